"""The query catalogue: one query per operator over the star graph, and equal SQL over its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import cypher, execute
from ..plans.graphql import graphql_frames
from ..sources.graph import star_graph
from . import kv

K = 48

#: name -> (query, SQL)
GRAPH_QUERIES: dict[str, tuple[str, str]] = {
    "scan_label": ("MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region"),
    "scan_all_labels": (
        "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents",
    ),
    "rel_counts_by_type": (
        "MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n",
        "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'DID', count(*) FROM events UNION ALL SELECT 'NEXT', count(*) - count(DISTINCT user_id) FROM events",
    ),
    "point_lookup": ("MATCH (c:Customer) WHERE c.key = 42 RETURN c.name AS name, id(c) AS id", f"SELECT c_name AS name, (3::BIGINT << {K}) + c_custkey AS id FROM customer WHERE c_custkey = 42"),
    "filter_cmp": ("MATCH (p:Part) WHERE p.size > 40 AND p.type = 'PROMO' RETURN p.key AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 40 AND p_type = 'PROMO'"),
    "filter_string": ("MATCH (p:Part) WHERE p.name STARTS WITH 'P' OR p.name ENDS WITH '7' OR p.name CONTAINS '99' RETURN p.key AS k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'P') OR ends_with(p_name, '7') OR contains(p_name, '99')"),
    "filter_in": ("MATCH (n:Nation) WHERE n.key IN [1, 3, 5] RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5)"),
    "chained_cmp": ("MATCH (p:Part) WHERE 10 < p.size <= 20 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size > 10 AND p_size <= 20"),
    "three_valued": ("MATCH (p:Part) WHERE NOT (p.size > 25 XOR p.type = 'PROMO') OR p.none = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE (p_size > 25) = (p_type = 'PROMO')"),
    "inline_props": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN n.name AS name", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN c.key AS c, o.key AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'"),
    "expand_in": ("MATCH (n:Nation)<-[:LIVES_IN]-(c) RETURN n.name AS name, count(c) AS n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "expand_both": (
        "MATCH (a:Event)-[:NEXT]-(b) RETURN a.key AS a, count(b) AS n",
        "WITH x AS (SELECT event_id a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) SELECT a, count(*) AS n FROM (SELECT a, b FROM x WHERE b IS NOT NULL UNION ALL SELECT b, a FROM x WHERE b IS NOT NULL) GROUP BY a",
    ),
    "three_hop": (
        "MATCH (r:Region)<-[:IN_REGION]-(n)<-[:LIVES_IN]-(c)-[:PLACED]->(o) RETURN r.name AS region, count(*) AS orders",
        "SELECT r_name AS region, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "type_alternation": ("MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.key AS k, count(x) AS n", "SELECT k::BIGINT AS k, count(*) AS n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "cycle_close": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n)<-[:BASED_IN]-(s:Supplier) RETURN c.key AS c, s.key AS s",
        "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    ),
    "rel_uniqueness": ("MATCH (p1:Part)<-[:CONTAINS]-(o)-[:CONTAINS]->(p2:Part) RETURN count(*) AS n", "SELECT sum(c * (c - 1))::BIGINT AS n FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey)"),
    "multi_chain_join": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[r:CONTAINS]->(p:Part) WHERE p.size = 7 RETURN c.key AS c, count(r) AS n",
        "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7 GROUP BY 1",
    ),
    "cartesian": ("MATCH (a:Region), (b:Region) RETURN a.key AS a, b.key AS b", "SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a, region b"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.key < b.key AND a.name > b.name RETURN a.key AS a, b.key AS b", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_name > b.n_name"),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' RETURN c.key AS c, count(o) AS n",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1",
    ),
    "filter_null": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {priority: '1-URGENT'}) WITH c, o WHERE o IS NULL RETURN c.key AS c",
        "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "exists_pattern": ("MATCH (o:Order) WHERE (o)-[:CONTAINS]->(:Part {size: 9}) RETURN o.key AS o", "SELECT o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 9)"),
    "not_exists_pattern": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {status: 'P'}) RETURN c.key AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "exists_subquery": (
        "MATCH (o:Order) WHERE EXISTS { MATCH (o)-[r:CONTAINS]->(p) WHERE r.quantity > 45 AND p.size > 45 } RETURN count(o) AS n",
        "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND p_size > 45)",
    ),
    "exists_value": (
        "MATCH (s:Supplier) RETURN s.key AS s, exists((s)-[:SUPPLIES]->(:Part {size: 1})) OR s.key < 3 AS hit",
        "SELECT s_suppkey AS s, s_suppkey < 3 OR EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size = 1) AS hit FROM supplier",
    ),
    "pattern_comprehension": (
        "MATCH (c:Customer) RETURN c.key AS c, size([(c)-[:PLACED]->(o) WHERE o.status = 'F' | o.key]) AS n",
        "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer",
    ),
    "label_predicate": ("MATCH (x)-[:LIVES_IN|BASED_IN]->(:Nation {key: 3}) WHERE x:Supplier RETURN x.key AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 3"),
    "path_length": ("MATCH p = (r:Region)<-[:IN_REGION]-()<-[:LIVES_IN]-(c) RETURN length(p) AS l, size(nodes(p)) AS n, count(*) AS c", "SELECT 2::BIGINT AS l, 3::BIGINT AS n, count(*) AS c FROM customer"),
    "varlen_fixed": (
        "MATCH (a:Event)-[:NEXT*2]->(b) RETURN a.key AS a, b.key AS b",
        "SELECT a, b FROM (SELECT event_id a, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NOT NULL",
    ),
    "varlen_range": (
        "MATCH p = (a:Event)-[rs:NEXT*1..3]->(b) RETURN length(p) AS l, size(rs) AS r, count(*) AS n",
        "WITH c AS (SELECT count(*) k FROM events GROUP BY user_id) SELECT l, l AS r, sum(greatest(k - l, 0))::BIGINT AS n FROM c, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) v(l) GROUP BY l",
    ),
    "varlen_unbounded": (
        "MATCH (u:User) WHERE u.key < 10 MATCH (u)-[:DID]->(a:Event)-[:NEXT*]->(b:Event) RETURN a.key AS a, b.key AS b",
        "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id < 10) SELECT x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.r < y.r",
    ),
    "varlen_zero": ("MATCH (a:Event)-[:NEXT*0..1]->(b:Event) RETURN count(*) AS n", "SELECT 2 * count(*) - count(DISTINCT user_id) AS n FROM events"),
    "agg_basic": (
        "MATCH (o:Order) RETURN o.status AS s, count(*) AS n, count(DISTINCT o.priority) AS p, sum(o.key) AS total, min(o.key) AS lo, max(o.key) AS hi",
        "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_orderpriority) AS p, sum(o_orderkey)::BIGINT AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1",
    ),
    "agg_avg": ("MATCH (p:Part) RETURN p.type AS t, avg(p.size) AS a", "SELECT p_type AS t, avg(p_size) AS a FROM part GROUP BY 1"),
    "agg_collect": (
        "MATCH (n:Nation)-[:IN_REGION]->(r) WITH r.name AS r, n.name AS n ORDER BY n RETURN r, size(collect(n)) AS k, size(collect(DISTINCT n)) AS d",
        "SELECT r_name AS r, count(*) AS k, count(DISTINCT n_name) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "percentile_cont": ("MATCH (p:Part) RETURN p.type AS t, percentileCont(p.size, 0.25) AS q", "SELECT p_type AS t, quantile_cont(p_size::DOUBLE, 0.25) AS q FROM part GROUP BY 1"),
    "percentile_disc": ("MATCH (p:Part) RETURN p.type AS t, percentileDisc(p.size, 0.5) AS q", "SELECT p_type AS t, quantile_disc(p_size, 0.5) AS q FROM part GROUP BY 1"),
    "agg_empty": ("MATCH (n:Region) WHERE n.key < 0 RETURN count(*) AS n, sum(n.key) AS s, size(collect(n.key)) AS c", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS c"),
    "agg_nested_expr": ("MATCH (o:Order) RETURN o.status AS s, 1 + count(*) * 2 AS n, max(o.key) - min(o.key) AS d", "SELECT o_orderstatus AS s, 1 + count(*) * 2 AS n, max(o_orderkey) - min(o_orderkey) AS d FROM orders GROUP BY 1"),
    "having": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 14 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 14"),
    "order_on_agg": (
        "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.key AS c, count(*) AS n ORDER BY count(*) DESC, c LIMIT 10",
        "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, c LIMIT 10",
    ),
    "distinct_rows": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.type AS t", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "union_all": ("MATCH (r:Region) RETURN r.name AS x UNION ALL MATCH (n:Nation) RETURN n.name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.mktsegment AS x UNION MATCH (c:Customer) WHERE c.key < 9 RETURN c.mktsegment AS x", "SELECT DISTINCT c_mktsegment AS x FROM customer"),
    "unwind_range": ("UNWIND range(1, 9, 2) AS x RETURN x, x * x AS y", "SELECT x, x * x AS y FROM range(1, 10, 2) t(x)"),
    "unwind_collect": ("MATCH (r:Region) WITH collect(r.name) AS names UNWIND names AS name RETURN name, size(names) AS n", "SELECT r_name AS name, (SELECT count(*) FROM region) AS n FROM region"),
    "topk": ("MATCH (o:Order) RETURN o.key AS k, o.totalprice AS t ORDER BY o.totalprice DESC, o.key LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 20"),
    "skip_limit": ("MATCH (n:Nation) RETURN n.name AS name ORDER BY name SKIP 5 LIMIT 7", "SELECT n_name AS name FROM nation ORDER BY 1 OFFSET 5 LIMIT 7"),
    "order_nulls": (
        "MATCH (n:Nation) WITH CASE WHEN n.key > 20 THEN null ELSE n.key END AS k RETURN k ORDER BY k DESC LIMIT 6",
        "SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_nationkey END::BIGINT AS k FROM nation ORDER BY k DESC NULLS FIRST LIMIT 6",
    ),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "case_generic": ("MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 1 WHEN p.size < 30 THEN 2 END AS c, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 END::BIGINT AS c, count(*) AS n FROM part GROUP BY 1"),
    "list_ops": (
        "MATCH (n:Nation) WITH n.key AS k, [1, n.key, 3] + 4 AS l RETURN k, l[1] AS i, l[-1] AS neg, size(l[1..]) AS s, size([x IN l WHERE x > 2 | x]) AS c",
        "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT AS i, NULL::BIGINT AS neg, 3::BIGINT AS s, 2 + (n_nationkey > 2)::BIGINT AS c FROM nation",
    ),
    "quantifiers": (
        "MATCH (n:Nation) RETURN n.key AS k, all(x IN [1, 2] WHERE x < n.key) AS a, any(x IN [1, 2] WHERE x = n.key) AS b, none(x IN [1, 2] WHERE x = n.key) AS c, single(x IN [1, 2] WHERE x < n.key) AS d",
        "SELECT n_nationkey::BIGINT AS k, n_nationkey > 2 AS a, n_nationkey IN (1, 2) AS b, n_nationkey NOT IN (1, 2) AS c, n_nationkey = 2 AS d FROM nation",
    ),
    "arithmetic": (
        "MATCH (n:Nation) RETURN n.key AS k, n.key / 4 AS d, n.key % 3 AS m, n.key / 0 AS z, 2 ^ n.key AS p, -n.key AS neg",
        "SELECT n_nationkey::BIGINT AS k, (n_nationkey // 4)::BIGINT AS d, (n_nationkey % 3)::BIGINT AS m, NULL::BIGINT AS z, pow(2, n_nationkey) AS p, -n_nationkey::BIGINT AS neg FROM nation",
    ),
    "str_funcs": (
        "MATCH (n:Nation) RETURN toUpper(n.name) AS u, toLower(n.name) AS l, substring(n.name, 1, 3) AS s, left(n.name, 2) AS a, right(n.name, 2) AS b, reverse(n.name) AS r, size(n.name) AS z, replace(n.name, 'A', '_') AS p, split(n.name, 'A')[0] AS f, trim('  x ') AS t",
        "SELECT upper(n_name) AS u, lower(n_name) AS l, substring(n_name, 2, 3) AS s, left(n_name, 2) AS a, right(n_name, 2) AS b, reverse(n_name) AS r, length(n_name) AS z, replace(n_name, 'A', '_') AS p, split_part(n_name, 'A', 1) AS f, 'x' AS t FROM nation",
    ),
    "num_funcs": (
        "MATCH (p:Part) RETURN p.key AS k, abs(-p.size) AS a, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, round(p.retailprice) AS r, sign(p.size) AS s",
        "SELECT p_partkey AS k, p_size AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, round_even(p_retailprice, 0)::BIGINT AS r, sign(p_size)::BIGINT AS s FROM part",
    ),
    "conv_funcs": (
        "MATCH (n:Nation) RETURN n.key AS k, toString(n.key) AS s, toInteger('12') AS i, toInteger('x') AS j, toFloat('1.5') AS f, toBoolean('TRUE') AS b, coalesce(n.none, n.name) AS c",
        "SELECT n_nationkey::BIGINT AS k, n_nationkey::VARCHAR AS s, 12::BIGINT AS i, NULL::BIGINT AS j, 1.5::DOUBLE AS f, true AS b, n_name AS c FROM nation",
    ),
    "date_components": (
        "MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.month AS m, o.orderdate.quarter AS q, count(*) AS n",
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY ALL",
    ),
    "date_truncate": ("MATCH (o:Order) RETURN date.truncate('month', o.orderdate) AS d, count(*) AS n", "SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1"),
    "date_compare": ("MATCH (o:Order) WHERE date(o.orderdate) < date('1995-01-01') RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate::DATE < DATE '1995-01-01'"),
    "keys_of": ("MATCH (r:Region) RETURN r.key AS k, size(keys(r)) AS n", "SELECT r_regionkey::BIGINT AS k, 2::BIGINT AS n FROM region"),
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS seg, count(*) AS n ORDER BY n DESC",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "busiest_parts": (
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.type AS t, count(r) AS n, count(DISTINCT o) AS orders ORDER BY n DESC",
        "SELECT p_type AS t, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "co_purchase": (
        "MATCH (a:Part {key: 5})<-[:CONTAINS]-(o)-[:CONTAINS]->(b:Part) WHERE b.key <> 5 RETURN b.key AS b, count(DISTINCT o) AS n",
        "SELECT y.l_partkey AS b, count(DISTINCT y.l_orderkey) AS n FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_partkey = 5 AND y.l_partkey <> 5 GROUP BY 1",
    ),
    "two_hop": (
        "MATCH (r:Region)<-[:IN_REGION]-(n)<-[:BASED_IN]-(s) RETURN r.name AS region, count(s) AS n",
        "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "lookup_by_id": (f"MATCH (c:Customer) WHERE id(c) = {(3 << K) + 42} RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 42"),
    "rel_limit": ("MATCH ()-[r:SUPPLIES]->() WITH r LIMIT 100 RETURN count(r) AS n", "SELECT least(count(*), 100) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    "bound_rel": (
        "MATCH (:Customer)-[r:PLACED]->(o:Order) WHERE o.status = 'P' WITH r MATCH (a)-[r]->(b) RETURN a.key AS c, b.key AS o",
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'",
    ),
    "bound_end": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) MATCH (s:Supplier {key: 3})-[:BASED_IN]->(n) RETURN c.key AS c",
        "SELECT c_custkey AS c FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey = 3",
    ),
    "bound_rel_list": (
        "MATCH (u:User)-[:DID]->(a:Event)-[rs:NEXT*2]->() WHERE u.key < 20 WITH a, rs MATCH (a)-[rs*]->(b) RETURN a.key AS a, b.key AS b",
        "SELECT a, b FROM (SELECT event_id a, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events WHERE user_id < 20) WHERE b IS NOT NULL",
    ),
    "varlen_rel_list": (
        "MATCH (u:User)-[:DID]->(a:Event)-[rs:NEXT*2]->() WHERE u.key < 20 UNWIND rs AS r RETURN a.key AS a, id(r) AS r",
        "WITH e AS (SELECT event_id AS a, lead(event_id) OVER w AS b, lead(event_id, 2) OVER w AS c FROM events WHERE user_id < 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, a AS r FROM e WHERE c IS NOT NULL UNION ALL SELECT a, b FROM e WHERE c IS NOT NULL",
    ),
    "varlen_after_step": (
        "MATCH (a:Event)-[:NEXT]->(b)-[:NEXT*1..2]-(c) RETURN count(*) AS n",
        "SELECT sum(greatest(k - 2, 0) + greatest(k - 3, 0))::BIGINT AS n FROM (SELECT count(*) k FROM events GROUP BY user_id)",
    ),
    "start_node": ("MATCH ()-[r:IN_REGION]->() RETURN startNode(r).name AS n, endNode(r).name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_nodes": (
        "MATCH p = (r:Region)<-[:IN_REGION]-(n)<-[:BASED_IN]-(s) RETURN s.key AS s, nodes(p)[0].name + '/' + nodes(p)[1].name AS way, size([x IN relationships(p) WHERE type(x) = 'BASED_IN']) AS k",
        "SELECT s_suppkey AS s, r_name || '/' || n_name AS way, 1::BIGINT AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "exists_full": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 14 RETURN true } RETURN c.key AS c",
        "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) > 14",
    ),
    "cross_type": ("MATCH (p:Part) RETURN p.key AS k, p.size = p.type AS e, p.size <> p.type AS d, p.size < p.type AS l", "SELECT p_partkey AS k, false AS e, true AS d, NULL::BOOLEAN AS l FROM part"),
    "single_null": (
        "MATCH (n:Nation) WITH n, CASE WHEN n.key > 10 THEN null ELSE n.key END AS v RETURN n.key AS k, single(x IN [v, 3] WHERE x = 3) AS s, [v, 1] = [2, 1] AS e",
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey <= 10 THEN n_nationkey <> 3 END AS s, CASE WHEN n_nationkey <= 10 THEN n_nationkey = 2 END AS e FROM nation",
    ),
    "list_types": (
        "MATCH (n:Nation) RETURN n.key AS k, [x IN [n.key] | x / 2][0] AS h, [x IN [n.name] | x + '!'][0] AS s, size([x IN [[n.key], []] | size(x)]) AS z",
        "SELECT n_nationkey::BIGINT AS k, (n_nationkey // 2)::BIGINT AS h, n_name || '!' AS s, 2::BIGINT AS z FROM nation",
    ),
    "map_literal": ("MATCH (n:Nation) RETURN {a: n.key, b: {c: n.name}}.b.c AS c, n['name'] AS name, {a: n.key}['a'] AS a", "SELECT n_name AS c, n_name AS name, n_nationkey::BIGINT AS a FROM nation"),
    "list_funcs": (
        "MATCH (n:Nation) RETURN n.key AS k, head([n.key, 7]) AS h, last([n.key, 7]) AS l, size(tail([n.key, 7])) AS t, properties(n).name AS name, reverse([n.key, 7])[0] AS r",
        "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT AS h, 7::BIGINT AS l, 1::BIGINT AS t, n_name AS name, 7::BIGINT AS r FROM nation",
    ),
    "distinct_on_groups": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n RETURN DISTINCT n", "SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey"),
    "return_all": ("MATCH (r:Region) WITH r.key AS k, r.name AS name RETURN *", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region"),
    "date_parse": (
        "MATCH (r:Region) RETURN r.key AS k, toString(date('2015-W30-2')) AS w, toString(date('2015-202')) AS o, toString(date({year: 1984, week: 10, dayOfWeek: 3})) AS m, toString(datetime('2015-07-21T21:40:32+01:00')) AS z, toString(time('214032.142+0100')) AS t",
        "SELECT r_regionkey::BIGINT AS k, '2015-07-21' AS w, '2015-07-21' AS o, '1984-03-07' AS m, '2015-07-21T21:40:32+01:00' AS z, '21:40:32.142+01:00' AS t FROM region",
    ),
    "date_plus_duration": (
        "MATCH (o:Order) RETURN o.key AS k, date(o.orderdate) + duration('P1M2D') AS d, date(o.orderdate) - duration({weeks: 1}) AS e",
        "SELECT o_orderkey AS k, (o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 2 DAY)::DATE AS d, (o_orderdate::DATE - INTERVAL 7 DAY)::DATE AS e FROM orders",
    ),
    "duration_between": (
        "MATCH (o:Order) WITH o.key AS k, date('1992-01-01') AS a, date(o.orderdate) AS b RETURN k, duration.inDays(a, b).days AS d, duration.between(a, b).months AS m, duration.between(a, b).days AS r",
        "SELECT o_orderkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d, date_diff('month', DATE '1992-01-01', o_orderdate::DATE) AS m, (day(o_orderdate) - 1)::BIGINT AS r FROM orders",
    ),
    "duration_parts": (
        "MATCH (e:Event) WITH e.key AS k, duration({months: e.key % 30, hours: e.key}) AS d RETURN k, d.years AS y, d.monthsOfYear AS m, d.seconds AS s, toString(d * 2) AS t",
        "SELECT event_id AS k, (event_id % 30) // 12 AS y, (event_id % 30) % 12 AS m, event_id * 3600 AS s, CASE WHEN event_id = 0 THEN 'PT0S' ELSE 'P' || CASE WHEN (event_id % 30) * 2 // 12 > 0 THEN ((event_id % 30) * 2 // 12) || 'Y' ELSE '' END || CASE WHEN (event_id % 30) * 2 % 12 > 0 THEN ((event_id % 30) * 2 % 12) || 'M' ELSE '' END || 'T' || (event_id * 2) || 'H' END AS t FROM events",
    ),
    "epoch": (
        "MATCH (e:Event) RETURN e.key AS k, e.ts.epochSeconds AS s, datetime.fromepoch(e.key, 0).epochMillis AS f, toString(date(datetime.fromepochmillis(e.key * 86400000))) AS d",
        "SELECT event_id AS k, epoch_us(ts) // 1000000 AS s, event_id * 1000 AS f, strftime(DATE '1970-01-01' + event_id::INTEGER, '%Y-%m-%d') AS d FROM events WHERE event_id >= 0",
    ),
    "date_units": (
        "MATCH (o:Order) WITH o.key AS k, date(o.orderdate) AS d RETURN k, d.week AS w, d.weekYear AS wy, d.dayOfQuarter AS q, date.truncate('week', d) AS t, date.truncate('decade', d) AS c",
        "SELECT o_orderkey AS k, weekofyear(o_orderdate) AS w, isoyear(o_orderdate) AS wy, date_diff('day', date_trunc('quarter', o_orderdate), date_trunc('day', o_orderdate)) + 1 AS q, date_trunc('week', o_orderdate)::DATE AS t, make_date(year(o_orderdate) // 10 * 10, 1, 1) AS c FROM orders",
    ),
    "pickup_sums": ("MATCH (a:Supplier)-[r:SUPPLIES]->(:Part) RETURN a.name AS name, sum(r.n) AS n ORDER BY n DESC, name LIMIT 5", "SELECT s_name AS name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY n DESC, name LIMIT 5"),
    "top_by_average": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS s, avg(o.key) AS a, count(*) AS n ORDER BY s LIMIT 3",
        "SELECT c_mktsegment AS s, avg(o_orderkey) AS a, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY s LIMIT 3",
    ),
    "largest_collected": (
        "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, collect(c.name) AS held RETURN n.name AS name, size(held) AS k ORDER BY k DESC, name LIMIT 3",
        "SELECT n_name AS name, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY k DESC, name LIMIT 3",
    ),
    "by_decade": ("MATCH (p:Part) RETURN toInteger(p.size / 10) * 10 AS d, count(*) AS n ORDER BY d", "SELECT (p_size // 10 * 10)::BIGINT AS d, count(*) AS n FROM part GROUP BY 1"),
    "within_hops": (
        "MATCH p = (a:Supplier {key: 1})-[:SUPPLIES*1..2]-(b) RETURN length(p) AS hops, count(*) AS n",
        "WITH s AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem) SELECT 1::BIGINT AS hops, count(*) AS n FROM s WHERE s = 1 UNION ALL SELECT 2, count(*) FROM s x JOIN s y ON x.p = y.p AND y.s <> 1 WHERE x.s = 1",
    ),
    "self_named": (
        "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE c.key = s.key RETURN DISTINCT n.name AS name",
        "SELECT DISTINCT n_name AS name FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey",
    ),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cypher(star_graph(spark, sf_dir), text, spark)


def _call_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.register_procedure("tax.rate", ["segment"], spark.createDataFrame([("BUILDING", 5), ("MACHINERY", 7)], "segment string, rate long"))
    return cypher(graph, "MATCH (c:Customer) CALL tax.rate(c.mktsegment) YIELD rate AS r RETURN r, count(*) AS n", spark)


def _call_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.register_procedure("graph.segments", [], graph.nodes["Customer"].select("mktsegment").distinct())
    return cypher(graph, "CALL graph.segments() YIELD mktsegment AS s RETURN s, size(s) AS n", spark)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value log of the events: one database for each user's number modulo 3, deletions at errors."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('db', user_id % 3) AS db", "concat('user:', user_id) AS key", "cast(value AS string) AS value", "event_id AS seq", "if(event_type = 'error', 'DELETE', 'PUT') AS op")


def _kv_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(_log(spark, sf_dir).drop("db")).select("key", "value")


def _kv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.log import followed

    return followed(spark, f"{sf_dir}/events.parquet", lambda rows: rows.selectExpr("concat('user:', user_id) AS key", "cast(value AS string) AS value", "event_id AS seq", "if(event_type = 'error', 'DELETE', 'PUT') AS op")).select("key", "value")


def _changed(change: str, then: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher(execute(star_graph(spark, sf_dir), change, spark)[1], then, spark)

    return run


def _gql_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graphql_frames(star_graph(spark, sf_dir), '{ c: nodes(label: "Customer") { id kind: labels } }', spark)["c"]
    return found.select(F.col("value.id").alias("id"), F.col("value.kind")[0].alias("kind"))


def _gql_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'query ($l: String = "Nation") { nodes(label: $l) { id in(type: "BASED_IN") { id from { ...F } } out { to { id } } } } fragment F on Node { labels }'
    found = graphql_frames(star_graph(spark, sf_dir), text, spark)["nodes"]
    return found.select("id", F.size("value.in").cast("long").alias("n"), F.array_min(F.transform("value.in", lambda x: x["id"])).alias("least"), F.col("value.out")[0]["to"]["id"].alias("region"))


#: name -> (change, query of the graph after it, SQL)
CHANGES = {
    "upd_create": (
        "MATCH (c:Customer) WHERE c.key < 50 CREATE (c)-[:HOLDS {since: 1}]->(a:Account {of: c.key})",
        "MATCH (c:Customer)-[h:HOLDS]->(a:Account) RETURN c.key AS c, a.of AS o, h.since AS s",
        "SELECT c_custkey AS c, c_custkey AS o, 1::BIGINT AS s FROM customer WHERE c_custkey < 50",
    ),
    "upd_merge": (
        "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.new = true MERGE (c)-[:IN]->(s)",
        "MATCH (c:Customer)-[:IN]->(s:Segment) RETURN s.name AS name, s.new AS new, count(c) AS n",
        "SELECT c_mktsegment AS name, true AS new, count(*) AS n FROM customer GROUP BY 1",
    ),
    "upd_set": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) SET n.region = r.name, n:Place", "MATCH (n:Place) RETURN n.name AS name, n.region AS region", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "upd_remove": ("MATCH (p:Part) WHERE p.size > 25 REMOVE p.size", "MATCH (p:Part) WHERE p.size IS NULL RETURN p.key AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 25"),
    "upd_detach_delete": (
        "MATCH (o:Order {status: 'P'}) DETACH DELETE o",
        "MATCH ()-[r:PLACED|CONTAINS]->() RETURN type(r) AS t, count(*) AS n",
        "SELECT 'PLACED' AS t, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'",
    ),
}
_LAST = "SELECT db, key, value FROM (SELECT 'db' || (user_id % 3) AS db, 'user:' || user_id AS key, arg_max(event_id, event_id) AS e, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id) JOIN (SELECT event_id, value::VARCHAR AS value FROM events) ON e = event_id WHERE op <> 'error'"

GRAPH_CALLABLES = {name: _query(text) for name, (text, _) in GRAPH_QUERIES.items()} | {name: _changed(change, then) for name, (change, then, _) in CHANGES.items()} | {
    "call_args": _call_args,
    "call_yield": _call_yield,
    "kv_replay": _kv_replay,
    "kv_stream": _kv_stream,
    "kv_prefix_scan": lambda spark, sf_dir: kv.prefix_scan(kv.replay(_log(spark, sf_dir)).select("key", "value"), "user:1"),
    "kv_scan_page": lambda spark, sf_dir: kv.prefix_scan(kv.replay(_log(spark, sf_dir)).select("key", "value"), "user:", 5, 20),
    "kv_scan_fast": lambda spark, sf_dir: kv.scan_fast(kv.replay(_log(spark, sf_dir)).select("key", "value"), "user:2"),
    "db_counts": lambda spark, sf_dir: kv.database_counts(kv.replay(_log(spark, sf_dir))),
    "graph_counts": lambda spark, sf_dir: star_graph(spark, sf_dir).counts().where("name IN ('Order', 'Part', 'PLACED', 'NEXT')"),
    "gql_nodes": _gql_nodes,
    "gql_nested": _gql_nested,
}
GRAPH_SQL = {name: sql for name, (_, sql) in GRAPH_QUERIES.items()} | {name: sql for name, (_, _, sql) in CHANGES.items()} | {
    "call_args": "SELECT r, count(*) AS n FROM customer JOIN (VALUES ('BUILDING', 5::BIGINT), ('MACHINERY', 7::BIGINT)) t(s, r) ON s = c_mktsegment GROUP BY 1",
    "call_yield": "SELECT DISTINCT c_mktsegment AS s, length(c_mktsegment) AS n FROM customer",
    "kv_replay": f"SELECT key, value FROM ({_LAST})",
    "kv_stream": f"SELECT key, value FROM ({_LAST})",
    "kv_prefix_scan": f"SELECT key, value FROM ({_LAST}) WHERE starts_with(key, 'user:1') ORDER BY key",
    "kv_scan_page": f"SELECT key, value FROM ({_LAST}) ORDER BY key OFFSET 5 LIMIT 20",
    "kv_scan_fast": f"SELECT key, value FROM ({_LAST}) WHERE starts_with(key, 'user:2')",
    "db_counts": f"SELECT db, count(*) AS n FROM ({_LAST}) GROUP BY 1",
    "graph_counts": "SELECT 'node' AS kind, 'Order' AS name, count(*) AS n FROM orders UNION ALL SELECT 'node', 'Part', count(*) FROM part UNION ALL SELECT 'relationship', 'PLACED', count(*) FROM orders UNION ALL SELECT 'relationship', 'NEXT', count(*) - count(DISTINCT user_id) FROM events",
    "gql_nodes": f"SELECT (3::BIGINT << {K}) + c_custkey AS id, 'Customer' AS kind FROM customer",
    "gql_nested": f"SELECT (2::BIGINT << {K}) + n_nationkey AS id, count(s_suppkey) AS n, min(s_suppkey) AS least, (1::BIGINT << {K}) + any_value(n_regionkey) AS region FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
}
