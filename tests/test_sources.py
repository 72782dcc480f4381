"""GraphQL reads, the key-value store, loaders and result text."""

import json

import pytest

from loomgraph.errors import ArgumentError
from loomgraph.operators.kv import Store
from loomgraph.plans.compiler import cypher, execute
from loomgraph.plans.graphql import graphql, graphql_frames
from loomgraph.sources.files import load_graph, prepare_trips, result_json, run_script, save_graph, statements, trip_graph
from loomgraph.sources.graph import PropertyGraph


@pytest.fixture(scope="module")
def town(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Ben", None)], "id long, name string, age long")
    firm = spark.createDataFrame([(10, "Mill")], "id long, name string")
    knows = spark.createDataFrame([(1, 1, 2, 2001), (2, 2, 1, 2002)], "id long, start long, end long, since long")
    works = spark.createDataFrame([(1, 1, 10)], "id long, start long, end long")
    return PropertyGraph({"Person": people, "Firm": firm}, {"KNOWS": (knows, "Person", "Person"), "WORKS": (works, "Person", "Firm")})


def test_graphql(spark, town):
    found = graphql(town, '{ nodes { id labels } n1: nodes(label: "Firm") { properties } __typename }', spark)
    assert found["data"] == {"nodes": [{"id": 1, "labels": ["Person"]}, {"id": 2, "labels": ["Person"]}, {"id": 10, "labels": ["Firm"]}], "n1": [{"properties": {"name": "Mill"}}], "__typename": "Query"}
    assert [n["id"] for n in found["extensions"]["graph"]["nodes"]] == [1, 2, 10]
    text = """query Q($l: String = "Person", $n: Int) { nodes(label: $l, limit: $n) { ...F relationships(direction: BOTH, type: "KNOWS") { id type start to { id ... on Node { labels } } } } }
    fragment F on Node @skip(if: false) { id properties }"""
    found = graphql(town, text, spark, {"n": 1})
    rels = [{"id": 1, "type": "KNOWS", "start": 1, "to": {"id": 2, "labels": ["Person"]}}, {"id": 2, "type": "KNOWS", "start": 2, "to": {"id": 1, "labels": ["Person"]}}]
    assert found["data"] == {"nodes": [{"id": 1, "properties": {"name": "Ann", "age": 30}, "relationships": rels}]}
    assert [e["id"] for e in found["extensions"]["graph"]["edges"]] == [1, 2] and {n["id"] for n in found["extensions"]["graph"]["nodes"]} == {1, 2}
    found = graphql(town, '{ node(id: 1) { out(limit: 1) { type properties } in { from { properties } } } none: node(id: 99) { id } relationship(id: 2) { type } relationships(type: "WORKS") { start end } }', spark)["data"]
    assert found["node"] == {"out": [{"type": "KNOWS", "properties": {"since": 2001}}], "in": [{"from": {"properties": {"name": "Ben"}}}]}
    assert found["none"] is None and found["relationship"] == {"type": "KNOWS"} and found["relationships"] == [{"start": 1, "end": 10}]
    for bad in ("{ nodes { bogus } }", "{ nodes {", "{ bogus }", "mutation { x }", "{ nodes(limit: -1) { id } }", '{ node(id: 1) { relationships(direction: "UP") { id } } }', "{ nodes { ...Nope } }"):
        found = graphql(town, bad, spark)
        assert found["data"] is None and found["errors"][0]["message"]
    assert graphql_frames(town, "{ nodes { id } }", spark)["nodes"].count() == 3


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"))
    store.put("a:1", "x")
    store.bulk_put([("a:2", "y"), ("b:1", "z"), ("__hidden", "h"), ("a:2", "yy")])
    store.put("a:1", "x2")
    store.delete("b:1")
    assert store.get("a:1") == "x2" and store.get("b:1") is None
    assert [tuple(r) for r in store.scan("a:").collect()] == [("a:1", "x2"), ("a:2", "yy")]
    assert [r["key"] for r in store.scan("", offset=1, limit=5).collect()] == ["a:2"]
    store.create_database("more")
    store.put("k", "v", "more")
    assert store.databases() == {"default": 2, "more": 1}
    for fault in (lambda: store.put("k", "v", "none"), lambda: store.drop_database("default"), lambda: store.create_database("more")):
        with pytest.raises(ArgumentError):
            fault()
    store.snapshot(str(tmp_path / "snap"))
    store.delete("a:1")
    store.put("c", "new")
    store.restore(str(tmp_path / "snap"))
    assert [tuple(r) for r in store.scan().collect()] == [("a:1", "x2"), ("a:2", "yy")]
    assert store.command("use more") == ("ok", "more") and store.command("get k", "more") == ('"v"', "more")
    assert json.loads(store.command("scan a:")[0]) == [["a:1", "x2"], ["a:2", "yy"]]
    store.drop_database("more")
    assert store.databases() == {"default": 2}


def test_trips(spark, tmp_path):
    (tmp_path / "zones.csv").write_text("id,borough,zone,service_zone\n1,B,Old Town,X\n2,B,Port,X\nx,none,none,none\n")
    (tmp_path / "trips.csv").write_text("pickup,dropoff,distance,fare,passengers\n1,2,3.5,10.0,1\n2,1,1.0,5.0,2\n1,9,1.0,5.0,2\n1,1,,,\n")
    graph = trip_graph(spark, str(tmp_path / "zones.csv"), str(tmp_path / "trips.csv"))
    found = cypher(graph, "MATCH (a:Zone)-[r:TRIP]->(:Zone) RETURN a.zone AS zone, count(*) AS n, sum(r.fare) AS f ORDER BY n DESC", spark).collect()
    assert [tuple(r) for r in found] == [("Old Town", 2, 10.0), ("Port", 1, 5.0)]
    records = spark.createDataFrame([(1, 2, 1.0, 2.0, 1.0), (1, 2, None, 3.0, None), (0, 2, 1.0, 1.0, 1.0)], "PULocationID int, DOLocationID int, trip_distance double, fare_amount double, passenger_count double")
    assert [tuple(r) for r in prepare_trips(records, True).collect()] == [(1, 2, 2, 1.0, 5.0, 1)]


def test_script_and_snapshot(spark, tmp_path):
    script = """// a film; with people
    CREATE CONSTRAINT x IF NOT EXISTS FOR (n:Person) REQUIRE n.name IS UNIQUE;
    CREATE (m:Movie {title: 'The ; Net // 2'}) CREATE (p:Person:Actor {name: "Kim"})-[:ACTED_IN {roles: ['A']}]->(m);
    MATCH (p:Person) SET p.seen = true;"""
    assert len(statements(script)) == 2
    graph = run_script(PropertyGraph({}, {}), script, spark)
    save_graph(graph, str(tmp_path / "g"))
    for g in (graph, load_graph(spark, str(tmp_path / "g"))):
        assert [tuple(r) for r in cypher(g, "MATCH (p:Actor)-[r]->(m) RETURN p.name, r.roles, m.title, p.seen", spark).collect()] == [("Kim", ["A"], "The ; Net // 2", True)]


def test_result_text(spark, town):
    df = cypher(town, "MATCH p = (a:Person {name: 'Ann'})-[r:WORKS]->(b) RETURN a, r, p, date('2020-01-02') AS d, duration('P1D') AS u, [1.5, 0.0 / 0.0] AS l", spark)
    found = result_json(df)
    json.dumps(found)
    ann = {"~t": "node", "id": 1, "labels": ["Person"], "properties": {"name": "Ann", "age": 30}}
    rel = {"~t": "relationship", "id": 1, "type": "WORKS", "start": 1, "end": 10, "properties": {}}
    assert found["count"] == 1 and found["columns"] == ["a", "r", "p", "d", "u", "l"]
    a, r, p, d, u, l = found["rows"][0]
    assert a == ann and r == rel and p["relationships"] == [rel] and p["nodes"][0] == ann and p["nodes"][1]["labels"] == ["Firm"]
    assert d == {"~t": "date", "v": "2020-01-02"} and u["~t"] == "duration" and l == [1.5, {"~t": "float", "v": "nan"}]
    assert execute(town, "MATCH (n) RETURN n", spark)[1] is town
