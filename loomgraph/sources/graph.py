"""Property graphs as typed DataFrames: one for each node label and each relationship type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ProcedureError

#: Ids of different labels do not meet: the label's number stands above the key's 48 bits.
KEY_BITS = 48


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column of two types becomes the wider number, or text."""
    for c in set(a.columns) & set(b.columns):
        x, y = a.schema[c].dataType, b.schema[c].dataType
        if x != y:
            kinds = {type(x), type(y)}
            wide = y if isinstance(x, T.NullType) else x if isinstance(y, T.NullType) else T.LongType() if kinds <= {T.LongType, T.IntegerType} else T.DoubleType() if all(isinstance(t, T.NumericType) for t in (x, y)) else T.StringType()
            a, b = (df.withColumn(c, F.col(f"`{c}`").cast(wide)) for df in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


class PropertyGraph:
    """nodes: label -> DataFrame(id, properties...); rels: type -> (DataFrame(id, start, end, properties...), start label, end label).

    A node table may hold a column `labels` where its nodes have other labels than the table's name;
    `mixed` has the labels that such a table may hold. `wide` names relationships whose start or end is a row of the
    same table: ("start" | "end", the relationships with that node's columns, as `#n$name`), which spares a join.
    Changes make new graphs, which share what is unchanged, but for `wide`.
    """

    def __init__(self, nodes: dict[str, DataFrame], rels: dict[str, tuple[DataFrame, str | None, str | None]], procedures: dict | None = None, mixed: dict[str, set[str]] | None = None, wide: dict[str, tuple[str, DataFrame]] | None = None):
        self.nodes, self.rels, self.procedures, self.mixed, self.wide = nodes, rels, procedures if procedures is not None else {}, mixed or {}, wide or {}

    def changed(self, nodes: dict | None = None, rels: dict | None = None, mixed: dict | None = None) -> PropertyGraph:
        return PropertyGraph({**self.nodes, **(nodes or {})}, {**self.rels, **(rels or {})}, self.procedures, {**self.mixed, **(mixed or {})})

    def register_procedure(self, name: str, inputs: list[str], table: DataFrame, types: list[str] | None = None) -> None:
        """A table that CALL joins on its input columns; its other columns can be yielded. types: STRING, INTEGER, FLOAT or NUMBER of each input, `?` after it if null is allowed."""
        self.procedures[name] = (inputs, table, types)

    def procedure(self, name: str) -> tuple[list[str], DataFrame, list[str] | None]:
        if name not in self.procedures:
            raise ProcedureError("ProcedureNotFound", name)
        return self.procedures[name]

    def labelled(self, name: str) -> DataFrame:
        df = self.nodes[name]
        return df if "labels" in df.columns else df.withColumn("labels", F.array(F.lit(name)))

    def node_table(self, labels: set[str] | None) -> DataFrame | None:
        """Nodes of any of the labels (None: all), with `labels`; None if there is no such label."""
        some = []
        for x in self.nodes:
            if labels is None or (x in labels and x not in self.mixed):
                some.append(self.labelled(x))
            elif x in self.mixed and self.mixed[x] & labels:
                some.append(self.labelled(x).where(F.arrays_overlap("labels", F.array(*[F.lit(y) for y in sorted(labels)]))))
        return reduce(aligned, some) if some else None

    def rel_table(self, types: list[str]) -> DataFrame | None:
        """Relationships of any of the types (none given: all), with `type`."""
        some = [df.withColumn("type", F.lit(t)) for t, (df, _, _) in self.rels.items() if not types or t in types]
        return reduce(aligned, some) if some else None

    def endpoint_labels(self, types: list[str], end: int) -> set[str] | None:
        """Labels that the start (1) or end (2) of such relationships can have; None: any."""
        found = {r[end] for t, r in self.rels.items() if not types or t in types}
        return None if None in found or self.mixed else found

    def dangling(self) -> DataFrame:
        """(type, id) of relationships whose start or end is missing: empty in a sound graph."""
        ids = self.node_table(None).select(F.col("id").alias("n"))
        rels = self.rel_table([]).select("type", "id", "start", "end")
        return rels.join(ids, F.col("start") == F.col("n"), "left_anti").union(rels.join(ids, F.col("end") == F.col("n"), "left_anti")).select("type", "id").distinct()

    def counts(self) -> DataFrame:
        """(kind, name, n): nodes of each label and relationships of each type."""
        nodes = self.node_table(None).select(F.lit("node").alias("kind"), F.explode("labels").alias("name"))
        return nodes.union(self.rel_table([]).select(F.lit("relationship"), "type")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))

    # -- changes: each gives a new graph -----------------------------------------------------------

    def greatest_id(self) -> int:
        """The greatest id of any node or relationship, 0 if there is none."""
        tables = [*self.nodes.values(), *[df for df, _, _ in self.rels.values()]]
        if not tables:
            return 0
        return reduce(DataFrame.union, [t.agg(F.max("id").alias("m")) for t in tables]).agg(F.max("m")).first()[0] or 0

    def with_nodes(self, labels: list[str], rows: DataFrame) -> PropertyGraph:
        name = labels[0] if labels else ""
        if len(labels) != 1 or name in self.mixed:
            rows = rows.withColumn("labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
            table = aligned(self.labelled(name), rows) if name in self.nodes else rows
            return self.changed({name: table}, mixed={name: self.mixed.get(name, {name} if name in self.nodes else set()) | set(labels)})
        return self.changed({name: aligned(self.nodes[name], rows) if name in self.nodes else rows})

    def with_rels(self, name: str, rows: DataFrame, ends: tuple[str | None, str | None]) -> PropertyGraph:
        if name not in self.rels:
            return self.changed(rels={name: (rows, *ends)})
        before = self.rels[name]
        return self.changed(rels={name: (aligned(before[0], rows), *[x if x == y else None for x, y in zip(before[1:], ends, strict=True)])})

    def assigned(self, kind: str, found: DataFrame, prop: str, where: set[str] | None = None) -> PropertyGraph:
        """Property prop set to value at the ids of found (uid, value, and utype for relationships); where: the tables that may hold them."""

        def put(df: DataFrame, found: DataFrame = found) -> DataFrame:
            value = found.schema["value"].dataType
            if (prop not in df.columns or df.schema[prop].dataType != value) and df.join(found, F.col("id") == F.col("uid"), "left_semi").isEmpty():
                return df  # none of its rows is meant, so its columns stay as they are
            if prop in df.columns:
                own = df.schema[prop].dataType
                wide = value if isinstance(own, T.NullType) else own if own == value or isinstance(value, T.NullType) else T.DoubleType() if isinstance(own, T.NumericType) and isinstance(value, T.NumericType) else T.StringType()
                old = F.col(f"`{prop}`").cast(wide)
            else:
                wide, old = value, F.lit(None).cast(value)
            both = df.join(found.select("uid", F.col("value").cast(wide).alias("#value")), F.col("id") == F.col("uid"), "left")
            return both.withColumn(prop, F.when(F.col("uid").isNotNull(), F.col("#value")).otherwise(old)).drop("uid", "#value")

        if kind == "node":
            return self.changed({x: put(df) for x, df in self.nodes.items() if where is None or x in where})
        return self.changed(rels={x: (put(df, found.where(F.col("utype") == x)), a, b) for x, (df, a, b) in self.rels.items() if where is None or x in where})

    def relabelled(self, found: DataFrame, labels: list[str], add: bool) -> PropertyGraph:
        """Labels added to or taken from the nodes of found (uid)."""
        own = F.array(*[F.lit(x) for x in labels])
        nodes, mixed = {}, {}
        for x in self.nodes:
            both = self.labelled(x).join(found.select("uid"), F.col("id") == F.col("uid"), "left")
            new = F.array_union("labels", own) if add else F.array_except("labels", own)
            nodes[x] = both.withColumn("labels", F.when(F.col("uid").isNotNull(), new).otherwise(F.col("labels"))).drop("uid")
            mixed[x] = self.mixed.get(x, {x}) | (set(labels) if add else set())
        return self.changed(nodes, mixed=mixed)

    def without_nodes(self, ids: DataFrame) -> PropertyGraph:
        return self.changed({x: df.join(ids, F.col("id") == F.col("uid"), "left_anti") for x, df in self.nodes.items()})

    def without_rels(self, ids: DataFrame) -> PropertyGraph:
        """Without the relationships of ids (utype, uid)."""
        return self.changed(rels={x: (df.join(ids.where(F.col("utype") == x), F.col("id") == F.col("uid"), "left_anti"), a, b) for x, (df, a, b) in self.rels.items()})

    def incident(self, ids: DataFrame) -> DataFrame:
        """(utype, uid) of the relationships that start or end at the nodes of ids (uid)."""
        table = self.rel_table([])
        if table is None:
            return ids.sparkSession.createDataFrame([], "utype string, uid long")
        nodes = ids.select(F.col("uid").alias("#n"))
        ends = [table.join(nodes, F.col(e) == F.col("#n"), "left_semi") for e in ("start", "end")]
        return ends[0].union(ends[1]).select(F.col("type").alias("utype"), F.col("id").alias("uid")).distinct()


def star_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The test tables as a graph: business tables, events of users, documents and their labels."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    number = {x: k + 1 for k, x in enumerate(("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event", "Document"))}

    def ident(label: str, key) -> F.Column:
        return F.lit(number[label] << KEY_BITS) + F.col(key).cast("long")

    def properties(table: DataFrame, key: str, prefix: str) -> dict[str, F.Column]:
        return {"key": F.col(key).cast("long"), **{c.removeprefix(prefix): F.col(c) for c in table.columns if c != key}}

    def nodes(label: str, table: DataFrame, key: str, prefix: str) -> DataFrame:
        return table.select(ident(label, key).alias("id"), *[c.alias(n) for n, c in properties(table, key, prefix).items()])

    def with_node(which: str, table: DataFrame, label: str, key: str, prefix: str, start: F.Column, end: F.Column) -> tuple[str, DataFrame]:
        """Relationships whose ids are their node's keys, with that node."""
        own = {**properties(table.drop("c_nationkey", "s_nationkey", "n_regionkey", "o_custkey", "user_id"), key, prefix), "labels": F.array(F.lit(label))}
        return which, table.select(F.col(key).cast("long").alias("id"), start.alias("start"), end.alias("end"), *[c.alias(f"#n${n}") for n, c in own.items()])

    def rel(table: DataFrame, a: str, akey: str, b: str, bkey: str, ident_key: str, **props):
        return table.select(F.col(ident_key).cast("long").alias("id"), ident(a, akey).alias("start"), ident(b, bkey).alias("end"), *[F.col(c).alias(n) for n, c in props.items()]), a, b

    t = {x: read(x) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")}
    drop = lambda x, *c: t[x].drop(*c)
    events = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumnRenamed("event_type", "type")
    # rows of lineitem have no key of their own: rows are numbered inside their order, by all columns
    items = t["lineitem"]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[c for c in items.columns if c != "l_orderkey"]))
    items = items.withColumn("lid", F.col("l_orderkey") * 4096 + place)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = t["events"].select("event_id", F.lead("event_id").over(order).alias("following")).where("following is not null")
    orders = t["orders"].withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority", "o_orderdate": "orderdate"})
    seen = events.select("event_id", "ts", "type", "value", "k", "user_id")
    supplied = t["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", F.col("l_suppkey") * (1 << 32) + F.col("l_partkey"))
    return PropertyGraph(
        {
            "Region": nodes("Region", t["region"], "r_regionkey", "r_"),
            "Nation": nodes("Nation", drop("nation", "n_regionkey"), "n_nationkey", "n_"),
            "Customer": nodes("Customer", drop("customer", "c_nationkey"), "c_custkey", "c_"),
            "Supplier": nodes("Supplier", drop("supplier", "s_nationkey"), "s_suppkey", "s_"),
            "Part": nodes("Part", t["part"], "p_partkey", "p_"),
            "Order": nodes("Order", orders.drop("o_custkey"), "o_orderkey", "o_"),
            "User": nodes("User", t["events"].select("user_id").distinct(), "user_id", ""),
            "Event": nodes("Event", seen.drop("user_id"), "event_id", ""),
            "Document": nodes("Document", t["documents"], "doc_id", ""),
        },
        {
            "IN_REGION": rel(t["nation"], "Nation", "n_nationkey", "Region", "n_regionkey", "n_nationkey"),
            "LIVES_IN": rel(t["customer"], "Customer", "c_custkey", "Nation", "c_nationkey", "c_custkey"),
            "BASED_IN": rel(t["supplier"], "Supplier", "s_suppkey", "Nation", "s_nationkey", "s_suppkey"),
            "PLACED": rel(t["orders"], "Customer", "o_custkey", "Order", "o_orderkey", "o_orderkey"),
            "CONTAINS": rel(items, "Order", "l_orderkey", "Part", "l_partkey", "lid", **{c.removeprefix("l_"): c for c in items.columns if c not in ("l_orderkey", "l_partkey", "lid")}),
            "SUPPLIES": rel(supplied, "Supplier", "l_suppkey", "Part", "l_partkey", "sid", n="n"),
            "DID": rel(t["events"], "User", "user_id", "Event", "event_id", "event_id"),
            "NEXT": rel(following, "Event", "event_id", "Event", "following", "event_id"),
        },
        wide={
            "IN_REGION": with_node("start", t["nation"], "Nation", "n_nationkey", "n_", ident("Nation", "n_nationkey"), ident("Region", "n_regionkey")),
            "LIVES_IN": with_node("start", t["customer"], "Customer", "c_custkey", "c_", ident("Customer", "c_custkey"), ident("Nation", "c_nationkey")),
            "BASED_IN": with_node("start", t["supplier"], "Supplier", "s_suppkey", "s_", ident("Supplier", "s_suppkey"), ident("Nation", "s_nationkey")),
            "PLACED": with_node("end", orders, "Order", "o_orderkey", "o_", ident("Customer", "o_custkey"), ident("Order", "o_orderkey")),
            "DID": with_node("end", seen, "Event", "event_id", "", ident("User", "user_id"), ident("Event", "event_id")),
        },
    )
