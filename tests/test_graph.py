import pytest

from loomgraph.errors import CypherError
from loomgraph.lang.parser import parse
from loomgraph.plans.compiler import cypher
from loomgraph.sources.graph import PropertyGraph


@pytest.fixture(scope="module")
def social(spark):
    people = spark.createDataFrame([(1, "Ada", None), (2, "Bob", 42), (3, "Cyd", None)], "id long, name string, age long")
    company = spark.createDataFrame([(4, "Acme")], "id long, name string")
    rel = lambda rows: spark.createDataFrame(rows, "id long, start long, end long")
    return PropertyGraph(
        {"Person": people, "Company": company},
        {"KNOWS": (rel([(1, 1, 2), (2, 2, 3)]), "Person", "Person"), "LIKES": (rel([(3, 1, 3), (4, 3, 1)]), "Person", "Person"), "WORKS_AT": (rel([(5, 2, 4)]), "Person", "Company")},
    )


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("MATCH (n:Person) RETURN count(n) AS x", [3]),
        ("MATCH (a)-[:KNOWS]->(b) RETURN count(*) AS x", [2]),
        ("MATCH (a)-[:KNOWS]-(b) RETURN count(*) AS x", [4]),
        ("MATCH (a)-[:KNOWS]->()-[:KNOWS]->(c) RETURN count(*) AS x", [1]),
        ("MATCH ()-[r]->() RETURN count(r) AS x", [5]),
        ("MATCH (a)-[:LIKES]->(b)-[:LIKES]->(c) RETURN count(*) AS x", [2]),
        ("MATCH (n:Person) WHERE NOT n.age = 42 RETURN count(*) AS x", [0]),
        ("MATCH (n) WHERE n.name STARTS WITH 'A' RETURN count(*) AS x", [2]),
        ("MATCH (n:Person) WHERE exists((n)-[:KNOWS]->()) RETURN count(*) AS x", [2]),
        ("MATCH (n) RETURN n.name AS x ORDER BY x", ["Acme", "Ada", "Bob", "Cyd"]),
        ("MATCH (n:Missing) RETURN count(*) AS x", [0]),
        ("MATCH (n:Person) WHERE n.name = $who RETURN n.name AS x", ["Bob"]),
        ("MATCH (a {name: 'Ada'})-[:KNOWS*]->(b) RETURN b.name AS x ORDER BY x", ["Bob", "Cyd"]),
        ("MATCH (a:Person {name: 'Ada'}) OPTIONAL MATCH (a)-[:WORKS_AT]->(c) RETURN c.name AS x", [None]),
        ("UNWIND [1, null, 3] AS y RETURN sum(y) AS x", [4]),
        ("RETURN 7 / 2 AS x", [3]),
        ("RETURN [1, 2, 3][-1] AS x", [None]),
        ("RETURN null IN [] AS x", [False]),
    ],
)
def test_query(spark, social, query, expected):
    assert [r["x"] for r in cypher(social, query, spark, {"who": "Bob"}).collect()] == expected


def test_unbounded_path_walks_to_the_end(spark):
    nodes = spark.range(1, 71).selectExpr("id", "id AS key")
    steps = spark.range(1, 70).selectExpr("id", "id AS start", "id + 1 AS end").coalesce(1)
    chain = PropertyGraph({"Event": nodes}, {"NEXT": (steps, "Event", "Event")})
    assert [r["x"] for r in cypher(chain, "MATCH (a:Event {key: 1})-[:NEXT*]->(b) RETURN count(*) AS x", spark).collect()] == [69]


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("RETURN missing AS x", "UndefinedVariable"),
        ("MATCH (n) RETURN n.name AS a, n.age AS a", "ColumnNameConflict"),
        ("MATCH (n) WHERE count(n) > 1 RETURN n", "InvalidAggregation"),
        ("MATCH (n) RETURN n.name AS x SKIP n.age", "NonConstantExpression"),
        ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"),
        ("RETURN nosuch(1) AS x", "UnknownFunction"),
        ("RETURN 9223372036854775808 AS x", "IntegerOverflow"),
        ("MATCH (n RETURN n", "UnexpectedSyntax"),
        ("CALL no.such() YIELD a RETURN a", "ProcedureNotFound"),
        ("MATCH (n:Person) RETURN percentileCont(n.age, 1.1) AS x", "NumberOutOfRange"),
    ],
)
def test_errors(spark, social, query, kind):
    with pytest.raises(CypherError) as found:
        cypher(social, query, spark)
    assert found.value.kind == kind


def test_parser_shapes():
    assert parse("MATCH (a)-[:X*2..3]->(b) RETURN a")[1][0][1][0][2][1][5] == (2, 3)
    assert parse("RETURN 'a\\u0041\\n' AS x")[1][0][1][0][0] == ("lit", "aA\n")


def test_dangling_and_kv(spark, social):
    from loomgraph.operators.kv import prefix_scan, replay

    assert social.dangling().count() == 0
    log = spark.createDataFrame([("a", "1", 1, "PUT"), ("a", "2", 3, "PUT"), ("b", "1", 2, "PUT"), ("b", None, 4, "DELETE"), ("__x", "1", 5, "PUT")], "key string, value string, seq long, op string")
    assert [tuple(r) for r in prefix_scan(replay(log), "").collect()] == [("a", "2")]
