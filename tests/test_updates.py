"""Changes to a graph, on a small one."""

import pytest

from loomgraph.errors import CypherError
from loomgraph.plans.compiler import cypher, execute
from loomgraph.sources.graph import PropertyGraph


@pytest.fixture
def town(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Ben", 41), (3, "Cat", None)], "id long, name string, age long")
    knows = spark.createDataFrame([(1, 1, 2, 2001), (2, 2, 3, 2005)], "id long, start long, end long, since long")
    return PropertyGraph({"Person": people}, {"KNOWS": (knows, "Person", "Person")})


def changed(spark, graph, text, then, params=None):
    """(what the change returns, what the query then finds in the new graph, sorted)."""
    rows, new = execute(graph, text, spark, params)
    found = [tuple(r) for r in rows.collect()] if rows.columns else []
    return found, sorted((tuple(r) for r in cypher(new, then, spark).collect()), key=repr)


ALL = "MATCH (n) RETURN labels(n) AS l, n.name AS name"


def test_create(spark, town):
    found, after = changed(spark, town, "CREATE (a:Person {name: 'Dan'})-[r:KNOWS {since: 1}]->(b:Pet:Dog {name: 'Rex', age: null})<-[:OWNS]-(a) RETURN a.name, type(r), b.age", "MATCH (a)-[r]->(b) RETURN a.name, type(r), b.name")
    assert found == [("Dan", "KNOWS", None)]
    assert after == sorted([("Ann", "KNOWS", "Ben"), ("Ben", "KNOWS", "Cat"), ("Dan", "KNOWS", "Rex"), ("Dan", "OWNS", "Rex")])
    found, after = changed(spark, town, "MATCH (a:Person) CREATE (a)-[:HAS]->(c:Card {of: a.name}) RETURN count(c) AS n", "MATCH (:Person)-[:HAS]->(c:Card) RETURN c.of")
    assert found == [(3,)] and after == [("Ann",), ("Ben",), ("Cat",)]
    _, after = changed(spark, town, "CREATE (), (:Pet:Dog {name: 'Rex'})", "MATCH (n:Dog) RETURN n.name, size(labels(n))")
    assert after == [("Rex", 2)]
    assert cypher(town, "MATCH (n) RETURN count(*) AS n", spark).first()["n"] == 3


def test_merge(spark, town):
    then = "MATCH (n:Person) RETURN n.name, n.seen"
    found, after = changed(spark, town, "UNWIND ['Ann', 'Eve', 'Eve'] AS x MERGE (n:Person {name: x}) ON CREATE SET n.seen = 1 ON MATCH SET n.seen = 2 RETURN n.name AS name, n.seen AS seen ORDER BY name", then)
    assert found == [("Ann", 2), ("Eve", 1), ("Eve", 1)]
    assert after == sorted([("Ann", 2), ("Ben", None), ("Cat", None), ("Eve", 1)], key=repr)
    found, after = changed(spark, town, "MATCH (a:Person {name: 'Ann'}), (b:Person) WHERE b.name <> 'Ann' MERGE (a)-[r:KNOWS]->(b) RETURN b.name AS b, r.since AS s ORDER BY b", "MATCH (:Person {name: 'Ann'})-[:KNOWS]->(b) RETURN b.name")
    assert found == [("Ben", 2001), ("Cat", None)] and after == [("Ben",), ("Cat",)]
    found, _ = changed(spark, town, "MERGE (a:Person {age: 30})-[r:KNOWS]-(b) RETURN a.name, b.name", ALL)
    assert found == [("Ann", "Ben")]
    with pytest.raises(CypherError) as e:
        execute(town, "MERGE (n:Person {name: null})", spark)
    assert e.value.kind == "MergeReadOwnWrites"


def test_set_and_remove(spark, town):
    found, after = changed(spark, town, "MATCH (n:Person {name: 'Ann'}) SET n.age = n.age + 1, n.tag = n.age, n:Boss RETURN n.age, n.tag, labels(n)", "MATCH (n:Boss) RETURN n.age, n.tag")
    assert found == [(31, 31, ["Person", "Boss"])] and after == [(31, 31)]
    found, after = changed(spark, town, "MATCH (n:Person) SET n = {name: toUpper(n.name), x: 1} RETURN n.name AS a ORDER BY a", "MATCH (n:Person) RETURN n.name, n.age, n.x")
    assert found == [("ANN",), ("BEN",), ("CAT",)] and after == [("ANN", None, 1), ("BEN", None, 1), ("CAT", None, 1)]
    _, after = changed(spark, town, "MATCH (n:Person {name: 'Ben'}) SET n += {age: null, x: 'y'}", "MATCH (n:Person) RETURN n.name, n.age, n.x")
    assert after == sorted([("Ann", 30, None), ("Ben", None, "y"), ("Cat", None, None)], key=repr)
    _, after = changed(spark, town, "MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Cat'}) SET b = a", "MATCH (n:Person) RETURN n.name, n.age")
    assert after == [("Ann", 30), ("Ann", 30), ("Ben", 41)]
    _, after = changed(spark, town, "MATCH (n:Person) SET n.l = [1] WITH n SET n.l += [2]", "MATCH (n:Person {name: 'Ann'}) RETURN n.l")
    assert after == [([1, 2],)]
    _, after = changed(spark, town, "MATCH ()-[r:KNOWS]->() SET r.since = r.since + 1, r.w = 0.5", "MATCH ()-[r]->() RETURN r.since, r.w")
    assert after == [(2002, 0.5), (2006, 0.5)]
    found, after = changed(spark, town, "MATCH (n:Person {name: 'Ann'}) REMOVE n.age, n:Person RETURN n.age, labels(n)", "MATCH (n:Person) RETURN n.name")
    assert found == [(None, [])] and after == [("Ben",), ("Cat",)]
    found, _ = changed(spark, town, "MATCH (n:Person) OPTIONAL MATCH (n)-[:NONE]->(m) SET m.x = 1, n.x = 2 RETURN n.x", ALL)
    assert found == [(2,)] * 3


def test_delete(spark, town):
    with pytest.raises(CypherError) as e:
        execute(town, "MATCH (n:Person {name: 'Ann'}) DELETE n", spark)
    assert e.value.kind == "DeleteConnectedNode"
    rels = "MATCH (a)-[r]->(b) RETURN a.name, b.name"
    assert changed(spark, town, "MATCH (n:Person {name: 'Ann'}) DETACH DELETE n", rels)[1] == [("Ben", "Cat")]
    assert changed(spark, town, "MATCH (n:Person {name: 'Ann'})-[r]->() DELETE r, n", ALL)[1] == [(["Person"], "Ben"), (["Person"], "Cat")]
    assert changed(spark, town, "MATCH p = (:Person {name: 'Ann'})-[:KNOWS]->() DELETE p", ALL)[1] == [(["Person"], "Cat")]
    assert changed(spark, town, "MATCH ()-[rs:KNOWS*2]->() WITH rs DELETE rs", rels)[1] == []
    assert changed(spark, town, "MATCH (n:Person) DETACH DELETE n RETURN count(*) AS n", ALL) == ([(3,)], [])
    for text in ("MATCH (n:Person) DETACH DELETE n RETURN n.name", "MATCH (n:Person) DETACH DELETE n RETURN labels(n) AS l"):
        with pytest.raises(CypherError) as e:
            execute(town, text, spark)
        assert e.value.kind == "DeletedEntityAccess"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("MATCH (a) CREATE (a)", "VariableAlreadyBound"),
        ("MATCH (a) CREATE (a {x: 1})-[:R]->()", "VariableAlreadyBound"),
        ("CREATE (a)-[:R*2]->()", "CreatingVarLength"),
        ("CREATE (a)-[:R|S]->()", "NoSingleRelationshipType"),
        ("CREATE (a)-->()", "NoSingleRelationshipType"),
        ("CREATE (a)-[:R]-()", "RequiresDirectedRelationship"),
        ("MATCH ()-[r]->() CREATE ()-[r:R]->()", "VariableAlreadyBound"),
        ("MERGE (a $p)", "InvalidParameterUse"),
        ("SET a.x = 1", "UndefinedVariable"),
        ("MATCH (a) SET a.x = {b: 1}", "InvalidPropertyType"),
        ("MATCH (a) DELETE 1 + 1", "InvalidArgumentType"),
    ],
)
def test_faults(spark, town, text, kind):
    with pytest.raises(CypherError) as e:
        execute(town, text, spark)
    assert e.value.kind == kind


def test_query_without_return(spark, town):
    rows, new = execute(town, "CREATE (:Person {name: 'Dan'})", spark)
    assert rows.count() == 0
    assert new.dangling().count() == 0
    assert {tuple(r) for r in new.counts().collect()} == {("node", "Person", 4), ("relationship", "KNOWS", 2)}
