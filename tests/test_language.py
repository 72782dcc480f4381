"""Answers of the language beyond the catalogue: values, scopes, bound variables, paths and times."""

import pytest

from loomgraph.errors import CypherError
from loomgraph.plans.compiler import cypher
from loomgraph.sources.graph import PropertyGraph


@pytest.fixture(scope="module")
def town(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Ben", 41), (3, "Cat", None), (4, "Dan", 30)], "id long, name string, age long")
    place = spark.createDataFrame([(10, "Hill", 3), (11, "Dale", 5)], "id long, name string, size long")
    rel = lambda rows, more="": spark.createDataFrame(rows, "id long, start long, end long" + more)
    return PropertyGraph(
        {"Person": people, "Place": place},
        {
            "KNOWS": (rel([(1, 1, 2, 2001), (2, 2, 3, 2005), (3, 3, 4, 2009)], ", since long"), "Person", "Person"),
            "LIVES": (rel([(1, 1, 10), (2, 2, 10), (3, 4, 11)]), "Person", "Place"),
        },
    )


VALUES = [
    ("1 = 'a'", False), ("1 <> 'a'", True), ("'a' < 1", None), ("[1, null] = [1, 2]", None), ("[1, null] = [2, null]", False), ("[1] = [1, 2]", False), ("0.0 / 0.0 = 0.0 / 0.0", False), ("0.0 / 0.0 > 1", False),
    ("null = 1", None), ("{a: 1} = {a: 1}", True), ("{a: 1} = {b: 1}", False), ("[x IN [7] | x / 2]", [3]), ("[x IN [1, 2] | x + 'a']", ["1a", "2a"]), ("[x IN ['ab'] | size(x)]", [2]), ("[x IN [[1, 2], [3]] | size(x)]", [2, 1]),
    ("single(x IN [1, null] WHERE x = 1)", None), ("single(x IN [1, 2, 1] WHERE x = 1)", False), ("none(x IN [2, null] WHERE x = 1)", None), ("all(x IN [] WHERE x = 1)", True), ("any(x IN [1, null] WHERE x = 1)", True), ("1 STARTS WITH 'a'", None),
    ("3 IN [1, null]", None), ("[1] IN [[1], [2]]", True), ("null IN []", False), ("[1, 2] + 3", [1, 2, 3]), ("{a: {b: 5}}.a.b", 5), ("{a: 7}['a']", 7), ("'a' + 1", "a1"), ("CASE 1 WHEN 'a' THEN 2 ELSE 3 END", 3), ("7 / 2 * 2.0", 6.0), ("[x IN [3, 1] WHERE x > 1 | [y IN [x] | x + y]]", [[6]]),
]


def test_values(spark, town):
    for text, expected in VALUES:
        assert cypher(town, f"RETURN {text} AS x", spark).first()["x"] == expected, text


ROWS = [
    ("UNWIND null AS y RETURN y AS x", []),
    ("UNWIND 5 AS y RETURN y AS x", []),
    ("UNWIND [[1], [2, 3]] AS y UNWIND y AS z RETURN z AS x", [1, 2, 3]),
    ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS*1..2]-(c) WHERE a.name = 'Ann' RETURN c.name AS x ORDER BY x", ["Cat", "Dan"]),
    ("MATCH (a)-[r]->(b) WITH a, r, b WHERE type(r) = 'KNOWS' MATCH (a)-[r]->(c) RETURN c.name AS x ORDER BY x", ["Ben", "Cat", "Dan"]),
    ("MATCH ()-[r:KNOWS]->() WITH r MATCH (a)-[r]->(b) RETURN a.name + b.name AS x ORDER BY x", ["AnnBen", "BenCat", "CatDan"]),
    ("MATCH ()-[r:KNOWS]->() WITH r MATCH (a)<-[r]-(b) RETURN a.name + b.name AS x ORDER BY x", ["BenAnn", "CatBen", "DanCat"]),
    ("MATCH (a:Person {name: 'Ann'})-[rs:KNOWS*2]->() WITH a, rs MATCH (a)-[rs*]->(b) RETURN b.name AS x", ["Cat"]),
    ("MATCH (a:Person)-[r:LIVES]->() RETURN startNode(r).name + '@' + endNode(r).name AS x ORDER BY x", ["Ann@Hill", "Ben@Hill", "Dan@Dale"]),
    ("MATCH p = (a {name: 'Ann'})-[:KNOWS*1..3]->(b) RETURN [n IN nodes(p) | n.name] AS x ORDER BY size(x)", [["Ann", "Ben"], ["Ann", "Ben", "Cat"], ["Ann", "Ben", "Cat", "Dan"]]),
    ("MATCH p = (a {name: 'Ann'})-[:KNOWS]->(b) RETURN [r IN relationships(p) | r.since] AS x", [[2001]]),
    ("MATCH (a {name: 'Ann'})-[rs:KNOWS*3]->() UNWIND rs AS r RETURN r.since AS x", [2001, 2005, 2009]),
    ("MATCH p = (a {name: 'Ann'})-[:LIVES]->() RETURN [n IN nodes(p) | n.size] AS x", [[None, 3]]),
    ("MATCH (a:Person) WHERE EXISTS { MATCH (a)-->(b) WITH a, count(b) AS n WHERE n = 2 RETURN true } RETURN a.name AS x ORDER BY x", ["Ann", "Ben"]),
    ("MATCH (a:Person) WHERE NOT EXISTS { MATCH (a)-[:LIVES]->(b) RETURN b } RETURN a.name AS x", ["Cat"]),
    ("MATCH (a:Person) RETURN EXISTS { (a)-[:LIVES]->(:Place {name: 'Hill'}) } AS x ORDER BY a.name", [True, True, False, False]),
    ("MATCH (a:Person) RETURN size([(a)-[:KNOWS]-(b) | b.name]) AS x ORDER BY a.name", [1, 2, 2, 1]),
    ("MATCH (a:Person) RETURN [p = (a)-[:KNOWS]->(b) | b.name] AS x ORDER BY a.name", [["Ben"], ["Cat"], ["Dan"], []]),
    ("MATCH (a:Person) WITH a.age AS age, a ORDER BY a.name RETURN collect(DISTINCT age) AS x", [[30, 41]]),
    ("MATCH (a:Person)-[:LIVES]->(p) WITH DISTINCT p RETURN p.name AS x ORDER BY x", ["Dale", "Hill"]),
    ("MATCH (a:Person)-[:LIVES]->(p) WITH p, count(a) AS n RETURN p.name + n AS x ORDER BY x", ["Dale1", "Hill2"]),
    ("MATCH (a:Person) RETURN sum(a.name) AS x", [0]),
    ("MATCH (a:Person) RETURN percentileDisc(a.age, 0.5) AS x", [30]),
    ("MATCH (a:Person) WITH * MATCH (a)-[:LIVES]->(p:Place) RETURN count(*) AS x", [3]),
    ("MATCH (a:Person), (a)-[:KNOWS]->(b)-[:LIVES]->(c) RETURN a.name + c.name AS x", ["AnnHill", "CatDale"]),
    ("OPTIONAL MATCH (a:Nobody) RETURN a AS x", [None]),
    ("MATCH (a:Person) WHERE a.age IS NULL OPTIONAL MATCH (a)-[:LIVES]->(p) RETURN p.name AS x", [None]),
    ("MATCH (`a b`:Person) /* none */ WHERE `a b`.age = 41 // end\nRETURN `a b`.name AS x;", ["Ben"]),
    ("MATCH (a:Person) RETURN a.name AS x LIMIT 0", []),
    ("MATCH (a:Person)-[r:KNOWS {since: 2005}]->() RETURN properties(r).since AS x", [2005]),
    ("MATCH (a:Person {name: 'Cat'}) RETURN keys(a) AS x", [["name"]]),
    ("MATCH (a {name: 'Ann'})-[:KNOWS*0..1]->(b) RETURN b.name AS x ORDER BY x", ["Ann", "Ben"]),
    ("RETURN 1 AS x UNION RETURN 1 AS x", [1]),
    ("MATCH (a:Person) WITH collect(a) AS l UNWIND l AS m RETURN m.name AS x ORDER BY x", ["Ann", "Ben", "Cat", "Dan"]),
    ("RETURN head([3, 4]) + last([5, 6]) + size(tail([1, 2, 3])) AS x", [11]),
    ("MATCH (n)-[r]-(m) RETURN count(DISTINCT r) AS x", [6]),
    ("UNWIND [[2], [1, 5], [1], null] AS x RETURN x ORDER BY x", [[1], [1, 5], [2], None]),
    ("UNWIND [true, null, false] AS x RETURN x ORDER BY x DESC", [None, True, False]),
]


@pytest.mark.parametrize(("query", "expected"), ROWS)
def test_rows(spark, town, query, expected):
    assert [r["x"] for r in cypher(town, query, spark).collect()] == expected


TIMES = [
    ("date('2015-W30-2')", "2015-07-21"), ("date('2015-202')", "2015-07-21"), ("date('20150721')", "2015-07-21"), ("date('2015-Q3-21')", "2015-07-21"), ("date('2015-07')", "2015-07-01"), ("date({year: 1984, week: 10, dayOfWeek: 3})", "1984-03-07"),
    ("date({year: 1984, month: 10, day: 11})", "1984-10-11"), ("date({year: 1984, quarter: 3, dayOfQuarter: 45})", "1984-08-14"), ("date({date: date('1984-11-11'), day: 28})", "1984-11-28"), ("date({year: 1984, ordinalDay: 202})", "1984-07-20"),
    ("localdatetime('2015-07-21T21:40:32.142')", "2015-07-21T21:40:32.142"), ("datetime('2015-07-21T21:40:32+01:00')", "2015-07-21T21:40:32+01:00"), ("time('214032.142+0100')", "21:40:32.142+01:00"), ("localtime('21:40')", "21:40"),
    ("datetime({year: 1984, month: 10, day: 11, hour: 12, timezone: '+01:00'})", "1984-10-11T12:00+01:00"), ("localtime({hour: 12, minute: 31, second: 14, nanosecond: 645876123})", "12:31:14.645876123"),
    ("duration('P14DT16H12M')", "P14DT16H12M"), ("duration('P5M1.5D')", "P5M1DT12H"), ("duration('PT0.75M')", "PT45S"), ("duration('-P1Y2M')", "P-1Y-2M"), ("duration('P2012-02-02T14:37:21.545')", "P2012Y2M2DT14H37M21.545S"),
    ("duration({days: 14, hours: 16, minutes: 12})", "P14DT16H12M"), ("duration({months: 0.75})", "P22DT19H51M49.5S"), ("duration({seconds: 2, milliseconds: -1})", "PT1.999S"), ("duration('P1D') + duration('PT2H')", "P1DT2H"),
    ("duration('P1DT2H') * 2", "P2DT4H"), ("duration('P1D') / 2", "PT12H"), ("date('2011-01-31') + duration('P1M')", "2011-02-28"), ("date('2011-01-31') - duration('P1DT25H')", "2011-01-29"), ("localdatetime('2011-01-31T23:30') + duration('PT1H')", "2011-02-01T00:30"),
    ("time('23:30+01:00') + duration('PT1H')", "00:30+01:00"), ("duration.between(date('1984-10-11'), date('2015-06-24'))", "P30Y8M13D"), ("duration.inMonths(date('1984-10-11'), date('2015-06-24'))", "P30Y8M"),
    ("duration.inDays(date('1984-10-11'), date('2015-06-24'))", "P11213D"), ("duration.inSeconds(localtime('10:00'), localtime('12:30'))", "PT2H30M"), ("duration.between(date('2015-06-24'), date('1984-10-11'))", "P-30Y-8M-13D"),
    ("date.truncate('decade', date('1984-10-11'))", "1980-01-01"), ("date.truncate('weekYear', date('1984-10-11'))", "1984-01-02"), ("localdatetime.truncate('hour', localdatetime('2015-07-21T21:40:32'))", "2015-07-21T21:00"), ("date.truncate('month', date('1984-10-11'), {day: 2})", "1984-10-02"),
    ("datetime.fromepoch(416779, 999999999)", "1970-01-05T19:46:19.999999Z"), ("datetime.fromepochmillis(237821673987)", "1977-07-15T13:34:33.987Z"), ("date(localdatetime('2015-07-21T21:40'))", "2015-07-21"), ("localtime(datetime('2015-07-21T21:40:32+01:00'))", "21:40:32"),
    ("datetime(date('2015-07-21'), localtime('21:40'))", "2015-07-21T21:40Z"), ("datetime('2015-07-21T21:40[Europe/Berlin]')", "2015-07-21T21:40+02:00[Europe/Berlin]"),
]

PARTS = [
    ("date('2015-07-21').week", 30), ("date('2015-07-21').dayOfQuarter", 21), ("date('2015-01-01').weekYear", 2015), ("duration('P1Y4M').monthsOfYear", 4), ("duration('PT75M').minutesOfHour", 15), ("duration('P9D').weeks", 1), ("duration('PT1.5S').milliseconds", 1500),
    ("datetime('2015-07-21T21:40:32+01:30').offsetMinutes", 90), ("time('12:00:00.5Z').millisecond", 500), ("datetime('1970-01-02T00:00Z').epochSeconds", 86400), ("date('2015-07-21') < date('2015-07-22')", True), ("datetime('2015-07-21T21:00+01:00') = datetime('2015-07-21T20:00Z')", True),
    ("date('2015-07-21') = localdatetime('2015-07-21T00:00')", False), ("duration('P1D') = duration('PT24H')", False), ("time('12:00+01:00') < time('12:00Z')", True), ("date() <= date()", True), ("currentTimestamp() > 0", True), ("datetime.transaction().year > 2000", True),
]


def test_times(spark, town):
    query = "RETURN " + ", ".join(f"toString({t}) AS x{k}" for k, (t, _) in enumerate(TIMES))
    found = cypher(town, query, spark).first()
    assert {t: x for (t, _), x in zip(TIMES, found, strict=True)} == dict(TIMES)


LONG = [
    ("duration({hours: 3000000})", "PT3000000H"), ("duration({hours: -3000000, nanoseconds: 1})", "PT-2999999H-59M-59.999999999S"), ("duration('PT3000000H') * 2", "PT6000000H"), ("duration('PT3000000H') / 3", "PT1000000H"),
    ("duration({seconds: 9007199254740993}) * 1", "PT2501999792983H36M33S"), ("duration({seconds: 9223372036854775807})", "PT2562047788015215H30M7S"), ("date('2000-01-01') + duration({hours: 3000000})", "2342-03-29"),
]


def test_durations_of_more_than_292_years(spark, town):
    found = cypher(town, "RETURN " + ", ".join(f"toString({t}) AS x{k}" for k, (t, _) in enumerate(LONG)), spark).first()
    assert {t: x for (t, _), x in zip(LONG, found, strict=True)} == dict(LONG)


FAR = [
    ("date('+18397-06-07')", "18397-06-07"), ("date({year: 9999, month: 12, day: 31}) + duration('P1D')", "10000-01-01"), ("date('18397-06-07') + 'T'", "18397-06-07T"), ("date('-0005-01-02')", "-0005-01-02"), ("date('0005-01-02')", "0005-01-02"),
    ("localdatetime('18397-06-07T21:40')", "18397-06-07T21:40"), ("datetime('18397-06-07T21:40+01:00')", "18397-06-07T21:40+01:00"), ("datetime.fromepochmillis(518399913600000)", "18397-06-10T00:00Z"),
]


def test_years_of_five_digits_have_no_sign(spark, town):
    found = cypher(town, "RETURN " + ", ".join(f"toString({t}) AS x{k}" for k, (t, _) in enumerate(FAR)), spark).first()
    assert {t: x for (t, _), x in zip(FAR, found, strict=True)} == dict(FAR)


def test_parts_of_times(spark, town):
    query = "RETURN " + ", ".join(f"{t} AS x{k}" for k, (t, _) in enumerate(PARTS))
    found = cypher(town, query, spark).first()
    assert {t: x for (t, _), x in zip(PARTS, found, strict=True)} == dict(PARTS)


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("MATCH (a) CREATE (b) MATCH (c) RETURN c", "InvalidClauseComposition"),
        ("RETURN 1 AS a MATCH (b) RETURN b", "InvalidClauseComposition"),
        ("MATCH (a) WHERE EXISTS { MATCH (a) DELETE a } RETURN a", "InvalidClauseComposition"),
        ("MATCH (a)-[r]->() MATCH (r) RETURN r", "VariableTypeConflict"),
        ("MATCH (a) RETURN type(a)", "InvalidArgumentType"),
        ("MATCH (a)-[r]->() RETURN labels(r)", "InvalidArgumentType"),
        ("RETURN [x IN 5 | x] AS x", "InvalidArgumentType"),
        ("RETURN 1 + true AS x", "InvalidArgumentType"),
        ("RETURN date('2015-07-21').hour AS x", "InvalidArgumentType"),
        ("UNWIND [count(1)] AS x RETURN x", "InvalidAggregation"),
        ("MATCH (a) RETURN percentileDisc(a.age, 2) AS x", "NumberOutOfRange"),
        ("MATCH p = (a)-->() RETURN p.name AS x", "InvalidArgumentType"),
        ("RETURN 'a' =~ 'b' AS x", "UnexpectedSyntax"),
        ("RETURN size() AS x", "InvalidNumberOfArguments"),
        ("RETURN left('a') AS x", "InvalidNumberOfArguments"),
    ],
)
def test_faults(spark, town, query, kind):
    with pytest.raises(CypherError) as found:
        cypher(town, query, spark)
    assert found.value.kind == kind


def test_procedures(spark, town):
    town.register_procedure("to.word", ["n"], spark.createDataFrame([(1, "one"), (2, "two")], "n long, word string"), ["INTEGER?"])
    town.register_procedure("do.nothing", [], spark.createDataFrame([(1,)], "x long").drop("x"))
    assert cypher(town, "CALL to.word(2) YIELD word AS w RETURN w", spark).first()["w"] == "two"
    assert cypher(town, "CALL to.word", spark, {"n": 1}).first()["word"] == "one"
    assert cypher(town, "MATCH (a:Person) CALL do.nothing() RETURN count(*) AS n", spark).first()["n"] == 4
    for query, kind in (
        ("CALL to.word('a') YIELD word RETURN word", "InvalidArgumentType"),
        ("CALL to.word", "MissingParameter"),
        ("MATCH (a) CALL to.word YIELD word RETURN word", "InvalidArgumentPassingMode"),
        ("CALL to.word(1, 2) YIELD word RETURN word", "InvalidNumberOfArguments"),
        ("WITH 1 AS word CALL to.word(1) YIELD word RETURN word", "VariableAlreadyBound"),
    ):
        with pytest.raises(CypherError) as found:
            cypher(town, query, spark)
        assert found.value.kind == kind
