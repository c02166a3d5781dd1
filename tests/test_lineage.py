"""What statements read: scopes, aliases, derived tables, literals."""

import pytest

from quillgraph.operators.lineage import Lineage

SCHEMA = [("Singer", "Name"), ("Singer", "Age"), ("Singer", "id"), ("Concert", "id"), ("Concert", "Singer_ID"), ("Concert", "Year"), ("Stadium", "id"), ("Stadium", "Place Name")]
CASES = [
    ("select name, age a from singer where age > 20 -- where year = 3\n", {"Singer.Name", "Singer.Age"}, {("Singer.Age", "20", ">")}),
    ("SELECT T1.name, count(*) n FROM Singer AS T1 JOIN concert T2 ON T1.id = T2.singer_id WHERE T2.year IN (2014, 2015) AND name LIKE '%it''s%' GROUP BY T1.name HAVING count(*) > 2 ORDER BY n", {"Singer.Name", "Singer.id", "Concert.Singer_ID", "Concert.Year"}, {("Concert.Year", "2014", "IN"), ("Concert.Year", "2015", "IN"), ("Singer.Name", "%it's%", "LIKE")}),
    ("select s.name from singer s where s.id in (select singer_id from concert where year not between 2010 and 2012 and s.age > 5) and \"age\" not in ('x')", {"Singer.Name", "Singer.id", "Singer.Age", "Concert.Singer_ID", "Concert.Year"}, {("Concert.Year", "2010", "BETWEEN"), ("Concert.Year", "2012", "BETWEEN"), ("Singer.Age", "5", ">"), ("Singer.Age", "x", "IN")}),
    # a column of no table in reach, a name that a common table hides
    ("WITH c AS (SELECT singer_id, max(year) AS y FROM concert GROUP BY singer_id) SELECT singer.name, c.y FROM singer, c WHERE c.singer_id = singer.id AND year = 3", {"Singer.Name", "Singer.id", "Concert.Singer_ID", "Concert.Year"}, set()),
    ("WITH singer AS (SELECT id AS name FROM stadium) SELECT name FROM singer", {"Stadium.id"}, set()),
    ("SELECT x.n FROM (SELECT name AS n, id FROM singer WHERE age = 3) AS x JOIN stadium ON x.id = stadium.id WHERE `Place Name` = 'a' UNION SELECT year FROM db.main.concert WHERE id != 7", {"Singer.Name", "Singer.id", "Singer.Age", "Stadium.id", "Stadium.Place Name", "Concert.Year", "Concert.id"}, {("Singer.Age", "3", "="), ("Stadium.Place Name", "a", "="), ("Concert.id", "7", "!=")}),
    # the inner scope's alias wins; an unqualified name is of the first table that has it
    ("SELECT id FROM concert, singer t WHERE EXISTS (SELECT 1 FROM stadium t WHERE t.id = 4)", {"Concert.id", "Stadium.id"}, {("Stadium.id", "4", "=")}),
    ("SELECT t.age FROM singer t WHERE age > (SELECT avg(age) FROM singer) ORDER BY CASE WHEN age = 9 THEN 1 END", {"Singer.Age"}, {("Singer.Age", "9", "=")}),
    ("SELECT DISTINCT a.name FROM singer a, singer b WHERE lower(b.name) LIKE 'x%' AND CAST(a.age AS int) <= .5e2", {"Singer.Name", "Singer.Age"}, set()),
    ("not sql at all (", set(), set()),
    ("", set(), set()),
    (None, set(), set()),
    (") ) ( select ' from )", set(), set()),
    ("select name from singer where id in (select singer_id from concert where age > 3)", {"Singer.Name", "Singer.id", "Singer.Age", "Concert.Singer_ID"}, {("Singer.Age", "3", ">")}),
]


@pytest.fixture(scope="module")
def lineage(spark):
    statements = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "sid long, sql string")
    return Lineage(statements, spark.createDataFrame(SCHEMA, "table string, column string"))


def test_columns(lineage):
    got = {(r["sid"], f"{r['table']}.{r['column']}") for r in lineage.columns().collect()}
    assert got == {(i, c) for i, case in enumerate(CASES) for c in case[1]}


def test_tables(lineage):
    got = {(r["sid"], r["table"]) for r in lineage.tables().collect()}
    assert got >= {(i, c.split(".")[0]) for i, case in enumerate(CASES) for c in case[1]}
    assert {t for i, t in got if i == 4} == {"Stadium"} and {i for i, _ in got if i > 8} == {13}


def test_literals(lineage):
    got = {(r["sid"], f"{r['table']}.{r['column']}", r["literal"], r["how"]) for r in lineage.literals().collect()}
    assert got == {(i, *x) for i, case in enumerate(CASES) for x in case[2]}


def test_literals_that_values_hold(spark, lineage):
    values = spark.createDataFrame([("Concert", "Year", "in 2014"), ("Singer", "Name", "IT'S me"), ("Singer", "Age", "y")], "table string, column string, value string")
    got = {(r["sid"], r["literal"], r["how"]) for r in lineage.literals(values).collect() if r["how"] in ("IN", "LIKE")}
    assert got == {(1, "2014", "IN"), (1, "it's", "LIKE")}


def test_no_statements(spark):
    empty = Lineage(spark.createDataFrame([], "sid long, sql string"), spark.createDataFrame(SCHEMA, "table string, column string"))
    assert empty.tables().isEmpty() and empty.columns().isEmpty() and empty.literals().isEmpty()
