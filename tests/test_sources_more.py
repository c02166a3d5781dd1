"""Caches with versions and bounds; folders of descriptions, broken files among them."""

import json

import pytest

from quillgraph.sources import caches, metadata


def test_cache_hits_misses_evicts_and_goes_stale(spark, tmp_path):
    cache = caches.Cache(spark, str(tmp_path / "c"), "string", 3)
    rows = lambda *keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "key string, value string")
    held = lambda v: {r["key"] for r in cache.entries(v).collect()}
    assert held("1") == set()
    assert cache.put(rows("a", "b", "a", None), "1") == 2
    assert cache.put(rows("b", "c"), "1") == 1 and held("1") == {"a", "b", "c"}
    assert cache.put(rows("d"), "1") == 1 and held("1") == {"b", "c", "d"}  # the first in is out
    assert cache.put(rows("a"), "1") == 1 and held("1") == {"a", "c", "d"}  # and may come back, as the newest
    asked = spark.createDataFrame([("a",), ("b",), ("d",)], "key string")
    assert {(r["key"], r["hit"], r["value"]) for r in cache.get(asked, "1").collect()} == {("a", True, "va"), ("b", False, None), ("d", True, "vd")}
    assert not any(r["hit"] for r in cache.get(asked, "2").collect())
    cache.put(rows("z"), "2")
    cache.drop_stale("2")
    assert held("1") == set() and held("2") == {"z"}


def test_version_follows_the_rows(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "u int, v int")
    b = spark.createDataFrame([(3, 4), (1, 2)], "u int, v int")
    assert caches.version_of(a, b) == caches.version_of(b, a) != caches.version_of(a, a.filter("u = 1"))


def test_walk_of_descriptions(spark, tmp_path):
    root = tmp_path / "meta"
    film = {"table_name": "FILM", "table_fullname": "X.FILM", "column_names": ["ID", "TITLE", "Ü"], "column_types": ["NUMBER", "TEXT"], "description": [None, "the title", "x"], "sample_rows": [{"ID": 1, "TITLE": "a"}, {"ID": 2, "TITLE": ""}]}
    for at, text in (("A/x/FILM.json", json.dumps(film)), ("A/y/C.json", json.dumps({"table_name": "C", "column_names": []})), ("B/D.json", json.dumps(film | {"table_name": "D", "sample_rows": None}, indent=2)), ("B/bad.json", "{not json"), ("B/other.json", "[1, 2]"), ("B/empty.json", ""), ("B/note.txt", "x")):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text(text)
    (root / "B/raw.json").write_bytes(b"\xff\xfe\x80")
    found = metadata.Metadata(spark, str(root))
    assert {r["path"].rsplit("/", 1)[1] for r in found.broken().collect()} == {"bad.json", "other.json", "raw.json"}  # an empty file is no row
    assert {tuple(r) for r in found.tables().collect()} == {("A", "FILM", "X.FILM", 3, 2), ("A", "C", None, 0, 0), ("B", "D", "X.FILM", 3, 0)}
    assert {tuple(r)[2:] for r in found.columns().filter("`table` = 'D'").collect()} == {(0, "ID", "NUMBER", None), (1, "TITLE", "TEXT", "the title"), (2, "Ü", None, "x")}
    assert {tuple(r) for r in found.samples().collect()} == {("A", "FILM", 0, "ID", "1"), ("A", "FILM", 0, "TITLE", "a"), ("A", "FILM", 1, "ID", "2")}
    assert {tuple(r) for r in found.databases().collect()} == {("A", 2, 3, 1.5), ("B", 1, 3, 3.0)}
    metadata.write_summaries(found.columns(), str(tmp_path / "out"))
    document = json.loads(spark.read.text(str(tmp_path / "out")).filter("db = 'B'").head()["value"])
    assert document == {"db": "B", "table_count": 1, "tables": [{"name": "D", "column_count": 3, "columns": [{"name": "ID", "type": "NUMBER"}, {"name": "TITLE", "type": "TEXT", "description": "the title"}, {"name": "Ü", "description": "x"}]}]}


def test_summary_values_that_json_lacks(spark):
    rows = spark.createDataFrame([("d", "t", 0, "c", float("nan"), 1.5), ("d", "t", 1, "e", 2.0, float("inf"))], "db string, table string, position int, column string, a double, b double")
    assert json.loads(metadata.summaries(rows).head()["json"])["tables"][0]["columns"] == [{"name": "c", "b": "1.5"}, {"name": "e", "a": "2.0"}]


def test_descriptions_of_either_encoding(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    (tmp_path / "plain.csv").write_text(head + 'id,the id,"first\nsecond",int,not useful\n', "utf-8-sig")
    (tmp_path / "old.csv").write_bytes((head + "né,“name”,,text,Commonsense evidence: a – b\n").encode("cp1252"))
    got = {r["table"]: r for r in metadata.described_columns(spark, str(tmp_path)).collect()}
    assert got["plain"]["original_column_name"] == "id" and got["plain"]["column_description"] == "first second" and got["plain"]["value_description"] == ""
    assert got["old"]["original_column_name"] == "né" and got["old"]["column_name"] == "“name”" and got["old"]["value_description"] == "a – b"
    said = {r["table"]: r["description"] for r in metadata.concatenated(metadata.described_columns(spark, str(tmp_path))).collect()}
    assert said == {"plain": "the id, first second", "old": "“name”, a – b"}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        metadata.described_columns(spark, str(tmp_path / "none"))
