"""Ingest into three stores at once, detection of languages, and the source registry over time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ingest
from tickerloom.operators import source_history as sh
from tickerloom.sources.domain import News
from tickerloom.sources.versions import Tables

SF = "/root/testdata/sf0.001"


def counts(tables, state=None):
    state = state or tables.state()
    return [tables.read(store, state=state).count() for store in ingest.STORES]


@pytest.mark.parametrize("last", [None, "documents", "pieces", "links"])
def test_a_killed_writer_leaves_nothing(spark, tmp_path, last):
    n, tables = News(spark, SF), Tables(spark, str(tmp_path), ingest.STORES, 4)
    rows = ingest.submissions(n)

    def die(store):
        if store == last:
            raise ConnectionAbortedError

    seen = []

    def look(store):  # a reader between any two stores sees what was there before
        seen.append(counts(tables))

    if last:
        with pytest.raises(ConnectionAbortedError):
            ingest.ingest(n, tables, rows.filter("doc_id < 50"), "one", die)
        assert counts(tables) == [0, 0, 0]
    assert ingest.ingest(n, tables, rows.filter("doc_id < 50"), "one", look) and seen == [[0, 0, 0]] * 3
    once, pinned = counts(tables), tables.state()
    assert min(once) > 0 and not ingest.ingest(n, tables, rows.filter("doc_id < 50"), "one") and counts(tables) == once
    assert ingest.ingest(n, tables, rows.filter("doc_id >= 50"), "two")
    assert counts(tables, pinned) == once and all(a > b for a, b in zip(counts(tables), once, strict=True))
    gone = tables.clean()
    assert len(gone) == 3 + (0 if last is None else list(ingest.STORES).index(last) + 1) and counts(tables, pinned) == once


def test_languages_are_detected_only_if_not_given(spark):
    rows = spark.createDataFrame(
        [(1, "the title of it", "and that is the way to the end of the day", None), (2, "der Titel", "und das ist nicht mit der Hand von hier", " "), (3, "der die das", "und nicht mit der Hand von dort", " FR "),
         (4, "der die das", "und nicht", "xx"), (5, None, None, None)],
        "doc_id long, title string, content string, language string",
    )
    assert {r["doc_id"]: r["language"] for r in ingest.with_language(rows).collect()} == {1: "en", 2: "de", 3: "fr", 4: "xx", 5: "en"}
    n = News(spark, SF)
    found = ingest.problems(n, rows.withColumn("source", F.lit(n.sources.filter("active").first()["source"])).withColumn("group_id", F.lit(1)))
    assert {r["doc_id"]: r["problems"] for r in found.collect()} == {1: [], 2: [], 3: [], 4: ["language"], 5: ["title", "content"]}


def requests(spark, *rows):
    full = [(i, dt.datetime(2024, 1, day), source, action, *(fields.get(c) for c in sh.FIELDS)) for i, (day, source, action, fields) in enumerate(rows)]
    return spark.createDataFrame(full, sh.REQUEST)


def test_decisions_in_order(spark):
    rows = requests(
        spark, (1, "a", "create", {"name": "N"}), (1, "b", "create", {"name": "N"}), (2, "a", "update", {"region": "EUROPE"}), (3, "b", "update", {"region": "ASIA"}), (4, "a", "delete", {}), (5, "a", "delete", {}),
        (6, "a", "update", {"region": "AFRICA"}), (6, "c", "create", {"name": "N"}), (7, "a", "create", {"name": "M"}), (8, "d", "update", {}), (9, "c", "rename", {}), (9, "e", "create", {"name": None}), (9, "f", "create", {"name": None}),
    )
    found = {r["no"]: r["refused"] for r in sh.decided(rows).collect()}
    assert found == {0: None, 1: "name", 2: None, 3: "unknown", 4: None, 5: "deleted", 6: None, 7: None, 8: "exists", 9: "unknown", 10: "action", 11: None, 12: None}


def test_history_and_log(spark):
    rows = requests(
        spark, (1, "a", "create", {"name": "N"}), (2, "a", "update", {"region": "EUROPE"}), (2, "a", "update", {"region": "EUROPE"}), (3, "a", "update", {"trust_level": "high", "name": "other"}), (5, "a", "delete", {}),
    )
    states = sh.history(rows).cache()
    told = [(r["version"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day, r["name"], r["source_type"], r["region"], r["trust_level"], r["active"]) for r in states.orderBy("version").collect()]
    assert told == [
        (1, 1, 2, "N", "other", None, "unverified", True), (2, 2, 3, "N", "other", "EUROPE", "unverified", True), (3, 3, 5, "N", "other", "EUROPE", "high", True), (4, 5, None, "N", "other", "EUROPE", "high", False),
    ]
    log = [(r["entry"], r["action"], r["field"], r["old"], r["new"]) for r in sh.audit_log(states).orderBy("entry", "field").collect()]
    assert log == [
        (1, "delete", "active", "true", "false"), (2, "update", "trust_level", "unverified", "high"), (3, "update", "region", None, "EUROPE"),
        (4, "create", "active", None, "true"), (4, "create", "name", None, "N"), (4, "create", "source_type", None, "other"), (4, "create", "trust_level", None, "unverified"),
    ]
    at = lambda d: [r["version"] for r in sh.registry_at(states, F.to_timestamp_ntz(F.lit(f"2024-01-0{d}"))).collect()]
    assert [at(d) for d in (1, 2, 4, 5, 9)] == [[1], [2], [3], [4], [4]]
    docs = spark.createDataFrame([(1, "a", dt.datetime(2023, 12, 1)), (2, "a", dt.datetime(2024, 1, 4)), (3, None, dt.datetime(2024, 1, 4))], "doc_id long, source string, created_at timestamp_ntz")
    assert {r["doc_id"]: r["trust_level"] for r in sh.with_source_then(docs, states).collect()} == {1: None, 2: "high", 3: None}
    assert sh.history(requests(spark, (1, "x", "delete", {}))).count() == 0 and sh.audit_log(sh.history(rows.limit(0))).count() == 0
