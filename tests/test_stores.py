"""Stores over temporary folders: saving, deletion, versions, pieces, audit days; and pieces of texts by a plain rule."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.sources.stores import AuditLog, DocumentStore, PieceStore, load_ips, read_json_files


def documents(spark, rows):
    frame = pd.DataFrame(rows, columns=["guid", "group_id", "created_at", "version", "previous_version_guid", "title"])
    return spark.createDataFrame(frame, "guid string, group_id int, created_at timestamp_ntz, version int, previous_version_guid string, title string")


def test_document_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    day = lambda d, h=0: pd.Timestamp(2024, 1, d, h)
    store.save(documents(spark, [("a", 1, day(1, 5), 1, None, "A"), ("b", 1, day(2), 1, None, "B"), ("c", 2, day(2, 3), 1, None, "C")]))
    assert store.exists("a", 1) and store.exists("a", 1, "2024-01-01") and not store.exists("a", 1, "2024-01-02") and not store.exists("a", 2)
    assert [r["guid"] for r in store.by_groups([1, 2], 2).collect()] == ["c", "b"] and store.by_group([]).count() == 0
    assert store.get("c", [1], "2024-01-02").first()["status"] == "DENIED" and store.get("z", [1]).first()["status"] == "NOT_FOUND"
    store.new_version("a", "a2", title="A again")
    assert {(r["guid"], r["version"], r["title"]) for r in store.latest().collect()} == {("a2", 2, "A again"), ("b", 1, "B"), ("c", 1, "C")}
    assert store.delete("b", 1) and not store.delete("b", 1) and not store.delete("b", 2)
    assert {r["group_id"]: r["count"] for r in store.count().collect()} == {1: 2, 2: 1}


def test_saving_again_and_after_a_deletion(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    day = lambda d, h=0: pd.Timestamp(2024, 1, d, h)
    titles = lambda **options: sorted((r["guid"], r["group_id"], r["title"]) for r in store.scan(**options).collect())
    store.save(documents(spark, [("a", 1, day(1), 1, None, "A"), ("b", 1, day(1), 1, None, "B"), ("a", 2, day(1), 1, None, "other group")]))
    store.save(documents(spark, [("a", 1, day(1), 1, None, "A2"), ("a", 1, day(1, 5), 1, None, "A3")]))  # twice in one save: the newest
    assert titles() == [("a", 1, "A3"), ("a", 2, "other group"), ("b", 1, "B")]
    store.save(documents(spark, [("b", 1, day(9), 1, None, "B on another day")]))
    assert titles() == [("a", 1, "A3"), ("a", 2, "other group"), ("b", 1, "B on another day")] and titles(day="2024-01-01") == [("a", 1, "A3"), ("a", 2, "other group")]
    assert store.delete("a", 1) and not store.exists("a", 1) and store.exists("a", 2)
    store.save(documents(spark, [("a", 1, day(1), 1, None, "A back")]))
    assert store.exists("a", 1) and store.get("a", [1]).filter("group_id = 1").first()["title"] == "A back"
    assert store.delete("b", 1)
    before = titles()
    assert store.compact() == 4 and titles() == before == [("a", 1, "A back"), ("a", 2, "other group")]
    assert store.compact() == 0 and len(list((tmp_path / "docs" / "documents").glob("*/created_date=*"))) == 2
    store.save(documents(spark, [("b", 1, day(9), 1, None, "B again")]))
    assert ("b", 1, "B again") in titles() and spark.read.parquet(str(tmp_path / "docs" / "documents")).count() == 3


def test_a_save_that_breaks_off(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    rows = documents(spark, [("a", 1, pd.Timestamp(2024, 1, 1), 1, None, "A")])
    store.save(rows)
    with pytest.raises(Exception, match="lost"):
        store.save(rows.withColumn("title", F.raise_error(F.lit("lost")).cast("string")))
    assert [r["title"] for r in store.scan().collect()] == ["A"]


def test_broken_files_are_listed(spark, tmp_path):
    folder = tmp_path / "json"
    (folder / "group" / "day").mkdir(parents=True)
    (folder / "group" / "day" / "a.json").write_text('{"guid": "a",\n "n": 1}')
    (folder / "group" / "day" / "b.json").write_text('{"guid": "b", "n": ')
    (folder / "c.json").write_text('[{"guid": "c", "n": 3}, {"guid": "d", "n": 4}]')
    (folder / "e.json").write_text('{"guid": "e", "n": "many"}')
    rows, bad = read_json_files(spark, str(folder), "guid string, n long")
    assert sorted((r["guid"], r["n"]) for r in rows.collect()) == [("a", 1), ("c", 3), ("d", 4)]
    assert sorted(r["file"].split("/")[-1] for r in bad.collect()) == ["b.json", "e.json"]


def test_policy_statements(spark, tmp_path):
    one = {
        "client_guid": "g", "client_name": "Fund", "archetype": "x", "primary_objective": "grow", "risk_tolerance": "low", "time_horizon": "10y", "esg_policy": "none", "trust_requirement": "Trust Level 8+ only",
        "alert_threshold": 0.7, "prohibited_sectors": ["Tobacco"], "esg_exclusions": [], "positive_themes": ["solar", "water"], "news_priority": ["M&A"],
    }
    for name, change in (("a", {}), ("b", {"trust_requirement": "any trust level 2+"}), ("c", {"trust_requirement": ""}), ("d", {"client_name": None})):
        (tmp_path / f"{name}.json").write_text(json.dumps(one | {"client_guid": name} | change))
    (tmp_path / "e.json").write_text("{")
    profiles, bad = load_ips(spark, str(tmp_path))
    found = {r["client_guid"]: r for r in profiles.collect()}
    assert {k: r["min_trust"] for k, r in found.items()} == {"a": 8, "b": 2, "c": 5}
    lines = ["Investment Profile for Fund:", "Objective: grow", "Risk Tolerance: low", "Time Horizon: 10y", "ESG Policy: none", "Trust Requirement: Trust Level 8+ only", "News Priorities: M&A", "Positive Themes: solar, water"]
    assert found["a"]["summary"].split("\n") == lines
    assert sorted(r["file"].split("/")[-1] for r in bad.collect()) == ["d.json", "e.json"]


def test_pieces_and_audit(spark, tmp_path):
    store = PieceStore(spark.createDataFrame([("a", 1, 1, "y"), ("a", 0, 1, "x"), ("b", 0, 2, "z")], "guid string, piece int, group_id int, text string"))
    assert [r["text"] for r in store.of("a").collect()] == ["x", "y"]
    left = store.without(spark.createDataFrame([("a",)], "guid string"))
    assert [tuple(r) for r in left.count().collect()] == [(2, 1, 1)]
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.append(spark.createDataFrame([("x", "2024-01-01 10:00:00"), ("y", "2024-01-02 10:00:00")], "event_type string, at string").selectExpr("event_type", "to_timestamp(at) AS timestamp"))
    assert log.query("2024-01-01", "2024-01-02", event_type="y").count() == 1
    assert log.clear("2024-01-01") and not log.clear("2024-01-01")
    assert [tuple(r) for r in log.count().collect()] == [("2024-01-02", 1)]


def test_pieces_of_texts():
    assert tx.chunks_of("short") == [(0, 5, "short")] and tx.chunks_of("") == [(0, 0, "")]
    plain = "x" * 2500
    assert [p[:2] for p in tx.chunks_of(plain)] == [(0, 1000), (800, 1800), (1600, 2500)]
    # a full stop before a later exclamation mark wins, one before the last fifth doesn't count
    text = "a" * 700 + ". " + "b" * 150 + ". " + "c" * 50 + "! " + "d" * 700
    assert [p[:2] for p in tx.chunks_of(text)] == [(0, 854), (654, len(text))]
    marked = "e" * 950 + "!\n" + "f" * 500
    assert [p[:2] for p in tx.chunks_of(marked)] == [(0, 952), (752, len(marked))]
    # what is left at the end and too short is no piece
    assert [p[:2] for p in tx.chunks_of("g" * 1000 + " " * 850)] == [(0, 1000), (800, 1800)]
