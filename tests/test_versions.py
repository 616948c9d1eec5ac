"""Version logs and bucketed tables under races and break-offs; the piece index against planted faults."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.operators import piece_index
from tickerloom.operators.piece_index import PieceIndex, differing
from tickerloom.sources.versions import Conflict, Table, Tables, VersionLog

PAIRS = {"a": Table("k long, x string", ("k",)), "b": Table("k long, y array<double>", ("k",))}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, x string")


def held(tables, version=None):
    return sorted(map(tuple, tables.read("a", version).collect()))


def test_one_of_two_writers_commits(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path))
    assert log.latest() == (0, {})
    assert log.commit(1, {"n": 1}) and not log.commit(1, {"n": 9})
    assert log.latest() == (1, {"n": 1})

    def add(state):
        if state["n"] == 1:  # someone else commits between reading and committing
            assert VersionLog(spark, str(tmp_path)).commit(2, {"n": 10})
        return {"n": state["n"] + 1}

    assert log.change(add) == 3 and log.latest() == (3, {"n": 11})
    assert log.change(lambda state: None) is None and log.numbers() == [1, 2, 3]


def test_tables_change_together(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), PAIRS, 4)
    assert tables.read("a").count() == 0
    vectors = spark.createDataFrame([(1, [0.5, 1.0])], "k long, y array<double>")
    assert tables.append({"a": rows(spark, (1, "p"), (2, None)), "b": vectors}) == 1
    tables.stage("a", rows(spark, (3, "broke off")))  # a writer that dies before its commit
    assert held(tables) == [(1, "p"), (2, None)] and tables.read("b").first()["y"] == [0.5, 1.0]
    assert tables.append({"a": rows(spark, (1, "p"))}) == 2
    assert held(tables, 1) == [(1, "p"), (2, None)] and held(tables) == [(1, "p"), (1, "p"), (2, None)]
    assert Tables(spark, str(tmp_path), PAIRS, 99).buckets == 4
    assert len(tables.clean()) == 1 and held(tables, 1) == [(1, "p"), (2, None)] and tables.clean() == []


def test_rewrites_see_other_writers(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), PAIRS, 2)
    tables.append({"a": rows(spark, *((i, "old") for i in range(20)))})
    base = tables.state()
    staged = tables.stage("a", rows(spark, (1, "new")))
    tables.append({"a": rows(spark, (100, "late"), (101, "late"), (102, "late"))})
    with pytest.raises(Conflict):
        tables.commit({}, {"a": {b: staged.get(b, []) for b in (0, 1)}}, base)
    tries = []

    def change(old):
        if not tries:
            tables.append({"a": rows(spark, *((i, "meanwhile") for i in range(200, 210)))})
        tries.append(1)
        return old.withColumn("x", F.upper("x"))

    tables.rewrite("a", [0, 1], change)
    assert len(tries) == 2 and {x for _, x in held(tables)} == {"OLD", "LATE", "MEANWHILE"} and len(held(tables)) == 33
    for i in range(6):
        tables.append({"a": rows(spark, *((k, str(i)) for k in range(8)))})
    before = held(tables)
    tables.compact("a")
    assert held(tables) == before and all(len(e) == 1 for e in tables.state()["a"].values())
    assert tables.compact("a") is None


def test_named_changes_are_made_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), PAIRS, 2)
    assert tables.commit({"a": tables.stage("a", rows(spark, (1, "p")))}, once="one") == 1
    assert tables.commit({"a": tables.stage("a", rows(spark, (1, "p")))}, once="one") is None
    assert held(tables) == [(1, "p")]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_trees(n):
    one = [str(i) for i in range(n)]
    assert differing(one, list(one)) == ([], 1)
    two = list(one)
    two[n - 1] = "x"
    found, compared = differing(one, two)
    assert found == [n - 1] and compared <= 1 + 3 * piece_index.FAN


LONG = "One sentence after another, and so on. " * 90


def stored(spark, tmp_path, n=60):
    index = PieceIndex(spark, str(tmp_path), 32)
    texts = [(i, LONG + str(i) if i % 3 == 0 else f"short {i}") for i in range(n - 3)] + [(n - 3, None), (n - 2, ""), (n - 1, " " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    index.save(docs)
    index.rebuild("full")
    return index, dict(texts)


def agree(index, texts):
    found = sorted(map(tuple, index.pieces().collect()))
    return found == sorted((i, n, *c) for i, t in texts.items() for n, c in enumerate(tx.chunks_of(t or "")))


def problems(report):
    return sorted(map(tuple, report.problems.collect()))


def test_index_follows_its_store(spark, tmp_path):
    index, texts = stored(spark, tmp_path)
    assert agree(index, texts)
    assert problems(index.verify()) == [] and index.verify().buckets == []
    quiet = index.rebuild()
    assert (quiet.buckets, quiet.nodes, quiet.bytes_read) == ([], 1, 0)
    new = {3: "other", 100: LONG}
    index.save(spark.createDataFrame(list(new.items()), "doc_id long, content string"))
    index.delete(spark.createDataFrame([(6,), (777,)], "doc_id long"))
    wanted = [(3, "stale"), (6, "orphan"), (100, "missing")]
    assert problems(index.verify()) == problems(index.outdated()) == wanted
    report = index.rebuild()
    assert problems(report) == wanted and 1 <= len(report.buckets) <= 3
    full = index.rebuild("full")
    assert 0 < report.bytes_read < full.bytes_read / 3
    texts = {**texts, **new}
    del texts[6]
    assert agree(index, texts) and problems(index.verify()) == []
    index.save(spark.createDataFrame([(6, "back again")], "doc_id long, content string"))
    index.save(spark.createDataFrame([(6, "and again")], "doc_id long, content string"))
    index.rebuild()
    assert agree(index, {**texts, 6: "and again"})


def test_verify_finds_what_digests_of_the_state_hide(spark, tmp_path):
    index, texts = stored(spark, tmp_path)
    # a piece lost, another twice, a text changed, each committed as if it were right; then a file that vanishes
    drop, twice, other = (F.col("doc_id") == 9) & (F.col("piece") == 1), (F.col("doc_id") == 12) & (F.col("piece") == 0), F.col("doc_id") == 15

    def harm(old):
        text = F.when(other, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
        return old.filter(~drop).withColumn("content", text).union(old.filter(twice))

    index.tables.rewrite("pieces", range(32), harm)
    assert [d for d, _ in problems(index.outdated())] in ([], [12])
    report = index.verify()
    assert problems(report) == [(9, "damaged"), (12, "damaged"), (15, "damaged")]
    index.rebuild(also=report.buckets)
    assert agree(index, texts)
    (bucket,) = {r["b"] for r in spark.createDataFrame([(21,)], "doc_id long").select(index.tables.bucket_of("pieces").alias("b")).collect()}
    (entry,) = index.tables.state()["pieces"][bucket]
    for path in glob.glob(f"{tmp_path}/data/{entry['at']}/bucket={bucket}/*.parquet"):
        os.remove(path)
    report = index.verify()
    assert (21, "missing") in problems(report) and report.buckets == [bucket]
    index.rebuild(also=report.buckets)
    assert agree(index, texts) and problems(index.verify()) == []


def test_searches_pin_a_version(spark, tmp_path):
    index, texts = stored(spark, tmp_path, 12)
    before = index.pieces()
    index.save(spark.createDataFrame([(i, "gone") for i in range(12)], "doc_id long, content string"))
    index.rebuild("full")
    assert {r["content"] for r in index.pieces().collect()} == {"gone"}
    assert "gone" not in {r["content"] for r in before.collect()}
    with pytest.raises(ValueError):
        index.rebuild("verify")
