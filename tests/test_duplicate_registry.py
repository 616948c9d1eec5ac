"""The duplicate registry: batches against one batch, unregistering, replays, odd rows. Its query is compared with SQL besides."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickerloom.operators.duplicate_registry import DOCUMENT, DuplicateRegistry


def document(i, text="", group=1, source="s", hour=0, event="IPO", tickers=("A",), vector=(1.0, 0.0)):
    return (i, group, source, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), "", text, event, None if tickers is None else list(tickers), None if vector is None else list(vector))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


def found(df):
    return {r["doc_id"]: (r["method"], r["duplicate_of"]) for r in df.collect()}


def mixed_documents(n=90):
    """Copies by text, by story, by vector and by words, in no order; and documents that match nothing."""
    rng, rows = random.Random(6), []
    for i in range(n):
        text = " ".join(rng.choices([f"w{k}" for k in range(400)], k=30)) + f" only{i}"
        row = dict(text=text, group=rng.randint(0, 1), source=rng.choice("st"), hour=i, event=f"E{i}", tickers=(f"T{i}",), vector=[rng.gauss(0, 1) for _ in range(16)])
        kind, old = rng.randint(0, 6), rows[rng.randrange(len(rows))] if rows else None
        if old and kind < 4:
            if kind == 0:
                row |= {"text": " " + old["text"].upper(), "group": old["group"]}
            elif kind == 1:
                row |= {"event": old["event"], "tickers": old["tickers"], "group": old["group"], "hour": max(i, old["hour"])}
            elif kind == 2:
                row |= {"vector": [x + 0.01 for x in old["vector"]], "group": old["group"]}
            else:
                row |= {"text": old["text"] + " more", "source": old["source"]}
        rows.append(row)
    return [document(i, **row) for i, row in enumerate(rows)]


def test_batches_find_what_one_batch_finds(spark, tmp_path):
    rows = mixed_documents()
    whole = found(DuplicateRegistry(spark, str(tmp_path / "one"), 8).check(frame(spark, rows)))
    assert {m for m, _ in whole.values()} == {"none", "hash", "fingerprint", "embedding", "tokens"}
    registry, parts = DuplicateRegistry(spark, str(tmp_path / "many"), 8), {}
    registry.load(frame(spark, rows[:40]), "first")
    for lo, hi in ((40, 41), (41, 90)):
        parts |= found(registry.check_and_register(frame(spark, rows[lo:hi]), f"{lo}"))
    assert parts == {i: x for i, x in whole.items() if i >= 40} and registry.count() == 90
    assert not registry.register(frame(spark, rows[40:41]), "40") and registry.count() == 90
    # checking what is registered already finds the same, as only earlier documents count
    assert found(registry.check(frame(spark, rows[60:70]))) == {i: whole[i] for i in range(60, 70)}


def test_unregistering_falls_back(spark, tmp_path):
    registry = DuplicateRegistry(spark, str(tmp_path), 4)
    rows = [document(i, "the same words", tickers=(f"T{i}",), hour=100 * i, source=f"s{i}", vector=None) for i in range(3)]
    registry.register(frame(spark, rows))
    late = frame(spark, [document(9, "The same\twords", hour=900, source="x", vector=None)])
    assert found(registry.check(late)) == {9: ("hash", 0)}
    assert registry.unregister(frame(spark, rows[:1])) == 1 and found(registry.check(late)) == {9: ("hash", 1)}
    assert registry.unregister(spark.createDataFrame([(1,), (2,), (77,)], "doc_id long")) == 2
    assert found(registry.check(late)) == {9: ("none", -1)} and registry.count() == 0
    registry.register(frame(spark, rows))
    registry.register(frame(spark, [document(1, "other words", tickers=("T1",), hour=100, source="s1", vector=None)]))  # replaces
    assert registry.count() == 3
    assert registry.unregister(frame(spark, rows[:1])) == 1 and found(registry.check(late)) == {9: ("hash", 2)}
    registry.clear()
    assert registry.count() == 0 and found(registry.check(late)) == {9: ("none", -1)}


def test_a_batch_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    registry = DuplicateRegistry(spark, str(tmp_path), 64)
    registry.register(frame(spark, [document(i, f"text {i}", tickers=(f"T{i}",), hour=30 * i, source=f"s{i}") for i in range(40)]))
    read, seen = registry.tables.read, {}

    def watched(table, **options):
        seen[table] = options["buckets"]
        return read(table, **options)

    monkeypatch.setattr(registry.tables, "read", watched)
    assert found(registry.check(frame(spark, [document(100, "text 7", hour=210 + 24 * 30)]))) == {100: ("hash", 7)}
    assert {t: len(b) for t, b in seen.items()} == {"hashes": 1, "stories": 1, "vectors": 3, "tokens": 1}


def test_odd_documents(spark, tmp_path):
    registry = DuplicateRegistry(spark, str(tmp_path), 4)
    empty = [document(1, None, source=None, tickers=None, vector=None, event=None), document(2, " \n", source=None, tickers=(), vector=None, event="OTHER", hour=1)]
    assert found(registry.check_and_register(frame(spark, empty))) == {1: ("none", -1), 2: ("fingerprint", 1)}
    assert found(registry.check_and_register(frame(spark, []))) == {}
    assert registry.unregister(frame(spark, [])) == 0
    day = [document(3, "x y", tickers=("B",), hour=47, vector=(0.6, 0.8)), document(4, "z", tickers=("C",), hour=95, vector=(0.6, 0.8)), document(5, "q", tickers=("D",), hour=144, vector=(0.6, 0.8))]
    assert found(registry.check_and_register(frame(spark, day))) == {3: ("none", -1), 4: ("embedding", 3), 5: ("none", -1)}


def test_many_copies_of_one_text(spark, tmp_path):
    registry = DuplicateRegistry(spark, str(tmp_path), 4)
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("group_id"), F.lit("s").alias("source"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id * 25)").alias("created_at"),
        F.lit("").alias("title"), F.lit("one text").alias("content"), F.lit("E").alias("event_type"), F.array(F.col("id").cast("string")).alias("tickers"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    out = registry.check_and_register(rows)
    assert out.filter("method = 'hash' AND duplicate_of = 0").count() == 2999
