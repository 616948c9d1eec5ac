"""Streams with state: answers don't depend on how rows arrive, state shrinks, counts add up, pushes are made once. Their queries are compared with SQL besides."""

import random

import pytest
from pyspark.sql import functions as F

from tickerloom.sources.domain import News
from tickerloom.sources.lineage import fresh_path
from tickerloom.sources.versions import Tables
from tickerloom.streaming import alerts
from tickerloom.streaming import stateful as st

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, minute long, k string, batch int"


def timed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("id", F.timestamp_seconds(1_700_000_000 // 60 * 60 + F.col("minute") * 60).alias("ts"), "k", "batch")


def flagged(spark, rows, batches, minutes=60, delay="10 hours"):
    """What comes out, and the entries of state after each batch."""
    sizes = []

    def start(stream, root, batch):
        query = st.drain(st.keep_and_flag(stream, ["k"], minutes, delay), root)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    with st.state_store(spark):
        root = st.deliver(timed(spark, rows), batches, start)
    out = [tuple(r) for r in spark.read.schema("id long, duplicate_of long").parquet(f"{root}/out").collect()]
    assert len(out) == len(dict(out))
    return dict(out), sizes


def brute(rows, minutes=60):
    return {i: min((j for j, n, x, _ in rows if x == k and j < i and n >= m - minutes), default=-1) for i, m, k, _ in rows}


@pytest.mark.parametrize("batches", [1, 3])
def test_flags_do_not_depend_on_batches(spark, batches):
    rng = random.Random(4)
    rows = [(i, i + rng.randint(-200, 200), rng.choice("aab"), i * batches // 150) for i in range(150)]
    rows += [(150 + i, 160, "hot", batches - 1) for i in range(500)]
    found, _ = flagged(spark, rows, batches)
    assert found == brute(rows)


def test_state_shrinks(spark):
    rows = [(i, i % 30, f"k{i}", 0) for i in range(50)] + [(50, 100_000, "z", 1), (51, 100_001, "z", 2)]
    found, sizes = flagged(spark, rows, 3, delay="1 minute")
    assert found == brute(rows) and found[51] == 50
    assert sizes[0] >= 50 and sizes[-1] <= 3


def test_late_rows_add_up(spark):
    n = News(spark, SF)
    counts, progress = st.late_counts(n)
    by_kind = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    total = n.table("events").count()
    assert sum(by_kind.values()) == total == sum(p["rows_in"] for p in progress)
    assert by_kind["late"] == sum(p["late"] for p in progress) > 0
    assert by_kind["closed"] == sum(p["closed"] for p in progress) > 0


def test_pushes_once_and_by_the_positions_of_the_time(spark):
    n = News(spark, SF)
    tables = Tables(spark, fresh_path(spark, "pushes"), st.PUSHES, 4)
    docs = n.documents.select("doc_id", "group_id", "impact_score")
    run = st.push_batch(n, tables)
    run(docs, 0)  # nobody holds anything yet
    assert tables.read("pushes").count() == 0
    tables.append({"positions": st.positions_of(n)})
    run(docs, 0)  # tried again, this batch is done: nothing comes
    assert tables.read("pushes").count() == 0
    run(docs, 1)
    once = sorted(map(tuple, tables.read("pushes").collect()))
    run(docs, 1)
    assert once and sorted(map(tuple, tables.read("pushes").collect())) == once
    thresholds = {r["client_id"]: r["impact_threshold"] for r in n.clients.collect()}
    assert all(score >= thresholds[client] for client, _, score, _ in once)


def test_a_stream_that_breaks_off_pushes_once(spark, tmp_path):
    """The sink fails after its commit, so Spark runs the batch again from the checkpoint."""
    n = News(spark, SF)
    tables = Tables(spark, str(tmp_path / "pushes"), st.PUSHES, 4)
    tables.append({"positions": st.positions_of(n)})
    run, fails = st.push_batch(n, tables), [True]

    def sink(batch, number):
        run(batch, number)
        if fails:
            fails.clear()
            raise RuntimeError("lost")

    rows = n.documents.select("doc_id", "group_id", "impact_score")
    rows.write.parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    before = tables.read("pushes").count()
    go()
    assert before > 0 and tables.read("pushes").count() == before


def test_users_share_states(spark, monkeypatch):
    """Late counts of many users, one of them null: as many states as parts of the users, and the counts of each user by itself."""
    monkeypatch.setattr(st, "KEY_PARTS", 8)
    rng = random.Random(3)
    rows = [(i, None if i % 301 == 0 else i % 300, rng.randint(0, 4000) + 1000 * (i // 1500), i // 1500) for i in range(3000)]
    made = spark.createDataFrame(rows, "id long, user_id long, minute long, batch int")
    made = made.select("id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "user_id", "batch")
    sizes = []

    def start(stream, root, batch):
        sizes.append(st.drain(st.counting_late(stream), root, "kind").lastProgress["stateOperators"][0]["numRowsTotal"])

    with st.state_store(spark):
        root = st.deliver(made, 2, start)
        opened = {(r[0], int(r[1].timestamp()) // 3600): r[2] for r in st.open_hours(spark, root).collect()}
    assert max(sizes) <= 2 * 8
    high, top, late, kept = {}, {}, [], {}
    for _, u, m, b in rows:
        top[u] = max(top.get(u, 0), m)
        if b == 0:
            high[u] = max(high.get(u, 0), m)
    for i, u, m, b in rows:
        if b and u in high and m // 60 < high[u] // 60 - 24:
            late.append((u, i))
        else:
            kept[u, m // 60] = kept.get((u, m // 60), 0) + 1
    out = [tuple(r) for r in spark.read.schema(st.COUNTED).parquet(f"{root}/out").collect()]
    assert late and sorted((str(r[0]), r[3]) for r in out if r[4] == "late") == sorted((str(u), i) for u, i in late)
    closed = {}
    for u, at, n, _, kind in out:
        if kind == "closed":
            closed[u, int(at.timestamp()) // 3600] = closed.get((u, int(at.timestamp()) // 3600), 0) + n
    assert closed == {k: n for k, n in kept.items() if k[1] < top[k[0]] // 60 - 24}
    assert opened == {k: n for k, n in kept.items() if k[1] >= top[k[0]] // 60 - 24}


def test_capped_users_share_states(spark, monkeypatch):
    """Alerts of many users and days, in two batches: as many states as parts, at most two a user and day, nulls as one user; days that are over go."""
    monkeypatch.setattr(alerts, "CAP_PARTS", 8)
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 0 else i % 40, 1440 * (19_000 + i // 400) + rng.randint(0, 700) + 740 * (i % 400 // 300), i // 1000) for i in range(2000)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, minute long, batch int")
    made = made.select("event_id", "user_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "batch")
    sizes = []

    def start(stream, root, batch):
        progress = st.drain(alerts.alert_cap(stream.withWatermark("ts", "20 hours"), 2), root).recentProgress
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in progress))

    root = st.deliver(made, 2, start)
    found = sorted(r[0] for r in spark.read.schema("event_id long, user_id long").parquet(f"{root}/out").collect())
    sent, wanted = {}, []
    for i, u, m, _ in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        sent[u, m // 1440] = sent.get((u, m // 1440), 0) + 1
        if sent[u, m // 1440] <= 2:
            wanted.append(i)
    assert max(sizes) <= 8
    assert found == sorted(wanted)
