"""Streams with state of their own: duplicates that are named and kept, late rows that are counted, and pushes that are made once.

The queries deliver the given rows in batches. Each batch is drained by a query of its own that starts from the checkpoint of the one before it, so
every batch is also a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import sql
from tickerloom.sources.lineage import fresh_path
from tickerloom.sources.versions import Table, Tables

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, as stateful processors need; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def deliver(rows: DataFrame, batches: int, start: Callable[[DataFrame, str, int], None]) -> str:
    """Append the rows of batch 0, 1, ... (column ``batch``) to a folder, and let ``start`` drain the stream of it after each; the root of it all."""
    spark, names = rows.sparkSession, [c for c in rows.columns if c != "batch"]
    root = fresh_path(spark, "arrivals")
    for batch in range(batches):
        rows.filter(F.col("batch") == batch).select(names).write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(rows.select(names).schema).parquet(f"{root}/in"), root, batch)
    return root


def drain(stream: DataFrame, root: str, *partitions: str):
    """Write what a stream has now as Parquet below ``root``; the ended query."""
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query = (writer.partitionBy(*partitions) if partitions else writer).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# duplicates


#: Keys of ``keep_and_flag`` share a state by a hash, so that what Spark does for each state is done for many keys at once.
KEY_PARTS = 2_048


class KeepAndFlag(StatefulProcessor):
    """Names, for each row of a key, the earliest arrived row of the key that is at most ``minutes`` older (by whole minutes).

    The state of a part of the keys is a list of (name, minute, id): for each key the smallest id of each minute, without those that a later minute with a
    smaller id makes needless; so it has an entry a key and minute at most, however many copies arrive. Entries that the watermark has left behind go, and a
    timer drops the whole list when no row can match it any more.
    """

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", "name string, minute long, id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([f[["id", "ts", "name"]] for f in rows])
        ids, minutes = own["id"].to_numpy(np.int64), own["ts"].to_numpy("datetime64[m]").astype(np.int64)
        held = list(self.first.get())
        codes, names = pd.factorize(np.array([r[0] for r in held] + own["name"].tolist(), object))
        every = np.concatenate([np.array([r[1:] for r in held], np.int64).reshape(-1, 2), np.stack([minutes, ids], axis=1)])
        order = np.lexsort((every[:, 0], codes))
        sorted_codes, every = codes[order], every[order]
        last = np.append(sorted_codes[1:] != sorted_codes[:-1], True)
        least = pd.Series(every[::-1, 1]).groupby(sorted_codes[::-1]).cummin().to_numpy()[::-1]  # the smallest id of the key from a minute on
        base = every[:, 0].min() - self.minutes
        span = every[:, 0].max() - base + 1
        found = least[np.searchsorted(sorted_codes * span + every[:, 0] - base, codes[len(held) :] * span + minutes - self.minutes - base)]
        needed = last | (every[:, 1] < np.append(least[1:], 0))
        needed &= every[:, 0] >= timerValues.getCurrentWatermarkInMs() // 60_000 - self.minutes
        kept = [(names[c], int(m), int(i)) for c, (m, i) in zip(sorted_codes[needed], every[needed], strict=True)]
        if kept:
            self.first.put(kept)
        else:
            self.first.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(every[:, 0].max()) + self.minutes + 1) * 60_000)
        yield pd.DataFrame({"id": ids, "duplicate_of": np.where(found < ids, found, -1)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_and_flag(stream: DataFrame, keys: list[str], minutes: int = 48 * 60, delay: str = "1 hour") -> DataFrame:
    """(id, duplicate_of) for every row of a stream with columns id, ts and keys; -1 without an earlier copy.

    Ids ascend with arrival. Rows behind the watermark are dropped by Spark: ``delay`` must cover them, or ``counting_late`` counts them.
    """
    named = stream.withWatermark("ts", delay).select("id", "ts", F.to_json(F.struct(*keys)).alias("name"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(KEY_PARTS)).cast("int")).groupBy("part")
    return parts.transformWithStateInPandas(KeepAndFlag(minutes), "id long, duplicate_of long", "Append", "EventTime")


def _events(n: News) -> DataFrame:
    return n.table("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props")


def _part(n: News, table: str, column: str, parts: int):
    """Which of ``parts`` equal ranges of a number a row lies in."""
    most = n.table(table).agg(F.max(column)).first()[0] or 0
    return lambda c: F.floor(F.col(c) * parts / (most + 1)).cast("int")


KEPT_BATCHES = 3


def stream_keep_flag(n: News) -> DataFrame:
    """Every event, with the first event of the same user, type and properties of the two days before it."""
    rows = _events(n).withColumn("batch", _part(n, "events", "event_id", KEPT_BATCHES)("id"))
    with state_store(n.spark):
        root = deliver(rows, KEPT_BATCHES, lambda stream, root, _: drain(keep_and_flag(stream, ["user_id", "event_type", "props"]), root))
    return n.spark.read.schema("id long, duplicate_of long").parquet(f"{root}/out").select(F.col("id").alias("event_id"), "duplicate_of")


# late rows


#: Stands for no user in states and joins of ``counting_late``.
NOBODY = -(2**63)


class CountingLate(StatefulProcessor):
    """Hourly counts of users, closed by each one's own watermark; rows of closed hours come out as late ones.

    A user's watermark is the greatest time of its batches before, less a delay. A part of the users keeps these and the open hours in one state
    each, as lists. So nothing is dropped unseen, and what is closed, late and open adds up to what came in.
    """

    def __init__(self, delay_hours: int):
        self.delay = delay_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "user_id array<long>, seconds array<long>")
        self.open = handle.getValueState("open", "user_id array<long>, hour array<long>, n array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        users, seconds = self.high.get() if self.high.exists() else ([], [])
        high = pd.Series(np.array(seconds, np.int64), np.array(users, np.int64))
        held = self.open.get() if self.open.exists() else ([], [], [])
        counts, highs = [pd.Series(np.array(held[2], np.int64), pd.MultiIndex.from_arrays([np.array(x, np.int64) for x in held[:2]]))], [high]
        for frame in rows:
            user, seconds = frame["user_id"].to_numpy(np.int64), frame["ts"].to_numpy("datetime64[s]").astype(np.int64)
            hours = seconds // 3600
            late = hours < (high.reindex(user) // 3600 - self.delay).to_numpy()  # hours before this one are over; none for a new user
            if late.any():
                yield self._rows(user[late], "late", hours[late], np.ones(late.sum(), np.int64), frame["id"].to_numpy(np.int64)[late])
            highs.append(pd.Series(seconds, user).groupby(level=0).max())
            on_time = pd.Series(1, pd.MultiIndex.from_arrays([user[~late], hours[~late]]), np.int64)
            counts.append(on_time.groupby(level=[0, 1]).sum())
        high = pd.concat(highs).groupby(level=0).max()
        count = pd.concat([c for c in counts if len(c)] or counts[:1]).groupby(level=[0, 1]).sum()
        user, hours = (count.index.get_level_values(i).to_numpy(np.int64) for i in (0, 1))
        over = hours < high.reindex(user).to_numpy() // 3600 - self.delay
        self.high.update((high.index.tolist(), high.tolist()))
        self.open.update((user[~over].tolist(), hours[~over].tolist(), count.to_numpy()[~over].tolist()))
        if over.any():
            yield self._rows(user[over], "closed", hours[over], count.to_numpy()[over], np.full(over.sum(), -1))

    @staticmethod
    def _rows(users: np.ndarray, kind: str, hours: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"user_id": users, "start": pd.to_datetime(hours * 3600, unit="s", utc=True), "n": counts, "id": ids, "kind": kind})

    def close(self) -> None:
        pass


COUNTED = "user_id long, start timestamp, n long, id long, kind string"


def counting_late(stream: DataFrame, delay_hours: int = 24) -> DataFrame:
    """(user_id, start, n, id, kind): closed hours with their counts, and late rows one by one, of a stream with id, ts and user_id; counts are observed too."""
    named = stream.select("id", "ts", F.coalesce("user_id", F.lit(NOBODY)).alias("user_id"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(KEY_PARTS)).cast("int")).groupBy("part")
    counted = parts.transformWithStateInPandas(CountingLate(delay_hours), COUNTED, "Append", "None")
    counted = counted.withColumn("user_id", F.nullif("user_id", F.lit(NOBODY)))
    number = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    return counted.observe("counted", number("closed"), number("late"))


def open_hours(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, start, n) of the hours that aren't closed, from the state of a drained stream."""
    state = spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", "open").load()
    hours = state.select(F.inline(F.arrays_zip("value.user_id", "value.hour", "value.n")))
    return hours.select(F.nullif("user_id", F.lit(NOBODY)).alias("user_id"), F.timestamp_seconds(F.col("hour") * 3600).alias("start"), "n")


LATE_BATCHES = 5


def late_counts(n: News) -> tuple[DataFrame, list[dict]]:
    """(kind, user_id, start, n) of closed, late and open hours, and the progress of each batch; every 29th event arrives two batches late."""
    rows = _events(n).withColumn("batch", F.least(_part(n, "events", "event_id", LATE_BATCHES - 1)("id") + F.when(F.col("id") % 29 == 7, 2).otherwise(0), F.lit(LATE_BATCHES - 1)))
    progress: list[dict] = []

    def start(stream: DataFrame, root: str, batch: int) -> None:
        for p in drain(counting_late(stream), root, "kind").recentProgress:
            seen = p.observedMetrics.get("counted")
            progress.append({"batch": batch, "rows_in": p.numInputRows, "closed": seen["closed"] if seen else 0, "late": seen["late"] if seen else 0})

    with state_store(n.spark):
        root = deliver(rows, LATE_BATCHES, start)
        out = n.spark.read.schema(COUNTED).parquet(f"{root}/out").groupBy("kind", "user_id", "start").agg(F.sum("n").alias("n"))
        every = out.unionByName(open_hours(n.spark, root).withColumn("kind", F.lit("open")))
    return every.select("kind", "user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"), progress


def stream_late_news(n: News) -> DataFrame:
    return late_counts(n)[0]


# pushes

PUSHES = {
    "positions": Table("client_id long, instrument_id long, weight double, watched int", ("client_id",)),
    "pushes": Table("client_id long, doc_id long, score double, batch long", ("client_id",)),
}


def positions_of(n: News) -> DataFrame:
    """(client_id, instrument_id, weight, watched): what clients hold or watch."""
    held = n.holds.select("client_id", "instrument_id", "weight", F.lit(0).alias("watched"))
    seen = n.watches.select("client_id", "instrument_id", F.lit(0.0).alias("weight"), F.lit(1).alias("watched"))
    return held.unionByName(seen).groupBy("client_id", "instrument_id").agg(F.max("weight").alias("weight"), F.max("watched").alias("watched"))


def push_batch(n: News, tables: Tables, name: str = "push") -> Callable[[DataFrame, int], None]:
    """What a stream of documents (doc_id, group_id, impact_score) does with each batch: clients get those that score at or above their threshold.

    Positions are read anew for each batch, so changes between batches count. Pushes are committed once under the batch's number, so a batch
    that is run again after a failure pushes nothing twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        if tables.done(f"{name}-{number}"):
            return
        # by instrument and group: a document meets the holders who may read it, not all clients of its group
        holders = tables.read("positions").join(n.permitted, "client_id")
        met = batch.join(n.affects.select("doc_id", "instrument_id"), "doc_id").join(holders, ["instrument_id", "group_id"])
        score = F.coalesce(F.col("impact_score"), F.lit(0)) + F.col("weight") * 100 + F.col("watched") * 50
        best = met.groupBy("client_id", "doc_id").agg(F.round(F.max(score), 6).alias("score"))
        due = best.join(n.clients.select("client_id", "impact_threshold"), "client_id").filter("score >= impact_threshold")
        tables.commit({"pushes": tables.stage("pushes", due.withColumn("batch", F.lit(number).cast("long")))}, once=f"{name}-{number}")

    return run


PUSH_BATCHES = 3


def stream_push(n: News) -> DataFrame:
    """Pushes of documents that arrive in batches; a third of the instruments is bought after the first batch, and every batch runs twice."""
    rows = n.documents.select("doc_id", "group_id", "impact_score").withColumn("batch", _part(n, "documents", "doc_id", PUSH_BATCHES)("doc_id"))
    tables = Tables(n.spark, fresh_path(n.spark, "pushes"), PUSHES, 8)
    held = positions_of(n)
    tables.append({"positions": held.filter(F.col("instrument_id") % 3 != 0)})
    run = push_batch(n, tables)

    def twice(batch: DataFrame, number: int) -> None:
        run(batch, number)
        run(batch, number)

    def start(stream: DataFrame, root: str, batch: int) -> None:
        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        if batch == 0:
            tables.append({"positions": held.filter(F.col("instrument_id") % 3 == 0)})

    deliver(rows, PUSH_BATCHES, start)
    return tables.read("pushes")


def _batch(table: str, column: str, parts: int) -> str:
    return f"floor({column} * {parts} / ((SELECT max({column}) FROM {table}) + 1))::INTEGER"


QUERIES = {f.__name__: f for f in (stream_keep_flag, stream_late_news, stream_push)}
SQL = {
    "stream_keep_flag": """WITH e AS (SELECT event_id, user_id, event_type, props, epoch(date_trunc('minute', ts)) // 60 AS m FROM events)
        SELECT a.event_id, coalesce(min(b.event_id), -1) AS duplicate_of FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.props = b.props
        AND b.event_id < a.event_id AND b.m >= a.m - 2880 GROUP BY 1""",
    "stream_late_news": f"""WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS start, least({_batch("events", "event_id", LATE_BATCHES - 1)} + CASE WHEN event_id % 29 = 7 THEN 2 ELSE 0 END, {LATE_BATCHES - 1}) AS batch, ts FROM events),
        highs AS (SELECT user_id, batch, max(max(ts)) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e GROUP BY 1, 2),
        told AS (SELECT e.*, coalesce(start < date_trunc('hour', high) - INTERVAL 24 HOUR, FALSE) AS late FROM e JOIN highs USING (user_id, batch)),
        ends AS (SELECT user_id, date_trunc('hour', max(ts)) - INTERVAL 24 HOUR AS over FROM e GROUP BY 1)
        SELECT CASE WHEN late THEN 'late' WHEN start < over THEN 'closed' ELSE 'open' END AS kind, user_id, start, count(*) AS n FROM told JOIN ends USING (user_id) GROUP BY 1, 2, 3""",
    "stream_push": sql(
        """SELECT client_id, doc_id, score, batch::BIGINT AS batch FROM (SELECT client_id, doc_id, any_value(batch) AS batch, round(max(coalesce(impact_score, 0) + weight * 100 + watched * 50), 6) AS score
        FROM arr JOIN affects USING (doc_id) JOIN pos USING (instrument_id) JOIN permitted USING (client_id, group_id) WHERE batch > 0 OR instrument_id % 3 <> 0 GROUP BY 1, 2)
        JOIN clients USING (client_id) WHERE score >= impact_threshold""",
        ("arr", f"SELECT doc_id, group_id, impact_score, {_batch('docs', 'doc_id', PUSH_BATCHES)} AS batch FROM docs"),
        ("pos", """SELECT client_id, instrument_id, max(weight) AS weight, max(watched) AS watched FROM (SELECT client_id, instrument_id, weight, 0 AS watched FROM holds
            UNION ALL SELECT client_id, instrument_id, 0.0, 1 FROM watches) GROUP BY 1, 2"""),
    ),
}
