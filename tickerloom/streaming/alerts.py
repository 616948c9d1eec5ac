"""Streams over the event table: deduplication, digests, bursts and a daily cap of alerts.

Each drains what is there (``availableNow``) into Parquet below a fresh shared folder and returns it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerloom.operators.feeds import rank_in
from tickerloom.sources.domain import News
from tickerloom.sources.lineage import shared_root


def _events(n: News) -> DataFrame:
    """The event table as a stream; timestamps get the session's time zone for watermarks."""
    schema = n.table("events").schema
    rows = n.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(n.dir) if not _is_folder(n) else n.spark.readStream.schema(schema).parquet(f"{n.dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(n: News) -> bool:
    """Whether the table is a folder of files, by the file names that Spark lists."""
    return not n.table("events").inputFiles()[0].endswith("events.parquet")


def _drained(n: News, stream: DataFrame, mode: str = "append") -> DataFrame:
    root = f"{shared_root(n.spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return n.spark.read.schema(stream.schema).parquet(f"{root}/rows")


def stream_dedupe(n: News) -> DataFrame:
    """Each (user, type, props) once within a day."""
    rows = _events(n).withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(["user_id", "event_type", "props"])
    return _drained(n, rows.select("user_id", "event_type", "props"))


def stream_digest(n: News) -> DataFrame:
    """Closed hourly windows by type, with a watermark of one hour; the last open ones aren't out yet."""
    rows = _events(n).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _drained(n, rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


def stream_user_digest(n: News, most: int = 5) -> DataFrame:
    """The instruments that a user saw most in each closed day, the first ``most`` of them."""
    seen = _events(n).withColumn("instrument_id", F.get_json_object("props", "$.k").cast("long")).filter("instrument_id IS NOT NULL")
    rows = seen.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "user_id", "instrument_id").agg(F.count("*").alias("n"))
    closed = _drained(n, rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "user_id", "instrument_id", "n"))
    return closed.withColumn("rank", rank_in(["day", "user_id"], F.col("n").desc(), F.col("instrument_id"))).filter(F.col("rank") <= most)


def stream_trending(n: News) -> DataFrame:
    """Closed windows of six hours that slide by one, by type."""
    rows = _events(n).withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _drained(n, rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


def stream_sessions(n: News) -> DataFrame:
    """Bursts of a user's events with gaps below 30 minutes."""
    rows = _events(n).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return _drained(n, rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"))


#: Users and days of ``alert_cap`` share a state by a hash, so that what Spark does for each state is done for many at once.
CAP_PARTS = 2_048


def alert_cap(rows: DataFrame, most: int) -> DataFrame:
    """(event_id, user_id): at most ``most`` of a user's rows (event_id, user_id, ts) a day, by time within what arrives together; a day's state goes when the watermark passes its end."""

    def cap(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, days, counts = state.get if state.exists else ([], [], [])
        sent = pd.DataFrame({"user": np.array(users, object), "day": np.array(days, object), "sent": np.array(counts, np.int64)})
        if not state.hasTimedOut:
            new = pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)
            before = new[["user", "day"]].merge(sent, "left", ["user", "day"])["sent"].fillna(0).to_numpy(np.int64)
            new = new[before + new.groupby(["user", "day"]).cumcount().to_numpy() < most]
            told = new.groupby(["user", "day"]).size().rename("sent").reset_index()
            sent = pd.concat([sent, told]).groupby(["user", "day"], as_index=False)["sent"].sum()
            yield new[["event_id", "user_id"]]
        # a day ends up to twelve hours later than in UTC
        ends = (pd.to_datetime(sent["day"]).to_numpy("datetime64[ms]").astype(np.int64)) + 36 * 3_600_000
        stays = ends > state.getCurrentWatermarkMs()
        if not stays.any():
            state.remove()
            return
        sent = sent[stays]
        state.update((sent["user"].tolist(), sent["day"].tolist(), sent["sent"].tolist()))
        state.setTimeoutTimestamp(int(ends[stays].min()))

    named = rows.select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("user_id", "day"), F.lit(CAP_PARTS)).cast("int")).groupBy("part")
    return parts.applyInPandasWithState(
        cap, "event_id long, user_id long", "users array<string>, days array<string>, sent array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_alert_cap(n: News, most: int = 2) -> DataFrame:
    """Errors that alert a user: at most ``most`` a day."""
    return _drained(n, alert_cap(_events(n).filter(F.col("event_type") == "error").withWatermark("ts", "1 hour"), most))


_OPEN = "(SELECT max(ts) - INTERVAL 1 HOUR FROM {})"
QUERIES = {f.__name__: f for f in (stream_dedupe, stream_digest, stream_user_digest, stream_trending, stream_sessions, stream_alert_cap)}
SQL = {
    "stream_dedupe": "SELECT DISTINCT user_id, event_type, props FROM events",
    "stream_digest": f"""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
        HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {_OPEN.format('events')}""",
    "stream_user_digest": f"""SELECT day, user_id, instrument_id, n, row_number() OVER (PARTITION BY day, user_id ORDER BY n DESC, instrument_id) AS rank FROM (
        SELECT date_trunc('day', ts) AS day, user_id, (props->>'$.k')::BIGINT AS instrument_id, count(*) AS n FROM events WHERE props->>'$.k' IS NOT NULL
        GROUP BY 1, 2, 3 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {_OPEN.format("events WHERE props->>'$.k' IS NOT NULL")}) QUALIFY rank <= 5""",
    "stream_trending": f"""SELECT start AS start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(h) AS start, event_type FROM events, range(0, 6) hs(h))
        GROUP BY 1, 2 HAVING min(start) + INTERVAL 6 HOUR <= {_OPEN.format('events')}""",
    "stream_sessions": f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, TRUE))::INT AS fresh FROM events)) GROUP BY user_id, s
        HAVING max(ts) + INTERVAL 30 MINUTE <= {_OPEN.format('events')}""",
    "stream_alert_cap": """SELECT event_id, user_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2""",
}
