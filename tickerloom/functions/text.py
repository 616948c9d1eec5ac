"""Text functions: counts, scripts, chunks, hash embeddings, tolerant JSON."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import vocabulary as v
from tickerloom.sources.lineage import map_batches

CHUNK, OVERLAP, LEAST = 1000, 200, 100
#: What stands between the words of a text, in any script.
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}_]+"
#: Sentence ends, by priority.
BOUNDARIES = [". ", ".\n", "! ", "!\n", "? ", "?\n"]
EXTRACTION = (
    "impact_score DOUBLE, impact_tier STRING, events ARRAY<STRUCT<event_type: STRING, confidence: DOUBLE>>, "
    "instruments ARRAY<STRUCT<ticker: STRING, direction: STRING, magnitude: STRING>>, themes ARRAY<STRING>, summary STRING"
)
RESTRICTIONS = (
    "ethical_sector STRUCT<excluded_industries: ARRAY<STRING>, faith_based: STRING>, "
    "impact_sustainability STRUCT<impact_mandate: BOOLEAN, impact_themes: ARRAY<STRING>>"
)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it; functions of lambdas would compute it again each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    """Words of a text, lower case."""
    return F.filter(F.split(F.lower(c), BETWEEN_WORDS), lambda t: t != "")


def is_cjk(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"[一-鿿぀-ゟ゠-ヿ가-힯]")), F.lit(False))


def parse_datetime(c: Column) -> Column:
    """A date or time as ISO 8601 writes it, in UTC if it names a zone; null for anything else, impossible dates too."""
    text = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})[Tt ]", "$1 ")
    zoned = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"))
    plain = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"))
    full = F.regexp_replace(text, r"^(.{10} \d{2}:\d{2})(?!:)", "$1:00")  # a cast asks for seconds
    there = F.convert_timezone(F.current_timezone(), F.lit("UTC"), full.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, there).when(plain, full.try_cast("timestamp_ntz"))


def scenario_of_title(c: Column) -> Column:
    """What stands in the brackets that open a title, if it begins with Phase3; else null."""
    found = F.regexp_extract(c, r"^\s*\[(Phase3[^\]]*)\]", 1)
    return F.when(found != "", found)


def hash_embedding(c: Column, dims: int = 384) -> Column:
    """Byte i % 32 of the SHA-256, from -1 to 1."""
    byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, 2), 16, 10).cast("int") / 255 * 2 - 1
    cycle = let(F.sha2(F.coalesce(c, F.lit("")), 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(digest, i)))
    return F.slice(F.flatten(F.array_repeat(cycle, -(-dims // 32))), 1, dims)


def tolerant_list(c: Column) -> Column:
    """A JSON list of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def parse_extraction(c: Column) -> Column:
    """A struct of score (0-100), tier, primary event, tickers, themes and summary; null without score, tier or valid JSON."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^```(json)?|```$", ""))
    x = F.from_json(bare, EXTRACTION)
    theme = F.transform(F.coalesce(x["themes"], F.array().cast("array<string>")), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_")))
    known = F.array(*[F.lit(t) for t in v.THEMES])
    events = F.coalesce(x["events"], F.array().cast("array<struct<event_type:string,confidence:double>>"))
    best = F.aggregate(
        events, F.struct(F.lit("OTHER").alias("event_type"), F.lit(-1.0).alias("confidence")),
        lambda a, e: F.when(F.coalesce(e["confidence"], F.lit(0.5)) > a["confidence"], F.struct(F.coalesce(e["event_type"], F.lit("OTHER")).alias("event_type"), F.coalesce(e["confidence"], F.lit(0.5)).alias("confidence"))).otherwise(a),
    )
    tier = F.upper(x["impact_tier"])
    made = F.struct(
        F.greatest(F.lit(0), F.least(F.lit(100), x["impact_score"].cast("int"))).alias("impact_score"),
        F.when(tier.isin(v.TIERS), tier).otherwise("STANDARD").alias("impact_tier"),
        best["event_type"].alias("event"),
        F.transform(F.coalesce(x["instruments"]["ticker"], F.array().cast("array<string>")), lambda t: F.upper(t)).alias("tickers"),
        F.filter(theme, lambda t: F.array_contains(known, t)).alias("themes"),
        F.substring(F.coalesce(x["summary"], F.lit("")), 1, 200).alias("summary"),
    )
    return F.when(x["impact_score"].isNotNull() & x["impact_tier"].isNotNull(), made)


def spans_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size`` that overlap; a piece ends behind the first kind of sentence end that its last fifth holds."""
    ends = [[m.end() for m in re.finditer(re.escape(mark), text)] for mark in BOUNDARIES]

    def stop(start: int) -> int:
        most = start + size
        if most >= len(text):
            return len(text)
        last = [found[bisect_right(found, most) - 1] if found and found[0] <= most else -1 for found in ends]
        return next((e for e, mark in zip(last, BOUNDARIES, strict=True) if e - len(mark) >= start + size * 4 // 5), most)

    spans = [(0, stop(0))]
    while spans[-1][1] < len(text):
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1)
        spans.append((start, stop(start)))
    return spans


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, content) of the pieces without white space around them; those below ``least`` are left out, but a short text is a piece."""
    if len(text) <= size:
        return [(0, len(text), text)]
    pieces = [(a, b, text[a:b].strip()) for a, b in spans_of(text, size, overlap)]
    return [p for p in pieces if len(p[2]) >= least]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "content", with_content: bool = True) -> DataFrame:
    """(id, chunk_index, start_char, end_char, content): all pieces of every whole text; a short text is one chunk, null is empty. Without content, places only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunks_of(t or "") for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            every = [c for x in found for c in x]
            index = pa.array([n for size in sizes for n in range(size)], pa.int32())
            places = [pa.array([c[k] for c in every], pa.int32()) for k in (0, 1)]
            ids = batch.column(0).take(pa.array([i for i, size in enumerate(sizes) for _ in range(size)], pa.int64()))
            more = [pa.array([c[2] for c in every], pa.string())] if with_content else []
            yield pa.RecordBatch.from_arrays([ids, index, *places, *more], names=names)

    names = [id_col, "chunk_index", "start_char", "end_char"] + ["content"] * with_content
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text), run, f"`{id_col}` {kind}, chunk_index int, start_char int, end_char int" + ", content string" * with_content)


def piece_of(text: Column, index: Column) -> Column:
    """The content of one piece of a text; for the few rows whose pieces are shown."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(t or "")[n][2] for t, n in zip(texts, numbers, strict=True)])

    return cut(text, index)
