"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its 5-word shingles with their counts, and its words with a quarter of
theirs. For sample j and term of weight S, gamma variables r, c and a uniform b that depend on
(term, j) only give t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the term with the
smallest a is sampled. Two sets draw the same (term, t) with a probability equal to their
generalised Jaccard similarity, sum of minimums over sum of maximums, so the share of equal
samples estimates it.

With E1 = r (1 - b) and E2 = r b, which are independent exponentials for r of shape 2, a term of weight 1 has
t = 0 and a = c exp(-E1), an exponential too; call it e. Given e, c is e + E3 with E3 exponential. So three
independent exponentials e, E2, E3 give r = ln(1 + E3 / e) + E2, t = floor((ln S + E2) / r) and ln a = ln e - r t, exactly, and
terms of weight 1 need e only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import parts, read

SAMPLES = 64
SHINGLE = 5
WORD_WEIGHT = 0.25
SEED = 17
#: Documents whose terms are sampled together, and words that a worker remembers.
STEP_DOCS = 16
CACHE_WORDS = 500_000
#: Terms of which all samples are held at a time.
STEP_TERMS = 1_024


@lru_cache(maxsize=4)
def _lanes(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return tuple(rng.integers(1, 1 << 32, samples, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def sample_bits(terms: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """32 uniform bits for each term (row) and sample (column)."""
    one, two = _lanes(samples, seed)
    x = (terms & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * one
    x += (terms >> np.uint64(32)).astype(np.uint32)[:, None] * two
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


def _exponential(bits: np.ndarray) -> np.ndarray:
    """Exponentials that grow with the bits, with full relative precision near 0."""
    v = (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
    small = v * (np.float32(1) + v * (np.float32(0.5) + v * np.float32(1 / 3)))
    return np.where(v < 0.01, small, -np.log(np.maximum(np.float32(1) - v, np.float32(2.0**-33))))


def weighted_values(bits: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t for terms of any positive weights, from their bits."""
    y = (bits ^ (bits >> np.uint32(16))) * np.uint32(0x7FEB352D)
    y ^= y >> np.uint32(15)
    z = y * np.uint32(0x846CA68B)
    z ^= z >> np.uint32(16)
    e, e2, e3 = _exponential(bits), *(-np.log((w.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)) for w in (y, z))
    log_e = np.log(e)
    e += e3
    r = np.log(e, out=e)
    r -= log_e
    r += e2
    np.maximum(r, np.float32(1e-30), out=r)
    e2 += np.log(weights.astype(np.float32))[:, None]
    t = np.floor(np.clip(e2 / r, -(2.0**30), 2.0**30))
    return log_e - r * t, t.astype(np.int32)


def _ordered(values: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned integers of the same order."""
    bits = values.view(np.uint32)
    return bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))


def _sample_codes(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A sample (term, t) as 32 bits."""
    mixed = bits + t.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(0x85EBCA6B)


def _least(values: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Lower rows of ``out`` to the minimums of the values of their owners, which follow one another."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    mine = owner[starts]
    out[mine] = np.minimum(out[mine], np.minimum.reduceat(values, starts, axis=0))


class _Hashes(dict):
    """Word hashes, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


class TermSets:
    """Weighted terms of texts; remembers the hashes of words."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self.hashes = _Hashes()

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms (unsigned 64-bit) and weights; none for a text without words."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.float32)
        known = self.hashes
        if len(known) > CACHE_WORDS:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.shingle + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(min(self.shingle, len(words))):
            rolled = (rolled ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            rolled ^= rolled >> np.uint64(29)
        rolled |= np.uint64(1)  # shingles are odd, words even
        terms, counts = np.unique(np.concatenate([h & ~np.uint64(1), rolled]), return_counts=True)
        weights = counts.astype(np.float32)
        weights[terms & np.uint64(1) == 0] *= np.float32(WORD_WEIGHT)
        return terms, weights


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each set; zeros for an empty one."""
    sizes = np.array([len(t) for t, _ in sets], np.int64)
    if not sizes.sum():
        return np.zeros((len(sets), samples), np.uint16)
    terms, weights = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
    owner, one = np.repeat(np.arange(len(sets)), sizes), weights == 1
    # weight 1: the least bits are the least e
    plain = np.full((len(sets), samples), 0xFFFFFFFF, np.uint32)
    own, mine = terms[one], owner[one]
    for at in range(0, len(own), STEP_TERMS):
        _least(sample_bits(own[at : at + STEP_TERMS], samples), mine[at : at + STEP_TERMS], plain)
    values = _ordered(np.log(_exponential(plain))).astype(np.uint64) << np.uint64(32)
    best = values | _sample_codes(plain, np.zeros(1, np.int32))
    best[np.bincount(mine, minlength=len(sets)) == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # other weights: terms that several sets share are worked out once
    own, mine, heavy = terms[~one], owner[~one], weights[~one]
    if len(own):
        key = own ^ (heavy.view(np.uint32).astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        for at in range(0, len(first), STEP_TERMS):
            some = first[at : at + STEP_TERMS]
            bits = sample_bits(own[some], samples)
            values, t = weighted_values(bits, heavy[some])
            packed = (_ordered(values).astype(np.uint64) << np.uint64(32)) | _sample_codes(bits, t)
            rows = np.flatnonzero((back >= at) & (back < at + len(some))) if len(first) > STEP_TERMS else np.arange(len(back))
            for lo in range(0, len(rows), STEP_TERMS):
                part = rows[lo : lo + STEP_TERMS]
                _least(packed[back[part] - at], mine[part], best)
    codes = (best.astype(np.uint32) >> np.uint32(16)).astype(np.uint16)
    codes[sizes == 0] = 0
    return codes


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _hex(code: np.ndarray) -> str:
    return code.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) for every row: ``samples`` groups of 4 hex digits.

    * null and empty texts, and texts of white space, have no terms and a fingerprint of zeros.
    * fewer words than a shingle: the whole sequence is the shingle. Whole texts count.
    * equal texts have equal fingerprints; repeated rows each give a row; other columns are
      ignored, so their names can't clash. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = TermSets()
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), STEP_DOCS):
                found += map(_hex, signatures([sets.terms(t or "") for t in texts[at : at + STEP_DOCS]], samples))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above ``value``, as a balanced tree of comparisons; null: the last."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(value.isNull(), F.lit(len(bounds))).otherwise(tree(0, len(bounds)))


def with_next(docs: DataFrame, text: str, id_col: str, buckets: int) -> DataFrame:
    """(bucket, halo, id, tie, text), dealt and sorted so that the next document of a row stands behind it.

    Order: descending id, null ids last, equal ids by a hash of the text. The first rows of each
    bucket are repeated, as halo, at the end of the bucket before it; those of the first bucket
    at the end of the last. Bounds and heads of buckets are as many as ``buckets``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text")
    )
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    bounds = sorted(set(rows.select("id").agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), 10_000)).first()[0] or []), reverse=True) if shares else []
    dealt = rows.withColumn("bucket", _bucket(F.col("id"), bounds))
    heads = dealt.groupBy("bucket").agg(F.max("id").alias("head")).orderBy("bucket").collect()
    before = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}
    whole = dealt.withColumn("halo", F.lit(False))
    for chosen in ([h for h in heads if h["head"] is not None], [h for h in heads if h["head"] is None]):
        if chosen:
            is_head = F.col("id").isin([h["head"] for h in chosen]) if chosen[0]["head"] is not None else F.col("id").isNull()
            to = F.lit(None).cast("int")
            for h in chosen:
                to = F.when(F.col("bucket") == h["bucket"], before[h["bucket"]]).otherwise(to) if len(chosen) < 8 else to
            if len(chosen) >= 8:
                to = F.element_at(F.create_map(*[F.lit(x) for h in chosen for x in (h["bucket"], before[h["bucket"]])]), F.col("bucket"))
            halo = rows.filter(is_head).withColumn("bucket", _bucket(F.col("id"), bounds)).withColumn("bucket", to)
            whole = whole.unionByName(halo.withColumn("halo", F.lit(True)).select(*whole.columns))
    order = ["bucket", "halo", F.col("id").desc_nulls_last(), "tie"]
    return whole.repartitionById(buckets, F.col("bucket")).sortWithinPartitions(*order).select("bucket", "halo", "id", "text")


def edited_fingerprints(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", samples: int = SAMPLES, buckets: int | None = None
) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The next document is the next lower id; after the lowest comes the highest. The edited text
    has its last third (rounded down) replaced by as many first code points of the next one, or
    all it has. Columns: id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited, near_next. Nulls, ties, short and repeated texts as in ``fingerprints`` and
    ``with_next``; two empty texts have likeness 1. Of an only document, the next is itself.
    """
    ordered = with_next(docs, text, id_col, buckets or parts(docs.sparkSession))
    fields = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = TermSets()
        waiting: list[tuple] = []  # rows of one bucket, the last of which waits for its next one

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """All but the last row, which is the next one of the row before it."""
            texts, edited = [r[3] for r in rows], []
            for own, following in zip(texts, texts[1:], strict=False):
                cut = len(own) // 3
                edited.append(own[: len(own) - cut] + following[:cut])
            codes = signatures([sets.terms(t) for t in (*texts, *edited)], samples)
            n = len(edited)
            own, other = codes[: n + 1], codes[n + 1 :]
            return pa.RecordBatch.from_pydict(
                {
                    "id": [r[2] for r in rows[:n]], "n_chars": [len(t) for t in texts[:n]], "edited": edited,
                    "fingerprint": [_hex(c) for c in own[:n]], "edited_fingerprint": [_hex(c) for c in other],
                    "near_edited": [likeness(a, b) for a, b in zip(own[:n], other, strict=True)],
                    "near_next": [likeness(a, b) for a, b in zip(own[:n], own[1:], strict=True)],
                },
                schema=schema,
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if waiting and waiting[-1][0] == row[0] and waiting[-1][1]:
                    continue  # more rows with the id of the next bucket's first one
                if waiting and waiting[-1][0] != row[0]:
                    if len(waiting) > 1:
                        yield done(waiting)
                    waiting = []
                waiting.append(row)
                if len(waiting) > STEP_DOCS:
                    yield done(waiting)
                    waiting = waiting[-1:]
        if len(waiting) > 1:
            yield done(waiting)

    names = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, names).withColumnRenamed("id", id_col)


def op2(spark, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
