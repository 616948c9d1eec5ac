"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, turned to their principal axes and rotated so that their signs lose least
(iterative quantisation), all learned from a bounded sample. A code of 64 bits is split into
substrings, and each substring of each block of rows has an index. Two codes within Hamming
radius R have a substring within R // m (the first R % m + 1 of them) or one less (the others),
so probing those balls finds every code within R; they are measured exactly, as floats.

R is set so that the true neighbours of a bounded set of trial queries, found by brute force
over all rows, lie within it at the wanted rate. A query that finds too few is searched again
with the largest radius, which is exact. The stated queries go to the rows in passes of bounded size: each task cuts its
own rows into blocks, indexes them, and keeps a pass's best so far from block to block. Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import about, cut_lineage, map_batches, read, shared_path

BITS = 64
SUBSTRINGS = 4
#: Rows that the rotation is fitted to, and trial queries that the radius is fitted to: about so many.
FIT_ROWS = 8_192
TRIAL_ROWS = 128
#: Share of true neighbours of the trial queries within the radius.
WITHIN = 0.97
BLOCK_ROWS = 16_384
#: Components of the queries that are searched for in one pass.
PASS_VALUES = 1 << 21
ITERATIONS = 30


class Rotation:
    """Signs of rotated principal components, packed into an unsigned integer."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, substrings: int = SUBSTRINGS, seed: int = 5):
        self.mean = sample.mean(axis=0)
        bits = max(1, min(bits, sample.shape[1], 64))
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(np.vstack([centred, np.zeros((sample.shape[1], sample.shape[1]))]), full_matrices=False)
        axes = axes[:bits].T
        turned = centred @ axes
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(turned @ turn).T @ turned)
            turn = (u @ v).T
        self.axes, self.bits = axes @ turn, bits
        edges = np.linspace(0, bits, min(substrings, bits) + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def codes(self, rows: np.ndarray) -> np.ndarray:
        on = (rows - self.mean) @ self.axes > 0
        return np.bitwise_or.reduce(on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64), axis=1)

    def substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        return [(codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in self.spans]


class SubstringIndex:
    """The rows that hold each value of one substring, in a block."""

    def __init__(self, values: np.ndarray, width: int):
        self.order = np.argsort(values, kind="stable")
        self.values, self.starts = np.unique(values[self.order], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))
        self.width = width

    def probe(self, value: np.uint64, reach: int) -> np.ndarray:
        """Rows whose substring differs from ``value`` in at most ``reach`` bits."""
        if reach < 0:
            return self.order[:0]
        masks = _masks(self.width, reach, len(self.values))
        if masks is None:
            at = np.flatnonzero(np.bitwise_count(self.values ^ value) <= reach)
        else:
            wanted = masks ^ value
            at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            at = at[self.values[at] == wanted]
        return np.concatenate([self.order[s:e] for s, e in zip(self.starts[at], self.ends[at], strict=True)] or [self.order[:0]])


def _masks(width: int, reach: int, most: int) -> np.ndarray | None:
    """All patterns of at most ``reach`` bits, or None if there are more than ``most``."""
    count, term = 1, 1
    for i in range(1, min(reach, width) + 1):
        term = term * (width - i + 1) // i
        count += term
        if count > most:
            return None
    bits = [np.uint64(1) << np.uint64(i) for i in range(width)]
    return np.array([sum(c, np.uint64(0)) for i in range(min(reach, width) + 1) for c in combinations(bits, i)], np.uint64)


def within_radius(rotation: Rotation, indexes: list[SubstringIndex], codes: np.ndarray, query: np.uint64, radius: int) -> np.ndarray:
    """Every row of the block whose code is within ``radius`` of the query's."""
    m = len(indexes)
    each, rest = divmod(radius, m)
    own = [s[0] for s in rotation.substrings(np.array([query], np.uint64))]
    found = [index.probe(value, each if i <= rest else each - 1) for i, (index, value) in enumerate(zip(indexes, own, strict=True))]
    rows = np.unique(np.concatenate(found))
    return rows[np.bitwise_count(codes[rows] ^ query) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(row, id, vector) of rows that take part: an id and finite components, not all zero. ``row`` tells repeated rows apart once the lineage is cut."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "id", "vector")


def sampled(rows: DataFrame, wanted: int, total: int, salt: int) -> list:
    """About ``wanted`` rows, by a hash of all that a row holds; twice as many at most, however often rows repeat."""
    return rows.filter(about(wanted / total, salt, "row", "id", "vector")).limit(2 * wanted).collect() or rows.limit(wanted).collect()


def fit_radius(rows: DataFrame, rotation: Rotation, trials: np.ndarray, trial_ids: np.ndarray, k: int, within: float) -> int:
    """The Hamming radius that holds the wanted share of the trial queries' true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rotation.codes(trials)
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            own = rotation.codes(vectors)
            out: list[tuple] = []
            for i, (query, name) in enumerate(zip(trials, trial_ids, strict=True)):
                far = np.where(numbers == name, np.inf, np.sum((vectors - query) ** 2, axis=1))
                best = np.argsort(far, kind="stable")[:k]
                best = best[np.isfinite(far[best])]
                out += zip([i] * len(best), far[best].tolist(), np.bitwise_count(own[best] ^ codes[i]).tolist(), strict=True)
            yield pa.RecordBatch.from_pydict({"trial": [o[0] for o in out], "far": [o[1] for o in out], "bits": [o[2] for o in out]}, schema=pa.schema([("trial", pa.int32()), ("far", pa.float64()), ("bits", pa.int32())]))

    best = map_batches(rows.select("row", "vector"), run, "trial int, far double, bits int")
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy("far", "bits"))).filter(F.col("n") <= k)
    counts = {r["bits"]: r["count"] for r in ranked.groupBy("bits").count().collect()}
    seen, total = 0, sum(counts.values())
    for bits in sorted(counts):
        seen += counts[bits]
        if seen >= within * total:
            return bits
    return rotation.bits


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows in blocks of about ``BLOCK_ROWS``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _passes(queries: DataFrame) -> Iterator[list]:
    """Queries in lists of bounded size; the driver holds one partition and one list at a time."""
    some, size = [], 0
    for row in queries.toLocalIterator():
        some.append(row)
        size += len(row["vector"])
        if size >= PASS_VALUES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _sweep(rows: DataFrame, queries: DataFrame, rotation: Rotation, radius: int, k: int) -> DataFrame:
    """(query, rank, vec_id, score): the best k of each query over the blocks of all tasks."""
    spark, names = rows.sparkSession, "query long, query_id long, rank int, vec_id long, score double"
    path, done = shared_path(spark, "nearest"), False
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    for some in _passes(queries):
        wanted, numbers, ids = np.array([r["vector"] for r in some]), np.array([r["row"] for r in some]), np.array([r["id"] for r in some])

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted, numbers=numbers, ids=ids) -> Iterator[pa.RecordBatch]:
            codes = rotation.codes(wanted)
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in wanted]
            for block in _blocks(batches):
                own_numbers, own_ids, vectors = block.column(0).to_numpy(), block.column(1).to_numpy(), _matrix(block.column(2))
                own = rotation.codes(vectors)
                indexes = [SubstringIndex(s, b - a) for s, (a, b) in zip(rotation.substrings(own), rotation.spans, strict=True)]
                for i, (query, number, code) in enumerate(zip(wanted, numbers, codes, strict=True)):
                    near = within_radius(rotation, indexes, own, code, radius)
                    near = near[own_numbers[near] != number]
                    found = np.concatenate([best[i][0], own_ids[near]])
                    far = np.concatenate([best[i][1], np.sqrt(np.sum((vectors[near] - query) ** 2, axis=1))])
                    order = np.lexsort((found, far))[:k]
                    best[i] = found[order], far[order]
            sizes = [len(found) for found, _ in best]
            columns = np.repeat(numbers, sizes), np.repeat(ids, sizes), *(np.concatenate(c) for c in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        found = map_batches(rows.select("row", "id", "vector"), run, "query long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*[n.split(" ")[0] for n in names.split(", ")]).write.mode("append").parquet(path)
        done = True
    return spark.read.schema(names).parquet(path) if done else spark.createDataFrame([], names)


def nearest(
    df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
    within: float = WITHIN, radius: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first.

    * queries: all rows whose id is divisible by ``every``, so a repeated id is several queries; candidates: all rows but the query itself.
    * score: Euclidean distance of the original vectors in double precision; ties to smaller ids.
    * rows without an id, and vectors that are null, zero or hold null or non-finite components take no part. Vectors of
      different dimensions have no distance: each dimension is searched by itself. Equal vectors are candidates each, and repeated rows too.
    * fewer candidates than ``k``: all of them. An empty table gives no rows.
    * ``radius``: fixed instead of fitted. Other columns are ignored.
    """
    rows = cut_lineage(usable(df, id_col, vector))
    # a row a dimension
    sizes = sorted((r["n"], r["count"]) for r in rows.groupBy(F.size("vector").alias("n")).count().collect())
    found = [_search(rows.filter(F.size("vector") == n) if len(sizes) > 1 else rows, total, every, k, within, radius) for n, total in sizes]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, total: int, every: int, k: int, within: float, radius: int | None) -> DataFrame:
    """The search over ``total`` rows of one dimension."""
    rotation = Rotation(np.array([r["vector"] for r in sampled(rows, FIT_ROWS, total, 1)]))
    if radius is None:
        trials = sampled(rows, TRIAL_ROWS, total, 2)
        radius = fit_radius(rows, rotation, np.array([t["vector"] for t in trials]), np.array([t["row"] for t in trials]), k, within)
    queries = rows.filter(F.col("id") % every == 0)
    found = _sweep(rows, queries, rotation, radius, k)
    full = found.groupBy("query").count().filter(F.col("count") >= k).select(F.col("query").alias("row"))
    short = cut_lineage(queries.join(full, "row", "left_anti"))
    if radius < rotation.bits and short.limit(1).count():
        exact = _sweep(rows, short, rotation, rotation.bits, k)
        found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
