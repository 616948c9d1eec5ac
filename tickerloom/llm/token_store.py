"""Token ids of a corpus in files of directly addressable codes.

Documents are range-partitioned by id, so the files follow ascending ids; a partition becomes
shards of about ``SHARD_TOKENS`` ids, cut between documents. A store is a Parquet folder with a
row a shard: (part, shard, n_tokens, doc_ids, n_ids, code). Spark's writer commits it, so a lost
executor leaves no half-written shard. The place of a shard in the whole sequence is a prefix
sum over parts and then over the shards of a part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import dac
from tickerloom.llm.common import parts, read, shared_path
from tickerloom.llm.pretokens import Numbers, chunk_keys, chunk_text, ragged, windows

END_ID = 2
SHARD_TOKENS = 1 << 22
#: Ids that are read from a code at a time.
READ_IDS = 1 << 18
#: Chunks that a worker remembers; then it starts anew.
CACHE_CHUNKS = 1_200_000
#: Code points that are encoded at a time.
STEP_CHARS = 1 << 20
#: New chunks that are given to the library as one text.
JOINED = 64
SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, n_ids array<long>, code binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes texts with the tokenizers library; each different chunk once while it is remembered.

    New chunks go to the library joined, as they stand in texts: borders between them are borders of the
    pre-tokenizer too, and in a byte-level vocabulary they are where a token starts with a space.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.greedy = any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each by itself, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _joined_ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that hold no space but the one before them."""
        groups = [keys[at : at + JOINED] for at in range(0, len(keys), JOINED)]
        ids, _ = self._ids([" " + " ".join(g) for g in groups])
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(keys):  # not a byte-level vocabulary
            return self._ids([" " + k for k in keys])
        return ids, np.diff(np.append(starts, len(ids)))

    def _learn(self) -> None:
        keys, self.number.new = self.number.new, []
        first = len(self.number) - len(keys)
        while len(self.number) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        simple = np.fromiter((type(k) is str and " " not in k for k in keys), bool, len(keys))
        for places, find in ((np.flatnonzero(simple), self._joined_ids), (np.flatnonzero(~simple), lambda some: self._ids(list(map(chunk_text, some))))):
            for at in range(0, len(places), 4096):
                some = places[at : at + 4096]
                ids, sizes = find([keys[i] for i in some])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
                self.flat[self.used : self.used + len(ids)] = ids
                self.starts[first + some] = self.used + np.cumsum(sizes) - sizes
                self.lengths[first + some] = sizes
                self.used += len(ids)

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text of any length that may hold added tokens, like <|endoftext|>; texts end before and start after each."""
        if self.greedy and self.cut.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [], 0
        for found in self.cut.finditer(text) if self.added else ():
            out += [self._windows(text[at : found.start()]), np.array([self.added[found.group()]], np.uint32)]
            at = found.end()
        return np.concatenate([*out, self._windows(text[at:])])

    def _windows(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode([w])[0] for w in windows(text, STEP_CHARS)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.number) > self.cache:
            self._forget()
        keys = [chunk_keys(t) for t in texts]
        every = list(chain.from_iterable(keys))
        index = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        if self.number.new:
            self._learn()
        lengths = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))])
        return ragged(self.flat, self.starts[index], lengths), np.diff(ends[borders])


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """A worker process keeps its encoder from task to task."""
    return ChunkEncoder(path)


def _encoded(texts: list[str], encoder: ChunkEncoder) -> Iterator[np.ndarray]:
    """The ids of each text, several texts at a time."""
    added = list(encoder.added)

    def alone(text: str) -> bool:
        return len(text) > STEP_CHARS or any(token in text for token in added)

    at = 0
    while at < len(texts):
        if alone(texts[at]):
            yield encoder.encode_long(texts[at])
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= STEP_CHARS and not alone(texts[to]):
            size += len(texts[to])
            to += 1
        ids, counts = encoder.encode(texts[at:to])
        yield from np.split(ids, np.cumsum(counts)[:-1])
        at = to


def write_store(
    docs: DataFrame,
    path: str,
    text: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every text of ``docs``, append ``end_id`` to each, and write a store at ``path``.

    * null and empty texts hold the end id only. Whole texts are encoded, in windows if long;
      a document longer than a shard is a shard of its own.
    * added tokens of the tokenizer that stand in a text, like <|endoftext|>, get their ids, as by the library's default.
    * null ids come first, equal ids in the order of a hash of their texts; repeated rows are
      repeated documents. An empty table writes an empty store.
    * other columns are ignored, so their names can't clash. Ids must be integers.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, end = _encoder(tokenizer), TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        names, found, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, names, found, total
            row = {
                "part": [part], "shard": [shard], "n_tokens": [total], "doc_ids": [names],
                "n_ids": [[len(x) + 1 for x in found]], "code": [dac.encode(np.concatenate([x for ids in found for x in (ids, end)]))],
            }
            shard, names, found, total = shard + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), _encoded(batch.column(1).to_pylist(), encoder), strict=True):
                if found and total + len(ids) + 1 > shard_tokens:
                    yield flush()
                names.append(name)
                found.append(ids)
                total += len(ids) + 1
        if found:
            yield flush()

    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("code", pa.binary())]
    )
    dealt.mapInArrow(run, SCHEMA).write.mode("errorifexists").parquet(path)


def shard_starts(spark, path: str) -> DataFrame:
    """(part, shard, shard_start, n_tokens): how many ids stand before each shard."""
    shards = spark.read.schema(SCHEMA).parquet(path).select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part: as many as shuffle partitions
    by_part = (
        shards.groupBy("part")
        .agg(F.sum("n_tokens").alias("__n"))
        .select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(by_part, "part").select(
        "part", "shard", (F.col("__before") + F.col("__inside")).alias("shard_start"), "n_tokens"
    )


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document of a store, from its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, names, counts, code = (batch.column(k)[row] for k in ("part", "shard", "doc_ids", "n_ids", "code"))
                counts = counts.values.to_numpy()
                ends = np.cumsum(counts)
                reader = dac.Reader(code.as_py())
                sums, held, ids = [], 0, np.empty(0, "<u4")
                for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
                    if e > held:  # the next documents of about a megabyte of ids together
                        start = e - n
                        held = max(e, int(ends[min(np.searchsorted(ends, start + READ_IDS), len(ends) - 1)]))
                        ids = reader.slice(start, held).astype("<u4")
                    sums.append(zlib.crc32(ids[e - n - start : e - start].data))
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, shard.as_py(), np.int32)),
                        names.values, pa.array(ends - counts), pa.array(counts), pa.array(np.array(sums, np.int64)),
                    ],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = spark.read.schema(SCHEMA).parquet(path).mapInArrow(
        run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    starts = shard_starts(spark, path).select("part", "shard", "shard_start")
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_at(spark, path: str, positions: list[int]) -> DataFrame:
    """(position, token) for a stated list of positions in the whole sequence; others are not decoded.

    Positions outside the store give no row; repeated ones give one.
    """
    wanted = np.unique(np.array(positions, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, code in zip(*(batch.column(k) for k in ("shard_start", "n_tokens", "code")), strict=True):
                lo, hi = np.searchsorted(wanted, [start.as_py(), start.as_py() + n.as_py()])
                if lo < hi:
                    ids = dac.Reader(code.as_py()).take(wanted[lo:hi] - start.as_py())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(wanted[lo:hi]), pa.array(ids.astype(np.int64))], names=["position", "token"]
                    )

    codes = spark.read.schema(SCHEMA).parquet(path).select("part", "shard", "code")
    if not len(wanted):
        return spark.createDataFrame([], "position long, token long")
    held = F.exists(
        F.array(*[F.lit(int(p)) for p in wanted]),
        lambda p: (p >= F.col("shard_start")) & (p < F.col("shard_start") + F.col("n_tokens")),
    )
    # at most a shard for each stated position
    return codes.join(F.broadcast(shard_starts(spark, path).filter(held)), ["part", "shard"]).mapInArrow(run, "position long, token long")


def op1(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_store(read(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
