"""Byte-level BPE through one shuffle of distinct words.

Exploding every pre-token of a corpus and joining the ids back would shuffle a row for each of
them. Here a block of documents is cut into pre-tokens and keeps them as numbers into its own
list of distinct words, in order of position. Only the distinct words of a block are dealt,
packed by hash bucket; in its bucket each distinct word of the corpus is encoded once, however
many blocks hold it, and the ids go back to the blocks. A block then puts the ids of its words
at their positions. A very frequent word is one entry a block.

Texts are cut once and never shuffled: one pass deals words and positions in one exchange, from which
the encoding of words and the reassembly of blocks both read. If that exchange has to be computed again, after an
executor is lost, say, a checksum of the words proves that both saw the same block.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import give_back, map_batches, parts, read
from tickerloom.llm.pretokens import WINDOW, Numbers, chunk_keys, chunk_text, ragged, windows

#: Code points of a block; a longer document is a block of its own.
BLOCK_CHARS = 1 << 23
#: Chunks that a worker remembers in a block, and words in a bucket; then it starts anew.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 2_000_000
#: Code points that are cut at a time.
STEP_CHARS = 1 << 20
#: Word numbers of documents in a row of positions.
PIECE_WORDS = 1_000_000
#: Output bytes in a batch.
BATCH_BYTES = 1 << 23


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: two fields a line, the first in base 64."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(spark, path: str) -> DataFrame:
    """The token-byte table (token, bytes): as many rows as the vocabulary."""
    return spark.createDataFrame(((r, bytearray(b)) for b, r in load_ranks(path).items()), "token long, bytes binary")


class WordNumbers:
    """Numbers the pre-tokens of one block's texts in order of appearance."""

    def __init__(self, pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        self.number: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.chunks = Numbers()
        self.flat = np.empty(0, np.uint32)
        self.lengths = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Cuts the chunks that are new since the last call into words."""
        keys, self.chunks.new = self.chunks.new, []
        number, cut, found, sizes = self.number, self.cut, [], []
        for key in keys:
            words = cut(chunk_text(key))
            sizes.append(len(words))
            found += [number.setdefault(w, len(number)) for w in words]
        self.flat = np.concatenate([self.flat, np.array(found, np.uint32)])
        self.lengths = np.concatenate([self.lengths, np.array(sizes, np.int64)])

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of some texts, one after another, and how many each has."""
        if len(self.chunks) > CACHE_CHUNKS:
            self._forget()
        keys = [chunk_keys(t) for t in texts]
        every = list(chain.from_iterable(keys))
        index = np.fromiter(map(self.chunks.__getitem__, every), np.int64, len(every))
        if self.chunks.new:
            self._learn()
        starts, lengths = (np.cumsum(self.lengths) - self.lengths)[index], self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))])
        return ragged(self.flat, starts, lengths), np.diff(ends[borders])


@lru_cache(maxsize=1)
def _encoding(ranks: str, pattern: str):
    """A worker process keeps its encoding from task to task."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _joined(words: list[bytes]) -> bytes:
    return b"".join(words)


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[str, list, list[str]]]:
    """(block, ids, texts), the same whenever the same partition is read."""
    part, at, names, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(text) > chars:
                yield f"{part}.{at}", names, texts
                at, names, texts, size = at + 1, [], [], 0
            names.append(name)
            texts.append(text)
            size += len(text)
    if texts:
        yield f"{part}.{at}", names, texts


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    ranks: str | None = None,
    pattern: str | None = None,
    block_chars: int = BLOCK_CHARS,
    buckets: int | None = None,
    finish: tuple[Callable[[pa.Table], pa.Table], str] | None = None,
) -> DataFrame:
    """(id, n_tokens, ids) for every row: ids are little-endian unsigned 32-bit integers in a binary.

    * each match of ``pattern`` is encoded by itself, by the ranks of the vocabulary; no special tokens.
    * null and empty texts have no ids. Whole texts are encoded, whatever their length.
    * repeated rows each give a row; other columns are ignored, so their names can't clash. An
      empty table gives no rows.
    * ``docs`` must give the same rows in the same partitions when it is read again, as files do;
      if it can't, cut its lineage first. Otherwise the job fails rather than mix up words.
    * ``finish`` is a function of the tables (id, n_tokens, ids) that tasks make, and the fields besides
      id of what it returns; then those come instead, and ids needn't leave the worker that has them.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    buckets = buckets or parts(docs.sparkSession, 4)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word numbers of each block's documents by position, in pieces, and its distinct words, packed by bucket."""

        def row(key: str, words: bytes | None, names: list | None, numbers: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            values = [key], [block], [check], [_pack(numbers)], [_pack(sizes)], [words], [names]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, mixed, strict=True)], schema=mixed)

        for block, names, texts in _blocks(batches, block_chars):
            seen, pieces, piece, size, first, at = WordNumbers(pattern), [], [], 0, 0, 0
            while at < len(texts):
                to, length = at, 0
                while to < len(texts) and (to == at or length + len(texts[to]) <= STEP_CHARS):
                    length += len(texts[to])
                    to += 1
                if length <= WINDOW:
                    numbers, counts = seen.numbers(texts[at:to])
                else:
                    numbers = np.concatenate([seen.numbers([w])[0] for w in windows(texts[at])])
                    counts = np.array([len(numbers)])
                piece.append((numbers, counts))
                size, at = size + len(numbers), to
                if size > PIECE_WORDS or at == len(texts):
                    pieces.append((names[first:at], np.concatenate([n for n, _ in piece]), np.concatenate([c for _, c in piece])))
                    piece, size, first = [], 0, at
            every = [w.encode() for w in seen.number]
            check = zlib.crc32(_joined(every))
            for own, numbers, counts in pieces:
                yield row(block, None, own, numbers, counts)
            home = np.fromiter((zlib.crc32(w) % buckets for w in every), np.int64, len(every))
            order = np.argsort(home, kind="stable")
            borders = np.searchsorted(home[order], np.arange(buckets + 1))
            for bucket in range(buckets):
                own = order[borders[bucket] : borders[bucket + 1]]
                if len(own):
                    pack = [every[i] for i in own]
                    sizes = np.fromiter(map(len, pack), np.uint32, len(pack))
                    yield row(f"bucket {bucket}", zstandard.ZstdCompressor(level=3).compress(_joined(pack)), None, own, sizes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a bucket is encoded once."""
        encoding = _encoding(ranks, pattern)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for block, check, numbers, sizes, data in zip(*(batch.column(k).to_pylist() for k in ("block", "check", "numbers", "sizes", "words")), strict=True):
                blob = zstandard.ZstdDecompressor().decompress(data)
                ends = np.cumsum(_unpack(sizes).astype(np.int64)).tolist()
                found, start = [], 0
                if len(known) > CACHE_WORDS:
                    known.clear()
                for end in ends:
                    word = blob[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoding.encode_ordinary(word.decode())
                    found.append(ids)
                    start = end
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "check": [check], "numbers": [numbers], "counts": [_pack(counts)], "ids": [_pack(flat)]},
                    schema=pa.schema([("block", pa.string()), ("check", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())]),
                )

    def assemble(placed: pa.Table, packs: pa.Table) -> pa.Table:
        """The ids of a block's documents."""
        checks = {*placed.column("check").to_pylist(), *packs.column("check").to_pylist()}
        if len(checks) > 1:
            raise ValueError("the documents changed between two reads; cut the lineage of the input")
        every = [_unpack(x) for x in packs.column("numbers").to_pylist()]
        total = sum(map(len, every))
        starts, lengths = np.zeros(total, np.int64), np.zeros(total, np.int64)
        flats, used = [np.empty(0, np.uint32)], 0
        for numbers, counts, ids in zip(every, packs.column("counts").to_pylist(), packs.column("ids").to_pylist(), strict=True):
            counts = _unpack(counts).astype(np.int64)
            starts[numbers], lengths[numbers] = used + np.cumsum(counts) - counts, counts
            flats.append(_unpack(ids))
            used += len(flats[-1])
        flat = np.concatenate(flats)
        out = []
        for names, counts, numbers in zip(placed.column("names"), placed.column("sizes").to_pylist(), placed.column("numbers").to_pylist(), strict=True):
            index = _unpack(numbers)
            n = lengths[index]
            ids = ragged(flat, starts[index], n).astype("<u4")
            borders = np.concatenate([[0], np.cumsum(_unpack(counts).astype(np.int64))])
            ends = np.concatenate([[0], np.cumsum(n)])[borders]
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype("<i8")), pa.py_buffer(ids)])
            table = pa.Table.from_arrays([names.values, pa.array(np.diff(ends)), data.cast(pa.binary())], names=["id", "n_tokens", "ids"])
            out.append(finish[0](table) if finish else table)
        if not out:
            return finish[0](empty.empty_table()) if finish else empty.empty_table()
        whole = pa.concat_tables(out)
        give_back()
        return whole

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    empty = pa.schema([("id", id_type), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    simple = kind.simpleString()
    mixed = pa.schema(
        [("key", pa.string()), ("block", pa.string()), ("check", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("names", pa.list_(id_type))]
    )
    dealt = map_batches(
        rows, cut, f"key string, block string, check long, numbers binary, sizes binary, words binary, names array<{simple}>"
    ).repartition(buckets, "key")
    # a condition that isn't deterministic stays above the exchange, so that both sides read the same one
    here = F.spark_partition_id() >= 0
    packs = map_batches(
        dealt.filter(F.col("words").isNotNull() == here), encode, "block string, check long, numbers binary, counts binary, ids binary"
    )
    placed = dealt.filter(F.col("words").isNull() == here)
    fields = finish[1] if finish else "n_tokens long, ids binary"
    found = placed.groupBy("key").cogroup(packs.groupBy("block")).applyInArrow(assemble, f"id {simple}, {fields}")
    return found.withColumnRenamed("id", id_col)


class Decoder:
    """The token-byte table in a task: ids are joined to it by their value."""

    def __init__(self, table: DataFrame):
        pairs = table.select("token", "bytes").collect()
        self.size = max((p["token"] for p in pairs), default=-1) + 1
        pieces = [b""] * self.size
        self.missing = np.ones(self.size, bool)
        for p in pairs:
            pieces[p["token"]] = bytes(p["bytes"])
            self.missing[p["token"]] = False
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = b"".join(pieces)

    def decode(self, ids: pa.Scalar) -> bytes | None:
        """The bytes that little-endian unsigned 32-bit ids stand for; null ids give null."""
        if not ids.is_valid:
            return None
        own = np.frombuffer(ids.as_buffer(), "<u4")
        if len(own) and (int(own.max()) >= self.size or self.missing[own].any()):
            raise ValueError("an id isn't in the token-byte table")
        return ragged(np.frombuffer(self.flat, np.uint8), self.starts[own], self.lengths[own]).tobytes()


def decode_documents(encoded: DataFrame, table: DataFrame, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``encoded`` (with ids as little-endian unsigned 32-bit integers) and the bytes that they stand for, in ``decoded``.

    The token-byte table has a row a token, so its size is bounded by the vocabulary; each task
    joins it to the ids by their value. An id outside the table is an error; null ids decode to null.
    """
    decoder = Decoder(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decoder.decode(value) for value in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded"]
    kept = encoded.select(*[f.name for f in encoded.schema.fields if f.name != "decoded"])
    return map_batches(kept, run, ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: ids are decoded where they are put together."""
    decoder = Decoder(token_bytes(docs.sparkSession, default_ranks()))

    def finish(table: pa.Table) -> pa.Table:
        ids = table.column("ids")
        of_ids = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in ids], pa.string())
        of_texts = pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string())
        return pa.Table.from_arrays([*table.select(["id", "n_tokens"]).columns, of_ids, of_texts], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(docs, finish=(finish, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
