"""BPE by rounds of merges over many words at once.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by binary search
among the sorted keys of the vocabulary's pairs, finds the lowest rank in each word, and merges every place
of it, from the left. Words without a pair of the vocabulary leave the array; the rest go on. Texts are cut by the
tokenizer's own pre-tokenizer; each different chunk of a text, and each different word in it, is encoded once
while a worker remembers it. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import map_batches, read
from tickerloom.llm.pretokens import Numbers, ragged
from tickerloom.llm.token_store import ChunkEncoder, _encoded, default_tokenizer

#: Words that a worker remembers; then it starts anew.
CACHE_WORDS = 1_000_000
#: Symbols that are merged together; a longer word is merged by itself.
ROUND_SYMBOLS = 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: pairs of ids as sorted keys, with their ranks and the ids that they give."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.bytes = np.array([vocabulary[c] for c in byte_characters()], np.int64)
        self.base = max(vocabulary.values()) + 1
        rank = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}  # of equal pairs the last one counts
        gives = {(vocabulary[a], vocabulary[b]): vocabulary[a + b] for a, b in merges}
        pairs = np.array(list(rank), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(rank.values(), np.int64, len(rank))[order], 0)
        self.results = np.append(np.fromiter(gives.values(), np.int64, len(gives))[order], 0)
        self.none = len(merges)
        # where a pair can outrank the merge that made one of its symbols, only the first place of a pair is safe in a round
        made = np.full(self.base, -1, np.int64)
        np.maximum.at(made, self.results[:-1], self.ranks[:-1])
        self.rising = bool((self.ranks[:-1] > made[pairs[order]].max(axis=1, initial=-1)).all())

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words given as ids of bytes, one after another, and how many each has (1 at least)."""
        done, word, out_word = [], np.repeat(np.arange(len(sizes)), sizes), []
        while len(symbols):
            borders = np.flatnonzero(word[1:] != word[:-1])
            key = symbols[:-1] * self.base + symbols[1:]
            key[borders] = -1
            place = np.searchsorted(self.keys, key)
            rank = np.append(np.where(self.keys[place] == key, self.ranks[place], self.none), self.none)
            starts = np.concatenate([[0], borders + 1])
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbols)))
            open_ = np.repeat(least < self.none, length)
            done.append(symbols[~open_])
            out_word.append(word[~open_])
            hit = (rank == np.repeat(least, length)) & open_
            at = np.flatnonzero(hit)
            if not len(at):
                break
            if self.rising:  # of places that overlap, as in a run of equal symbols, every second
                first = np.concatenate([[True], np.diff(at) != 1])
                run = np.flatnonzero(first)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            else:
                at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbols = symbols.copy()
            symbols[at] = self.results[place[at]]
            open_[at + 1] = False
            symbols, word = symbols[open_], word[open_]
        if not done:
            return symbols, sizes
        words, ids = np.concatenate(out_word), np.concatenate(done)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(sizes))


class MergeEncoder(ChunkEncoder):
    """The ids of the tokenizers library, from its vocabulary and pre-tokenizer, merged in rounds.

    Vocabularies other than plain byte-level BPE are an error: with a normalizer, dropout, an unknown token, affixes of
    words, a space before texts, or added tokens that take spaces.
    """

    def __init__(self, path: str, **options):
        super().__init__(path, **options)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        if any(odd) or whole["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or self.greedy:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._forget_words()
        self.names = {i: c.encode() for c, i in self.added.items()}
        value = {c: b for b, c in enumerate(byte_characters())}
        self.names |= {i: bytes(value[c] for c in token) for token, i in model["vocab"].items() if i not in self.names and all(c in value for c in token)}

    def _forget_words(self) -> None:
        self.words = Numbers()
        self.word_ids = np.empty(0, np.uint32)
        self.word_sizes = np.empty(0, np.int64)

    def _learn_words(self) -> None:
        """Merges the words that are new since the last call."""
        new, self.words.new = self.words.new, []
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) <= ROUND_SYMBOLS):
                size += len(new[to])
                to += 1
            some = new[at:to]
            ids, sizes = self.merges.apply(self.merges.bytes[np.frombuffer(b"".join(some), np.uint8)], np.fromiter(map(len, some), np.int64, len(some)))
            self.word_ids = np.concatenate([self.word_ids, ids.astype(np.uint32)])
            self.word_sizes = np.concatenate([self.word_sizes, sizes])
            at = to

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each by itself, and how many each has."""
        if len(self.words) > CACHE_WORDS:
            self._forget_words()
        every, counts = [], []
        for text in texts:
            spans = [s for _, s in self.split(text)]
            every += [self.words[text[a:b].encode()] for a, b in spans]
            counts.append(len(spans))
        if self.words.new:
            self._learn_words()
        index, counts = np.array(every, np.int64), np.array(counts, np.int64)
        lengths = self.word_sizes[index]
        starts = (np.cumsum(self.word_sizes) - self.word_sizes)[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.concatenate([[0], np.cumsum(counts)])
        return ragged(self.word_ids, starts, lengths), np.diff(ends[borders])


class IdBytes:
    """The bytes of each id, gathered by value; ids that the vocabulary doesn't have stand for nothing, as in the library."""

    def __init__(self, names: dict[int, bytes]):
        pieces = [names.get(i, b"") for i in range(max(names, default=-1) + 2)]
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; what isn't UTF-8 is replaced."""
        own = np.minimum(ids, len(self.lengths) - 1).astype(np.int64)
        found = ragged(self.flat, self.starts[own], self.lengths[own]).tobytes()
        return found.decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def _encoder(path: str) -> MergeEncoder:
    """A worker process keeps its encoder from task to task."""
    return MergeEncoder(path)


@lru_cache(maxsize=1)
def _id_bytes(path: str) -> IdBytes:
    return IdBytes(_encoder(path).names)


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    finish: tuple[Callable[[list[np.ndarray]], list[pa.Array]], pa.Schema, str] | None = None,
) -> DataFrame:
    """(id, n_tokens, ids) for every row: ids are little-endian unsigned 32-bit integers in a binary.

    * the ids are those of the tokenizers library without special tokens at the ends; added tokens that stand in a text get their ids.
    * null and empty texts have no ids. Whole texts are encoded, in windows if long.
    * repeated rows each give a row; null ids stay null. Other columns are ignored, so their names can't clash. An empty table gives no rows.
    * ``finish`` is a function of some texts' ids, with the Arrow and Spark schemas of the columns that it returns instead of ids.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    make, extra, fields = finish or (_as_binary, pa.schema([("ids", pa.binary())]), "ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            found = list(_encoded(batch.column(1).to_pylist(), encoder))
            counts = pa.array(np.fromiter(map(len, found), np.int64, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *make(found)], names=["id", "n_tokens", *extra.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n_tokens long, {fields}").withColumnRenamed("id", id_col)


def _as_binary(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([ids.astype("<u4").tobytes() for ids in found], pa.binary())]


def decode_documents(encoded: DataFrame, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``encoded`` and the text that its ids stand for, in ``decoded``, added tokens included.

    Ids that the vocabulary doesn't have are left out, bytes that aren't UTF-8 are replaced, null ids decode to null. A column
    ``decoded`` that was there before is replaced.
    """
    tokenizer = tokenizer or default_tokenizer()
    kept = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(tokenizer)
        for batch in batches:
            out = [table.text(np.frombuffer(x.as_buffer(), "<u4")).decode() if x.is_valid else None for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return map_batches(kept, run, ", ".join([*fields, "decoded string"]))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids are decoded in the task that found them."""
    path = tokenizer or default_tokenizer()

    def make(found: list[np.ndarray]) -> list[pa.Array]:
        table = _id_bytes(path)
        of_ids = [hashlib.sha256(ids.astype("<u4").data).hexdigest() for ids in found]
        of_texts = [hashlib.sha256(table.text(ids)).hexdigest() for ids in found]
        return [pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    schema = pa.schema([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return encode_documents(docs, tokenizer=path, finish=(make, schema, "ids_sha256 string, decoded_sha256 string"))


def op11(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
