"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A change inserts a document's count, deletes it, or revises it; changes of a batch are summed by
key before they are written. A batch is written to a folder of its own, and it is committed by the next version of a log,
a small file that one renaming puts in place and that never replaces another: of two writers of a batch one is committed, and the other's
folder is never read; a batch that broke off before its commit is simply tried again. Totals are the
sum over the newest snapshot and the batches since; ``fold`` makes a new snapshot, so that
what is listed and read stays small however many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bpe import default_pattern, load_ranks
from tickerloom.llm.common import cut_lineage, map_batches, read, shared_path
from tickerloom.llm.pretokens import WINDOW, Numbers, chunk_keys, chunk_text, windows
from tickerloom.sources.versions import VersionLog

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Chunks whose counts a worker remembers; then it starts anew.
CACHE_CHUNKS = 1_000_000
STEP_CHARS = 1 << 20


def default_versions() -> dict[str, str]:
    """Versions of the query and their vocabulary files."""
    import public_tokenizers

    return {"byte-50k-1": public_tokenizers.path("byte_bpe_50k.tiktoken"), "multi-50k-1": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}


class TokenCounter:
    """Counts the tokens of texts under several vocabularies; each different chunk is encoded once while it is remembered."""

    def __init__(self, paths: tuple[str, ...], pattern: str):
        import tiktoken

        self.encodings = [tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(p), special_tokens={}) for p in paths]
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.counts = np.empty((0, len(self.encodings)), np.int64)

    def _count(self, pieces: list[str]) -> np.ndarray:
        keys = [chunk_keys(p) for p in pieces]
        every = list(chain.from_iterable(keys))
        index = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        if self.number.new:
            new, self.number.new = list(map(chunk_text, self.number.new)), []
            found = [np.fromiter((len(e.encode_ordinary(c)) for c in new), np.int64, len(new)) for e in self.encodings]
            self.counts = np.concatenate([self.counts, np.stack(found, axis=1)])
        ends = np.concatenate([np.zeros((1, len(self.encodings)), np.int64), np.cumsum(self.counts[index], axis=0)])
        borders = np.concatenate([[0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))])
        return np.diff(ends[borders], axis=0)

    def counts_of(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each vocabulary. Whole texts count, long ones in windows."""
        out, at = [np.empty((0, len(self.encodings)), np.int64)], 0
        while at < len(texts):
            if len(self.number) > CACHE_CHUNKS:
                self._forget()
            if len(texts[at]) > WINDOW:
                out.append(sum(self._count([w]) for w in windows(texts[at])))
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and len(texts[to]) <= WINDOW and (to == at or size + len(texts[to]) <= STEP_CHARS):
                size += len(texts[to])
                to += 1
            out.append(self._count(texts[at:to]))
            at = to
        return np.concatenate(out)


@lru_cache(maxsize=1)
def _counter(paths: tuple[str, ...], pattern: str) -> TokenCounter:
    """A worker process keeps its counter from task to task."""
    return TokenCounter(paths, pattern)


def token_counts(docs: DataFrame, versions: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text: str = "text") -> DataFrame:
    """The columns ``keep`` and, for each version in order, its number of tokens n0, n1, ...; null and empty texts have none."""
    paths, pattern = tuple((versions or default_versions()).values()), default_pattern()
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(paths, pattern)
        for batch in batches:
            found = counter.counts_of(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in found.T.copy())], names=[*keep, *(f"n{i}" for i in range(len(paths)))])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return map_batches(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"n{i} long" for i in range(len(paths)))]))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key of (source, lang, tokenizer_version, change, tokens, old_tokens).

    ``change`` is insert, delete or revise; a revision adds tokens less old_tokens and no document. Any
    other or null change is an error. Null counts are 0; null keys are keys of their own;
    repeated changes each count. Other columns are ignored.
    """
    sign = (
        F.when(F.col("change") == "insert", 1)
        .when(F.col("change") == "delete", -1)
        .when(F.col("change") == "revise", 0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null")))).cast("int"))
    )
    tokens, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    more = F.when(sign == 0, tokens - old).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(more).cast("long").alias("n_tokens"))


class TokenRollup:
    """A rollup below ``path``, in any file system that Hadoop's FileContext knows.

    Its states are versions of one log: {totals, folded, open}, the folder of the newest snapshot, that of the ids which it took in, and the
    folder of each committed batch since. A version names all that belongs together, so a reader can't see a batch in both places or in none, and of
    two writers the later one decides again on what the earlier one left.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, path)

    def _fresh(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def _taken(self, folder: str | None, batch: str) -> bool:
        """Whether a snapshot holds a batch."""
        return folder is not None and self.spark.read.schema("batch string").parquet(f"{self.path}/{folder}").filter(F.col("batch") == batch).limit(1).count() > 0

    def committed(self) -> list[str]:
        """Ids of committed batches that no snapshot holds yet."""
        return sorted(self.log.latest()[1].get("open", {}))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was committed before, also by another writer meanwhile, and then nothing changes."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")

        def known(state: dict) -> bool:
            return batch in state.get("open", {}) or self._taken(state.get("folded"), batch)

        if known(self.log.latest()[1]):
            return False
        folder = self._fresh(f"batches/{batch}")
        deltas(changes).write.parquet(f"{self.path}/{folder}")
        return self.log.change(lambda state: None if known(state) else state | {"open": state.get("open", {}) | {batch: folder}}) is not None

    def _sums(self, state: dict) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in [*state.get("open", {}).values(), *([state["totals"]] if state.get("totals") else [])]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def fold(self) -> bool:
        """Take the batches committed so far into a new snapshot; False if another process made one meanwhile. Batches committed meanwhile stay open."""
        _, state = self.log.latest()
        totals, folded = self._fresh("totals"), self._fresh("folded")
        self._sums(state).write.parquet(f"{self.path}/{totals}")
        ids = self.spark.createDataFrame([(b,) for b in state.get("open", {})], "batch string").coalesce(1)
        if state.get("folded"):
            ids = ids.union(self.spark.read.schema("batch string").parquet(f"{self.path}/{state['folded']}"))
        ids.write.parquet(f"{self.path}/{folded}")

        def decide(now: dict) -> dict | None:
            if now.get("totals") != state.get("totals"):
                return None
            left = {b: f for b, f in now.get("open", {}).items() if b not in state.get("open", {})}
            return {"totals": totals, "folded": folded, "open": left}

        return self.log.change(decide) is not None

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over committed batches; keys at 0 documents and 0 tokens are gone."""
        return self._sums(self.log.latest()[1]).filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def op7(spark, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizer versions, revise one by an end token a document, delete what labels call bad, fold, and replay a batch."""
    versions = default_versions()
    one, two = versions
    docs = cut_lineage(token_counts(read(spark, sf_dir, "documents"), versions))
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, change: str, version: str, tokens, old=none) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(change).alias("change"), tokens.alias("tokens"), old.alias("old_tokens"))

    bad = read(spark, sf_dir, "labels").filter(F.col("quality") == 0).select("doc_id").distinct()
    rollup = TokenRollup(spark, shared_path(spark, "rollup"))
    loaded = changes(docs, "insert", one, F.col("n0"))
    rollup.apply("load-one", loaded)
    rollup.apply("load-two", changes(docs, "insert", two, F.col("n1")))
    rollup.fold()
    rollup.apply("revise-one", changes(docs, "revise", one, F.col("n0") + 1, F.col("n0")))
    rollup.apply("delete-bad", changes(docs.join(bad, "doc_id", "left_semi"), "delete", two, F.col("n1")))
    rollup.apply("load-one", loaded)  # a replay: nothing changes
    return rollup.totals()
