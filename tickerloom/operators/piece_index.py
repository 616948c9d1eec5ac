"""A store of documents and an index of their pieces, kept in step by digests.

Both are tables in the same buckets of the document's id. The state that names their files has for each bucket a digest of
the (document, content hash) pairs that it holds; over these digests stands a tree. Two trees are compared from the top, so a
rebuild reads only the buckets that differ, and in them the ids and hashes before any text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.operators import search
from tickerloom.operators.search import Ask, query_documents
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import PIECES, sql
from tickerloom.sources.lineage import cut_lineage, few_or_shuffled, fresh_path, map_batches
from tickerloom.sources.versions import Conflict, Table, Tables

#: Children of a node of the tree, and documents for which the tables get another bucket.
FAN = 16
BUCKET_DOCS = 50_000
TABLES = {
    "documents": Table("doc_id long, content string, hash long", ("doc_id",), "xxhash64(doc_id, hash)"),
    "pieces": Table(
        "doc_id long, piece int, of_pieces int, start_char int, end_char int, content string, digest long, hash long", ("doc_id",), "CASE WHEN piece <= 0 THEN xxhash64(doc_id, hash) END"
    ),
}


def tree(leaves: list[str]) -> list[list[str]]:
    """Levels from the leaves to one root; an inner node is the hash of its children."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("|".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return levels


def differing(one: list[str], two: list[str]) -> tuple[list[int], int]:
    """The leaves in which two trees differ, and how many nodes were compared: only children of nodes that differ are."""
    first, second = tree(one), tree(two)
    nodes, compared = [0], 0
    for depth in range(len(first) - 1, -1, -1):
        compared += len(nodes)
        nodes = [i for i in nodes if first[depth][i] != second[depth][i]]
        if depth:
            nodes = [c for i in nodes for c in range(i * FAN, min((i + 1) * FAN, len(first[depth - 1])))]
    return nodes, compared


@dataclass(frozen=True)
class Report:
    """(doc_id, problem) rows: missing, stale, orphan, damaged; the buckets that they lie in; and what it took to find them."""

    problems: DataFrame
    buckets: list[int]
    nodes: int
    bytes_read: int


class PieceIndex:
    """Documents (doc_id, content) and the pieces that searches read, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.tables = Tables(spark, path, TABLES, buckets)

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r["b"] for r in ids.select(self.tables.bucket_of("documents").alias("b")).distinct().collect()]  # at most all buckets

    def change(self, docs: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Drop documents (doc_id) and insert others, which replace those of the same id, in one version. Ids must be distinct and not null; the index isn't changed."""
        parts = [x.select("doc_id") for x in (docs, gone) if x is not None]
        ids = cut_lineage((parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct())
        marked = few_or_shuffled(ids)

        new = None if docs is None else docs.select("doc_id", "content", F.xxhash64(F.coalesce("content", F.lit(""))).alias("hash"))
        self.tables.rewrite("documents", self._touched(ids), lambda old: old.join(marked, "doc_id", "left_anti"), new)

    def save(self, docs: DataFrame) -> None:
        """Insert documents, or replace those of the same id."""
        self.change(docs)

    def delete(self, ids: DataFrame) -> None:
        """Drop documents (doc_id)."""
        self.change(gone=ids)

    def documents(self) -> DataFrame:
        return self.tables.read("documents").select("doc_id", "content")

    def pieces(self) -> DataFrame:
        """(doc_id, piece, start_char, end_char, content) of all indexed pieces."""
        return self.tables.read("pieces").filter("piece >= 0").select("doc_id", "piece", "start_char", "end_char", "content")

    def _leaves(self, state: dict, table: str) -> list[str]:
        """A digest for each bucket, as the state has them."""
        return [str(sum(int(e["digest"]) for e in state[table].get(b, []))) for b in range(self.tables.buckets)]

    def _bytes(self, state: dict, buckets: list[int], *tables: str) -> int:
        return sum(e["bytes"] for t in tables for b in buckets for e in state[t].get(b, []))

    def _compared(self, state: dict, buckets: list[int]) -> DataFrame:
        """The problems of some buckets, document by document."""
        wanted = self.tables.read("documents", state=state, buckets=buckets).select("doc_id", F.col("hash").alias("wanted"))
        rows = self.tables.read("pieces", state=state, buckets=buckets, lenient=True)
        real = F.col("piece") >= 0
        held = rows.groupBy("doc_id").agg(
            F.min("hash").alias("least"), F.max("hash").alias("most"), F.max("of_pieces").alias("of_pieces"), F.count(F.when(real, 1)).alias("n"),
            F.count_distinct(F.when(real, F.col("piece"))).alias("different"), F.max((F.col("digest") != F.xxhash64("content")).cast("int")).alias("broken"),
        )
        whole = (F.col("n") == F.col("of_pieces")) & (F.col("different") == F.col("of_pieces")) & (F.col("broken") == 0)
        problem = (
            F.when(F.col("least").isNull(), "missing").when(F.col("wanted").isNull(), "orphan")
            .when((F.col("least") != F.col("wanted")) | (F.col("most") != F.col("wanted")), "stale").when(~whole, "damaged")
        )
        return wanted.join(held, "doc_id", "full_outer").select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL")

    def verify(self) -> Report:
        """Compare the index with the store, and every byte of the index with what was committed; nothing is changed."""
        state = self.tables.state()
        rows = self.tables.read("pieces", state=state, lenient=True)
        first = F.when(F.col("piece") <= 0, F.greatest("of_pieces", F.lit(1)))
        found = rows.groupBy(self.tables.bucket_of("pieces").alias("b")).agg(
            *self.tables.digests("pieces", rows), F.sum(first).alias("expected"), F.max((F.col("digest") != F.xxhash64("content")).cast("int")).alias("broken")
        )
        actual = {r["b"]: r for r in found.collect()}  # a row a bucket
        leaves, suspect = [], set()
        for b in range(self.tables.buckets):
            entries, r = state["pieces"].get(b, []), actual.get(b)
            leaves.append(r["digest"] if r else "0")
            stated = (sum(e["rows"] for e in entries), sum(int(e["own"]) for e in entries))
            if stated != ((r["rows"], int(r["own"])) if r else (0, 0)) or (r and (r["expected"] != r["rows"] or r["broken"])):
                suspect.add(b)
        unequal, nodes = differing(self._leaves(state, "documents"), leaves)
        buckets = sorted(suspect | set(unequal))
        size = self._bytes(state, range(self.tables.buckets), "pieces") + self._bytes(state, buckets, "documents", "pieces")
        return Report(self._compared(state, buckets), buckets, nodes, size)

    def outdated(self) -> Report:
        """What the states' digests show, without a look at buckets that agree."""
        state = self.tables.state()
        buckets, nodes = differing(self._leaves(state, "documents"), self._leaves(state, "pieces"))
        return Report(self._compared(state, buckets), buckets, nodes, self._bytes(state, buckets, "documents", "pieces"))

    def rebuild(self, mode: str = "incremental", also: list[int] | None = None) -> Report:
        """Bring the index in step with the store, in one version.

        * incremental: what differs by the digests, and the buckets ``also``, those that ``verify`` found, say.
        * full: every piece anew.
        Searches see the index before or after it. If someone else changes it meanwhile, it is done again.
        """
        if mode not in ("incremental", "full"):
            raise ValueError("a rebuild is incremental or full; verify() reports only")
        while True:
            state = self.tables.state()
            buckets, nodes = differing(self._leaves(state, "documents"), self._leaves(state, "pieces"))
            buckets = sorted({*buckets, *(also or [])}) if mode == "incremental" else list(range(self.tables.buckets))
            docs = self.tables.read("documents", state=state, buckets=buckets)
            if mode == "full":
                problems = docs.select("doc_id", F.lit("missing").alias("problem"))
                rows = pieces_of(docs)
            else:
                problems = cut_lineage(self._compared(state, buckets))
                marked = few_or_shuffled(problems.select("doc_id"))
                kept = self.tables.read("pieces", state=state, buckets=buckets, lenient=True).join(marked, "doc_id", "left_anti")
                rows = kept.unionByName(pieces_of(docs.join(marked, "doc_id", "left_semi")))
            size = self._bytes(state, buckets, "documents", *(["pieces"] if mode == "incremental" else []))
            report = Report(problems, buckets, nodes, size)
            if not buckets:
                return report
            staged = self.tables.stage("pieces", rows, True)
            try:
                self.tables.commit({}, {"pieces": {b: staged.get(b, []) for b in buckets}}, state)
                return report
            except Conflict:
                continue


def pieces_of(docs: DataFrame) -> DataFrame:
    """Rows of the index for documents (doc_id, content, hash); a text without pieces gets one row with piece -1, so that it isn't missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, mark in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = tx.chunks_of(text or "")
                rows += [(name, n, len(found), *piece, mark) for n, piece in enumerate(found)] or [(name, -1, 0, None, None, None, mark)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    names = ["doc_id", "piece", "of_pieces", "start_char", "end_char", "content", "hash"]
    cut = map_batches(docs.select("doc_id", "content", "hash"), run, "doc_id long, piece int, of_pieces int, start_char int, end_char int, content string, hash long")
    return cut.withColumn("digest", F.xxhash64("content"))


def _buckets(n: News) -> int:
    return max(16, -(-n.table("documents").count() // BUCKET_DOCS))


_GONE = 1_000_000_000


def _behind(n: News) -> PieceIndex:
    """An index of the documents as they were: some not there yet, some with another text, and some that have been deleted since."""
    d = F.col("doc_id")
    docs = n.documents.select("doc_id", "content")
    before = docs.filter(d % 11 != 3).withColumn("content", F.when(d % 13 == 5, F.concat(F.lit("Draft. "), "content")).otherwise(F.col("content")))
    index = PieceIndex(n.spark, fresh_path(n.spark, "pieces"), _buckets(n))
    index.save(before.union(docs.filter(d % 17 == 2).withColumn("doc_id", d + _GONE)))
    index.rebuild("full")
    index.change(docs.filter((d % 11 == 3) | (d % 13 == 5)), docs.filter(d % 17 == 2).select((d + _GONE).alias("doc_id")))
    index.tables.clean(1)  # nobody else writes or reads here
    return index


def index_rebuild(n: News) -> DataFrame:
    """All pieces after an incremental rebuild of an index that had fallen behind its store."""
    index = _behind(n)
    index.rebuild()
    return index.pieces().select("doc_id", "piece", "start_char", "end_char", F.md5("content").alias("digest"))


def index_problems(n: News) -> DataFrame:
    """What verify reports of such an index that has lost its second pieces of some documents besides."""
    index = _behind(n)
    lost = (F.col("doc_id") % 19 == 4) & (F.col("piece") == 1)
    index.tables.rewrite("pieces", range(index.tables.buckets), lambda rows: rows.filter(~lost))
    return index.verify().problems


def query_documents_indexed(n: News) -> DataFrame:
    """The document query over the stored pieces instead of texts that are cut for it."""
    index = PieceIndex(n.spark, fresh_path(n.spark, "pieces"), _buckets(n))
    index.save(n.documents.select("doc_id", "content"))
    index.rebuild()
    return search._short(query_documents(n, Ask(), index.pieces()))


QUERIES = {f.__name__: f for f in (index_rebuild, index_problems, query_documents_indexed)}
SQL = {
    "index_rebuild": sql("SELECT doc_id, piece::INTEGER AS piece, start_char::INTEGER AS start_char, end_char::INTEGER AS end_char, md5(text) AS digest FROM pieces", *PIECES),
    "index_problems": sql(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'missing' WHEN doc_id % 13 = 5 THEN 'stale' ELSE 'damaged' END AS problem FROM docs
        WHERE doc_id % 11 = 3 OR doc_id % 13 = 5 OR (doc_id % 19 = 4 AND doc_id IN (SELECT doc_id FROM pieces WHERE piece = 1))
        UNION ALL SELECT doc_id + {_GONE}, 'orphan' FROM docs WHERE doc_id % 17 = 2""", *PIECES),
    "query_documents_indexed": sql("SELECT rank, doc_id, score, similarity FROM ans", *search._PLAIN),
}
