"""Ranked lexical search over inverted treaps.

A block of documents has a treap for each term: binary search order by document (ascending doc_id in its block), heap
order by impact, so that a node's impact bounds its whole subtree. An index is a Parquet folder with a row a block, cut
by documents: no posting is shuffled, and a frequent term is one treap a block. Impacts depend on the number of documents and words, so
postings are written first, and treaps after the totals are known.

A search walks the treaps of an item's terms together. A task of the walk is a range of documents with, for each term, the root
of its treap within the range; the weighted impacts of these roots bound every score in the range. Ranges that can't enter the top k
are dropped; of the others the document of the largest root is scored exactly and splits the range in two.
Many ranges go side by side in flat arrays. The k best so far are kept from block to block of a task.

Heap order uses impacts rounded up to six significant bits, ties in the order of a hash: so a treap stays shallow
though impacts be equal or sorted. Scores use exact impacts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickerloom.llm.bpe import _pack, _unpack
from tickerloom.llm.common import map_batches, read, shared_path
from tickerloom.llm.pretokens import Numbers, ragged

#: Code points of a block; a longer document is a block of its own.
BLOCK_CHARS = 1 << 24
#: Terms of the items that are searched for in one pass.
PASS_TERMS = 200_000
#: Roots in the ranges that go side by side.
SIDE_BY_SIDE = 1 << 14
#: Significant bits of the impacts that order treaps.
BITS = 6
BEST = 10

POSTINGS = "n_docs long, n_words long, doc_ids array<long>, sizes binary, terms binary, dfs binary, docs binary, tfs binary"
INDEX = POSTINGS + ", left binary, right binary, roots binary"
_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [(k, pa.binary()) for k in ("sizes", "terms", "dfs", "docs", "tfs", "left", "right", "roots")]
)

#: Terms are runs of ASCII letters and digits and of all that isn't ASCII, A-Z in lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: pa.Scalar) -> list[bytes]:
    """The terms of a text in order."""
    return text.as_buffer().to_pybytes().translate(_TERM_BYTES).split() if text.is_valid else []


def impacts_of(tfs: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that occurs ``tfs`` times in documents of ``sizes`` terms adds for each unit of its weight."""
    m = 10 + 90 * sizes * n // total
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def rounded_up(impacts: np.ndarray) -> np.ndarray:
    """The least numbers of ``BITS`` significant bits that aren't below."""
    shift = np.maximum(np.frexp(impacts.astype(np.float64))[1] - BITS, 0).astype(np.int64)
    return -(-impacts >> shift) << shift


def build_treaps(bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, roots): children (-1: none) of the nodes of many treaps that lie one after another in search order, and their roots.

    A node's parent is the lesser of the nearest greater nodes on both sides; those are found for all nodes at once, by jumps
    over stretches that are known to be lower.
    """
    n = len(bounds)
    place = np.arange(n)
    # an odd factor permutes 32-bit numbers, so no two priorities are equal
    priority = np.append((bounds << 32) + (place * 2_654_435_761 + 97) % (1 << 32), np.iinfo(np.int64).max)
    starts = np.cumsum(counts) - counts
    sides = []
    for step, border in ((-1, starts), (1, starts + counts - 1)):
        near = place + step
        near[border] = n
        going = place
        while len(going):
            going = going[priority[near[going]] < priority[going]]
            near[going] = near[near[going]]
        sides.append(near)
    before, after = sides
    under_before = priority[before] < priority[after]
    top = (before == n) & (after == n)
    left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    right[before[under_before]] = place[under_before]
    under_after = ~under_before & ~top
    left[after[under_after]] = place[under_after]
    return left[:n], right[:n], place[top]


class Treaps:
    """A block of the index in a task."""

    def __init__(self, row: dict, n: int, total: int):
        self.doc_ids = row["doc_ids"]
        self.counts = _unpack(row["dfs"]).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        sizes = _unpack(row["sizes"]).astype(np.int64)
        steps = _unpack(row["docs"]).astype(np.int64)
        run = np.cumsum(steps)
        self.docs = run - np.repeat(run[self.starts] - steps[self.starts], self.counts)
        self.impacts = impacts_of(_unpack(row["tfs"]).astype(np.int64), sizes[self.docs], n, total)
        self.bounds = rounded_up(self.impacts)
        if row.get("left") is not None:
            place = np.arange(len(self.docs))
            down, up = _unpack(row["left"]).astype(np.int64), _unpack(row["right"]).astype(np.int64)
            self.left, self.right = np.where(down > 0, place - down, -1), np.where(up > 0, place + up, -1)
            self.roots = self.starts + _unpack(row["roots"]).astype(np.int64)

    def packed(self) -> dict:
        """The columns that a block of postings gets when its treaps are built."""
        left, right, roots = build_treaps(self.bounds, self.counts)
        place = np.arange(len(left))
        return {
            "left": _pack(np.where(left >= 0, place - left, 0)), "right": _pack(np.where(right >= 0, right - place, 0)),
            "roots": _pack(roots - self.starts),
        }

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of each node's treap restricted to the documents low <= d < high; -1 if there are none."""
        found, going = node.copy(), np.arange(len(node))
        while len(going):
            here = found[going]
            doc = self.docs[here]
            below = doc < low[going]
            outside = below | (doc >= high[going])
            going, here = going[outside], here[outside]
            found[going] = here = np.where(below[outside], self.right[here], self.left[here])
            going = going[here >= 0]
        return found


class Ranges:
    """Ranges of documents side by side: (low, high, roots a range, the roots and their terms' weights one after another)."""

    def __init__(self, treaps: Treaps, low: np.ndarray, high: np.ndarray, counts: np.ndarray, node: np.ndarray, weight: np.ndarray):
        self.low, self.high, self.counts, self.node, self.weight = low, high, counts, node, weight
        self.starts = np.cumsum(counts) - counts
        self.most = weight * treaps.bounds[node]
        self.bound = np.add.reduceat(self.most, self.starts) if len(counts) else counts

    def take(self, treaps: Treaps, some: np.ndarray) -> Ranges:
        """Some of the ranges, by number."""
        starts, counts = self.starts[some], self.counts[some]
        return Ranges(treaps, self.low[some], self.high[some], counts, ragged(self.node, starts, counts), ragged(self.weight, starts, counts))


class Best:
    """The k best (score, doc_id) of an item: highest scores, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, np.int64), [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        scores, ids = np.concatenate([self.scores, scores]), [*self.ids, *ids]
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[: self.k]
        self.scores, self.ids = scores[order], [ids[i] for i in order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])  # of equal scores a smaller id may still come


def search_block(treaps: Treaps, roots: np.ndarray, weights: np.ndarray, best: Best, side_by_side: int = SIDE_BY_SIDE) -> int:
    """Puts a block's documents into ``best``; returns how many were scored."""
    one = lambda x: np.array([x], np.int64)
    stack = [Ranges(treaps, one(0), one(len(treaps.doc_ids)), one(len(roots)), roots, weights)] if len(roots) else []
    scored = 0
    while stack:
        ranges = stack.pop()
        some = np.flatnonzero(ranges.bound >= best.least)
        if len(some) < len(ranges.bound):
            ranges = ranges.take(treaps, some)
        if not len(some):
            continue
        rows = np.repeat(np.arange(len(ranges.counts)), ranges.counts)
        largest = np.flatnonzero(ranges.most == np.maximum.reduceat(ranges.most, ranges.starts)[rows])
        first = np.concatenate([[True], rows[largest[1:]] != rows[largest[:-1]]])
        doc = treaps.docs[ranges.node[largest[first]]]
        at = doc[rows]
        own = treaps.within(ranges.node, at, at + 1)
        scores = np.add.reduceat(np.where(own >= 0, ranges.weight * treaps.impacts[own], 0), ranges.starts)
        scored += len(doc)
        good = np.flatnonzero(scores >= best.least)
        if len(good) > best.k:  # all that tie with the k-th
            good = good[scores[good] >= np.partition(scores[good], len(good) - best.k)[len(good) - best.k]]
        if len(good):
            best.add(scores[good], [treaps.doc_ids[d] for d in doc[good]])
        lows, highs, counts, nodes, weights = [], [], [], [], []
        for low, high in ((ranges.low, doc), (doc + 1, ranges.high)):
            node = treaps.within(ranges.node, low[rows], high[rows])
            held = node >= 0
            count = np.bincount(rows[held], minlength=len(doc))
            full = count > 0
            for parts, part in zip((lows, highs, counts, nodes, weights), (low[full], high[full], count[full], node[held], ranges.weight[held]), strict=True):
                parts.append(part)
        both = Ranges(treaps, *map(np.concatenate, (lows, highs, counts, nodes, weights)))
        order = np.argsort(both.bound, kind="stable")  # the highest last, as they leave the stack first
        order = order[both.bound[order] >= best.least]
        piece = np.cumsum(both.counts[order]) // side_by_side
        for some in np.split(order, np.flatnonzero(np.diff(piece)) + 1) if len(order) else ():
            stack.append(both.take(treaps, some))
    return scored


def write_index(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> None:
    """Index every whole text of ``docs``, all its terms, at ``path``.

    * terms are runs of ASCII letters and digits and of all that isn't ASCII; only A-Z is lower-cased.
    * null texts and texts without terms are in no posting. Repeated rows are documents of their own, null ids too.
    * other columns are ignored, so their names can't clash. Ids must be integers. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def block(ids: list, found: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        key, tfs = np.unique(np.concatenate(found) * len(ids) + np.repeat(place, sizes), return_counts=True)
        term, doc = key // len(ids), key % len(ids)
        new = np.concatenate([[True], term[1:] != term[:-1]])
        row = {
            "n_docs": len(ids), "n_words": int(sizes.sum()), "doc_ids": [ids[i] for i in order], "sizes": _pack(sizes[order]),
            "terms": zstandard.ZstdCompressor(level=3).compress(b" ".join(numbers)), "dfs": _pack(np.bincount(term)),
            "docs": _pack(np.where(new, doc, np.diff(doc, prepend=0))), "tfs": _pack(tfs),
        }
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(_ARROW)[: len(row)]))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, numbers, size = [], [], Numbers(), 0
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(own)
                if not words:
                    continue
                length = sum(map(len, words)) + len(words)
                if ids and size + length > block_chars:
                    yield block(ids, found, numbers)
                    ids, found, numbers, size = [], [], Numbers(), 0
                ids.append(name)
                found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += length
        if ids:
            yield block(ids, found, numbers)

    first = shared_path(spark, "postings")
    map_batches(rows, postings, POSTINGS).write.parquet(first)
    n, total = _totals(spark, first)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([row | Treaps(row, n, total).packed()], schema=_ARROW)

    map_batches(spark.read.schema(POSTINGS).parquet(first), build, INDEX).write.mode("errorifexists").parquet(path)


def _totals(spark, path: str) -> tuple[int, int]:
    """How many documents with terms an index holds, and how many terms they have."""
    found = spark.read.schema(POSTINGS).parquet(path).agg(F.sum("n_docs"), F.sum("n_words")).first()
    return found[0] or 0, found[1] or 0


def _block_terms(packed: pa.Scalar) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed.as_py()).split(b" ")


def document_counts(spark, path: str, terms: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of some terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(terms, 0)
        for batch in batches:
            for packed, counts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for term, count in zip(_block_terms(packed), _unpack(counts).tolist(), strict=True):
                    if term in sums:
                        sums[term] += count
        held = {t: c for t, c in sums.items() if c}
        yield pa.RecordBatch.from_pydict({"term": list(held), "df": list(held.values())}, schema=pa.schema([("term", pa.binary()), ("df", pa.int64())]))

    found = map_batches(spark.read.schema(INDEX).parquet(path).select("terms", "dfs"), run, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row a term of this pass at most


def item_terms(items: DataFrame, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """(item, terms): the distinct terms of each item. Rows of one id are one item; items without terms give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(terms_of(x))) for x in batch.column(1)]
            index = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array([t for x in found for t in x], pa.binary())], names=["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    pairs = map_batches(items.select(F.col(id_col).alias("item"), F.col(text).alias("text")), run, f"item {kind}, term binary")
    return pairs.distinct().groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def _passes(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in lists of at most so many terms together, a longer item by itself; the driver holds one partition and one list at a time."""
    some, size = [], 0
    for row in items.toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if some and size + len(terms) > most:
            yield some
            some, size = [], 0
        some.append((row["item"], terms))
        size += len(terms)
    if some:
        yield some


def search(spark, path: str, items: DataFrame, text: str = "text", id_col: str = "item_id", k: int = BEST, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of the index at ``path`` with a score above 0, whole and exact.

    * a term's weight falls with its number of documents; a document's score sums weight times impact over the item's distinct terms.
    * equal scores stand by ascending doc_id, null ids last. Rows of items with one id are one item, its terms together; null is an id like others.
    * items without terms, or none of whose terms is in the index, give no row. Extra columns are ignored.
    * any number of items is searched in passes of bounded size; each pass reads the index once.
    """
    out, done = shared_path(spark, "found"), 0
    kind = items.schema[id_col].dataType
    item_type = to_arrow_type(kind)
    n, total = _totals(spark, path)
    schema = pa.schema([("item", item_type), ("doc_id", pa.int64()), ("score", pa.int64())])
    for some in _passes(item_terms(items, text, id_col), pass_terms) if n else ():
        counts = document_counts(spark, path, {t for _, terms in some for t in terms})
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in counts.items()}
        asked = [(item, [t for t in terms if weight.get(t, 0) > 0]) for item, terms in some]

        def run(batches: Iterator[pa.RecordBatch], asked=asked, weight=weight) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in asked]
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at].as_py() for c in batch.schema.names if c != "terms"}
                    number = {t: i for i, t in enumerate(_block_terms(batch.column("terms")[at])) if t in weight}
                    treaps = Treaps(row, n, total)
                    for (_, terms), own in zip(asked, best, strict=True):
                        held = [t for t in terms if t in number]
                        roots = treaps.roots[np.array([number[t] for t in held], np.int64)]
                        search_block(treaps, roots, np.array([weight[t] for t in held], np.int64), own)
            for (item, _), own in zip(asked, best, strict=True):
                if own.ids:
                    values = [pa.array([item] * len(own.ids), item_type), pa.array(own.ids, pa.int64()), pa.array(own.scores)]
                    yield pa.RecordBatch.from_arrays(values, schema=schema)

        found = map_batches(spark.read.schema(INDEX).parquet(path), run, f"item {kind.simpleString()}, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.select(F.col("item").alias(id_col), "rank", "doc_id", "score").write.mode("append").parquet(out)
        done += 1
    names = f"`{id_col}` {kind.simpleString()}, rank int, doc_id long, score long"
    return spark.read.schema(names).parquet(out) if done else spark.createDataFrame([], names)


def op12(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "treaps")
    write_index(read(spark, sf_dir, "documents"), path)
    return search(spark, path, read(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {_SQL_TERMS} AS term FROM docs),
postings AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM postings GROUP BY r),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_SQL_TERMS} AS term FROM benchmark)),
scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (r), totals GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 10
"""
