"""Inverted treaps: their shape, the walk against brute force, edge cases; the query's SQL is checked with the other operators'."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import ODD, odd
from tickerloom.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k=10):
    """By the definition: every document's score for every item."""
    counts = [(d, Counter(brute_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(brute_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def some_documents(rng, n=400, words=60):
    names = [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(3000)] + ["Ü", "x1", "É漢", "ONE", "one"]
    docs = [(i * 3 % 1000, rng.choice([" ", ", ", "\n"]).join(rng.choices(names, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    hot = "the hot passage w1 w2 w3 that many documents share " * 3
    return docs + [(2000 + i, hot) for i in range(n // 3)] + [(5, hot), (5, hot), (None, hot), (7, None), (8, ""), (9, " .,;")]


def some_items(rng, docs, n=30):
    texts = [t for _, t in docs if t]
    items = [(i, rng.choice(texts)[: rng.randint(1, 300)]) for i in range(n)]
    return items + [(3, "one more ROW of item three"), (n, None), (n + 1, ""), (n + 2, "nowhere at all"), (None, "w1 hot")]


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_chars, pass_terms, side", [(1 << 24, 200_000, 1 << 18), (2000, 40, 7), (300, 1, 1)])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, block_chars, pass_terms, side):
    monkeypatch.setattr(treaps.search_block, "__defaults__", (side,))
    rng = random.Random(block_chars)
    docs = some_documents(rng, 400 if pass_terms > 40 else 120)
    items = some_items(rng, docs, 30 if pass_terms > 40 else 4)
    left, right = tables(spark, docs, items)
    path = str(tmp_path / "index")
    treaps.write_index(left.repartition(3), path, block_chars=block_chars)
    found = [tuple(r) for r in treaps.search(spark, path, right, pass_terms=pass_terms).collect()]
    assert sorted(found, key=key) == sorted(brute_search(docs, items), key=key)


def test_treaps_are_treaps():
    rng = np.random.default_rng(2)
    for counts in ([1], [5, 1, 40], [3000], [1, 1, 1], [700, 2, 1300]):
        counts = np.array(counts)
        for bounds in (rng.integers(1, 6, counts.sum()), np.arange(counts.sum()), np.zeros(counts.sum(), np.int64)):
            left, right, roots = treaps.build_treaps(bounds.astype(np.int64), counts)
            starts = np.cumsum(counts) - counts
            depth = 0
            for root, start, count in zip(roots, starts, counts, strict=True):
                seen, stack = [], [(root, start, start + count, 1)]
                while stack:
                    node, lo, hi, d = stack.pop()
                    assert lo <= node < hi
                    seen.append(node)
                    depth = max(depth, d)
                    for child, a, b in ((left[node], lo, node), (right[node], node + 1, hi)):
                        assert (child >= 0) == (a < b)
                        if child >= 0:
                            assert bounds[child] <= bounds[node]
                            stack.append((child, a, b, d + 1))
                assert sorted(seen) == list(range(start, start + count))
            if len(set(bounds.tolist())) <= 6:
                assert depth < 8 * math.log2(len(bounds) + 2)


def test_rounding_keeps_bounds():
    x = np.concatenate([np.arange(1, 5000), np.random.default_rng(1).integers(1, 1_000_000, 5000)])
    up = treaps.rounded_up(x)
    assert (up >= x).all() and (up <= x * (1 + 2 / 2**treaps.BITS)).all()


def test_documents_of_rising_length_stay_shallow():
    """Impacts that fall with doc_id would make a chain; rounding keeps treaps shallow."""
    impacts = treaps.impacts_of(np.ones(20_000, np.int64), np.arange(1, 20_001), 20_000, 200_010_000)
    left, right, roots = treaps.build_treaps(treaps.rounded_up(impacts), np.array([20_000]))
    level, depth = roots, 0
    while len(level):
        level = np.concatenate([x[x >= 0] for x in (left[level], right[level])])
        depth += 1
    assert depth < 1200


def test_the_walk_prunes(spark, tmp_path):
    """An item that a few documents repeat: most documents are never scored."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=50))) for i in range(4000)]
    rare = " ".join(f"r{i}" for i in range(20))
    docs += [(10_000 + i, rare + " " + docs[i][1]) for i in range(12)]
    left, right = tables(spark, docs, [(1, rare + " w1 w2 w3 w4 w5")])
    path = str(tmp_path / "index")
    treaps.write_index(left.coalesce(1), path)
    (row,) = [r.asDict() for r in spark.read.parquet(path).collect()]
    n, total = treaps._totals(spark, path)
    block = treaps.Treaps(row, n, total)
    number = {t.decode(): i for i, t in enumerate(treaps._block_terms(__import__("pyarrow").scalar(row["terms"])))}
    terms = brute_terms(rare + " w1 w2 w3 w4 w5")
    roots = block.roots[[number[t] for t in terms]]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * block.counts[number[t]] + 1))) for t in terms])
    best = treaps.Best(10)
    assert treaps.search_block(block, roots, weights, best) < 100
    assert sorted((r["doc_id"], r["score"]) for r in treaps.search(spark, path, right).collect()) == sorted(zip(best.ids, best.scores.tolist(), strict=True))


def test_odd_rows(spark, tmp_path):
    docs = odd(spark).withColumnRenamed("row", "item").withColumnRenamed("size", "n_docs")
    items = odd(spark).withColumnRenamed("doc_id", "item_id").withColumnRenamed("row", "score")
    path = str(tmp_path / "index")
    treaps.write_index(docs, path, block_chars=100)
    found = treaps.search(spark, path, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    wanted = brute_search([r[:2] for r in ODD], [r[:2] for r in ODD])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    names = spark.createDataFrame([("a", "one"), ("b", "id HERE")], "item_id string, text string")
    assert {r["item_id"] for r in treaps.search(spark, path, names).collect()} == {"a", "b"}
    assert treaps.search(spark, path, items.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    treaps.write_index(odd(spark, []), path)
    assert treaps.search(spark, path, odd(spark).withColumnRenamed("doc_id", "item_id")).count() == 0
