"""The ten operators against brute force, exact round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import canonical, run_sql
from tickerloom.llm import bpe, dac, language, license_rules, licenses, mixing, multi_index, quality, registry, rollup, simhash, token_store
from tickerloom.llm import weighted_sampling as ws
from tickerloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, taken string, row string"
#: Nulls, empty and odd texts, ties, repeated rows, and columns whose names clash with outputs.
ODD = [
    (1, None, "a", "s", "t", "r"), (2, "", "a", "s", "t", "r"), (3, "   \n", None, "s", "t", "r"), (4, "one", "b", None, None, None),
    (4, "one", "b", None, None, None), (5, "Copyright (c) 2020 CC-BY 4.0 all rights reserved", "b", "s", "t", "r"),
    (None, "no id here at all", "c", "s", "t", "r"), (6, "wörd " * 40_000, "c", "s", "t", "r"), (7, "<|endoftext|> a  b\t　c", "a", "s", "t", "r"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert canonical(found) == canonical(run_sql(SF, registry.ORACLE_SQL[name]))


# 1


@pytest.mark.parametrize("n, top", [(0, 1), (1, 200), (700, 300), (70_001, 70_000), (1000, 1 << 31)])
def test_codes_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    reader = dac.Reader(dac.encode(ids))
    assert (reader.slice(0, n) == ids).all()
    for lo, hi in [(n // 3, n // 2), (n // 7, n), (n, n), (n // 2, min(n, n // 2 + 1))]:
        assert (reader.slice(lo, hi) == ids[lo:hi]).all()
    some = np.random.default_rng(1).integers(0, max(n, 1), min(n, 50))
    assert (reader.take(some) == ids[some]).all()
    with pytest.raises(IndexError):
        reader.take(np.array([n]))


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, token_store.END_ID]


def test_token_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd(spark), path, shard_tokens=100)
    found = [tuple(r) for r in token_store.read_documents(spark, path).orderBy("start").collect()]
    start, wanted, every = 0, [], []
    for row in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = reference_ids(row[1])
        wanted.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert found == wanted
    positions = [0, 5, len(every) - 1, len(every) + 7]
    assert {r["position"]: r["token"] for r in token_store.tokens_at(spark, path, positions).collect()} == {p: every[p] for p in positions[:3]}


def test_special_tokens_and_long_texts():
    rng = random.Random(4)
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"a  {end}  b", f" {end} {end}\n{end}", f"x {end}", f"{end} x", "", f"y\n \n{end}"]
    bits = ["foo ", " ", "bar\n", "é,", "12 ", "  ", "don't ", f"z{end} "]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts.append("".join(rng.choice(bits[:-1]) for _ in range(450_000)))
    texts.append(texts[-1][: (1 << 20) + 7] + end + texts[-1][::2])
    assert min(map(len, texts[-2:])) > 1 << 20
    found = token_store._encoded(texts, token_store.ChunkEncoder(token_store.default_tokenizer()))
    for text, ids in zip(texts, found, strict=True):
        assert [*ids.tolist(), token_store.END_ID] == reference_ids(text)


def test_token_store_empty(spark, tmp_path):
    token_store.write_store(odd(spark, []), str(tmp_path / "none"))
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0


# 2


@pytest.mark.parametrize("n", [300, 2_000, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_samples_estimate_generalised_jaccard(n, seed):
    rng = np.random.default_rng(seed)
    terms = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    values = [0, 0.25, 0.5, 1, 2, 3, 7.5]
    a = rng.choice(values, n).astype(np.float32)
    b = np.where(rng.random(n) < 0.6, a, rng.choice(values, n)).astype(np.float32)
    codes = ws.signatures([(terms[a > 0], a[a > 0]), (terms[b > 0], b[b > 0])], samples=2048)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(ws.likeness(*codes) - true) < 3 * (true * (1 - true) / 2048) ** 0.5


def weighted_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    held = Counter({("w", w): n / 4 for w, n in Counter(words).items()})
    held.update(Counter(("s", *words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {})
    return held


def exact_likeness(a, b):
    x, y = weighted_set(a), weighted_set(b)
    most = sum(max(x[k], y[k]) for k in {*x, *y})
    return sum(min(x[k], y[k]) for k in x) / most if most else 1.0


def test_likenesses_against_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = ws.edited_fingerprints(docs).toPandas().sort_values("doc_id", ascending=False)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = [texts[i] for i in found.doc_id]
    following = [*own[1:], own[0]]
    for column, others in (("near_edited", list(found.edited)), ("near_next", following)):
        true = np.array([exact_likeness(a, b) for a, b in zip(own, others, strict=True)])
        off = (found[column].to_numpy() - true) / np.sqrt(np.maximum(true * (1 - true), 0.01) / ws.SAMPLES)
        assert abs(off.mean()) < 0.35 and np.abs(off).max() < 5
    by_text = dict(zip(found.edited, found.edited_fingerprint, strict=True))
    plain = ws.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(by_text)], "doc_id long, text string")).collect()
    assert [r["fingerprint"] for r in sorted(plain, key=lambda r: r["doc_id"])] == list(by_text.values())


def test_edited_fingerprints(spark):
    found = ws.edited_fingerprints(odd(spark), buckets=3).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in order]
    wanted = []
    for own, following in zip(texts, [*texts[1:], texts[0]], strict=True):
        cut = len(own) // 3
        wanted.append(own[: len(own) - cut] + following[:cut])
    assert Counter(r["edited"] for r in found) == Counter(wanted)
    by_text = {r[1] or "": set() for r in ODD}
    for r, row in zip(sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0), reverse=True), order, strict=True):
        by_text[row[1] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert ws.edited_fingerprints(odd(spark, [])).count() == 0
    only = ws.edited_fingerprints(odd(spark, ODD[5:6])).first()
    assert only["near_next"] == 1.0
    assert ws.fingerprints(odd(spark)).filter(F.col("doc_id") == 2).first()["fingerprint"] == "0" * 256


# 3


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_text_model(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = language.identify_pages(pages, model).toPandas()
    assert len(found) == pages.count() and (found.language == found.declared).mean() > 0.95
    rows = [(1, None, None), (1, None, None), (2, "", "<p>7 % 8</p>"), (3, "http://x.example.fr/a", "<html lang=fr><p>12 34</p>"), (None, "http://h.de", "<html lang='DE'>der die und")]
    few = language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).toPandas()
    assert len(few) == 5 and (few[few.page_id.isin([1, 2, 3])].language == "und").all()
    assert language.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    assert [len(r["posterior"]) for r in language.identify_pages(pages.limit(1), model).collect()] == [len(model.languages)]


# 4


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["CC", "by", "cc-by", "general", "public", "license", "All", "rights", "reserved", "ALL RIGHTS RESERVED", "é", "word", ",", "4.0", "GPL v3 or later"]
    texts = [rng.choice([" ", "-", "\n", "/"]).join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(rows).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    for i, text in enumerate(texts):
        words = word.findall(text.translate(lower))
        places = sorted((k, r.label) for r in license_rules.BASE for p in [r.pattern.split()] for k in range(len(words)) if words[k : k + len(p)] == p)
        assert found[i]["n_words"] == len(words)
        assert sorted((d["start"], d["label"]) for d in found[i]["base_detections"]) == places


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("MIT License", {"mit"}), ("CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
    ("GNU General Public License v3 or later", {"gpl-3.0-or-later"}), ("Copyright 2020 Foo. All rights reserved", {"copyright", "reserved"}),
    ("a submit license", set()), ("", set()), (None, set()), ("BSD 3-Clause", {"bsd-3-clause"}), ("this is in the public domain", {"public-domain"}),
])
def test_rules(spark, text, labels):
    row = licenses.scan_licenses(spark.createDataFrame([(text, "x")], "text string, score string")).first()
    assert {d["label"] for d in row["detections"] if d["label"] not in {"licensed"}} - {"cc-by"} == labels - {"cc-by"}
    assert (row["score"] > 0) == bool(row["detections"])


def brute_detections(text, table):
    """(start, end, label, priority) after suppression, by trying every rule on the joined words and comparing all pairs in order."""
    joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))
    found = []
    for r in table:
        if f" {r.keyword}" in f" {joined} ":
            for m in re.finditer(rf"(?<![^ ])({r.pattern})(?![^ ])", joined):
                found.append((joined.count(" ", 0, m.start()), joined.count(" ", 0, m.end()), r.label, r.priority, r.base))
    found.sort(key=lambda d: (d[0], -d[1], -d[3], d[2], d[4]))
    kept = []
    for i, d in enumerate(found):
        if not any(e[1] >= d[1] and e[3] >= d[3] for e in found[:i]):
            kept.append(d[:4])
    return kept


def test_suppression_against_brute_force(spark, monkeypatch):
    """All detections, labels and scores of texts full of licence words, long lists of detections and odd rows."""
    monkeypatch.setattr(licenses, "GATHERED", 5)
    rng, table = random.Random(12), license_rules.rules()
    phrases = [
        "GNU General Public License version 2.0 or later", "licensed under the Apache License, Version 2.0", "MIT License", "CC BY-SA 4.0", "all rights reserved", "Creative Commons Attribution ShareAlike 3.0 license",
        "Copyright (c) 2019 by X", "redistribution and use in source and binary forms, with or without modification, are permitted", "public domain", "without warranty of any kind", "Q Public License 1.0", "words", "of", "no other",
        "Zope Public License", "tutti i diritti riservati", "BSD 3-Clause License", "LGPL v2.1", "mozilla public license 2.0", "SIL Open Font License 1.1", "patent license", "dual licensed under", "fair use notice",
    ]
    texts = [rng.choice([" ", ". ", "\n"]).join(rng.choice(phrases) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [" ".join(phrases) * 60, None, "", "all rights reserved " * 400]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Detections string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(rows.union(rows)).collect()}
    for i, text in enumerate(texts):
        wanted = brute_detections(text, table)
        assert [(d["start"], d["end"], d["label"], d["priority"]) for d in found[i]["detections"]] == wanted
        assert abs(found[i]["score"] - (1 - np.prod([1 - p / 6 for _, p in {(d[2], d[3]) for d in wanted}]))) < 1e-9
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def test_rules_are_hundreds_and_gated():
    table = license_rules.rules()
    assert len(table) > 400 and len(license_rules.NAMED) + len(license_rules.RARER) > 190
    for r in license_rules.RARER:  # the gate lets through what a rule matches
        assert re.compile(r[3])
    assert not [r for r in table if re.compile(r.pattern) is None]


# 5


def test_recall_and_probing(spark):
    found = multi_index.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), every=10).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = 0
    for q in ids[ids % 10 == 0]:
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, far))[:10]]) & set(found[found.query_id == q].vec_id))
    assert hits / (10 * (ids % 10 == 0).sum()) >= 0.9
    rng = np.random.default_rng(2)
    rotation = multi_index.Rotation(rng.normal(size=(200, 32)))
    codes = rotation.codes(rng.normal(size=(500, 32)))
    indexes = [multi_index.SubstringIndex(s, b - a) for s, (a, b) in zip(rotation.substrings(codes), rotation.spans, strict=True)]
    for radius in (0, 3, 8, 13, 32):
        near = multi_index.within_radius(rotation, indexes, codes, codes[7], radius)
        assert set(near) == set(np.flatnonzero(np.bitwise_count(codes ^ codes[7]) <= radius))


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0])]
    found = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 8, 0.0), (0, 100, 0.0), (0, 1, 2**0.5), (100, 0, 0.0), (100, 8, 0.0), (100, 1, 2**0.5)]
    assert multi_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (100, [1.0], "x"), (7, [3.0], "x"), (8, [2.0], "x")], "vec_id long, embedding array<float>, rank string")
    found = multi_index.nearest(mixed).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 2**0.5), (100, 1, 8, 1.0), (100, 2, 7, 2.0)]


def test_repeated_ids(spark, monkeypatch):
    """An id in three quarters of all rows: each row is a query, samples stay bounded, and small passes and blocks give what large ones give."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 4)).round(3).tolist()
    rows = [(0 if i < 300 else i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(multi_index, "FIT_ROWS", 50)
    assert len(multi_index.sampled(spark.createDataFrame([(1, 0, [1.0, 2.0])] * 3000, "row long, id long, vector array<double>"), 50, 60, 1)) <= 100
    wanted = []
    for i, (name, v) in enumerate(rows):
        if name % 100 == 0:
            far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), other) for j, (other, w) in enumerate(rows) if j != i)[:10]
            wanted += [(name, rank, other, d) for rank, (d, other) in enumerate(far, 1)]
    for values, block in ((1 << 21, 16_384), (40, 50)):
        monkeypatch.setattr(multi_index, "PASS_VALUES", values)
        monkeypatch.setattr(multi_index, "BLOCK_ROWS", block)
        found = sorted(map(tuple, multi_index.nearest(df, radius=4).collect()))
        assert [f[:3] for f in found] == [w[:3] for w in sorted(wanted)] and np.allclose([f[3] for f in found], [w[3] for w in sorted(wanted)])


# 6


def test_quality_held_out(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    found = quality.op6(spark, larger).toPandas().merge(spark.read.parquet(f"{larger}/labels.parquet").toPandas(), on="doc_id")
    assert {i for i in found.doc_id if zlib.crc32(str(i).encode()) % 4 == 2} == set(found[found.held_out].doc_id)
    held = found[found.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() >= 0.9


def test_quality_edges(spark):
    model = quality.fit_model(odd(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r["quality_score"], 6) for r in quality.score_documents(odd(spark), model).collect()} == {0.5}
    assert quality.score_documents(odd(spark, []), model).count() == 0


# 7


def test_rollup(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, change string, tokens long, old_tokens long, n_docs string"
    r = rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert r.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "1", "insert", 5, None, "x"), ("a", "en", "1", "insert", 5, None, "x"), (None, None, "1", "insert", None, None, "x")], schema)
    assert r.apply("b1", first) and not r.apply("b1", first)
    assert r.apply("b2", spark.createDataFrame([("a", "en", "1", "revise", 9, 5, ""), ("a", "en", "1", "delete", 5, None, "")], schema))
    assert r.apply("b3", spark.createDataFrame([], schema))
    assert {(x["source"], x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == {("a", 1, 9), (None, 1, 0)}
    with pytest.raises(Exception, match="unknown change"):
        r.apply("b4", spark.createDataFrame([("a", "en", "1", "odd", 5, None, "")], schema))
    assert r.committed() == ["b1", "b2", "b3"]
    before = sorted(map(tuple, r.totals().na.fill("-").collect()))
    assert r.fold() and r.committed() == [] and sorted(map(tuple, r.totals().na.fill("-").collect())) == before
    assert not r.apply("b2", first) and r.fold()
    # a batch that broke off before its commit is tried again
    rollup.deltas(first).write.parquet(str(tmp_path / "rollup" / "batches" / "b5" / "lost"))
    assert r.apply("b5", first)
    assert {(x["source"], x["n_docs"], x["n_tokens"]) for x in r.totals().collect()} == {("a", 3, 19), (None, 2, 0)}


def counted(spark, *tokens):
    schema = "source string, lang string, tokenizer_version string, change string, tokens long, old_tokens long"
    return spark.createDataFrame([("a", "en", "1", "insert", t, None) for t in tokens], schema)


def summed(r):
    return [(x["n_docs"], x["n_tokens"]) for x in r.totals().collect()]


def interleaved(spark, path, own, other):
    """Run ``own`` once for each of its steps on the log, with ``other`` let in just before that step; yields the rollup after both and what they gave."""
    for step in range(12):
        r, at = rollup.TokenRollup(spark, f"{path}-{step}"), [0]
        assert r.apply("b1", counted(spark, 5)) and r.fold() and r.apply("b2", counted(spark, 7))
        meddler, gave = rollup.TokenRollup(spark, r.path), []

        def let_in(real, step=step, at=at, gave=gave, meddler=meddler):
            def call(*args):
                at[0] += 1
                if at[0] == step + 1:
                    gave.append(other(meddler))
                return real(*args)

            return call

        r.log.latest, r.log.commit = let_in(r.log.latest), let_in(r.log.commit)
        gave.append(own(r))
        if len(gave) < 2:
            return
        yield meddler, gave


def test_commits_folds_and_readers_at_every_step(spark, tmp_path):
    apply = lambda batch, *tokens: lambda r: r.apply(batch, counted(spark, *tokens))
    fold = lambda r: r.fold()
    meetings = 0
    cases = [
        (fold, apply("b3", 11), (3, 23), lambda x: all(x)), (apply("b3", 11), fold, (3, 23), lambda x: all(x)),
        (fold, fold, (2, 12), lambda x: any(x)), (apply("b3", 11), apply("b4", 13), (4, 36), lambda x: all(x)),
        (apply("b3", 11), apply("b3", 11), (3, 23), lambda x: sorted(x) == [False, True]),
        # a late writer of a batch that others have committed and folded, with a further fold after it
        (apply("b3", 11), lambda r: r.apply("b3", counted(spark, 11)) and r.fold() and r.apply("b4", counted(spark, 1)) and r.fold(), (4, 24), lambda x: x == [True, False]),
    ]
    for k, (own, other, wanted, right) in enumerate(cases):
        for r, gave in interleaved(spark, str(tmp_path / f"case-{k}"), own, other):
            assert summed(r) == [wanted] and right(gave)
            assert r.fold() and summed(r) == [wanted] and r.committed() == []
            assert not r.apply("b1", counted(spark, 99)) and not r.apply("b2", counted(spark, 99)) and summed(r) == [wanted]
            meetings += 1
    assert meetings >= 12


def test_readers_beside_folds(spark, tmp_path):
    for _, gave in interleaved(spark, str(tmp_path / "reader"), summed, lambda r: r.fold()):
        assert gave[1] == [(2, 12)]
    r = rollup.TokenRollup(spark, str(tmp_path / "pinned"))
    r.apply("b1", counted(spark, 5))
    before = r.totals()
    assert r.fold() and r.apply("b2", counted(spark, 7)) and r.fold()
    assert [(x["n_docs"], x["n_tokens"]) for x in before.collect()] == [(1, 5)]


def test_rollup_counts_tokens(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    bad = set(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").toPandas().doc_id)
    wanted = {}
    for k, (version, path) in enumerate(rollup.default_versions().items()):
        own = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        for r in docs.itertuples():
            if k == 0 or r.doc_id not in bad:
                n = wanted.setdefault((r.source, r.lang, version), [0, 0])
                n[0] += 1
                n[1] += len(own.encode_ordinary(r.text or "")) + (k == 0)
    found = rollup.op7(spark, SF).collect()
    assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"]] for r in found} == wanted
    assert [r["n0"] for r in rollup.token_counts(odd(spark), keep=("doc_id", "source")).orderBy(F.col("doc_id").asc_nulls_last()).collect()[:2]] == [0, 0]
    assert rollup.token_counts(odd(spark, []), keep=("doc_id",)).count() == 0


# 8


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})


def test_bpe_round_trip(spark):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "foo", "é", "'s", "12", "!!", "\x1c", "　", "\x85", "\xa0", "don't", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [r[1] for r in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    encoded = bpe.encode_documents(docs, block_chars=500)
    found = bpe.decode_documents(encoded, bpe.token_bytes(spark, bpe.default_ranks())).collect()
    own = encoding()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text) and r["decoded"].decode() == text
    assert bpe.encode_documents(odd(spark, [])).count() == 0


def test_bpe_unknown_id(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="token-byte table"):
        bpe.decode_documents(rows, bpe.token_bytes(spark, bpe.default_ranks())).collect()


def test_digests(spark):
    r = bpe.digests(odd(spark, ODD[8:])).first()
    assert r["decoded_sha256"] == hashlib.sha256(ODD[8][1].encode()).hexdigest()


# 9


def groups_by_brute_force(prints, ids, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, name in enumerate(ids):
        least[root(i)] = min(least.get(root(i), name), name)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_links_lose_nothing(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 30)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for base in (prints[0], prints[0], prints[5]):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (120, 3)).astype(np.uint64), axis=1)
        prints = np.concatenate([prints, base ^ flips])
    prints = np.unique(prints)
    rows = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").localCheckpoint()
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(rows, radius)).collect()}
    signed = prints.view(np.int64).tolist()
    assert [roots.get(p, p) for p in signed] == groups_by_brute_force(prints, signed, radius)


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    found = simhash.op9(spark, SF).toPandas().sort_values("doc_id")
    prints = np.array([simhash.simhash(t) for t in docs.text], np.uint64)
    assert [format(int(p), "016x") for p in prints] == found.fingerprint.tolist()
    assert groups_by_brute_force(prints, docs.doc_id.tolist(), 3) == found.component_id.tolist()


def test_near_duplicate_edges(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.keep_one(odd(spark)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(odd(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100)], "a long, b long")
    assert {(r["node"], r["root"]) for r in connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100)}


# 10


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, "e": 300}
    rows = spark.createDataFrame([("s" + k, n) for k, n in sizes.items()] + [("n", 40)], "source_key string, source_size long")
    found = {r["source_key"]: r["target"] for r in mixing.source_targets(rows).collect()}
    names, weights = ["sa", "sb", "sc", "sd", "se", "n"], [3, 1, 2, 3, 1, 2]
    size = [sizes.get(k[1:], 40) for k in names]
    target, left, live = [0.0] * 6, 1.5 * sum(size), set(range(6))
    while live:
        share = left / sum(weights[i] for i in live)
        full = {i for i in live if share * weights[i] >= 2 * size[i]}
        for i in full or live:
            target[i] = 2.0 * size[i] if full else share * weights[i]
            left -= target[i] if full else 0
        live = live - full if full else set()
    assert [found[k] for k in names] == pytest.approx(target)


def test_mix(spark):
    sized = odd(spark).withColumn("size", mixing.word_count(F.col("text")))
    found = mixing.mix_sources(sized).collect()
    assert len(found) == len(ODD)
    sums = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for taken, target in sums.values())
    assert mixing.mix_sources(sized.limit(0)).count() == 0
    times = {r['doc_id']: 0 for r in found}
    for r in mixing.mix_documents(odd(spark)).collect():
        assert r['text'].strip() and r['row'] in ('r', None)
        times[r['doc_id']] += 1
    assert max(times.values()) <= 4 and sum(times.values()) > 0
    assert mixing.mix_documents(odd(spark, [])).count() == 0


def test_equal_rows_keep_their_copies(spark):
    rows = [(1, "a b c d e", "s", None, None, str(i)) for i in range(5)] + [(2, "x y z", "t", None, None, "r")]
    sized = mixing.mix_sources(odd(spark, rows).withColumn("size", mixing.word_count(F.col("text")))).collect()
    times = sum(int(r["taken"] / 5 + 0.5) for r in sized if r["doc_id"] == 1)
    assert sum(r["doc_id"] == 1 for r in mixing.mix_documents(odd(spark, rows)).collect()) == times > 0


# the pipeline


def test_stages_with_odd_rows(spark):
    """Nulls, repeats, empty texts, equal ids, clashing columns and empty tables go through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    good = docs.filter("lang = 'en'").orderBy("doc_id").limit(3).collect()
    odd_rows = [(None, None, None, None, None), (good[0].doc_id, "12 34 ?!", "xx", None, 8), (good[0].doc_id, "12 34 ?!", "xx", None, 8), (9_000, "", "en", "src1", 0), (9_001, "word " * 50_000, "en", "src1", 0)]
    rows = docs.union(spark.createDataFrame(odd_rows, docs.schema)).withColumn("__mark", F.lit("clash")).withColumn("quality_score", F.lit("clash"))
    kept = pipeline.language_stage(spark, rows, SF)
    assert kept.columns == pipeline.COLUMNS
    assert {g.doc_id for g in good} <= {r["doc_id"] for r in kept.collect()}
    assert kept.filter(F.col("text") == "12 34 ?!").count() == 0
    for name, stage in pipeline.STAGES:
        found = stage(spark, rows, SF)
        assert found.count() > 0 and found.columns == (pipeline.COLUMNS if name != "encode" else found.columns)
        assert stage(spark, rows.limit(0), SF).count() == 0



def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == (pipeline.COLUMNS if name != "encode" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "mix")).collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert pipeline.run(spark, SF).count() == docs.count()


# sampling


def test_thin_samples(spark):
    from tickerloom.llm.common import about

    assert 10 < spark.range(40_000_000).filter(about(1e-6, 3, "id")).count() < 80
    assert spark.range(1000).filter(about(1.0, 3, "id")).count() == 1000


def test_every_language_is_known(spark):
    rows = [(i, f"the words of text {i % 7}", "en") for i in range(3000)] + [(5000, "mot rare", "fr"), (5001, "x" * 30_000, "de"), (None, None, "es"), (5002, "no language", None)]
    model = language.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=200)
    assert model.languages == ["de", "en", "es", "fr"]
    found = language.identify_documents(spark.createDataFrame([(1, "mot rare", "s", None)], "doc_id long, text string, source string, lang string"), model)
    assert found.first()["language"] == "fr"


def test_unknown_scripts_and_long_rows(spark):
    """A language whose rows are all long is learned from their beginnings; one without texts takes nothing; a script that no language has is undetermined."""
    rng = random.Random(2)
    words = {"en": "the words of this text are those that people use every day in the street", "fr": "les mots de ce texte sont ceux que les gens disent chaque jour dans la rue", "de": "die Worte dieses Textes sind die welche man jeden Tag auf der Strasse sagt"}
    draw = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    rows = [(i, draw(lang, 30), lang) for i, lang in enumerate(["en", "fr"] * 60)] + [(1000 + i, draw("de", 5000), "de") for i in range(60)] + [(2000, None, "es"), (2001, "", "it")]
    assert all(len(t) > language.FIT_CHARS for _, t, name in rows if name == "de")
    model = language.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "es", "fr", "it"]
    tests = [(1, "die Worte sind die welche man sagt"), (2, "слова этого текста люди говорят каждый день на улице"), (3, "les gens disent les mots"), (4, "これは日本語の文章です"), (5, "the words people use " * 20_000)]
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in tests], "doc_id long, text string, source string, lang string")
    assert {r["doc_id"]: r["language"] for r in language.identify_documents(docs, model).collect()} == {1: "de", 2: "und", 3: "fr", 4: "und", 5: "en"}
    html = "<html lang={}><body>{}</body></html>"
    pages = [(1, "http://a.de/x", html.format("ru", tests[1][1]), "clash"), (2, "http://a.de/y", html.format("de", draw("de", 40)), "clash"), (2, "http://a.de/y", html.format("de", draw("de", 40)), "clash"), (3, None, draw("fr", 60_000), "clash"), (None, "", "", None)]
    found = language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, language string"), model).collect()
    assert sorted((r["page_id"] or 0, r["language"]) for r in found) == [(0, "und"), (1, "und"), (2, "de"), (2, "de"), (3, "fr")]


def test_likelihoods_against_brute_force():
    """The log likelihood of a text, n-gram by n-gram, from counts of a few texts."""
    texts = {"en": ["the cat", "a dog"], "fr": ["le chat noir"]}
    counts = np.zeros((1 << language.BUCKET_BITS, 2))
    for k, some in enumerate(texts.values()):
        for t in some:
            for found in language.text_buckets(t):
                for b in found:
                    counts[b, k] += 1
    model, text = language.TextModel(list(texts), counts), "the cat noir"
    buckets = [int(b) for found in language.text_buckets(text) for b in found]
    wanted = [sum(np.log((counts[b, k] + 0.1) / (counts[:, k].sum() + 0.1 * len(counts))) for b in buckets) for k in range(2)]
    logs, n = model.likelihoods(text)
    assert n == len(buckets) and np.allclose(logs, [w * min(1.0, language.TEXT_WEIGHT / n) for w in wanted], rtol=1e-4)


def test_samples_stay_bounded_when_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_TIMES", 2)
    docs = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS doc_id", "cast(id % 2 AS int) AS quality")
    seen = []
    monkeypatch.setattr(quality, "fit_in_task", lambda rows, fit: seen.append(rows.count()) or quality.Model())
    quality.fit_model(docs, labels, fit_rows=100)
    assert seen[0] <= 200


def test_near_copies(spark):
    """Planted near copies of a similarity of .8 or more on 5-word shingles, and unlike texts, by the stage's scheme."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    docs, planted = [], []
    for i in range(300):
        text = rng.choices(words, k=rng.randint(80, 400))
        docs.append((i, " ".join(text)))
        if i % 3 == 0:
            edited = list(text)
            for _ in range(max(1, len(text) // 60)):
                edited[rng.randrange(len(edited))] = "edit"
            a, b = (set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (text, edited))
            docs.append((1000 + i, " ".join(edited)))
            if len(a & b) / len(a | b) >= 0.8:
                planted.append((i, 1000 + i))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), scheme=simhash.COPIES).collect()}
    assert len(planted) > 60 and np.mean([found[a] == found[b] for a, b in planted]) >= 0.95
    assert all(found[i] == i for i in range(300))
    kept = simhash.keep_one(odd(spark), scheme=simhash.COPIES).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(odd(spark, []), scheme=simhash.COPIES).count() == 0
