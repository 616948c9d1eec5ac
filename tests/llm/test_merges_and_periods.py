"""BPE by merge rounds against the tokenizers library, and periodic runs against brute force."""

import hashlib
import json
import random

import numpy as np
import pytest

from tickerloom.llm import merges, periods, registry, token_store
from tests.llm.test_operators import ODD, SF, odd


def library(path=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or token_store.default_tokenizer())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def wild_texts(n=1500):
    rng = random.Random(1)
    letters = "abcXYZ  \n\t'sté漢字\x1c\x85   0123٣½🙂-_.,‍́"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(n)]
    long = ["x" * 5000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(100_000)), "é" * 4000, " " * 5000]
    return some + long + ["", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", "<|endoftext", " \n <|endoftext|> x"]


def test_merges_are_the_librarys():
    encoder, other = merges.MergeEncoder(token_store.default_tokenizer()), library()
    table, texts = merges.IdBytes(encoder.names), wild_texts()
    for text, ids in zip(texts, token_store._encoded(texts, encoder), strict=True):
        wanted = other.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert table.text(ids).decode() == other.decode(wanted, skip_special_tokens=False) == text


def test_decoding_of_any_ids():
    """Broken UTF-8 and ids beyond the vocabulary."""
    encoder, other, rng = merges.MergeEncoder(token_store.default_tokenizer()), library(), np.random.default_rng(5)
    table = merges.IdBytes(encoder.names)
    for _ in range(200):
        ids = rng.integers(0, 50_400, 30)
        assert table.text(ids).decode() == other.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("cache", [0, 40])
def test_forgetting_changes_nothing(monkeypatch, cache):
    monkeypatch.setattr(merges, "CACHE_WORDS", cache)
    monkeypatch.setattr(merges, "ROUND_SYMBOLS", 64)
    encoder, other, texts = merges.MergeEncoder(token_store.default_tokenizer(), cache=cache), library(), wild_texts(60)
    for text in texts:
        assert encoder.encode_long(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_ranks_that_do_not_rise(tmp_path):
    """A vocabulary in which a pair outranks the merge that makes one of its symbols, and a pair listed twice."""
    letters = merges.byte_characters()
    pairs = [("ab", "a"), ("a", "b"), ("b", "b"), ("a", "a"), ("aa", "b"), ("aba", "b"), ("a", "b"), ("aab", "aa")]
    tokens = dict.fromkeys([*letters, *(x + y for x, y in pairs)])
    whole = json.load(open(token_store.default_tokenizer()))
    whole["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": pairs}
    whole["added_tokens"] = []
    path = str(tmp_path / "small.json")
    json.dump(whole, open(path, "w"))
    encoder, other, rng = merges.MergeEncoder(path), library(path), random.Random(2)
    assert not encoder.merges.rising
    for _ in range(300):
        text = "".join(rng.choice("aab b") for _ in range(rng.randint(0, 40)))
        assert encoder.encode_long(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    whole = json.load(open(token_store.default_tokenizer()))
    whole["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "odd.json")
    json.dump(whole, open(path, "w"))
    with pytest.raises(ValueError):
        merges.MergeEncoder(path)


def test_documents_round_trip(spark):
    encoded = merges.encode_documents(odd(spark))
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    other = library()
    wanted = sorted((str(i), (t or ""), len(other.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    rows = merges.decode_documents(encoded.withColumn("Decoded", encoded.n_tokens)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"], r["n_tokens"]) for r in rows) == wanted
    none = encoded.selectExpr("doc_id", "cast(null as binary) as ids").limit(1)
    assert merges.decode_documents(none).first()["decoded"] is None
    assert merges.encode_documents(odd(spark, [])).count() == 0
    assert merges.decode_documents(encoded.limit(0)).count() == 0


def test_op11(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op11_merge_rounds"](spark, SF).collect()}
    other, docs = library(), spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = other.encode(d["text"] or "", add_special_tokens=False).ids
        text = other.decode(ids, skip_special_tokens=False)
        assert found[d["doc_id"]] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))


# periodic runs


def brute_runs(w, least=12):
    """By the definition: every stretch of every period, its smallest period by trial."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                own = w[i : i + length]
                if not any(all(own[x] == own[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + length for s, length, p in runs)]


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 90)
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            length = rng.randint(1, n - a)
            w[a : a + length] = [w[a + i % p] if a + i % p < n else 0 for i in range(length)]
    return w


@pytest.mark.parametrize("heavy", [0.0, 0.25, 100.0])
@pytest.mark.parametrize("near", [1, 3, 32])
def test_runs_against_brute_force(monkeypatch, heavy, near):
    monkeypatch.setattr(periods, "NEAR", near)
    rng = random.Random(3)
    for _ in range(500):
        w = some_words(rng)
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        codes = np.array([number[x] for x in w], np.int64)
        for least in (2, 12):
            runs = periods.runs_of(codes, least, heavy)
            assert runs == brute_runs(w, least)
        assert [w[i] for i in np.flatnonzero(periods.kept_words(len(w), runs))] == brute_kept(w, runs)


@pytest.mark.parametrize("heavy", [0.0, 0.25, 100.0])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1000])
def test_lag_counts_are_exact(n, heavy):
    codes = np.random.default_rng(n).integers(0, 1 + n // 9, n)
    codes = np.unique(codes, return_inverse=True)[1] if n else codes
    wanted = [0] + [int((codes[:-q] == codes[q:]).sum()) for q in range(1, n // 2 + 1)]
    assert periods.lag_counts(codes, heavy).tolist() == wanted


def test_long_repeats_stay_quick():
    """A million equal words, and half a million words of period 2 before random ones: multiples of a period aren't scanned."""
    n = 200_000
    assert periods.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    codes = np.concatenate([np.arange(n // 2) % 2, 2 + np.random.default_rng(1).integers(0, 9, n // 2)])
    assert (0, n // 2, 2) in periods.runs_of(codes)


def test_runs_of_odd_rows(spark):
    rows = [*ODD, (8, "a b\tc " * 5, "s", "t", "u", "v"), (9, "x" + " x" * 11, "s", "t", "u", "v"), (9, "é\x1cé " * 20, "s", "t", "u", "v")]
    docs = odd(spark, rows).withColumnRenamed("row", "Runs").withColumnRenamed("size", "start")
    found = periods.periodic_runs(docs)
    assert found.columns == ["doc_id", "source", "start", "taken", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    wanted = []
    for name, text, *_ in rows:
        w = (text or "").encode().split()
        few = [(0, len(w), 1)] if len(w) > 1000 else brute_runs(w)
        wanted.append((str(name), len(w), few, b" ".join(w[:1] if len(w) > 1000 else brute_kept(w, few)).decode()))
    assert got == sorted(wanted)
    assert periods.periodic_runs(odd(spark, [])).count() == 0


def test_op13(spark):
    found = {r["doc_id"]: r.asDict() for r in registry.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((d["text"] or "").split()) < 700]
    assert sum(found[d["doc_id"]]["n_runs"] > 0 for d in docs) > 5
    for d in docs:
        w = periods.planted(d["doc_id"], (d["text"] or "").encode().split())
        runs = brute_runs(w)
        row = found[d["doc_id"]]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
        assert row["collapsed_sha256"] == sha(b" ".join(brute_kept(w, runs)))


def test_planted_words():
    import zlib

    words = [b"%d" % i for i in range(100)]
    name = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(name).encode()) // 10
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert periods.planted(name, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert periods.planted(None, words) == words and periods.planted(name, []) == []
