"""Runs of words that repeat with a period, found by counting matches at each lag.

At lag q a place matches if the word q further on is the same. A run of smallest period q and length l is an
island of l - q matches in a row, so only lags with at least max(least - q, q) matches can hold one.

Matches are counted exactly: for words that are frequent in a text (heavy) as the autocorrelation of their places, by FFT and
rounded; for the others (light) from the differences of their places. From a lag's count the matches inside runs already found, of periods that
divide it, are taken off: no run of smallest period q has any of them, since a stretch of q words with a period that
divides q would give that period to the whole run. Only lags that still have enough are scanned for islands.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import map_batches, read, without

#: Shortest run, in words.
LEAST = 12
#: A word is heavy if its squared frequency is above so many times n log2 n.
HEAVY = 0.25
#: Places on each side that are looked at before a lag is scanned.
NEAR = 32


def lag_counts(codes: np.ndarray, heavy: float = HEAVY) -> np.ndarray:
    """Exact numbers of matches at the lags 0 to n // 2 (0 at lag 0); ``codes`` are 0, 1, ... by word."""
    n = len(codes)
    top = n // 2
    counts = np.zeros(top + 1, np.int64)
    if top < 1:
        return counts
    often = np.bincount(codes)
    limit = max(4.0, (heavy * n * np.log2(n)) ** 0.5)
    spectrum, size = None, 1 << int(n + top).bit_length()  # long enough that no pair wraps round to a counted lag
    for word in np.flatnonzero(often > limit):
        found = np.fft.rfft((codes == word).astype(np.float64), size)
        power = found.real**2 + found.imag**2
        spectrum = power if spectrum is None else spectrum + power
    if spectrum is not None:
        exact = np.fft.irfft(spectrum, size)[: top + 1]
        counts += np.rint(exact).astype(np.int64)
    place = np.flatnonzero(often[codes] <= limit)
    place = place[np.argsort(codes[place], kind="stable")]
    word = codes[place]
    left = np.arange(len(place))
    for step in range(1, int(min(limit, often.max())) + 1):  # each with its step-th next place of the same word
        left = left[: np.searchsorted(left, len(place) - step)]
        left = left[word[left] == word[left + step]]
        if not len(left):
            break
        lags = place[left + step] - place[left]
        near = lags <= top
        counts += np.bincount(lags[near], minlength=top + 1)
        left = left[near]  # places further on are further still
    counts[0] = 0
    return counts


def _may_hold(codes: np.ndarray, lag: int, least: int, known: list[tuple[int, int]]) -> bool:
    """Whether an island of at least ``least`` matches may start outside the stretches ``known``; looks at every ``least``-th place, one of which an island must hold."""
    n = len(codes) - lag
    at = np.arange(least - 1, n, least)
    at = at[codes[at] == codes[at + lag]]
    for start, end in known:
        at = at[(at < start) | (at >= end)]
    reach = min(least, NEAR)
    length = np.ones(len(at), np.int64)
    for way in (1, -1):
        going = np.arange(len(at))
        for step in range(1, reach):
            place = at[going] + way * step
            inside = (place >= 0) & (place < n)
            going, place = going[inside], place[inside]
            going = going[codes[place] == codes[place + lag]]
            if not len(going):
                break
            length[going] += 1
    return bool((length >= reach).any())


def islands(codes: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of at least ``least`` matches in a row at a lag."""
    broken = np.flatnonzero(codes[:-lag] != codes[lag:])
    borders = np.concatenate([[-1], broken, [len(codes) - lag]])
    length = np.diff(borders) - 1
    good = np.flatnonzero(length >= least)
    return borders[good] + 1, length[good]


def runs_of(codes: np.ndarray, least: int = LEAST, heavy: float = HEAVY) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    if len(codes) < least:
        return []
    counts = lag_counts(codes, heavy)
    lags = np.arange(len(counts))
    need = np.maximum(least - lags, lags)
    need[0] = len(codes) + 1
    found: dict[int, list[tuple[int, int]]] = {}
    waiting = counts >= need
    lag = 0
    while True:
        rest = np.flatnonzero(waiting[lag + 1 :])
        if not len(rest):
            break
        lag += 1 + int(rest[0])
        known = [(start, start + length - lag) for p, own in found.items() if lag % p == 0 for start, length in own if length > lag]
        if not _may_hold(codes, lag, int(need[lag]), known):
            continue
        starts, lengths = islands(codes, lag, int(need[lag]))
        for start, length in zip(starts.tolist(), (lengths + lag).tolist(), strict=True):
            if any(_covers(own, start, length) for p, own in found.items() if lag % p == 0 and p < lag):
                continue
            found.setdefault(lag, []).append((start, length))
            multiples = np.arange(2 * lag, min(length, len(counts)), lag)
            if len(multiples):
                counts[multiples] -= length - multiples
                waiting[multiples] = counts[multiples] >= need[multiples]
    return sorted((start, length, p) for p, own in found.items() for start, length in own)


def _covers(own: list[tuple[int, int]], start: int, length: int) -> bool:
    """Whether one of some runs of one period, by start, holds a stretch."""
    lo, hi = 0, len(own)
    while lo < hi:
        mid = (lo + hi) // 2
        if own[mid][0] <= start:
            lo = mid + 1
        else:
            hi = mid
    return lo > 0 and own[lo - 1][0] + own[lo - 1][1] >= start + length


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    least: int = LEAST,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` without ``text``, and n_words, runs (start, length, period) by start then period, and collapsed: the words that stay, joined by one space.

    * words are runs of anything but ASCII white space, numbered from 0. A run is a stretch with smallest period p, at least
      max(``least``, 2 p) long, that no neighbouring word extends; runs may overlap. All are returned, whatever the length of a text.
    * a word goes if any run holds it after that run's first p words. Null and empty texts have no words, no runs and an empty ``collapsed``.
    * repeated rows and null ids are rows like others; columns named like outputs are replaced. An empty table gives no rows.
    * ``edit`` changes the words of a row, given its id, before they are looked at.
    """
    kept = without(docs, text, "n_words", "runs", "collapsed")
    names = kept.columns
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, starts, lengths, periods, ends, collapsed = [], [], [], [], [0], []
            for name, found in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1), strict=True):
                words = found.as_buffer().to_pybytes().split()
                if edit:
                    words = edit(name, words)
                number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                runs = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least)
                totals.append(len(words))
                for start, length, period in runs:
                    starts.append(start)
                    lengths.append(length)
                    periods.append(period)
                ends.append(len(starts))
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                collapsed.append(b" ".join(words).decode())
            fields = [pa.field(k, pa.int64()) for k in ("start", "length", "period")]
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], fields=fields)
            columns = [pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, "n_words", "runs", "collapsed"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return map_batches(rows, run, ", ".join([*schema, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"]))


def planted(name: object, words: list[bytes]) -> list[bytes]:
    """The words of a text with the repeat that its id asks for; null ids ask for none."""
    h = zlib.crc32(str(name).encode())
    n, g = len(words), h // 10
    if name is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), edit=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("__best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("__best.start")).alias("start"), F.col("__best.length").alias("length"), (-F.col("__best.period")).alias("period"),
        F.floor(1000 * F.col("__best.length") / -F.col("__best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
