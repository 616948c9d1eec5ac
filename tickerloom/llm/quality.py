"""A quality classifier of supervised subword embeddings.

A word is the sum of hashed vectors of itself and of its character 3- to 5-grams; a document is
the mean over its words and hashed word pairs, and a softmax over two classes gives the score.
The vectors are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. A pair of equal words counts as one pair whatever the word, so repetition can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import about, fit_in_task, map_batches, read
from tickerloom.llm.pretokens import Numbers, ragged

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM = 12
GRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.4
SEED = 11
#: The fit takes about so many labelled rows, none longer than so many code points.
FIT_ROWS = 3_000
FIT_CHARS = 20_000
#: The bound of the sample, in times of FIT_ROWS.
MOST_TIMES = 4
#: Texts whose features are made at a time.
FIT_STEP = 50
THRESHOLD = 0.7
#: Words that a worker remembers.
CACHE_WORDS = 400_000
CHUNK_WORDS = 100_000
#: Code points whose new words are learned together.
STEP_CHARS = 1 << 18


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, with marks at both ends; and how many each word has.

    The first bucket of a word is that of the word itself.
    """
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[owner]
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    found = [np.add.reduceat((points + np.uint64(1)) * powers[place], starts)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        last = len(points) - n + 1
        if last > 0:
            at = np.flatnonzero(place[:last] + n <= sizes[owner[:last]])
            rolled = np.full(len(at), n, np.uint64)
            for k in range(n):
                rolled = (rolled ^ points[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
                rolled ^= rolled >> np.uint64(31)
            found.append(rolled)
            owners.append(owner[at])
    every, owners = np.concatenate(found), np.concatenate(owners)
    every ^= every >> np.uint64(29)
    every *= np.uint64(0x94D049BB133111EB)
    buckets = (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


class WordTable:
    """Numbers of words, and the features of new ones."""

    def __init__(self) -> None:
        self.number = Numbers()

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def learn(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of the words that are new since the last call."""
        words, self.number.new = self.number.new, []
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return word_features(words)


def pair_features(first: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the buckets of the words; one for any two equal words."""
    a, b = first[:-1].astype(np.uint64), first[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return np.where(a == b, 1, mixed % np.uint64(BUCKETS)).astype(np.int64)


def document_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares, as 32-bit numbers."""
    table, out = WordTable(), []
    numbers = [table.numbers(t.split()) for t in texts]
    flat, lengths = table.learn()
    starts = np.cumsum(lengths) - lengths
    for own in numbers:
        if not len(own):
            out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        words, counts = np.unique(own, return_counts=True)
        n = lengths[words]
        pairs = pair_features(flat[starts[own]])
        every = np.concatenate([ragged(flat, starts[words], n), pairs])
        ids, back = np.unique(every, return_inverse=True)
        sums = np.bincount(back, np.concatenate([np.repeat(counts / n, n), np.ones(len(pairs))]))
        out.append((ids.astype(np.int32), (sums / sums.sum()).astype(np.float32)))
    return out


class Model:
    """Embeddings (buckets x dim) and the output layer (dim x 2)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.output = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
        """Stochastic gradient descent on the log loss; the rate falls linearly to 0."""
        rows = [row for at in range(0, len(texts), FIT_STEP) for row in document_features(texts[at : at + FIT_STEP])]
        rng, step, steps = np.random.default_rng(seed), 0, max(1, epochs * len(rows))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, shares = rows[i]
                now = np.float32(rate * (1 - step / steps))
                step += 1
                own = self.vectors[ids]
                hidden = shares @ own if len(ids) else np.zeros(DIM, np.float32)
                logits = hidden @ self.output + self.bias
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[labels[i]] -= 1
                back = self.output @ error
                self.output -= now * np.outer(hidden, error)
                self.bias -= now * np.float32(0.1) * error
                if len(ids):
                    # shares are small: a bucket's step is scaled to that of a word-sized share
                    self.vectors[ids] = own - now * np.minimum(shares * 20, 1)[:, None] * back
        return self

    def score(self, hidden: np.ndarray) -> float:
        logits = hidden.astype(np.float64) @ self.output + self.bias
        return float(1 / (1 + np.exp(np.clip(logits[0] - logits[1], -60, 60))))


class Scorer:
    """Scores texts; remembers the summed vectors of words."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.table = WordTable()
        self.sums = np.zeros((1 << 16, DIM), np.float32)
        self.first = np.zeros(1 << 16, np.int64)
        self.known = 0

    def _learn(self) -> None:
        flat, lengths = self.table.learn()
        if not len(lengths):
            return
        to = self.known + len(lengths)
        while to > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        starts = np.cumsum(lengths) - lengths
        self.sums[self.known : to] = np.add.reduceat(self.model.vectors[flat], starts, axis=0) / lengths[:, None]
        self.first[self.known : to] = flat[starts]
        self.known = to

    def scores(self, texts: list[str]) -> list[float]:
        """Scores of texts; new words of all of them are learned together."""
        out: list[float] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= STEP_CHARS):
                size += len(texts[to])
                to += 1
            if self.known > CACHE_WORDS:
                self._forget()
            numbers = [self.table.numbers(t.split()) for t in texts[at:to]]
            self._learn()
            for own in numbers:
                total, count = np.zeros(DIM, np.float64), 0
                for lo in range(0, len(own), CHUNK_WORDS):
                    part = own[lo : lo + CHUNK_WORDS]
                    pairs = pair_features(self.first[own[max(lo - 1, 0) : lo + CHUNK_WORDS]])
                    total += self.sums[part].sum(axis=0)
                    total += self.model.vectors[pairs].sum(axis=0)
                    count += len(part) + len(pairs)
                out.append(self.model.score(total / max(count, 1)))
            at = to
        return out


def held_out(id_text: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, mod 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(id_text.cast("string")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id") -> Model:
    """A model of ``labels`` (id, quality 0 or 1) outside the held-out fold.

    The sample is bounded: about ``fit_rows`` labelled rows, chosen by a hash of their id, whose texts
    have at most ``fit_chars`` code points; however often ids repeat, at most ``MOST_TIMES`` as many go into the fit. Rows without label, id or text are left out; without
    any labelled row the model scores 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__quality")
    )
    total = known.count()
    some = known.filter(about(fit_rows / max(total, 1), SEED, "__id")).limit(MOST_TIMES * fit_rows)
    texts = docs.filter(F.length("text") <= fit_chars).select(F.col(id_col).alias("__id"), "text")
    # as many rows as the sample is bounded to
    rows = texts.join(F.broadcast(some), "__id").limit(MOST_TIMES * fit_rows)

    def fit(columns: dict[str, list]) -> Model:
        order = sorted(range(len(columns["__id"])), key=lambda i: (columns["__id"][i], columns["__quality"][i], columns["text"][i]))
        return Model().fit([columns["text"][i] for i in order], np.array([columns["__quality"][i] for i in order], np.int64))

    return fit_in_task(rows, fit)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, the probability of label 1.

    Null and empty texts get the score of an empty document; whole texts are scored; repeated rows
    get equal scores; a column named quality_score is replaced, others are kept.
    """
    kept = docs.select(*[c for c in docs.columns if c.lower() != "quality_score"])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return map_batches(kept, run, ", ".join([*fields, "quality_score double"]))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_model(docs, read(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
