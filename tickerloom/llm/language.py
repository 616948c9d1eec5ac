"""Language identification by Bayesian fusion of evidence.

log posterior = text + declaration + suffix + host prior, up to a constant:

* text: log likelihood of the letters' 1- to 3-grams under each language's hashed n-gram model, fitted
  to a bounded sample of labelled rows; n-grams overlap, so it counts for at most ``TEXT_WEIGHT`` of them.
* declaration: how often pages of a language (judged by their text) declare each language in
  their markup, from grouped counts.
* suffix: the same for the last part of the address.
* host prior: shares of a host's pages by language, smoothed towards its domain's, whose are
  smoothed towards those of all pages. Counts are sums of text posteriors by host and by domain,
  and the page's own share is taken out, so that no text counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import cut_lineage, fit_in_task, map_batches, read

BUCKET_BITS = 16
GRAMS = (1, 2, 3)
#: The fit takes about so many labelled rows, none longer than so many code points.
FIT_ROWS = 4_000
FIT_CHARS = 20_000
#: n-grams that a text counts for at most, however long it is.
TEXT_WEIGHT = 60.0
#: Log probability of an n-gram if all were alike.
EVENLY = -BUCKET_BITS * float(np.log(2))
#: Pages by which a level of the prior leans on the level above.
SMOOTHING = 8.0
#: Below this posterior the language is undetermined.
CONFIDENT = 0.6
SEED = 23
STEP_POINTS = 1 << 20
OUTPUTS = ("language", "confidence", "posterior")


def text_buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the letters of a text, lower case, anything else as one space."""
    for at in range(0, len(text), STEP_POINTS):
        points = np.frombuffer(f" {text[at : at + STEP_POINTS].lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        letter = (points >= 0xAA) | ((points >= 97) & (points <= 122))
        points = np.where(letter, points, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        points = points[keep].astype(np.uint64)
        if len(points) < 2:
            continue
        for n in GRAMS:
            last = len(points) - n + 1
            rolled = np.full(max(last, 0), n, np.uint64)
            for k in range(n):
                rolled = (rolled ^ points[k : k + last]) * np.uint64(0xBF58476D1CE4E5B9)
                rolled ^= rolled >> np.uint64(31)
            yield (rolled >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """Log probabilities of n-gram buckets by language.

    A language without any learned n-gram takes the least probability of each bucket that another one has: text is no evidence for it.
    """

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        logs = np.log(smooth / smooth.sum(axis=0))
        learned = counts.any(axis=0)
        if learned.any() and not learned.all():
            logs[:, ~learned] = logs[:, learned].min(axis=1, keepdims=True) - 1.0
        self.logs = logs.astype(np.float32)

    def likelihoods(self, text: str) -> tuple[list[float], int]:
        """Log likelihoods by language, scaled to at most ``TEXT_WEIGHT`` n-grams, and the number of n-grams.

        A text that all languages explain worse than n-grams drawn evenly would, as one in a script that none of them has, is no evidence and counts as
        without n-grams.
        """
        total, n = np.zeros(len(self.languages)), 0
        for found in text_buckets(text):
            total += self.logs[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if n and total.max() < n * EVENLY:
            return [0.0] * len(self.languages), 0
        return (total * (min(1.0, TEXT_WEIGHT / n) if n else 0.0)).tolist(), n


def fit_text_model(docs: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id") -> TextModel:
    """A model of the languages that ``lang`` names.

    Each language is learned from the same number of rows, ``fit_rows`` over the languages and 50 at least (all it has, if
    fewer), drawn by a hash of id and text. Rows without text or language aren't learned from, texts of over
    ``fit_chars`` code points only where a language has none shorter, and then by so many of their code points; every language that a row names is known.
    """
    ids = [F.col(id_col).alias("id")] if id_col in docs.columns else []
    named = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), *ids)
    short = F.length("text") <= fit_chars
    # a row a language
    sizes = named.groupBy("lang").agg(F.count(F.when(short, 1)).alias("rows"), F.count("text").alias("texts")).collect()
    counts = {r["lang"]: r["rows"] or r["texts"] for r in sizes}
    long = [r["lang"] for r in sizes if not r["rows"]]
    known = named.filter(short | (F.col("lang").isin(long) & F.col("text").isNotNull())).withColumn("text", F.substring("text", 1, fit_chars)) if long else named.filter(short)
    each = max(50, fit_rows // max(len(counts), 1))
    # about twice as many are drawn as wanted, and ranked: no copies of a text or row can outgrow the bound
    places = F.xxhash64(F.lit(SEED), *[c for c in ("id", "text") if c in known.columns])
    share = F.create_map(*[x for name, rows in counts.items() for x in (F.lit(name), F.lit(int(min(1.0, 2 * each / max(rows, 1)) * (1 << 60))))]) if counts else F.create_map(F.lit(""), F.lit(0))
    drawn = known.filter(F.shiftrightunsigned(places, 4) < F.element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy(places, "text")
    some = drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("lang", "text")

    every = list(counts)

    def fit(columns: dict[str, list]) -> TextModel:
        languages = sorted(every)
        counts = np.zeros((1 << BUCKET_BITS, max(len(languages), 1)))
        for name, value in zip(columns["lang"], columns["text"], strict=True):
            for found in text_buckets(value):
                counts[:, languages.index(name)] += np.bincount(found, minlength=1 << BUCKET_BITS)
        return TextModel(languages or ["und"], counts)

    return fit_in_task(some, fit)


def _softmax(logs: np.ndarray) -> np.ndarray:
    """Shares that rows of log weights stand for."""
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _leaned(sums: np.ndarray, own: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Shares of counts, less the row's own share, smoothed towards ``above``; rounding may leave less than nothing."""
    rest = np.maximum(sums - own, 0)
    return (rest + SMOOTHING * above) / (rest.sum(axis=1, keepdims=True) + SMOOTHING)


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """A column of arrays of n numbers as a matrix; null arrays are rows of not-a-number."""
    out = np.full((len(column), n), np.nan)
    held = column.is_valid().to_numpy(zero_copy_only=False)
    out[held] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)]


def _array(n: int, prefix: str = "s") -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(n)])


def text_likelihoods(df: DataFrame, model: TextModel, text: str) -> DataFrame:
    """``df`` with __logs and __own (log likelihoods and shares by language) and __grams."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.likelihoods(t or "") for t in batch.column(at).to_pylist()]
            if not found:
                continue
            logs = np.array([f[0] for f in found])
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (logs, _softmax(logs))]
            grams = pa.array([f[1] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, grams], names=[*batch.schema.names, "__logs", "__own", "__grams"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return map_batches(df, run, ", ".join([*fields, "__logs array<double>", "__own array<double>", "__grams long"]))


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """(key columns, language, confidence, posterior) from rows with __logs, declared, suffix, domain and host.

    Null declarations, suffixes, domains and hosts say nothing. ``evidence`` is read several times.
    """
    n = len(languages)
    rows = evidence
    everything = rows.agg(*_sums("__own", n)).first()
    overall = [float(everything[i] or 0) for i in range(n)]
    total = sum(overall) or 1.0
    base = [(x + 1.0) / (total + n) for x in overall]

    def conditional(column: str) -> DataFrame:
        """P(value | language), smoothed over the values and one unseen one; grouped sums first."""
        by = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*_sums("__own", n))
        whole = by.agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(n)], F.count("*").alias("__values"))
        return by.crossJoin(F.broadcast(whole)).select(  # one row of totals
            column,
            F.array(*[F.log((F.col(f"s{i}") + 0.5) / (F.col(f"t{i}") + 0.5 * (F.col("__values") + 1))) for i in range(n)]).alias(f"__{column}_logs"),
        )

    hosts = rows.filter(F.col("host").isNotNull()).groupBy("host", "domain").agg(*_sums("__own", n))
    hosts = cut_lineage(hosts)
    domains = hosts.groupBy(F.col("domain").alias("__d")).agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    priors = hosts.join(domains, F.equal_null(F.col("domain"), F.col("__d")), "left").select(
        F.col("host").alias("__host"), F.col("domain").alias("__domain"), _array(n).alias("__host_sums"), _array(n, "d").alias("__domain_sums")
    )
    joined = (
        rows.join(priors, (F.col("host") == F.col("__host")) & F.equal_null(F.col("domain"), F.col("__domain")), "left")
        .join(conditional("declared"), "declared", "left")
        .join(conditional("suffix"), "suffix", "left")
    )
    parts = ["__logs", "__own", "__host_sums", "__domain_sums", "__declared_logs", "__suffix_logs"]
    keys = [c for c in evidence.columns if c not in parts]
    whole = np.array(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logs, own, host, domain, declared, suffix = (_rows(batch.column(c), n) for c in parts)
            by_domain = _leaned(np.where(np.isnan(domain), own, domain), own, whole)
            prior = _leaned(np.where(np.isnan(host), own, host), own, by_domain)
            post = _softmax(logs + np.log(prior) + np.nan_to_num(declared) + np.nan_to_num(suffix))
            best = post.max(axis=1)
            sure = (best >= CONFIDENT) & (batch.column("__grams").to_numpy() > 0)
            named = np.where(sure, np.array(languages, object)[post.argmax(axis=1)], "und")
            made = [pa.array(named.tolist(), pa.string()), pa.array(best), pa.array(list(post), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *made], names=[*keys, "language", "confidence", "posterior"])

    kinds = {f.name: f.dataType.simpleString() for f in evidence.schema.fields}
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "language string", "confidence double", "posterior array<double>"])
    return map_batches(joined.select(*keys, *parts), run, out)


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments, tags and named or numbered characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> list[Column]:
    """declared, suffix, host and domain of a page, each null if there is none."""
    none = F.lit(None).cast("string")
    blank = lambda c: F.when(c == "", none).otherwise(c)
    tag = F.regexp_extract(F.col(html), r"(?is)<html\b([^>]*)>", 1)
    declared = blank(F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)))
    host = blank(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)))
    suffix = blank(F.regexp_extract(host, r"\.([^.]+)$", 1))
    domain = blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    return [declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain")]


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, language, confidence, posterior, declared, suffix, host) for every page.

    * language is "und" if the posterior is below ``CONFIDENT`` or the page has no letters, or only such as no language has; then the
      other evidence still gives the posterior. Null pages and addresses are pages without that
      evidence; repeated rows each give a row and each count in the grouped sums.
    * ties go to the first language by name. Whole texts count. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("__id"), page_text(F.col(html)).alias("__text"), *page_evidence(pages, url, html))
    narrow = cut_lineage(text_likelihoods(rows, model, "__text").drop("__text"))
    return fuse(narrow, model.languages).select(
        F.col("__id").alias(id_col), "language", "confidence", "posterior", "declared", "suffix", "host"
    )


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text: str = "text", source: str = "source", declared: str = "lang") -> DataFrame:
    """(id, language, confidence) for documents: their source is the host, their declared language the markup's.

    A source's name up to its digits is the domain. Nulls, ties and repeats as for pages.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.lower(F.col(declared).cast("string")).alias("declared"),
        none.alias("suffix"), F.col(source).cast("string").alias("host"),
        F.regexp_extract(F.col(source).cast("string"), r"^(\D*)", 1).alias("domain"),
    )
    narrow = cut_lineage(text_likelihoods(rows, model, "__text").drop("__text"))
    return fuse(narrow, model.languages).select(F.col("__id").alias(id_col), "language", "confidence", "__grams")


def op3(spark, sf_dir: str) -> DataFrame:
    model = fit_text_model(read(spark, sf_dir, "documents"))
    found = identify_pages(read(spark, sf_dir, "pages"), model)
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "declared", "suffix", "host")
