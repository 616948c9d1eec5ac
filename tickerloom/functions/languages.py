"""Language of news texts by common words and scripts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.text import let, tokens

#: A few of the commonest words of each language.
COMMON = {
    "de": ["der", "die", "und", "das", "nicht", "mit", "von", "ist"],
    "en": ["the", "and", "of", "to", "in", "is", "for", "that"],
    "es": ["el", "la", "de", "que", "los", "las", "una", "por"],
    "fr": ["le", "les", "des", "et", "une", "est", "dans", "pour"],
}
#: Characters that only one language's script has.
SCRIPTS = {"ja": r"[\x{3040}-\x{30FF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "zh": r"[\x{4E00}-\x{9FFF}]"}
#: Languages of the Asia-Pacific region.
APAC = ["ja", "ko", "zh", "th", "vi", "id", "hi"]
#: Variants that count as one language.
VARIANTS = {"zh-cn": "zh", "zh-tw": "zh"}
SHORT, SURE, LEAST = 20, 0.8, 0.5


def detect(text: Column) -> Column:
    """(language, confidence). A script of its own decides at 1; else the share of a language's common words among all such words.

    Fewer than 20 characters, or no common word, is English at 0. Ties go to the first language by name.
    """

    def counted(words: Column) -> Column:
        return F.array(*[F.struct(F.size(F.filter(words, _among(own))).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, own) in enumerate(COMMON.items())])

    def decided(hits: Column) -> Column:
        total, best = F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"]), F.array_max(hits)
        return F.when(total > 0, F.struct(best["name"].alias("language"), (best["n"] / total).alias("confidence"))).otherwise(F.struct(F.lit("en").alias("language"), F.lit(0.0).alias("confidence")))

    out = let(let(tokens(F.coalesce(text, F.lit(""))), counted), decided)  # a text is cut into words once
    for name, pattern in reversed(SCRIPTS.items()):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.lit(name).alias("language"), F.lit(1.0).alias("confidence"))).otherwise(out)
    return F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < SHORT, F.struct(F.lit("en").alias("language"), F.lit(0.0).alias("confidence"))).otherwise(out)


def _among(words: list[str]):
    return lambda w: w.isin(words)


def best_of(title: Column, content: Column) -> Column:
    """What the content says if it is sure enough, else the surer of title and content (of equals, the content)."""
    return F.when((content["confidence"] >= SURE) | (content["confidence"] >= title["confidence"]), content).otherwise(title)


def or_fallback(found: Column, fallback: Column) -> Column:
    return F.when(found["confidence"] < LEAST, fallback).otherwise(found["language"])


def is_apac(language: Column) -> Column:
    return language.isin(APAC)


def canonical(code: Column) -> Column:
    """A declared code in lower case, variants as one."""
    out = F.lower(F.trim(code))
    for variant, name in VARIANTS.items():
        out = F.when(F.lower(F.trim(code)) == variant, name).otherwise(out)
    return out
