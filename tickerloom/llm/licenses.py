"""License scans in DataFrame functions only: ordered regex rules behind a keyword prefilter.

A text becomes its lower-case words joined by single spaces. Rows without any keyword
skip all rules; the others try only rules whose keyword starts one of their words. A match is marked in the
string before the words are split, so that marks give its first and last word. Detections are
then swept in order of their first word, and one that lies inside a detection of equal or
higher priority is suppressed. It is one projection: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import ascii_lower, read, without
from tickerloom.llm.license_rules import Rule, rules

#: What stands between words, once lower-cased; upper case is dealt with afterwards.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 6
OUTPUTS = ("n_words", "detections", "base_detections", "score")


def _words_joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))


def _keywords(table: list[Rule]) -> list[str]:
    return sorted({r.keyword for r in table})


def _gates(table: list[Rule]) -> list[str]:
    """Strings of which a text with any match holds at least one: "licen" where a pattern can't do without, else the keyword."""
    out = set()
    for r in table:
        fixed, before = r.pattern, None
        while fixed != before:
            fixed, before = re.sub(r"\((?:\?:)?[^()]*\)\?", "", fixed), fixed
        out.add("licen" if "licen" in fixed and "|" not in fixed else f" {r.keyword}")
    return sorted(out)


def _marked(words: Column, test) -> Column:
    return F.array_compact(F.transform(words, lambda w, i: F.when(test(w), i)))


def _detections(words: Column, table: list[Rule]) -> Column:
    """All matches as structs, by first word, longest and highest priority first."""
    keywords = F.array(*[F.lit(k) for k in _keywords(table)])
    literal = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<![^ ])({r.pattern})(?![^ ])").alias("pattern"),
                F.lit(r.base).alias("base"),
            )
            for r in table
        ]
    )
    held = F.filter(keywords, lambda k: F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), k)))
    tried = F.transform(F.array(held), lambda ks: F.filter(literal, lambda r: F.array_contains(ks, r["keyword"])))[0]
    matched = F.filter(tried, lambda r: F.regexp_like(words, r["pattern"]))
    marked = F.transform(
        matched,
        lambda r: F.struct(
            r["label"].alias("label"),
            r["priority"].alias("priority"),
            r["base"].alias("base"),
            F.split(F.regexp_replace(words, r["pattern"], F.lit("\x01$1\x02")), " ").alias("words"),
        ),
    )

    def spans(m: Column) -> Column:
        both = F.arrays_zip(
            _marked(m["words"], lambda w: F.startswith(w, F.lit("\x01"))).alias("first"),
            _marked(m["words"], lambda w: F.endswith(w, F.lit("\x02"))).alias("last"),
        )
        return F.transform(
            both,
            lambda s: F.struct(
                s["first"].alias("start"),
                (-s["last"]).alias("minus_end"),
                (-m["priority"]).alias("minus_priority"),
                m["label"].alias("label"),
                m["base"].alias("base"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(marked, spans)))


SPAN = "array<struct<start:int,end:int,label:string,priority:int>>"
#: Detections that are gathered before they are put aside, so that a long list isn't copied for each of them.
GATHERED = 64


def _swept(found: Column) -> Column:
    """Detections that no earlier one of equal or higher priority contains."""
    none = F.array().cast(SPAN)
    first = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("ends"), none.alias("kept"), F.array().cast(f"array<{SPAN}>").alias("aside"))

    def step(acc: Column, d: Column) -> Column:
        end, level = -d["minus_end"], -d["minus_priority"]
        inside = F.exists(F.slice(acc["ends"], level, LEVELS), lambda e: e >= end)
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == level, F.greatest(e, end)).otherwise(e))
        one = F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), level.alias("priority")))
        full = F.size(acc["kept"]) >= GATHERED
        kept = F.when(inside, acc["kept"]).when(full, one).otherwise(F.concat(acc["kept"], one))
        return F.struct(ends.alias("ends"), kept.alias("kept"), F.when(full & ~inside, F.concat(acc["aside"], F.array(acc["kept"]))).otherwise(acc["aside"]).alias("aside"))

    return F.aggregate(found, first, step, lambda acc: F.concat(F.flatten(acc["aside"]), acc["kept"]))


def scan_licenses(df: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``df`` with n_words, detections, base_detections and score.

    * ``detections``: (start, end, label, priority) by word numbers from 0, after suppression;
      ``base_detections``: (start, label) of every place of a base phrase, never suppressed.
    * ``score``: 1 less the product, over distinct labels left, of 1 - priority / 6; 0 if none.
    * null and empty texts have no words and no detections. Whole texts count. Repeated rows
      each get a row; columns of ``df`` with an output's name are replaced.
    """
    table = rules() if table is None else table
    rows = without(df, *OUTPUTS).select(F.struct("*").alias("__row"), _words_joined(F.col(text)).alias("__joined"))
    none = F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,label:string,base:boolean>>")
    gated = rows.withColumn("__small", F.concat(F.lit(" "), F.lower("__joined"), F.lit(" ")))
    gate = F.lit(False)
    for part in _gates(table):
        gate = gate | F.contains("__small", F.lit(part))
    found = gated.withColumn("__words", F.when(gate, ascii_lower(F.col("__joined")))).withColumn(
        "__found", F.when(F.col("__words").isNotNull(), _detections(F.col("__words"), table)).otherwise(none)
    )
    kept = found.withColumn("__kept", F.when(F.size("__found") > 0, _swept(F.col("__found"))).otherwise(F.array().cast(SPAN)))
    n_words = F.when(F.col("__joined") == "", 0).otherwise(
        F.length("__joined") - F.length(F.replace(F.col("__joined"), F.lit(" "), F.lit(""))) + 1
    )
    base = F.transform(
        F.filter("__found", lambda d: d["base"]), lambda d: F.struct(d["start"].alias("start"), d["label"].alias("label"))
    )
    strengths = F.array_distinct(F.transform("__kept", lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"))))
    score = 1 - F.aggregate(strengths, F.lit(1.0), lambda acc, d: acc * (1 - d["priority"] / 6))
    return kept.select(
        "__row.*",
        n_words.cast("long").alias("n_words"),
        F.col("__kept").alias("detections"),
        base.alias("base_detections"),
        score.alias("score"),
    )


def _labels(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base_detections", lambda d: d["start"].cast("long"))
    of_base = F.transform("base_detections", lambda d: d["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_detections").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(of_base).alias("base_labels"),
        _labels(of_base, F.transform("detections", lambda d: d["label"])).alias("labels"),
        "score",
    )
