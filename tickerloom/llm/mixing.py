"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key. Rows are dealt by (source, range of the key), so that a
source with a third of all rows is spread over thousands of key ranges; sums of the ranges
give each range the count before it, and a running sum inside a range completes the prefix
sum. A source takes whole epochs while its target allows and then the rows, in key order,
that the rest of the target covers; the row on the cut is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import BROADCAST_IDS, WORD, cut_lineage, read, without

#: 3 hex digits: ranges of the key in each source.
RANGES = 4096
OUTPUTS = ("source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str, *cols: Column) -> Column:
    """60 bits of an MD5: the same in every run, on every cluster and in other SQL engines."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """Never null: nulls are a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """Targets by source for (source_key, source_size): one row a source.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` times
    the total. A target stops at ``max_epochs`` times its source; what is over goes to the
    others by weight. That ends where one level times the weight holds for all sources below
    their cap, and the level follows from prefix sums over sources ordered by cap / weight.
    An empty source has target 0.
    """
    order = Window.orderBy(F.col("source_key").startswith("n"), F.substring("source_key", 2, 1 << 30))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = sizes.withColumn("__rank", F.row_number().over(order)).withColumn(
        "__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1))
    )
    ranked = ranked.withColumn("__cap", cap).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    full = Window.orderBy("__ratio", "__rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    ) / F.sum("__weight").over(after)
    leveled = ranked.withColumn("__level", level)
    open_level = F.max(F.when(F.col("__level") < F.col("__ratio"), F.col("__level"))).over(whole)
    target = F.when(F.col("__level") >= F.col("__ratio"), F.col("__cap")).otherwise(F.col("__weight") * open_level)
    return leveled.withColumn("target", target).select("source_key", "source_size", "target")


def mix_sources(
    df: DataFrame,
    source: str = "source",
    size: str = "size",
    key: tuple[str, ...] = ("doc_id",),
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1",
    ranges: int = RANGES,
) -> DataFrame:
    """All rows of ``df`` with source_size, target (of its source) and taken.

    * ``taken`` counts the units of a row that the mix takes, repeats included; it is at most
      ``max_epochs`` times the size, and a source's sum is its target rounded to a whole unit.
    * null source: a source of its own, last in order. Null size: 0, and nothing is taken.
    * rows with equal keys are ordered by size; equal rows can't be told apart, and each of
      them counts. An empty table gives no rows.
    * columns of ``df`` named source_size, target or taken are replaced; others are kept.
    """
    if ranges & (ranges - 1):
        raise ValueError("ranges must be a power of two")
    bits = 60 - (ranges.bit_length() - 1)
    rows = without(df, *OUTPUTS).select(
        F.struct("*").alias("__row"),
        _source_key(F.col(source)).alias("source_key"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"),
        random_key(seed, *[F.col(k) for k in key]).alias("__key"),
    ).withColumn("__range", F.shiftright("__key", bits))
    sums = rows.groupBy("source_key", "__range").agg(F.sum("__size").alias("__sum"))
    totals = source_targets(
        sums.groupBy("source_key").agg(F.sum("__sum").alias("source_size")), weights, share, max_epochs
    )
    up_to = Window.partitionBy("source_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select("source_key", "__range", (F.sum("__sum").over(up_to) - F.col("__sum")).alias("__start")).join(
        totals, "source_key"
    )
    inside = (
        Window.partitionBy("source_key", "__range").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = rows.join(starts, ["source_key", "__range"]).withColumn(
        "__before", F.col("__start") + F.sum("__size").over(inside) - F.col("__size")
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = F.col("__budget") - F.col("__epochs") * F.col("source_size")
    taken = F.col("__epochs") * F.col("__size") + F.least(
        F.col("__size"), F.greatest(F.lit(0), rest - F.col("__before"))
    )
    return (
        placed.withColumn("__budget", budget)
        .withColumn("__epochs", epochs.cast("long"))
        .select("__row.*", "source_size", "target", taken.cast("long").alias("taken"))
    )


def times_taken(size: Column, taken: Column) -> Column:
    """How often a row is taken whole: the one on a source's cut counts once more if at least half of it is inside the budget."""
    return F.when(size > 0, F.floor(taken / size + F.lit(0.5))).otherwise(0).cast("int")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The training rows of a mix: each row of ``docs`` as often as it is taken, whole.

    The mix works on ids and sizes; texts meet only the number of copies, by id and a hash of the
    text, and are shuffled only if that table has more than ``BROADCAST_IDS`` rows. Equal rows (by id and text) share
    their copies evenly; what is left over are copies of one of them. Rows without words aren't taken.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("__id"), mark.alias("__mark"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    mixed = mix_sources(narrow, key=("__id", "__mark"))
    copies = cut_lineage(
        mixed.groupBy("__id", "__mark").agg(F.sum(times_taken(F.col("size"), F.col("taken"))).alias("__all"), F.count("*").alias("__rows"))
        .select("__id", "__mark", F.floor(F.col("__all") / F.col("__rows")).cast("int").alias("__times"), (F.col("__all") % F.col("__rows")).cast("int").alias("__left"))
    )
    on = F.equal_null(F.col(id_col), F.col("__id")) & (mark == F.col("__mark"))

    def taken(wanted: DataFrame) -> DataFrame:
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return docs.join(F.broadcast(wanted) if few else wanted, on)

    names = [f"`{c}`" for c in docs.columns]
    whole = taken(copies.filter("__times > 0")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
    left = copies.filter("__left > 0")
    if not left.limit(1).count():
        return whole
    one = taken(left).select("__id", "__mark", "__left", F.struct(*[docs[c] for c in docs.columns]).alias("__row")).groupBy("__id", "__mark", "__left").agg(F.any_value("__row").alias("__row"))
    more = one.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__left")))).select(*[f"__row.{c}" for c in names])
    return whole.union(more)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT *, ((ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 + 1)::INT])::DOUBLE AS w,
             row_number() OVER (ORDER BY k = 'n', k) AS rk, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
             (sum(source_size) OVER () * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT k, source_size,
             CASE WHEN lev >= ratio THEN cap
                  ELSE w * max(CASE WHEN lev < ratio THEN lev END) OVER () END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
             (sum(d.size) OVER (PARTITION BY d.k ORDER BY h, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.k = t.k),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM p)
SELECT doc_id, size, source_size, target,
       (e * size + least(size, greatest(0, budget - e * source_size - before)))::BIGINT AS taken
FROM q
"""
