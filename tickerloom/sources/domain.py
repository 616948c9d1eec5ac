"""The news domain as typed tables over the test tables.

Every table is a lazy DataFrame; edges are tables of keys, so a pattern is a chain of equi-joins.
Derivations use integer arithmetic, so that another SQL engine gives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions import vocabulary as v


def pick(values: list, index: Column) -> Column:
    """values[index] for an index from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def lookup(values: dict, key: Column) -> Column:
    """values[key], null for other keys."""
    pairs = [F.lit(x) for k, x in values.items() if x is not None for x in (k, x)]
    return F.try_element_at(F.create_map(*pairs), key)


class _Sizes(dict):
    """Row counts that derivations take moduli by, each counted when first asked for; Parquet footers answer them."""

    def __init__(self, news: News):
        self.news = news

    def __missing__(self, table: str) -> int:
        self[table] = found = max(self.news.table(table).count(), 1)
        return found


class News:
    """All tables of the domain for one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def now(self) -> Column:
        return F.to_timestamp_ntz(F.lit(v.NOW))

    @cached_property
    def sizes(self) -> dict[str, int]:
        return _Sizes(self)

    @staticmethod
    def story(d: Column) -> Column:
        """The document whose story a document tells: every twentieth repeats that of five before, ten minutes later."""
        return F.when(d % 20 == 19, d - 5).otherwise(d)

    # nodes

    @cached_property
    def documents(self) -> DataFrame:
        d = F.col("doc_id")
        raw = (d * 37) % 101
        tier = F.lit("STANDARD")
        for name, least in sorted(v.TIER_FROM.items(), key=lambda x: x[1]):
            tier = F.when(raw >= least, name).otherwise(tier)
        story = self.story(d)
        minutes = (story * 7919) % 43200 - F.when(story != d, 10).otherwise(0)
        created = F.to_timestamp_ntz(F.lit(v.NOW)) - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
        codes = list(v.EVENT_CATEGORY)
        one, two = pick(v.THEMES, d % 25), pick(v.THEMES, (d * 7 + 3) % 25)
        return self.table("documents").select(
            "doc_id",
            F.substring("text", 1, 60).alias("title"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
            "source",
            (d % 5).cast("int").alias("group_id"),
            created.alias("created_at"),
            F.when(d % 29 != 0, raw).cast("int").alias("impact_score"),
            tier.alias("impact_tier"),
            F.array_sort(F.array_distinct(F.array(one, two))).alias("themes"),
            pick(codes, story % 32).alias("event_code"),
            lookup(v.EVENT_CATEGORY, pick(codes, story % 32)).alias("event_type"),
            story.alias("story_id"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        trust = pick(list(v.TRUST), n % 4)
        return (
            self.table("documents").select("source").filter(F.col("source").isNotNull()).distinct()
            .select(
                "source", trust.alias("trust_level"), lookup(v.TRUST, trust).alias("trust_score"),
                lookup(v.TRUST_POINTS, trust).alias("trust_points"), pick(v.REGIONS, n % 6).alias("region"), (n % 10 != 9).alias("active"),
            )
        )

    @cached_property
    def instruments(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("instrument_id"),
            F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("instrument_type"),
            F.col("p_brand").alias("index_name"),
            (F.col("p_partkey") % self.sizes["supplier"]).alias("company_id"),
            (F.col("p_size") * F.col("p_retailprice") * 1000).alias("daily_volume_usd"),
        )

    @cached_property
    def companies(self) -> DataFrame:
        """Company with its sector (nation) and region."""
        nation, region = self.table("nation"), self.table("region")
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"), F.col("n_name").alias("sector"), F.col("r_name").alias("region"))
        )

    @cached_property
    def clients(self) -> DataFrame:
        c = F.col("c_custkey")
        themes = F.array(*[pick(v.THEMES, (c * m + a) % 25) for m, a in ((1, 0), (3, 1), (11, 5))])
        return self.table("customer").select(
            c.alias("client_id"),
            F.col("c_name").alias("name"),
            lookup(v.CLIENT_TYPES, F.col("c_mktsegment")).alias("client_type"),
            (c % 5).cast("int").alias("group_id"),
            F.when(c % 17 == 0, "defunct").when(c % 17 == 1, F.lit(None)).otherwise("active").alias("status"),
            (30 + c % 40).cast("int").alias("impact_threshold"),
            F.when(c % 7 != 0, c % 3 == 0).alias("esg_constrained"),
            F.when(c % 13 != 0, pick(["equity", "credit", "macro"], c % 3)).alias("mandate_type"),
            F.when(c % 11 == 0, F.lit(None)).when(c % 11 == 1, F.lit("  ")).otherwise(F.concat(F.lit("Focus on "), themes[0])).alias("mandate_text"),
            F.array_sort(F.array_distinct(themes)).alias("mandate_themes"),
            F.when(c % 4 != 0, F.concat(F.lit("contact"), c.cast("string"))).alias("primary_contact"),
            pick(["realtime", "hourly", "daily", "weekly"], c % 4).alias("alert_frequency"),
            ((c * 19) % self.sizes["part"]).alias("benchmark_id"),
            F.concat(F.lit("NATION_"), (c % 25).cast("string")).alias("excluded_sector"),
            (c % self.sizes["embeddings"]).alias("mandate_vec_id"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    # edges

    @cached_property
    def affects(self) -> DataFrame:
        d, k = self.story(F.col("doc_id")), F.col("k")
        return (
            self.table("documents").select("doc_id").withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
            .select(
                "doc_id", ((d * 31 + k * 17) % self.sizes["part"]).alias("instrument_id"),
                pick(["positive", "negative", "neutral"], (d + k) % 3).alias("direction"), pick([0.05, 0.02, 0.01], (d * 3 + k) % 3).alias("magnitude"),
            )
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """Document to company: issuers of what it affects, and one more."""
        n = self.sizes["supplier"]
        issuers = self.affects.select("doc_id", (F.col("instrument_id") % n).alias("company_id"))
        more = self.table("documents").select("doc_id", ((F.col("doc_id") * 13) % n).alias("company_id"))
        return issuers.union(more).distinct()

    @cached_property
    def competes(self) -> DataFrame:
        """A ring inside each sector of two companies or more."""
        w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self.table("supplier").select(
            F.col("s_suppkey").alias("from_id"), F.coalesce(F.lead("s_suppkey").over(w), F.first("s_suppkey").over(whole)).alias("to_id")
        )
        return rows.filter("from_id <> to_id")

    @cached_property
    def supplies(self) -> DataFrame:
        n, s = self.sizes["supplier"], F.col("s_suppkey")
        return self.table("supplier").select(s.alias("from_id"), ((s * 3 + 1) % n).alias("to_id")).filter("from_id <> to_id")

    @cached_property
    def exposures(self) -> DataFrame:
        """Instrument to factor with a beta between -2 and 2."""
        p = F.col("p_partkey")
        return self.table("part").select(
            p.alias("instrument_id"), F.concat(F.lit("FACTOR_"), (p % 5).cast("string")).alias("factor"), ((((p * 11) % 41) - 20) / 10).alias("beta")
        )

    @cached_property
    def doc_factors(self) -> DataFrame:
        """Document to the macro factor that it moves; every eighth has one."""
        d = F.col("doc_id")
        return self.table("documents").filter(d % 8 == 3).select("doc_id", F.concat(F.lit("FACTOR_"), (d % 5).cast("string")).alias("factor"))

    @cached_property
    def holds(self) -> DataFrame:
        """Client to instrument with its share of the client's revenue, from cents."""
        cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
        rows = (
            self.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
            .filter(F.col("l_partkey") % 97 != 5)  # nobody holds these
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .repartition("o_custkey")  # by client at once: a client's pairs hardly repeat, and the total needs its rows together
            .groupBy(F.col("o_custkey").alias("client_id"), F.col("l_partkey").alias("instrument_id"))
            .agg(cents.alias("cents"), F.sum("l_quantity").cast("long").alias("shares"))
        )
        total = F.sum("cents").over(Window.partitionBy("client_id"))
        return rows.withColumn("weight", F.col("cents") / total).select("client_id", "instrument_id", "weight", "shares")

    @cached_property
    def watches(self) -> DataFrame:
        return (
            self.table("events").filter(F.col("event_type") == "view")
            .select(F.col("user_id").alias("client_id"), F.get_json_object("props", "$.k").cast("long").alias("instrument_id"))
            .filter(F.col("instrument_id").isNotNull())
            .distinct()
        )

    @cached_property
    def permitted(self) -> DataFrame:
        """Groups that a client may read: its own and the public one."""
        return self.clients.select("client_id", F.explode(F.array_distinct(F.array(F.col("group_id"), F.lit(v.PUBLIC_GROUP)))).alias("group_id"))
