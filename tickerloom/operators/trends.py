"""Aggregations over documents, instruments, companies, sources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import vocabulary as v
from tickerloom.operators.feeds import rank_in, text_list
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import sql


def sentiments(n: News) -> DataFrame:
    """(doc_id, instrument_id, sentiment): signed magnitude times 20."""
    sign = F.when(F.col("direction") == "positive", 1.0).when(F.col("direction") == "negative", -1.0).otherwise(0.0)
    return n.affects.select("doc_id", "instrument_id", (sign * F.col("magnitude") * 20).alias("sentiment"))


SENT = ("sent", "SELECT doc_id, instrument_id, CASE direction WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE * magnitude * 20 AS sentiment FROM affects")


def most_mentioned(n: News) -> DataFrame:
    return n.mentions.groupBy("company_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company_id").limit(20)


def most_affected(n: News) -> DataFrame:
    rows = sentiments(n).groupBy("instrument_id").agg(F.count("*").alias("n"), F.round(F.avg("sentiment"), 6).alias("mean"))
    return rows.orderBy(F.desc("n"), "instrument_id").limit(20)


def event_distribution(n: News) -> DataFrame:
    return n.documents.filter(F.col("event_type").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


def by_sector(n: News) -> DataFrame:
    return n.instruments.select("instrument_id", "company_id").join(n.companies.select("company_id", "sector", "region"), "company_id")


def event_by_sector(n: News) -> DataFrame:
    docs = n.documents.select("doc_id", "event_type").filter(F.col("event_type").isNotNull())
    rows = n.affects.select("doc_id", "instrument_id").join(docs, "doc_id").join(by_sector(n), "instrument_id")
    return rows.groupBy("sector", "event_type").agg(F.count_distinct("doc_id").alias("n"))


def sector_sentiment(n: News) -> DataFrame:
    x = F.col("sentiment")
    return sentiments(n).join(by_sector(n), "instrument_id").groupBy("sector").agg(
        F.round(F.avg(x), 6).alias("mean"), F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.stddev_samp(x), 6).alias("deviation")
    )


def volatility(n: News, least: int = 1) -> DataFrame:
    """Deviation by instrument with more than ``least`` documents."""
    rows = sentiments(n).groupBy("instrument_id").agg(F.round(F.stddev_samp("sentiment"), 6).alias("deviation"), F.count("*").alias("n"))
    return rows.filter(F.col("n") > least)


def source_bias(n: News) -> DataFrame:
    rows = sentiments(n).join(n.documents.select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count_distinct("doc_id").alias("n"), F.round(F.avg("sentiment"), 6).alias("mean"), F.round(F.stddev_samp("sentiment"), 6).alias("deviation"))


def daily_trend(n: News) -> DataFrame:
    rows = sentiments(n).join(n.documents.select("doc_id", "created_at"), "doc_id").join(by_sector(n), "instrument_id")
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return rows.groupBy("sector", day).agg(F.round(F.avg("sentiment"), 6).alias("mean"), F.count("*").alias("n"))


def trend_rollup(n: News) -> DataFrame:
    """Region and sector totals with subtotals (an extension)."""
    rows = sentiments(n).join(by_sector(n), "instrument_id")
    return rows.rollup("region", "sector").agg(F.count("*").alias("n")).select(F.coalesce("region", F.lit("*")).alias("region"), F.coalesce("sector", F.lit("*")).alias("sector"), "n")


def event_timeline(n: News) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return n.documents.filter(F.col("event_type").isNotNull()).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.max("impact_score").cast("double").alias("most"))


def low_trust_anomaly(n: News) -> DataFrame:
    low = n.sources.filter(F.col("trust_level").isin("low", "unverified")).select("source", "trust_level")
    rows = sentiments(n).filter(F.abs("sentiment") > 0.5).join(n.documents.select("doc_id", "source"), "doc_id").join(low, "source")
    return rows.orderBy(F.abs("sentiment").desc(), "doc_id", "instrument_id").limit(50).select("doc_id", "instrument_id", "source", "sentiment")


def multi_mention(n: News) -> DataFrame:
    rows = n.mentions.join(n.companies.select("company_id", "company"), "company_id").groupBy("doc_id").agg(F.count("*").alias("n"), text_list(F.collect_set("company")).alias("companies"))
    return rows.filter("n > 1")


def tier_counts(n: News) -> DataFrame:
    return n.documents.groupBy(F.coalesce("impact_tier", F.lit("UNKNOWN")).alias("tier")).agg(F.count("*").alias("n"))


def node_counts(n: News) -> DataFrame:
    tables = {"Document": n.documents, "Source": n.sources, "Instrument": n.instruments, "Company": n.companies, "Client": n.clients}
    out = None
    for label, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def edge_counts(n: News) -> DataFrame:
    tables = {"AFFECTS": n.affects, "MENTIONS": n.mentions, "COMPETES_WITH": n.competes, "SUPPLIES_TO": n.supplies, "HOLDS": n.holds, "WATCHES": n.watches}
    out = None
    for label, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(label).alias("rel_type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def decayed_relevance(n: News) -> DataFrame:
    """Impact decayed by days and tier, at least 10, the best 50."""
    from tickerloom.sources.domain import lookup

    days = F.date_diff(F.to_date(n.now), F.to_date("created_at"))
    score = F.col("impact_score") * F.exp(-lookup(v.TIER_DECAY, F.col("impact_tier")) * days)
    rows = n.documents.select("doc_id", "impact_tier", F.round(score, 6).alias("score")).filter("score > 10")
    return rows.orderBy(F.desc("score"), "doc_id").limit(50)


def percentile_tiers(n: News) -> DataFrame:
    """Tiers by share of the ranking inside a group: top 1, 2, 10, 20 % and the rest."""
    rows = n.documents.filter(F.col("impact_score").isNotNull()).select("doc_id", "group_id", "impact_score")
    # ranks from the counts of equal scores: a row for each group and score, however many documents there are
    counts = rows.groupBy("group_id", "impact_score").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("group_id")
    above = F.coalesce(F.sum("n").over(by_group.orderBy(F.col("impact_score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(by_group)
    share = F.when(total > 1, above / (total - 1)).otherwise(0.0)
    rows = rows.join(counts.select("group_id", "impact_score", share.alias("p")), ["group_id", "impact_score"])
    tier = F.when(F.col("p") < 0.01, "PLATINUM").when(F.col("p") < 0.03, "GOLD").when(F.col("p") < 0.13, "SILVER").when(F.col("p") < 0.33, "BRONZE").otherwise("STANDARD")
    return rows.select("doc_id", tier.alias("tier"))


def platinum_digest(n: News) -> DataFrame:
    """For each group the 5 newest PLATINUM and 10 newest GOLD documents."""
    rows = n.documents.filter(F.col("impact_tier").isin("PLATINUM", "GOLD")).select("group_id", "impact_tier", "doc_id", "created_at")
    ranked = rows.withColumn("rank", rank_in(["group_id", "impact_tier"], F.col("created_at").desc(), F.col("doc_id")))
    return ranked.filter(F.col("rank") <= F.when(F.col("impact_tier") == "PLATINUM", 5).otherwise(10)).select("group_id", "impact_tier", "rank", "doc_id")


def source_coverage(n: News) -> DataFrame:
    rows = n.documents.join(n.sources, "source", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.max("trust_score").alias("trust"), F.round(F.avg("impact_score"), 6).alias("mean_impact"))


def daily_audit(n: News) -> DataFrame:
    return n.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def audit_query(n: News) -> DataFrame:
    """Errors of a week, the first 100 in order of time."""
    rows = n.table("events").filter((F.col("event_type") == "error") & F.col("ts").between(F.to_timestamp_ntz(F.lit("2024-01-08")), F.to_timestamp_ntz(F.lit("2024-01-15"))))
    return rows.orderBy("ts", "event_id").limit(100).select("event_id", "user_id", "value")


_SEC = ("bysec", "SELECT instrument_id, company_id, sector, region FROM instr JOIN comps USING (company_id)")
_DAY = "strftime(created_at, '%Y-%m-%d')"
QUERIES = {f.__name__: f for f in (
    most_mentioned, most_affected, event_distribution, event_by_sector, sector_sentiment, volatility, source_bias, daily_trend, trend_rollup,
    event_timeline, low_trust_anomaly, multi_mention, tier_counts, node_counts, edge_counts, decayed_relevance, percentile_tiers, platinum_digest,
    source_coverage, daily_audit, audit_query,
)}
SQL = {
    "most_mentioned": sql("SELECT company_id, count(*) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, company_id LIMIT 20"),
    "most_affected": sql("SELECT instrument_id, count(*) AS n, round(avg(sentiment), 6) AS mean FROM sent GROUP BY 1 ORDER BY n DESC, instrument_id LIMIT 20", SENT),
    "event_distribution": sql("SELECT event_type, count(*) AS n FROM docs WHERE event_type IS NOT NULL GROUP BY 1"),
    "event_by_sector": sql("SELECT sector, event_type, count(DISTINCT doc_id) AS n FROM affects JOIN docs USING (doc_id) JOIN bysec USING (instrument_id) WHERE event_type IS NOT NULL GROUP BY 1, 2", _SEC),
    "sector_sentiment": sql("SELECT sector, round(avg(sentiment), 6) AS mean, count(*) AS n, min(sentiment) AS least, max(sentiment) AS most, round(stddev_samp(sentiment), 6) AS deviation FROM sent JOIN bysec USING (instrument_id) GROUP BY 1", SENT, _SEC),
    "volatility": sql("SELECT instrument_id, round(stddev_samp(sentiment), 6) AS deviation, count(*) AS n FROM sent GROUP BY 1 HAVING count(*) > 1", SENT),
    "source_bias": sql("SELECT source, count(DISTINCT doc_id) AS n, round(avg(sentiment), 6) AS mean, round(stddev_samp(sentiment), 6) AS deviation FROM sent JOIN docs USING (doc_id) GROUP BY 1", SENT),
    "daily_trend": sql(f"SELECT sector, {_DAY} AS day, round(avg(sentiment), 6) AS mean, count(*) AS n FROM sent JOIN docs USING (doc_id) JOIN bysec USING (instrument_id) GROUP BY 1, 2", SENT, _SEC),
    "trend_rollup": sql("SELECT coalesce(region, '*') AS region, coalesce(sector, '*') AS sector, count(*) AS n FROM sent JOIN bysec USING (instrument_id) GROUP BY ROLLUP (region, sector)", SENT, _SEC),
    "event_timeline": sql(f"SELECT {_DAY} AS day, event_type, count(*) AS n, max(impact_score)::DOUBLE AS most FROM docs WHERE event_type IS NOT NULL GROUP BY 1, 2"),
    "low_trust_anomaly": sql("SELECT doc_id, instrument_id, source, sentiment FROM sent JOIN docs USING (doc_id) JOIN srcs USING (source) WHERE trust_level IN ('low', 'unverified') AND abs(sentiment) > 0.5 ORDER BY abs(sentiment) DESC, doc_id, instrument_id LIMIT 50", SENT),
    "multi_mention": sql("SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(company))), ',') AS companies FROM mentions JOIN comps USING (company_id) GROUP BY 1 HAVING count(*) > 1"),
    "tier_counts": sql("SELECT coalesce(impact_tier, 'UNKNOWN') AS tier, count(*) AS n FROM docs GROUP BY 1"),
    "node_counts": sql("SELECT 'Document' AS label, count(*) AS n FROM docs UNION ALL SELECT 'Source', count(*) FROM srcs UNION ALL SELECT 'Instrument', count(*) FROM instr UNION ALL SELECT 'Company', count(*) FROM comps UNION ALL SELECT 'Client', count(*) FROM clients"),
    "edge_counts": sql("SELECT 'AFFECTS' AS rel_type, count(*) AS n FROM affects UNION ALL SELECT 'MENTIONS', count(*) FROM mentions UNION ALL SELECT 'COMPETES_WITH', count(*) FROM competes UNION ALL SELECT 'SUPPLIES_TO', count(*) FROM supplies UNION ALL SELECT 'HOLDS', count(*) FROM holds UNION ALL SELECT 'WATCHES', count(*) FROM watches"),
    "decayed_relevance": sql("SELECT doc_id, impact_tier, round(impact_score * exp(-(CASE impact_tier WHEN 'PLATINUM' THEN 0.05 WHEN 'GOLD' THEN 0.10 WHEN 'SILVER' THEN 0.15 WHEN 'BRONZE' THEN 0.20 ELSE 0.30 END)::DOUBLE * date_diff('day', created_at, TIMESTAMP '2024-01-31')), 6) AS score FROM docs WHERE score > 10 ORDER BY score DESC, doc_id LIMIT 50"),
    "percentile_tiers": sql("SELECT doc_id, CASE WHEN p < 0.01 THEN 'PLATINUM' WHEN p < 0.03 THEN 'GOLD' WHEN p < 0.13 THEN 'SILVER' WHEN p < 0.33 THEN 'BRONZE' ELSE 'STANDARD' END AS tier FROM (SELECT doc_id, percent_rank() OVER (PARTITION BY group_id ORDER BY impact_score DESC) AS p FROM docs WHERE impact_score IS NOT NULL)"),
    "platinum_digest": sql("SELECT group_id, impact_tier, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, impact_tier ORDER BY created_at DESC, doc_id) AS rank FROM docs WHERE impact_tier IN ('PLATINUM', 'GOLD')) WHERE rank <= CASE impact_tier WHEN 'PLATINUM' THEN 5 ELSE 10 END"),
    "source_coverage": sql("SELECT source, count(*) AS n, max(trust_score) AS trust, round(avg(impact_score), 6) AS mean_impact FROM docs LEFT JOIN srcs USING (source) GROUP BY 1"),
    "daily_audit": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "audit_query": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 100",
}
