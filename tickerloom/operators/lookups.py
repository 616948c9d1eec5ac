"""The documented query dictionary: documents by what they mention, paths, clusters, and scores of documents for clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.feeds import rank_in
from tickerloom.operators.trends import SENT, sentiments
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import sql

TOP = 20


def recent_documents(n: News) -> DataFrame:
    """The newest documents with their source's trust."""
    docs = n.documents.select("doc_id", "title", "created_at", "source").orderBy(F.desc("created_at"), "doc_id").limit(TOP)
    return docs.join(n.sources.select("source", "trust_level"), "source", "left").select("doc_id", "created_at", "source", "trust_level")


def documents_by_title(n: News) -> DataFrame:
    """Every document's place among those of its title, whatever its case, newest first."""
    rows = n.documents.select("doc_id", "group_id", F.lower(F.trim("title")).alias("title"), "created_at")
    return rows.withColumn("place", rank_in(["title"], F.col("created_at").desc(), F.col("doc_id"))).drop("created_at")


def documents_by_company_name(n: News, part: str = "00001") -> DataFrame:
    """The newest documents that mention a company whose name contains ``part``, whatever its case."""
    named = n.companies.filter(F.contains(F.lower("company"), F.lit(part.lower()))).select("company_id", "company")
    rows = n.mentions.join(F.broadcast(named) if n.sizes["supplier"] < 100_000 else named, "company_id").join(n.documents.select("doc_id", "created_at"), "doc_id")
    return rows.withColumn("rank", rank_in(["company"], F.col("created_at").desc(), F.col("doc_id"))).filter(F.col("rank") <= TOP).select("company", "rank", "doc_id")


def documents_by_tickers(n: News, tickers: tuple[str, ...] = ("T1", "T7", "T31", "T62")) -> DataFrame:
    """Documents that affect any of some tickers, by impact and then newest, for each ticker."""
    asked = n.instruments.filter(F.col("ticker").isin(list(tickers))).select("instrument_id", "ticker")
    rows = n.affects.select("doc_id", "instrument_id", "direction").join(asked, "instrument_id").join(n.documents.select("doc_id", "impact_score", "created_at"), "doc_id")
    order = rank_in(["ticker"], F.col("impact_score").desc_nulls_last(), F.col("created_at").desc(), F.col("doc_id"))
    return rows.withColumn("rank", order).select("ticker", "rank", "doc_id", "direction")


def high_impact(n: News) -> DataFrame:
    """What moves an instrument by more than .5 either way, strongest first."""
    rows = sentiments(n).filter(F.abs("sentiment") > 0.5)
    return rows.orderBy(F.abs("sentiment").desc(), "doc_id", "instrument_id").limit(50).select("doc_id", "instrument_id", F.round("sentiment", 6).alias("sentiment"))


def documents_by_event_name(n: News, part: str = "earn") -> DataFrame:
    """Documents whose event's name contains ``part``."""
    return n.documents.filter(F.contains(F.lower("event_type"), F.lit(part))).select("doc_id", "event_type", "event_code")


def full_path(n: News) -> DataFrame:
    """Source, document, instrument and company, along the whole path, as counts."""
    rows = n.documents.select("doc_id", "source").join(n.sources.select("source"), "source").join(n.affects.select("doc_id", "instrument_id"), "doc_id")
    rows = rows.join(n.instruments.select("instrument_id", "company_id"), "instrument_id").join(n.companies.select("company_id", "company"), "company_id")
    return rows.groupBy("source", "company").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("instrument_id").alias("instruments"))


def supplier_walk(n: News) -> DataFrame:
    """Companies that supply a company directly or through one other, at the least number of steps."""
    one = n.supplies.select(F.col("to_id").alias("company_id"), F.col("from_id").alias("supplier_id"))
    two = one.join(n.supplies.select(F.col("to_id").alias("supplier_id"), F.col("from_id").alias("further")), "supplier_id").select("company_id", F.col("further").alias("supplier_id"))
    both = one.withColumn("steps", F.lit(1)).union(two.withColumn("steps", F.lit(2))).filter("company_id <> supplier_id")
    return both.groupBy("company_id", "supplier_id").agg(F.min("steps").alias("steps"))


def shared_document_pairs(n: News, least: int = 2) -> DataFrame:
    """Pairs of instruments that at least some documents affect together."""
    rows = n.affects.select("doc_id", "instrument_id")
    pairs = rows.join(rows.withColumnRenamed("instrument_id", "other"), "doc_id").filter("instrument_id < other")
    return pairs.groupBy("instrument_id", "other").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= least)


def contagion(n: News) -> DataFrame:
    """Companies hit by negative news and the first five companies that they supply, by name."""
    bad = sentiments(n).filter("sentiment < 0").join(n.instruments.select("instrument_id", "company_id"), "instrument_id").groupBy("company_id").agg(F.count_distinct("doc_id").alias("bad"))
    names = n.supplies.join(n.companies.select(F.col("company_id").alias("to_id"), "company"), "to_id").groupBy(F.col("from_id").alias("company_id")).agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("company")), 1, 5), ",").alias("reached")
    )
    return bad.join(names, "company_id")


def co_mentioned_competitors(n: News) -> DataFrame:
    """Competitors that documents mention together."""
    pairs = n.mentions.alias("x").join(n.mentions.alias("y"), "doc_id").select(F.col("x.company_id").alias("from_id"), F.col("y.company_id").alias("to_id"), "doc_id")
    return pairs.join(n.competes, ["from_id", "to_id"]).groupBy("from_id", "to_id").agg(F.count_distinct("doc_id").alias("n"))


def source_trend(n: News) -> DataFrame:
    """Documents and mean impact of each source by day."""
    rows = n.documents.filter(F.col("source").isNotNull()).groupBy("source", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("impact_score"), 6).alias("mean"))


def pieces_by_partial_id(n: News, part: str = "11") -> DataFrame:
    """Documents whose id contains some digits, with their number of pieces of 1,000 characters and 800 new ones each."""
    more = F.greatest(F.lit(0), F.ceil((F.length("content") - 1000) / 800))
    return n.documents.filter(F.contains(F.col("doc_id").cast("string"), F.lit(part))).select("doc_id", (1 + more).cast("long").alias("pieces"))


def liquidity_feed(n: News, least: float = 10_000_000.0, k: int = 10) -> DataFrame:
    """A client's documents on holdings of enough daily volume, by impact and then newest."""
    liquid = n.instruments.filter(F.col("daily_volume_usd") > least).select("instrument_id")
    held = n.holds.select("client_id", "instrument_id").join(liquid, "instrument_id", "left_semi")
    docs = n.documents.select("doc_id", "group_id", "impact_score", "created_at")
    reach = n.affects.select("doc_id", "instrument_id").join(docs, "doc_id").join(held.join(n.permitted, "client_id"), ["instrument_id", "group_id"])
    rows = reach.select("client_id", "doc_id", "impact_score", "created_at").distinct()
    return rows.withColumn("rank", rank_in(["client_id"], F.col("impact_score").desc_nulls_last(), F.col("created_at").desc(), F.col("doc_id"))).filter(F.col("rank") <= k).select("client_id", "rank", "doc_id")


def relevance_edges(n: News) -> DataFrame:
    """(doc_id, client_type, shared): documents of the two highest tiers that share themes with clients of a type."""
    wanted = n.clients.select("client_type", F.explode("mandate_themes").alias("theme")).distinct()
    docs = n.documents.filter(F.col("impact_tier").isin("PLATINUM", "GOLD")).select("doc_id", F.explode("themes").alias("theme"))
    return docs.join(wanted, "theme").groupBy("doc_id", "client_type").agg(F.count("*").alias("shared"))


def feed_by_relevance(n: News, k: int = 10) -> DataFrame:
    """Each client type's documents, PLATINUM first, then by impact and newest."""
    docs = n.documents.select("doc_id", "impact_tier", "impact_score", "created_at")
    tier = F.when(F.col("impact_tier") == "PLATINUM", 0).otherwise(1)
    order = rank_in(["client_type"], tier, F.col("impact_score").desc_nulls_last(), F.col("created_at").desc(), F.col("doc_id"))
    return relevance_edges(n).join(docs, "doc_id").withColumn("rank", order).filter(F.col("rank") <= k).select("client_type", "rank", "doc_id", "impact_tier")


def platinum_for_type(n: News) -> DataFrame:
    """How many PLATINUM documents are relevant to each client type, and the newest of them."""
    docs = n.documents.filter("impact_tier = 'PLATINUM'").select("doc_id", "created_at")
    rows = relevance_edges(n).join(docs, "doc_id")
    return rows.groupBy("client_type").agg(F.count("*").alias("n"), F.max_by("doc_id", F.struct("created_at", -F.col("doc_id"))).alias("newest"))


def document_scores(n: News) -> DataFrame:
    """Of each client and readable document that touches it: 100 times the weights held, 50 if watched, 30 if its benchmark is affected; and the feed's score.

    The feed's score is 50 times the greatest weight, 40 if watched and 30 if a theme is shared, on the same pairs.
    """
    held = n.holds.select("client_id", "instrument_id", "weight", F.lit(False).alias("watched"), F.lit(False).alias("bench"))
    seen = n.watches.select("client_id", "instrument_id", F.lit(0.0).alias("weight"), F.lit(True).alias("watched"), F.lit(False).alias("bench"))
    marks = n.clients.select("client_id", F.col("benchmark_id").alias("instrument_id"), F.lit(0.0).alias("weight"), F.lit(False).alias("watched"), F.lit(True).alias("bench"))
    docs = n.documents.select("doc_id", "group_id", "themes")
    touch = n.affects.select("doc_id", "instrument_id").join(docs.select("doc_id", "group_id"), "doc_id")
    reach = touch.join(held.union(seen).union(marks).join(n.permitted, "client_id"), ["instrument_id", "group_id"])
    rows = reach.groupBy("client_id", "doc_id").agg(F.sum("weight").alias("held"), F.max("weight").alias("most"), F.max("watched").alias("watched"), F.max("bench").alias("bench"))
    rows = rows.join(docs.select("doc_id", "themes"), "doc_id").join(n.clients.select("client_id", "mandate_themes"), "client_id")
    one = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    score = 100 * F.col("held") + one(F.col("watched"), 50) + one(F.col("bench"), 30)
    feed = 50 * F.col("most") + one(F.col("watched"), 40) + one(F.arrays_overlap("themes", "mandate_themes"), 30)
    return rows.select("client_id", "doc_id", F.round(score, 6).alias("score"), F.round(feed, 6).alias("feed_score"))


def market_impact(n: News) -> DataFrame:
    """.5 price + .2 volume + .2 volatility + .1 velocity, each from 0 to 1, of every document and instrument that it affects.

    Price is the magnitude over .05; volume the instrument's share of the greatest volume; volatility the deviation of its sentiment over 2;
    velocity its documents of the last week over the most of any.
    """
    most = n.instruments.agg(F.max("daily_volume_usd").alias("most"))
    own = n.instruments.join(F.broadcast(most)).select("instrument_id", (F.col("daily_volume_usd") / F.col("most")).alias("volume"))  # one row
    spread = sentiments(n).groupBy("instrument_id").agg(F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("spread"))
    week = n.documents.filter(F.col("created_at") >= n.now - F.expr("INTERVAL 7 DAYS")).select("doc_id")
    pace = n.affects.join(week, "doc_id", "left_semi").groupBy("instrument_id").agg(F.count("*").alias("recent"))
    top = pace.agg(F.max("recent").alias("top"))
    rows = n.affects.join(own, "instrument_id").join(spread, "instrument_id").join(pace, "instrument_id", "left").join(F.broadcast(top))  # one row
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = 0.5 * unit(F.col("magnitude") / 0.05) + 0.2 * unit(F.col("volume")) + 0.2 * unit(F.col("spread") / 2) + 0.1 * unit(F.coalesce(F.col("recent") / F.col("top"), F.lit(0.0)))
    return rows.select("doc_id", "instrument_id", F.round(score, 6).alias("score"))


def all_related(n: News, k: int = 20) -> DataFrame:
    """The newest other documents that share an instrument or a company with a document."""
    from tickerloom.operators.graph import newest_shared

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("key")
    links = n.affects.select("doc_id", key("I", "instrument_id")).union(n.mentions.select("doc_id", key("C", "company_id"))).distinct()
    return newest_shared(n, links, "key", k)


_REL = ("rel", """SELECT doc_id, client_type, count(*) AS shared FROM (SELECT doc_id, unnest(themes) AS theme FROM docs WHERE impact_tier IN ('PLATINUM', 'GOLD'))
    JOIN (SELECT DISTINCT client_type, unnest(mandate_themes) AS theme FROM clients) USING (theme) GROUP BY 1, 2""")
QUERIES = {f.__name__: f for f in (
    recent_documents, documents_by_title, documents_by_company_name, documents_by_tickers, high_impact, documents_by_event_name, full_path, supplier_walk, shared_document_pairs, contagion,
    co_mentioned_competitors, source_trend, pieces_by_partial_id, liquidity_feed, feed_by_relevance, platinum_for_type, document_scores, market_impact, all_related,
)}
SQL = {
    "recent_documents": sql("SELECT doc_id, created_at, source, trust_level FROM (SELECT * FROM docs ORDER BY created_at DESC, doc_id LIMIT 20) LEFT JOIN srcs USING (source)"),
    "documents_by_title": sql("SELECT doc_id, group_id, lower(trim(title)) AS title, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY created_at DESC, doc_id) AS place FROM docs"),
    "documents_by_company_name": sql("""SELECT company, rank, doc_id FROM (SELECT company, doc_id, row_number() OVER (PARTITION BY company ORDER BY created_at DESC, doc_id) AS rank
        FROM mentions JOIN comps USING (company_id) JOIN docs USING (doc_id) WHERE contains(lower(company), '00001')) WHERE rank <= 20"""),
    "documents_by_tickers": sql("""SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY impact_score DESC NULLS LAST, created_at DESC, doc_id) AS rank, doc_id, direction
        FROM affects JOIN instr USING (instrument_id) JOIN docs USING (doc_id) WHERE ticker IN ('T1', 'T7', 'T31', 'T62')"""),
    "high_impact": sql("SELECT doc_id, instrument_id, round(sentiment, 6) AS sentiment FROM sent WHERE abs(sentiment) > 0.5 ORDER BY abs(sent.sentiment) DESC, doc_id, instrument_id LIMIT 50", SENT),
    "documents_by_event_name": sql("SELECT doc_id, event_type, event_code FROM docs WHERE contains(lower(event_type), 'earn')"),
    "full_path": sql("""SELECT source, company, count(DISTINCT doc_id) AS docs, count(DISTINCT instrument_id) AS instruments FROM docs JOIN srcs USING (source) JOIN affects USING (doc_id)
        JOIN instr USING (instrument_id) JOIN comps USING (company_id) GROUP BY 1, 2"""),
    "supplier_walk": sql("""SELECT company_id, supplier_id, min(steps) AS steps FROM (SELECT to_id AS company_id, from_id AS supplier_id, 1 AS steps FROM supplies
        UNION ALL SELECT a.to_id, b.from_id, 2 FROM supplies a JOIN supplies b ON b.to_id = a.from_id) WHERE company_id <> supplier_id GROUP BY 1, 2"""),
    "shared_document_pairs": sql("""SELECT a.instrument_id, b.instrument_id AS other, count(DISTINCT a.doc_id) AS n FROM affects a JOIN affects b ON a.doc_id = b.doc_id AND a.instrument_id < b.instrument_id
        GROUP BY 1, 2 HAVING count(DISTINCT a.doc_id) >= 2"""),
    "contagion": sql("""SELECT company_id, bad, reached FROM (SELECT company_id, count(DISTINCT doc_id) AS bad FROM sent JOIN instr USING (instrument_id) WHERE sentiment < 0 GROUP BY 1)
        JOIN (SELECT from_id AS company_id, array_to_string(list_sort(list_distinct(list(company)))[1:5], ',') AS reached FROM supplies JOIN comps ON comps.company_id = to_id GROUP BY 1) USING (company_id)""", SENT),
    "co_mentioned_competitors": sql("""SELECT from_id, to_id, count(DISTINCT x.doc_id) AS n FROM competes JOIN mentions x ON x.company_id = from_id JOIN mentions y ON y.company_id = to_id AND x.doc_id = y.doc_id GROUP BY 1, 2"""),
    "source_trend": sql("SELECT source, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg(impact_score), 6) AS mean FROM docs WHERE source IS NOT NULL GROUP BY 1, 2"),
    "pieces_by_partial_id": sql("SELECT doc_id, (1 + greatest(0, ceil((length(content) - 1000) / 800.0)))::BIGINT AS pieces FROM docs WHERE contains(doc_id::VARCHAR, '11')"),
    "liquidity_feed": sql("""SELECT client_id, rank, doc_id FROM (SELECT client_id, doc_id, row_number() OVER (PARTITION BY client_id ORDER BY max(impact_score) DESC NULLS LAST, max(created_at) DESC, doc_id) AS rank
        FROM affects JOIN docs USING (doc_id) JOIN holds USING (instrument_id) JOIN instr USING (instrument_id) JOIN permitted USING (client_id, group_id) WHERE daily_volume_usd > 10000000 GROUP BY client_id, doc_id) WHERE rank <= 10"""),
    "feed_by_relevance": sql("""SELECT client_type, rank, doc_id, impact_tier FROM (SELECT client_type, doc_id, impact_tier, row_number() OVER (PARTITION BY client_type
        ORDER BY (impact_tier <> 'PLATINUM')::INT, impact_score DESC NULLS LAST, created_at DESC, doc_id) AS rank FROM rel JOIN docs USING (doc_id)) WHERE rank <= 10""", _REL),
    "platinum_for_type": sql("""SELECT client_type, count(*) AS n, arg_max(doc_id, (created_at, -doc_id)) AS newest FROM rel JOIN docs USING (doc_id) WHERE impact_tier = 'PLATINUM' GROUP BY 1""", _REL),
    "document_scores": sql("""SELECT client_id, doc_id, round(100 * held + CASE WHEN watched THEN 50.0 ELSE 0.0 END::DOUBLE + CASE WHEN bench THEN 30.0 ELSE 0.0 END::DOUBLE, 6) AS score,
        round(50 * most + CASE WHEN watched THEN 40.0 ELSE 0.0 END::DOUBLE + CASE WHEN list_has_any(themes, mandate_themes) THEN 30.0 ELSE 0.0 END::DOUBLE, 6) AS feed_score FROM (
        SELECT client_id, doc_id, sum(weight) AS held, max(weight) AS most, bool_or(watched) AS watched, bool_or(bench) AS bench FROM affects JOIN docs USING (doc_id) JOIN (
            SELECT client_id, instrument_id, weight, FALSE AS watched, FALSE AS bench FROM holds UNION ALL SELECT client_id, instrument_id, 0.0, TRUE, FALSE FROM watches
            UNION ALL SELECT client_id, benchmark_id, 0.0, FALSE, TRUE FROM clients) USING (instrument_id) JOIN permitted USING (client_id, group_id) GROUP BY 1, 2)
        JOIN docs USING (doc_id) JOIN clients USING (client_id)"""),
    "market_impact": sql("""SELECT a.doc_id, a.instrument_id, round(0.5::DOUBLE * least(1.0, magnitude / 0.05::DOUBLE) + 0.2::DOUBLE * (daily_volume_usd / (SELECT max(daily_volume_usd) FROM instr))
        + 0.2::DOUBLE * least(1.0, coalesce(spread, 0) / 2) + 0.1::DOUBLE * coalesce(recent / (SELECT max(recent) FROM pace)::DOUBLE, 0), 6) AS score FROM affects a JOIN instr USING (instrument_id)
        JOIN (SELECT instrument_id, stddev_samp(sentiment) AS spread FROM sent GROUP BY 1) USING (instrument_id) LEFT JOIN pace USING (instrument_id)""", SENT,
        ("pace", "SELECT instrument_id, count(*) AS recent FROM affects JOIN docs USING (doc_id) WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")),
    "all_related": sql("""SELECT doc_id, rank, related FROM (SELECT p.doc_id, related, row_number() OVER (PARTITION BY p.doc_id ORDER BY created_at DESC, related) AS rank FROM (
        SELECT x.doc_id, y.doc_id AS related FROM mentions x JOIN mentions y ON x.company_id = y.company_id AND x.doc_id <> y.doc_id
        UNION SELECT x.doc_id, y.doc_id FROM affects x JOIN affects y ON x.instrument_id = y.instrument_id AND x.doc_id <> y.doc_id) p JOIN docs ON docs.doc_id = related) WHERE rank <= 20"""),
}
