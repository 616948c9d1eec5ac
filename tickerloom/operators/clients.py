"""Client views, stores and their changes, text functions as queries, search and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import providers
from tickerloom.functions import scoring as sc
from tickerloom.functions import text as tx
from tickerloom.functions import vocabulary as v
from tickerloom.operators import dedupe
from tickerloom.operators.feeds import rank_in
from tickerloom.sources.domain import News, lookup
from tickerloom.sources.domain_sql import PIECES, _case, _list, sql
from tickerloom.sources.lineage import cut_lineage


def list_clients(n: News) -> DataFrame:
    """Clients that aren't defunct, by name, the first 100."""
    rows = n.clients.filter(F.coalesce("status", F.lit("active")) != "defunct")
    return rows.orderBy("name").limit(100).select("client_id", "name", "client_type", "group_id")


def client_profile(n: News) -> DataFrame:
    bench = n.instruments.select(F.col("instrument_id").alias("benchmark_id"), F.col("ticker").alias("benchmark"))
    return n.clients.join(bench, "benchmark_id", "left").select(
        "client_id", "client_type", "benchmark", F.array_join("mandate_themes", ",").alias("themes"), F.coalesce(F.trim("mandate_text"), F.lit("")).alias("mandate")
    )


def completeness_score(n: News) -> DataFrame:
    has = n.holds.select("client_id").union(n.watches.select("client_id")).distinct().withColumn("has", F.lit(True))
    c = F.col
    score = sc.completeness(F.coalesce(c("has"), F.lit(False)), c("mandate_type"), c("mandate_text"), c("esg_constrained"), c("primary_contact"), c("alert_frequency"))
    return n.clients.join(has, "client_id", "left").select("client_id", score.alias("score"))


def portfolio_holdings(n: News) -> DataFrame:
    """All holdings of each client, largest first."""
    rows = n.holds.join(n.instruments.select("instrument_id", "ticker"), "instrument_id")
    pct = F.format_string("%.1f%%", F.col("weight") * 100)
    ranked = rows.withColumn("rank", rank_in(["client_id"], F.coalesce("weight", F.lit(-1.0)).desc(), F.col("ticker")))
    return ranked.select("client_id", "rank", "ticker", pct.alias("percent"), "shares")


def holdings_totals(n: News) -> DataFrame:
    """Sum of weights, to 4 digits, and number of holdings."""
    return n.holds.groupBy("client_id").agg(F.round(F.sum("weight"), 4).alias("total_weight"), F.count("*").alias("holdings"))


def watchlist_items(n: News) -> DataFrame:
    return n.watches.join(n.instruments.select("instrument_id", "ticker"), "instrument_id").select("client_id", "ticker")


def profile_counts(n: News) -> DataFrame:
    """Distinct holdings, watched instruments, exclusions and benchmarks of each client."""
    held = n.holds.groupBy("client_id").agg(F.count_distinct("instrument_id").alias("holdings"))
    seen = n.watches.groupBy("client_id").agg(F.count_distinct("instrument_id").alias("watched"))
    rows = n.clients.select("client_id", F.col("excluded_sector").isNotNull().cast("long").alias("excluded"), F.col("benchmark_id").isNotNull().cast("long").alias("benchmarks"))
    rows = rows.join(held, "client_id", "left").join(seen, "client_id", "left")
    return rows.select("client_id", F.coalesce("holdings", F.lit(0)).alias("holdings"), F.coalesce("watched", F.lit(0)).alias("watched"), "excluded", "benchmarks")


def scalar_scores(n: News) -> DataFrame:
    """recency30, breaking recency, impact and trust of every document."""
    rows = n.documents.join(n.sources.select("source", "trust_level"), "source", "left")
    return rows.select(
        "doc_id", F.round(sc.recency30(F.col("created_at"), n.now), 9).alias("recency30"),
        F.round(sc.recency_breaking(F.col("created_at"), n.now, 600.0), 9).alias("breaking"),
        F.round(sc.impact_norm(F.col("impact_score")), 9).alias("impact"), sc.trust_score(F.col("trust_level")).alias("trust"),
    )


def _asked(n: News):
    """The vector of the query: embedding 7."""
    return n.vectors.filter("vec_id = 7").select(F.col("embedding").alias("q"))


def vector_topk(n: News, k: int = 20, groups: tuple[int, ...] | None = None) -> DataFrame:
    """The documents nearest to the query's vector; the one query row is broadcast."""
    docs = n.documents.select("doc_id", "group_id", (F.col("doc_id") % n.sizes["embeddings"]).alias("vec_id"))
    if groups is not None:
        docs = docs.filter(F.col("group_id").isin(list(groups)))
    scores = n.vectors.join(F.broadcast(_asked(n))).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))
    return docs.join(scores, "vec_id").orderBy(F.desc("similarity"), "doc_id").limit(k).select("doc_id", F.round("similarity", 6).alias("similarity"))


def hybrid_search(n: News, k: int = 10, regions: tuple[str, ...] | None = None, prefilter: bool = False) -> DataFrame:
    """.6 similarity + .2 trust + .1 recency over the 3 k nearest; filters apply after that cut unless ``prefilter``."""
    docs = n.documents.join(n.sources.select("source", "region", "trust_score"), "source", "left").select("doc_id", "created_at", "region", "trust_score", (F.col("doc_id") % n.sizes["embeddings"]).alias("vec_id"))
    wanted = F.coalesce("region", F.lit("")).isin(list(regions)) if regions else F.lit(True)
    if prefilter:
        docs = docs.filter(wanted)
    scores = n.vectors.join(F.broadcast(_asked(n))).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))
    near = docs.join(scores, "vec_id").orderBy(F.desc("similarity"), "doc_id").limit(3 * k).filter(wanted)
    score = 0.6 * F.col("similarity") + 0.2 * F.coalesce("trust_score", F.lit(0.5)) + 0.1 * sc.recency30(F.col("created_at"), n.now)
    return near.select("doc_id", F.round(score, 6).alias("score"), F.round("similarity", 6).alias("similarity")).orderBy(F.desc("score"), "doc_id").limit(k)


def hybrid_search_expanded(n: News, k: int = 10) -> DataFrame:
    """Semantic results and, for the five nearest, the newest documents on the same instruments."""
    seeds = vector_topk(n, 5).withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")))  # five rows
    semantic = hybrid_search(n, k).select("doc_id", "score", F.lit("semantic").alias("via"))
    links = n.affects.join(seeds.select("doc_id", "seed_rank"), "doc_id").select("instrument_id", "seed_rank").distinct()
    near = n.affects.select(F.col("doc_id"), "instrument_id").join(links, "instrument_id").join(n.documents.select("doc_id", "created_at", "source"), "doc_id")
    near = near.withColumn("r", rank_in(["instrument_id", "seed_rank"], F.col("created_at").desc(), F.col("doc_id"))).filter("r <= 5")
    fresh = near.groupBy("doc_id", "created_at", "source").agg(F.min("seed_rank").alias("p")).join(semantic.select("doc_id"), "doc_id", "left_anti")
    score = 0.2 * F.coalesce("trust_score", F.lit(0.5)) + 0.1 * sc.recency30(F.col("created_at"), n.now) + 0.1
    graph = fresh.join(n.sources.select("source", "trust_score"), "source", "left").select("doc_id", F.round(score, 6).alias("score"), F.lit("graph").alias("via"))
    return semantic.unionByName(graph)


def keyword_bm25(n: News, words: tuple[str, ...] = ("the", "license", "version"), k: int = 20) -> DataFrame:
    """BM25 over words in any script (an extension): texts are cut once, and a row keeps its length and a count for each word asked."""
    # two spaces between words, so that each word has a space of its own on either side
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce("content", F.lit(""))), tx.BETWEEN_WORDS, "  ")), F.lit(" "))
    times = lambda part: ((F.length("p") - F.length(F.replace(F.col("p"), F.lit(part), F.lit("")))) / len(part)).cast("int")
    cut = n.documents.select("doc_id", plain.alias("p"))
    # texts without words go after the cut: a condition before it would prepare each text twice
    length = F.when(F.col("p") != "  ", times("  ") + 1).alias("len")
    counts = cut_lineage(cut.select("doc_id", length, *[times(f" {w} ").alias(f"c{i}") for i, w in enumerate(words)])).filter("len IS NOT NULL")
    held = [F.count_if(F.col(f"c{i}") > 0).alias(f"df{i}") for i in range(len(words))]
    whole = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *held)

    def part(i: int) -> Column:
        c, df = F.col(f"c{i}"), F.col(f"df{i}")
        return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))

    hit = reduce(Column.__or__, [F.col(f"c{i}") > 0 for i in range(len(words))])
    rows = counts.filter(hit).join(F.broadcast(whole))  # one row of totals
    return rows.select("doc_id", F.round(sum((part(i) for i in range(len(words))), F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def text_stats(n: News) -> DataFrame:
    return n.documents.select("doc_id", tx.word_count(F.col("content")).cast("long").alias("words"), F.length(dedupe.normalize_text(F.col("content"))).cast("long").alias("normalized"))


def hash_embedding(n: News) -> DataFrame:
    """The embedding of whole texts: its number of dimensions, their sum, and the first eight."""
    rows = n.documents.select("doc_id", tx.hash_embedding(F.col("content")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("e").cast("long").alias("dims"), F.round(total, 6).alias("total"), *[F.round(F.col("e")[i], 6).alias(f"e{i}") for i in range(8)])


def cjk_flag(n: News) -> DataFrame:
    return n.documents.select("doc_id", tx.is_cjk(F.col("content")).alias("cjk"))


def chunk_documents(n: News) -> DataFrame:
    return tx.chunk_documents(n.documents.select("doc_id", "content"))


def datetime_parse(n: News) -> DataFrame:
    """Times as they come, in several forms and some broken, as times in UTC."""
    d, at = F.col("doc_id"), F.col("created_at")
    form = lambda pattern, end="": F.concat(F.date_format(at, pattern), F.lit(end))
    raw = F.when(d % 7 == 0, form("yyyy-MM-dd")).when(d % 7 == 1, form("yyyy-MM-dd'T'HH:mm:ss")).when(d % 7 == 2, form("yyyy-MM-dd'T'HH:mm", "+02:00")).when(d % 7 == 3, form("yyyy-MM-dd HH:mm:ss", ".250Z"))
    raw = raw.when(d % 7 == 4, form("yyyy/MM/dd")).when(d % 7 == 5, form("yyyy", "-13-40")).otherwise(F.lit(None))
    return n.documents.select("doc_id", tx.parse_datetime(raw).alias("at"))


def scenario_titles(n: News) -> DataFrame:
    """The scenario that a title names in front, if any."""
    d = F.col("doc_id")
    title = F.when(d % 4 == 0, F.concat(F.lit(" [Phase3 S"), (d % 9).cast("string"), F.lit("] x"))).when(d % 4 == 1, F.concat(F.lit("[Phase3 S"), d.cast("string"))).when(d % 4 == 2, F.concat(F.lit("[Phase2] [Phase3 S] "), F.lit("y"))).otherwise(F.col("title"))
    return n.documents.select("doc_id", F.coalesce(tx.scenario_of_title(title), F.lit("-")).alias("scenario"))


def return_stats(n: News, limit: int = 20) -> DataFrame:
    """How many documents the clients' feeds give on average, and how many clients get none."""
    from tickerloom.operators.feeds import client_feed

    sizes = client_feed(n, limit).groupBy("client_id").agg(F.count("*").alias("n"))
    every = n.clients.select("client_id").join(sizes, "client_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.count("*").alias("clients"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") == 0).alias("empty"))


def piece_embeddings(n: News) -> DataFrame:
    """Pieces by the SQL table function, each with the vector of the default provider; first and last number and sum as digests."""
    providers.register_table_functions(n.spark)
    docs = n.documents.select("doc_id", "content")
    cut = n.spark.sql("SELECT * FROM pieces(TABLE({docs}), id => 'doc_id', text => 'content')", docs=docs)
    made = providers.embed(cut)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return made.select("doc_id", "piece", F.size("embedding").cast("long").alias("dims"), F.round(total, 6).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"))


def _raw_extraction(n: News) -> DataFrame:
    """Answers as an extraction model writes them: fenced, out of range, out of vocabulary, incomplete or broken."""
    d = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit('{"impact_score": '), ((F.col("doc_id") * 7) % 140).cast("string"), F.lit(', "impact_tier": "'),
        F.when(F.col("doc_id") % 4 == 0, "gold").when(F.col("doc_id") % 4 == 1, "HUGE").otherwise("BRONZE"),
        F.lit('", "instruments": [{"ticker": "t'), d, F.lit('"}], "themes": ["Supply Chain", "nonsense", "esg"], "summary": "s'), d, F.lit('"}'),
    )
    raw = F.when(F.col("doc_id") % 10 == 3, F.lit("{broken")).when(F.col("doc_id") % 10 == 4, F.lit('{"impact_score": 5}')).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return n.documents.select("doc_id", raw.alias("raw"))


def extraction_parse(n: News) -> DataFrame:
    rows = _raw_extraction(n).select("doc_id", tx.parse_extraction(F.col("raw")).alias("x"))
    x = F.col("x")
    return rows.select(
        "doc_id", F.coalesce(x["impact_score"], F.lit(-1)).alias("impact"), F.coalesce(x["impact_tier"], F.lit("-")).alias("tier"),
        F.coalesce(F.array_join(x["tickers"], ","), F.lit("")).alias("tickers"), F.coalesce(F.array_join(x["themes"], ","), F.lit("")).alias("themes"),
    )


def restrictions_parse(n: News) -> DataFrame:
    """Excluded industries and faith of a client's JSON restrictions; every sixth is broken."""
    c = F.col("client_id")
    raw = F.when(c % 6 == 5, F.lit("oops")).otherwise(F.concat(F.lit('{"ethical_sector": {"excluded_industries": '), F.when(c % 2 == 0, '["tobacco", "arms"]').otherwise("[]"), F.lit(', "faith_based": "'), F.when(c % 3 == 0, "islamic").otherwise("none"), F.lit('"}}')))
    x = F.from_json(raw, tx.RESTRICTIONS)["ethical_sector"]
    size = F.coalesce(F.size(F.coalesce(x["excluded_industries"], F.array().cast("array<string>"))), F.lit(0))
    return n.clients.select("client_id", size.cast("long").alias("excluded"), ((size > 0) | (F.coalesce(x["faith_based"], F.lit("none")) != "none")).alias("has_exclusions"))


def theme_vocabulary_gate(n: News) -> DataFrame:
    """Themes in use, and whether the vocabulary has them."""
    rows = n.documents.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))
    return rows.select("theme", "n", F.col("theme").isin(v.THEMES).alias("known"))


def schema_gate(n: News) -> DataFrame:
    """Documents that lack a score, tier, themes or date."""
    return n.documents.filter(F.col("impact_score").isNull() | F.col("impact_tier").isNull() | (F.size("themes") == 0) | F.col("created_at").isNull()).select("doc_id", "impact_tier")


#: What documents must not speak of, by client type.
ESG_WORDS = {"PENSION": "license", "LONG_ONLY": "copyright", "FAMILY_OFFICE": "free of charge"}
#: Fixed value: the trust of a document without a source.
NO_SOURCE_TRUST = 10


def ips_filter(n: News) -> DataFrame:
    """Documents left for each client type by trust, after sector prohibition in either direction and after topics that it excludes."""
    least = lookup({"HEDGE_FUND": 3, "PENSION": 7, "LONG_ONLY": 5, "FAMILY_OFFICE": 10, "ADVISOR": 0}, F.col("client_type"))
    barred = F.concat(F.lit("NATION_"), F.length("client_type").cast("string"))
    types = n.clients.select("client_type").distinct().withColumn("least", least).withColumn("barred", barred)
    sectors = n.affects.join(n.instruments.select("instrument_id", "company_id"), "instrument_id").join(n.companies.select("company_id", "sector"), "company_id").select("doc_id", "sector").distinct()
    # each text is looked at once, and goes on as the types that exclude it
    text = F.lower(F.concat_ws(" ", "title", "content"))
    spoken = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(t)) for t, w in ESG_WORDS.items()]))
    docs = n.documents.select("doc_id", "source", spoken.alias("spoken")).join(n.sources.select("source", "trust_points"), "source", "left")
    trusted = F.coalesce("trust_points", F.lit(NO_SOURCE_TRUST)) >= F.col("least")
    rows = docs.join(F.broadcast(types), trusted).filter(~F.array_contains("spoken", F.col("client_type"))).drop("spoken")  # five client types
    bad = rows.join(sectors, "doc_id").filter(F.contains("sector", F.col("barred")) | F.contains("barred", F.col("sector"))).select("doc_id", "client_type").distinct()
    return rows.join(bad, ["doc_id", "client_type"], "left_anti").groupBy("client_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


def ips_rerank(n: News) -> DataFrame:
    """50 + 20 theme share + 15 event priority, the best 5 documents of each client type's leading theme."""
    lead = n.clients.groupBy("client_type").agg(F.min("client_id").alias("client_id")).join(n.clients.select("client_id", "mandate_themes"), "client_id")
    wanted = lead.select("client_type", F.size("mandate_themes").alias("many"), F.explode("mandate_themes").alias("theme"))
    docs = n.documents.select("doc_id", "event_type", F.explode("themes").alias("theme")).join(wanted, "theme")
    shared = docs.groupBy("client_type", "many", "doc_id", "event_type").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(F.lit("EARNINGS"), F.lit("M&A"), F.lit("REGULATORY")), F.coalesce("event_type", F.lit("")))
    event = F.when(place > 0, 1 - (place - 1) / 3 * 0.5).otherwise(0.3)
    rows = shared.select("client_type", "doc_id", F.round(50 + 20 * (F.col("n") / F.col("many")) + 15 * event, 6).alias("score"))
    return rows.withColumn("rank", rank_in(["client_type"], F.col("score").desc(), F.col("doc_id"))).filter("rank <= 5")


def contained(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of (q, ...) and (name, ...) of which one contains the other.

    A text that is contained has all its runs of three characters in the other, so each side joins with its rarest run
    on all runs of the other side; texts of fewer than three characters match nothing.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))

    def cut(rows: DataFrame, c: str) -> DataFrame:
        return rows.filter(F.length(c) >= 3).select(c, F.explode(runs(F.col(c))).alias("run")).distinct()

    def rarest(rows: DataFrame, c: str, other: DataFrame) -> DataFrame:
        often = other.groupBy("run").agg(F.count("*").alias("often"))
        return rows.join(often, "run", "left").groupBy(c).agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)), "run")).alias("run"))

    q, name = cut(asked.select("q"), "q"), cut(names.select("name"), "name")
    met = rarest(q, "q", name).join(name, "run").select("q", "name").union(rarest(name, "name", q).join(q, "run").select("q", "name")).distinct()
    return met.filter(F.contains("name", F.col("q")) | F.contains("q", F.col("name"))).join(asked, "q").join(names, "name")


def _company_names(n: News) -> DataFrame:
    """Names and aliases of companies, lower case."""
    one = n.companies.select("company_id", F.lower("company").alias("name"), F.length("company").alias("size"))
    return one.union(n.companies.select("company_id", F.lower(F.concat(F.lit("S-"), F.col("company_id").cast("string"), F.lit(" Holding"))), F.length("company")))


def company_fuzzy_match(n: News) -> DataFrame:
    """Parts of names, names with more around them, and aliases, matched by containment either way; shortest name first."""
    c = F.col("company_id")
    asked = n.companies.select(F.lower(
        F.when(c % 3 == 0, F.concat(F.lit("#"), F.lpad(c.cast("string"), 9, "0"))).when(c % 3 == 1, F.concat(F.lit("The "), "company", F.lit(" Inc")))
        .otherwise(F.concat(F.lit("S-"), c.cast("string"), F.lit(" hold")))).alias("q")).distinct()
    rows = contained(asked, _company_names(n))
    return rows.withColumn("r", rank_in(["q"], F.col("size"), F.col("company_id"))).filter("r = 1").select("q", "company_id")


def ticker_scan(n: News) -> DataFrame:
    """Known tickers that stand as whole words, case counting, in whole texts and aren't extracted yet; here every seventh text names two."""
    d = F.col("doc_id").cast("string")
    more = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" (T"), d, F.lit("), T"), ((F.col("doc_id") * 31) % n.sizes["part"]).cast("string"), F.lit(" and t1 or XT1."))).otherwise("")
    texts = n.documents.select("doc_id", F.concat(F.coalesce("content", F.lit("")), more).alias("content"))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("ticker"))
    found = words.join(n.instruments.select("ticker", "instrument_id"), "ticker")
    return found.join(n.affects.select("doc_id", "instrument_id"), ["doc_id", "instrument_id"], "left_anti").select("doc_id", "ticker")


def alias_resolve(n: News) -> DataFrame:
    """Upper-case scheme and trimmed value to an instrument; unknown values have none."""
    aliases = n.instruments.select(F.lit("TICKER").alias("scheme"), F.col("ticker").alias("value"), "instrument_id")
    asked = n.documents.select("doc_id", F.upper(F.lit("ticker")).alias("scheme"), F.trim(F.concat(F.lit(" T"), (F.col("doc_id") * 3).cast("string"), F.lit(" "))).alias("value"))
    return asked.join(aliases, ["scheme", "value"], "left").select("doc_id", F.coalesce("instrument_id", F.lit(-1)).alias("instrument_id"))


def doc_lookup_access(n: News) -> DataFrame:
    """OK, DENIED or NOT_FOUND for a list of asked documents, of which some don't exist, in groups 0 and 1."""
    asked = n.documents.select((F.col("doc_id") * 2).alias("asked"))
    found = n.documents.select(F.col("doc_id").alias("asked"), "group_id")
    status = F.when(F.col("group_id").isNull(), "NOT_FOUND").when(F.col("group_id").isin(0, 1), "OK").otherwise("DENIED")
    return asked.join(found, "asked", "left").select("asked", status.alias("status"))


def upsert_latest(n: News) -> DataFrame:
    """Last write wins by key over two change sets."""
    old = n.instruments.select("instrument_id", "name", F.lit(1).alias("ts"))
    new = n.instruments.filter(F.col("instrument_id") % 3 == 0).select("instrument_id", F.upper("name").alias("name"), F.lit(2).alias("ts"))
    return old.unionByName(new).groupBy("instrument_id").agg(F.max_by("name", "ts").alias("name"))


def detach_delete(n: News) -> DataFrame:
    """Edges left by type after every seventh document is deleted."""
    gone = n.documents.filter(F.col("doc_id") % 7 == 0).select("doc_id")
    one = n.affects.join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("AFFECTS").alias("rel"), "n")
    return one.union(n.mentions.join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("MENTIONS"), "n"))


def accuracy_by_group(n: News) -> DataFrame:
    """Share of labelled documents whose tier agrees with their quality label, by group."""
    rows = n.documents.select("doc_id", "group_id", "impact_tier").join(n.table("labels"), "doc_id")
    hit = (F.col("impact_tier").isin("PLATINUM", "GOLD", "SILVER").cast("int") == F.col("quality")).cast("int")
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def golden_diff(n: News) -> DataFrame:
    """NEW, LOST, REGR, FIXED or SAME for checks of two runs, by a full outer join."""
    c = F.col("client_id")
    was = n.clients.filter(c % 3 != 0).select("client_id", (c % 4 == 0).alias("was"))
    now = n.clients.filter(c % 5 != 0).select("client_id", (c % 2 == 0).alias("now"))
    kind = F.when(F.col("was").isNull(), "NEW").when(F.col("now").isNull(), "LOST").when(F.col("was") & ~F.col("now"), "REGR").when(~F.col("was") & F.col("now"), "FIXED").otherwise("SAME")
    return was.join(now, "client_id", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def recall_at_k(n: News, k: int = 3) -> DataFrame:
    """Share of clients with a watchlist whose best k documents of the feed touch it, by client type."""
    from tickerloom.operators.feeds import client_feed

    feed = client_feed(n, k).select("client_id", "doc_id")
    seen = n.watches.select("client_id").distinct()
    hit = feed.join(n.affects.select("doc_id", "instrument_id"), "doc_id").join(n.watches, ["client_id", "instrument_id"], "left_semi").select("client_id").distinct().withColumn("hit", F.lit(1))
    rows = n.clients.select("client_id", "client_type").join(seen, "client_id", "left_semi").join(hit, "client_id", "left")
    return rows.groupBy("client_type").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


_BYTE = "('0x' || substr(sha256(coalesce(content, '')), (i * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1"
_HASH = ", ".join(f"round(('0x' || substr(sha256(coalesce(content, '')), {i * 2 + 1}, 2))::INT / 255.0::DOUBLE * 2 - 1, 6) AS e{i}" for i in range(8))
_R30 = "coalesce(power(2.718::DOUBLE, greatest(0, date_diff('second', created_at, TIMESTAMP '2024-01-31') // 86400) * -0.023::DOUBLE), 0.5)"
_SIM = ("sim", "SELECT v.vec_id, round(list_cosine_similarity(v.embedding, q.embedding), 9) AS similarity FROM vecs v, (SELECT embedding FROM vecs WHERE vec_id = 7) q")
_DV = ("dvs", "SELECT doc_id, group_id, created_at, region, trust_score, source, similarity FROM docs LEFT JOIN srcs USING (source) JOIN sim ON vec_id = doc_id % (SELECT embeddings FROM n)")
_SCORE = f"0.6::DOUBLE * similarity + 0.2::DOUBLE * coalesce(trust_score, 0.5) + 0.1::DOUBLE * {_R30}"


def _hybrid_sql(before: str, after: str) -> str:
    return f"SELECT doc_id, round({_SCORE}, 6) AS score, round(similarity, 6) AS similarity FROM (SELECT * FROM dvs WHERE {before} ORDER BY similarity DESC, doc_id LIMIT 30) WHERE {after} ORDER BY score DESC, doc_id LIMIT 10"


_REG = "coalesce(region, '') IN ('EUROPE', 'AFRICA')"
_TK = ("tk", f"SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(content), '{tx.BETWEEN_WORDS}')) AS t FROM docs) WHERE t <> '' GROUP BY 1, 2")
QUERIES = {f.__name__: f for f in (
    list_clients, client_profile, completeness_score, portfolio_holdings, holdings_totals, watchlist_items, profile_counts, scalar_scores, vector_topk, hybrid_search,
    hybrid_search_expanded, keyword_bm25, text_stats, hash_embedding, cjk_flag, chunk_documents, piece_embeddings, datetime_parse, scenario_titles, return_stats, extraction_parse, restrictions_parse, theme_vocabulary_gate,
    schema_gate, ips_filter, ips_rerank, company_fuzzy_match, ticker_scan, alias_resolve, doc_lookup_access, upsert_latest, detach_delete, accuracy_by_group,
    golden_diff, recall_at_k,
)} | {
    "vector_topk_scoped": lambda n: vector_topk(n, groups=(0, 1)),
    "hybrid_search_filtered": lambda n: hybrid_search(n, regions=("EUROPE", "AFRICA")),
    "hybrid_search_prefilter": lambda n: hybrid_search(n, regions=("EUROPE", "AFRICA"), prefilter=True),
}
SQL = {
    "chunk_documents": sql("SELECT doc_id, piece::INTEGER AS chunk_index, start_char::INTEGER AS start_char, end_char::INTEGER AS end_char, text AS content FROM pieces", *PIECES),
    "list_clients": sql("SELECT client_id, name, client_type, group_id FROM clients WHERE coalesce(status, 'active') <> 'defunct' ORDER BY name LIMIT 100"),
    "client_profile": sql("SELECT client_id, client_type, ticker AS benchmark, array_to_string(mandate_themes, ',') AS themes, coalesce(trim(mandate_text), '') AS mandate FROM clients LEFT JOIN instr ON instrument_id = benchmark_id"),
    "completeness_score": sql("""SELECT client_id, round(0.35::DOUBLE * (client_id IN (SELECT client_id FROM holds UNION SELECT client_id FROM watches))::INT + 0.35::DOUBLE * (0.5::DOUBLE * (mandate_type IS NOT NULL)::INT
        + 0.5::DOUBLE * coalesce(trim(mandate_text) <> '', FALSE)::INT) + 0.20::DOUBLE * (esg_constrained IS NOT NULL)::INT + 0.10::DOUBLE * (primary_contact IS NOT NULL AND alert_frequency IS NOT NULL)::INT, 2) AS score FROM clients"""),
    "portfolio_holdings": sql("SELECT client_id, rank, ticker, format('{:.1f}%', weight * 100) AS percent, shares FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY weight DESC, ticker) AS rank FROM holds JOIN instr USING (instrument_id))"),
    "watchlist_items": sql("SELECT client_id, ticker FROM watches JOIN instr USING (instrument_id)"),
    "profile_counts": sql("SELECT client_id, coalesce(h, 0) AS holdings, coalesce(w, 0) AS watched, (excluded_sector IS NOT NULL)::BIGINT AS excluded, (benchmark_id IS NOT NULL)::BIGINT AS benchmarks FROM clients LEFT JOIN (SELECT client_id, count(*) AS h FROM holds GROUP BY 1) USING (client_id) LEFT JOIN (SELECT client_id, count(*) AS w FROM watches GROUP BY 1) USING (client_id)"),
    "scalar_scores": sql(f"""SELECT doc_id, round({_R30}, 9) AS recency30, round(exp(greatest(0, date_diff('second', created_at, TIMESTAMP '2024-01-31')) / 60.0::DOUBLE * (-ln(2.0::DOUBLE) / 600)), 9) AS breaking,
        round(coalesce(least(1.0, greatest(0.0, impact_score / 100.0::DOUBLE)), 0.0), 9) AS impact, coalesce(trust_score, 0.5)::DOUBLE AS trust FROM docs LEFT JOIN srcs USING (source)"""),
    "vector_topk": sql("SELECT doc_id, round(similarity, 6) AS similarity FROM dvs ORDER BY dvs.similarity DESC, doc_id LIMIT 20", _SIM, _DV),
    "vector_topk_scoped": sql("SELECT doc_id, round(similarity, 6) AS similarity FROM dvs WHERE group_id IN (0, 1) ORDER BY dvs.similarity DESC, doc_id LIMIT 20", _SIM, _DV),
    "hybrid_search": sql(_hybrid_sql("TRUE", "TRUE"), _SIM, _DV),
    "hybrid_search_filtered": sql(_hybrid_sql("TRUE", _REG), _SIM, _DV),
    "hybrid_search_prefilter": sql(_hybrid_sql(_REG, "TRUE"), _SIM, _DV),
    "hybrid_search_expanded": sql(f"""SELECT doc_id, score, 'semantic' AS via FROM sem UNION ALL
        SELECT doc_id, round(0.2::DOUBLE * coalesce(trust_score, 0.5) + 0.1::DOUBLE * {_R30} + 0.1::DOUBLE, 6), 'graph' FROM fresh JOIN docs USING (doc_id) LEFT JOIN srcs USING (source)""", _SIM, _DV,
        ("sem", _hybrid_sql("TRUE", "TRUE")), ("seeds", "SELECT doc_id, row_number() OVER (ORDER BY round(similarity, 6) DESC, doc_id) AS sr FROM (SELECT * FROM dvs ORDER BY similarity DESC, doc_id LIMIT 5)"),
        ("fresh", """SELECT DISTINCT doc_id FROM (SELECT a.doc_id FROM affects a JOIN (SELECT DISTINCT instrument_id, sr FROM affects JOIN seeds USING (doc_id)) l USING (instrument_id) JOIN docs d ON d.doc_id = a.doc_id
            QUALIFY row_number() OVER (PARTITION BY instrument_id, sr ORDER BY created_at DESC, a.doc_id) <= 5) WHERE doc_id NOT IN (SELECT doc_id FROM sem)""")),
    "keyword_bm25": sql("""SELECT doc_id, round(sum(ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
        FROM tk JOIN (SELECT t, count(*) AS df FROM tk GROUP BY 1) USING (t) JOIN sz USING (doc_id), (SELECT count(*) AS n, avg(len) AS mean FROM sz) n WHERE t IN ('the', 'license', 'version') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""",
        _TK, ("sz", "SELECT doc_id, sum(c) AS len FROM tk GROUP BY 1")),
    "text_stats": sql(r"SELECT doc_id, len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+'))::BIGINT AS words, length(trim(regexp_replace(lower(content), '[ \t\n\x0B\f\r]+', ' ', 'g')))::BIGINT AS normalized FROM docs"),
    "datetime_parse": sql("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN date_trunc('day', created_at) WHEN 1 THEN date_trunc('second', created_at) WHEN 2 THEN date_trunc('minute', created_at) - INTERVAL 2 HOUR
        WHEN 3 THEN date_trunc('second', created_at) + INTERVAL 250 MILLISECOND END AS at FROM docs""".replace(" AS at ", ' AS "at" ')),
    "scenario_titles": sql("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Phase3 S' || doc_id % 9 ELSE '-' END AS scenario FROM docs"),
    "return_stats": sql("""SELECT count(*) AS clients, round(avg(coalesce(n, 0)), 6) AS mean, count(*) FILTER (n IS NULL) AS empty FROM clients LEFT JOIN (SELECT client_id, least(20, count(DISTINCT doc_id)) AS n
        FROM affects JOIN docs USING (doc_id) JOIN (SELECT client_id, instrument_id FROM holds UNION SELECT client_id, instrument_id FROM watches) USING (instrument_id) JOIN permitted USING (client_id, group_id) GROUP BY 1) USING (client_id)"""),
    "piece_embeddings": sql(f"""SELECT doc_id, piece::INTEGER AS piece, 384::BIGINT AS dims, round(12 * list_sum(list_transform(range(0, 32), lambda i: {_BYTE.replace('content', 'text')})), 6) AS total,
        round({_BYTE.replace('content', 'text').replace('i * 2', '0 * 2')}, 6) AS first FROM pieces""", *PIECES),
    "hash_embedding": sql(f"SELECT doc_id, 384::BIGINT AS dims, round(12 * list_sum(list_transform(range(0, 32), lambda i: {_BYTE})), 6) AS total, {_HASH} FROM docs"),
    "holdings_totals": sql("SELECT client_id, round(sum(weight), 4) AS total_weight, count(*) AS holdings FROM holds GROUP BY 1"),
    "cjk_flag": sql(r"SELECT doc_id, coalesce(regexp_matches(content, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]'), FALSE) AS cjk FROM docs"),
    "extraction_parse": sql(f"""SELECT doc_id, CASE WHEN doc_id % 10 IN (3, 4) THEN -1 ELSE least(100, doc_id * 7 % 140)::INT END AS impact,
        CASE WHEN doc_id % 10 IN (3, 4) THEN '-' WHEN doc_id % 4 = 0 THEN 'GOLD' WHEN doc_id % 4 = 1 THEN 'STANDARD' ELSE 'BRONZE' END AS tier,
        CASE WHEN doc_id % 10 IN (3, 4) THEN '' ELSE 'T' || doc_id END AS tickers, CASE WHEN doc_id % 10 IN (3, 4) THEN '' ELSE 'supply_chain,esg' END AS themes FROM docs"""),
    "restrictions_parse": sql("SELECT client_id, CASE WHEN client_id % 6 <> 5 AND client_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS excluded, client_id % 6 <> 5 AND (client_id % 2 = 0 OR client_id % 3 = 0) AS has_exclusions FROM clients"),
    "theme_vocabulary_gate": sql(f"SELECT theme, count(*) AS n, list_contains({_list(v.THEMES)}, theme) AS known FROM (SELECT unnest(themes) AS theme FROM docs) GROUP BY 1"),
    "schema_gate": sql("SELECT doc_id, impact_tier FROM docs WHERE impact_score IS NULL OR impact_tier IS NULL OR len(themes) = 0 OR created_at IS NULL"),
    "ips_filter": sql(f"""SELECT client_type, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most FROM docs LEFT JOIN srcs USING (source), (SELECT DISTINCT client_type FROM clients) t
        WHERE NOT coalesce(contains(lower(concat_ws(' ', title, content)), {_case(ESG_WORDS, 'client_type')}), FALSE) AND coalesce(trust_points, {NO_SOURCE_TRUST}) >= {_case({'HEDGE_FUND': 3, 'PENSION': 7, 'LONG_ONLY': 5, 'FAMILY_OFFICE': 10, 'ADVISOR': 0}, 'client_type')} AND NOT EXISTS (SELECT 1 FROM affects a JOIN instr USING (instrument_id) JOIN comps USING (company_id)
            WHERE a.doc_id = docs.doc_id AND (contains(sector, 'NATION_' || length(client_type)) OR contains('NATION_' || length(client_type), sector))) GROUP BY 1"""),
    "ips_rerank": sql("""SELECT client_type, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY client_type ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT client_type, doc_id, round(50 + 20 * len(list_filter(themes, lambda t: list_contains(mandate_themes, t)))::DOUBLE / len(mandate_themes) + 15 * CASE event_type WHEN 'EARNINGS' THEN 1.0 WHEN 'M&A' THEN 1 - 1 / 3.0::DOUBLE * 0.5
            WHEN 'REGULATORY' THEN 1 - 2 / 3.0::DOUBLE * 0.5 ELSE 0.3 END, 6) AS score FROM docs JOIN (SELECT client_type, arg_min(mandate_themes, client_id) AS mandate_themes FROM clients GROUP BY 1) ON list_has_any(themes, mandate_themes))) WHERE rank <= 5"""),
    "company_fuzzy_match": sql("""SELECT q, company_id FROM (SELECT q, b.company_id, row_number() OVER (PARTITION BY q ORDER BY size, b.company_id) AS r FROM ask JOIN nms b ON contains(name, q) OR contains(q, name)) WHERE r = 1""",
        ("ask", """SELECT DISTINCT lower(CASE company_id % 3 WHEN 0 THEN '#' || lpad(company_id::VARCHAR, 9, '0') WHEN 1 THEN 'The ' || company || ' Inc' ELSE 'S-' || company_id || ' hold' END) AS q FROM comps"""),
        ("nms", "SELECT company_id, lower(company) AS name, length(company) AS size FROM comps UNION ALL SELECT company_id, lower('S-' || company_id || ' Holding'), length(company) FROM comps")),
    "ticker_scan": sql("""SELECT doc_id, ticker FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content || CASE WHEN doc_id % 7 = 0 THEN ' (T' || doc_id || '), T' || (doc_id * 31) % (SELECT part FROM n) || ' and t1 or XT1.' ELSE '' END,
        '[A-Za-z0-9_]+')) AS ticker FROM docs) w JOIN instr USING (ticker) WHERE NOT EXISTS (SELECT 1 FROM affects a WHERE a.doc_id = w.doc_id AND a.instrument_id = instr.instrument_id)"""),
    "alias_resolve": sql("SELECT doc_id, coalesce(instrument_id, -1) AS instrument_id FROM docs LEFT JOIN instr ON ticker = 'T' || (doc_id * 3)"),
    "doc_lookup_access": sql("SELECT a.doc_id * 2 AS asked, CASE WHEN b.group_id IS NULL THEN 'NOT_FOUND' WHEN b.group_id IN (0, 1) THEN 'OK' ELSE 'DENIED' END AS status FROM docs a LEFT JOIN docs b ON b.doc_id = a.doc_id * 2"),
    "upsert_latest": sql("SELECT instrument_id, CASE WHEN instrument_id % 3 = 0 THEN upper(name) ELSE name END AS name FROM instr"),
    "detach_delete": sql("SELECT 'AFFECTS' AS rel, count(*) AS n FROM affects WHERE doc_id % 7 <> 0 UNION ALL SELECT 'MENTIONS', count(*) FROM mentions WHERE doc_id % 7 <> 0"),
    "accuracy_by_group": sql("SELECT group_id, count(*) AS n, round(avg(((impact_tier IN ('PLATINUM', 'GOLD', 'SILVER'))::INT = quality)::INT), 6) AS accuracy FROM docs JOIN labels USING (doc_id) GROUP BY 1"),
    "golden_diff": sql("""SELECT CASE WHEN w IS NULL THEN 'NEW' WHEN c IS NULL THEN 'LOST' WHEN w AND NOT c THEN 'REGR' WHEN NOT w AND c THEN 'FIXED' ELSE 'SAME' END AS kind, count(*) AS n
        FROM (SELECT client_id, client_id % 4 = 0 AS w FROM clients WHERE client_id % 3 <> 0) FULL JOIN (SELECT client_id, client_id % 2 = 0 AS c FROM clients WHERE client_id % 5 <> 0) USING (client_id) GROUP BY 1"""),
    "recall_at_k": sql("""SELECT client_type, count(*) AS n, round(avg((client_id IN (SELECT f.client_id FROM feed f JOIN affects USING (doc_id) JOIN watches w ON w.client_id = f.client_id AND w.instrument_id = affects.instrument_id))::INT), 6) AS recall
        FROM clients WHERE client_id IN (SELECT client_id FROM watches) GROUP BY 1""",
        ("pos", "SELECT client_id, instrument_id FROM holds UNION SELECT client_id, instrument_id FROM watches"),
        ("feed", """SELECT client_id, doc_id FROM (SELECT client_id, doc_id, row_number() OVER (PARTITION BY client_id ORDER BY max(impact_score) DESC NULLS LAST, doc_id) AS rank
            FROM affects JOIN docs USING (doc_id) JOIN pos USING (instrument_id) JOIN permitted USING (client_id, group_id) GROUP BY client_id, doc_id) WHERE rank <= 3""")),
}
