"""The full document query: vector candidates over pieces, every filter, the best piece of a document, weights, expansion by peers and related documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import scoring as sc
from tickerloom.functions import text as tx
from tickerloom.operators.clients import _R30, _SIM, _asked
from tickerloom.operators.feeds import rank_in
from tickerloom.operators.graph import newest_shared
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import PIECES, sql

SNIPPET = 500
RESERVED = ("title", "group", "source", "language", "created")


@dataclass(frozen=True)
class Ask:
    """A query: None means no filter. The first three lists restrict the vector search; the others its results, unless ``prefilter``."""

    k: int = 10
    groups: tuple[int, ...] | None = None
    sources: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    regions: tuple[str, ...] | None = None
    sectors: tuple[str, ...] | None = None
    companies: tuple[str, ...] | None = None
    first_day: str | None = None
    last_day: str | None = None
    least_impact: int | None = None
    tiers: tuple[str, ...] | None = None
    events: tuple[str, ...] | None = None
    name_part: str | None = None
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.6, "trust": 0.2, "recency": 0.1, "graph": 0.1})
    prefilter: bool = False

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 0.01:
            raise ValueError("the weights of semantic, trust, recency and graph must add up to 1")


def list_or_single(c: Column) -> Column:
    """A JSON list of strings, or the text itself as its only element; null is empty."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


def described(n: News) -> DataFrame:
    """Documents with their source's region and trust and with sectors and companies as metadata has them: JSON lists, and sometimes one bare name."""
    d = F.col("doc_id")
    sectors = F.when(d % 6 == 0, "tech").when(d % 4 == 0, '["energy", "tech"]').when(d % 4 == 1, '["banks"]').when(d % 4 == 2, "[]")
    companies = F.when(d % 5 == 0, F.lit("C1")).otherwise(F.concat(F.lit('["C'), (d % 7).cast("string"), F.lit('", "C9"]')))
    return n.documents.withColumn("sectors", sectors).withColumn("companies", companies).join(n.sources.select("source", "region", "trust_score"), "source", "left")


def with_vectors(n: News, pieces: DataFrame) -> DataFrame:
    """Pieces (doc_id, piece) with the number of each one's vector."""
    place = F.col("doc_id") * (1 + 6 * F.col("piece")) + F.col("piece")
    return pieces.withColumn("vec_id", place % n.sizes["embeddings"])


def pieces(n: News, docs: DataFrame) -> DataFrame:
    """(doc_id, piece, vec_id): every piece of each whole text."""
    cut = tx.chunk_documents(docs.select("doc_id", "content"), with_content=False)
    return with_vectors(n, cut.select("doc_id", F.col("chunk_index").alias("piece")))


def conditions(a: Ask) -> tuple[Column, Column]:
    """What the vector search restricts to, and what is filtered after it."""
    every = lambda parts: F.forall(F.array(F.lit(True), *parts), lambda x: x)
    isin = lambda c, values: [] if values is None else [F.coalesce(F.col(c).isin(list(values)), F.lit(False))]
    overlap = lambda c, values: [] if values is None else [F.arrays_overlap(list_or_single(F.col(c)), F.array(*map(F.lit, values)))]
    before = isin("group_id", a.groups) + isin("source", a.sources) + isin("language", a.languages)
    after = isin("impact_tier", a.tiers) + isin("event_type", a.events) + overlap("sectors", a.sectors) + overlap("companies", a.companies)
    if a.regions is not None:
        after.append(F.coalesce("region", F.lit("")).isin(list(a.regions)))
    if a.first_day:
        after.append(F.col("created_at").isNull() | (F.col("created_at") >= F.to_timestamp_ntz(F.lit(a.first_day))))
    if a.last_day:
        after.append(F.col("created_at").isNull() | (F.col("created_at") < F.to_timestamp_ntz(F.lit(a.last_day)) + F.expr("INTERVAL 1 DAY")))
    if a.least_impact is not None:
        after.append(F.coalesce(F.col("impact_score") >= a.least_impact, F.lit(False)))
    if a.name_part:
        after.append(F.contains(F.lower("title"), F.lit(a.name_part.lower())))
    return every(before), every(after)


def query_documents(n: News, a: Ask | None = None, index: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, score, similarity, piece, snippet): the best piece of each document among the 3 k nearest pieces of all.

    Texts are cut here unless ``index`` has the pieces (doc_id, piece) of every document, as a piece index keeps them.
    """
    a = a or Ask()
    before, after = conditions(a)
    if a.prefilter:
        before = before & after
    docs = described(n)
    scores = n.vectors.join(F.broadcast(_asked(n))).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))  # one row asked
    admitted = docs.filter(before)
    cut = pieces(n, admitted) if index is None else with_vectors(n, index.select("doc_id", "piece")).join(admitted.select("doc_id"), "doc_id", "left_semi")
    # keys first: metadata and texts are looked up for the few that stay
    near = cut.join(scores, "vec_id").orderBy(F.desc("similarity"), "doc_id", "piece").limit(3 * a.k)
    found = near.join(docs, "doc_id").filter(after)
    best = found.withColumn("r", rank_in(["doc_id"], F.col("similarity").desc(), F.col("piece"))).filter("r = 1")
    w = a.weights
    score = w["semantic"] * F.col("similarity") + w["trust"] * F.coalesce("trust_score", F.lit(0.5)) + w["recency"] * sc.recency30(F.col("created_at"), n.now)
    rows = best.select("doc_id", F.round(score, 6).alias("score"), F.round("similarity", 6).alias("similarity"), "piece", "content")
    top = rows.orderBy(F.desc("score"), "doc_id").limit(a.k)
    shown = top.withColumn("snippet", F.substring(tx.piece_of(F.col("content"), F.col("piece")), 1, SNIPPET)).drop("content")
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # k rows


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("rank", "doc_id", "score", "similarity")


def snippets(n: News) -> DataFrame:
    return query_documents(n).select("rank", "doc_id", "piece", F.length("snippet").cast("long").alias("chars"), F.md5("snippet").alias("digest"))


def metadata_view(n: News) -> DataFrame:
    """A document's metadata without the keys that the answer has as fields of its own."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    pairs = F.create_map(*[x for k, name in (("title", "title"), ("group", "group_id"), ("source", "source"), ("language", "language"), ("created", "created_at"), ("region", "region"), ("event", "event_code")) for x in (F.lit(k), c(name))])
    left = F.map_filter(pairs, lambda k, v: ~k.isin(list(RESERVED)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(left)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return described(n).select("doc_id", text.alias("metadata"))


def expanded(n: News, k: int = 10) -> DataFrame:
    """(place, doc_id, via, seed, score): documents on the instruments of the five nearest documents and on up to three peers of each.

    Of each instrument the 5 newest, of each peer (same sector, by key) the 3 newest; a document counts by the first way that leads to it,
    and what the query itself finds is left out. Only the first k ways are kept.
    """
    scores = n.vectors.join(F.broadcast(_asked(n))).select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))  # one row asked
    docs = n.documents.select("doc_id", "created_at", "source", (F.col("doc_id") % n.sizes["embeddings"]).alias("vec_id"))
    seeds = docs.join(scores, "vec_id").orderBy(F.desc("similarity"), "doc_id").limit(5)
    seeds = seeds.select(F.col("doc_id").alias("seed"), F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")).alias("s"))  # five rows
    ways = n.affects.select(F.col("doc_id").alias("seed"), "instrument_id").join(F.broadcast(seeds), "seed").distinct()
    ways = ways.withColumn("t", rank_in(["seed"], F.col("instrument_id")))
    sector = n.instruments.select("instrument_id", "company_id").join(n.companies.select("company_id", "sector"), "company_id").select("instrument_id", "sector")
    few = sector.withColumn("r", rank_in(["sector"], F.col("instrument_id"))).filter("r <= 4").select("sector", F.col("instrument_id").alias("peer"))
    peers = ways.join(sector, "instrument_id").join(few, "sector").filter("peer <> instrument_id").withColumn("p", rank_in(["seed", "instrument_id"], F.col("peer"))).filter("p <= 3")
    every = ways.select("seed", "s", "t", F.lit(0).alias("p"), "instrument_id").union(peers.select("seed", "s", "t", "p", "peer"))
    reach = every.join(n.affects.select("doc_id", "instrument_id"), "instrument_id").join(docs.select("doc_id", "created_at", "source"), "doc_id").distinct()
    fresh = reach.withColumn("r", rank_in(["s", "t", "p"], F.col("created_at").desc(), F.col("doc_id"))).filter(F.col("r") <= F.when(F.col("p") == 0, 5).otherwise(3))
    new = fresh.join(query_documents(n, Ask(k=k)).select("doc_id"), "doc_id", "left_anti")
    first = new.withColumn("n", rank_in(["doc_id"], *map(F.col, ("s", "t", "p", "r")))).filter("n = 1")
    way = ["s", "t", "p", "r"]
    kept = first.orderBy(*way).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*way)))  # k rows
    score = 0.2 * F.coalesce("trust_score", F.lit(0.5)) + 0.1 * sc.recency30(F.col("created_at"), n.now) + 0.1
    return kept.join(n.sources.select("source", "trust_score"), "source", "left").select(
        "place", "doc_id", F.when(F.col("p") == 0, "instrument").otherwise("peer").alias("via"), "seed", F.round(score, 6).alias("score")
    )


def enriched(n: News, k: int = 10) -> DataFrame:
    """Results with the five newest documents that share a company with each."""
    top = query_documents(n, Ask(k=k)).select("doc_id", "rank")
    related = newest_shared(n, n.mentions, "company_id", 5, only=top.select("doc_id"))
    lists = related.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related"))), lambda x: x["related"].cast("string")), ",").alias("related"))
    return top.join(lists, "doc_id", "left").select("rank", "doc_id", F.coalesce("related", F.lit("")).alias("related"))


_ASKS = {
    "query_documents_dates": (Ask(first_day="2024-01-10", last_day="2024-01-25"), "TRUE", "created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-26'"),
    "query_documents_sectors": (Ask(sectors=("tech", "banks")), "TRUE", "list_has_any(sectors, ['tech', 'banks'])"),
    "query_documents_companies": (Ask(companies=("C1", "C3")), "TRUE", "list_has_any(companies, ['C1', 'C3'])"),
    "query_documents_languages": (Ask(languages=("en", "de")), "language IN ('en', 'de')", "TRUE"),
    "query_documents_sources": (Ask(sources=("src1", "src2", "src3")), "source IN ('src1', 'src2', 'src3')", "TRUE"),
    "query_documents_groups": (Ask(groups=(0, 3)), "group_id IN (0, 3)", "TRUE"),
    "query_documents_impact": (Ask(least_impact=50), "TRUE", "impact_score >= 50"),
    "query_documents_tiers": (Ask(tiers=("PLATINUM", "GOLD")), "TRUE", "impact_tier IN ('PLATINUM', 'GOLD')"),
    "query_documents_events": (Ask(events=("EARNINGS", "M&A")), "TRUE", "event_type IN ('EARNINGS', 'M&A')"),
    "query_documents_title": (Ask(name_part="E"), "TRUE", "contains(lower(title), 'e')"),
    "query_documents_weights": (Ask(weights={"semantic": 0.3, "trust": 0.4, "recency": 0.3, "graph": 0.0}), "TRUE", "TRUE"),
    "query_documents_everything": (
        Ask(groups=(0, 1, 2, 3), regions=("EUROPE", "AFRICA", "ASIA_PACIFIC"), least_impact=10, first_day="2024-01-03", sectors=("tech", "banks", "energy"), prefilter=True),
        "group_id IN (0, 1, 2, 3) AND coalesce(region, '') IN ('EUROPE', 'AFRICA', 'ASIA_PACIFIC') AND impact_score >= 10 AND created_at >= TIMESTAMP '2024-01-03' AND list_has_any(sectors, ['tech', 'banks', 'energy'])", "TRUE",
    ),
}


def _ctes(a: Ask, before: str, after: str) -> list[tuple[str, str]]:
    w = a.weights
    return [
        _SIM,
        ("des", """SELECT docs.*, region, trust_score, CASE WHEN doc_id % 6 = 0 THEN ['tech'] WHEN doc_id % 4 = 0 THEN ['energy', 'tech'] WHEN doc_id % 4 = 1 THEN ['banks'] ELSE []::VARCHAR[] END AS sectors,
            CASE WHEN doc_id % 5 = 0 THEN ['C1'] ELSE ['C' || doc_id % 7, 'C9'] END AS companies FROM docs LEFT JOIN srcs USING (source)"""),
        *PIECES,
        ("pcs", "SELECT doc_id, piece, text, (doc_id * (1 + 6 * piece) + piece) % (SELECT embeddings FROM n) AS vec_id FROM pieces"),
        ("top", f"SELECT * FROM pcs JOIN des USING (doc_id) JOIN sim USING (vec_id) WHERE {before} ORDER BY similarity DESC, doc_id, piece LIMIT {3 * a.k}"),
        ("best", f"SELECT * FROM top WHERE {after} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, piece) = 1"),
        ("res", f"""SELECT doc_id, piece, round({w['semantic']}::DOUBLE * similarity + {w['trust']}::DOUBLE * coalesce(trust_score, 0.5) + {w['recency']}::DOUBLE * {_R30}, 6) AS score, round(similarity, 6) AS similarity,
            substr(text, 1, {SNIPPET}) AS snippet FROM best"""),
        ("ans", f"SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM res QUALIFY rank <= {a.k}"),
    ]


_PLAIN = _ctes(Ask(), "TRUE", "TRUE")
QUERIES = {name: (lambda n, a=a: _short(query_documents(n, a))) for name, (a, _, _) in _ASKS.items()} | {
    "query_documents_snippets": snippets, "query_documents_metadata": metadata_view, "query_documents_expanded": expanded, "query_documents_enriched": enriched,
}
SQL = {name: sql("SELECT rank, doc_id, score, similarity FROM ans", *_ctes(a, before, after)) for name, (a, before, after) in _ASKS.items()} | {
    "query_documents_snippets": sql("SELECT rank, doc_id, piece, length(snippet) AS chars, md5(snippet) AS digest FROM ans", *_PLAIN),
    "query_documents_metadata": sql("SELECT doc_id, 'event=' || event_code || ',region=' || coalesce(region, '') AS metadata FROM des", *_PLAIN),
    "query_documents_expanded": sql(f"""SELECT place, doc_id, CASE p WHEN 0 THEN 'instrument' ELSE 'peer' END AS via, seed, round(0.2::DOUBLE * coalesce(trust_score, 0.5) + 0.1::DOUBLE * {_R30} + 0.1::DOUBLE, 6) AS score
        FROM (SELECT * EXCLUDE (created_at), row_number() OVER (ORDER BY s, t, p, r) AS place FROM firsts) JOIN des USING (doc_id) WHERE place <= 10""", *_PLAIN,
        ("seeds", "SELECT doc_id AS seed, row_number() OVER (ORDER BY similarity DESC, doc_id) AS s FROM docs JOIN sim ON vec_id = doc_id % (SELECT embeddings FROM n) QUALIFY s <= 5"),
        ("ways", "SELECT *, row_number() OVER (PARTITION BY seed ORDER BY instrument_id) AS t FROM (SELECT DISTINCT seed, s, instrument_id FROM affects JOIN seeds ON doc_id = seed)"),
        ("ise", "SELECT instrument_id, sector FROM instr JOIN comps USING (company_id)"),
        ("every1", """SELECT seed, s, t, 0 AS p, instrument_id FROM ways UNION ALL SELECT seed, s, t, row_number() OVER (PARTITION BY seed, w.instrument_id ORDER BY y.instrument_id) AS p, y.instrument_id
            FROM ways w JOIN ise x ON x.instrument_id = w.instrument_id JOIN ise y ON x.sector = y.sector AND y.instrument_id <> x.instrument_id QUALIFY p <= 3"""),
        ("fresh", """SELECT *, row_number() OVER (PARTITION BY s, t, p ORDER BY created_at DESC, doc_id) AS r FROM (SELECT DISTINCT seed, s, t, p, doc_id, created_at FROM every1 JOIN affects USING (instrument_id) JOIN docs USING (doc_id))
            QUALIFY r <= CASE p WHEN 0 THEN 5 ELSE 3 END"""),
        ("firsts", "SELECT * FROM fresh WHERE doc_id NOT IN (SELECT doc_id FROM ans) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, t, p, r) = 1")),
    "query_documents_enriched": sql("""SELECT rank, doc_id, coalesce(related, '') AS related FROM ans LEFT JOIN (SELECT doc_id, string_agg(related, ',' ORDER BY created_at DESC, related) AS related FROM (
        SELECT doc_id, p.related, created_at FROM (SELECT DISTINCT x.doc_id, y.doc_id AS related FROM mentions x JOIN ans ON ans.doc_id = x.doc_id JOIN mentions y ON x.company_id = y.company_id AND x.doc_id <> y.doc_id) p
            JOIN (SELECT doc_id AS related, created_at FROM docs) d USING (related) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, related) <= 5) GROUP BY 1) USING (doc_id)""", *_PLAIN),
}
