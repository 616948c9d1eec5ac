"""Taking documents in, and the source registry.

Submissions are rows; validation, extraction, resolution of instruments, duplicates and the decision are columns of them, and a
batch becomes visible as a whole or not at all. Submissions of the test tables are its documents with some faults put in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import languages
from tickerloom.functions import text as tx
from tickerloom.functions import vocabulary as v
from tickerloom.operators import dedupe
from tickerloom.sources.domain import News, lookup
from tickerloom.sources.domain_sql import PIECES, _list, sql
from tickerloom.sources.lineage import cut_lineage, fresh_path
from tickerloom.sources.versions import Table, Tables

MOST_WORDS = 20_000
#: Directions and magnitudes of extracted instruments.
DIRECTIONS = {"UP": "positive", "DOWN": "negative"}
MAGNITUDES = {"HIGH": 0.05, "MODERATE": 0.02}
#: What stands for an extraction that failed.
DEFAULT_SCORE, DEFAULT_TIER, DEFAULT_EVENT = 25, "STANDARD", "OTHER"


def direction(c: Column) -> Column:
    return F.coalesce(lookup(DIRECTIONS, F.upper(c)), F.lit("neutral"))


def magnitude(c: Column) -> Column:
    return F.coalesce(lookup(MAGNITUDES, F.upper(c)), F.lit(0.01))


def primary_ticker(instruments: Column) -> Column:
    """The first instrument that goes up or down, else the first."""
    moving = F.filter(instruments, lambda i: F.upper(i["direction"]).isin("UP", "DOWN"))
    return F.coalesce(F.get(moving, F.lit(0))["ticker"], F.get(instruments, F.lit(0))["ticker"])


def company_slug(name: Column) -> Column:
    """Lower case, spaces as hyphens, no dots and commas, at most 50 characters."""
    return F.substring(F.translate(F.lower(name), " .,", "-"), 1, 50)


def submissions(n: News) -> DataFrame:
    """Documents as they come in: blank titles, unknown or inactive sources, unknown, blank and no languages and groups without right among them."""
    d = F.col("doc_id")
    return n.documents.select(
        "doc_id", F.when(d % 31 == 0, "  ").otherwise(F.col("title")).alias("title"), F.when(d % 37 == 0, F.lit(None)).otherwise(F.col("content")).alias("content"),
        F.when(d % 41 == 0, "nowhere").otherwise(F.col("source")).alias("source"), F.when(d % 43 == 0, "xx").when(d % 44 == 0, " FR ").when(d % 47 != 5, F.when(d % 53 == 3, " ").otherwise(F.col("language"))).alias("language"), "group_id",
    )


def given_language() -> Column:
    return F.coalesce(F.trim("language") != "", F.lit(False))


def problems(n: News, rows: DataFrame, writable: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """``rows`` with the list of what is wrong with each, in a fixed order. No language is no problem: it will be detected."""
    known = n.sources.select("source", F.col("active").alias("__active"))
    joined = rows.join(known, "source", "left")
    problem = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    checks = [
        problem(F.trim("title") == "", "title"), problem(F.trim("content") == "", "content"), problem(tx.word_count(F.col("content")) > MOST_WORDS, "words"),
        problem(F.col("__active").isNull(), "source"), F.when(~F.col("__active"), "inactive"), F.when(given_language() & ~languages.canonical(F.col("language")).isin("en", "fr", "de", "es"), "language"),
        problem(~F.col("group_id").isin(list(writable)), "group"),
    ]
    return joined.withColumn("problems", F.array_compact(F.array(*checks))).drop("__active")


def ingest_validate(n: News) -> DataFrame:
    """The dry run: valid or what is wrong."""
    rows = problems(n, submissions(n))
    return rows.select("doc_id", (F.size("problems") == 0).alias("valid"), F.array_join("problems", ",").alias("problems"))


def instrument_resolve(n: News) -> DataFrame:
    """Names as extracted to instruments: by ticker, else by a ticker alias, else by a variant of the name, else a new instrument of that ticker."""
    i = F.col("instrument_id")
    asked = n.instruments.select("instrument_id", F.when(i % 4 == 0, F.col("ticker")).when(i % 4 == 1, F.concat(F.lit("ALT"), i.cast("string"))).when(i % 4 == 2, F.upper("name")).otherwise(
        F.concat(F.lit("zz"), i.cast("string"))).alias("asked")).select(F.col("instrument_id").alias("row"), F.trim("asked").alias("asked"))
    tickers = n.instruments.select(F.col("ticker").alias("asked"), F.col("instrument_id").alias("by_ticker"))
    alias = n.instruments.filter(i % 3 != 0).select(F.concat(F.lit("ALT"), i.cast("string")).alias("asked"), F.col("instrument_id").alias("by_alias"))
    named = n.instruments.groupBy(F.upper("name").alias("asked")).agg(F.min("instrument_id").alias("by_name"))
    rows = asked.join(tickers, "asked", "left").join(alias, "asked", "left").join(named, "asked", "left")
    how = F.when(F.col("by_ticker").isNotNull(), "ticker").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    found = F.coalesce("by_ticker", "by_alias", "by_name").cast("string")
    return rows.select("row", how.alias("how"), F.coalesce(found, F.concat(F.lit("inst-"), F.upper("asked"))).alias("found"))


def extracted(n: News) -> DataFrame:
    """(doc_id, x): answers of an extraction model, some broken or without instruments."""
    d = F.col("doc_id")
    text = d.cast("string")
    way = F.when(d % 3 == 0, "UP").when(d % 3 == 1, "flat").otherwise("down")
    body = F.concat(
        F.lit('{"impact_score": '), (d * 7 % 140).cast("string"), F.lit(', "impact_tier": "GOLD", "events": [{"event_type": "IPO", "confidence": 0.4}, {"event_type": "BUYBACK", "confidence": 0.9}, {"event_type": "DIVIDEND_CHANGE", "confidence": 0.9}], "instruments": '),
        F.when(d % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"ticker": "a'), text, F.lit('", "direction": "FLAT", "magnitude": "HIGH"}, {"ticker": "b'), text, F.lit('", "direction": "'), way, F.lit('", "magnitude": "moderate"}]'))), F.lit("}"),
    )
    return n.documents.select("doc_id", F.from_json(F.when(d % 10 == 3, "{broken").otherwise(body), tx.EXTRACTION).alias("x"))


def extraction_defaults(n: News) -> DataFrame:
    """Score, tier, primary event and ticker, direction and magnitude of the last instrument; a default for answers that can't be read."""
    x = F.col("x")
    fine = x["impact_score"].isNotNull() & x["impact_tier"].isNotNull()
    events = F.coalesce(x["events"], F.array().cast("array<struct<event_type:string,confidence:double>>"))
    best = F.aggregate(events, F.struct(F.lit(DEFAULT_EVENT).alias("event_type"), F.lit(-1.0).alias("confidence")), lambda a, e: F.when(e["confidence"] > a["confidence"], F.struct(e["event_type"].alias("event_type"), e["confidence"].alias("confidence"))).otherwise(a))
    last = F.get(x["instruments"], F.size(x["instruments"]) - 1)
    pick = lambda c, default: F.when(fine, c).otherwise(F.lit(default))
    return extracted(n).select(
        "doc_id", pick(F.greatest(F.lit(0), F.least(F.lit(100), x["impact_score"].cast("int"))), DEFAULT_SCORE).alias("score"), pick(x["impact_tier"], DEFAULT_TIER).alias("tier"),
        pick(best["event_type"], DEFAULT_EVENT).alias("event"), F.coalesce(F.when(fine, F.upper(primary_ticker(x["instruments"]))), F.lit("-")).alias("ticker"),
        direction(F.when(fine, last["direction"])).alias("direction"), magnitude(F.when(fine, last["magnitude"])).alias("magnitude"),
    )


def with_language(rows: DataFrame) -> DataFrame:
    """Each row's declared language in its usual form, or that of title and content together."""
    found = languages.detect(F.concat_ws(" ", "title", "content"))["language"]
    return rows.withColumn("language", F.when(given_language(), languages.canonical(F.col("language"))).otherwise(found))


def ingest_documents(n: News) -> DataFrame:
    """What became of each submission: refused, stored as a duplicate of another, or stored; its language is the declared one or that found."""
    rows = with_language(problems(n, submissions(n)))
    copies = dedupe.by_hash(n)
    status = F.when(F.size("problems") > 0, "refused").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("stored")
    rows = rows.join(copies, "doc_id", "left").select("doc_id", status.alias("status"), "duplicate_of", "language")
    kept = F.when(F.col("status") == "duplicate", F.col("duplicate_of")).otherwise(F.lit(-1))
    return rows.select("doc_id", "status", kept.alias("duplicate_of"), F.when(F.col("status") == "refused", "-").otherwise(F.col("language")).alias("language"))


#: What one ingest writes, in this order; a version names the files of all three.
STORES = {
    "documents": Table("doc_id long, source string, group_id int, language string, title string, content string", ("doc_id",)),
    "pieces": Table("doc_id long, piece int, start_char int, end_char int, content string", ("doc_id",)),
    "links": Table("doc_id long, kind string, target long", ("doc_id",)),
}


def ingest(n: News, tables: Tables, rows: DataFrame, name: str, between: Callable[[str], None] = lambda store: None) -> bool:
    """Store what is fine among some submissions, with its pieces and links, in one version; False if a batch of this name is stored already.

    Until the commit no reader sees anything of it, so a writer that dies between two stores needs no rollback: what it wrote is named by no
    version, and the batch is tried again. ``between`` is called after each store.
    """
    good = cut_lineage(with_language(problems(n, rows)).filter(F.size("problems") == 0))
    ids = good.select("doc_id")
    links = n.affects.select("doc_id", F.lit("AFFECTS").alias("kind"), F.col("instrument_id").alias("target")).union(n.mentions.select("doc_id", F.lit("MENTIONS"), "company_id"))
    pieces = tx.chunk_documents(good).withColumnRenamed("chunk_index", "piece")
    staged = {}
    for store, own in (("documents", good), ("pieces", pieces), ("links", links.join(ids, "doc_id", "left_semi"))):
        staged[store] = tables.stage(store, own)
        between(store)
    return tables.commit(staged, once=name) is not None


#: Batches of the query; the second breaks off and stays so, the third breaks off and is tried again, the fourth comes twice.
INGEST_BATCHES = 4


def ingest_rollback(n: News) -> DataFrame:
    """(store, n): visible rows by store after batches of which some broke off between two stores, or came twice."""
    tables = Tables(n.spark, fresh_path(n.spark, "stores"), STORES, 8)

    def die(store: str) -> None:
        if store == "pieces":
            raise ConnectionAbortedError(store)

    for batch in range(INGEST_BATCHES):
        rows = submissions(n).filter(F.col("doc_id") % INGEST_BATCHES == batch)
        for attempt in (0, 1):
            if (batch, attempt) in ((0, 1), (1, 1)):
                continue
            try:
                ingest(n, tables, rows, f"batch-{batch}", die if batch in (1, 2) and not attempt else lambda store: None)
            except ConnectionAbortedError:
                pass
    state = tables.state()
    out = None
    for store in STORES:
        counted = tables.read(store, state=state).agg(F.count("*").alias("n")).select(F.lit(store).alias("store"), "n")
        out = counted if out is None else out.union(counted)
    return out


def language_profile(n: News) -> DataFrame:
    """Language of title and content together, its confidence, the fallback to the declared one, and whether it is Asia-Pacific."""
    title, content = languages.detect(F.col("title")), languages.detect(F.col("content"))
    rows = n.documents.select("doc_id", "language", title.alias("t"), content.alias("c")).withColumn("best", languages.best_of(F.col("t"), F.col("c")))
    return rows.select(
        "doc_id", F.col("best.language").alias("found"), F.round("best.confidence", 6).alias("confidence"),
        languages.or_fallback(F.col("best"), F.coalesce("language", F.lit("en"))).alias("language"), languages.is_apac(F.col("best.language")).alias("apac"),
    )


# ---- sources


def registry(n: News) -> DataFrame:
    """Sources with a type and a name."""
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("wire", "blog", "filing"))), num % 3 + 1)
    return n.sources.select("source", F.concat(F.lit("Source "), num.cast("string")).alias("name"), kind.alias("source_type"), "region", "trust_level", "active")


def list_sources(n: News, region: str | None = "EUROPE", source_type: str | None = None, inactive: bool = False) -> DataFrame:
    """Sources of a region and type by name; inactive ones only if asked for."""
    rows = registry(n)
    for column, wanted in (("region", region), ("source_type", source_type)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    rows = rows if inactive else rows.filter("active")
    return rows.select("source", "name", "source_type", "active")


def source_lookup(n: News) -> DataFrame:
    """Names asked for: the active source of exactly that name, whether it exists at all, and how many sources there are."""
    rows = registry(n)
    asked = rows.select(F.col("name").alias("asked")).union(rows.select(F.upper("name")))
    total = rows.agg(F.count("*").alias("sources"))
    found = asked.join(rows.select(F.col("name").alias("asked"), "source", "active"), "asked", "left").join(F.broadcast(total))  # one row
    return found.select("asked", F.coalesce(F.when(F.col("active"), F.col("source")), F.lit("-")).alias("found"), F.col("source").isNotNull().alias("exists"), "sources")


def source_update(n: News) -> DataFrame:
    """Changes of region, trust and activity: a row for each field that differs, with its old and new value, in an audit log."""
    rows = registry(n)
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    new = rows.select("source", F.when(num % 2 == 0, "EUROPE").alias("region"), F.when(num % 3 == 0, "high").alias("trust_level"), F.when(num % 5 == 0, False).alias("active"))
    both = rows.alias("o").join(new.alias("c"), "source")
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"c.{f}").cast("string").alias("new")) for f in ("active", "region", "trust_level")]
    log = both.select("source", F.explode(F.array(*fields)).alias("d")).filter(F.col("d.new").isNotNull() & (F.col("d.new") != F.col("d.old")))
    kind = F.when((F.col("d.field") == "active") & (F.col("d.new") == "false"), "SOURCE_DELETE").otherwise("SOURCE_UPDATE")
    return log.select("source", kind.alias("event"), "d.field", "d.old", "d.new")


def audit_events(n: News) -> DataFrame:
    """Seven kinds of typed audit entries, by kind: entries, documents or sources they name, and details."""
    return audit_entries(n).groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("resource").alias("resources"), F.count_distinct("details").alias("kinds"))


def audit_entries(n: News) -> DataFrame:
    """(event, resource, details): typed audit entries of seven kinds, their details as JSON."""
    docs, rows = submissions(n).join(ingest_documents(n).select("doc_id", "status"), "doc_id"), registry(n)
    d = F.col("doc_id")
    entry = lambda table, kind, resource, **details: table.select(F.lit(kind).alias("event"), resource.cast("string").alias("resource"), F.to_json(F.struct(*[F.lit(x).alias(k) if not isinstance(x, Column) else x.alias(k) for k, x in details.items()])).alias("details"))
    parts = [
        entry(docs.filter("status <> 'refused'"), "DOCUMENT_INGEST", d, duplicate=F.col("status") == "duplicate", group=F.col("group_id")), entry(docs.filter(d % 3 == 0), "DOCUMENT_RETRIEVE", d, found=True),
        entry(docs.filter(d % 5 == 0), "DOCUMENT_QUERY", d, results=F.col("group_id")), entry(docs.filter(d % 7 == 0), "DOCUMENT_DELETE", d, confirmed=True),
        entry(rows, "SOURCE_CREATE", F.col("source"), name=F.col("name")), entry(source_update(n).filter("event = 'SOURCE_UPDATE'"), "SOURCE_UPDATE", F.col("source"), field=F.col("field")),
        entry(source_update(n).filter("event = 'SOURCE_DELETE'"), "SOURCE_DELETE", F.col("source"), hard=False),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every


# ---- SQL

_SUB = ("sub", """SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '  ' ELSE title END AS title, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE content END AS content,
    CASE WHEN doc_id % 41 = 0 THEN 'nowhere' ELSE source END AS source, CASE WHEN doc_id % 43 = 0 THEN 'xx' WHEN doc_id % 44 = 0 THEN ' FR ' WHEN doc_id % 47 = 5 THEN NULL WHEN doc_id % 53 = 3 THEN ' ' ELSE language END AS language, group_id FROM docs""")
_PRO = ("pro", r"""SELECT sub.*, array_to_string(list_filter([CASE WHEN coalesce(trim(title) = '', TRUE) THEN 'title' END, CASE WHEN coalesce(trim(content) = '', TRUE) THEN 'content' END,
    CASE WHEN len(regexp_extract_all(content, '[^ \t\n\x0B\f\r]+')) > 20000 THEN 'words' END, CASE WHEN active IS NULL THEN 'source' END, CASE WHEN NOT active THEN 'inactive' END,
    CASE WHEN trim(language) <> '' AND lower(trim(language)) NOT IN ('en', 'fr', 'de', 'es') THEN 'language' END, CASE WHEN group_id NOT IN (0, 1, 2, 3) THEN 'group' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM sub LEFT JOIN srcs USING (source)""")


def _detect_sql(column: str) -> str:
    """The number of common words of each language, in the order of names, as a list."""
    words = f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '{tx.BETWEEN_WORDS}'), lambda w: w <> '')"
    return "[" + ", ".join(f"len(list_filter({words}, lambda w: list_contains({_list(own)}, w)))" for own in languages.COMMON.values()) + "]"


def _detected(key: str, column: str, table: str) -> list[tuple[str, str]]:
    """lg<key> (doc_id, l, f): the language that a column of a table shows, and how surely."""
    names = _list(list(languages.COMMON))
    script = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{s}'" for s, p in languages.SCRIPTS.items())
    sure = " ".join(f"WHEN regexp_matches(x, '{p}') THEN 1.0" for p in languages.SCRIPTS.values())
    short = "coalesce(length(trim(x)), 0) < 20"
    return [
        (f"cw{key}", f"SELECT doc_id, x, {_detect_sql('x')} AS h FROM (SELECT doc_id, {column} AS x FROM {table})"),
        (f"lg{key}", f"""SELECT doc_id, CASE WHEN {short} THEN 'en' {script} WHEN list_sum(h) > 0 THEN {names}[list_position(h, list_max(h))] ELSE 'en' END AS l,
            CASE WHEN {short} THEN 0.0 {sure} WHEN list_sum(h) > 0 THEN list_max(h) / list_sum(h)::DOUBLE ELSE 0.0 END::DOUBLE AS f FROM cw{key}"""),
    ]


def _language_ctes() -> list[tuple[str, str]]:
    best = "c.f >= 0.8 OR c.f >= t.f"
    one = f"SELECT doc_id, CASE WHEN {best} THEN c.l ELSE t.l END AS l, CASE WHEN {best} THEN c.f ELSE t.f END AS f FROM lgt t JOIN lgc c USING (doc_id)"
    return [*_detected("t", "title", "docs"), *_detected("c", "content", "docs"), ("lang2", one)]


_REG = ("reg", """SELECT source, 'Source ' || num AS name, ['wire', 'blog', 'filing'][num % 3 + 1] AS source_type, region, trust_level, active, num
    FROM srcs JOIN (SELECT DISTINCT source, regexp_extract(source, '([0-9]+)$', 1)::INT AS num FROM documents WHERE source IS NOT NULL) USING (source)""")
_UPD = ("upd", """SELECT source, CASE WHEN field = 'active' AND new = 'false' THEN 'SOURCE_DELETE' ELSE 'SOURCE_UPDATE' END AS event, field, old, new FROM (
    SELECT source, 'region' AS field, region AS old, CASE WHEN num % 2 = 0 THEN 'EUROPE' END AS new FROM reg UNION ALL SELECT source, 'trust_level', trust_level, CASE WHEN num % 3 = 0 THEN 'high' END FROM reg
    UNION ALL SELECT source, 'active', active::VARCHAR, CASE WHEN num % 5 = 0 THEN 'false' END FROM reg) WHERE new IS NOT NULL AND new <> old""")
_ING = ("ing", """SELECT doc_id, CASE WHEN problems <> '' THEN 'refused' WHEN duplicate_of IS NOT NULL THEN 'duplicate' ELSE 'stored' END AS status, duplicate_of,
    CASE WHEN trim(language) <> '' THEN lower(trim(language)) ELSE l END AS language, group_id FROM pro LEFT JOIN d1 USING (doc_id) JOIN lgw USING (doc_id)""")
_WHOLE = _detected("w", "concat_ws(' ', title, content)", "sub")
_COPY = [c for c in dedupe._CTES if c[0] in ("h", "d1")]
QUERIES = {f.__name__: f for f in (
    ingest_validate, instrument_resolve, extraction_defaults, ingest_documents, ingest_rollback, language_profile, list_sources, source_lookup, source_update, audit_events, audit_entries,
)}
SQL = {
    "ingest_validate": sql("SELECT doc_id, problems = '' AS valid, problems FROM pro", _SUB, _PRO),
    "instrument_resolve": sql("""SELECT instrument_id AS row, CASE instrument_id % 4 WHEN 0 THEN 'ticker' WHEN 1 THEN CASE WHEN instrument_id % 3 <> 0 THEN 'alias' ELSE 'new' END WHEN 2 THEN 'name' ELSE 'new' END AS how,
        CASE WHEN instrument_id % 4 = 0 OR (instrument_id % 4 = 1 AND instrument_id % 3 <> 0) THEN instrument_id::VARCHAR WHEN instrument_id % 4 = 1 THEN 'inst-ALT' || instrument_id
            WHEN instrument_id % 4 = 2 THEN (min(instrument_id) OVER (PARTITION BY upper(name)))::VARCHAR ELSE 'inst-ZZ' || instrument_id END AS found FROM instr"""),
    "extraction_defaults": sql("""SELECT doc_id, CASE WHEN b THEN 25 ELSE least(100, doc_id * 7 % 140)::INT END AS score, CASE WHEN b THEN 'STANDARD' ELSE 'GOLD' END AS tier, CASE WHEN b THEN 'OTHER' ELSE 'BUYBACK' END AS event,
        CASE WHEN b OR doc_id % 5 = 0 THEN '-' WHEN doc_id % 3 = 1 THEN 'A' || doc_id ELSE 'B' || doc_id END AS ticker,
        CASE WHEN b OR doc_id % 5 = 0 OR doc_id % 3 = 1 THEN 'neutral' WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN b OR doc_id % 5 = 0 THEN 0.01 ELSE 0.02 END AS magnitude
        FROM (SELECT *, doc_id % 10 = 3 AS b FROM docs)"""),
    "ingest_documents": sql("""SELECT doc_id, status, CASE WHEN status = 'duplicate' THEN duplicate_of ELSE -1 END AS duplicate_of, CASE WHEN status = 'refused' THEN '-' ELSE language END AS language FROM ing""", *_COPY, _SUB, _PRO, *_WHOLE, _ING),
    "ingest_rollback": sql("""SELECT 'documents' AS store, count(*) AS n FROM good UNION ALL SELECT 'pieces', count(*) FROM pieces JOIN good USING (doc_id)
        UNION ALL SELECT 'links', count(*) FROM (SELECT doc_id FROM affects UNION ALL SELECT doc_id FROM mentions) JOIN good USING (doc_id)""", _SUB, _PRO, *PIECES, ("good", f"SELECT doc_id FROM pro WHERE problems = '' AND doc_id % {INGEST_BATCHES} <> 1")),
    "language_profile": sql(f"""SELECT doc_id, l AS found, round(f, 6) AS confidence, CASE WHEN f < 0.5 THEN coalesce(language, 'en') ELSE l END AS language, list_contains({_list(languages.APAC)}, l) AS apac
        FROM lang2 JOIN docs USING (doc_id)""", *_language_ctes()),
    "list_sources": sql("SELECT source, name, source_type, active FROM reg WHERE region = 'EUROPE' AND active", _REG),
    "source_lookup": sql("""SELECT asked, CASE WHEN active THEN source ELSE '-' END AS found, source IS NOT NULL AS exists, (SELECT count(*) FROM reg) AS sources
        FROM (SELECT name AS asked FROM reg UNION ALL SELECT upper(name) FROM reg) a LEFT JOIN reg ON name = asked""", _REG),
    "source_update": sql("SELECT * FROM upd", _REG, _UPD),
    "audit_entries": sql("""SELECT 'DOCUMENT_INGEST' AS event, doc_id::VARCHAR AS resource, '{"duplicate":' || (status = 'duplicate') || ',"group":' || group_id || '}' AS details FROM ing WHERE status <> 'refused'
        UNION ALL SELECT 'DOCUMENT_RETRIEVE', doc_id::VARCHAR, '{"found":true}' FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT 'DOCUMENT_QUERY', doc_id::VARCHAR, '{"results":' || group_id || '}' FROM docs WHERE doc_id % 5 = 0
        UNION ALL SELECT 'DOCUMENT_DELETE', doc_id::VARCHAR, '{"confirmed":true}' FROM docs WHERE doc_id % 7 = 0 UNION ALL SELECT 'SOURCE_CREATE', source, '{"name":"' || name || '"}' FROM reg
        UNION ALL SELECT event, source, CASE event WHEN 'SOURCE_UPDATE' THEN '{"field":"' || field || '"}' ELSE '{"hard":false}' END FROM upd""", *_COPY, _SUB, _PRO, *_WHOLE, _ING, _REG, _UPD),
    "audit_events": sql("""SELECT 'DOCUMENT_INGEST' AS event, count(*) AS n, count(DISTINCT doc_id) AS resources, count(DISTINCT (status, group_id)) AS kinds FROM ing WHERE status <> 'refused'
        UNION ALL SELECT 'DOCUMENT_RETRIEVE', count(*), count(DISTINCT doc_id), 1 FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT 'DOCUMENT_QUERY', count(*), count(DISTINCT doc_id), count(DISTINCT group_id) FROM docs WHERE doc_id % 5 = 0
        UNION ALL SELECT 'DOCUMENT_DELETE', count(*), count(DISTINCT doc_id), 1 FROM docs WHERE doc_id % 7 = 0 UNION ALL SELECT 'SOURCE_CREATE', count(*), count(DISTINCT source), count(DISTINCT name) FROM reg
        UNION ALL SELECT event, count(*), count(DISTINCT source), CASE event WHEN 'SOURCE_UPDATE' THEN count(DISTINCT field) ELSE 1 END FROM upd GROUP BY event""", *_COPY, _SUB, _PRO, *_WHOLE, _ING, _REG, _UPD),
}
