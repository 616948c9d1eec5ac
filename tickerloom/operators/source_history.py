"""The source registry over time: requests to create, update and soft-delete sources, the history that they make, and what is derived from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.feeds import rank_in
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import sql

FIELDS = ["name", "source_type", "region", "trust_level"]
#: Requests in order of (at, no); of an update the fields that aren't null change.
REQUEST = "no long, at timestamp_ntz, source string, action string, name string, source_type string, region string, trust_level string"
#: What a new source has unless it says otherwise.
DEFAULTS = {"source_type": "other", "trust_level": "unverified"}


def decided(requests: DataFrame) -> DataFrame:
    """Requests with ``refused``: null if they take effect, else why they don't.

    A create is refused if the source exists (deleted or not), or if an active source has its name; an update or a deletion if the source doesn't
    exist, a deletion also if it is deleted already. Names never change. Requests of sources that one name binds are decided in order; they are few.
    """
    named = requests.groupBy("source").agg(F.min_by("name", F.when(F.col("action") == "create", F.struct("at", "no"))).alias("called"))
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame, known, holder, why = frame.sort_values(["at", "no"]), {}, None, []
        for source, action, name in zip(frame["source"], frame["action"], frame["called"], strict=True):
            exists, active = source in known, known.get(source, False)
            if action == "create":
                reason = "exists" if exists else "name" if holder is not None and not pd.isna(name) else None
                if reason is None:
                    known[source], holder = True, source
            elif action in ("update", "delete"):
                reason = "unknown" if not exists else "deleted" if action == "delete" and not active else None
                if reason is None and action == "delete":
                    known[source], holder = False, None if holder == source else holder
            else:
                reason = "action"
            why.append(reason)
        return frame.drop(columns="called").assign(refused=why)

    # sources that are never created are bound by their own id
    bound = requests.join(named, "source", "left").withColumn("__name", F.coalesce(F.concat(F.lit("n"), "called"), F.concat(F.lit("s"), "source")))
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", refused string"
    return bound.groupBy("__name").applyInPandas(lambda frame: decide(frame.drop(columns="__name")), schema)


def history(requests: DataFrame) -> DataFrame:
    """(source, version, valid_from, valid_to, action, fields, active): each state of each source; the last one has no end.

    Requests that change nothing make no state.
    """
    taken = decided(requests).filter("refused IS NULL")
    by_source = Window.partitionBy("source").orderBy("at", "no")
    so_far = by_source.rowsBetween(Window.unboundedPreceding, 0)
    given = {c: F.when(F.col("action") == "create", F.coalesce(F.col(c), F.lit(DEFAULTS.get(c)))).when((F.col("action") == "update") & F.lit(c != "name"), F.col(c)) for c in FIELDS}
    states = taken.select("source", "no", "at", "action", *[F.last(given[c], True).over(so_far).alias(c) for c in FIELDS], (F.max(F.when(F.col("action") == "delete", 1)).over(so_far).isNull()).alias("active"))
    before = F.lag(F.struct(*FIELDS, "active")).over(by_source)
    changed = states.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.struct(*FIELDS, "active")))
    return changed.select("source", F.row_number().over(by_source).alias("version"), F.col("at").alias("valid_from"), F.lead("at").over(by_source).alias("valid_to"), "action", *FIELDS, "active")


def registry_at(states: DataFrame, day) -> DataFrame:
    """The registry as it was at a time: the state of each source that held then."""
    return states.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def audit_log(states: DataFrame) -> DataFrame:
    """(source, entry, at, action, field, old, new): a row for each changed field, newest entry first (entry 1); a creation lists its fields."""
    by_source = Window.partitionBy("source").orderBy("version")
    text = lambda c: F.col(c).cast("string")
    columns = [*FIELDS, "active"]
    rows = states.select("source", "version", "valid_from", "action", *[F.struct(F.lit(c).alias("field"), F.lag(text(c)).over(by_source).alias("old"), text(c).alias("new")).alias(c) for c in columns])
    newest = F.max("version").over(Window.partitionBy("source"))
    each = rows.select("source", (newest - F.col("version") + 1).alias("entry"), F.col("valid_from").alias("at"), "action", F.explode(F.array(*columns)).alias("d"))
    return each.filter(~F.col("d.old").eqNullSafe(F.col("d.new"))).select("source", "entry", "at", "action", "d.field", "d.old", "d.new")


def with_source_then(docs: DataFrame, states: DataFrame) -> DataFrame:
    """Documents (source, created_at) with the state of their source at that time; nulls where there was none."""
    held = states.select(F.col("source").alias("__s"), "valid_from", "valid_to", *FIELDS, "active")
    then = (F.col("source") == F.col("__s")) & (F.col("created_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("created_at") < F.col("valid_to")))
    return docs.join(held, then, "left").drop("__s", "valid_from", "valid_to")


def requests_of(n: News) -> DataFrame:
    """Requests over the test tables: every source is created; some are updated twice, deleted, wrongly created again, or created under a name that is taken or free again."""
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    base = n.sources.select("source", num.alias("num"), "region", "trust_level")
    day = lambda d: F.to_timestamp_ntz(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(d) if isinstance(d, int) else d)
    name, none = F.concat(F.lit("Source "), F.col("num").cast("string")), F.lit(None).cast("string")
    kind = F.element_at(F.array(F.lit("wire"), none, F.lit("filing")), F.col("num") % 3 + 1)

    def request(rows: DataFrame, no: int, at, action: str, source=None, **fields) -> DataFrame:
        return rows.select(
            (F.col("num") * 10 + no).cast("long").alias("no"), at.alias("at"), (F.col("source") if source is None else source).alias("source"), F.lit(action).alias("action"),
            *[fields.get(c, none).cast("string").alias(c) for c in FIELDS],
        )

    other = F.concat(F.lit("again-"), F.col("source"))
    parts = [
        request(base, 0, day(F.col("num") % 4), "create", name=name, source_type=kind, region=F.col("region"), trust_level=F.when(F.col("num") % 5 != 0, F.col("trust_level"))),
        request(base.filter("num % 2 = 0"), 1, day(8), "update", region=F.lit("EUROPE")),
        request(base.filter("num % 3 = 0"), 2, day(12), "update", trust_level=F.lit("high"), source_type=F.lit("blog")),
        request(base.filter("num % 4 = 1"), 3, day(14), "delete"),
        request(base.filter("num % 8 = 1"), 4, day(15), "delete"),
        request(base.filter("num % 7 = 0"), 5, day(16), "create", name=F.lit("another name")),
        request(base.filter("num % 2 = 1"), 6, day(18), "create", source=other, name=name, region=F.lit("ASIA_PACIFIC")),
        request(base.filter("num % 6 = 5"), 7, day(20), "update", source=F.concat(F.lit("nobody-"), F.col("source")), region=F.lit("AFRICA")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def source_decisions(n: News) -> DataFrame:
    return decided(requests_of(n)).select("no", "source", "action", F.coalesce("refused", F.lit("-")).alias("refused"))


def source_history(n: News) -> DataFrame:
    return history(requests_of(n))


def source_registry_at(n: News) -> DataFrame:
    """The registry at noon of 13 January."""
    return registry_at(history(requests_of(n)), F.to_timestamp_ntz(F.lit("2024-01-13 12:00:00"))).select("source", *FIELDS, "active")


def source_audit_log(n: News) -> DataFrame:
    return audit_log(history(requests_of(n)))


def documents_with_source_then(n: News) -> DataFrame:
    rows = with_source_then(n.documents.select("doc_id", "source", "created_at"), history(requests_of(n)))
    return rows.select("doc_id", F.coalesce("region", F.lit("-")).alias("region"), F.coalesce("trust_level", F.lit("-")).alias("trust_level"), F.coalesce("active", F.lit(False)).alias("active"))


_REQ = [
    ("base", "SELECT source, regexp_extract(source, '([0-9]+)$', 1)::INT AS num, region, trust_level FROM srcs"),
    ("req", """SELECT num * 10::BIGINT AS "no", TIMESTAMP '2024-01-01' + to_days(num % 4) AS "at", source, 'create' AS action, 'Source ' || num AS name, ['wire', NULL, 'filing'][num % 3 + 1] AS source_type, region,
            CASE WHEN num % 5 <> 0 THEN trust_level END AS trust_level FROM base
        UNION ALL SELECT num * 10 + 1, TIMESTAMP '2024-01-09', source, 'update', NULL, NULL, 'EUROPE', NULL FROM base WHERE num % 2 = 0
        UNION ALL SELECT num * 10 + 2, TIMESTAMP '2024-01-13', source, 'update', NULL, 'blog', NULL, 'high' FROM base WHERE num % 3 = 0
        UNION ALL SELECT num * 10 + 3, TIMESTAMP '2024-01-15', source, 'delete', NULL, NULL, NULL, NULL FROM base WHERE num % 4 = 1
        UNION ALL SELECT num * 10 + 4, TIMESTAMP '2024-01-16', source, 'delete', NULL, NULL, NULL, NULL FROM base WHERE num % 8 = 1
        UNION ALL SELECT num * 10 + 5, TIMESTAMP '2024-01-17', source, 'create', 'another name', NULL, NULL, NULL FROM base WHERE num % 7 = 0
        UNION ALL SELECT num * 10 + 6, TIMESTAMP '2024-01-19', 'again-' || source, 'create', 'Source ' || num, NULL, 'ASIA_PACIFIC', NULL FROM base WHERE num % 2 = 1
        UNION ALL SELECT num * 10 + 7, TIMESTAMP '2024-01-21', 'nobody-' || source, 'update', NULL, NULL, 'AFRICA', NULL FROM base WHERE num % 6 = 5"""),
    ("dec", """SELECT *, CASE WHEN "no" % 10 = 4 THEN 'deleted' WHEN "no" % 10 = 5 THEN 'exists' WHEN "no" % 10 = 6 AND NOT ("no" // 10) % 4 = 1 THEN 'name' WHEN "no" % 10 = 7 THEN 'unknown' END AS refused FROM req"""),
    ("st", """SELECT source, "no", "at", action, last_value(name IGNORE NULLS) OVER w AS name, last_value(CASE WHEN action = 'create' THEN coalesce(source_type, 'other') ELSE source_type END IGNORE NULLS) OVER w AS source_type,
            last_value(region IGNORE NULLS) OVER w AS region, last_value(CASE WHEN action = 'create' THEN coalesce(trust_level, 'unverified') ELSE trust_level END IGNORE NULLS) OVER w AS trust_level,
            NOT bool_or(action = 'delete') OVER w AS active FROM dec WHERE refused IS NULL WINDOW w AS (PARTITION BY source ORDER BY "at", "no" ROWS UNBOUNDED PRECEDING)"""),
    ("ch", """SELECT * FROM (SELECT *, lag((name, source_type, region, trust_level, active)) OVER (PARTITION BY source ORDER BY "at", "no") AS before FROM st) WHERE before IS DISTINCT FROM (name, source_type, region, trust_level, active)"""),
    ("his", """SELECT source, row_number() OVER w AS version, "at" AS valid_from, lead("at") OVER w AS valid_to, action, name, source_type, region, trust_level, active FROM ch WINDOW w AS (PARTITION BY source ORDER BY "at", "no")"""),
]
QUERIES = {f.__name__: f for f in (source_decisions, source_history, source_registry_at, source_audit_log, documents_with_source_then)}
_FIELD = "SELECT source, version, valid_from, action, '{0}' AS field, lag({0}::VARCHAR) OVER (PARTITION BY source ORDER BY version) AS old, {0}::VARCHAR AS new, max(version) OVER (PARTITION BY source) AS top FROM his"
SQL = {
    "source_decisions": sql("""SELECT "no", source, action, coalesce(refused, '-') AS refused FROM dec""", *_REQ),
    "source_history": sql("SELECT * FROM his", *_REQ),
    "source_registry_at": sql("""SELECT source, name, source_type, region, trust_level, active FROM his WHERE valid_from <= TIMESTAMP '2024-01-13 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-13 12:00:00')""", *_REQ),
    "source_audit_log": sql(
        'SELECT source, top - version + 1 AS entry, valid_from AS "at", action, field, old, new FROM (' + " UNION ALL ".join(_FIELD.format(c) for c in [*FIELDS, "active"]) + ") WHERE old IS DISTINCT FROM new", *_REQ
    ),
    "documents_with_source_then": sql("""SELECT doc_id, coalesce(h.region, '-') AS region, coalesce(h.trust_level, '-') AS trust_level, coalesce(h.active, FALSE) AS active FROM docs LEFT JOIN his h
        ON docs.source = h.source AND created_at >= valid_from AND (valid_to IS NULL OR created_at < valid_to)""", *_REQ),
}
