"""Changes as functions of tables: upserts of nodes and edges, deletions that cascade, and the client and portfolio tools.

A store is a table, a change set is a table with a time ``ts``, and the result is the table after it. Each query applies
one kind of change to the whole domain and returns the rows after it, or what it refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import vocabulary as v
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import _list, sql

CLIENT_TYPES = sorted(v.CLIENT_TYPES.values())


def merge_nodes(old: DataFrame, changes: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """One row a key: of every column the newest value that isn't null; among equal times the greatest. Old rows are older than any change."""
    names = [c for c in old.columns if c != key]
    both = old.withColumn(ts, F.lit(-1).cast(changes.schema[ts].dataType)).unionByName(changes, allowMissingColumns=True)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, c))).alias(c) for c in names]
    return both.groupBy(key).agg(*newest)


def merge_edges(old: DataFrame, changes: DataFrame, ends: tuple[DataFrame, DataFrame], keys: tuple[str, str], ts: str = "ts") -> DataFrame:
    """The edges after a change set, with ``status``: kept, created, updated, or refused if an end is missing.

    ``ends`` are the keys of both node tables. Several changes of an edge merge as for nodes.
    """
    names = [c for c in old.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, c))).alias(f"new_{c}") for c in names])
    for node, k in zip(ends, keys, strict=True):
        newest = newest.join(node.select(F.col(node.columns[0]).alias(k), F.lit(True).alias(f"has_{k}")), k, "left")
    newest = newest.withColumn("whole", F.coalesce(F.col(f"has_{keys[0]}") & F.col(f"has_{keys[1]}"), F.lit(False)))
    rows = old.withColumn("was", F.lit(True)).join(newest, list(keys), "full_outer")
    status = (
        F.when(F.col("whole").isNull(), "kept").when(~F.col("whole"), "refused").when(F.col("was"), "updated").otherwise("created")
    )
    return rows.select(*keys, *[F.when(F.coalesce("whole", F.lit(False)), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) for c in names], status.alias("status"))


def node_upsert(n: News) -> DataFrame:
    """Two partial changes of instruments: a name, and later a type with a name of null; and a new instrument."""
    i = F.col("instrument_id")
    old = n.instruments.select("instrument_id", "name", "instrument_type")
    none = F.lit(None).cast("string")
    named = n.instruments.filter(i % 3 == 0).select("instrument_id", F.upper("name").alias("name"), none.alias("instrument_type"), F.lit(1).alias("ts"))
    typed = n.instruments.filter(i % 6 == 0).select("instrument_id", none.alias("name"), F.lit("FUND").alias("instrument_type"), F.lit(2).alias("ts"))
    fresh = n.instruments.filter(i % 50 == 1).select((-i).alias("instrument_id"), F.lit("new").alias("name"), none.alias("instrument_type"), F.lit(1).alias("ts"))
    return merge_nodes(old, named.union(typed).union(fresh), "instrument_id")


def edge_upsert(n: News) -> DataFrame:
    """Holdings of every third instrument get a weight of half; some new ones, of which those of missing clients or instruments are refused."""
    old = n.holds.select("client_id", "instrument_id", "weight")
    i, c = F.col("instrument_id"), F.col("client_id")
    half = old.filter(i % 3 == 0).select("client_id", "instrument_id", (F.col("weight") / 2).alias("weight"), F.lit(1).alias("ts"))
    more = n.clients.select("client_id", F.when(c % 10 == 0, F.lit(-1)).otherwise(F.lit(5)).cast("long").alias("instrument_id"), F.lit(0.25).alias("weight"), F.lit(1).alias("ts"))
    lost = n.clients.filter(c % 7 == 0).select((-1 - c).alias("client_id"), F.lit(1).cast("long").alias("instrument_id"), F.lit(0.1).alias("weight"), F.lit(1).alias("ts"))
    rows = merge_edges(old, half.union(more).union(lost), (n.clients.select("client_id"), n.instruments.select("instrument_id")), ("client_id", "instrument_id"))
    return rows.select("client_id", "instrument_id", F.round(F.coalesce("weight", F.lit(-1.0)), 9).alias("weight"), "status")


def detach(nodes: DataFrame, key: str, gone: DataFrame, edges: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Nodes and edge tables without the rows of ``gone``."""
    gone = gone.select(key).distinct()
    left = {name: table.join(gone.withColumnRenamed(key, column), column, "left_anti") for name, (table, column) in edges.items()}
    return {"nodes": nodes.join(gone, key, "left_anti")} | left


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("rel"), "n") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def node_delete(n: News) -> DataFrame:
    """What is left of documents and of their edges once every seventh document is gone."""
    gone = n.documents.filter(F.col("doc_id") % 7 == 0)
    return _counts(detach(n.documents.select("doc_id"), "doc_id", gone, {"AFFECTS": (n.affects, "doc_id"), "MENTIONS": (n.mentions, "doc_id"), "FACTORS": (n.doc_factors, "doc_id")}))


def client_delete(n: News) -> DataFrame:
    """The same for every eleventh client, with profile, portfolio and watchlist."""
    gone = n.clients.filter(F.col("client_id") % 11 == 0)
    return _counts(detach(n.clients.select("client_id"), "client_id", gone, {"HOLDS": (n.holds, "client_id"), "WATCHES": (n.watches, "client_id"), "IN_GROUP": (n.permitted, "client_id")}))


def alias_upsert(n: News) -> DataFrame:
    """Aliases by upper-case scheme and trimmed value; a later change replaces the instrument."""
    i = F.col("instrument_id")
    old = n.instruments.select(F.lit("TICKER").alias("scheme"), F.col("ticker").alias("value"), "instrument_id")
    raw = n.instruments.filter(i % 4 == 0).select(F.lit("ticker").alias("scheme"), F.concat(F.lit(" "), "ticker", F.lit(" ")).alias("value"), (i + 1).alias("instrument_id"), F.lit(1).alias("ts"))
    more = n.instruments.filter(i % 4 == 1).select(F.lit("isin").alias("scheme"), F.concat(F.lit("X"), i.cast("string")).alias("value"), "instrument_id", F.lit(1).alias("ts"))
    clean = raw.union(more).select(F.upper(F.trim("scheme")).alias("scheme"), F.trim("value").alias("value"), "instrument_id", "ts")
    both = old.withColumn("ts", F.lit(0)).unionByName(clean)
    return both.groupBy("scheme", "value").agg(F.max_by("instrument_id", "ts").alias("instrument_id"))


def property_sets(n: News) -> DataFrame:
    """Impact and themes of some documents set anew; the others keep theirs."""
    d = F.col("doc_id")
    impact = n.documents.filter(d % 5 == 0).select("doc_id", (d % 100).cast("int").alias("new_impact"))
    themes = n.documents.filter(d % 6 == 0).select("doc_id", F.array(F.lit("rates")).alias("new_themes"))
    rows = n.documents.select("doc_id", "impact_score", "themes").join(impact, "doc_id", "left").join(themes, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("new_impact", "impact_score", F.lit(-1)).alias("impact_score"), F.array_join(F.coalesce("new_themes", "themes"), ",").alias("themes"))


def client_administration(n: News) -> DataFrame:
    """Clients after defunct, restore, move of group, change of type (of a known one only) and of benchmark."""
    c = F.col("client_id")
    status = F.when(c % 9 == 0, "defunct").when(c % 17 == 0, "active").otherwise(F.coalesce("status", F.lit("active")))
    group = F.when(c % 8 == 0, (F.col("group_id") + 1) % 5).otherwise(F.col("group_id"))
    asked = F.when(c % 10 == 0, "pension").when(c % 10 == 5, "ROBOT")
    kind = F.when(F.upper(asked).isin(CLIENT_TYPES), F.upper(asked)).otherwise(F.col("client_type"))
    bench = F.when(c % 12 == 0, F.lit(3).cast("long")).otherwise(F.col("benchmark_id"))
    refused = F.coalesce(~F.upper(asked).isin(CLIENT_TYPES), F.lit(False))
    return n.clients.select("client_id", status.alias("status"), group.cast("int").alias("group_id"), kind.alias("client_type"), bench.alias("benchmark_id"), refused.alias("refused"))


def client_problems(rows: DataFrame) -> Column:
    """The fields of a client to be created or updated that are wrong, in order: name, type, frequency, threshold, themes."""
    problem = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    known = F.array(*map(F.lit, v.THEMES))
    checks = [
        problem(F.trim("name") == "", "name"), problem(~F.upper("client_type").isin(CLIENT_TYPES), "client_type"),
        problem(~F.col("alert_frequency").isin("realtime", "hourly", "daily", "weekly"), "alert_frequency"),
        problem(~F.col("impact_threshold").between(0, 100), "impact_threshold"),
        problem(F.size(F.array_except(F.transform("themes", lambda t: F.lower(F.trim(t))), known)) > 0, "themes"),
    ]
    return F.array_compact(F.array(*checks))


def client_create(n: News) -> DataFrame:
    """Requests for clients, some of them wrong: what is stored or why it isn't. Exclusions set the ESG constraint by themselves."""
    c = F.col("client_id")
    asked = n.clients.select(
        "client_id", F.when(c % 13 == 0, "  ").otherwise(F.col("name")).alias("name"), F.when(c % 7 == 0, "ROBOT").otherwise(F.lower("client_type")).alias("client_type"),
        F.when(c % 19 == 0, "never").otherwise(F.col("alert_frequency")).alias("alert_frequency"), F.when(c % 23 == 0, 101).otherwise(F.col("impact_threshold")).alias("impact_threshold"),
        F.when(c % 29 == 0, F.array(F.lit("supply chain"))).otherwise(F.col("mandate_themes")).alias("themes"),
        F.when(c % 2 == 0, F.array(F.lit("tobacco"))).otherwise(F.array().cast("array<string>")).alias("excluded"), F.col("esg_constrained"),
    )
    rows = asked.withColumn("problems", client_problems(asked))
    fine = F.size("problems") == 0
    esg = F.when(F.size("excluded") > 0, True).otherwise(F.coalesce("esg_constrained", F.lit(False)))
    return rows.select(
        "client_id", F.when(fine, "created").otherwise("refused").alias("status"), F.array_join("problems", ",").alias("problems"),
        F.when(fine, F.upper("client_type")).otherwise("-").alias("client_type"), (fine & esg).alias("esg_constrained"),
    )


#: Requests to change profiles; a null field stays. An empty text, list or set of restrictions clears.
PROFILE_REQUEST = (
    "client_id long, groups array<int>, alert_frequency string, impact_threshold double, mandate_type string, mandate_text string, horizon string, esg_constrained boolean, "
    "excluded array<string>, mandate_themes array<string>, benchmark string"
)
PROFILE = ["alert_frequency", "impact_threshold", "mandate_type", "mandate_text", "horizon", "esg_constrained", "excluded", "mandate_themes"]
#: Alert frequencies, horizons and the longest mandate.
FREQUENCIES, HORIZONS, MOST_MANDATE = ["realtime", "hourly", "daily", "weekly"], ["short", "medium", "long"], 5000


def update_profiles(profiles: DataFrame, requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """(client_id, status, changes, the fields of ``PROFILE``, benchmark) for each request; only what it gives is changed, and if it is refused nothing is.

    The status is OK or the first of what is wrong: frequency, threshold, text, horizon, themes, nothing asked for, unknown client,
    client of another group. Exclusions set the ESG constraint unless the request says otherwise. ``profiles`` has the fields and client_id, group_id and
    benchmark (a ticker); a benchmark that ``instruments`` (ticker) doesn't have is an instrument to be made, ``new_benchmark``. Each client has one request at most.
    """
    asked = requests.select(*[F.col(c).alias(f"r_{c}") for c in requests.columns])
    known = instruments.select(F.upper("ticker").alias("__t")).distinct()
    rows = asked.join(profiles, F.col("r_client_id") == F.col("client_id"), "left").join(known, F.upper(F.trim("r_benchmark")) == F.col("__t"), "left")
    given = lambda c: F.col(f"r_{c}").isNotNull()
    themes = F.transform("r_mandate_themes", lambda t: F.lower(F.trim(t)))
    exclusions = F.coalesce(F.size("r_excluded") > 0, F.lit(False))
    nothing = F.forall(F.array(*[~given(c) for c in [*PROFILE, "benchmark"]]), lambda x: x)
    status = (
        F.when(given("alert_frequency") & ~F.lower("r_alert_frequency").isin(FREQUENCIES), "INVALID_ALERT_FREQUENCY").when(given("impact_threshold") & ~F.col("r_impact_threshold").between(0, 100), "INVALID_IMPACT_THRESHOLD")
        .when(F.length("r_mandate_text") > MOST_MANDATE, "MANDATE_TEXT_TOO_LONG").when(given("horizon") & ~F.lower("r_horizon").isin(HORIZONS), "INVALID_HORIZON")
        .when(F.size(F.array_except(themes, F.array(*map(F.lit, v.THEMES)))) > 0, "INVALID_MANDATE_THEMES").when(nothing, "NO_UPDATES_PROVIDED").when(F.col("client_id").isNull(), "CLIENT_NOT_FOUND")
        .when(given("groups") & ~F.coalesce(F.array_contains("r_groups", F.col("group_id")), F.lit(False)), "ACCESS_DENIED").otherwise("OK")
    )
    new = {c: F.col(f"r_{c}") for c in PROFILE} | {
        "alert_frequency": F.lower("r_alert_frequency"), "horizon": F.lower("r_horizon"), "mandate_text": F.trim("r_mandate_text"), "mandate_themes": themes,
        "esg_constrained": F.coalesce("r_esg_constrained", F.when(exclusions, True)),
    }
    set_ = {c: given(c) | (exclusions if c == "esg_constrained" else F.lit(False)) for c in PROFILE}
    fine = F.col("status") == "OK"
    changes = F.array_compact(F.array(*[F.when(set_[c], F.lit(c)) for c in PROFILE], F.when(given("benchmark"), F.lit("benchmark"))))
    after = [F.when(fine, F.coalesce(new[c], F.col(c))).otherwise(F.col(c)).alias(c) for c in PROFILE]
    ticker = F.upper(F.trim("r_benchmark"))
    return rows.withColumn("status", status).select(
        F.col("r_client_id").alias("client_id"), "status", F.when(fine, changes).otherwise(F.array().cast("array<string>")).alias("changes"), *after,
        F.when(fine & given("benchmark"), ticker).otherwise(F.col("benchmark")).alias("benchmark"), F.when(fine & given("benchmark") & F.col("__t").isNull(), ticker).alias("new_benchmark"),
    )


def profile_updates(n: News) -> DataFrame:
    """Requests of every client and of some that don't exist, many of them wrong: what becomes of each profile."""
    c = F.col("client_id")
    text = lambda x: F.lit(x).cast("string")
    profiles = n.clients.join(n.instruments.select(F.col("instrument_id").alias("benchmark_id"), F.col("ticker").alias("benchmark")), "benchmark_id", "left").select(
        "client_id", "group_id", "alert_frequency", F.col("impact_threshold").cast("double").alias("impact_threshold"), "mandate_type", "mandate_text", F.lit("medium").alias("horizon"), "esg_constrained",
        F.array().cast("array<string>").alias("excluded"), "mandate_themes", "benchmark",
    )
    whole = n.clients.select("client_id").union(n.clients.filter(c % 40 == 7).select(-c))
    requests = whole.select(
        "client_id", F.when(c % 5 != 0, F.array(*map(F.lit, (0, 1, 2)))).alias("groups"), F.when(c % 3 == 0, F.when(c % 21 == 0, "never").otherwise("DAILY")).alias("alert_frequency"),
        F.when(c % 4 == 0, (c % 110).cast("double")).alias("impact_threshold"), F.when(c % 6 == 0, "macro").alias("mandate_type"), F.when(c % 7 == 0, F.when(c % 14 == 0, text("  ")).otherwise(F.repeat(F.lit("words "), (c % 1000).cast("int")))).alias("mandate_text"),
        F.when(c % 8 == 0, F.when(c % 16 == 0, "forever").otherwise("Long")).alias("horizon"), F.when(c % 9 == 0, c % 2 == 0).alias("esg_constrained"), F.when(c % 10 == 0, F.when(c % 20 == 0, F.array(F.lit("tobacco"))).otherwise(F.array().cast("array<string>"))).alias("excluded"),
        F.when(c % 11 == 0, F.when(c % 22 == 0, F.array(F.lit(" Rates"), F.lit("fx"))).otherwise(F.array(F.lit("moon")))).alias("mandate_themes"), F.when(c % 12 == 0, F.when(c % 24 == 0, text(" t3 ")).otherwise(text("NEWONE"))).alias("benchmark"),
    )
    found = update_profiles(profiles, requests, n.instruments)
    listed = lambda name: F.coalesce(F.array_join(name, ","), F.lit("-")).alias(name)
    return found.select(
        "client_id", "status", listed("changes"), "alert_frequency", "impact_threshold", "mandate_type", F.md5(F.coalesce("mandate_text", F.lit("-"))).alias("mandate"), "horizon", F.coalesce(F.col("esg_constrained").cast("string"), F.lit("-")).alias("esg_constrained"), listed("excluded"), listed("mandate_themes"), "benchmark", "new_benchmark",
    )


def portfolio_changes(n: News) -> DataFrame:
    """Additions and removals of holdings by client: how many were added, changed and removed, and how many remain; weights outside 0..1 are refused."""
    c = F.col("client_id")
    asked = n.clients.select("client_id", (c * 19 % n.sizes["part"]).alias("instrument_id"), F.when(c % 15 == 0, 1.5).otherwise(0.1).alias("new_weight"))
    good = asked.filter(F.col("new_weight").between(0, 1))
    gone = n.holds.filter((F.col("instrument_id") + c) % 4 == 0).select("client_id", "instrument_id")
    after = n.holds.select("client_id", "instrument_id", F.lit(True).alias("was")).join(good, ["client_id", "instrument_id"], "full_outer")
    after = after.join(gone.withColumn("gone", F.lit(True)), ["client_id", "instrument_id"], "left")
    was, put, out = F.coalesce("was", F.lit(False)), F.col("new_weight").isNotNull(), F.coalesce("gone", F.lit(False))
    one = lambda c, name: F.count_if(c).alias(name)
    sums = after.groupBy("client_id").agg(one(put & ~was, "added"), one(put & was, "changed"), one(out, "removed"), one(~out, "remaining"))
    refused = asked.groupBy("client_id").agg(one(~F.col("new_weight").between(0, 1), "refused"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return refused.join(sums, "client_id", "left").select("client_id", *map(zero, ("added", "changed", "removed", "remaining")), "refused")


def watchlist_changes(n: News) -> DataFrame:
    """Watchlists after an instrument is added to each and even ones are removed."""
    more = n.clients.select("client_id", (F.col("client_id") % n.sizes["part"]).alias("instrument_id"))
    return n.watches.union(more).distinct().filter(F.col("instrument_id") % 2 == 1).select("client_id", "instrument_id")


def taxonomy(n: News) -> DataFrame:
    """The fixed dimensions, once a code: how many codes each has, how often the tables use them, and which they lack or have besides."""
    rows = [("client_type", t) for t in CLIENT_TYPES] + [("event", e) for e in v.EVENT_CATEGORY] + [("theme", t) for t in v.THEMES] + [("tier", t) for t in v.TIERS] + [("region", r) for r in v.REGIONS]
    table = n.spark.createDataFrame(rows, "dimension string, code string").dropDuplicates(["dimension", "code"])
    one = lambda kind, rows, c: rows.select(F.lit(kind).alias("dimension"), c.alias("code"))
    docs = n.documents
    seen = one("client_type", n.clients, F.col("client_type")).union(one("event", docs, F.col("event_code"))).union(one("theme", docs, F.explode("themes")))
    seen = seen.union(one("tier", docs, F.col("impact_tier"))).union(one("region", n.sources, F.col("region")))
    uses = seen.filter(F.col("code").isNotNull()).groupBy("dimension", "code").agg(F.count("*").alias("uses"))
    every = table.withColumn("known", F.lit(1)).join(uses, ["dimension", "code"], "full_outer")
    return every.groupBy("dimension").agg(
        F.count("known").alias("n"), F.min(F.when(F.col("known") == 1, F.col("code"))).alias("first"), F.max(F.when(F.col("known") == 1, F.col("code"))).alias("last"),
        F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count_if(F.col("uses").isNull()).alias("unused"), F.count_if(F.col("known").isNull()).alias("unknown"),
    )


QUERIES = {f.__name__: f for f in (
    node_upsert, edge_upsert, node_delete, client_delete, alias_upsert, property_sets, client_administration, client_create, profile_updates, portfolio_changes, watchlist_changes, taxonomy,
)}
SQL = {
    "node_upsert": sql("""SELECT instrument_id, CASE WHEN instrument_id % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN instrument_id % 6 = 0 THEN 'FUND' ELSE instrument_type END AS instrument_type FROM instr
        UNION ALL SELECT -instrument_id, 'new', NULL FROM instr WHERE instrument_id % 50 = 1"""),
    "edge_upsert": sql("""SELECT client_id, instrument_id, round(CASE WHEN n.w IS NOT NULL THEN n.w WHEN instrument_id % 3 = 0 THEN h.weight / 2 ELSE h.weight END, 9) AS weight,
        CASE WHEN h.weight IS NULL THEN 'created' WHEN n.w IS NOT NULL OR instrument_id % 3 = 0 THEN 'updated' ELSE 'kept' END AS status
        FROM holds h FULL JOIN (SELECT client_id, 5::BIGINT AS instrument_id, 0.25::DOUBLE AS w FROM clients WHERE client_id % 10 <> 0) n USING (client_id, instrument_id)
        UNION ALL SELECT client_id, -1, -1.0, 'refused' FROM clients WHERE client_id % 10 = 0 UNION ALL SELECT -1 - client_id, 1, -1.0, 'refused' FROM clients WHERE client_id % 7 = 0"""),
    "node_delete": sql("""SELECT 'nodes' AS rel, count(*) AS n FROM docs WHERE doc_id % 7 <> 0 UNION ALL SELECT 'AFFECTS', count(*) FROM affects WHERE doc_id % 7 <> 0
        UNION ALL SELECT 'MENTIONS', count(*) FROM mentions WHERE doc_id % 7 <> 0 UNION ALL SELECT 'FACTORS', count(*) FROM docfac WHERE doc_id % 7 <> 0"""),
    "client_delete": sql("""SELECT 'nodes' AS rel, count(*) AS n FROM clients WHERE client_id % 11 <> 0 UNION ALL SELECT 'HOLDS', count(*) FROM holds WHERE client_id % 11 <> 0
        UNION ALL SELECT 'WATCHES', count(*) FROM watches WHERE client_id NOT IN (SELECT client_id FROM clients WHERE client_id % 11 = 0) UNION ALL SELECT 'IN_GROUP', count(*) FROM permitted WHERE client_id % 11 <> 0"""),
    "alias_upsert": sql("""SELECT 'TICKER' AS scheme, ticker AS value, instrument_id + (instrument_id % 4 = 0)::INT AS instrument_id FROM instr
        UNION ALL SELECT 'ISIN', 'X' || instrument_id, instrument_id FROM instr WHERE instrument_id % 4 = 1"""),
    "property_sets": sql("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 100)::INT ELSE coalesce(impact_score, -1) END AS impact_score,
        CASE WHEN doc_id % 6 = 0 THEN 'rates' ELSE array_to_string(themes, ',') END AS themes FROM docs"""),
    "client_administration": sql("""SELECT client_id, CASE WHEN client_id % 9 = 0 THEN 'defunct' WHEN client_id % 17 = 0 THEN 'active' ELSE coalesce(status, 'active') END AS status,
        CASE WHEN client_id % 8 = 0 THEN (group_id + 1) % 5 ELSE group_id END AS group_id, CASE WHEN client_id % 10 = 0 THEN 'PENSION' ELSE client_type END AS client_type,
        CASE WHEN client_id % 12 = 0 THEN 3 ELSE benchmark_id END AS benchmark_id, client_id % 10 = 5 AS refused FROM clients"""),
    "client_create": sql("""SELECT client_id, CASE WHEN problems = '' THEN 'created' ELSE 'refused' END AS status, problems, CASE WHEN problems = '' THEN client_type ELSE '-' END AS client_type,
        problems = '' AND (client_id % 2 = 0 OR coalesce(esg_constrained, FALSE)) AS esg_constrained FROM (SELECT *, array_to_string(list_filter([CASE WHEN client_id % 13 = 0 THEN 'name' END,
            CASE WHEN client_id % 7 = 0 THEN 'client_type' END, CASE WHEN client_id % 19 = 0 THEN 'alert_frequency' END, CASE WHEN client_id % 23 = 0 THEN 'impact_threshold' END,
            CASE WHEN client_id % 29 = 0 THEN 'themes' END], lambda x: x IS NOT NULL), ',') AS problems FROM clients)"""),
    "profile_updates": sql(f"""SELECT client_id, status, CASE WHEN ok THEN array_to_string(list_filter([CASE WHEN f IS NOT NULL THEN 'alert_frequency' END, CASE WHEN t IS NOT NULL THEN 'impact_threshold' END, CASE WHEN m IS NOT NULL THEN 'mandate_type' END,
            CASE WHEN x IS NOT NULL THEN 'mandate_text' END, CASE WHEN h IS NOT NULL THEN 'horizon' END, CASE WHEN e IS NOT NULL OR len(xs) > 0 THEN 'esg_constrained' END, CASE WHEN xs IS NOT NULL THEN 'excluded' END,
            CASE WHEN th IS NOT NULL THEN 'mandate_themes' END, CASE WHEN b IS NOT NULL THEN 'benchmark' END], lambda y: y IS NOT NULL), ',') ELSE '' END AS changes,
        CASE WHEN ok AND f IS NOT NULL THEN lower(f) ELSE alert_frequency END AS alert_frequency, CASE WHEN ok AND t IS NOT NULL THEN t ELSE impact_threshold::DOUBLE END AS impact_threshold, CASE WHEN ok AND m IS NOT NULL THEN m ELSE mandate_type END AS mandate_type,
        md5(coalesce(CASE WHEN ok AND x IS NOT NULL THEN trim(x) ELSE mandate_text END, '-')) AS mandate, CASE WHEN old IS NULL THEN NULL WHEN ok AND h IS NOT NULL THEN lower(h) ELSE 'medium' END AS horizon,
        coalesce((CASE WHEN ok AND e IS NOT NULL THEN e WHEN ok AND len(xs) > 0 THEN TRUE ELSE esg_constrained END)::VARCHAR, '-') AS esg_constrained, CASE WHEN old IS NULL THEN '-' WHEN ok AND xs IS NOT NULL THEN array_to_string(xs, ',') ELSE '' END AS excluded,
        coalesce(array_to_string(CASE WHEN ok AND th IS NOT NULL THEN list_transform(th, lambda y: lower(trim(y))) ELSE mandate_themes END, ','), '-') AS mandate_themes,
        CASE WHEN ok AND b IS NOT NULL THEN upper(trim(b)) ELSE ticker END AS benchmark, CASE WHEN ok AND b IS NOT NULL AND upper(trim(b)) NOT IN (SELECT ticker FROM instr) THEN upper(trim(b)) END AS new_benchmark
        FROM (SELECT *, status = 'OK' AS ok FROM (SELECT r.*, c.* EXCLUDE (client_id, status), c.client_id AS old, CASE WHEN f = 'never' THEN 'INVALID_ALERT_FREQUENCY' WHEN t > 100 THEN 'INVALID_IMPACT_THRESHOLD' WHEN length(x) > 5000 THEN 'MANDATE_TEXT_TOO_LONG'
            WHEN h = 'forever' THEN 'INVALID_HORIZON' WHEN th = ['moon'] THEN 'INVALID_MANDATE_THEMES' WHEN coalesce(f, t::VARCHAR, m, x, h, e::VARCHAR, xs::VARCHAR, th::VARCHAR, b) IS NULL THEN 'NO_UPDATES_PROVIDED' WHEN c.client_id IS NULL THEN 'CLIENT_NOT_FOUND'
            WHEN r.client_id % 5 <> 0 AND group_id NOT IN (0, 1, 2) THEN 'ACCESS_DENIED' ELSE 'OK' END AS status FROM req r LEFT JOIN clients c ON c.client_id = r.client_id)) LEFT JOIN instr ON instrument_id = benchmark_id""",
        ("req", """SELECT client_id, CASE WHEN client_id % 21 = 0 THEN 'never' WHEN client_id % 3 = 0 THEN 'DAILY' END AS f, CASE WHEN client_id % 4 = 0 THEN (client_id % 110)::DOUBLE END AS t, CASE WHEN client_id % 6 = 0 THEN 'macro' END AS m,
            CASE WHEN client_id % 14 = 0 THEN '  ' WHEN client_id % 7 = 0 THEN repeat('words ', client_id % 1000) END AS x, CASE WHEN client_id % 16 = 0 THEN 'forever' WHEN client_id % 8 = 0 THEN 'Long' END AS h, CASE WHEN client_id % 9 = 0 THEN client_id % 2 = 0 END AS e,
            CASE WHEN client_id % 20 = 0 THEN ['tobacco'] WHEN client_id % 10 = 0 THEN []::VARCHAR[] END AS xs, CASE WHEN client_id % 22 = 0 THEN [' Rates', 'fx'] WHEN client_id % 11 = 0 THEN ['moon'] END AS th,
            CASE WHEN client_id % 24 = 0 THEN ' t3 ' WHEN client_id % 12 = 0 THEN 'NEWONE' END AS b FROM (SELECT client_id FROM clients UNION ALL SELECT -client_id FROM clients WHERE client_id % 40 = 7)""")),
    "portfolio_changes": sql("""SELECT c.client_id, coalesce(added, 0) AS added, coalesce(changed, 0) AS changed, coalesce(removed, 0) AS removed, coalesce(remaining, 0) AS remaining, (c.client_id % 15 = 0)::BIGINT AS refused
        FROM clients c LEFT JOIN (SELECT client_id, count(*) FILTER (put AND NOT was) AS added, count(*) FILTER (put AND was) AS changed, count(*) FILTER (out) AS removed, count(*) FILTER (NOT out) AS remaining FROM (
            SELECT client_id, instrument_id, bool_or(w) AS was, bool_or(NOT w) AS put, bool_or(w) AND (instrument_id + client_id) % 4 = 0 AS out FROM (SELECT client_id, instrument_id, TRUE AS w FROM holds
                UNION ALL SELECT client_id, client_id * 19 % (SELECT part FROM n), FALSE FROM clients WHERE client_id % 15 <> 0) GROUP BY 1, 2) GROUP BY 1) s ON s.client_id = c.client_id"""),
    "watchlist_changes": sql("SELECT client_id, instrument_id FROM (SELECT * FROM watches UNION SELECT client_id, client_id % (SELECT part FROM n) FROM clients) WHERE instrument_id % 2 = 1"),
    "taxonomy": sql("""SELECT dimension, count(known) AS n, min(code) FILTER (known IS NOT NULL) AS first, max(code) FILTER (known IS NOT NULL) AS last, coalesce(sum(uses), 0)::BIGINT AS uses,
        count(*) FILTER (uses IS NULL) AS unused, count(*) FILTER (known IS NULL) AS unknown FROM known FULL JOIN used USING (dimension, code) GROUP BY 1""",
        ("known", f"""SELECT DISTINCT dimension, code, 1 AS known FROM (SELECT 'client_type' AS dimension, unnest({_list(CLIENT_TYPES)}) AS code UNION ALL SELECT 'event', unnest({_list(list(v.EVENT_CATEGORY))})
            UNION ALL SELECT 'theme', unnest({_list(v.THEMES)}) UNION ALL SELECT 'tier', unnest({_list(v.TIERS)}) UNION ALL SELECT 'region', unnest({_list(v.REGIONS)}))"""),
        ("used", """SELECT dimension, code, count(*) AS uses FROM (SELECT 'client_type' AS dimension, client_type AS code FROM clients UNION ALL SELECT 'event', event_code FROM docs UNION ALL SELECT 'theme', unnest(themes) FROM docs
            UNION ALL SELECT 'tier', impact_tier FROM docs UNION ALL SELECT 'region', region FROM srcs) WHERE code IS NOT NULL GROUP BY 1, 2""")),
}
