"""The same tables as DuckDB common table expressions, for the SQL that checks queries."""

from __future__ import annotations

from tickerloom.functions import vocabulary as v
from tickerloom.functions.text import BOUNDARIES, CHUNK, LEAST, OVERLAP


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + "]"


def _case(values: dict, key: str) -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(x)}" for k, x in values.items() if x is not None) + " END"


_TH = _list(v.THEMES)
_EV = _list(list(v.EVENT_CATEGORY))

VIEWS = {
    "n": "SELECT (SELECT count(*) FROM part) AS part, (SELECT count(*) FROM supplier) AS supplier, (SELECT count(*) FROM embeddings) AS embeddings",
    "docs": f"""SELECT doc_id, substr(text, 1, 60) AS title, text AS content, lang AS language, source, (doc_id % 5)::INT AS group_id,
        CASE WHEN doc_id % 20 = 19 THEN doc_id - 5 ELSE doc_id END AS story_id,
        TIMESTAMP '{v.NOW}' - to_minutes(((story_id * 7919) % 43200 - CASE WHEN story_id <> doc_id THEN 10 ELSE 0 END)::INT) AS created_at,
        CASE WHEN doc_id % 29 <> 0 THEN ((doc_id * 37) % 101)::INT END AS impact_score,
        CASE WHEN (doc_id * 37) % 101 >= 90 THEN 'PLATINUM' WHEN (doc_id * 37) % 101 >= 75 THEN 'GOLD' WHEN (doc_id * 37) % 101 >= 50 THEN 'SILVER'
             WHEN (doc_id * 37) % 101 >= 30 THEN 'BRONZE' ELSE 'STANDARD' END AS impact_tier,
        list_sort(list_distinct([{_TH}[(doc_id % 25 + 1)::INT], {_TH}[((doc_id * 7 + 3) % 25 + 1)::INT]])) AS themes,
        {_EV}[(story_id % 32 + 1)::INT] AS event_code,
        {_case(v.EVENT_CATEGORY, f"{_EV}[(story_id % 32 + 1)::INT]")} AS event_type FROM documents""",
    "srcs": f"""SELECT source, trust_level, {_case(v.TRUST, "trust_level")}::DOUBLE AS trust_score, {_case(v.TRUST_POINTS, "trust_level")} AS trust_points,
        {_list(v.REGIONS)}[num % 6 + 1] AS region, num % 10 <> 9 AS active
        FROM (SELECT source, num, {_list(list(v.TRUST))}[num % 4 + 1] AS trust_level
              FROM (SELECT DISTINCT source, regexp_extract(source, '([0-9]+)$', 1)::INT AS num FROM documents WHERE source IS NOT NULL))""",
    "instr": """SELECT p_partkey AS instrument_id, 'T' || p_partkey AS ticker, p_name AS name, p_type AS instrument_type, p_brand AS index_name,
        p_partkey % (SELECT supplier FROM n) AS company_id, p_size * p_retailprice * 1000 AS daily_volume_usd FROM part""",
    "comps": """SELECT s_suppkey AS company_id, s_name AS company, n_name AS sector, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "clients": f"""SELECT c_custkey AS client_id, c_name AS name, {_case(v.CLIENT_TYPES, "c_mktsegment")} AS client_type, (c_custkey % 5)::INT AS group_id,
        CASE WHEN c_custkey % 17 = 0 THEN 'defunct' WHEN c_custkey % 17 = 1 THEN NULL ELSE 'active' END AS status,
        (30 + c_custkey % 40)::INT AS impact_threshold, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 = 0 END AS esg_constrained,
        CASE WHEN c_custkey % 13 <> 0 THEN ['equity', 'credit', 'macro'][(c_custkey % 3 + 1)::INT] END AS mandate_type,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '  ' ELSE 'Focus on ' || {_TH}[(c_custkey % 25 + 1)::INT] END AS mandate_text,
        list_sort(list_distinct([{_TH}[(c_custkey % 25 + 1)::INT], {_TH}[((c_custkey * 3 + 1) % 25 + 1)::INT], {_TH}[((c_custkey * 11 + 5) % 25 + 1)::INT]])) AS mandate_themes,
        CASE WHEN c_custkey % 4 <> 0 THEN 'contact' || c_custkey END AS primary_contact,
        ['realtime', 'hourly', 'daily', 'weekly'][(c_custkey % 4 + 1)::INT] AS alert_frequency,
        (c_custkey * 19) % (SELECT part FROM n) AS benchmark_id, 'NATION_' || (c_custkey % 25) AS excluded_sector,
        c_custkey % (SELECT embeddings FROM n) AS mandate_vec_id FROM customer""",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "affects": """SELECT doc_id, (story_id * 31 + k * 17) % (SELECT part FROM n) AS instrument_id,
        ['positive', 'negative', 'neutral'][((story_id + k) % 3 + 1)::INT] AS direction, ([0.05, 0.02, 0.01][((story_id * 3 + k) % 3 + 1)::INT])::DOUBLE AS magnitude
        FROM docs, (VALUES (0), (1), (2)) ks(k)""",
    "mentions": """SELECT doc_id, instrument_id % (SELECT supplier FROM n) AS company_id FROM affects
        UNION SELECT doc_id, (doc_id * 13) % (SELECT supplier FROM n) FROM documents""",
    "competes": """SELECT from_id, to_id FROM (SELECT s_suppkey AS from_id, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey),
        first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS to_id FROM supplier) WHERE from_id <> to_id""",
    "supplies": "SELECT s_suppkey AS from_id, (s_suppkey * 3 + 1) % (SELECT supplier FROM n) AS to_id FROM supplier WHERE s_suppkey <> (s_suppkey * 3 + 1) % (SELECT supplier FROM n)",
    "exposures": "SELECT p_partkey AS instrument_id, 'FACTOR_' || (p_partkey % 5) AS factor, (((p_partkey * 11) % 41) - 20) / 10.0::DOUBLE AS beta FROM part",
    "docfac": "SELECT doc_id, 'FACTOR_' || (doc_id % 5) AS factor FROM documents WHERE doc_id % 8 = 3",
    "holds": """SELECT client_id, instrument_id, cents / sum(cents) OVER (PARTITION BY client_id) AS weight, shares FROM (
        SELECT o_custkey AS client_id, l_partkey AS instrument_id, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS cents, sum(l_quantity)::BIGINT AS shares
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 97 <> 5 GROUP BY 1, 2)""",
    "watches": """SELECT DISTINCT user_id AS client_id, (props->>'$.k')::BIGINT AS instrument_id FROM events
        WHERE event_type = 'view' AND props->>'$.k' IS NOT NULL""",
    "permitted": "SELECT DISTINCT client_id, g AS group_id FROM (SELECT client_id, unnest([group_id, 0]) AS g FROM clients)",
}


def _stop(start: str) -> str:
    """Where a piece of ``content`` (of ``n`` characters) ends that starts at ``start``."""
    region = f"substr(content, {start} + {CHUNK * 4 // 5} + 1, {CHUNK // 5})"
    last = lambda mark: f"length(regexp_extract({region}, '(?s)^.*[{mark[0]}]{'[ ]' if mark[1] == ' ' else chr(92) + 'n'}'))"
    marks = " ".join(f"WHEN {last(m)} > 0 THEN {start} + {CHUNK * 4 // 5} + {last(m)}" for m in BOUNDARIES)
    return f"CASE WHEN {start} + {CHUNK} >= n THEN n {marks} ELSE {start} + {CHUNK} END"


_NEXT = f"greatest(b - {OVERLAP}, a + 1)"
_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: All pieces of whole texts: (doc_id, piece, start_char, end_char, text).
PIECES = [
    ("cuts", f"""SELECT doc_id, coalesce(content, '') AS content, length(coalesce(content, '')) AS n, 0 AS k, 0::BIGINT AS a, ({_stop("0")})::BIGINT AS b FROM (SELECT doc_id, content, length(coalesce(content, '')) AS n FROM docs)
        UNION ALL SELECT doc_id, content, n, k + 1, {_NEXT}, ({_stop(_NEXT)})::BIGINT FROM cuts WHERE b < n"""),
    ("stripped", f"SELECT *, CASE WHEN n <= {CHUNK} THEN content ELSE regexp_replace(regexp_replace(substr(content, a + 1, b - a), '^{_BLANK}', ''), '{_BLANK}$', '') END AS text FROM cuts"),
    ("pieces", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS piece, a AS start_char, b AS end_char, text FROM stripped WHERE n <= {CHUNK} OR length(text) >= {LEAST}"),
]


def sql(query: str, *more: tuple[str, str]) -> str:
    """``query`` after the views, and after further (name, SELECT) pairs."""
    parts = [*VIEWS.items(), *more]
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n" + query
