"""Golden values of scores and text functions."""

import datetime as dt
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import languages
from tickerloom.functions import scoring as sc
from tickerloom.functions import text as tx
from tickerloom.operators import dedupe
from tickerloom.sources import lineage


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))



def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, direct, theme, vector, competitor, supplier, peer, half", [
    (0.0, 0.9, 0.6, 0.5, 0.4, 0.6, 0.4, 60), (0.25, 0.775, 0.675, 0.6, 0.475, 0.55, 0.45, 90), (0.5, 0.65, 0.75, 0.7, 0.55, 0.5, 0.5, 120),
    (0.75, 0.525, 0.825, 0.8, 0.625, 0.45, 0.55, 150), (1.0, 0.4, 0.9, 0.9, 0.7, 0.4, 0.6, 180), (7.0, 0.4, 0.9, 0.9, 0.7, 0.4, 0.6, 180),
])
def test_bias(x, direct, theme, vector, competitor, supplier, peer, half):
    b = sc.Bias(x)
    wanted = {"DIRECT_HOLDING": direct, "WATCHLIST": 0.8, "THEMATIC": theme, "VECTOR": vector, "COMPETITOR": competitor, "SUPPLY_CHAIN": supplier, "PEER": peer}
    assert b.bases == pytest.approx(wanted)
    assert b.half_life_minutes == half


def test_recency(spark):
    then = F.to_timestamp_ntz(F.lit("2024-01-13 12:00:00"))
    assert one(spark, sc.recency30(then, now())) == pytest.approx(2.718 ** (-0.023 * 17))
    assert one(spark, sc.recency30(F.lit(None).cast("timestamp_ntz"), now())) == 0.5
    assert one(spark, sc.recency_breaking(F.to_timestamp_ntz(F.lit("2024-01-30 23:00:00")), now(), 60)) == pytest.approx(0.5)
    assert one(spark, sc.recency_breaking(then, now(), 0)) == 0
    assert one(spark, sc.impact_norm(F.lit(140))) == 1 and one(spark, sc.impact_norm(F.lit(None).cast("int"))) == 0
    assert one(spark, sc.trust_score(F.lit("HIGH"))) == 1 and one(spark, sc.trust_score(F.lit("odd"))) == 0.5
    assert one(spark, sc.position_boost(F.lit(0.5))) == pytest.approx(0.3 * math.log2(1.5))


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, sc.cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, sc.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_text(spark):
    assert one(spark, dedupe.normalize_text(F.lit("  A \n\tb  "))) == "a b"
    assert one(spark, tx.word_count(F.lit(" one  two\n"))) == 2 and one(spark, tx.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, tx.is_cjk(F.lit("abc 漢"))) and not one(spark, tx.is_cjk(F.lit(None).cast("string")))
    print_ = dedupe.story_fingerprint(F.lit(None).cast("string"), F.lit(dt.datetime(2024, 1, 2)), F.array(F.lit("b"), F.lit("a"), F.lit("B")))
    assert one(spark, print_) == "OTHER|2024-01-02|A,B"
    assert one(spark, tx.tolerant_list(F.lit("no json"))) == []


@pytest.mark.parametrize("raw, score, tier, themes", [
    ('```json\n{"impact_score": 140, "impact_tier": "gold", "themes": [" Supply Chain", "x"]}\n```', 100, "GOLD", ["supply_chain"]),
    ('{"impact_score": -3, "impact_tier": "odd"}', 0, "STANDARD", []),
])
def test_extraction(spark, raw, score, tier, themes):
    x = one(spark, tx.parse_extraction(F.lit(raw)))
    assert (x["impact_score"], x["impact_tier"], x["themes"]) == (score, tier, themes)


@pytest.mark.parametrize("raw", ["oops", '{"impact_score": 3}', '{"impact_tier": "GOLD"}', ""])
def test_extraction_incomplete(spark, raw):
    assert one(spark, tx.parse_extraction(F.lit(raw))) is None


def planned(spark, column) -> str:
    """The optimised plan of a column over texts."""
    rows = spark.createDataFrame([("x",)], "text string").select(column.alias("x"))
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_embedding_hashes_a_text_once(spark):
    plan = planned(spark, tx.hash_embedding(F.col("text")))
    assert plan.count("sha2(") == 1 and plan.index("sha2(") < plan.index("lambdafunction(")  # in no lambda of the numbers
    for dims in (1, 32, 40, 384):
        assert len(one(spark, tx.hash_embedding(F.lit("x"), dims))) == dims


def test_language_cuts_a_text_once(spark):
    assert planned(spark, languages.detect(F.col("text"))).count("split(") == 1


def test_chunks():
    text = ("A sentence of some length here. " * 120).strip()
    pieces = list(tx.chunks_of(text))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b[0] == max(a[1] - tx.OVERLAP, a[0] + 1) for a, b in zip(pieces, pieces[1:], strict=False))
    assert all(p[2].endswith(".") for p in pieces)
    assert list(tx.chunks_of("short")) == [(0, 5, "short")]


def test_texts_reach_workers_in_bounded_batches(spark):
    """400 texts of 100,000 characters in one partition: no batch holds over twice the bound, in pieces as elsewhere."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 10_000).alias("content"))
    tx.chunk_documents(docs)
    assert int(spark.conf.get(conf)) == lineage.ARROW_BYTES
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())])) for b in batches)
    found = [r["n"] for r in lineage.map_batches(docs, sizes, "n long").collect()]
    assert sum(found) == 400 and max(found) * 100_000 <= 2 * lineage.ARROW_BYTES


def test_stores(spark, tmp_path):
    from tickerloom.sources.stores import AuditLog, DocumentStore, load_aliases

    rows = [("a", 1, dt.datetime(2024, 1, 1), None), ("b", 1, dt.datetime(2024, 1, 2), "a"), ("c", 2, dt.datetime(2024, 1, 3), None)]
    store = DocumentStore(spark, str(tmp_path / "docs"))
    store.save(spark.createDataFrame(rows, "guid string, group_id int, created_at timestamp, previous_version_guid string"))
    assert [r["guid"] for r in store.by_group([1]).collect()] == ["b", "a"]
    assert store.by_group([]).count() == 0
    assert {g: store.get(g, [1]).first()["status"] for g in "acx"} == {"a": "OK", "c": "DENIED", "x": "NOT_FOUND"}
    assert {r["guid"] for r in store.latest().collect()} == {"b", "c"}
    assert store.by_dates(1, "2024-01-02", "2024-01-09").count() == 1
    (tmp_path / "a.csv").write_text("scheme,value,canonical_guid\nticker, A ,g1\nticker,,g2\n")
    assert [tuple(r) for r in load_aliases(spark, str(tmp_path / "a.csv")).collect()] == [("TICKER", "A", "g1")]
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.append(spark.createDataFrame([("e1", "x", dt.datetime(2024, 1, 1)), ("e2", "y", dt.datetime(2024, 1, 5))], "id string, event_type string, timestamp timestamp"))
    assert [r["id"] for r in log.query("2024-01-01", "2024-01-02").collect()] == ["e1"]
    assert [r["id"] for r in log.query("2024-01-01", "2024-01-09", event_type="y").collect()] == ["e2"]
