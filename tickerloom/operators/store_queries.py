"""The stores over the test tables: documents saved, replaced, deleted and saved again; their pieces; and the audit log by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.piece_index import PieceIndex
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import PIECES, sql
from tickerloom.sources.lineage import fresh_path
from tickerloom.sources.stores import AuditLog, DocumentStore


def _stored(n: News) -> DocumentStore:
    """All documents, some of them replaced, some deleted, and some of these saved again."""
    store, d = DocumentStore(n.spark, fresh_path(n.spark, "documents")), F.col("doc_id")
    docs = n.documents.select(
        "doc_id", F.concat(F.lit("D"), d.cast("string")).alias("guid"), "group_id", "created_at", F.lit(1).alias("version"), F.lit(None).cast("string").alias("previous_version_guid"), "title"
    )
    save = lambda rows, mark: store.save(rows.withColumn("title", F.concat(F.lit(mark), "title")).drop("doc_id"))
    save(docs, "")
    save(docs.filter(d % 9 == 4).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")), "again ")
    store.delete_all(docs.filter(d % 10 == 3))
    save(docs.filter(d % 20 == 3), "back ")
    return store


def store_scan(n: News) -> DataFrame:
    """Every stored document."""
    return _stored(n).scan().select("guid", "group_id", F.md5("title").alias("title"), F.col("created_date").cast("string").alias("day"))


def store_scan_compacted(n: News) -> DataFrame:
    """The same after compaction, by group with the newest of each."""
    store = _stored(n)
    store.compact()
    return store.scan().groupBy("group_id").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"), F.min("guid").alias("first"))


def store_dates(n: News) -> DataFrame:
    """The documents of a group from one day to another."""
    return _stored(n).by_dates(1, "2024-01-08", "2024-01-19").select("guid", F.col("created_date").cast("string").alias("day"))


def store_groups(n: News) -> DataFrame:
    """The 50 newest documents of two permitted groups."""
    return _stored(n).by_groups([0, 2], 50).select("guid", "group_id", "created_at")


def store_lookup(n: News) -> DataFrame:
    """What a reader of two groups gets for a guid: the document, a refusal, or nothing; for one replaced, one deleted, one that came back and one that never was."""
    store, out = _stored(n), None
    for guid in ("D4", "D13", "D23", "D24", "nobody"):
        found = store.get(guid, [0, 3]).select("guid", "status", F.coalesce(F.when(F.col("status") == "OK", F.md5("title")), F.lit("-")).alias("title"))
        out = found if out is None else out.union(found)
    return out


def piece_store_counts(n: News) -> DataFrame:
    """Documents and pieces of the stored index by group, after some documents are deleted."""
    index = PieceIndex(n.spark, fresh_path(n.spark, "pieces"), 16)
    index.save(n.documents.select("doc_id", "content"))
    index.rebuild()
    index.delete(n.documents.filter(F.col("doc_id") % 6 == 1).select("doc_id"))
    index.rebuild()
    rows = index.pieces().join(n.documents.select("doc_id", "group_id"), "doc_id")
    return rows.groupBy("group_id").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pieces"))


def audit_store(n: News) -> DataFrame:
    """Entries of a log in files by day: those of one kind in a week, after one day is cleared."""
    log = AuditLog(n.spark, fresh_path(n.spark, "audit"))
    log.append(n.table("events").select("event_id", "event_type", "user_id", F.col("ts").alias("timestamp")))
    log.clear("2024-01-10")
    found = log.query("2024-01-08", "2024-01-14", limit=None, event_type="error")
    return found.select("event_id", "user_id", F.col("date").cast("string").alias("day"))


QUERIES = {f.__name__: f for f in (store_scan, store_scan_compacted, store_dates, store_groups, store_lookup, piece_store_counts, audit_store)}
_STORED = [
    ("sto", """SELECT doc_id, 'D' || doc_id AS guid, group_id, CASE WHEN doc_id % 20 = 3 THEN 'back ' WHEN doc_id % 9 = 4 THEN 'again ' ELSE '' END || title AS title,
        CASE WHEN doc_id % 9 = 4 AND doc_id % 20 <> 3 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS created_at FROM docs WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3"""),
]
SQL = {
    "store_scan": sql("SELECT guid, group_id, md5(title) AS title, created_at::DATE::VARCHAR AS day FROM sto", *_STORED),
    "store_scan_compacted": sql("SELECT group_id, count(*) AS n, max(created_at) AS newest, min(guid) AS first FROM sto GROUP BY 1", *_STORED),
    "store_dates": sql("SELECT guid, created_at::DATE::VARCHAR AS day FROM sto WHERE group_id = 1 AND created_at::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'", *_STORED),
    "store_groups": sql("SELECT guid, group_id, created_at FROM sto WHERE group_id IN (0, 2) ORDER BY created_at DESC, guid DESC LIMIT 50", *_STORED),
    "store_lookup": sql("""SELECT a.guid, CASE WHEN group_id IS NULL THEN 'NOT_FOUND' WHEN group_id IN (0, 3) THEN 'OK' ELSE 'DENIED' END AS status, CASE WHEN group_id IN (0, 3) THEN md5(title) ELSE '-' END AS title
        FROM (SELECT unnest(['D4', 'D13', 'D23', 'D24', 'nobody']) AS guid) a LEFT JOIN sto ON sto.guid = a.guid""", *_STORED),
    "piece_store_counts": sql("SELECT group_id, count(DISTINCT doc_id) AS documents, count(*) AS pieces FROM pieces JOIN docs USING (doc_id) WHERE doc_id % 6 <> 1 GROUP BY 1", *PIECES),
    "audit_store": "SELECT event_id, user_id, ts::DATE::VARCHAR AS day FROM events WHERE event_type = 'error' AND ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND ts::DATE <> DATE '2024-01-10'",
}
