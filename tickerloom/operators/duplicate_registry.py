"""A registry of documents for duplicate detection that batches keep up: hashes, story fingerprints, vectors and token counts in buckets of their keys.

An arriving batch reads only the buckets that its own keys fall into. All tables change in one version, and a batch that has a name is
registered once, however often it is tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import dedupe
from tickerloom.sources.domain import News
from tickerloom.sources.domain_sql import sql
from tickerloom.sources.lineage import cut_lineage, fresh_path
from tickerloom.sources.versions import Conflict, Table, Tables

TABLES = {
    "hashes": Table("doc_id long, group_id int, hash string", ("group_id", "hash")),
    "stories": Table("doc_id long, group_id int, created_at timestamp_ntz, fingerprint string", ("group_id", "fingerprint")),
    "vectors": Table("doc_id long, group_id int, created_at timestamp_ntz, day int, embedding array<double>", ("group_id", "day")),
    "tokens": Table("doc_id long, source string, key binary, terms string, counts binary, norm2 long", ("source",)),
    # the keys of each document, so that it can be found in the others by its id
    "documents": Table("doc_id long, group_id int, hash string, fingerprint string, day int, source string", ("doc_id",)),
}
DOCUMENT = "doc_id long, group_id int, source string, created_at timestamp_ntz, title string, content string, event_type string, tickers array<string>, embedding array<double>"


class DuplicateRegistry:
    """Registered documents below ``path``. Batches have the columns of ``DOCUMENT``; ids are distinct and not null, and ascend with arrival."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.tables = Tables(spark, path, TABLES, buckets)

    def _keyed(self, batch: DataFrame) -> dict[str, DataFrame]:
        """What each table would hold of a batch."""
        fingerprint = dedupe.story_fingerprint(F.col("event_type"), F.col("created_at"), F.coalesce("tickers", F.array().cast("array<string>")))
        keys = batch.select(
            "doc_id", "group_id", "source", "created_at", dedupe.content_hash(F.col("title"), F.col("content")).alias("hash"), fingerprint.alias("fingerprint"),
            F.unix_date(F.to_date("created_at")).alias("day"), "embedding",
        )
        keys = cut_lineage(keys)
        return {
            "hashes": keys.filter(F.col("hash") != dedupe.EMPTY_HASH), "stories": keys, "vectors": keys.filter(F.col("embedding").isNotNull()),
            "tokens": cut_lineage(dedupe.token_vectors(batch)), "documents": keys,
        }

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self.tables.bucket_of(table).alias("b")).distinct().collect()]  # at most all buckets

    def _met(self, state: dict, table: str, rows: DataFrame) -> DataFrame:
        """The registered rows of the buckets that some rows' keys fall into."""
        return self.tables.read(table, state=state, buckets=self._touched(table, rows))

    def _matches(self, state: dict, own: dict[str, DataFrame]) -> DataFrame:
        new = own["documents"].select("doc_id")
        columns = lambda table: own[table].select(*[f.name for f in self.tables.schema(table)])
        # a document that is registered already is looked at as the batch has it
        before = lambda table, rows: self._met(state, table, rows).join(new, "doc_id", "left_anti")
        union = lambda table: before(table, own[table]).unionByName(columns(table))
        hashes = dedupe.match_hashes(own["hashes"].select("doc_id", "group_id", "hash"), union("hashes"))
        stories = dedupe.match_stories(union("stories")).join(new, "doc_id", "left_semi")
        days = own["vectors"].select("group_id", F.explode(F.sequence(F.col("day") - 2, F.col("day"))).alias("day")).distinct()
        vectors = dedupe.match_vectors(before("vectors", days).withColumn("fresh", F.lit(False)).unionByName(columns("vectors").withColumn("fresh", F.lit(True))))
        fresh = before("tokens", own["tokens"]).withColumn("fresh", F.lit(False)).unionByName(columns("tokens").withColumn("fresh", F.lit(True)))
        return dedupe.first_step(new, hashes, stories, vectors, dedupe.match_tokens(cut_lineage(fresh)))

    def check(self, batch: DataFrame) -> DataFrame:
        """(doc_id, method, duplicate_of) for each document of a batch: its first match among registered documents and earlier ones of the batch."""
        return self._matches(self.tables.state(), self._keyed(batch))

    def _register(self, own: dict[str, DataFrame], name: str | None) -> bool:
        if name is not None and name in self.tables.log.latest()[1].get("done", []):
            return False
        again = self._met(self.tables.state(), "documents", own["documents"]).join(own["documents"].select("doc_id"), "doc_id", "left_semi").select("doc_id")
        self.unregister(again)
        staged = {table: self.tables.stage(table, rows) for table, rows in own.items()}
        return self.tables.commit(staged, once=name) is not None

    def register(self, batch: DataFrame, name: str | None = None) -> bool:
        """Add a batch; documents of ids that are there already replace them. With a name, False if a batch of that name was registered before."""
        return self._register(self._keyed(batch), name)

    load = register

    def check_and_register(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """What ``check`` says, and then the batch is registered, duplicates too."""
        own = self._keyed(batch)
        found = cut_lineage(self._matches(self.tables.state(), own))
        self._register(own, name)
        return found

    def unregister(self, ids: DataFrame) -> int:
        """Drop documents (doc_id) from all tables in one version; how many there were."""
        ids = cut_lineage(ids.select("doc_id").distinct())
        while True:
            state = self.tables.state()
            gone = cut_lineage(self._met(state, "documents", ids).join(ids, "doc_id", "left_semi"))
            count = gone.count()
            if not count:
                return 0
            replaced = {}
            for table in TABLES:
                rows = gone.filter(F.col("source").isNotNull()) if table == "tokens" else gone
                touched = [b for b in self._touched(table, rows) if b in state[table]]
                kept = self.tables.read(table, state=state, buckets=touched).join(gone.select("doc_id"), "doc_id", "left_anti")
                staged = self.tables.stage(table, kept, True) if touched else {}
                replaced[table] = {b: staged.get(b, []) for b in touched}
            try:
                self.tables.commit({}, replaced, state)
                return count
            except Conflict:
                continue

    def clear(self) -> None:
        """Drop all documents, and forget the names of batches."""
        self.tables.log.change(lambda state: {"buckets": self.tables.buckets, "tables": {}, "done": []})

    def count(self) -> int:
        """Registered documents, from the state alone."""
        return sum(e["rows"] for entries in self.tables.state()["documents"].values() for e in entries)


def arrivals(n: News) -> DataFrame:
    """The documents with what the registry looks at."""
    tickers = n.affects.join(n.instruments.select("instrument_id", "ticker"), "instrument_id").groupBy("doc_id").agg(F.collect_set("ticker").alias("tickers"))
    rows = n.documents.withColumn("vec_id", F.col("story_id") % n.sizes["embeddings"]).join(tickers, "doc_id", "left").join(n.vectors, "vec_id", "left")
    return rows.selectExpr(*[c.split(" ")[0] for c in DOCUMENT.split(", ")])


#: Batches of the query, by ranges of the documents' number.
BATCHES = 3


def registry_batches(n: News) -> DataFrame:
    """(doc_id, batch, method, duplicate_of): documents that arrive in batches, each checked against those that came before; every batch comes twice."""
    rows = cut_lineage(arrivals(n))
    most = rows.agg(F.max("doc_id")).first()[0] or 0
    registry = DuplicateRegistry(n.spark, fresh_path(n.spark, "registry"), 16)
    out = None
    for batch in range(BATCHES):
        own = rows.filter(F.floor(F.col("doc_id") * BATCHES / (most + 1)) == batch)
        found = registry.check_and_register(own, f"batch-{batch}").withColumn("batch", F.lit(batch))
        registry.register(own, f"batch-{batch}")
        out = found if out is None else out.union(found)
    return out


_BATCH = f"floor(doc_id * {BATCHES} / ((SELECT max(doc_id) FROM docs) + 1))::INTEGER"
QUERIES = {"registry_batches": registry_batches}
SQL = {
    "registry_batches": sql(
        f"""SELECT docs.doc_id, {_BATCH.replace("doc_id *", "docs.doc_id *")} AS batch, coalesce(['hash', 'fingerprint', 'embedding', 'tokens'][step], 'none') AS method, coalesce(duplicate_of, -1) AS duplicate_of FROM docs LEFT JOIN (
        SELECT * FROM (SELECT doc_id, duplicate_of, 1 AS step FROM d1 UNION ALL SELECT doc_id, duplicate_of, 2 FROM arrived UNION ALL SELECT doc_id, duplicate_of, 3 FROM d3
            UNION ALL SELECT doc_id, duplicate_of, 4 FROM d4) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step, duplicate_of) = 1) USING (doc_id)""",
        *dedupe._CTES,
        ("told", f"SELECT doc_id, group_id, created_at, {_BATCH} AS batch, concat_ws('|', coalesce(event_type, 'OTHER'), strftime(created_at, '%Y-%m-%d'), coalesce(names, '')) AS story FROM docs LEFT JOIN nam USING (doc_id)"),
        ("arrived", """SELECT doc_id, duplicate_of FROM (SELECT a.doc_id, a.created_at, b.doc_id AS duplicate_of, b.created_at AS before_at FROM told a JOIN told b ON a.group_id = b.group_id AND a.story = b.story AND b.batch <= a.batch
            AND (b.created_at, b.doc_id) < (a.created_at, a.doc_id) QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.created_at DESC, b.doc_id DESC) = 1) WHERE before_at >= created_at - INTERVAL 24 HOUR"""),
    ),
}
