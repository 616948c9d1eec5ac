"""Document, source, alias and audit stores: files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tickerloom.sources.lineage import cut_lineage
from tickerloom.sources.versions import SPLIT, VersionLog


class DocumentStore:
    """Versioned documents below ``path``, partitioned by group and day, so that scans prune folders.

    Each save and each deletion takes the next number of a log, and its rows carry it: of the rows and deletions of a (guid, group) the
    one with the greatest number holds. So saving again replaces, a document can come back after its deletion, and nothing is rewritten before
    ``compact``. A save or deletion that breaks off changes nothing.
    """

    KEYS = ("group_id", "created_date")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, f"{self.path}/log")

    def save(self, docs: DataFrame) -> None:
        """Write documents with guid, group_id and created_at; those of the same guid and group are replaced. Of rows that share both the newest is saved."""
        number = self.log.change(lambda state: {})
        newest = F.row_number().over(Window.partitionBy("guid", "group_id").orderBy(F.col("created_at").desc_nulls_last(), F.xxhash64(*docs.columns)))
        rows = docs.withColumn("__n", newest).filter("__n = 1").drop("__n")
        rows = rows.withColumn("created_date", F.to_date("created_at")).withColumn("saved", F.lit(number).cast("long"))
        # a few files a folder, however many tasks there are and however many documents a day has
        dealt = rows.repartition(*self.KEYS, F.pmod(F.xxhash64("guid"), F.lit(SPLIT)))
        dealt.write.mode("append").partitionBy(*self.KEYS).parquet(f"{self.path}/documents")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def _outdated(self) -> DataFrame:
        """(guid, group_id, saved) of rows that a later save or deletion has replaced; from the key columns alone."""
        keys = self._rows().select("guid", "group_id", "saved")
        files, at = self.log._files(f"{self.path}/deleted")
        gone = self.spark.read.schema("guid string, group_id int, saved long").parquet(f"{self.path}/deleted") if files.exists(at) else keys.limit(0)
        last = keys.unionByName(gone).groupBy("guid", "group_id").agg(F.max("saved").alias("last"))
        return keys.join(last, ["guid", "group_id"]).filter("saved < last").select("guid", "group_id", "saved")

    def scan(self, day: str | None = None) -> DataFrame:
        """All documents, or those of a day."""
        rows = self._rows()
        if day is not None:
            rows = rows.filter(F.col("created_date") == F.to_date(F.lit(day)))
        return rows.join(self._outdated(), ["guid", "group_id", "saved"], "left_anti").select(*[c for c in rows.columns if c != "saved"])

    def compact(self) -> int:
        """Drop replaced rows from the folders that hold some, folder by folder; how many there were. No answer changes; no other writer may be at work."""
        outdated = cut_lineage(self._outdated())
        count = outdated.count()
        if not count:
            return 0
        rows = self._rows()
        touched = cut_lineage(rows.join(outdated, ["guid", "group_id", "saved"], "left_semi").select(*self.KEYS).distinct())
        held = rows.join(F.broadcast(touched), list(self.KEYS), "left_semi")  # a row a folder
        live = cut_lineage(held.join(outdated, ["guid", "group_id", "saved"], "left_anti"))
        live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.KEYS).parquet(f"{self.path}/documents")
        for group, day in touched.join(live.select(*self.KEYS).distinct(), list(self.KEYS), "left_anti").collect():  # folders without a live row
            files, at = self.log._files(f"{self.path}/documents/group_id={group}/created_date={day}")
            files.delete(at, True)
        return count

    def get(self, guid: str, permitted: list[int], day: str | None = None) -> DataFrame:
        """The document with a status: OK with its row, DENIED or NOT_FOUND without. With a day only its folders are read."""
        asked = self.spark.createDataFrame([(guid,)], "guid string")
        status = F.when(F.col("group_id").isNull(), "NOT_FOUND").when(F.col("group_id").isin(permitted), "OK").otherwise("DENIED")
        return asked.join(self.scan(day).filter(F.col("guid") == guid), "guid", "left").withColumn("status", status)

    def exists(self, guid: str, group: int, day: str | None = None) -> bool:
        return self.scan(day).filter((F.col("guid") == guid) & (F.col("group_id") == group)).limit(1).count() > 0

    def delete(self, guid: str, group: int) -> bool:
        """Whether there was such a document."""
        if not self.exists(guid, group):
            return False
        number = self.log.change(lambda state: {})
        self.spark.createDataFrame([(guid, group, number)], "guid string, group_id int, saved long").coalesce(1).write.mode("append").parquet(f"{self.path}/deleted")
        return True

    def delete_all(self, gone: DataFrame) -> None:
        """Delete documents (guid, group_id) by one number; those that don't exist are no error."""
        number = self.log.change(lambda state: {})
        gone.select("guid", F.col("group_id").cast("int").alias("group_id"), F.lit(number).cast("long").alias("saved")).distinct().write.mode("append").parquet(f"{self.path}/deleted")

    def by_group(self, groups: list[int], limit: int | None = None) -> DataFrame:
        """Newest day first, then guid, of permitted groups; an empty list permits none."""
        rows = self.scan().filter(F.col("group_id").isin(groups)).orderBy(F.desc("created_date"), F.desc("guid"))
        return rows.limit(limit) if limit is not None else rows

    def by_groups(self, groups: list[int], limit: int | None = None) -> DataFrame:
        """Newest first over several permitted groups together."""
        rows = self.scan().filter(F.col("group_id").isin(groups)).orderBy(F.desc("created_at"), F.desc("guid"))
        return rows.limit(limit) if limit is not None else rows

    def by_dates(self, group: int, first: str, last: str) -> DataFrame:
        return self.scan().filter((F.col("group_id") == group) & F.col("created_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))

    def count(self) -> DataFrame:
        return self.scan().groupBy("group_id").count()

    def new_version(self, guid: str, new_guid: str, **changes: object) -> None:
        """Append the next version of a document, with some columns changed; both stay."""
        old = self.scan().filter(F.col("guid") == guid).drop("created_date")
        new = {"guid": F.lit(new_guid), "previous_version_guid": F.lit(guid), "version": F.col("version") + 1, **{k: F.lit(x) for k, x in changes.items()}}
        self.save(old.select(*[new[c].cast(t).alias(c) if c in new else F.col(c) for c, t in old.dtypes]))

    def latest(self) -> DataFrame:
        """Documents that no other names as its predecessor."""
        rows = self.scan()
        return rows.join(rows.select(F.col("previous_version_guid").alias("guid")).filter(F.col("guid").isNotNull()), "guid", "left_anti")


class PieceStore:
    """Pieces of documents (guid, piece, group_id, text, vector), by document."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def of(self, guid: str) -> DataFrame:
        return self.rows.filter(F.col("guid") == guid).orderBy("piece")

    def without(self, gone: DataFrame) -> PieceStore:
        """The store less the pieces of some documents (guid)."""
        return PieceStore(self.rows.join(gone.select("guid"), "guid", "left_anti"))

    def count(self) -> DataFrame:
        return self.rows.groupBy("group_id").agg(F.count_distinct("guid").alias("documents"), F.count("*").alias("pieces"))


def read_json_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a folder of JSON files, one object or list each: rows with the fields of ``schema`` and ``file``, and (file, text) of what can't be read.

    A broken file, or one whose fields have other types, costs its own rows only, and is listed.
    """
    kinds = StructType([*_parse_datatype_string(schema), *_parse_datatype_string("__broken string")])
    found = spark.read.schema(kinds).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").option("recursiveFileLookup", True).json(path)
    found = cut_lineage(found.withColumn("file", F.col("_metadata.file_path")))  # parsed once
    return found.filter("__broken IS NULL").drop("__broken"), found.filter("__broken IS NOT NULL").select("file", F.col("__broken").alias("text"))


IPS = (
    "client_guid string, client_name string, archetype string, primary_objective string, risk_tolerance string, time_horizon string, esg_policy string, trust_requirement string, "
    "alert_threshold double, prohibited_sectors array<string>, esg_exclusions array<string>, positive_themes array<string>, news_priority array<string>"
)
#: What a trust requirement says, and the trust that it asks for; else DEFAULT_TRUST.
TRUST_TEXTS = {"trust level 8+": 8, "trust level 2+": 2, "trust level 1+": 1}
DEFAULT_TRUST = 5


def load_ips(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, quarantine) of a folder of policy statements: their fields, the least trust that they ask for, and a summary in lines.

    A statement without a client or with a missing field is quarantined too.
    """
    rows, broken = read_json_files(spark, path, IPS)
    names = [f.name for f in _parse_datatype_string(IPS)]
    whole = F.forall(F.array(*[F.col(c).isNotNull() for c in names]), lambda x: x)
    trust = F.lit(DEFAULT_TRUST)
    for text, least in reversed(TRUST_TEXTS.items()):
        trust = F.when(F.contains(F.lower("trust_requirement"), F.lit(text)), least).otherwise(trust)
    parts = [("Objective", "primary_objective"), ("Risk Tolerance", "risk_tolerance"), ("Time Horizon", "time_horizon"), ("ESG Policy", "esg_policy"), ("Trust Requirement", "trust_requirement")]
    lists = [("News Priorities", "news_priority"), ("Positive Themes", "positive_themes")]
    lines = [F.concat(F.lit("Investment Profile for "), "client_name", F.lit(":"))]
    lines += [F.concat(F.lit(f"{k}: "), c) for k, c in parts] + [F.concat(F.lit(f"{k}: "), F.array_join(c, ", ")) for k, c in lists]
    profiles = rows.filter(whole).withColumn("min_trust", trust).withColumn("summary", F.trim(F.concat_ws("\n", *lines)))
    lacking = rows.filter(~whole).select("file", F.to_json(F.struct(*names)).alias("text"))
    return profiles, broken.unionByName(lacking)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(scheme, value, canonical_guid) from JSON, CSV or TSV; incomplete rows are dropped, schemes upper-cased, values trimmed."""
    if path.endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
    else:
        rows = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return rows.select(F.upper(F.trim("scheme")).alias("scheme"), F.trim("value").alias("value"), "canonical_guid").replace("", None).dropna()


def latest_by_key(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: the row of each key with the greatest ``order``; ties by the whole row."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*changes.columns))))
    return changes.withColumn("__n", last).filter("__n = 1").drop("__n")


class AuditLog:
    """Append-only events as JSON lines by day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame) -> None:
        """Entries with a timestamp column ``timestamp``."""
        entries.withColumn("date", F.date_format("timestamp", "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(self.path)

    def count(self) -> DataFrame:
        """Entries by day."""
        return self.spark.read.json(self.path).groupBy(F.col("date").cast("string").alias("date")).count()

    def clear(self, day: str) -> bool:
        """Drop the entries of a day; whether there were any."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/date={day}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(at) and files.delete(at, True)

    def query(self, first: str, last: str, limit: int | None = 100, **equal: str) -> DataFrame:
        """Entries from day ``first`` to ``last`` with equal fields, oldest first; None: all of them."""
        rows = self.spark.read.json(self.path).filter(F.col("date").cast("string").between(first, last))
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == value)
        rows = rows.orderBy("timestamp")
        return rows if limit is None else rows.limit(limit)
