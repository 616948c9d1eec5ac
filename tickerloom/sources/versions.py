"""A log of small states, each committed by one renaming that never replaces a file; and tables in buckets whose files a state names.

Writers put data into folders of their own and then try to commit the state that follows the one they read. Of two writers
one succeeds; the other reads again and decides anew. A reader pins a state, and sees exactly the files that it names, so
nothing of a writer that broke off is ever visible, and several tables change together or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


class VersionLog:
    """Numbered states (JSON) below ``path``, in any file system that Hadoop's FileContext knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _files(self, path: str):
        at = self._hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        """Committed versions in order."""
        files, at = self._files(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()) if files.exists(at) else []

    def state(self, number: int) -> dict:
        files, at = self._files(f"{self.path}/versions/{number:012d}")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest version and its state; 0 and {} at the start."""
        numbers = self.numbers()
        return (numbers[-1], self.state(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, state: dict) -> bool:
        """Make ``state`` version ``number``, whole or not at all; False if there is such a version."""
        files, made = self._files(f"{self.path}/attempts/{uuid.uuid4().hex}")
        out = files.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, end = self._files(f"{self.path}/versions/{number:012d}")
        files.mkdirs(end.getParent())
        if files.exists(end):
            return False
        context = self._hadoop.FileContext.getFileContext(files.makeQualified(made).toUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(made, end, never_replace)
        except Exception:
            if files.exists(end):
                return False
            raise
        return True

    def change(self, decide: Callable[[dict], dict | None]) -> int | None:
        """Commit what ``decide`` makes of the newest state, again if others commit meanwhile; None if it gives None."""
        while True:
            number, state = self.latest()
            new = decide(state)
            if new is None:
                return None
            if self.commit(number + 1, new):
                return number + 1


#: Parts of a bucket in a shuffle.
SPLIT = 4


@dataclass(frozen=True)
class Table:
    """Columns (DDL), the key by whose hash rows go to buckets, and a SQL expression whose sum is the digest that two tables are compared by."""

    schema: str
    key: tuple[str, ...]
    digest: str = "0"


class Conflict(Exception):
    """Another writer changed what was to be replaced."""


def summed(c: Column) -> Column:
    """An exact sum of hashes as text: equal for equal rows in any order, and repeats don't cancel."""
    return F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string")


class Tables:
    """Tables below ``path`` in a fixed number of buckets. A state maps table, bucket to entries {at, rows, own, digest, bytes}."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.log = VersionLog(spark, path)
        _, state = self.log.latest()
        self.buckets = state.get("buckets", buckets)

    def schema(self, table: str) -> StructType:
        return _parse_datatype_string(self.tables[table].schema)

    def bucket_of(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].key), F.lit(self.buckets)).cast("int")

    def state(self, version: int | None = None) -> dict[str, dict[int, list[dict]]]:
        found = self.log.state(version) if version else self.log.latest()[1] if version is None else {}
        return {t: {int(b): e for b, e in found.get("tables", {}).get(t, {}).items()} for t in self.tables}

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None, state: dict | None = None, lenient: bool = False) -> DataFrame:
        """The rows of a version, of all or some buckets; only their files are listed and read. A folder that is lost is an error, unless ``lenient``."""
        held = (state or self.state(version))[table]
        paths = [f"{self.path}/data/{e['at']}/bucket={b}" for b in (held if buckets is None else buckets) for e in held.get(b, [])]
        if lenient:
            paths = [p for p in paths if (found := self.log._files(p))[0].exists(found[1])]
        schema = self.schema(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def digests(self, table: str, rows: DataFrame) -> list[Column]:
        """The aggregates of an entry: rows, a digest of whole rows, and that for comparisons."""
        whole = F.xxhash64(*[f.name for f in self.schema(table)])
        return [F.count("*").alias("rows"), summed(whole).alias("own"), summed(F.expr(self.tables[table].digest)).alias("digest")]

    def stage(self, table: str, rows: DataFrame, dealt: bool = False) -> dict[int, list[dict]]:
        """Write rows into a folder that no state names yet: shuffled by bucket, a bucket in several parts, however its keys are spread.

        Rows that were read from buckets of the same keys are ``dealt`` and are written as they are, about as many files as were read.
        """
        at = uuid.uuid4().hex
        folder = f"{self.path}/data/{at}"
        names = [f.name for f in self.schema(table)]
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema(table)]).withColumn("bucket", self.bucket_of(table))
        if not dealt:
            own = own.repartition("bucket", F.pmod(F.xxhash64(*names), F.lit(SPLIT)))
        own.write.partitionBy("bucket").parquet(folder)
        back = self.spark.read.schema(f"{self.tables[table].schema}, bucket int").parquet(folder)
        found = back.groupBy("bucket").agg(*self.digests(table, back)).collect()  # a row a bucket
        files, _ = self.log._files(folder)
        size = lambda b: files.getContentSummary(self.log._files(f"{folder}/bucket={b}")[1]).getLength()
        return {r["bucket"]: [{"at": at, "rows": r["rows"], "own": r["own"], "digest": r["digest"], "bytes": size(r["bucket"])}] for r in found}

    def append(self, rows: dict[str, DataFrame]) -> int:
        """Add rows to several tables in one version; never conflicts."""
        staged = {t: self.stage(t, r) for t, r in rows.items()}
        return self.commit(staged)

    def commit(self, added: dict[str, dict[int, list[dict]]], replaced: dict[str, dict[int, list[dict]]] | None = None, base: dict | None = None, once: str | None = None) -> int | None:
        """One version with entries ``added`` to buckets and with buckets ``replaced`` whole, which must be as in ``base``.

        With ``once``, a name that a state remembers: a change of that name is made once, and None comes back from then on.
        """

        def decide(state: dict) -> dict | None:
            tables = {t: {b: list(e) for b, e in state.get("tables", {}).get(t, {}).items()} for t in self.tables}
            done = state.get("done", [])
            if once is not None and once in done:
                return None
            for t, buckets in (replaced or {}).items():
                for b, entries in buckets.items():
                    if [e["at"] for e in tables[t].get(str(b), [])] != [e["at"] for e in (base or {}).get(t, {}).get(b, [])]:
                        raise Conflict(f"bucket {b} of {t} has changed")
                    tables[t][str(b)] = list(entries)
            for t, buckets in added.items():
                for b, entries in buckets.items():
                    tables[t].setdefault(str(b), []).extend(entries)
            return {"buckets": self.buckets, "tables": tables, "done": [*done, once] if once is not None else done}

        return self.log.change(decide)

    def done(self, name: str) -> bool:
        """Whether a change of that name was committed."""
        return name in self.log.latest()[1].get("done", [])

    def rewrite(self, table: str, buckets: Iterable[int], change: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> int | None:
        """Replace some buckets by what ``change`` makes of their rows (of the same keys) and by ``more`` rows, again if others change them meanwhile."""
        buckets = list(buckets)
        new = self.stage(table, more) if more is not None and buckets else {}
        while buckets:
            base = self.state()
            staged = self.stage(table, change(self.read(table, buckets=buckets, state=base)), True)
            staged = {b: staged.get(b, []) + new.get(b, []) for b in buckets}
            try:
                return self.commit({}, {table: {b: staged.get(b, []) for b in buckets}}, base)
            except Conflict:
                continue
        return None

    def compact(self, table: str, most: int = 4) -> int | None:
        """Rewrite the buckets that have more than ``most`` entries as one entry each; no answer changes."""
        return self.rewrite(table, [b for b, e in self.state()[table].items() if len(e) > most], lambda rows: rows)

    def clean(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last ``keep`` versions names, those of writers that broke off too; no writer may be at work."""
        numbers = self.log.numbers()[-keep:]
        named = {e["at"] for n in numbers for t in self.state(n).values() for entries in t.values() for e in entries}
        files, at = self.log._files(f"{self.path}/data")
        gone = [s.getPath() for s in files.listStatus(at) if s.getPath().getName() not in named] if files.exists(at) else []
        for folder in gone:
            files.delete(folder, True)
        return [folder.getName() for folder in gone]
