"""Embedding providers by name, and table functions for SQL over the pieces of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tickerloom.functions.text import chunks_of

#: Texts that a provider gets at a time.
BATCH = 256


@dataclass(frozen=True)
class Provider:
    """Vectors of ``dims`` numbers for a list of texts; ``make`` is called once in each task, so that a model is loaded there."""

    dims: int
    make: Callable[[], Callable[[list[str]], np.ndarray]]


def _hashed(dims: int) -> Callable[[list[str]], np.ndarray]:
    """Byte i % 32 of the SHA-256 from -1 to 1: the same vectors as the column function, for tests and as a stand-in for a model."""

    def embed(texts: list[str]) -> np.ndarray:
        digests = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 32)
        return digests[:, np.arange(dims) % 32] / 255 * 2 - 1

    return embed


_PROVIDERS: dict[str, Provider] = {"hash": Provider(384, lambda: _hashed(384))}


def register_provider(name: str, provider: Provider) -> None:
    """Make a provider known; a name stands for one provider."""
    if _PROVIDERS.setdefault(name, provider) is not provider:
        raise ValueError(f"there is a provider named {name}")


def provider(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"no provider named {name}; there are {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name]


def embed(df: DataFrame, name: str = "hash", text: str = "content", out: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text, from the provider of that name; null texts have none. Vectors of other sizes than the provider's are an error."""
    found = provider(name)
    kept = df.select(*[c for c in df.columns if c != out])
    names = kept.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = found.make()
        for batch in batches:
            texts, vectors = batch.column(at).to_pylist(), []
            for lo in range(0, len(texts), BATCH):
                some = texts[lo : lo + BATCH]
                real = [t for t in some if t is not None]
                made = np.asarray(model(real), np.float64) if real else np.empty((0, found.dims))
                if made.shape != (len(real), found.dims):
                    raise ValueError(f"provider {name} made vectors of shape {made.shape}")
                rows = iter(made.tolist())
                vectors += [None if t is None else next(rows) for t in some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{out}` array<double>")


class Pieces:
    """Table function ``pieces(TABLE(t), id => 'doc_id', text => 'content')``: a row a piece with the id's own type, whatever else the table has."""

    @staticmethod
    def analyze(table: AnalyzeArgument, id: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or id.value is None or text.value is None:
            raise ValueError("pieces needs a table and the names of its id and text columns")
        fields = {f.name: f for f in table.dataType.fields}
        for name in (id.value, text.value):
            if name not in fields:
                raise ValueError(f"no column {name}; there are {', '.join(fields)}")
        if not isinstance(fields[text.value].dataType, StringType):
            raise ValueError(f"{text.value} is no string")
        places = [StructField(c, IntegerType()) for c in ("piece", "start_char", "end_char")]
        return AnalyzeResult(StructType([StructField(id.value, fields[id.value].dataType), *places, StructField("content", StringType())]))

    def eval(self, table: Row, id: str, text: str):
        for n, (start, end, content) in enumerate(chunks_of(table[text] or "")):
            yield table[id], n, start, end, content


def register_table_functions(spark: SparkSession) -> None:
    """Make ``pieces`` callable from the session's SQL."""
    spark.udtf.register("pieces", F.udtf(Pieces))
