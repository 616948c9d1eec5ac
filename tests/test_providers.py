"""Embedding providers and the table function of pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import providers
from tickerloom.functions import text as tx
from tickerloom.functions.providers import Provider


def lengths(dims):
    return lambda: lambda texts: np.array([[len(t)] * dims for t in texts], float)


def test_providers(spark):
    rows = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (4, "é")], "id long, content string").withColumn("embedding", F.lit("old"))
    made = {r["id"]: r["embedding"] for r in providers.embed(rows).collect()}
    native = {r["id"]: r["e"] for r in rows.select("id", tx.hash_embedding(F.col("content")).alias("e")).collect()}
    assert made[2] is None and all(np.allclose(made[i], native[i]) for i in (1, 3, 4)) and len(made[1]) == 384
    providers.register_provider("lengths", Provider(3, lengths(3)))
    assert {r["id"]: r["v"] for r in providers.embed(rows, "lengths", out="v").collect()} == {1: [9.0] * 3, 2: None, 3: [0.0] * 3, 4: [1.0] * 3}
    with pytest.raises(ValueError, match="there is a provider"):
        providers.register_provider("lengths", Provider(3, lengths(3)))
    with pytest.raises(ValueError, match="no provider named other; there are hash, lengths"):
        providers.embed(rows, "other")
    providers.register_provider("wrong", Provider(3, lengths(2)))
    with pytest.raises(Exception, match="vectors of shape"):
        providers.embed(rows, "wrong").collect()
    assert providers.embed(rows.limit(0)).count() == 0


def test_table_function(spark):
    long = "A sentence of some words. " * 200
    docs = spark.createDataFrame([("a", long, 1), ("b", None, 2), ("c", "short", 3)], "guid string, body string, piece int")
    docs.createOrReplaceTempView("stored")
    providers.register_table_functions(spark)
    found = spark.sql("SELECT * FROM pieces(TABLE(stored), id => 'guid', text => 'body') ORDER BY guid, piece")
    assert found.dtypes == [("guid", "string"), ("piece", "int"), ("start_char", "int"), ("end_char", "int"), ("content", "string")]
    wanted = [(g, n, *c) for g, t in (("a", long), ("b", ""), ("c", "short")) for n, c in enumerate(tx.chunks_of(t))]
    assert [tuple(r) for r in found.collect()] == wanted
    for arguments in ("TABLE(stored), id => 'guid', text => 'none'", "TABLE(stored), id => 'guid', text => 'piece'"):
        with pytest.raises(Exception, match="no column none|is no string"):
            spark.sql(f"SELECT * FROM pieces({arguments})")
