"""Profile updates, times, scenario titles, and vectors of mandates against brute force."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.operators import changes, feeds


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_times(spark):
    given = ["2024-01-02", "2024-01-02T03:04", "2024-01-02 03:04:05", "2024-01-02t03:04:05.25", "2024-01-02T03:04:05Z", "2024-01-02T03:04+02:00", "2024-01-02 03:04:05.5-05:30", "2024-13-02", "02/01/2024", "", None, "2024-01-02T25:00", "today"]
    t = dt.datetime
    wanted = [t(2024, 1, 2), t(2024, 1, 2, 3, 4), t(2024, 1, 2, 3, 4, 5), t(2024, 1, 2, 3, 4, 5, 250_000), t(2024, 1, 2, 3, 4, 5), t(2024, 1, 2, 1, 4), t(2024, 1, 2, 8, 34, 5, 500_000)] + [None] * 6
    assert column(spark, given, tx.parse_datetime) == wanted
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column(spark, given, tx.parse_datetime) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scenarios(spark):
    given = ["[Phase3 A] x", "  [Phase3] ", "[Phase3 A", "x [Phase3 A]", "[Phase2 A]", "", None, "[Phase3 a]b]"]
    assert column(spark, given, tx.scenario_of_title) == ["Phase3 A", "Phase3", None, None, None, None, None, "Phase3 a"]


def profile(i, group=1, esg=False):
    return (i, group, "daily", 50.0, "equity", "text", "medium", esg, [], ["ai"], "SPY")


def request(i, **fields):
    names = [f.split(" ")[0] for f in changes.PROFILE_REQUEST.split(", ")]
    return tuple(i if c == "client_id" else fields.get(c) for c in names)


def test_profile_updates(spark):
    kinds = "client_id long, group_id int, alert_frequency string, impact_threshold double, mandate_type string, mandate_text string, horizon string, esg_constrained boolean, excluded array<string>, mandate_themes array<string>, benchmark string"
    profiles = spark.createDataFrame([profile(i) for i in range(20)], kinds)
    rows = [
        request(0, alert_frequency="HOURLY", impact_threshold=0.0), request(1, mandate_text="  "), request(2, excluded=["tobacco"]), request(3, excluded=["tobacco"], esg_constrained=False), request(4, excluded=[], mandate_themes=[]),
        request(5, benchmark=" qqq "), request(6, benchmark="spy"), request(7), request(8, horizon="LONG", alert_frequency="never"), request(9, impact_threshold=100.5), request(10, mandate_text="x" * 5001),
        request(11, mandate_themes=["AI ", "moon"]), request(12, groups=[2], horizon="long"), request(13, groups=[1, 2], horizon="long"), request(99, horizon="long"),
    ]
    instruments = spark.createDataFrame([("SPY",), ("spy",)], "ticker string")
    found = {r["client_id"]: r for r in changes.update_profiles(profiles, spark.createDataFrame(rows, changes.PROFILE_REQUEST), instruments).collect()}
    assert len(found) == len(rows)
    status = {7: "NO_UPDATES_PROVIDED", 8: "INVALID_ALERT_FREQUENCY", 9: "INVALID_IMPACT_THRESHOLD", 10: "MANDATE_TEXT_TOO_LONG", 11: "INVALID_MANDATE_THEMES", 12: "ACCESS_DENIED", 99: "CLIENT_NOT_FOUND"}
    assert {i: r["status"] for i, r in found.items()} == {i: status.get(i, "OK") for i in found}
    assert (found[0]["alert_frequency"], found[0]["impact_threshold"], found[0]["changes"]) == ("hourly", 0.0, ["alert_frequency", "impact_threshold"])
    assert found[1]["mandate_text"] == "" and found[2]["esg_constrained"] and not found[3]["esg_constrained"] and found[2]["changes"] == ["esg_constrained", "excluded"]
    assert (found[4]["excluded"], found[4]["mandate_themes"]) == ([], []) and (found[5]["benchmark"], found[5]["new_benchmark"]) == ("QQQ", "QQQ") and (found[6]["benchmark"], found[6]["new_benchmark"]) == ("SPY", None)
    assert found[13]["horizon"] == "long" and all(found[i]["changes"] == [] and (found[i]["alert_frequency"], found[i]["horizon"]) == ("daily", "medium") for i in status if i != 99)


def test_mandates_meet_documents_in_blocks(spark, monkeypatch):
    """The best 25 of each mandate and group, from lists of documents by vector, with ties."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 3)).round(1)
    docs = [(d, d % 3, int(rng.integers(0, 40))) for d in range(600)]
    held = spark.createDataFrame([([(g, d) for d, g, v in docs if v == k], vectors[k].tolist()) for k in range(40)], "docs array<struct<group_id:int,doc_id:long>>, embedding array<double>").select("embedding", "docs").repartition(4)
    asked = [{"vec_id": k, "embedding": vectors[k].tolist()} for k in range(0, 40, 2)]
    found = sorted((r["q"], r["group_id"], r["doc_id"]) for r in feeds._nearest_by_group(held, asked).collect())
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wanted = []
    for k in range(0, 40, 2):
        for g in range(3):
            near = sorted((-round(float(unit[k] @ unit[v]), 9), d) for d, own, v in docs if own == g and unit[k] @ unit[v] >= feeds.VECTOR_LEAST)[: feeds.VECTOR_BEST]
            wanted += [(k, g, d) for _, d in near]
    assert found == sorted(wanted)
