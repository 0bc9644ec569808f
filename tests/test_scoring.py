import pytest
from perigee.operators import ranges, scoring

S = 1_000_000_000
ROW = "event_id string, category string, start_ns long, end_ns long, is_selected_channel boolean"
A, RARE, GAP = ("A", "Anomaly", 10, 20), ("R", "Rare Event", 30, 40), ("G", "Communication Gap", 30, 40)


def one(spark, predictions, events, positive=("Anomaly",), masked=scoring.MASKED):
    p = spark.createDataFrame([(a * S, b * S) for a, b in predictions], "start_ns long, end_ns long")
    e = spark.createDataFrame([(i, c, a * S, b * S, True) for i, c, a, b in events], ROW)
    return scoring.f_beta(p, e, 0, 100 * S, positive, masked).first().asDict(), scoring.modes(p, e, 0, 100 * S)


@pytest.mark.parametrize("predictions,events,want", [
    ([(10, 20)], [A], {"tp": 1, "fp": 0, "fn": 0, "f_beta": 1.0}),
    ([], [A], {"tp": 0, "fp": 0, "fn": 1, "f_beta": 0.0}),
    ([(10, 20), (30, 40)], [A], {"tp": 1, "fp": 1, "nominal_ns": 89_999_999_998, "fp_time_ns": 10 * S}),
    ([(11, 12), (20, 21)], [("A", "Anomaly", 10, 30)], {"tp": 1, "fp": 0}),
    ([(20, 20)], [A], {"tp": 1, "fn": 0}),
    ([(32, 34)], [A, GAP], {"tp": 0, "fp": 0, "fn": 1}),
])
def test_hand_values(spark, predictions, events, want):
    got, _ = one(spark, predictions, events)
    assert {k: got[k] for k in want} == want


def test_modes(spark):
    _, m = one(spark, [(12, 13), (32, 33)], [A, RARE])
    got = {r["mode"]: r for r in m.collect()}
    assert got["unusual"]["tp"] == 2
    assert (got["operational"]["tp"], got["operational"]["rare_alarms"], got["operational"]["burden_precision"]) == (1, 1, 0.5)
    _, m = one(spark, [(32, 34)], [A, GAP])
    assert {(r["gap_predictions"], r["gap_events"]) for r in m.collect()} == {(1, 1)}


def test_grouping_of_samples(spark):
    x = spark.createDataFrame([(0, t * S, p) for t, p in ((0, True), (1, True), (10, True), (11, False))], "k long, ts_ns long, positive boolean")
    got = sorted(map(tuple, ranges.islands(x, ["k"], 2 * S).select("start_ns", "end_ns").collect()))
    assert got == [(0, 3 * S), (10 * S, 11 * S - 1)]


def test_beta_must_be_positive(spark):
    x = spark.createDataFrame([], "start_ns long, end_ns long")
    with pytest.raises(ValueError):
        scoring.f_beta(x, spark.createDataFrame([], ROW), 0, 1, ("Anomaly",), beta=0)
