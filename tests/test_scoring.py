"""Scoring against labels, by hand-counted cases and a plain rerun."""

from strandlog.plans import scoring


def test_case_scores_and_pooled(spark):
    said = spark.createDataFrame([("a", "x", 1), ("a", "x", 4), ("a", "y", 2), ("a", "s", 1), ("b", "x", 1), (None, "x", 1)], "case string, entity string, rank int")
    real = spark.createDataFrame([("a", "y"), ("a", "z"), ("a", "y"), ("a", "s"), ("c", "z")], "case string, entity string")
    skip = spark.createDataFrame([("a", "s")], "case string, entity string")
    got = {r["case"]: r for r in scoring.case_scores(said, real, skip).collect()}
    assert tuple(got["a"])[1:7] == (2, 1, 2, 0, 1, 1) and got["a"]["f1"] == 0.5
    assert (got["b"]["n"], got["b"]["truth"], got["b"]["recall"]) == (1, 0, None)
    assert (got["c"]["n"], got["c"]["precision"], got["c"]["recall"]) == (0, None, 0.0)
    p = scoring.pooled(scoring.case_scores(said, real, skip), universe=10).first()
    assert (p["cases"], p["n"], p["hits"], p["truth"]) == (2, 2, 1, 3) and abs(p["lift"] - 0.5 * 20 / 3) < 1e-9
    assert scoring.case_scores(said.limit(0), real.limit(0)).count() == 0


def test_bootstrap_holds_the_figure_and_reruns_agree(spark):
    rows = [(str(i), 4, i % 5, 5) for i in range(200)]
    scores = spark.createDataFrame(rows, "case string, n int, hits int, truth int")
    a, b = ({r["statistic"]: tuple(r) for r in scoring.bootstrap(scores, 200).collect()} for _ in range(2))
    assert a == b and a["precision"][1] < 0.5 < a["precision"][2] and a["recall"][1] < 0.4 < a["recall"][2] and a["f1"][3] == 200
