"""The published comparison figures out of the reconstructed fixture."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators.metrics import confusion, evaluate, point_metrics, roc_auc
from holdfast.operators.provenance import check_claims, long_found
from holdfast.operators.stability import paired, summarize
from holdfast.operators.stats import paired_t, wilcoxon

# Seed -> (fp, fn, misordered pairs) without and with oversampling.
COUNTS = {
    1: ((0, 2, 4), (0, 1, 4)),
    2: ((2, 0, 1), (2, 0, 1)),
    3: ((0, 1, 0), (0, 2, 1)),
    4: ((1, 0, 0), (1, 0, 0)),
    5: ((1, 0, 0), (1, 0, 0)),
    6: ((0, 0, 0), (0, 2, 0)),
    7: ((0, 0, 0), (0, 0, 0)),
    8: ((0, 0, 0), (0, 0, 0)),
    9: ((0, 0, 0), (0, 0, 0)),
    10: ((0, 0, 0), (0, 0, 0)),
}
PUBLISHED = [
    ("accuracy", "unbalanced", "mean", 0.9821),
    ("accuracy", "unbalanced", "sd", 0.0211),
    ("f1", "unbalanced", "mean", 0.9816),
    ("f1", "unbalanced", "sd", 0.0217),
    ("roc_auc", "unbalanced", "mean", 0.9987),
    ("roc_auc", "unbalanced", "sd", 0.0033),
    ("accuracy", "oversampled", "mean", 0.9769),
    ("accuracy", "oversampled", "sd", 0.0225),
    ("f1", "oversampled", "mean", 0.9761),
    ("f1", "oversampled", "sd", 0.0235),
    ("roc_auc", "oversampled", "mean", 0.9984),
    ("roc_auc", "oversampled", "sd", 0.0033),
    ("accuracy", "both", "paired_t_p", 0.4433),
    ("accuracy", "both", "wilcoxon_p", 0.4142),
    ("f1", "both", "paired_t_p", 0.4476),
    ("f1", "both", "wilcoxon_p", 0.4142),
    ("roc_auc", "both", "paired_t_p", 0.3434),
    ("roc_auc", "both", "wilcoxon_p", 0.3173),
]


def predictions():
    rows = []
    for seed, sides in COUNTS.items():
        for strategy, (fp, fn, loss) in zip(("unbalanced", "oversampled"), sides):
            for i in range(20):
                rows.append(("gold", "m", strategy, seed, i, 0, float(i), int(i < fp)))
            for i in range(19):
                # The first positive is ranked below `loss` of the negatives.
                score = 19.5 - loss if i == 0 else 20.0 + i
                rows.append(("gold", "m", strategy, seed, 20 + i, 1, score, int(i >= fn)))
    return rows


@pytest.fixture(scope="module")
def gold(spark):
    schema = "experiment string, model string, strategy string, seed int, id bigint, y int, score double, y_pred int"
    pred = spark.createDataFrame(predictions(), schema)
    return pred, evaluate(pred).cache()


def test_all_published_figures_are_confirmed(spark, gold):
    _, metrics = gold
    pairs = paired(metrics, "unbalanced", "oversampled")
    found = long_found(summarize(metrics), paired_t(pairs).unionByName(wilcoxon(pairs)))
    claims = spark.createDataFrame(
        [(f"{m}-{s}-{k}", m, s, k, v, 4) for m, s, k, v in PUBLISHED],
        "claim_id string, metric string, strategy string, stat string, claimed_value double, decimals int",
    )
    status = {r["claim_id"]: r["status"] for r in check_claims(claims, found).collect()}
    assert len(status) == 18 and set(status.values()) == {"confirmed"}


def test_one_pass_metrics_equal_the_separate_ones(gold):
    pred, metrics = gold
    key = lambda r: (r["strategy"], r["seed"], r["metric"])
    both = {key(r): r["value"] for r in metrics.collect()}
    for r in point_metrics(confusion(pred)).collect():
        assert both[key(r)] == pytest.approx(r["value"], abs=1e-12)
    for r in roc_auc(pred).collect():
        assert both[(r["strategy"], r["seed"], "roc_auc")] == r["roc_auc"]


def test_population_sd_would_not_match(gold):
    _, metrics = gold
    sd = metrics.filter("metric = 'accuracy' and strategy = 'unbalanced'").agg(F.stddev_pop("value")).first()[0]
    assert round(sd, 4) == 0.0200
