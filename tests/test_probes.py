"""Cases where rows or keys could get lost or run together."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import audit as A
from holdfast.operators import fairness, metrics, primitives, provenance
from holdfast.operators.split import holdout
from holdfast.session import new_path
from holdfast.sources import sinks

PRED = "experiment string, model string, strategy string, seed int, id bigint, y int, score double, y_pred int"


def test_contents_do_not_run_together(make):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, None), (4, "?", "-"), (5, "a", "b|c")]
    cohort = make(rows, "id bigint, p string, q string")
    splits = make([(1, i, 1, "train" if i % 2 else "test") for i in range(1, 6)], "seed int, id bigint, y int, split string")
    got = A.audit_copies(splits, cohort, ["p", "q"]).collect()
    assert [(r["n_train"], r["n_test"]) for r in got] == [(1, 1)]  # rows 2 and 5


def test_near_texts_of_other_scripts_differ(make):
    texts = [chr(0x410 + i) * 3 + chr(0x4E00 + i) for i in range(20)]
    cohort = make([(i, t) for i, t in enumerate(texts)] + [(20, texts[3].lower() + " !")], "id bigint, text string")
    splits = make([(1, i, 1, "test" if i == 20 else "train") for i in range(21)], "seed int, id bigint, y int, split string")
    got = A.audit_near(splits, cohort, {}, texts=["text"]).collect()
    assert [(r["n_train"], r["n_test"]) for r in got] == [(1, 1)]


def test_unknown_entities_are_reported(make):
    splits = make([(1, 1, 1, "train"), (1, 2, 1, "test"), (1, 9, 1, "test")], "seed int, id bigint, y int, split string")
    got = A.audit_entity(splits, make([(1, 5), (2, 6)], "id bigint, entity_id bigint")).collect()
    assert [(r["entity_id"], r["n_train"], r["n_test"]) for r in got] == [(None, 0, 1)]


def test_null_entities_are_refused(make):
    cohort = make([(i, None if i % 4 == 0 else i // 2, i % 2) for i in range(40)], "id bigint, entity_id bigint, y int")
    with pytest.raises(ValueError, match="entity_id"):
        holdout(cohort, [1], entity="entity_id")


def test_strata_of_several_columns_do_not_run_together(make):
    cohort = make([(i, *(("a|b", "c") if i % 2 else ("a", "b|c"))) for i in range(40)], "id bigint, p string, q string")
    got = holdout(cohort.withColumn("y", F.lit(1)), [1], strata=("p", "q"), keep=["p"]).filter("split = 'test'").groupBy("p").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4]


def test_predictions_without_attributes_stay(make):
    pred = make([("e", "m", "s", 1, i, i % 2, 0.5, i % 2) for i in range(10)], PRED)
    attrs = make([(i, "x") for i in range(6)], "id bigint, g string")
    got = {r["grp"]: r["n"] for r in fairness.subgroups(pred, ["g"], attrs).collect()}
    assert got == {"x": 6, "missing": 4}


def test_undefined_scores_have_no_auc(make):
    rows = [("e", "m", "s", 1, i, i % 2, None, 1) for i in range(6)]
    rows += [("e", "m", "s", 2, i, i % 2, float(i % 2) if i < 4 else None, i % 2) for i in range(6)]
    got = {(r["seed"], r["metric"]): r["value"] for r in metrics.evaluate(make(rows, PRED)).collect()}
    assert got[1, "roc_auc"] is None and got[2, "roc_auc"] == 1.0 and got[1, "accuracy"] == 0.5 and got[2, "accuracy"] == 1.0


def test_predictions_keep_their_types(spark, make):
    pred = make([("007", "m", "1", 1, 5, 1, 0.5, 1)], PRED)
    back = sinks.write_predictions(pred, new_path(spark, "typed"))
    assert back.schema["experiment"].dataType.simpleString() == "string" and back.first()["experiment"] == "007"


def test_a_rerun_does_not_double_a_trace(make):
    claims = make([("c1", "f1", "s")], "claim_id string, metric string, strategy string")
    links = make([("c1", "r1", "fig")], "claim_id string, result_id string, figure string")
    manifest = make([("r1", "e", "old", "x", "fp", 1), ("r1", "e", "new", "x", "fp", 2)], "result_id string, experiment string, config string, script string, input_fp string, created_at int")
    assert [r["config"] for r in provenance.trace(claims, links, manifest).collect()] == ["new"]


def test_claims_know_their_model(make):
    claims = make([("c1", "f1", "s", "mean", 0.91, 2, "e", "m1")], "claim_id string, metric string, strategy string, stat string, claimed_value double, decimals int, experiment string, model string")
    found = make([("f1", "s", "mean", 0.912, "e", "m1"), ("f1", "s", "mean", 0.5, "e", "m2")], "metric string, strategy string, stat string, value double, experiment string, model string")
    assert [r["status"] for r in provenance.check_claims(claims, found).collect()] == ["confirmed"]


def test_broken_promises_of_size(make):
    with pytest.raises(ValueError, match="promised"):
        primitives.settle(make([(1,), (2,), (3,)], "x int"), 2)
