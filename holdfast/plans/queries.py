"""Every operator as a named query over the test tables, with its plain SQL.

A query returns `(DataFrame builder, SQL or None)`. All of them run over whole tables.
Audit queries plant their own fault (from a column value), so that they have something
to find.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.expr import draw_key, r6
from holdfast.operators import audit as A
from holdfast.operators import balance as B
from holdfast.operators import fairness as J
from holdfast.operators import metrics as G
from holdfast.operators import model as M
from holdfast.operators import prepare as P
from holdfast.operators import provenance as L
from holdfast.operators import split as S
from holdfast.operators import stability as H
from holdfast.operators import stats as I
from holdfast.operators import transform as D
from holdfast.operators.figures import figure_data
from holdfast.operators.logistic import coefficients, fit_logistic, score_logistic
from holdfast.operators.primitives import prefix_sum, settle, take_k
from holdfast.operators.similarity import audit_jaccard, contents_of
from holdfast.plans.cohorts import DOC_FEATURES, ORDER_FEATURES, docs_cohort, emb_cohort, orders_cohort, table
from holdfast.plans.evaluation import SEEDS, STRATEGIES, gnb_predictions, sides
from holdfast.plans.oracle import CTES, fairness_ctes, gnb_ctes, logistic_ctes, metric_ctes, quota_sql, r, splits_ctes, sql, train_ctes
from holdfast.plans.run import Run, audit_summary, evaluate_run
from holdfast.session import new_path
from holdfast.sources import sinks
from holdfast.sources.cohort import CohortSpec, experiment_grid, load_cohort, seed_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS = 2 * len(SEEDS)


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# --- shared inputs -----------------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.store(docs_cohort(spark, sf), "docs")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.store(orders_cohort(spark, sf), "orders")


def docs_splits(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return S.holdout(docs(spark, sf), SEEDS, keep=keep)


def ord_splits(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return S.holdout(orders(spark, sf), SEEDS, keep=keep)


def docs_train(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return sides(docs_splits(spark, sf, keep))[0]


def ord_train(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return sides(ord_splits(spark, sf, keep))[0]


def docs_pred(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return gnb_predictions(docs(spark, sf), DOC_FEATURES, "docs", keep=keep)


def ord_pred(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return gnb_predictions(orders(spark, sf), ORDER_FEATURES, "orders", keep=keep)


def docs_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return G.evaluate(docs_pred(spark, sf))


def docs_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return H.paired(docs_metrics(spark, sf), *STRATEGIES)


def docs_tests(pairs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    out = I.paired_t(pairs).unionByName(I.wilcoxon(pairs))
    return out if sizes is None else out.unionByName(I.corrected_t(pairs, sizes))


def docs_sub(spark: SparkSession, sf: str) -> DataFrame:
    return J.subgroups(docs_pred(spark, sf, ["lang", "source"]), ["lang", "source"])


# --- A: sources and sinks ----------------------------------------------------------

ORDER_SPEC = CohortSpec(
    schema=T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.LongType()),
            T.StructField("o_orderstatus", T.StringType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_orderpriority", T.StringType()),
        ]
    ),
    ident="o_orderkey",
    target="o_orderstatus = 'F'",
    features={"price": "o_totalprice"},
    attrs={"priority": "o_orderpriority"},
    entity="o_custkey",
)


@query(
    "load_cohort",
    "SELECT o_orderkey AS id, o_custkey AS entity_id, (o_orderstatus = 'F')::INT AS y, o_totalprice AS price, "
    "o_orderpriority AS priority FROM orders",
)
def _(spark, sf):
    return load_cohort(spark, f"{sf}/orders.parquet", ORDER_SPEC)


@query(
    "seed_table",
    sql("SELECT s.seed, count(*) AS n_rows, count(*) FILTER (split = 'test') AS n_test FROM seeds s JOIN docs_splits d ON d.seed = s.seed GROUP BY ALL"),
)
def _(spark, sf):
    rows = docs_splits(spark, sf).join(F.broadcast(seed_table(spark, SEEDS)), "seed")
    return rows.groupBy("seed").agg(F.count("*").alias("n_rows"), F.count_if(F.col("split") == "test").alias("n_test"))


@query(
    "experiment_grid",
    sql(
        """SELECT md5(concat_ws('|', g.seed, g.strategy, g.model, g.config)) AS cell, g.seed, g.strategy, g.model,
                  g.config, t.n_train
           FROM (SELECT * FROM seeds, (VALUES ('unbalanced'), ('oversampled')) s(strategy),
                 (VALUES ('gnb'), ('majority')) m(model), (VALUES ('frac=0.2'), ('frac=0.3')) c(config)) g
           JOIN (SELECT seed, strategy, count(*) AS n_train FROM docs_train GROUP BY ALL) t
             ON t.seed = g.seed AND t.strategy = g.strategy"""
    ),
)
def _(spark, sf):
    grid = experiment_grid(
        seed_table(spark, SEEDS), STRATEGIES, ["gnb", "majority"], [{"frac": "0.2"}, {"frac": "0.3"}]
    )
    sets = B.unbalanced_and_even(docs_train(spark, sf), GROUPS)
    sizes = sets.groupBy("seed", "strategy").agg(F.count("*").alias("n_train"))
    return grid.join(sizes, ["seed", "strategy"])


@query(
    "write_predictions",
    sql(f"SELECT experiment, model, strategy, seed::INT AS seed, id, y, {r('score', 4)}, y_pred FROM docs_pred"),
)
def _(spark, sf):
    path = new_path(spark, "predictions")
    back = sinks.write_predictions(docs_pred(spark, sf), path)
    cols = ["experiment", "model", "strategy", "seed", "id", "y", "score", "y_pred"]
    return rounded(back.select(*cols), "score", places=4)


@query("write_results", sql(f"SELECT experiment, model, strategy, metric, n_seeds, {r('mean, sd, min, max')} FROM docs_summary"))
def _(spark, sf):
    path = new_path(spark, "results")
    back = sinks.write_results(H.summarize(docs_metrics(spark, sf)), "repeated_holdout", path, csv=True)
    return rounded(back, "mean", "sd", "min", "max")


@query("save_model")
def _(spark, sf):
    path = new_path(spark, "store")
    train, test = sides(S.freeze(docs_splits(spark, sf, DOC_FEATURES), new_path(spark, "splits")))
    cells = [(kind, seed) for kind in ("logistic", "forest", "boosted") for seed in SEEDS]

    def fit(cell):
        kind, seed = cell
        return M.fit_ml(kind, train.filter(F.col("seed") == seed), seed, DOC_FEATURES)

    def score(row):
        part = test.filter(F.col("seed") == int(row["seed"]))
        return M.score_ml(sinks.load_model(row["path"]), part, DOC_FEATURES, "docs", row["model"], row["strategy"])

    with ThreadPoolExecutor(4) as pool:  # one cell is a model, not a part of the rows
        models = list(pool.map(fit, cells))
        for (kind, seed), model in zip(cells, models):  # one writer at a time for the registry
            meta = {
                "experiment": "docs", "model": kind, "strategy": "unbalanced", "seed": seed,
                "config": "frac=0.2", "preprocessing": "mean fill, fitted on training rows",
            }
            sinks.save_model(model, meta, path)
        scored = list(pool.map(score, sinks.model_registry(spark, path).collect()))
    return G.confusion(reduce(DataFrame.unionByName, scored))


@query("append_manifest")
def _(spark, sf):
    path = new_path(spark, "manifest")
    digest = ";".join(f"{t}:{L.fingerprint(table(spark, sf, t)).first()['fingerprint']}" for t in ("documents", "labels"))
    metrics = docs_metrics(spark, sf)
    for config in ("frac=0.2", "frac=0.2;rerun"):
        back = sinks.append_manifest(sinks.manifest_rows(metrics, "repeated_holdout", config, digest), path)
    return back


@query(
    "figure_box",
    sql(
        f"""WITH q AS (SELECT experiment, model, strategy, metric, quantile_cont(value, 0.25) AS q1,
                    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM docs_metrics GROUP BY ALL),
             v AS (SELECT m.*, q.q1, q.median, q.q3,
                     m.value >= q.q1 - 1.5::DOUBLE * (q.q3 - q.q1) AND m.value <= q.q3 + 1.5::DOUBLE * (q.q3 - q.q1) AS inside
                   FROM docs_metrics m JOIN q USING (experiment, model, strategy, metric)),
             s AS (SELECT experiment, model, strategy, metric, min(value) FILTER (inside) AS whisker_low, q1, median, q3,
                     max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
                   FROM v GROUP BY ALL)
        SELECT experiment, model, strategy, metric, {r('whisker_low, q1, median, q3, whisker_high')}, n_outliers FROM s"""
    ),
)
def _(spark, sf):
    box = figure_data("box", docs_metrics(spark, sf))
    return longs(rounded(box, "whisker_low", "q1", "median", "q3", "whisker_high"), "n_outliers")


ROC_SQL = f"""
  WITH c AS (SELECT experiment, model, strategy, seed, round(score, 6) AS score, sum(y) AS pos, sum(1 - y) AS neg
             FROM {{p}}_pred GROUP BY ALL),
       d AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM c
             WINDOW w AS (PARTITION BY experiment, model, strategy, seed ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                    g AS (PARTITION BY experiment, model, strategy, seed)),
       e AS (SELECT experiment, model, strategy, seed, score, cfp::DOUBLE / n::DOUBLE AS fpr, ctp::DOUBLE / p::DOUBLE AS tpr FROM d)
  SELECT experiment, model, strategy, seed, {r('score', 4)}, {r('fpr, tpr')} FROM e"""


@query("figure_roc", sql(ROC_SQL.format(p="docs")))
def _(spark, sf):
    return rounded(rounded(figure_data("roc", docs_pred(spark, sf)), "score", places=4), "fpr", "tpr")


@query(
    "figure_bars",
    sql(
        f"""WITH s AS (SELECT experiment, model, strategy, attr, grp, measure, avg(value) AS mean, stddev_samp(value) AS sd,
             count(value) AS n_seeds FROM docs_fair GROUP BY ALL)
        SELECT experiment, model, strategy, attr, grp, measure, {r('mean, sd')}, n_seeds FROM s"""
    ),
)
def _(spark, sf):
    return rounded(figure_data("bars", J.fairness(docs_sub(spark, sf))), "mean", "sd")


# --- B: preparation ----------------------------------------------------------------


@query(
    "clean",
    """SELECT min(doc_id) AS doc_id, text, lang, source, n_chars
       FROM (SELECT doc_id, trim(text, ' ') AS text, CASE WHEN lower(trim(lang, ' ')) NOT IN ('', 'und') THEN lower(trim(lang, ' ')) END AS lang,
                    CASE WHEN trim(source, ' ') NOT IN ('src0', 'n/a') THEN trim(source, ' ') END AS source,
                    try_cast(n_chars AS INT) AS n_chars FROM documents) t
       GROUP BY text, lang, source, n_chars""",
)
def _(spark, sf):
    rules = {
        "text": P.Rule(),
        "lang": P.Rule(lower=True, sentinels=("", "und")),
        "source": P.Rule(sentinels=("src0", "n/a")),
        "n_chars": P.Rule(cast="int"),
    }
    return P.clean(table(spark, sf, "documents"), rules, ident="doc_id")


CRITERIA = [
    ("has a price", "o_totalprice > 1000"),
    ("known status", "o_orderstatus in ('F', 'O')"),
    ("not low priority", "o_orderpriority <> '5-LOW'"),
    ("ordered from 1995", "year(o_orderdate) >= 1995"),
]


def criteria_sql(final: str) -> str:
    cases = " ".join(f"WHEN NOT coalesce({e}, false) THEN {i}" for i, (_, e) in enumerate(CRITERIA, 1))
    names = ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(CRITERIA, 1))
    return f"WITH f AS (SELECT *, CASE {cases} END AS fail FROM orders), n(step, criterion) AS (VALUES {names}) {final}"


@query(
    "attrition",
    criteria_sql(
        """SELECT step, criterion, (SELECT count(*) FROM f WHERE fail = step) AS n_excluded,
                  (SELECT count(*) FROM f WHERE fail IS NULL OR fail > step) AS n_left FROM n"""
    ),
)
def _(spark, sf):
    return P.apply_criteria(table(spark, sf, "orders"), CRITERIA)[1]


@query("inclusion", criteria_sql("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM f WHERE fail IS NULL"))
def _(spark, sf):
    kept = P.apply_criteria(table(spark, sf, "orders"), CRITERIA)[0]
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("target", "SELECT o_orderkey AS id, (o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y FROM orders")
def _(spark, sf):
    out = P.with_target(table(spark, sf, "orders"), "o_totalprice > 100000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
    return out.select(F.col("o_orderkey").alias("id"), "y")


@query("predictors", sql(f"SELECT id, y, entity_id, {r('word_len, digit_share')}, n_chars, spaces, lang, source FROM docs"))
def _(spark, sf):
    return rounded(docs_cohort(spark, sf), "word_len", "digit_share")


@query(
    "predictors_from_expressions",
    f"""SELECT id, y, long_price, month, {r('log_price')} FROM (
        SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS y, (o_totalprice > 100000)::INT AS long_price,
               month(o_orderdate)::INT AS month, ln(1 + o_totalprice) AS log_price FROM orders) t""",
)
def _(spark, sf):
    base = P.with_target(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"), "o_orderstatus = 'F'")
    exprs = {
        "long_price": "cast(o_totalprice > 100000 as int)",
        "month": "month(o_orderdate)",
        "log_price": "ln(1 + o_totalprice)",
    }
    return rounded(P.with_features(base, exprs), "log_price")


APPROVAL_SQL = """SELECT source AS dataset, 10 * sum(toxic) < 2 * count(*) AS approved
                  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1"""


@query("release_view", f"SELECT doc_id, lang, n_chars FROM documents WHERE source IN (SELECT dataset FROM ({APPROVAL_SQL}) a WHERE approved)")
def _(spark, sf):
    texts = table(spark, sf, "documents").withColumnRenamed("source", "dataset")
    labels = table(spark, sf, "labels")
    approvals = (
        labels.join(texts.select("doc_id", "dataset"), "doc_id")
        .groupBy("dataset")
        .agg((10 * F.sum("toxic") < 2 * F.count("*")).alias("approved"))
    )
    return P.release_view(texts, approvals, ["doc_id", "lang", "n_chars"])


def pii_sql() -> str:
    parts = []
    for p, rx in P.PII_PATTERNS.items():
        parts.append(f"SELECT 'text' AS col, '{p}' AS pattern, count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '{rx}')) AS n_hits FROM documents")
    return f"SELECT col, pattern, n_rows, n_hits, round(n_hits::DOUBLE / n_rows, 6) + 0.0 AS share FROM ({' UNION ALL '.join(parts)}) t"


@query("pii_scan", pii_sql())
def _(spark, sf):
    return rounded(P.pii_scan(table(spark, sf, "documents"), ["text"]), "share")


def profile_sql() -> str:
    num, cat = ["y", "price", "month", "quantity", "extended", "discount"], ["segment", "region", "priority"]
    parts = []
    for c in num + cat:
        lo = f"min({c})::DOUBLE, max({c})::DOUBLE, avg({c})::DOUBLE" if c in num else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        kind = "numeric" if c in num else "categorical"
        src = "(SELECT * REPLACE (round(extended, 2) AS extended, round(discount, 6) AS discount) FROM orders_c) o"
        parts.append(f"SELECT '{c}', '{kind}', count(*), (count(*) - count({c}))::DOUBLE / count(*), count(DISTINCT {c}), {lo} FROM {src}")
    names = "t(variable, kind, n_rows, missing_share, n_distinct, min, max, mean)"
    return sql(f"SELECT variable, kind, n_rows, {r('missing_share')}, n_distinct, {r('min, max, mean', 3)} FROM ({' UNION ALL '.join(parts)}) {names}")


@query("profile", profile_sql())
def _(spark, sf):
    cols = ["y", *ORDER_FEATURES, "segment", "region", "priority"]
    # Summed features are rounded so that distinct counts do not hang on the last bit.
    cohort = orders_cohort(spark, sf).withColumns({"extended": F.round("extended", 2), "discount": F.round("discount", 6)})
    return rounded(rounded(P.profile(cohort, cols), "missing_share"), "min", "max", "mean", places=3)


# --- C: partitioning ---------------------------------------------------------------


@query("holdout", sql("SELECT seed, id, y, split FROM docs_splits"))
def _(spark, sf):
    return docs_splits(spark, sf)


@query("holdout_orders", sql("SELECT seed, id, y, split FROM ord_splits"))
def _(spark, sf):
    return ord_splits(spark, sf)


@query(
    "holdout_by_class_and_lang",
    sql(
        """SELECT seed, id, y, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split
           FROM (SELECT s.seed, c.id, c.y, q.k, row_number() OVER (PARTITION BY s.seed, c.y, c.lang
                   ORDER BY md5(concat_ws('|', s.seed, 'split', c.id)), c.id) AS rn
                 FROM docs c CROSS JOIN seeds s JOIN yl_quota q ON q.stratum = concat_ws('|', c.y, c.lang)) t""",
        yl_cnt="SELECT concat_ws('|', y, lang) AS stratum, count(*) AS n FROM docs GROUP BY 1",
        yl_quota=quota_sql("yl_cnt"),
    ),
)
def _(spark, sf):
    return S.holdout(docs(spark, sf), SEEDS, strata=("y", "lang"))


def entity_sql(cohort: str, final: str) -> str:
    return sql(
        final,
        ent=f"SELECT entity_id, (2 * sum(y) > count(*))::INT AS stratum FROM {cohort} GROUP BY 1",
        ent_cnt="SELECT stratum, count(*) AS n FROM ent GROUP BY 1",
        ent_quota=quota_sql("ent_cnt"),
        ent_side="""SELECT seed, entity_id, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split FROM (
            SELECT s.seed, e.entity_id, q.k, row_number() OVER (PARTITION BY s.seed, e.stratum
              ORDER BY md5(concat_ws('|', s.seed, 'split', e.entity_id)), e.entity_id) AS rn
            FROM ent e CROSS JOIN seeds s JOIN ent_quota q ON q.stratum = e.stratum) t""",
    )


@query("holdout_entity", entity_sql("orders_c", "SELECT e.seed, c.id, c.y, e.split, c.entity_id FROM orders_c c JOIN ent_side e ON e.entity_id = c.entity_id"))
def _(spark, sf):
    return S.holdout(orders(spark, sf), SEEDS, entity="entity_id")


REPORT_SQL = f"""
  WITH c AS (SELECT seed, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
                    count(*) FILTER (split = 'train' AND y = 1) AS pos_train, count(*) FILTER (split = 'test' AND y = 1) AS pos_test
             FROM {{t}} GROUP BY 1),
       d AS (SELECT *, pos_train::DOUBLE / n_train AS share_train, pos_test::DOUBLE / n_test AS share_test,
                    (pos_train + pos_test)::DOUBLE / (n_train + n_test) AS share_all FROM c),
       e AS (SELECT *, greatest(abs(share_train - share_all), abs(share_test - share_all)) AS max_dev FROM d)
  SELECT seed, n_train, n_test, pos_train, pos_test, {r('share_train, share_test, share_all, max_dev')} FROM e"""


@query("split_report", sql(REPORT_SQL.format(t="docs_splits")))
def _(spark, sf):
    return rounded(S.split_report(docs_splits(spark, sf)), "share_train", "share_test", "share_all", "max_dev")


@query("freeze", sql("SELECT seed::INT AS seed, id, y, split FROM docs_splits"))
def _(spark, sf):
    return S.freeze(docs_splits(spark, sf), new_path(spark, "splits"))


INNER = dict(
    in_cnt="SELECT seed, y AS stratum, count(*) AS n FROM docs_splits WHERE split = 'train' GROUP BY ALL",
    in_quota=quota_sql("in_cnt", by="seed"),
    docs_inner="""SELECT seed, id, y, n_chars, spaces, word_len, CASE WHEN rn <= k THEN 'valid' ELSE 'fit' END AS split FROM (
        SELECT t.*, q.k, row_number() OVER (PARTITION BY t.seed, t.y ORDER BY md5(concat_ws('|', t.seed, 'inner', t.id)), t.id) AS rn
        FROM docs_splits t JOIN in_quota q ON q.seed = t.seed AND q.stratum = t.y WHERE t.split = 'train') u""",
)


@query("inner_holdout", sql("SELECT seed, id, y, split FROM docs_inner", **INNER))
def _(spark, sf):
    return S.inner_holdout(docs_splits(spark, sf), groups=GROUPS)


@query(
    "take_k",
    """SELECT o_orderpriority, id, key FROM (
         SELECT o_orderpriority, o_orderkey AS id, md5(concat_ws('|', 0, 'take', o_orderkey)) AS key,
                count(*) OVER (PARTITION BY o_orderpriority) // 10 AS k,
                row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', 0, 'take', o_orderkey)), o_orderkey) AS rn
         FROM orders) t WHERE rn <= k""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_orderkey").alias("id"), draw_key(F.lit(0), "take", F.col("o_orderkey")).alias("key")
    )
    quota = rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.expr("count(*) div 10").alias("k"))
    return take_k(rows, ["o_orderpriority"], quota)


@query(
    "prefix_sum",
    """SELECT o_orderkey, o_orderstatus, cents, (sum(cents) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
         ROWS UNBOUNDED PRECEDING))::BIGINT AS running
       FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) t""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    out = prefix_sum(rows, ["o_orderstatus"], None, [F.col("o_orderdate"), F.col("o_orderkey")], {"cents": "running"})
    return out.select("o_orderkey", "o_orderstatus", "cents", "running")


# --- D: train-only transforms ------------------------------------------------------


def melt_sql(t: str, feats: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT seed, y, '{f}' AS feature, {f} AS value FROM {t} WHERE split = 'train'" for f in feats)


ORD_LONG = melt_sql("ord_splits", ORDER_FEATURES)
IMPUTE = {
    "mean": "avg(value)",
    "median": "quantile_cont(value, 0.5)",
    "mode": "(array_agg(value ORDER BY n DESC, value))[1]",
}


# Averages of cents end in exact halves at fewer places, which engines round apart.
IMPUTE_PLACES = {"mean": 4, "median": 4, "mode": 4}


def impute_sql(how: str) -> str:
    src = f"({ORD_LONG})"
    if how == "mode":
        src = f"(SELECT seed, feature, round(value, 6) AS value, count(*) AS n FROM ({ORD_LONG}) m WHERE value IS NOT NULL GROUP BY ALL)"
    return f"SELECT seed, 'impute' AS transform, feature, 'fill' AS stat, {IMPUTE[how]} AS value FROM {src} l GROUP BY seed, feature"


for how_ in IMPUTE:

    @query(f"impute_{how_}", sql(f"SELECT seed, transform, feature, stat, {r('value', IMPUTE_PLACES[how_])} FROM ({impute_sql(how_)}) t"))
    def _(spark, sf, how=how_):
        train = ord_train(spark, sf, ORDER_FEATURES)
        if how == "mode":  # sums and averages repeat only once their last bits are rounded off
            train = train.withColumns({f: F.round(f, 6) for f in ORDER_FEATURES})
        return rounded(D.fit_impute(train, ORDER_FEATURES, how, groups=len(SEEDS)), "value", places=IMPUTE_PLACES[how])


SCALE = {
    "z": ("avg(value)", "stddev_pop(value)"),
    "minmax": ("min(value)", "max(value) - min(value)"),
    "robust": ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
}
SCALE_PLACES = {"z": 4, "minmax": 4, "robust": 4}


def scale_sql(how: str) -> str:
    c, s = SCALE[how]
    agg = lambda e, n: f"SELECT seed, 'scale' AS transform, feature, '{n}' AS stat, {e} AS value FROM ({ORD_LONG}) l GROUP BY seed, feature"
    return f"{agg(c, 'center')} UNION ALL {agg(s, 'scale')}"


for how_ in SCALE:

    @query(f"scale_{how_}", sql(f"SELECT seed, transform, feature, stat, {r('value', SCALE_PLACES[how_])} FROM ({scale_sql(how_)}) t"))
    def _(spark, sf, how=how_):
        out = D.fit_scale(ord_train(spark, sf, ORDER_FEATURES), ORDER_FEATURES, how, groups=len(SEEDS))
        return rounded(out, "value", places=SCALE_PLACES[how])


CATS = ["segment", "region", "priority"]
ENC = dict(
    enc_long=" UNION ALL ".join(f"SELECT seed, y, '{c}' AS feature, {c} AS level FROM ord_splits WHERE split = 'train'" for c in CATS),
    enc_lv="SELECT seed, feature, level, count(*) AS n, sum(y) AS pos FROM enc_long GROUP BY ALL",
    enc_tab="""SELECT seed, feature, level, n, pos, row_number() OVER (PARTITION BY seed, feature ORDER BY level) - 1 AS ord,
                 (sum(pos) OVER (PARTITION BY seed, feature))::DOUBLE / (sum(n) OVER (PARTITION BY seed, feature))::DOUBLE AS prior FROM enc_lv""",
)
ENC_VALUE = {
    "ordinal": ("ord::DOUBLE", "-1.0::DOUBLE"),
    "target": ("(pos + 10 * prior) / (n + 10)", "max(prior)"),
    "onehot": ("1.0::DOUBLE", "0.0::DOUBLE"),
}

for how_ in ENC_VALUE:

    @query(
        f"encode_{how_}",
        sql(
            f"""SELECT seed, feature, level, n, {r('value')} FROM (
                SELECT seed, feature, level, n, {ENC_VALUE[how_][0]} AS value FROM enc_tab UNION ALL
                SELECT seed, feature, NULL, 0, {ENC_VALUE[how_][1]} FROM enc_tab GROUP BY seed, feature) t""",
            **ENC,
        ),
    )
    def _(spark, sf, how=how_):
        return rounded(D.fit_encode(ord_train(spark, sf, CATS), CATS, how, groups=len(SEEDS)), "value")


@query(
    "apply_encode",
    sql(
        f"""SELECT s.seed, s.id, s.source, coalesce(t.n, 0) AS n_seen, round(coalesce((t.pos + 10 * p.prior) / (t.n + 10), p.prior), 6) + 0.0 AS source_code
            FROM docs_splits s
            LEFT JOIN (SELECT seed, source, count(*) AS n, sum(y) AS pos FROM docs_splits WHERE split = 'train' AND lang <> 'en' GROUP BY ALL) t
              ON t.seed = s.seed AND t.source = s.source
            JOIN (SELECT seed, sum(y)::DOUBLE / count(*) AS prior FROM docs_splits WHERE split = 'train' AND lang <> 'en' GROUP BY ALL) p ON p.seed = s.seed
            WHERE s.split = 'test'"""
    ),
)
def _(spark, sf):
    # Fitted on part of the languages, so that test rows do meet unseen levels.
    train, test = sides(docs_splits(spark, sf, ["lang", "source"]))
    codes = D.fit_encode(train.filter(F.col("lang") != "en"), ["source"], "target", groups=len(SEEDS))
    coded = D.apply_encode(test, codes, ["source"])
    seen = codes.filter("n > 0").select("seed", F.col("level").alias("source"), "n")
    out = coded.join(seen, ["seed", "source"], "left")
    return rounded(out.select("seed", "id", "source", F.coalesce("n", F.lit(0)).alias("n_seen"), "source_code"), "source_code")


@query(
    "one_hot",
    sql(
        """SELECT seed, id, (lang = 'de')::INT AS lang_de, (lang = 'en')::INT AS lang_en, (lang = 'fr')::INT AS lang_fr,
                  (lang NOT IN ('de', 'en', 'fr'))::INT AS lang_other FROM docs_splits WHERE split = 'test'"""
    ),
)
def _(spark, sf):
    train, test = sides(docs_splits(spark, sf, ["lang"]))
    levels = ["de", "en", "fr"]
    codes = D.fit_encode(train, ["lang"], "onehot")
    out = D.one_hot(test, codes, "lang", levels)
    return out.select("seed", "id", *[f"lang_{v}" for v in levels], "lang_other")


F4 = [*DOC_FEATURES, "digit_share"]
SELECT = {
    "variance": "var_pop(value)",
    "pearson": "abs(corr(value, y))",
    "anova": """(count(*) FILTER (y = 1) * (avg(value) FILTER (y = 1) - avg(value)) ** 2
                 + count(*) FILTER (y = 0) * (avg(value) FILTER (y = 0) - avg(value)) ** 2) * (count(*) - 2)
                / (count(*) FILTER (y = 1) * var_pop(value) FILTER (y = 1) + count(*) FILTER (y = 0) * var_pop(value) FILTER (y = 0))""",
}

for how_ in SELECT:

    @query(
        f"select_{how_}",
        sql(
            f"""WITH s AS (SELECT seed, feature, {SELECT[how_]} AS value FROM ({melt_sql('docs_splits', F4)}) l GROUP BY seed, feature),
                 k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(value, 9) DESC, feature) AS rank FROM s)
            SELECT seed, 'select' AS transform, feature, 'score' AS stat, {r('value', 4)}, rank FROM k WHERE rank <= 2"""
        ),
    )
    def _(spark, sf, how=how_):
        out = D.fit_select(docs_train(spark, sf, F4), F4, 2, how)
        return longs(rounded(out, "value", places=4), "rank")


@query(
    "apply_params",
    sql(
        f"""WITH f AS (SELECT seed, {', '.join(f'avg({x}) AS f_{x}' for x in ORDER_FEATURES)} FROM ord_splits WHERE split = 'train' GROUP BY 1),
             g AS (SELECT s.seed, s.id, s.split, {', '.join(f'coalesce({x}, f_{x}) AS {x}, ({x} IS NULL)::INT AS {x}_missing' for x in ORDER_FEATURES)}
                   FROM ord_splits s JOIN f ON f.seed = s.seed),
             z AS (SELECT seed, {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in ORDER_FEATURES)} FROM g WHERE split = 'train' GROUP BY 1)
        SELECT g.seed, g.id, {', '.join(f'CASE WHEN s_{x} = 0 THEN 0 ELSE round(({x} - m_{x}) / s_{x}, 4) + 0.0 END AS {x}, {x}_missing' for x in ORDER_FEATURES)}
        FROM g JOIN z ON z.seed = g.seed WHERE g.split = 'test'"""
    ),
)
def _(spark, sf):
    train, test = sides(ord_splits(spark, sf, ORDER_FEATURES))
    n = len(SEEDS)
    fill = D.fit_impute(train, ORDER_FEATURES, "mean", groups=n)
    flags = [f"{f}_missing" for f in ORDER_FEATURES]
    filled = D.apply_params(train, fill, ORDER_FEATURES, groups=n).drop(*flags)
    scale = D.fit_scale(filled, ORDER_FEATURES, "z", groups=n)
    out = D.apply_params(test, fill.unionByName(scale), ORDER_FEATURES, groups=n)
    return rounded(out.select("seed", "id", *ORDER_FEATURES, *flags), *ORDER_FEATURES, places=4)


def selected_ctes(p: str, source: str, k: int) -> dict[str, str]:
    """`p_splits`: rows of `source` in which all but the k best features of a seed are null."""
    keep = ", ".join(f"bool_or(feature = '{f}') AS k_{f}" for f in F4)
    return {
        f"{p}_score": f"SELECT seed, feature, abs(corr(value, y)) AS value FROM ({melt_sql(source, F4)}) l GROUP BY seed, feature",
        f"{p}_sel": f"""SELECT seed, {keep} FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(value, 9) DESC, feature) AS rank
                        FROM {p}_score) t WHERE rank <= {k} GROUP BY seed""",
        f"{p}_splits": f"""SELECT s.seed, s.id, s.y, s.split, {', '.join(f'CASE WHEN k_{f} THEN {f} END AS {f}' for f in F4)}
                           FROM {source} s JOIN {p}_sel USING (seed)""",
    }


@query(
    "apply_select",
    sql(f"SELECT seed, id, split, {r(', '.join(F4))} FROM two_splits", **selected_ctes("two", "docs_splits", 2)),
)
def _(spark, sf):
    splits = docs_splits(spark, sf, F4)
    out = D.apply_select(splits, D.fit_select(sides(splits)[0], F4, 2), F4, groups=len(SEEDS))
    return rounded(out.select("seed", "id", "split", *F4), *F4)


THRESHOLDS = [-2.0, -1.0, 0.0, 1.0, 2.0]
TUNE = dict(
    **INNER,
    **{"in_splits": "SELECT seed, id, y, n_chars, spaces, word_len, CASE split WHEN 'fit' THEN 'train' ELSE 'test' END AS split FROM docs_inner"},
    **train_ctes("in", DOC_FEATURES),
    **gnb_ctes("in", DOC_FEATURES, "docs"),
)


@query(
    "tune",
    sql(
        f"""WITH g AS (SELECT p.*, t.threshold::DOUBLE AS threshold FROM in_pred p, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) t(threshold)),
             c AS (SELECT experiment, model, strategy, seed, threshold, count(*) FILTER (y = 1 AND score > threshold) AS tp,
                     count(*) FILTER (y = 0 AND score > threshold) AS fp, count(*) FILTER (y = 1 AND NOT score > threshold) AS fn
                   FROM g GROUP BY ALL),
             v AS (SELECT *, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS value FROM c),
             k AS (SELECT *, row_number() OVER (PARTITION BY experiment, model, strategy, seed ORDER BY round(value, 9) DESC, threshold) AS rk FROM v)
        SELECT experiment, model, strategy, seed, threshold, {r('value')} FROM k WHERE rk = 1""",
        **TUNE,
    ),
)
def _(spark, sf):
    fit, valid = inner_sides(spark, sf, DOC_FEATURES)
    params = M.fit_gnb_copies(B.even_copies(fit, GROUPS), DOC_FEATURES, groups=GROUPS)
    scored = M.score_gnb(valid, params, DOC_FEATURES, "docs", groups=GROUPS)
    return rounded(D.tune(scored, THRESHOLDS), "value")


def inner_sides(spark: SparkSession, sf: str, features) -> tuple[DataFrame, DataFrame]:
    inner = S.inner_holdout(docs_splits(spark, sf, features), groups=GROUPS)
    return tuple(inner.filter(F.col("split") == side).drop("split") for side in ("fit", "valid"))


COUNTS = (1, 2, 3)
TUNE_K: dict[str, str] = {
    **INNER,
    "ik_splits": """SELECT i.seed, i.id, i.y, n_chars, spaces, word_len, digit_share, CASE i.split WHEN 'fit' THEN 'train' ELSE 'test' END AS split
                    FROM docs_inner i JOIN (SELECT DISTINCT id, digit_share FROM docs) USING (id)""",
}
for k_ in COUNTS:
    TUNE_K |= {**selected_ctes(f"k{k_}", "ik_splits", k_), **train_ctes(f"k{k_}", F4), **gnb_ctes(f"k{k_}", F4, "docs"), **metric_ctes(f"k{k_}")}


@query(
    "tune_features",
    sql(
        f"""WITH v AS ({' UNION ALL '.join(f"SELECT experiment, model, strategy, seed, {k} AS k, value FROM k{k}_metrics WHERE metric = 'f1'" for k in COUNTS)}),
             b AS (SELECT *, row_number() OVER (PARTITION BY experiment, model, strategy, seed ORDER BY round(value, 9) DESC, k) AS rk FROM v)
        SELECT experiment, model, strategy, seed, k, {r('value')} FROM b WHERE rk = 1""",
        **TUNE_K,
    ),
)
def _(spark, sf):
    # How many features to keep, chosen on inner validation rows; selected anew on inner fit rows.
    fit, valid = inner_sides(spark, sf, F4)
    ranked = settle(D.fit_select(fit, F4, max(COUNTS)), max(COUNTS) * len(SEEDS))
    copies = B.even_copies(fit, GROUPS)

    def with_best(k: int) -> DataFrame:
        best = ranked.filter(F.col("rank") <= k)
        params = M.fit_gnb_copies(D.apply_select(copies, best, F4, groups=len(SEEDS)), F4, groups=GROUPS)
        rows = D.apply_select(valid, best, F4, groups=len(SEEDS))
        return M.score_gnb(rows, params, F4, "docs", groups=GROUPS).withColumn("k", F.lit(k))

    return rounded(D.best_setting(reduce(DataFrame.unionByName, [with_best(k) for k in COUNTS]), "k"), "value")


PENALTIES = (0.0001, 0.01, 0.1, 1.0)
TUNE_PENALTY: dict[str, str] = {
    **INNER,
    "tp_splits": "SELECT seed, id, y, n_chars, spaces, word_len, CASE split WHEN 'fit' THEN 'train' ELSE 'test' END AS split FROM docs_inner",
    "tp_rows": "SELECT * FROM tp_splits WHERE split = 'test'",
    **train_ctes("tp", DOC_FEATURES),
    **logistic_ctes("tp", DOC_FEATURES, "docs", "tp_copies", "tp_rows", list(PENALTIES)),
}


@query(
    "tune_penalty",
    sql(
        f"""WITH c AS (SELECT experiment, model, strategy, seed, penalty, count(*) FILTER (y = 1 AND y_pred = 1) AS tp,
                     count(*) FILTER (y = 0 AND y_pred = 1) AS fp, count(*) FILTER (y = 1 AND y_pred = 0) AS fn
                   FROM tp_pred GROUP BY ALL),
             v AS (SELECT *, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS value FROM c),
             k AS (SELECT *, row_number() OVER (PARTITION BY experiment, model, strategy, seed ORDER BY round(value, 9) DESC, penalty) AS rk FROM v)
        SELECT experiment, model, strategy, seed, penalty, {r('value')} FROM k WHERE rk = 1""",
        **TUNE_PENALTY,
    ),
)
def _(spark, sf):
    # The penalty of the regression, chosen on inner validation rows; all values in one fit.
    fit, valid = inner_sides(spark, sf, DOC_FEATURES)
    params = fit_logistic(B.even_copies(fit, GROUPS), DOC_FEATURES, GROUPS, PENALTIES)
    scored = score_logistic(valid, params, DOC_FEATURES, "docs", GROUPS * len(PENALTIES), keep=["penalty"])
    return rounded(D.best_setting(scored, "penalty"), "value")


# --- a preserved run ---------------------------------------------------------------

RUN_K = 3
RUN = dict(
    pf_fill=f"SELECT seed, {', '.join(f'avg({f}) AS f_{f}' for f in F4)} FROM docs_splits WHERE split = 'train' GROUP BY 1",
    pf_rows=f"SELECT s.seed, id, y, split, {', '.join(f'coalesce({f}, f_{f}) AS {f}' for f in F4)} FROM docs_splits s JOIN pf_fill USING (seed)",
    pf_z=f"SELECT seed, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in F4)} FROM pf_rows WHERE split = 'train' GROUP BY 1",
    pf_scaled=f"""SELECT seed, id, y, split, {', '.join(f'CASE WHEN s_{f} = 0 THEN 0 ELSE ({f} - m_{f}) / s_{f} END AS {f}' for f in F4)}
                  FROM pf_rows JOIN pf_z USING (seed)""",
    **selected_ctes("pr", "pf_scaled", RUN_K),
    **train_ctes("pr", F4),
    **gnb_ctes("pr", F4, "docs"),
    **metric_ctes("pr"),
)


def docs_run(spark: SparkSession, sf: str) -> Run:
    inputs = {t: table(spark, sf, t) for t in ("documents", "labels")}
    return evaluate_run(docs(spark, sf), F4, "docs", new_path(spark, "run"), RUN_K, inputs=inputs)


@query("evaluate_run", sql(f"SELECT experiment, model, strategy, seed, metric, {r('value')} FROM pr_metrics", **RUN))
def _(spark, sf):
    return rounded(docs_run(spark, sf).metrics, "value")


@query(
    "audit_run",
    "SELECT unnest(['overlap', 'complete', 'test', 'balance', 'params', 'order', 'shares']) AS \"check\", 0::BIGINT AS n_violations",
)
def _(spark, sf):
    return audit_summary(docs_run(spark, sf))


@query(
    "trace_run",
    sql(
        """SELECT concat_ws(':', experiment, model, strategy, seed, metric) AS claim_id, metric, strategy, experiment,
                  'frac=0.2;impute=mean;scale=z;select=pearson:3' AS config, 'repeated_holdout' AS script, 'table ' || metric AS figure
           FROM pr_metrics""",
        **RUN,
    ),
)
def _(spark, sf):
    run = docs_run(spark, sf)
    return L.trace(run.claims, run.provenance, run.manifest).drop("result_id", "input_fp")


# --- E: balancing ------------------------------------------------------------------


@query("balance_none", sql("SELECT seed, strategy, id, y, copy_no FROM docs_train WHERE strategy = 'unbalanced'"))
def _(spark, sf):
    out = B.balance(docs_train(spark, sf), "none")
    return longs(out.select("seed", "strategy", "id", "y", "copy_no"), "copy_no")


@query("balance_even", sql("SELECT seed, strategy, id, y, copy_no FROM docs_train WHERE strategy = 'oversampled'"))
def _(spark, sf):
    out = B.balance(docs_train(spark, sf), "even", GROUPS)
    return longs(out.select("seed", "strategy", "id", "y", "copy_no"), "copy_no")


@query(
    "balance_replace",
    sql(
        """WITH ix AS (SELECT t.seed, t.y, t.id, s.n, row_number() OVER (PARTITION BY t.seed, t.y ORDER BY md5(concat_ws('|', t.seed, 'ix', t.id)), t.id) - 1 AS i
                       FROM docs_splits t JOIN docs_sizes s ON s.seed = t.seed AND s.y = t.y WHERE t.split = 'train'),
                d AS (SELECT seed, y, n, unnest(range(1::BIGINT, n_max - n + 1)) AS draw FROM docs_sizes),
                e AS (SELECT seed, y, draw, ('0x' || substr(md5(concat_ws('|', seed, 'draw', y, draw)), 1, 15))::BIGINT % n AS i FROM d)
           SELECT seed, 'replacement' AS strategy, id, y, 0::BIGINT AS copy_no FROM docs_splits WHERE split = 'train'
           UNION ALL
           SELECT e.seed, 'replacement', ix.id, e.y, row_number() OVER (PARTITION BY e.seed, e.y, e.i ORDER BY e.draw)
           FROM e JOIN ix ON ix.seed = e.seed AND ix.y = e.y AND ix.i = e.i"""
    ),
)
def _(spark, sf):
    out = B.balance(docs_train(spark, sf), "replace", GROUPS)
    return longs(out.select("seed", "strategy", "id", "y", "copy_no"), "copy_no")


@query(
    "balance_weight",
    sql(
        """SELECT t.seed, 'weighted' AS strategy, t.id, t.y, round(s.n_max::DOUBLE / s.n, 6) + 0.0 AS weight
           FROM docs_splits t JOIN docs_sizes s ON s.seed = t.seed AND s.y = t.y WHERE t.split = 'train'"""
    ),
)
def _(spark, sf):
    out = B.balance(docs_train(spark, sf), "weight", GROUPS)
    return rounded(out.select("seed", "strategy", "id", "y", "weight"), "weight")


SYN = {f: f"round(k.{f} + (x.{f} - k.{f}) * k.u, 4) + 0.0 AS {f}" for f in DOC_FEATURES}


@query(
    "balance_interpolated",
    sql(
        f"""WITH ix AS (SELECT t.seed, t.y, {', '.join('t.' + f for f in DOC_FEATURES)}, s.n,
                              row_number() OVER (PARTITION BY t.seed, t.y ORDER BY md5(concat_ws('|', t.seed, 'ix', t.id)), t.id) - 1 AS i
                       FROM docs_splits t JOIN docs_sizes s ON s.seed = t.seed AND s.y = t.y WHERE t.split = 'train'),
                m AS (SELECT *, unnest(range(1::BIGINT, copies::BIGINT)) AS copy_no FROM docs_copies),
                k AS (SELECT m.*, ('0x' || substr(md5(concat_ws('|', m.seed, 'syn', id, copy_no)), 1, 15))::BIGINT % s.n AS i,
                             ('0x' || substr(md5(concat_ws('|', m.seed, 'step', id, copy_no)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
                      FROM m JOIN docs_sizes s ON s.seed = m.seed AND s.y = m.y WHERE s.n < s.n_max)
           SELECT seed, 'interpolated' AS strategy, id, y, 0::BIGINT AS copy_no, false AS synthetic, {', '.join(f'round({f}::DOUBLE, 4) + 0.0 AS {f}' for f in DOC_FEATURES)}
           FROM docs_splits WHERE split = 'train'
           UNION ALL
           SELECT k.seed, 'interpolated', k.id, k.y, copy_no, true, {', '.join(SYN.values())}
           FROM k JOIN ix x ON x.seed = k.seed AND x.y = k.y AND x.i = k.i"""
    ),
)
def _(spark, sf):
    out = B.balance(docs_train(spark, sf, DOC_FEATURES), "interpolated", GROUPS, DOC_FEATURES)
    return rounded(longs(out.select("seed", "strategy", "id", "y", "copy_no", "synthetic", *DOC_FEATURES), "copy_no"), *DOC_FEATURES, places=4)


def neighbour_sql(p: str, features: list[str], places: int = 4, k: int = 5) -> str:
    """All pairs of a class by distance and id; the k first are neighbours."""
    gaps = " + ".join("(coalesce(a.{0}, 0) - coalesce(b.{0}, 0)) * (coalesce(a.{0}, 0) - coalesce(b.{0}, 0))".format(f) for f in features)
    moved = ", ".join(f"round(m.{f} + (x.{f} - m.{f}) * m.u, {places}) + 0.0 AS {f}" for f in features)
    return f"""
      WITH t AS (SELECT t.seed, t.y, t.id, {', '.join('t.' + f for f in features)} FROM {p}_splits t
                 JOIN {p}_sizes s ON s.seed = t.seed AND s.y = t.y WHERE t.split = 'train' AND s.n < s.n_max),
      near AS (SELECT a.seed, a.y, a.id, b.id AS other, row_number() OVER (PARTITION BY a.seed, a.y, a.id ORDER BY {gaps}, b.id) AS nth
               FROM t a JOIN t b ON a.seed = b.seed AND a.y = b.y AND a.id <> b.id QUALIFY nth <= {k}),
      n AS (SELECT seed, y, id, count(*) AS n FROM near GROUP BY ALL),
      c AS (SELECT c.*, unnest(range(1::BIGINT, copies::BIGINT)) AS copy_no FROM {p}_copies c),
      m AS (SELECT c.*, 1 + ('0x' || substr(md5(concat_ws('|', c.seed, 'syn', c.id, copy_no)), 1, 15))::BIGINT % n.n AS nth,
                   ('0x' || substr(md5(concat_ws('|', c.seed, 'step', c.id, copy_no)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
            FROM c JOIN n ON n.seed = c.seed AND n.y = c.y AND n.id = c.id)
      SELECT seed, 'synthetic' AS strategy, id, y, 0::BIGINT AS copy_no, false AS synthetic, {', '.join(f'round({f}::DOUBLE, {places}) + 0.0 AS {f}' for f in features)}
      FROM {p}_splits WHERE split = 'train'
      UNION ALL
      SELECT m.seed, 'synthetic', m.id, m.y, copy_no, true, {moved}
      FROM m JOIN near ON near.seed = m.seed AND near.y = m.y AND near.id = m.id AND near.nth = m.nth
      JOIN t x ON x.seed = m.seed AND x.y = m.y AND x.id = near.other"""


@query("balance_synthetic", sql(neighbour_sql("docs", DOC_FEATURES)))
def _(spark, sf):
    out = B.balance(docs_train(spark, sf, DOC_FEATURES), "synthetic", GROUPS, DOC_FEATURES)
    return rounded(longs(out.select("seed", "strategy", "id", "y", "copy_no", "synthetic", *DOC_FEATURES), "copy_no"), *DOC_FEATURES, places=4)


@query("balance_synthetic_orders", sql(neighbour_sql("ord", ORDER_FEATURES, 6)))
def _(spark, sf):
    out = B.balance(ord_train(spark, sf, ORDER_FEATURES), "synthetic", GROUPS, ORDER_FEATURES)
    return rounded(longs(out.select("seed", "strategy", "id", "y", "copy_no", "synthetic", *ORDER_FEATURES), "copy_no"), *ORDER_FEATURES)


@query(
    "balance_report",
    sql(
        """SELECT a.seed, a.strategy, a.side, a.y, a.n_before,
                  CASE WHEN a.side = 'test' THEN a.n_before ELSE coalesce(b.n_after, 0) END AS n_after
           FROM (SELECT seed, split AS side, y, count(*) AS n_before, s.strategy FROM docs_splits,
                   (VALUES ('unbalanced'), ('oversampled')) s(strategy) GROUP BY ALL) a
           LEFT JOIN (SELECT seed, strategy, y, count(*) AS n_after FROM docs_train GROUP BY ALL) b
             ON b.seed = a.seed AND b.strategy = a.strategy AND b.y = a.y"""
    ),
)
def _(spark, sf):
    splits = docs_splits(spark, sf)
    return B.balance_report(splits, B.unbalanced_and_even(sides(splits)[0], GROUPS), STRATEGIES)


# --- M: models ---------------------------------------------------------------------

MAJORITY = dict(
    maj_fit="""SELECT seed, strategy, sum(y)::DOUBLE / count(*) AS prevalence, (2 * sum(y) > count(*))::INT AS label
               FROM docs_train GROUP BY ALL""",
    maj_pred="""SELECT 'docs' AS experiment, 'majority' AS model, f.strategy, t.seed, t.id, t.y, f.prevalence AS score, f.label AS y_pred
                FROM docs_splits t JOIN maj_fit f ON f.seed = t.seed WHERE t.split = 'test'""",
    **metric_ctes("maj"),
)


def majority_pred(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sides(docs_splits(spark, sf))
    params = M.fit_majority(B.unbalanced_and_even(train, GROUPS), GROUPS)
    return M.score_majority(test, params, "docs", GROUPS)


@query("majority", sql(f"SELECT experiment, model, strategy, seed, id, y, {r('score')}, y_pred FROM maj_pred", **MAJORITY))
def _(spark, sf):
    return rounded(majority_pred(spark, sf), "score")


def gnb_long_sql() -> str:
    items = [(f, s) for f in DOC_FEATURES for s in ("m0", "v0", "m1", "v1")]
    parts = " UNION ALL ".join(
        f"SELECT seed, strategy, 'gnb' AS transform, '{f}' AS feature, '{s}' AS stat, {s}_{f} AS value FROM docs_fit" for f, s in items
    )
    return sql(f"SELECT seed, strategy, transform, feature, stat, {r('value', 2)} FROM ({parts}) t")


@query("gnb_fit", gnb_long_sql())
def _(spark, sf):
    train_set = B.unbalanced_and_even(docs_train(spark, sf, DOC_FEATURES), GROUPS)
    params = M.fit_gnb(train_set, DOC_FEATURES, groups=GROUPS)
    return rounded(M.gnb_params_long(params, DOC_FEATURES), "value", places=2)


@query("gnb_predict", sql(f"SELECT experiment, model, strategy, seed, id, y, {r('score', 4)}, y_pred FROM docs_pred"))
def _(spark, sf):
    return rounded(docs_pred(spark, sf), "score", places=4)


@query(
    "predict_threshold",
    sql(f"SELECT experiment, model, strategy, seed, id, y, {r('score', 4)}, (score > 1.5)::INT AS y_pred FROM docs_pred"),
)
def _(spark, sf):
    return rounded(M.predict(docs_pred(spark, sf), 1.5), "score", places=4)


@query("library_models")
def _(spark, sf):
    sided = S.freeze(ord_splits(spark, sf, ORDER_FEATURES), new_path(spark, "splits"))
    train, test = sides(sided)
    train_set = B.unbalanced_and_even(train, GROUPS)
    pred = M.evaluate_ml(["logistic", "forest", "boosted"], train_set, test, SEEDS, STRATEGIES, ORDER_FEATURES, "orders")
    return rounded(G.evaluate(pred), "value")


# Logistic regression of all seeds and strategies in one fit.
PENALTY = 0.001
LOGISTIC = {
    "lr_rows": "SELECT * FROM docs_splits WHERE split = 'test'",
    **logistic_ctes("lr", DOC_FEATURES, "docs", "docs_copies", "lr_rows", [PENALTY]),
    **metric_ctes("lr"),
}


def docs_logistic(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, test = sides(docs_splits(spark, sf, DOC_FEATURES))
    return fit_logistic(B.even_copies(train, GROUPS), DOC_FEATURES, GROUPS, [PENALTY]), test


@query("fit_logistic", sql("SELECT seed, strategy, penalty, feature, round(coef, 5) + 0.0 AS coef FROM lr_coef", **LOGISTIC))
def _(spark, sf):
    return rounded(coefficients(docs_logistic(spark, sf)[0], DOC_FEATURES), "coef", places=5)


@query("evaluate_logistic", sql(f"SELECT experiment, model, strategy, seed, metric, {r('value')} FROM lr_metrics", **LOGISTIC))
def _(spark, sf):
    params, test = docs_logistic(spark, sf)
    return rounded(G.evaluate(score_logistic(test, params, DOC_FEATURES, "docs", GROUPS)), "value")


@query("save_parameters", sql("SELECT experiment, model, strategy, seed, tp, fp, fn, tn FROM lr_conf", **LOGISTIC))
def _(spark, sf):
    params, test = docs_logistic(spark, sf)
    meta = {"experiment": "docs", "model": "logistic", "config": "frac=0.2", "preprocessing": "mean fill and scale, fitted on training rows"}
    path = new_path(spark, "parameters")
    sinks.save_parameters(params, meta, path)
    back = sinks.load_parameters(spark, path, "docs", "logistic", params.schema)
    return longs(G.confusion(score_logistic(test, back, DOC_FEATURES, "docs", GROUPS)), "tp", "fp", "fn", "tn")


@query(
    "compare_models",
    sql(
        f"""SELECT g.experiment, g.model, g.strategy, g.seed, g.metric, round(g.value, 6) + 0.0 AS value,
               round(m.value, 6) + 0.0 AS base_value, round(g.value - m.value, 6) + 0.0 AS diff
        FROM docs_metrics g JOIN maj_metrics m ON m.strategy = g.strategy AND m.seed = g.seed AND m.metric = g.metric""",
        **MAJORITY,
    ),
)
def _(spark, sf):
    both = docs_pred(spark, sf).unionByName(majority_pred(spark, sf))
    return rounded(M.compare_models(G.evaluate(both), "majority"), "value", "base_value", "diff")


# --- G: metrics --------------------------------------------------------------------


@query("confusion", sql("SELECT * FROM docs_conf"))
def _(spark, sf):
    return G.confusion(docs_pred(spark, sf))


@query("point_metrics", sql(f"SELECT experiment, model, strategy, seed, metric, {r('value')} FROM docs_metrics WHERE metric <> 'roc_auc'"))
def _(spark, sf):
    return rounded(G.point_metrics(G.confusion(docs_pred(spark, sf))), "value")


@query("roc_auc", sql("SELECT experiment, model, strategy, seed, round(value, 6) + 0.0 AS roc_auc FROM docs_auc"))
def _(spark, sf):
    return rounded(G.roc_auc(docs_pred(spark, sf)), "roc_auc")


@query("roc_auc_orders", sql("SELECT experiment, model, strategy, seed, round(value, 6) + 0.0 AS roc_auc FROM ord_auc"))
def _(spark, sf):
    return rounded(G.roc_auc(ord_pred(spark, sf)), "roc_auc")


@query("roc_points", sql(ROC_SQL.format(p="docs")))
def _(spark, sf):
    return rounded(rounded(G.roc_points(docs_pred(spark, sf)), "score", places=4), "fpr", "tpr")


@query("evaluate_orders", sql(f"SELECT experiment, model, strategy, seed, metric, {r('value')} FROM ord_metrics"))
def _(spark, sf):
    return rounded(G.evaluate(ord_pred(spark, sf)), "value")


# --- H: stability ------------------------------------------------------------------


@query("summary", sql(f"SELECT experiment, model, strategy, metric, n_seeds, {r('mean, sd, min, max')} FROM docs_summary"))
def _(spark, sf):
    return rounded(H.summarize(docs_metrics(spark, sf)), "mean", "sd", "min", "max")


@query("summary_orders", sql(f"SELECT experiment, model, strategy, metric, n_seeds, {r('mean, sd, min, max')} FROM ord_summary"))
def _(spark, sf):
    return rounded(H.summarize(G.evaluate(ord_pred(spark, sf))), "mean", "sd", "min", "max")


@query(
    "variation",
    sql(
        f"""SELECT experiment, model, strategy, metric, {r('min, q1, median, q3, max, range, cv')} FROM (
            SELECT experiment, model, strategy, metric, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                   quantile_cont(value, 0.75) AS q3, max(value) AS max, max(value) - min(value) AS range,
                   stddev_samp(value) / nullif(avg(value), 0) AS cv FROM docs_metrics GROUP BY ALL) t"""
    ),
)
def _(spark, sf):
    return rounded(H.variation(docs_metrics(spark, sf)), "min", "q1", "median", "q3", "max", "range", "cv")


@query("paired", sql(f"SELECT experiment, model, metric, seed, {r('a, b, diff')} FROM docs_paired"))
def _(spark, sf):
    return rounded(docs_pairs(spark, sf), "a", "b", "diff")


@query(
    "consistency",
    sql(
        """WITH s AS (SELECT experiment, model, metric, count(*) AS n_seeds, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties,
                        count(*) FILTER (d < 0) AS losses, sign(round(avg(diff), 12))::INT AS mean_sign FROM docs_d GROUP BY ALL)
           SELECT *, round((CASE mean_sign WHEN 1 THEN wins WHEN -1 THEN losses ELSE ties END)::DOUBLE / n_seeds, 6) + 0.0 AS agree_share FROM s"""
    ),
)
def _(spark, sf):
    return rounded(H.consistency(docs_pairs(spark, sf)), "agree_share")


@query(
    "flip_rate",
    sql(
        f"""SELECT experiment, model, strategy, id, n_tested, n_pos::BIGINT AS n_pos,
              round(least(n_pos, n_tested - n_pos)::DOUBLE / n_tested, 6) + 0.0 AS flip_rate
            FROM (SELECT experiment, model, strategy, id, count(*) AS n_tested, sum(y_pred) AS n_pos FROM docs_pred GROUP BY ALL) t"""
    ),
)
def _(spark, sf):
    return rounded(H.flip_rate(docs_pred(spark, sf)), "flip_rate")


@query(
    "seed_reuse",
    sql(
        """SELECT a.seed AS seed_a, b.seed AS seed_b, count(*) AS n_shared, max(n.n) AS n_test_a, round(count(*)::DOUBLE / max(n.n), 6) + 0.0 AS shared_share
           FROM ord_splits a JOIN ord_splits b ON a.id = b.id AND a.seed < b.seed
           JOIN (SELECT seed, count(*) AS n FROM ord_splits WHERE split = 'test' GROUP BY 1) n ON n.seed = a.seed
           WHERE a.split = 'test' AND b.split = 'test' GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    return rounded(H.reuse(ord_splits(spark, sf)), "shared_share")


@query(
    "leave_one_seed",
    sql(
        f"""SELECT experiment, model, strategy, metric, {r('min_mean, max_mean, range')} FROM (
            SELECT experiment, model, strategy, metric, min(m) AS min_mean, max(m) AS max_mean, max(m) - min(m) AS range FROM (
              SELECT a.experiment, a.model, a.strategy, a.metric, a.seed, avg(b.value) AS m
              FROM docs_metrics a JOIN docs_metrics b ON a.experiment = b.experiment AND a.model = b.model AND a.strategy = b.strategy
                AND a.metric = b.metric AND a.seed <> b.seed GROUP BY ALL) t GROUP BY ALL) u"""
    ),
)
def _(spark, sf):
    return rounded(H.leave_one_seed(docs_metrics(spark, sf)), "min_mean", "max_mean", "range")


# --- I: paired statistics ----------------------------------------------------------


def tests_sql(where: str) -> str:
    return sql(f"SELECT experiment, model, metric, test, n, {r('statistic, p_value')} FROM docs_tests WHERE {where}")


@query("paired_t", tests_sql("test = 'paired_t'"))
def _(spark, sf):
    return rounded(I.paired_t(docs_pairs(spark, sf)), "statistic", "p_value")


@query("wilcoxon", tests_sql("test = 'wilcoxon'"))
def _(spark, sf):
    return rounded(I.wilcoxon(docs_pairs(spark, sf)), "statistic", "p_value")


@query("corrected_t", tests_sql("test = 'corrected_t'"))
def _(spark, sf):
    sizes = I.split_sizes(docs_splits(spark, sf), "docs")
    return rounded(I.corrected_t(docs_pairs(spark, sf), sizes), "statistic", "p_value")


@query(
    "verdict",
    sql(
        f"""SELECT t.experiment, t.model, t.metric, t.test, round(p_value, 6) + 0.0 AS p_value, round(m.mean_diff, 6) + 0.0 AS mean_diff,
              CASE sign(round(m.mean_diff, 12)) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'none' END AS direction,
              CASE WHEN p_value < 0.05 THEN 'difference supported' ELSE 'no supported difference' END AS verdict
            FROM docs_tests t JOIN (SELECT experiment, model, metric, avg(diff) AS mean_diff FROM docs_paired GROUP BY ALL) m
              USING (experiment, model, metric)"""
    ),
)
def _(spark, sf):
    sizes = I.split_sizes(docs_splits(spark, sf), "docs")
    pairs = docs_pairs(spark, sf)
    return rounded(I.verdict(docs_tests(pairs, sizes), pairs), "p_value", "mean_diff")


# --- J: fairness -------------------------------------------------------------------


@query("subgroups", sql("SELECT * FROM docs_sub"))
def _(spark, sf):
    return docs_sub(spark, sf)


@query("subgroups_orders", sql("SELECT * FROM ord_sub"))
def _(spark, sf):
    return J.subgroups(ord_pred(spark, sf, ["segment", "region"]), ["segment", "region"])


for measure_ in ("spd", "eod", "di"):

    @query(
        measure_,
        sql(f"SELECT experiment, model, strategy, seed, attr, grp, n, {r('prevalence')}, measure, {r('value')} FROM docs_fair WHERE measure = '{measure_}'"),
    )
    def _(spark, sf, measure=measure_):
        fn = {"spd": J.spd, "eod": J.eod, "di": J.di}[measure]
        return rounded(fn(docs_sub(spark, sf)), "prevalence", "value")


@query(
    "fairness_reference",
    sql(
        f"""WITH c AS (SELECT s.*, b.n AS bn, b.pos AS bpos, b.pred_pos AS bpp, b.tp AS btp FROM docs_sub s
               LEFT JOIN docs_sub b ON b.experiment = s.experiment AND b.model = s.model AND b.strategy = s.strategy
                 AND b.seed = s.seed AND b.attr = s.attr AND b.grp = 'en' WHERE s.attr = 'lang'),
             v AS (SELECT *, pred_pos::DOUBLE / n - bpp::DOUBLE / bn AS value FROM c)
        SELECT experiment, model, strategy, seed, attr, grp, n, round(pos::DOUBLE / n, 6) + 0.0 AS prevalence, 'spd' AS measure, {r('value')} FROM v"""
    ),
)
def _(spark, sf):
    sub = J.subgroups(docs_pred(spark, sf, ["lang"]), ["lang"], reference={"lang": "en"})
    return rounded(J.spd(sub), "prevalence", "value")


@query(
    "fairness_summary",
    sql(
        f"""SELECT experiment, model, strategy, attr, grp, measure, n_seeds, {r('mean, sd, min, max')} FROM (
            SELECT experiment, model, strategy, attr, grp, measure, count(value) AS n_seeds, avg(value) AS mean,
                   stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM docs_fair GROUP BY ALL) t"""
    ),
)
def _(spark, sf):
    return rounded(J.fairness_summary(J.fairness(docs_sub(spark, sf))), "mean", "sd", "min", "max")


def wilson_sql(k: str, n: str, sign: str) -> str:
    return (
        f"CASE WHEN {n} > 0 THEN ({k} + 1.96 * 1.96 / 2 {sign} 1.96 * sqrt({n} * ({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) "
        f"+ 1.96 * 1.96 / 4))::DOUBLE / ({n} + 1.96 * 1.96)::DOUBLE END"
    )


@query(
    "subgroup_caution",
    sql(
        f"""SELECT experiment, model, strategy, seed, attr, grp, n, {r('prevalence, rate, rate_low, rate_high, tpr, tpr_low, tpr_high')}, small_group FROM (
            SELECT *, pos::DOUBLE / n AS prevalence, pred_pos::DOUBLE / n AS rate, {wilson_sql('pred_pos', 'n', '-')} AS rate_low,
                   {wilson_sql('pred_pos', 'n', '+')} AS rate_high, tp::DOUBLE / nullif(pos, 0) AS tpr, {wilson_sql('tp', 'pos', '-')} AS tpr_low,
                   {wilson_sql('tp', 'pos', '+')} AS tpr_high, n < 30 AS small_group FROM docs_sub) t"""
    ),
)
def _(spark, sf):
    cols = ["prevalence", "rate", "rate_low", "rate_high", "tpr", "tpr_low", "tpr_high"]
    return rounded(J.subgroup_caution(docs_sub(spark, sf)), *cols)


@query(
    "fairness_paired",
    sql(
        f"""SELECT a.experiment, a.model, a.attr, a.grp, a.measure, a.seed, round(a.value, 6) + 0.0 AS a, round(b.value, 6) + 0.0 AS b,
              round(b.value - a.value, 6) + 0.0 AS diff
            FROM docs_fair a JOIN docs_fair b USING (experiment, model, attr, grp, measure, seed)
            WHERE a.strategy = 'unbalanced' AND b.strategy = 'oversampled' AND a.value IS NOT NULL AND b.value IS NOT NULL"""
    ),
)
def _(spark, sf):
    return rounded(J.fairness_paired(J.fairness(docs_sub(spark, sf)), *STRATEGIES), "a", "b", "diff")


# --- K: audit ----------------------------------------------------------------------

LEAKED = "source = 'src3'"
K_CTES = dict(
    leaky_splits=f"""SELECT seed, id, y, split, source, lang FROM docs_splits
                     UNION ALL SELECT seed, id, y, 'train', source, lang FROM docs_splits WHERE split = 'test' AND {LEAKED}""",
)


def leaky_splits(spark: SparkSession, sf: str, keep=("source", "lang")) -> DataFrame:
    """Splits in which the test rows of one source were put into training as well."""
    return leaky(docs_splits(spark, sf, keep))


def leaky(good: DataFrame) -> DataFrame:
    twice = F.when((F.col("split") == "test") & F.expr(LEAKED), F.array(F.lit("test"), F.lit("train"))).otherwise(F.array("split"))
    return good.withColumn("split", F.explode(twice))


@query("audit_overlap", sql("SELECT seed, id FROM leaky_splits GROUP BY 1, 2 HAVING count(DISTINCT split) > 1", **K_CTES))
def _(spark, sf):
    return A.audit_overlap(leaky_splits(spark, sf))


def content_sql(*parts: str) -> str:
    """Each part with its length in front, `-` for null, as `content_key` writes them."""
    return " || ".join(f"coalesce(length(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-')" for p in parts)


BOTH_SQL = """SELECT seed, {c}, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test
              FROM ({src}) t GROUP BY 1, 2 HAVING count(DISTINCT split) > 1"""


@query("audit_entity", sql(BOTH_SQL.format(c="entity_id", src="SELECT s.seed, s.split, c.entity_id FROM ord_splits s JOIN orders_c c ON c.id = s.id")))
def _(spark, sf):
    # A plain row split of orders, which does put customers on both sides.
    return A.audit_entity(ord_splits(spark, sf, ["entity_id"]), orders_cohort(spark, sf))


@query(
    "audit_copies",
    sql(
        BOTH_SQL.format(
            c="content",
            src=f"""SELECT s.seed, s.split, md5({content_sql('d.text')}) AS content FROM doc_all_splits s JOIN documents d ON d.doc_id = s.id""",
        ),
        doc_all="SELECT doc_id AS id, (lang = 'en')::INT AS y FROM documents",
        **splits_ctes("doc_all", "doc_all", ""),
    ),
)
def _(spark, sf):
    text = table(spark, sf, "documents")
    cohort = text.select(F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("y"), "text")
    return A.audit_copies(S.holdout(cohort, SEEDS), cohort, ["text"])


NEAR_SQL = f"""SELECT s.seed, s.split, md5({content_sql('floor(c.n_chars / 40)::BIGINT', 'floor(c.word_len / 0.5::DOUBLE)::BIGINT', 'c.lang')}) AS content
              FROM docs_splits s JOIN docs c ON c.id = s.id"""


@query("audit_near", sql(BOTH_SQL.format(c="content", src=NEAR_SQL)))
def _(spark, sf):
    cohort = docs(spark, sf)
    return A.audit_near(S.holdout(cohort, SEEDS), cohort, {"n_chars": 40, "word_len": 0.5}, exact=["lang"])


@query(
    "audit_near_text",
    sql(
        BOTH_SQL.format(
            c="content",
            src=f"""SELECT s.seed, s.split, md5({content_sql("lower(regexp_replace(d.text, '[^\\p{L}\\p{N}]+', '', 'g'))")}) AS content
                   FROM doc_all_splits s JOIN documents d ON d.doc_id = s.id""",
        ),
        doc_all="SELECT doc_id AS id, (lang = 'en')::INT AS y FROM documents",
        **splits_ctes("doc_all", "doc_all", ""),
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("y"), "text"
    )
    return A.audit_near(S.holdout(rows, SEEDS), rows, {}, texts=["text"])


def similar_sql() -> str:
    bands, rows, words = 10, 4, 5
    least = [f"list_min([(x::HUGEINT * {a} + {b}) % {A.PRIME} FOR x IN xs])" for a, b in A.linear_hashes(bands * rows)]
    parts = [f"'{i}:' || md5(concat_ws('|', {', '.join(least[i * rows:(i + 1) * rows])}))" for i in range(bands)]
    return f"""
      WITH p AS (SELECT doc_id AS id, trim(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS plain FROM documents),
           w AS (SELECT id, string_split(plain, ' ') AS ws FROM p WHERE length(plain) > 0),
           h AS (SELECT id, [('0x' || substr(md5(array_to_string(ws[i:i + {words - 1}], ' ')), 1, 7))::BIGINT
                             FOR i IN range(1, greatest(len(ws) - {words - 1}, 1) + 1)] AS xs FROM w),
           c AS (SELECT id, unnest([{', '.join(parts)}]) AS content FROM h)
      SELECT s.seed, s.split, c.content FROM doc_all_splits s JOIN c ON c.id = s.id"""


@query(
    "audit_similar",
    sql(
        BOTH_SQL.format(c="content", src=similar_sql()),
        doc_all="SELECT doc_id AS id, (lang = 'en')::INT AS y FROM documents",
        **splits_ctes("doc_all", "doc_all", ""),
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("y"), "text"
    )
    return A.audit_similar(S.holdout(rows, SEEDS), rows, "text")


JACCARD_SQL = """
  WITH p AS (SELECT doc_id AS id, trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS plain FROM documents),
       w AS (SELECT id, string_split(plain, ' ') AS ws FROM p WHERE length(plain) > 0),
       s AS (SELECT id, list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)])) AS t FROM w),
       c AS MATERIALIZED (SELECT min(id) AS c, t, len(t) AS n FROM s GROUP BY t),
       m AS (SELECT s.id, c.c FROM s JOIN c USING (t)),
       e AS (SELECT c, n, unnest(t) AS x FROM c),
       o AS (SELECT a.c AS a, b.c AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY ALL),
       near AS (SELECT * FROM o WHERE j >= 0.8),
       side AS (SELECT seed, c, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM doc_all_splits JOIN m USING (id) GROUP BY ALL),
       k AS (SELECT seed, a, sum(n_train)::BIGINT AS n, max(j) AS j FROM near JOIN side ON b = c WHERE n_train > 0 GROUP BY ALL)
  SELECT side.seed, side.c AS first_id, n_test, n_train, coalesce(k.n, 0)::BIGINT AS n_near_train,
         round(CASE WHEN n_train > 0 THEN 1 ELSE k.j END, 6) AS similarity
  FROM side LEFT JOIN k ON k.seed = side.seed AND k.a = side.c WHERE n_test > 0 AND n_train + coalesce(k.n, 0) > 0"""


@query(
    "audit_jaccard",
    sql(JACCARD_SQL, doc_all="SELECT doc_id AS id, (lang = 'en')::INT AS y FROM documents", **splits_ctes("doc_all", "doc_all", "")),
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").cast("int").alias("y"), "text")
    known = contents_of(rows, "text")
    found = audit_jaccard(S.holdout(rows, SEEDS), rows, "text", known=known)
    first = known[0].groupBy("content").agg(F.min("id").alias("first_id"))
    return rounded(found.join(first, "content").drop("content"), "similarity")


@query(
    "audit_complete",
    sql(
        """WITH bad AS (SELECT seed, id FROM leaky_splits WHERE NOT (lang = 'fr' AND split = 'test')
                        UNION ALL SELECT seed, -id - 1 FROM docs_splits WHERE source = 'src5' AND split = 'test'),
                n AS (SELECT seed, id, count(*) AS n FROM bad GROUP BY 1, 2)
           SELECT s.seed, d.id, 'missing' AS issue FROM docs d CROSS JOIN seeds s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.seed = s.seed AND n.id = d.id)
           UNION ALL SELECT seed, id, 'repeated' FROM n WHERE n > 1
           UNION ALL SELECT seed, id, 'foreign' FROM n WHERE id NOT IN (SELECT id FROM docs)""",
        **K_CTES,
    ),
)
def _(spark, sf):
    leaked = leaky_splits(spark, sf)
    dropped = leaked.filter(~((F.col("lang") == "fr") & (F.col("split") == "test"))).select("seed", "id")
    foreign = docs_splits(spark, sf, ["source"]).filter("source = 'src5' and split = 'test'").select("seed", (-F.col("id") - 1).alias("id"))
    return A.audit_complete(dropped.unionByName(foreign), docs_cohort(spark, sf), SEEDS)


@query(
    "audit_test",
    sql(
        """SELECT seed, id, 'changed' AS issue FROM docs_splits WHERE split = 'test' AND source = 'src3'
           UNION ALL SELECT seed, id, 'copy' FROM docs_splits WHERE split = 'test' AND source = 'src4'
           UNION ALL SELECT seed, id, 'repeated' FROM docs_splits WHERE split = 'test' AND source = 'src4'"""
    ),
)
def _(spark, sf):
    cols = ["y", "n_chars", "spaces", "source"]
    test = sides(docs_splits(spark, sf, cols[1:]))[1]
    spoiled = test.withColumn("n_chars", F.when(F.col("source") == "src3", F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    copies = F.when(F.col("source") == "src4", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return A.audit_test(spoiled.withColumn("copy_no", F.explode(copies)), docs_cohort(spark, sf), cols)


@query(
    "audit_balance",
    sql(
        """SELECT c.seed, 'oversampled' AS strategy, c.id, count(*) AS n_rows
           FROM (SELECT seed, id, unnest(range(copies::BIGINT)) AS copy_no FROM all_copies) c
           JOIN docs_splits s ON s.seed = c.seed AND s.id = c.id WHERE s.split = 'test' GROUP BY ALL""",
        all_splits="SELECT seed, id, y, 'train' AS split, n_chars FROM docs_splits",
        **{k: v for k, v in train_ctes("all", ["n_chars"]).items() if k != "all_train"},
    ),
)
def _(spark, sf):
    # Oversampling that was given every row instead of the training rows.
    splits = docs_splits(spark, sf)
    return A.audit_balance(B.balance(splits.drop("split"), "even", GROUPS), splits)


def _doc_params(rows: DataFrame) -> DataFrame:
    return D.fit_scale(rows, DOC_FEATURES, "z")


def params_sql() -> str:
    def fit(where: str) -> str:
        parts = []
        for f in DOC_FEATURES:
            parts.append(f"SELECT seed, '{f}' AS feature, 'center' AS stat, avg({f}) AS value FROM docs_splits {where} GROUP BY 1")
            parts.append(f"SELECT seed, '{f}', 'scale', stddev_pop({f}) FROM docs_splits {where} GROUP BY 1")
        return " UNION ALL ".join(parts)

    return sql(
        f"""SELECT t.seed, 'scale' AS transform, t.feature, t.stat, round(a.value, 3) + 0.0 AS stored,
               round(t.value, 3) + 0.0 AS from_train, round(a.value, 3) + 0.0 AS from_all, true AS matches_full
            FROM pt t JOIN pa a ON a.seed = t.seed AND a.feature = t.feature AND a.stat = t.stat
            WHERE t.feature = 'n_chars' AND abs(a.value - t.value) > 1e-6 * greatest(1, abs(t.value))""",
        pt=fit("WHERE split = 'train'"),
        pa=fit(""),
    )


@query("audit_params", params_sql())
def _(spark, sf):
    # One feature was scaled with parameters of all rows, the others correctly.
    splits = docs_splits(spark, sf, DOC_FEATURES)
    right, full = _doc_params(sides(splits)[0]), _doc_params(splits)
    stored = right.filter("feature <> 'n_chars'").unionByName(full.filter("feature = 'n_chars'"))
    return rounded(A.audit_params(stored, right, full), "stored", "from_train", "from_all", places=3)


LOG_CASE = "CASE event_type WHEN 'signup' THEN 'split' WHEN 'view' THEN 'freeze' WHEN 'click' THEN 'fit' WHEN 'purchase' THEN 'predict' ELSE 'report' END"


@query(
    "audit_order",
    f"""WITH log AS (SELECT 'user' || user_id AS experiment, day(ts)::INT AS seed, {LOG_CASE} AS step, event_id AS step_no, ts FROM events),
             s AS (SELECT experiment, seed, step, min(row(ts, step_no)) AS f, max(row(ts, step_no)) AS l,
                     list_position(['split', 'freeze', 'balance', 'fit', 'predict', 'evaluate'], step) AS place FROM log GROUP BY ALL),
             b AS (SELECT s.experiment, s.seed, s.step, s.f, coalesce(s.place, 0) AS place,
                     (SELECT max(p.l) FROM s p WHERE p.experiment = s.experiment AND p.seed = s.seed AND p.place < s.place) AS prev FROM s),
             i AS (SELECT *, CASE WHEN place = 0 THEN 'unknown step' WHEN f < prev THEN 'too early' END AS issue FROM b)
        SELECT experiment, seed, step, strftime(f[1], '%Y-%m-%d %H:%M:%S') AS first_at,
               CASE WHEN place > 0 THEN strftime(prev[1], '%Y-%m-%d %H:%M:%S') END AS previous_end, issue
        FROM i WHERE issue IS NOT NULL""",
)
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("experiment"),
        F.dayofmonth("ts").alias("seed"),
        F.expr(LOG_CASE).alias("step"),
        F.col("event_id").alias("step_no"),
        F.col("ts").alias("at"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return A.audit_order(log).select("experiment", "seed", "step", stamp("first_at"), stamp("previous_end"), "issue")


@query(
    "audit_shares",
    sql(
        f"""WITH c AS (SELECT seed, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND y = 1) AS pos_test,
                        avg(y) * count(*) FILTER (split = 'test') AS expected FROM bad GROUP BY 1)
            SELECT seed, n_test, pos_test, {r('expected')} FROM c WHERE abs(pos_test - expected) > 1""",
        bad="SELECT seed, id, y, CASE WHEN lang = 'de' AND y = 1 THEN 'test' ELSE split END AS split FROM docs_splits",
    ),
)
def _(spark, sf):
    moved = F.when((F.col("lang") == "de") & (F.col("y") == 1), "test").otherwise(F.col("split"))
    return rounded(A.audit_shares(docs_splits(spark, sf, ["lang"]).withColumn("split", moved)), "expected")


WRONG = dict(
    whole="SELECT 0 AS seed, id, y, 'train' AS split, n_chars, spaces, word_len FROM docs",
    wh_splits="SELECT * FROM whole",
    **{k: v for k, v in train_ctes("wh", DOC_FEATURES).items() if k != "wh_train"},
    wrong_c="SELECT id || '#' || c AS id, y, n_chars, spaces, word_len FROM (SELECT *, unnest(range(copies::BIGINT)) AS c FROM wh_copies) t",
    **splits_ctes("wrong", "wrong_c", "n_chars, spaces, word_len"),
    wrong_train="SELECT seed, 'oversampled' AS strategy, y, n_chars, spaces, word_len FROM wrong_splits WHERE split = 'train'",
    **gnb_ctes("wrong", DOC_FEATURES, "docs"),
    **metric_ctes("wrong"),
)


@query(
    "leak_effect",
    sql(
        """SELECT r.experiment, r.model, r.metric, r.seed, round(r.value, 6) + 0.0 AS "right", round(w.value, 6) + 0.0 AS wrong,
                  round(w.value - r.value, 6) + 0.0 AS diff
           FROM docs_metrics r JOIN wrong_metrics w ON w.seed = r.seed AND w.metric = r.metric WHERE r.strategy = 'oversampled'""",
        **WRONG,
    ),
)
def _(spark, sf):
    cohort = docs(spark, sf)
    right = docs_metrics(spark, sf).filter(F.col("strategy") == "oversampled")
    train, test = sides(A.leaky_sides(cohort, SEEDS, DOC_FEATURES))
    params = M.fit_gnb(train.withColumn("strategy", F.lit("oversampled")), DOC_FEATURES, groups=len(SEEDS))
    wrong = G.evaluate(M.score_gnb(test, params, DOC_FEATURES, "docs", groups=len(SEEDS)))
    return rounded(A.leak_effect(wrong, right), "right", "wrong", "diff")


@query(
    "audit_all",
    sql(
        """SELECT 'overlap' AS "check", (SELECT count(*) FROM (SELECT seed, id FROM leaky_splits GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) t) AS n_violations
           UNION ALL SELECT 'entity', (SELECT count(*) FROM (SELECT s.seed, c.entity_id FROM docs_splits s JOIN docs c ON c.id = s.id
                                       GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) t)
           UNION ALL SELECT 'copies', (SELECT count(*) FROM (SELECT s.seed, d.text FROM docs_splits s JOIN documents d ON d.doc_id = s.id
                                       GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) t)
           UNION ALL SELECT 'near', (SELECT count(*) FROM (""" + BOTH_SQL.format(c="content", src=NEAR_SQL) + """) t)
           UNION ALL SELECT 'complete', 0
           UNION ALL SELECT 'test', 0
           UNION ALL SELECT 'shares', 0
           UNION ALL SELECT 'balance', 0
           UNION ALL SELECT 'params', (SELECT count(*) FROM (""" + params_sql().strip() + """) t)
           UNION ALL SELECT 'order', 0""",
        **K_CTES,
    ),
)
def _(spark, sf):
    cohort = docs(spark, sf)
    good = S.freeze(S.holdout(cohort, SEEDS, keep=[*DOC_FEATURES, "lang", "source", "entity_id"]), new_path(spark, "splits"))
    train, test = sides(good)
    right, full = _doc_params(train), _doc_params(good)
    stored = right.filter("feature <> 'n_chars'").unionByName(full.filter("feature = 'n_chars'"))
    log = spark.range(len(SEEDS) * len(A.STEPS)).select(
        F.lit("docs").alias("experiment"),
        (F.col("id") % len(SEEDS) + 1).cast("int").alias("seed"),
        F.element_at(F.array(*[F.lit(s) for s in A.STEPS]), (F.floor(F.col("id") / len(SEEDS)) + 1).cast("int")).alias("step"),
        F.col("id").cast("int").alias("step_no"),
        F.timestamp_seconds(F.col("id")).alias("at"),
    )
    checks = {
        "overlap": A.audit_overlap(leaky(good)),
        "entity": A.audit_entity(good, cohort),
        # The entity of a document is the digest of its text.
        "copies": A.audit_copies(good, cohort, ["entity_id"]),
        "near": A.audit_near(good, cohort, {"n_chars": 40, "word_len": 0.5}, exact=["lang"]),
        "test": A.audit_test(test, cohort, ["y", *DOC_FEATURES]),
        "params": A.audit_params(stored, right, full),
        "order": A.audit_order(log),
        "complete": A.audit_complete(good, cohort, SEEDS),
        "shares": A.audit_shares(good),
        "balance": A.audit_balance(B.unbalanced_and_even(sides(good)[0], GROUPS), good),
    }
    return A.audit_all(checks)


# --- L: provenance and claims ------------------------------------------------------

L_CTES = dict(
    claims="""SELECT strategy || ':' || metric || ':mean' AS claim_id, metric, strategy, 'mean' AS stat,
                     round(mean, 6) + CASE WHEN metric = 'f1' THEN 0.01 ELSE 0 END AS claimed_value, 6 AS decimals,
                     CASE metric WHEN 'roc_auc' THEN 'repeated-holdout performance' WHEN 'precision' THEN 'clinical deployment readiness'
                       WHEN 'recall' THEN 'cost' ELSE 'stability' END AS topic
              FROM docs_summary WHERE metric <> 'accuracy'
              UNION ALL
              SELECT 'synthetic:' || metric || ':mean', metric, 'synthetic', 'mean', round(mean, 6), 6, 'stability'
              FROM docs_summary WHERE strategy = 'unbalanced'""",
    results="SELECT md5(concat_ws('|', experiment, strategy, metric, n_seeds)) AS result_id, experiment, strategy, metric FROM docs_summary",
    provenance="""SELECT c.claim_id, r.result_id, 'figure ' || c.metric AS figure FROM claims c
                  JOIN results r ON r.strategy = c.strategy AND r.metric = c.metric""",
    manifest="""SELECT result_id, experiment, CASE WHEN metric <> 'precision' THEN 'frac=0.2' END AS config, 'repeated_holdout' AS script,
                       'docs' AS input_fp FROM results WHERE metric <> 'recall' OR strategy = 'unbalanced'""",
    traced="""SELECT c.claim_id, c.metric, c.strategy, p.result_id, m.experiment, m.config, m.script, m.input_fp, p.figure
              FROM claims c LEFT JOIN provenance p ON p.claim_id = c.claim_id LEFT JOIN manifest m ON m.result_id = p.result_id""",
)


class Evidence:
    """Claims made from the recomputed summary, some of them wrong or without a result."""

    def __init__(self, spark: SparkSession, sf: str):
        self.pairs_from = docs_metrics(spark, sf)
        self.summary = H.summarize(self.pairs_from)
        topic = (
            F.when(F.col("metric") == "roc_auc", "repeated-holdout performance")
            .when(F.col("metric") == "precision", "clinical deployment readiness")
            .when(F.col("metric") == "recall", "cost")
            .otherwise("stability")
        )
        wrong = F.when(F.col("metric") == "f1", 0.01).otherwise(0.0)
        known = F.struct(F.col("strategy"), wrong.alias("wrong"), topic.alias("topic"))
        extra = F.struct(F.lit("synthetic").alias("strategy"), F.lit(0.0).alias("wrong"), F.lit("stability").alias("topic"))
        rows = F.filter(
            F.array(F.when(F.col("metric") != "accuracy", known), F.when(F.col("strategy") == "unbalanced", extra)),
            lambda x: x.isNotNull(),
        )
        self.claims = self.summary.select("metric", "mean", F.explode(rows).alias("_c")).select(
            F.concat_ws(":", "_c.strategy", "metric", F.lit("mean")).alias("claim_id"),
            "metric",
            F.col("_c.strategy").alias("strategy"),
            F.lit("mean").alias("stat"),
            (F.round("mean", 6) + F.col("_c.wrong")).alias("claimed_value"),
            F.lit(6).alias("decimals"),
            F.col("_c.topic").alias("topic"),
        )
        results = self.summary.select(
            F.md5(F.concat_ws("|", "experiment", "strategy", "metric", F.col("n_seeds").cast("string"))).alias("result_id"),
            "experiment",
            "strategy",
            "metric",
        )
        self.provenance = self.claims.join(results, ["strategy", "metric"]).select(
            "claim_id", "result_id", F.concat(F.lit("figure "), "metric").alias("figure")
        )
        self.manifest = results.filter("metric <> 'recall' or strategy = 'unbalanced'").select(
            "result_id",
            "experiment",
            F.when(F.col("metric") != "precision", "frac=0.2").alias("config"),
            F.lit("repeated_holdout").alias("script"),
            F.lit("docs").alias("input_fp"),
        )
        self.found = self.summary.select("metric", "strategy", F.expr("stack(2, 'mean', mean, 'sd', sd) as (stat, value)"))


@query("trace", sql("SELECT * FROM traced", **L_CTES))
def _(spark, sf):
    e = Evidence(spark, sf)
    return L.trace(e.claims, e.provenance, e.manifest)


@query(
    "broken_links",
    sql(
        """SELECT 'claim' AS kind, claim_id AS ref, CASE WHEN result_id IS NULL THEN 'result_id' WHEN experiment IS NULL THEN 'experiment'
                  WHEN config IS NULL THEN 'config' WHEN script IS NULL THEN 'script' WHEN input_fp IS NULL THEN 'input_fp' END AS missing
           FROM traced WHERE result_id IS NULL OR experiment IS NULL OR config IS NULL
           UNION ALL
           SELECT 'result', result_id, 'claim' FROM manifest WHERE result_id NOT IN (SELECT result_id FROM traced WHERE result_id IS NOT NULL)""",
        **L_CTES,
    ),
)
def _(spark, sf):
    e = Evidence(spark, sf)
    return L.broken_links(L.trace(e.claims, e.provenance, e.manifest), e.manifest)


@query(
    "check_claims",
    sql(
        """SELECT c.claim_id, c.metric, c.strategy, c.stat, round(c.claimed_value, 6) + 0.0 AS claimed_value, round(s.mean, 6) + 0.0 AS recomputed,
                  CASE WHEN s.mean IS NULL THEN 'no result' WHEN abs(round(s.mean, 6) - c.claimed_value) < 5e-7 THEN 'confirmed' ELSE 'contradicted' END AS status
           FROM claims c LEFT JOIN docs_summary s ON s.metric = c.metric AND s.strategy = c.strategy""",
        **L_CTES,
    ),
)
def _(spark, sf):
    e = Evidence(spark, sf)
    return rounded(L.check_claims(e.claims, e.found), "claimed_value", "recomputed")


@query(
    "resolve_evidence",
    sql(
        f"""SELECT metric, model, {r('value')}, corrected, leakage_safe, version, result_id FROM (
            SELECT *, row_number() OVER (PARTITION BY metric, model ORDER BY corrected DESC, leakage_safe DESC, version DESC, result_id DESC) AS rk FROM (
              SELECT metric, model, value, seed > 3 AS corrected, strategy = 'oversampled' AS leakage_safe, seed // 4 AS version,
                     strategy || '-' || seed AS result_id FROM docs_metrics) t) u WHERE rk = 1"""
    ),
)
def _(spark, sf):
    results = docs_metrics(spark, sf).select(
        "metric",
        "model",
        "value",
        (F.col("seed") > 3).alias("corrected"),
        (F.col("strategy") == "oversampled").alias("leakage_safe"),
        F.expr("cast(seed div 4 as int)").alias("version"),
        F.concat_ws("-", "strategy", F.col("seed").cast("string")).alias("result_id"),
    )
    return rounded(L.resolve_evidence(results, ["metric", "model"]), "value")


# Topics the evidence does and does not support.
SCOPE = {
    "leakage-safe evaluation": True,
    "repeated-holdout performance": True,
    "stability": True,
    "comparison of training strategies": True,
    "subgroup fairness diagnostics": True,
    "independent external clinical validation": False,
    "cross-dataset generalization": False,
    "empirical privacy guarantees": False,
    "universal algorithmic fairness": False,
    "clinical deployment readiness": False,
}


@query(
    "scope_gate",
    sql(
        f"""SELECT c.claim_id, c.topic, CASE WHEN s.supported IS NULL THEN 'topic not listed' WHEN NOT s.supported THEN 'unsupported topic'
                WHEN NOT EXISTS (SELECT 1 FROM docs_summary d WHERE d.metric = c.metric AND d.strategy = c.strategy) THEN 'no result'
                ELSE 'in scope' END AS gate
            FROM claims c LEFT JOIN (VALUES {', '.join(f"('{k}', {str(v).lower()})" for k, v in SCOPE.items())}) s(topic, supported) ON s.topic = c.topic""",
        **L_CTES,
    ),
)
def _(spark, sf):
    e = Evidence(spark, sf)
    scope = spark.createDataFrame(list(SCOPE.items()), "topic string, supported boolean")
    return L.scope_gate(e.claims, scope, e.found)


def fingerprint_sql() -> str:
    part = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    key = f"md5(concat_ws('|', {', '.join(part(c) for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))}))"
    sums = ", ".join(f"sum(('0x' || substr(k, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(4))
    return f"SELECT n_rows, md5(concat_ws('|', n_rows, s0, s1, s2, s3)) AS fingerprint FROM (SELECT count(*) AS n_rows, {sums} FROM (SELECT {key} AS k FROM documents) t) u"


@query("fingerprint", fingerprint_sql())
def _(spark, sf):
    return L.fingerprint(table(spark, sf, "documents"))


@query(
    "rerun_diff",
    sql(
        """WITH a AS (SELECT seed, id, y_pred FROM docs_pred WHERE strategy = 'unbalanced'),
                b AS (SELECT seed, id, y_pred FROM docs_pred WHERE strategy = 'oversampled')
           SELECT seed, id, y_pred, 'only_a' AS side, 1::BIGINT AS n_extra FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) t
           UNION ALL SELECT seed, id, y_pred, 'only_b', 1::BIGINT FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) t"""
    ),
)
def _(spark, sf):
    pred = docs_pred(spark, sf)
    run = lambda s: pred.filter(F.col("strategy") == s).select("seed", "id", "y_pred")
    return L.rerun_diff(run(STRATEGIES[0]), run(STRATEGIES[1]))
