"""Plain SQL for every registered query, written without any of the distributed forms.

A query is a chain of common table expressions: one plain window where the library uses
histograms and thresholds, self joins where it uses aggregates.
"""

from __future__ import annotations

PI_TERM = "-0.5 * ln(2 * pi() * {v}) - ({x} - {m}) * ({x} - {m}) / (2 * {v})"

DOC_F = ["n_chars", "spaces", "word_len"]
ORD_F = ["price", "month", "quantity", "extended", "discount"]

BASE = {
    "seeds": "SELECT range::INT AS seed FROM range(1, 11)",
    "docs": """
      SELECT d.doc_id AS id, md5(d.text) AS entity_id, (1 - l.quality)::INT AS y,
             d.n_chars::DOUBLE AS n_chars,
             (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces,
             d.n_chars::DOUBLE / (1 + length(text) - length(replace(text, ' ', '')))::DOUBLE AS word_len,
             (length(text) - length(translate(text, '0123456789', '')))::DOUBLE
               / greatest(length(text), 1)::DOUBLE AS digit_share,
             d.lang, d.source
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "orders_c": """
      SELECT o.o_orderkey AS id, o.o_custkey AS entity_id, (o.o_orderstatus = 'F')::INT AS y,
             o.o_totalprice AS price, month(o.o_orderdate)::DOUBLE AS month,
             s.quantity, s.extended, s.discount,
             c.c_mktsegment AS segment, r.r_name AS region, o.o_orderpriority AS priority
      FROM orders o
      LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS extended,
                        avg(l_discount) AS discount FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey
      JOIN customer c ON c.c_custkey = o.o_custkey
      JOIN nation n ON n.n_nationkey = c.c_nationkey
      JOIN region r ON r.r_regionkey = n.n_regionkey""",
}


def quota_sql(counts: str, per_mille: int = 200, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
      WITH a AS (SELECT *, (sum(n) OVER ({part}))::BIGINT AS total FROM {counts}),
           b AS (SELECT *, ({per_mille} * total + 999) // 1000 AS n_test FROM a),
           c AS (SELECT *, (n_test * n) // total AS fl, (n_test * n) % total AS rm FROM b),
           d AS (SELECT *, row_number() OVER ({part} ORDER BY rm DESC, stratum) AS rk,
                        n_test - (sum(fl) OVER ({part}))::BIGINT AS extra FROM c)
      SELECT {lead}stratum, n, fl + (rk <= extra)::INT AS k FROM d"""


def splits_ctes(p: str, cohort: str, cols: str, salt: str = "split") -> dict[str, str]:
    extra = "".join(f", c.{x.strip()}" for x in cols.split(",") if x.strip())
    return {
        f"{p}_cnt": f"SELECT y AS stratum, count(*) AS n FROM {cohort} GROUP BY 1",
        f"{p}_quota": quota_sql(f"{p}_cnt"),
        f"{p}_splits": f"""
          SELECT seed, id, y, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split{extra.replace('c.', '')}
          FROM (SELECT s.seed, c.id, c.y, q.k{extra},
                       row_number() OVER (PARTITION BY s.seed, c.y
                         ORDER BY md5(concat_ws('|', s.seed, '{salt}', c.id)), c.id) AS rn
                FROM {cohort} c CROSS JOIN seeds s JOIN {p}_quota q ON q.stratum = c.y) t""",
    }


def train_ctes(p: str, feats: list[str]) -> dict[str, str]:
    f = ", ".join(feats)
    return {
        f"{p}_sizes": f"""
          SELECT seed, y, n, max(n) OVER (PARTITION BY seed) AS n_max
          FROM (SELECT seed, y, count(*) AS n FROM {p}_splits WHERE split = 'train' GROUP BY ALL) t""",
        f"{p}_copies": f"""
          SELECT t.seed, t.id, t.y, {', '.join('t.' + x for x in feats)},
                 s.n_max // s.n + (row_number() OVER (PARTITION BY t.seed, t.y
                   ORDER BY md5(concat_ws('|', t.seed, 'os', t.id)), t.id) <= s.n_max % s.n)::INT AS copies
          FROM {p}_splits t JOIN {p}_sizes s ON s.seed = t.seed AND s.y = t.y WHERE t.split = 'train'""",
        f"{p}_train": f"""
          SELECT seed, 'unbalanced' AS strategy, id, 0::BIGINT AS copy_no, y, {f} FROM {p}_copies
          UNION ALL
          SELECT seed, 'oversampled' AS strategy, id, unnest(range(copies::BIGINT)) AS copy_no, y, {f} FROM {p}_copies""",
    }


def gnb_ctes(p: str, feats: list[str], exp: str, keep: str = "") -> dict[str, str]:
    aggs, floors, cols = [], [], []
    for x in feats:
        for c in (0, 1):
            aggs.append(f"avg({x}) FILTER (y = {c}) AS m{c}_{x}, var_pop({x}) FILTER (y = {c}) AS u{c}_{x}")
            cols.append(f"m{c}_{x}, CASE WHEN u{c}_{x} IS NOT NULL THEN greatest(u{c}_{x}, flr) END AS v{c}_{x}")
        aggs.append(f"var_pop({x}) AS vt_{x}")
        floors.append(f"coalesce(vt_{x}, 0)")
    top = f"greatest({', '.join(floors)})"
    terms = []
    for x in feats:
        pdf = [PI_TERM.format(x=f"t.{x}", m=f"g.m{c}_{x}", v=f"g.v{c}_{x}") for c in (0, 1)]
        terms.append(f"coalesce(({pdf[1]}) - ({pdf[0]}), 0)")
    kept = "".join(f", t.{k.strip()}" for k in keep.split(",") if k.strip())
    return {
        f"{p}_fit": f"""
          SELECT seed, strategy, n0, n1, {', '.join(cols)}
          FROM (SELECT *, CASE WHEN {top} > 0 THEN {top} * 1e-9 ELSE 1e-9 END AS flr
                FROM (SELECT seed, strategy, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1,
                             {', '.join(aggs)} FROM {p}_train GROUP BY ALL) a) b""",
        f"{p}_pred": f"""
          SELECT *, (score > 0)::INT AS y_pred FROM (
            SELECT '{exp}' AS experiment, 'gnb' AS model, g.strategy, t.seed, t.id, t.y,
                   ln(g.n1::DOUBLE) - ln(g.n0::DOUBLE) + {' + '.join(terms)} AS score{kept}
            FROM {p}_splits t JOIN {p}_fit g ON g.seed = t.seed WHERE t.split = 'test') z""",
    }


def metric_ctes(p: str) -> dict[str, str]:
    k = "experiment, model, strategy, seed"
    return {
        f"{p}_conf": f"""
          SELECT {k}, count(*) FILTER (y = 1 AND y_pred = 1) AS tp, count(*) FILTER (y = 0 AND y_pred = 1) AS fp,
                 count(*) FILTER (y = 1 AND y_pred = 0) AS fn, count(*) FILTER (y = 0 AND y_pred = 0) AS tn
          FROM {p}_pred GROUP BY ALL""",
        f"{p}_auc": f"""
          SELECT {k}, (sum(rk) FILTER (y = 1) - p * (p + 1) / 2) / (p::DOUBLE * n::DOUBLE) AS value
          FROM (SELECT {k}, y,
                       rank() OVER (PARTITION BY {k} ORDER BY round(score, 6))
                         + (count(*) OVER (PARTITION BY {k}, round(score, 6)) - 1) / 2 AS rk,
                       sum(y) OVER (PARTITION BY {k}) AS p, sum(1 - y) OVER (PARTITION BY {k}) AS n
                FROM {p}_pred) t
          GROUP BY {k}, p, n""",
        f"{p}_metrics": f"""
          SELECT {k}, 'accuracy' AS metric, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS value FROM {p}_conf
          UNION ALL SELECT {k}, 'precision', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) FROM {p}_conf
          UNION ALL SELECT {k}, 'recall', coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) FROM {p}_conf
          UNION ALL SELECT {k}, 'f1', coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) FROM {p}_conf
          UNION ALL SELECT {k}, 'roc_auc', value FROM {p}_auc""",
        f"{p}_summary": f"""
          SELECT experiment, model, strategy, metric, count(value) AS n_seeds, avg(value) AS mean,
                 stddev_samp(value) AS sd, min(value) AS min, max(value) AS max
          FROM {p}_metrics GROUP BY ALL""",
        f"{p}_paired": f"""
          SELECT a.experiment, a.model, a.metric, a.seed, a.value AS a, b.value AS b, b.value - a.value AS diff
          FROM {p}_metrics a JOIN {p}_metrics b ON b.experiment = a.experiment AND b.model = a.model
            AND b.metric = a.metric AND b.seed = a.seed
          WHERE a.strategy = 'unbalanced' AND b.strategy = 'oversampled'
            AND a.value IS NOT NULL AND b.value IS NOT NULL""",
        f"{p}_d": f"SELECT experiment, model, metric, seed, round(diff, 12) AS d, diff FROM {p}_paired",
        f"{p}_t": f"""
          WITH m AS (SELECT experiment, model, metric, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd
                     FROM {p}_d GROUP BY ALL),
               s AS (SELECT avg(a) AS n_train, avg(b) AS n_test FROM (
                       SELECT seed, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b
                       FROM {p}_splits GROUP BY 1) q),
               u AS (SELECT experiment, model, metric, 'paired_t' AS test, n,
                            CASE WHEN sd > 0 THEN mean / (sd * sqrt(1 / n::DOUBLE)) END AS statistic FROM m
                     UNION ALL
                     SELECT experiment, model, metric, 'corrected_t', n,
                            CASE WHEN sd > 0 THEN mean / (sd * sqrt(1 / n::DOUBLE + n_test / n_train)) END FROM m, s),
               v AS (SELECT *, atan(abs(statistic) / 3) AS th, cos(atan(abs(statistic) / 3)) AS c,
                            sin(atan(abs(statistic) / 3)) AS sn FROM u)
          SELECT experiment, model, metric, test, n, statistic,
                 1 - 2 / pi() * (th + sn * (c + 2 / 3::DOUBLE * c ** 3 + 8 / 15::DOUBLE * c ** 5
                                            + 16 / 35::DOUBLE * c ** 7)) AS p_value
          FROM v""",
        f"{p}_w": f"""
          WITH r AS (SELECT experiment, model, metric, d,
                            rank() OVER (PARTITION BY experiment, model, metric ORDER BY abs(d))
                            + (count(*) OVER (PARTITION BY experiment, model, metric, abs(d)) - 1) / 2 AS rk
                     FROM {p}_d WHERE d <> 0),
               g AS (SELECT DISTINCT experiment, model, metric FROM {p}_d),
               s AS (SELECT g.experiment, g.model, g.metric, count(r.d) AS n,
                            coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down,
                            coalesce(sum(rk * rk), 0) AS sq
                     FROM g LEFT JOIN r USING (experiment, model, metric) GROUP BY ALL),
               z AS (SELECT *, least(up, down) AS w,
                            abs(least(up, down) - n * (n + 1) / 4) / nullif(sqrt(sq / 4), 0) / sqrt(2) AS x FROM s)
          SELECT experiment, model, metric, 'wilcoxon' AS test, n, CASE WHEN n > 0 THEN w::DOUBLE END AS statistic,
                 CASE WHEN x = 0 THEN 1.0::DOUBLE WHEN x IS NOT NULL THEN
                   1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 200), lambda i:
                     exp((2 * i + 1) * ln(x) - ln(2) - lgamma(i + 1.5::DOUBLE) + 0.5 * ln(pi())))) END AS p_value
          FROM z""",
        f"{p}_tests": f"SELECT * FROM {p}_t UNION ALL SELECT * FROM {p}_w",
    }


def logistic_ctes(
    p: str, feats: list[str], exp: str, copies: str, rows: str, penalties: list[float], rounds: int = 10
) -> dict[str, str]:
    """Newton's method written out: each round sums gradient and Hessian and solves by elimination.

    `copies` holds the training rows with their copies, `rows` the rows to be scored.
    """
    k, n = "seed, strategy", len(feats) + 1
    margin = " + ".join(f"b.b{i} * t.z{i}" for i in range(n))
    std = ", ".join(f"CASE WHEN s_{x} > 0 AND t.{x} IS NOT NULL THEN (t.{x} - m_{x}) / s_{x} ELSE 0 END AS z{i + 1}" for i, x in enumerate(feats))
    out = {
        f"{p}_arms": f"""
          SELECT seed, 'unbalanced' AS strategy, y, 1.0::DOUBLE AS w, {', '.join(feats)} FROM {copies}
          UNION ALL SELECT seed, 'oversampled', y, copies::DOUBLE, {', '.join(feats)} FROM {copies}""",
        f"{p}_m": f"""
          SELECT {k}, sum(w) AS total, {', '.join(f'sum(w * {x}) / sum(w) FILTER ({x} IS NOT NULL) AS m_{x}' for x in feats)}
          FROM {p}_arms GROUP BY ALL""",
        f"{p}_s": f"""
          SELECT m.*, q.* EXCLUDE (seed, strategy) FROM {p}_m m JOIN (
            SELECT t.seed, t.strategy, {', '.join(f'sqrt(sum(w * (t.{x} - m_{x}) ** 2) / (any_value(total) - 1)) AS s_{x}' for x in feats)}
            FROM {p}_arms t JOIN {p}_m m ON m.seed = t.seed AND m.strategy = t.strategy GROUP BY ALL) q
          ON q.seed = m.seed AND q.strategy = m.strategy""",
        f"{p}_z": f"""
          SELECT t.seed, t.strategy, t.y, w / total AS w, 1.0::DOUBLE AS z0, {std}
          FROM {p}_arms t JOIN {p}_s s ON s.seed = t.seed AND s.strategy = t.strategy""",
        f"{p}_b0": f"""
          SELECT seed, strategy, penalty, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(n))}
          FROM {p}_m, (VALUES {', '.join(f'({x}::DOUBLE)' for x in penalties)}) g(penalty)""",
    }
    ridge = lambda i: "penalty" if i else "0"
    for it in range(rounds):
        sums = [f"sum(w * (pr - y) * z{i}) AS g{i}, any_value(b{i}) AS b{i}" for i in range(n)]
        sums += [f"sum(w * pr * (1 - pr) * z{i} * z{j}) AS h{i}{j}" for i in range(n) for j in range(i + 1)]
        out[f"{p}_h{it}"] = f"""
          SELECT seed, strategy, penalty, {', '.join(sums)} FROM (
            SELECT t.*, b.penalty, {', '.join(f'b.b{i}' for i in range(n))}, 1 / (1 + exp(-({margin}))) AS pr
            FROM {p}_z t JOIN {p}_b{it} b ON b.seed = t.seed AND b.strategy = t.strategy) q
          GROUP BY ALL"""
        steps = []
        for i in range(n):
            less = "".join(f" - l{i}{m} * l{i}{m} * d{m}" for m in range(i))
            for j in range(i):
                own = "".join(f" - l{i}{m} * l{j}{m} * d{m}" for m in range(j))
                steps.append(f"(h{i}{j}{own}) / d{j} AS l{i}{j}")
            steps.append(f"h{i}{i} + {ridge(i)}{less} AS d{i}")
        for i in range(n):
            steps.append(f"g{i} + {ridge(i)} * b{i}" + "".join(f" - l{i}{j} * u{j}" for j in range(i)) + f" AS u{i}")
        for i in reversed(range(n)):
            steps.append(f"u{i} / d{i}" + "".join(f" - l{j}{i} * v{j}" for j in range(i + 1, n)) + f" AS v{i}")
        out[f"{p}_b{it + 1}"] = f"""
          SELECT seed, strategy, penalty, {', '.join(f'b{i} - v{i} AS b{i}' for i in range(n))}
          FROM (SELECT *, {', '.join(steps)} FROM {p}_h{it}) q"""
    out[f"{p}_coef"] = " UNION ALL ".join(
        f"SELECT seed, strategy, penalty, '{x}' AS feature, b{i} AS coef FROM {p}_b{rounds}"
        for i, x in enumerate(["const", *feats])
    )
    out[f"{p}_pred"] = f"""
      SELECT *, (score > 0)::INT AS y_pred FROM (
        SELECT '{exp}' AS experiment, 'logistic' AS model, t.strategy, t.seed, t.id, t.y, b.penalty, {margin} AS score
        FROM (SELECT t.seed, s.strategy, t.id, t.y, 1.0::DOUBLE AS z0, {std}
              FROM {rows} t JOIN {p}_s s ON s.seed = t.seed) t
        JOIN {p}_b{rounds} b ON b.seed = t.seed AND b.strategy = t.strategy) q"""
    return out


def fairness_ctes(p: str, attrs: list[str]) -> dict[str, str]:
    k = "experiment, model, strategy, seed, attr, grp"
    w = "OVER (PARTITION BY experiment, model, strategy, seed, attr)"
    long = " UNION ALL ".join(
        f"SELECT experiment, model, strategy, seed, y, y_pred, '{a}' AS attr, {a} AS grp FROM {p}_pred" for a in attrs
    )
    one = lambda m, e: f"SELECT {k}, n, prevalence, '{m}' AS measure, {e} AS value FROM r"
    return {
        f"{p}_sub": f"""
          SELECT *, ((sum(n) {w}) - n)::BIGINT AS rest_n, ((sum(pos) {w}) - pos)::BIGINT AS rest_pos,
                 ((sum(pred_pos) {w}) - pred_pos)::BIGINT AS rest_pred_pos, ((sum(tp) {w}) - tp)::BIGINT AS rest_tp
          FROM (SELECT {k}, count(*) AS n, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y_pred = 1) AS pred_pos,
                       count(*) FILTER (y = 1 AND y_pred = 1) AS tp FROM ({long}) l GROUP BY ALL) g""",
        f"{p}_fair": f"""
          WITH r AS (SELECT *, pos::DOUBLE / n AS prevalence, pred_pos::DOUBLE / n AS rate,
                            rest_pred_pos::DOUBLE / nullif(rest_n, 0) AS orate, tp::DOUBLE / nullif(pos, 0) AS tpr,
                            rest_tp::DOUBLE / nullif(rest_pos, 0) AS otpr FROM {p}_sub)
          {one('spd', 'rate - orate')} UNION ALL {one('eod', 'tpr - otpr')}
          UNION ALL {one('di', 'rate / nullif(orate, 0)')}""",
    }


CTES: dict[str, str] = {
    **BASE,
    **splits_ctes("docs", "docs", "n_chars, spaces, word_len, digit_share, lang, source"),
    **train_ctes("docs", DOC_F),
    **gnb_ctes("docs", DOC_F, "docs", "lang, source"),
    **metric_ctes("docs"),
    **fairness_ctes("docs", ["lang", "source"]),
    **splits_ctes("ord", "orders_c", ", ".join(ORD_F) + ", segment, region, priority"),
    **train_ctes("ord", ORD_F),
    **gnb_ctes("ord", ORD_F, "orders", "segment, region"),
    **metric_ctes("ord"),
    **fairness_ctes("ord", ["segment", "region"]),
}


def sql(final: str, **more: str) -> str:
    """`final` behind the expressions it needs, found by name, `more` first."""
    known = {**CTES, **more}
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and _mentions(text, name):
                need(known[name])
                order.append(name)

    need(final)
    if not order:
        return final
    head = "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order)
    own = final.strip()
    return f"{head},\n{own[5:]}" if own.upper().startswith("WITH ") else f"{head}\n{own}"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![\w']){name}\b(?!\s*\.)(?!\s+AS\s*\()", text) is not None


def r(cols: str, places: int = 6) -> str:
    """Rounded, signed-zero-free select items."""
    return ", ".join(f"round({c.strip()}, {places}) + 0.0 AS {c.strip()}" for c in cols.split(","))
