"""Split and metric queries over the score and duration views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.functions.shared import written
from padlens.operators import metrics as M
from padlens.operators import splits as D
from padlens.plans import adapters as A
from padlens.plans.adapters import BINS, CELL, SCORES

LEVELS = [0.2, 0.4, 0.6, 0.8]
CUT = 40000.0


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def cuts_of(spark: SparkSession, sf: str) -> DataFrame:
    return M.select_cuts(A.scores(spark, sf).filter("pool = 'val'"), CELL)


def cells_of(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = written(A.scores(spark, sf), "scores") if rows is None else rows  # split once for both pools
    return M.at_cut(rows.filter("pool = 'test'"), M.select_cuts(rows.filter("pool = 'val'"), CELL), CELL, "frr5")


def e1_operating_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: cuts from validation rows, FAR and FRR on test rows, joined with AUC, per cell."""
    rows = written(A.scores(spark, sf), "scores")
    return rounded(cells_of(spark, sf, rows).join(M.auc(rows.filter("pool = 'test'"), CELL).select(*CELL, "auc"), CELL), "far", "frr", "auc")


def e4_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = M.curve(A.scores(spark, sf).filter("pool = 'val'"), CELL).filter("cut <> double('Infinity')")
    return rounded(out.select(*CELL, "cut", "accepted", "rejected", "fa", "frr"), "cut", "fa", "frr")


def e12_e14_duration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.bins(spark, sf)
    cuts = M.duration_cuts(rows.filter("pool = 'train'"), LEVELS)
    return rounded(M.duration_metrics(rows.filter("pool = 'test'"), cuts, CUT), "fa", "frr", "auc")


def e15_standardised_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.bins(spark, sf)
    return rounded(M.standardised_rate(rows, M.duration_cuts(rows, LEVELS), CUT, "F"), "rate")


def e9_paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    cells = A.scores(spark, sf).groupBy(*CELL, "pool").agg(F.avg("score").alias("v"))
    return rounded(M.paired_delta(cells.filter("pool = 'test'"), cells.filter("pool = 'val'"), CELL, "v"), "mean_gap", "median_gap")


def e10_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.macro(cells_of(spark, sf), ["detector"], ["far", "frr"]), "far", "frr")


def e11_long_results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.long_results(cells_of(spark, sf).select(*CELL, "far", "frr"), CELL, ["far", "frr"]), "value")


def e24_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways to one number: cell AUC over all rows against AUC over test rows."""
    rows = A.scores(spark, sf)
    a, b = M.auc(rows, CELL), M.auc(rows.filter("pool = 'test'"), CELL)
    return rounded(M.reconcile(a, b, CELL, "auc"), "left_value", "right_value", "gap")


def e25_reference_box(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scores(spark, sf)
    out = M.reference_box(rows.filter("pool = 'test'"), rows.filter("label = 0 and pool = 'train'"), CELL, "score")
    return rounded(out.select("event_id", *CELL, "scaled"), "scaled")


QUERIES = {
    "d1_hash_rank_split": lambda s, d: A.scores(s, d).select("event_id", "pool"),
    "d4_meta_pool": lambda s, d: D.meta_pool(A.scores(s, d)).select("event_id", "label", "pool"),
    "d5_two_folds": lambda s, d: D.two_folds(A.scores(s, d)).groupBy("fold").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n")),
    "d6_mirrored_draw": lambda s, d: D.mirrored_draw(A.rhythm(s, d).filter("event_id % 2 = 0"), A.scores(s, d).filter("label = 1"), 20),
    "d7_equal_size_sample": lambda s, d: D.equal_size_sample(A.scores(s, d), "action", "event_id", "d7").select("action", "event_id"),
    "d8_stable_seed": lambda s, d: A.scores(s, d).select("event_id", D.stable_seed(F.concat_ws("|", "user_id", "event_id")).alias("seed")),
    "e1_operating_metrics": e1_operating_metrics,
    "e2_auc": lambda s, d: rounded(M.auc(A.scores(s, d), CELL), "auc"),
    "e4_curve": e4_curve,
    "e5_threshold_selection": lambda s, d: rounded(cuts_of(s, d), "eer", "eer_rate", "frr5", "val_fa", "val_frr"),
    "e6_test_eer": lambda s, d: rounded(M.test_eer(A.scores(s, d).filter("pool = 'test'"), CELL), "cut", "eer"),
    "e7_far_at_frozen_cut": lambda s, d: rounded(cells_of(s, d), "far", "frr"),
    "e8_grid_summary": lambda s, d: rounded(M.grid_summary(cells_of(s, d), "far", CELL), "mean", "median"),
    "e9_paired_delta": e9_paired_delta,
    "e10_macro": e10_macro,
    "e11_long_results": e11_long_results,
    "e14_duration_metrics": e12_e14_duration_metrics,
    "e15_standardised_rate": e15_standardised_rate,
    "e16_ks": lambda s, d: rounded(M.ks(A.scores(s, d), CELL), "ks"),
    "e17_quantile_ladder": lambda s, d: rounded(M.quantile_ladder(A.scores(s, d), ["action", "label"], "score"), "value"),
    "e18_real_fake_comparison": lambda s, d: rounded(M.real_fake_comparison(A.scores(s, d), CELL, "score"), "outside", "distance", "ratio99"),
    "e19_plausibility": lambda s, d: rounded(M.plausibility(M.real_fake_comparison(A.scores(s, d), CELL, "score"), outside=0.004), "outside", "distance", "ratio99"),
    "e23_outside_unit": lambda s, d: rounded(M.outside_unit(A.scores(s, d), CELL), "outside"),
    "e24_reconcile": e24_reconcile,
    "e25_reference_box": e25_reference_box,
}

_CURVE = """counts AS (SELECT action, detector, score, count(*) FILTER (label = 0) AS real, count(*) FILTER (label = 1) AS fake FROM src GROUP BY ALL),
cum AS (SELECT *, lag(score) OVER w AS last, coalesce(sum(real) OVER b, 0) AS real_below, coalesce(sum(fake) OVER b, 0) AS fake_below,
  sum(real) OVER c AS n_real, sum(fake) OVER c AS n_fake FROM counts
  WINDOW w AS (PARTITION BY action, detector ORDER BY score), b AS (PARTITION BY action, detector ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY action, detector)),
points AS (SELECT action, detector, CASE WHEN last IS NULL THEN score ELSE last + 0.5::DOUBLE * (score - last) END AS cut, CAST(fake_below AS BIGINT) AS accepted,
  CAST(n_real - real_below AS BIGINT) AS rejected, fake_below::DOUBLE / n_fake AS fa, (n_real - real_below)::DOUBLE / n_real AS frr FROM cum
  UNION ALL SELECT DISTINCT action, detector, 'infinity'::DOUBLE, CAST(n_fake AS BIGINT), 0, 1.0::DOUBLE, 0.0::DOUBLE FROM cum)"""
_CUTS = f"""WITH {SCORES}, src AS (SELECT * FROM scores WHERE pool = 'val'), {_CURVE},
eer AS (SELECT action, detector, cut AS eer, (fa + frr) / 2 AS eer_rate FROM points QUALIFY row_number() OVER (PARTITION BY action, detector ORDER BY abs(fa - frr), greatest(fa, frr), cut) = 1),
low AS (SELECT action, detector, cut AS frr5, fa AS val_fa, frr AS val_frr FROM points WHERE frr <= 0.05::DOUBLE + 1e-15 QUALIFY row_number() OVER (PARTITION BY action, detector ORDER BY fa, frr DESC, cut) = 1),
cuts AS (SELECT * FROM eer JOIN low USING (action, detector))"""
_CELLS = f"""{_CUTS}, cells AS (SELECT action, detector, avg(CAST(score < frr5 AS INTEGER)) FILTER (label = 1) AS far, avg(CAST(score >= frr5 AS INTEGER)) FILTER (label = 0) AS frr,
  count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake FROM scores JOIN cuts USING (action, detector) WHERE pool = 'test' GROUP BY ALL)"""


def _auc(name: str, where: str) -> str:
    return f"""{name} AS (SELECT action, detector, sum(fake * (below + real / 2.0::DOUBLE)) / (sum(real) * sum(fake)) AS auc, CAST(sum(real) AS BIGINT) AS n_real, CAST(sum(fake) AS BIGINT) AS n_fake FROM
 (SELECT *, coalesce(sum(real) OVER (PARTITION BY action, detector ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
  (SELECT action, detector, score, count(*) FILTER (label = 0) AS real, count(*) FILTER (label = 1) AS fake FROM scores WHERE {where} GROUP BY ALL)) GROUP BY ALL)"""


_LITTLE = "('0x' || " + " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in range(7, -1, -1)) + ")::UBIGINT"
_COMPARED = f"""WITH {SCORES}, r AS (SELECT action, detector, quantile_cont(score, [0.001, 0.25, 0.5, 0.75, 0.99, 0.999]) AS r FROM scores WHERE label = 0 AND pool = 'train' GROUP BY ALL),
f AS (SELECT action, detector, avg(CAST(score < r[1] OR score > r[6] AS INTEGER)) AS outside, quantile_cont(score, [0.5, 0.99]) AS f FROM scores JOIN r USING (action, detector) WHERE label = 1 GROUP BY ALL),
compared AS (SELECT action, detector, round(outside, 6) AS outside, round(abs(f[1] - r[3]) / greatest(r[4] - r[2], abs(r[3]) * 0.01::DOUBLE, 1e-9), 6) AS distance, round(CASE WHEN abs(r[5]) > 1e-12 THEN f[2] / r[5] END, 6) AS ratio99 FROM f JOIN r USING (action, detector))"""
_BINNED = "len(list_filter(cuts, lambda c: c <= duration))"

ORACLES = {
    "d1_hash_rank_split": f"WITH {SCORES} SELECT event_id, pool FROM scores",
    "d4_meta_pool": f"""WITH {SCORES}, u AS (SELECT DISTINCT user_id FROM scores WHERE label = 1 AND pool = 'val' ORDER BY user_id LIMIT 6),
h AS (SELECT *, sha256('total-meta-real|' || event_id) AS h FROM scores WHERE pool <> 'train')
SELECT event_id, label, CASE WHEN pool = 'test' THEN 'test' WHEN label = 1 THEN CASE WHEN user_id IN (FROM u) THEN 'train' ELSE 'val' END
 WHEN {_LITTLE} % 10 < 6 THEN 'train' ELSE 'val' END AS pool FROM h""",
    "d5_two_folds": f"""WITH {SCORES}, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM scores))
SELECT CAST(k >= ceil(n / 2.0) AS INTEGER) AS fold, count(DISTINCT user_id) AS users, count(*) AS n FROM scores JOIN u USING (user_id) GROUP BY 1""".replace("n FROM (SELECT DISTINCT", "n FROM (SELECT DISTINCT"),
    "d7_equal_size_sample": f"""WITH {SCORES} SELECT action, event_id FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY sha256(concat_ws('|', 'd7', action, event_id)), event_id) AS k FROM scores)
WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scores GROUP BY action))""",
    "d8_stable_seed": f"WITH h AS (SELECT event_id, sha256(concat_ws('|', user_id, event_id)) AS h FROM events) SELECT event_id, CAST({_LITTLE} % 9223372036854775808 AS BIGINT) AS seed FROM h",
    "e1_operating_metrics": f"{_CELLS}, {_auc('areas', "pool = 'test'")} SELECT action, detector, round(far, 6) AS far, round(frr, 6) AS frr, cells.n_real, cells.n_fake, round(auc, 6) AS auc FROM cells JOIN areas USING (action, detector)",
    "e2_auc": f"WITH {SCORES}, {_auc('areas', 'true')} SELECT action, detector, round(auc, 6) AS auc, n_real, n_fake FROM areas",
    "e4_curve": f"WITH {SCORES}, src AS (SELECT * FROM scores WHERE pool = 'val'), {_CURVE} SELECT action, detector, round(cut, 6) AS cut, accepted, rejected, round(fa, 6) AS fa, round(frr, 6) AS frr FROM points WHERE cut < 'infinity'::DOUBLE",
    "e5_threshold_selection": f"{_CUTS} SELECT action, detector, round(eer, 6) AS eer, round(eer_rate, 6) AS eer_rate, round(frr5, 6) AS frr5, round(val_fa, 6) AS val_fa, round(val_frr, 6) AS val_frr FROM cuts",
    "e6_test_eer": f"""WITH {SCORES}, src AS (SELECT * FROM scores WHERE pool = 'test'), {_CURVE}, p AS (SELECT action, detector, score, fake_below::DOUBLE / n_fake AS fa, (n_real - real_below)::DOUBLE / n_real AS frr FROM cum)
SELECT action, detector, round(score, 6) AS cut, round((fa + frr) / 2, 6) AS eer FROM p QUALIFY row_number() OVER (PARTITION BY action, detector ORDER BY abs(fa - frr), score) = 1""",
    "e7_far_at_frozen_cut": f"{_CELLS} SELECT action, detector, round(far, 6) AS far, round(frr, 6) AS frr, n_real, n_fake FROM cells",
    "e8_grid_summary": f"{_CELLS} SELECT action, detector, count(far) AS n, round(avg(far), 6) AS mean, round(quantile_cont(far, 0.5), 6) AS median, CAST(sum(CAST(far >= 0.6::DOUBLE AS INTEGER)) AS BIGINT) AS n_high FROM cells GROUP BY CUBE (action, detector)",
    "e9_paired_delta": f"""WITH {SCORES}, v AS (SELECT action, detector, pool, avg(score) AS v FROM scores GROUP BY ALL), g AS (SELECT a.v - b.v AS gap FROM v a JOIN v b USING (action, detector) WHERE a.pool = 'test' AND b.pool = 'val')
SELECT count(*) AS n, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap, CAST(sum(CAST(gap > 0 AS INTEGER)) AS BIGINT) AS wins FROM g""",
    "e10_macro": f"{_CELLS} SELECT detector, round(avg(far), 6) AS far, round(avg(frr), 6) AS frr, count(*) AS n_cells FROM cells GROUP BY detector",
    "e11_long_results": f"{_CELLS} SELECT action, detector, 'far' AS point, round(far, 6) AS value FROM cells UNION ALL SELECT action, detector, 'frr', round(frr, 6) FROM cells",
    "e14_duration_metrics": f"""WITH {BINS}, c AS (SELECT list_sort(list_distinct(quantile_cont(duration, {LEVELS}))) AS cuts FROM bins WHERE pool = 'train'),
p AS (SELECT {_BINNED} AS bin, * FROM bins, c WHERE pool = 'test'), l AS (SELECT unnest(range(0, len(cuts) + 1)) AS bin FROM c),
k AS (SELECT bin, score, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS f FROM p GROUP BY ALL), b AS (SELECT *, coalesce(sum(r) OVER (PARTITION BY bin ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
u AS (SELECT bin, CASE WHEN sum(r) > 0 AND sum(f) > 0 THEN sum(f * (below + r / 2.0::DOUBLE)) / (sum(r) * sum(f)) END AS auc FROM b GROUP BY bin)
SELECT CAST(l.bin AS INTEGER) AS bin, round(avg(CAST(score < {CUT} AS INTEGER)) FILTER (label = 1), 6) AS fa, round(avg(CAST(score >= {CUT} AS INTEGER)) FILTER (label = 0), 6) AS frr,
 count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake, round(any_value(auc), 6) AS auc FROM l LEFT JOIN p ON p.bin = l.bin LEFT JOIN u ON u.bin = l.bin GROUP BY l.bin""",
    "e15_standardised_rate": f"""WITH {BINS}, c AS (SELECT list_sort(list_distinct(quantile_cont(duration, {LEVELS}))) AS cuts FROM bins), p AS (SELECT {_BINNED} AS bin, * FROM bins, c),
r AS (SELECT arm, bin, avg(CAST(score < {CUT} AS INTEGER)) AS rate FROM p GROUP BY ALL), w AS (SELECT bin, count(*) AS w FROM p WHERE arm = 'F' GROUP BY bin)
SELECT arm, round(sum(w * rate) / sum(w), 6) AS rate, count(*) AS n_bins FROM r JOIN w USING (bin) GROUP BY arm""",
    "e16_ks": f"WITH {SCORES}, src AS (SELECT * FROM scores), {_CURVE} SELECT action, detector, round(max(abs((real_below + real)::DOUBLE / n_real - (fake_below + fake)::DOUBLE / n_fake)), 6) AS ks FROM cum GROUP BY ALL",
    "e17_quantile_ladder": f"""WITH {SCORES}, q AS (SELECT action, label, quantile_cont(score, {M.LADDER}) AS q FROM scores GROUP BY ALL)
SELECT action, label, CAST(i - 1 AS INTEGER) AS step, round(q[i], 6) AS value FROM (SELECT *, unnest(range(1, 12)) AS i FROM q)""",
    "e18_real_fake_comparison": f"{_COMPARED} SELECT * FROM compared",
    "e19_plausibility": f"""{_COMPARED} SELECT *, 'outside' AS rule FROM compared WHERE outside > 0.004::DOUBLE UNION ALL SELECT *, 'distance' FROM compared WHERE distance > 8
UNION ALL SELECT *, 'ratio99' FROM compared WHERE ratio99 NOT BETWEEN 0.05::DOUBLE AND 20""",
    "e23_outside_unit": f"WITH {SCORES} SELECT action, detector, round(avg(CAST(NOT (score > 0 AND score < 1) AS INTEGER)), 6) AS outside, count(*) AS n FROM scores GROUP BY ALL",
    "e24_reconcile": f"""WITH {SCORES}, {_auc('a', 'true')}, {_auc('b', "pool = 'test'")} SELECT action, detector, round(a.auc, 6) AS left_value, round(b.auc, 6) AS right_value, round(abs(a.auc - b.auc), 6) AS gap,
 CASE WHEN a.auc IS NULL THEN 'only_right' WHEN b.auc IS NULL THEN 'only_left' WHEN abs(a.auc - b.auc) > 0.005::DOUBLE THEN 'differs' ELSE 'agrees' END AS cause FROM a FULL JOIN b USING (action, detector)""",
    "e25_reference_box": f"""WITH {SCORES}, x AS (SELECT action, detector, min(score) AS lo, max(score) AS hi FROM scores WHERE label = 0 AND pool = 'train' GROUP BY ALL)
SELECT event_id, action, detector, round((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS scaled FROM scores JOIN x USING (action, detector) WHERE pool = 'test'""",
}
