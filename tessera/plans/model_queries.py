"""Queries of evaluation, preservation and fitted models (W6, M2, M4, M6-M23, A7) and their SQL."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from tessera.functions import physics as P
from tessera.operators import attribution as A
from tessera.operators import evaluate as E
from tessera.operators import model as M
from tessera.operators import prepare as R
from tessera.operators import preserve as V
from tessera.plans.registry import query
from tessera.plans.tables import new_path
from tessera.sources import files

c = F.col
FEATURES = ["lon", "lat", "f1", "f2"]


@query("m09_brier", "fx_score", sql="""
WITH b AS (SELECT sum(weight * pow(probability - label, 2)) / sum(weight) AS b, sum(weight * pow(erosion_m / 997 - label, 2)) / sum(weight) AS a FROM fx_score)
SELECT round(b, 6) AS brier, round(100 * (b - a) / b, 6) AS improvement_pct FROM b""")
def m09(s):
    before, after = E.brier(s), E.brier(s.withColumn("probability", c("erosion_m") / 997))
    both = before.crossJoin(E.improvement_pct(before, after))  # one row each
    return both.select(F.round("brier", 6).alias("brier"), F.round("improvement_pct", 6).alias("improvement_pct"))


@query("m10_calibration_curve", "fx_score", sql="SELECT CAST(greatest(ceil(probability * 20) - 1, 0) AS INT) AS bin, round(avg(label), 6) AS observed, round(avg(probability), 6) AS predicted, CAST(count(*) AS BIGINT) AS n FROM fx_score GROUP BY 1")
def m10(s):
    return E.calibration_curve(s).select("bin", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"), "n")


@query("m11_classification_report", "fx_score", sql="""
WITH k AS (SELECT count(*) FILTER (probability > 0.5 AND label = 1) AS tp, count(*) FILTER (probability > 0.5 AND label = 0) AS fp, count(*) FILTER (probability <= 0.5 AND label = 1) AS fn, count(*) FILTER (probability <= 0.5 AND label = 0) AS tn,
  sum(weight) FILTER (probability > 0.5 AND label = 1) AS a, sum(weight) FILTER (probability > 0.5 AND label = 0) AS b, sum(weight) FILTER (probability <= 0.5 AND label = 1) AS d, sum(weight) FILTER (probability <= 0.5 AND label = 0) AS e FROM fx_score)
SELECT tp, fp, fn, tn, round((a + e) / (a + b + d + e), 6) AS accuracy, round(a / (a + b), 6) AS "precision", round(a / (a + d), 6) AS recall, round(2 * (a / (a + b)) * (a / (a + d)) / (a / (a + b) + a / (a + d)), 6) AS f1 FROM k""")
def m11(s):
    out = E.classification_report(s)
    return out.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


ROC = """s AS (SELECT probability AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM fx_score GROUP BY probability),
r AS (SELECT threshold, sum(pos) OVER w / (SELECT sum(pos) FROM s) AS tpr, sum(neg) OVER w / (SELECT sum(neg) FROM s) AS fpr FROM s WINDOW w AS (ORDER BY threshold DESC))"""


@query("m12_roc_curve", "fx_score", sql=f"WITH {ROC} SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def m12(s):
    return E.roc_curve(s).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("m12_roc_auc", "fx_score", sql=f"""WITH {ROC}, a AS (SELECT fpr - coalesce(lag(fpr) OVER w, 0) AS dx, tpr + coalesce(lag(tpr) OVER w, 0) AS y FROM r WINDOW w AS (ORDER BY threshold DESC)) SELECT round(sum(dx * y / 2), 6) AS auc FROM a""")
def m12_auc(s):
    return E.roc_auc(s).select(F.round("auc", 6).alias("auc"))


def three_classes(s):
    return s.select((c("point_id") % 3).cast("int").alias("kind"), "probability", (c("erosion_m") / 997).alias("s1"), (c("weight") / 3).alias("s2"))


SCORES = {0: "probability", 1: "s1", 2: "s2"}
BY_CLASS = """e AS (SELECT CAST(k AS INT) AS k, CASE k WHEN 0 THEN probability WHEN 1 THEN erosion_m / 997 ELSE weight / 3 END AS s, CAST(point_id % 3 = k AS INT) AS hit FROM fx_score CROSS JOIN range(3) t(k)),
g AS (SELECT k, s, sum(hit) AS pos, sum(1 - hit) AS neg FROM e GROUP BY k, s),
r AS (SELECT k, s, sum(pos) OVER w / (SELECT sum(pos) FROM g h WHERE h.k = g.k) AS tpr, sum(neg) OVER w / (SELECT sum(neg) FROM g h WHERE h.k = g.k) AS fpr FROM g WINDOW w AS (PARTITION BY k ORDER BY s DESC))"""


@query("m12_roc_by_class", "fx_score", sql=f"""WITH {BY_CLASS} SELECT k AS "class", round(s, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r""")
def m12_by_class(s):
    found = E.roc_by_class(three_classes(s), SCORES, "kind")
    return found.select("class", *[F.round(x, 6).alias(x) for x in ("threshold", "tpr", "fpr")])


@query("m12_auc_by_class", "fx_score", sql=f"""WITH {BY_CLASS}, d AS (SELECT k, fpr - coalesce(lag(fpr) OVER w, 0) AS dx, tpr + coalesce(lag(tpr) OVER w, 0) AS y FROM r WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
a AS (SELECT k, sum(dx * y / 2) AS auc FROM d GROUP BY k) SELECT k AS "class", round(auc, 6) AS auc FROM a UNION ALL SELECT NULL, round(avg(auc), 6) FROM a""")
def m12_auc_by_class(s):
    return E.auc_by_class(three_classes(s), SCORES, "kind").withColumn("auc", F.round("auc", 6))


@query("w06_rank_auc", "fx_score", sql="""
WITH r AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS rk FROM fx_score), k AS (SELECT sum(label) AS p, count(*) AS n, sum(label * rk) AS s FROM r)
SELECT round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM k""")
def w06(s):
    return E.rank_auc(s).select(F.round("auc", 6).alias("auc"))


@query("m18_vote_variance", "fx_vote", sql="SELECT point_id, round(var_pop(vote), 6) AS vote_variance FROM fx_vote GROUP BY point_id")
def m18(v):
    return E.vote_variance(v).select("point_id", F.round("vote_variance", 6).alias("vote_variance"))


def basis_sql(x: str, low: float, high: float) -> list[str]:
    """The uniform cubic basis written out piece by piece: u is the place within a span."""
    step = (high - low) / 5
    s = f"least(floor((least(greatest({x}, {low}), {high}) - {low}) / {step}), 4)"
    u = f"((least(greatest({x}, {low}), {high}) - {low}) / {step} - {s})"
    pieces = [f"pow(1 - {u}, 3) / 6", f"(3 * pow({u}, 3) - 6 * pow({u}, 2) + 4) / 6", f"(-3 * pow({u}, 3) + 3 * pow({u}, 2) + 3 * {u} + 1) / 6", f"pow({u}, 3) / 6"]
    return ["CASE " + " ".join(f"WHEN {s} = {k - i} THEN {pieces[i]}" for i in range(4)) + " ELSE 0.0 END" for k in range(8)]


LOW, HIGH, COEF = 1.5, 3.5, [0.4, -0.2, 0.9, 1.3, 0.1, -0.6, 0.2, 0.5]
BASIS = basis_sql("log10(erosion_m + 50)", LOW, HIGH)


@query("m19_spline_basis", "fx_score", sql="SELECT point_id, " + ", ".join(f"round({b}, 5) AS b{k}" for k, b in enumerate(BASIS)) + " FROM fx_score")
def m19(s):
    return s.select("point_id", *[F.round(b, 5).alias(f"b{k}") for k, b in enumerate(V.bspline_basis(V.transform(c("erosion_m")), LOW, HIGH))])


LINEAR = "(-0.3 + " + " + ".join(f"({b}) * {k}" for b, k in zip(BASIS, COEF)) + ")"
FIT = V.Preservation(LOW, HIGH, COEF, -0.3, (-0.5, 0.8))


@query("m20_score_preservation", "fx_score", sql=f"SELECT point_id, round(least(greatest(({LINEAR} + 0.5) / 1.3, 0.0), 1.0), 5) AS score FROM fx_score")
def m20(s):
    return s.select("point_id", F.round(FIT.score(c("erosion_m")), 5).alias("score"))


@query("m22_score_summary", "fx_score")
def m22(s):
    return V.score_summary(s.sparkSession, V.fit_preservation(R.exclude_zero(s, "erosion_m")))


GIVEN = LINEAR.replace("log10(erosion_m + 50)", f"least(greatest(log10(e.erosion_m + 50), {LOW!r}), {HIGH - 1e-9!r})")


@query("m22_score_summary_given", "fx_score", sql=f"""
SELECT e.erosion_m, round(least(greatest(({GIVEN} + 0.5) / 1.3, 0.0), 1.0), 5) AS preservation_score, count(s.point_id) AS n
FROM (VALUES {', '.join(f'(CAST({x!r} AS DOUBLE))' for x in V.SUMMARY)}) e(erosion_m) LEFT JOIN fx_score s ON s.erosion_m <= e.erosion_m GROUP BY e.erosion_m""")
def m22_given(s):
    """The summary of a given fit, with how many rows have at most that erosion."""
    steps = V.score_summary(s.sparkSession, FIT)
    first = F.array_min(F.filter(F.array(*map(F.lit, V.SUMMARY)), lambda x: x >= c("erosion_m")))
    counts = s.groupBy(first.alias("first")).agg(F.count("*").alias("m")).where("first is not null")
    both = steps.join(counts, c("first") <= c("erosion_m"), "left")  # eleven rows each
    out = both.groupBy("erosion_m", "preservation_score").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    return out.select("erosion_m", F.round("preservation_score", 5).alias("preservation_score"), "n")


@query("m19_fit_preservation", "fx_score")
def m19_fit(s):
    fit = V.fit_preservation(R.exclude_zero(s, "erosion_m"))
    return s.select("point_id", "age", fit.score(c("erosion_m")).alias("score"))


@query("m21_held_out_auc", "fx_score")
def m21(s):
    mean, std = V.held_out_auc(R.exclude_zero(s, "erosion_m"), n=25)
    return s.agg(F.count("*").alias("n")).select("n", F.lit(mean).alias("mean_auc"), F.lit(std).alias("std_auc"))


@query("m21_areas_given", "fx_score", sql=f"""
WITH q AS (SELECT age, label, round(least(greatest(({LINEAR} + 0.5) / 1.3, 0.0), 1.0), 9) AS s FROM fx_score),
r AS (SELECT age, label, rank() OVER (PARTITION BY age ORDER BY s) + (count(*) OVER (PARTITION BY age, s) - 1) / 2.0 AS rk FROM q), k AS (SELECT age, sum(label) AS p, count(*) AS n, sum(label * rk) AS s FROM r GROUP BY age)
SELECT age, round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM k""")
def m21_areas(s):
    """Areas of a given fit by age, all from one pass."""
    scored = s.withColumn("probability", F.round(FIT.score(c("erosion_m")), 9))
    return V.split_areas(scored, "age").select("age", F.round("auc", 6).alias("auc"))


_B = ["1.0", *[f"b{k}" for k in range(8)]]
_SUMS = [f"round(sum((label - p) * {b}), 4) AS g{i}" for i, b in enumerate(_B)] + [f"round(sum(p * (1 - p) * {_B[i]} * {_B[k]}), 4) AS h{i}{k}" for i in range(9) for k in range(i, 9)]


@query("m19_newton_sums", "fx_score", sql=f"""
WITH b AS (SELECT age, label, {', '.join(f'{b} AS b{k}' for k, b in enumerate(BASIS))} FROM fx_score),
q AS (SELECT *, 1 / (1 + exp(-(-0.3 + {' + '.join(f'b{k} * {x}' for k, x in enumerate(COEF))}))) AS p FROM b)
SELECT age, count(*) AS n, {', '.join(_SUMS)} FROM q GROUP BY age""")
def m19_sums(s):
    """Gradient and curvature of the likelihood at given coefficients, of all ages by one aggregation."""
    rows = s.select("age", V.transform(c("erosion_m")).alias("x"), c("label").alias("y"))
    given = s.sparkSession.createDataFrame([(k, LOW, HIGH, [-0.3, *COEF]) for k in range(5)], "age int, low double, high double, w array<double>")
    found = V.newton_sums(rows, given, "age")
    return found.select("age", "n", *[F.round(x, 4).alias(x) for x in found.columns if x not in ("age", "n")])


def training(p):
    return R.impute_median(p, ["f2"]).select("point_id", "age", "weight", "label", *FEATURES)


def forest(p):
    rows = training(p)
    return rows, M.fit_forest(rows, FEATURES, trees=5, depth=4)


@query("a07_save_load_model", "fx_point")
def a07(p):
    rows, model = forest(p)
    path = new_path(p.sparkSession, "model")
    files.save_model(model, path)
    return M.probability(rows, files.load_model(RandomForestClassificationModel, path), FEATURES).select("point_id", "probability")


@query("m02_impute_iterative", "fx_point")
def m02(p):
    return M.impute_iterative(p.select("point_id", "age", "lon", "lat", "f1", "f2"), ["f2"], ["lon", "lat", "f1"], trees=3).select("point_id", "f2")


@query("m04_pu_bagging", "fx_point")
def m04(p):
    return M.pu_bagging(training(p), FEATURES, bags=3, depth=3)


@query("m06_tune", "fx_point")
def m06(p):
    rows = training(p)
    _, scores = M.tune(rows, FEATURES, settings=4, folds=2, rungs=2)
    return scores.crossJoin(rows.agg(F.count("*").alias("n")))  # one row of counts beside six scores


@query("m07_fit_forest", "fx_point")
def m07(p):
    rows, model = forest(p)
    return M.probability(rows, model, FEATURES).select("point_id", "label", "probability")


@query("m08_calibrate_isotonic", "fx_score", sql="""
WITH s AS (SELECT probability AS p, sum(weight) AS w, sum(weight * label) AS y FROM fx_score GROUP BY probability),
q AS (SELECT p, w, y, row_number() OVER (ORDER BY p) AS i, sum(w) OVER (ORDER BY p) AS cw, sum(y) OVER (ORDER BY p) AS cy FROM s),
m AS (SELECT a.i AS a, b.i AS i, min((b.cy - a.cy + a.y) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM q a JOIN q b ON a.i <= b.i),
f AS (SELECT i, max(low) AS calibrated FROM m GROUP BY i)
SELECT point_id, probability, round(calibrated, 6) AS calibrated FROM fx_score JOIN q ON q.p = probability JOIN f USING (i)""")
def m08(s):
    """Spark pools violators in ranges of scores, then the blocks of all ranges; SQL has the min-max formula."""
    return M.calibrate_isotonic(s).transform(s).select("point_id", "probability", F.round("calibrated", 6).alias("calibrated"))


@query("m13_gini_importance", "fx_point")
def m13(p):
    return M.gini_importance(training(p), FEATURES, folds=2, trees=3)


@query("m14_permutation_importance", "fx_point")
def m14(p):
    return M.permutation_importance_cv(training(p), FEATURES, folds=2, repeats=1, trees=5, depth=4)


@query("m15_partial_dependence", "fx_point")
def m15(p):
    rows, model = forest(p)
    return M.partial_dependence(rows, model, FEATURES, "f1", 5)


@query("m16_shapley", "fx_point")
def m16(p):
    rows, model = forest(p)
    return A.tree_attributions(rows, rows, A.forest_leaves(model), FEATURES, weight="weight")


@query("m16_shapley_cv", "fx_point")
def m16_cv(p):
    return A.attributions_cv(training(p), FEATURES, folds=5, repeats=1, trees=5, depth=4)


UP, DOWN = float("inf"), -float("inf")
#: Two small trees over the four features, each worth a half.
GIVEN_LEAVES = [
    A.leaf(0.1, {0: (DOWN, 10.0), 2: (DOWN, 150000.0)}), A.leaf(0.35, {0: (DOWN, 10.0), 2: (150000.0, UP)}), A.leaf(0.2, {0: (10.0, UP), 1: (DOWN, 0.0)}), A.leaf(0.45, {0: (10.0, UP), 1: (0.0, UP)}),
    A.leaf(0.05, {3: (DOWN, 50.0)}), A.leaf(0.3, {3: (50.0, UP), 0: (DOWN, 10.0)}), A.leaf(0.15, {3: (50.0, UP), 0: (10.0, UP)}),
]
_MIX = "((x.k & s.s) | (z.k & (15 - s.s)))"


@query("m16_shapley_given", "fx_point", sql=f"""
WITH p AS (SELECT point_id, weight, CAST(lon <= 10 AS INT) + 2 * CAST(lat <= 0 AS INT) + 4 * CAST(f1 <= 150000 AS INT) + 8 * CAST(coalesce(f2 <= 50, false) AS INT) AS k FROM fx_point),
z AS (SELECT k, sum(weight) / (SELECT sum(weight) FROM p) AS w FROM p GROUP BY k),
v AS (SELECT x.k AS x, s.s, sum(z.w * ((CASE WHEN {_MIX} & 1 = 1 THEN CASE WHEN {_MIX} & 4 = 4 THEN 0.1 ELSE 0.35 END ELSE CASE WHEN {_MIX} & 2 = 2 THEN 0.2 ELSE 0.45 END END)
  + (CASE WHEN {_MIX} & 8 = 8 THEN 0.05 WHEN {_MIX} & 1 = 1 THEN 0.3 ELSE 0.15 END))) AS v FROM (SELECT DISTINCT k FROM p) x CROSS JOIN (SELECT CAST(s AS INT) AS s FROM range(16) r(s)) s CROSS JOIN z GROUP BY ALL),
a AS (SELECT v.x, i.i, sum((CASE bit_count(v.s) WHEN 0 THEN 1.0 / 4 WHEN 3 THEN 1.0 / 4 ELSE 1.0 / 12 END) * (u.v - v.v)) AS a FROM v JOIN (SELECT CAST(i AS INT) AS i FROM range(4) r(i)) i ON (v.s >> i.i) & 1 = 0 JOIN v u ON u.x = v.x AND u.s = v.s | (1 << i.i) GROUP BY ALL)
SELECT point_id, CASE i WHEN 0 THEN 'lon' WHEN 1 THEN 'lat' WHEN 2 THEN 'f1' ELSE 'f2' END AS feature, round(CAST(a AS DOUBLE), 6) + 0.0 AS attribution FROM p JOIN a ON a.x = p.k""")
def m16_given(p):
    """Attributions of a given forest's score against all points, by the definition over sets of features."""
    found = A.tree_attributions(p, p, GIVEN_LEAVES, FEATURES, weight="weight")
    return found.select("point_id", "feature", (F.round("attribution", 6) + 0.0).alias("attribution"))


@query("m17_score_points", "fx_point")
def m17(p):
    rows, model = forest(p)
    isotonic = M.calibrate_isotonic(M.probability(rows, model, FEATURES))
    return M.score_points(rows, model, isotonic, FEATURES)


@query("m23_fit_slab_dip", "fx_trench")
def m23(t):
    d = {"obliquity": c("obliquity_deg"), "conv_rate": c("conv_rate_cm_yr"), "conv_rate_orth": c("conv_rate_orth_cm_yr"), "trench_vel_orth": c("spreading_km_myr") / 100, "plate_vel": c("obliquity_deg"), "spreading": c("spreading_km_myr"), "age": c("seafloor_age_myr"), "thickness": c("seafloor_age_myr") * 700}
    names = P.slab_dip_predictors(d)
    rows = t.select("trench_id", c("slab_dip_deg").alias("known_dip"), *[v.alias(k) for k, v in names.items()])
    fitted = M.fit_slab_dip(rows, list(names), "known_dip").transform(M.with_vector(rows, list(names)))
    return fitted.select("trench_id", "slab_dip_deg", P.arc_trench_distance(c("slab_dip_deg")).alias("arc_trench_distance_km"))
