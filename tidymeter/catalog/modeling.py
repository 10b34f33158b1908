"""Queries of the modeling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter.catalog import inputs  # noqa: F401
from tidymeter.catalog.base import VIEWS, duck, register, table, view
from tidymeter.catalog.similarity import _CLUSTERS, tokens
from tidymeter.modeling import domain, folds, scores, selection, targets, training

# One row per order: price against quantity, discount and tax, grouped by supplier.
VIEWS["order_model"] = """
SELECT CAST(l_orderkey AS STRING) AS CID, min(l_suppkey) AS grp, sum(l_quantity) AS qty, sum(l_discount) AS disc,
  sum(l_tax) AS tax, sum(l_quantity) * 2 + 1 AS twice, sum(1.0E0) AS lines, max(7.0E0) AS fixed,
  CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE max(l_discount) END AS gappy,
  sum(l_extendedprice) AS y
FROM {lineitem} GROUP BY l_orderkey
"""
VIEWS["target_values"] = """
SELECT 'T' || CAST(l_linenumber AS STRING) AS target, CASE l_linenumber WHEN 1 THEN l_extendedprice - 30000
  WHEN 2 THEN pow(10, l_quantity / 8) WHEN 3 THEN l_tax ELSE l_extendedprice END AS y, l_orderkey FROM {lineitem}
"""
VIEWS["method_results"] = """
SELECT l_returnflag AS target, CASE l_linestatus WHEN 'F' THEN 'with_block' ELSE 'without_block' END AS block,
  'm' || CAST(l_linenumber AS STRING) AS method,
  CASE WHEN l_returnflag <> 'R' OR l_linestatus <> 'F' THEN avg(l_tax) END AS cv_r2_grouped FROM {lineitem}
GROUP BY l_returnflag, l_linestatus, l_linenumber
"""

_FEATURES = ["qty", "disc", "tax", "twice", "lines", "fixed"]


def model_rows(spark, sf, features=("qty",)):
    rows = view(spark, sf, "order_model").select("CID", "grp", "y", *features)
    return training.with_vectors(rows, list(features), ["CID", "grp", "y"])


@register(
    "m01_decide_transforms",
    f"""SELECT *, CASE WHEN n >= 30 AND min > 0 AND high / low >= 1000 THEN 'log10' ELSE 'identity' END AS transform FROM (
      SELECT target, count(*) AS n, quantile_cont(y, 0.05) AS low, quantile_cont(y, 0.95) AS high, min(y) AS min
      FROM {duck('target_values')} GROUP BY target)""",
    "low,high,min",
    digits=3,
)
def m01(spark, sf):
    return targets.decide_transforms(view(spark, sf, "target_values"))


_TARGETS = [
    "ChEMBL:MIC [Bacillus]", "ChEMBL:MIC [Proteus]", "ChEMBL:IC50 [Giardia]", "ChEMBL:Ki [HeLa]",
    "ChEMBL:Potency [x]",
]


@register(
    "m02_to_target_long",
    " UNION ALL ".join(
        f"""SELECT CID, MW, LogP, '{t}' AS target, "{t}" AS y FROM {duck('wide')} WHERE "{t}" IS NOT NULL"""
        for t in _TARGETS
    ),
    "MW,LogP,y",
)
def m02(spark, sf):
    wide = view(spark, sf, "wide")
    features, names = targets.classify_columns(wide)
    return targets.to_target_long(wide, ["CID", *[c for c in features if c != "Rare"]], names)


@register(
    "m03_select_targets",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS target, count("{t}") AS n, count("{t}") / count(*) AS coverage FROM {duck('wide')}"""
        for t in _TARGETS
    )
    + ") WHERE coverage >= 0.05",
    "coverage",
)
def m03(spark, sf):
    return targets.select_targets(view(spark, sf, "wide"), 0.05)


_RANDOM = """SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY
    md5(concat_ws('|', o_orderkey, '42')), o_orderkey) - 1) % least(5, greatest(2, count(*) OVER (PARTITION BY o_orderpriority) // 10)) AS fold
  FROM orders"""


@register("m04_random_folds", _RANDOM)
def m04(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return folds.random_folds(rows, "o_orderkey", ["o_orderpriority"])


@register(
    "m04_random_folds_all",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) - 1)
      % least(5, greatest(2, (SELECT count(*) FROM orders) // 10)) AS fold FROM orders""",
    ints="fold",
)
def m04_all(spark, sf):
    return folds.random_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def _greedy(src: str, group: str, k: str) -> str:
    """Largest-first assignment of groups to the lightest fold, one group per step."""
    return f"""sized AS (SELECT {group} AS g, count(*) AS c FROM {src} GROUP BY 1),
      queue AS (SELECT g, c, row_number() OVER (ORDER BY c DESC, md5(CAST(g AS VARCHAR)), g) AS i FROM sized),
      kk AS (SELECT {k} AS k FROM {src}),
      step(i, loads, g, fold) AS (SELECT 0::BIGINT, list_transform(range((SELECT k FROM kk)), lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT
        UNION ALL SELECT q.i, list_transform(range(len(loads)), lambda j: loads[j + 1] + CASE WHEN j + 1 = list_position(loads, list_min(loads)) THEN q.c ELSE 0 END),
          q.g, list_position(loads, list_min(loads)) - 1 FROM step s JOIN queue q ON q.i = s.i + 1),
      gfold AS (SELECT g, fold FROM step WHERE i > 0)"""


_K = "least(5, greatest(3, count(*) // 10), count(DISTINCT grp))"


@register(
    "m05_group_folds",
    f"""WITH RECURSIVE src AS (SELECT * FROM {duck('order_model')}), {_greedy('src', 'grp', _K)}
    SELECT CID, grp, fold FROM src JOIN gfold ON g = grp""",
    ints="fold",
)
def m05(spark, sf):
    return folds.group_folds(view(spark, sf, "order_model").select("CID", "grp"), "grp")


@register(
    "m05_group_folds_many",
    f"""WITH RECURSIVE src AS (SELECT o_orderkey, o_custkey FROM orders), {_greedy('src', 'o_custkey', '7')}
    SELECT o_orderkey, o_custkey, fold FROM src JOIN gfold ON g = o_custkey""".replace("SELECT 7 AS k FROM src", "SELECT 7 AS k"),
    ints="fold",
)
def m05_many(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.group_folds(rows, "o_custkey", folds=7)


@register(
    "m06_repeated_group_folds",
    """SELECT o_orderkey, r.o_custkey, r.repeat, fold FROM orders o JOIN (SELECT o_custkey, repeat,
      (row_number() OVER (PARTITION BY repeat ORDER BY md5(concat_ws('|', repeat, o_custkey)), o_custkey) - 1) % 4 AS fold
      FROM (SELECT DISTINCT o_custkey FROM orders), range(3) AS t(repeat)) r ON r.o_custkey = o.o_custkey""",
)
def m06(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.repeated_group_folds(rows, "o_custkey", 4, 3)


_RANDOM_ALL = """SELECT *, (row_number() OVER (ORDER BY md5(concat_ws('|', CID, '42')), CID) - 1)
  % least(5, greatest(2, count(*) OVER () // 10)) AS fold FROM src"""


def _linear_cv(src: str) -> str:
    """Mean and spread of fold scores of a one-feature regression; src has qty, y, fold."""
    return f"""SELECT avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std, count(*) AS cv_folds FROM (
      SELECT t.fold, 1 - sum((t.y - (a + b * t.qty)) ** 2) / regr_syy(t.y, t.y) AS r2 FROM {src} t JOIN (
        SELECT f.fold, regr_intercept(y, qty) AS a, regr_slope(y, qty) AS b FROM {src} s
        JOIN (SELECT DISTINCT fold FROM {src}) f ON f.fold <> s.fold GROUP BY f.fold) m USING (fold) GROUP BY t.fold)"""


@register(
    "m07_cv_r2",
    f"WITH src AS (SELECT * FROM {duck('order_model')}), rf AS ({_RANDOM_ALL}) {_linear_cv('rf')}",
    "cv_r2_mean,cv_r2_std",
    digits=6,
)
def m07(spark, sf):
    return scores.cv_r2(training.random_cv(model_rows(spark, sf), training.linear, "CID"))


_BOTH = ["cv_r2_random", "cv_r2_random_std", "cv_r2_grouped", "cv_r2_grouped_std", "cv_r2_mean", "cv_r2_std"]


@register(
    "m08_evaluate",
    f"""WITH RECURSIVE src AS (SELECT * FROM {duck('order_model')}), rf AS ({_RANDOM_ALL}), {_greedy('src', 'grp', _K)},
    gf AS (SELECT src.*, fold FROM src JOIN gfold ON g = grp), r AS ({_linear_cv('rf')}), c AS ({_linear_cv('gf')})
    SELECT (SELECT count(*) FROM src) AS n_samples, (SELECT count(DISTINCT grp) FROM src) AS n_groups,
      r.cv_r2_mean AS cv_r2_random, r.cv_r2_std AS cv_r2_random_std, c.cv_r2_mean AS cv_r2_grouped, c.cv_r2_std AS cv_r2_grouped_std,
      c.cv_folds, c.cv_r2_mean, c.cv_r2_std, 'grouped' AS cv_method, true AS reliable, '' AS reliability_note FROM r, c""",
    ",".join(_BOTH),
    digits=6,
)
def m08(spark, sf):
    return training.evaluate(model_rows(spark, sf), training.linear, "CID", "grp")


def two_targets(spark, sf):
    rows = view(spark, sf, "order_model")
    return rows.withColumns({"IC50 a": F.col("y"), "IC50 b": F.when(F.col("tax") > 0.1, F.pow(F.lit(10.0), F.col("qty") / 50))})


# The trained queries run with the operators' own defaults: trees, folds, trials, methods and targets.
# Queries over several tables of one training share it.
_DONE: dict = {}


def once(spark, sf, name, work):
    place = (spark.sparkContext.applicationId, sf, name)
    if place not in _DONE:
        _DONE[place] = work()
    return _DONE[place]


def _trained(spark, sf):
    rows = two_targets(spark, sf)
    return once(spark, sf, "m09", lambda: training.train_targets(rows, ["IC50 a", "IC50 b"], ["qty", "disc", "gappy"], "CID", "grp"))


@register("m09_train_targets")
def m09(spark, sf):
    return _trained(spark, sf)[0]


@register("m09_importances")
def m09_importances(spark, sf):
    return _trained(spark, sf)[1]


@register(
    "m09_cluster_folds",
    f"""WITH {_CLUSTERS}, src AS (SELECT doc_id, cluster AS grp FROM label), {_greedy('src', 'grp', _K).replace('NULL::BIGINT, NULL', 'NULL::VARCHAR, NULL')}
    SELECT doc_id, grp AS cluster, fold FROM src JOIN gfold ON g = grp""",
    ints="fold",
)
def m09_cluster_folds(spark, sf):
    return training.cluster_folds(tokens(spark, sf), "doc_id", "words")


@register("m09_cluster_training")
def m09_clusters(spark, sf):
    words = tokens(spark, sf).withColumn("n_words", F.size("words"))
    rows = words.join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").where("n_words > 0")
    rows = rows.withColumn("IC50 length", F.col("n_chars") / F.col("n_words"))
    params = training.TrainingParams(cv_strategy="cluster")
    return training.train_targets(rows, ["IC50 length"], ["n_chars", "n_words"], "doc_id", tp=params, tokens="words")[0]


def _legacy(target: str, y: str, where: str) -> str:
    """Cross-validated and in-sample scores of a regression on three features, solved by Cramer's rule."""
    return f"""SELECT '{target}' AS target, n_samples, cv_r2_mean, cv_r2_std, train_r2, train_rmse, train_mae FROM (
      WITH src AS (SELECT CID, qty, disc, tax, log10(greatest({y}, 1e-12)) AS y FROM {duck('order_model')} WHERE {where}),
      n AS (SELECT count(*) AS n FROM src),
      rf AS (SELECT src.*, (row_number() OVER (ORDER BY md5(concat_ws('|', CID, '42')), CID) - 1) % least(least(5, greatest(3, n // 10)), greatest(2, n // 10)) AS fold FROM src, n),
      sets AS (SELECT DISTINCT fold AS held FROM rf UNION ALL SELECT -1),
      c AS (SELECT held, avg(qty) AS mx, avg(disc) AS mz, avg(tax) AS mw, avg(y) AS my, var_pop(qty) AS a, covar_pop(qty, disc) AS b,
        covar_pop(qty, tax) AS c, var_pop(disc) AS d, covar_pop(disc, tax) AS e, var_pop(tax) AS f, covar_pop(qty, y) AS p,
        covar_pop(disc, y) AS q, covar_pop(tax, y) AS r FROM rf JOIN sets ON held <> fold GROUP BY held),
      m AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c),
      k AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS k1,
        (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q)) / det AS k2,
        (a * (d * r - q * e) - b * (b * r - c * q) + p * (b * e - c * d)) / det AS k3 FROM m),
      t AS (SELECT held, y, my + k1 * (qty - mx) + k2 * (disc - mz) + k3 * (tax - mw) AS g FROM rf JOIN k ON held = fold OR held = -1),
      s AS (SELECT held, 1 - sum((y - g) ** 2) / regr_syy(y, y) AS r2, sqrt(avg((y - g) ** 2)) AS rmse, avg(abs(y - g)) AS mae FROM t GROUP BY held)
      SELECT (SELECT n FROM n) AS n_samples, avg(r2) FILTER (held >= 0) AS cv_r2_mean, stddev_pop(r2) FILTER (held >= 0) AS cv_r2_std,
        max(r2) FILTER (held < 0) AS train_r2, max(rmse) FILTER (held < 0) AS train_rmse, max(mae) FILTER (held < 0) AS train_mae FROM s)"""


@register(
    "m10_train_targets_legacy",
    _legacy("IC50 a", "y", "true") + " UNION ALL " + _legacy("IC50 b", "pow(10.0, qty / 50)", "tax > 0.1"),
    "cv_r2_mean,cv_r2_std,train_r2,train_rmse,train_mae",
    digits=5,
)
def m10(spark, sf):
    return training.train_targets_legacy(
        two_targets(spark, sf), ["IC50 a", "IC50 b"], ["qty", "disc", "tax"], "CID", training.linear
    )


def _name_rows(spark, names):
    return spark.createDataFrame([(c, i) for i, c in enumerate(names)], "feature string, position int")


@register(
    "m11_variance_filter",
    f"""SELECT feature, row_number() OVER (ORDER BY p) - 1 AS position FROM (
      SELECT unnest(['qty', 'disc', 'tax', 'twice', 'lines', 'fixed']) AS feature, unnest([1, 2, 3, 4, 5, 6]) AS p,
        unnest([var_samp(qty), var_samp(disc), var_samp(tax), var_samp(twice), var_samp(lines), var_samp(fixed)]) AS v
      FROM {duck('order_model')}) WHERE v >= 0.01""",
)
def m11(spark, sf):
    rows = view(spark, sf, "order_model")
    return _name_rows(spark, selection.variance_filter(rows, _FEATURES, 0.01))


@register(
    "m12_correlation_filter",
    f"""WITH c AS (SELECT corr(qty, disc) AS qd, corr(qty, tax) AS qt, corr(disc, tax) AS dt, corr(qty, twice) AS qw,
      corr(disc, twice) AS dw, corr(tax, twice) AS tw, corr(qty, lines) AS ql, corr(disc, lines) AS dl, corr(tax, lines) AS tl,
      corr(twice, lines) AS wl, corr(qty, gappy) AS qg, corr(disc, gappy) AS dg, corr(tax, gappy) AS tg, corr(twice, gappy) AS wg,
      corr(lines, gappy) AS lg FROM {duck('order_model')}),
    k AS (SELECT unnest(['qty', 'disc', 'tax', 'twice', 'lines', 'gappy']) AS feature, unnest([1, 2, 3, 4, 5, 6]) AS p,
      unnest([0, abs(qd), greatest(abs(qt), abs(dt)), greatest(abs(qw), abs(dw), abs(tw)), greatest(abs(ql), abs(dl), abs(tl), abs(wl)),
        greatest(abs(qg), abs(dg), abs(tg), abs(wg), abs(lg))]) AS top FROM c)
    SELECT feature, row_number() OVER (ORDER BY p) - 1 AS position FROM k WHERE top <= 0.8""",
)
def m12(spark, sf):
    rows = view(spark, sf, "order_model")
    names = ["qty", "disc", "tax", "twice", "lines", "gappy"]
    return _name_rows(spark, selection.correlation_filter(rows, names, 0.8))


_FILLED = f"""SELECT qty, disc, tax, lines, y, coalesce(gappy, (SELECT median(gappy) FROM {duck('order_model')})) AS gappy
  FROM {duck('order_model')}"""
_F_SCORES = f"""SELECT feature, r * r * (n - 2) / (1 - r * r) AS score FROM (SELECT count(*) AS n,
  unnest(['qty', 'disc', 'tax', 'lines', 'gappy']) AS feature, unnest([corr(qty, y), corr(disc, y), corr(tax, y), corr(lines, y), corr(gappy, y)]) AS r
  FROM ({_FILLED}))"""


@register("m13_f_scores", _F_SCORES, "score", digits=3)
def m13(spark, sf):
    return selection.f_scores(view(spark, sf, "order_model"), ["qty", "disc", "tax", "lines", "gappy"], "y")


_EDGE = "len(list_filter((SELECT quantile_cont({c}, [" + ", ".join(f"{i}/8.0" for i in range(1, 8)) + "]) FROM src), lambda e: e < {c}))"


@register(
    "m13_mutual_information",
    f"""WITH src AS (SELECT qty, lines, y FROM {duck('order_model')}),
    b AS (SELECT {_EDGE.format(c='qty')} AS q, {_EDGE.format(c='lines')} AS l, {_EDGE.format(c='y')} AS y FROM src),
    j AS (SELECT 'qty' AS feature, q AS x, y, count(*) AS c FROM b GROUP BY ALL UNION ALL SELECT 'lines', l, y, count(*) FROM b GROUP BY ALL),
    m AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, x) AS cx,
      sum(c) OVER (PARTITION BY feature, y) AS cy FROM j)
    SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS score FROM m GROUP BY feature""",
    "score",
    digits=5,
)
def m13_mi(spark, sf):
    return selection.mutual_information(view(spark, sf, "order_model"), ["qty", "lines"], "y", bins=8)


@register("m14_relevance_model")
def m14(spark, sf):
    return selection.model_scores(view(spark, sf, "order_model"), ["qty", "disc", "tax", "gappy"], "y")


@register(
    "m15_select_features",
    f"SELECT feature, row_number() OVER (ORDER BY score DESC, feature) - 1 AS position FROM ({_F_SCORES}) WHERE feature <> 'lines' ORDER BY score DESC LIMIT 2",
)
def m15(spark, sf):
    params = selection.SelectionParams("univariate", 2, "f_regression", 1e-6, 0.85)
    kept, _ = selection.select_features(
        view(spark, sf, "order_model"), ["qty", "disc", "tax", "twice", "fixed", "gappy"], "y", params
    )
    return _name_rows(spark, kept)


def _benchmark(spark, sf):
    params = selection.SelectionParams("univariate", 2, "f_regression", 1e-6, 0.9)
    blocks = {"without_block": ["qty", "fixed"], "with_block": ["qty", "fixed", "disc", "lines"]}
    return once(
        spark, sf, "m16",
        lambda: training.selection_benchmark(two_targets(spark, sf), "IC50 a", blocks, "CID", "grp", selection=params),
    )


@register("m16_selection_benchmark")
def m16(spark, sf):
    return _benchmark(spark, sf)[0]


@register("m16_relevance")
def m16_relevance(spark, sf):
    return _benchmark(spark, sf)[1]


@register(
    "m17_best_method",
    f"""WITH r AS (SELECT * FROM {duck('method_results')}), p AS (SELECT *, bool_or(block = 'with_block') OVER (PARTITION BY target) AS has FROM r)
    SELECT target, CASE WHEN cv_r2_grouped IS NOT NULL THEN method END AS best_method
    FROM p WHERE (has AND block = 'with_block') OR NOT has
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY cv_r2_grouped DESC NULLS LAST, method DESC) = 1""",
)
def m17(spark, sf):
    return training.best_method(view(spark, sf, "method_results"))


def _ablated(spark, sf):
    block = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("CID"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total")
    )
    rows = two_targets(spark, sf)
    return once(spark, sf, "m18", lambda: training.ablate_block(rows, "IC50 a", ["qty", "disc"], block, "CID", "grp"))


@register("m18_ablate_block")
def m18(spark, sf):
    return _ablated(spark, sf)[0]


@register("m18_block_importances")
def m18_importances(spark, sf):
    return _ablated(spark, sf)[1]


@register(
    "m19_conformal",
    """SELECT count(*) AS n, quantile_cont(abs(l_extendedprice - 1500 * l_quantity), 0.8) AS halfwidth, 0.8 AS level FROM lineitem""",
    "halfwidth,level",
    digits=4,
)
def m19(spark, sf):
    preds = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return scores.conformal(preds, 0.2)


@register(
    "m20_scrambled",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders),
    b AS (SELECT o_totalprice AS y, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, '3')), o_orderkey) AS k FROM orders)
    SELECT o_orderkey, y FROM a JOIN b USING (k)""",
    "y",
)
def m20(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    return scores.scrambled(rows, "o_orderkey", seed=3)


@register("m20_y_scramble")
def m20_control(spark, sf):
    return training.y_scramble(model_rows(spark, sf), training.boosted_trees(training.TrainingParams()), "CID")


def _brute(train: str, new: str, key: str, exclude: bool, k: int = 5) -> str:
    """Mean distance to the k nearest rows by comparing all pairs; sources have key, a, b."""
    self_ = f"WHERE q.{key} <> t.{key}" if exclude else ""
    return f"""SELECT {key}, avg(d) AS mean_distance FROM (SELECT q.{key}, sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS d,
      row_number() OVER (PARTITION BY q.{key} ORDER BY (q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS rn FROM {new} q, {train} t {self_})
      WHERE rn <= {k} GROUP BY {key}"""


_CUST = "(SELECT c_custkey AS id, c_acctbal / 100 AS a, c_nationkey::DOUBLE AS b FROM customer)"
_SUPP = "(SELECT s_suppkey AS sid, s_acctbal / 100 AS a, s_nationkey::DOUBLE AS b FROM supplier)"


def _points(spark, sf, name, p):
    return table(spark, sf, name).select(
        F.col(f"{p}key").alias("id") if p == "c_cust" else F.col("s_suppkey").alias("id"),
        (F.col("c_acctbal" if p == "c_cust" else "s_acctbal") / 100).alias("a"),
        F.col("c_nationkey" if p == "c_cust" else "s_nationkey").alias("b"),
    )


@register(
    "m21_fit_domain",
    f"""SELECT quantile_cont(mean_distance, 0.95) AS threshold, 5 AS k, count(*) AS "rows" FROM ({_brute(_CUST, _CUST, 'id', True)})""",
    "threshold",
    "k",
    digits=6,
)
def m21(spark, sf):
    return domain.fit_domain(_points(spark, sf, "customer", "c_cust"), ["a", "b"])[1]


@register(
    "m22_in_domain",
    f"""SELECT id, mean_distance, mean_distance <= 12.5 AS in_domain FROM (SELECT id, avg(d) AS mean_distance FROM (
      SELECT id, sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS d, row_number() OVER (PARTITION BY id
        ORDER BY (q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS rn FROM {_CUST} q, {_SUPP} t) WHERE rn <= 5 GROUP BY id)""",
    "mean_distance",
    digits=6,
)
def m22(spark, sf):
    train, new = _points(spark, sf, "supplier", "s_supp"), _points(spark, sf, "customer", "c_cust")
    return domain.in_domain(train, new, ["a", "b"], 12.5).drop("a", "b")


def _searched(spark, sf):
    return once(spark, sf, "m23", lambda: training.search(two_targets(spark, sf), "IC50 a", ["qty", "disc"], "CID", "grp"))


@register("m23_search")
def m23(spark, sf):
    return _searched(spark, sf)["folds"]


@register("m23_history")
def m23_history(spark, sf):
    return _searched(spark, sf)["history"]


def _job(spark, sf):
    structures = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("CID"), F.col("c_mktsegment").alias("SMILES")
    )
    return once(spark, sf, "m24", lambda: training.training_job(view(spark, sf, "wide"), structures, group="SMILES"))


@register("m24_training_job")
def m24(spark, sf):
    return _job(spark, sf)["report"]


@register("m24_importances")
def m24_importances(spark, sf):
    return _job(spark, sf)["importance"]
