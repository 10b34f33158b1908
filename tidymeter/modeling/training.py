"""Per-target training, validation, ablation and search.

Boosted trees run as one job per cross-validation, one task per fit (``boosting``),
and by MLlib's row-parallel training for targets beyond that bound; any other
estimator on ``x`` and ``y`` can be passed as a factory. Targets, blocks and
selection methods are independent, so a few of them run side by side.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import numeric as N
from tidymeter.modeling import folds as K, scores as S, selection as Sel, targets as T
from tidymeter.modeling.boosting import Fit, QuantisedTrees, TreeParams, binned, folded_scores, quantised, run_fits
from tidymeter.operators.combine import attach_structures
from tidymeter.operators.similarity import leader_clusters
from tidymeter.session import materialize


@dataclass
class TrainingParams:
    n_estimators: int = 500
    max_depth: int = 5
    learning_rate: float = 0.03
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0
    min_samples: int = 30
    cv_max_folds: int = 5
    cv_repeats: int = 1
    log_dynamic_range: float = 1000.0
    cv_strategy: str = "both"
    cluster_cutoff: float = 0.4
    min_reliable_samples: int = 50
    conformal: bool = False
    conformal_alpha: float = 0.2
    y_scramble_runs: int = 0


ModelFactory = Callable[[], Estimator]


def boosted_trees(tp: TrainingParams) -> ModelFactory:
    """Gradient boosted trees on a vector column ``x`` and label ``y``."""
    return lambda: QuantisedTrees(TreeParams.of(tp))


def linear() -> Estimator:
    return LinearRegression(featuresCol="x", labelCol="y", solver="normal")


def with_vectors(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Features as one vector ``x``: medians fill the gaps, and a flag marks what was missing."""
    numeric = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    counts = numeric.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(features)], F.count(F.lit(1)).alias("n")).first()
    gaps = [c for i, c in enumerate(features) if counts[f"n{i}"] < counts["n"]]
    empty = [c for i, c in enumerate(features) if counts[f"n{i}"] == 0]
    stages = []
    fill = [c for c in gaps if c not in empty]
    renamed = {c: f"f{i}" for i, c in enumerate(features)}
    work = numeric.select(*keep, *[F.col(f"`{c}`").alias(renamed[c]) for c in features])
    work = work.withColumns({f"m_{renamed[c]}": F.col(renamed[c]).isNull().cast("double") for c in gaps})
    if empty:
        work = work.fillna(0.0, [renamed[c] for c in empty])
    if fill:
        names = [renamed[c] for c in fill]
        stages.append(Imputer(inputCols=names, outputCols=names, strategy="median"))
    inputs = list(renamed.values()) + [f"m_{renamed[c]}" for c in gaps]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="x"))
    return Pipeline(stages=stages).fit(work).transform(work).select(*keep, "x")


def oof_predictions(
    rows: DataFrame, factory: ModelFactory, n_folds: int, fold: str = "fold", parallelism: int = 4
) -> DataFrame:
    """Out-of-fold predictions (fold, y, prediction): one model per fold, trained on the other folds.

    Quantised trees fit all folds in one job. Other estimators are independent
    Spark jobs, so a few run side by side.
    """
    estimator = factory()
    if isinstance(estimator, QuantisedTrees):
        found = estimator.out_of_fold(rows, n_folds, fold)
        if found is not None:
            return found
        factory = estimator.by_rows

    def fit(f: int) -> DataFrame:
        model = factory().fit(rows.where(F.col(fold) != f))
        return model.transform(rows.where(F.col(fold) == f)).select(F.lit(f).alias("fold"), "y", "prediction")

    parts = side_by_side(fit, range(n_folds), parallelism)
    return reduce(lambda a, b: a.unionByName(b), parts)


def cv_scores(rows: DataFrame, factory: ModelFactory, folds: list[str]) -> list[DataFrame]:
    """The row of ``cv_r2`` for each of the fold columns; large targets are scored by their sums, on all rows."""
    estimator, counts = factory(), {f: _folds(rows, f) for f in folds}
    found = estimator.fold_scores(rows, counts) if isinstance(estimator, QuantisedTrees) else None
    if found is not None:
        return [S.mean_scores(found.where(F.col("run") == f)) for f in folds]
    return [S.cv_r2(oof_predictions(rows, factory, counts[f], f)) for f in folds]


def side_by_side(work: Callable, things, parallelism: int = 4) -> list:
    """Results of ``work`` on each thing, in order; each is a sequence of Spark jobs."""
    with ThreadPool(max(1, min(parallelism, len(things)))) as pool:
        return pool.map(work, things)


def _folds(df: DataFrame, fold: str = "fold") -> int:
    return df.agg(F.max(fold)).first()[0] + 1


def random_cv(rows: DataFrame, factory: ModelFactory, key: str, max_folds: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions over shuffled folds."""
    split = materialize(K.random_folds(rows, key, max_folds=max_folds, seed=seed), "random-folds")
    return oof_predictions(split, factory, _folds(split))


def grouped_cv(
    rows: DataFrame, factory: ModelFactory, group: str, max_folds: int = 5, repeats: int = 1, folds: int | None = None
) -> DataFrame:
    """Out-of-fold predictions over grouped folds; repeats shuffle the groups anew."""
    if repeats <= 1:
        split = materialize(K.group_folds(rows, group, max_folds, folds=folds), "group-folds")
        return oof_predictions(split, factory, _folds(split))
    n = rows.count()
    groups = rows.select(group).distinct().count()
    k = folds or min(max_folds, max(3, n // 10), groups)
    split = materialize(K.repeated_group_folds(rows, group, k, repeats), "repeated-folds")
    parts = [
        oof_predictions(split.where(F.col("repeat") == r), factory, k).withColumn("fold", F.col("fold") + r * k)
        for r in range(repeats)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def assign_folds(rows: DataFrame, key: str, group: str | None, max_folds: int = 5) -> DataFrame:
    """Both fold columns, written once: every model of one target is scored on the same split."""
    split = K.random_folds(rows, key, max_folds=max_folds).withColumnRenamed("fold", "fold_random")
    if group and rows.select(group).distinct().limit(2).count() > 1:
        split = K.group_folds(split, group, max_folds).withColumnRenamed("fold", "fold_grouped")
    return materialize(split, "folds")


def evaluate(
    rows: DataFrame,
    factory: ModelFactory,
    key: str,
    group: str | None = None,
    strategy: str = "both",
    max_folds: int = 5,
    repeats: int = 1,
    min_reliable: int = 50,
) -> DataFrame:
    """One row: random and grouped cross-validated scores, primary score, reliability.

    ``rows`` has key, x, y and the group, and may carry the columns of
    ``assign_folds``. One group only falls back to random.
    """
    if repeats <= 1 and "fold_random" not in rows.columns:
        rows = assign_folds(rows, key, group, max_folds)
    groups = F.countDistinct(group) if group else F.lit(0)
    counts = rows.agg(F.count(F.lit(1)).alias("n_samples"), groups.cast("bigint").alias("n_groups"))
    can_group = bool(group) and counts.first()["n_groups"] >= 2
    use_grouped = strategy in ("both", "grouped") and can_group
    use_random = strategy in ("both", "random") or not can_group
    grouped = random_ = None
    if repeats <= 1:
        wanted = ["fold_grouped"] * use_grouped + ["fold_random"] * use_random
        found = dict(zip(wanted, cv_scores(rows, factory, wanted)))
        grouped, random_ = found.get("fold_grouped"), found.get("fold_random")
    else:
        if use_grouped:
            grouped = S.cv_r2(grouped_cv(rows, factory, group, max_folds, repeats))
        if use_random:
            runs = [
                random_cv(rows, factory, key, max_folds, 42 + r).withColumn("fold", F.col("fold") + 1000 * r)
                for r in range(repeats)
            ]
            random_ = S.cv_r2(reduce(lambda a, b: a.unionByName(b), runs))
    return S.evaluation(random_, grouped, counts, min_reliable)


def y_scramble(
    rows: DataFrame, factory: ModelFactory, key: str, repeats: int = 5, max_folds: int = 5
) -> DataFrame:
    """Mean cross-validated R2 over permuted labels."""
    # Written once: every run ranks the rows anew.
    rows = materialize(rows, "scramble-rows")

    def one(r: int) -> DataFrame:
        mixed = materialize(S.scrambled(rows, key, seed=r), "scrambled")
        split = materialize(K.random_folds(mixed, key, max_folds=max_folds), "random-folds")
        return cv_scores(split, factory, ["fold"])[0].withColumn("run", F.lit(r))

    out = reduce(DataFrame.unionByName, side_by_side(one, range(max(1, repeats))))
    return out.agg(F.avg("cv_r2_mean").alias("scramble_r2"), F.count(F.lit(1)).alias("runs"))


FOLDS = ["fold_random", "fold_grouped"]


def _prepared(
    df: DataFrame, target: str, features: list[str], keep: list[str], tp: TrainingParams, folds: bool = True
) -> tuple[DataFrame, str] | None:
    """Rows of one target in model space with their folds, written once; None with too few samples.

    ``keep`` starts with the key, then the group if there is one.
    """
    rows = df.where(F.col(f"`{target}`").isNotNull())
    long = rows.select(F.lit(target).alias("target"), F.col(f"`{target}`").cast("double").alias("y"))
    found = T.decide_transforms(long, min_samples=tp.min_samples, dynamic_range=tp.log_dynamic_range).first()
    if found is None or found["n"] < tp.min_samples:
        return None
    kind = found["transform"]
    y = N.apply_transform(F.col(f"`{target}`").cast("double"), kind).alias("y")
    # Written before the folds are drawn, which reads the rows several times.
    chosen = materialize(rows.select(*keep, *[F.col(f"`{c}`") for c in features], y), "target-rows")
    if not folds:
        return chosen, kind
    return assign_folds(chosen, keep[0], keep[1] if len(keep) > 1 else None, tp.cv_max_folds), kind


def _kept(rows: DataFrame, keep: list[str]) -> list[str]:
    return [*keep, "y", *[c for c in FOLDS if c in rows.columns]]


def cluster_folds(df: DataFrame, key: str, tokens: str, cutoff: float = 0.4, max_folds: int = 5) -> DataFrame:
    """(key, cluster, fold): rows with near token sets share a cluster, and clusters are held out whole."""
    labels = materialize(leader_clusters(df, key, tokens, cutoff), "clusters")
    return K.group_folds(labels, "cluster", max_folds)


def train_target(
    df: DataFrame,
    target: str,
    features: list[str],
    key: str,
    group: str | None = None,
    tp: TrainingParams | None = None,
    selection: Sel.SelectionParams | None = None,
    factory: ModelFactory | None = None,
    tokens: str | None = None,
) -> tuple[object, DataFrame, DataFrame] | None:
    """(model, one-row report, importances) of one target, or None with too few samples.

    The strategy ``cluster`` holds out clusters of near ``tokens`` (a column of token
    sets) among the target's rows instead of ``group``, beside the random folds.
    """
    tp = tp or TrainingParams()
    factory = factory or boosted_trees(tp)
    if tp.cv_strategy == "cluster":
        if tokens is None:
            raise ValueError("the cluster strategy needs a column of tokens")
        own = df.where(F.col(f"`{target}`").isNotNull())
        labels = materialize(leader_clusters(own, key, tokens, tp.cluster_cutoff), "clusters")
        df, group = own.join(labels.withColumnRenamed("cluster", "_cluster"), key), "_cluster"
    keep = [key] + ([group] if group and group != key else [])
    prepared = _prepared(df, target, features, keep, tp)
    if prepared is None:
        return None
    rows, kind = prepared
    names = features
    if selection is not None:
        names, _ = Sel.select_features(rows, features, "y", selection, trees=min(100, tp.n_estimators))
    vectors = materialize(with_vectors(rows, names, _kept(rows, keep)), "vectors")
    cv = evaluate(
        vectors, factory, key, group, "both" if tp.cv_strategy == "cluster" else tp.cv_strategy,
        tp.cv_max_folds, tp.cv_repeats, tp.min_reliable_samples,
    )
    model = factory().fit(vectors)
    fit = S.only_row(S.regression_metrics(model.transform(vectors)))
    report = cv.select(
        F.lit(target).alias("target"), F.lit(kind).alias("transform"),
        F.lit(selection.method if selection else "none").alias("fs_method"),
        F.lit(len(names)).alias("n_features"), F.lit(tp.cv_strategy).alias("cv_strategy"),
        F.lit("cluster" if tp.cv_strategy == "cluster" else "group").alias("cv_grouping"),
        F.lit(tp.cv_repeats).alias("cv_repeats"), *cv.columns,
        *[fit[c].alias(c) for c in ("train_r2", "train_rmse", "train_mae")],
    )
    if tp.conformal:
        oof = random_cv(vectors, factory, key, tp.cv_max_folds)
        width = S.only_row(S.conformal(oof, tp.conformal_alpha))
        report = report.withColumns(
            {"conformal_halfwidth": width["halfwidth"], "conformal_level": width["level"]}
        )
    if tp.y_scramble_runs > 0:
        control = y_scramble(vectors, factory, key, tp.y_scramble_runs, tp.cv_max_folds)
        report = report.withColumn("y_scramble_r2", S.only_row(control)["scramble_r2"])
    return model, report, importances(df, model, names, target)


def importances(df: DataFrame, model, names: list[str], target: str) -> DataFrame:
    """(target, feature, importance); a missing flag counts for its feature's own entry only."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = [abs(c) for c in model.coefficients]
    rows = [(target, c, float(v)) for c, v in zip(names, values)]
    out = df.sparkSession.createDataFrame(rows, "target string, feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature")


def train_targets(
    df: DataFrame,
    targets: list[str],
    features: list[str],
    key: str,
    group: str | None = None,
    tp: TrainingParams | None = None,
    selection: Sel.SelectionParams | None = None,
    factory: ModelFactory | None = None,
    tokens: str | None = None,
) -> tuple[DataFrame | None, DataFrame | None, dict]:
    """(report, importances, models) over all targets with enough samples, best first."""
    results = side_by_side(lambda t: train_target(df, t, features, key, group, tp, selection, factory, tokens), targets)
    done = [(t, r) for t, r in zip(targets, results) if r is not None]
    if not done:
        return None, None, {}
    report = reduce(DataFrame.unionByName, [r[1] for _, r in done])
    imps = reduce(DataFrame.unionByName, [r[2] for _, r in done])
    return report.orderBy(F.col("cv_r2_mean").desc_nulls_last(), "target"), imps, {t: r[0] for t, r in done}


def train_targets_legacy(
    df: DataFrame, targets: list[str], features: list[str] | None, key: str, factory: ModelFactory, min_coverage: float = 0.05, min_samples: int = 30
) -> DataFrame | None:
    """Property columns only, clipped log10 of every target, random folds."""
    names = [c for c in (features or D.PROPERTY_ONLY_FEATURES) if c in df.columns]
    covered = {r["target"] for r in T.target_coverage(df, targets).where(F.col("coverage") >= min_coverage).collect()}
    report = None
    for target in [t for t in targets if t in covered]:
        rows = df.where(F.col(f"`{target}`").isNotNull())
        y = N.clipped_log10(F.col(f"`{target}`").cast("double")).alias("y")
        work = materialize(rows.select(key, *[F.col(f"`{c}`") for c in names], y), "legacy-rows")
        n = work.count()
        if n < min_samples:
            continue
        vectors = materialize(with_vectors(work, names, [key, "y"]), "legacy-vectors")
        cv = S.cv_r2(random_cv(vectors, factory, key, max_folds=min(5, max(3, n // 10))))
        fit = S.only_row(S.regression_metrics(factory().fit(vectors).transform(vectors)))
        one = cv.select(
            F.lit(target).alias("target"), F.lit(n).alias("n_samples"), "cv_r2_mean", "cv_r2_std",
            *[fit[c].alias(c) for c in ("train_r2", "train_rmse", "train_mae")],
        )
        report = one if report is None else report.unionByName(one)
    return report


METHODS = ["none", "variance", "correlation", "univariate", "model"]


def method_params(method: str, base: Sel.SelectionParams) -> Sel.SelectionParams:
    """Parameters that switch on one selection method alone."""
    off = Sel.SelectionParams(method="none", k_best=0, variance_threshold=0.0, correlation_threshold=1.0, score_func=base.score_func)
    changes = {
        "none": {},
        "variance": {"variance_threshold": base.variance_threshold or 1e-6},
        "correlation": {"correlation_threshold": base.correlation_threshold},
        "univariate": {"method": "univariate", "k_best": base.k_best},
        "model": {"method": "model", "k_best": base.k_best},
    }
    return replace(off, **changes[method])


def selection_benchmark(
    df: DataFrame,
    target: str,
    blocks: dict[str, list[str]],
    key: str,
    group: str,
    tp: TrainingParams | None = None,
    selection: Sel.SelectionParams | None = None,
    methods: list[str] | None = None,
    factory: ModelFactory | None = None,
) -> tuple[DataFrame, DataFrame | None] | None:
    """(results, relevance): one scored row per block and method, and their top 20 features."""
    tp, base = tp or TrainingParams(), selection or Sel.SelectionParams()
    factory = factory or boosted_trees(tp)
    every = list(dict.fromkeys(c for cs in blocks.values() for c in cs))
    keep = [key] + ([group] if group != key else [])
    prepared = _prepared(df, target, every, keep, tp)
    if prepared is None:
        return None
    rows, _ = prepared

    def one(task: tuple[str, str]) -> tuple[DataFrame, DataFrame | None]:
        block, method = task
        kept, found = Sel.select_features(rows, blocks[block], "y", method_params(method, base), trees=min(100, tp.n_estimators))
        vectors = materialize(with_vectors(rows, kept, _kept(rows, keep)), "benchmark-vectors")
        cv = evaluate(vectors, factory, key, group, "both", tp.cv_max_folds, 1, tp.min_reliable_samples)
        scored = cv.select(
            F.lit(target).alias("target"), F.lit(block).alias("block"), F.lit(method).alias("method"),
            F.lit(len(kept)).alias("n_features"), "cv_r2_random", "cv_r2_grouped", "reliable",
        )
        top = found and found.orderBy(F.desc("score"), "feature").limit(20).select(
            F.lit(block).alias("block"), F.lit(method).alias("method"), "feature", "score"
        )
        return scored, top

    done = side_by_side(one, [(b, m) for b in blocks for m in methods or METHODS])
    tops = [top for _, top in done if top is not None]
    results = reduce(DataFrame.unionByName, [scored for scored, _ in done])
    return results, reduce(DataFrame.unionByName, tops) if tops else None


def best_method(results: DataFrame, metric: str = "cv_r2_grouped", prefer: str = "with_block") -> DataFrame:
    """Best method per target by the honest score; the preferred block where a target has it."""
    pick = F.struct(metric, F.col("method").alias("method"))
    preferred = F.when((F.col("block") == prefer) & F.col(metric).isNotNull(), pick)
    other = F.when((F.col("block") != prefer) & F.col(metric).isNotNull(), pick)
    has = F.bool_or(F.col("block") == prefer)
    return results.groupBy("target").agg(
        F.when(has, F.max_by("method", preferred)).otherwise(F.max_by("method", other)).alias("best_method")
    )


def best_config(method: str | None, base: Sel.SelectionParams | None = None) -> Sel.SelectionParams:
    return method_params(method or "none", base or Sel.SelectionParams())


def ablate_block(
    df: DataFrame,
    target: str,
    base_features: list[str],
    block: DataFrame,
    key: str,
    group: str,
    tp: TrainingParams | None = None,
    factory: ModelFactory | None = None,
    selection: Sel.SelectionParams | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """(scores, block importances): the same model with and without a joined feature block."""
    tp = tp or TrainingParams()
    factory = factory or boosted_trees(tp)
    extra = [c for c in block.columns if c != key]
    joined = df.withColumn(key, F.col(key).cast("string")).join(
        block.withColumn(key, F.col(key).cast("string")), key, "left"
    )
    keep = [key] + ([group] if group != key else [])
    prepared = _prepared(joined, target, base_features + extra, keep, tp)
    if prepared is None:
        return None
    rows, kind = prepared

    def side(task: tuple[str, list[str]]) -> tuple:
        name, features = task
        chosen = features if selection is None else Sel.select_features(rows, features, "y", selection)[0]
        vectors = materialize(with_vectors(rows, chosen, _kept(rows, keep)), f"{name}-vectors")
        cv = evaluate(vectors, factory, key, group, "both", tp.cv_max_folds, 1, tp.min_reliable_samples)
        return cv, factory().fit(vectors) if name == "augmented" else None, chosen

    baseline, augmented = side_by_side(side, [("baseline", base_features), ("augmented", base_features + extra)])
    _, model, kept = augmented
    imp = importances(df, model, kept, target).where(F.col("feature").isin(extra))
    covered = rows.agg(F.count_if(F.coalesce(*[F.col(f"`{c}`").cast("double") for c in extra]).isNotNull()).alias("n_covered"))
    after = S.only_row(augmented[0])
    total = S.only_row(imp.agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("block_importance")))
    names = {"cv_r2": "cv_r2_mean", "cv_std": "cv_r2_std", "cv_r2_random": "cv_r2_random", "cv_r2_grouped": "cv_r2_grouped"}
    both = baseline[0].select(
        "n_samples", "n_groups", "cv_folds", "reliable", "reliability_note",
        *[F.col(c).alias(f"baseline_{n}") for n, c in names.items()],
        *[after[c].alias(f"augmented_{n}") for n, c in names.items()],
        S.only_row(covered)["n_covered"].alias("n_covered"),
        total["block_importance"].alias("block_importance"),
    )
    deltas = {
        f"delta_{m}": F.col(f"augmented_{m}") - F.col(f"baseline_{m}") for m in ("cv_r2", "cv_r2_random", "cv_r2_grouped")
    }
    scores = both.withColumns(deltas).select(F.lit(target).alias("target"), F.lit(kind).alias("transform"), "*")
    return scores, imp


# --- parameter search -------------------------------------------------------------------

# The searched ranges.
SPACE = {
    "n_estimators": ("int", 100, 1200),
    "max_depth": ("int", 2, 7),
    "learning_rate": ("log", 5e-3, 0.3),
    "subsample": ("float", 0.6, 1.0),
    "colsample_bytree": ("float", 0.5, 1.0),
    "min_child_weight": ("float", 1.0, 10.0),
}


def sample_params(space: dict, rng: random.Random) -> dict:
    """One seeded random point of the search space."""
    out = {}
    for name, spec in space.items():
        if isinstance(spec, list):
            out[name] = rng.choice(spec)
        elif spec[0] == "int":
            out[name] = rng.randint(spec[1], spec[2])
        elif spec[0] == "log":
            out[name] = spec[1] * (spec[2] / spec[1]) ** rng.random()
        else:
            out[name] = rng.uniform(spec[1], spec[2])
    return out


def _inner_folds(vectors: DataFrame, key: str, group: str | None, max_folds: int, name: str) -> DataFrame:
    split = K.group_folds(vectors, group, max_folds) if group else K.random_folds(vectors, key, max_folds=max_folds)
    return split.withColumnRenamed("fold", name)


def _studies_at_once(
    vectors: DataFrame, outer: DataFrame | None, key: str, group: str | None, tp: TrainingParams, space: dict, n_trials: int, seed: int
) -> tuple[list[list[tuple[int, dict, float]]], list[tuple]] | None:
    """(trials of every study, outer fold rows): all inner fits of all trials are one job, the outer fits another.

    The study of an outer fold sees the rows of the others; the last study sees all
    rows. Rows beyond the bound of quantised training are scored by their sums; None beyond
    the bound of these.
    """
    n_outer = _folds(outer) if outer is not None else 0
    table = vectors if outer is None else outer.withColumnRenamed("fold", "outer")
    for s in range(n_outer):
        inner = _inner_folds(table.where(F.col("outer") != s), key, group, tp.cv_max_folds, f"inner{s}")
        rest = table.where(F.col("outer") == s).withColumn(f"inner{s}", F.lit(-1))
        table = materialize(inner.unionByName(rest), "inner-folds")
    table = materialize(_inner_folds(table, key, group, tp.cv_max_folds, f"inner{n_outer}"), "inner-folds")
    names = [f"inner{s}" for s in range(n_outer + 1)]
    shared = quantised(table, names + (["outer"] if n_outer else []))
    tables = None
    if shared is None:
        sums = binned(table, names + (["outer"] if n_outer else []))
        sums = sums and sums.folded(names + (["outer"] if n_outer else []))
        if not sums:
            return None
        tables = dict(zip(names + ["outer"], sums))

    def fold_scores(fits: list[Fit]) -> DataFrame:
        if tables is None:
            return S.fold_scores(run_fits(table, shared, fits), ["run"])
        return folded_scores(vectors.sparkSession, tables, fits)

    most = table.agg(*[F.max(n).alias(n) for n in names]).first()
    points, fits = [], []
    for s, name in enumerate(names):
        rng = random.Random(seed if s == n_outer else seed + 1 + s)
        points.append([sample_params(space, rng) for _ in range(n_trials)])
        for t, params in enumerate(points[-1]):
            own = TreeParams.of(replace(tp, **params))
            fits += [Fit(f"{s}/{t}", own, name, k) for k in range(most[name] + 1)]
    # The longest fits start first.
    fits.sort(key=lambda f: -f.params.n_estimators * f.params.max_depth)
    scores = {r["run"]: r["cv_r2_mean"] for r in S.mean_scores(fold_scores(fits), ["run"]).collect()}
    studies = [
        [(t, p, scores.get(f"{s}/{t}") if scores.get(f"{s}/{t}") is not None else float("-inf")) for t, p in enumerate(own)]
        for s, own in enumerate(points)
    ]
    best = [max(own, key=lambda t: t[2]) for own in studies]
    last = [Fit(f"outer{s}", TreeParams.of(replace(tp, **best[s][1])), "outer", s) for s in range(n_outer)]
    tested = fold_scores(last).collect() if last else []
    return studies, [(r["fold"], float(best[r["fold"]][2]), r["r2"], r["n"]) for r in sorted(tested, key=lambda r: r["fold"])]


def _study(vectors: DataFrame, key: str, group: str | None, tp: TrainingParams, space: dict, n_trials: int, seed: int, make) -> list[tuple[int, dict, float]]:
    """Seeded random trials scored by inner cross-validation; every trial is a set of Spark jobs."""
    rng, trials = random.Random(seed), []
    for t in range(n_trials):
        params = sample_params(space, rng)
        factory = make(replace(tp, **params))
        if group:
            preds = grouped_cv(vectors, factory, group, tp.cv_max_folds, tp.cv_repeats)
        else:
            preds = random_cv(vectors, factory, key, tp.cv_max_folds)
        score = S.cv_r2(preds).first()["cv_r2_mean"]
        trials.append((t, params, score if score is not None else float("-inf")))
    return trials


def search(
    df: DataFrame,
    target: str,
    features: list[str],
    key: str,
    group: str | None,
    tp: TrainingParams | None = None,
    space: dict | None = None,
    n_trials: int = 50,
    outer_folds: int = 3,
    seed: int = 42,
    make: Callable[[TrainingParams], ModelFactory] = boosted_trees,
) -> dict | None:
    """Random search on (grouped) cross-validation with an honest outer loop.

    Returns ``best`` parameters, ``best_score``, and the tables ``folds`` and
    ``history``; None with too few samples. The final study uses all rows.
    """
    tp, space = tp or TrainingParams(), space or SPACE
    keep = [key] + ([group] if group and group != key else [])
    prepared = _prepared(df, target, features, keep, tp, folds=False)
    if prepared is None:
        return None
    vectors = materialize(with_vectors(prepared[0], features, [*keep, "y"]), "search-vectors")
    spark = df.sparkSession
    outer = None
    if outer_folds >= 2:
        if group:
            groups = vectors.select(group).distinct().count()
            outer = K.group_folds(vectors, group, folds=min(outer_folds, groups)) if groups >= 2 else None
        else:
            outer = K.random_folds(vectors, key, max_folds=outer_folds, seed=seed)
        outer = outer and materialize(outer, "outer-folds")
    found = None
    if make is boosted_trees and tp.cv_repeats == 1:
        found = _studies_at_once(vectors, outer, key, group, tp, space, n_trials, seed)
    if found:
        studies, fold_rows = found
        trials = studies[-1]
    else:
        fold_rows = []
        for f in range(_folds(outer) if outer is not None else 0):
            train = outer.where(F.col("fold") != f).drop("fold")
            test = outer.where(F.col("fold") == f)
            trials = _study(train, key, group, tp, space, n_trials, seed + 1 + f, make)
            best = max(trials, key=lambda t: t[2])
            model = make(replace(tp, **best[1]))().fit(train)
            got = model.transform(test).agg(S.r2().alias("r2"), F.count(F.lit(1)).alias("n")).first()
            fold_rows.append((f, float(best[2]), got["r2"], got["n"]))
        trials = _study(vectors, key, group, tp, space, n_trials, seed, make)
    best = max(trials, key=lambda t: t[2])
    return {
        "best": asdict(replace(tp, **best[1])),
        "tuned": best[1],
        "best_score": best[2],
        "folds": spark.createDataFrame(fold_rows, "fold int, inner_best_cv double, test_r2 double, n_test long"),
        "history": spark.createDataFrame([(t, s) for t, _, s in trials], "trial int, score double"),
    }


def training_job(
    wide: DataFrame,
    structures: DataFrame,
    tp: TrainingParams | None = None,
    selection: Sel.SelectionParams | None = None,
    key: str = "CID",
    group: str | None = None,
    factory: ModelFactory | None = None,
    min_coverage: float = 0.0,
) -> dict:
    """Attach structures, find features and targets, train every target.

    Returns report, importances, models and the joined table.
    """
    joined = attach_structures(wide, structures, key)
    features, names = T.classify_columns(joined, ids=[group] if group else None)
    covered = T.target_coverage(joined, names).where(F.col("coverage") >= min_coverage)
    ok = {r["target"] for r in covered.collect()}
    report, imps, models = train_targets(
        joined, [t for t in names if t in ok], features, key, group, tp, selection, factory
    )
    return {"table": joined, "report": report, "importance": imps, "models": models}
