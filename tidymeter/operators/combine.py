"""Joins, set operations and incremental work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import numeric as N, text as X
from tidymeter.functions.units import energy_from_hartree
from tidymeter.operators.ranks import null_safe_join


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key by ``order``, with map-side combine, so a hot key is harmless."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(
        F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*[X.as_col(c) for c in order])
    )
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def attach_structures(wide: DataFrame, structures: DataFrame, key: str = "CID") -> DataFrame:
    """Left join by the id as text."""
    left = wide.withColumn(key, F.col(key).cast("string"))
    return left.join(structures.withColumn(key, F.col(key).cast("string")), key, "left")


def missing_count(df: DataFrame, col: str) -> DataFrame:
    """How many rows lack a value, and of how many."""
    return df.agg(
        F.count_if(F.col(col).isNull()).alias("missing"), F.count(F.lit(1)).alias("rows")
    )


def attach_distinct(
    left: DataFrame, right: DataFrame, key: str = "CID", ordinal: str = "ordinal"
) -> DataFrame:
    """Left join with the first right row of every id."""
    return attach_structures(left, first_per_key(right, [key], [ordinal]).drop(ordinal), key)


def attach_block(df: DataFrame, block: DataFrame, key: str = "CID") -> DataFrame:
    """Left join a feature block; ``covered`` tells whether any of it is present."""
    names = [c for c in block.columns if c != key]
    present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])
    return attach_structures(df, block, key).withColumn("covered", present)


def coverage_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("rows"))


def pair_states(
    df: DataFrame, a: str, b: str, columns: list[str], key: str = "CID", state: str = "state"
) -> DataFrame:
    """Keys present in both states, with the columns of each side by side.

    The input has one row per (key, state). Both states come out of one
    aggregation on the key, which shuffles once where a self-join shuffles twice.
    """
    row = F.struct(*[F.col(c) for c in columns])
    sides = df.where(F.col(state).isin(a, b)).groupBy(key).agg(
        F.first(F.when(F.col(state) == a, row), ignorenulls=True).alias("_a"),
        F.first(F.when(F.col(state) == b, row), ignorenulls=True).alias("_b"),
    )
    both = sides.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.select(
        key,
        *[F.col(f"_a.{c}").alias(f"{a}_{c}") for c in columns],
        *[F.col(f"_b.{c}").alias(f"{b}_{c}") for c in columns],
    )


def state_delta(
    df: DataFrame,
    a: str = "neutral",
    b: str = "anion",
    columns: list[str] | None = None,
    deltas: list[str] | None = None,
    key: str = "CID",
    state: str = "state",
) -> DataFrame:
    """Both states side by side plus ``delta_c = b - a``."""
    columns = columns or D.DESCRIPTORS
    deltas = deltas or [c for c in D.DELTA_DESCRIPTORS if c in columns]
    pairs = pair_states(df, a, b, columns, key, state)
    return pairs.withColumns(
        {f"delta_{c}": F.col(f"{b}_{c}") - F.col(f"{a}_{c}") for c in deltas}
    )


def available_pairs(
    df: DataFrame, a: str = "neutral", b: str = "anion", key: str = "CID", state: str = "state"
) -> DataFrame:
    """Sorted keys completed in both states."""
    return (
        df.groupBy(key)
        .agg(F.bool_or(F.col(state) == a).alias("_a"), F.bool_or(F.col(state) == b).alias("_b"))
        .where("_a and _b")
        .select(key)
        .orderBy(key)
    )


def assemble_marcus(
    equilibrium: DataFrame,
    cross: DataFrame,
    oxidized: str = "neutral",
    reduced: str = "anion",
    key: str = "CID",
) -> DataFrame:
    """Reorganization and activation energies of every key with both states.

    ``equilibrium``: key, state, scf_energy, gibbs_G. ``cross``: key,
    e_reduced_at_oxidized, e_oxidized_at_reduced (Hartree), error.
    """
    pairs = pair_states(equilibrium, oxidized, reduced, ["scf_energy", "gibbs_G"], key)
    joined = pairs.join(cross, key, "left")
    lam = N.reorganization(
        "e_reduced_at_oxidized", f"{reduced}_scf_energy",
        "e_oxidized_at_reduced", f"{oxidized}_scf_energy",
    )
    work = joined.withColumn("_lam", lam).withColumn(
        "_dg", F.col(f"{reduced}_gibbs_G") - F.col(f"{oxidized}_gibbs_G")
    )
    work = work.withColumn("_act", N.activation(F.col("_lam.total"), F.col("_dg")))
    return work.select(
        key,
        energy_from_hartree("_lam.total", "eV").alias("reorg_energy_eV"),
        energy_from_hartree("_lam.total", "kcal/mol").alias("reorg_energy_kcal"),
        energy_from_hartree("_lam.lambda1", "eV").alias("lambda1_eV"),
        energy_from_hartree("_lam.lambda2", "eV").alias("lambda2_eV"),
        energy_from_hartree("_dg", "eV").alias("dG_reduction_eV"),
        energy_from_hartree("_act", "eV").alias("activation_energy_eV"),
        energy_from_hartree("_act", "kcal/mol").alias("activation_energy_kcal"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def skipped_keys(df: DataFrame, a: str = "neutral", b: str = "anion", key: str = "CID") -> DataFrame:
    """Keys that lack one of the two states."""
    return df.select(key).distinct().join(available_pairs(df, a, b, key), key, "left_anti")


def priority_lookup(attempts: DataFrame, key: str = "CID") -> DataFrame:
    """Outcome of trying several lookups per key in order of ``priority``.

    ``attempts``: key, priority, method, url, title, error, not_found,
    search_page, has_keywords, snippet. A failed, unknown or search-page attempt
    goes on to the next; the first direct page ends the search. Without one the
    last note stays, with title and url of the last attempt that answered.
    """
    failed = F.col("error").isNotNull()
    unknown = ~failed & F.col("not_found")
    search = ~failed & ~F.col("not_found") & F.col("search_page")
    direct = ~failed & ~F.col("not_found") & ~F.col("search_page")
    note = (
        F.when(failed, F.concat(F.lit("Lookup failed: "), F.col("error")))
        .when(unknown, F.lit("No entry found"))
        .when(search, F.lit("Search results page returned, no direct page"))
        .when(F.col("has_keywords"), F.lit("Found related content"))
        .otherwise(F.lit("Page found, no explicit keywords"))
    )
    snippet = F.when(F.col("has_keywords"), F.col("snippet")).otherwise(F.lit(""))
    answer = F.struct("title", "url", "method")
    page = F.struct(
        "title", "url", "method", note.alias("note"), "has_keywords", snippet.alias("snippet")
    )
    out = attempts.groupBy(key).agg(
        F.min_by(page, F.when(direct, F.col("priority"))).alias("_hit"),
        F.max_by(answer, F.when(~failed, F.col("priority"))).alias("_last"),
        F.max_by(note, F.col("priority")).alias("_note"),
    )
    hit = F.col("_hit").isNotNull()

    def field(name: str) -> Column:
        return F.coalesce(F.when(hit, F.col(f"_hit.{name}")).otherwise(F.col(f"_last.{name}")), F.lit(""))

    return out.select(
        key,
        F.coalesce(F.col("_hit.has_keywords"), F.lit(False)).alias("found"),
        field("url").alias("url"), field("method").alias("method"), field("title").alias("title"),
        F.when(hit, F.col("_hit.note")).otherwise(F.col("_note")).alias("note"),
        F.coalesce(F.col("_hit.snippet"), F.lit("")).alias("snippet"),
    )


def resolve_names(activities: DataFrame, targets: DataFrame) -> DataFrame:
    """TargetName by fallback: preferred, target, first component name or accession, blank.

    ``targets``: target_id, pref_name, target_name, components array of
    struct(component_name, accession). No join side is forced to broadcast.
    """
    parts = F.transform(
        "components",
        lambda c: F.coalesce(
            F.nullif(c["component_name"], F.lit("")), F.nullif(c["accession"], F.lit(""))
        ),
    )
    name = F.coalesce(
        F.nullif(F.col("pref_name"), F.lit("")),
        F.nullif(F.col("target_name"), F.lit("")),
        F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)),
        F.lit(""),
    )
    dim = targets.select(F.col("target_id").alias("Target"), name.alias("TargetName"))
    return (
        activities.drop("TargetName")
        .join(dim, "Target", "left")
        .withColumn("TargetName", F.coalesce("TargetName", F.lit("")))
    )


def pending(inputs: DataFrame, results: DataFrame, key: str, success: str, time: str) -> DataFrame:
    """Inputs whose latest result did not succeed, or that have none."""
    done = (
        results.groupBy(key)
        .agg(F.max_by(success, time).alias("_ok"))
        .where("_ok")
        .select(key)
    )
    return inputs.join(done, key, "left_anti")


def latest_per_key(
    df: DataFrame, key: str, time: str, tie: list[str] | None = None, complete: Column | None = None
) -> DataFrame:
    """The newest complete row of every key."""
    work = df if complete is None else df.where(complete)
    others = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(time, *(tie or [])))
    return (
        work.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*").select(*df.columns)
    )


def qualifying_ids(
    wide: DataFrame,
    targets: list[str] | None = None,
    min_coverage: float = 0.01,
    min_samples: int = 1,
    key: str = "CID",
) -> DataFrame:
    """Distinct ids that have a value in any target with enough coverage and samples."""
    names = targets or [c for c in wide.columns if X.is_target_name(c)]
    counts = wide.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names]
    ).first()
    chosen = [
        c for c in names
        if counts["_rows"] and counts[c] >= min_samples and counts[c] / counts["_rows"] >= min_coverage
    ]
    if not chosen:
        return wide.select(F.col(key).cast("string").alias(key)).where(F.lit(False))
    filled = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in chosen])
    return wide.where(filled).select(X.strip(F.col(key).cast("string")).alias(key)).distinct()


def prepend_dedup(
    first: DataFrame, rest: DataFrame, key: str = "CID", ordinal: str = "ordinal"
) -> DataFrame:
    """Union with ``first`` in front; the first row of every id stays."""
    both = first.withColumn("_part", F.lit(0)).unionByName(
        rest.withColumn("_part", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, [key], ["_part", ordinal]).drop("_part")


__all__ = [
    "assemble_marcus", "attach_block", "attach_distinct", "attach_structures",
    "available_pairs", "coverage_count", "first_per_key", "latest_per_key", "missing_count",
    "null_safe_join", "pair_states", "pending", "prepend_dedup", "priority_lookup",
    "qualifying_ids", "resolve_names", "skipped_keys", "state_delta",
]
