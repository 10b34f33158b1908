"""From log files to state energies: newest completed run per entity and state, deltas, reorganisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidymeter import dictionaries as D
from tidymeter.operators import combine as J, logs as L


def newest_states(
    logs: DataFrame, key: str = "CID", state: str = "state", time: str = "mtime", tie: list[str] | None = None
) -> DataFrame:
    """Descriptors of the newest completed log of every (entity, state)."""
    found = L.extract_descriptors(logs).withColumn("_run", F.struct(key, state))
    return J.latest_per_key(found, "_run", time, tie).select(key, state, *D.DESCRIPTORS)


def state_energies(
    logs: DataFrame,
    cross: DataFrame,
    oxidized: str = "neutral",
    reduced: str = "anion",
    tie: list[str] | None = None,
) -> DataFrame:
    """One row per entity with both states: descriptor deltas and Marcus energies.

    ``logs``: CID, state, mtime, text. ``cross``: CID, e_reduced_at_oxidized,
    e_oxidized_at_reduced, error. The texts are parsed once; both results come
    from the same aggregated descriptors, keyed by entity.
    """
    states = newest_states(logs, tie=tie)
    deltas = J.state_delta(states, oxidized, reduced)
    energies = J.assemble_marcus(states, cross, oxidized, reduced)
    return J.attach_block(deltas, energies)
