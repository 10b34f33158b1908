"""Sinks: CSV, TSV, JSON and Parquet, one folder per table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        (
            writer.option("header", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        ).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")
    return path


def write_tables(
    tables: dict[str, DataFrame], folder: str, kinds: dict[str, list[str]] | None = None, mode: str = "errorifexists"
) -> dict[str, str]:
    """Write every table; ``kinds`` names the formats per table (CSV by default).

    A log summary takes ``["tsv"]`` and a model report ``["csv", "json"]``.
    """
    out = {}
    for name, df in tables.items():
        for kind in (kinds or {}).get(name, ["csv"]):
            out[f"{name}.{kind}"] = write_table(df, os.path.join(folder, f"{name}.{kind}"), kind, mode)
    return out
