"""Registry, shared input views and result normalisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidymeter.session import spread_rows

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Sums differ by their last bits with the order of addition. Rounding cuts those
# bits, and the shift keeps the cut away from the halves that short decimals hit.
SHIFT = 0.2371


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared input view over the given tables, as Spark sees it."""
    sql = VIEWS[name]
    used = {t: spread_rows(table(spark, sf, t)) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """The same input view as a parenthesised SQL subquery."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}).replace("`", '"') + ")"


def tidy(df: DataFrame, digits: int = 7) -> DataFrame:
    """Round doubles and widen integers, so that engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            scale = F.lit(10.0**digits)
            c = F.round(c.cast("double") * scale + F.lit(SHIFT), 0) / scale + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def oracle(sql: str, doubles: str = "", ints: str = "", digits: int = 7) -> str:
    """Wrap a query so that its doubles are rounded and its integers are BIGINT."""
    scale = f"1e{digits}"
    changes = [
        f'round(CAST("{c}" AS DOUBLE) * {scale} + {SHIFT}) / {scale} + 0.0 AS "{c}"' for c in _names(doubles)
    ]
    changes += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in _names(ints)]
    if not changes:
        return sql
    return f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})"


def _names(text: str) -> list[str]:
    return [c.strip() for c in text.split(",") if c.strip()]


def register(
    name: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 7
):
    """Register a query; its result is normalised like its SQL counterpart."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return tidy(fn(spark, sf), digits)

        REGISTRY[name] = Entry(run, oracle(sql, doubles, ints, digits) if sql else None)
        return fn

    return wrap


def values(rows: dict | list, names: str) -> str:
    """A VALUES table from a Python dictionary of fixed values."""
    items = rows.items() if isinstance(rows, dict) else rows
    lines = []
    for row in items:
        flat: list = []
        for part in row:
            flat.extend(part if isinstance(part, tuple) else [part])
        lines.append("(" + ", ".join(literal(x) for x in flat) + ")")
    return f"(VALUES {', '.join(lines)}) AS {names}"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(literal(w) for w in words) + ")"
