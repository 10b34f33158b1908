"""Arithmetic expressions: spread ratios, transforms, energies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions.text import as_col


def fold_range(low, high) -> Column:
    """max / min, null unless the minimum is positive."""
    low, high = as_col(low), as_col(high)
    return F.when(low > 0, high / low)


def relative_iqr(iqr, median) -> Column:
    """IQR over |median|, 0 when the median is 0."""
    iqr, median = as_col(iqr), as_col(median)
    return F.when(median != 0, iqr / F.abs(median)).when(median.isNotNull(), F.lit(0.0))


def apply_transform(c, kind) -> Column:
    """log10 or identity, chosen by a text column or literal."""
    c, kind = as_col(c), kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(kind == "log10", F.log10(c)).otherwise(c)


def inverse_transform(c, kind) -> Column:
    c, kind = as_col(c), kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(kind == "log10", F.pow(F.lit(10.0), c)).otherwise(c)


def clipped_log10(c, floor: float = 1e-12) -> Column:
    """log10 of the value raised to at least ``floor``; null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.log10(F.greatest(c, F.lit(floor))))


def gibbs_energy(energy_hartree, enthalpy_kcal, entropy_cal, temperature) -> Column:
    """G = H - T*S in kJ/mol; null if any part is missing."""
    enthalpy = as_col(energy_hartree) * D.HARTREE_TO_KJ + as_col(enthalpy_kcal) * D.KCAL_TO_KJ
    entropy = as_col(entropy_cal) * (D.KCAL_TO_KJ / 1000.0)
    return enthalpy - as_col(temperature) * entropy


def redox_potential(g_red, g_ox, g_sol_red, g_sol_ox) -> Column:
    """Potential in V from four Gibbs energies in kJ/mol (gas terms cancel)."""
    g_red, g_ox = as_col(g_red), as_col(g_ox)
    total = g_red - g_ox + (as_col(g_sol_red) - g_red) - (as_col(g_sol_ox) - g_ox)
    return -total / D.REDOX_KJ_PER_EV


def reorganization(e_r_og, e_r_rg, e_o_rg, e_o_og) -> Column:
    """Struct(lambda, lambda1, lambda2); all null if any energy is missing."""
    parts = [as_col(c) for c in (e_r_og, e_r_rg, e_o_rg, e_o_og)]
    complete = parts[0].isNotNull()
    for p in parts[1:]:
        complete = complete & p.isNotNull()
    first = F.when(complete, parts[0] - parts[1])
    second = F.when(complete, parts[2] - parts[3])
    return F.struct(
        (first + second).alias("total"), first.alias("lambda1"), second.alias("lambda2")
    )


def activation(lam, dg_red) -> Column:
    """(lambda + dG)^2 / (4 lambda), null unless lambda is positive."""
    lam, dg = as_col(lam), as_col(dg_red)
    return F.when(lam > 0, (lam + dg) * (lam + dg) / (4.0 * lam))


def tanimoto(a, b) -> Column:
    """Count Tanimoto of two equally long numeric arrays; 1 when both are empty."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v
        )

    a, b = as_col(a), as_col(b)
    ab = dot(a, b)
    rest = dot(a, a) + dot(b, b) - ab
    return F.when(rest > 0, ab / rest).otherwise(F.lit(1.0))
