"""Unit cleaning, inference and conversion expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions.text import as_col, lookup, strip, strip_to_null


def clean_unit(c, spellings: dict[str, str] | None = None) -> Column:
    """Harmonised unit: spelling table, then suffix rules, else the trimmed original."""
    table = spellings or D.UNIT_SPELLINGS
    unit = strip_to_null(c)
    low = F.lower(F.translate(unit, "* ", "/"))
    degrees = F.regexp_replace(low, "deg(ree)?c", "c")
    suffix = (
        F.when(F.endswith(low, F.lit("mol/k")), F.lit("J/mol/K"))
        .when(F.endswith(low, F.lit("kj/mol")), F.lit("kJ/mol"))
        .when(F.endswith(low, F.lit("/mol")), low)
    )
    return F.coalesce(lookup(table, low), suffix, lookup(table, degrees), unit)


def _clean_unit_text(text: str) -> str:
    """Harmonised spelling of one fixed candidate (driver side, constants only)."""
    low = text.replace("*", "/").replace(" ", "").lower()
    return D.UNIT_SPELLINGS.get(low, text)


def infer_unit(c, legacy: bool = False) -> Column:
    """Unit named inside a value text.

    The default tries longer candidates first, so that 'J/mol*K' is not taken
    for 'K'; ``legacy=True`` keeps the plain candidate order.
    """
    c = as_col(c)
    candidates = D.UNIT_CANDIDATES
    if not legacy:
        candidates = sorted(candidates, key=lambda u: -len(u))
    out = F.when(F.contains(c, F.lit(candidates[0])), F.lit(_clean_unit_text(candidates[0])))
    for unit in candidates[1:]:
        out = out.when(F.contains(c, F.lit(unit)), F.lit(_clean_unit_text(unit)))
    return out


def standard_unit(unit, value, legacy: bool = False) -> Column:
    """Cleaned unit, else the unit inferred from the value text."""
    return F.coalesce(clean_unit(unit), infer_unit(value, legacy))


def canonical_unit(prop, units: dict[str, str] | None = None) -> Column:
    return lookup(units or D.CANONICAL_UNITS, as_col(prop))


def canonical_value(prop, value, unit, units=None, conversions=None) -> Column:
    """Value in the canonical unit of its property.

    Unmanaged properties and rows without a unit pass through; a unit that
    cannot be converted yields null.
    """
    value = as_col(value)
    target = canonical_unit(prop, units)
    clean = strip_to_null(unit)
    table = conversions or D.UNIT_CONVERSIONS
    key = F.concat_ws("→", clean, target)
    divisor = lookup({f"{a}→{b}": k[0] for (a, b), k in table.items()}, key)
    offset = lookup({f"{a}→{b}": k[1] for (a, b), k in table.items()}, key)
    return F.when(target.isNull() | clean.isNull(), value).otherwise(value / divisor + offset)


def molar_multiplier(c) -> Column:
    """Concentration unit -> factor to mol/l, null when unknown."""
    unit = F.translate(F.lower(strip(as_col(c).cast("string"))), "µμ", "uu")
    short = F.endswith(unit, F.lit("m")) & (F.length(unit) <= 3)
    return F.coalesce(
        lookup(D.MOLAR_UNITS, unit),
        F.when(short, lookup(D.MOLAR_PREFIXES, F.substring(unit, 1, 1))),
    )


def energy_from_hartree(c, unit: str) -> Column:
    """Hartree to eV, kcal/mol or kJ/mol."""
    factor = {"eV": D.HARTREE_TO_EV, "kcal/mol": D.HARTREE_TO_KCAL, "kJ/mol": D.HARTREE_TO_KJ}
    return as_col(c) * F.lit(factor[unit])
