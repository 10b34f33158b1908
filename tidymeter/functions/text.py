"""Text and name expressions."""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter import dictionaries as D

# Number patterns.
WHOLE_NUMBER = r"(?i)^\s*[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?|inf(?:inity)?)\s*$"
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
# The characters that count as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


DICTIONARY_ROWS = 10_000


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, use) -> Column:
    """``use`` of a value that is worked out once, however often it occurs in ``use``.

    Inside a lambda, Spark evaluates an expression anew wherever it stands.
    """
    return F.get(F.transform(F.array(as_col(c)), use), F.lit(0))


def lookup(mapping: dict, key: Column) -> Column:
    """Constant dictionary lookup; null when the key is absent."""
    items = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def dictionary(spark, rows: dict, columns: str) -> DataFrame:
    """A constant dictionary as an inline table, marked for broadcast up to ``DICTIONARY_ROWS`` rows."""
    def literal(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{x!r}D" if isinstance(x, float) else repr(x)

    lines = []
    for pair in rows.items():
        flat = [y for x in pair for y in (x if isinstance(x, tuple) else (x,))]
        lines.append("(" + ", ".join(literal(x) for x in flat) + ")")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS t({columns})")
    return F.broadcast(table) if len(lines) <= DICTIONARY_ROWS else table


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(as_col(c), F.lit(SPACES))


def strip_to_null(c) -> Column:
    """Trim, and turn an empty text into null (null stays null)."""
    return F.nullif(strip(c), F.lit(""))


def collapse_ws(c) -> Column:
    """Runs of white space become one blank; edges are trimmed."""
    return F.trim(F.regexp_replace(as_col(c), f"[{SPACES}]+", " "))


REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,30});"


def unescape(c) -> Column:
    """Character references of markup as characters; an unknown one stays as it is."""
    text = as_col(c)

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(F.substring(ref, 3, 1).isin("x", "X"), F.lpad(digits, 8, "0")).otherwise(F.lpad(F.hex(digits.try_cast("int")), 8, "0"))
        known = lookup({f"&{name};": chr(code) for name, code in name2codepoint.items()}, ref)
        return F.when(F.startswith(ref, F.lit("&#")), F.decode(F.unhex(code), "UTF-32")).otherwise(F.coalesce(known, ref))

    # The pieces between the references and the references, in turn.
    parts = F.arrays_zip(F.split(text, REFERENCE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("ref"))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(character(p["ref"]), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(out: Column, part: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", out).otherwise(F.concat(out, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    closed = F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), closed).otherwise(path)


def join_url(base: str, href) -> Column:
    """An address as seen from a page at ``base``."""
    to, own = as_col(href), urlsplit(base)
    origin, folder = f"{own.scheme}://{own.netloc}", own.path.rsplit("/", 1)[0] + "/" if "/" in own.path else "/"
    here = origin + own.path
    path = F.regexp_extract(to, r"^([^?#]*)", 1)
    rest = F.substring(to, F.length(path) + 1, F.length(to))
    return (
        F.when(to == "", F.lit(base))
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit(f"{own.scheme}:"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(F.lit(origin), without_dots(path), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(F.lit(here), to))
        .when(F.startswith(to, F.lit("#")), F.concat(F.lit(base.split("#")[0]), to))
        .otherwise(F.concat(F.lit(origin), without_dots(F.concat(F.lit(folder), path)), rest))
    )


def slugify(c) -> Column:
    """File-safe label: '/', ':' and blanks become '_', square brackets go."""
    return F.translate(as_col(c), "/: []", "___")


def number_or_null(c: Column) -> Column:
    """Text to double; anything that does not look like a whole number text becomes null.

    Looking first is much cheaper than a failing cast.
    """
    return F.when(c.rlike(WHOLE_NUMBER), c.try_cast("double"))


def extract_numeric(c, coerce: bool = False) -> Column:
    """First numeric token of a text as double, else null.

    ``coerce=True`` first casts any other type to text.
    """
    c = as_col(c)
    text = c.cast("string") if coerce else c
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")


def standardize_property(c, synonyms: dict[str, str] | None = None) -> Column:
    """Standard property name; unknown names are kept, trimmed."""
    name = strip_to_null(c)
    return F.coalesce(lookup(synonyms or D.PROPERTY_SYNONYMS, F.lower(name)), name)


def strip_unit_suffix(value, unit) -> Column:
    """Remove a trailing ' unit' from the value text."""
    value, unit = as_col(value), as_col(unit)
    suffix = F.concat(F.lit(" "), unit)
    kept = F.substring(value, F.lit(1), F.length(value) - F.length(suffix))
    cut = (F.length(value) > 0) & (F.length(unit) > 0) & F.endswith(value, suffix)
    return F.when(cut, strip(kept)).otherwise(value)


def split_value_unit(c) -> Column:
    """Struct(value, unit) from 'v (u)' or 'number rest'; other text is all value."""
    text = strip(as_col(c).cast("string"))
    bracket = r"^(.+?)\s*\(([^)]+)\)\s*$"
    number = r"^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s+(.+))?$"
    pattern_hit = text.rlike(bracket)
    value = (
        F.when(pattern_hit, strip(F.regexp_extract(text, bracket, 1)))
        .when(text.rlike(number), strip(F.regexp_extract(text, number, 1)))
        .otherwise(text)
    )
    unit = (
        F.when(pattern_hit, strip(F.regexp_extract(text, bracket, 2)))
        .when(text.rlike(number), strip(F.regexp_extract(text, number, 2)))
        .otherwise(F.when(text.isNotNull(), F.lit("")))
    )
    return F.struct(value.alias("value"), unit.alias("unit"))


def split_header_unit(c) -> Column:
    """Struct(name, unit) from 'name (unit)'."""
    text = strip(c)
    pattern = r"^(.*?)\s*\(([^)]+)\)\s*$"
    hit = text.rlike(pattern)
    return F.struct(
        F.when(hit, strip(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("name"),
        F.when(hit, strip(F.regexp_extract(text, pattern, 2)))
        .when(text.isNotNull(), F.lit(""))
        .alias("unit"),
    )


def format_condition(fields: Column) -> Column:
    """'k=v | k=v' from a map or an array of (key, value) structs, empty values left out."""
    def render(entries: Column) -> Column:
        filled = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
        return F.array_join(
            F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | "
        )

    return render(fields)


def pick_structure(isomeric, canonical, generic) -> Column:
    """First non-empty structure text: isomeric, canonical, generic, else ''."""
    filled = [F.nullif(as_col(c), F.lit("")) for c in (isomeric, canonical, generic)]
    return F.coalesce(*filled, F.lit(""))


def _contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def classify_column(c) -> Column:
    """Column name -> identity, feature or one of the four target families."""
    c = as_col(c)
    out = F.when(c.isin(D.IDENTITY_COLUMNS), F.lit("identity")).when(
        c.isin(D.PROPERTY_FEATURES) | ~F.startswith(c, F.lit("ChEMBL:")), F.lit("feature")
    )
    for family, words in D.TARGET_FAMILIES.items():
        out = out.when(_contains_any(c, words), F.lit(family))
    return out.otherwise(F.lit("target_other"))


def is_target(c, strict: bool = False) -> Column:
    """Whether a column name denotes an activity target.

    ``strict`` wants the prefix, or a token that starts a word, and refuses the
    bare prefix.
    """
    c = as_col(c)
    if not strict:
        return _contains_any(c, D.TARGET_TOKENS)
    hit = F.startswith(c, F.lit(D.STRICT_TARGET_PREFIX)) | _contains_any(c, D.STRICT_TARGET_TOKENS)
    return hit & (c != D.STRICT_TARGET_PREFIX)


def is_target_name(name: str, strict: bool = False) -> bool:
    """The same rule for a schema's column name on the driver."""
    if not strict:
        return any(t in name for t in D.TARGET_TOKENS)
    hit = name.startswith(D.STRICT_TARGET_PREFIX) or any(t in name for t in D.STRICT_TARGET_TOKENS)
    return hit and name != D.STRICT_TARGET_PREFIX


def quoted(label: str) -> str:
    """A label as literal regular expression text (Java syntax)."""
    return re.sub(r"([\\.\[\](){}*+?^$|])", r"\\\1", label)
