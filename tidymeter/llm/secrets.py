"""Secret scan: fixed patterns, and character Markov models of random strings against identifiers.

Only DataFrame functions are used. Both models are first-order chains over the
printable ASCII characters, trained from labelled samples of the scanned table:
values that the fixed patterns found count as random strings; ordinary identifiers
are the words and numbers of the prose and their joins (in capitals, camel case, with
hyphens, underscores and slashes). Unlabelled candidates train neither, so that keys
which no pattern knows cannot turn the identifier model. A model has at most 95 x 95 transitions whatever
the corpus, and only these counts reach the driver. A candidate becomes a span
when its mean log-likelihood ratio per transition exceeds a threshold.

Defined cases: a null text is an empty one and has no spans; an empty table
trains nothing and gives no rows; repeated rows are scanned one by one; columns
of any name are carried inside a struct and cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract: kind, pattern, least length of the value.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: the first AKIA of a run is its longest match
HEX = r"[0-9a-f]{32,}"  # runs of 32 or more
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{8,}"
CANDIDATE_MIN = 8
# A word or number that stands alone between blanks or punctuation. Words are of one case or capitalised.
PROSE = r"(?<![A-Za-z0-9+/_=.:@-])(?:[A-Z]?[a-z]{1,14}|[A-Z]{2,15}|[0-9]{1,15})(?![A-Za-z0-9+/_=@-])"
JOINTS = ("_", "-", "/")
FIRST, LAST = 33, 126  # printable ASCII, without the blank
WIDTH = LAST - FIRST + 1
SMOOTH = 0.5
MIN_RATIO = 0.4
PLACEHOLDER = "<SECRET>"


SPAN = "struct<start:int,stop:int,kind:string,value:string>"
CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, kind: str, keep=lambda value: F.lit(True)) -> Column:
    """(start, end, kind, value) of each match that is kept; offsets are code points, the end is exclusive.

    The gaps between matches and the matches themselves add up to the text, so
    their lengths give the offsets. They are added up chunk by chunk, and only kept
    matches are gathered, so that the work is linear in the text.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    none = F.array().cast(f"array<{SPAN}>")

    def size(z: Column) -> Column:
        return F.length(z["gap"]) + F.coalesce(F.length(z["hit"]), F.lit(0))

    def spans(part: Column, begin: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            first = acc["at"] + F.length(z["gap"])
            stop = acc["at"] + size(z)
            one = F.struct(first.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), z["hit"].alias("value"))
            out = F.when(z["hit"].isNotNull() & keep(z["hit"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
            return F.struct(stop.alias("at"), out.alias("out")).cast(f"struct<at:int,out:array<{SPAN}>>")

        start = F.struct(begin.alias("at"), none.alias("out")).cast(f"struct<at:int,out:array<{SPAN}>>")
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def chunked(ps: Column) -> Column:
        def chunk(k: Column) -> Column:
            return F.slice(ps, k * CHUNK + 1, F.lit(CHUNK))

        chunks = F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / CHUNK).cast("int"))
        totals = F.transform(chunks, lambda k: F.aggregate(chunk(k), F.lit(0), lambda a, z: a + size(z)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
        return _let(starts, lambda begins: F.flatten(F.transform(chunks, lambda k: spans(chunk(k), F.get(begins, k)))))

    return F.when(text.rlike(pattern), _let(pieces, chunked)).otherwise(none)


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` beside ``text`` and ``base``: the contract's spans, one array per row."""
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    base = base.withColumn("text", F.coalesce(base["row"][text_col].cast("string"), F.lit("")))
    text = F.col("text")
    assign = _located(text, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= ASSIGN_MIN)
    return base.select(
        "row", "text",
        F.concat(assign, _located(text, ACCESS, "access"), _located(text, HEX, "hex")).alias("base"),
    )


def _identifiers(found: DataFrame) -> DataFrame:
    """(pair, count): transitions of words, numbers and their joins, by the occurrences in the prose."""
    words = found.select(F.explode(F.regexp_extract_all("text", F.lit(PROSE), F.lit(0))).alias("w")).groupBy("w").count()
    w, first, last = F.col("w"), F.substring("w", 1, 1), F.expr("substring(w, -1, 1)")
    forms = [w, F.lower(w), F.initcap(w), F.upper(w)]
    inner = F.flatten(F.array(*[F.when(F.length(w) > 1, _pairs(f)).otherwise(F.array().cast("array<int>")) for f in forms]))
    ends = [F.concat(last, F.lit(j)) for j in JOINTS] + [F.concat(F.lit(j), x) for j in JOINTS for x in (first, F.upper(first))]
    # Camel case and numbers after words: the next word's beginning is taken as any of the same table.
    ends += [F.concat(F.lower(last), F.upper(first)), F.concat(F.upper(last), F.lit("_"))]
    joins = F.transform(F.array(*ends), lambda x: _code(x, F.lit(1)) * WIDTH + _code(x, F.lit(2)))
    return words.select(F.explode(F.concat(inner, joins)).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("count"))


def _code(value: Column, at: Column) -> Column:
    return F.ascii(F.substring(value, at, F.lit(1))) - FIRST


def _pairs(value: Column) -> Column:
    """Indices into a flat WIDTH x WIDTH table, one per transition."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))),
        lambda i: _code(value, i) * WIDTH + _code(value, i + 1),
    )


def fit(df: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios (random against identifier) of all transitions, as a flat table.

    Counts come from every row of ``df``. Each distinct random string is counted
    once, so that a key copied a thousand times is one sample; words count as often
    as they occur, so that rare strings among them weigh little.
    """
    found = base_spans(df, text_col)
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value"))
    samples = (
        found.select(F.explode("base").alias("s")).select(value.alias("value")).filter(F.length("value") > 1).distinct()
    )
    random = samples.select(F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("pair").count()
    counts = {True: [SMOOTH] * WIDTH * WIDTH, False: [SMOOTH] * WIDTH * WIDTH}
    for kind, table in ((True, random), (False, _identifiers(found))):
        for r in table.collect():  # at most WIDTH x WIDTH rows
            if 0 <= r["pair"] < WIDTH * WIDTH:
                counts[kind][r["pair"]] += r["count"]
    # Strings of either case and any digit follow one law: random characters are
    # exchangeable inside their class, so the random chain is pooled by class.
    logs = {}
    for kind, table in counts.items():
        table = _pooled(table) if kind else table
        sums = [sum(table[i * WIDTH : (i + 1) * WIDTH]) for i in range(WIDTH)]
        logs[kind] = [math.log(x / sums[i // WIDTH]) for i, x in enumerate(table)]
    ratios = [a - b for a, b in zip(logs[True], logs[False])]
    # Numbers of the prose, written with or without separators, are as random as those in keys: digits and
    # separators next to each other never speak for a secret.
    plain = [_class(i) not in ("lower", "upper") for i in range(WIDTH)]
    return [min(x, 0.0) if plain[i // WIDTH] and plain[i % WIDTH] else x for i, x in enumerate(ratios)]


def _class(code: int) -> str:
    c = chr(code + FIRST)
    return "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else c


def _pooled(table: list[float]) -> list[float]:
    """Mean count over all transitions between the same two character classes."""
    total: dict[tuple[str, str], float] = {}
    size: dict[tuple[str, str], int] = {}
    kinds = [_class(i) for i in range(WIDTH)]
    keys = [(kinds[i // WIDTH], kinds[i % WIDTH]) for i in range(len(table))]
    for key, x in zip(keys, table):
        total[key] = total.get(key, 0.0) + x
        size[key] = size.get(key, 0) + 1
    return [total[key] / size[key] for key in keys]


def scan(df: DataFrame, model: list[float], text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``row`` beside ``text``, ``base`` and ``spans``: all spans by start, then kind as listed."""
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")

    def is_random(value: Column) -> Column:
        total = F.aggregate(_pairs(value), F.lit(0.0), lambda a, i: a + F.get(ratios, i))
        return total / (F.length(value) - 1) > min_ratio

    found = base_spans(df, text_col)
    found = found.withColumn("random", _located(F.col("text"), CANDIDATE, "markov", is_random))
    # What a base span covers whole is its own; what it holds in part is judged whole.
    random = F.filter("random", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["stop"] <= b["stop"])))
    order = F.array(*[F.lit(k) for k in KINDS])

    def ordered(spans: Column) -> Column:
        keyed = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
                s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"),
            ),
        )
        return F.sort_array(keyed)

    return found.select(
        "row", "text", ordered(F.col("base")).alias("base"), ordered(F.concat("base", random)).alias("spans")
    )


def digest(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def redact(df: DataFrame, model: list[float], text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of ``df`` with every span of their text replaced by a placeholder."""
    done = scan(df, model, text_col, min_ratio)
    kind = "struct<at:int,out:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        # Spans of different kinds may overlap; the later one is then cut short.
        inside = s["start"] < acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, F.lit(PLACEHOLDER))))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out")).cast(kind)

    def finish(acc: Column) -> Column:
        rest = F.substring(F.col("text"), acc["at"] + 1, F.length("text"))
        return F.concat(F.array_join(acc["out"], ""), rest)

    text = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(F.aggregate("spans", start, step, finish))
    return done.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
