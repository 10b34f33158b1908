"""Line-first cleaning: judge every line, drop failures, then reject documents that lost too much.

Only DataFrame functions are used. One document is one row of a single narrow
stage; nothing is shuffled, so skewed sources and copies do not matter.

Defined cases: a null text has no words and no lines (it fails the base rule and
is not kept); an empty text likewise; repeated rows are judged one by one; input
columns of any name are carried inside a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

# Rule patterns; written so that Java and RE2 read them alike.
LOUD = r"[!?]{2,}|[#*$%&<>]{2,}"
SEPARATOR = r"[|»›•]"
TERMINAL = r"[.!?…:;\"'»)\]][\x20\x09-\x0D]*$"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|sitemap|contact|contact us"
    r"|about|about us|next|previous|back|back to top|read more|share|skip to content)[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy"
    r"|cookie policy|javascript|lorem ipsum|click here|subscribe to our)"
)

MAX_LOST = 0.4
MIN_WORDS = 50
FRAGMENT_WORDS = 4
LOUD_SHARE = 0.25
REPEAT_MIN_WORDS = 10
REPEAT_DISTINCT_SHARE = 1 / 3


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def _verdict(line: Column, words: Column) -> Column:
    """Name of the first rule that a line fails, or null."""
    n = F.size(words)
    loud = F.regexp_count(line, F.lit(LOUD)) > LOUD_SHARE * n
    fragment = (n < FRAGMENT_WORDS) & ~line.rlike(TERMINAL)
    repeated = (n >= REPEAT_MIN_WORDS) & (F.size(F.array_distinct(words)) < REPEAT_DISTINCT_SHARE * n)
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) | line.rlike(NAVIGATION)
    return (
        F.when(navigation, "navigation")
        .when(loud | fragment, "punctuation")
        .when(repeated | line.rlike(BOILERPLATE), "boilerplate")
    )


def judge(df: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Every input row as struct ``row`` beside its counts, ``clean_text`` and verdict.

    ``lines`` holds (line, rule) with the rule each line failed, or null.
    ``base_failed`` is the contract's base rule; ``kept`` asks also that at most
    ``max_lost`` of the characters stood on failed lines.
    """
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    base = base.withColumn("text", F.coalesce(base["row"][text_col].cast("string"), F.lit("")))
    split = base.select(
        "row", "text", _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_WHITE)).alias("full_lines"),
    )
    grams = F.transform(
        "words",
        lambda w, i: F.struct(
            F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("gram"), i.alias("at")
        ),
    )
    counted = split.select(
        "row", "words", "full_lines",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > 3, F.sort_array(F.slice(grams, 1, F.size("words") - 2))).alias("grams"),
        F.transform(
            F.transform("full_lines", lambda x: F.struct(x.alias("line"), _words(x).alias("words"))),
            lambda s: F.struct(s["line"].alias("line"), _verdict(s["line"], s["words"]).alias("rule")),
        ).alias("lines"),
    )
    twice = F.filter(
        F.transform(
            "grams",
            lambda g, i: F.when(
                (g["gram"] == F.get("grams", i - 1)["gram"]) | (g["gram"] == F.get("grams", i + 1)["gram"]), g["at"]
            ),
        ),
        lambda at: at.isNotNull(),
    )
    placed = counted.select(
        "row", "word_chars", "n_symbols", "n_dup_lines", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.sort_array(twice).alias("at"),
        F.transform(F.filter("lines", lambda s: s["rule"].isNull()), lambda s: s["line"]).alias("good"),
        F.length(F.array_join("full_lines", "")).cast("long").alias("line_chars"),
    )
    covered = F.transform(
        "at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1), p + 3) - p)
    )
    done = placed.select(
        "row", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias(
            "n_repeat_words"
        ),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_good_lines"),
        (F.col("line_chars") - F.length(F.array_join("good", ""))).alias("lost_chars"),
        "line_chars",
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    done = done.withColumn("base_failed", failed)
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("line_chars")))


def clean(df: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept rows in the columns of ``df``, their text without the failed lines.

    A text that loses no line stays as it is, white space included.
    """
    done = judge(df, text_col, max_lost)
    text = F.when(F.col("n_good_lines") == F.col("n_lines"), F.col("row")[text_col]).otherwise(F.col("clean_text"))
    whole = F.struct(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
    # Not a filter: that would be pushed below the projections above, each of their
    # expressions written out again wherever it is used.
    return done.select(F.inline(F.when(F.col("kept"), F.array(whole))))
