"""PII surrogates: detected entities get keyed replacements of their own type, script and format.

Only DataFrame functions are used. An entity has a canonical form (lower-case
address, national digits of a phone number, card digits, single name words), so that
spellings of one entity get one surrogate. A surrogate is made from keyed digests of
(type, canonical form, attempt), then laid into the spelling of each mention:
separators, case, country code and script stay, names keep the gender that their
title tells (or, without one, that of the same person elsewhere), card numbers keep a valid check digit.

Collision check: all distinct entities of the corpus are written with their
surrogates. Where two entities share a surrogate, or a surrogate is itself an entity
of the corpus, all but the least get another attempt, until none is left. Entities
that needed one are rare; they are joined back to the few rows that mention them.

Defined cases: a null text stays null, an empty one empty; an empty table gives no
rows; rows with equal ids or texts are rewritten one by one and alike; columns of
any name are carried inside a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.session import materialize

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
CARD = r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)"
# Numbers with a country code in any grouping, in pairs after a leading zero, or in groups of three and four.
PHONE = (
    r"(?<![\w+])(?:\+\d(?:[ .()/-]{0,2}\d){6,14}|0\d(?:[ .-]\d{2}){4}"
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4})(?!\w)"
)
#: What a phone number starts with besides its national digits: country code and trunk zero.
CODE = (
    r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[ .-]?)?(?:\(0\)[ .-]?|0)?"
)
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Don"
TITLES_N = "Dr|Prof"
TITLE = rf"(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.?"
PARTICLE = (
    "(?:von|van|vom|de|del|della|der|den|des|di|da|do|dos|du|la|las|le|les|los|ten|ter|zu|zum|zur|y|af|av|bin|ibn|al|el)"
)
INITIAL = r"\p{Lu}\."
# A capitalised word, with hyphens and apostrophes inside; the 's of a possessive stands outside.
WORD = r"(?:[dl]['’])?\p{Lu}(?:[\p{L}\p{M}]|['’](?!s(?![\p{L}\p{M}]))(?=\p{L})|-(?=\p{L}))*"
_PART = rf"(?:{PARTICLE} ){{0,3}}(?:{INITIAL}(?= \p{{Lu}})|{WORD})"
NAME = rf"\b{TITLE}(?: {TITLE})* {_PART}(?: {_PART})*"
TITLED = rf"\b(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b"
ANY = "|".join((EMAIL, IP, CARD, PHONE, NAME))
#: A text without any of these characters or words has no entity.
HINT = rf"@|\d\D?\d|\b(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b"
TYPES = ["email", "ip", "card", "phone", "name"]

LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшыэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}

#: Attempts that keep the length of an e-mail address or a number; later ones are longer.
FORMAT_TRIES = 8
#: IP addresses have no longer form: attempts after which more of them than can be told apart are an error.
IP_TRIES = 200

_UNIT = "struct<type:string,canonical:string,person:string>"
#: Types of the words of a name that are no entities: titles and particles stay, initials change without a check.
LOOSE = ("fixed", "initial")


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _type(hit: Column) -> Column:
    kinds = ((EMAIL, "email"), (IP, "ip"), (CARD, "card"), (PHONE, "phone"))
    out = F.lit("name")
    for pattern, kind in reversed(kinds):
        out = F.when(hit.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    # Long digit runs are cards only with a valid check digit; else they are numbers to be hidden all the same.
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _national(x: Column) -> Column:
    """Digits of a phone number without its country code and trunk zero."""
    return _digits(F.regexp_replace(x, CODE, ""))


def _gender(name: Column) -> Column:
    """By the first title that tells it."""
    titles = F.regexp_extract(name, rf"^{TITLE}(?: {TITLE})*", 0)
    return (
        F.when(titles.rlike(rf"\b(?:{TITLES_F})\b"), "f").when(titles.rlike(rf"\b(?:{TITLES_M})\b"), "m").otherwise("n")
    )


def _unit(type_: Column, canonical: Column, person: Column | None = None) -> Column:
    person = F.lit(None).cast("string") if person is None else person
    return F.struct(type_.alias("type"), canonical.alias("canonical"), person.alias("person")).cast(_UNIT)


def _loose(word: Column) -> Column:
    """The type of a word that is no entity, or null."""
    return F.when(word.rlike(rf"^(?:{TITLE}|{PARTICLE})$"), "fixed").when(word.rlike(rf"^{INITIAL}$"), "initial")


def _titled_units(hit: Column) -> Column:
    """A unit for each word of a titled name: the last is a family name, words before it are given names."""
    person = F.lower(F.regexp_replace(hit, rf"^{TITLE}(?: {TITLE})* ", ""))
    return _let(
        F.split(hit, " "),
        lambda words: F.transform(
            words,
            lambda w, i: _unit(
                F.coalesce(_loose(w), F.when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given_"), _gender(hit)))),
                F.lower(w), person,
            ),
        ),
    )


def _known_units(hit: Column, known: Column) -> Column:
    """The units of an untitled mention, looked up among the document's names.

    The types' order puts family names first, then given names with a gender.
    """
    return _let(
        F.split(hit, " "),
        lambda words: F.transform(
            words,
            lambda w, i: F.coalesce(
                F.when(i < F.size(words) - 1, F.array_min(F.filter(known, lambda u: (u["canonical"] == F.lower(w)) & (u["type"] != "family")))),
                F.array_min(F.filter(known, lambda u: u["canonical"] == F.lower(w))),
                _unit(F.lit("fixed"), F.lower(w)),
            ),
        ),
    )


def _units(type_: Column, hit: Column, known: Column) -> Column:
    """The canonical parts of a mention that get a surrogate each."""
    one = (
        F.when(type_ == "email", F.lower(hit)).when(type_ == "ip", hit)
        .when(type_ == "card", _digits(hit)).otherwise(_national(hit))
    )
    names = F.when(hit.rlike(rf"^{TITLE} "), _titled_units(hit)).otherwise(_known_units(hit, known))
    return F.when(type_ == "name", names).otherwise(F.array(_unit(type_, one))).cast(f"array<{_UNIT}>")


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` beside ``mentions``: (type, value, units) in the order of the text, and the ``pattern`` that finds them.

    Names are found by their titles; the pattern of a document then also has the
    words of its names, which are replaced wherever the document repeats them.
    """
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    text = base["row"][text_col].cast("string")
    titled = F.when(text.rlike(TITLED), F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))
    base = base.select("row", F.array_distinct(F.coalesce(titled, F.array().cast("array<string>"))).alias("titled"))
    entity = lambda u: ~u["type"].isin(*LOOSE)
    words = F.array_distinct(F.flatten(F.transform("titled", lambda h: F.split(h, " "))))
    words = F.filter(words, lambda w: (F.length(w) > 1) & _loose(w).isNull())
    base = base.select(
        "row",
        F.array_distinct(F.filter(F.flatten(F.transform("titled", _titled_units)), entity)).alias("known"),
        F.array_join(F.array_distinct(F.concat(words, F.transform(words, F.upper))), "|").alias("words"),
    )
    edge = r"[\p{L}\p{M}\p{N}_]"
    run = F.concat(
        F.lit(f"{ANY}|(?<!{edge})(?:"), F.col("words"), F.lit(rf")(?!{edge})(?: (?:{PARTICLE} ){{0,3}}(?:"),
        F.col("words"), F.lit(rf")(?!{edge}))*"),
    )
    base = base.select("row", "known", F.when(F.col("words") == "", F.lit(ANY)).otherwise(run).alias("pattern"))
    hits = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.col("pattern"), F.lit(0)))
    base = base.select("row", "known", "pattern", F.coalesce(hits, F.array().cast("array<string>")).alias("hits"))
    typed = base.select(
        "row", "known", "pattern",
        F.transform("hits", lambda h: F.struct(_type(h).alias("type"), h.alias("value"))).alias("hits"),
    )
    return typed.select(
        "row",
        F.transform(
            "hits",
            lambda h: F.struct(
                h["type"].alias("type"), h["value"].alias("value"),
                _units(h["type"], h["value"], F.col("known")).alias("units"),
            ),
        ).alias("mentions"),
        "pattern",
    )


def _grown(type_: Column, attempt: Column) -> Column:
    """How many characters longer than its entity a surrogate is, so that no space of surrogates is ever used up."""
    return F.when(type_.isin("family", "given_f", "given_m", "given_n"), attempt).otherwise(
        F.greatest(attempt - FORMAT_TRIES, F.lit(0))
    )


def _stream(key: str, type_: Column, canonical: Column, attempt: Column) -> Column:
    """Keyed hex digits, two for each character of the surrogate and some to spare."""
    size = F.length(canonical) + _grown(type_, attempt)
    blocks = F.sequence(F.lit(0), F.floor(size / 24).cast("int"))
    return F.array_join(
        F.transform(
            blocks,
            lambda b: F.sha2(
                F.concat_ws("\x1f", F.lit(key), type_, canonical, attempt.cast("string"), b.cast("string")), 256
            ),
        ),
        "",
    )


def _pick(stream: Column, at: Column, size: Column) -> Column:
    """A number below ``size`` from the stream's place ``at`` (from 0)."""
    return F.conv(F.substring(stream, 2 * at + 1, F.lit(2)), 16, 10).cast("int") % size


def _letter(alphabet: str, stream: Column, at: Column) -> Column:
    return F.substring(F.lit(alphabet), _pick(stream, at, F.lit(len(alphabet))) + 1, F.lit(1))


def _each(canonical: Column, rule) -> Column:
    """``rule(character, position)`` over all characters, joined."""
    places = F.sequence(F.lit(0), F.greatest(F.length(canonical) - 1, F.lit(0)))
    return F.array_join(F.transform(places, lambda i: rule(F.substring(canonical, i + 1, F.lit(1)), i)), "")


def _like(c: Column, stream: Column, i: Column) -> Column:
    """A character of the same class; others stay."""
    return (
        F.when(c.rlike("[0-9]"), _pick(stream, i, F.lit(10)).cast("string"))
        .when(c.rlike("[a-z]"), _letter(LATIN, stream, i))
        .otherwise(c)
    )


def _luhn(digits: Column) -> Column:
    """The check digit that completes a digit string."""
    size = F.length(digits)
    places = F.sequence(F.lit(1), size)
    total = F.aggregate(
        places, F.lit(0),
        lambda a, i: a + F.when(
            (size - i) % 2 == 0,
            F.substring(digits, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return ((10 - total % 10) % 10).cast("string")


def _name(type_: Column, canonical: Column, stream: Column, more: Column) -> Column:
    """A pronounceable word of the same script, ``more`` letters longer, with an ending of the same gender."""

    def of(script: str, alphabet: str, female: str, male: str) -> Column:
        consonants = "".join(c for c in alphabet if c not in VOWELS[script])
        body = _each(
            F.concat(canonical, F.repeat(F.lit("x"), more)),
            lambda c, i: F.when(c.rlike("[-'’]"), c).when(i % 2 == 0, _letter(consonants, stream, i)).otherwise(_letter(VOWELS[script], stream, i)),
        )
        short = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
        return _let(
            body,
            lambda x: F.when(type_ == "given_f", F.concat(short(x), F.lit(female)))
            .when(type_ == "given_m", F.concat(short(x), F.lit(male)))
            .otherwise(x),
        )

    return (
        F.when(canonical.rlike(r"\p{IsCyrillic}"), of("cyrillic", CYRILLIC, "а", "н"))
        .when(canonical.rlike(r"\p{IsGreek}"), of("greek", GREEK, "α", "ς"))
        .otherwise(of("latin", LATIN, "a", "o"))
    )


def surrogate(key: str, type_: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity."""
    return _let(_stream(key, type_, canonical, attempt), lambda stream: _made(type_, canonical, stream, _grown(type_, attempt)))


def _made(type_: Column, canonical: Column, stream: Column, more: Column) -> Column:
    longer = F.repeat(F.lit("0"), more)

    def like(x: Column) -> Column:
        return _each(x, lambda c, i: _like(c, stream, i))

    def checked(digits: Column) -> Column:
        """Digits with a valid check digit, if the canonical ones have one."""
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
        proper = _luhn(F.substring(canonical, F.lit(1), F.length(canonical) - 1)) == F.substring(
            canonical, F.length(canonical), F.lit(1)
        )
        return F.when(proper, F.concat(payload, _luhn(payload))).otherwise(digits)

    email = _let(
        F.regexp_extract(canonical, r"\.[a-z]+$", 0),
        lambda domain: F.concat(
            like(F.concat(longer, F.substring(canonical, F.lit(1), F.length(canonical) - F.length(domain)))), domain
        ),
    )
    octets = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_pick(stream, i, F.lit(254)) + 1).cast("string")), "."
    )
    return (
        F.when(type_ == "fixed", F.lit(None).cast("string"))
        .when(type_ == "initial", F.concat(_letter(LATIN, stream, F.lit(0)), F.lit(".")))
        .when(type_ == "email", email).when(type_ == "ip", octets).when(type_ == "card", _let(like(F.concat(canonical, longer)), checked))
        .when(type_ == "phone", like(F.concat(canonical, longer))).otherwise(_name(type_, canonical, stream, more))
    )


def resolve(units: DataFrame, key: str) -> DataFrame:
    """(type, canonical, attempt, surrogate) of distinct entities, without collisions.

    Each round checks the whole written table, but re-keys only entities that collide.
    Surrogates grow with the attempts, so that the rounds end however many entities
    share a length and type; only IP addresses cannot grow, and are refused in the end.
    """
    first = units.select("type", "canonical", F.lit(0).alias("attempt"))
    now = materialize(first.withColumn("surrogate", surrogate(key, F.col("type"), F.col("canonical"), F.col("attempt"))), "entities")
    while True:
        shared = now.groupBy("type", "surrogate").agg(F.count("*").alias("n"), F.min("canonical").alias("least")).filter("n > 1")
        taken = now.select("type", F.col("canonical").alias("surrogate"))
        bad = (
            now.join(shared, ["type", "surrogate"]).filter("canonical <> least").select("type", "canonical")
            .union(now.join(taken, ["type", "surrogate"], "left_semi").select("type", "canonical"))
            .distinct()
        )
        bad = materialize(bad, "collisions")
        if bad.isEmpty():
            return now
        again = now.join(bad, ["type", "canonical"], "left_semi").select("type", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if not again.filter((F.col("type") == "ip") & (F.col("attempt") > IP_TRIES)).isEmpty():
            raise ValueError("too many distinct IP addresses for surrogates that differ from all of them")
        again = again.withColumn("surrogate", surrogate(key, F.col("type"), F.col("canonical"), F.col("attempt")))
        now = materialize(now.join(bad, ["type", "canonical"], "left_anti").unionByName(again), "entities")


def _laid(value: Column, plain: Column) -> Column:
    """The digits of ``plain`` in the places of the digits of ``value``; those left over follow at the end."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    places = F.sequence(F.lit(1), F.length(value))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        digit = c.rlike("[0-9]")
        return F.struct(
            (acc["n"] + digit.cast("int")).alias("n"),
            F.concat(acc["out"], F.when(digit, F.substring(plain, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        )

    return F.aggregate(
        places, start, step,
        lambda acc: F.concat(acc["out"], F.substring(plain, acc["n"] + 1, F.greatest(F.length(plain) - acc["n"], F.lit(0)))),
    )


def _cased(value: Column, plain: Column) -> Column:
    """``plain`` with capitals where ``value`` has them."""
    return _each(
        plain,
        lambda c, i: F.when(
            F.substring(value, i + 1, F.lit(1)) != F.lower(F.substring(value, i + 1, F.lit(1))), F.upper(c)
        ).otherwise(c),
    )


def _mention(m: Column) -> Column:
    """The text that replaces a mention, from the surrogates of its units."""
    value, first = m["value"], F.get(m["made"], F.lit(0))
    phone = _let(
        F.regexp_extract(value, CODE, 0),
        lambda code: F.concat(
            code, _let(F.substring(value, F.length(code) + 1, F.length(value)), lambda rest: _laid(rest, first))
        ),
    )
    name = _let(
        F.split(value, " "),
        lambda words: F.array_join(
            F.transform(m["made"], lambda w, i: F.when(w.isNull(), F.get(words, i)).otherwise(_cased(F.get(words, i), w))), " "
        ),
    )
    return (
        F.when(m["type"] == "email", _cased(value, first))
        .when(m["type"] == "ip", first)
        .when(m["type"] == "card", _laid(value, first))
        .when(m["type"] == "phone", phone)
        .otherwise(name)
    )


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with surrogates in their text, beside ``n_<type>`` counts of the mentions.

    The key is a secret of the caller: the same key gives the same surrogates in
    every run over the same corpus.
    """
    found = detect(df, text_col).withColumn("at", F.monotonically_increasing_id())
    found = materialize(found, "mentions")
    units = (
        found.select("at", F.explode("mentions").alias("m")).select("at", F.explode("m.units").alias("u"))
        .select("at", "u.*").filter(~F.col("type").isin(*LOOSE))
    )
    told = materialize(_told(units), "told")
    fixes = None
    if not told.isEmpty():
        units = units.join(told, ["type", "canonical", "person"], "left")
        fixes = _map(units.filter("gendered IS NOT NULL"), F.concat_ws(":", "type", "canonical", "person"), "gendered", "genders")
        units = units.withColumn("type", F.coalesce("gendered", "type"))
    table = resolve(units.select("type", "canonical").distinct(), key)
    later = materialize(table.filter("attempt > 0").select("type", "canonical", "attempt"), "attempts")
    plain = found.withColumns({"genders": F.lit(None).cast("map<string,string>"), "again": F.lit(None).cast("map<string,int>")})
    if fixes is not None:
        plain = plain.drop("genders").join(fixes, "at", "left")
    if not later.isEmpty():
        again = _map(units.join(later, ["type", "canonical"]), F.concat_ws(":", "type", "canonical"), "attempt", "again")
        plain = plain.drop("again").join(again, "at", "left")
    return _rewritten(plain, key, text_col, df.columns)


def _told(units: DataFrame) -> DataFrame:
    """(type, canonical, person, gendered): given names without a gender whose person has one by other titles."""
    genders = units.filter("type LIKE 'given%'").groupBy("person", "canonical").agg(
        F.count_if(F.col("type") == "given_n").alias("n"),
        F.min(F.when(F.col("type") != "given_n", F.col("type"))).alias("gendered"),
        F.max(F.when(F.col("type") != "given_n", F.col("type"))).alias("other"),
    )
    found = genders.filter("n > 0 AND gendered = other")
    return found.select(F.lit("given_n").alias("type"), "canonical", "person", "gendered")


def _map(units: DataFrame, name: Column, value: str, out: str) -> DataFrame:
    """Per row number, a map from units to a value."""
    pairs = units.select("at", F.struct(name.alias("name"), F.col(value)).alias("pair")).distinct()
    return pairs.groupBy("at").agg(F.map_from_entries(F.collect_list("pair")).alias(out))


def _equals(value: str):
    return lambda x: x == value


def _rewritten(plain: DataFrame, key: str, text_col: str, columns: list[str]) -> DataFrame:
    text = F.col("row")[text_col].cast("string")
    type_of = lambda u: F.coalesce(
        F.element_at("genders", F.concat_ws(":", u["type"], u["canonical"], u["person"])), u["type"]
    )
    attempt = lambda u: F.coalesce(F.element_at("again", F.concat_ws(":", type_of(u), u["canonical"])), F.lit(0))
    made = lambda m: F.transform(
        m["units"], lambda u: surrogate(key, type_of(u), u["canonical"], attempt(u))
    )
    settled = plain.select(
        "row", "mentions", "pattern",
        F.transform(
            "mentions", lambda m: F.struct(m["type"].alias("type"), m["value"].alias("value"), made(m).alias("made"))
        ).alias("settled"),
    )
    parts = settled.select(
        "row", "mentions",
        F.when(F.size("settled") > 0, F.split(text, F.col("pattern"), -1)).alias("gaps"),
        F.transform("settled", _mention).alias("made"),
    )
    joined = F.array_join(
        F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("made", i), F.lit("")))), ""
    )
    new = F.when(F.size("mentions") > 0, joined).otherwise(text)
    types = F.transform("mentions", lambda m: m["type"])
    counts = [F.size(F.filter(types, _equals(t))).cast("long").alias(f"n_{t}") for t in TYPES]
    kept = [(new if c == text_col else F.col("row")[c]).alias(c) for c in columns if c not in {f"n_{t}" for t in TYPES}]
    return parts.select(*kept, *counts)
