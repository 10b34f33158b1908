"""Surrogates: type, format, gender, script, coreference, distinctness, and forced collisions."""

import re

from pyspark.sql import functions as F

from tidymeter.llm import surrogates as S

TEXT = (
    "Mail Anna.B@mail3.example.com or anna.b@MAIL3.example.com. Call +1 (648) 555-1250 or 648-555-1250. "
    "Host 33.122.173.101, card 4539 1488 0343 6467 and 4539148803436467. Mrs. Anna Smith met Dr. Smith and Mr. Karl Smith. "
    "Frau Анна Петрова."
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_formats_and_coreference(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "card 4539148803436467"), (3, "nothing 7 here"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.pseudonymise(df, "k").collect()}
    new = got[1]["text"]
    assert (got[1]["n_email"], got[1]["n_phone"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_name"]) == (2, 2, 1, 2, 4)
    for old in ("mail3", "648", "555-1250", "33.122.173.101", "4539", "Smith", "Anna", "Петрова"):
        assert old not in new and old.lower() not in new.lower()
    mails = re.findall(r"\S+@\S+\.com", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", new)[0]
    assert phones[:3] == phones[3:]
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", new)
    assert cards[1].replace(" ", "") == cards[2] and luhn(cards[2])
    assert got[2]["text"] == f"card {cards[2]}"
    names = re.search(r"Mrs\. (\w+) (\w+) met Dr\. (\w+) and Mr\. (\w+) (\w+)\.", new)
    assert names[2] == names[3] == names[5] and names[1].endswith("a") and names[4].endswith("o") and names[1].istitle()
    assert re.search(r"Frau [А-Яа-я]+ [А-Яа-я]+\.", new)
    assert got[3]["text"] == "nothing 7 here" and got[4]["text"] is None


def test_key_changes_surrogates(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    assert S.pseudonymise(df, "a").first()["text"] != S.pseudonymise(df, "b").first()["text"]
    assert S.pseudonymise(df, "a").first()["text"] == S.pseudonymise(df, "a").first()["text"]


def test_collisions_are_resolved(spark):
    """Two-letter names of one script have few surrogates: many collide at first."""
    units = spark.range(40).select(
        F.lit("family").alias("type"),
        F.concat(F.expr("substring('bcdfghjklmnpqrstvwxyz', cast(id % 20 as int) + 1, 1)"), F.when(F.col("id") < 20, "e").otherwise("u")).alias("canonical"),
    )
    table = S.resolve(units, "k").collect()
    assert len(table) == 40 and len({r["surrogate"] for r in table}) == 40
    assert not {r["surrogate"] for r in table} & {r["canonical"] for r in table}
    assert max(r["attempt"] for r in table) > 0


def test_attempts_reach_the_texts(spark):
    names = [f"Mr. {c}{v}" for c in "BCDFGHJKLM" for v in "ae"]
    df = spark.createDataFrame([(i, f"Here is {n} today.") for i, n in enumerate(names)], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in S.pseudonymise(df, "k").collect()}
    assert len(set(new.values())) == len(names)


def test_more_names_than_surrogates_of_their_length(spark):
    """All 105 two-letter Latin forms of a consonant and a vowel stand in the corpus: only longer surrogates are free."""
    pairs = [c + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"]
    units = spark.createDataFrame([(t, p) for t in ("family", "given_f") for p in pairs], "type string, canonical string")
    table = S.resolve(units, "k").collect()
    for kind in ("family", "given_f"):
        made = {r["surrogate"] for r in table if r["type"] == kind}
        assert len(made) == 105 and not made & set(pairs)
    df = spark.createDataFrame([(i, f"Ms {p.title()} is in.") for i, p in enumerate(pairs)], "doc_id long, text string")
    assert len({r["text"] for r in S.pseudonymise(df, "k").collect()}) == 105


def test_whole_names_and_phones(spark):
    texts = [
        "Mrs. Anna Maria Schmidt came. Later Anna Schmidt and SCHMIDT left, Schmidt's car too.",
        "Herr Thomas McDonald, Mr. Karl Smith-Jones, Dr. O'Neil, Prof. Dr. Ludwig van Houten and Mr. J. Becker.",
        "Call 01 23 45 67 89, +33 6 12 34 56 78, +33612345678, 06 12 34 56 78 or +14155550123 now.",
        "Mrs Anna Weber wrote.", "Dr Anna Weber answered.", "Mr Andrea Rossi met Mrs Andrea Weber and Dr Andrea Weber.",
        "Frau Schmidtke kept Anna and Schmidt.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r["text"] for r in S.pseudonymise(df, "k").orderBy("doc_id").collect()]
    for old in ("Anna", "Maria", "Schmidt", "SCHMIDT"):
        assert old not in new[0]
    first = re.fullmatch(r"Mrs\. (\w+) (\w+) (\w+) came\. Later (\w+) (\w+) and ([A-Z]+) left, (\w+)'s car too\.", new[0])
    assert first[1] == first[4] and first[3] == first[5] == first[7] == first[6].capitalize()
    for old in ("Thomas", "Donald", "Smith", "Jones", "Neil", "Ludwig", "Houten", "Becker"):
        assert old not in new[1]
    assert re.search(r"Mr\. \w+ [A-Z]\w+-[A-Z]\w+, Dr\. \w'\w+, Prof\. Dr\. \w+ van \w+ and Mr\. [A-Z]\. \w+\.$", new[1])
    assert not re.search(r"23 45|12 34|612345|5550123", new[2])
    spread, compact, local = re.search(r"\+33 ([\d ]+), \+33(\d+), 0([\d ]+) or \+1\d{10} now", new[2]).groups()
    assert spread.replace(" ", "") == compact == local.replace(" ", "")
    assert new[3].split()[1:3] == new[4].split()[1:3] and new[3].split()[1].endswith("a")
    male, female, doctor = re.fullmatch(r"Mr (\w+) \w+ met Mrs (\w+) \w+ and Dr (\w+) \w+\.", new[5]).groups()
    assert male.endswith("o") and female == doctor and female.endswith("a")
    assert new[6].endswith("kept Anna and Schmidt.")
