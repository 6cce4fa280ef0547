"""Rules of the splitters are skipped where they change nothing, and only there."""

import random
from functools import reduce

from pyspark.sql import functions as F

from shelfsense.functions import tokens
from shelfsense.functions.text import LATIN_SPACE, WHITESPACE, single_blanks

PIECES = (
    "Dr. ", "dr.", "Mr. Mrs. ", "e.g. ", " no. ", "no.", "(St. ", "a", "Bike", "7,5", ", ", ": ", "..", "...", ". ", "! ",
    "?)", '"', "'", "n't", "n't ", "'s ", "cannot ", "--", " ", "\t", "\n", "\xa0", " ", "　", " ", " ", "’", "é", "]",
)


def plain(text, rules):
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1].replace("\\", "$")), rules, text)


def test_guarded_rules_change_what_the_rules_change(spark):
    rng = random.Random(5)
    texts = [("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))),) for _ in range(4000)]
    df = spark.createDataFrame([*texts, (None,), ("",)], "t string")
    marked = plain(F.concat(F.lit(" "), "t"), tokens.SENTENCE_RULES)
    blanks = F.regexp_replace("t", LATIN_SPACE, " ")
    for char in WHITESPACE:
        blanks = F.replace(blanks, F.lit(char), F.lit(" ")) if ord(char) > 0xFF else blanks
    spaced = plain(single_blanks(marked), tokens.WORD_RULES)
    pairs = df.select(
        "t", marked.alias("m"), tokens.mark_sentences(F.col("t")).alias("m2"), blanks.alias("b"), single_blanks(F.col("t")).alias("b2"),
        spaced.alias("w"), tokens._apply(single_blanks(marked), tokens.WORD_RULES).alias("w2"),
    )
    assert pairs.where("not (m <=> m2 and b <=> b2 and w <=> w2)").take(3) == []


def test_texts_without_abbreviations_skip_their_rule(spark):
    plan = spark.range(1).select(tokens.mark_sentences(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "(?<=" in plan
