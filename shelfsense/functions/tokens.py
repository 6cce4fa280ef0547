"""Sentence and word splitting as chains of regular expressions.

Sentences end at ``. ! ?`` (plus closing quotes or brackets) followed by white space,
unless the full stop belongs to a listed abbreviation. Words follow the published Penn
Treebank conventions. Patterns use only constructs that Java and RE2 share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import bind
from .text import SPACE, WHITESPACE, single_blanks

BREAK, HELD = "\ue000", "\ue001"  # private-use characters: sentence break, held full stop

# --- fixed values -----------------------------------------------------------
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "inc", "ltd", "co",
    "no", "approx", "dept", "e.g", "i.e",
)
# Words that are written as one but split in two: word → length of the first part.
JOINED_WORDS = {
    "cannot": 3, "d'ye": 1, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "more'n": 4,
    "wanna": 3, "'tis": 2, "'twas": 2,
}
STOP_WORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "but", "by", "can", "could", "did", "do", "does", "for",
    "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into",
    "is", "it", "its", "just", "me", "more", "my", "no", "not", "of", "on", "one", "or",
    "our", "out", "she", "so", "some", "than", "that", "the", "their", "them", "then",
    "there", "they", "this", "to", "up", "us", "was", "we", "were", "what", "when",
    "which", "who", "will", "with", "would", "you", "your",
)
# --- end of fixed values ----------------------------------------------------

_END = "( |$)"
# Both rule lists see the text with a blank put in front, so that "after a blank" also
# covers its beginning.
SENTENCE_RULES = (
    (
        r"([\s(\"'\[])((?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
        + rf"))\.({SPACE})",
        rf"\1\2{HELD}\3",
    ),
    (rf"([.!?]+[\"')\]]*){SPACE}+", rf"\1{BREAK} "),
    (HELD, "."),
)
LITERALS = (HELD, "--", '"')  # patterns without special characters
# Applied in order to text whose white space is single blanks and whose sentences are
# separated by BREAK and a blank. Patterns start with the rare character they are about, so a scan
# rejects most positions at once.
WORD_RULES = (
    # a quote that opens
    (r"([ (\[<{])\"", r"\1 `` "),
    # punctuation; comma and colon stay inside numbers
    (r"([:,])([^\d]|$)", r" \1 \2"),
    (r"(\.\.+)", r" \1 "),
    (r"([;@#$%&?!*\]\[(){}<>])", r" \1 "),
    # the full stop that ends a sentence
    (rf"(\.+)([\])}}>\"' ]*)({BREAK}|$)", r" \1 \2\3"),
    ("--", " -- "),
    # quotes that close
    ('"', " '' "),
    (rf"('+){_END}", r" \1 \2"),
    # clitics
    (rf"('(?:[sSmMdD]|ll|LL|re|RE|ve|VE)|n't|N'T){_END}", r" \1 \2"),
)


# Substrings without one of which a rule changes nothing; most texts lack them.
_NEEDED = {
    WORD_RULES[0][0]: ('"',), WORD_RULES[1][0]: (":", ","), WORD_RULES[2][0]: ("..",), WORD_RULES[4][0]: (".",),
    WORD_RULES[7][0]: ("'",), WORD_RULES[8][0]: ("'",),
}
# A full stop behind a listed abbreviation. The rule itself tries every abbreviation after every
# blank; this looks back from the full stops, and tells whether the rule finds anything at all.
_ABBREVIATED = r"\.(?<=[\s(\"'\[](?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + rf")\.){SPACE}"


def _rule(pattern: str, replacement: str):
    def changed(text: Column) -> Column:
        if pattern in LITERALS:
            return F.replace(text, F.lit(pattern), F.lit(replacement))
        return F.regexp_replace(text, pattern, replacement.replace("\\", "$"))

    def guarded(text: Column) -> Column:
        if pattern == SENTENCE_RULES[0][0]:
            needed = F.regexp_like(text, F.lit(_ABBREVIATED))
        else:
            needed = reduce(lambda a, b: a | b, (text.contains(n) for n in _NEEDED[pattern]))
        return F.when(needed, changed(text)).otherwise(text)

    if pattern in _NEEDED or pattern == SENTENCE_RULES[0][0]:
        return lambda text: bind(text, guarded)
    return changed


def _apply(text: Column, rules) -> Column:
    return reduce(lambda done, rule: _rule(*rule)(done), rules, text)


def mark_sentences(text: Column) -> Column:
    return _apply(F.concat(F.lit(" "), text), SENTENCE_RULES)


def sentences(text: Column, marked: Column | None = None) -> Column:
    """The sentences of a text; ``marked`` is its ``mark_sentences`` where at hand."""
    marked = mark_sentences(text) if marked is None else marked
    pieces = F.transform(
        F.split(marked, BREAK, -1), lambda s: F.btrim(s, F.lit(WHITESPACE))
    )
    return F.filter(pieces, _not_empty)


def words(text: Column, marked: Column | None = None) -> Column:
    """The words of a text, sentence by sentence."""
    marked = mark_sentences(text) if marked is None else marked
    spaced = _apply(single_blanks(marked), WORD_RULES)
    tokens = F.filter(F.split(F.replace(spaced, F.lit(BREAK), F.lit(" ")), " ", -1), _not_empty)

    def parts(word: Column) -> Column:
        low = F.lower(word)
        size = F.lit(None).cast("int")
        for joined, length in JOINED_WORDS.items():
            size = F.when(low == joined, F.lit(length)).otherwise(size)
        return F.when(
            low.isin(*JOINED_WORDS),
            F.array(F.substr(word, F.lit(1), size), F.substr(word, size + 1)),
        ).otherwise(F.array(word))

    # Splitting joined words looks at every token, so only texts that hold one pay for it.
    low = F.lower(text)
    holds_one = reduce(lambda a, b: a | b, (low.contains(j) for j in JOINED_WORDS))
    return F.when(holds_one, F.flatten(F.transform(tokens, parts))).otherwise(tokens)


def _not_empty(piece: Column) -> Column:
    return piece != ""


def combine_text(title: Column, body: Column, concatenate: bool) -> Column:
    """The text to split: body alone, or title and body when there is a title."""
    body = F.coalesce(body, F.lit(""))
    if not concatenate:
        return body
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(" ", title, body)).otherwise(
        body
    )
