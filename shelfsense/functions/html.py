"""Extraction from stored HTML with native string functions.

A selector is turned into the pattern of an opening tag; attributes may be quoted or not. An
element's end is found by balancing tags of its name, or, where matches lie inside each other,
by one pass over all tags of the page that labels every element with the places of its opening
and closing tag. Text is either the mere content or rendered: blocks and ``<br>`` begin new lines.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html.entities import name2codepoint
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# --- fixed values -----------------------------------------------------------
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
)
# Elements that are rendered as lines of their own, and those that are set off by a blank.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "br", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
)
CELL_TAGS = ("td", "th")
# --- end of fixed values ----------------------------------------------------

# Character references by name (those of HTML 4), and the numbers that stand for Windows-1252.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
MOVED = {n: _html.unescape(f"&#{n};") for n in range(128, 160) if _html.unescape(f"&#{n};") != chr(n)}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
ANY_TAG = "</?[a-zA-Z][^>]*>"
_BREAK = "\ue000"  # marks a line break until blanks around it are gone
INVISIBLE = r"(?is)<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>|<!--.*?-->"
_SELECTOR = re.compile(
    r"^(?P<tag>[a-z][a-z0-9]*)?(?P<cls>\.[\w-]+)?(?P<id>#[\w-]+)?"
    r"(?P<attrs>(?:\[[\w-]+(?:[*^]?=(?:'[^']*'|\"[^\"]*\"))?\])*)$"
)
_ATTR = re.compile(r"\[([\w-]+)(?:([*^]?=)['\"]([^'\"]*)['\"])?\]")


#: Anything before an attribute, whole quoted values at a time.
_SKIP = r"(?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*?[^>\"']*?(?:\s|(?<=[\"']))"
_BARE = r"[^\s\"'=<>`]"


def _value(inside: str) -> str:
    """An attribute value, quoted or not; ``inside`` uses ``~`` for any run of other characters."""
    double, single = inside.replace("~", '[^"]*'), inside.replace("~", "[^']*")
    bare = inside.replace(r"(?:~\s)?", "").replace(r"(?:\s~)?", "").replace("~", f"{_BARE}*")
    return rf"(?:\"{double}\"|'{single}'|{bare}(?=[\s>]))"


def _escape(value: str) -> str:
    return re.escape(value).replace(r"\ ", " ")


def _conditions(selector: str) -> tuple[str, dict[str, str], list[str]]:
    """Tag pattern, one pattern per attribute, and the literal words a match contains."""
    parts = _SELECTOR.match(selector)
    if not parts:
        raise ValueError(f"unsupported selector: {selector}")
    inside, words = {}, []
    if parts["cls"]:
        name = parts["cls"][1:]
        inside["class"] = rf"(?:~\s)?{_escape(name)}(?:\s~)?"
        words += [name, "class"]
    if parts["id"]:
        inside["id"] = _escape(parts["id"][1:])
        words.append(parts["id"][1:])
    for name, op, value in _ATTR.findall(parts["attrs"] or ""):
        words += [name, value] if value else [name]
        if op == "*=" and name in inside:  # two words wanted in one value, in this order
            inside[name] += f"{_escape(value)}~"
        else:
            inside[name] = {
                "": "~", "=": _escape(value), "^=": f"{_escape(value)}~",
                "*=": f"~{_escape(value)}~",
            }[op]
    tag = f"(?i:{parts['tag']})" if parts["tag"] else "[a-zA-Z][a-zA-Z0-9-]*"
    return tag, {name: rf"{name}\s*=\s*{_value(p)}" for name, p in inside.items()}, words


def opening_tag(selector: str) -> str:
    """The pattern of an opening tag that satisfies ``selector``; attributes in any order."""
    tag, attributes, _ = _conditions(selector)
    if not attributes:
        return rf"<{tag}(?:\s[^>]*)?>"
    orders = [rf"(?:{_SKIP})?" + _SKIP.join(order) for order in permutations(attributes.values())]
    return rf"<{tag}\s+(?:{'|'.join(orders)})[^>]*>"


def needed_words(selector: str) -> list[str]:
    return _conditions(selector)[2]


def opener(html: Column, selector: str) -> Column:
    """The first opening tag matching ``selector``; empty when there is none.

    A plain substring test comes first, so most of the text never meets the pattern.
    """
    found = F.regexp_extract(html, opening_tag(selector), 0)
    tag = _SELECTOR.match(selector)["tag"] or ""
    if sum(map(str.isalpha, tag)) == 1:  # two spellings, each cheaper to look for than a pattern
        spelled = html.contains(f"<{tag}") | html.contains(f"<{tag.upper()}")
        found = F.when(spelled, found).otherwise(F.lit(""))
    for word in needed_words(selector):
        found = F.when(html.contains(word), found).otherwise(F.lit(""))
    return found


def visible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, "")


def _character(code: Column) -> Column:
    """The character with that number, from its UTF-8 bytes; numbers without one give U+FFFD."""
    low = [F.shiftright(code, shift).bitwiseAND(63) + 128 for shift in (0, 6, 12)]
    two = (F.shiftright(code, 6) + 192) * 256 + low[0]
    three = ((F.shiftright(code, 12) + 224) * 256 + low[1]) * 256 + low[0]
    four = (((F.shiftright(code, 18) + 240) * 256 + low[2]) * 256 + low[1]) * 256 + low[0]
    coded = F.when(code < 128, code).when(code < 2048, two).when(code < 65536, three).otherwise(four)
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    moved = F.map_from_arrays(F.lit(list(MOVED)), F.lit(list(MOVED.values())))
    plain = F.decode(F.unhex(F.hex(F.when(known, coded).otherwise(0xEFBFBD))), "UTF-8")
    return F.when(code.between(128, 159), F.coalesce(F.try_element_at(moved, code.cast("int")), plain)).otherwise(plain)


def _referred(reference: Column) -> Column:
    """What a character reference stands for; an unknown name stands for itself."""
    names = F.map_from_arrays(F.lit(list(NAMED)), F.lit(list(NAMED.values())))
    body = F.substr(reference, F.lit(3), F.length(reference) - 3)
    number = F.when(F.lower(F.left(body, F.lit(1))) == "x", F.conv(F.substr(body, F.lit(2)), 16, 10)).otherwise(body)
    name = F.substr(reference, F.lit(2), F.length(reference) - 2)
    return F.when(F.substr(reference, F.lit(2), F.lit(1)) == "#", bind(number.try_cast("bigint"), _character)).otherwise(
        F.coalesce(F.try_element_at(names, name), reference)
    )


def decode_entities(text: Column) -> Column:
    """Character references read once, from left to right, so that ``&amp;lt;`` gives ``&lt;``."""

    def decoded(text: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, REFERENCE, -1),
            F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referred),
            lambda gap, character: F.array(gap, character),
        )
        return F.when(text.contains("&"), F.array_join(F.flatten(pieces), "")).otherwise(text)

    return bind(text, decoded)


def inner_text(inner: Column) -> Column:
    """The content without tags, as it stands."""
    return strip(decode_entities(F.regexp_replace(inner, "<[^>]*>", "")))


def rendered_text(inner: Column) -> Column:
    """The content as lines: blocks and ``<br>`` end the line before and after them, cells of a
    table are set off by a blank. Line breaks that stand in the text itself are kept."""
    blocks = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?>"
    cells = rf"(?i)</(?:{'|'.join(CELL_TAGS)})\s*>"

    def lines(raw: Column) -> Column:
        broken = F.regexp_replace(F.regexp_replace(raw, blocks, _BREAK), cells, " ")
        bare = F.regexp_replace(broken, "<[^>]*>", "")
        return F.regexp_replace(bare, rf"[ \t\r\n\f]*{_BREAK}[ \t\r\n\f{_BREAK}]*", "\n")

    return strip(decode_entities(bind(inner, lambda raw: F.when(raw.contains("<"), lines(raw)).otherwise(raw))))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^<([a-zA-Z][a-zA-Z0-9-]*)", 1))


def after(html: Column, tag: Column) -> Column:
    return F.substr(html, F.instr(html, tag) + F.length(tag))


def first_inner(html: Column, tag: Column) -> Column:
    """What lies between the opening tag ``tag`` and the closing tag that belongs to it."""
    return bind(
        tag_name(tag),
        lambda name: F.when(name.isin(*VOID_TAGS), F.lit("")).otherwise(balanced_inner(after(html, tag), name)),
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag, NULL when absent; its value may stand without quotes."""
    pattern = rf"^<[^\s>]+{_SKIP}{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|({_BARE}+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(F.regexp_like(tag, F.lit(pattern)), decode_entities(value))


def computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    They pass through a one-row generator, which the optimizer does not look through; a
    plain projection would be copied into every later filter and expression using it.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def with_texts(
    df: DataFrame,
    html: str,
    fields: Mapping[str, Sequence[str]],
    text: Callable[[Column], Column] = inner_text,
) -> DataFrame:
    """Add one text column per field: the first selector with a non-empty text wins.

    When elements match but all are empty the result is empty, and NULL when none match.
    ``text`` makes it of an element's content: ``inner_text`` or ``rendered_text``.
    """
    tags = {
        f"_{field}": F.filter(
            F.array(*[opener(F.col(html), s) for s in selectors]), lambda tag: tag != ""
        )
        for field, selectors in fields.items()
    }
    def chosen(field: str) -> Column:
        return F.aggregate(
            F.array_distinct(f"_{field}"),
            F.lit(None).cast("string"),
            lambda found, tag: F.when(found != "", found).otherwise(text(first_inner(F.col(html), tag))),
        )

    return computed(computed(df, tags), {field: chosen(field) for field in fields}).drop(*tags)


def elements(html: Column, selector: str, outer: bool = False) -> Column:
    """Inner HTML (with ``outer`` the tags as well) of every element matching ``selector``, in order.

    Mostly an element closes before the next match, so the text up to there will do. Where one
    does not, all elements of the page are labelled in one pass.
    """
    pattern = opening_tag(selector)
    matches = F.struct(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("tags"),
        F.split(html, pattern, -1).alias("gaps"),
    )

    def whole(tag: Column, inner: Column) -> Column:
        if not outer:
            return inner
        return bind(
            tag_name(tag),
            lambda name: F.when(name.isin(*VOID_TAGS), tag).otherwise(F.concat(tag, inner, F.lit("</"), name, F.lit(">"))),
        )

    def cut(found: Column) -> Column:
        near = F.transform(found["tags"], lambda tag, i: balanced(F.get(found["gaps"], i + 1), tag_name(tag)))
        return bind(
            near,
            lambda each: F.when(
                F.forall(each, lambda n: n["closed"]),
                F.transform(each, lambda n, i: whole(F.get(found["tags"], i), n["inner"])),
            ).otherwise(_labelled(html, selector, whole)),
        )

    return bind(matches, cut)


def _labelled(html: Column, selector: str, whole: Callable[[Column, Column], Column]) -> Column:
    """The elements whose opening tag matches, from the intervals of all elements of the page."""
    page = F.struct(
        F.regexp_extract_all(html, F.lit(ANY_TAG), F.lit(0)).alias("tags"),
        F.split(html, ANY_TAG, -1).alias("gaps"),
    )

    def matching(found: Column) -> Column:
        pieces = F.flatten(F.zip_with(found["gaps"], found["tags"], lambda gap, tag: F.array(gap, tag)))
        spans = intervals(found["tags"], wanted)
        return bind(F.struct(spans.alias("spans"), pieces.alias("pieces")), lambda parts: F.transform(
            parts["spans"],
            lambda span: whole(F.get(found["tags"], span["at"]), between(parts["pieces"], span)),
        ))

    def wanted(tag: Column) -> Column:
        matches = F.regexp_like(tag, F.lit(f"^{opening_tag(selector)}$"))
        return reduce(lambda rest, word: tag.contains(word) & rest, needed_words(selector), matches)

    def between(pieces: Column, span: Column) -> Column:
        length = F.greatest(F.lit(0), 2 * (span["to"] - span["at"]) - 1)
        return F.array_join(F.slice(pieces, 2 * span["at"] + 3, length), "")

    return bind(page, matching)


def intervals(tags: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """``at`` and ``to`` of every element, in order: the numbers of its opening and closing tag.

    One fold with a stack of open elements. A closing tag ends the last open element of its name
    and those opened since; what never closes ends behind the last tag, a void element at once.
    Only elements whose opening tag is ``wanted`` are noted, so few are carried from tag to tag;
    others that hold no element leave the stack as it was and are not folded.
    """
    read = F.transform(
        tags,
        lambda tag, i: F.struct(
            F.lower(F.regexp_extract(tag, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("name"),
            tag.startswith("</").alias("closing"),
            i.alias("at"),
            (F.lit(True) if wanted is None else wanted(tag)).alias("wanted"),
        ),
    )
    element = "name:string,at:int,wanted:boolean"
    start = F.struct(
        F.array().cast(f"array<struct<{element}>>").alias("open"),
        F.array().cast("array<struct<at:int,to:int>>").alias("spans"),
    )

    def state(is_open: Column, spans: Column) -> Column:
        return F.struct(is_open.alias("open"), spans.alias("spans"))

    def noted(spans: Column, elements: Column, to: Column) -> Column:
        ended = F.transform(F.filter(elements, lambda e: e["wanted"]), lambda e: F.struct(e["at"].alias("at"), to.alias("to")))
        return F.when(F.exists(elements, lambda e: e["wanted"]), F.concat(spans, ended)).otherwise(spans)

    def close(now: Column, tag: Column) -> Column:
        names = F.reverse(F.transform(now["open"], lambda e: e["name"]))
        last = F.get(now["open"], F.size(now["open"]) - 1)["name"]
        return bind(
            F.when(last == tag["name"], F.lit(1)).otherwise(F.array_position(names, tag["name"]).cast("int")),
            lambda up: F.when(up == 0, now).otherwise(state(
                F.slice(now["open"], F.lit(1), F.size(now["open"]) - up),
                noted(now["spans"], F.slice(now["open"], F.size(now["open"]) - up + 1, up), tag["at"]),
            )),
        )

    def step(now: Column, tag: Column) -> Column:
        void = F.struct(tag["at"].alias("at"), tag["at"].alias("to"))
        opened = F.struct(*[tag[c].alias(c) for c in ("name", "at", "wanted")])
        single = F.when(tag["wanted"], F.concat(now["spans"], F.array(void))).otherwise(now["spans"])
        return (
            F.when(tag["closing"], close(now, tag))
            .when(tag["name"].isin(*VOID_TAGS), state(now["open"], single))
            .otherwise(state(F.concat(now["open"], F.array(opened)), now["spans"]))
        )

    def alone(tag: Column, other: Column) -> Column:
        """``tag`` and ``other`` open and close an element that holds no other and is not wanted."""
        return ~tag["closing"] & other["closing"] & (tag["name"] == other["name"]) & ~tag["wanted"]

    def without_leaves(tags: Column) -> Column:
        no = F.lit(False)
        return F.filter(tags, lambda tag, i: ~F.when(tag["closing"], F.coalesce(alone(F.get(tags, i - 1), tag), no)).otherwise(
            F.coalesce(alone(tag, F.get(tags, i + 1)), no)
        ))

    return F.aggregate(
        bind(read, without_leaves), start, step,
        lambda now: F.array_sort(noted(now["spans"], now["open"], F.size(tags))),
    )


def balanced_inner(rest: Column, name: Column) -> Column:
    """The inner HTML of an element ``name`` whose opening tag stands right before ``rest``."""
    return balanced(rest, name)["inner"]


def balanced(rest: Column, name: Column) -> Column:
    """Inner HTML (all of ``rest`` if the element never closes) and whether it closed.

    Where no tag of that name stands before the first closing one, that is the end.
    """

    def cut(parts: Column) -> Column:
        rest, name = parts["rest"], parts["name"]
        near = F.call_function("substring_index", rest, F.concat(F.lit("</"), name, F.lit(">")), F.lit(1))

        def ends(near: Column) -> Column:
            low = F.lower(near)
            further = (F.length(near) == F.length(rest)) | low.contains(F.concat(F.lit("<"), name)) | low.contains(
                F.concat(F.lit("</"), name)
            )
            return F.when(further, _counted(rest, name)).otherwise(
                F.struct(near.alias("inner"), F.lit(True).alias("closed"))
            )

        empty = F.struct(F.lit("").alias("inner"), F.lit(True).alias("closed"))
        return F.when(name.isin(*VOID_TAGS), empty).otherwise(bind(near, ends))

    return bind(F.struct(rest.alias("rest"), name.alias("name")), cut)


def _counted(rest: Column, name: Column) -> Column:
    """As ``balanced``, by counting the opening and closing tags of that name."""
    closing = F.concat(F.lit("(?i)</"), name, F.lit(r"\s*>"))
    start = F.struct(
        F.lit(0).alias("opened"), F.lit(0).alias("taken"), F.lit(False).alias("closed")
    )
    end = F.concat(F.lit("</"), name, F.lit(">"))

    def joined(pieces: Column, state: Column) -> Column:
        # The last piece has no closing tag behind it, so reaching it is not a close.
        closed = state["closed"] & (state["taken"] < F.size(pieces))
        inner = F.call_function("array_join", F.slice(pieces, F.lit(1), state["taken"]), end)
        return F.struct(inner.alias("inner"), closed.alias("closed"))

    def counted(parts: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            return F.when(state["closed"], state).otherwise(bind(
                state["opened"] + F.regexp_count(piece, parts["opening"]),
                lambda opened: F.struct(
                    opened.alias("opened"),
                    (state["taken"] + 1).alias("taken"),
                    (opened == state["taken"]).alias("closed"),
                ),
            ))

        return bind(F.aggregate(parts["pieces"], start, step), lambda state: joined(parts["pieces"], state))

    opening = F.concat(F.lit("(?i)<"), name, F.lit(r"[\s>]"))
    return bind(F.struct(F.split(rest, closing, -1).alias("pieces"), opening.alias("opening")), counted)
