"""A page as a list of blocks: its main content, and as Markdown.

The tags of a page are folded, one after the other, into blocks of text with
their kind and the share of their text that is links. Everything is a built-in
column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Elements that hold no text of the page.
UNSEEN = ("head", "script", "style", "noscript", "template", "svg", "iframe", "select", "button")
# Elements, and words in a class or id, of what surrounds the main content.
SURROUNDING = ("nav", "header", "footer", "aside", "form")
SURROUNDING_WORDS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie menu nav navbar navigation "
    "newsletter pagination popup promo related share sharing sidebar social sponsor sponsored subscribe"
).split()
# Elements that may be left out by such a word.
CONTAINERS = "div section ul ol table p span article main".split()
BLOCKS = (*tx.BLOCK_ELEMENTS, "nav", "header", "footer", "aside", "form", "main")
# A block of running text has this many characters or ends like a sentence, and at most this share of links.
LONG_BLOCK = 40
LINK_SHARE = 0.33
# How far a heading may be from the text it belongs to, in blocks.
HEADING_REACH = 3
# Tags folded before the finished blocks are set aside.
TAG_BLOCK = 256

BLOCK_TYPE = "array<struct<kind:string,level:int,text:string,links:int>>"
_TAG = r"(?s)<!--.*?-->|<[/!?A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
_KEPT = ("skip", "depth", "link", "kind", "level", "lists", "cells", "text", "links")


def _tokens(html: Column, main_only: bool) -> Column:
    """``array<struct<tag,close,alone,left,text>>``: texts have an empty tag, ``left`` marks elements to leave out."""
    marked = F.regexp_replace(html, _TAG, "\u0001$0\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: p != "")

    def token(p: Column) -> Column:
        tag = F.lower(F.regexp_extract(p, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        is_tag = p.rlike(r"(?s)^<[/!?A-Za-z].*>$")
        left = tag.isin(*UNSEEN)
        if main_only:
            words = F.split(F.lower(F.regexp_extract(p, r"(?is)\s(?:class|id)\s*=\s*[\"']?([^\"'>]*)", 1)), "[^a-z]+")
            around = F.arrays_overlap(words, F.array(*[F.lit(w) for w in SURROUNDING_WORDS]))
            left = left | tag.isin(*SURROUNDING) | (tag.isin(*CONTAINERS) & around)
        return F.struct(
            F.when(is_tag, F.when(tag == "", F.lit("!")).otherwise(tag)).otherwise(F.lit("")).alias("tag"),
            p.startswith("</").alias("close"),
            p.endswith("/>").alias("alone"),
            (is_tag & left).alias("left"),
            F.when(is_tag, F.lit("")).otherwise(p).alias("text"),
        )

    return F.transform(pieces, token)


def _state(acc: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(n, acc[n]).alias(n) for n in (*_KEPT, "out")])


def _closed(acc: Column) -> Column:
    """The finished blocks with the open one, if it has any text."""
    text = F.array_join(acc["text"], "")
    some = F.exists(acc["text"], lambda t: tx.strip(t) != "")
    block = F.struct(acc["kind"].alias("kind"), acc["level"].alias("level"), text.alias("text"), acc["links"].alias("links"))
    return F.when(some, F.array_append(acc["out"], block)).otherwise(acc["out"])


def _step(acc: Column, t: Column) -> Column:
    no_text = F.expr("cast(array() as array<string>)")
    opens = ~t["close"]
    inside = (
        F.when(t["tag"] != acc["skip"], _state(acc))
        .when(opens & ~t["alone"], _state(acc, depth=acc["depth"] + 1))
        .when(opens, _state(acc))
        .when(acc["depth"] > 1, _state(acc, depth=acc["depth"] - 1))
        .otherwise(_state(acc, skip=F.lit(""), depth=F.lit(0)))
    )
    lists = (
        F.when(t["tag"].isin("ul", "ol") & opens, F.concat(acc["lists"], F.substring(t["tag"], 1, 1)))
        .when(t["tag"].isin("ul", "ol"), F.substring(acc["lists"], F.lit(1), F.greatest(F.length(acc["lists"]) - 1, F.lit(0))))
        .otherwise(acc["lists"])
    )
    heading = t["tag"].rlike("^h[1-6]$")
    kind = (
        F.when(t["close"], F.lit("p"))
        .when(heading, F.lit("h"))
        .when((t["tag"] == "li") & (F.substring(acc["lists"], -1, 1) == "o"), F.lit("ol"))
        .when(t["tag"] == "li", F.lit("ul"))
        .when(t["tag"] == "tr", F.lit("tr"))
        .when(t["tag"] == "pre", F.lit("pre"))
        .when(t["tag"] == "blockquote", F.lit("quote"))
        .when(t["tag"].isin("br", "p", "div") & (acc["kind"] != "h"), acc["kind"])
        .otherwise(F.lit("p"))
    )
    level = F.when(heading & opens, F.substring(t["tag"], 2, 1).cast("int")).when(kind.isin("ul", "ol"), F.length(lists)).otherwise(F.lit(0))
    fresh = _state(acc, kind=kind, level=level, lists=lists, cells=F.lit(0), text=no_text, links=F.lit(0), out=_closed(acc))
    # Inside a row only the row's own tags end it; its cells stay in one block.
    in_row = (acc["kind"] == "tr") & ~t["tag"].isin("tr", "table", "tbody", "thead", "tfoot")
    cell = F.when(
        t["tag"].isin("td", "th") & opens,
        _state(acc, cells=acc["cells"] + 1, text=F.when(acc["cells"] > 0, F.array_append(acc["text"], F.lit("\u0002"))).otherwise(acc["text"])),
    ).otherwise(_state(acc, text=F.array_append(acc["text"], F.lit(" "))))
    visible = F.length(F.regexp_replace(t["text"], r"\s+", ""))
    return (
        F.when(acc["skip"] != "", inside)
        .when(t["tag"] == "", _state(acc, text=F.array_append(acc["text"], t["text"]), links=acc["links"] + acc["link"] * visible))
        .when(t["left"] & opens & ~t["alone"], _state(fresh, lists=acc["lists"], skip=t["tag"], depth=F.lit(1)))
        .when(t["tag"] == "a", _state(acc, link=opens.cast("int")))
        .when(in_row & t["tag"].isin("td", "th", *BLOCKS), cell)
        .when(t["tag"].isin(*BLOCKS), fresh)
        .otherwise(_state(acc))
    )


def blocks(html: Column, main_only: bool = False) -> Column:
    """``array<struct<kind,level,text,links>>`` of a page, in its order.

    ``kind`` is ``p``, ``h`` (of ``level`` 1 to 6), ``ul`` or ``ol`` (a list's item, ``level`` deep), ``tr``,
    ``pre`` or ``quote``. White space is collapsed but for ``pre``; cells of a row are joined by
    ``" | "``. ``links`` counts the characters of links without white space. Elements that hold
    no text are left out, and with ``main_only`` those around the main content.
    Tags that are not closed end with the next block; null is an empty page.

    Finished blocks are set aside every few tags, so that the fold stays linear.
    """
    start = F.expr(
        "named_struct('skip', '', 'depth', 0, 'link', 0, 'kind', 'p', 'level', 0, 'lists', '', 'cells', 0,"
        f" 'text', cast(array() as array<string>), 'links', 0, 'done', cast(array() as array<{BLOCK_TYPE}>))"
    )

    def fold_part(acc: Column, part: Column) -> Column:
        first = F.struct(*[acc[n].alias(n) for n in _KEPT], F.expr(f"cast(array() as {BLOCK_TYPE})").alias("out"))
        folded = F.aggregate(part, first, _step)
        return F.transform(
            F.array(folded), lambda t: F.struct(*[t[n].alias(n) for n in _KEPT], F.array_append(acc["done"], t["out"]).alias("done"))
        )[0]

    def finish(acc: Column) -> Column:
        done = F.struct(*[acc[n].alias(n) for n in _KEPT], F.flatten(acc["done"]).alias("out"))
        return F.transform(F.array(done), _closed)[0]

    def fold(tokens: Column) -> Column:
        n = F.size(tokens)
        firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(TAG_BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(F.transform(firsts, lambda i: F.slice(tokens, i, F.lit(TAG_BLOCK))), start, fold_part, finish)

    def tidy(b: Column) -> Column:
        decoded = F.when(F.contains(b["text"], F.lit("&")), tx.unescape(b["text"])).otherwise(b["text"])
        plain = F.regexp_replace(decoded, f"{tx.WHITESPACE}+", " ")
        cells = F.transform(F.split(plain, "\u0002"), tx.strip)
        text = F.when(b["kind"] == "pre", F.regexp_replace(decoded, r"^\n|\s+$", "")).when(
            b["kind"] == "tr", F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | ")
        ).otherwise(tx.strip(plain))
        return F.struct(b["kind"].alias("kind"), b["level"].alias("level"), text.alias("text"), b["links"].alias("links"))

    folded = F.transform(F.array(_tokens(F.coalesce(html, F.lit("")), main_only)), fold)[0]
    return F.transform(folded, tidy)


def main_blocks(found: Column) -> Column:
    """The blocks of ``blocks(html, main_only=True)`` that belong to the main content.

    Running text does: a block of some length, or that ends like a sentence, with
    few links. So do rows, code and quotes with few links, and a heading shortly
    before one of these. Short blocks without an end do between two that belong.
    """

    def good(b: Column) -> Column:
        size = F.length(F.regexp_replace(b["text"], r"\s+", ""))
        text = (F.length(b["text"]) >= LONG_BLOCK) | b["text"].rlike(r"[.!?…][\"'’”)\]]*$") | b["kind"].isin("tr", "pre", "quote")
        return (b["kind"] != "h") & text & (b["links"] <= F.lit(LINK_SHARE) * size)

    def kept(bs: Column, marks: Column) -> Column:
        def belongs(b: Column, i: Column) -> Column:
            after = F.exists(F.slice(marks, i + 2, F.lit(HEADING_REACH)), lambda m: m)
            between = F.coalesce(F.get(marks, i - 1), F.lit(False)) & F.coalesce(F.get(marks, i + 1), F.lit(False))
            few = b["links"] <= F.lit(LINK_SHARE) * F.length(F.regexp_replace(b["text"], r"\s+", ""))
            return F.get(marks, i) | ((b["kind"] == "h") & after) | (between & few)

        return F.filter(bs, belongs)

    both = F.struct(found.alias("b"), F.transform(found, good).alias("m"))
    return F.transform(F.array(both), lambda s: kept(s["b"], s["m"]))[0]


def blocks_text(found: Column) -> Column:
    """One line per block."""
    return F.array_join(F.transform(found, lambda b: b["text"]), "\n")


def markdown(found: Column) -> Column:
    """Blocks as Markdown: headings, nested lists, tables with a head row, code, quotes and paragraphs."""

    def shown(b: Column, i: Column, bs: Column) -> Column:
        before = F.get(bs, i - 1)["kind"]
        indent = F.repeat(F.lit("  "), F.greatest(b["level"] - 1, F.lit(0)))
        row = F.concat(F.lit("| "), b["text"], F.lit(" |"))
        rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size(F.split(b["text"], r" \| "))))
        first_row = F.coalesce(before != "tr", F.lit(True))
        line = (
            F.when(b["kind"] == "h", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"]))
            .when(b["kind"] == "ul", F.concat(indent, F.lit("- "), b["text"]))
            .when(b["kind"] == "ol", F.concat(indent, F.lit("1. "), b["text"]))
            .when((b["kind"] == "tr") & first_row, F.concat(row, rule))
            .when(b["kind"] == "tr", row)
            .when(b["kind"] == "pre", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .when(b["kind"] == "quote", F.concat(F.lit("> "), b["text"]))
            .otherwise(b["text"])
        )
        together = (b["kind"].isin("ul", "ol") & before.isin("ul", "ol")) | ((b["kind"] == "tr") & (before == "tr"))
        return F.concat(F.when(i == 0, F.lit("")).when(together, F.lit("\n")).otherwise(F.lit("\n\n")), line)

    return F.transform(F.array(found), lambda bs: F.array_join(F.transform(bs, lambda b, i: shown(b, i, bs)), ""))[0]
