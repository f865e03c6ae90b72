"""Text expressions: whitespace, sentences, chunks, blocks, ids, markup.

Everything here is a built-in column expression, so it stays on the JVM and
inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as whitespace. One class is used
# everywhere because Java's \s, RE2's \s and Unicode disagree.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Default sizes, in characters.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
# Sentences folded before the finished chunks are set aside.
SENTENCE_BLOCK = 128
BLOCK_SIZE = 50_000

# Fixed value: the DNS namespace of RFC 4122, as hex.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# Named character references that are decoded (numeric ones
# are decoded by code point). "&amp;" comes last so nothing decodes twice.
NAMED_REFERENCES = {
    "nbsp": " ",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "copy": "©",
    "reg": "®",
    "middot": "·",
    "bull": "•",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "euro": "€",
    "trade": "™",
    "amp": "&",
}

# Elements whose content is not main text.
DROPPED_ELEMENTS = ("head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form")

# Elements that end a line of text.
BLOCK_ELEMENTS = (
    "address article blockquote body br caption dd div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table tbody tfoot thead tr ul"
).split()


# The same code points spelled out, for trimming without a pattern.
WHITESPACE_CHARS = "".join(
    chr(c)
    for low, high in [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A)]
    + [(0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
    for c in range(low, high + 1)
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def sentence_array(text: Column) -> Column:
    """Sentences of a text; the end mark stays with its sentence.

    Stripping once before the split leaves no piece with outer whitespace.
    """
    pieces = F.split(strip(text), f"(?<=[.!?]){WHITESPACE}+")
    return F.filter(pieces, lambda s: s != F.lit(""))


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<struct<start,overlap,text>>`` of overlapping sentence chunks.

    A fold over blocks of sentences, and inside a block over its sentences. The
    state holds the open chunk and the block's finished chunks; those of earlier
    blocks are kept as one array per block, so that appending copies few
    references and the whole is linear in the length of a document. Sizes count
    characters of sentences without the joining spaces. A null text has no chunks.
    """

    def carried(cur: Column) -> Column:
        start = F.expr("named_struct('kept', cast(array() as array<string>), 'len', 0, 'open', true)")

        def step(acc: Column, s: Column) -> Column:
            fits = acc["open"] & (acc["len"] + F.length(s) <= F.lit(overlap))
            return F.when(
                fits,
                F.struct(
                    F.array_prepend(acc["kept"], s).alias("kept"),
                    (acc["len"] + F.length(s)).alias("len"),
                    F.lit(True).alias("open"),
                ),
            ).otherwise(F.struct(acc["kept"].alias("kept"), acc["len"].alias("len"), F.lit(False).alias("open")))

        return F.aggregate(F.reverse(cur), start, step)

    def closed(acc: Column) -> Column:
        return F.array_append(
            acc["out"],
            F.struct(
                acc["start"].alias("start"),
                acc["overlap"].alias("overlap"),
                F.array_join(acc["cur"], " ").alias("text"),
            ),
        )

    def grow(acc: Column, s: Column) -> Column:
        return F.struct(
            F.array_append(acc["cur"], s).alias("cur"),
            (acc["len"] + F.length(s)).alias("len"),
            acc["start"].alias("start"),
            acc["overlap"].alias("overlap"),
            acc["out"].alias("out"),
        )

    def flush(acc: Column, s: Column) -> Column:
        # A one-element transform binds the overlap once for all its uses.
        return F.transform(
            F.array(carried(acc["cur"])),
            lambda t: F.struct(
                F.array_append(t["kept"], s).alias("cur"),
                (t["len"] + F.length(s)).alias("len"),
                (acc["start"] + acc["len"] + F.size(acc["cur"]) - F.lit(1) - t["len"]).alias("start"),
                t["len"].alias("overlap"),
                closed(acc).alias("out"),
            ),
        )[0]

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["len"] + F.length(s) > F.lit(size))
        return F.when(full, flush(acc, s)).otherwise(grow(acc, s))

    chunks = "array<struct<start:int,overlap:int,text:string>>"

    def fold_block(acc: Column, block: Column) -> Column:
        kept = [acc[name].alias(name) for name in ("cur", "len", "start", "overlap")]
        folded = F.aggregate(block, F.struct(*kept, F.expr(f"cast(array() as {chunks})").alias("out")), step)
        return F.transform(
            F.array(folded),
            lambda t: F.struct(
                *[t[name].alias(name) for name in ("cur", "len", "start", "overlap")],
                F.array_append(acc["done"], t["out"]).alias("done"),
            ),
        )[0]

    def finish(acc: Column) -> Column:
        done = F.flatten(acc["done"])
        last = F.struct(acc["start"].alias("start"), acc["overlap"].alias("overlap"), F.array_join(acc["cur"], " ").alias("text"))
        return F.when(F.size(acc["cur"]) > 0, F.array_append(done, last)).otherwise(done)

    def fold(sentences: Column) -> Column:
        n = F.size(sentences)
        firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(SENTENCE_BLOCK))).otherwise(F.expr("cast(array() as array<int>)"))
        start = F.expr(
            "named_struct('cur', cast(array() as array<string>), 'len', 0, 'start', 0, 'overlap', 0,"
            f" 'done', cast(array() as array<{chunks}>))"
        )
        blocks = F.transform(firsts, lambda i: F.slice(sentences, i, F.lit(SENTENCE_BLOCK)))
        return F.aggregate(blocks, start, fold_block, finish)

    # A one-element transform binds the sentences once for all their uses.
    return F.transform(F.array(sentence_array(text)), fold)[0]


def block_array(text: Column, size: int = BLOCK_SIZE) -> Column:
    """Fixed-size blocks of a text; an empty text has none."""
    offsets = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    blocks = F.transform(offsets, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(text) > 0, blocks).otherwise(F.expr("cast(array() as array<string>)"))


def content_id(text: Column) -> Column:
    """Name-based UUID (version 5, DNS namespace) of a text."""
    name = F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text, "UTF-8"))
    digest = F.sha1(name)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def approx_tokens(text: Column) -> Column:
    """About one token per four characters."""
    return F.floor(F.length(text) / F.lit(4)).cast("long")


def unescape(text: Column) -> Column:
    """Decode numeric and the common named character references."""

    def decoded(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def piece(p: Column, i: Column) -> Column:
        dec = F.regexp_extract(p, r"^0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(p, r"^[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = (
            F.when(dec != "", dec.cast("long"))
            .when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        )
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(p, r"^[xX]?[0-9a-fA-F]+;", "")
        return (
            F.when(i == 0, p)
            .when(code == 38, F.concat(F.lit("&amp;"), rest))
            .when(valid, F.concat(decoded(code), rest))
            .otherwise(F.concat(F.lit("&#"), p))
        )

    def numeric(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&#"), piece)
        return F.when(F.contains(t, F.lit("&#")), F.array_join(pieces, "")).otherwise(t)

    # A one-element transform binds the text once for all its uses.
    out = F.transform(F.array(text), numeric)[0]
    for name, char in NAMED_REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def hidden_pattern(elements: tuple[str, ...]) -> str:
    """Comments, and the named elements with their content, as one pattern."""
    spans = [rf"<{name}(?:\s[^>]*)?>.*?</{name}\s*>" for name in elements]
    return "(?is)" + "|".join(["<!--.*?-->", *spans])


def drop_hidden(html: Column, elements: tuple[str, ...] = ("script", "style")) -> Column:
    return F.regexp_replace(html, hidden_pattern(elements), "")


def main_text(html: Column) -> Column:
    """Readable text of a page: one line per block, references decoded."""
    out = drop_hidden(html, DROPPED_ELEMENTS)
    out = F.regexp_replace(out, r"(?i)</?(?:td|th)(?:\s[^>]*)?>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCK_ELEMENTS)})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[A-Za-z/!][^>]*>", "")
    out = unescape(out)
    out = F.regexp_replace(out, r"[\t\x{a0} ]+", " ")
    out = F.regexp_replace(out, r" ?[\r\n][ \r\n]*", "\n")
    return strip(out)
