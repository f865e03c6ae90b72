"""Independent plain-Python statements of the rules, used as test oracles."""

from __future__ import annotations

import re
from html import unescape

SPACE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def sentences(text):
    """Read character by character: a sentence closes at white space after an end mark."""
    found, now = [], ""
    for ch in text:
        if ch.isspace() and now and now[-1] in ".!?":
            found.append(now)
            now = ""
        elif not ch.isspace() or now:
            now += ch
    tail = now
    while tail and tail[-1].isspace():
        tail = tail[:-1]
    return found + ([tail] if tail else [])


def chunks(text, size=512, overlap=50):
    """Rows (index, start, end, text), stated through first/last sentence positions."""
    sents = sentences(text)
    lens = [len(s) for s in sents]
    rows, first, last, start = [], 0, 0, 0
    total = len(sents)
    while first < total or (rows and last < total):
        last = max(last, first + 1)
        while last < total and sum(lens[first : last + 1]) <= size:
            last += 1
        body = " ".join(sents[first:last])
        rows.append((len(rows), start, start + len(body), body))
        if last >= total:
            break
        back = last
        while back > first and sum(lens[back - 1 : last]) <= overlap:
            back -= 1
        start += len(body) - sum(lens[back:last])
        first, last = back, last + 1
    return rows


# -------------------------------------------------------------- similarity


def cosines(vectors):
    import numpy as np

    m = np.asarray(vectors, dtype=np.float64)
    m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.round(m @ m.T, 9)


def resolve(vectors, threshold):
    """Leader position of each vector, decided one arrival after the other."""
    sims, stored, out = cosines(vectors), [], []
    for i in range(len(vectors)):
        near = [(-sims[i, j], j) for j in stored if sims[i, j] >= threshold]
        if near:
            out.append(min(near)[1])
        else:
            stored.append(i)
            out.append(i)
    return out


# -------------------------------------------------------------------- crawl


def crawl(start, pages, links, max_pages, max_depth):
    """By levels: pages at each distance from the start, ordered by their first parent and its links.

    ``pages``: url -> text of fetchable pages; ``links``: url -> links in order.
    """
    distance, level, out = {start: 0}, [start], []
    for depth in range(max_depth + 1):
        good = [u for u in level if pages.get(u.partition("#")[0])][: max_pages - len(out)]
        out += [(u, depth) for u in good]
        below = dict.fromkeys(v for u in good for v in links(u) if v not in distance)
        distance.update(dict.fromkeys(below, depth + 1))
        level = list(below)
    return out


# ------------------------------------------------------------------- markup

UNSEEN = "head script style noscript template svg iframe select button".split()
AROUND = "nav header footer aside form".split()
AD_WORDS = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie menu nav navbar navigation "
    "newsletter pagination popup promo related share sharing sidebar social sponsor sponsored subscribe".split()
)
BLOCK_TAGS = set(
    "address article blockquote body br caption dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre "
    "section table tbody tfoot thead tr ul nav header footer aside form".split()
)


def page_blocks(html, main_only=False):
    """(kind, level, text, links) of a page, tag by tag."""
    out, piece = [], re.compile(r"(?s)<!--.*?-->|<[/!?A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<")
    block = {"kind": "p", "level": 0, "text": "", "links": 0, "cells": 0}
    lists, skip, depth, link = [], None, 0, False

    def end(kind="p", level=0):
        if block["text"].strip(SPACE):
            out.append((block["kind"], block["level"], block["text"], block["links"]))
        block.update(kind=kind, level=level, text="", links=0, cells=0)

    for m in piece.finditer(html or ""):
        t = m[0]
        if not re.match(r"<[/!?A-Za-z]", t) or not t.endswith(">"):
            if not skip:
                block["text"] += t
                block["links"] += len(re.sub(r"[ \t\n\x0b\f\r]+", "", t)) if link else 0
            continue
        name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", t)
        name, closing, alone = name[1].lower() if name else "!", t.startswith("</"), t.endswith("/>")
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if alone else 1
                skip = skip if depth else None
            continue
        marks = re.search(r"(?is)\s(?:class|id)\s*=\s*[\"']?([^\"'>]*)", t)
        ad = bool(marks) and bool(AD_WORDS & set(re.split("[^a-z]+", marks[1].lower())))
        hide = name in UNSEEN or main_only and (name in AROUND or ad and name in "div section ul ol table p span article main".split())
        in_row = block["kind"] == "tr" and name not in ("tr", "table", "tbody", "thead", "tfoot")
        old = block["kind"]
        if name in ("ul", "ol") and not (hide or in_row):
            if not closing:
                lists.append(name)
            elif lists:
                lists.pop()
        if closing:
            kind, level = "p", 0
        elif re.match("h[1-6]$", name):
            kind, level = "h", int(name[1])
        elif name == "li":
            kind, level = (lists[-1] if lists else "ul"), len(lists)
        elif name in ("tr", "pre"):
            kind, level = name, 0
        elif name == "blockquote":
            kind, level = "quote", 0
        elif name in ("br", "p", "div") and old != "h":
            kind, level = old, len(lists) if old in ("ul", "ol") else 0
        else:
            kind, level = "p", 0
        if hide and not closing and not alone:
            end(kind, level)
            skip, depth = name, 1
        elif name == "a":
            link = not closing
        elif in_row and name in BLOCK_TAGS | {"td", "th"}:
            if name in ("td", "th") and not closing:
                block["text"] += "\x02" if block["cells"] else ""
                block["cells"] += 1
            else:
                block["text"] += " "
        elif name in BLOCK_TAGS:
            end(kind, level)
    end()
    return [(k, n, tidy(k, t), a) for k, n, t, a in out]


def tidy(kind, text):
    text = unescape(text)
    if kind == "pre":
        return re.sub(r"^\n|[ \t\n\x0b\f\r]+$", "", text)
    flat = re.sub(f"[{SPACE}]+", " ", text)
    if kind == "tr":
        return " | ".join(c.strip(SPACE).replace("|", "\\|") for c in flat.split("\x02"))
    return flat.strip(SPACE)


def main_text(html):
    bs = page_blocks(html, True)
    size = lambda b: len(re.sub(r"[ \t\n\x0b\f\r]+", "", b[2]))
    few = [b[3] <= 0.33 * size(b) for b in bs]
    ends = re.compile("[.!?…][\"'’”)\\]]*$")
    good = [b[0] != "h" and f and (len(b[2]) >= 40 or bool(ends.search(b[2])) or b[0] in ("tr", "pre", "quote")) for b, f in zip(bs, few)]
    at = lambda i: 0 <= i < len(good) and good[i]
    kept = [b for i, b in enumerate(bs) if good[i] or b[0] == "h" and any(good[i + 1 : i + 4]) or at(i - 1) and at(i + 1) and few[i]]
    return "\n".join(b[2] for b in kept), len(bs), len(kept)


def as_markdown(html):
    out, before = "", None
    for kind, level, text, _ in page_blocks(html):
        indent = "  " * max(0, level - 1)
        line = {"h": "#" * level + " " + text, "ul": indent + "- " + text, "ol": indent + "1. " + text, "pre": f"```\n{text}\n```", "quote": "> " + text}.get(kind, text)
        if kind == "tr":
            line = f"| {text} |" + ("" if before == "tr" else "\n|" + " --- |" * (text.count(" | ") + 1))
        together = kind in ("ul", "ol") and before in ("ul", "ol") or kind == before == "tr"
        out += ("" if before is None else "\n" if together else "\n\n") + line
        before = kind
    return out
