"""Token ids of texts, by a public tokenizer, inside Python workers."""

from __future__ import annotations

import codecs
import re
import string
import struct
import sys
from operator import attrgetter

import numpy as np

# Distinct word forms whose ids one worker remembers; the older half is dropped beyond it.
REMEMBERED = 1 << 20
# Characters of one text that are given to the tokenizer at once where spaces cannot be used to cut it.
PIECE = 1 << 16

_two_spaces = re.compile(r"\s\s")
_other_spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Neither letters nor digits, nor what begins an English ending.
_marks = "".join(c for c in string.punctuation if c not in "'_")
_closing = re.compile(r"(?<=[a-zA-Z])[^\w\s']+$")
# Letters of this range are letters to the tokenizer as well, whatever its tables.
_plain_letters = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_safe_space = re.compile(r"(?<=\S) (?=\S)")


class Words(dict):
    """Ids of words as bytes, found out when a word is first asked for.

    A word stands for itself with a space in front; one that begins with a line
    feed has none. At most ``remembered`` words are kept.
    """

    def __init__(self, tokenizer, remembered: int):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.half = max(1, remembered // 2)
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.line_feed = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found

    def encode(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            # Most words: one part of letters.
            return packed(self.model.tokenize("\u0120" + word))
        # Marks after a letter are a part of their own.
        at = len(word.rstrip(_marks))
        if at == len(word) or not _plain_letters(word[at - 1 : at]):
            end = None if word[-1:].isalnum() else _closing.search(word)
            at = end.start() if end else len(word)
        if at < len(word):
            marks = self.marks.get(word[at:])
            if marks is None:
                marks = self.ids(word[at:])
                if len(self.marks) < 4096:
                    self.marks[word[at:]] = marks
            return self[word[:at]] + marks
        first = word[:1] == "\n"
        bare = word[1:] if first else word
        if not _plain_letters(bare):
            return self.ids(word if first else " " + word)
        # One part: the bytes are merged without looking for parts first.
        shown = bare if bare.isascii() else byte_letters(bare)
        return self.line_feed + packed(self.model.tokenize(shown)) if first else packed(self.model.tokenize("\u0120" + shown))

    def age(self) -> None:
        """Forget what was not asked for of late, if there is much."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, remembered per word form.

    The byte-level tokenizer splits a text into parts before it merges bytes,
    and no part goes on across a single space or line feed between two other
    characters: such a space begins a part. So the ids of a text are the ids of
    its space-led words in order, and each distinct word is encoded once. Texts
    in which two white spaces meet, or that hold an added token of the tokenizer,
    are encoded directly.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.words = Words(tokenizer, remembered)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; memory is a small multiple of the texts given."""
        self.words.age()
        of, skip = self.words.__getitem__, len(self.words.line_feed)
        out = []
        for text in texts:
            if self.added and self.added.search(text):
                # Added tokens have ids of their own and change how their neighbours are cut.
                out.append(self.words.ids(text))
            elif spaces_meet(text) or text[:1].isspace():
                out.append(b"".join(map(self.words.ids, cut_freely(text))))
            else:
                # The first word of a text has no space in front: a line feed stands there for now.
                parts = ("\n" + text).replace("\n", " \n").split(" ")
                out.append(b"".join(map(of, parts[1:]))[skip:])
        return out


def spaces_meet(text: str) -> bool:
    """Whether two white spaces stand side by side; texts that have spaces and line feeds alone need no pattern."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _other_spaces) and bool(_two_spaces.search(text))


_id = attrgetter("id")


def packed(merged: list) -> bytes:
    return struct.pack(f"<{len(merged)}I", *map(_id, merged))


def byte_letters(text: str) -> str:
    """The UTF-8 bytes of a text as the tokenizer's vocabulary writes them: printable ones of Latin-1 as
    themselves, the others as the letters from U+0100 on, in order."""
    return codecs.charmap_decode(text.encode(), "strict", _byte_letters)[0]


def _byte_table() -> str:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return "".join(chr(others.get(b, b)) for b in range(256))


_byte_letters = _byte_table()


def cut_freely(text: str) -> list[str]:
    """Pieces of any text, cut before single spaces only, and only as needed."""
    pieces, at = [], 0
    while len(text) - at > PIECE:
        cut = _safe_space.search(text, at + PIECE)
        if cut is None:
            break
        pieces.append(text[at : cut.start()])
        at = cut.start()
    pieces.append(text[at:])
    return pieces


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file.

    It is kept by the process, since this module reaches a worker by value, anew with each task.
    """
    kept = sys.__dict__.setdefault("_corpusloom_encoders", {})
    found = kept.get((path, remembered))
    if found is None:
        found = kept[path, remembered] = Encoder(path, remembered)
    return found


def forget() -> None:
    """Drop the worker's encoders, for steps that need their room: workers live on between stages."""
    sys.__dict__.pop("_corpusloom_encoders", None)
