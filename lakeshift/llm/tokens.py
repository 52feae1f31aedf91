"""Token ids of whole texts from a tokenizer file, cached by word.

The ids are those that the ``tokenizers`` library gives for the whole text
(``add_special_tokens=False``; the strings of special tokens are ordinary
text). For the two kinds of file that split a text at white space before
merging, a text is cut at its spaces and line ends and the ids of each piece
are kept in a bounded dictionary, since most words of a corpus recur. Texts
with other white space, and files of other kinds, go through the library as
a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: White space other than space and line feed (none is above U+3000). Searching for each is faster than one expression.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters that are one code point in every normal form, perhaps followed by marks that stand alone as one piece.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: A word with the space before it, white space up to the last before a word, or white space.
BYTE_PIECES = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: White space that byte-level files do not take one by one (two line ends between words they do).
WIDE_SPACE = ("  ", " \n", "\n ", "\n\n\n")
#: Characters of the same class in every version of Unicode, and how byte-level files cut what is made of them.
KNOWN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
BYTE_CUTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")
LONGEST = 64
PACKS = [struct.Struct(f"<{n}I").pack for n in range(LONGEST)]


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level files use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


class Pieces(dict):
    """Ids of pieces (little-endian unsigned 32-bit), made where missing; emptied at ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """``ids(text)`` encodes a whole text; ``limit`` bounds the words kept (some 170 bytes each)."""

    def __init__(self, path: str, limit: int = 1_600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, self.letters = self.kind_of(spec), byte_letters()
        self.space, self.tokenize = self.letters[32], merger(spec["model"]) if self.kind != "other" else None
        self.bare = Pieces(self.make_bare, limit)
        self.spaced = Pieces(self.make_spaced, limit)  # pieces after one space, or from a line end on (byte-level files)

    @staticmethod
    def kind_of(spec: dict) -> str:
        steps = lambda part, key: [s["type"] for s in (part or {}).get(key, [part] if part else [])]
        norm, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        if spec["model"]["type"] == "BPE" and norm == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"]:
            return "word"
        if spec["model"]["type"] == "BPE" and not norm and pre == ["ByteLevel"] and spec["pre_tokenizer"]["use_regex"]:
            return "byte"
        return "other"

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, word: str, space: str = "") -> bytes:
        """The ids of letters that the file does not split further."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return packed([t.id for t in self.tokenize(space + word)])

    def make_bare(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.whole(piece)
        if piece.isascii() and piece.isalpha():
            word, marks = piece, ""
        elif plain := PLAIN.fullmatch(piece):
            word, marks = plain.groups()
        elif self.kind == "byte" and KNOWN.fullmatch(piece):
            cuts = BYTE_CUTS.findall(piece)
            return b"".join(map(self.bare.__getitem__, cuts)) if len(cuts) > 1 else self.merged(piece)
        else:
            return self.whole(piece) if piece else b""
        if marks:
            return self.bare[word] + self.bare[marks]
        if self.kind == "word" and not word.islower():
            return self.bare[low] if (low := word.lower()) != word else self.merged(word)
        return self.merged(word)

    def make_spaced(self, piece: str) -> bytes:
        if piece[:1] == "\n":
            return self.bare["\n"] + self.bare[piece[1:]]
        if len(piece) > LONGEST:
            return self.whole(" " + piece)
        if piece.isascii() and piece.isalpha():
            return packed([t.id for t in self.tokenize(self.space + piece)])
        if plain := PLAIN.fullmatch(piece):
            word, marks = plain.groups()
            return self.spaced[word] + self.bare[marks] if marks else self.merged(word, self.space)
        if KNOWN.fullmatch(piece):
            first, *rest = BYTE_CUTS.findall(" " + piece)
            if rest:
                return self.spaced[first[1:]] + b"".join(map(self.bare.__getitem__, rest))
            return self.merged(piece, self.space)
        return self.whole(" " + piece)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "other" or any(c in text for c in OTHER_SPACE):
            return self.whole(text)
        if self.kind == "word":
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        if any(w in text for w in WIDE_SPACE) or text.endswith("\n\n"):
            return b"".join([self.spaced[p[1:]] if p[0] == " " and not p.isspace() else self.bare[p]
                             for p in BYTE_PIECES.findall(text)])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


def merger(model: dict):
    """The library's merges of one word, without its cache: words come here that are in none."""
    from tokenizers.models import BPE

    options = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BPE(model["vocab"], merges, cache_capacity=0, **options).tokenize


def packed(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < LONGEST else struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
