"""Token ids of whole texts by a tokenizer file, with the ids of recent words kept.

Where the tokenizer's own rules cut a text at spaces, a text is cut there first and each new piece is
encoded once; the ids of the pieces in a row are then the ids of the text.  ``tests/llm`` compares
this with the encoding of whole texts.  A text that may hold a special token is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pieces of one generation: a full generation becomes the old one, from which pieces still in use move on.
GENERATION = 500_000
#: Pieces longer than this are not kept.
LONG = 64
#: Letters below this one are the same in every Unicode version and composed form.
PLAIN = "\u0250"
_LEADING = re.compile(r" ?[^\W\d_]+")
_ENCODERS: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable Latin-1 byte stands for itself, the others follow from 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


class Encoder(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        self.cut = _cut_of(spec)
        self.lower = self.cut is at_white_space

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._encoded(piece)
        if len(piece) <= LONG:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        """A run of letters is one word to the tokenizer, so it goes straight to the merges; what follows
        the letters, if it begins in ASCII, is a piece of its own."""
        lead = _LEADING.match(piece)
        lead = lead[0] if lead and lead[0].lstrip(" ").isalpha() else ""
        if lead and piece[len(lead) : len(lead) + 1].isascii() and len(lead) < len(piece):
            return self[lead] + self[piece[len(lead) :]]
        word = piece.lower() if self.lower else piece
        if lead and lead == piece and max(word) < PLAIN:
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.cut(text)))


def _cut_of(spec: dict):
    """How texts may be cut ahead of this tokenizer, or None where that isn't known to be safe."""
    pre, normal, suffix = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"].get("end_of_word_suffix")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and normal is None:
        return before_spaces
    parts = pre.get("pretokenizers", [])
    if suffix and parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
        if r"\s" in str(parts[0].get("pattern")):
            return at_white_space
    return None


_BEFORE = re.compile(r"(?= \S)")


def before_spaces(text: str) -> list[str]:
    """Cut before each space that a non-space follows: byte-level rules always start a word there."""
    first, *rest = text.split(" ")
    if all(rest) and not any(p[0].isspace() for p in rest):
        return [first, *[" " + p for p in rest]]
    return _BEFORE.split(text)


def at_white_space(text: str) -> list[str]:
    """Cut at spaces and line ends, which rules that drop white space never join."""
    return [p for p in text.replace("\n", " ").split(" ") if p]


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker; Spark reuses its workers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
