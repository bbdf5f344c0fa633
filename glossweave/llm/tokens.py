"""Token ids of the public vocabularies, through the tokenizers library, with a cache of pieces.

A text of common Latin characters is split by the vocabulary's own pattern and its pieces go to the library's model. Any
other text is cut at single spaces into chunks, which no token crosses (byte-level: unless a space stands beside other
white space; then the text goes to the library whole); plain chunks are split likewise, others go to the whole library
pipeline. Ids of pieces are kept in a bounded cache that starts anew when full. A text that may hold an added token of the
vocabulary (such as one that marks an end) goes to the library whole, which finds such tokens.
"""

from __future__ import annotations

import os
import re
from array import array

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The contractions that both vocabularies split off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN = re.compile(f"[ \n!-~{LETTER}]*")
SPLIT = {
    "byte": re.compile(rf" ?[{LETTER}]+|{CONTRACTIONS}| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{LETTER}]+|{CONTRACTIONS}|[0-9]|[^\s{LETTER}0-9]+"),
}
ODD_SPACE = re.compile(r"\s[ ]|[ ]\s")
CACHE = 500_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or 256 and up in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Encoder:
    """encode(text) gives the text's ids as little-endian uint32 bytes. kind: "byte" or "word"."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        # what all added tokens begin with, as far as it has no case, tells most texts apart at once
        self.mark = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0] if added else None
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.model, self.kind, self.letters = self.whole.model, kind, byte_letters()
        self.pieces = _Cache(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or " " in piece or "\n" in piece:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, SPLIT[self.kind].findall(text.lower() if self.kind == "word" else text)))

    def encode(self, text: str) -> bytes:
        if self.added and self.mark in text and self.added.search(text):
            return self._whole(text)
        if PLAIN.fullmatch(text):
            return self._plain(text)
        if self.kind == "byte" and ODD_SPACE.search(text):
            return self._whole(text)
        chunks = text.split(" ")
        if self.kind == "byte":
            chunks[1:] = [f" {c}" for c in chunks[1:]]
        return b"".join([self._plain(c) if PLAIN.fullmatch(c) else self._whole(c) for c in chunks])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder in each Python worker."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
