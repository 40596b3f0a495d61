"""Byte-level pair encoding with a given vocabulary, and decoding back to text."""

from __future__ import annotations

import re

# Fixed value: how the published models cut text before pairs are merged.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?\d+| ?[^\sA-Za-z\d]+|\s+(?!\S)|\s+")


def alphabet() -> dict[int, str]:
    """The character that stands for each byte in vocabulary files: itself if it shows, else one above U+00FF."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def from_file_form(token: str) -> bytes:
    """The bytes of a token as vocabulary files spell it."""
    byte = {c: b for b, c in alphabet().items()}
    return bytes(byte[c] for c in token)


class Coder:
    """``merges`` in order of rank; ids are the 256 bytes first, then the merged tokens, unless ``ids`` names others."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int] | None = None):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        own = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.ids = ids if ids is not None else {t: i for i, t in enumerate(dict.fromkeys(own))}
        self.token = {i: t for t, i in self.ids.items()}
        self.known: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        parts = [bytes([b]) for b in piece.encode("utf-8", "surrogatepass")]
        worst = len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get((a, b), worst) for a, b in zip(parts, parts[1:])]  # noqa: B905
            least = min(ranks)
            if least == worst:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in PIECES.findall(text):
            if piece not in self.known:
                if len(self.known) >= 100_000:
                    self.known.clear()
                self.known[piece] = self._piece(piece)
            out += self.known[piece]
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary lacks give nothing; bytes that aren't UTF-8 give the replacement character."""
        return b"".join(self.token.get(i, b"") for i in ids).decode("utf-8", "replace")
