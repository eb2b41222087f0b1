"""Texts cut into chunks, so that an encoder meets every distinct chunk once per worker, not once per place.

A chunk is a word with the white space that belongs to it.  The cut is exact:
tokenizers split at the same places themselves, and what they do within a chunk
does not depend on its neighbours.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import regex

CHUNKS = 1 << 19  # chunks that one worker remembers
LONGEST = 64  # bytes of a chunk worth remembering
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """``key -> make(key)`` for about the last ``limit`` distinct keys.

    Keys live in two halves.  When the new half is full it becomes the old one, and
    what is asked for again moves back; the rest goes at the next change.
    """

    def __init__(self, make: Callable[[bytes], bytes], limit: int = CHUNKS):
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


BLOCK = 1 << 20  # bytes of a text that are cut into chunks at once
CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def blocks(text: bytes) -> Iterator[bytes]:
    """A long text in blocks that begin with a single space between two printable characters."""
    at = 0
    while len(text) - at > BLOCK and (cut := CUT.search(text, at + BLOCK)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class _Uneven(Exception):
    """White space of several characters next to a cut."""


class ByteChunks:
    """Encodes a text whose tokenizer cuts by the byte-level pattern; ``piece`` encodes one match of it.

    The text is cut before a space that follows a character other than white
    space: no match of the pattern spans such a place, and none looks back.  Texts
    with longer white space around a space are matched as a whole.
    """

    def __init__(self, piece: Callable[[str], Sequence[int]], pattern: str = BYTE_PATTERN, limit: int = CHUNKS):
        self.find = regex.compile(pattern).findall
        self.piece = piece
        self.pieces = Remembered(lambda p: packed(piece(p.decode())), limit // 8)
        self.chunks = Remembered(self._chunk, limit)  # by what follows the space

    def matched(self, text: bytes) -> bytes:
        return self._joined(self.find(text.decode()))

    def _joined(self, found: list[str]) -> bytes:
        chunks, pieces = self.chunks, self.pieces
        # a match that begins with a space is a chunk of its own
        return b"".join([chunks[p[1:].encode()] if p[0] == " " and not p[-1].isspace() else pieces[p.encode()] for p in found])

    def _chunk(self, part: bytes) -> bytes:
        word = part.decode()
        if not word or word[-1].isspace():
            raise _Uneven
        found = self.find(" " + word)
        return packed(self.piece(found[0])) if len(found) == 1 else self._joined(found)

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self._block, blocks(text)))

    def _block(self, text: bytes) -> bytes:
        parts = text.split(b" ")
        if len(parts) == 1:
            return self.matched(text)
        first, last = parts[0], parts.pop()
        try:
            if first[-1:].isspace() or not last or first and first.decode()[-1].isspace():
                raise _Uneven
            middle = b"".join(map(self.chunks.__getitem__, parts[1:]))
        except _Uneven:
            return self.matched(text)
        return self.matched(first) + middle + self.matched(b" " + last)


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
