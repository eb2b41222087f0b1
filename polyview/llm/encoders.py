"""Ids of whole batches of texts: cut in numpy, one call of the library for the chunks that are new, ids gathered by index.

A text is cut into chunks at places where the tokenizer cuts itself and where what
it does to either side does not depend on the other.  The chunks of a batch are
hashed without a loop; each distinct one is looked up once, and those that the
worker does not remember go to the tokenizers library in a single call.  Chunks are
known by 128 bits of hash.

**Bytes.** Cuts are made before a single space between two characters that are not
white space, and between printable ASCII characters of different classes (letters,
digits, others), but not between an apostrophe and a letter.  No match of the
byte-level pattern spans such a place.

**Words.** White space goes, and words of ASCII are cut between classes as above.
Others stay whole: lower case and composition may look beyond the next character.

A text that holds the string of a special token goes to the library as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np

from polyview.llm.chunks import blocks, library
from polyview.llm.words import Words, find_words

KNOWN = 1 << 20  # chunks that a worker remembers, in about 40 bytes each
KNOWN_IDS = 1 << 23  # and their ids in all
HASHES = (301, 302)
U = np.uint64

LETTER, DIGIT, OTHER, QUOTE = 1, 2, 4, 12  # classes as bits; an apostrophe is one of the others


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for byte in range(0x21, 0x7F):
        c = chr(byte)
        out[byte] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else OTHER
    return out


CLASS = _classes()


def class_changes(buf: np.ndarray) -> np.ndarray:
    """Whether the bytes before and at a place are printable ASCII of different classes, and not an apostrophe and a letter."""
    kind = CLASS[buf]
    out = np.zeros(len(buf), bool)
    a, b = kind[:-1], kind[1:]
    out[1:] = (a & b == 0) & (a > 0) & (b > 0) & ~((a == QUOTE) & (b == LETTER))
    return out


def lone_spaces(buf: np.ndarray) -> np.ndarray:
    """Spaces between two characters that are no white space: printable ASCII, or of two bytes from U+00C0 on."""
    two = (buf >= 0xC3) & (buf <= 0xDF)
    out = np.zeros(len(buf), bool)
    if len(buf) > 2:
        before = CLASS[buf[:-2]] > 0
        before[1:] |= two[:-3]
        out[1:-1] = (buf[1:-1] == 0x20) & before & ((CLASS[buf[2:]] > 0) | two[2:])
    return out


class Encoder:
    """``encode(text, add_special_tokens=False)`` of a tokenizer file for batches of texts.

    ``words``: whether the file drops white space and splits at it, else it is a
    byte-level file without a normalizer.
    """

    def __init__(self, path: str, words: bool, known: int = KNOWN):
        self.tokenizer, self.words, self.limit = library(path), words, known
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.names, self.place = np.zeros(0, U), np.zeros(0, np.int64)  # first hashes in order, and where their chunk is kept
        self.check, self.start, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _encoded(self, texts: list[str]) -> list[Sequence[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> Words:
        begin = class_changes(buf)
        if self.words:
            found = find_words(buf, offsets)
            odd = np.concatenate([[0], np.cumsum(buf >= 0x80)])
            plain = odd[found.ends] == odd[found.starts]
            begin &= _within(len(buf), found, plain)
            begin[found.starts] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(buf))
            ends = np.minimum(ends, found.ends[np.searchsorted(found.starts, starts, "right") - 1])
        else:
            begin |= lone_spaces(buf)
            begin[offsets[:-1][offsets[:-1] < len(buf)]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(buf))
        return Words(buf, starts, ends, np.searchsorted(starts, offsets))

    def _learn(self, texts: list[str], hashes: np.ndarray, check: np.ndarray) -> None:
        found = self._encoded(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.names, hashes)
        self.names = np.insert(self.names, at, hashes)
        self.place = np.insert(self.place, at, len(self.check) + np.arange(len(hashes)))
        self.check = np.concatenate([self.check, check])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, self.place[at], -1)

    def _places(self, data: bytes, cut: Words) -> tuple[np.ndarray, np.ndarray]:
        """The remembered place of each chunk, and whether it is another chunk with the same first hash."""
        hashes, check = cut.hashes(HASHES[0]), cut.hashes(HASHES[1])
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self._find(distinct) < 0)
        if len(self.names) + len(new) > self.limit or len(self.ids) > KNOWN_IDS:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            spans = zip(cut.starts[first[new]].tolist(), cut.ends[first[new]].tolist())
            self._learn([data[a:b].decode() for a, b in spans], distinct[new], check[first[new]])
        at = self._find(distinct)
        return at[of], self.check[at][of] != check

    def rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows that lie end to end in ``buf``, end to end, and how many each row has."""
        data = buf.tobytes()
        cut = self._cut(buf, offsets)
        if not len(cut.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        at, clash = self._places(data, cut)
        counts = self.count[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.start[at] - total[:-1], counts) + np.arange(total[-1])]
        edges = total[cut.first]
        odd = set(np.unique(np.searchsorted(offsets, cut.starts[clash], "right") - 1).tolist())
        if any(s in data for s in self.special):
            texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            odd |= {r for r, text in enumerate(texts) if any(s in text for s in self.special)}
        if odd:
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            parts = [self._whole(data[offsets[r]:offsets[r + 1]]) if r in odd else ids[a:b] for r, (a, b) in enumerate(spans)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(edges)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``rows``; a row on its own is taken in blocks, so that a very long text needs little memory."""
        if len(offsets) != 2:
            return self.rows(buf, offsets)
        text = buf.tobytes()
        if any(s in text for s in self.special):
            ids = self._whole(text)
            return ids, np.array([len(ids)])
        parts = [self.rows(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in blocks(text)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])


def _within(n: int, found: Words, kept: np.ndarray) -> np.ndarray:
    """The bytes of the words that are ``kept``."""
    edge = np.zeros(n + 1, np.int8)
    edge[found.starts[kept]] = 1
    edge[found.ends[kept]] -= 1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def byte_level(path: str, known: int = KNOWN) -> Encoder:
    return Encoder(path, False, known)


def word_level(path: str, known: int = KNOWN) -> Encoder:
    return Encoder(path, True, known)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row with ``end`` behind it."""
    last = np.cumsum(counts + 1) - 1
    out = np.empty(len(ids) + len(counts), np.uint32)
    own = np.ones(len(out), bool)
    own[last] = False
    out[own] = ids
    out[last] = end
    return out, counts + 1

