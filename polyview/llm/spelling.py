"""Spelling variants: words one edit apart, found with a bit-sliced index of letters by position.

**Words.** Maximal runs of Latin letters, with a few misspelt on purpose by a rule of
the caller, counted over all texts.

**Index.** Of a block of words, ``index[place, letter]`` is a set of bits: the words
with that letter at that place.  A query word runs over it letter by letter, and
sets of words are kept in step, 64 words per machine word: those that agree so
far, without an error, and those with one.  Where a word of the block has the
query's length, the error is another letter, and a word enters the second set from
the first where it lacks the query's letter.  Where it is one letter longer, the
error is a letter more: the words of the second set are looked up one place
further on, and the words of the first enter it at every step.  A word that lacks
a letter is the same pair seen from the other side.  What is left in the second set
at the end is one edit away.  All queries of a block run together.

**Blocks.** Words of lengths n and n, or n and n + 1, meet in a class of their own.
A class with many words is cut by letters: an edit leaves the first half or the
last half of the shorter word as it is, so words meet by their first letters and,
apart from that, by their last ones, as many as the class needs and no more than
half.  A group that is large nevertheless is cut into blocks, and each block of
queries meets each block of the index in a task of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from polyview.llm.common import NULL_ID, byte_column, id_text, small_batches
from polyview.session import stored

RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")  # UTF-8 of a-z and U+00C0 to U+00FF
EVERY = 199  # one run in so many loses a letter
LETTERS = 6  # of a word, at least
COUNT = 5  # occurrences of a word, at least
RATIO = 5  # times a word's count that its form must have
GROUP = 4096  # words of a group that is not cut by letters any more, and of a block
SHARE = 1 << 14  # words of a task that looks for near ones
LONG = 32  # letters of words beyond which blocks get smaller
HELD = 1 << 18  # counts that a task holds before it sends them on
CELLS = 1 << 16  # machine words of a set for all queries that run together
U = np.uint64


def misspelt(doc_id: int | None, run: bytes, every: int = EVERY) -> bytes:
    """``run`` without one code point if the crc32 of ``<doc_id>:<run>`` is a multiple of ``every``; a NULL id is written as nothing."""
    return _misspelt(crc32(f"{'' if doc_id is None else doc_id}:".encode()), run, every)


def _misspelt(start: int, run: bytes, every: int) -> bytes:
    h = crc32(run, start)
    if h % every:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _counts(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            buf, offsets = byte_column(batch.column("_text"))
            data = buf.tobytes().lower()  # bytes: A-Z only
            for i, a, b in zip(batch.column("_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                start = crc32(f"{'' if i == NULL_ID else i}:".encode())
                for match in RUN.finditer(data, a, b):
                    word = match.group()
                    if crc32(word, start) % every == 0:
                        word = _misspelt(start, word, every)
                    total[word] = total.get(word, 0) + 1
                    if len(total) >= HELD:
                        yield flush()
        if total:
            yield flush()

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """``word, n`` over all texts, after misspelling; tasks add up what they read before the shuffle."""
    small_batches(docs.sparkSession)
    found = id_text(docs, doc_id, text).mapInArrow(_counts(every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def index(words: np.ndarray, alphabet: int) -> np.ndarray:
    """``bits[place, letter, word // 64]`` of ``words[word, place]``; letter 0 is none, and the last place is empty."""
    n, width = words.shape
    full = np.zeros((width + 1, -(-n // 64) * 64), words.dtype)
    full[:width, :n] = words.T
    out = np.zeros((width + 1, alphabet, full.shape[1] // 64), U)
    for letter in range(1, alphabet):
        out[:, letter] = np.packbits(full == letter, axis=1, bitorder="little").view("<u8")
    return out


def one_edit(queries: np.ndarray, n: int, words: np.ndarray, m: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query of length ``n`` and a word of length ``m`` (``n`` or ``n + 1``) one edit apart; rows are letters as numbers from 1."""
    bits = index(words[:, :m], alphabet)
    cells = bits.shape[2]
    every = np.packbits(np.arange(cells * 64) < len(words), bitorder="little").view("<u8")
    found = []
    for at in range(0, len(queries), max(1, CELLS // cells)):
        part = queries[at:at + max(1, CELLS // cells)]
        same = np.tile(every, (len(part), 1))
        error = same.copy() if m > n else np.zeros_like(same)  # a letter before the first one
        for i in range(n):
            here = bits[i][part[:, i]]
            if m == n:
                error = (error & here) | (same & ~here)
                same &= here
            else:
                same &= here
                error = (error & bits[i + 1][part[:, i]]) | same
        row, cell = np.nonzero(error)
        value = error[row, cell]
        hit = np.unpackbits(value.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(hit)
        found.append((row[which] + at, cell[which] * 64 + bit))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _letters(words: list[str], width: int) -> tuple[np.ndarray, int]:
    """Words as numbers from 1, in the order of the code points they use, and how many numbers there are."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(points.max(initial=0)) + 1, bool)
    used[points] = True
    numbers = np.cumsum(used)
    codes = np.zeros((len(words), width), np.int64)
    codes[np.arange(width) < sizes[:, None]] = numbers[points]
    return codes, int(numbers[-1]) + 1


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group; rows of a group follow one another."""
    names = ("group", "n", "m", "a", "b")
    held: list[pa.RecordBatch] = []

    def finish() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        n, m = rows.column("n")[0].as_py(), rows.column("m")[0].as_py()
        indexed = rows.column("indexed").to_numpy()
        queries, words = (rows.column("word").filter(pa.array(side)).combine_chunks() for side in (~indexed, indexed))
        a = b = np.zeros(0, np.int64)
        if len(queries) and len(words):
            codes, alphabet = _letters(queries.to_pylist() + words.to_pylist(), m)
            a, b = one_edit(codes[:len(queries)], n, codes[len(queries):], m, alphabet)
        word, near = queries.take(pa.array(a)), words.take(pa.array(b))
        if m > n:  # words of one length meet both ways
            word, near = pa.concat_arrays([word, near]), pa.concat_arrays([near, word])
        return pa.RecordBatch.from_arrays([word, near], ["word", "near"])

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = bool(held) and any(batch.column(c)[0] != held[-1].column(c)[0] for c in names)
        for c in names:
            column = batch.column(c)
            change[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        at = 0
        for to in np.flatnonzero(change).tolist():
            if to > at:
                held.append(batch.slice(at, to - at))
            yield finish()
            held, at = [], to
        held.append(batch.slice(at))
    if held:
        yield finish()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, near``: all ordered pairs of the distinct strings in ``word`` that are one inserted, deleted or replaced code point apart.

    A class with more than ``group`` words is cut by letters.  ``words`` is read more than once, so it should be stored.
    """
    sized = words.select("word", F.length("word").alias("_len"))
    as_query = sized.withColumn("n", F.col("_len")).withColumn("m", F.explode(F.array(F.col("_len"), F.col("_len") + 1)))
    classed = as_query.unionByName(sized.withColumns({"n": F.col("_len") - 1, "m": F.col("_len")}))
    totals = classed.groupBy("n", "m").agg(F.count(F.lit(1)).alias("size"))  # one row per pair of lengths
    letters = F.greatest(F.lit(0), F.ceil(F.log(F.col("size") / group) / math.log(8))).cast("int")
    totals = totals.withColumn("letters", F.least(letters, F.floor(F.col("n") / 2).cast("int")))
    cut = classed.join(totals, ["n", "m"])
    first = F.concat(F.lit("<"), F.expr("substring(word, 1, letters)"))
    last = F.concat(F.lit(">"), F.expr("right(word, letters)"))
    sides = F.when(F.col("letters") > 0, F.array(first, last)).otherwise(F.array(F.lit("")))
    grouped = cut.select("word", "_len", "n", "m", F.explode(sides).alias("group"))
    room = F.count(F.lit(1)) * F.greatest(F.lit(1.0), F.col("n") / LONG)
    blocks = grouped.groupBy("n", "m", "group").agg(F.ceil(room / group).cast("int").alias("blocks"))
    placed = grouped.join(blocks, ["n", "m", "group"])
    # words of length m make up the index, words of length n are queries; each block of one meets each block of the other
    own, others = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = placed.where("_len = n").withColumns({"a": own, "indexed": F.lit(False)}).withColumn("b", others)
    indexed = placed.where("_len = m").withColumns({"b": own, "indexed": F.lit(True)}).withColumn("a", others)
    rows = asked.unionByName(indexed).select("group", "n", "m", "a", "b", "word", "indexed")
    # a word costs far more time than bytes, so the number of tasks follows the words and not the size of the shuffle
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // SHARE))
    dealt = rows.repartition(parts, "group", "n", "m", "a", "b").sortWithinPartitions("group", "n", "m", "a", "b")
    return dealt.mapInArrow(_neighbours, "word string, near string").distinct()  # words that agree at both ends meet twice


def spelling_variants(counts: DataFrame, letters: int = LETTERS, least: int = COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words with ``letters`` code points and ``least`` occurrences or more.

    ``counts`` has ``word, n``, a row per word; a NULL word takes no part.  Near
    words differ by one inserted, deleted or replaced code point.  A word's form is
    its near word of largest count, ties by code points, if that has ``ratio`` times
    its count or more, else NULL.  The root follows forms to the last one; counts grow
    ``ratio`` times at each step, so the steps are few.
    """
    if ratio < 2 or letters < 2:
        raise ValueError("a form has twice a word's count at least, and words have two letters at least")
    words = stored(counts.where((F.length("word") >= letters) & (F.col("n") >= least)).select("word", "n"), "words")
    pairs = near_words(words, group).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest count first, then the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    about = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(about, "word", "left")
    large = -F.col("best.less")
    has = large >= ratio * F.col("n")
    out = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, large).alias("form_n"),
    ), "forms")
    # pointers double: each round follows twice as many steps
    step = out.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(step.join(after, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    return out.join(step.select("word", "root"), "word").select("word", "n", "n_near", "form", "form_n", "root")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, letters: int = LETTERS,
                    least: int = COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """The spelling variants of the words in all whole texts; see ``word_counts`` and ``spelling_variants``.

    NULL and empty texts have no words; repeated rows count each; a NULL id is
    written as nothing in the rule of misspelling.  Other columns are not read; an
    empty table gives an empty result.
    """
    return spelling_variants(word_counts(docs, doc_id, text, every), letters, least, ratio, group)
