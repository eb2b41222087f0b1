"""Documents and brute-force versions that the tests share."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, length int, ids string, anchor int"
WORD = re.compile("[^\x20\x09-\x0D]+")


def documents(spark, rows, parts=2):
    """Rows of id and text, with columns whose names the operators use inside."""
    full = [(i, t, "en", "src0", None if t is None else len(t), "x", "y", 1, "z", 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def edge_rows():
    """NULL ids and texts, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, "The cat sat on the mat."), (2, "The cat sat on the mat."), (2, "The cat sat on the mat."), (2, "another text with id two"),
        (3, None), (4, ""), (5, " \n\t "), (None, "The cat sat on the mat."), (None, None), (6, long), (7, "x" * 50_000), (8, "ünïcode 🙂 ß"),
    ]


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(n, seed):
    """Texts that share passages, repeat themselves or are made of very few words."""
    rng = random.Random(seed)
    base = [rng.choice("abc") for _ in range(400)]
    out = []
    for i in range(n):
        start, kind = rng.randrange(300), i % 6
        out.append((i, [
            lambda: " ".join(rng.choice("ab") for _ in range(rng.randrange(60))),
            lambda: " ".join("xyz"[j % 3] for j in range(rng.randrange(70))),
            lambda: " ".join(base[start:start + rng.randrange(90)]),
            lambda: None,
            lambda: "q " * rng.randrange(60),
            lambda: " ".join([str(i)] * 3 + base[start:start + 40] + [f"{i}e"] + base[start + 10:start + 33]),
        ][kind]()))
    return out
