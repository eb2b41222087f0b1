"""Threshold-scaled sketches of documents, with DataFrame functions only.

Every shingle of five words is hashed to 64 bits, and the sketch keeps the hashes
that lie below a fixed fraction of the range.  So the sketch of a text is a
sample of its shingles whose size follows the text, two sketches are comparable
whatever the sizes of their texts, and the sketch of a union is the union of the
sketches.  The least hash is kept as well, so that no text with words has an
empty sketch; a union keeps the lesser of the two, so sketches still merge.  A
least hash above the threshold tells texts apart, but it is no part of the sample:
likeness is estimated without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from polyview.llm.common import given_id, id_text, text_key
from polyview.session import stored

SHINGLE = 5
FRACTION = 1 / 8
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """The hash of every ``size`` words in a row; of all words if there are fewer; none without words.

    ``tokens`` must be a column of the frame, not an expression: it is read once per word.
    """
    n = F.size(tokens)
    last = F.greatest(n - size, F.lit(0))
    # an index beyond the end gives NULL, which the hash skips
    shingle = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), shingle)).otherwise(F.array().cast("array<long>"))


def _highest(fraction: float) -> int:
    return -(2**63) + int(fraction * 2**64) - 1


def keep_low(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch: distinct hashes below ``fraction`` of the range and the least one, sorted."""
    low = F.filter(hashes, lambda h: h <= F.lit(_highest(fraction)))
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(low, least)))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    return keep_low(F.concat(a, b), fraction)


def _low(sketch: Column, fraction: float) -> Column:
    """A sketch without a least hash that lies above the threshold; that is then its only one."""
    return F.when(F.get(sketch, F.lit(0)) <= F.lit(_highest(fraction)), sketch).otherwise(F.array().cast("array<long>"))


def resemblance(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of common shingles among all of both: 1 for two empty sketches, 0 for one.

    Estimated from the hashes below the threshold.  Where neither text has one, it is
    1 if the least hashes are equal, which has just this chance, and 0 if not.
    """
    low_a, low_b = _low(a, fraction), _low(b, fraction)
    union = F.size(F.array_union(low_a, low_b))
    empty = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    return empty.when(union == 0, (a == b).cast("double")).otherwise(F.size(F.array_intersect(low_a, low_b)) / union)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, however large ``b`` is; 1 if ``a`` has none.

    Estimated from the hashes below the threshold; NULL if ``a`` has shingles but none there.
    """
    low = _low(a, fraction)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(low) > 0, F.size(F.array_intersect(low, b)) / F.size(low))


def printed(sketch: Column) -> Column:
    """The hashes as 16 hex digits each, joined by commas."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def sketch(df: DataFrame, text: str, name: str, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of column ``text`` in column ``name``; NULL counts as empty."""
    tokens, hashes = f"__{name}_words", f"__{name}_hashes"
    split = df.withColumn(tokens, words(F.coalesce(F.col(text), F.lit(""))))
    hashed = split.withColumn(hashes, shingle_hashes(F.col(tokens), size))
    return hashed.withColumn(name, keep_low(F.col(hashes), fraction)).drop(tokens, hashes)


def next_rows(ids: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """``ids`` with the number of the row (``_row``, from 0 without gaps) in ascending ``order``, and that of the next row.

    Rows are dealt out by range, numbered inside a part and shifted by the parts
    before it; after the last row comes the first.  Only ``order`` and ``carry``
    move, and only one row per part goes through a global window.
    """
    dealt = ids.select(*order, *carry).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    fixed = stored(dealt, "order")  # the parts must not change between the two reads below
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = fixed.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_part")
    row = F.col("_start") + F.col("_rank")
    return numbered.select(*order, *carry, row.alias("_row"), ((row + 1) % F.col("_all")).alias("_next"))


def edited_sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketches of every text and of its edited text, and how alike they and those of the next document are.

    In the edited text the last quarter of the code points is replaced by as many
    from the start of the next document in ascending ``doc_id``, or by all of it if
    it is shorter; the first follows the last.  A NULL id comes first; rows with
    equal ids are ordered by a hash of the text, and rows that repeat id and text
    are one document with one row.  NULL and empty texts have no shingles, and an
    empty sketch.  Other columns are not read; an empty table gives an empty result.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, in_edited, in_next``: likeness as resemblance and, in
    the last two, as containment of the text's shingles (NULL where the sample of
    the text is empty).
    """
    key = ["_id", "_key"]
    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    light = rows.select(*key, F.length("_text").cast("long").alias("_n")).groupBy(*key).agg(F.first("_n").alias("_n"))
    order = next_rows(light, key, ["_n"])
    # a document gives the one before it as many code points as that one replaces
    before = order.select(F.col("_next").alias("_row"), *[F.col(k).alias(f"_to{k}") for k in key], F.floor(F.col("_n") / 4).alias("_wanted"))
    gives = order.join(before, "_row").select(*key, "_to_id", "_to_key", F.col("_wanted").cast("int").alias("_wanted"))
    # one exchange of texts and sketches by document serves both joins
    dealt = sketch(rows, "_text", "_own", size, fraction).repartition(*key)
    heads = (
        dealt.join(gives.hint("shuffle_hash"), key)
        .select(F.col("_to_id").alias("_id"), F.col("_to_key").alias("_key"),
                F.substring("_text", F.lit(1), F.col("_wanted")).alias("_head"), F.col("_own").alias("_after"))
        .groupBy(*key).agg(F.first("_head").alias("_head"), F.first("_after").alias("_after"))  # repeated rows give the same
    )
    joined = dealt.join(heads.hint("shuffle_hash"), key).withColumn("n_chars", F.length("_text").cast("long"))
    kept = F.substring("_text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    edited = joined.withColumn("_edited", F.concat(kept, "_head")).drop("_text", "_head")
    both = sketch(edited.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "_new", size, fraction)
    own, new, after = F.col("_own"), F.col("_new"), F.col("_after")
    return both.select(
        given_id().alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed(own).alias("fingerprint"),
        printed(new).alias("edited_fingerprint"),
        resemblance(own, new, fraction).alias("near_edited"),
        resemblance(own, after, fraction).alias("near_next"),
        containment(own, new, fraction).alias("in_edited"),
        containment(own, after, fraction).alias("in_next"),
    )
