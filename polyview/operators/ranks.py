"""Row identity, seeded order and splits without a single-task window.

Rows are ordered by a seeded hash of their key.  A short hash prefix cuts them
into even buckets; a bucket's start is the number of rows in the buckets before
it, and only the rank inside a bucket needs a window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from polyview.functions.hashing import hex_cut, seeded_hash

PREFIX_DIGITS = 4  # 16**4 buckets: the bound of every table broadcast here
MAX_DIGITS = 5


def _prefix(digits: int) -> Column:
    if not 1 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must lie between 1 and {MAX_DIGITS}, got {digits}")
    return F.substring("__hash", 1, digits)


def _running_sizes(df: DataFrame, bucket: str) -> DataFrame:
    """``bucket, size, before``: one row per bucket, so the global window is bounded."""
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("before", F.sum("size").over(upto) - F.col("size"))


def global_rank(df: DataFrame, bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank of every row by ``bucket`` and then ``order``.

    ``bucket`` must rise with the wanted order and take a bounded number of
    values (at most a few hundred thousand), none of which holds a large share
    of the rows.  ``order`` must be unique inside a bucket.
    """
    keyed = df.withColumn("__bucket", bucket)
    starts = _running_sizes(keyed, "__bucket").select("__bucket", "before")
    inside = Window.partitionBy("__bucket").orderBy(*order)
    return (
        keyed.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(starts), "__bucket")
        .withColumn(name, F.col("before") + F.col("__rank") - 1)
        .drop("__bucket", "__rank", "before")
    )


def seeded_rank(df: DataFrame, key: Sequence[str], seed: int | str, name: str = "row_id",
                digits: int = PREFIX_DIGITS) -> DataFrame:
    """Position of each row in the seeded order of its unique ``key``."""
    keyed = df.withColumn("__hash", seeded_hash(list(key), seed))
    order = [F.col("__hash"), *[F.col(k) for k in key]]
    return global_rank(keyed, _prefix(digits), order, name).drop("__hash")


def number_copies(df: DataFrame, seed: int | str, name: str = "row_id", digits: int = PREFIX_DIGITS,
                  chunk: int = 100_000) -> DataFrame:
    """Adds a 0-based row id to a table without a key.

    Equal rows cannot be told apart, so they are counted first, the distinct
    rows are ranked in seeded order, and each gets a run of ids as long as its
    count.  Runs are unrolled in chunks spread over the cluster, so copies of
    one row may be any share of the table.
    """
    columns = df.columns
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    keyed = counted.withColumn("__hash", seeded_hash(text, seed)).withColumn("__bucket", _prefix(digits))
    totals = keyed.groupBy("__bucket").agg(F.sum("__n").alias("__size"))
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("__bucket", (F.sum("__size").over(upto) - F.col("__size")).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy("__hash", *columns).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    first = F.col("__before") + F.sum("__n").over(inside) - F.col("__n")
    runs = keyed.join(F.broadcast(starts), "__bucket").withColumn("__first", first)
    last = F.col("__first") + F.col("__n") - 1
    chunks = runs.select(
        *columns, last.alias("__last"), F.explode(F.sequence("__first", last, F.lit(chunk).cast("bigint"))).alias("__from")
    ).repartition("__from")
    upper = F.least(F.col("__from") + chunk - 1, F.col("__last"))
    return chunks.select(*columns, F.explode(F.sequence("__from", upper)).alias(name))


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: int | str) -> DataFrame:
    """All rows in seeded order: a range-partitioned sort on the hash."""
    hashed = df.withColumn("shuffle_key", seeded_hash(list(key), seed))
    return hashed.orderBy("shuffle_key", *key)


def exact_cut(df: DataFrame, key: Sequence[str], test_size: float, seed: int | str,
              digits: int = PREFIX_DIGITS) -> Row | None:
    """Hash and key of the last of the first ``ceil(n * test_size)`` rows in seeded order.

    Bucket counts tell in which bucket that row lies, and only that bucket is
    ranked.  One row comes to the driver; ``None`` when no row is wanted.
    """
    keys = df.select(*key, seeded_hash(list(key), seed).alias("__hash"))
    keys = keys.withColumn("__bucket", _prefix(digits))
    wanted = F.ceil(F.sum("size").over(Window.partitionBy()) * F.lit(float(test_size)))
    sizes = _running_sizes(keys, "__bucket").withColumn("wanted", wanted)
    edge = sizes.where((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("size")))
    edge = edge.select("__bucket", (F.col("wanted") - F.col("before")).alias("nth"))
    inside = Window.partitionBy("__bucket").orderBy("__hash", *key)
    last = keys.join(F.broadcast(edge), "__bucket").withColumn("__rank", F.row_number().over(inside))
    return last.where(F.col("__rank") == F.col("nth")).select("__hash", *key).first()


def split_exact(df: DataFrame, key: Sequence[str], test_size: float, seed: int | str,
                digits: int = PREFIX_DIGITS) -> DataFrame:
    """Adds ``split``: exactly ``ceil(n * test_size)`` rows are ``test``.

    The cut is found first, then every row is compared with it where it lies:
    the rows themselves are never shuffled.  ``key`` must be unique.
    """
    cut = exact_cut(df, key, test_size, seed, digits)
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    own = F.struct(seeded_hash(list(key), seed).alias("h"), *key)
    types = dict(df.select(*key).dtypes)
    last = F.struct(F.lit(cut["__hash"]).alias("h"), *[F.lit(cut[k]).cast(types[k]).alias(k) for k in key])
    return df.withColumn("split", F.when(own <= last, "test").otherwise("train"))


def split_hash(df: DataFrame, key: Sequence[str], test_size: float, seed: int | str) -> DataFrame:
    """Adds ``split`` row by row; the test share is ``test_size`` on average."""
    prefix = F.substring(seeded_hash(list(key), seed), 1, 8)
    return df.withColumn("split", F.when(prefix < hex_cut(test_size), "test").otherwise("train"))


def mini_batches(df: DataFrame, size: int, row_id: str = "row_id") -> DataFrame:
    """Adds ``batch_id``: consecutive runs of ``size`` rows, the last may be short."""
    return df.withColumn("batch_id", F.floor(F.col(row_id) / size).cast("bigint"))


def step_cap(df: DataFrame, max_steps: int | None, step: str = "batch_id") -> DataFrame:
    """The batches a training pass sees when it stops after ``max_steps``."""
    return df if max_steps is None else df.where(F.col(step) < max_steps)


PRIME, FACTORS = 2**31 - 1, (48271, 69621)  # products of two numbers below the prime fit 64 bits
ROUNDS = 4
GRIDS = 256
SURE = 1e-15  # chance that a walk does not end in time, which is an error


def sides(n: int) -> tuple[int, int]:
    """Sides of a nearly square grid with at least ``n`` cells, and as few more as any of ``GRIDS`` choices has."""
    root = math.isqrt(max(1, n))
    return min(((a, -(-max(1, n) // a)) for a in range(root, root + min(GRIDS, root // 2 + 1))), key=lambda s: s[0] * s[1])


def walks(n: int) -> int:
    """Steps that bring a cell beyond ``n`` back: no more than there are such cells, and for a large ``n`` so many that
    none of ``n`` rows is likely to need another one."""
    a, b = sides(n)
    beyond = a * b - n
    return min(beyond, math.ceil(math.log(SURE / n) / math.log(beyond / (a * b)))) if beyond and n else 0


def _mixed(x: Column, key: Column) -> Column:
    """A number below ``PRIME`` that depends on ``x`` and ``key``, in 64-bit integers only."""
    for factor, shift in zip(FACTORS, (13, 11)):
        x = (x * factor + key) % PRIME
        x = x.bitwiseXOR(F.shiftright(x, shift)) % PRIME
    return x


def _network(df: DataFrame, x: str, key: str, n: int) -> DataFrame:
    """``x`` sent through the keyed network: its row and column in the grid are shifted by turns, each by a hash of the other."""
    a, b = sides(n)
    df = df.withColumns({"__l": F.floor(F.col(x) / F.lit(b)).cast("bigint"), "__r": F.col(x) % b})
    for turn in range(ROUNDS):
        df = df.withColumn("__l", (F.col("__l") + _mixed(F.col("__r"), F.col(key) + 2 * turn)) % a)
        df = df.withColumn("__r", (F.col("__r") + _mixed(F.col("__l"), F.col(key) + 2 * turn + 1)) % b)
    return df.withColumn(x, F.col("__l") * b + F.col("__r")).drop("__l", "__r")


def epoch_positions(df: DataFrame, n: int, epoch: Column, seed: int, row_id: str = "row_id", name: str = "position") -> DataFrame:
    """Adds the position of a row in the order of an epoch: a permutation of ``0 .. n - 1`` for every value of ``epoch``.

    The permutation is computed from the row id alone, by a keyed Feistel network on
    a grid of at least ``n`` cells; a row that lands beyond ``n`` walks on until it is
    back.  No row meets another: there is no sort and no shuffle.  ``row_id`` holds
    0 .. n - 1; another id, or a walk that does not end, is an error.
    """
    if not 0 <= n < 2**62:
        raise ValueError(f"{n} rows")
    inside = F.col(row_id).between(0, n - 1)
    start = F.when(inside, F.col(row_id).cast("bigint")).otherwise(F.raise_error(F.lit(f"row id beyond {n} rows")).cast("bigint"))
    key = ((F.lit(seed % PRIME) * FACTORS[0] + epoch.cast("bigint") * FACTORS[1]) % PRIME + PRIME) % PRIME
    df = _network(df.withColumns({name: start, "__key": key}), name, "__key", n)
    for _ in range(walks(n)):
        df = _network(df.withColumn("__next", F.col(name)), "__next", "__key", n)
        df = df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(F.col("__next"))).drop("__next")
    ended = F.when(F.col(name) < n, F.col(name)).otherwise(F.raise_error(F.lit("the walk did not end")).cast("bigint"))
    return df.withColumn(name, ended).drop("__key")


def epoch_batches(df: DataFrame, n: int, epochs: int, size: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Every row once per epoch, with ``epoch``, ``position``, ``batch_id`` in the epoch and ``step`` over all epochs."""
    if size < 1:
        raise ValueError("a batch holds one row at least")
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else df.withColumn("epoch", F.lit(0)).limit(0)
    placed = mini_batches(epoch_positions(each, n, F.col("epoch"), seed, row_id), size, "position")
    per_epoch = -(-n // size)
    return placed.withColumn("step", F.col("epoch").cast("bigint") * per_epoch + F.col("batch_id"))
