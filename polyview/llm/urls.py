"""URL filter: rules first, then the reputation of the host, with DataFrame functions only.

**Reputation.** Pages with a known outcome (good or bad) are counted per host,
and every rate is shrunk through beta-binomial priors: the rate of a suffix
towards that of all pages, of a registered domain towards its suffix, of a host
towards its domain.  How strongly a level pulls is estimated from the data: by the
moments of how much the rates of its groups differ beyond chance.  A host is
blocked if even the upper bound of its posterior good rate is below a floor, so a
host is only blocked on evidence, and one that was never seen gets the bound of
its domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Z = 1.6449  # one-sided 95 %
FLOOR = 0.5
STRENGTH = (2.0, 1000.0)  # bounds of an estimated prior strength
LEVELS = ("suffix", "domain", "host")
#: Public suffixes of two labels that are common; others are one label.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#`` or the end, lower-cased; from there up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a rule is ``host/path`` and fits the host and all below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, wanted in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(wanted)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column]:
    last_two = F.substring_index(host, ".", -2)
    suffix = F.when(last_two.isin(*two_labels), last_two).otherwise(F.substring_index(host, ".", -1))
    return suffix, F.when(last_two.isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(last_two)


def prior_strength(groups: DataFrame, bounds: tuple[float, float] = STRENGTH) -> float:
    """Strength of a beta prior by moments, from one row of ``n`` and ``good`` per group; one row comes to the driver."""
    rate = F.col("good") / F.col("n")
    row = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"),
        F.sum(F.col("n") * rate * rate).alias("square"), F.sum(F.col("n") * rate * (1 - rate)).alias("within"),
    ).first()
    low, high = bounds
    if row["k"] < 2 or row["n"] <= row["k"]:
        return high
    between = (row["square"] - row["good"] * row["good"] / row["n"]) / (row["k"] - 1)
    inside = row["within"] / (row["n"] - row["k"])
    size = (row["n"] - row["n2"] / row["n"]) / (row["k"] - 1)
    scale = between + (size - 1) * inside
    alike = (between - inside) / scale if scale > 0 else 0.0
    return high if alike <= 0 else min(high, max(low, 1 / alike - 1))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``host, n, good, posterior_mean, lower_bound, upper_bound`` for each row of ``hosts`` (``host``, distinct).

    ``outcomes`` has ``host`` and ``good`` (boolean; NULL is no outcome).  Counts are
    summed per host before anything else, so a host with a third of all pages is one row.
    """
    counted = (
        outcomes.where(F.col("good").isNotNull()).groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    )
    suffix, domain = suffix_and_domain(F.col("host"))
    rated = counted.withColumns({"suffix": suffix, "domain": domain})
    names = hosts.select("host", suffix.alias("suffix"), domain.alias("domain"))
    total = rated.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = F.lit(((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0))
    out = names.withColumn("_mean", mean)
    for level in LEVELS:
        groups = rated.groupBy(level).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        pull = F.lit(float(prior_strength(groups)))
        known = groups.select(level, F.col("n").alias("_n"), F.col("good").alias("_good"))
        out = out.join(known, level, "left")
        n, good = F.coalesce("_n", F.lit(0)), F.coalesce("_good", F.lit(0))
        if level != "host":
            out = out.withColumn("_mean", (good + pull * F.col("_mean")) / (n + pull)).drop("_n", "_good")
        else:
            a, b = good + pull * F.col("_mean"), n - good + pull * (1 - F.col("_mean"))
            out = out.withColumns({"n": n, "good": good, "_a": a, "_b": b}).drop("_n", "_good")
    a, b = F.col("_a"), F.col("_b")
    centre = a / (a + b)
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * z
    return out.select(
        "host", "n", "good", centre.alias("posterior_mean"),
        F.greatest(centre - spread, F.lit(0.0)).alias("lower_bound"), F.least(centre + spread, F.lit(1.0)).alias("upper_bound"),
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], floor: float = FLOOR, z: float = Z,
                page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, labelled, posterior_mean, upper_bound``: one row per input row.

    ``outcomes`` has ``url`` and ``good``.  The verdict is that of the longest rule
    that fits, else ``block`` if the host's upper bound is below ``floor``, else
    ``allow``.  A NULL url and one without ``://`` have an empty host, which is a
    host like any other.  Repeated rows are judged each; other columns are not
    read; without outcomes everything not ruled is allowed; an empty table gives
    an empty result.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), "good")
    bounds = reputation(rows.select("host").distinct(), seen, z)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("upper_bound") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bounds, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"),
        F.col("n").cast("long").alias("labelled"), "posterior_mean", "upper_bound",
    )
