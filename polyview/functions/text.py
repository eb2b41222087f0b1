"""Row-local text functions: tokens, masks, numeric and event features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

SPACE = "[ \\t\\n\\r\\f]+"
NUMBER = "[0-9]+([.][0-9]+)?"
PERCENT = "[0-9]%"


def tokens(text: Column) -> Column:
    """Lower-cased words of the whole text; a NULL text has none."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), SPACE), ""), F.array().cast("array<string>"))


def truncate(seq: Column, length: int | None) -> Column:
    """The first ``length`` positions; ``None`` keeps all."""
    return seq if length is None else F.slice(seq, 1, length)


def pad(seq: Column, length: Column, filler: Column) -> Column:
    return F.concat(seq, F.array_repeat(filler, (length - F.size(seq)).cast("int")))


def attention_mask(real: Column, length: Column) -> Column:
    """1 for each real position, 0 for each padded one."""
    return F.concat(
        F.array_repeat(F.lit(1), real.cast("int")),
        F.array_repeat(F.lit(0), (length - real).cast("int")),
    )


def segment_ids(*lengths: Column) -> Column:
    """0 for each position of the first sequence, 1 for each of the second, and so on."""
    return F.concat(*[F.array_repeat(F.lit(n), length.cast("int")) for n, length in enumerate(lengths)])


def numeric_features(text: Column) -> dict[str, Column]:
    """Numbers, percentages, digits and their share of the characters."""
    digits = F.regexp_count(text, F.lit("[0-9]"))
    chars = F.length(text)
    return {
        "n_numbers": F.regexp_count(text, F.lit(NUMBER)),
        "n_percents": F.regexp_count(text, F.lit(PERCENT)),
        "n_digits": digits,
        "digit_share": F.when(chars > 0, digits / chars).otherwise(F.lit(0.0)),
    }


def token_stats(words: Column) -> dict[str, Column]:
    """Shape of a text: words, distinct words, mean word length."""
    n = F.size(words)
    letters = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    return {
        "n_tokens": n,
        "n_distinct": F.size(F.array_distinct(words)),
        "mean_length": F.when(n > 0, letters / n).otherwise(F.lit(0.0)),
    }


def lexicon_hits(words: Column, lexicon: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Hits of each term list among the words of a row; needs no join and no shuffle."""
    def hits(terms: Sequence[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*terms)))

    return {kind: hits(terms) for kind, terms in lexicon.items()}
