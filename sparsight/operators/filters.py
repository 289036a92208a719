"""Document filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparsight.functions import text as tx


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(tx.is_nonblank(F.col(text)))


def quality_good(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(tx.is_good(F.col(text)))


def quality_strict(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(tx.is_strict(F.col(text)))


def quality_report(df: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """How many documents each rule rejects, per group, in one pass."""
    return df.groupBy(by).agg(*_rule_counts(text))


def quality_cube(df: DataFrame, by: Sequence[str] = ("source", "lang"), text: str = "text") -> DataFrame:
    """The same counts for every combination of ``by``, each alone, and all rows, from one pass over the texts.

    ``grouping_id`` tells which columns a row sums over, the last one in the
    lowest bit; these are null there. The rules run before rows are repeated
    for the combinations.
    """
    counts = _rule_counts(text)
    finest = df.groupBy(*by).agg(*counts)
    names = [c for c in finest.columns if c not in by]
    return finest.cube(*by).agg(F.grouping_id().cast("int").alias("grouping_id"), *(F.sum(n).alias(n) for n in names))


def _rule_counts(text: str) -> list:
    t = F.col(text)
    return [
        F.count("*").alias("n_docs"),
        F.count_if(~tx.is_nonblank(t)).alias("blank"),
        F.count_if(~tx.long_enough(t)).alias("too_short"),
        F.count_if(~tx.short_enough(t)).alias("too_long"),
        F.count_if(~tx.has_two_letters(t)).alias("few_letters"),
        F.count_if(~tx.not_all_upper(t)).alias("all_upper"),
        F.count_if(~tx.not_numeric(t)).alias("numeric"),
        F.count_if(tx.is_good(t)).alias("kept_good"),
        F.count_if(tx.is_strict(t)).alias("kept_strict"),
    ]


def drop_special(tokens: DataFrame, special: Sequence[int] | DataFrame) -> DataFrame:
    """Rows whose id is not special; the set may be a list or a table."""
    if isinstance(special, DataFrame):
        return tokens.join(special.select("token_id"), "token_id", "left_anti").select(
            *tokens.columns
        )
    return tokens.where(~F.col("token_id").isin(*special))


def dedup_exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the smallest key of every group of equal stripped texts.

    ``min`` combines before the shuffle, so a group of any size costs one
    (hash, key) pair per task; the texts meet only keys.
    """
    digest = F.sha2(tx.strip(F.col(text)), 256)
    keepers = (
        df.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key)).select(key)
    )
    return df.join(keepers, key, "left_semi")


def by_language(df: DataFrame, lang: str) -> DataFrame:
    return df.where(F.col("lang") == lang)


def by_source(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("source").isin(*names))
