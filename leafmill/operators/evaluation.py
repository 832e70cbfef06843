"""How good tags and rankings are against expected terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_terms(text: Column, gold: list[str]) -> Column:
    """The terms that occur in a text, as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, gold)), lambda t: low.contains(t))


def precision_recall(tags: Column, expected: Column) -> tuple[Column, Column]:
    """Shares of expected terms that some tag contains or lies within, of tags and of terms; null without such terms."""
    hits = F.size(F.filter(expected, lambda e: F.exists(tags, lambda t: t.contains(e) | e.contains(t))))
    some = F.size(expected) > 0
    return F.when(some, hits / F.greatest(F.size(tags), F.lit(1))), F.when(some, hits / F.size(expected))


def top_hits(ranked: DataFrame, hit: Column) -> DataFrame:
    """query_id, top1, top3 of rows (query_id, rank): whether a hit is first, and among the first three."""
    return ranked.filter("rank <= 3").groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, hit)), F.lit(False)).alias("top1"), F.coalesce(F.max(hit), F.lit(False)).alias("top3"))


def accuracy(per_query: DataFrame) -> DataFrame:
    share = lambda c: F.floor(F.avg(F.col(c).cast("int")) * 1000 + 0.5) / 1000
    return per_query.agg(share("top1").alias("top1_accuracy"), share("top3").alias("top3_accuracy"))
