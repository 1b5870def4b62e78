"""Counts and coverage of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, by: str, price: Column, spread: bool = True) -> DataFrame:
    """For each group: rows, priced, missing, share priced in per cent, and the least, greatest and mean price above 0."""
    has = price > 0
    priced = F.count_if(has)
    found = [F.count("*").alias("total"), priced.alias("priced"), (F.count("*") - priced).alias("missing"), F.round(100.0 * priced / F.count("*"), 1).alias("pct")]
    if spread:
        found += [F.round(F.min(F.when(has, price)), 2).alias("min_price"), F.round(F.max(F.when(has, price)), 2).alias("max_price")]
    return df.groupBy(by).agg(*found, F.round(F.avg(F.when(has, price)), 2).alias("avg_price"))


def overall_coverage(groups: DataFrame) -> DataFrame:
    total, priced = F.sum("total"), F.sum("priced")
    return groups.agg(total.cast("long").alias("total"), priced.cast("long").alias("priced"), F.round(100.0 * priced / total, 1).alias("pct"))


def histogram(df: DataFrame, by: str, most: int | None = None, nulls: bool = True) -> DataFrame:
    """Rows by group, most frequent first, ties by name; at most `most` groups."""
    counts = (df if nulls else df.where(F.col(by).isNotNull())).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
    return counts.limit(most) if most else counts


def session_counters(candidates: DataFrame, session: str, status: str) -> DataFrame:
    """Of each session: total, reviewed, approved (corrected ones too), rejected and the status that follows."""
    s = F.col(status)
    total, reviewed = F.count("*"), F.count_if(s != "pending")
    return candidates.groupBy(session).agg(
        total.alias("total"), reviewed.alias("reviewed"), F.count_if(s.isin("approved", "corrected")).alias("approved"), F.count_if(s == "rejected").alias("rejected"),
        F.when((reviewed == total) & (total > 0), "completed").otherwise("reviewing").alias("status"))


def confidence(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean_confidence"))
