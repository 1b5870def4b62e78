"""Review feedback, what is learned from it, and evaluation against labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords
from .joins import zipped
from .upserts import folded

STATUS = {"approve": "approved", "reject": "rejected", "correct": "corrected"}
FIELDS = ["label", "name", "quantity", "price"]


def reviewed(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates after feedback (candidate_id, session_id, action, corrected_*, seq): the last item of each counts.

    Items of unknown candidates change nothing, nor do those that name another session.
    """
    last = items.groupBy("candidate_id", F.col("session_id").alias("_session")).agg(*[F.max_by(c, "seq").alias(f"_{c}") for c in ["action", *[f"corrected_{f}" for f in FIELDS]]])
    joined = candidates.join(last, (candidates["id"] == last["candidate_id"]) & (candidates["session_id"] == last["_session"]), "left")
    status = F.coalesce(*[F.when(F.col("_action") == a, s) for a, s in STATUS.items()], F.col("status"))
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c.startswith("corrected_") else (status.alias("status") if c == "status" else candidates[c]) for c in candidates.columns])


def approve_all(candidates: DataFrame) -> DataFrame:
    """Pending products become approved."""
    return candidates.withColumn("status", F.when((F.col("status") == "pending") & (F.col("predicted_label") == "product"), "approved").otherwise(F.col("status")))


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Audit rows: key, changed_fields, old_values and new_values (maps of texts) of the rows that differ."""
    o, n = old.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields]), new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), f) for f in fields]))

    def values(side: str) -> Column:
        return F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"_{side}_{f}").cast("string"))]), lambda k, _: F.array_contains("changed_fields", k))

    return o.join(n, key).withColumn("changed_fields", changed).where(F.size("changed_fields") > 0).select(key, "changed_fields", values("o").alias("old_values"), values("n").alias("new_values"))


def learned(events: DataFrame) -> DataFrame:
    """Keyword weights from reviews (name, action, seq): approvals promote by 0.5, rejections demote by 0.3, in order."""
    step = F.when(F.col("action") == "reject", -0.3).otherwise(0.5)
    return folded(events.select(F.explode(keywords(F.col("name"))).alias("keyword"), "seq", step.alias("step")), "keyword", "seq")


def name_match(said: Column, truth: Column, least: float = 0.5) -> Column:
    """At least half of the truth's words are said; no words, no match."""
    t, s = (F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (truth, said))
    return F.coalesce((F.size(t) > 0) & (F.size(F.array_intersect(t, s)) / F.greatest(F.size(t), F.lit(1)) >= least), F.lit(False))


def number_match(said: Column, truth: Column, within: float = 0.05) -> Column:
    return F.coalesce(F.when(truth == 0, said == 0).otherwise(F.abs(said - truth) / F.abs(truth) <= within), F.lit(False))


def field_accuracy(said: DataFrame, truth: DataFrame, position: str, names: list[str] = (), texts: list[str] = (), amounts: list[str] = (), positive: str = "product") -> DataFrame:
    """Of rows that both call positive: for each field, how many the truth states, how many of them are met, and the share.

    Names match by half of the truth's words, texts when they are equal but for case and outer blanks, amounts within 5 %.
    Fields that the truth never states have no row.
    """
    def exact(s: Column, t: Column) -> Column:
        return F.coalesce(F.lower(F.trim(s)) == F.lower(F.trim(t)), F.lit(False))

    fields = [(f, rule) for rule, some in ((name_match, names), (exact, texts), (number_match, amounts)) for f in some]
    s, t = (df.where(F.col("label") == positive).select(position, F.struct(*[f for f, _ in fields]).alias(side)) for df, side in ((said, "s"), (truth, "t")))
    judged = F.array(*[F.when(F.col(f"t.{f}").isNotNull(), F.struct(F.lit(f).alias("field"), rule(F.col(f"s.{f}"), F.col(f"t.{f}")).alias("hit"))) for f, rule in fields])
    rows = s.join(t, position).select(F.explode(F.array_compact(judged)).alias("j"))
    return rows.groupBy(F.col("j.field").alias("field")).agg(F.count("*").alias("total"), F.count_if("j.hit").alias("hits"), F.round(F.count_if("j.hit") / F.count("*"), 4).alias("accuracy"))


def evaluated(said: DataFrame, truth: DataFrame, position: str, positive: str = "product") -> DataFrame:
    """Counts and precision, recall and F1 of labels at the same positions; a tail without partner counts against."""
    both = zipped(said.select(position, F.col("label").alias("said")), truth.select(position, F.col("label").alias("truth")), position)
    s, t = F.col("said") == positive, F.col("truth") == positive
    s, t = F.coalesce(s, F.lit(False)), F.coalesce(t, F.lit(False))
    counts = both.agg(F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"), F.count_if(~s & ~t).alias("tn"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return counts.select("tp", "fp", "fn", "tn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"))
