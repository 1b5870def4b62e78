"""Upserts as plans over snapshots: what is inserted, what is updated and with which values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.streaming.changes import shared_folder


def matched(current: DataFrame, incoming: DataFrame, scope: str, keys: list[str], id_: str) -> DataFrame:
    """Incoming rows with the id of the current row they mean, by the first key that finds one within the scope.

    Blank keys find nothing; of several current rows of a key the least id counts. One equi-join a key.
    """
    out = incoming
    for k in keys:
        found = current.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).groupBy(F.col(scope).alias(f"_s_{k}"), F.col(k).alias(f"_k_{k}")).agg(F.min(id_).alias(f"_id_{k}"))
        out = out.join(found, (out[scope] == F.col(f"_s_{k}")) & (out[k] == F.col(f"_k_{k}")), "left").drop(f"_s_{k}", f"_k_{k}")
    by = F.coalesce(*[F.when(F.col(f"_id_{k}").isNotNull(), k) for k in keys])
    out = out.withColumn("matched_id", F.coalesce(*[F.col(f"_id_{k}") for k in keys])).withColumn("matched_by", by)
    return out.drop(*[f"_id_{k}" for k in keys]).withColumn("action", F.when(F.col("matched_id").isNull(), "insert").otherwise("update"))


def last_of_batch(incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of incoming rows that mean the same thing the last one."""
    return incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def applied(current: DataFrame, plan: DataFrame, id_: str, update: list[str], insert: list[str], keep_if_blank: tuple[str, ...] = (), reset: dict[str, Column] | None = None, order: str | None = None) -> DataFrame:
    """The next snapshot: updated columns from the plan, the rest as it was, and inserted rows with new ids.

    Of several plan rows for one current row the last by `order` counts (without an order: the greatest by values).
    Incoming rows that mean one new row are for `last_of_batch` to settle before.
    """
    values = F.struct(*update)
    last = F.max_by(values, F.struct(order, values)) if order else F.max(values)
    ups = plan.where("action = 'update'").groupBy("matched_id").agg(last.alias("_u")).select("matched_id", *[F.col(f"_u.{c}").alias(f"_new_{c}") for c in update])
    joined = current.join(ups, current[id_] == ups["matched_id"], "left")
    hit = F.col("matched_id").isNotNull()

    def value(c: str) -> Column:
        if c in update:
            new = F.nullif(F.col(f"_new_{c}"), F.lit("")) if c in keep_if_blank else F.col(f"_new_{c}")
            return (F.when(hit, F.coalesce(new, F.col(c)) if c in keep_if_blank else new).otherwise(F.col(c))).alias(c)
        if reset and c in reset:
            return F.when(hit, reset[c]).otherwise(F.col(c)).alias(c)
        return F.col(c)

    kept = joined.select(*[value(c) for c in current.columns])
    top = current.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    new = numbered(plan.where("action = 'insert'"), "_rank").crossJoin(F.broadcast(top))  # one row
    rows = new.select(*[(F.col("_top") + F.col("_rank")).cast(current.schema[id_].dataType).alias(id_) if c == id_ else (F.col(c) if c in insert else F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return kept.unionByName(rows)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with numbers from 1, gapless, counted per partition; no single task sees all rows.

    The rows are checkpointed first: their partitions are evaluated twice and must be the same both times.
    """
    shared_folder(df.sparkSession)
    tagged = df.checkpoint().withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = tagged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return tagged.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("_m"))).drop("_p", "_m", "_b")


def dimension(current: DataFrame, incoming: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Get or create: current rows and one new row, with the next ids in the order of the keys, for each unknown key.

    They are put in order by an exchange by ranges and numbered range by range.
    """
    new = incoming.select(*keys).where(F.col(keys[-1]).isNotNull()).distinct().join(current.select(*keys), keys, "left_anti")
    return with_next_ids(current.select(id_, *keys), new, keys, id_)


def with_next_ids(current: DataFrame, new: DataFrame, order: list[str], id_: str) -> DataFrame:
    """Current rows and new ones (all columns but the id), which get the next ids in the order of the given columns."""
    columns = [c for c in current.columns if c != id_]
    top = current.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    ranked = numbered(new.repartitionByRange(*order).sortWithinPartitions(*order), "_n").crossJoin(F.broadcast(top))  # one row
    return current.unionByName(ranked.select((F.col("_top") + F.col("_n")).cast(current.schema[id_].dataType).alias(id_), *columns))


def get_or_create(current: DataFrame, incoming: DataFrame, scope: str, keys: list[str], id_: str) -> DataFrame:
    """Current rows (id, scope, keys) and a new row for each member that none of the keys finds, tried in order.

    Of incoming rows with the same first filled key within a scope one new row comes, with the least value of each other
    key. Rows without scope or any filled key create nothing.
    """
    told = F.coalesce(*[F.when(F.col(k).cast("string") != "", F.struct(F.lit(n).alias("n"), F.col(k).cast("string").alias("value"))) for n, k in enumerate(keys)])
    unknown = matched(current, incoming.select(scope, *keys).distinct(), scope, keys, id_).where("action = 'insert'").withColumn("_told", told)
    new = unknown.where(F.col(scope).isNotNull() & F.col("_told").isNotNull()).groupBy(scope, "_told").agg(*[F.min(k).alias(k) for k in keys])
    return with_next_ids(current.select(id_, scope, *keys), new, [scope, "_told"], id_)


def plan_counts(plan: DataFrame) -> DataFrame:
    """What a plan of `matched` will do: total, inserted, updated, and updated rows by the key that found them (a map)."""
    by = plan.groupBy("action", "matched_by").agg(F.count("*").alias("n"))
    updates = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("action") == "update", F.struct("matched_by", "n")))))
    return by.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("total", F.lit(True)), ("inserted", F.col("action") == "insert"), ("updated", F.col("action") == "update"))], updates.alias("updated_by"))


def slug_conflicts(current: DataFrame, incoming: DataFrame, scope: str, slug: str, id_: str) -> DataFrame:
    """Incoming rows whose slug another row of the scope has: they must be refused. A row doesn't conflict with itself."""
    taken = current.where(F.col(slug).isNotNull()).select(F.col(scope).alias("_s"), F.col(slug).alias("_g"), F.col(id_).alias("_i"))
    return incoming.join(taken, (F.col(scope) == F.col("_s")) & (F.col(slug) == F.col("_g")) & ~F.col(id_).eqNullSafe(F.col("_i")), "left_semi")


def marked_synced(current: DataFrame, sent: DataFrame, key: str, at: Column) -> DataFrame:
    """Current rows, with is_synced and synced_at set on those whose last attempt in sent (key, ok, seq) went well."""
    last = sent.groupBy(F.col(key).alias("_k")).agg(F.max_by("ok", "seq").alias("_ok")).where("_ok")
    hit = F.col("_k").isNotNull()
    return current.join(last, F.col(key) == F.col("_k"), "left").withColumns({"is_synced": hit | F.col("is_synced"), "synced_at": F.when(hit, at).otherwise(F.col("synced_at"))}).drop("_k", "_ok")


def job_states(changes: DataFrame, job: str, at: str) -> DataFrame:
    """Of each job's changes (status, `at`): its last status, when it first ran, when it ended (done or failed), how often it ran."""
    status, when = F.col("status"), F.col(at)
    return changes.groupBy(job).agg(
        F.max_by(status, F.struct(when, status)).alias("status"), F.min(F.when(status == "running", when)).alias("started_at"),
        F.max(F.when(status.isin("done", "failed"), when)).alias("ended_at"), F.count_if(status == "running").alias("runs"))


def hard_deleted(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Current rows without those of the given keys; null keys delete nothing."""
    return current.join(ids.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def promoted(rules: DataFrame, hits: DataFrame, key: str, step: float = 0.5, most: float = 3.0) -> DataFrame:
    """Rule weights after hits: step for each, at most `most`; new rules start from 0. The order of hits doesn't matter."""
    counts = hits.groupBy(F.lower(key).alias(key)).agg(F.count("*").alias("_n"))
    return rules.join(counts, key, "full_outer").select(key, F.least(F.lit(most), F.coalesce("weight", F.lit(0.0)) + step * F.coalesce("_n", F.lit(0))).alias("weight"), (F.coalesce("examples_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("examples_count"))


def folded(events: DataFrame, key: str, order: str, start: float = 0.0, most: float = 3.0) -> DataFrame:
    """Weights after promotions and demotions in order (column `step`), clamped to 0 .. most after each: key, weight, is_active.

    A step is the map w -> min(high, max(low, w + step)), and such maps compose to one of their kind. Events are dealt by
    ranges of key and order, so that a frequent key's are spread over tasks; each range is read once, in order, and
    gives one map a key. Only those few are folded per key. A null step sets the weight to 0, as greatest skips nulls.
    """
    names = ["key", "part", "step", "low", "high"]
    dealt = events.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col("step").cast("double").alias("step"))
    dealt = dealt.repartitionByRange("key", "order", "step").sortWithinPartitions("key", "order", "step").select("key", "step")

    def composed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, kind = TaskContext.get().partitionId(), None, None

        def row(k, s, low, high):
            return pa.RecordBatch.from_arrays([pa.array([k], type=kind), pa.array([part], type=pa.int32()), *[pa.array([x], type=pa.float64()) for x in (s, low, high)]], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for k, step in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now[0] != k:
                    if now is not None:
                        yield row(*now)
                    now = (k, 0.0, float("-inf"), float("inf"))
                _, s, low, high = now
                if step is None or step != step:
                    to = 0.0 if step is None else most
                    now = (k, 0.0, min(most, to), min(most, to))
                else:
                    now = (k, s + step, *(min(most, max(0.0, x + step)) for x in (low, high)))
        if now is not None:
            yield row(*now)

    kind = dealt.schema["key"].dataType.simpleString()
    maps = dealt.mapInArrow(composed, f"key {kind}, part int, step double, low double, high double")
    steps = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "step", "low", "high"))).alias("_e"))
    weight = F.aggregate("_e", F.lit(start).cast("double"), lambda w, e: F.least(e["high"], F.greatest(e["low"], w + e["step"])))
    return steps.select(F.col("key").alias(key), weight.alias("weight")).withColumn("is_active", F.col("weight") > 0)


def changed_prices(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming prices that differ from the current ones, nulls compared as values; new keys count as changed."""
    now = current.select(*keys, F.col("price").alias("old_price"))
    return incoming.join(now, keys, "left").where(~F.col("price").eqNullSafe(F.col("old_price")))


def patched(current: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Current rows with the fields that a patch sets (its nulls set nothing)."""
    p = patch.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    return current.join(p, current[key] == F.col("_k"), "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns])


def soft_deleted(current: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    hit = ids.select(F.col(key).alias("_k")).distinct()
    return current.join(hit, current[key] == F.col("_k"), "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_k").isNotNull(), at))).drop("_k")


def ensured(current: DataFrame, wanted: DataFrame, scope: str, slug: str, id_: str = "id") -> DataFrame:
    """The snapshot with a live row for each wanted (scope, slug), and the ids it has now: current rows, then new ones.

    A row that is deleted (deleted_at) doesn't count as there. A wanted row that is new takes the other columns that it
    states, the first by value of several; null scopes and blank slugs want nothing.
    """
    live = current.where(F.col("deleted_at").isNull()) if "deleted_at" in current.columns else current
    asked = wanted.where(F.col(scope).isNotNull() & (F.trim(slug) != "")).join(live.select(scope, slug), [scope, slug], "left_anti")
    rest = [c for c in wanted.columns if c not in (scope, slug)]
    new = asked.groupBy(scope, slug).agg(*[F.min(c).alias(c) for c in rest])
    rows = new.select(*[F.col(c) if c in wanted.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns if c != id_])
    return with_next_ids(current, rows, [scope, slug], id_)
