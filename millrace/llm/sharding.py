"""Sharding documents by histogram sort: exact byte counts below candidate boundaries until every splitter is in place."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized

#: Keys are triples of signed 64-bit numbers, kept as one Python number in their order: the text's hash, the doc_id, the row.
HALF, ALL = 1 << 63, 1 << 64


def _cut(key: int) -> tuple[int, int, int]:
    return tuple(key // ALL**k % ALL - HALF for k in (2, 1, 0))


def _below(keys: list, probes: list):
    """How many of the ascending probes are at or below each key (the key's bucket); both as a list of arrays, one a part."""
    import numpy as np

    k, end = (np.searchsorted(probes[0], keys[0], side=side) for side in ("left", "right"))
    if len(keys) == 1:
        return end
    for value in np.unique(keys[0][k < end]):
        same = keys[0] == value
        low, high = k[same][0], end[same][0]
        k[same] = low + _below([x[same] for x in keys[1:]], [p[low:high] for p in probes[1:]])
    return k


def _bucketed(keys: DataFrame, probes: list[int], schema: str, columns: list[str]) -> DataFrame:
    parts = [_cut(p) for p in probes]

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        cuts = [np.array([p[k] for p in parts], dtype=np.int64) for k in range(3)]
        for b in batches:
            k = _below([b.column(c).to_numpy() for c in ("h", "d", "row")], cuts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(k.astype("int32"))], names=[*columns, "bucket"])

    return keys.mapInArrow(assign, schema)


def histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact bytes and rows below each probe, from one pass; the driver gets two numbers a probe."""
    found = {r["bucket"]: (r["n_bytes"], r["n_rows"]) for r in _bucketed(keys, probes, "size long, bucket int", ["size"]).groupBy("bucket").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows")).collect()}
    out, a, b = [], 0, 0
    for k in range(len(probes)):
        a, b = a + found.get(k, (0, 0))[0], b + found.get(k, (0, 0))[1]
        out.append((a, b))
    return out


def splitters(keys: DataFrame, total: int, rows: int, parts: int, tolerance: float, fan_out: int = 16, rounds: int = 64) -> list[int]:
    """Boundaries that leave below them k/parts of all bytes (k = 1 .. parts - 1) to within tolerance x a part.

    Every round counts exactly below `fan_out` probes inside each open interval, at first evenly spaced, and narrows it to
    the probes around the target. An interval that holds one row ends too: one document cannot be cut. The number of
    splitters is that of the shards, whatever the size of the table.
    """
    goals = [total * k // parts for k in range(1, parts)]
    spans = {g: ((0, 0, 0), (ALL**3, total, rows)) for g in goals}  # low and high: key, bytes and rows below it
    done: dict[int, int] = {}
    slack = tolerance * total / parts
    for _ in range(rounds):
        for g, (low, high) in spans.items():
            if g not in done and (min(g - low[1], high[1] - g) <= slack or high[2] - low[2] <= 1):
                done[g] = low[0] if g - low[1] <= high[1] - g else high[0]
        open_ = [g for g in goals if g not in done]
        if not open_:
            break
        probes = set()
        for low, high in {spans[g] for g in open_}:
            probes.update(low[0] + (high[0] - low[0]) * k // fan_out for k in range(1, fan_out))
        probes = sorted(probes)
        counted = [(p, *n) for p, n in zip(probes, histogram(keys, probes))]
        n_bytes = [c[1] for c in counted]
        for g in open_:
            k = bisect.bisect_right(n_bytes, g)
            low, high = spans[g]
            spans[g] = max([low, *counted[max(0, k - 1) : k]]), min([high, *counted[k : k + 1]])
    return [done[g] for g in goals]


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, task_rows: int = 1_000_000, overhead: int = 16) -> DataFrame:
    """Puts documents (doc_id, text) into `shards` shards of near equal bytes, in the order of (hash of the text, doc_id, row).

    One row a document: doc_id, size (UTF-8 bytes, none for null, plus `overhead`), text_crc32, law ('bytes'), shard,
    slot (place in the shard in that order, gapless from 0). Equal texts lie side by side, so that a group is only cut
    where a shard ends, also if its rows are equal in doc_id. After the splitters are found, rows move once, by ranges of
    the same key in tasks of about `task_rows`, whatever the size of a shard; slots go on from task to task by exact
    counts. Null doc_ids come first among equal texts; equal rows get slots side by side; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    keys = materialize(docs.select(
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-HALF)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))).withColumn("row", F.monotonically_increasing_id())
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = splitters(keys, total, rows, shards, tolerance) if rows else []
    columns = ["doc_id", "h", "d", "row", "size", "text_crc32"]
    placed = _bucketed(keys, cuts, "doc_id long, h long, d long, row long, size long, text_crc32 long, bucket int", columns)
    ordered = placed.repartitionByRange(max(shards, -(-rows // task_rows)), "bucket", "h", "d", "row").sortWithinPartitions("bucket", "h", "d", "row")
    # Once written, a row's place in its partition is the lower part of this number, and the partition the upper one.
    ordered = materialize(ordered.select("doc_id", "size", "text_crc32", F.col("bucket").alias("shard"))).withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    runs = ordered.groupBy("shard", part.alias("part")).agg(F.min(place).alias("first"), F.count("*").alias("n"))  # a row a task and shard
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sized(runs.select("shard", "part", (before - F.col("first")).alias("shift")), 40)
    return ordered.select("*", part.alias("part"), place.alias("place")).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
