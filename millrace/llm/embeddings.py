"""Near duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. The inverted lists hold, for each label and each
two pivots, the vectors that have both among their nearest, so that vectors meet if they share two pivots at least; those
of a list are verified in double precision, under the first two pivots that they share. Long lists are compared in blocks
of bounded size, and a block gives only link counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, sized


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def pivots_of(vectors: DataFrame, least: int = 32, most: int = 512, sample: int = 4) -> list[list[float]]:
    """Pivots far apart: about 2 sqrt(n), between `least` and `most`, chosen greedily from `sample` times as many vectors.

    The sample is bounded and taken by hash. The first pivot is its first vector, and each further one is the vector whose
    largest cosine with those before is the least, so that a crowd of near copies gives few pivots, whatever its share.
    """
    import numpy as np

    n = vectors.count()
    wanted = min(most, max(least, math.ceil(2 * math.sqrt(n))))
    rows = [r["v"] for r in vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample * wanted).collect()]
    if not rows:
        return []
    x = _matrix(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, close = [0], x @ x[0]
    while len(chosen) < min(wanted, len(x)):
        k = int(close.argmin())
        if close[k] > 1 - 1e-9:  # only copies are left
            break
        chosen.append(k)
        close = np.maximum(close, x @ x[k])
    return [list(map(float, rows[k])) for k in chosen]


def described(vectors: DataFrame, pivots: list[list[float]], depth: int) -> DataFrame:
    """Adds `near`: the numbers of the `depth` nearest pivots by cosine, nearest first; those of another dimension come last."""
    width = max(map(len, pivots))

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array([[*x, *[0.0] * (width - len(x))] for x in pivots])
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        for b in batches:
            x = _matrix(b.column(2).to_pylist(), width)
            order = np.argsort(-(x @ p.T) / np.linalg.norm(x, axis=1, keepdims=True), axis=1, kind="stable")[:, :depth].astype("int32") if len(x) else np.zeros((0, depth), "int32")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order), type=pa.list_(pa.int32()))], names=["rep", "label", "v", "copies", "near"])

    return vectors.mapInArrow(nearest, f"rep long, label long, v {vectors.schema['v'].dataType.simpleString()}, copies long, near array<int>")


def _matrix(rows: list, width: int = 0):
    import numpy as np

    width = max([width, *map(len, rows)])
    return np.array([[*r, *[0.0] * (width - len(r))] for r in rows], dtype=np.float64).reshape(len(rows), width)


def links_of(reps, copies, left, right):
    """Of linked pairs (indexes into reps): each one's link count, and a forest that joins what they connect."""
    import numpy as np
    import pandas as pd

    counts = np.bincount(np.r_[left, right], weights=np.r_[copies[right], copies[left]], minlength=len(reps)).astype(np.int64)
    root = np.arange(len(reps))
    while True:  # the least number each one reaches, until none falls
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            break
        root = low
    tied = root != np.arange(len(reps))
    return pd.concat([pd.DataFrame({"rep": reps[counts > 0], "other": np.int64(0), "n": counts[counts > 0]}), pd.DataFrame({"rep": reps[tied], "other": reps[root[tied]], "n": np.int64(0)})])


def first_shared(near_a, near_b, shared: int, base: int):
    """The key of the first `shared` pivots that each two rows have in common (-1: fewer): base-`base` digits, ascending."""
    import numpy as np

    both = (near_a[:, :, None] == near_b[:, None, :]).any(axis=2)
    least = np.sort(np.where(both, near_a, base), axis=1)[:, :shared].astype(np.int64)
    key = np.zeros(len(least), dtype=np.int64)
    for k in range(shared):
        key = key * base + least[:, k]
    return np.where(least[:, -1] < base, key, -1)


def compare_lists(threshold: float, shared: int, base: int, chunk: int = 1 << 16):
    """A function for a task's share of short lists: link counts (rep, n) and forest edges (rep, other) of their linked pairs."""
    def lists(pdf):
        import numpy as np

        pdf = pdf.sort_values(["label", "key"])
        keys, near = pdf["key"].to_numpy(), np.stack(pdf["near"].to_list())
        v, sizes = _matrix(list(pdf["v"])), pdf["v"].map(len).to_numpy()
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        begins = np.r_[True, (np.diff(keys) != 0) | (np.diff(pdf["label"].to_numpy()) != 0)]
        ends = np.r_[np.flatnonzero(begins)[1:], len(pdf)][np.cumsum(begins) - 1]
        after = ends - np.arange(len(pdf)) - 1  # each row meets those that follow it in its list
        reps, index = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
        copies = np.zeros(len(reps), dtype=np.int64)
        copies[index] = pdf["copies"].to_numpy()
        bounds, found = np.r_[0, np.cumsum(after)], []
        for start in range(0, int(bounds[-1]), chunk):
            pair = np.arange(start, min(start + chunk, int(bounds[-1])))
            i = np.searchsorted(bounds, pair, side="right") - 1
            j = i + 1 + pair - bounds[i]
            hit = (np.einsum("ij,ij->i", v[i], v[j]) >= threshold) & (sizes[i] == sizes[j])
            i, j = i[hit], j[hit]
            own = first_shared(near[i], near[j], shared, base) == keys[i]
            found.append((index[i[own]], index[j[own]]))
        left, right = (np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]) for k in (0, 1))
        return links_of(reps, copies, left, right)

    return lists


def compare(threshold: float, shared: int, base: int):
    """A function for one block of a long list: what compare_lists gives, for the linked pairs of the block's two sides."""
    def block(key, pdf):
        import numpy as np
        import pandas as pd

        one_side = key[2] == key[3]
        a = pdf[pdf["side"] == 0]
        b = a if one_side else pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "other": [], "n": []}).astype("int64")
        va, vb = (_matrix(list(x["v"]), max(map(len, pdf["v"]))) for x in (a, b))
        cosine = (va / np.linalg.norm(va, axis=1, keepdims=True)) @ (vb / np.linalg.norm(vb, axis=1, keepdims=True)).T
        i, j = np.nonzero(np.triu(cosine >= threshold, 1) if one_side else cosine >= threshold)
        own = a["v"].map(len).to_numpy()[i] == b["v"].map(len).to_numpy()[j]
        i, j = i[own], j[own]
        own = first_shared(np.stack(a["near"].to_list())[i], np.stack(b["near"].to_list())[j], shared, base) == key[1]
        i, j = i[own], j[own]
        both = a if one_side else pd.concat([a, b])
        return links_of(both["rep"].to_numpy(), both["copies"].to_numpy(), i, j + (0 if one_side else len(a)))

    return block


def embedding_links(embeddings: DataFrame, threshold: float = 0.98, depth: int = 6, shared: int = 2, block_rows: int = 1024, task_rows: int = 4096) -> DataFrame:
    """Links between embeddings (vec_id, embedding, label) of equal label and cosine >= threshold, one row a vector.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included),
    kept (vec_id = component_id). The pivots are chosen from a bounded sample, but every vector is indexed; pairs that share
    fewer than `shared` of their `depth` nearest pivots are missed (see the tests for the recall, with and without a crowd
    of near copies), and no pair below the threshold is linked. Equal vectors of a label are one class, whose copies are
    counted and not paired. Vectors that are null, zero or hold null or non-finite components, and those without a label,
    link with nothing, as do vectors of different length. A row without vec_id links with nothing; different vectors under
    one vec_id are rows of their own; an empty table gives no rows.
    """
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("v"))
    fit = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).where(usable(F.col("v"))).where(F.exists("v", lambda x: x != 0))
    classes = materialize(fit.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))).withColumn("rep", F.monotonically_increasing_id())
    pivots = pivots_of(classes)
    if not pivots:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    base = len(pivots) + 1
    shared = min(shared, len(pivots))
    indexed = materialize(described(classes.select("rep", "label", "v", "copies"), pivots, depth))
    # Every `shared` of the nearest pivots, ascending, are a key; only keys that two vectors have are followed.
    ordered, picks = F.array_sort("near"), list(itertools.combinations(range(min(depth, len(pivots))), shared))
    digits = [sum((F.get(ordered, F.lit(k)).cast("long") * base ** (shared - 1 - n) for n, k in enumerate(pick)), F.lit(0).cast("long")) for pick in picks]
    keyed = indexed.withColumn("key", F.explode(F.array(*digits)))
    shares = keyed.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1").select("label", "key", F.ceil(F.col("n") / block_rows).cast("int").alias("chunks"))
    shares = sized(shares, 40)
    short = keyed.join(shares.where("chunks = 1"), ["label", "key"]).select("label", "key", "rep", "v", "copies", "near")
    tasks = max(1, -(-classes.count() * len(picks) // task_rows))
    by_task = short.groupBy(F.pmod(F.xxhash64("label", "key"), F.lit(tasks)).alias("task"))
    found = by_task.applyInPandas(compare_lists(threshold, shared, base), "rep long, other long, n long")
    parts = keyed.join(shares.where("chunks > 1"), ["label", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("low"), F.greatest("chunk", k).alias("high"), F.when(F.col("chunk") <= k, 0).otherwise(1).alias("side"))))
    blocks = parts.select("label", "key", "rep", "v", "copies", "near", spread.alias("b")).select("label", "key", "b.low", "b.high", "b.side", "rep", "v", "copies", "near")
    found = materialize(found.unionByName(blocks.groupBy("label", "key", "low", "high").applyInPandas(compare(threshold, shared, base), "rep long, other long, n long")))
    counts = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("label", "v", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = materialize(known)
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "v", "n_links", "component_id")
    linked = fit.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    unfit = F.col("label").isNull() | F.col("vec_id").isNull() | ~usable(F.col("v")) | ~F.exists("v", lambda x: x != 0)
    alone = rows.where(F.coalesce(unfit, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
