"""Exact top-k search as a Voronoi join: queries and data are grouped by pivots, and bounds say which data a group needs.

Inner products become distances by one more component: with M the largest length of a data vector, |(q, 0) - (x, sqrt(M^2 -
|x|^2))|^2 = |q|^2 + M^2 - 2 q.x, so that the nearest are those of the highest score. Queries are scaled to length M for that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized
from .embeddings import _matrix, usable

ROWS = "row long, id long, v array<long>"


def _lifted(batch, pivots, largest: float, data: bool):
    """Distances of a batch's vectors to the pivots, with the further component."""
    import numpy as np

    x = _matrix(batch.column(2).to_pylist(), pivots.shape[1] - 1)[:, : pivots.shape[1] - 1]
    squares = (x * x).sum(axis=1)
    if data:
        x = np.c_[x, np.sqrt(np.maximum(0, largest - squares))]
    else:  # as long as the longest data vector, which leaves a query's order of scores as it is
        x = np.c_[x * np.sqrt(largest / np.where(squares > 0, squares, 1))[:, None], np.zeros(len(x))]
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T))


def _cells(rows: DataFrame, pivots, largest: float, data: bool) -> DataFrame:
    """Adds the nearest pivot's number and the distance to it."""
    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            d = _lifted(b, pivots, largest, data)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("int32")), pa.array(d[np.arange(len(d)), cell])], names=["row", "id", "v", "cell", "d"])

    return rows.select("row", "id", "v").mapInArrow(assign, f"{ROWS}, cell int, d double")


def _gaps(queries: DataFrame, pivots, largest: float, apart) -> DataFrame:
    """For query cells and data pivots the least distance of the cell's queries to the pivot's side: cell, other, gap.

    A data vector of a cell is nearer to its own pivot than to the one nearest to the query, so that it lies beyond the
    bisector between the two.
    """
    def gaps(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            d = _lifted(b, pivots, largest, False)
            if not len(d):
                continue
            cell, near = b.column(3).to_numpy(), d.argmin(axis=1)
            gap = (d**2 - d[np.arange(len(d)), near][:, None] ** 2) / np.maximum(2 * apart[near], 1e-300)
            least = {i: gap[cell == i].min(axis=0) for i in np.unique(cell)}
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(least), len(pivots)).astype("int32")), pa.array(np.tile(np.arange(len(pivots)), len(least)).astype("int32")), pa.array(np.concatenate(list(least.values())))], names=["cell", "other", "gap"])

    return queries.select("row", "id", "v", "cell").mapInArrow(gaps, "cell int, other int, gap double").groupBy("cell", "other").agg(F.min("gap").alias("gap"))


def _solve(k: int, low, high):
    """The k best of one block of data for each query of one block; a query cell looks only where its bounds let it."""
    def block(queries, data):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["q", "query_id", "row", "vec_id", "score"]
        if not len(queries) or not len(data):
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        data = data.take(pc.sort_indices(data, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        vq, vx = queries["v"].to_pylist(), data["v"].to_pylist()
        width = max(max(map(len, vq)), max(map(len, vx)))
        q, x = _matrix(vq, width), _matrix(vx, width)
        if exact := width * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) >= 2**52:  # beyond what doubles hold exactly
            q, x = (np.array([[*r, *[0] * (width - len(r))] for r in v], dtype=np.int64).reshape(len(v), width) for v in (vq, vx))
        rows, own = data["row"].to_numpy(), queries["row"].to_numpy()
        cell, d, cells = data["cell"].to_numpy(), data["d"].to_numpy(), queries["cell"].to_numpy()
        found = []
        for i in np.unique(cells):
            asked, open_ = np.flatnonzero(cells == i), np.flatnonzero((d >= low[i][cell]) & (d <= high[i][cell]))
            scores = q[asked] @ x[open_].T
            scores = scores if exact else scores.astype(np.int64)
            for n, s in zip(asked, scores):
                fit = np.flatnonzero(rows[open_] != own[n])
                if len(fit) > k:
                    bar = np.partition(s[fit], len(fit) - k)[len(fit) - k]
                    above, ties = fit[s[fit] > bar], fit[s[fit] == bar]
                    fit = np.r_[above, ties[: k - len(above)]]  # data is in the order of ids
                found.append((np.full(len(fit), n), open_[fit], s[fit]))
        asked, at, scores = (np.concatenate(c) for c in zip(*found))
        return pa.table([pa.array(own[asked]), queries["id"].take(pa.array(asked)), pa.array(rows[at]), data["id"].take(pa.array(at)), pa.array(scores)], names=names)

    return block


#: In how many parts a cell's distances are told.
QUANTILES = 32


def _apart(sample, wanted: int):
    """At most `wanted` of the sample's vectors, each the farthest from those before it."""
    import numpy as np

    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def routed(rows: DataFrame, asked: Column, k: int, pivots: int | None, query_block: int):
    """The Voronoi join's plan: data sent to groups (g, query_blocks, row, id, v, cell, d), queries (the same), low, high, groups.

    Pivots are far apart in a bounded sample (taken in the order of a hash); what the driver gathers is a few numbers for each
    two pivots. Groups are formed by what they send: query cells join where they need the same data. For each query cell, the
    k + 1 data vectors nearest to each pivot bound the distance of the k-th best. Queries have cells of their own, around the
    pivots as queries, since a query and the same vector as data are apart. A data vector is sent to a group of
    query cells only if for one of them neither the triangle inequality at its own pivot nor the bisector between the two
    pivots rules it out. None if there are no rows.
    """
    import numpy as np

    spark = rows.sparkSession
    rows = materialize(rows.select("id", "v", F.coalesce(asked, F.lit(False)).alias("asked"))).withColumn("row", F.monotonically_increasing_id())
    largest, width, n = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.max(F.size("v")), F.count("*")).first()
    if not n:
        return None
    wanted = pivots or min(256, max(32, math.ceil(math.sqrt(n))))
    sample = {tuple(r["v"]) for r in rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(4 * wanted).select("v").collect()}
    p = _apart(_matrix(sorted(sample), width), wanted)
    squares = (p * p).sum(axis=1)
    asking = np.c_[p * np.sqrt(largest / np.where(squares > 0, squares, 1))[:, None], np.zeros(len(p))]  # the same vectors as queries
    p = np.c_[p, np.sqrt(np.maximum(0, largest - squares))]

    def between(x, y):
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T))

    apart, across, beside = between(p, p), between(asking, p), between(asking, asking)
    near = materialize(_cells(rows, p, largest, True))
    filled = near.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d", [k / QUANTILES for k in range(QUANTILES + 1)], 200).alias("q")).collect()
    count, steps = np.zeros(len(p)), np.full((len(p), QUANTILES + 1), np.inf)
    for r in filled:
        count[r["cell"]], steps[r["cell"]] = r["n"], r["q"]
    queries = materialize(_cells(rows.where("asked"), asking, largest, False))
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("n") <= k + 1).select("cell", "d").collect()
    reach = {r["cell"]: (r["far"], r["n"]) for r in queries.groupBy("cell").agg(F.max("d").alias("far"), F.count("*").alias("n")).collect()}
    slack = 1e-6 * (1 + largest**0.5)
    low, high = np.full(across.shape, np.inf), np.full(across.shape, -np.inf)
    of, at = np.array([r["cell"] for r in best], dtype=int), np.array([r["d"] for r in best])
    bound = {}
    for i, (far, _) in reach.items():
        upper = np.sort(far + across[i][of] + at)
        bound[i] = upper[k] if len(upper) > k else np.inf  # one of the k + 1 may be the query itself
        low[i], high[i] = across[i] - far - bound[i] - slack, across[i] + far + bound[i] + slack
    for r in _gaps(queries, p, largest, apart).collect():
        if r["gap"] > bound[r["cell"]] + slack:
            low[r["cell"], r["other"]], high[r["cell"], r["other"]] = np.inf, -np.inf
    # Query cells, each next to the last one's pivot, join the group whose data they share most; apart they would send more.
    def load(lows, highs):
        part = (steps <= highs[:, None]).mean(axis=1) - (steps < lows[:, None]).mean(axis=1)
        return float((count * np.maximum(0, part)).sum())

    group, groups, hulls, left, last = {}, [], [], set(reach), None
    while left:
        i = min(left, key=lambda i: (0 if last is None else beside[last][i], i))
        own, best = load(low[i], high[i]), None
        for g, (a, b, sends) in enumerate(hulls):
            if groups[g] + reach[i][1] <= query_block:
                hull = np.minimum(a, low[i]), np.maximum(b, high[i])
                together = load(*hull)
                saved = sends + own - together
                if saved > 0.1 * together and (best is None or saved > best[0]):
                    best = (saved, g, (*hull, together))
        if best is None:
            best = (0, len(groups), (low[i].copy(), high[i].copy(), own))
            groups.append(0)
            hulls.append(None)
        groups[best[1]] += reach[i][1]
        group[i], hulls[best[1]], last = best[1], best[2], i
        left.remove(i)
    needs = []  # for each data cell and group, joined: the distances to the cell's pivot that a data vector may have
    for g, size in enumerate(groups):
        members = [i for i in group if group[i] == g]
        for j in range(len(p)):
            end = None
            for a, b in sorted((low[i][j], high[i][j]) for i in members if low[i][j] <= high[i][j]):
                if end is None or a > end:
                    needs.append([j, g, max(1, -(-size // query_block)), float(a), float(b)])
                elif b > end:
                    needs[-1][4] = float(b)
                end = b if end is None else max(end, b)
    needs = F.broadcast(spark.createDataFrame(needs, "cell int, g int, query_blocks int, low double, high double"))  # at most pivots x pivots
    sent = near.join(needs, "cell").where("d >= low and d <= high").select("g", "query_blocks", "row", "id", "v", "cell", "d")
    cells = F.broadcast(spark.createDataFrame([(i, g, max(1, -(-groups[g] // query_block))) for i, g in group.items()], "cell int, g int, query_blocks int"))
    return sent, queries.join(cells, "cell").select("g", "query_blocks", "row", "id", "v", "cell"), low, high, len(groups)


def sent_share(rows: DataFrame, asked: Column, k: int = 5, pivots: int | None = None, query_block: int = 1024) -> float:
    """The share of all (data vector, group of queries) that the bounds leave to be sent; 1 if they rule out none."""
    plan = routed(rows, asked, k, pivots, query_block)
    return plan[0].count() / (plan[4] * rows.count()) if plan and plan[4] else 0.0


def voronoi_topk(rows: DataFrame, asked: Column, k: int = 5, pivots: int | None = None, query_block: int = 1024, data_block: int = 8192) -> DataFrame:
    """For each row (id, v: array<long>) that `asked` is true for, the k rows of the highest inner product, ties to the smaller id.

    Returns query_id, rank, vec_id, score. Exact. Every row but the query's own is a candidate, also one of the same id;
    rows without id come last among ties; there are fewer than k rows where fewer candidates exist. Each query row has
    ranks of its own, also beside others of its id. A group's queries and data meet in blocks of bounded size, so that a
    hot cell is spread over tasks. Shorter vectors count as filled up with zeros; an empty table gives no rows. About
    sqrt(n) pivots (32 to 256) unless `pivots` says how many.
    """
    plan = routed(rows, asked, k, pivots, query_block)
    if plan is None or not plan[4]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent, queries, low, high, _ = plan
    sent = materialize(sent)
    salts = sized(sent.groupBy("g").agg(F.ceil(F.count("*") / data_block).cast("int").alias("salts")), 16)
    fields, keys = ["row", "id", "v", "cell"], ["g", "salt", "b"]
    spread = sent.join(salts, "g").select("g", F.pmod(F.xxhash64("row"), "salts").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("b"), *fields, "d")
    posed = queries.join(salts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("row"), "query_blocks").cast("int").alias("b"), *fields)
    found = posed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_solve(k, low, high), "q long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Vectors (vec_id, embedding) as integers, floor(scale * x): id, v. Those null or with null or non-finite components go."""
    vector = F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), vector.alias("e")).where(usable(F.col("e"))).select("id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
