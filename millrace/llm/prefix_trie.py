"""The trie of conversation prefixes: which conversations begin alike, how they branch, and what sharing them would save.

Every prefix of a conversation gets a digest of 128 bits. A count-min sketch over all digests screens them: where its
estimate is one, the prefix belongs to one conversation alone, and so does everything after it; those tails become nodes
where they are. Only prefixes that may be shared are shuffled and grouped exactly.

No group is ever gathered. Turns are sorted by ranges, so that a conversation of any length is dealt over tasks, and
running digests are put together from those of the ranges. What a node sums over its subtree is said as a sum over its
members of something that each member knows alone, so that partial aggregation does the work:

- a member stands for a node if it is the smallest; along its own path it does from some depth `first` on
- a node's saved characters are the lengths that its members have from there on and before their own `first`
- its leaves are the members that stand for a childless node, its children the members that stand for the next node
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, materialize, small_batches, written

#: Counters of one of the sketch's two rows at most (as a power of two), and of a block in which they travel.
MOST_BITS, BLOCK_BITS = 24, 16

#: Up to so many ends of a node are sorted in one array; beyond, they are sorted by ranges and hashed as a stream.
FEW_ENDS = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """The turns as c, t1, t2 (128 bits of role and text), chars and place, which ascends by c and turn.

    Turns are ordered by turn, null first; turns of one number by role, by the text's first 16 characters, by digest.
    place holds the task that sorted a row (from bit 33) and the row's number there. Texts aren't moved.
    """
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 16).alias("lead"),
        *(F.xxhash64(F.lit(k), role, text).alias(f"t{k}") for k in (1, 2)), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    keys = ["c", "turn", "role", "lead", "t1", "t2", "tie"]
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "t1", "t2", "chars", F.monotonically_increasing_id().alias("place")))


def part() -> Column:
    return F.shiftright("place", 33)


def digests(depth: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(depth), "t1", "t2").alias(f"h{k}") for k in (1, 2)]


def running(rows: DataFrame, keys: str, order: str) -> DataFrame:
    """Adds g1, g2 (digests of all turns so far) and w (characters so far) within the keys."""
    over = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rows.selectExpr("*", f"bit_xor(h1) {over} AS g1", f"bit_xor(h2) {over} AS g2", f"sum(chars) {over} AS w")


def prefixes(conversations: DataFrame, head: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """A row for each prefix of each conversation, the empty one included: c, d (turns), g1, g2 (digest), chars (of the last text), w (of all), n (turns of c).

    head(c) names another conversation and how many of its first turns replace as many of c's own; a missing one gives none.
    """
    turns = ordered_turns(conversations)
    ranges = written(turns.groupBy("c", part().alias("p")).agg(F.min("place").alias("first"), F.count("*").alias("k")))
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that holds turns of c
    ranges = ranges.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("several", F.count("*").over(Window.partitionBy("c")) > 1)
    own = ranges.groupBy("c").agg(F.sum("k").alias("own"))
    if head is None:
        lengths = own.withColumns({"hc": F.lit(None).cast("long"), "h": F.lit(0).cast("long"), "a": F.lit(0).cast("long")})
    else:
        hc, h = head(F.col("c"))
        asked = own.withColumns({"hc": hc.cast("long"), "h": h.cast("long")})
        lengths = asked.join(own.select(F.col("c").alias("hc"), F.col("own").alias("there")), "hc", "left").withColumn("a", F.least("h", F.coalesce("there", F.lit(0))))
    lengths = written(lengths.select("c", "hc", "h", "a", (F.col("a") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))

    needed = lengths.where("a > 0").groupBy(F.col("hc").alias("c")).agg(F.max("a").alias("need"))
    index = (F.col("place") - F.col("first") + F.col("before") + 1).alias("d")
    numbered = turns.withColumn("p", part()).join(ranges.join(needed, "c").where("before < need").select("c", "p", "first", "before", "need"), ["c", "p"])
    first_turns = numbered.select("c", "t1", "t2", "chars", "need", index).where("d <= need").select("c", "d", "chars", *digests("d"))
    heads = written(running(first_turns, "c", "d").select(F.col("c").alias("hc"), "d", "chars", "g1", "g2", "w"))  # windows of at most `need` rows

    zero = F.lit(0).cast("long")
    start = heads.select("hc", F.col("d").alias("a"), F.col("g1").alias("s1"), F.col("g2").alias("s2"), F.col("w").alias("sw"))
    about = lengths.join(start, ["hc", "a"], "left").select("c", "h", "a", "n", *(F.coalesce(k, zero).alias(k) for k in ("s1", "s2", "sw")))
    place = ranges.join(about, "c").select("c", "p", "first", "before", "several", "h", "a", "n", "s1", "s2", "sw")
    kept = turns.withColumn("p", part()).join(place, ["c", "p"]).withColumn("i", index).where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("a"))
    kept = kept.select("c", "p", "place", "several", "d", "chars", "n", "s1", "s2", "sw", *digests("d"))
    sums = kept.where("several").groupBy("c", "p").agg(F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("chars").alias("ew"))
    over = "OVER (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = sums.selectExpr("c", "p", f"bit_xor(e1) {over} AS e1", f"bit_xor(e2) {over} AS e2", f"sum(ew) {over} AS ew")
    earlier = F.broadcast(written(earlier))  # a conversation in several tasks: at most two rows a task
    runs = running(kept, "c, p", "place").join(earlier, ["c", "p"], "left")
    digest = [F.expr(f"g{k} ^ s{k} ^ coalesce(e{k}, 0L)").alias(f"g{k}") for k in (1, 2)]
    rest = runs.select("c", "d", *digest, "chars", (F.col("w") + F.col("sw") + F.coalesce("ew", zero)).alias("w"), "n")
    shared = lengths.where("a > 0").join(heads, "hc").where("d <= a").select("c", "d", "g1", "g2", "chars", "w", "n")
    roots = lengths.select("c", zero.alias("d"), zero.alias("g1"), zero.alias("g2"), zero.alias("chars"), zero.alias("w"), "n")
    return rest.unionByName(shared).unionByName(roots)


def buckets(d, g1, g2, bits: int):
    """A counter in each of the sketch's two rows (the second row's counters follow the first's)."""
    import numpy as np

    d, g1, g2 = (x.astype(np.uint64) for x in (d, g1, g2))
    mixed = d * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k, g in enumerate((g1, g2)):
        x = (g ^ mixed) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out.append(((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64) + (k << bits))
    return out


def longs(batch, *names):
    import numpy as np

    return [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in names]


def sketched(rows: DataFrame, count: int) -> tuple[int, bytes]:
    """A count-min sketch of the prefixes (d, g1, g2): its width as a power of two, and a bit for each counter that is over one.

    The width follows the number of rows up to 2^24; beyond, fewer prefixes are proved single, and the result stays the
    same. A task's counters stop at two and travel compressed in blocks; they are added up in two steps, 64 to a group
    and then the groups. What reaches the driver takes 4 MB at most.
    """
    bits = min(MOST_BITS, max(BLOCK_BITS - 1, (4 * count).bit_length()))
    size = 1 << BLOCK_BITS

    def count_all(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        counters = np.zeros(2 << bits, dtype=np.uint8)
        for batch in batches:
            for at in buckets(*longs(batch, "d", "g1", "g2"), bits):
                hit, times = np.unique(at, return_counts=True)
                counters[hit] = np.minimum(counters[hit] + np.minimum(times, 2), 2)
        blocks = counters.reshape(-1, size)
        full = np.flatnonzero(blocks.any(axis=1))
        group = TaskContext.get().partitionId() % 64
        for b in full.tolist():
            yield pa.RecordBatch.from_pylist([{"b": b, "grp": group, "counters": zlib.compress(blocks[b].tobytes(), 1)}])

    def added(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        total = np.zeros(size, dtype=np.uint8)
        for c in pdf["counters"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(c), dtype=np.uint8), 2)
        return pd.DataFrame({"b": [int(pdf["b"].iloc[0])], "counters": [zlib.compress(total.tobytes(), 1)]})

    kind = "b long, counters binary"
    partial = rows.select("d", "g1", "g2").mapInArrow(giving_back(count_all), "b long, grp long, counters binary")
    found = partial.groupBy("b", "grp").applyInPandas(added, kind).groupBy("b").applyInPandas(added, kind).collect()
    import zlib

    import numpy as np

    over = np.zeros((2 << bits) // 8, dtype=np.uint8).reshape(-1, size // 8)
    for r in found:
        over[r["b"]] = np.packbits(np.frombuffer(zlib.decompress(bytes(r["counters"])), dtype=np.uint8) > 1, bitorder="little")
    return bits, over.tobytes()


def screened(rows: DataFrame, bits: int, over) -> DataFrame:
    """Adds kind: 0 where a prefix may be shared; 2 where it is single and so is the row before it, a turn shorter; 1 for other single ones."""
    columns = rows.columns

    def screen(batches):
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(over.value, dtype=np.uint8)
        last = (-1, -1, False)
        for batch in batches:
            c, d, g1, g2 = longs(batch, "c", "d", "g1", "g2")
            if not len(c):
                continue
            shared = np.ones(len(c), dtype=bool)
            for at in buckets(d, g1, g2, bits):
                shared &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            follows = np.zeros(len(c), dtype=bool)
            follows[1:] = (c[1:] == c[:-1]) & (d[1:] == d[:-1] + 1) & ~shared[:-1]
            follows[0] = last == (c[0], d[0] - 1, True)
            last = (c[-1], d[-1], not shared[-1])
            kind = np.where(shared, 0, np.where(follows, 2, 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], names=[*columns, "kind"])

    return rows.mapInArrow(giving_back(screen), ", ".join(f"{k} long" for k in columns) + ", kind int")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """d, g1, g2 and the hash of a node's ends (c), ascending and comma-joined, for nodes of many ends.

    Ends are sorted by ranges and joined to texts of at most FEW_ENDS; one task then hashes a node's texts as a stream.
    """
    node = ["d", "g1", "g2"]

    def join(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            d, g1, g2, c = longs(batch, *node, "c")
            if not len(c):
                continue
            cut = np.flatnonzero((d[1:] != d[:-1]) | (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(c)]):
                for i in range(a, b, FEW_ENDS):
                    ids = c[i : min(i + FEW_ENDS, b)]
                    yield pa.RecordBatch.from_pylist([{"d": int(d[i]), "g1": int(g1[i]), "g2": int(g2[i]), "first": int(ids[0]), "ids": ",".join(map(str, ids.tolist()))}])

    def digest(batches):
        import hashlib

        import pyarrow as pa

        now, state = None, None

        def result():
            return pa.RecordBatch.from_pylist([dict(zip(node, now)) | {"many_sha256": state.hexdigest()}])

        for batch in batches:
            for row in batch.to_pylist():
                if (key := tuple(row[k] for k in node)) != now:
                    if now:
                        yield result()
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
        if now:
            yield result()

    sorted_ends = ends.repartitionByRange(*node, "c").sortWithinPartitions(*node, "c")
    texts = sorted_ends.mapInArrow(join, "d long, g1 long, g2 long, first long, ids string")
    return texts.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(digest, "d long, g1 long, g2 long, many_sha256 string")


def prefix_trie(conversations: DataFrame, head: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text): one for each distinct sequence of first turns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members: conversations that begin so),
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, the characters of each node's last
    text once for each member but one), ends_sha256 (of the members that end there, ascending, comma-joined).

    Null role or text counts as empty. Rows without conv_id take no part. Turns of one number are ordered by role, then by
    text as ordered_turns says; repeated rows are turns of their own. Other columns are ignored. A conversation left
    without turns by `head` is a member of the root. An empty table has no node, not even a root. Equal digests of 128
    bits count as equal prefixes.
    """
    spark = conversations.sparkSession
    small_batches(spark, 65536)
    rows = written(prefixes(conversations, head))
    bits, over = sketched(rows, rows.count())
    judged = screened(rows, bits, spark.sparkContext.broadcast(over))
    empty, one = F.sha2(F.lit(""), 256), F.sha2(F.col("c").cast("string"), 256)
    tails = judged.where("kind = 2").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("d") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("d") == F.col("n"), one).otherwise(empty).alias("ends_sha256"),
    )

    node = ["d", "g1", "g2"]
    near = written(judged.where("kind < 2"))
    groups = near.where("kind = 0").groupBy(*node).agg(F.min("c").alias("m"), F.count("*").alias("members"), F.count_if(F.col("n") == F.col("d")).alias("ends"))
    single = near.where("kind = 1").withColumns({"m": F.col("c"), "members": F.lit(1).cast("long"), "ends": (F.col("n") == F.col("d")).cast("long")})
    near = written(near.where("kind = 0").join(groups, node).unionByName(single).drop("kind"))
    other = F.col("m") != F.col("c")
    each = near.groupBy("c").agg(
        F.count_if(other).alias("first"), F.max(F.when(other, F.col("w"))).alias("w_before"), F.max_by("m", F.when(other, F.col("d"))).alias("m_before"),
        F.max(F.when(F.col("d") == F.col("n"), (F.col("members") == F.col("ends")) & ~other)).alias("leaf"),
    )
    near = near.join(written(each), "c")
    saved = F.when(F.col("d") < F.col("first"), F.col("w_before") - F.col("w") + F.col("chars")).otherwise(0)
    above = F.when(F.col("d") == 0, None).when(F.col("d") > F.col("first"), F.col("c")).otherwise(F.col("m_before"))
    last = F.when((F.col("n") == F.col("d")) & (F.col("ends") <= FEW_ENDS), F.col("c"))
    nodes = near.groupBy(*node).agg(
        F.min("c").alias("conv_id"), F.max(F.when(~other, above)).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if((F.col("n") > F.col("d")) & (F.col("first") <= F.col("d") + 1)).alias("n_children"),
        F.count_if(F.coalesce("leaf", F.lit(True))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.max("ends").alias("ends"), F.sort_array(F.collect_list(last)).alias("few"),
    )
    many = materialize(hashed_ends(near.where((F.col("n") == F.col("d")) & (F.col("ends") > FEW_ENDS)).select(*node, "c")))
    few = F.sha2(F.array_join(F.transform("few", lambda c: c.cast("string")), ","), 256)
    nodes = nodes.join(many, node, "left").withColumn("ends_sha256", F.coalesce("many_sha256", few)).withColumn("depth", F.col("d"))
    return nodes.select(tails.columns).unionByName(tails)
