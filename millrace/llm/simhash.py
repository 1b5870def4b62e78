"""SimHash near duplicates through pivot distance tables.

Fingerprints are described by their Hamming distances to many reference fingerprints, computed once. Two fingerprints
within r bits differ by at most r in every such distance. Some references cover one block of bits each: as r flipped bits
touch at most r blocks, the table's entries for the other blocks are equal, and those equal entries are what pairs are
found by. Pairs whose largest difference over the other references exceeds r are discarded, and the rest are verified.
"""

from __future__ import annotations

import itertools
import math
import operator
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, giving_back, materialize, sized, small_batches, written


def shingle_hashes(text: bytes, size: int):
    """XXH64 (seed 42) of each `size`-word shingle, repeats included; the whole sequence if it is shorter; none without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, and only the ASCII blanks cut
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def majority_bits(hashes):
    """The 64-bit number whose bits are set in over half the hashes (0 for none)."""
    import numpy as np

    if not len(hashes):
        return 0
    lanes, counts = np.uint64(0x0101010101010101), np.zeros((8, 8), dtype=np.int64)
    cuts = np.arange(0, len(hashes), 255)  # as many as a byte can count
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cuts)
        counts[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).reshape(64)  # byte by byte from the lowest, bit by bit
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id and fp (array of `words` 64-bit numbers) of whole texts (doc_id, text); null text counts as empty.

    The first number is the majority over the shingles' XXH64; each further one is the majority over the same hashes
    multiplied and mixed, so that a wider fingerprint costs no more hashing of text.
    """
    def prints(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hashes, fp = shingle_hashes(text or b"", shingle), []
                for k in range(words):
                    if k:
                        mixed = hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
                        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                        mixed ^= mixed >> np.uint64(32)
                    value = majority_bits(mixed if k else hashes)
                    fp.append(value - (1 << 64) if value >> 63 else value)
                out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(giving_back(prints), "doc_id long, fp array<long>")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_references(radius: int, seed: int = 7) -> list[list[int]]:
    """For each of radius + 3 blocks of bits, reference fingerprints: random halves of the block's bits."""
    pick, blocks = random.Random(seed), radius + 3
    out = []
    for b in range(blocks):
        bits = range(64 * b // blocks, 64 * (b + 1) // blocks)
        out.append([sum(1 << k for k in pick.sample(bits, len(bits) // 2)) for _ in range(10)])
    return out


def wide_references(count: int = 12, seed: int = 11) -> list[int]:
    pick = random.Random(seed)
    return [pick.getrandbits(64) for _ in range(count)]


def distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(reference))))


def pivot_tables(prints: DataFrame, radius: int) -> DataFrame:
    """Adds to fingerprints (column f) their table: `blocks`, an entry for each block's references, and `wide`, distances."""
    zero = F.bit_count("f")
    entries = [F.xxhash64(*[distance(F.col("f"), r) - zero for r in family]) for family in block_references(radius)]
    return prints.select("*", F.array(*entries).alias("blocks"), F.array(*[distance(F.col("f"), r).cast("tinyint") for r in wide_references()]).alias("wide"))


def keyed_by_pivots(tables: DataFrame, radius: int) -> DataFrame:
    """A row for each three blocks of a fingerprint's table: fingerprints within `radius` bits share one of these keys."""
    triples = itertools.combinations(range(radius + 3), 3)
    at = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *[F.col("blocks")[b] for b in t]).alias("key")) for k, t in enumerate(triples)]
    return tables.withColumn("at", F.explode(F.array(*at))).select(*tables.columns, "at.k", "at.key")


def within(radius: int) -> Column:
    """Of two table rows a and b: discarded by the largest coordinate difference, then verified by the fingerprints."""
    apart = F.greatest(*[F.abs(F.col("a.wide")[k] - F.col("b.wide")[k]) for k in range(12)])
    return (apart <= radius) & (F.bit_count(F.col("a.f").bitwiseXOR(F.col("b.f"))) <= radius)


def hamming_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of distinct 64-bit fingerprints (column f) at `radius` or fewer differing bits, each once.

    The table has each fingerprint's distance to the zero fingerprint and to ten references in each of radius + 3 blocks. A
    block's entries, less the distance to zero, depend on that block alone; three blocks stay untouched by `radius`
    flips, so that every near pair has equal entries in some three blocks. A pair is taken at the first such three
    blocks alone. Rows per fingerprint: (radius + 3 choose 3); nothing is dropped, and large buckets are left to the
    skew join.
    """
    families = block_references(radius)
    keyed = keyed_by_pivots(materialize(pivot_tables(prints, radius)), radius)
    triples = list(itertools.combinations(range(len(families)), 3))
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = keyed.join(often, "key", "left_semi")
    a, b = keyed.alias("a"), keyed.alias("b")
    equal = [F.col(f"a.blocks")[k] == F.col("b.blocks")[k] for k in range(len(families))]
    first = F.coalesce(*[F.when(equal[x] & equal[y] & equal[z], F.lit(k)) for k, (x, y, z) in enumerate(triples)])
    near = (F.col("a.f") < F.col("b.f")) & within(radius) & (first == F.col("a.k"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.k") == F.col("b.k")) & near).select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate groups of documents (doc_id, text): doc_id, f (64-bit fingerprint), component_id.

    Fingerprints that differ in `radius` or fewer bits link; component_id is the smallest doc_id reachable. Equal
    fingerprints are one node, so that copies are never paired. Null and empty texts have fingerprint zero and link like
    any other; rows without doc_id keep their fingerprint, lend no id, and take their group's; repeated rows stay; an empty
    table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle).select("doc_id", F.col("fp")[0].alias("f")))
    nodes = materialize(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    # Fingerprints themselves are the nodes; the smallest doc_id of a component is found at its end.
    roots = components(hamming_links(nodes.select("f"), radius))
    rooted = nodes.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("f", "component_id"), "f").select("doc_id", "f", "component_id")


def common_shingles(rows: DataFrame, shingle: int, sample: int = 4096, most: int = 65536):
    """Hashes of shingles that three or more of about `sample` rows (by the hash of d and t) have, rarer ones first.

    They only order the shingles of `heads`; which ones are listed changes the work, not the pairs found.
    """
    import numpy as np

    share = min(1.0, sample / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("d", "t"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).dropDuplicates(["d", "t"])

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], names=["x"])

    counts = few.select(F.col("text").cast("binary")).mapInArrow(giving_back(sets), "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "x").limit(most).collect()
    return np.array([r["x"] for r in reversed(found)], dtype=np.int64).view(np.uint64)


def heads(rows: DataFrame, shingle: int, similarity: float, common) -> DataFrame:
    """Adds h (128 bits of the set of shingles), its size, f (SimHash over the set), parity and head: its first shingles.

    parity has 1024 bits, and each shingle of the set flips one of them: two sets differ by as many shingles at least as
    these bits do.

    Shingles are in one order everywhere: those not in `common` by their hash, then those in it. Two sets of m and n
    shingles with Jaccard similarity >= s share one of the first m - ceil(s m) + 1 and n - ceil(s n) + 1. The head holds
    all 64 bits of each: of fewer, unlike texts agree by chance, and the more often the larger the table, with its square.
    """
    def read(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        by_hash = np.argsort(common, kind="stable")
        known = common[by_hash]
        for batch in batches:
            h, sizes, prints, parity, first = [], [], [], [], []
            for t in batch.column(3).to_pylist():
                s = np.unique(shingle_hashes(t, shingle))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                prints.append(signed(majority_bits(s)))
                flips = np.bincount((s >> np.uint64(20) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
                parity.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
                n = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    s = np.concatenate([s[~hit][:n], common[np.sort(by_hash[at[hit]])]])
                first.append(s[:n].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(h, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "d", "t", "h", "size", "f", "parity", "head"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "d", "t", F.col("text").cast("binary")).mapInArrow(giving_back(read), "doc_id long, d long, t long, h binary, size int, f long, parity array<long>, head array<long>")


def alike(shingle: int, similarity: float):
    """Of rows (a, b, texts of a and b), those whose sets of shingles are similar enough: a, b."""
    def verify(batches):
        import numpy as np
        import pyarrow as pa

        last, left = None, None
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:  # rows come sorted by a
                    last, left = a, np.unique(shingle_hashes(one.as_py(), shingle))
                right = np.unique(shingle_hashes(two.as_py(), shingle))
                same = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(same >= similarity * (len(left) + len(right) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and d and t, which tell rows apart: the doc_id (the largest number for null), the text's hash."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(doc_id.isNull(), text).alias("t"), text.alias("text"))


def shared_heads(nodes: DataFrame) -> DataFrame:
    """rep and head (pos, key, in order) of the nodes (rep, head): of each head the shingles that another node's head has too."""
    entries = nodes.select("rep", F.posexplode("head").alias("pos", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return entries.join(sized(shared, 64), "key", "left_semi").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("head"))


def placed_keys(nodes: DataFrame, look: int = 8) -> DataFrame:
    """A row for each key of the heads: pos, key, left, how many keys that head has from there on, and prev, the up to `look` before."""
    at = nodes.select("*", F.posexplode("head").alias("nth", "e"))
    prev = F.transform(F.slice("head", F.greatest(F.col("nth") - (look - 1), F.lit(1)), F.least("nth", F.lit(look))), lambda x: x["key"])
    return at.select(*[c for c in nodes.columns if c != "head"], "e.pos", "e.key", (F.size("head") - F.col("nth")).alias("left"), prev.alias("prev"))


def close(longs: int, similarity: float) -> Column:
    """The parities of a and b differ in no more bits than sets that are similar enough can."""
    differing = reduce(operator.add, [F.bit_count(F.get("a.parity", F.lit(k)).bitwiseXOR(F.get("b.parity", F.lit(k)))) for k in range(longs)])
    return differing <= (F.col("a.size") + F.col("b.size")) * (1 - similarity) / (1 + similarity) + 1e-6


def head_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots that meet under a key, all that can be similar enough, and most of them once.

    `placed` has the rows of `placed_keys` with rep, size, root, parity (8 longs) and main, the key's largest root, of which
    no two nodes meet. What is asked of a pair holds at the first key that similar sets a and b share:

    - As many shingles as they must have in common can still follow in both.
    - So can as many shared keys of their heads. Of the at least (m + n) s / (1 + s) shingles in common, ceil(s m) - 1 at
      most are beyond the head that ends first, m being that set's size; the others are keys of both heads.
    - None of the keys before it is the other's too. That leaves out later keys that are near an earlier shared one.
    """
    a, b, size = placed.where("root <> main").alias("a"), placed.alias("b"), F.col("a.size") + F.col("b.size")
    least, beyond = size * (similarity / (1 + similarity)) - 1e-6, F.ceil(F.greatest("a.size", "b.size") * similarity - 1e-9) - 1
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep")))
    follow = (F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos")) >= least) & (F.least("a.left", "b.left") >= least - beyond)
    first = ~F.arrays_overlap("a.prev", "b.prev")
    return a.join(b, met & follow & first & close(8, similarity)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, block: int = 256, turns: int = 3) -> DataFrame:
    """doc_id, d and t of each row (see `identified`) and `first`: the struct (d, t, doc_id) of the first row of its group.

    Groups are connected by texts whose sets of `shingle`-word shingles have Jaccard similarity >= similarity. The nodes are
    the sets themselves: equal ones are one node. Links are looked for in three ways, each over nodes that are not in
    one group yet, and each link is verified by the exact similarity of whole texts:

    1. SimHash: under each key of the pivot distance tables, every node meets the first one, is discarded by the largest
       coordinate difference or the Hamming distance, and survivors are verified. That joins the closest copies.
    2. Turn by turn each node draws four shingles of its head, those of the least hash, so that similar heads draw alike;
       the nodes that drew the same one are dealt to lots of about eight, and each meets the first of its lot. The work is
       linear, and crowds of near copies become one group however large they are.
    3. All pairs that share a shingle of their heads. As similar sets must share one (see `heads`), no link is lost at
       any size of the table; pairs are left out only by bounds that follow from sizes, places, counts of shared
       shingles and parities, and where an earlier shared shingle has brought them (see `head_pairs`). A shingle's
       largest group isn't paired with itself.
    """
    rows = identified(docs)
    prints = written(heads(rows, shingle, similarity, common_shingles(rows, shingle)).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct("d", "t", "doc_id", "row")).alias("first")
    sets = written(prints.groupBy("h").agg(first, F.first("size").alias("size"), F.first("f").alias("f"), F.first("parity").alias("parity")).select(F.col("first.row").alias("rep"), "h", "first", "size", "f", "parity"))
    nodes = written(sets.join(shared_heads(prints.join(sized(sets.select("rep"), 16), F.col("row") == F.col("rep"))), "rep", "left"))

    def promising(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that their parities leave possible."""
        one, two = (nodes.select("rep", "size", "parity").alias(c) for c in "ab")
        pairs = pairs.distinct().alias("p").join(one, F.col("p.a") == F.col("a.rep")).join(two, F.col("p.b") == F.col("b.rep"))
        return pairs.where(close(16, similarity)).select("p.a", "p.b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that hold by their whole texts; one a with many b is dealt to tasks in blocks."""
        pairs = written(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        keys = nodes.select("rep", "first.d", "first.t").join(sized(wanted, 16), "rep")
        texts = rows.select("d", "t", "text").join(sized(keys, 32), ["d", "t"]).select("rep", F.col("text").cast("binary").alias("text")).dropDuplicates(["rep"])
        blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        many = sized(blocks.where("blocks > 1"), 24)
        dealt = pairs.join(many, "a", "left").withColumn("block", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int")).select("a", "b", "block")
        left = texts.join(many, F.col("rep") == F.col("a"), "left").select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), F.col("text").alias("one"))
        right = texts.select(F.col("rep").alias("b"), F.col("text").alias("two"))
        both = dealt.join(right, "b").join(left, ["a", "block"]).select("a", "b", "one", "two")
        return written(both.mapInArrow(giving_back(alike(shingle, similarity)), "a long, b long"))

    def upward(links: DataFrame) -> DataFrame:
        """Roots (node, root): nodes of one root are in one group, though not yet all of a group have one root.

        Links (a, b) lead from a node b to an earlier a; each node goes up to eight of them.
        """
        up = written(links.groupBy("b").agg(F.min("a").alias("a")))
        for _ in range(3):
            up = written(up.join(up.select(F.col("b").alias("a"), F.col("a").alias("next")), "a", "left").select("b", F.coalesce("next", "a").alias("a")))
        return up.select(F.col("b").alias("node"), F.col("a").alias("root"))

    def grouped(links: DataFrame, rooted=upward) -> DataFrame:
        """The nodes with the root of the groups that `links` make."""
        roots = rooted(links)
        return nodes.join(sized(roots, 16), F.col("rep") == F.col("node"), "left").select("rep", "size", "parity", "head", F.coalesce("root", "rep").alias("root"))

    keyed = keyed_by_pivots(pivot_tables(nodes.select("rep", "f"), radius), radius).select("rep", "f", "wide", "key")
    least = keyed.groupBy("key").agg(F.min(F.struct("rep", "f", "wide")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m.*")
    met = keyed.alias("b").join(least.alias("a"), (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & within(radius))
    links = verified(met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct())

    for turn in range(turns):
        drawn = F.slice(F.array_sort(F.transform("head", lambda x: F.xxhash64(x["key"], F.lit(turn)))), 1, 4)
        early = grouped(links).select("rep", "size", "root", F.explode(drawn).alias("key"))
        met = early.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / 8).alias("lots")).where("low < high").select("key", "lots")
        early = written(early.join(sized(met, 24), "key").withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(turn)), "lots")))
        least = early.groupBy("key", "lot").agg(F.min(F.struct("rep", "size", "root")).alias("m")).select("key", "lot", "m.*")
        near = (F.col("a.key") == F.col("b.key")) & (F.col("a.lot") == F.col("b.lot")) & (F.col("a.root") != F.col("b.root")) & (F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6)
        met = early.alias("b").join(least.alias("a"), near)
        links = links.unionByName(verified(promising(met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")))))

    folded = F.array(*[F.get("parity", F.lit(k)).bitwiseXOR(F.get("parity", F.lit(k + 8))) for k in range(8)])  # half the bits, by the same rule
    placed = placed_keys(grouped(links, components).select("rep", "size", "root", folded.alias("parity"), "head"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    placed = placed.join(sized(split, 16), "key", "left_semi")
    main = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    placed = written(placed.join(main, "key"))
    rest = head_pairs(placed, similarity)
    links = links.unionByName(verified(promising(rest)))

    roots = nodes.join(components(links), F.col("rep") == F.col("node"), "left").select("h", "first", F.coalesce("root", "rep").alias("root"))
    tops = roots.groupBy("root").agg(F.min(F.struct("first.d", "first.t", "first.doc_id")).alias("top"))
    return prints.select("doc_id", "d", "t", "h").join(roots.join(tops, "root").select("h", "top"), "h").select("doc_id", "d", "t", F.col("top").alias("first"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of alike texts (see similar_rows), one row a document: doc_id, component_id (the group's smallest doc_id).

    Null and empty texts, and those without words, form one group, as equal texts. Rows without doc_id take part, after
    all others: they take their group's smallest doc_id, and null if it has none. Different texts under one doc_id are
    rows of their own; repeated rows stay; an empty table gives no rows.
    """
    return similar_rows(docs, shingle, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def without_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) that come first in their group of alike texts.

    Of each group one row stays: that of the smallest doc_id (rows without come last), of different texts under one
    doc_id that of the smallest hash, and of repeated rows any one.
    """
    found = written(similar_rows(docs, shingle, similarity).groupBy("d", "t").agg(F.first("first").alias("first"), F.count("*").alias("n")))
    leads = (F.col("d") == F.col("first.d")) & (F.col("t") == F.col("first.t"))
    gone, repeated = found.where(~leads).select("d", "t"), found.where(leads & (F.col("n") > 1)).select("d", "t")
    one = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col("doc_id").cast("long").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), one[0].alias("d"), one[1].alias("t")).join(sized(gone, 24), ["d", "t"], "left_anti")
    if not repeated.isEmpty():
        repeated = sized(repeated, 24)
        rows = rows.join(repeated, ["d", "t"], "left_anti").unionByName(rows.join(repeated, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]))
    return rows.select("row.*")
