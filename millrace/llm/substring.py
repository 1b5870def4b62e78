"""Removal of passages that repeat across documents, by repeated-phrase automata.

A window of 50 words that two documents share holds the same 25-word phrase, chosen by its hash among the window's 26
(winnowing). Phrases found in two documents mark regions; the windows of the regions alone are confirmed, by their first
document. The confirmed passages are compiled into Aho-Corasick automata, one a shard and only over phrases of them, and
the regions of all documents that hold a phrase of the shard are streamed through it; what it locates is compared
window by window with the confirmed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, materialize, small_batches

#: An odd number and its inverse modulo 2^64, twice: rolling hashes of word sequences.
BASES = [(0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)), (0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))]


def word_hashes(words: list):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(hashes, size: int, which: int = 0):
    """A 64-bit number for each `size` consecutive words, the same wherever they stand."""
    import numpy as np

    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    base, inverse = BASES[which]
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (base, inverse))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down, dtype=np.uint64)])
    x = (sums[size:] - sums[:-size]) * up[: n - size + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chosen(phrases, among: int):
    """Positions of the least phrase of every `among` consecutive ones, the first of equals."""
    import numpy as np

    if len(phrases) < among:
        return np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(phrases, among).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def merged(starts, size: int) -> list[tuple[int, int]]:
    """Ascending starts of windows of `size` as joined spans (from, to)."""
    import numpy as np

    if not len(starts):
        return []
    starts = np.asarray(starts)
    gaps = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.r_[0, gaps + 1]].tolist(), (starts[np.r_[gaps, len(starts) - 1]] + size).tolist()))


def _scan(window: int, phrase: int):
    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, sames, found, places = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = text.split() if text else []
                n.append(len(words))
                sames.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if len(words) < window:
                    found.append([])
                    places.append([])
                    continue
                phrases = rolling(word_hashes(words), phrase)
                at = chosen(phrases, window - phrase + 1)
                found.append(phrases[at].view(np.int64))
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sames, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "h", "n_words", "same", "phrases", "places"])

    return scan


def _regions(window: int, phrase: int):
    """Around each recurring phrase, the words of all windows that may hold it, by shard."""
    def regions(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, h, text, marks in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = text.split()
                by_shard: dict = {}
                for m in marks:
                    by_shard.setdefault(m["shard"], []).append(m["place"])
                for shard, at in by_shard.items():
                    mask = np.zeros(len(words) + 1, dtype=np.int64)
                    for p in at:
                        mask[max(0, p + phrase - window)] += 1
                        mask[min(len(words), p + window)] -= 1
                    inside = np.flatnonzero(np.diff(np.r_[0, np.cumsum(mask[:-1]) > 0, 0]))
                    for a, b in zip(inside[::2].tolist(), inside[1::2].tolist()):
                        if b - a >= window:
                            out.append((shard, doc, h, a, b - a, b" ".join(words[a:b])))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["shard", "doc_id", "h", "start", "size", "words"])

    return regions


def _windows(window: int):
    def windows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                hashes = word_hashes(batch.column(3)[k].as_py().split())
                one, two = rolling(hashes, window), rolling(hashes, window, 1)
                n = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, batch.column(1)[k].as_py())), pa.array((np.arange(n) + batch.column(2)[k].as_py()).astype("int32"))], names=["shard", "one", "two", "doc_id", "place"])

    return windows


def _passages(window: int):
    """The confirmed windows of a region, joined: each passage's words."""
    def passages(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for shard, doc, start, size, words, places in zip(*(batch.column(k).to_pylist() for k in range(6))):
                own = sorted(p - start for p in places if start <= p <= start + size - window)
                words = words.split()
                run = []
                for p in own:  # windows at neighbouring places make one passage; any other gap ends it
                    if run and p > run[-1] + 1:
                        out.append((shard, doc, b" ".join(words[run[0] : run[-1] + window])))
                        run = []
                    run.append(p)
                if run:
                    out.append((shard, doc, b" ".join(words[run[0] : run[-1] + window])))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["shard", "doc_id", "words"])

    return passages


def _locate(window: int, phrase: int):
    """Compiles one shard's passages and streams regions through the automaton: spans (from, to) to remove, by document."""
    def locate(passages, regions):
        import ahocorasick
        import numpy as np
        import pandas as pd

        out = []
        if len(passages) and len(regions):
            number: dict = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            ones, twos, owners = [], [], []
            for doc, words in zip(passages["doc_id"], passages["words"]):
                words = words.split()
                ids = [number.setdefault(w, len(number) + 1) for w in words]
                for k in range(0, len(ids) - phrase + 1, phrase):  # every window holds one of these in full
                    automaton.add_word(tuple(ids[k : k + phrase]), 1)
                hashes = word_hashes(words)
                ones.append(rolling(hashes, window))
                twos.append(rolling(hashes, window, 1))
                owners.append(np.full(len(ones[-1]), doc))
            automaton.make_automaton()
            ones, twos, owners = map(np.concatenate, (ones, twos, owners))
            order = np.lexsort((twos, ones))
            ones, twos, owners = ones[order], twos[order], owners[order]
            for doc, h, start, words in zip(regions["doc_id"], regions["h"], regions["start"], regions["words"]):
                words = words.split()
                near = np.zeros(len(words) + 1, dtype=np.int64)
                for end, _ in automaton.iter(tuple(map(number.get, words, [0] * len(words)))):
                    near[max(0, end + 1 - window)] += 1
                    near[end + 2 - phrase] -= 1
                at = np.flatnonzero(np.cumsum(near)[: len(words) - window + 1] > 0)
                if not len(at):
                    continue
                hashes = word_hashes(words)
                one, two = rolling(hashes, window)[at], rolling(hashes, window, 1)[at]
                k = np.searchsorted(ones, one)
                hit = np.zeros(len(at), dtype=bool)
                while len(ones):  # equal first halves stand side by side
                    live = (k < len(ones)) & (ones[np.minimum(k, len(ones) - 1)] == one)
                    hit |= live & (twos[np.minimum(k, len(ones) - 1)] == two) & (owners[np.minimum(k, len(ones) - 1)] < doc)
                    if not live.any():
                        break
                    k = k + live
                out += [(doc, h, a + start, b + start) for a, b in merged(at[hit], window)]
        return pd.DataFrame(out, columns=["doc_id", "h", "a", "b"]).astype("int64")

    def run(passages, regions):
        spans = locate(passages, regions)  # the automaton and its hashes end with the call
        give_back()
        return spans

    return run


def removed(docs: DataFrame, window: int = 50, phrase: int = 25, shard_phrases: int = 5_000, task_words: int = 300_000, most_broadcast: int = 64 << 20) -> DataFrame:
    """Spans of words to remove from documents (doc_id, text): doc_id, h (xxhash64 of the text), spans (array of a, b).

    See remove_repeats. Tables of more than `most_broadcast` bytes are joined by a shuffle, smaller ones by a broadcast.
    """
    def sized(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= most_broadcast else df

    small_batches(docs.sparkSession, 200)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    scanned = materialize(texts.mapInArrow(giving_back(_scan(window, phrase)), "doc_id long, h long, n_words long, same binary, phrases array<long>, places array<int>"))
    # Copies: of documents of the same words all but the first lose everything, and only the first goes on.
    first = materialize(scanned.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("same", "first"))
    repeated = scanned.select("doc_id", "h", "n_words", "same").join(sized(first, 32 * first.count()), "same").where("doc_id > first")
    repeated = materialize(repeated.select("doc_id", "h", "n_words"))
    copies = repeated.where(F.col("n_words") >= window).select("doc_id", "h", F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b"))
    single = scanned.select("doc_id", "h", "phrases", "places").join(sized(repeated.select("doc_id", "h"), 16 * repeated.count()), ["doc_id", "h"], "left_anti")
    alone = single.select("doc_id", "h", F.explode(F.arrays_zip("phrases", "places")).alias("p")).select("doc_id", "h", F.col("p.phrases").alias("phrase"), F.col("p.places").alias("place"))
    recurring = materialize(alone.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("phrase", "first"))
    n = recurring.count()
    shards = max(1, -(-n // shard_phrases))
    marks = alone.join(sized(recurring, 16 * n), "phrase").select("doc_id", "h", F.struct(F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard"), "place").alias("mark"))
    lists = materialize(marks.groupBy("doc_id", "h").agg(F.collect_list("mark").alias("marks")))
    total, rows_ = lists.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0)), F.count("*")).first()
    regions = materialize(texts.join(sized(lists, 16 * total + 24 * rows_), ["doc_id", "h"]).select("doc_id", "h", "text", "marks").mapInArrow(giving_back(_regions(window, phrase)), "shard long, doc_id long, h long, start int, size int, words binary"))
    rows = regions.select("shard", "doc_id", "start", "words").mapInArrow(giving_back(_windows(window)), "shard long, one long, two long, doc_id long, place int")
    confirmed = rows.groupBy("shard", "one", "two").agg(F.min(F.struct("doc_id", "place")).alias("m"), F.max("doc_id").alias("last")).where("m.doc_id < last")
    owned = confirmed.groupBy("shard", F.col("m.doc_id").alias("doc_id")).agg(F.collect_list("m.place").alias("own"))
    passages = materialize(regions.join(owned, ["shard", "doc_id"]).select("shard", "doc_id", "start", "size", "words", "own").mapInArrow(giving_back(_passages(window)), "shard long, doc_id long, words binary"))
    # A shard that many documents share is streamed by several tasks, each with the shard's automaton.
    salts = materialize(regions.groupBy("shard").agg(F.ceil(F.sum("size") / task_words).cast("int").alias("salts")))
    streams = regions.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "salts").cast("int")).select("shard", "salt", "doc_id", "h", "start", "words")
    compiled = passages.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc_id", "words")
    keys = ["shard", "salt"]
    located = compiled.groupBy(*keys).cogroup(streams.groupBy(*keys)).applyInPandas(_locate(window, phrase), "doc_id long, h long, a long, b long")
    return located.unionByName(copies).groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 25, most_broadcast: int = 64 << 20) -> DataFrame:
    """Removes each word that a window of `window` words covers which also starts in a document of a smaller doc_id.

    Takes documents (doc_id, text and any other columns) and returns the input's columns, text being the kept words joined
    by one blank, with n_words and n_removed (columns of these names in the input are replaced). Words are what ASCII
    blanks leave; windows are judged on the input. Null text has no words and becomes empty. Rows without doc_id are
    compared with nothing and keep their words; rows of the same doc_id remove nothing from each other. Repeated rows
    stay; an empty table gives no rows.
    """
    spans = materialize(removed(docs, window, phrase, most_broadcast=most_broadcast))
    few = spans.agg(F.coalesce(F.sum(24 + 16 * F.size("spans")), F.lit(0))).first()[0] <= most_broadcast

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(texts, spans):
        import numpy as np
        import pandas as pd

        out = []
        for text, found in zip(texts, spans):
            words = (text or "").encode().split()
            if found is not None and len(found):
                keep = np.zeros(len(words) + 1, dtype=np.int64)
                for s in found:
                    keep[s["a"]] += 1
                    keep[s["b"]] -= 1
                keep = np.cumsum(keep[:-1]) == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                kept = words
            out.append((b" ".join(kept).decode(), len(words), len(words) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    joined = rows.join(F.broadcast(spans) if few else spans, ["doc_id", "h"], "left").select("row", cut(F.col("row.text").cast("string"), "spans").alias("cut"))
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    return joined.select(*[F.col("cut.text").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in names], "cut.n_words", "cut.n_removed")
