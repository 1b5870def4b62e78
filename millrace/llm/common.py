"""What the training-data operators share: checkpoints, Arrow batch sizes, word-cached tokenizing, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's spark.checkpoint.dir; where it is unset, a new folder under /tmp on a local master alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder; what follows reads them and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Rows written once as a table in the shared checkpoint folder and read again.

    Unlike a checkpoint, which keeps its plan's guess of its size, a table's size is that of its files; in chains of many
    joins the guesses multiply until planning takes longer than the work.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, width: int, most: int = 64 << 20) -> DataFrame:
    """A side of a join, broadcast if its rows of about `width` bytes are counted to take at most `most`; beyond, both sides shuffle.

    The rows are written first, so that the count and the join read the same ones.
    """
    df = written(df)
    return F.broadcast(df) if width * df.count() <= most else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what a Python worker and the buffers beside the heap hold at once: at most so many rows and 2 MB to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks, beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(work):
    """`work` over Arrow batches; at its end the worker returns what it has freed."""
    def run(batches):
        yield from work(batches)
        give_back()

    return run


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges(a, b), a and b long: node, root (the component's smallest node).

    Alternating large-star and small-star steps: every step is a grouped minimum and a join, so a hub's neighbours are
    spread over tasks by partial aggregation and by the skew join. The number of steps follows the logarithm of the
    longest path. An empty input gives an empty result.
    """
    def pointed(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(pointed(edges))
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pointed(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a")
        now = written(pointed(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def loaded(kind: str, path: str, make):
    """A tokenizer read once in each Python worker, not once a task."""
    import sys

    kept = sys.modules.setdefault("_millrace_loaded", type(sys)("_millrace_loaded")).__dict__
    return kept.get((kind, path)) or kept.setdefault((kind, path), make(path))


#: Letters and digits of the plain Latin characters, and those characters: words of them need no Unicode normal form.
LETTERS, DIGITS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
PLAIN = r"[\x21-\x7e\xa1-\u017f]*"


class WordCache:
    """Ids of words as bytes (little-endian, 4 an id), kept for at most `most` words at a time.

    find(list of new words) gives each word's ids. A text costs one lookup a word and one join.
    """

    def __init__(self, find, most: int = 100_000):
        self.find, self.most, self.known = find, most, {}

    def __call__(self, words: list) -> bytes:
        parts = list(map(self.known.get, words))
        if None in parts:
            if len(self.known) > self.most:
                self.known = {}
            new = list({w for w in words if w not in self.known})
            self.known.update(zip(new, self.find(new)))
            parts = map(self.known.__getitem__, words)
        return b"".join(parts)


def word_bpe(path: str):
    """A function from a text to the ids (numpy, uint32) that `tokenizers` gives with word_bpe_49k.json, but faster.

    That file lower-cases, drops white space and marks word ends, and its vocabulary is in the order of its merges, so
    that its merges are those of a rank table: the mark of a word's end becomes the byte 0, and tiktoken merges the
    bytes of each word. Words that hold other than plain Latin characters, or a special token, go through `tokenizers`
    itself; white space always ends a word, so that the ids of a text are those of its words, one after the other.
    """
    def make(path):
        import json
        import re

        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        slow, model = Tokenizer.from_file(path), json.load(open(path))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in model["added_tokens"]}
        end = model["model"]["end_of_word_suffix"]
        ranks = {bytes(byte[c] for c in word.removesuffix(end)) + b"\0" * word.endswith(end): k for word, k in model["model"]["vocab"].items() if word not in special}
        merge = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        plain = re.compile(PLAIN).fullmatch
        cut = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+").findall
        last = np.zeros(max(ranks.values()) + 1, dtype=bool)
        last[[k for word, k in ranks.items() if word.endswith(b"\0")]] = True

        def find(new):
            pieces, counts = [], []
            for w in new:
                if w.isascii() and w.isalpha():
                    pieces.append(w.lower())
                    counts.append(1)
                elif plain(w) and "<|" not in w:
                    pieces += (found := cut(w.lower()))
                    counts.append(len(found))
                else:
                    counts.append(-1)
            ids = bytes(merge("\0".join([*pieces, ""]), set())) if pieces else b""
            ends = [0, *(4 * (np.flatnonzero(last[np.frombuffer(ids, dtype=np.uint32)]) + 1)).tolist()]
            out, at = [], 0
            for w, n in zip(new, counts):
                if n < 0:
                    out.append(np.array(slow.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes())
                else:
                    out.append(ids[ends[at] : ends[at + n]])
                    at += n
            return out

        cache = WordCache(find)
        return lambda text: np.frombuffer(cache(text.replace("\n", " ").split(" ")), dtype="<u4")

    return loaded("word_bpe", path, make)


def byte_bpe(path: str):
    """A function from a text to its ids (numpy, uint32) by tiktoken with a rank file and the usual byte-level pattern."""
    def make(path):
        import base64

        import numpy as np
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        return lambda text: np.frombuffer(encode(text, set()), dtype="<u4")

    return loaded("byte_bpe", path, make)
