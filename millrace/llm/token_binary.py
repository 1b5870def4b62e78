"""Token-id matrices: documents as ids, packed best-fit-decreasing with a segment tree over the free capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_bpe, materialize, small_batches


class Capacities:
    """How many open sequences have each free capacity; a segment tree finds the least capacity that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, wanted: int) -> int | None:
        """The smallest capacity >= wanted that some sequence has."""
        k = wanted + self.size
        if self.count[k]:
            return wanted
        while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a right neighbour holds one
            k >>= 1
        if k <= 1:
            return None
        k += 1
        while k < self.size:  # down, to its leftmost
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; every length is between 1 and capacity."""
    tree, open_, out = Capacities(capacity), {}, []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = tree.least(lengths[k])
        if room is None:
            room, b = capacity, len(out)
            out.append([])
        else:
            b = open_[room].pop()
            tree.change(room, -1)
        out[b].append(k)
        open_.setdefault(room - lengths[k], []).append(b)
        tree.change(room - lengths[k], 1)
    return out


def token_matrices(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 50256, cell_bytes: int = 8 << 20) -> DataFrame:
    """Packs documents (doc_id, text) as rows of id matrices, one row a sequence of at most `capacity` ids.

    Returns sequence_id, n_tokens, ids (binary: little-endian uint16 where every id fits, else uint32, filled up with the
    end id to `capacity`), segment_ends (cumulative segment lengths from 0), position_resets (places where positions start
    anew at 0, those of a later piece too), doc_ids, pieces and starts (ids of its document before it) of the segments.
    Ids are by tiktoken, with the end id after each document. Longer documents are cut into full pieces and a rest, so
    that the pieces of a document give back all its ids. Pieces are written once and dealt row by row, whatever they hold, to
    cells of about `cell_bytes` of text, packed one a task. Null text is an empty document; null and repeated doc_ids keep their rows; an empty table gives none.
    """
    wide = end_id > 0xFFFF
    kind = "<u4" if wide else "<u2"
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    cells = max(1, -(-total // cell_bytes))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encode = byte_bpe(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype(kind)
                out += [(doc, k, s, ids[s : s + capacity].tobytes()) for k, s in enumerate(range(0, len(ids), capacity))]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "ids"])

    def assemble(key, cell):
        import numpy as np
        import pyarrow as pa

        doc_ids, numbers, starts, ids = (cell[c].to_pylist() for c in ("doc_id", "piece", "start", "ids"))
        out, width = [], 4 if wide else 2
        fill = np.full(1, end_id, dtype=kind).tobytes()
        for b, members in enumerate(best_fit_decreasing([len(x) // width for x in ids], capacity)):
            ends = np.cumsum([0, *(len(ids[k]) // width for k in members)]).tolist()
            row = b"".join(ids[k] for k in members)
            out.append(((key[0].as_py() << 32) + b, ends[-1], row + fill * (capacity - ends[-1]), ends, ends[:-1], *([c[k] for k in members] for c in (doc_ids, numbers, starts))))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["sequence_id", "n_tokens", "ids", "segment_ends", "position_resets", "doc_ids", "pieces", "starts"])

    small_batches(docs.sparkSession)
    pieces = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, ids binary"))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(assemble, "sequence_id long, n_tokens int, ids binary, segment_ends array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>")


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Writes the rows of token_matrices as Parquet; each ids value is one row of the id matrix, of the same size for all."""
    matrices.write.mode("errorifexists").option("compression", "zstd").parquet(path)
