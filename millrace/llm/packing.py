"""Packing documents into token sequences by linear grouping and configurations, the small ones by best fit.

Lengths above a quarter of a sequence are large. Per cell of a few thousand pieces, the large lengths are sorted and cut
into groups of equal cardinality; every length counts as its group's longest. That leaves few sizes, so that the fillings
of a sequence (configurations) can be searched for the longest size left; two plans of them are compared, and the better
one's emptiest sequences are grouped anew. Actual documents then take the places of their group, and the small ones go,
longest first, where they leave the least room.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_bpe, give_back, materialize, small_batches, word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, encoder: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most `capacity` ids; an end id follows each document, null text is empty.

    Only longer documents are cut, into full pieces and a last one that may be shorter, so that nothing is lost.
    """
    make = {"word_bpe": word_bpe, "byte_bpe": byte_bpe}[encoder]

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = make(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(sizes, left, a: int, capacity: int) -> list[int]:
    """Indexes of the one or two further sizes (ascending `sizes`, at most a's) that fill a sequence begun with size a most."""
    import numpy as np

    room = capacity - sizes[a]
    live = np.flatnonzero(left[: a + 1] > 0)
    live = live[sizes[live] <= room]
    if not len(live):
        return []
    of = sizes[live]
    rest = np.minimum(np.searchsorted(of, room - of, side="right") - 1, np.arange(len(live)))  # the third is the second at most
    alone = (rest == np.arange(len(live))) & (left[live] < 2)
    rest = np.where(alone, rest - 1, rest)
    best = int(np.argmax(of + np.where(rest >= 0, of[rest], 0)))
    return [int(live[best])] + ([int(live[rest[best]])] if rest[best] >= 0 else [])


def largest(sizes, left, a: int, capacity: int) -> list[int]:
    """Indexes of further sizes for a sequence begun with size a: always the largest that fits."""
    import numpy as np

    out, room, used = [], capacity - sizes[a], {}
    while True:
        live = np.flatnonzero(left[: np.searchsorted(sizes, room, side="right")] > 0)
        while len(live) and left[live[-1]] <= used.get(int(live[-1]), 0):
            live = live[:-1]
        if not len(live):
            return out
        k = int(live[-1])
        used[k] = used.get(k, 0) + 1
        out.append(k)
        room -= sizes[k]


def configurations(sizes, counts, capacity: int, choose) -> list:
    """Fillings of a sequence by few sizes (ascending): pairs of (size indexes, how often), until no count is left.

    For the longest size left, the filling that `choose` finds is taken as often as the counts allow.
    """
    left, plan = counts.copy(), []
    for a in range(len(sizes) - 1, -1, -1):
        while left[a]:
            left[a] -= 1
            chosen = (a, *choose(sizes, left, a, capacity))
            left[a] += 1
            times = min(int(left[k]) // chosen.count(k) for k in set(chosen))
            for k in chosen:
                left[k] -= times
            plan.append((chosen, times))
    return plan


def grouped(lengths, capacity: int, width: int, choose) -> tuple:
    """One plan over groups of `width` large lengths: sequence numbers and how many. Groups that count alike are one size of the search."""
    import numpy as np

    large = np.flatnonzero(lengths > capacity // 4)
    large = large[np.argsort(lengths[large], kind="stable")]
    if not len(large):
        return substituted(lengths, large, large, large, [], capacity)
    stops = np.arange(len(large), 0, -width)[::-1]  # the first group may be smaller, so that the longest are grouped fully
    counted = np.repeat(lengths[large[stops - 1]], np.diff(np.r_[0, stops]))  # each length counts as its group's longest
    starts = np.flatnonzero(np.diff(counted, prepend=-1))
    plan = configurations(counted[starts], np.diff(np.r_[starts, len(large)]), capacity, choose)
    return substituted(lengths, large, starts, np.r_[starts[1:], len(large)], plan, capacity)


def pack(lengths, capacity: int, groups: int = 4096, rounds: int = 4):
    """Sequence number and offset of each length (numpy arrays), all within one task's cell.

    Large lengths are put in groups of one or more, at most `groups` of them, and the plans of the fullest fillings and of the
    largest that fit are carried through to the small lengths. The better one is revised: its emptiest sequences are taken
    apart and grouped anew, in groups of one and two, as long as that saves some.
    """
    import numpy as np

    width = max(1, -(-int((lengths > capacity // 4).sum()) // groups))
    bin_of, used = min((grouped(lengths, capacity, width, f) for f in (fullest, largest)), key=lambda found: found[1])
    for part in range(rounds):
        fill = np.bincount(bin_of, weights=lengths, minlength=used)
        if used <= -(-int(lengths.sum()) // capacity):
            break
        loose = np.argsort(fill, kind="stable")[: max(2, used * (part + 1) // (rounds + 1))]
        again = np.flatnonzero(np.isin(bin_of, loose))
        found, n = min((grouped(lengths[again], capacity, w, f) for w in (1, 2) for f in (fullest, largest)), key=lambda x: x[1])
        if n < len(loose):
            kept = np.cumsum(~np.isin(np.arange(used), loose)) - 1
            bin_of, used = kept[bin_of], used - len(loose) + n
            bin_of[again] = used - n + found
    by_bin = np.argsort(bin_of, kind="stable")
    ends = np.cumsum(lengths[by_bin])
    begins = ends - lengths[by_bin]
    first = np.searchsorted(bin_of[by_bin], bin_of[by_bin], side="left")
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[by_bin] = begins - begins[first]
    return bin_of, offset


def substituted(lengths, large, starts, stops, plan, capacity: int):
    """Puts the actual lengths in the places of their groups, then the small ones by best fit: sequence numbers, how many."""
    import numpy as np

    bin_of, members, last = np.full(len(lengths), -1, dtype=np.int64), [list(large[a:b]) for a, b in zip(starts.tolist(), stops.tolist())], 0
    for chosen, times in plan:
        for _ in range(times):
            for k in chosen:
                bin_of[members[k].pop()] = last
            last += 1
    used = np.bincount(bin_of[large], weights=lengths[large], minlength=last).astype(np.int64)
    small = np.flatnonzero(bin_of < 0)
    # Best fit of the small ones: sequences by the room they have left, and which rooms there are, as bits of a number.
    by_room: dict[int, list[int]] = {}
    for b, u in enumerate(used.tolist()):
        by_room.setdefault(capacity - u, []).append(b)
    rooms = sum(1 << r for r in by_room)
    for k in small[np.argsort(-lengths[small], kind="stable")].tolist():
        size = int(lengths[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms ^= 1 << room
        else:
            room, b, last = capacity, last, last + 1
        bin_of[k] = b
        by_room.setdefault(room - size, []).append(b)
        rooms |= 1 << (room - size)
    return bin_of, last


def _pack_cells(pieces: DataFrame, cell, capacity: int, series: int) -> DataFrame:
    def one(key, cell):
        import numpy as np
        import pyarrow as pa

        lengths = cell["length"].to_numpy()
        bins, offset = pack(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)[bins].astype(np.int64)
        return pa.table([*(cell[n] for n in names), pa.array((series << 56) + (key[0].as_py() << 24) + bins), pa.array(offset), pa.array(fill)], names=[*names, "sequence_id", "offset", "sequence_fill"])

    names = [c.split()[0] for c in PIECES.split(", ")]
    return pieces.select(*names, cell.alias("cell")).groupBy("cell").applyInArrow(one, f"{PIECES}, sequence_id long, offset long, sequence_fill long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, encoder: str = "word_bpe", cell_rows: int = 8192) -> DataFrame:
    """Packs documents (doc_id, text) into as few sequences of at most `capacity` ids as the grouping scheme finds.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (places in a sequence are gapless from
    0), sequence_fill. Only lengths are packed: pieces are dealt evenly to cells of about `cell_rows`, whatever their
    keys, so that no task grows with the input. What the cells leave in sequences less than 97 % full is taken out
    once more and packed together. Null texts are empty documents of the end id alone; null and repeated doc_ids keep
    their rows; an empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, encoder, tokenizer, end_id, capacity)).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id()))
    cells = max(1, -(-pieces.count() // cell_rows))
    packed = _pack_cells(pieces, F.pmod("dealt", F.lit(cells)), capacity, 0)
    if cells == 1:
        return packed
    packed = materialize(packed)
    loose = packed.where(F.col("sequence_fill") < int(capacity * 0.97))
    again = max(1, -(-loose.count() // cell_rows))
    repacked = _pack_cells(loose, F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(again)), capacity, 1)
    return packed.where(F.col("sequence_fill") >= int(capacity * 0.97)).unionByName(repacked)
