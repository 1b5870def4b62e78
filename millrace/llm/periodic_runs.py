"""Maximal repetitions (runs) of words in documents, from Lyndon arrays that Baier's grouping of suffixes yields.

Every run has a Lyndon root that is the longest Lyndon word at its place, under the order of words or under the opposite
one. The first phase of Baier's suffix sorting groups suffixes by just these longest Lyndon words, so that it gives the
array for either order; each candidate root is extended to both sides as far as the text keeps its period, by names of
equal blocks of 1, 2, 4, ... words (exact, no hashes).

A run of at least `least` words lies within words covered by sequences of `least / 2` words that occur again in the same
document. All other words are set aside before the grouping, which changes no result: the sequences are found by hashes,
and equal hashes of unlike words only leave more words in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, small_batches


def lyndon_array(word: list, end: int = -1) -> list:
    """The length of the longest Lyndon word at each place of a list of numbers; `end` marks the ends of texts and is below all of them.

    Suffixes are grouped by their first number. Groups are done from the greatest to the smallest; the group's word is then
    final. Each suffix before one of the group, and nearest to it of those in lower groups, is followed by the group's word
    as many times as it is such a neighbour, and moves to a new group right above its own, higher for more times.
    """
    n = len(word)
    left, right = [-1, *range(n)], [*range(1, n + 1), n + 1]  # a place that isn't done yet on either side; n stands for both outer ends
    left[0] = n
    of, places, size, below, above = [0] * n, [[]], [0], [-1], [-1]
    first = {}
    for i, x in enumerate(word):
        if x != end:
            first.setdefault(x, []).append(i)
    for x in sorted(first):
        g = len(places)
        places.append(first[x])
        size.append(1)
        below.append(g - 1)
        above.append(-1)
        above[g - 1] = g
        for i in first[x]:
            of[i] = g
    g = len(places) - 1
    while g > 0:
        times = {}
        for i in places[g]:
            if of[i] == g:
                before, after = left[i], right[i]
                left[after], right[before] = before, after
                times[before] = times.get(before, 0) + 1
        moved = {}
        for p, k in times.items():
            if p < n and of[p]:
                moved.setdefault((k, of[p]), []).append(p)
        for k, h in sorted(moved, reverse=True):
            new = len(places)
            places.append(moved[k, h])
            size.append(size[h] + k * size[g])
            up = above[h]
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
            for p in moved[k, h]:
                of[p] = new
        g = below[g]
    return [size[g] for g in of]


def block_names(word):
    """Names of the blocks of 1, 2, 4, ... numbers at each place, equal for equal blocks, as far as any block occurs twice."""
    import numpy as np

    names, levels = word.astype(np.int64), []
    while len(names):
        _, names = np.unique(names, return_inverse=True)
        levels.append(names.astype(np.int32))
        step = 1 << (len(levels) - 1)
        if names.max() + 1 == len(names) or len(names) <= step:
            break
        names = names[:-step].astype(np.int64) * len(word) + names[step:]
    return levels


def common_lengths(levels: list, a, b, backward: bool):
    """How many numbers agree from places a and b on, a < b; backward: up to a and b, they included."""
    import numpy as np

    a, b, found = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        x, y = (a - step + 1, b - step + 1) if backward else (a, b)
        fits = (x >= 0) & (y < len(names))
        agree = fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)])
        found += step * agree
        move = (-step if backward else step) * agree
        a += move
        b += move
    return found


def runs_of(word, least: int):
    """Runs of at least `least` numbers and two periods in an array of texts that end in -1 each: start, length, period."""
    import numpy as np

    ends = np.flatnonzero(word < 0)
    unlike = word.astype(np.int64)
    unlike[ends] = word.max() + 1 + np.arange(len(ends))  # no end equals another
    levels = block_names(unlike)
    places = np.flatnonzero(word >= 0)
    top = int(word.max())
    pairs = []
    for values in (word, np.where(word < 0, -1, top - word)):
        size = np.array(lyndon_array(values.tolist()), dtype=np.int64)
        pairs.append(np.c_[places, size[places]])
    at, period = np.concatenate(pairs).T
    more = common_lengths(levels, at, at + period, False)
    less = common_lengths(levels, at - 1, at + period - 1, True)
    start, length = at - less, less + period + more
    found = (less + more >= period) & (length >= least)
    return np.unique(np.c_[start, length, period][found], axis=0)


def recurring(grams, text):
    """Which sequences (numbers) occur twice in their text (numbers)."""
    import numpy as np

    mixed = (grams ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(mixed), dtype=bool)
    bits = np.uint64(64 - 20)
    table = np.zeros(1 << 20, dtype=bool)
    table[twice >> bits] = True
    out = table[mixed >> bits]
    some = np.flatnonzero(out)
    k = np.searchsorted(twice, mixed[some])
    k[k == len(twice)] = 0
    out[some] = twice[k] == mixed[some]
    return out


def stretches(hashes, text, size: int):
    """Stretches of words, as (from, to), of at least 2 * size, covered by sequences of `size` words that occur twice in the stretch.

    hashes: of all words of some texts, one after the other; text: the text of each.
    """
    import numpy as np

    none = np.zeros((0, 2), dtype=np.int64)
    if len(hashes) < 2 * size:
        return none
    grams = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
    grams ^= grams >> np.uint64(31)
    starts, of = np.arange(len(grams)), text
    for _ in range(3):  # stretches only shrink, and each round is right by itself
        inside = starts[of[starts] == of[starts + size - 1]]
        starts = inside[recurring(grams[inside], of[inside])]
        if not len(starts):
            return none
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        same = np.r_[False, covered[1:] & covered[:-1] & (of[1:] == of[:-1])]
        of = np.cumsum(~same)
        begin = np.flatnonzero(covered & ~same)
        cut = np.c_[begin, begin + np.add.reduceat(covered.astype(np.int64), begin)]
        cut = cut[cut[:, 1] - cut[:, 0] >= 2 * size]
        keep = np.zeros(len(hashes) + 1, dtype=np.int64)
        keep[cut[:, 0]] += 1
        keep[cut[:, 1]] -= 1
        starts = starts[np.cumsum(keep[:-1])[starts] > 0]
    return cut


def runs_in_texts(texts: list, least: int):
    """The words of each text, and its runs of at least `least` words as rows of start, length, period, by start and period."""
    import re

    import numpy as np

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begins = np.r_[0, np.cumsum(counts)]
    hashes = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=int(begins[-1])).astype(np.uint64)
    cut = stretches(hashes, np.repeat(np.arange(len(words)), counts), least // 2)
    out = [[] for _ in words]
    if len(cut):
        known: dict = {}
        of = np.searchsorted(begins, cut[:, 0], side="right") - 1
        parts = []
        for (a, b), k in zip(cut.tolist(), of.tolist()):
            own = begins[k]
            parts.append([known.setdefault(w, len(known)) for w in words[k][a - own : b - own]])
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        joined = np.fromiter((x for p in parts for x in [*p, -1]), dtype=np.int64, count=int(sizes.sum()) + len(parts))
        at = np.r_[0, np.cumsum(sizes + 1)]
        found = runs_of(joined, least)
        piece = np.searchsorted(at, found[:, 0], side="right") - 1
        shift = cut[piece, 0] - begins[of[piece]] - at[piece]
        for k, row in zip(of[piece].tolist(), (found + np.c_[shift, np.zeros_like(found[:, 1:])]).tolist()):
            out[k].append(row)
    return words, [sorted(rows, key=lambda r: (r[0], r[2])) for rows in out]


def collapsed(words: list, runs: list) -> str:
    """The words without those that some run repeats: of each run its first period stays, unless another run drops it."""
    import itertools

    import numpy as np

    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs).T
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return " ".join(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """The runs of words in every whole text (doc_id, text): doc_id, n_words, runs, text (the words left, joined by one space).

    Words are sequences of characters other than the blank and \\x09 to \\x0D. runs: array of (start, length, period) by start,
    then period; a run is a stretch of at least max(least, 2 * period) words with that smallest period, which no neighbouring
    word extends. `least` is even. Words of a run after its first period are left out of the text.

    Rows are judged one by one: null text has no word, repeated rows and rows without doc_id give a row each, other columns
    are ignored, an empty table gives no rows. A text is judged whole, however long, in memory that follows its length.
    """
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"

    def find(batches):
        import pyarrow as pa

        row = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            words, runs = runs_in_texts(batch.column(1).to_pylist(), least)
            named = [[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in runs]
            texts = [collapsed(w, r) for w, r in zip(words, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(named, row), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "text"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(find), kind)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a stretch of the text made periodic where a hash of doc_id says so: cases for periodic_runs.

    h is the CRC of the decimal doc_id and g a tenth of it. If h divides by 10, the n words from a = g % n on become repeats of
    the first p of them, p = 1 + (n - a) / (3 + g % 8), and words are joined by one space. Other rows stay as they are, and so do
    those without doc_id or without words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), (3 + g % 8).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
    return rows.withColumn("text", F.when(h % 10 == 0, F.when(n > 0, made).otherwise(F.col("text"))).otherwise(F.col("text")))
