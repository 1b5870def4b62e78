"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text falls into words: no piece goes on over a blank. Forward weights are computed once for each
distinct word; the backward draws of all words of a batch are made together, one table lookup a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import loaded, small_batches

BLANK = "▁"


class Lattice:
    """Pieces of a model, and for distinct words the tables of backward draws.

    A piece of rank r (0 for the first merge) weighs (r + 2) ** -theta, as if its frequency followed Zipf's law; a piece
    of one character that has no rank weighs as the last. Characters without a piece become their UTF-8 bytes. Draws have
    24 bits, and so do the tables' probabilities, so that sums with node numbers stay exact and don't depend on them.
    """

    #: After so many places the forward weights of a word are scaled anew, so that none leaves a double's range.
    RESCALE = 32

    def __init__(self, model: str, theta: float, most: int = 4_000_000):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        self.byte = {int(sp.id_to_piece(k)[3:5], 16): k for k in range(size) if sp.is_byte(k)}
        self.pieces = {sp.id_to_piece(k): k for k in range(size) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
        self.weight = {p: (2 + max(0.0, min(-sp.get_score(k), size))) ** -theta for p, k in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        self.bytes_of = [p.replace(BLANK, " ").encode() for p in map(sp.id_to_piece, range(size))]
        for b, k in self.byte.items():
            self.bytes_of[k] = bytes([b])
        # A trie of the pieces: edges (state, letter) in order, the state each leads to, and the piece that ends there.
        self.letters = np.array(sorted({ord(c) for p in self.pieces for c in p}), dtype=np.uint32)
        letter = {chr(c): k + 1 for k, c in enumerate(self.letters.tolist())}
        states, edges, ends = {"": 0}, [], {}
        for piece, k in self.pieces.items():
            for n in range(1, len(piece) + 1):
                if piece[:n] not in states:
                    states[piece[:n]] = len(states)
                    edges.append((states[piece[: n - 1]] * (len(letter) + 1) + letter[piece[n - 1]], states[piece[:n]]))
            ends[states[piece]] = k
        edges.sort()
        self.edge, self.to = (np.array(x, dtype=np.int64) for x in zip(*edges))
        self.ends = np.full(len(states), -1, dtype=np.int64)
        self.ends[list(ends)] = list(ends.values())
        # A factor for each letter leaves the odds within a word as they are and keeps long products in range.
        self.mass = np.zeros(size)
        for piece, k in self.pieces.items():
            self.mass[k] = self.weight[piece] * 50.0 ** len(piece)
        self.rare = (2.0 + size) ** -theta * 50.0
        self.most = most
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.last, self.nodes, self.used = {}, 0, 0
        self.first = np.zeros(1 << 20, dtype=np.int32)
        self.cum, self.prev, self.piece = np.zeros(1 << 21), np.zeros(1 << 21, np.int32), np.zeros(1 << 21, np.uint32)

    def add(self, words: list) -> None:
        """Tables of new words, all at once: for each place, the pieces that may end there, longest first."""
        import numpy as np

        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stops = np.cumsum(sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        total = len(codes)
        begin = np.repeat(stops - sizes, sizes)
        place = np.arange(total)
        stop = np.repeat(stops, sizes)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[at] == codes, at + 1, 0)
        # From every place along the trie, all places in step.
        start, state, found = place, np.zeros(total, dtype=np.int64), []
        for n in range(self.longest):
            inside = start + n < stop[start]
            start, state = start[inside], state[inside]
            key = state * (len(self.letters) + 1) + letter[start + n]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[k] == key
            start, state = start[on], self.to[k[on]]
            piece = self.ends[state]
            is_piece = piece >= 0
            found.append((start[is_piece], n, piece[is_piece]))
            if n == 0:
                alone = np.ones(total, dtype=bool)
                alone[start[is_piece]] = False
                odd = place[alone]
                single = np.array([self.byte[b] for b in range(128)], dtype=np.int64)
                ids = np.where(codes[odd] == 0, (1 << 31) + ord(BLANK), np.where(codes[odd] < 128, single[np.minimum(codes[odd], 127)], (1 << 31) + codes[odd].astype(np.int64)))
                found.append((odd, 0, ids))
        # By the place where they end, the longest first; a place has at most one piece of a length.
        counts = np.zeros(total, dtype=np.int64)
        for s, n, _ in found:
            counts[s + n] += 1
        heads = np.cumsum(counts) - counts
        start, piece, filled = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64), heads.copy()
        for s, n, k in reversed(found):
            slot = filled[s + n]
            start[slot], piece[slot] = s, k
            filled[s + n] += 1
        end = np.repeat(place, counts)
        known = piece < len(self.mass)
        mass = np.where(known, self.mass[np.where(known, piece, 0)], 0)
        mass[mass == 0] = self.rare  # bytes
        # Forward weights, by the place in the word: each place needs those before it only, back to the longest piece. What
        # ends at a place is weighed by its odds there, so that a word's weights may be scaled as it goes on.
        opens = start == begin[start]
        most = int(sizes.max(initial=0))
        step = (end - begin[end]).astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
        by_step = place[np.argsort(place - begin, kind="stable")] if most >= self.RESCALE else place
        alive = np.searchsorted(np.sort(sizes), np.arange(most + 1), side="right")  # words that end by a step
        past = np.cumsum(len(sizes) - alive)
        order = np.argsort(step, kind="stable")
        bounds = np.searchsorted(step[order], np.arange(int(step.max(initial=0)) + 2))
        forward, part = np.zeros(total), np.empty(len(start))
        step_now = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            o = order[a:b]
            part[o] = np.where(opens[o], 1.0, forward[start[o] - 1]) * mass[o]
            np.add.at(forward, end[o], part[o])
            part[o] /= forward[end[o]]
            step_now += 1
            if step_now % self.RESCALE == 0:
                now = by_step[past[step_now - 1] - (len(sizes) - alive[step_now - 1]) : past[step_now - 1]]
                forward[now[:, None] - np.arange(min(self.longest, step_now))] /= forward[now][:, None]
        cum = part.copy()
        for r in range(1, int(counts.max())):
            more = heads[counts > r] + r
            cum[more] += cum[more - 1]
        cum = np.floor(cum * 2.0**24 + 0.5) / 2.0**24
        cum[heads + counts - 1] = 1.0
        before = np.where(opens, -1, start - 1 + self.nodes)
        n = len(start)
        while self.used + n > len(self.cum):
            self.cum, self.prev, self.piece = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cum, self.prev, self.piece))
        while self.nodes + total > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.cum[self.used : self.used + n], self.prev[self.used : self.used + n], self.piece[self.used : self.used + n] = cum, before, piece
        self.first[self.nodes : self.nodes + total] = heads + self.used
        self.last.update(zip(words, (self.nodes + stops - 1).tolist()))
        self.nodes, self.used = self.nodes + total, self.used + n

    def words_of(self, text: str) -> list:
        """The text's words with their blanks shown; line ends stand alone, as do characters that look like a shown blank."""
        import re

        shown = []
        for k, part in enumerate(text.split(BLANK)):
            if k:
                shown.append("\0")  # a literal shown blank: as bytes
            line = (BLANK if not k else "") + part.replace(" ", BLANK)
            shown += re.findall("\n|" + BLANK + "*[^" + BLANK + "\n]+|" + BLANK + "+", line)
        return shown

    def sample(self, keys: list, texts: list, seed: int) -> list:
        """Ids of each text, drawn by its key alone: the same for a key and text wherever and beside whatever they run."""
        import numpy as np

        words = [self.words_of(t) if t else [] for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for ws in words for w in ws]
        if self.used > self.most:
            self.clear()
        new = list({w for w in flat if w not in self.last})
        if new:
            self.add(new)
        node = np.fromiter(map(self.last.__getitem__, flat), dtype=np.int64, count=len(flat))
        row = np.repeat(np.array([(k * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) & (2**64 - 1) for k in keys], dtype=np.uint64), counts)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        state = mixed(row ^ mixed(place + np.uint64(1)))
        active, steps, lengths = np.arange(len(flat)), [], np.zeros(len(flat), dtype=np.int64)
        while len(active):
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            u = ((state >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24
            at = self.first[node]
            past = np.flatnonzero(u > self.cum[at])
            while len(past):
                at[past] += 1
                past = past[u[past] > self.cum[at[past]]]
            steps.append((active, self.piece[at]))
            lengths[active] += 1
            node = self.prev[at]
            on = node >= 0
            active, node, state = active[on], node[on], state[on]
        ends = np.cumsum(lengths)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        for t, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - t] = piece
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [self.plain(out[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def plain(self, ids):
        """Characters without a piece replaced by the ids of their bytes."""
        import numpy as np

        if not len(ids) or not (odd := ids >= 1 << 31).any():
            return ids
        out = []
        for k, is_odd in zip(ids.tolist(), odd.tolist()):
            if is_odd:
                c = k - (1 << 31)
                out += [self.byte[b] for b in chr(c).encode()]
            else:
                out.append(k)
        return np.array(out, dtype=np.uint32)

    def decode(self, ids) -> str:
        """The text of ids: the blank before the first word goes; bytes become their characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode()


def mixed(x):
    """A well-mixed 64-bit number for each one."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lattice(model: str, theta: float) -> Lattice:
    return loaded(f"lattice {theta}", model, lambda path: Lattice(path, theta))


def _key(value) -> int:
    return 0 if value is None else int(value)


def sample_pieces(docs: DataFrame, model: str, seed: int = 1, theta: float = 1.0) -> DataFrame:
    """Sampled segmentations of documents (doc_id, text): doc_id, ids (array of int).

    A segmentation is drawn with probability in proportion to the product of its pieces' weights, by numbers that come from
    the seed, the doc_id, the word's place and the draw's number alone; so a row's ids never depend on how the table is
    cut. Null and empty texts have no ids; a null doc_id counts as 0; equal rows get equal ids; an empty table gives no rows.
    """
    def sample(batches):
        import pyarrow as pa

        lat = lattice(model, theta)
        for batch in batches:
            found = lat.sample([_key(k) for k in batch.column(0).to_pylist()], batch.column(1).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("int32") for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession, 200)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sample, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of id lists (doc_id, ids): doc_id, text. No ids give an empty text, null ids a null one."""
    def decode(batches):
        import numpy as np
        import pyarrow as pa

        lat = lattice(model, 1.0)
        for batch in batches:
            texts = [None if x is None else lat.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(encoded.sparkSession, 200)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")


def sampled_digests(docs: DataFrame, model: str, seed: int = 1, theta: float = 1.0) -> DataFrame:
    """sample_pieces and decode_pieces in one pass: doc_id, n_ids, ids_crc32 (unsigned 32-bit ids), decoded_crc32, lossless."""
    def digest(batches):
        import zlib

        import pyarrow as pa

        lat = lattice(model, theta)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = lat.sample([_key(k) for k in batch.column(0).to_pylist()], texts, seed)
            decoded = [lat.decode(x) for x in found]
            rows = zip(*((len(x), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(d.encode()), d == (t or "")) for x, d, t in zip(found, decoded, texts)))
            columns = list(rows) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "lossless"])

    small_batches(docs.sparkSession, 200)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean")
