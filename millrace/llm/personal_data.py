"""Personal data in texts: fixed patterns, and what a linear-chain conditional random field over word shapes adds to them.

The field labels words (begin or inside of an email, an ip, a card, a phone; or none). It is trained on a small labelled
table by L-BFGS with forward and backward sums, and decoded by Viterbi in numpy batches. It is there for the forms that
the patterns miss: spelled addresses ("name at host dot org"), local telephone numbers, cards in groups with other
separators, addresses of version 6.

Only words that hold a digit, an @ or two colons, words for @ and dot, and the neighbours of these can carry a label: that is
part of the model, in training too. All other words are none of them, so that decoding whole texts takes the labelled
words' islands alone.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, giving_back, loaded, small_batches

KINDS = ["email", "ip", "card", "phone"]
#: None, then begin and inside of each kind.
STATES = 1 + 2 * len(KINDS)
#: A weight that no path takes.
NEVER = -1e4

#: Words for @ and for a dot, as people write them to hide an address; bare ones, or in brackets.
AT_WORDS, DOT_WORDS = ("at", "(at)", "[at]", "{at}"), ("dot", "(dot)", "[dot]", "{dot}")
#: Words whose identity the field sees beside their shape.
TOLD = {*AT_WORDS, *DOT_WORDS, "tel", "telephone", "phone", "call", "fax", "mobile", "card", "visa", "ip", "host", "server", "mail", "email", "contact", "order", "invoice", "version", "isbn", "page", "on", "for", "no", "id", "ref"}


def luhn(digits: str) -> bool:
    """Whether a number of 12 to 19 digits has the right check digit."""
    if not 12 <= len(digits) <= 19:
        return False
    twice = [2 * int(x) - 9 * (x > "4") for x in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small_part(part: str) -> bool:
    """Whether a number is at most 255, leading zeros aside."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text: str) -> list:
    """What the fixed patterns find, leftmost and non-overlapping for each kind, as (start, number of the kind, end).

    The patterns are written so that a text of any length takes linear time: an address is found from its @ and extended
    to the left; a number can only begin where no digit stands before it.
    """
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, 0, end))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if luhn(only_digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def shape(word: str) -> tuple:
    """What the field sees of a word."""
    low = word.lower()
    bare = low.strip(".,;:!?\"'")
    if low in TOLD or bare in TOLD:
        return ("told:" + (low if low in TOLD else bare),)
    digits = sum("0" <= x <= "9" for x in word)
    if not digits and "@" not in word and word.count(":") < 2:
        return ("word", "word:upper" if word.isupper() else "word:title" if word[:1].isupper() else "word:lower", "word:dotted" if "." in word[1:-1] else "word:even")
    core = word.strip(",;!?\"'").rstrip(".:")
    runs = re.sub(r"[^\W\d_]+", "x", core[:64])
    long_form = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", runs)
    out = [f"form:{long_form}", f"kind:{re.sub('[0-9]+', 'd', runs)}", f"digits:{min(digits, 20)}"]
    if luhn(only_digits(core)) and re.fullmatch(r"[0-9](?:[./_\x20-]?[0-9])+", core):
        out.append("check digit")
    if re.fullmatch(r"\(?\[?[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}\]?\)?", core):
        out.append("colons:" + ("double" if "::" in core else str(core.count(":"))) + ":" + ("six" if re.search("[a-fA-F]", core) or core.count(":") > 3 or "::" in core else "time"))
    if "[.]" in core:
        out.append("bracketed dot")
    out += [f"first:{core[:2]}"] if core[:1] in "0+(" else []
    return (*out, "at" if "@" in word else "no at", "stop" if word[-1:] in ".,;" else "go on")


def marked(words: list) -> tuple[list, list]:
    """Which words can carry a label by themselves, and which make their neighbours do so."""
    spelled = [w.lower().strip(",;") in AT_WORDS or w.lower().strip(",;") in DOT_WORDS for w in words]
    return [s or w.count(":") > 1 or re.search("[0-9@]", w) is not None for w, s in zip(words, spelled)], spelled


def near(marks, spelled):
    """Marked words, and those next to a spelled one."""
    out = marks | spelled
    out[1:] |= spelled[:-1]
    out[:-1] |= spelled[1:]
    return out


def transitions_allowed():
    """0 or NEVER for each pair of states: an inside state follows its own kind alone."""
    import numpy as np

    out = np.zeros((STATES, STATES))
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = NEVER
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return out


class Encoded:
    """Labelled texts as arrays: the class of each word (words of one shape are one class) and its state, padded."""

    def __init__(self, rows: list):
        import numpy as np

        self.shapes: dict = {("edge",): 0}
        texts = []
        for text, spans in rows:
            found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
            words = [m[0] for m in found]
            states = [0] * len(words)
            for kind, start, stop in spans:
                inside = [i for i, m in enumerate(found) if m.start() < stop and m.end() > start]
                for i in inside:
                    states[i] = 2 * KINDS.index(kind) + (1 if i == inside[0] else 2)
            texts.append((words, states))
        n, t = len(texts), max(len(w) for w, _ in texts)
        self.classes, self.states, self.free, self.length = np.zeros((n, t + 2), dtype=np.int64), np.zeros((n, t), dtype=np.int64), np.zeros((n, t), dtype=bool), np.zeros(n, dtype=np.int64)
        for i, (words, states) in enumerate(texts):
            self.length[i] = len(words)
            self.classes[i, 1 : len(words) + 1] = [self.shapes.setdefault(shape(w), len(self.shapes)) for w in words]
            marks, spelled = map(np.array, marked(words))
            self.free[i, : len(words)] = near(marks.astype(bool), spelled.astype(bool))
            self.states[i, : len(words)] = np.where(self.free[i, : len(words)], states, 0)
        self.names: dict = {}
        for s in self.shapes:
            for f in s:
                self.names.setdefault(f, len(self.names))
        self.has = np.zeros((len(self.shapes), len(self.names)))
        for s, k in self.shapes.items():
            self.has[k, [self.names[f] for f in s]] = 1


def log_sum(x, axis):
    import numpy as np

    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def loss_and_gradient(weights, data: Encoded, ridge: float):
    """Minus the log-likelihood of the labelled states with a ridge, and its gradient, by forward and backward sums.

    weights: for a word's own features, those of the word before and those of the word after (features x states each), then
    the transitions.
    """
    import numpy as np

    n, t = data.states.shape
    width = len(data.names) * STATES
    parts = [weights[k * width : (k + 1) * width].reshape(-1, STATES) for k in range(3)]
    step = weights[3 * width :].reshape(STATES, STATES) + transitions_allowed()
    before, own, after = data.classes[:, :-2], data.classes[:, 1:-1], data.classes[:, 2:]
    score = (data.has @ parts[0])[own] + (data.has @ parts[1])[before] + (data.has @ parts[2])[after]
    score = np.where(data.free[:, :, None] | (np.arange(STATES) == 0), score, NEVER)
    real = np.arange(t) < data.length[:, None]
    score = np.where(real[:, :, None], score, np.where(np.arange(STATES) == 0, 0, NEVER))  # padding is none, at no cost
    moves = np.repeat(step[None], t, axis=0)
    forward, backward = np.zeros((n, t, STATES)), np.zeros((n, t, STATES))
    first = score[:, 0] + step[0]  # as if a word of no kind stood before
    forward[:, 0] = first
    for i in range(1, t):
        forward[:, i] = log_sum(forward[:, i - 1][:, :, None] + np.where(real[:, i][:, None, None], moves[i], 0), 1) + score[:, i]
    for i in range(t - 2, -1, -1):
        backward[:, i] = log_sum(np.where(real[:, i + 1][:, None, None], moves[i], 0) + (score[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
    total = log_sum(forward[:, -1], 1)
    rows, cols = np.nonzero(real)
    y = data.states
    gold = score[rows, cols, y[rows, cols]].sum() + step[0, y[:, 0]].sum()
    pairs = np.nonzero(real[:, 1:])
    gold += step[y[pairs[0], pairs[1]], y[pairs[0], pairs[1] + 1]].sum()
    p = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
    p[rows, cols, y[rows, cols]] -= 1
    p *= data.free[:, :, None]
    out = []
    for where in (own, before, after):
        by = np.zeros((len(data.has), STATES))
        np.add.at(by, where[rows, cols], p[rows, cols])
        out.append(data.has.T @ by)
    moved = np.zeros((STATES, STATES))
    np.add.at(moved[0], np.arange(STATES), np.exp(first + backward[:, 0] - total[:, None]).sum(axis=0))
    np.add.at(moved, (np.zeros(n, dtype=int), y[:, 0]), -1)
    for i in range(t - 1):
        on = real[:, i + 1]
        moved += np.exp(forward[on, i][:, :, None] + step + (score[on, i + 1] + backward[on, i + 1])[:, None, :] - total[on][:, None, None]).sum(axis=0)
        np.add.at(moved, (y[on, i], y[on, i + 1]), -1)
    gradient = np.concatenate([*(g.ravel() for g in out), moved.ravel()]) + ridge * weights
    return total.sum() - gold + ridge * weights @ weights / 2, gradient


def minimized(f, x, rounds: int = 100, kept: int = 8):
    """L-BFGS with halved steps."""
    import numpy as np

    value, slope = f(x)
    past: list = []
    for _ in range(rounds):
        q, used = slope.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, np.abs(q).sum())
        for (s, y), a in zip(past, reversed(used)):
            q += s * (a - y @ q / (s @ y))
        size = 1.0
        while size > 1e-6:
            new = x - size * q
            value2, slope2 = f(new)
            if value2 <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        if (new - x) @ (slope2 - slope) > 1e-10:
            past = [*past[1 - kept :], (new - x, slope2 - slope)]
        done = value - value2 < 1e-4 * max(1.0, abs(value2))
        x, value, slope = new, value2, slope2
        if done:
            break
    return x


def fit_field(labelled: DataFrame, most_rows: int = 2000, ridge: float = 0.5) -> dict | None:
    """Trains a field on labelled texts: text, spans (array of kind, start, stop; code points). None without any text of words.

    The table is meant to be small; of a larger one the `most_rows` rows of the least hashes are taken, whose texts are
    fitted in one task. Rows without words are left out; null spans count as none.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), "spans").where(r"text rlike '[^\\x20\\x09-\\x0D]'")
    few = rows.orderBy(F.xxhash64("text"), "text").limit(most_rows)

    def fit(pdf):
        import numpy as np
        import pandas as pd

        data = Encoded([(r.text, [] if r.spans is None else [(s["kind"], s["start"], s["stop"]) for s in r.spans]) for r in pdf.sort_values("text", kind="stable").itertuples()])
        w = minimized(lambda x: loss_and_gradient(x, data, ridge), np.zeros(3 * len(data.names) * STATES + STATES * STATES))
        give_back()
        return pd.DataFrame({"names": [list(data.names)], "weights": [w]})

    found = few.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "names array<string>, weights array<double>").collect()
    return {"names": list(found[0]["names"]), "weights": list(found[0]["weights"])} if found else None


class Field:
    """A trained field ready to decode: scores by class of word, grown as new shapes are met."""

    def __init__(self, model: dict):
        import numpy as np

        self.names = {f: k for k, f in enumerate(model["names"])}
        w, width = np.array(model["weights"]), len(self.names) * STATES
        self.parts = [w[k * width : (k + 1) * width].reshape(-1, STATES) for k in range(3)]
        self.step = w[3 * width :].reshape(STATES, STATES) + transitions_allowed()
        self.known: dict = {}
        self.shapes: dict = {}
        self.scores: list = []
        self.table = None
        self.edge = self.class_of(("edge",))

    def class_of(self, features: tuple) -> int:
        k = self.shapes.get(features)
        if k is None:
            import numpy as np

            on = [self.names[f] for f in features if f in self.names]
            k = self.shapes[features] = len(self.scores)
            self.scores.append(np.stack([p[on].sum(axis=0) for p in self.parts]))
        return k

    def classes(self, words: list) -> list:
        if len(self.known) > 200_000:
            self.known = {}
        out = []
        for w in words:
            k = self.known.get(w)
            if k is None:
                k = self.known[w] = self.class_of(shape(w))
            out.append(k)
        return out

    def best_states(self, before, own, after, begins, lengths):
        """Viterbi over all islands at once: words' classes one after the other, the islands' first words and lengths."""
        import numpy as np

        if self.table is None or len(self.table) < len(self.scores):
            self.table = np.array(self.scores)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # islands of more than i words
        score = lambda at: self.table[own[at], 0] + self.table[before[at], 1] + self.table[after[at], 2]
        now = score(begins) + self.step[0]
        backs, last = [], np.zeros((len(begins), STATES))
        last[:] = now
        for i in range(1, int(lengths[0])):
            n = active[i]
            paths = last[:n, :, None] + self.step
            back = paths.argmax(axis=1)
            backs.append(back.astype(np.int8))
            last[:n] = np.take_along_axis(paths, back[:, None, :], axis=1)[:, 0] + score(begins[:n] + i)
        state = (last + self.step[:, 0]).argmax(axis=1)  # a word of no kind follows
        out = np.zeros(len(own), dtype=np.int8)
        for i in range(int(lengths[0]) - 1, -1, -1):
            n = active[i]
            out[begins[:n] + i] = state[:n]
            if i:
                state[:n] = backs[i - 1][np.arange(n), state[:n]]
        return out


SPELLED_EMAIL = re.compile(r"[a-z0-9._%+-]+ *[(\[{]? *(?:@|\bat\b) *[)\]}]? *[a-z0-9-]+(?: *[(\[{]? *(?:\.|\bdot\b) *[)\]}]? *[a-z0-9-]+)+", re.I)


def trimmed(kind: int, text: str, start: int, stop: int) -> tuple[int, int] | None:
    """A labelled stretch without the punctuation around it; None if it can't be of its kind."""
    first, last = (("[a-zA-Z0-9]", "[a-zA-Z0-9]"), ("[0-9a-fA-F:]", "[0-9a-fA-F:]"), ("[0-9]", "[0-9]"), ("[0-9(+]", "[0-9]"))[kind]
    inside = [start + i for i, x in enumerate(text[start:stop]) if re.match(first, x)][:1]
    behind = [start + i + 1 for i, x in enumerate(text[start:stop]) if re.match(last, x)][-1:]
    if not inside or not behind or inside[0] >= behind[0] or behind[0] - inside[0] > 320:
        return None
    start, stop = inside[0], behind[0]
    found, digits = re.sub(r"\s", " ", text[start:stop]), only_digits(text[start:stop])
    if kind == 0:
        right = SPELLED_EMAIL.fullmatch(found) is not None
    elif kind == 1:
        import ipaddress

        try:
            right = bool(ipaddress.ip_address(found.replace("[.]", ".")))
        except ValueError:
            right = False
    else:
        right = luhn(digits) if kind == 2 else 7 <= len(digits) <= 15
    return (start, stop) if right else None


def cut_words(texts: list):
    """All texts as one, the places where words begin and end, the number of each word's text, and which words hold a digit, an @ or two colons."""
    import numpy as np

    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (codes == 32) | (codes - np.uint32(9) <= 4)
    change = np.diff(np.r_[True, blank, True].astype(np.int8))
    begin, stop = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, begin, side="right")
    sums = np.cumsum(np.r_[0, (codes - np.uint32(48) <= 9) | (codes == 64)], dtype=np.int64)
    colons = np.cumsum(np.r_[0, codes == 58], dtype=np.int64)
    return joined, codes, begin, stop, of, (sums[stop] > sums[begin]) | (colons[stop] - colons[begin] > 1)


def field_spans(field: Field, texts: list) -> list:
    """What the field finds in each text, as (start, number of the kind, end)."""
    import numpy as np

    out = [[] for _ in texts]
    joined, codes, begin, stop, of, marks = cut_words(texts)
    if not len(begin):
        return out
    size = stop - begin
    may = (size >= 2) & (size <= 7) & np.isin(codes[begin] | np.uint32(32), [ord(x) for x in "ad([{"])  # the bit 32 lowers letters; the brackets keep theirs or are kept
    may |= (size >= 2) & (size <= 7) & np.isin(codes[begin], [ord(x) for x in "([{"])
    spelled = np.zeros(len(begin), dtype=bool)
    for i in np.flatnonzero(may).tolist():
        w = joined[begin[i] : stop[i]].lower().strip(",;")
        spelled[i] = w in AT_WORDS or w in DOT_WORDS
    free = marks | spelled
    same = of[1:] == of[:-1]
    free[1:] |= spelled[:-1] & same
    free[:-1] |= spelled[1:] & same
    some = np.flatnonzero(free)
    if not len(some):
        return out
    around = np.unique(np.clip(np.r_[some - 1, some, some + 1], 0, len(begin) - 1))
    classes = np.full(len(begin) + 2, field.edge)
    classes[around + 1] = field.classes([joined[a:b] for a, b in zip(begin[around].tolist(), stop[around].tolist())])
    before = np.where(np.r_[-1, of[:-1]][some] == of[some], classes[some], field.edge)
    after = np.where(np.r_[of[1:], -1][some] == of[some], classes[some + 2], field.edge)
    opens = np.r_[True, (some[1:] != some[:-1] + 1) | (of[some[1:]] != of[some[:-1]])]
    begins = np.flatnonzero(opens)
    states = field.best_states(before, classes[some + 1], after, begins, np.diff(np.r_[begins, len(some)]))
    base = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    hit = np.flatnonzero(states)
    i = 0
    while i < len(hit):
        a = b = hit[i]
        kind = (states[a] - 1) // 2
        while i + 1 < len(hit) and hit[i + 1] == b + 1 and states[hit[i + 1]] == 2 * kind + 2:
            i += 1
            b = hit[i]
        i += 1
        k = int(of[some[a]])
        text = texts[k]
        span = trimmed(int(kind), text, int(begin[some[a]] - base[k]), int(stop[some[b]] - base[k]))
        if span:
            out[k].append((span[0], int(kind), span[1]))
    return out


def all_spans(field: Field | None, texts: list) -> list:
    """For each text: (start, kind, end, whether a pattern found it); the field adds only what touches no span of the patterns."""
    out = []
    for text, added in zip(texts, field_spans(field, texts) if field else [[] for _ in texts]):
        base = base_spans(text)
        rows = [(*s, True) for s in base] + [(*s, False) for s in added if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        out.append(sorted(rows))
    return out


def personal_data(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Personal data in every whole text (doc_id, text): doc_id, spans (array of kind, start, stop, base).

    Places are code points, stop is exclusive; spans are ordered by start, then by kind (email, ip, card, phone), then by stop. base
    tells what the patterns found; of different kinds these may overlap. The others are the field's, fitted on `labelled` (text,
    spans); an empty table adds none. Null text is empty, repeated rows and rows without doc_id give a row each, other
    columns are ignored, an empty table gives no rows.
    """
    model = fit_field(labelled)
    key = str(hash(tuple(model["weights"]))) if model else ""

    def find(batches):
        import pyarrow as pa

        field = loaded("personal_data", key, lambda _: Field(model)) if model else None
        row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            spans = all_spans(field, [t or "" for t in batch.column(1).to_pylist()])
            named = [[{"kind": KINDS[k], "start": a, "stop": b, "base": base} for a, k, b, base in rows] for rows in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, row)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    kind = "doc_id long, spans array<struct<kind:string,start:long,stop:long,base:boolean>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(find), kind)


def example_rows(n: int = 900, seed: int = 11) -> list:
    """A small labelled table, made by rule: invented prose around personal data in many forms, and around what only looks like it."""
    r = random.Random(seed)
    syllables = "ba ke lo mi nu ra si to va we the an or is du fe gi ho".split()

    def word():
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = r.choice([w, w, w, w.title(), w.upper()])
        return w + r.choice(["", "", "", "", "", ",", ".", "!!", "***"])

    def number(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def card(groups):
        digits = r.choice("3456") + number(sum(groups) - 2)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        cut, at = [], 0
        for g in groups:
            cut.append(digits[at : at + g])
            at += g
        return cut

    def host():
        return [*("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 2))), r.choice(["com", "org", "net", "de", "info"])]

    def email():
        name, parts = "".join(r.choice(syllables) for _ in range(2)) + r.choice(["", f".{number(2)}", f"{r.choice('._-')}{r.choice(syllables)}"]), host()
        form = r.randrange(6)
        if form == 0:
            return f"{name}@{'.'.join(parts)}"
        at, dot = [("(at)", "."), ("[at]", "."), ("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)")][form - 1]
        gap = "" if at[0] in "([" and dot == "." and r.random() < 0.3 else " "
        return f"{name}{gap}{at}{gap}" + ("." if dot == "." else f" {dot} ").join(parts)

    def phone():
        a, b, c = f"{r.randint(200, 989)}", number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b}{c}", f"0{a} {b} {c}", f"00{r.randint(1, 49)} {a} {b}{c}", f"+{r.randint(20, 49)} {a} {b} {c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}"])

    def ip():
        four = [str(r.randint(1, 254)) for _ in range(4)]
        six = [f"{r.randrange(1, 65536):x}" for _ in range(8)]
        return r.choice([".".join(four), "[.]".join(four), ":".join(six), ":".join(six[:2]) + "::" + ":".join(six[5:]), "fe80::" + ":".join(six[4:])])

    def some_card():
        groups = r.choice([[16], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4]])
        return r.choice([" ", "-", ".", "/", "_", "."]).join(card(groups))

    def not_card():
        while True:
            digits = number(16)
            if not luhn(digits):
                return r.choice([digits, ".".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))])

    def decoy():
        return r.choice([
            f"20{number(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{number(2)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{number(4)}", f"{r.randint(10, 23)}:{number(2)}:{number(2)}",
            f"{r.randint(1, 9)},{number(3)}.{number(2)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{number(1)}.", f"#{number(5)}", f"INV-20{number(2)}-{number(5)}", number(r.randint(1, 11)), number(r.randint(12, 18)) if False else number(r.randint(5, 11)),
            not_card(), f"{number(2)}-{number(2)}", f"978-{r.randint(1, 9)}-{number(2)}-{number(6)}-{number(1)}", f"{number(3)} {number(3)}", f"{number(4)} {number(4)}", f"{r.randint(1, 99)}%", f"(19{number(2)})", f"{number(4)}-{number(4)}", f"{number(3)}-{number(2)}",
            f"{r.randrange(1 << 63):x}", "look at the dot", f"at {number(2)} or at {word()}", f"{word()} at {word()} and", f"the {word()} dot", f"@{word()}", f"{word()} at home", f"{number(1)} x {number(2)}", f"{number(4)} {number(4)} {number(4)}", f"{number(1)}:{number(2)}:{number(2)}", f"a::b", f"{number(2)} {number(2)} {number(4)}",
            "| " + " | ".join(number(r.randint(2, 6)) for _ in range(4)) + " |", f"{number(3)}.{number(3)}.{number(3)},00",
        ])

    makers = [email, ip, some_card, phone]
    before = {0: ["mail", "email:", "contact", ""], 1: ["ip", "host", "server", ""], 2: ["card", "visa", "card:", ""], 3: ["tel", "phone:", "call", "fax", ""]}
    rows = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(r.randint(1, 3)):
            for w in [word() for _ in range(r.randint(1, 6))]:
                parts.append(w)
                at += len(w) + 1
            k = r.randrange(9)
            if k < 4:
                lead = r.choice(before[k]) if r.random() < 0.4 else ""
                if lead:
                    parts.append(lead)
                    at += len(lead) + 1
                found = makers[k]()
                spans.append({"kind": KINDS[k], "start": at, "stop": at + len(found)})
                text = found + r.choice(["", "", ",", "."])
            else:
                text = decoy()
            parts.append(text)
            at += len(text) + 1
        parts.append(word())
        rows.append((" ".join(parts), spans))
    return rows


def examples(spark: SparkSession, n: int = 900, seed: int = 11) -> DataFrame:
    """The rows of example_rows as a table: text, spans."""
    return spark.createDataFrame([(t, [(s["kind"], s["start"], s["stop"]) for s in spans]) for t, spans in example_rows(n, seed)], "text string, spans array<struct<kind:string,start:long,stop:long>>")
