"""Personal data, word runs and the prefix trie against brute force, on awkward rows, on held-out labels, on nothing."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import periodic_runs as runs
from millrace.llm import personal_data as private
from millrace.llm import prefix_trie as trie
from millrace.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# runs


def brute_runs(words, least):
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=int)
    out = []
    for q in range(1, len(x) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (x[q:] == x[:-q]).astype(int), 0]))
        for s, t in zip(edges[::2].tolist(), edges[1::2].tolist()):
            part = x[s : t + q]
            if len(part) >= max(least, 2 * q) and not any((part[z:] == part[:-z]).all() for z in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_repeats(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def brute_lyndon(w):
    return [max(k for k in range(1, len(w) - i + 1) if all(w[i : i + k] < w[i + j : i + k] for j in range(1, k))) for i in range(len(w))]


def test_grouping_gives_lyndon_arrays():
    r = random.Random(1)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(1, 14))]
        v = [r.randrange(3) for _ in range(r.randrange(1, 9))]
        assert runs.lyndon_array([*w, -1, *v, -1]) == [*brute_lyndon(w), 0, *brute_lyndon(v), 0]


@pytest.mark.parametrize("least", [4, 6, 12])
def test_runs_in_texts(least):
    r = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(r.randrange(1, 4)):
            n, k = r.randrange(0, 70), r.choice([1, 2, 3, 20])
            words = [f"w{r.randrange(k)}" for _ in range(n)]
            if n and r.random() < 0.6:
                a = r.randrange(n)
                p = r.randrange(1, n - a + 1)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(" ".join(words))
        found = runs.runs_in_texts(texts, least)[1]
        assert [[tuple(r) for r in rows] for rows in found] == [brute_runs(t.split(), least) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a " * 11), (6, "a " * 12), (7, "a b c d e f " * 2), (7, "a b c d e f " * 2), (None, "x y " * 30), (8, fibonacci(600)),
    (9, "the end " + "a b " * 9 + "then a a a a a a a a a a a a b " * 2), (10, "z" * 50000), (11, "line one two three four five six\n" * 40), (12, "    a b " * 12), (-30, "q r s " * 50), (1 << 62, "tail " * 5000),
    *((100 + k, " ".join(f"w{(k * j * j) % 37}" for j in range(90))) for k in range(60)),
]


def test_periodic_runs(spark):
    docs = spark.createDataFrame([(d, t, 5, "x", [1]) for d, t in AWKWARD], "doc_id long, text string, N_WORDS int, start string, runs array<int>")
    assert any(brute_repeats(d, t) != WORD.findall(t or "") for d, t in AWKWARD)
    got = runs.periodic_runs(runs.with_repeats(docs)).collect()
    want = [(d, len(w), brute_runs(w, 12), brute_collapsed(w, brute_runs(w, 12))) for d, t in AWKWARD for w in [brute_repeats(d, t)]]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got), key=str) == sorted(want, key=str)
    assert runs.periodic_runs(runs.with_repeats(docs.where("false"))).count() == 0


def test_op12_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = brute_repeats(d.doc_id, d.text)
        if len(words) > 1200:
            continue
        found = brute_runs(words, 12)
        some += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert got[d.doc_id] == (len(found), *shown, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(words, found))))
    assert some > 10


# conversations


def brute_trie(rows, change=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if change else 0
        made[c] = own.get(c - c % 100, [])[:h] + v[h:]
    nodes, children = defaultdict(list), defaultdict(set)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].add(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        ends = sorted(c for c in nodes[k] if len(made[c]) == len(k))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children[k]), leaves[k], saved[k], digest))
    return sorted(out, key=str)


def conversation_rows(seed, n, hot):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 6, 7])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "hello there", f"own {r.randrange(5)}", "ünï𝄞" * 3])))
    rows += [(n + k, t, "user", f"turn {t}") for k in range(hot) for t in range(4)]  # copies of one conversation
    rows += [(n + hot, t % 90, "user", f"long {t}") for t in range(300)] + [(n + hot + 1, t % 90, "user", f"long {t}") for t in range(280)]  # long ones that begin alike, with ties
    return [*rows, (None, 1, "user", "lost"), *rows[:2]]


@pytest.mark.parametrize("seed,few", [(1, 4096), (2, 3)])
def test_prefix_trie(spark, monkeypatch, seed, few):
    monkeypatch.setattr(trie, "FEW_ENDS", few)
    rows = conversation_rows(seed, 230, 40)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, c string").repartition(7)
    for change in (True, False):
        head = (lambda c: (c - c % 100, trie.F.crc32(c.cast("string")) % 6)) if change else None
        assert sorted(map(tuple, trie.prefix_trie(table, head).collect()), key=str) == brute_trie(rows, change)


def test_prefix_trie_with_a_full_sketch(spark, monkeypatch):
    """A sketch that proves nothing changes no node."""
    monkeypatch.setattr(trie, "MOST_BITS", 2)
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    rows = conversation_rows(3, 120, 9)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(table).collect()), key=str) == brute_trie(rows, False)


def test_prefix_trie_of_nothing_and_of_one(spark):
    table = spark.createDataFrame([(7, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(table.where("false")).count() == 0
    assert sorted(map(tuple, trie.prefix_trie(table).collect()), key=str) == brute_trie([(7, 1, "user", "hi")], False)


# personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        total += sum(divmod(int(x) * (1 + i % 2), 10))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: plain_luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(zip((EMAIL, IP, CARD, PHONE), tests)) for m in p.finditer(text) if good(m))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "255", "256", "10.0.0.1", "x@y.z", "4111 1111 1111 1111", "4111111111111111", "0", "00000000255", "(", ")", " ", " ", "+1 (555) 010-9999", "é", "%", "_", "9", "42"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert private.base_spans(text) == brute_base(text), text
    for text in ("x" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 50_000, "+" + "1 " * 100_000, "a@" * 100_000):
        private.base_spans(text)  # ends soon


def test_field_gradient():
    data = private.Encoded([(t, [(s["kind"], s["start"], s["stop"]) for s in spans]) for t, spans in private.example_rows(12, 3)])
    r = np.random.default_rng(1)
    w = r.normal(0, 0.1, 3 * len(data.names) * private.STATES + private.STATES**2)
    _, slope = private.loss_and_gradient(w, data, 0.5)
    for k in [*r.integers(0, len(w), 25).tolist(), *range(len(w) - 30, len(w))]:
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs((private.loss_and_gradient(w + step, data, 0.5)[0] - private.loss_and_gradient(w - step, data, 0.5)[0]) / 2e-5 - slope[k]) < 1e-4 * max(1, abs(slope[k]))


@pytest.fixture(scope="module")
def model(spark):
    return private.fit_field(private.examples(spark))


def test_viterbi_finds_the_best_path(model):
    """Against all paths of short islands."""
    import itertools

    field, r = private.Field(model), random.Random(9)
    pool = ["(043)", "555-1234", "at", "mail", "dot", "org", "4412.4730.1489.4482", "12:30:15", "fe80::1", "x@y.org", "7", "+1"]
    islands = [[r.choice(pool) for _ in range(r.randrange(1, 5))] for _ in range(40)]
    own = np.array([k for w in islands for k in field.classes(w)])
    lengths = np.array([len(w) for w in islands])
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    first, last = np.isin(np.arange(len(own)), begins), np.isin(np.arange(len(own)), begins + lengths - 1)
    before, after = np.where(first, field.edge, np.r_[0, own[:-1]]), np.where(last, field.edge, np.r_[own[1:], 0])
    got = field.best_states(before, own, after, begins, lengths)
    table = np.array(field.scores)
    for b, n in zip(begins, lengths):
        score = table[own[b : b + n], 0] + table[before[b : b + n], 1] + table[after[b : b + n], 2]
        value = lambda p: field.step[0, p[0]] + sum(score[i, x] for i, x in enumerate(p)) + sum(field.step[x, y] for x, y in zip(p, p[1:])) + field.step[p[-1], 0]
        assert value(tuple(got[b : b + n])) == pytest.approx(max(map(value, itertools.product(range(private.STATES), repeat=int(n)))))


def test_field_on_held_out_labels(model):
    rows = private.example_rows(500, 99)
    found = private.all_spans(private.Field(model), [t for t, _ in rows])
    want = {(i, s["kind"], s["start"], s["stop"]) for i, (_, spans) in enumerate(rows) for s in spans}
    got = {(i, private.KINDS[k], a, b) for i, spans in enumerate(found) for a, k, b, _ in spans}
    added = {(i, private.KINDS[k], a, b) for i, spans in enumerate(found) for a, k, b, base in spans if not base}
    base = got - added
    assert len(got & want) >= 0.93 * len(want) and len(added & want) >= 0.95 * len(added)
    assert len(base & want) < 0.7 * len(want), "the field must add to the patterns"


def test_personal_data(spark, model):
    rows = [(1, "write to jo.lee@mail.example.com, or 10.0.0.300 or 10.0.0.3"), (2, None), (3, ""), (None, "+1 (043) 555-0123 4111 1111 1111 1111"), (4, "é𝄞 reach me: anna [at] stone [dot] org now"), (9, "z " * 30000 + "tel (212) 555-0188"), (5, "😀 +49 30 1234567 "), (6, "look at the dot on 2024-01-30")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, KIND int")
    got = private.personal_data(docs, private.examples(spark)).collect()
    for d, t in rows:
        mine = [r.spans for r in got if r.doc_id == d]
        assert any([(s.start, private.KINDS.index(s.kind), s.stop) for s in spans if s.base] == brute_base(t or "") for spans in mine)
    assert len(got) == len(rows) and all(sorted((s.start, private.KINDS.index(s.kind), s.stop) for s in r.spans) == [(s.start, private.KINDS.index(s.kind), s.stop) for s in r.spans] for r in got)
    texts = {(r.doc_id, s.kind): t[s.start : s.stop] for r in got for d, t in rows if d == r.doc_id for s in r.spans if not s.base}
    assert texts[4, "email"] == "anna [at] stone [dot] org" and any(s.kind == "phone" and not s.base for r in got if r.doc_id == 9 for s in r.spans)
    assert [list(r.spans) for r in got if r.doc_id in (2, 3, 6)] == [[], [], []]
    none = private.personal_data(docs, private.examples(spark).where("false")).collect()
    assert all(s.base for r in none for s in r.spans) and private.personal_data(docs.where("false"), private.examples(spark)).count() == 0


def test_op11_query(spark):
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = brute_base(d.text or ""), got[d.doc_id]
        shown = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(","))


# matrices


def test_written_matrices(spark, tmp_path):
    """Rows of id matrices come back from their files as they were, all of one size."""
    import public_tokenizers

    from millrace.llm import token_binary

    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "tail " * 300)], "doc_id long, text string")
    rows = token_binary.token_matrices(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=64)
    token_binary.write_matrices(rows, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and {len(r.ids) for r in back.collect()} == {128}
