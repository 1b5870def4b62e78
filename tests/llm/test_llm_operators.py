"""Each training-data operator against brute force, on tables with every awkward row, and on an empty one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

import public_tokenizers
from pyspark.sql import functions as F
from millrace.llm import common, embeddings, packing, sentence_pieces, sharding, simhash, substring, token_binary, topk, toxicity, url_filters

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
rnd = random.Random(5)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "river", "stone", "walks", "Über", "naïve", "table,", "seven", "green.", f"w{r.randrange(500)}"]) for _ in range(n))


BASE = prose(120, 1)
ROWS = [
    (1, BASE), (2, BASE), (3, prose(90, 2)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, prose(60, 3) + "\n" + prose(70, 2) + " tail"),
    (9, prose(9000, 4)), (10, "x" * 30000), (11, "word " * 400), (12, "word " * 300), (13, BASE.replace("river", "creek", 1)), (3, prose(90, 2)), (None, BASE), (14, "中文 ﬁ İΣ <|endoftext|> \u2581 a\u0301\x1c" + " z" * 40),
]


def frame(spark, rows=ROWS):
    """Documents with columns that clash with the operators' own names."""
    data = [(d, t, "en", 7, "s", 1) for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, N_WORDS int, shard string, h int")


def empty(spark):
    return frame(spark, [])


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def ids_of(text):
    from tokenizers import Tokenizer

    t = common.loaded("plain", WORD_BPE, Tokenizer.from_file)
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_bpe_is_the_tokenizer():
    ours, r = common.word_bpe(WORD_BPE), random.Random(1)
    parts = [" ", "  ", "\n", "a", "B", "é", "Σ", "İ", "ß", "1", "½", "'s", "'ll", "<|endoftext|>", "\u0301", "\x1c", "\xa0", "\t", "中", "!?", "the", "ÿ", "\x00", "\u2581"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert list(ours(text)) == ids_of(text), repr(text)


def test_packing(spark, docs):
    found = packing.best_fit_packing(docs, WORD_BPE, capacity=256, cell_rows=20).collect()
    want = sorted((d is None, d or 0, k, s, zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for d, t in ROWS for ids in [[*ids_of(t), 1]] for k, s in enumerate(range(0, len(ids), 256)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.ids_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= -(-sum(r.length for r in found) // 256) + 3
    assert packing.best_fit_packing(empty(spark), WORD_BPE).count() == 0


def test_pack_never_loses_to_best_fit_decreasing():
    g = np.random.default_rng(3)
    cells = [g.integers(1, 4097, 3000), np.minimum(4096, g.lognormal(6.5, 1, 3000).astype(int) + 1), np.full(999, 1365), np.full(7, 4096), np.zeros(0, int)]
    cells += [g.integers(1300, 2801, 8192), g.integers(1025, 4097, 8192), g.integers(1025, 1700, 3000), g.integers(900, 2100, 3000)]
    for lengths in cells:
        bins, offset = packing.pack(lengths, 4096)
        assert (np.bincount(bins, weights=lengths) <= 4096).all() if len(lengths) else len(bins) == 0
        assert len(set(bins)) <= len(token_binary.best_fit_decreasing(lengths.tolist(), 4096))


#: A doc_id that a double can't hold, beside a null one.
HUGE = [(2**60 + 1, "huge id"), (None, "no id"), (2**60 + 2, None), (-(2**62) - 1, "low id"), (2**60 + 1, "huge id")]


def test_huge_ids_survive_beside_null_ones(spark):
    docs = frame(spark, HUGE)
    want = sorted((d for d, _ in HUGE), key=str)
    assert sorted((r.doc_id for r in packing.best_fit_packing(docs, WORD_BPE).collect()), key=str) == want
    assert sorted((d for r in token_binary.token_matrices(docs, BYTE_BPE).collect() for d in r.doc_ids), key=str) == want
    assert sorted((r.doc_id for r in sharding.histogram_shards(docs).collect()), key=str) == want
    found = sorted(((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()), key=str)
    assert found == sorted(((d, d) for d, _ in HUGE), key=str)


def test_topk(spark):
    g = np.random.default_rng(1)
    x = [(i, [float(v) for v in g.normal(size=6) / 3]) for i in range(400)]
    x += [(400 + i, x[3][1]) for i in range(40)] + [(500, None), (501, [float("nan")] * 6), (502, [None, 1.0]), (503, [float("inf")] * 6), (504, [0.0] * 6), (505, [0.5, 0.25]), (506, [])]
    table = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    v = topk.scaled(table)
    ints = {r.id: r.v for r in v.collect()}
    assert not {500, 501, 502, 503} & set(ints) and {504, 505, 506} <= set(ints)
    for block in (1024, 7):
        found = {}
        for r in topk.voronoi_topk(v, F.col("id") % 50 == 0, pivots=8, query_block=block, data_block=100).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in [i for i in ints if i % 50 == 0]:
            best = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)[:5]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.voronoi_topk(v.where("id < 0"), F.lit(True)).count() == 0 and topk.voronoi_topk(v, F.lit(False)).count() == 0
    assert topk.voronoi_topk(v.where("id in (0, 1)"), F.col("id") == 0).count() == 1


def test_topk_of_repeated_null_and_huge_ids(spark):
    big = 2**60 + 1
    rows = [(0, [3, 1]), (0, [3, 1]), (0, [1, 1]), (None, [9, 9]), (None, [3, 1]), (big, [2, 2]), (big + 1, [2, 2]), (-1, [2, 2])]
    table = spark.createDataFrame(rows, "id long, v array<long>")
    found = topk.voronoi_topk(table, F.col("id") % 50 == 0, pivots=3).collect()
    order = lambda c: (-c[1], c[0] is None, c[0] or 0)
    want = []
    for n, (i, v) in enumerate(rows):
        if i == 0:
            want += [(0, k + 1, *c) for k, c in enumerate(sorted(((j, v[0] * w[0] + v[1] * w[1]) for m, (j, w) in enumerate(rows) if m != n), key=order)[:5])]
    assert sorted(map(str, want)) == sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in found)
    assert any(r.vec_id in (big, big + 1) for r in found) and any(r.vec_id is None for r in found)


def test_topk_sends_less_with_more_pivots(spark):
    g, rows = np.random.default_rng(4), []
    centres = g.normal(size=(40, 8)) * 1000
    for i in range(2000):
        rows.append((i, [int(x) for x in (centres[i % 40] + g.normal(size=8) * 3)]))
    table = spark.createDataFrame(rows, "id long, v array<long>").cache()
    shares = [topk.sent_share(table, F.col("id") % 50 == 0, pivots=p) for p in (1, 24, None, 160)]  # None: as registered
    assert shares[0] == 1 and shares[0] > shares[1] > shares[2] > shares[3] and shares[2] < 0.1


def test_url_filters(spark):
    html = '<a href="https://good.org/x">g</a><A HREF=//bad.org>b</A><a href="/here">h</a>'
    pages = [(1, "https://Good.org/a", '<a href="//a.good.org/x?y">g</a><a href="/here">h</a>'), (2, "http://bad.org/es/1", '<a href="http://worse.org/">w</a>'), (3, "http://worse.org/q?x#y", '<a href="http://bad.org/">w</a>'), (4, "no scheme", None), (5, None, html), (6, "http://a.good.org", ""), (7, "x://GOOD.org/ok/p", None), (7, "x://GOOD.org/ok/p", None)]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, trust string")
    rules = [("allow", "good.org", "/ok/"), ("block", "bad.org", "/es/"), ("block", "org", "/ok/")]
    found = {r.page_id: r for r in url_filters.filter_urls(df, rules).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("good.org", "/a", None, "allow")
    assert (found[2].rule, found[2].verdict, found[3].verdict, found[3].path) == ("bad.org/es/", "block", "block", "/q")
    assert (found[4].host, found[4].verdict, found[5].host, found[6].path, found[7].rule) == ("", "allow", "", "", "good.org/ok/")
    shuffled = url_filters.filter_urls(df, rules, most_broadcast=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, url_filters.filter_urls(df, rules).collect()))
    assert url_filters.filter_urls(df, rules).count() == 8 and url_filters.filter_urls(df.where("page_id < 0"), rules).count() == 0


def test_rank_is_the_power_method(spark):
    edges = [("a", "b", 1.0), ("b", "c", 0.5), ("b", "a", 0.5), ("c", "a", 1.0)]
    e, s = spark.createDataFrame(edges, "src string, dst string, share double"), spark.createDataFrame([("a", 1.0)], "host string, seed double")
    m = np.zeros((3, 3))
    for a, b, w in edges:
        m["abc".index(b), "abc".index(a)] = w
    r = seed = np.array([1.0, 0, 0])
    for _ in range(7):
        r = 0.85 * m @ r + 0.15 * seed
    assert {x.host: x["rank"] for x in url_filters.personalised_rank(e, s, 7).collect()} == pytest.approx(dict(zip("abc", r)))


def test_rank_with_dead_ends_is_the_power_method(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("c", "a", 1.0)]  # b has no links: its mass goes back to the seed
    e, s = spark.createDataFrame(edges, "src string, dst string, share double"), spark.createDataFrame([("a", 1.0)], "host string, seed double")
    m = np.zeros((3, 3))
    for a, b, w in edges:
        m["abc".index(b), "abc".index(a)] = w
    r = seed = np.array([1.0, 0, 0])
    for _ in range(300):
        r = 0.85 * (m @ r + r[1] * seed) + 0.15 * seed
    found = {x.host: x["rank"] for x in url_filters.personalised_rank(e, s, 30).collect()}
    assert found == pytest.approx(dict(zip("abc", r)), abs=0.01) and sum(found.values()) == pytest.approx(1)


def toxic_rows(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.choice(["clean", "clean", "clean", "toxic", "junk"])
        text = prose(r.randrange(10, 80), seed * 10_000 + i)
        if kind == "toxic":
            text += r.choice([" vequ", " moron", " scumb"]) + r.choice(["", "a", "ent", "i"]) + " " + prose(5, i)
        if kind == "junk":
            text = "zzz qqq " * r.randrange(3, 20)
        out.append((i, text, 0 if kind == "junk" else 1, int(kind == "toxic")))
    return out


def test_toxicity_on_held_out_rows(spark):
    train, test = toxic_rows(500, 1), toxic_rows(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in train] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, toxicity.label_categories(labels), ["low_quality", "toxic"])
    assert [c[0] for c in chain] == ["low_quality", "toxic"] and len(chain[1][2]) == len(chain[1][1]) + 2  # the first one's probability and the constant
    held = spark.createDataFrame([(i, t) for i, t, _, _ in test] + [(9999, None), (9998, "")], "doc_id long, text string")
    p = {r.doc_id: r for r in toxicity.score_chain(held, chain).collect()}
    right = sum((p[i].p_toxic > 0.42) == bool(x) for i, _, _, x in test)
    assert right >= 0.98 * len(test) and p[9999].p_toxic == p[9998].p_toxic < 0.42
    assert sum((p[i].p_low_quality > 0.5) == (q == 0) for i, _, q, _ in test) >= 0.98 * len(test)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge_toxicity(docs, labels).count() == len(ROWS)
    assert toxicity.judge_toxicity(docs, labels.where("doc_id < 0")).where("not toxic").count() == len(ROWS)
    assert toxicity.judge_toxicity(empty(spark), labels).count() == 0


def test_without_toxic_judges_each_row(spark):
    train, test = toxic_rows(500, 1), toxic_rows(300, 2)
    rows = [(i, t) for i, t, _, _ in train] + [(None if k % 3 == 0 else 500, t) for k, (_, t, _, _) in enumerate(test)] + [(None, None), (501, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in train] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    verdicts = {(r.doc_id, r.text) for r in kept.collect()}
    held = [(None if k % 3 == 0 else 500, t, x) for k, (_, t, _, x) in enumerate(test)]
    assert sum(((d, t) in verdicts) != bool(x) for d, t, x in held) >= 0.98 * len(held)
    assert (None, None) in verdicts and (501, "") in verdicts
    # At the threshold in use judge_toxicity says the same of every row.
    judged = toxicity.judge_toxicity(docs, labels)
    assert judged.where("not toxic").count() == kept.count() and judged.count() == len(rows)
    assert toxicity.without_toxic(empty(spark), labels).count() == 0 and toxicity.without_toxic(docs, labels.where("doc_id < -1")).count() == len(rows)


def brute_removed(rows, size):
    first = {}
    for d, t in rows:
        if d is not None:
            w = words(t)
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if d is not None and first[tuple(w[k : k + size])] < d:
                gone.update(range(k, k + size))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, phrase, most", [(50, 25, 64 << 20), (20, 10, 0)])
def test_substring(spark, docs, window, phrase, most):
    r = random.Random(9)
    pool = [prose(r.randrange(15, 80), 700 + k) for k in range(12)]
    rows = ROWS + [(100 + i, " ".join(x for _ in range(4) for x in (prose(r.randrange(0, 30), 900 + 7 * i), r.choice(pool)))) for i in range(40)]
    found = substring.remove_repeats(frame(spark, rows), window, phrase, most)
    assert found.columns == ["doc_id", "text", "lang", "shard", "h", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()), key=str) == brute_removed(rows, window)


def test_substring_of_nothing(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) > len(s))


def test_simhash(spark, docs):
    found = simhash.simhash_components(docs).collect()
    prints = [(d, fingerprint(t)) for d, t in ROWS]
    group = {f: f for _, f in prints}
    for _ in prints:
        for _, a in prints:
            for _, b in prints:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    want = sorted(((d, f, min(e for e, g in prints if e is not None and group[g] == group[f])) for d, f in prints), key=str)
    assert sorted(((r.doc_id, r.f % 2**64, r.component_id) for r in found), key=str) == want
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_hamming_links_are_all_of_them(spark):
    r, near = random.Random(2), []
    for _ in range(60):
        f = r.getrandbits(64)
        near += [f, f ^ 1 << r.randrange(64), f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), f ^ 7 << r.randrange(60)]
    near = sorted({simhash.signed(f) for f in near})
    got = {(x.a, x.b) for x in simhash.hamming_links(spark.createDataFrame([(f,) for f in near], "f long")).collect()}
    assert got == {(a, b) for a in near for b in near if a < b and ((a ^ b) % 2**64).bit_count() <= 2}


def test_similar_groups(spark):
    rows, r = [], random.Random(4)
    for k in range(60):
        w = prose(200, 4000 + k).split()
        rows.append((3 * k, " ".join(w)))
        for j, changes in ((1, 2), (2, 60)):
            v = list(w)
            for p in r.sample(range(200), changes):
                v[p] = f"new{p}"
            rows.append((3 * k + j, " ".join(v)))
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows + [(999, None), (998, ""), (None, "x")])).collect()}
    assert all(found[3 * k] == found[3 * k + 1] == 3 * k for k in range(60)) and all(found[3 * k + 2] == 3 * k + 2 for k in range(60))
    assert found[999] == found[998] == 998 and found[None] is None
    assert simhash.similar_groups(empty(spark)).count() == 0


def shingles5(text):
    w = text.encode().lower().split()  # A-Z alone
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_groups_finds_all_pairs_at_the_threshold(spark):
    rows, r = [], random.Random(6)
    for k in range(150):
        w = [f"u{r.randrange(10**6)}" for _ in range(400)]
        v = list(w)
        for p in r.sample(range(10, 390), r.choice((8, 9, 10))):
            v[p] = f"new{p}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    alike = [len(a & b) / len(a | b) for a, b in ((shingles5(rows[2 * k][1]), shingles5(rows[2 * k + 1][1])) for k in range(150))]
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert sum(0.8 <= s <= 0.85 for s in alike) > 50 and any(s < 0.8 for s in alike)
    assert all((found[2 * k + 1] == 2 * k) == (s >= 0.8) for k, s in enumerate(alike))


def test_similar_groups_tells_repeats_from_likeness(spark):
    a, b = ("word " * n + " ".join(f"{c}{k}" for k in range(200)) for n, c in ((400, "a"), (300, "b")))
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_similar_groups_ignores_how_often_a_line_repeats(spark):
    text = prose(1000, 77)
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, [(1, text), (2, text + "\nall rights kept by the owner" * 300)])).collect()}
    assert found == {1: 1, 2: 1}


def brute_groups(rows, similarity=0.8):
    """The component of each row, by the index of its first row in the order of (no doc_id, doc_id)."""
    sets = [shingles5(t or "") if (t or "").split() else set() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    root = {i: n for n, i in enumerate(order)}
    changed = True
    while changed:
        changed = False
        for i in root:
            for j in root:
                if root[i] < root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])):
                    root[j], changed = root[i], True
    return {i: order[n] for i, n in root.items()}


AWKWARD = [
    *ROWS, (None, None), (None, "alone without an id"), (None, "alone without an id"), (3, prose(80, 555)), (20, prose(80, 555) + " end"), (20, prose(80, 555) + " end"), (21, "a b c d"), (22, "a b c d"), (23, "a b c"),
    (24, BASE.upper()), (25, prose(9000, 4) + " more"), (2**60 + 1, prose(30, 9)), (-5, prose(30, 9) + " x"),
]


def test_without_similar_keeps_the_first_row_of_each_group(spark):
    root = brute_groups(AWKWARD)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    kept = simhash.without_similar(frame(spark, AWKWARD)).collect()
    assert frame(spark, AWKWARD).columns == simhash.without_similar(frame(spark, AWKWARD)).columns
    assert len(kept) == len(groups)
    for members in groups.values():
        ids = [AWKWARD[i][0] for i in members]
        least = min((d for d in ids if d is not None), default=None)
        # One row, of the smallest doc_id.
        assert sum((r.doc_id, r.text) in {AWKWARD[i] for i in members if AWKWARD[i][0] == least} for r in kept) == 1
    found = sorted(((r.doc_id, r.component_id) for r in simhash.similar_groups(frame(spark, AWKWARD)).collect()), key=str)
    assert found == sorted(((AWKWARD[i][0], AWKWARD[r][0]) for i, r in root.items()), key=str)
    assert simhash.without_similar(empty(spark)).count() == 0


def test_similar_groups_at_exactly_the_threshold(spark):
    """Pairs of sets of 20 to 1000 shingles each that share just enough, and pairs that share one shingle less."""
    rows, r = [], random.Random(8)
    for k, size in enumerate([20, 60, 300, 1000] * 20):
        same = -(-8 * 2 * size // 18)  # J >= 0.8: same >= 2 size * 0.8 / 1.8
        w = [f"u{r.randrange(10**9)}" for _ in range(size + 4)]
        fewer = size - same + k // 4 % 2  # shingles that the copy changes, in one run at its end
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: len(w) - fewer] + [f"new{k}x{p}" for p in range(fewer)]))]
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows)).collect()}
    for k in range(80):
        a, b = shingles5(rows[2 * k][1]), shingles5(rows[2 * k + 1][1])
        assert (found[2 * k + 1] == 2 * k) == (len(a & b) / len(a | b) >= 0.8)
        assert found[2 * k] == 2 * k
    assert sum(found[2 * k + 1] == 2 * k for k in range(80)) == 40


def test_similar_groups_of_a_hot_group(spark):
    """A third of all rows are near copies of one text, each with words of its own; the rest share one long passage."""
    r, passage = random.Random(3), prose(60, 66)
    hot = [f"h{k}" for k in range(300)]
    rows = []
    for i in range(150):
        w = list(hot)
        for p in r.sample(range(300), 3):
            w[p] = f"own{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + " ".join(f"r{r.randrange(10**9)}" for _ in range(40))) for i in range(300)]
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows), 5).collect()}
    assert all(found[i] == 0 for i in range(150)) and all(found[1000 + i] == 1000 + i for i in range(300))


def test_sharding(spark, docs):
    big = frame(spark, ROWS + [(100 + i, "hot copy of a text " * 20) for i in range(300)])
    for task_rows in (1_000_000, 20):
        found = sharding.histogram_shards(big, 8, 0.001, task_rows).collect()
        rows = ROWS + [(100 + i, "hot copy of a text " * 20) for i in range(300)]
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
        for s in range(8):
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
        total, sizes = sum(r.size for r in found), [sum(r.size for r in found if r.shard == s) for s in range(8)]
        assert {r.law for r in found} == {"bytes"} and max(sizes) <= total / 8 + 2 * max(r.size for r in found)
    assert sharding.histogram_shards(empty(spark)).count() == 0


def test_shards_are_those_of_a_sort(spark):
    """Against splitters and slots by a plain sort of all rows; half of the rows are equal, without doc_id."""
    rows = [(i, f"text {i} " + "x" * (i % 37)) for i in range(600)] + [(None, "the same row")] * 600
    df = frame(spark, rows).select("doc_id", "text").repartition(3).cache()
    found = sharding.histogram_shards(df, 7, 0.0001, 100).withColumn("h", F.lit(0)).collect()
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    crc = {zlib.crc32(t.encode()): t for _, t in rows}
    placed = sorted((hashes[crc[r.text_crc32]], -1 if r.doc_id is None else r.doc_id, r.shard, r.slot, r.size) for r in found)
    want = sorted((hashes[t], -1 if d is None else d, len(t.encode()) + 16) for d, t in rows)
    assert [(h, d, size) for h, d, _, _, size in placed] == want
    shards = [p[2] for p in placed]
    assert shards == sorted(shards) and sorted((p[2], p[3]) for p in placed) == [(p[2], p[3]) for p in placed]
    total, biggest = sum(w[2] for w in want), max(w[2] for w in want)
    for k in range(7):
        assert sorted(p[3] for p in placed if p[2] == k) == list(range(shards.count(k)))
        assert abs(sum(p[4] for p in placed if p[2] < k) - total * k / 7) <= biggest


def test_sharding_is_even_where_rows_are_small(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(5000)]
    sizes = {r.shard: r.b for r in sharding.histogram_shards(frame(spark, rows)).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()}
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 60


def test_sampled_pieces(spark, docs):
    found = sentence_pieces.sample_pieces(docs, PIECES)
    again = sentence_pieces.sample_pieces(docs.repartition(3), PIECES)
    key = lambda r: (str(r.doc_id), r.ids)
    assert sorted(map(key, found.collect())) == sorted(map(key, again.collect()))
    decoded = sentence_pieces.decode_pieces(found, PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(d), t or "") for d, t in ROWS)
    assert sentence_pieces.sampled_digests(docs, PIECES).where("lossless").count() == len(ROWS)
    assert sentence_pieces.sample_pieces(docs, PIECES, seed=2).exceptAll(found).count() > 5
    assert sentence_pieces.sample_pieces(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("size", [31, 32, 33, 64, 255, 256, 257, 5000])
def test_tables_of_words_of_any_length(size):
    """The odds of every place of a long word, against the forward sums in whole numbers' logarithms; letters without a piece too."""
    lat, r = sentence_pieces.Lattice(PIECES, 1.0), random.Random(size)
    for letters in ("etaoinshrdlu", "中文字符没有空格", "\u0378\u0379"):
        word = "▁" + "".join(r.choice(letters) for _ in range(size - 1))
        lat.clear()
        lat.add(["▁then", word, "▁a"])
        logs = [0.0]
        node = lat.last[word]
        for end in range(1, size + 1):
            options = []
            for n in range(1, min(end, lat.longest) + 1):
                piece = word[end - n : end]
                if piece in lat.pieces or n == 1:
                    options.append((n, logs[end - n] + np.log(lat.weight[piece] if piece in lat.pieces else (2.0 + len(lat.mass)) ** -1.0)))
            top = max(w for _, w in options)
            logs.append(top + np.log(sum(np.exp(w - top) for _, w in options)))
            if end in (1, 2, size // 2, size - 1, size):
                at, total = lat.first[node - size + end], 0.0
                for n, w in sorted(options, reverse=True):
                    total += np.exp(w - logs[end])
                    assert abs(lat.cum[at] - total) < 1e-6
                    assert lat.prev[at] == (-1 if n == end else node - size + end - n)
                    at += 1


def test_samples_follow_the_lattice():
    lat = sentence_pieces.Lattice(PIECES, 1.0)
    word = "▁then"

    def all_of(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in lat.pieces:
                for tail, w in all_of(rest[n:]):
                    yield (lat.pieces[rest[:n]], *tail), w * lat.weight[rest[:n]]

    weights = dict(all_of(word))
    drawn = [tuple(x) for x in lat.sample(list(range(40_000)), ["then"] * 40_000, 1)]
    for path, w in weights.items():
        p = w / sum(weights.values())
        assert abs(drawn.count(path) / 40_000 - p) < 5 * (p / 40_000) ** 0.5 + 1e-4


def test_embedding_links(spark):
    g, rows = np.random.default_rng(7), []
    for c in range(150):
        centre = g.normal(size=16)
        rows += [centre + g.normal(size=16) * s for s in (0, 0.05, 0.05, 0.3)]
    data = [(i, [float(v) for v in x], i % 3 if i % 50 else None) for i, x in enumerate(rows)]
    data += [(1000 + i, data[4][1], data[4][2]) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0], 1), (None, data[1][1], 1)]
    table = spark.createDataFrame([(*d, 0) for d in data], "vec_id long, embedding array<float>, label int, n_links int")
    read = [(r.vec_id, np.array(r.embedding, dtype=float), r.label) for r in table.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and r.label is not None and np.isfinite(r.embedding).all() and any(r.embedding)]
    for block in (1024, 16):
        found = {r.vec_id: r for r in embeddings.embedding_links(table, block_rows=block).collect()}
        truth = {i: sum(l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 for j, y, m in read if j != i) for i, x, l in read}
        assert len(found) == len(data) and all(found[i].n_links <= n for i, n in truth.items())
        assert sum(found[i].n_links for i in truth) >= 0.95 * sum(truth.values()) > 100
        assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (2000, 2001, 2002, 2003))
        assert all(found[1000 + i].component_id == found[4].component_id for i in range(30))
        assert all(r.kept == (r.vec_id == r.component_id) for r in found.values() if r.vec_id is not None)
    assert embeddings.embedding_links(table.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("n, crowd", [(2000, 0), (2000, 1), (12000, 1)])
def test_embedding_recall_at_64_dimensions(spark, n, crowd):
    """Pairs from 0.98 up to 0.995, alone or beside a crowd of near copies that is a third of all rows."""
    g = np.random.default_rng(n)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(g.normal(size=(n // 3, 64)))
    w = g.normal(size=x.shape)
    w = unit(w - (w * x).sum(axis=1, keepdims=True) * x)
    angle = np.arccos(g.uniform(0.9805, 0.995, len(x)))[:, None]
    crowded = unit(unit(g.normal(size=(1, 64))) + 0.1 * unit(g.normal(size=(n // 3, 64)))) if crowd else unit(g.normal(size=(n // 3, 64)))
    rows = np.r_[x, x * np.cos(angle) + w * np.sin(angle), crowded]
    table = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    cosine = unit(rows) @ unit(rows).T
    true = (cosine >= 0.98).sum(axis=1) - 1
    found = {r.vec_id: r for r in embeddings.embedding_links(table).collect()}
    links = np.array([found[i].n_links for i in range(len(rows))])
    assert (links <= (cosine >= 0.98 - 1e-12).sum(axis=1) - 1).all() and links.sum() >= 0.97 * true.sum()
    assert links[: len(x)].sum() >= 0.97 * true[: len(x)].sum()
    if crowd:
        first = 2 * len(x)
        assert sum(found[i].component_id == first for i in range(first, len(rows))) >= 0.99 * len(crowded)


def test_token_matrices(spark, docs):
    rows = token_binary.token_matrices(docs, BYTE_BPE, capacity=128, cell_bytes=40_000).collect()
    encode = common.byte_bpe(BYTE_BPE)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 128 and r.segment_ends[-1] == r.n_tokens <= 128 and r.position_resets == r.segment_ends[:-1] and (ids[r.n_tokens :] == 50256).all()
        for a, b, d, k, s in zip(r.segment_ends, r.segment_ends[1:], r.doc_ids, r.pieces, r.starts):
            pieces.setdefault((d, k, s), []).append(ids[a:b].tolist())
    want = {}
    for d, t in ROWS:
        ids = [*encode(t or "").tolist(), 50256]
        for k, s in enumerate(range(0, len(ids), 128)):
            want.setdefault((d, k, s), []).append(ids[s : s + 128])
    assert pieces == want
    assert token_binary.token_matrices(empty(spark), BYTE_BPE).count() == 0


def test_best_fit_by_tree_is_best_fit():
    r = random.Random(1)
    for _ in range(20):
        lengths, rooms = [r.randrange(1, 65) for _ in range(200)], []
        for n in sorted(lengths, reverse=True):
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is None:
                rooms.append(64 - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        found = token_binary.best_fit_decreasing(lengths, 64)
        assert sorted(64 - sum(lengths[k] for k in b) for b in found) == sorted(rooms)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 200}


def test_sha_of_kept_text(spark, docs):
    row = substring.remove_repeats(docs).where("doc_id = 7").select(F.sha2("text", 256)).first()
    assert row[0] == hashlib.sha256(b"one").hexdigest()


def test_head_pairs_meet_once_and_by_more_than_a_few_shared_shingles(spark):
    """Unlike texts that share a passage don't meet, related ones meet once or twice and not under each shared shingle; none that is alike is missed."""
    r, passage = random.Random(8), prose(30, 81)
    base, rows = [f"b{k}" for k in range(500)], []
    for i in range(40):  # versions that differ in up to a tenth of their words
        w = list(base)
        for p in r.sample(range(500), 2 + i):
            w[p] = f"own{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"r{r.randrange(10**9)}" for _ in range(600)) + " " + passage) for i in range(60)]
    texts = simhash.identified(frame(spark, rows))
    nodes = common.written(simhash.heads(texts, 5, 0.8, simhash.common_shingles(texts, 5)).select(F.col("doc_id").alias("rep"), "size", F.slice("parity", 1, 8).alias("parity"), "head"))
    nodes = nodes.drop("head").join(simhash.shared_heads(nodes), "rep")
    placed = simhash.placed_keys(nodes).selectExpr("*", "rep as root", "-1L as main")
    met = [(x.a, x.b) for x in simhash.head_pairs(placed.withColumn("parity", F.array(*[F.lit(0).cast("long")] * 8)), 0.8).collect()]  # no bound by parities
    sets = {i: shingles5(t) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(min(p), max(p)) for p in met}
    assert len(alike) > 10 and alike <= found and max(max(p) for p in found) < 100
    assert len(met) < 2 * len(found)
