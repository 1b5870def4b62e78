"""The stages of the corpus pipeline, one after the other, against brute force over the words of small documents."""

import random

import pytest

import corpus_pipeline
from millrace.llm import toxicity

SF = "/root/testdata/sf0.001"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.randrange(60)}" for _ in range(n))


SHARED, COPY = prose(70, 1), prose(200, 2)
ROWS = [
    (1, "a " + prose(60, 3) + " " + SHARED), (2, SHARED + " " + prose(80, 4)), (3, COPY), (4, COPY.replace(" ", "  ", 3)), (5, COPY + " tail"), (6, None), (7, ""), (8, " \n "), (9, "short text"), (9, "short text"),
    (None, prose(90, 5)), (None, SHARED + " of no document"), (10, SHARED), (11, prose(30, 6) + "\n" + SHARED[:100]), (12, "x" * 30000), (13, prose(9000, 7)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_before string, n_words int, n_removed int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "mine", 7, 8, "r") for d, t in rows], SCHEMA)


def windows(words, size=50):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def brute_cut(rows):
    first = {}
    for d, t in rows:
        if d is not None:
            for w in windows((t or "").split()):
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        words = (t or "").split()
        gone = set()
        if d is not None:
            for i, w in enumerate(windows(words)):
                if first[w] < d:
                    gone |= set(range(i, i + 50))
        if not gone:
            out.append((d, t))
        elif len(gone) < len(words):
            out.append((d, " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_repeated_passages(spark):
    docs = frame(spark, ROWS)
    got = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert got.schema == docs.schema
    kept = got.collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(brute_cut(ROWS), key=str)
    assert all((r.text_before, r.n_words, r.n_removed, r.row, r.lang) == ("mine", 7, 8, "r", "en") and r.n_chars == len(r.text or "") for r in kept)
    assert corpus_pipeline.repeated_passages(spark, docs.where("false"), SF).count() == 0


def shingles(text):
    w = (text or "").split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)])


def test_stages_one_after_the_other(spark):
    """Near duplicates leave the first of each group, passages the first document's; all but toxic rows are kept or cut as brute force says."""
    docs = frame(spark, ROWS)
    after = corpus_pipeline.toxicity(spark, docs, SF)
    chain = toxicity.fit_chain(docs, toxicity.label_categories(spark.read.parquet(f"{SF}/labels.parquet")), toxicity.CATEGORIES)
    toxic = set() if chain is None else {t for (d, t), p in zip(ROWS, toxicity.probabilities([t for _, t in ROWS], toxicity.arrays(chain))[:, -1]) if p >= 0.42}
    clean = [(d, t) for d, t in ROWS if t not in toxic]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == sorted(clean, key=str) and after.schema == docs.schema

    sets = [shingles(t) for _, t in clean]
    root = list(range(len(clean)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(clean)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, t) in enumerate(clean):
        groups.setdefault(find(i), []).append((d is None, d or 0, d, t))
    once = corpus_pipeline.near_duplicates(spark, after, SF)
    kept = [(r.doc_id, r.text) for r in once.collect()]
    assert once.schema == docs.schema and len(kept) == len(groups)
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted(min(g)[:2] for g in groups.values())

    cut = corpus_pipeline.repeated_passages(spark, once, SF)
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(brute_cut(kept), key=str)
    packed = corpus_pipeline.packing(spark, cut, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in cut.collect()} and max(r.offset + r.length for r in packed) <= 4096


def test_run(spark):
    """The whole run over given documents is its stages one by one."""
    packed = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = docs.select("doc_id").collect()
    pieces = packed.where("piece = 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in pieces) == sorted(r.doc_id for r in kept) and 0 < len(kept) < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_of_nothing(spark, name):
    docs = frame(spark, [])
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert got.count() == 0 and got.schema == docs.schema
