"""Toxicity by classifier chains: linear models, each of which also sees the probabilities of the categories before it.

While a chain is trained, a row's earlier probabilities come from models that were fitted without its fold, so that a
later link learns from predictions as good as those it will get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import give_back, giving_back, materialize, small_batches

#: Letters that a word's beginnings are taken of, besides the word itself.
PREFIXES = (4, 5, 6)

#: What the labels know, in the order of the chain.
CATEGORIES = ["low_quality", "toxic"]


def features(text: str):
    """Numbers (hashes, ascending) of the distinct lower-case words of a whole text and of their beginnings."""
    import re
    import zlib

    import numpy as np

    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    parts = words.union(*({f"{n}:{w[:n]}" for w in words if len(w) > n} for n in PREFIXES))
    return np.unique(np.fromiter((zlib.crc32(p.encode()) for p in parts), dtype=np.uint32, count=len(parts)))


def fit_link(rows: list, y, extra, most: int, ridge: float):
    """One logistic regression on the `most` most telling features (chi-square on these rows) and on `extra` columns.

    Returns the features' hashes and the weights: one each, one for each extra column, and the constant.
    """
    import numpy as np

    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    names, at = np.unique(np.concatenate([*rows, np.zeros(0, dtype=np.uint32)]), return_inverse=True)
    at, of = at.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    seen = np.bincount(at, minlength=len(names)).astype(float)
    hit = np.bincount(at, weights=y[of], minlength=len(names))
    rate = min(max(y.mean(), 1e-9), 1 - 1e-9)
    chi = np.where(seen >= 3, (hit - seen * rate) ** 2 / np.maximum(seen * rate * (1 - rate), 1e-9), 0)
    best = np.sort(np.argsort(-chi, kind="stable")[:most])
    best = best[chi[best] > 12]
    slot = np.full(len(names), -1)
    slot[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best) + extra.shape[1] + 1))
    keep = slot[at] >= 0
    x[of[keep], slot[at[keep]]] = 1
    x[:, len(best) : -1] = extra
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return names[best].astype(np.int64), w


def link_scores(rows: list, extra, names, weights):
    import numpy as np

    out = extra @ weights[len(names) : -1] + weights[-1]
    for i, r in enumerate(rows):
        if len(names) and len(r):
            r = r.astype(np.int64)
            k = np.searchsorted(names, r)
            k[k == len(names)] = 0
            out[i] += weights[k[names[k] == r]].sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], folds: int = 3, most_rows: int = 6000, most_features: int = 384, ridge: float = 0.5) -> list | None:
    """Fits a chain on documents (doc_id, text) and labels (doc_id and a 0/1 column for each category); None without any.

    The sample is bounded: the `most_rows` labels of the smallest doc_id hash, fitted in one task; of different texts
    under one doc_id the least is taken. Copies of a text share a fold. Labels that are null, or whose document is
    missing, are left out.
    """
    known = labels.where("doc_id is not null and " + " and ".join(f"`{c}` is not null" for c in categories))
    known = known.select(F.col("doc_id").cast("long").alias("labelled_id"), *[F.col(c).cast("double").alias(c) for c in categories])
    few = known.orderBy(F.xxhash64("labelled_id"), "labelled_id", *categories).limit(most_rows)
    text = F.col("text").cast("string")
    few = materialize(few)
    ids = F.broadcast(few.select(F.col("labelled_id").alias("id")).distinct())  # at most most_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sample = texts.join(F.broadcast(few), F.col("id") == F.col("labelled_id")).select("text", *categories, F.xxhash64("text").alias("h"))

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["h", *categories])
        rows = [features(t or "") for t in pdf["text"]]
        fold = pdf["h"].to_numpy() % folds
        extra, out = np.zeros((len(rows), 0)), []
        for k, name in enumerate(categories):
            y = pdf[name].to_numpy()
            names, weights = fit_link(rows, y, extra, most_features, ridge)
            out.append({"link": k, "hashes": names, "weights": weights})
            if k < len(categories) - 1:
                p = np.zeros(len(rows))
                for i in range(folds):
                    inside, outside = np.flatnonzero(fold == i), np.flatnonzero(fold != i)
                    if len(inside) and len(outside):
                        link = fit_link([rows[r] for r in outside], y[outside], extra[outside], most_features, ridge)
                        p[inside] = link_scores([rows[r] for r in inside], extra[inside], *link)
                    else:
                        p[inside] = link_scores([rows[r] for r in inside], extra[inside], names, weights)
                extra = np.c_[extra, p]
        give_back()
        return pd.DataFrame(out)

    small_batches(docs.sparkSession)
    found = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "link int, hashes array<long>, weights array<double>").orderBy("link").collect()
    return [(categories[r["link"]], list(r["hashes"]), list(r["weights"])) for r in found] or None


def arrays(chain: list) -> list:
    import numpy as np

    return [(np.array(h, dtype=np.int64), np.array(w)) for _, h, w in chain]


def probabilities(texts: list, links: list):
    """A row of probabilities for each text (null: empty), one a link; each link sees those before it."""
    import numpy as np

    rows = [features(t or "") for t in texts]
    p = np.zeros((len(rows), 0))
    for names, weights in links:
        p = np.c_[p, link_scores(rows, p, names, weights)]
    return p


def score_chain(docs: DataFrame, chain: list) -> DataFrame:
    """Scores every whole text (doc_id, text): doc_id and p_<category> for each link; null text counts as empty."""
    columns = [f"p_{name}" for name, _, _ in chain]

    def score(batches):
        import pyarrow as pa

        links = arrays(chain)
        for batch in batches:
            p = probabilities(batch.column(1).to_pylist(), links)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(links)))], names=["doc_id", *columns])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(score), "doc_id long, " + ", ".join(f"{c} double" for c in columns))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.42) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) that judge_toxicity doesn't call toxic, each by its own text.

    Rows are judged one by one, so that rows without doc_id and different texts under one doc_id get their own verdict;
    nothing is joined or moved. Without labels all rows stay.
    """
    chain = fit_chain(docs, label_categories(labels), CATEGORIES)
    if chain is None:
        return docs

    def keep(batches):
        import pyarrow as pa

        links = arrays(chain)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(probabilities(batch.column(1).to_pylist(), links)[:, -1] < threshold))

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(keep), StructType([StructField("row", docs.schema)])).select("row.*")


def label_categories(labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality, toxic) as categories: low_quality (quality is 0) and toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.42) -> DataFrame:
    """Scores every document (doc_id, text) by a chain fitted on the labelled ones: doc_id, p_low_quality, p_toxic, toxic.

    A document is toxic if the chain's last probability reaches the threshold (below a half: a missed one
    costs more). Null and empty texts have no features and get the constant's probability; without labels nothing is known, and the scores are null and no document toxic.
    Repeated rows are scored each; an empty table gives no rows.
    """
    chain = fit_chain(docs, label_categories(labels), CATEGORIES)
    if chain is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("double").alias("p_low_quality"), F.lit(None).cast("double").alias("p_toxic"), F.lit(False).alias("toxic"))
    return score_chain(docs, chain).withColumn("toxic", F.col("p_toxic") >= threshold)
