"""Element trees of HTML pages as rows, and what selectors find in them.

A page becomes its tokens (tags, texts, whole scripts), and its elements become intervals of token numbers, from the opening tag
to the closing one. Being inside of something is then a comparison of numbers within a page, and selectors, nearest
ancestors and texts are joins; no tree is ever built. Where all that is asked lies within the cards of a page, `nested` and
`held` answer it from the page's own row, so that no token is shuffled or written down.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import once

#: Elements that have no closing tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: A comment, a whole script or style, a tag (quoted values may hold >), a text, or a lone <.
TOKEN = r"""(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*+>|</?[a-z][^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>|<[!?][^>]*+>|[^<]++|<"""
#: A text node that is nothing but a price.
STRICT_PRICE = r"^\d+(?:\.\d{1,2})?$"


def tokens(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A page's tokens in order: key, n (from 0), token, kind (open, close, void, raw, text, other) and tag (lower case)."""
    found = pages.where(F.col(key).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("n", "token"))
    named = found.withColumn("tag", _tag(F.col("token")))
    return named.select(key, "n", "token", _kind(F.col("token"), F.col("tag")).alias("kind"), F.nullif("tag", F.lit("")).alias("tag"))


def _tag(token: Column) -> Column:
    """The lower-case name of a tag; empty for what is none."""
    return F.when(token.startswith("<"), F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))).otherwise("")


def _kind(token: Column, tag: Column) -> Column:
    return (
        F.when(tag == "", F.when(token.startswith("<!") | token.startswith("<?"), "other").otherwise("text")).when(token.startswith("</"), "close")
        .when(tag.isin("script", "style"), "raw").when(tag.isin(VOID) | token.endswith("/>"), "void").otherwise("open")
    )


def elements(rows: DataFrame, key: str) -> DataFrame:
    """The elements of tokens: key, n (of the opening tag), stop (of the closing one), tag, token.

    An opening tag is closed by the next closing tag of its name on its level, levels being counted for each name alone, so
    that what is left open of one name does no harm to others. Void elements and scripts stop where they begin; an element
    that is never closed lasts to the end of the page.
    """
    page = Window.partitionBy(key)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    tags = rows.withColumn("last", F.max("n").over(page)).where("tag is not null")
    depth = F.sum(step).over(Window.partitionBy(key, "tag").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    leveled = tags.withColumn("level", depth + F.when(F.col("kind") == "close", 1).otherwise(0))
    closing = F.min(F.when(F.col("kind") == "close", F.col("n"))).over(Window.partitionBy(key, "tag", "level").orderBy("n").rowsBetween(1, Window.unboundedFollowing))
    ended = leveled.withColumn("closing", closing).where("kind in ('open', 'void', 'raw')")
    stop = F.when(F.col("kind") == "open", F.coalesce("closing", "last")).otherwise(F.col("n"))
    return ended.select(key, "n", stop.alias("stop"), "tag", "token")


def attribute(token: Column, name: str) -> Column:
    """An attribute of an opening tag, quoted either way or bare; null where the tag hasn't it."""
    pattern = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
    return F.when(token.rlike(pattern), F.concat(*[F.regexp_extract(token, pattern, k) for k in (1, 2, 3)]))


def has_class(token: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.trim(attribute(token, "class")), r"\s+"), name), F.lit(False))


def selector(tag: str | None = None, classes: tuple[str, ...] = (), attributes: dict[str, str | None] | None = None, of: Column | None = None) -> Column:
    """A condition on elements: a tag, classes that it must have, attributes with their value (None: any).

    The elements are rows with columns tag and token, or the structs `of`.
    """
    name_, token = (F.col("tag"), F.col("token")) if of is None else (of["tag"], of["token"])
    out = F.lit(True) if tag is None else name_ == tag
    for c in classes:
        out = out & has_class(token, c)
    for name, value in (attributes or {}).items():
        found = attribute(token, name)
        out = out & (found.isNotNull() if value is None else F.coalesce(found == value, F.lit(False)))
    return out


def _pairs(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Each row of `inner` (key, n) with each element of `outer` around it, as outer_n and outer_stop."""
    around = outer.select(F.col(key).alias("_k"), F.col("n").alias("outer_n"), F.col("stop").alias("outer_stop"))
    return inner.join(around, (F.col(key) == F.col("_k")) & (F.col("n") > F.col("outer_n")) & (F.col("n") <= F.col("outer_stop"))).drop("_k")


def inside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """The rows of `inner` (tokens or elements) that stand in some element of `outer`, each with the innermost: adds outer_n."""
    near = _pairs(inner, outer, key)
    return near.groupBy(*inner.columns).agg(F.max("outer_n").alias("outer_n"))


def texts(found: DataFrame, rows: DataFrame, key: str, separator: str = " ") -> DataFrame:
    """The text inside each of some elements: key, n, text. Texts are trimmed, blank ones go; elements without any have ''."""
    own = rows.where("kind = 'text'").select(key, "n", F.trim(F.regexp_replace("token", r"\s+", " ")).alias("t")).where("t <> ''")
    parts = _pairs(own, found, key).groupBy(key, "outer_n").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))
    said = parts.select(key, F.col("outer_n").alias("n"), F.array_join(F.transform("p", lambda x: x["t"]), separator).alias("text"))
    return found.select(key, "n").join(said, [key, "n"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def first_inside(cards: DataFrame, tree: DataFrame, rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """The text of the first element inside each card that each field's selector finds: key, n (of the card) and the fields.

    An element belongs to the innermost card around it. A field that a card lacks is null.
    """
    out = cards.select(key, "n")
    for name, condition in fields.items():
        held = inside(tree.where(condition).select(key, "n", "stop"), cards, key)
        first = held.groupBy(key, F.col("outer_n").alias("card")).agg(F.min(F.struct("n", "stop")).alias("e")).select(key, "card", "e.n", "e.stop")
        said = first.select(key, "card", "n").join(texts(first, rows, key), [key, "n"]).select(key, F.col("card").alias("n"), F.col("text").alias(name))
        out = out.join(said, [key, "n"], "left")
    return out


def nearest_match(anchors: DataFrame, tree: DataFrame, rows: DataFrame, key: str, pattern: str = STRICT_PRICE, levels: int = 4) -> DataFrame:
    """The first text node that is wholly of a pattern in the nearest ancestor that has one, of at most `levels` ancestors: key, n, value.

    Every element knows the first such node at or behind its opening tag, so that an anchor meets its ancestors alone.
    """
    ahead = Window.partitionBy(key).orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    node = F.trim("token")
    first = rows.withColumn("hit", F.first(F.when((F.col("kind") == "text") & node.rlike(pattern), F.struct("n", node.alias("value"))), ignorenulls=True).over(ahead)).select(key, "n", "hit")
    known = tree.join(first, [key, "n"]).select(F.col(key).alias("_k"), F.col("n").alias("outer_n"), F.col("stop").alias("outer_stop"), "hit").where("outer_stop > outer_n")
    around = anchors.select(key, "n").join(known, (F.col(key) == F.col("_k")) & (F.col("n") > F.col("outer_n")) & (F.col("n") <= F.col("outer_stop")))
    nearest = around.withColumn("level", F.row_number().over(Window.partitionBy(key, "n").orderBy(F.desc("outer_n")))).where(F.col("level") <= levels)
    best = nearest.where(F.col("hit.n") <= F.col("outer_stop")).groupBy(key, "n").agg(F.min_by("hit.value", "level").alias("value"))
    return anchors.select(key, "n").join(best, [key, "n"], "left")


def _nesting(levels: int):
    """Of each page's tokens: where an element stops, the innermost card around it, and the matching text near an anchor.

    marks: 1 opens, 2 closes, 4 an element, 8 a card, 16 an anchor, 32 a matching text. Elements are closed as in `elements`. A
    page is passed once, and what has stopped leaves the ways up when it is met.
    """

    @F.arrow_udf("struct<stop: array<int>, outer: array<int>, near: array<int>>")
    def of(tags, marks):
        import numpy as np
        import pyarrow as pa

        codes, flags = tags.flatten().dictionary_encode().indices.to_pylist(), marks.flatten().to_numpy(zero_copy_only=False)
        offsets = tags.offsets.to_numpy() - tags.offsets[0].as_py()
        found = [np.full(len(flags), -1, np.int32) for _ in range(3)]
        for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            n = end - first
            stops, outer, near, up, top = [n - 1] * n, [-1] * n, [-1] * n, [-1] * n, -1
            opened, cards, hits, asked = {}, [], [], []
            for i, mark in enumerate(flags[first:end].tolist()):
                if not mark:
                    continue
                if mark & 4:
                    while cards and stops[cards[-1]] < i:
                        cards.pop()
                    if cards:
                        outer[i] = cards[-1]
                if mark & 17:
                    while top >= 0 and stops[top] < i:
                        top = up[top]
                if mark & 16:
                    e, ancestors = top, []
                    while e >= 0 and len(ancestors) < levels:
                        ancestors.append(e)
                        while up[e] >= 0 and stops[up[e]] < i:
                            up[e] = up[up[e]]
                        e = up[e]
                    asked.append((i, ancestors))
                if mark & 32:
                    hits.append(i)
                elif mark & 1:
                    opened.setdefault(codes[first + i], []).append(i)
                    up[i], top = top, i
                elif mark & 4:
                    stops[i] = i
                elif mark & 2 and opened.get(codes[first + i]):
                    stops[opened[codes[first + i]].pop()] = i
                if mark & 8:
                    cards.append(i)
            for i, ancestors in asked:
                ahead = [bisect_left(hits, e) for e in ancestors]
                near[i] = next((hits[h] for e, h in zip(ancestors, ahead) if h < len(hits) and hits[h] <= stops[e]), -1)
            for to, values in zip(found, (stops, outer, near)):
                to[first:end] = values
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in found], ["stop", "outer", "near"])

    return of


def nested(pages: DataFrame, key: str, card: Callable[[Column], Column], anchor: Callable[[Column], Column], html: str = "html", pattern: str = STRICT_PRICE, levels: int = 4) -> DataFrame:
    """Pages with their tokens inside, one row a page: key, t (structs of n, token, kind, tag, mark, stop, outer, near; see `_nesting`).

    card and anchor tell elements by a struct with tag and token; near is what `nearest_match` finds for an anchor, outer what
    `inside` finds among the cards, each as the number of a token, -1 for none.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    told = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda x: once(_tag(x), lambda tag: F.struct(x.alias("token"), _kind(x, tag).alias("kind"), tag.alias("tag"))))

    def mark(x: Column) -> Column:
        also = F.when(card(x), 8).otherwise(0) + F.when(anchor(x), 16).otherwise(0) + 4
        return F.when(x["kind"] == "open", also + 1).when(x["kind"].isin("void", "raw"), also).when(x["kind"] == "close", 2).when((x["kind"] == "text") & F.trim(x["token"]).rlike(pattern), 32).otherwise(0)

    rows = pages.where(F.col(key).isNotNull() & F.col(html).isNotNull()).select(key, told.alias("t")).withColumn("marks", F.transform("t", mark))
    placed = rows.withColumn("x", _nesting(levels)(F.transform("t", lambda x: x["tag"]), F.col("marks")))
    full = F.transform("t", lambda x, i: F.struct(i.alias("n"), *[x[c].alias(c) for c in ("token", "kind", "tag")], F.get("marks", i).alias("mark"), *[F.get(F.col("x")[c], i).alias(c) for c in ("stop", "outer", "near")]))
    return placed.select(key, full.alias("t"))


def held(pages: DataFrame, key: str, fields: dict[str, Callable[[Column], Column]], separator: str = " ") -> DataFrame:
    """The anchors inside the cards of `nested` pages: key, n and card (number and token), the fields as of `first_inside`, anchor (token), value."""
    t = F.col("t")

    def behind(e: Column) -> Column:
        return F.slice(t, e["n"] + 2, e["stop"] - e["n"])

    def said(e: Column) -> Column:
        parts = F.transform(F.filter(behind(e), lambda x: x["kind"] == "text"), lambda x: F.trim(F.regexp_replace(x["token"], r"\s+", " ")))
        return F.array_join(F.filter(parts, lambda p: p != ""), separator)

    def rows(c: Column) -> Column:
        def of(own: Column) -> Column:
            firsts = [once(F.get(F.filter(own, is_), F.lit(0)), lambda e: F.when(e.isNotNull(), said(e))).alias(name) for name, is_ in fields.items()]
            anchors = F.filter(own, lambda x: x["mark"].bitwiseAND(16) > 0)
            return once(F.struct(*firsts), lambda f: F.transform(anchors, lambda a: F.struct(c["n"].alias("n"), c["token"].alias("card"), *[f[name].alias(name) for name in fields], a["token"].alias("anchor"), F.when(a["near"] >= 0, F.trim(F.get(t, a["near"])["token"])).alias("value"))))

        return once(F.filter(behind(c), lambda x: (x["outer"] == c["n"]) & (x["mark"].bitwiseAND(4) > 0)), of)

    return pages.select(key, F.inline(F.flatten(F.transform(F.filter(t, lambda x: x["mark"].bitwiseAND(8) > 0), rows))))
