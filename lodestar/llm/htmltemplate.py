"""Operator 8, HTML extraction by equivalence classes of tokens.

Tokens (tags by name, words) of a host that occur equally often on each of its pages form a class; large and frequent
classes whose tokens keep their order and which nest into one another make the host's template.  What stands in its slots is extracted.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import textkit
from lodestar.llm.common import column, picked, slices, stored

_UNSEEN = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>?")


def tokens(col: pa.Array) -> tuple[textkit.Words, np.ndarray]:
    """(tokens, whether each is a tag). Comments, scripts and styles are none; a tag is its name, with / if it closes."""
    raw, offsets = textkit.buffers(col)
    raw = raw.copy()
    for i in range(len(offsets) - 1):
        for m in _UNSEEN.finditer(raw[offsets[i] : offsets[i + 1]].tobytes()):
            raw[offsets[i] + m.start() : offsets[i] + m.end()] = 32
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n == 0:
        return textkit.Words(raw, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)), np.zeros(0, bool)
    opens = np.flatnonzero(raw == 60)
    follows = raw[np.minimum(opens + 1, n - 1)]
    named = ((follows | 32) >= 97) & ((follows | 32) <= 122) | (follows == 47) | (follows == 33)
    opens = opens[named & (opens + 1 < n)]
    closes = np.flatnonzero(raw == 62)
    page = np.searchsorted(offsets, opens, side="right") - 1
    k = np.searchsorted(closes, opens)
    until = np.where(k < len(closes), closes[np.minimum(k, max(0, len(closes) - 1))] if len(closes) else n, n)
    until = np.minimum(until, offsets[page + 1] - 1)
    if len(opens) > 1:  # a tag begins only after the one before it has ended
        fresh = np.concatenate([[True], opens[1:] > np.maximum.accumulate(until)[:-1]])
        opens, until = opens[fresh], until[fresh]
    begins = np.zeros(n, bool)
    begins[opens] = True
    depth = np.zeros(n + 1, np.int8)
    depth[opens] = 1
    depth[until + 1] -= 1
    within = np.cumsum(depth[:-1], dtype=np.int8) > 0
    space = textkit._IS_SPACE[raw]
    # inside a tag, only its name is kept: up to the first space, or slash after the first letter
    slash = raw == 47
    slash[1:] &= ~begins[:-1]
    blocked = np.cumsum((space | slash | (raw == 62)) & within, dtype=np.int32)
    name = within
    if len(opens):
        own = np.cumsum(begins, dtype=np.int32) - 1
        name = within & (blocked == blocked[opens][np.maximum(own, 0)])
    inside = np.where(within, name, ~space)
    after = np.zeros(n, bool)
    past = until + 1
    after[past[past < n]] = True
    w = textkit.runs(raw, offsets, inside, begins | after)
    return w, begins[w.start]


def host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def frequent(pages: DataFrame, share: float) -> DataFrame:
    """(host, token): at least those tokens that the share of a host's pages hold: then a part of them does, of some partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[list] = []
        sizes: list[int] = []
        for whole in batches:
            for batch in slices(whole, "html"):
                w, _ = tokens(column(batch, "html"))
                for i, h in enumerate(column(batch, "host").to_pylist()):
                    k = names.setdefault(h, len(names))
                    if k == len(held):
                        held.append([])
                        sizes.append(0)
                    held[k].append(np.unique(w.hash[w.first[i] : w.first[i + 1]]))
                    sizes[k] += 1
                    if len(held[k]) >= 512:
                        held[k] = [_merge(held[k])]
        for h, k in names.items():
            value, count = _merge(held[k])
            value = value[count >= share * sizes[k]]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(value), pa.string()), pa.array(value.view(np.int64))], names=["host", "token"])

    return pages.mapInArrow(run, "host string, token long").distinct()


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many of the sets hold each) of sets and of such pairs."""
    values = np.concatenate([p[0] if isinstance(p, tuple) else p for p in parts])
    counts = np.concatenate([p[1] if isinstance(p, tuple) else np.ones(len(p), np.int64) for p in parts])
    unique, at = np.unique(values, return_inverse=True)
    return unique, np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)


def sequences(pages: DataFrame) -> DataFrame:
    """(host, page_id, held): each page's occurrences of its host's frequent tokens, in order; pages has those as `some`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                w, _ = tokens(column(batch, "html"))
                some = column(batch, "some").to_pylist()
                out = []
                for i, wanted in enumerate(some):
                    own = w.hash[w.first[i] : w.first[i + 1]].view(np.int64)
                    out.append(own[np.isin(own, np.array(wanted, np.int64))].tolist())
                yield pa.RecordBatch.from_arrays([column(batch, "host"), column(batch, "page_id"), column(batch, "row"), pa.array(out, pa.list_(pa.int64()))], names=["host", "page_id", "row", "held"])

    return pages.mapInArrow(run, "host string, page_id long, row long, held array<long>")


def conflicts(held: np.ndarray, classes: dict[int, int], sizes: dict[int, int]) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """({class: hash of its tokens' order, 0 if they don't repeat one}, pairs of classes that aren't nested) on one page."""
    of = np.array([classes.get(t, -1) for t in held.tolist()], np.int64)
    orders: dict[int, int] = {}
    spots: dict[int, np.ndarray] = {}
    for c in set(of.tolist()) - {-1}:
        at = np.flatnonzero(of == c)
        block = held[at]
        m = sizes[c]
        rows = block.reshape(-1, m) if len(block) % m == 0 else block[:0].reshape(0, m)
        if not len(rows) or (rows != rows[0]).any() or len(np.unique(rows[0])) != m:
            orders[c] = 0
            continue
        orders[c] = int(textkit.ngrams(rows[0].view(np.uint64), m).view(np.int64)[0]) or 1
        spots[c] = at.reshape(-1, m)
    crossed = set()
    names = sorted(spots)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if not (_nested(spots[a], spots[b]) or _nested(spots[b], spots[a])):
                crossed.add((a, b))
    return orders, crossed


def _nested(outer: np.ndarray, inner: np.ndarray) -> bool:
    """Whether each occurrence of inner is within one gap between neighbouring tokens of outer, or outside it."""
    flat = outer.ravel()
    return bool((np.searchsorted(flat, inner[:, 0]) == np.searchsorted(flat, inner[:, -1])).all())


def _small(df: DataFrame, weight: str, limit: int) -> DataFrame:
    """Broadcast if what it weighs is checked to be within the limit; else it is left to be joined by a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(weight))).first()[0] or 0) <= limit else df


def templates(pages: DataFrame, share: float, least_pages: int, least_tokens: int, limit: int) -> DataFrame:
    """(host, template): the tokens of each host's valid classes."""
    counts = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    counts = stored(counts)
    known = pages.join(_small(counts, "1", limit), "host")
    some = stored(frequent(known.select("host", "html"), share).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("some")))
    held = stored(sequences(known.join(_small(some, "size(some)", limit), "host").select("host", "page_id", "row", "html", "some")))
    each = held.select("host", "row", F.explode("held").alias("token")).groupBy("host", "row", "token").agg(F.count("*").alias("times"))
    # equal sums over the pages: equal occurrence vectors
    vector = each.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum(F.xxhash64("row", "times").cast("decimal(20,0)")).alias("v1"), F.sum(F.xxhash64(F.lit("second"), "row", "times").cast("decimal(20,0)")).alias("v2")
    )
    vector = vector.join(counts, "host").filter(F.col("support") >= F.greatest(F.lit(least_pages), share * F.col("pages")))
    groups = vector.groupBy("host", "support", "v1", "v2").agg(F.sort_array(F.collect_list("token")).alias("tokens")).filter(F.size("tokens") >= least_tokens)
    groups = groups.withColumn("class", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("support"), F.desc(F.size("tokens")), "tokens")))
    groups = stored(groups.select("host", "class", "support", "tokens"))
    lists = _small(stored(groups.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))), "aggregate(classes, 0, (s, c) -> s + size(c.tokens))", limit)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int, int]] = set()
        for batch in batches:
            for h, own, found in zip(column(batch, "host").to_pylist(), column(batch, "held"), column(batch, "classes").to_pylist(), strict=True):
                classes = {t: c["class"] for c in found for t in c["tokens"]}
                orders, crossed = conflicts(own.values.to_numpy(), classes, {c["class"]: len(c["tokens"]) for c in found})
                seen |= {(h, c, c, o) for c, o in orders.items()} | {(h, a, b, 0) for a, b in crossed}
        cols = list(zip(*sorted(seen), strict=True)) if seen else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "a", "b", "how"])

    said = stored(held.join(lists, "host").select("host", "held", "classes").mapInArrow(check, "host string, a long, b long, how long").distinct())
    orders = said.filter("a = b").groupBy("host", F.col("a").alias("class")).agg(F.countDistinct("how").alias("ways"), F.min(F.abs("how")).alias("least"))
    valid = groups.join(orders.filter("ways = 1 and least <> 0"), ["host", "class"], "left_semi")
    # of two classes that cross, the one of less support (then fewer tokens) is no part of the template
    crossing = said.filter("a <> b").join(valid.select("host", F.col("class").alias("a")), ["host", "a"], "left_semi").select("host", F.col("b").alias("class"))
    valid = valid.join(crossing, ["host", "class"], "left_anti")
    return valid.select("host", F.explode("tokens").alias("token")).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least_pages: int = 3, least_tokens: int = 3, limit: int = 2_000_000) -> DataFrame:
    """(page_id, slot, text): the text of each slot of each page that has any; a slot's number is that of the template tokens before it, so
    that an empty slot leaves those after it their numbers.

    Pages of one host (of its URL, lower case; '' without one) share a template.  A class is a set of at least
    `least_tokens` tokens with one occurrence vector, on `least_pages` pages and the `share` of the host's at least.  It is valid if its tokens
    repeat one order on every page, and of two valid classes that cross on a page, the one of less support (then of fewer
    tokens) goes.  Slots are what lies between template tokens: its words, without tags, entities resolved, joined
    by a space.  Comments, scripts and styles are left out.  A page of a host with fewer pages has no template: it is one slot.
    Up to `limit` hosts, or tokens of all hosts together, are broadcast to the pages; beyond, pages are shuffled by host.
    Null or empty html has no slots; very long pages are read whole.  Null ids stay null; repeated rows count as pages of their own and are repeated.  Other columns are ignored.
    """
    base = picked(pages, page_id=id_col, url=url_col, html=html_col).filter("html is not null").withColumn("page_id", F.col("page_id").cast("long"))
    base = base.select("page_id", host().alias("host"), "html", F.xxhash64("page_id", "url", "html").alias("row"))
    known = _small(stored(templates(base, share, least_pages, least_tokens, limit)), "size(template)", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                w, tag = tokens(column(batch, "html"))
                rows: list[tuple[int | None, int, str]] = []
                names, template = column(batch, "page_id").to_pylist(), column(batch, "template").to_pylist()
                for i in range(batch.num_rows):
                    lo, hi = w.first[i], w.first[i + 1]
                    fixed = np.isin(w.hash[lo:hi].view(np.int64), np.array(template[i] or [], np.int64))
                    words = np.flatnonzero(~fixed & ~tag[lo:hi])
                    if not len(words):
                        continue
                    gap = np.cumsum(fixed)[words]
                    new = np.flatnonzero(np.diff(gap, prepend=-1))
                    for slot, a, b in zip(gap[new].tolist(), words[new], words[np.append(new[1:], len(words)) - 1], strict=True):
                        text = w.raw[w.start[lo + a] : w.end[lo + b]].tobytes().decode("utf-8", "replace")
                        if "<" in text:
                            text = _TAG.sub(" ", text)
                        rows.append((names[i], slot, " ".join(entities.unescape(text).split())))
                a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string())], names=["page_id", "slot", "text"])

    joined = base.join(known, "host", "left").select("page_id", "html", "template")
    return joined.mapInArrow(run, "page_id long, slot int, text string")
