"""Operator 7, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkit
from lodestar.llm.common import column, picked, slices

SCHEMA = "doc_id long, item_id long, score double"


class Lookup:
    """Finds 64-bit values in a sorted set; a bit table rules most out."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.mask = np.uint64((1 << max(16, int(len(self.values) * 16).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in x of members, their index in the set)."""
        at = np.flatnonzero(self.table[(x & self.mask).astype(np.int64)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        sure = self.values[k] == x[at]
        return at[sure], k[sure]


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> float:
    """Best Smith-Waterman score of two word sequences, as a share of the item's score with itself."""
    if not len(item) or not len(passage):
        return 0.0
    steps = np.arange(len(passage) + 1, dtype=np.int32) * -gap
    row = np.zeros(len(passage) + 1, np.int32)
    best = 0
    for w in item:
        score = np.where(passage == w, np.int32(match), np.int32(mismatch))
        new = np.maximum(row + gap, 0)
        np.maximum(new[1:], row[:-1] + score, out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        best = max(best, int(row.max()))
    return best / (match * len(item))


def grams_in(w: textkit.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram at each word, whether it lies within one text)."""
    grams = textkit.ngrams(w.hash, n)
    inside = np.ones(len(grams), bool)
    for back in range(1, n):
        at = w.first[1:-1] - back
        inside[at[(at >= 0) & (at < len(grams))]] = False
    return grams, inside


def spread_seeds(own: np.ndarray, counted: np.ndarray, threshold: float, n: int) -> list[int]:
    """The rarest n-gram of each block of an item, whose n-grams are `own` (-1 for none), such that `threshold` of its words in a row hold a whole block."""
    block = max(1, (int(threshold * len(own)) - n + 1) // 2)
    out = []
    for at in range(0, len(own), block):
        some = own[at : at + block]
        some = some[(some >= 0) & (counted[some] > 0)]
        if len(some):
            out.append(int(some[np.lexsort((some, counted[some]))[0]]))
    return out


def _items(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of bounded size; any size is handled, part by part."""
    part, held = [], 0
    for item, text in benchmark.orderBy("id", "text").toLocalIterator():
        part.append((item, text))
        held += len(text)
        if held >= part_bytes:
            yield part
            part, held = [], 0
    if part:
        yield part


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 3,
    threshold: float = 0.4,
    common_share: float = 0.01,
    rare_docs: int = 100,
    least_seeds: int = 12,
    part_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, score) of each document in which a benchmark item is found, exact, edited or paraphrased.

    Words are runs of letters and digits, ASCII case folded.  Seeds are an item's word n-grams that at most
    `common_share` of all documents, or `rare_docs` if that is more, hold, counted over the whole corpus, and in any case its `least_seeds`
    rarest of those that occur, and where others are left out, the rarest of each stretch, so that each share of `threshold` of an item has one.
    Around every seed hit the passage is aligned with the item by words (match 2, mismatch and gap -1); score is the
    best local alignment as a share of the item's own, kept from `threshold` on and rounded to 6 digits.
    Items of fewer than n words have no seed and are not found.  Null ids and texts on either side are left out.
    Repeated rows give one row, with the highest score; so do texts that share an id.  Empty tables give no rows.
    The benchmark is taken in parts of `part_bytes`, each matched in two scans without a shuffle of texts.
    """
    spark = docs.sparkSession
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    items = picked(benchmark, id=item_col, text=item_text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long")).distinct()
    out = spark.createDataFrame([], SCHEMA)
    total = None
    for part in _items(items, part_bytes):
        ids = np.array([i for i, _ in part], np.int64)
        w = textkit.words(pa.array([t for _, t in part], pa.string()), alnum=True)
        grams, inside = grams_in(w, n)
        known = Lookup(grams[inside])

        def count(batches: Iterator[pa.RecordBatch], known: Lookup = known) -> Iterator[pa.RecordBatch]:
            seen, rows = np.zeros(len(known.values), np.int64), 0
            for whole in batches:
                rows += whole.num_rows
                for batch in slices(whole, "text"):
                    d = textkit.words(column(batch, "text"), alnum=True)
                    g, ok = grams_in(d, n)
                    at, k = known.find(g)
                    at, k = at[ok[at]], k[ok[at]]
                    own = np.searchsorted(d.first, at, side="right") - 1
                    both = np.unique(own * len(known.values) + k)
                    seen += np.bincount(both % max(1, len(known.values)), minlength=len(known.values))
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], rows))], names=["seed", "n"])

        counted = np.zeros(len(known.values) + 1, np.int64)
        for r in base.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():
            counted[r["seed"]] = r["n"]
        total = int(counted[-1])
        where = np.full(len(w.hash), -1, np.int64)
        where[: len(grams)][inside] = np.searchsorted(known.values, grams[inside])
        seeds: list[tuple[int, int]] = []  # (seed, item)
        for i in range(len(ids)):
            own = np.unique(where[w.first[i] : w.first[i + 1]])
            own = own[(own >= 0) & (counted[own] > 0)]  # what no document holds finds none
            own = own[np.lexsort((own, counted[own]))]
            rare = counted[own] <= max(rare_docs, common_share * total)
            rare[:least_seeds] = True
            seeds += [(int(s), i) for s in own[rare]]
            if not rare.all():
                seeds += [(s, i) for s in spread_seeds(where[w.first[i] : w.first[i + 1]], counted, threshold, n)]
        if not seeds:
            continue
        pairs = np.array(sorted(set(seeds)), np.int64)
        held = Lookup(known.values[pairs[:, 0]])
        begin = np.searchsorted(known.values[pairs[:, 0]], held.values)  # pairs are in the order of the values
        stop = np.append(begin[1:], len(pairs))
        sequences = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(ids))]

        def search(
            batches: Iterator[pa.RecordBatch], held: Lookup = held, begin: np.ndarray = begin, stop: np.ndarray = stop, of: np.ndarray = pairs[:, 1], sequences: list[np.ndarray] = sequences, ids: np.ndarray = ids
        ) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    d = textkit.words(column(batch, "text"), alnum=True)
                    g, ok = grams_in(d, n)
                    at, k = held.find(g)
                    at, k = at[ok[at]], k[ok[at]]
                    names = column(batch, "id").to_numpy()
                    many = stop[k] - begin[k]
                    place = np.repeat(at, many)
                    item = of[np.repeat(begin[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    doc = np.searchsorted(d.first, place, side="right") - 1
                    order = np.lexsort((place, item, doc))
                    place, item, doc = place[order], item[order], doc[order]
                    fresh = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
                    rows = []
                    for lo, hi in zip(fresh, np.append(fresh[1:], len(place))[: len(fresh)], strict=True):
                        q, text = sequences[item[lo]], int(doc[lo])
                        reach = len(q) + len(q) // 2
                        spots = place[lo:hi]
                        best = 0.0
                        for run in np.split(spots, np.flatnonzero(np.diff(spots) > reach) + 1):
                            left, right = max(int(d.first[text]), int(run[0]) - reach), min(int(d.first[text + 1]), int(run[-1]) + reach)
                            best = max(best, align(q, d.hash[left:right]))
                        if best >= threshold:
                            rows.append((int(names[text]), int(ids[item[lo]]), round(best, 6)))
                    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["doc_id", "item_id", "score"])

        out = out.unionAll(base.mapInArrow(search, SCHEMA))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
