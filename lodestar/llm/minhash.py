"""Operator 10, document fingerprints: MinHash.

Shingles of `n` consecutive words are hashed, `bands * rows` universal permutations
are applied in numpy, signature bands are joined in Spark and every candidate pair's
Jaccard similarity is computed on the whole shingle sets.  No pair is ever a row: documents that share bands
are brought together in blocks of bounded size, and pairs of blocks are compared in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkit
from lodestar.llm.common import column, components, content_key, forest, picked, slices, stored


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of x -> a x + b modulo 2**32, each a permutation of 32-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def shingles(w: textkit.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, where each text's begin): n consecutive words, or all words of a text that has fewer."""
    count = np.diff(w.first)
    keep = np.maximum(count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(keep)])
    grams = textkit.ngrams(w.hash, n)
    out = np.empty(int(first[-1]), np.uint64)
    own = np.repeat(np.arange(len(count)), keep)
    at = w.first[:-1][own] + np.arange(len(out)) - first[:-1][own]
    full = count[own] >= n
    out[full] = grams[at[full]] if len(grams) else 0
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        out[first[i]] = textkit.ngrams(h, len(h))[0]
    return (out >> np.uint64(32)).astype(np.uint32), first


def signatures(hashes: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of minima per text that has a shingle."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(some), len(a)), np.uint32)
    if len(some):
        starts = first[:-1][some]
        with np.errstate(over="ignore"):
            for k in range(len(a)):
                out[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): the hash of each band of each signature."""
    keys = np.full((len(sig), bands), 0, np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64)
        return textkit.mix(textkit.mix(keys) + np.arange(bands, dtype=np.uint64))


def fingerprints(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, h1, h2, size, bands) of every text with a word; size is its number of shingles."""
    a, b = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, first = shingles(textkit.words(column(batch, "text")), n)
                keys = band_keys(signatures(hashes, first, a, b), bands, rows)
                size = np.diff(first)
                flat = pa.array(keys.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.int32()), flat)
                kept = batch.take(pa.array(np.flatnonzero(size > 0)))
                yield pa.RecordBatch.from_arrays([column(kept, "id"), column(kept, "h1"), column(kept, "h2"), pa.array(size[size > 0]), lists], names=["id", "h1", "h2", "size", "bands"])

    keyed = docs.select("id", "text", *content_key(F.col("text")))
    return keyed.mapInArrow(run, "id long, h1 long, h2 long, size long, bands array<long>")


def linked(ids: np.ndarray, side: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids, each once, of which a set of the one and a set of the other share a key and are similar by `threshold` or more.

    Sides 0 and 1 are compared with each other, and side 2 with itself.
    """
    size = np.array([len(x) for x in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    code = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint32), return_inverse=True)[1]
    mark = np.zeros(int(code.max(initial=-1)) + 1, np.int32)
    one, other = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in one:
        near = other[ids[other] > ids[i]] if side[i] == 2 else other
        near = near[(keys[near] == keys[i]).any(axis=1)]
        # what is too small or too large can't be similar enough
        near = near[(np.minimum(size[near], size[i]) >= threshold * np.maximum(size[near], size[i])) & (ids[near] != ids[i])]
        if not len(near):
            continue
        own = code[first[i] : first[i + 1]]
        mark[own] = 1
        count = size[near]
        at = np.repeat(first[near] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        same = np.add.reduceat(mark[code[at]], np.cumsum(count) - count)
        mark[own] = 0
        close = near[same / (size[i] + count - same) >= threshold]
        found.append((np.full(len(close), ids[i]), ids[close]))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def placed(keys: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(id, pair, side): the pairs of blocks in which each document is compared; members has id, root and weight.

    Documents that share no key, directly or through others, are in different roots.  A root that weighs at most `block` is one block.
    In a larger one, a document is in the block of its heaviest key, which is divided by hash into blocks of about
    that weight, and those blocks are compared that have a key in common.
    """
    roots = members.groupBy("root").agg(F.sum("weight").alias("held"))
    whole = members.join(roots.filter(F.col("held") <= block), "root").select("id", F.col("root").alias("pair"), F.lit(2).alias("side"))
    large = members.join(roots.filter(F.col("held") > block), "root").select("id", "weight")
    own = keys.join(large, "id")
    heavy = own.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("held")).filter("n > 1")
    own = stored(own.join(heavy, "key").select("key", "id", "held"))
    top = own.groupBy("id").agg(F.max(F.struct("held", "key")).alias("top"))
    parts = F.ceil(F.col("top.held") / block)
    blocks = stored(top.select("id", F.xxhash64("top.key", F.pmod(F.xxhash64(F.lit("part"), "id"), parts)).alias("block")))
    meets = own.join(blocks, "id").select("key", "block").distinct()
    pairs = meets.join(meets.withColumnRenamed("block", "second"), "key").filter("block <= second").select("block", "second").distinct()
    # a block of one document, or of none that share a key, is still met here with itself: it costs nothing
    both = pairs.select("block", F.xxhash64("block", "second").alias("pair"), F.when(F.col("block") == F.col("second"), 2).otherwise(0).alias("side"))
    both = both.unionAll(pairs.filter("block < second").select("second", F.xxhash64("block", "second").alias("pair"), F.lit(1).alias("side")))
    return whole.unionAll(blocks.join(both, "block").select("id", "pair", "side"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, bands: int = 40, rows: int = 4, block: int = 1 << 18, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """(doc_id, class_id, links) of each document with a word.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams (a text of fewer words is one shingle), ASCII case
    folded, is `threshold` or more.  links is the number of other texts that a document's text is linked with; texts equal
    byte by byte count as one, however many documents have it.  class_id is the smallest id of the documents that are
    connected by links and by equal texts, and the document's own id where there are none.
    Candidates share a band; a pair of similarity s is found with probability 1 - (1 - s**rows)**bands, 0.92 at 0.5 and over 0.99 at 0.6.
    Every candidate pair is verified on the whole sets, in blocks that weigh about `block` (shingles, and 256 a document).
    Up to `broadcast_rows` candidates (32 MB) are broadcast to find their texts; beyond, texts are shuffled by id.
    Null ids, null texts and texts without words have no row.  Repeated rows count once; an id with several texts has one row
    and class, and is linked by each of them, but not with itself: where it is a text's smallest id, the text's other documents have these links as well.  Very long texts are read whole.  Other columns are ignored;
    an empty table gives no rows.
    """
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    prints = stored(fingerprints(base, n, bands, rows))
    reps = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    owned = stored(prints.select("id", "h1", "h2", "size").distinct().join(reps, ["h1", "h2"]).select("id", "rep", "size", "h1", "h2"))
    copies = owned.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    own = owned.filter("id = rep").select("id", "h1", "h2")
    keys = prints.join(own, ["id", "h1", "h2"], "left_semi").select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low")
    keys = stored(keys.join(shared, "key"))  # those of one document are gone
    parts = components(keys.select(F.col("id").alias("a"), F.col("low").alias("b")))
    weights = owned.filter("id = rep").groupBy("id").agg((F.sum("size") + 256).alias("weight"))
    members = stored(parts.join(weights, F.col("node") == F.col("id")).select("id", "root", "weight"))
    wanted = stored(placed(keys.select("key", "id"), members, block).groupBy("id").agg(F.collect_list(F.struct("pair", "side")).alias("wanted")))
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= broadcast_rows
    found = base.join(F.broadcast(wanted) if few else wanted, "id").select("id", "text", "wanted")
    a, b = permutations(bands * rows)

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, first = shingles(textkit.words(column(batch, "text")), n)
                keyed = band_keys(signatures(hashes, first, a, b), bands, rows)
                some = np.flatnonzero(np.diff(first) > 0)
                held = [(np.unique(hashes[first[i] : first[i + 1]]).tobytes(), keyed[k].tobytes()) for k, i in enumerate(some)]
                kept = batch.take(pa.array(some))
                lists = column(kept, "wanted")
                at = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                columns = [flat.field(0), flat.field(1), column(kept, "id").take(pa.array(at)), pa.array([held[k][0] for k in at], pa.binary()), pa.array([held[k][1] for k in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "side", "id", "held", "keys"])

    def compare(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        raw, _ = textkit.buffers(table.column("keys"))
        held, off = textkit.buffers(table.column("held"))
        sets = [held[x:y].view(np.uint32) for x, y in zip(off[:-1], off[1:], strict=True)]
        x, y = linked(ids, side, raw.view(np.uint64).reshape(len(ids), bands), sets, threshold)
        node, n_links = np.unique(np.concatenate([x, y]), return_counts=True)
        p, q = forest(x, y)
        columns = [np.concatenate([node, p]), np.concatenate([node, q]), np.concatenate([n_links, np.zeros(len(p), np.int64)])]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "links": pa.array(columns[2], pa.int64())})

    sets = found.mapInArrow(as_sets, "pair long, side int, id long, held binary, keys binary")
    near = stored(sets.groupBy("pair").applyInArrow(compare, "a long, b long, links long"))
    classes = components(near.filter("a <> b").select("a", "b").unionAll(copies))
    links = near.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    rows_ = owned.select("id", "rep").distinct().join(links, "rep", "left").groupBy("id").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    rows_ = rows_.join(classes, F.col("id") == F.col("node"), "left")
    return rows_.select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("class_id"), "links")
