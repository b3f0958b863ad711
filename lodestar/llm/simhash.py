"""Operator 4, SimHash near-dedup: tiled exact comparison of 128-bit fingerprints.

Two fingerprints within the radius are close in one of eight chunks of 16 bits, as not all chunks can differ by more than
their share (see limits).  Chunk by chunk, fingerprints are sorted into tiles of equal leading bits, and within pairs of close tiles into
buckets of equal trailing bits; only close buckets are compared, with numpy exclusive-or and bit counts.  No pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkit
from lodestar.llm.common import column, components, forest, picked, slices, stored

BITS, CHUNK = 128, 16
#: Rows of a bucket to aim at, pairs compared at once, and pairs found that are contracted at once. None has an effect on results.
BUCKET, BLOCK, LINKS = 32, 1 << 16, 1 << 20


def distinct_words(w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, where each text's begin), each word of a text once."""
    parts = [np.unique(w.hash[w.first[i] : w.first[i + 1]]) for i in range(len(w.first) - 1)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def simhash(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2) words of 64 bits: bit k is set if most features of the text have it set in their hash; 0 without features."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    step = 1 << 14  # features at once
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(first[some], first[some[at]] + step)))
        own = some[at:to]
        f = features[first[own[0]] : first[own[-1] + 1]]
        both = np.stack([textkit.mix(f), textkit.mix(f + np.uint64(0x5851F42D4C957F2D))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(f), 16), axis=1)
        ones = np.add.reduceat(bits, first[own] - first[own[0]], axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * ones > np.diff(first)[own][:, None], axis=1).view(np.uint64)
        at = to
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, f1, f2, features) of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                features, first = distinct_words(textkit.words(column(batch, "text")))
                prints, count = simhash(features, first).view(np.int64), np.diff(first)
                out = pa.RecordBatch.from_arrays(
                    [column(batch, "id"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(count.astype(np.int32))], names=["id", "f1", "f2", "features"]
                )
                yield out.filter(pa.array(count > 0))

    return docs.mapInArrow(run, "id long, f1 long, f2 long, features int")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all rows of a and b within the radius, by comparing all; with same, only i < j. The plain version of chunk_pairs."""
    found_i, found_j = [], []
    width = 1 << 13
    for left in range(0, len(b), width):
        part = np.ascontiguousarray(b[left : left + width].T)
        rows = max(1, (1 << 15) // part.shape[1])
        for top in range(0, min(len(a), left + width) if same else len(a), rows):
            x = a[top : top + rows]
            d = np.bitwise_count(x[:, 0, None] ^ part[0])
            d += np.bitwise_count(x[:, 1, None] ^ part[1])
            hits = np.flatnonzero(d.ravel() <= radius)
            if len(hits):
                i, j = hits // part.shape[1] + top, hits % part.shape[1] + left
                if same:
                    i, j = i[i < j], j[i < j]
                found_i.append(i)
                found_j.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def limits(radius: int) -> list[tuple[int, int, int]]:
    """(bits of the chunk, bits of its quarter, chunk's number) that two fingerprints within the radius may differ by; they keep to those of one chunk at least.

    If both halves differed by more than their limits (which are radius - 1 together), the whole would by more than the radius; so too for
    the quarters of a half and the chunks of a quarter.  A limit of -1 is never kept to: such chunks are left out.
    """

    def shares(r: int) -> tuple[int, int]:
        return (r - 1) // 2, r // 2

    quarters = [q for half in shares(radius) for q in shares(half)]
    return [(c, quarters[k // 2], k) for k, c in enumerate(c for q in quarters for c in shares(q)) if c >= 0]


def masks(bits: int, flips: int) -> list[int]:
    """All numbers of so many bits of which at most `flips` are set."""
    return [sum(1 << k for k in some) for n in range(min(bits, flips) + 1) for some in combinations(range(bits), n)]


def chunk_blocks(a: np.ndarray, b: np.ndarray, chunk: int, flips: int, within: int, radius: int, same: bool, bits: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), block by block, of all rows of a and b within the radius whose last `bits` bits of the chunk differ by at most `flips`, and whose quarter by at most `within`.

    With same, a is b, and only i < j, some of them twice.  A block compares about BLOCK pairs, or one row with all it may be near to.
    """
    bits = min(bits, max(0, (len(b) // BUCKET).bit_length() - 1))

    def sorted_(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by bucket, where the buckets begin, and the rows' quarters."""
        key = (x[:, chunk // 4] >> np.uint64(CHUNK * (chunk % 4)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rows = np.argsort(key, kind="stable")
        return rows, np.append(0, np.cumsum(np.bincount(key, minlength=1 << bits))), (x[rows, chunk // 4] >> np.uint64(2 * CHUNK * (chunk // 2 % 2))).astype(np.uint32)

    (rows_a, first_a, quarter_a), (rows_b, first_b, quarter_b) = sorted_(a), sorted_(b)
    flipped = np.array(masks(bits, flips), np.int64)
    for k in np.flatnonzero(np.diff(first_a)).tolist():
        near = k ^ flipped
        if same:
            near = near[near >= k]
        many = first_b[near + 1] - first_b[near]
        at = np.repeat(first_b[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
        if not len(at):
            continue
        part = quarter_b[at]
        step = max(1, BLOCK // len(at))
        for top in range(int(first_a[k]), int(first_a[k + 1]), step):
            x = quarter_a[top : min(top + step, int(first_a[k + 1]))]
            hits = np.flatnonzero(np.bitwise_count(x[:, None] ^ part).ravel() <= within)
            i, j = rows_a[top + hits // len(at)], rows_b[at[hits % len(at)]]
            close = np.bitwise_count(a[i] ^ b[j]).sum(axis=1) <= radius
            if same:
                close &= i != j
            i, j = i[close], j[close]
            yield (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def chunk_pairs(a: np.ndarray, b: np.ndarray, chunk: int, flips: int, within: int, radius: int, same: bool, bits: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of chunk_blocks(): in a group of near copies they are as many as its size squared."""
    found = list(chunk_blocks(a, b, chunk, flips, within, radius, same, bits))
    none = np.zeros(0, np.int64)
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (none, none)


def chunk_links(x: np.ndarray, y: np.ndarray, chunk: int, flips: int, within: int, radius: int, same: bool, bits: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what chunk_pairs() would of rows (f1, f2, id): pairs are contracted as they are found, so that memory follows the rows."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0
    for i, j in chunk_blocks(x[:, :2].view(np.uint64), y[:, :2].view(np.uint64), chunk, flips, within, radius, same, bits):
        held.append((x[i, 2], y[j, 2]))
        size += len(i)
        if size > max(LINKS, len(a)) or len(held) > LINKS:
            a, b = forest(*(np.concatenate([part, *(h[k] for h in held)]) for k, part in enumerate((a, b))))
            held, size = [], 0
    return forest(*(np.concatenate([part, *(h[k] for h in held)]) for k, part in enumerate((a, b))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 22, min_features: int = 8, tile_rows: int = 1 << 19) -> DataFrame:
    """(doc_id, duplicate_of): each document that another of its group stands for; the group's smallest id stays.

    A group is a connected component of documents whose fingerprints, over their distinct words
    with ASCII case folded, are within `radius` bits of 128; very long texts are read whole.  All pairs that
    can be are compared: recall at the radius is 1.  Documents of fewer than `min_features` distinct words are grouped where their fingerprints are equal, that is by
    the same words: one other word in seven or fewer is a larger edit than the radius stands for, though it often moves fewer bits.  Equal fingerprints are compared once, through the smallest id.
    Null ids, null texts and texts without words are in no group.  Repeated rows count once; an id with several
    texts is in the group of each.  Other columns are ignored; an empty table gives no rows.
    `tile_rows`, about the rows that a task compares with as many others, only sets how the comparison is divided.
    """
    spark = docs.sparkSession
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    prints = stored(fingerprints(base))
    reps = prints.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("features").alias("features"))
    large = stored(reps.filter(F.col("features") >= min_features).select("rep", "f1", "f2"))
    bits = min(CHUNK, max(2, (large.count() // tile_rows).bit_length()))  # that are equal in a tile
    copies = prints.join(reps.select("f1", "f2", "rep"), ["f1", "f2"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()

    def leading(chunk: int) -> Column:
        return F.shiftrightunsigned("f1" if chunk < 4 else "f2", CHUNK * (chunk % 4 + 1) - bits).bitwiseAND((1 << bits) - 1)

    kept_to = limits(radius)
    chunked = large.withColumn("in", F.explode(F.array(*(F.struct(F.lit(k).alias("chunk"), leading(k).alias("tile")) for _, _, k in kept_to)))).select("rep", "f1", "f2", "in.*")
    parts = stored(chunked.groupBy("chunk", "tile").agg(F.ceil(F.count("*") / tile_rows).alias("parts")))  # at most 8 << bits rows
    named = chunked.join(F.broadcast(parts), ["chunk", "tile"]).withColumn("part", F.pmod(F.xxhash64("f1", "f2"), "parts"))

    def tile(table: pa.Table) -> pa.Table:
        both = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("f1", "f2", "rep")], axis=1)
        return table.slice(0, 1).select(["chunk", "tile", "part"]).append_column("held", pa.array([both.tobytes()], pa.binary()))

    packed = stored(named.groupBy("chunk", "tile", "part").applyInArrow(tile, "chunk int, tile long, part long, held binary").withColumn("name", F.concat_ws(".", "chunk", "tile", "part")))
    near = spark.createDataFrame([(k, m, flips - m.bit_count(), within) for flips, within, k in kept_to for m in masks(bits, flips)], "chunk int, mask long, flips int, within int")
    todo = packed.select("chunk", "tile", F.col("name").alias("t1")).join(near, "chunk").withColumn("tile", F.col("tile").bitwiseXOR(F.col("mask")))
    todo = todo.join(packed.select("chunk", "tile", F.col("name").alias("t2")), ["chunk", "tile"]).filter("t1 <= t2").select("chunk", "flips", "within", "t1", "t2")
    todo = todo.join(packed.select(F.col("name").alias("t1"), F.col("held").alias("h1")), "t1")
    todo = todo.join(packed.select(F.col("name").alias("t2"), F.col("held").alias("h2")), "t2")
    todo = todo.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "t1", "t2")

    def compare(table: pa.Table) -> pa.Table:
        found = []
        for t1, t2, h1, h2, chunk, flips, within in zip(*(table.column(c).to_pylist() for c in ("t1", "t2", "h1", "h2", "chunk", "flips", "within")), strict=True):
            x, y = np.frombuffer(h1, np.int64).reshape(-1, 3), np.frombuffer(h2, np.int64).reshape(-1, 3)
            found.append(chunk_links(x, y, chunk, flips, within, radius, t1 == t2, CHUNK - bits))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = todo.groupBy("t1", "t2").applyInArrow(compare, "a long, b long").unionAll(copies)
    return components(edges).filter("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))
