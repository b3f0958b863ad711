"""Operator 1, packing: related documents share training windows.

A nearest-neighbour graph over min-hash sketches is walked along greedy paths that begin at documents of
low degree; the documents, in the order of the paths, fill windows of a fixed number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import textkit
from lodestar.llm.common import column, components, picked, slices, stored
from lodestar.llm.minhash import permutations, shingles, signatures

SKETCH = 16
TREES = np.arange(SKETCH)
#: Keys of more sketches than these are split by a second value; pairs compared at once. Neither has an effect on recall.
SMALL, BLOCK = 64, 1 << 20


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(id, words, sketch) of every text with a word; a sketch is 16 minima of 16 bits each, big-endian."""
    a, b = permutations(SKETCH, seed=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = textkit.words(column(batch, "text"))
                sig = signatures(*shingles(w, n), a, b)
                some = np.flatnonzero(np.diff(w.first) > 0)
                low = (textkit.mix(sig.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")
                values = [row.tobytes() for row in low]
                # a tree's key comes from the whole 32-bit minimum; its last 4 bits are the tree
                keys = textkit.mix(sig.astype(np.uint64) * np.uint64(SKETCH) + TREES.astype(np.uint64))
                keys = (keys & ~np.uint64(SKETCH - 1) | TREES.astype(np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * SKETCH, pa.int32()), pa.array(keys.ravel()))
                count = np.diff(w.first)[some]
                yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(some)), pa.array(count), pa.array(values, pa.binary()), lists], names=["id", "words", "sketch", "keys"])

    return docs.mapInArrow(run, "id long, words long, sketch binary, keys array<long>")


def _close(group: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agree): all pairs of rows of one group that agree in at least `least` values; a group's rows are consecutive."""
    found, j, k = [], np.arange(len(group)), 0
    while True:
        k += 1
        j = j[j >= k]
        j = j[group[j] == group[j - k]]
        if not len(j):
            break
        agree = (held[j] == held[j - k]).sum(axis=1)
        near = agree >= least
        found.append((j[near], j[near] - k, agree[near]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))


def _best(i: np.ndarray, j: np.ndarray, agree: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `degree` pairs of most agreement of each i, of several those of the next rows."""
    order = np.lexsort((j, j < i, -agree, i))
    i, j, agree = i[order], j[order], agree[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < degree], j[place < degree], agree[place < degree]


def _blocks(held: np.ndarray, before: list[int], least: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best of _close of one group, compared in blocks; without pairs that agree in one of the values `before`."""
    size, columns, found = len(held), np.ascontiguousarray(held.T), []
    degree = min(degree, size)
    step = max(1, BLOCK // size)
    for at in range(0, size, step):
        to = min(size, at + step)
        agree = np.zeros((to - at, size), np.uint8)
        for c in before:
            agree |= columns[c][at:to, None] == columns[c]
        hidden = agree.astype(bool)
        agree[:] = 0
        for c in columns:
            agree += c[at:to, None] == c
        agree[hidden] = 0
        agree[np.arange(to - at), np.arange(at, to)] = 0
        far = (np.arange(size, dtype=np.int32) - np.arange(at, to, dtype=np.int32)[:, None]) % np.int32(size)
        top = np.argpartition(far - agree.astype(np.int32) * np.int32(size), degree - 1, axis=1)[:, :degree].ravel()
        i = np.repeat(np.arange(to - at), degree)
        held_ = agree[i, top].astype(np.int64)
        near = held_ >= least
        found.append((i[near] + at, top[near], held_[near]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _within(held: np.ndarray, tree: int, least: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best of _close of one large group, whose rows have value `tree` in common.

    Pairs that agree in two values or more meet in the rows of a second common value, and are compared at the first such.
    """
    if least < 2:
        return _blocks(held, [], least, degree)
    best, others = tuple(np.zeros(0, np.int64) for _ in range(3)), [t for t in range(SKETCH) if t != tree]
    for n, u in enumerate(others):
        order = np.argsort(held[:, u], kind="stable")
        value = held[order, u]
        first = np.flatnonzero(np.diff(value, prepend=-1, append=-1) != 0) if len(value) else np.zeros(1, np.int64)
        sizes = np.diff(first)
        small = order[np.repeat((sizes > 1) & (sizes <= SMALL), sizes)]
        i, j, agree = _close(held[small, u], held[small], least)
        i, j = small[i], small[j]
        fresh = ~(held[i][:, others[:n]] == held[j][:, others[:n]]).any(axis=1)
        found = [best, (i[fresh], j[fresh], agree[fresh]), (j[fresh], i[fresh], agree[fresh])]
        for k in np.flatnonzero(sizes > SMALL):
            own = order[first[k] : first[k + 1]]
            x, y, agree = _blocks(held[own], others[:n], least, degree)
            found.append((own[x], own[y], agree))
        best = _best(*(np.concatenate([f[k] for f in found]) for k in range(3)), degree)
    return best


def nearest(key: np.ndarray, ids: np.ndarray, held: np.ndarray, reach: int, least: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agree): for each row, the `degree` rows of its key of most agreement, if it is `least` or more.

    Rows are sorted by key, sketch and id, and keys are whole.  Rows of equal sketches are compared as one.
    """
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1]).any(axis=1)
    start = np.flatnonzero(fresh)
    copies = np.diff(np.append(start, len(key)))
    of = np.cumsum(fresh) - 1
    group, sketch = key[start], held[start]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(group)))
    some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    i, j, agree = _close(group[some], sketch[some], least)
    found = [(some[i], some[j], agree), (some[j], some[i], agree)]
    for k in np.flatnonzero(sizes > SMALL):
        x, y, agree = _within(sketch[first[k] : first[k] + sizes[k]], int(group[first[k]]) & (SKETCH - 1), least, degree)
        found.append((x + first[k], y + first[k], agree))
    i, j, agree = _best(*(np.concatenate([f[k] for f in found]) for k in range(3)), degree)
    # rows of a sketch that has more than `degree` have enough in each other
    few = copies[i] <= degree
    i, j, agree = i[few], j[few], agree[few]
    rows, at = _spread(copies[i])
    x = start[i][rows] + at
    take = np.minimum(copies[j], degree)[rows]
    each, n = _spread(take)
    y = start[j][rows][each] + (at[each] + n) % copies[j][rows][each]
    x, agree = x[each], agree[rows][each]
    x, y, agree = _best(x, y, agree, degree)
    place, number = np.arange(len(key)) - start[of] if len(key) else of, copies[of] if len(key) else of
    out = [(ids[x], ids[y], agree)]
    for k in range(1, max(reach, (degree + 1) // 2) + 1):
        p = np.flatnonzero(number > k)
        out.append((ids[p], ids[start[of[p]] + (place[p] + k) % number[p]], np.full(len(p), SKETCH)))
    x, y, agree = (np.concatenate([f[k] for f in out]) for k in range(3))
    other = x != y
    return np.minimum(x, y)[other], np.maximum(x, y)[other], agree[other]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n): each row as often as its count, numbered from 0."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)


def neighbours(prints: DataFrame, reach: int, least: int, degree: int) -> DataFrame:
    """(a, b, agree): each document's `degree` nearest of all documents that have a key in common with it."""
    rows = prints.select("id", "sketch", F.explode("keys").alias("key"))
    rows = rows.select("key", "sketch", "id").repartition("key").sortWithinPartitions("key", "sketch", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(key: np.ndarray, ids: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            x, y, agree = nearest(key, ids, held, reach, least, degree)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = column(batch, "key").to_numpy(), column(batch, "id").to_numpy()
            raw, _ = textkit.buffers(column(batch, "sketch"))
            held = raw.view(np.uint16).reshape(-1, SKETCH)
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if waiting and (last or waiting[-1][0][-1] != key[0]):
                # the last key may go on in the next batch
                waiting.append((key[:last], ids[:last], held[:last]))
                yield found(*(np.concatenate([w[k] for w in waiting]) for k in range(3)))
                waiting = []
            elif last:
                yield found(key[:last], ids[:last], held[:last])
            waiting.append((key[last:], ids[last:], held[last:].copy()))
        if waiting:
            yield found(*(np.concatenate([w[k] for w in waiting]) for k in range(3)))

    return rows.mapInArrow(run, "a long, b long, agree int")


def walk(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, path, place): paths that together visit every node once.

    A path begins at the unvisited node of the lowest degree (the smallest of several) and goes on to the unvisited
    neighbour of the highest weight (of several, that of the lowest degree, then the smallest) until there is none.
    A path is named after its first node.
    """
    nodes = np.unique(nodes)
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    source, target, w = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([weight, weight])
    order = np.argsort(source, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(source, minlength=len(nodes))))
    out, start, place = follow(first, target[order].astype(np.int32), w[order])
    return nodes[out], nodes[start], place.astype(np.int64)


def follow(first: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As walk, by the numbers of nodes: node k's neighbours are target[first[k] : first[k + 1]], which are put in order of preference.

    Takes 28 bytes a node besides its arguments, and bounded pieces of them.
    """
    n, at = len(first) - 1, 0
    degree = np.diff(first).astype(np.int32)
    while at < n:
        to = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, side="right")) - 1)
        lo, hi = int(first[at]), int(first[to])
        own, source = target[lo:hi], np.repeat(np.arange(to - at), degree[at:to])
        target[lo:hi] = own[np.lexsort((own, degree[own], -weight[lo:hi].astype(np.int64), source))]
        at = to
    starts = np.argsort(degree, kind="stable").astype(np.int32)
    out, start, place = (np.empty(n, np.int32) for _ in range(3))
    seen, k = bytearray(n), 0
    # single elements of memory views are Python's own numbers
    near, begin, node_, start_, place_ = (memoryview(x) for x in (target, first, out, start, place))
    for beginning in memoryview(starts):
        at, step = beginning, 0
        while at >= 0 and not seen[at]:
            seen[at] = 1
            node_[k], start_[k], place_[k] = at, beginning, step
            k += 1
            step += 1
            for t in near[begin[at] : begin[at + 1]]:
                if not seen[t]:
                    at = t
                    break
            else:
                at = -1
    return out, start, place


def graph(prints: DataFrame, reach: int, least: int, degree: int) -> DataFrame:
    """(a, b, agree): each document's `degree` nearest neighbours, either way."""
    pairs = neighbours(prints, reach, least, degree).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "agree")
    ranked = both.select("e.x", "e.y", "agree").withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("agree"), "y")))
    return ranked.filter(F.col("rank") <= degree).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "agree").distinct()


def divided(edges: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(part, a, b, agree): all edges; a part is some whole components, of about `block` edges together where these allow it.

    parts has (node, root) of the components. No edge is left out, whatever the sizes.
    """
    number = max(1, edges.count() // block)
    return edges.join(parts.withColumnRenamed("node", "a"), "a").select(F.pmod(F.xxhash64("root"), F.lit(number)).alias("part"), "a", "b", "agree")


def walked(parted: DataFrame, tasks: int) -> DataFrame:
    """(id, path, place) of every node of the edges (part, a, b, agree), as walk over all of them; parts are walked one by one.

    Edges come sorted, either way, from the cluster: besides a part's nodes, a task holds 26 bytes an edge of it.
    """
    ways = (F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    rows = parted.withColumn("e", F.explode(F.array(*ways))).select("part", "e.x", "e.y", F.col("agree").cast("byte"))
    # a number of partitions of its own: these few bytes are much work, which must not be merged into one task
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        targets: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        part = None

        def add(x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> None:
            begin = np.flatnonzero(np.diff(x) != 0) + 1
            begin, count = np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(x)]]))
            if nodes and nodes[-1][-1] == x[0]:  # goes on from the batch before
                counts[-1][-1] += count[0]
                begin, count = begin[1:], count[1:]
            if len(begin):
                nodes.append(x[begin])
                counts.append(count)
            targets.append(y.copy())
            weights.append(agree.copy())

        def done() -> Iterator[pa.RecordBatch]:
            ids, first, weight = np.concatenate(nodes), np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(weights)
            for k, y in enumerate(targets):
                targets[k] = np.searchsorted(ids, y).astype(np.int32)
            target = np.concatenate(targets)
            for held in (nodes, counts, targets, weights):
                held.clear()
            found = follow(first, target, weight)
            for at in range(0, len(ids), BLOCK):
                out, start, place = (f[at : at + BLOCK] for f in found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[start]), pa.array(place.astype(np.int64))], names=["id", "path", "place"])

        for batch in batches:
            parts, x, y, agree = (column(batch, c).to_numpy() for c in ("part", "x", "y", "agree"))
            begin = np.flatnonzero(np.diff(parts) != 0) + 1
            for lo, hi in zip(np.append(0, begin), np.append(begin, len(parts)), strict=True):
                if lo == hi:
                    continue
                if part is not None and parts[lo] != part:
                    yield from done()
                part = parts[lo]
                add(x[lo:hi], y[lo:hi], agree[lo:hi])
        if nodes:
            yield from done()

    return rows.mapInArrow(run, "id long, path long, place long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, n: int = 3, degree: int = 6, reach: int = 3, least: int = 2, block: int = 1 << 19
) -> DataFrame:
    """(window, piece, doc_id, start, stop): piece `piece` of window `window` is words start to stop - 1 of doc_id.

    Neighbours are documents whose sketches (16 minima over hashed word n-grams) agree in at least `least`
    values; a document has at most `degree` nearest ones. All documents that have one of the 16 values in common are compared,
    which finds every pair that agrees at all; the time is quadratic in the number of different sketches that have two values in
    common.  Documents of equal sketches are not compared: each is linked to those within `reach` rows either way (at least half of
    `degree`), in a ring by id.  Paths are walked along all edges: connected components are walked whole, however large, several together up to about
    `block` edges, which has no effect on results.  A task holds its largest component, at about 26 bytes an edge and 60 a document.  Paths follow one another in the order of
    their first documents' ids, and windows of `window` words are filled along them: every word of every document
    is in exactly one window, and only the last window may be short.  Words are runs of other than ASCII white space; texts of any length are read whole.
    Null ids, null texts and texts without words are left out.  Rows that share an id are one document,
    the one of the most words.  Other columns are ignored; an empty table gives no rows.
    """
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    prints = stored(sketches(base, n))
    edges = stored(graph(prints, reach, least, degree))
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = walked(divided(edges, components(edges), min(block, max(1, edges.count() // tasks))), tasks)
    sizes = prints.groupBy("id").agg(F.max("words").alias("words"))
    placed = sizes.join(paths, "id", "left").select("id", "words", F.coalesce("path", "id").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))
    # sums by range: no task sees more than its share, whatever the ids are
    shelved = stored(placed.repartitionByRange("path", "place").withColumn("shelf", F.spark_partition_id()))
    shelves = shelved.groupBy("shelf").agg(F.sum("words").alias("held"))  # a row per partition
    shelves = shelves.select("shelf", (F.sum("held").over(Window.orderBy("shelf")) - F.col("held")).alias("base"))
    upto = F.sum("words").over(Window.partitionBy("shelf").orderBy("path", "place").rowsBetween(Window.unboundedPreceding, 0))
    spread = shelved.withColumn("upto", upto).join(F.broadcast(shelves), "shelf").withColumn("begin", F.col("base") + F.col("upto") - F.col("words"))
    spread = spread.withColumn("end", F.col("begin") + F.col("words"))
    cut = spread.withColumn("window", F.explode(F.expr(f"sequence(begin div {window}, (end - 1) div {window})")))
    left, right = F.greatest(F.col("begin"), F.col("window") * window), F.least(F.col("end"), (F.col("window") + 1) * window)
    pieces = cut.select("window", F.col("id").alias("doc_id"), (left - F.col("begin")).alias("start"), (right - F.col("begin")).alias("stop"), left.alias("at"))
    return pieces.select("window", F.row_number().over(Window.partitionBy("window").orderBy("at")).alias("piece"), "doc_id", "start", "stop")
