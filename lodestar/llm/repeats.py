"""Operator 5, suffix-array dedup by prefix-free parsing.

Rolling-hash triggers serve twice.  The minimal hash of 8 words in each passage of the least length is its anchor; the
passages around anchors that recur are brought together by anchor, equal ones once.  Each group is then parsed:
triggers cut it into phrases that overlap by the trigger, the suffix array of the dictionary of distinct phrases and that of
the parse combine into the order of all its suffixes, and neighbours in that order that share the least length are repeats.
Anchors of very many different passages are no group: the hashes of their windows are counted over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import textkit
from lodestar.llm.common import column, picked, slices, stored

ANCHOR = 8


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive values."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    fill = x[-1]
    padded = np.concatenate([x, np.full(blocks * width - n, fill, x.dtype)]).reshape(blocks, width)
    front = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return pick(back[:m], front[width - 1 : width - 1 + m])


_PLACE = np.uint64((1 << 30) - 1)


def anchors(w: textkit.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word position, hash, left, right) of each anchor: it is the first minimal gram of those windows of `least` words that make up left to right - 1.

    Each window of a text has one anchor, at the same place wherever its words occur.
    """
    grams = textkit.ngrams(w.hash, ANCHOR)
    low = sliding((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), least - ANCHOR + 1, np.minimum)
    begin = np.arange(len(low))
    own = np.searchsorted(w.first, begin, side="right") - 1
    begin = begin[begin + least <= w.first[own + 1]]  # the others run over a text's end
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    at = (low[begin] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    last = np.append(new[1:], len(at)) - 1
    return at[new], grams[at[new]], begin[new], begin[last] + least


def span_hash(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the words left to right - 1, wherever they stand."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * textkit.powers(n)[:n], dtype=np.uint64)])
        return textkit.mix((total[right] - total[left]) * textkit.inverse_powers(n + 1)[left] + (right - left).astype(np.uint64))


def passage_hash(hashes: np.ndarray, left: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the words left to right - 1 and of the place of the anchor among them."""
    return span_hash(hashes, left, right) ^ textkit.mix((at - left).astype(np.uint64))


def rank_suffixes(x: np.ndarray, stop: np.ndarray, most: int | None = None) -> np.ndarray:
    """Rank of each suffix x[i:stop[i]], equal ones alike, a prefix before what continues it; by doubling, up to `most` values."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    step, longest = 1, int((stop - np.arange(n)).max(initial=0))
    longest = min(longest, most) if most else longest
    while step < longest:
        after = np.arange(n) + step
        inside = after < stop
        second = np.zeros(n, np.int64)
        second[inside] = rank[after[inside]]
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def corpus_order(text: np.ndarray, piece: np.ndarray, trigger: int = 2, modulus: int = 6) -> np.ndarray:
    """The suffix array of `text`, whose piece i is text[piece[i]:piece[i + 1]]; suffixes end with their piece.

    Prefix-free parsing: a phrase runs from one trigger (`trigger` words whose hash is 0 modulo `modulus`, or a
    piece's beginning) through the next (or its end), so consecutive phrases overlap by a trigger and none is a
    proper prefix of another.  Suffixes compare by the rest of their phrase, then by the parse that follows it.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(piece) - 1), np.diff(piece))
    ends = piece[1:][own]
    cut = np.zeros(n, bool)
    rolled = textkit.ngrams(text.astype(np.uint64), trigger)
    at = np.flatnonzero(rolled % np.uint64(modulus) == 0)
    cut[at[at + trigger <= ends[at]]] = True
    cut[piece[:-1][np.diff(piece) > 0]] = True
    begin = np.flatnonzero(cut)
    follows = np.append(begin[1:], n)
    last = follows >= ends[begin]  # of its piece
    stop = np.where(last, ends[begin], np.minimum(follows + trigger, ends[begin]))
    # a piece's last phrase ends with its own mark: it stands for nothing that goes on
    name = span_hash(text.astype(np.uint64), begin, stop) ^ np.where(last, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    _, sample, phrase = np.unique(name, return_index=True, return_inverse=True)
    size = (stop - begin)[sample] + last[sample]
    where = np.concatenate([[0], np.cumsum(size)])
    dictionary = np.zeros(where[-1], np.int64)
    word = np.repeat(begin[sample], size) + np.arange(where[-1]) - np.repeat(where[:-1], size)
    real = np.ones(where[-1], bool)
    real[where[1:][last[sample]] - 1] = False  # the marks, before all words
    dictionary[real] = text[word[real]].astype(np.int64) + 1
    suffix = rank_suffixes(dictionary, np.repeat(where[1:], size))
    parse = suffix[where[:-1][phrase]]
    piece_of = own[begin]
    parse_stop = np.searchsorted(piece_of, piece_of, side="right")
    parsed = rank_suffixes(parse, parse_stop)
    k = np.searchsorted(begin, np.arange(n), side="right") - 1
    rest = suffix[where[:-1][phrase[k]] + np.arange(n) - begin[k]]
    after = np.where(last[k], 0, parsed[np.minimum(k + 1, len(parsed) - 1)])
    return np.lexsort((after, rest))


def repeated_starts(text: np.ndarray, piece: np.ndarray, least: int, place: np.ndarray) -> np.ndarray:
    """Positions whose next `least` words, within their piece, also begin elsewhere at an equal `place`.

    Suffixes that share the words are neighbours in the corpus order.  A place is an anchor and the distance from it, which keeps
    apart two pieces that overlap in their text: they hold the same words, but not at one distance from one anchor.
    """
    order = corpus_order(text, piece)
    own = np.repeat(np.arange(len(piece) - 1), np.diff(piece))
    full = np.arange(len(text)) + least <= piece[1:][own]
    order = order[full[order]]  # suffixes of fewer words share too little with any
    ahead = span_hash(text.astype(np.uint64), order, order + least)
    group = np.cumsum(np.concatenate([[False], ahead[1:] != ahead[:-1]])[: len(order)])
    by = np.lexsort((place[order], group))
    order, group = order[by], group[by]
    same = (group[1:] == group[:-1]) & (place[order[1:]] == place[order[:-1]])
    found = np.zeros(len(text), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, shard_words: int = 200_000, hot: int = 2000) -> DataFrame:
    """(doc_id, start, stop): maximal runs of words, start to stop - 1, covered by passages of `least` words that occur more than once.

    Words are runs of other than ASCII white space, ASCII case folded, numbered from 0.  Both the first and the later
    occurrences are given, in other documents or the same one.  Null ids, null texts, and texts of fewer than `least` words give no rows;
    very long texts are read whole.
    Repeated rows count once, as do equal passages at one place in several texts of an id; such an id has the runs of each text, merged by position.
    Other columns are ignored; an empty table gives no rows.  `least` is at most 200.  A suffix array is built of about `shard_words` words; an
    anchor of more than `hot` different passages belongs to no suffix array, its windows are counted by their hashes, which gives the same rows.
    """
    if not ANCHOR < least <= 200:
        raise ValueError("least must be over 8 and at most 200")
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = textkit.words(column(batch, "text"))
                at, name, left, right = anchors(w, least)
                passage = passage_hash(w.hash, left, at, right) if len(at) else name
                own = np.searchsorted(w.first, at, side="right") - 1
                where = (at - w.first[own]) << 16 | (at - left) << 8 | (right - at - ANCHOR)
                ids = column(batch, "id").take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(passage.view(np.int64)), ids, pa.array(where)], names=["anchor", "passage", "id", "loc"])

    rows = base.mapInArrow(scan, "anchor long, passage long, id long, loc long")
    occurrence = F.xxhash64("id", F.shiftright("loc", 16))
    # two occurrences that differ have different hashes; minimum and maximum are combined before the shuffle, however often an anchor occurs
    several = rows.groupBy("anchor").agg(F.min(occurrence).alias("x"), F.max(occurrence).alias("y")).filter("x <> y").select("anchor")
    found = stored(rows.join(several, "anchor", "left_semi"))
    kinds = found.groupBy("anchor", "passage").agg((F.min(occurrence) != F.max(occurrence)).alias("twice"), F.first("id").alias("id"), F.first("loc").alias("loc"))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    classes = stored(kinds.join(many, "anchor"))
    before, after = F.shiftright("loc", 8).bitwiseAND(F.lit(255)).cast("int"), (F.col("loc").bitwiseAND(F.lit(255)) + ANCHOR).cast("int")
    mixed = classes.filter("kinds > 1")
    total = mixed.filter(F.col("kinds") <= hot).agg(F.sum(before + after)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    wanted = mixed.groupBy("id").agg(F.collect_list(F.struct("anchor", "passage", "loc", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    fetched = base.join(wanted, "id").select("text", "wanted")

    def fetch(batch: pa.RecordBatch, hottest: bool) -> tuple[textkit.Words, list[np.ndarray]]:
        """(words, [anchor, passage, left, place of the anchor, right]) of the wanted passages that the texts hold."""
        w = textkit.words(column(batch, "text"))
        lists = column(batch, "wanted")
        flat = lists.flatten()
        own = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        name, passage, loc = (flat.field(k).to_numpy() for k in range(3))
        at = w.first[own] + (loc >> 16)
        left, right = at - (loc >> 8 & 255), at + (loc & 255) + ANCHOR
        # an id may have several texts: only where the passage is there
        there = (flat.field(3).to_numpy(zero_copy_only=False) == hottest) & (right <= w.first[own + 1])
        there[there] = passage_hash(w.hash, left[there], at[there], right[there]).view(np.int64) == passage[there]
        return w, [x[there] for x in (name, passage, left, at, right)]

    def fetch_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w, (name, passage, left, at, right) = fetch(batch, False)
                short = (w.hash >> np.uint64(32)).astype(np.uint32)
                held = [short[a:b].tobytes() for a, b in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(passage), pa.array((at - left).astype(np.int32)), pa.array(held, pa.binary())], names=["anchor", "passage", "before", "held"])

    def fetch_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w, (_, passage, left, at, right) = fetch(batch, True)
                count = right - left - least + 1
                k = np.repeat(np.arange(len(count)), count)
                begin = left[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                window = span_hash(w.hash, begin, begin + least) if len(begin) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(passage[k]), pa.array((begin - at[k]).astype(np.int32)), pa.array(window.view(np.int64))], names=["passage", "lo", "window"])

    def order(table: pa.Table) -> pa.Table:
        raw, offsets = textkit.buffers(table.column("held"))
        text, piece = raw.view(np.uint32), offsets // 4
        anchor, passage = table.column("anchor").to_numpy(), table.column("passage").to_numpy()
        keep = np.sort(np.unique(np.stack([anchor, passage]), axis=1, return_index=True)[1])  # one of each
        parts = [text[piece[i] : piece[i + 1]] for i in keep]
        text, piece = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ahead = table.column("before").to_numpy()[keep]
        group = np.unique(anchor[keep], return_inverse=True)[1]
        size = np.diff(piece)
        place = np.arange(len(text)) - np.repeat(piece[:-1] + ahead, size) + np.repeat(group, size) * (4 * least)
        starts = repeated_starts(text, piece, least, place)
        at = np.flatnonzero(starts)
        own = np.searchsorted(piece, at, side="right") - 1
        new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(at, prepend=-9) > least))
        final = np.append(new[1:], len(at)) - 1 if len(at) else new
        k = keep[own[new]]
        shift = piece[own[new]] + table.column("before").to_numpy()[k]
        cols = [pa.array(anchor[k]), pa.array(passage[k]), pa.array((at[new] - shift).astype(np.int32)), pa.array((at[final] + least - shift).astype(np.int32))]
        return pa.table(cols, names=["anchor", "passage", "lo", "hi"])

    held = fetched.mapInArrow(fetch_words, "anchor long, passage long, before int, held binary")
    partial = held.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(order, "anchor long, passage long, lo int, hi int")
    whole = classes.filter("twice").select("anchor", "passage", (-before).alias("lo"), after.alias("hi"))
    marks = partial.unionAll(whole)
    if mixed.filter(F.col("kinds") > hot).limit(1).count():
        # a window's words have one anchor at one place, so equal windows of different passages are occurrences of their own
        windows = fetched.mapInArrow(fetch_windows, "passage long, lo int, window long")
        twice = windows.groupBy("window").agg(F.min("passage").alias("x"), F.max("passage").alias("y")).filter("x <> y")
        shared = windows.join(twice, "window", "left_semi").select("passage", "lo").distinct()
        islands = shared.select("passage", "lo", (F.col("lo") - F.row_number().over(Window.partitionBy("passage").orderBy("lo"))).alias("island"))
        runs = islands.groupBy("passage", "island").agg(F.min("lo").alias("lo"), (F.max("lo") + least).alias("hi"))
        hottest = mixed.filter(F.col("kinds") > hot).select("anchor", "passage")
        marks = marks.unionAll(runs.join(hottest, "passage").select("anchor", "passage", "lo", "hi"))
    spans = found.join(marks, ["anchor", "passage"]).select("id", (F.shiftright("loc", 16) + F.col("lo")).alias("lo"), (F.shiftright("loc", 16) + F.col("hi")).alias("hi")).distinct()
    upto = Window.partitionBy("id").orderBy("lo", "hi")
    before_ = F.max("hi").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before_ >= F.col("lo"), 0).otherwise(1)).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("run", run).groupBy("id", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"))
    return merged.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
