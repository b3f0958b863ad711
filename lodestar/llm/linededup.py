"""Operator 9, line dedup: a log-template tree of fixed depth.

A line's leaf is given by its number of tokens and its leading tokens, with tokens that hold a digit
standing for any such token.  In a leaf, lines are generalised to templates, in corpus order, where enough tokens
agree.  Lines of templates that recur across documents are dropped; the first one in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import textkit
from lodestar.llm.common import column, free_name, picked, slices, stored

ANY = np.uint64(0)
#: Lines of fewer tokens than these that are all variable stand for themselves: no constant token tells one from another.
BARE = 3


def parse(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a token: (text, number in its text, where its tokens begin; all tokens' hashes, ANY where they hold a digit; see BARE)."""
    w = textkit.words(col)
    hashes = w.hash.copy()
    digit = (w.raw >= 48) & (w.raw <= 57)
    held = np.concatenate([[0], np.cumsum(digit)])
    hashes[held[w.end] > held[w.start]] = ANY
    breaks = np.flatnonzero(w.raw == 10)
    own = np.searchsorted(w.offsets, w.start, side="right") - 1
    line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, w.offsets[own])
    new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
    first = np.append(new, len(w.hash))
    count = np.diff(first)
    constant = np.concatenate([[0], np.cumsum(hashes != ANY)])
    bare = np.repeat((count < BARE) & (constant[first[1:]] == constant[first[:-1]]), count)
    hashes[bare] = w.hash[bare]
    return own[new], line[new], first, hashes


def lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(id, line, content, leaf) of each line of at least min_tokens tokens; a leaf has lines of one number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own, line, first, hashes = parse(column(batch, "text"))
                count = np.diff(first)
                with np.errstate(over="ignore"):
                    leaf = count.astype(np.uint64)
                    for k in range(depth):
                        at = np.minimum(first[:-1] + k, np.maximum(first[1:] - 1, 0))
                        leaf = textkit.mix(leaf + np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[at] if len(hashes) else leaf)
                    place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
                    power = textkit.powers(int(count.max(initial=0)) + 2)
                    content = textkit.mix(np.add.reduceat(textkit.mix(hashes + np.uint64(1)) * power[place + 1], first[:-1]) if len(count) else leaf)
                keep = count >= min_tokens
                ids = column(batch, "id").take(pa.array(own[keep]))
                arrays = [ids, *(pa.array(x[keep].astype(np.uint64).view(np.int64)) for x in (line, content, textkit.mix(leaf)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "line", "content", "leaf"])

    return docs.mapInArrow(run, "id long, line long, content long, leaf long")


def grow(tokens: list[np.ndarray], similarity: float) -> list[int]:
    """The template, by the number of the line that began it, of each line of a leaf, in order.

    A line joins the template with which most tokens agree (the earliest of several), if that is at least the share
    `similarity` of them, and each token that differs becomes ANY; else it begins a template.
    """
    if not tokens:
        return []
    table, begun, out = np.empty((16, len(tokens[0])), np.uint64), [], []
    for i, line in enumerate(tokens):
        if begun:
            agree = (table[: len(begun)] == line).sum(axis=1)
            k = int(agree.argmax())
            if agree[k] >= similarity * len(line):
                table[k][table[k] != line] = ANY
                out.append(begun[k])
                continue
        if len(begun) == len(table):
            table = np.concatenate([table, np.empty_like(table)])
        table[len(begun)] = line
        begun.append(i)
        out.append(i)
    return out


def recurring(docs: DataFrame, depth: int = 2, similarity: float = 0.8, min_docs: int = 3, min_tokens: int = 1, broadcast_lines: int = 1_000_000) -> DataFrame:
    """(id, line, template, first_id, first_line) of each line whose template at least min_docs documents hold; docs has id and text.

    Up to `broadcast_lines` lines of open leaves (one per distinct content) are broadcast to fetch them; beyond, texts are shuffled by id.
    """
    found = stored(lines(docs, depth, min_tokens))
    contents = _counted(found, "content", F.first("leaf").alias("leaf"))
    contents = stored(contents)
    # only leaves of several contents can generalise, and only where enough documents meet
    leaves = contents.groupBy("leaf").agg(F.count("*").alias("many"), F.sum("docs").alias("docs")).filter(f"many > 1 and docs >= {int(min_docs)}")
    open_ = contents.join(leaves.select("leaf"), "leaf", "left_semi").select("content", "leaf", "first.id", "first.line")
    wanted = open_.groupBy("id").agg(F.collect_list(F.struct("line", "content", "leaf")).alias("wanted"))
    wanted = stored(wanted)
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= broadcast_lines
    fetched = docs.join(F.broadcast(wanted) if few else wanted, "id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                own, line, first, hashes = parse(column(batch, "text"))
                at = {(int(o), int(n)): i for i, (o, n) in enumerate(zip(own, line, strict=True))}
                rows = []
                for o, (name, want) in enumerate(zip(column(batch, "id").to_pylist(), column(batch, "wanted").to_pylist(), strict=True)):
                    for x in want:
                        if (i := at.get((o, x["line"]))) is not None:
                            rows.append((x["leaf"], name, x["line"], x["content"], hashes[first[i] : first[i + 1]].tobytes()))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["leaf", "id", "line", "content", "held"])

    held = fetched.select("id", "text", "wanted").mapInArrow(fetch, "leaf long, id long, line long, content long, held binary")

    def templates(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("line", "ascending"), ("content", "ascending")])
        names = table.column("content").to_numpy()
        fresh = np.sort(np.unique(names, return_index=True)[1])  # an id with several texts may give a content twice
        blobs = table.column("held").to_pylist()
        lines_ = [np.frombuffer(blobs[i], np.uint64) for i in fresh]
        size = len(lines_[0]) if lines_ else 0
        same = [i for i, x in enumerate(lines_) if len(x) == size]
        of = grow([lines_[i] for i in same], similarity)
        names = names[fresh][same]
        return pa.table({"content": pa.array(names, pa.int64()), "template": pa.array(names[of] if len(of) else names, pa.int64())})

    grown = held.groupBy("leaf").applyInArrow(templates, "content long, template long").filter("content <> template")
    mapped = stored(grown)
    # a content that too few documents have recurs only as part of a template of several contents
    alone = contents.filter(F.col("docs") >= min_docs).select("content", F.col("content").alias("template")).join(mapped, "content", "left_anti")
    founders = mapped.select(F.col("template").alias("content"), "template").distinct().join(alone, "content", "left_anti")
    named = found.join(mapped.unionByName(founders).unionByName(alone), "content").select("id", "line", "template")
    stats = _counted(named, "template").filter(F.col("docs") >= min_docs)
    return named.join(stats, "template").select("id", "line", "template", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))


def _counted(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, docs, first, ...): in how many ids each key is, and its first (id, line); one shuffle, by key."""
    before = F.lag("id").over(Window.partitionBy(key).orderBy("id", "line"))
    marked = rows.withColumn("fresh", F.when(before == F.col("id"), 0).otherwise(1))
    return marked.groupBy(key).agg(F.sum("fresh").alias("docs"), F.min(F.struct("id", "line")).alias("first"), *more)


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, count_col: str | None = None) -> DataFrame:
    """docs with the lines (id, line) cut from their texts; other rows and columns as they were."""
    own, gone, parts = free_name(docs, "id"), free_name(docs, "gone"), free_name(docs, "parts")
    by = dropped.groupBy(F.col("id").alias(own)).agg(F.collect_set(F.col("line").cast("int")).alias(gone))
    joined = docs.join(by, F.col(f"`{id_col}`").cast("long") == F.col(own), "left")
    joined = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(F.col(f"`{text_col}`"), "\n", -1)))
    # array_except hashes: linear, whatever number of lines goes
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.col(parts)[i]), "\n")
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_col:
        out.append(F.coalesce(F.size(gone), F.lit(0)).alias(count_col))
    return joined.select(*out)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: float) -> DataFrame:
    """(id, line) of the lines that go: recurring ones, but for the first of their template."""
    base = picked(docs, id=id_col, text=text_col).filter("id is not null and text is not null").withColumn("id", F.col("id").cast("long"))
    return recurring(base, **params).filter("id <> first_id or line <> first_line").select("id", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, similarity: float = 0.8, min_docs: int = 3, min_tokens: int = 1) -> DataFrame:
    """(doc_id, text, lines_dropped) of every row: its text without lines whose template recurs.

    Lines end at LF.  A template recurs if lines of at least `min_docs` different ids follow it; its line of the smallest
    (id, number) stays, so that of a group of copies one text stays whole.  Tokens are runs of other than ASCII white space,
    ASCII case folded; a token with an ASCII digit is variable, but not in a line of one or two tokens that all have one.
    Lines of fewer than `min_tokens` tokens are never dropped: by default there are none.  Very long texts and lines are read whole.
    Lines join templates of their leaf in the order of their first (id, number), at `similarity` or more agreeing tokens.
    Null ids and null texts stay as they are and count nowhere.  A text all of whose lines go is ''.  Repeated rows stay
    repeated; an id's texts count as one document and lose the same line numbers.  Other columns are ignored.
    """
    cut = dropped_lines(docs, id_col, text_col, depth=depth, similarity=similarity, min_docs=min_docs, min_tokens=min_tokens)
    only = picked(docs, doc_id=id_col, text=text_col)
    return without_lines(only, cut, "doc_id", "text", "lines_dropped")
