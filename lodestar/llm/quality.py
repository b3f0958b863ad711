"""Operator 6, quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad.  A line's score comes from its own and its neighbours' features; transitions tie
neighbouring lines together.  The forward-backward marginals, weighted by line length, make the quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkit
from lodestar.llm.common import column, picked, reachable, slices, stored

BUCKETS = 1 << 16
_CLASSES = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 symbol, 4 other than ASCII
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-?\"()"]] = 3
_CLASSES[128:] = 4


@dataclass
class Lines:
    """first: of text i, lines first[i]:first[i + 1]; size: bytes; dense: features; word: of line j, buckets word[j]:word[j + 1]."""

    first: np.ndarray
    size: np.ndarray
    dense: np.ndarray
    word: np.ndarray
    buckets: np.ndarray


def read_lines(col: pa.Array) -> Lines:
    """Features of every line that has a word; lines end at LF."""
    w = textkit.words(col)
    texts = len(w.offsets) - 1
    if not len(w.start):
        return Lines(np.zeros(texts + 1, np.int64), np.zeros(0), np.zeros((0, 22)), np.zeros(1, np.int64), np.zeros(0, np.int64))
    breaks = np.flatnonzero(w.raw == 10)
    own = np.searchsorted(w.offsets, w.start, side="right") - 1
    line = np.searchsorted(breaks, w.start)
    new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
    word = np.append(new, len(w.start))
    left, right = w.start[new], w.end[word[1:] - 1]
    size = (right - left).astype(float)
    count = np.diff(word).astype(float)
    kind = _CLASSES[w.raw]
    shares = []
    for k in (1, 2, 3, 4):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        shares.append((total[right] - total[left]) / size)
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])]), dtype=np.int64)])
    distinct = np.array([len(np.unique(w.hash[a:b])) / max(1, b - a) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])
    doc = own[new]
    ends = np.isin(w.raw[right - 1], np.frombuffer(b".!?", np.uint8))
    dense = np.stack(
        [np.ones(len(new)), np.log1p(count), *shares, np.minimum(size / count / 10, 3), ends.astype(float), (same[word[1:]] - same[word[:-1]]) / count, distinct[doc], np.log1p(w.first[doc + 1] - w.first[doc])], axis=1
    )
    before, after = np.zeros_like(dense), np.zeros_like(dense)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = dense[:-1][joined]
    after[:-1][joined] = dense[1:][joined]
    near = [0, 2, 4, 7, 8, 9]
    dense = np.concatenate([dense, before[:, near[:5]], after[:, near]], axis=1)
    return Lines(np.searchsorted(doc, np.arange(texts + 1)), size, dense, word, (w.hash >> np.uint64(48)).astype(np.int64))


def read_all_lines(col: pa.Array) -> Lines:
    """read_lines of a column of any size, read piece by piece to bound the memory."""
    parts = [read_lines(column(b, "text")) for b in slices(pa.RecordBatch.from_arrays([col], names=["text"]), "text")] or [read_lines(col)]
    first, word = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for p in parts:
        first.append(p.first[1:] + first[-1][-1])
        word.append(p.word[1:] + word[-1][-1])
    size, dense, buckets = (np.concatenate([getattr(p, name) for p in parts]) for name in ("size", "dense", "buckets"))
    return Lines(np.concatenate(first), size, dense, np.concatenate(word), buckets)


@dataclass
class Model:
    """dense, words: weights of a good line's score; steps: log weights of [bad, good] -> [bad, good]; a document from `threshold` on is kept."""

    dense: np.ndarray
    words: np.ndarray
    steps: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float = 0.5

    def scores(self, x: Lines) -> np.ndarray:
        out = ((x.dense - self.mean) / self.spread) @ self.dense
        if len(x.buckets):
            out = out + np.add.reduceat(self.words[x.buckets], x.word[:-1])
        return out


def forward_backward(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, expected number of each transition), all chains at once."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, length = first[:-1][order], count[order]
    good = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    emit = np.stack([1 - good, good], axis=1)
    move = np.exp(steps - steps.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    most = int(length.max(initial=0))
    live = np.searchsorted(-length, -np.arange(1, most + 2), side="right")  # chains of more than t lines
    for t in range(most):
        at = start[: live[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        at = start[: live[t + 1]] + t
        ahead = emit[at + 1] * beta[at + 1]
        b = ahead @ move.T
        joint = alpha[at][:, :, None] * move * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1) if len(p) else np.zeros(0), pairs


def document_quality(model: Model, x: Lines) -> np.ndarray:
    """Share of a document's bytes expected to be in good lines; 0 without lines."""
    good, _ = forward_backward(model.scores(x), x.first, model.steps)
    held = np.concatenate([[0], np.cumsum(x.size)])
    won = np.concatenate([[0], np.cumsum(x.size * good)])
    total = held[x.first[1:]] - held[x.first[:-1]]
    return np.where(total > 0, (won[x.first[1:]] - won[x.first[:-1]]) / np.maximum(total, 1), 0.0)


def fit(texts: pa.Array, good: np.ndarray, epochs: int = 120, rate: float = 0.3, sparsity: float = 1e-4, least_docs: int = 10, keep: float = 0.985) -> Model:
    """Maximum likelihood by AdaGrad; every line has its document's label.

    Word buckets seen in fewer than least_docs texts have no weight, and `sparsity` is the L1 penalty on the others.  The threshold is the one that best separates
    the texts among those that keep at least the share `keep` of the good ones.
    """
    x = read_all_lines(texts)
    doc = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    y = good[doc].astype(float)
    mean, spread = x.dense.mean(axis=0), x.dense.std(axis=0)
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-9] = 1
    model = Model(np.zeros(x.dense.shape[1]), np.zeros(BUCKETS), np.zeros((2, 2)), mean, spread)
    z = (x.dense - mean) / spread
    owner = np.repeat(np.arange(len(y)), np.diff(x.word))
    seen = np.unique(doc[owner] * BUCKETS + x.buckets) % BUCKETS
    usable = np.bincount(seen, minlength=BUCKETS) >= least_docs
    live = usable[x.buckets]
    owner, buckets = owner[live], x.buckets[live]
    step_counts = np.zeros((2, 2))
    joined = doc[1:] == doc[:-1]
    np.add.at(step_counts, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)
    squares = [np.full_like(p, 1e-6) for p in (model.dense, model.words, model.steps)]
    n = max(1, len(y))
    for _ in range(epochs):
        s = z @ model.dense + np.bincount(owner, weights=model.words[buckets], minlength=len(y))
        p, pairs = forward_backward(s, x.first, model.steps)
        off = (y - p) / n
        grads = [off @ z, np.bincount(buckets, weights=off[owner], minlength=BUCKETS), (step_counts - pairs) / n]
        for w, g, q in zip((model.dense, model.words, model.steps), grads, squares, strict=True):
            q += g * g
            w += rate * g / np.sqrt(q)
        shrunk = np.abs(model.words) - sparsity * rate / np.sqrt(squares[1])
        model.words = np.sign(model.words) * np.maximum(shrunk, 0)
        model.steps.clip(-4, 4, out=model.steps)
    q = document_quality(model, x)
    some = np.diff(x.first) > 0
    q, label = q[some], good[some]
    best = (-1.0, 0.5)
    for t in np.unique(np.quantile(q, np.linspace(0, 1, 200))) if len(q) else []:
        held = float((q[label] >= t).mean())
        if held >= keep:
            best = max(best, (held + float((q[~label] < t).mean()), float(t)))
    model.threshold = best[1]
    return model


def labelled(docs: DataFrame, labels: DataFrame, bound: int, reject_toxic: bool, bytes_bound: int) -> tuple[pa.Array, np.ndarray]:
    """(texts, good) of at most `bound` labelled documents of `bytes_bound` bytes together, those of the smallest hashes of ids; docs has id and text."""
    rows = labels.select(F.col("`doc_id`").cast("long").alias("id"), F.col("`quality`").cast("int").alias("quality"), F.col("`toxic`").cast("int").alias("toxic"))
    rows = rows.filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    bad = F.col("quality") < 1
    if reject_toxic:
        bad = bad | (F.col("toxic") > 0)
    sample = rows.withColumn("good", ~bad).orderBy(F.xxhash64("id"), "id").limit(bound).select("id", "good")
    found = docs.filter("text is not null").join(F.broadcast(sample), "id").select("id", "text", "good").groupBy("id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    found = stored(found)
    sizes = found.select("id", F.xxhash64("id").alias("h"), F.octet_length("text").alias("n")).toPandas().sort_values(["h", "id"])  # `bound` rows at most
    if sizes["n"].sum() > bytes_bound:
        few = sizes.loc[sizes["n"].cumsum() <= bytes_bound, ["id"]]
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(few.to_numpy().tolist(), "id long")), "id", "left_semi")
    table = found.toArrow().sort_by("id")
    return table.column("text").combine_chunks() if len(table) else pa.array([], pa.string()), table.column("good").to_numpy().astype(bool)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 8000, reject_toxic: bool = True, bytes_bound: int = 64 << 20) -> Model | None:
    """A model fitted on at most `bound` labelled documents of `bytes_bound` bytes together; None if they aren't of both kinds."""
    base = picked(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    texts, good = labelled(base, labels, bound, reject_toxic, bytes_bound)
    return fit(texts, good) if good.any() and not good.all() else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality, keep) of every row, ids as they are."""
    base = picked(docs, id=id_col, text=text_col)
    if model is None:
        return base.select(F.col("id").alias("doc_id"), F.lit(None).cast("double").alias("quality"), F.lit(True).alias("keep"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                q = document_quality(model, read_lines(column(batch, "text")))
                ids = column(batch, "id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.round(q, 6)), pa.array(q >= model.threshold)], names=["doc_id", "quality", "keep"])

    return base.mapInArrow(run, f"doc_id {kind}, quality double, keep boolean")


def kept_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the model keeps."""
    if model is None:
        return docs
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(document_quality(model, read_lines(column(batch, text_col))) >= model.threshold))

    return docs.mapInArrow(run, docs.schema)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 8000, reject_toxic: bool = True) -> DataFrame:
    """(doc_id, quality) of each row that the classifier keeps; quality in [0, 1], rounded to 6 digits.

    labels has doc_id, quality (below 1: bad) and toxic (with reject_toxic, above 0: bad as well).  The field is
    fitted on at most `bound` labelled documents, and 64 MB of them; every document, however long, is then scored on its whole text.
    Of equal qualities none goes before another: each row is held against the threshold alone.
    A null or empty text, or one without a word, has quality 0 and is rejected.  Null ids are scored as any other row; repeated
    rows stay repeated.  Labels with a null doc_id or quality are left out, a null toxic counts as 0, and of several labels of a
    document the worst counts.  Without labels of both kinds nothing can be learned: all rows are kept, with a null quality.
    Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, bound, reject_toxic)
    return score(docs, model, id_col, text_col).filter("keep").select("doc_id", "quality")
