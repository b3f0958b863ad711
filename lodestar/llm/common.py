"""What the operators share: stored tables, batch slicing, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import textkit
from lodestar.storage import fresh_dir, stored

__all__ = ["column", "components", "content_key", "contract", "forest", "free_name", "fresh_dir", "load", "picked", "reachable", "slices", "stored"]

#: Bytes of text that one vectorised step works on; bounds memory, has no effect on results.
CHUNK_BYTES = 1 << 20


ROOT = str(Path(__file__).resolve().parents[2])


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text; a longer text is a piece of its own."""
    _, off = textkit.buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reachable(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only these columns, under these names: what else the table has can't clash."""
    reachable(df.sparkSession)
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes for df not to have such a column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def content_key(text: Column) -> list[Column]:
    """128 bits of a text, as two longs; collisions are negligible below 10**15 texts."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges that aren't the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) replaced, partition by partition, by as few edges that connect the same nodes."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(local, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Local contraction, then alternating large-star and small-star steps, each written
    to the shared folder.  Nulls must not occur; loops are ignored, no edges give no rows.
    Steps are taken until none changes anything; their number grows as the logarithm of the longest path.
    """
    work = stored(contract(edges.filter("a <> b")).distinct())
    before = None
    while True:
        both = work.unionAll(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        work = stored(small.filter("a <> b").distinct())
        now = work.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = work.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return work.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


