"""Structured Streaming: ordered deltas, live file state, notifications, expiry, early cut-off."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lodestar.operators.ingest import index_changed, latest
from lodestar.storage import exists, names, remove

CHANGES = "client string, seq long, action string, uri string, content_hash string"
LIVE = "uri string, content_hash string, client string, seq long, deleted boolean"


def read_deltas(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of changes from JSON lines, with `arrived`, when and in which file each came; files_per_trigger bounds a batch, nothing is dropped."""
    reader = spark.readStream.schema(CHANGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start").alias("arrived"))


def watch_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (uri, text, mtime_ms) of files that come below a folder; see ingest.listing_changes for files that change where they are."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return reader.load(path).select(uri.alias("uri"), F.decode("content", "UTF-8").alias("text"), F.unix_millis("modificationTime").alias("mtime_ms"))


def arrivals(batch: DataFrame) -> DataFrame:
    """The changes of a batch in the order in which they came, as `place`: by `arrived` if there is such a column, and by row.

    Of rows of one (client, seq) the first counts.
    """
    rows = batch.withColumn("row_", F.monotonically_increasing_id())
    place = F.struct(*(["arrived", "row_"] if "arrived" in batch.columns else ["row_"]))
    first = Window.partitionBy("client", "seq").orderBy("place")
    return rows.withColumn("place", place).withColumn("rn_", F.row_number().over(first)).filter("rn_ = 1").drop("rn_", "row_")


def fold(changes: DataFrame) -> DataFrame:
    """The last change of each uri: of one client by seq, of several clients by arrival."""
    of_client = latest(changes, ["uri", "client"], [F.desc("seq")])
    return latest(of_client, ["uri"], [F.desc("place")]).drop("place")


class LiveFiles:
    """The live files in a folder, with tombstones of the deleted, divided by hash into `buckets`; a batch rewrites those buckets that it touches.

    Sequence numbers are a client's own: a change counts once, and not after a later one of its client; clients are ordered by
    arrival.  A manifest per batch says which batch holds each bucket, so that a batch that runs twice gives the same; what neither of
    the last two manifests needs is removed.  acks (client, seq) and notices (source_session, indexed_files, affected_uris) come
    with each batch.  The folder may be on any file system that Hadoop knows.
    """

    def __init__(self, spark: SparkSession, path: str, on_change: Callable[[DataFrame, int], None] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.on_change, self.buckets = spark, path.rstrip("/"), on_change, buckets

    def _batch(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/batch={number}"

    def last(self, before: int | None = None) -> int | None:
        done = [int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/manifest") if n.startswith("batch=") and exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return max((n for n in done if before is None or n < before), default=None)

    def _manifest(self, number: int | None) -> dict[int, int]:
        """The batch that holds each bucket: at most `buckets` entries."""
        if number is None:
            return {}
        line = self.spark.read.text(self._batch("manifest", number)).first()[0]
        return {int(k): v for k, v in json.loads(line).items()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self._batch('files', n)}/bucket={b}" for b, n in sorted(held.items())]
        return self.spark.read.schema(LIVE).parquet(*paths) if paths else self.spark.createDataFrame([], LIVE)

    def read(self, before: int | None = None) -> DataFrame:
        """(uri, content_hash, seq) of the files that aren't deleted."""
        return self._rows(self._manifest(self.last(before))).filter("not deleted").select("uri", "content_hash", "seq")

    def merge(self, batch: DataFrame, number: int) -> None:
        before = self.last(before=number)
        done = self.spark.read.schema("client string, seq long").parquet(self._batch("acks", before)) if before is not None else self.spark.createDataFrame([], "client string, seq long")
        fresh = arrivals(batch).join(done.withColumnRenamed("seq", "done"), "client", "left").filter("done is null or seq > done").drop("done").persist()
        bucket = F.pmod(F.xxhash64("uri"), F.lit(self.buckets)).cast("int")
        change = fold(fresh).select("uri", "content_hash", "client", "seq", (F.col("action") == "delete").alias("deleted"), bucket.alias("bucket"))
        touched = [r[0] for r in change.select("bucket").distinct().collect()]  # at most `buckets`
        held = self._manifest(before)
        kept = self._rows({b: n for b, n in held.items() if b in touched}).withColumn("bucket", bucket).join(change.select("uri"), "uri", "left_anti")
        kept.unionByName(change).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._batch("files", number))
        now = held | dict.fromkeys(touched, number)
        acks = done.unionByName(fresh.select("client", "seq")).groupBy("client").agg(F.max("seq").alias("seq"))
        acks.write.mode("overwrite").parquet(self._batch("acks", number))
        total = self._rows(now).filter("not deleted").count()
        index_changed(fresh, None, total).write.mode("overwrite").parquet(self._batch("notices", number))
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(self._batch("manifest", number))
        if self.on_change:
            self.on_change(change, number)
        fresh.unpersist()
        self._prune(now, held, number, before)

    def _prune(self, now: dict[int, int], held: dict[int, int], number: int, before: int | None) -> None:
        for b, n in held.items():  # replaced in the batch before: nobody reads it any more
            if before is not None and now[b] == number and n < before:
                remove(self.spark, f"{self._batch('files', n)}/bucket={b}")
        for name in ("acks", "manifest"):
            for n in names(self.spark, f"{self.path}/{name}"):
                if n.startswith("batch=") and before is not None and int(n.split("=")[1]) < before:
                    remove(self.spark, f"{self.path}/{name}/{n}")

    def notices_for(self, me: str) -> DataFrame:
        """What other sessions changed."""
        return self.spark.read.parquet(f"{self.path}/notices").filter(F.col("source_session") != me)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_state(stream: DataFrame) -> DataFrame:
    """(uri, action, seq, content_hash): a row whenever a file's latest state changes, kept as keyed state.

    The state is the last seq of each client that changed the file; it outlives a delete, so that what came late can't revive the file.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        if "arrived" in rows.columns:
            rows = rows.assign(at=rows["arrived"].map(lambda a: tuple(a.values()) if isinstance(a, dict) else tuple(a))).sort_values("at", kind="stable")
        final = None
        for row in rows.itertuples(index=False):
            client = str(row.client)
            if row.seq > done.get(client, -1):
                done[client] = int(row.seq)
                final = row
        if final is not None:
            state.update((json.dumps(done),))
            yield pd.DataFrame({"uri": [key[0]], "action": [final.action], "seq": [int(final.seq)], "content_hash": [final.content_hash]})

    return stream.groupBy("uri").applyInPandasWithState(update, "uri string, action string, seq long, content_hash string", "done string", "update", GroupStateTimeout.NoTimeout)


def upgrades_only(stream: DataFrame, symbols: DataFrame) -> DataFrame:
    """Upgrades (uri, confidence_score) above what a symbol has."""
    held = symbols.select("uri", F.col("confidence_score").alias("old_confidence"))
    return stream.join(held, "uri").filter(F.col("confidence_score") > F.col("old_confidence")).select("uri", "old_confidence", F.col("confidence_score").alias("new_confidence"))


def live_annotations(stream: DataFrame, as_of_ms: int) -> DataFrame:
    """Annotations that haven't expired when they are read."""
    return stream.filter((F.col("expires_ms") == 0) | (F.col("expires_ms") >= as_of_ms))


def windowed_counts(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): events in tumbling windows, with late ones dropped."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")
