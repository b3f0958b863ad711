"""Ingest: deltas, extraction of changed files, journals, slices, listings and provenance, as folds and set operations on relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar import schemas
from lodestar.functions import scalars as S
from lodestar.operators.relations import backfill_translate
from lodestar.sources import extract
from lodestar.storage import exists, stored
from lodestar.workspace import Workspace

COMPACT_THRESHOLD = 500


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(last)).filter("rn_ = 1").drop("rn_")


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """Live files after deltas (uri, seq, action, ...): the last of each uri, unless it deletes."""
    return latest(deltas, ["uri"], [F.desc("seq")]).filter("action <> 'delete'")


def _replaced(ws: Workspace, changed: DataFrame, files: DataFrame, symbols: DataFrame, occurrences: DataFrame, edges: DataFrame) -> Workspace:
    """The workspace with these rows in place of those of the changed files (file_uri), which lose their vectors."""
    by_uri = F.col("uri") == F.col("file_uri")

    def swap(held: DataFrame, fresh: DataFrame) -> DataFrame:
        return held.join(changed, "file_uri", "left_anti").unionByName(fresh, allowMissingColumns=True)

    return ws.with_(
        files=ws.files.join(changed, by_uri, "left_anti").unionByName(files, allowMissingColumns=True),
        symbols=swap(ws.symbols, symbols),
        occurrences=swap(ws.occurrences, occurrences),
        edges=swap(ws.edges, edges),
        embeddings=ws.embeddings.join(changed, by_uri, "left_anti"),
    )


def apply_delta(ws: Workspace, deltas: DataFrame) -> Workspace:
    """The workspace after deltas (seq, action, document of schemas.DELTAS): rows of changed files are replaced, annotations stay.

    A document with symbols is taken as it is; one with a text alone is extracted anew, and a document with symbols and a
    text but without edges has its call edges made from the text, with the names of its symbols (see backfill_edges).
    A changed file loses its vector; of two deltas of a file the later one counts.
    """
    rows = deltas.select("seq", "action", "document.*")
    last = stored(latest(rows, ["uri"], [F.desc("seq")]))
    changed, kept = last.select(F.col("uri").alias("file_uri")), last.filter("action <> 'delete'")
    language = S.detect_language(F.col("uri"), F.col("language"))
    given = F.size(F.coalesce("symbols", F.array())) > 0
    files = kept.select(
        "uri", F.col("source_text").alias("text"), language.alias("language"), F.col("seq").alias("revision"),
        (F.col("source_text").isNull() | given).alias("precomputed"), F.coalesce(F.sha2("source_text", 256), "content_hash").alias("content_hash"),
    )
    files = files.withColumn("indexed_at_ms", F.lit(ws.as_of_ms))
    texts = kept.filter("source_text is not null").select("uri", F.col("source_text").alias("text"), language.alias("language"), given.alias("given"), (F.size(F.coalesce("edges", F.array())) > 0).alias("linked"))
    indexed = stored(extract.index_files(texts.filter("not (given and linked)")))
    new = indexed.join(texts.filter("not given").select("uri"), "uri", "left_semi")
    missing = texts.filter("given and not linked").select("uri")

    def of(field: str) -> DataFrame:
        sent = kept.filter(given).select(F.col("uri").alias("file_uri"), F.posexplode(field).alias("ordinal", "x")).select("file_uri", F.col("ordinal").cast("long").alias("ordinal"), "x.*")
        made = extract.relation(new, field)
        return sent.unionByName(made.select(*[c for c in made.columns if c in sent.columns or c in getattr(ws, field).columns]), allowMissingColumns=True)

    symbols = of("symbols")
    after = ws.symbols.join(changed, "file_uri", "left_anti").unionByName(symbols, allowMissingColumns=True).select("file_uri", "uri", "display_name", "ordinal")
    raw = extract.relation(indexed.join(missing, "uri", "left_semi"), "edges")
    return _replaced(ws, changed, files, symbols, of("occurrences"), of("edges").unionByName(backfill_edges(raw, after), allowMissingColumns=True))


def backfill_edges(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges (file_uri, from_uri, to_uri, kind, ordinal) extracted from text, their ends named as imported symbols (file_uri, uri, display_name, ordinal) are.

    An end becomes the first symbol of the file with its name, by display name or the URI's last part, else the only symbol of all
    whose URI ends so; otherwise it stays.
    """
    names = symbols.select("file_uri", "uri", "ordinal", F.explode(F.array_distinct(F.array("display_name", S.extract_name(F.col("uri"))))).alias("name")).filter("name <> ''")
    ends = raw.select("file_uri", F.explode(F.array("from_uri", "to_uri")).alias("end")).distinct().withColumn("name", S.extract_name(F.col("end")))
    anywhere = symbols.select(S.extract_name(F.col("uri")).alias("name"), "uri").distinct()
    found = backfill_translate(ends.select("file_uri", "name").distinct(), names, anywhere)
    named = ends.join(found, ["file_uri", "name"], "left").select("file_uri", "end", F.coalesce("uri", "end").alias("as_"))
    one = raw.join(named.select("file_uri", F.col("end").alias("from_uri"), F.col("as_").alias("from_")), ["file_uri", "from_uri"])
    both = one.join(named.select("file_uri", F.col("end").alias("to_uri"), F.col("as_").alias("to_")), ["file_uri", "to_uri"])
    return both.select("file_uri", F.col("from_").alias("from_uri"), F.col("to_").alias("to_uri"), "kind", "ordinal")


def upsert_files(ws: Workspace, files: DataFrame) -> Workspace:
    """The workspace with files (uri, text, language) extracted anew, one row of each uri; their revision goes up by 1."""
    rows = stored(files.select("uri", "text", S.detect_language(F.col("uri"), F.col("language")).alias("language")).filter("text is not null").dropDuplicates(["uri"]))
    held = ws.files.select("uri", F.col("revision").alias("held"))
    out = rows.join(held, "uri", "left").select(
        "uri", "text", "language", (F.coalesce("held", F.lit(0)) + 1).cast("long").alias("revision"), F.lit(False).alias("precomputed"), F.sha2("text", 256).alias("content_hash"), F.lit(ws.as_of_ms).alias("indexed_at_ms")
    )
    indexed = stored(extract.index_files(rows))
    found = {n: extract.relation(indexed, n) for n in ("symbols", "occurrences", "edges")}
    found["symbols"] = found["symbols"].drop("line", "char")
    return _replaced(ws, rows.select(F.col("uri").alias("file_uri")), out, **found)


def remove_call_edges(ws: Workspace, uris: DataFrame) -> Workspace:
    """Without the call edges that come from these files."""
    return ws.with_(edges=ws.edges.join(uris.select(F.col("uri").alias("file_uri")), "file_uri", "left_anti"))


def remove_files(ws: Workspace, uris: DataFrame) -> Workspace:
    """Without these files' rows; annotations survive."""
    gone = uris.select(F.col("uri").alias("file_uri"))
    by_uri = F.col("uri") == F.col("file_uri")
    return ws.with_(
        files=ws.files.join(gone, by_uri, "left_anti"),
        symbols=ws.symbols.join(gone, "file_uri", "left_anti"),
        occurrences=ws.occurrences.join(gone, "file_uri", "left_anti"),
        edges=ws.edges.join(gone, "file_uri", "left_anti"),
        embeddings=ws.embeddings.join(gone, by_uri, "left_anti"),
    )


# journal


def journal_append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def journal_open(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a journal; lines that aren't JSON or have no op are skipped."""
    rows = spark.read.schema(schemas.JOURNAL + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record is null and op is not null").drop("_corrupt_record")


def journal_replay(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live files, annotations) after all entries in order."""
    files = latest(entries.filter("op in ('upsert_file', 'remove_file')"), ["uri"], [F.desc("seq")]).filter("op = 'upsert_file'")
    notes = latest(entries.filter("op = 'annotation_set'"), ["symbol_uri", "key"], [F.desc("seq")])
    return (
        files.select("uri", "content_hash", "language", "source_text", "seq"),
        notes.select("symbol_uri", "key", "value", "author_id", "confidence", "timestamp_ms", "expires_ms"),
    )


def journal_compact(spark: SparkSession, path: str, snapshot: str, as_of_ms: int) -> None:
    """Writes what the journal amounts to as a new journal: one entry per live file and live annotation."""
    entries = journal_open(spark, path)
    files, notes = journal_replay(entries)
    live = notes.filter(S.not_expired(as_of_ms))
    out = files.withColumn("op", F.lit("upsert_file")).unionByName(live.withColumn("op", F.lit("annotation_set")), allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("op", F.coalesce("uri", "symbol_uri")).orderBy("key"))
    out.withColumn("seq", F.coalesce("seq", order.cast("long"))).write.mode("errorifexists").json(snapshot)


# event streams


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Deltas of event-stream envelopes, one JSON object per line."""
    rows = spark.read.schema(schemas.EVENT_STREAM).json(path)
    return rows.filter("schema_version = 1").select(F.explode("deltas").alias("d")).select("d.*")


def write_event_stream(deltas: DataFrame, path: str, emitter: str, timestamp_ms: int, span: int = 1000) -> None:
    """Writes deltas as envelopes, each of one client and of sequence numbers within one `span`."""
    rows = deltas.withColumn("part_", F.floor(F.col("seq") / span))
    one = rows.groupBy("client", "part_").agg(F.sort_array(F.collect_list(F.struct("seq", "action", "document"))).alias("deltas"))
    out = F.transform("deltas", lambda d: F.struct(F.col("client").alias("client"), d["seq"].alias("seq"), d["action"].alias("action"), d["document"].alias("document")))
    one.select(F.lit(1).alias("schema_version"), F.lit(emitter).alias("emitter_id"), F.lit(timestamp_ms).alias("timestamp_ms"), out.alias("deltas")).write.mode("append").json(path)


# listings of what is on disk


def scan_directory(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(uri, text, language, content_hash, mtime_ms) of the files below a folder in known languages."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    lang = S.detect_language(uri, F.lit(language) if language else None)
    out = rows.select(uri.alias("uri"), F.decode("content", "UTF-8").alias("text"), lang.alias("language"), F.sha2("content", 256).alias("content_hash"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return out.filter("language <> 'unknown'")


def reindex_files(ws: Workspace, uris: DataFrame, listing: DataFrame) -> Workspace:
    """The workspace with the named files, and all that is derived from them, as the listing (uri, text, language) has them; what it lacks is skipped."""
    return upsert_files(ws, listing.join(uris.select("uri").distinct(), "uri", "left_semi"))


def stale_actions(ws: Workspace, uris: DataFrame, max_age_seconds: int) -> DataFrame:
    """(uri, action): reindexed where a file is unknown or older than the age, else skipped."""
    rows = uris.select("uri").join(ws.files.select("uri", "indexed_at_ms"), "uri", "left")
    age = S.age_seconds(F.col("indexed_at_ms"), ws.as_of_ms)
    return rows.select("uri", F.when(age.isNull() | (age > max_age_seconds), "reindexed").otherwise("skipped").alias("action"))


def reindex_stale(ws: Workspace, uris: DataFrame, max_age_seconds: int, listing: DataFrame) -> tuple[Workspace, DataFrame]:
    """(the workspace with stale files as the listing has them, what was done with each uri: reindexed or skipped)."""
    actions = stale_actions(ws, uris, max_age_seconds)
    return reindex_files(ws, actions.filter("action = 'reindexed'"), listing), actions


def listing_changes(ws: Workspace, listing: DataFrame) -> DataFrame:
    """(uri, action) of what a listing (uri, content_hash) has that the index lacks or holds otherwise (upsert), and the reverse (delete)."""
    held = ws.files.select("uri", F.col("content_hash").alias("held"), F.lit(True).alias("known"))
    rows = listing.select("uri", "content_hash", F.lit(True).alias("there")).join(held, "uri", "full_outer")
    action = F.when(F.col("there").isNull(), "delete").when(F.col("known").isNull() | ~F.col("held").eqNullSafe(F.col("content_hash")), "upsert")
    return rows.select("uri", action.alias("action")).filter("action is not null")


def deleted_files(ws: Workspace, listing: DataFrame) -> DataFrame:
    """(uri) of the files that the listing lacks."""
    return ws.files.join(listing, "uri", "left_anti").select("uri")


def prune_deleted(ws: Workspace, listing: DataFrame) -> tuple[Workspace, DataFrame]:
    """(the workspace without the files that the listing lacks, one row of how many were checked and removed)."""
    gone = deleted_files(ws, listing)
    counts = ws.files.agg(F.count("*").alias("checked")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("removed"))))  # one row each
    return remove_files(ws, gone), counts


# packages


def build_slices(symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """Slice symbols of packages (manager, package_name, version, directory): those of files below its folder, at confidence 100."""
    key = F.concat("manager", F.lit(":"), "package_name", F.lit("@"), "version")
    rows = symbols.join(packages, F.col("file_uri").startswith(F.concat(F.lit("file://"), F.regexp_replace("directory", "/*$", "/"))))
    out = rows.select(
        "manager", "package_name", "version", F.sha2(key, 256).alias("package_hash"),
        F.concat(F.lit("lip://"), "manager", F.lit("/"), "package_name", F.lit("@"), "version", F.lit("/"), F.substring_index("file_uri", "/", -1), F.lit("#"), S.extract_name(F.col("uri"))).alias("uri"),
        "display_name", "kind", "signature", F.lit(100).alias("confidence_score"),
    )
    hashes = out.groupBy("manager", "package_name", "version").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "uri", "kind", F.coalesce("signature", F.lit(""))))), "\n"), 256).alias("content_hash"))
    return out.join(hashes, ["manager", "package_name", "version"])


def mount_slice(slice_symbols: DataFrame, new: DataFrame) -> DataFrame:
    """Mounted symbols after a slice: it replaces its package of the same manager and name, at confidence 100. Idempotent."""
    packages = new.select("manager", "package_name").distinct()
    kept = slice_symbols.join(packages, ["manager", "package_name"], "left_anti")
    return kept.unionByName(new.dropDuplicates(["manager", "package_name", "version", "uri"]).withColumn("confidence_score", F.lit(100)), allowMissingColumns=True)


def slice_definitions(slice_symbols: DataFrame) -> DataFrame:
    """Where mounted symbols are defined: at the beginning of what their URI names."""
    return slice_symbols.select(F.col("uri").alias("symbol_uri"), F.substring_index("uri", "#", 1).alias("def_file"), F.lit(0).alias("def_line"), F.lit(0).alias("def_char"))


def mounted_package_count(slice_symbols: DataFrame) -> DataFrame:
    return slice_symbols.select("manager", "package_name").distinct().agg(F.count("*").alias("packages"))


class SliceCache:
    """Slices in a folder, of any file system that Hadoop knows, by the hash of their symbols; a registry is one that several caches share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def insert(self, symbols: DataFrame, content_hash: str) -> None:
        held = symbols.select("content_hash").distinct().take(2)
        if [r[0] for r in held] != [content_hash]:
            raise ValueError("the slice isn't what its hash says")
        symbols.write.mode("overwrite").parquet(f"{self.path}/{content_hash}")

    def get(self, content_hash: str) -> DataFrame | None:
        if not is_slice_hash(content_hash) or not exists(self.spark, f"{self.path}/{content_hash}/_SUCCESS"):
            return None
        return self.spark.read.parquet(f"{self.path}/{content_hash}")

    def push(self, content_hash: str, registry: SliceCache) -> bool:
        """Copies a slice to a registry; whether this cache has it."""
        held = self.get(content_hash)
        if held is not None:
            registry.insert(held, content_hash)
        return held is not None

    def fetch(self, content_hash: str, registry: SliceCache) -> DataFrame | None:
        """The slice, from a registry if this cache lacks it; None if neither has it."""
        if self.get(content_hash) is None and not registry.push(content_hash, self):
            return None
        return self.get(content_hash)


def is_slice_hash(text: str) -> bool:
    return len(text) == 64 and all(c in "0123456789abcdefABCDEF" for c in text)


def register_project_root(roots: DataFrame, new: DataFrame) -> DataFrame:
    return roots.unionByName(new.select(S.normalise_root(F.col("root")).alias("root"))).filter("root <> ''").distinct()


def source_id(tool: Column, root: Column) -> Column:
    return F.sha2(F.concat(tool, F.lit(":"), root), 256)


def register_tier3_source(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Provenance by source_id; of two the later import counts."""
    return latest(sources.unionByName(new), ["source_id"], [F.desc("imported_at_ms"), F.desc("tool_version")])


def index_changed(batch: DataFrame, me: str | None, indexed_files: int | DataFrame) -> DataFrame:
    """(source_session, indexed_files, affected_uris) for the upserts of each session other than me; indexed_files is the number of files in the index, or one row of it."""
    upserts = batch.filter("action = 'upsert'")
    sums = upserts.groupBy(F.col("client").alias("source_session")).agg(F.array_join(F.sort_array(F.collect_set("uri")), ",").alias("affected_uris"))
    rows = sums if me is None else sums.filter(F.col("source_session") != me)
    if isinstance(indexed_files, int):
        return rows.select("source_session", F.lit(indexed_files).cast("long").alias("indexed_files"), "affected_uris")
    return rows.crossJoin(F.broadcast(indexed_files.select("indexed_files"))).select("source_session", "indexed_files", "affected_uris")  # one row


def classify_embed_error(status: int, body: str) -> str:
    """The error code for an embedding service's answer."""
    low = body.lower()
    if status in (400, 404) and "model" in low:
        return "unknown_model"
    if status in (400, 413, 422):
        return "invalid_request"
    if status in (401, 403):
        return "embedding_not_configured"
    return "internal"


def backoff_seconds(failures: int) -> int | None:
    """How long a verifier waits after so many failures; None once it is given up."""
    return None if failures >= 8 else min(300, 2**failures)


def map_files(files: DataFrame, function: object, schema: str) -> DataFrame:
    """function (uri, text, language) -> rows, over every file, in Python workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for batch in batches:
            for part in extract.text_slices(batch):
                rows = [r for u, t, k in zip(part["uri"], part["text"], part["language"], strict=True) for r in function(u, t or "", k)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("uri", "text", "language").mapInPandas(run, schema)
