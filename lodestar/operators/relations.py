"""Joins between relations and aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import scalars as S
from lodestar.workspace import Workspace


def reverse_deps(ws: Workspace, file_uris: DataFrame) -> DataFrame:
    """(target, dependent): other files with an occurrence, in any role, of a symbol that the target exports."""
    surface = ws.symbols.filter("is_exported").join(file_uris.select(F.col("uri").alias("file_uri")), "file_uri").select(F.col("file_uri").alias("target"), F.col("uri").alias("symbol_uri"))
    uses = ws.occurrences.select("symbol_uri", F.col("file_uri").alias("dependent")).distinct()
    return uses.join(surface, "symbol_uri").filter("target <> dependent").select("target", "dependent").distinct()


def dead_symbols(ws: Workspace, exclude_exported: bool = False) -> DataFrame:
    """Symbols of files that no occurrence has in the role of a reference."""
    rows = ws.symbols.filter("not is_exported") if exclude_exported else ws.symbols
    used = ws.occurrences.filter("role = 'reference'").select(F.col("symbol_uri").alias("uri"))
    return rows.join(used, "uri", "left_anti").select("file_uri", "uri", "display_name", "kind")


def name_bridge(ws: Workspace) -> DataFrame:
    """(from_uri, to_uri, symbol_uri): edges whose target has the bare name of a symbol under another URI."""
    names = ws.symbols.select(F.col("uri").alias("symbol_uri"), S.callee_name(F.col("uri")).alias("name")).filter("name <> ''")
    calls = ws.edges.select("from_uri", "to_uri", S.callee_name(F.col("to_uri")).alias("name"))
    return calls.join(names, "name").filter("to_uri <> symbol_uri").select("from_uri", "to_uri", "symbol_uri")


def resolve_definition(ws: Workspace, uris: DataFrame) -> DataFrame:
    """(symbol_uri, file_uri): the defining file, else the file its local URI names if that exists; others are dropped."""
    by_symbol = ws.symbols.groupBy(F.col("uri").alias("symbol_uri")).agg(F.max("file_uri").alias("defined_in"))
    by_path = ws.files.select(F.col("uri").alias("path_uri"))
    path = F.concat(F.lit("file://"), F.regexp_replace(F.substring_index("symbol_uri", "#", 1), "^lip://local/", ""))
    rows = uris.select("symbol_uri").distinct().withColumn("path_uri_", F.when(F.col("symbol_uri").startswith("lip://local/"), path))
    rows = rows.join(by_symbol, "symbol_uri", "left").join(by_path, F.col("path_uri_") == F.col("path_uri"), "left")
    return rows.select("symbol_uri", F.coalesce("defined_in", "path_uri").alias("file_uri")).filter("file_uri is not null")


def backfill_translate(raw: DataFrame, in_file: DataFrame, names: DataFrame) -> DataFrame:
    """raw (file_uri, name) with uri: the file's own first definition of the name, else the only one anywhere, else null."""
    own = in_file.groupBy("file_uri", "name").agg(F.min_by("uri", "ordinal").alias("own"))
    unique = names.groupBy("name").agg(F.count("*").alias("n"), F.max("uri").alias("only")).filter("n = 1").select("name", "only")
    return raw.join(own, ["file_uri", "name"], "left").join(unique, "name", "left").select("file_uri", "name", F.coalesce("own", "only").alias("uri"))


def consumed_names(ws: Workspace) -> DataFrame:
    """(file_uri, name): names of symbols that a file refers to and doesn't define."""
    defined = ws.symbols.select("file_uri", F.col("uri").alias("symbol_uri"))
    uses = ws.occurrences.filter("role <> 'definition'").select("file_uri", "symbol_uri").distinct()
    return uses.join(defined, ["file_uri", "symbol_uri"], "left_anti").select("file_uri", S.callee_name(F.col("symbol_uri")).alias("name")).distinct()


def invalidated_files(ws: Workspace, names: DataFrame) -> DataFrame:
    """Files that consume any of the changed names."""
    return consumed_names(ws).join(names, "name", "left_semi").select("file_uri").distinct()


def canonicalize(uris: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, canonical): a relative local URI under the longest root with such a file, else under the longest root.

    Fragments stay; absolute and other URIs, and all without roots, stay as they are.
    """
    rel = F.regexp_replace(F.substring_index("uri", "#", 1), "^lip://local/", "")
    local = uris.withColumn("rel", F.when(F.col("uri").startswith("lip://local/") & ~F.col("uri").startswith("lip://local//"), rel))
    tried = local.filter("rel is not null").crossJoin(F.broadcast(roots.select("root").distinct()))  # a handful of roots
    tried = tried.withColumn("candidate", F.concat(F.lit("lip://local/"), "root", F.lit("/"), "rel"))
    known = files.select(F.col("uri").alias("candidate"), F.lit(1).alias("has")).distinct()
    best = tried.join(known, "candidate", "left").groupBy("uri").agg(F.max_by("candidate", F.struct(F.coalesce("has", F.lit(0)), F.length("root"), "root")).alias("best"))
    tail = F.when(F.contains("uri", F.lit("#")), F.concat(F.lit("#"), F.regexp_replace("uri", "^[^#]*#", ""))).otherwise("")
    return uris.join(best, "uri", "left").select("uri", F.when(F.col("best").isNull(), F.col("uri")).otherwise(F.concat("best", tail)).alias("canonical"))


def coverage(ws: Workspace) -> DataFrame:
    """(directory, total, embedded, fraction) of file:// files, and one row with directory '' for all."""
    held = ws.embeddings.filter("scope = 'file'").select("uri", F.lit(1).alias("has")).distinct()
    rows = ws.files.filter(F.col("uri").startswith("file://")).join(held, "uri", "left").withColumn("directory", F.regexp_replace(S.strip_file_scheme(F.col("uri")), "/[^/]*$", ""))
    sums = rows.rollup("directory").agg(F.count("*").alias("total"), F.coalesce(F.sum("has"), F.lit(0)).alias("embedded"))
    return sums.select(F.coalesce("directory", F.lit("")).alias("directory"), "total", "embedded", F.when(F.col("total") > 0, F.round(F.col("embedded") / F.col("total"), 6)).alias("fraction"))


def module_count(ws: Workspace) -> DataFrame:
    """(symbol kind, modules that define one)."""
    return ws.symbols.join(ws.files.select(F.col("uri").alias("file_uri"), "module_id"), "file_uri").groupBy("kind").agg(F.countDistinct("module_id").alias("modules"), F.count("*").alias("symbols"))


def model_names(ws: Workspace) -> DataFrame:
    return ws.embeddings.select("model").distinct()


def pending_embeddings(ws: Workspace) -> DataFrame:
    return ws.files.join(ws.embeddings.filter("scope = 'file'"), "uri", "left_anti").agg(F.count("*").alias("pending"))


# annotations


def annotation_set(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """annotations after changes (the same columns): the last by timestamp, then the changed one, for each symbol and key."""
    both = annotations.withColumn("late", F.lit(0)).unionByName(changes.withColumn("late", F.lit(1)))
    last = Window.partitionBy("symbol_uri", "key").orderBy(F.desc("late"), F.desc("timestamp_ms"), F.desc("value"))
    return both.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "late")


def live_annotations(ws: Workspace) -> DataFrame:
    return ws.annotations.filter(S.not_expired(ws.as_of_ms))


def annotation_get(ws: Workspace, symbol_uri: str, key: str) -> DataFrame:
    return live_annotations(ws).filter((F.col("symbol_uri") == symbol_uri) & (F.col("key") == key)).select("value")


def annotation_list(ws: Workspace, symbol_uri: str) -> DataFrame:
    return live_annotations(ws).filter(F.col("symbol_uri") == symbol_uri).select("symbol_uri", "key", "value", "author_id", "timestamp_ms", "expires_ms")


def annotation_prefix(ws: Workspace, key_prefix: str = "") -> DataFrame:
    return live_annotations(ws).filter(F.col("key").startswith(key_prefix)).select("symbol_uri", "key", "value", "author_id", "timestamp_ms", "expires_ms")


def batch_annotation_get(ws: Workspace, uris: DataFrame, key: str) -> DataFrame:
    """(symbol_uri, value) for each uri; null without a live value."""
    live = live_annotations(ws).filter(F.col("key") == key).select("symbol_uri", "value")
    return uris.select(F.col("uri").alias("symbol_uri")).join(live, "symbol_uri", "left")


def purge_expired(ws: Workspace) -> DataFrame:
    """(kept, removed) numbers of annotations."""
    keep = F.when(S.not_expired(ws.as_of_ms), 1).otherwise(0)
    return ws.annotations.agg(F.coalesce(F.sum(keep), F.lit(0)).alias("kept"), F.coalesce(F.sum(1 - keep), F.lit(0)).alias("removed"))
