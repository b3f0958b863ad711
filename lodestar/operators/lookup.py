"""Point lookups, filters and predicates over a workspace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import scalars as S
from lodestar.storage import stored
from lodestar.workspace import Workspace


def _contains(line: Column, col: Column) -> Column:
    after = (line > F.col("start_line")) | ((line == F.col("start_line")) & (col >= F.col("start_char")))
    before = (line < F.col("end_line")) | ((line == F.col("end_line")) & (col < F.col("end_char")))
    return after & before


def symbols_at_positions(ws: Workspace, probes: DataFrame) -> DataFrame:
    """probes (probe, file_uri, line, col) with symbol_uri: the first occurrence, in extraction order, whose range holds the
    position; start inclusive, end exclusive; null without one.

    A hash join on the file and a bucket of lines.  An occurrence of n lines is in the one or two buckets of 2**level lines, the
    least power from n on, that it touches; a probe is in one bucket of each level that occurs, of which there are 31 at most.
    """
    o = ws.occurrences.select("file_uri", "symbol_uri", "ordinal", "start_line", "start_char", "end_line", "end_char").filter("end_line >= start_line")
    # one line is level 0, by far the most; the level of others is the number of bits of their last line's distance
    level = F.when(F.col("end_line") == F.col("start_line"), 0).otherwise(F.length(F.bin(F.col("end_line").cast("long") - F.col("start_line")))).cast("int")
    o = o.withColumn("level", level)
    levels = o.select("level").distinct()
    both = F.array_distinct(F.array(F.expr("shiftright(start_line, level)"), F.expr("shiftright(end_line, level)")))
    o = o.withColumn("bucket", F.explode(both))
    p = probes.crossJoin(F.broadcast(levels)).withColumn("bucket", F.expr("shiftright(line, level)"))  # at most 31 levels
    hit = p.join(o, ["file_uri", "level", "bucket"]).filter(_contains(F.col("line"), F.col("col")))
    best = hit.groupBy("probe").agg(F.min_by("symbol_uri", "ordinal").alias("symbol_uri"))
    return probes.join(best, "probe", "left").select("probe", "file_uri", "line", "col", "symbol_uri")


def definitions(ws: Workspace) -> DataFrame:
    """(symbol_uri, def_file, def_line, def_char): of several definition occurrences the last wins."""
    d = ws.occurrences.filter("role = 'definition'")
    return d.groupBy("symbol_uri").agg(F.max_by(F.struct("file_uri", "start_line", "start_char"), F.struct("file_uri", "ordinal")).alias("d")).select(
        "symbol_uri", F.col("d.file_uri").alias("def_file"), F.col("d.start_line").alias("def_line"), F.col("d.start_char").alias("def_char")
    )


def query_definition(ws: Workspace, probes: DataFrame) -> DataFrame:
    """Where the symbol at each position is defined; without a known place, the probed file at 0:0.

    Occurrences are read twice, so they are made once.
    """
    ws = ws.with_(occurrences=stored(ws.occurrences.select("file_uri", "symbol_uri", "start_line", "start_char", "end_line", "end_char", "role", "ordinal")))
    at = symbols_at_positions(ws, probes).filter("symbol_uri is not null")
    known = at.join(ws.symbols.select(F.col("uri").alias("symbol_uri"), "display_name"), "symbol_uri").join(definitions(ws), "symbol_uri", "left")
    return known.select(
        "probe", "symbol_uri", "display_name", F.coalesce("def_file", "file_uri").alias("def_file"), F.coalesce("def_line", F.lit(0)).alias("def_line"), F.coalesce("def_char", F.lit(0)).alias("def_char")
    )


def query_hover(ws: Workspace, probes: DataFrame) -> DataFrame:
    """The symbol at each position with its signature and documentation, and both as Markdown."""
    at = symbols_at_positions(ws, probes).filter("symbol_uri is not null")
    text = F.concat_ws("\n\n", F.concat(F.lit("```\n"), "signature", F.lit("\n```")), "documentation")
    return at.join(ws.symbols.withColumnRenamed("uri", "symbol_uri").drop("file_uri"), "symbol_uri").select("probe", "symbol_uri", "display_name", "kind", "signature", "documentation", text.alias("markdown"))


def query_references(ws: Workspace, symbol_uri: str, limit: int = 50) -> DataFrame:
    """Occurrences of a symbol in any role, definitions too, with their files; the first `limit` by file and order."""
    hits = ws.occurrences.filter(F.col("symbol_uri") == symbol_uri)
    return hits.select("file_uri", "ordinal", "start_line", "start_char", "role", "is_test").orderBy("file_uri", "ordinal").limit(limit)


def document_symbols(ws: Workspace, file_uri: str) -> DataFrame:
    return ws.symbols.filter(F.col("file_uri") == file_uri).select("uri", "display_name", "kind", "signature", "confidence_score", "is_exported")


def file_occurrences(ws: Workspace, file_uri: str) -> DataFrame:
    return ws.occurrences.filter(F.col("file_uri") == file_uri).select("symbol_uri", "start_line", "start_char", "role", "ordinal")


def all_symbols(ws: Workspace) -> DataFrame:
    """Symbols of files and of mounted slices, (origin 0 and 1), with the columns that searches read."""
    cols = ["file_uri", "uri", "display_name", "kind", "signature", "documentation", "confidence_score", "modifiers"]
    mounted = ws.slice_symbols.select(
        F.substring_index("uri", "#", 1).alias("file_uri"), "uri", "display_name", "kind", "signature", F.lit(None).cast("string").alias("documentation"), "confidence_score", F.array().cast("array<string>").alias("modifiers")
    )
    return ws.symbols.select(*cols, F.lit(0).alias("origin")).unionByName(mounted.withColumn("origin", F.lit(1)))


def symbol_by_uri(ws: Workspace, uris: DataFrame) -> DataFrame:
    """The symbol of each uri, that of a mounted slice before that of a file."""
    first = Window.partitionBy("uri").orderBy(F.desc("origin"), "file_uri")
    return all_symbols(ws).join(uris, "uri").withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("uri", "display_name", "kind", "confidence_score", "origin")


def symbols_by_name(ws: Workspace, name: str) -> DataFrame:
    return ws.symbols.filter(F.col("display_name") == name).select("uri")


def workspace_symbols(ws: Workspace, query: str, limit: int = 100, kinds: Sequence[str] | None = None, scope: str | None = None, modifiers: Sequence[str] | None = None) -> DataFrame:
    """Ranked search by name: exact 1, prefix 0.8, substring 0.5 (both ignore case), 0.2 for an empty query.

    Filters: kinds, a prefix of the defining file, any of the modifiers.  By score, name, uri; match_type is null for an empty query.
    """
    name, low = F.col("display_name"), query.lower()
    rows = all_symbols(ws)
    if kinds:
        rows = rows.filter(F.col("kind").isin(list(kinds)))
    if scope:
        rows = rows.filter(F.col("file_uri").startswith(scope))
    if modifiers:
        rows = rows.filter(F.arrays_overlap("modifiers", F.array(*map(F.lit, modifiers))))
    if query:
        score = F.when(name == query, 1.0).when(F.lower(name).startswith(low), 0.8).when(F.contains(F.lower(name), F.lit(low)), 0.5)
        kind = F.when(name == query, "exact").when(F.lower(name).startswith(low), "prefix").otherwise("fuzzy")
    else:
        score, kind = F.lit(0.2), F.lit(None).cast("string")
    found = rows.select("uri", "display_name", "kind", score.alias("score"), kind.alias("match_type")).filter("score is not null")
    return found.orderBy(F.desc("score"), "display_name", "uri").limit(limit)


def similar_symbols(ws: Workspace, query: str, limit: int = 20, least: float = 0.2) -> DataFrame:
    """Trigram similarity of names, or 0.6 times that of documentation if higher; from `least` on, best first."""
    of_name = S.trigram_similarity(F.lit(query), F.col("display_name"))
    of_doc = F.when(F.col("documentation").isNotNull(), S.trigram_similarity(F.lit(query), F.col("documentation")) * 0.6).otherwise(0.0)
    found = all_symbols(ws).select("uri", "display_name", F.greatest(of_name, of_doc).alias("raw")).filter(F.col("raw") >= least)
    return found.select("uri", "display_name", F.round("raw", 6).alias("score")).orderBy(F.desc("score"), "uri").limit(limit)


def stale_files(ws: Workspace, probes: DataFrame) -> DataFrame:
    """Those of probes (uri, content_hash) that the index doesn't know or knows with another hash."""
    known = ws.files.select("uri", F.col("content_hash").alias("held"))
    return probes.join(known, "uri", "left").filter(F.col("held").isNull() | (F.col("held") != F.col("content_hash"))).select("uri", F.col("held").isNull().alias("unknown"))


def file_status(ws: Workspace, uris: DataFrame) -> DataFrame:
    """For each uri: whether it is indexed, whether it has a vector, its age in seconds, the vector's model."""
    held = ws.embeddings.filter("scope = 'file'").select("uri", F.col("model").alias("embedding_model"))
    rows = uris.join(ws.files.select("uri", "indexed_at_ms"), "uri", "left").join(held, "uri", "left")
    age = S.age_seconds(F.col("indexed_at_ms"), ws.as_of_ms)
    return rows.select("uri", F.col("indexed_at_ms").isNotNull().alias("indexed"), F.col("embedding_model").isNotNull().alias("has_embedding"), age.alias("age_seconds"), "embedding_model")


def index_status(ws: Workspace) -> DataFrame:
    """One row: files, those without a vector, the last time, models in use, whether they are mixed, and `tool@version:root` of the imports, sorted."""
    held = ws.embeddings.filter("scope = 'file'").select("uri", F.lit(1).alias("has")).distinct()
    totals = ws.files.join(held, "uri", "left").agg(
        F.count("*").alias("indexed_files"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("pending_embedding_files"), F.max("indexed_at_ms").alias("last_updated_ms")
    )
    models = ws.embeddings.agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), (F.countDistinct("model") > 1).alias("mixed_models"))
    tools = F.concat("tool_name", F.lit("@"), "tool_version", F.lit(":"), "project_root")
    sources = ws.tier3_sources.agg(F.array_join(F.sort_array(F.collect_set(tools)), ",").alias("tier3_sources"))
    return totals.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(sources))  # one row each


def abi_hash(ws: Workspace) -> DataFrame:
    """(uri, abi_hash) of every file: SHA-256 of the sorted `uri|kind|signature` lines of its exported symbols; of none, that of ''."""
    line = F.concat_ws("|", "uri", S.kind_code(F.col("kind")), F.coalesce("signature", F.lit("")))
    surface = ws.symbols.filter("is_exported").groupBy("file_uri").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    rows = ws.files.select("uri").join(surface, F.col("uri") == F.col("file_uri"), "left")
    return rows.select("uri", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("abi_hash"))


def api_surface(ws: Workspace) -> DataFrame:
    """(uri, exported, surface_hash) of every file: SHA-256 of `uri:signature or name` of its exported symbols in extraction order."""
    line = F.concat("uri", F.lit(":"), F.coalesce("signature", "display_name"))
    surface = ws.symbols.filter("is_exported").groupBy("file_uri").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    rows = ws.files.select("uri").join(surface, F.col("uri") == F.col("file_uri"), "left")
    text = F.array_join(F.coalesce(F.col("lines.line"), F.array().cast("array<string>")), "\n")
    return rows.select("uri", F.coalesce("n", F.lit(0)).alias("exported"), F.sha2(text, 256).alias("surface_hash"))


def changed_surfaces(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files whose surface differs from an earlier snapshot of api_surface: only what depends on them needs work."""
    old = before.select("uri", F.col("surface_hash").alias("old"))
    return after.join(old, "uri", "left").filter(~F.col("old").eqNullSafe(F.col("surface_hash"))).select("uri")


def glob_files(ws: Workspace, pattern: str) -> DataFrame:
    return ws.files.filter(S.glob_matches(F.col("uri"), pattern)).select("uri")
