"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import graph as G
from lodestar.operators import ingest as I
from lodestar.operators import lookup as L
from lodestar.operators import relations as R
from lodestar.operators import vectors as V
from lodestar.plans.projection import AS_OF_MS, CTES, table, vectors, workspace
from lodestar.streaming import deltas as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name; sql continues CTES."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            ORACLE[f.__name__] = CTES + text
        return f

    return register


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor for every order, in the file of its customer's number."""
    ws_files = workspace(spark, sf_dir).files.select("id", F.col("uri").alias("file_uri"))
    orders, count = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    rows = orders.crossJoin(F.broadcast(count)).withColumn("id", F.col("o_custkey") % F.col("n"))  # one row
    return rows.join(ws_files, "id").select(F.col("o_orderkey").alias("probe"), "file_uri", F.col("o_orderkey").cast("int").alias("line"), (F.col("o_custkey") % 7 + 1).cast("int").alias("col"))


PROBES = """
, probes AS (SELECT o_orderkey AS probe, f.uri AS file_uri, CAST(o_orderkey AS INTEGER) AS line, CAST(o_custkey % 7 + 1 AS INTEGER) AS col
  FROM orders JOIN files f ON f.id = o_custkey % (SELECT n FROM n_supp))
, hits AS (SELECT p.probe, arg_min(o.symbol_uri, o.ordinal) AS symbol_uri FROM probes p JOIN occurrences o ON o.file_uri = p.file_uri
   AND (p.line > o.start_line OR (p.line = o.start_line AND p.col >= o.start_char)) AND (p.line < o.end_line OR (p.line = o.end_line AND p.col < o.end_char)) GROUP BY p.probe)
, defs AS (SELECT symbol_uri, file_uri AS def_file, start_line AS def_line, start_char AS def_char FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol_uri ORDER BY file_uri DESC, ordinal DESC) AS rn FROM occurrences WHERE role = 'definition') WHERE rn = 1)
"""


@query(PROBES + "SELECT p.probe, p.file_uri, p.line, p.col, h.symbol_uri FROM probes p LEFT JOIN hits h USING (probe)")
def symbol_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.symbols_at_positions(workspace(spark, sf_dir), probes(spark, sf_dir))


@query(PROBES + """SELECT h.probe, h.symbol_uri, s.display_name, coalesce(d.def_file, p.file_uri) AS def_file, coalesce(d.def_line, 0) AS def_line, coalesce(d.def_char, 0) AS def_char
FROM hits h JOIN probes p USING (probe) JOIN symbols s ON s.uri = h.symbol_uri LEFT JOIN defs d ON d.symbol_uri = h.symbol_uri""")
def query_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.query_definition(workspace(spark, sf_dir), probes(spark, sf_dir))


@query(PROBES + """SELECT h.probe, h.symbol_uri, s.display_name, s.kind, s.signature, s.documentation, '```' || chr(10) || s.signature || chr(10) || '```' || chr(10) || chr(10) || s.documentation AS markdown
FROM hits h JOIN symbols s ON s.uri = h.symbol_uri""")
def query_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.query_hover(workspace(spark, sf_dir), probes(spark, sf_dir))


def _busiest(spark: SparkSession, sf_dir: str) -> str:
    """The symbol with most occurrences, the smallest URI of several."""
    o = workspace(spark, sf_dir).occurrences
    return o.groupBy("symbol_uri").count().orderBy(F.desc("count"), "symbol_uri").first()["symbol_uri"]


BUSIEST = ", busiest AS (SELECT symbol_uri FROM occurrences GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "


@query(BUSIEST + "SELECT file_uri, ordinal, start_line, start_char, role, is_test FROM occurrences WHERE symbol_uri = (SELECT symbol_uri FROM busiest) ORDER BY file_uri, ordinal LIMIT 50")
def query_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.query_references(workspace(spark, sf_dir), _busiest(spark, sf_dir))


@query("SELECT uri, display_name, kind, signature, confidence_score, is_exported FROM symbols WHERE file_uri = (SELECT max(uri) FROM files)")
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return L.document_symbols(ws, ws.files.agg(F.max("uri")).first()[0])


@query("SELECT symbol_uri, start_line, start_char, role, ordinal FROM occurrences WHERE file_uri = (SELECT max(uri) FROM files)")
def file_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return L.file_occurrences(ws, ws.files.agg(F.max("uri")).first()[0])


ALL_SYMBOLS = """, all_symbols AS (SELECT file_uri, uri, display_name, kind, signature, documentation, confidence_score, modifiers, 0 AS origin FROM symbols
  UNION ALL SELECT split_part(uri, '#', 1), uri, display_name, kind, signature, NULL, confidence_score, CAST([] AS VARCHAR[]), 1 FROM slice_symbols) """


@query(ALL_SYMBOLS + "SELECT uri, display_name, kind, confidence_score, origin FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY origin DESC, file_uri) AS rn FROM all_symbols) WHERE rn = 1")
def symbol_by_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return L.symbol_by_uri(ws, L.all_symbols(ws).select("uri").distinct())


@query("SELECT uri FROM symbols WHERE display_name = 'red bolt'")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.symbols_by_name(workspace(spark, sf_dir), "red bolt")


SEARCH = """SELECT uri, display_name, kind, score, match_type FROM (SELECT *, CASE WHEN display_name = '{q}' THEN 1.0 WHEN lower(display_name) LIKE '{l}%' THEN 0.8 WHEN contains(lower(display_name), '{l}') THEN 0.5 END AS score,
  CASE WHEN display_name = '{q}' THEN 'exact' WHEN lower(display_name) LIKE '{l}%' THEN 'prefix' ELSE 'fuzzy' END AS match_type FROM all_symbols {where}) WHERE score IS NOT NULL ORDER BY score DESC, display_name, uri LIMIT {n}"""


@query(ALL_SYMBOLS + SEARCH.format(q="Red", l="red", where="", n=100))
def workspace_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.workspace_symbols(workspace(spark, sf_dir), "Red")


@query(ALL_SYMBOLS + SEARCH.format(q="ring", l="ring", where="WHERE kind IN ('function', 'method', 'class') AND file_uri LIKE 'file:///repo/n1%' AND list_has_any(modifiers, ['async'])", n=50))
def workspace_symbols_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.workspace_symbols(workspace(spark, sf_dir), "ring", 50, ["function", "method", "class"], "file:///repo/n1", ["async"])


TRIGRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), CAST(i AS BIGINT), 3))) ELSE CAST([] AS VARCHAR[]) END"


def _jaccard(a: str, b: str) -> str:
    x, y = TRIGRAMS.format(a), TRIGRAMS.format(b)
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / CAST(len(list_distinct(list_concat({x}, {y}))) AS DOUBLE) END"


@query(ALL_SYMBOLS + f"""SELECT uri, display_name, round(raw, 6) AS score FROM (SELECT uri, display_name, greatest({_jaccard("'small ring'", 'display_name')}, CASE WHEN documentation IS NULL THEN 0.0 ELSE 0.6 * ({_jaccard("'small ring'", 'documentation')}) END) AS raw FROM all_symbols)
WHERE raw >= 0.2 ORDER BY score DESC, uri LIMIT 100""")
def similar_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.similar_symbols(workspace(spark, sf_dir), "small ring", 100)


CLIENT = ", client AS (SELECT uri, CASE WHEN id % 7 = 0 THEN 'changed' ELSE content_hash END AS content_hash FROM files UNION ALL SELECT 'file:///repo/new' || c_custkey || '.rs', 'x' FROM customer) "


def _client(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = workspace(spark, sf_dir).files
    known = files.select("uri", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"))
    return known.unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("file:///repo/new"), "c_custkey", F.lit(".rs")).alias("uri"), F.lit("x").alias("content_hash")))


@query(CLIENT + "SELECT c.uri, f.uri IS NULL AS unknown FROM client c LEFT JOIN files f USING (uri) WHERE f.uri IS NULL OR f.content_hash <> c.content_hash")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stale_files(workspace(spark, sf_dir), _client(spark, sf_dir))


@query(CLIENT + f"""SELECT c.uri, f.uri IS NOT NULL AS indexed, e.model IS NOT NULL AS has_embedding, CASE WHEN f.indexed_at_ms <= {AS_OF_MS} THEN CAST(({AS_OF_MS} - f.indexed_at_ms) // 1000 AS DOUBLE) END AS age_seconds, e.model AS embedding_model
FROM client c LEFT JOIN files f USING (uri) LEFT JOIN (SELECT uri, model FROM embeddings_ WHERE scope = 'file') e ON e.uri = c.uri""")
def batch_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = L.file_status(workspace(spark, sf_dir), _client(spark, sf_dir).select("uri"))
    return status.withColumn("age_seconds", F.col("age_seconds").cast("double"))  # has nulls


TOOLS = "SELECT n_regionkey, CAST(max(n_nationkey) AS VARCHAR) AS tool_version FROM nation GROUP BY n_regionkey"


@query(f"""SELECT (SELECT string_agg('scip@' || tool_version || ':/work/' || n_regionkey, ',' ORDER BY 'scip@' || tool_version || ':/work/' || n_regionkey) FROM ({TOOLS})) AS tier3_sources, (SELECT count(*) FROM files) AS indexed_files, (SELECT CAST(count(*) AS BIGINT) FROM files WHERE uri NOT IN (SELECT uri FROM embeddings_ WHERE scope = 'file')) AS pending_embedding_files, (SELECT max(indexed_at_ms) FROM files) AS last_updated_ms,
 (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM embeddings_) AS models, (SELECT count(DISTINCT model) > 1 FROM embeddings_) AS mixed_models""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return L.index_status(ws.with_(tier3_sources=I.register_tier3_source(ws.tier3_sources, _imports(spark, sf_dir))))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import for every nation, by its region's project."""
    root = F.concat(F.lit("/work/"), "n_regionkey")
    n = table(spark, sf_dir, "nation")
    return n.select(I.source_id(F.lit("scip"), root).alias("source_id"), F.lit("scip").alias("tool_name"), F.col("n_nationkey").cast("string").alias("tool_version"), root.alias("project_root"), (F.lit(1000) + F.col("n_nationkey")).cast("long").alias("imported_at_ms"))


KIND_CODE = "CASE s.kind WHEN 'class' THEN 2 WHEN 'interface' THEN 3 WHEN 'method' THEN 4 WHEN 'variable' THEN 6 WHEN 'function' THEN 7 WHEN 'type_alias' THEN 14 ELSE 0 END"


@query(f"SELECT f.uri, sha256(coalesce(string_agg(s.uri || '|' || {KIND_CODE} || '|' || s.signature, chr(10) ORDER BY s.uri || '|' || {KIND_CODE} || '|' || s.signature), '')) AS abi_hash FROM files f LEFT JOIN symbols s ON s.file_uri = f.uri AND s.is_exported GROUP BY f.uri")
def abi_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.abi_hash(workspace(spark, sf_dir))


@query("SELECT f.uri, count(s.uri) AS exported, sha256(coalesce(string_agg(s.uri || ':' || s.signature, chr(10) ORDER BY s.ordinal), '')) AS surface_hash FROM files f LEFT JOIN symbols s ON s.file_uri = f.uri AND s.is_exported GROUP BY f.uri")
def api_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.api_surface(workspace(spark, sf_dir))


@query("SELECT uri FROM files WHERE regexp_matches(uri, '/n1[^/]*/s[^/]*[02468][.]rs$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.glob_files(workspace(spark, sf_dir), "**/n1*/s*[02468].rs")


# relations


@query("SELECT DISTINCT s.file_uri AS target, o.file_uri AS dependent FROM symbols s JOIN occurrences o ON o.symbol_uri = s.uri WHERE s.is_exported AND s.file_uri <> o.file_uri")
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return R.reverse_deps(ws, ws.files.select("uri"))


@query("SELECT file_uri, uri, display_name, kind FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.symbol_uri = s.uri AND o.role = 'reference')")
def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dead_symbols(workspace(spark, sf_dir))


NAME = "regexp_replace(split_part(CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '[^#]*$') ELSE {0} END, '(', 1), '[^\\p{{L}}\\p{{N}}_]+$', '')"


@query(f", alias_ AS (SELECT uri, 'lip://scip/' || display_name || '#' || regexp_extract(uri, '[^#]*$') || '().' AS other FROM symbols) SELECT e.from_uri, a.other AS to_uri, s.uri AS symbol_uri FROM edges e JOIN alias_ a ON a.uri = e.to_uri JOIN symbols s ON {NAME.format('s.uri')} = {NAME.format('a.other')} WHERE a.other <> s.uri")
def name_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    other = ws.symbols.select(F.col("uri").alias("to_uri"), F.concat(F.lit("lip://scip/"), "display_name", F.lit("#"), S.extract_name(F.col("uri")), F.lit("().")).alias("other"))
    return R.name_bridge(ws.with_(edges=ws.edges.join(other, "to_uri").drop("to_uri").withColumnRenamed("other", "to_uri")))


@query("SELECT uri AS symbol_uri, file_uri FROM symbols UNION ALL SELECT 'lip://local/' || substr(uri, 8) || '#unseen', uri FROM files")
def resolve_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    unseen = ws.files.select(F.concat(F.lit("lip://local/"), F.substr("uri", F.lit(8)), F.lit("#unseen")).alias("symbol_uri"))
    nowhere = ws.slice_symbols.select(F.col("uri").alias("symbol_uri"))
    return R.resolve_definition(ws, ws.symbols.select(F.col("uri").alias("symbol_uri")).union(unseen).union(nowhere))


@query(""", raw AS (SELECT DISTINCT o.file_uri, s.display_name AS name FROM occurrences o JOIN symbols s ON s.uri = o.symbol_uri),
own AS (SELECT file_uri, display_name AS name, arg_min(uri, ordinal) AS own FROM symbols GROUP BY 1, 2), uniq AS (SELECT display_name AS name, max(uri) AS only_ FROM symbols GROUP BY 1 HAVING count(*) = 1)
SELECT file_uri, name, coalesce(own, only_) AS uri FROM raw LEFT JOIN own USING (file_uri, name) LEFT JOIN uniq USING (name)""")
def backfill_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    raw = ws.occurrences.join(ws.symbols.select(F.col("uri").alias("symbol_uri"), F.col("display_name").alias("name")), "symbol_uri").select("file_uri", "name").distinct()
    named = ws.symbols.withColumnRenamed("display_name", "name")
    return R.backfill_translate(raw, named.select("file_uri", "name", "uri", "ordinal"), named.select("name", "uri"))


CONSUMED = f", consumed AS (SELECT DISTINCT o.file_uri, {NAME.format('o.symbol_uri')} AS name FROM occurrences o WHERE o.role <> 'definition' AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_uri = o.file_uri AND s.uri = o.symbol_uri)) "


@query(CONSUMED + "SELECT file_uri, name FROM consumed")
def consumed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consumed_names(workspace(spark, sf_dir))


@query(CONSUMED + f"SELECT DISTINCT file_uri FROM consumed WHERE name IN (SELECT {NAME.format('uri')} FROM symbols WHERE confidence_score = 41)")
def invalidated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return R.invalidated_files(ws, ws.symbols.filter("confidence_score = 41").select(S.callee_name(F.col("uri")).alias("name")))


@query("""SELECT 'lip://local/' || regexp_extract(uri, 's[0-9]+[.]rs$') || '#x' AS uri, 'lip://local/' || CASE WHEN contains(uri, '/n7/') THEN '/repo/n7/' ELSE '/repo/n24/' END || regexp_extract(uri, 's[0-9]+[.]rs$') || '#x' AS canonical FROM files""")
def canonicalize_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = workspace(spark, sf_dir).files
    rel = F.regexp_extract("uri", r"s[0-9]+[.]rs$", 0)
    roots = spark.createDataFrame([("/repo/n7",), ("/repo/n24",), ("/repo",)], "root string")
    return R.canonicalize(files.select(F.concat(F.lit("lip://local/"), rel, F.lit("#x")).alias("uri")), roots, files.select(F.concat(F.lit("lip://local/"), F.substr("uri", F.lit(8))).alias("uri")))


@query("""SELECT coalesce(directory, '') AS directory, count(*) AS total, CAST(coalesce(sum(has), 0) AS BIGINT) AS embedded, round(coalesce(sum(has), 0) / count(*), 6) AS fraction
FROM (SELECT regexp_replace(substr(uri, 8), '/[^/]*$', '') AS directory, CASE WHEN uri IN (SELECT uri FROM embeddings_ WHERE scope = 'file') THEN 1 END AS has FROM files) GROUP BY ROLLUP (directory)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(workspace(spark, sf_dir))


@query("SELECT s.kind, count(DISTINCT f.module_id) AS modules, count(*) AS symbols FROM symbols s JOIN files f ON f.uri = s.file_uri GROUP BY 1")
def module_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.module_count(workspace(spark, sf_dir))


@query("SELECT DISTINCT model FROM embeddings_")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_names(workspace(spark, sf_dir))


@query("SELECT count(*) AS pending FROM files WHERE uri NOT IN (SELECT uri FROM embeddings_ WHERE scope = 'file')")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending_embeddings(workspace(spark, sf_dir))


# annotations

NOTE = "symbol_uri, key, value, author_id, timestamp_ms, expires_ms"
LIVE = f"(expires_ms = 0 OR expires_ms >= {AS_OF_MS})"


@query(f""", changes AS (SELECT symbol_uri, 'view' AS key, 'seen' AS value, author_id, 100 AS confidence, {AS_OF_MS} AS timestamp_ms, 0 AS expires_ms FROM annotations WHERE key = 'click')
SELECT symbol_uri, key, value, author_id, confidence, timestamp_ms, expires_ms FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.symbol_uri = a.symbol_uri AND c.key = a.key) UNION ALL SELECT symbol_uri, key, value, author_id, confidence, timestamp_ms, expires_ms FROM changes""")
def annotation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = workspace(spark, sf_dir).annotations
    changes = notes.filter("key = 'click'").select("symbol_uri", F.lit("view").alias("key"), F.lit("seen").alias("value"), "author_id", "confidence", F.lit(AS_OF_MS).alias("timestamp_ms"), F.lit(0).cast("long").alias("expires_ms"))
    return R.annotation_set(notes, changes)


@query(f"SELECT value FROM annotations WHERE symbol_uri = 'sym:8' AND key = 'purchase' AND {LIVE}")
def annotation_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annotation_get(workspace(spark, sf_dir), "sym:8", "purchase")


@query(f"SELECT {NOTE} FROM annotations WHERE symbol_uri = 'sym:7' AND {LIVE}")
def annotation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annotation_list(workspace(spark, sf_dir), "sym:7")


@query(f"SELECT {NOTE} FROM annotations WHERE key LIKE 'p%' AND {LIVE}")
def annotation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.annotation_prefix(workspace(spark, sf_dir), "p")


@query(f"SELECT 'sym:' || c_custkey AS symbol_uri, a.value FROM customer LEFT JOIN (SELECT * FROM annotations WHERE key = 'view' AND {LIVE}) a ON a.symbol_uri = 'sym:' || c_custkey")
def batch_annotation_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_annotation_get(workspace(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("sym:"), "c_custkey").alias("uri")), "view")


@query(f"SELECT CAST(sum(CASE WHEN {LIVE} THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN {LIVE} THEN 0 ELSE 1 END) AS BIGINT) AS removed FROM annotations")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.purge_expired(workspace(spark, sf_dir))


@query(f"SELECT {NOTE} FROM annotations WHERE {LIVE}")
def all_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.live_annotations(workspace(spark, sf_dir)).select("symbol_uri", "key", "value", "author_id", "timestamp_ms", "expires_ms")


# graph

SEEDS = ", seeds AS (SELECT uri AS seed, file_uri FROM symbols) "


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).symbols.select(F.col("uri").alias("seed"))


CALLERS = """, up AS (SELECT seed, seed AS node, 0 AS d FROM seeds UNION SELECT u.seed, e.from_uri, u.d + 1 FROM up u JOIN edges e ON e.to_uri = u.node WHERE u.d < 4)
, callers AS (SELECT seed, node, min(d) AS distance FROM up WHERE node <> seed GROUP BY 1, 2)
"""
FILE_REACH = """, deps AS (SELECT DISTINCT s.file_uri AS target, o.file_uri AS dependent FROM symbols s JOIN occurrences o ON o.symbol_uri = s.uri WHERE s.is_exported AND s.file_uri <> o.file_uri)
, fup AS (SELECT file_uri AS seed, file_uri AS node, 0 AS d FROM (SELECT DISTINCT file_uri FROM seeds) UNION SELECT u.seed, e.dependent, u.d + 1 FROM fup u JOIN deps e ON e.target = u.node WHERE u.d < 4)
, file_reach AS (SELECT seed AS home, node, min(d) AS distance FROM fup WHERE node <> seed GROUP BY 1, 2)
, called AS (SELECT c.seed, s.file_uri, c.node AS symbol_uri, c.distance FROM callers c JOIN symbols s ON s.uri = c.node)
, items AS (SELECT * FROM called UNION ALL SELECT s.seed, r.node, '', r.distance FROM seeds s JOIN file_reach r ON r.home = s.file_uri
   WHERE NOT EXISTS (SELECT 1 FROM called c WHERE c.seed = s.seed AND c.file_uri = r.node))
, sums AS (SELECT seed, CAST(sum(CASE WHEN distance = 1 THEN 1 ELSE 0 END) AS BIGINT) AS direct, count(*) AS total FROM (SELECT seed, file_uri, min(distance) AS distance FROM items GROUP BY 1, 2) GROUP BY 1)
"""
RISK = "CASE WHEN coalesce(direct, 0) > 10 OR coalesce(total, 0) > 20 THEN 'high' WHEN coalesce(direct, 0) > 3 OR coalesce(total, 0) > 5 THEN 'medium' ELSE 'low' END"
CONFIDENCE = "CASE distance WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 ELSE 0.5 END"
SUMMARY = f"SELECT s.seed, coalesce(direct, 0) AS direct_dependents, coalesce(total, 0) AS transitive_dependents, {RISK} AS risk, f.edges_source FROM seeds s LEFT JOIN sums USING (seed) JOIN files f ON f.uri = s.file_uri"


@query(SEEDS + CALLERS + FILE_REACH + SUMMARY)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius(workspace(spark, sf_dir), _seeds(spark, sf_dir))


@query(SEEDS + CALLERS + FILE_REACH + f"SELECT seed, file_uri, symbol_uri, distance, {CONFIDENCE} AS confidence FROM items")
def blast_radius_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius_items(workspace(spark, sf_dir), _seeds(spark, sf_dir))


@query(SEEDS + CALLERS + "SELECT seed, node, distance FROM callers")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callers(workspace(spark, sf_dir), _seeds(spark, sf_dir))


BATCH = ", changed AS (SELECT uri FROM client), seeds AS (SELECT uri AS seed, file_uri FROM symbols WHERE kind IN ('function', 'method', 'class', 'interface', 'constructor', 'macro') AND file_uri IN (SELECT uri FROM changed)) "


@query(CLIENT + BATCH + CALLERS + FILE_REACH + SUMMARY.replace("f.edges_source FROM", "f.edges_source, true AS indexed FROM") + " UNION ALL SELECT uri, 0, 0, 'low', 'empty', false FROM changed WHERE uri NOT IN (SELECT uri FROM files)")
def blast_radius_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius_batch(workspace(spark, sf_dir), _client(spark, sf_dir).select("uri"))


ONE = BUSIEST + ", seeds AS (SELECT s.uri AS seed, s.file_uri FROM symbols s JOIN busiest b ON b.symbol_uri = s.uri) "


@query(ONE + CALLERS + FILE_REACH + SUMMARY)
def blast_radius_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius(workspace(spark, sf_dir), spark.createDataFrame([(_busiest(spark, sf_dir),)], "seed string"))


@query(None)
def blast_radius_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius_limited(workspace(spark, sf_dir), _busiest(spark, sf_dir))


def _unit(alias: str, of: str) -> str:
    return f", {alias} AS (SELECT * EXCLUDE (vector), CAST(vector AS DOUBLE[]) AS v FROM {of} WHERE list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) > 0)"


COS = "round(list_cosine_similarity({0}, {1}), 6)"


@query(SEEDS + CALLERS + FILE_REACH + _unit("pool", "(SELECT * FROM embeddings_ WHERE scope = 'symbol')") + f""", fpool AS (SELECT uri, CAST(vector AS DOUBLE[]) AS v FROM embeddings_ WHERE scope = 'file'),
asked AS (SELECT y.uri, coalesce(o.v, f.v) AS v FROM symbols y LEFT JOIN pool o ON o.uri = y.uri LEFT JOIN fpool f ON f.uri = y.file_uri WHERE y.uri IN (SELECT seed FROM items)),
near AS (SELECT q.uri AS seed, p.uri, {COS.format('q.v', 'p.v')} AS score FROM asked q JOIN pool p ON p.uri <> q.uri WHERE q.v IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, uri) AS rn FROM near WHERE score >= 0.2) WHERE rn <= 20)
SELECT b.seed, b.uri, b.score, CASE WHEN EXISTS (SELECT 1 FROM items i WHERE i.seed = b.seed AND i.file_uri = s.file_uri) THEN 'both' ELSE 'semantic' END AS source FROM best b JOIN symbols s ON s.uri = b.uri""")
def semantic_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.semantic_enrichment(workspace(spark, sf_dir), _seeds(spark, sf_dir), 0.2)


@query(SEEDS + """, down AS (SELECT seed, seed AS node, 0 AS d FROM seeds UNION SELECT u.seed, e.to_uri, u.d + 1 FROM down u JOIN edges e ON e.from_uri = u.node WHERE u.d < 2)
SELECT DISTINCT n.seed, e.from_uri, e.to_uri, n.d + 1 AS distance FROM (SELECT seed, node, min(d) AS d FROM down GROUP BY 1, 2) n JOIN edges e ON e.from_uri = n.node WHERE n.d < 3""")
def outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outgoing_calls(workspace(spark, sf_dir), _seeds(spark, sf_dir), 3)


@query(SEEDS + f""", down AS (SELECT seed, seed AS node, 0 AS d FROM seeds UNION SELECT u.seed, e.to_uri, u.d + 1 FROM down u JOIN edges e ON e.from_uri = u.node WHERE u.d < 4)
, n AS (SELECT seed, node, min(d) AS distance FROM down WHERE node <> seed GROUP BY 1, 2) SELECT n.seed, n.node AS symbol_uri, s.file_uri, n.distance, {CONFIDENCE} AS confidence FROM n JOIN symbols s ON s.uri = n.node""")
def outgoing_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outgoing_impact(workspace(spark, sf_dir), _seeds(spark, sf_dir), 4)


@query(""", least AS (SELECT e.to_uri AS uri, min(s.confidence_score) AS least FROM edges e JOIN symbols s ON s.uri = e.from_uri GROUP BY 1)
SELECT s.uri, s.confidence_score, 65 AS inferred, CASE WHEN least IS NULL THEN CAST(ceil((65 - s.confidence_score) / 5.0) AS BIGINT) ELSE 1 END AS steps FROM symbols s LEFT JOIN least USING (uri)
WHERE (least >= 80 AND s.confidence_score < 65) OR (least IS NULL AND s.is_exported AND s.confidence_score >= 40 AND s.confidence_score < 65)""")
def infer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.infer_confidence(workspace(spark, sf_dir))


@query(""", up AS (SELECT s.uri, CAST(60 + p.p_size % 30 AS INTEGER) AS c, CASE WHEN p.p_size % 3 = 0 THEN 'verified ' || s.display_name END AS sig FROM symbols s JOIN part p ON p.p_partkey = s.id)
SELECT s.uri, CASE WHEN c >= confidence_score THEN c ELSE confidence_score END AS confidence_score, CASE WHEN c >= confidence_score THEN coalesce(sig, signature) ELSE signature END AS signature, documentation FROM symbols s JOIN up USING (uri)""")
def upgrade_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workspace(spark, sf_dir).symbols
    size = F.col("confidence_score") - 40
    new = s.select("uri", (60 + size % 30).alias("confidence_score"), F.when(size % 3 == 0, F.concat(F.lit("verified "), "display_name")).alias("signature"), F.lit(None).cast("string").alias("documentation"))
    return G.upgrade_symbols(s.select("uri", "confidence_score", "signature", "documentation"), new)


RANKED = PROBES + ", seeds AS (SELECT DISTINCT symbol_uri AS seed FROM hits)" + CALLERS + """, tiers AS (SELECT probe, symbol_uri, 0 AS tier, 1.0 AS score FROM hits UNION ALL SELECT h.probe, c.node, 1, greatest(0.1, 0.9 - 0.1 * c.distance) FROM hits h JOIN callers c ON c.seed = h.symbol_uri)
, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe, symbol_uri ORDER BY tier, score DESC) AS rn FROM tiers) WHERE rn = 1)
, ranked AS (SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY tier, score DESC, symbol_uri) AS rank, symbol_uri, round(score, 6) AS score, CAST(ceil((strlen(s.signature) + strlen(s.documentation)) / 4) AS BIGINT) + 8 AS cost FROM once JOIN symbols s ON s.uri = symbol_uri)
, used AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY probe ORDER BY rank) AS BIGINT) AS used FROM ranked)
"""


@query(RANKED + "SELECT probe, rank, symbol_uri, score, cost FROM ranked")
def rank_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rank_context(workspace(spark, sf_dir), probes(spark, sf_dir))


@query(RANKED + "SELECT probe, rank, symbol_uri, score, cost, used FROM used WHERE used <= 400")
def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stream_context(rank_context(spark, sf_dir), 400)


@query(RANKED + "SELECT probe, CAST(sum(CASE WHEN used <= 400 THEN 1 ELSE 0 END) AS BIGINT) AS emitted, count(*) AS total_candidates, CASE WHEN sum(CASE WHEN used <= 400 THEN 1 ELSE 0 END) < count(*) THEN 'budget_reached' ELSE 'exhausted' END AS reason FROM used GROUP BY probe")
def stream_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stream_end(rank_context(spark, sf_dir), 400)


# vectors

POOL = _unit("pool", "vectors")


def _top(queries: str, pool: str, k: int, extra: str = "", cols: str = ", model") -> str:
    return f"SELECT query, uri, score{cols} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rn FROM (SELECT q.query, p.uri, {COS.format('q.v', 'p.v')} AS score, p.model FROM {queries} q CROSS JOIN {pool} p {extra})) WHERE rn <= {k}"


@query(POOL + _top("(SELECT uri AS query, v FROM pool)", "pool", 5, "WHERE q.query <> p.uri"))
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vectors(spark, sf_dir)
    return V.top_k(pool.select(F.col("uri").alias("query"), "vector"), pool, 5, exclude_self=True)


@query(", s AS (SELECT * FROM embeddings_ WHERE scope = 'file')" + _unit("pool", "s") + "SELECT query, uri, score, model FROM (" + _top("(SELECT uri AS query, v FROM pool)", "(SELECT * FROM pool WHERE regexp_matches(uri, '^file:///repo/n1[^/]*/[^/]*[.]rs$'))", 10, "WHERE q.query <> p.uri AND round(list_cosine_similarity(q.v, p.v), 6) >= 0.1") + ")")
def nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = workspace(spark, sf_dir).embeddings.filter("scope = 'file'")
    return V.top_k(pool.select(F.col("uri").alias("query"), "vector"), pool, 10, 0.1, True, "/repo/n1*/*.rs")


@query(", s AS (SELECT * FROM embeddings_ WHERE scope = 'symbol')" + _unit("pool", "s") + _top("(SELECT uri AS query, v FROM pool)", "pool", 3, "WHERE q.query <> p.uri"))
def nearest_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = workspace(spark, sf_dir).embeddings.filter("scope = 'symbol'")
    return V.top_k(pool.select(F.col("uri").alias("query"), "vector"), pool, 3, exclude_self=True)


@query(POOL + ", q AS (SELECT 'vec:0-vec:1' AS query, list_transform(list_zip(a.v, b.v), lambda x: x[1] - x[2]) AS v FROM pool a, pool b WHERE a.uri = 'vec:0' AND b.uri = 'vec:1') " + _top("q", "pool", 20))
def nearest_by_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest_by_contrast(vectors(spark, sf_dir), "vec:0", "vec:1", 20)


@query(POOL + _top("(SELECT uri AS query, v FROM pool)", "(SELECT * FROM pool WHERE label = 3)", 2, cols=""))
def nearest_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vectors(spark, sf_dir)
    store = pool.filter("label = 3").agg(F.map_from_entries(F.collect_list(F.struct("uri", "vector"))).alias("store"))
    return V.nearest_in_store(pool.select(F.col("uri").alias("query"), "vector"), store, 2)


@query(POOL + _top("(SELECT uri AS query, v FROM pool WHERE uri = 'vec:5')", "(SELECT * FROM pool WHERE label = 4)", 15, "WHERE q.query <> p.uri", ""))
def find_counterpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vectors(spark, sf_dir)
    return V.find_counterpart(pool, "vec:5", pool.filter("label = 4").select("uri"), 15)


@query(", s AS (SELECT * FROM embeddings_ WHERE scope = 'symbol' AND model = 'm1')" + _unit("pool", "s") + _unit("all_", "vectors") + "SELECT t.query, t.uri, y.display_name AS term, t.score FROM (" + _top("(SELECT uri AS query, v FROM all_)", "pool", 2, cols="") + ") t JOIN symbols y ON y.uri = t.uri")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.query_expansion(workspace(spark, sf_dir), vectors(spark, sf_dir).select(F.col("uri").alias("query"), "vector"), 2, "m1")


PAIRS = ", pairs AS (SELECT 'vec:' || vec_id AS a, 'vec:' || (vec_id + 1) AS b FROM embeddings) "


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("uri").alias("a"), F.concat(F.lit("vec:"), F.col("vec_id") + 1).alias("b"))


@query(POOL + PAIRS + f"SELECT p.a, p.b, {COS.format('x.v', 'y.v')} AS similarity FROM pairs p LEFT JOIN pool x ON x.uri = p.a LEFT JOIN pool y ON y.uri = p.b")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similarity(vectors(spark, sf_dir), _pairs(spark, sf_dir)).drop("drift")


@query(POOL + PAIRS + "SELECT p.a, p.b, round(1 - list_cosine_similarity(x.v, y.v), 6) AS drift FROM pairs p LEFT JOIN pool x ON x.uri = p.a LEFT JOIN pool y ON y.uri = p.b")
def semantic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similarity(vectors(spark, sf_dir), _pairs(spark, sf_dir)).drop("similarity")


@query(POOL + f"SELECT x.uri AS a, y.uri AS b, CASE WHEN x.uri = y.uri THEN 1.0 ELSE {COS.format('x.v', 'y.v')} END AS similarity FROM pool x CROSS JOIN pool y")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similarity_matrix(vectors(spark, sf_dir))


@query("SELECT CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value, count(*) AS included FROM embeddings, range(1, 65) t(i) GROUP BY 1")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.centroid(vectors(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(POOL + "SELECT x.uri, round(sum(list_cosine_similarity(x.v, y.v)) / (count(*)), 6) AS score FROM pool x JOIN pool y ON y.uri <> x.uri GROUP BY 1 ORDER BY score, x.uri LIMIT 20")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.outliers(vectors(spark, sf_dir), 20)


@query(POOL + """SELECT uri, novelty, nearest, round(avg(novelty) OVER (), 6) AS mean FROM (SELECT x.uri, round(1 - round(list_cosine_similarity(x.v, y.v), 6), 6) AS novelty, y.uri AS nearest,
 row_number() OVER (PARTITION BY x.uri ORDER BY round(list_cosine_similarity(x.v, y.v), 6) DESC, y.uri) AS rn FROM pool x CROSS JOIN pool y WHERE x.label < 3 AND y.label >= 3) WHERE rn = 1""")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vectors(spark, sf_dir)
    return V.novelty(pool, pool.filter("label < 3").select("uri"))


@query(""", c AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(CAST(vector[i] AS DOUBLE)) AS m FROM embeddings_, range(1, 65) t(i) WHERE scope = 'file' GROUP BY i)),
scored AS (SELECT s.display_name AS term, s.uri, round(list_cosine_similarity(CAST(e.vector AS DOUBLE[]), c.v), 6) AS score FROM embeddings_ e JOIN symbols s ON s.uri = e.uri, c WHERE e.scope = 'symbol')
SELECT term, uri, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, uri) AS rn FROM scored) WHERE rn = 1 ORDER BY score DESC, term LIMIT 25""")
def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    return V.terminology(ws, ws.files.select("uri"), 25)


@query("SELECT uri, CAST(i - 1 AS INTEGER) AS pos, vector[i] AS value FROM vectors, range(1, 65) t(i)")
def export_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vectors(spark, sf_dir)
    return V.export_embeddings(pool, pool.select("uri"))


@query(None)
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cluster(vectors(spark, sf_dir), 0.5)


# texts

LETTER_LIST = "[" + ", ".join(f"CAST(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')) AS DOUBLE)" for c in V.LETTERS) + "]"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("uri"), "text")


def _chunks(lines: int) -> str:
    return f""", line AS (SELECT 'doc:' || doc_id AS uri, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
, chunk AS (SELECT uri, CAST(floor(n / {lines}) AS BIGINT) AS chunk, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, string_agg(content, chr(10) ORDER BY n) AS text FROM line GROUP BY 1, 2)
, cv AS (SELECT *, {LETTER_LIST.format('text')} AS v FROM chunk)
"""


DEFINED = "list_dot_product({0}, {0}) > 0 AND list_dot_product({1}, {1}) > 0"


@query(_chunks(5) + f"SELECT uri, chunk, start_line, distance FROM (SELECT *, CASE WHEN {DEFINED.format('v', 'nv')} THEN round(1 - list_cosine_similarity(v, nv), 6) END AS distance FROM (SELECT *, lead(v) OVER (PARTITION BY uri ORDER BY chunk) AS nv FROM cv)) WHERE distance >= 0.05")
def find_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.find_boundaries(_texts(spark, sf_dir), 5, 0.05)


@query(_chunks(5) + f", q AS (SELECT {LETTER_LIST.format(chr(39) + 'the tested region' + chr(39))} AS q) SELECT uri, chunk, start_line, end_line, score FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY score DESC, chunk) AS rn FROM (SELECT cv.*, CASE WHEN {DEFINED.format('v', 'q')} THEN round(list_cosine_similarity(v, q), 6) END AS score FROM cv, q) WHERE score IS NOT NULL) WHERE rn <= 2")
def explain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.explain_match(_texts(spark, sf_dir), "the tested region", 2, 5)


@query(f", d AS (SELECT doc_id, {LETTER_LIST.format('text')} AS v FROM documents) SELECT 'doc:' || x.doc_id AS a, 'doc:' || y.doc_id AS b, coalesce(CASE WHEN {DEFINED.format('x.v', 'y.v')} THEN round(1 - list_cosine_similarity(x.v, y.v), 6) END, 0.0) AS distance FROM d x JOIN d y ON y.doc_id = x.doc_id + 1")
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    x = d.select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("a"), F.col("text").alias("text_a"))
    y = d.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("doc:"), "doc_id").alias("b"), F.col("text").alias("text_b"))
    return V.semantic_diff(x.join(y, "doc_id"))


@query(f""", d AS (SELECT doc_id, {LETTER_LIST.format('text')} AS v FROM documents), spool AS (SELECT uri, v FROM (SELECT 'item:' || item_id AS uri, {LETTER_LIST.format('text')} AS v FROM benchmark) WHERE list_dot_product(v, v) > 0),
ways AS (SELECT 'doc:' || x.doc_id AS query, list_transform(list_zip(y.v, x.v), lambda p: p[1] - p[2]) AS v FROM d x JOIN d y ON y.doc_id = x.doc_id + 1)
SELECT query, uri, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rn FROM (SELECT w.query, p.uri, {COS.format('w.v', 'p.v')} AS score FROM ways w CROSS JOIN spool p WHERE list_dot_product(w.v, w.v) > 0)) WHERE rn <= 3""")
def semantic_diff_toward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    x = d.select("doc_id", F.concat(F.lit("doc:"), "doc_id").alias("query"), F.col("text").alias("text_a"))
    y = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("uri"), V.letter_vector(F.col("text")).alias("vector"), F.lit("letters").alias("model"))
    return V.moving_toward(x.join(y, "doc_id"), items, 3)


TEXT_POOL = f", pool0 AS (SELECT 'doc:' || doc_id AS uri, {LETTER_LIST.format('text')} AS v, 'letters' AS model FROM documents), pool AS (SELECT * FROM pool0 WHERE list_dot_product(v, v) > 0), asked AS (SELECT 'item:' || item_id AS query, {LETTER_LIST.format('text')} AS v FROM benchmark) "


@query(TEXT_POOL + _top("asked", "pool", 3, cols=""))
def batch_nearest_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest_by_text(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("query"), "text"), 3)


@query(TEXT_POOL + f", one AS (SELECT 'text' AS query, {LETTER_LIST.format(chr(39) + 'where the tested region ends' + chr(39))} AS v) " + _top("one", "pool", 10, cols=""))
def nearest_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest_by_text(_texts(spark, sf_dir), spark.createDataFrame([("text", "where the tested region ends")], "query string, text string"), 10)


@query(f"SELECT 'item:' || item_id AS uri, CAST(i - 1 AS INTEGER) AS pos, v[i] AS value FROM (SELECT item_id, {LETTER_LIST.format('text')} AS v FROM benchmark), range(1, 27) t(i)")
def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("uri"), "text")
    return V.embed_batch(texts, V.letter_counts).select("uri", F.posexplode("vector").alias("pos", "value"))


# ingest

DELTA = ", deltas AS (SELECT 'user:' || user_id AS uri, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, sha256(props) AS content_hash FROM events) "


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user:"), "user_id").alias("uri"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"), F.sha2("props", 256).alias("content_hash"))


@query(DELTA + "SELECT uri, seq, action, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS rn FROM deltas) WHERE rn = 1 AND action <> 'delete'")
def apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fold_deltas(_deltas(spark, sf_dir))


@query(DELTA + "SELECT uri, content_hash, 'text' AS language, CAST(NULL AS VARCHAR) AS source_text, seq FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS rn FROM deltas) WHERE rn = 1 AND action <> 'delete'")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("action") == "delete", "remove_file").otherwise("upsert_file")
    none = F.lit(None).cast("string")
    rows = _deltas(spark, sf_dir).select(op.alias("op"), "seq", "uri", "content_hash", F.lit("text").alias("language"), none.alias("source_text"), *[none.alias(c) for c in ("symbol_uri", "key", "value", "author_id", "confidence", "timestamp_ms", "expires_ms")])
    return I.journal_replay(rows)[0]


@query(DELTA + "SELECT 'session' || (seq % 5) AS source_session, (SELECT count(*) FROM files) AS indexed_files, string_agg(DISTINCT uri, ',' ORDER BY uri) AS affected_uris FROM deltas WHERE action = 'upsert' AND seq % 5 <> 0 GROUP BY 1")
def index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = workspace(spark, sf_dir).files.agg(F.count("*").alias("indexed_files"))
    return I.index_changed(_deltas(spark, sf_dir).withColumn("client", F.concat(F.lit("session"), F.col("seq") % 5)), "session0", known)


LISTING = ", listing AS (SELECT f.uri, CAST(f.indexed_at_ms + CAST(floor(s_acctbal) AS BIGINT) - 4000 AS BIGINT) AS mtime_ms FROM files f JOIN supplier ON s_suppkey = f.id WHERE s_acctbal > 1000) "


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, supplier = workspace(spark, sf_dir).files, table(spark, sf_dir, "supplier").filter("s_acctbal > 1000")
    return files.join(supplier, F.col("s_suppkey") == F.col("id")).select("uri", (F.col("indexed_at_ms") + F.floor("s_acctbal") - 4000).alias("mtime_ms"))


@query(LISTING + "SELECT uri FROM files WHERE uri NOT IN (SELECT uri FROM listing)")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.deleted_files(workspace(spark, sf_dir), _listing(spark, sf_dir))


@query(LISTING + "SELECT (SELECT count(*) FROM files) AS checked, (SELECT count(*) FROM files WHERE uri NOT IN (SELECT uri FROM listing)) AS removed, (SELECT count(*) FROM symbols WHERE file_uri IN (SELECT uri FROM listing)) AS symbols_left")
def prune_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, counts = I.prune_deleted(workspace(spark, sf_dir), _listing(spark, sf_dir))
    return counts.crossJoin(F.broadcast(after.symbols.agg(F.count("*").alias("symbols_left"))))  # one row each


@query(LISTING + "SELECT f.uri, l.mtime_ms, f.indexed_at_ms FROM files f JOIN listing l USING (uri) WHERE f.uri LIKE 'file:///repo/%' AND l.mtime_ms > f.indexed_at_ms AND f.uri IN (SELECT uri FROM embeddings_ WHERE scope = 'file')")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stale_embeddings(workspace(spark, sf_dir), _listing(spark, sf_dir), "file:///repo/")


@query("""SELECT manager, package_name, '2.0.0' AS version, package_hash, uri, display_name, kind, signature, confidence_score FROM slice_symbols WHERE kind = 'function' AND package_name LIKE '%A%'
UNION ALL SELECT manager, package_name, version, package_hash, uri, display_name, kind, signature, confidence_score FROM slice_symbols WHERE package_name NOT LIKE '%A%'""")
def mount_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = workspace(spark, sf_dir).slice_symbols
    new = held.filter(F.col("package_name").contains("A")).withColumn("version", F.lit("2.0.0")).withColumn("confidence_score", F.lit(30))
    return I.mount_slice(held, new)


@query("SELECT count(DISTINCT manager || ':' || package_name) AS packages FROM slice_symbols")
def mounted_package_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.mounted_package_count(workspace(spark, sf_dir).slice_symbols)


@query("""SELECT manager, package_name, version, sha256(manager || ':' || package_name || '@' || version) AS package_hash, uri, display_name, kind, signature, 100 AS confidence_score,
 sha256(string_agg(uri || '|' || kind || '|' || signature, chr(10) ORDER BY uri || '|' || kind || '|' || signature) OVER (PARTITION BY package_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS content_hash FROM (
 SELECT 'cargo' AS manager, 'n' || n_nationkey AS package_name, '1.0.0' AS version, 'lip://cargo/n' || n_nationkey || '@1.0.0/' || regexp_extract(file_uri, '[^/]*$') || '#' || regexp_extract(uri, '[^#]*$') AS uri, display_name, kind, signature
 FROM nation JOIN symbols ON file_uri LIKE 'file:///repo/n' || n_nationkey || '/%')""")
def build_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    packages = n.select(F.lit("cargo").alias("manager"), F.concat(F.lit("n"), "n_nationkey").alias("package_name"), F.lit("1.0.0").alias("version"), F.concat(F.lit("/repo/n"), "n_nationkey").alias("directory"))
    return I.build_slices(workspace(spark, sf_dir).symbols, packages)


@query("SELECT DISTINCT '/work/' || lower(r_name) AS root FROM region UNION SELECT '/repo'")
def register_project_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "region").select(F.concat(F.lit("file:///work//"), F.lower("r_name"), F.lit("/")).alias("root"))
    return I.register_project_root(spark.createDataFrame([("/repo",)], "root string"), new.union(new))


@query(f"SELECT sha256('scip:' || '/work/' || n_regionkey) AS source_id, 'scip' AS tool_name, max(n_nationkey) AS tool_version, '/work/' || n_regionkey AS project_root, CAST(1000 + max(n_nationkey) AS BIGINT) AS imported_at_ms FROM nation GROUP BY n_regionkey".replace("max(n_nationkey) AS tool_version", "CAST(max(n_nationkey) AS VARCHAR) AS tool_version"))
def register_tier3_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _imports(spark, sf_dir)
    older = new.withColumn("imported_at_ms", F.col("imported_at_ms") - 1000).withColumn("tool_version", F.lit("old"))
    return I.register_tier3_source(older, new)


@query("""SELECT c_custkey AS client, CASE WHEN c_custkey % 5 = 0 THEN 'cold' WHEN c_custkey % 5 = 1 THEN 'warm_full' WHEN c_custkey % 3 > 0 THEN 'warm_partial' ELSE 'cold' END AS state FROM customer""")
def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    root = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, "held").otherwise("other")
    return c.select(F.col("c_custkey").alias("client"), S.lifecycle_state(root, F.lit("held"), F.col("c_custkey") % 3).alias("state"))


@query(", up AS (SELECT s.uri, s.confidence_score AS old, CAST(60 + p.p_size % 30 AS INTEGER) AS new FROM symbols s JOIN part p ON p.p_partkey = s.id) SELECT uri, old AS old_confidence, new AS new_confidence FROM up WHERE new > old")
def symbol_upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workspace(spark, sf_dir).symbols
    return D.upgrades_only(s.select("uri", (60 + (F.col("confidence_score") - 40) % 30).alias("confidence_score")), s)


# scalar functions, over the columns they are for


@query("SELECT uri, 'rust' AS by_extension, CASE WHEN id % 2 = 0 THEN 'go' ELSE 'rust' END AS by_hint, substr(uri, 8) AS path, 'lip://local/' || substr(uri, 8) || '#main' AS symbol, contains(lower(uri), 'tests.rs') AS is_test FROM files")
def uri_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, uri = workspace(spark, sf_dir).files, F.col("uri")
    hint = F.when(F.col("id") % 2 == 0, "Go").otherwise("none such")
    symbol = F.concat(F.lit("lip://local/"), S.strip_file_scheme(uri), F.lit("#main"))
    return f.select("uri", S.detect_language(uri).alias("by_extension"), S.detect_language(uri, hint).alias("by_hint"), S.uri_to_path(uri).alias("path"), symbol.alias("symbol"), S.is_test_file(uri).alias("is_test"))


@query("""SELECT uri, 'local' AS scope, regexp_extract(uri, '#(.*)$', 1) AS descriptor, split_part(regexp_extract(uri, '#(.*)$', 1), '(', 1) AS name, 'rust-analyzer cargo ' || replace(display_name, ' ', '-') || ' 1.' || id || ' lib.rs#f().' AS scip,
 'lip://rust-analyzer/cargo/' || replace(display_name, ' ', '-') || '@1.' || id || '/lib.rs#f().' AS scip_uri, 'f' AS container FROM symbols""")
def symbol_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import scip

    s = workspace(spark, sf_dir).symbols
    raw = F.concat(F.lit("rust-analyzer cargo "), F.replace("display_name", F.lit(" "), F.lit("-")), F.lit(" 1."), "id", F.lit(" lib.rs#f()."))
    to_uri = scip.symbol_to_uri(raw)
    return s.select("uri", S.uri_part(F.col("uri"), "scope").alias("scope"), S.uri_part(F.col("uri"), "descriptor").alias("descriptor"), S.callee_name(F.col("uri")).alias("name"), scip.uri_to_symbol(to_uri).alias("scip"), to_uri.alias("scip_uri"), scip.container_of(raw).alias("container"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity::INT & 1 > 0 THEN 'definition' WHEN l_quantity::INT & 4 > 0 THEN 'write_access' WHEN l_quantity::INT & 8 > 0 THEN 'read_access' ELSE 'reference' END AS role,
 CASE WHEN l_quantity::INT & 4 > 0 THEN 'write' WHEN l_quantity::INT & 8 > 0 THEN 'read' ELSE 'unknown' END AS kind, l_quantity::INT & 32 > 0 AS is_test, l_linenumber AS end_line, l_linenumber + 3 AS end_char FROM lineitem""")
def occurrence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import scip

    bits, at = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    r = scip.range_of(F.array(at, at, at + 3))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", scip.role_of(bits).alias("role"), scip.reference_kind_of(bits).alias("kind"), scip.is_test(bits).alias("is_test"), r["end_line"].alias("end_line"), r["end_char"].alias("end_char")
    )


@query("SELECT o_orderkey, o_orderkey % 3 < o_custkey % 3 + 1 AS inside FROM orders")
def scip_path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.repeat(F.lit("a/"), (F.col("o_custkey") % 3).cast("int")), F.repeat(F.lit("../"), (F.col("o_orderkey") % 3).cast("int")), F.lit("f.rs"))
    return o.select("o_orderkey", S.path_stays_inside(path).alias("inside"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust source for every file: a function for each of its symbols, which calls what the symbol calls."""
    ws = workspace(spark, sf_dir)
    calls = ws.edges.groupBy(F.col("from_uri").alias("uri")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(S.extract_name(F.col("to_uri")), F.lit("();")))), " ").alias("body"))
    rows = ws.symbols.join(calls, "uri", "left")
    text = F.concat(F.when(F.col("is_exported"), "pub ").otherwise(""), F.lit("fn "), S.extract_name(F.col("uri")), F.lit("(size: i32) { "), F.coalesce("body", F.lit("")), F.lit(" }"))
    return rows.groupBy(F.col("file_uri").alias("uri")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"), F.lit("rust").alias("language"))


@query("SELECT file_uri, uri, regexp_extract(uri, '#(.*)$', 1) AS display_name, 'function' AS kind, is_exported, CASE WHEN is_exported THEN 'public' ELSE 'private' END AS visibility FROM symbols")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import extract

    return extract.relation(extract.index_files(_sources(spark, sf_dir)), "symbols").select("file_uri", "uri", "display_name", "kind", "is_exported", "visibility")


@query("SELECT e.file_uri, e.from_uri, 'lip://local/' || substr(e.file_uri, 8) || '#' || regexp_extract(e.to_uri, '#(.*)$', 1) AS to_uri FROM edges e")
def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import extract

    return extract.relation(extract.index_files(_sources(spark, sf_dir)), "edges").select("file_uri", "from_uri", "to_uri")


@query("""SELECT file_uri, uri AS symbol_uri, 'definition' AS role, 'unknown' AS kind FROM symbols UNION ALL
 SELECT e.file_uri, 'lip://local/' || substr(e.file_uri, 8) || '#' || regexp_extract(e.to_uri, '#(.*)$', 1), 'reference', 'call' FROM edges e""")
def extract_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import extract

    found = extract.relation(extract.index_files(_sources(spark, sf_dir)), "occurrences").select("file_uri", "symbol_uri", "role", "kind")
    return found.filter(~F.col("symbol_uri").endswith("#size") & ~F.col("symbol_uri").endswith("#i32"))  # the parameter and its type


@query("SELECT uri, 'fn ' || replace(display_name, ' ', '_') || '(_: i32) -> Brand#' || regexp_extract(signature, '#([0-9]+)$', 1) AS signature_normalized FROM symbols")
def normalize_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.sources import extract

    return extract.enrich(workspace(spark, sf_dir).symbols).select("uri", "signature_normalized")


from lodestar.plans import lifecycle  # noqa: E402, F401 - registers its queries here
