"""The driver's star schema seen as a codebase, in Spark, and the same in DuckDB SQL for comparison."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.workspace import Workspace

ROOT = str(Path(__file__).resolve().parents[2])
AS_OF_MS = 1_704_400_000_000

#: Common table expressions that give DuckDB the relations of `workspace`.
CTES = """
WITH RECURSIVE n_supp AS (SELECT count(*) AS n FROM supplier),
files AS MATERIALIZED (
  SELECT s_suppkey AS id, 'file:///repo/n' || s_nationkey || '/s' || s_suppkey || '.rs' AS uri, 'rust' AS language, CAST(1 AS BIGINT) AS revision,
    false AS precomputed, sha256(s_name) AS content_hash, 'cargo/n' || s_nationkey AS module_id,
    CAST(1704067200000 + s_suppkey * 1000 AS BIGINT) AS indexed_at_ms, CASE WHEN s_suppkey % 3 = 0 THEN 'scip_only' ELSE 'tier1' END AS edges_source
  FROM supplier),
symbols AS MATERIALIZED (
  SELECT p_partkey AS id, f.uri AS file_uri, 'lip://local/' || substr(f.uri, 8) || '#' || replace(p_name, ' ', '_') || '_' || p_partkey AS uri,
    p_name AS display_name,
    CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'variable' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'interface' WHEN 'STANDARD' THEN 'method' ELSE 'type_alias' END AS kind,
    p_brand || ' part' AS documentation, 'fn ' || replace(p_name, ' ', '_') || '(size: i32) -> ' || p_brand AS signature, CAST(40 + p_size AS INTEGER) AS confidence_score,
    p_partkey % 3 = 0 AS is_exported, CASE WHEN p_size % 2 = 0 THEN ['async'] ELSE ['static', 'const'] END AS modifiers, p_partkey AS ordinal
  FROM part JOIN files f ON f.id = p_partkey % (SELECT n FROM n_supp)),
raw_occurrences AS (
  SELECT f.uri AS file_uri, s.uri AS symbol_uri, CAST(l_orderkey AS INTEGER) AS start_line, CAST(l_linenumber AS INTEGER) AS start_char,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'reference' WHEN l_returnflag = 'N' THEN 'write_access' ELSE 'read_access' END AS role,
    l_tax = 0 AS is_test, CAST(20 + l_linenumber AS INTEGER) AS confidence_score, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice
  FROM lineitem JOIN files f ON f.id = l_suppkey JOIN symbols s ON s.id = l_partkey
  UNION ALL
  SELECT file_uri, uri, -1, CAST(id % 100000 AS INTEGER), 'definition', false, confidence_score, -1, -1, id, -1, NULL, NULL, NULL FROM symbols),
occurrences AS MATERIALIZED (
  SELECT file_uri, symbol_uri, start_line, start_char, start_line AS end_line, start_char + 2 AS end_char, role, is_test, confidence_score,
    row_number() OVER (PARTITION BY file_uri ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, role, confidence_score, is_test) AS ordinal
  FROM raw_occurrences),
calls AS MATERIALIZED (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R'),
edges AS MATERIALIZED (
  SELECT x.file_uri, x.uri AS from_uri, y.uri AS to_uri, 'calls' AS kind, a * 100000000 + b AS ordinal, a, b
  FROM (SELECT DISTINCT a, b FROM calls WHERE b IS NOT NULL AND a <> b) c JOIN symbols x ON x.id = a JOIN symbols y ON y.id = b),
raw_annotations AS (
  SELECT 'sym:' || user_id AS symbol_uri, event_type AS key, json_extract_string(props, '$.k') AS value, 'user' || user_id AS author_id, CAST(100 AS INTEGER) AS confidence,
    epoch_us(ts) // 1000 AS timestamp_ms, CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) END AS expires_ms, ts, event_id
  FROM events),
annotations AS MATERIALIZED (
  SELECT symbol_uri, key, value, author_id, confidence, timestamp_ms, expires_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol_uri, key ORDER BY ts DESC, event_id DESC) AS rn FROM raw_annotations) WHERE rn = 1),
embeddings_ AS MATERIALIZED (
  SELECT f.uri AS uri, 'file' AS scope, e.embedding AS vector, 'm' || (e.label % 2) AS model, e.label FROM embeddings e JOIN files f ON f.id = e.vec_id WHERE e.label < 5
  UNION ALL
  SELECT s.uri, 'symbol', e.embedding, 'm' || (e.label % 2), e.label FROM embeddings e JOIN symbols s ON s.id = e.vec_id),
vectors AS (SELECT 'vec:' || vec_id AS uri, vec_id, embedding AS vector, 'm' || (label % 2) AS model, label FROM embeddings),
slice_symbols AS (
  SELECT 'cargo' AS manager, n_name AS package_name, '1.0.' || n_regionkey AS version, sha256('cargo:' || n_name || '@1.0.' || n_regionkey) AS package_hash,
    'lip://cargo/' || n_name || '@1.0.' || n_regionkey || '/lib.rs#' || lower(n_name) || '_init' AS uri, lower(n_name) || '_init' AS display_name, 'function' AS kind,
    'fn init_' || n_nationkey || '()' AS signature, CAST(100 AS INTEGER) AS confidence_score
  FROM nation)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment  # workers on this file system find the package, wherever the driver was started
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a vector of its own: (uri, vec_id, vector, model, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("vec:"), "vec_id").alias("uri"), "vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), "label")


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    supplier, part, lines = (table(spark, sf_dir, t) for t in ("supplier", "part", "lineitem"))
    files = supplier.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("file:///repo/n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit(".rs")).alias("uri"),
        F.lit("rust").alias("language"),
        F.lit(1).cast("long").alias("revision"),
        F.lit(False).alias("precomputed"),
        F.sha2("s_name", 256).alias("content_hash"),
        F.concat(F.lit("cargo/n"), "s_nationkey").alias("module_id"),
        (F.lit(1_704_067_200_000) + F.col("s_suppkey") * 1000).alias("indexed_at_ms"),
        F.when(F.col("s_suppkey") % 3 == 0, "scip_only").otherwise("tier1").alias("edges_source"),
    )
    count = supplier.agg(F.count("*").alias("n"))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    kinds = {"ECONOMY": "function", "SMALL": "variable", "MEDIUM": "class", "PROMO": "interface", "STANDARD": "method"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("p_type")], F.lit("type_alias"))
    symbols = (
        part.crossJoin(F.broadcast(count))  # one row
        .withColumn("fid", F.col("p_partkey") % F.col("n"))
        .join(files.select(F.col("id").alias("fid"), F.col("uri").alias("file_uri")), "fid")
        .select(
            F.col("p_partkey").alias("id"),
            "file_uri",
            F.concat(F.lit("lip://local/"), F.substr("file_uri", F.lit(8)), F.lit("#"), name, F.lit("_"), "p_partkey").alias("uri"),
            F.col("p_name").alias("display_name"),
            kind.alias("kind"),
            F.concat("p_brand", F.lit(" part")).alias("documentation"),
            F.concat(F.lit("fn "), name, F.lit("(size: i32) -> "), "p_brand").alias("signature"),
            (F.lit(40) + F.col("p_size")).cast("int").alias("confidence_score"),
            (F.col("p_partkey") % 3 == 0).alias("is_exported"),
            F.when(F.col("p_size") % 2 == 0, F.array(F.lit("async"))).otherwise(F.array(F.lit("static"), F.lit("const"))).alias("modifiers"),
            F.col("p_partkey").alias("ordinal"),
        )
    )
    uses = lines.join(files.select(F.col("id").alias("l_suppkey"), F.col("uri").alias("file_uri")), "l_suppkey").join(
        symbols.select(F.col("id").alias("l_partkey"), F.col("uri").alias("symbol_uri")), "l_partkey"
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    role = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "reference").when(F.col("l_returnflag") == "N", "write_access").otherwise("read_access")
    uses = uses.select(
        "file_uri", "symbol_uri", F.col("l_orderkey").cast("int").alias("start_line"), F.col("l_linenumber").cast("int").alias("start_char"), role.alias("role"),
        (F.col("l_tax") == 0).alias("is_test"), (F.lit(20) + F.col("l_linenumber")).cast("int").alias("confidence_score"), *order,
    )
    defs = symbols.select(
        "file_uri", F.col("uri").alias("symbol_uri"), F.lit(-1).alias("start_line"), (F.col("id") % 100_000).cast("int").alias("start_char"), F.lit("definition").alias("role"),
        F.lit(False).alias("is_test"), "confidence_score", F.lit(-1).cast("long").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"), F.col("id").alias("l_partkey"),
        F.lit(None).cast("timestamp_ntz").alias("l_shipdate"), F.lit(None).cast("double").alias("l_quantity"), F.lit(None).cast("double").alias("l_extendedprice"),
    )
    defs = defs.withColumn("l_shipdate", F.col("l_shipdate").cast(dict(uses.dtypes)["l_shipdate"]))
    by = Window.partitionBy("file_uri").orderBy(*[F.col(c).asc_nulls_last() for c in [*order, "role", "confidence_score", "is_test"]])
    occurrences = uses.unionByName(defs).select(
        "file_uri", "symbol_uri", "start_line", "start_char", F.col("start_line").alias("end_line"), (F.col("start_char") + 2).alias("end_char"), "role", "is_test", "confidence_score",
        F.row_number().over(by).cast("long").alias("ordinal"),
    )
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    calls = lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), following.alias("b")).filter("b is not null and a <> b").distinct()
    ends = symbols.select("id", "uri", "file_uri")
    edges = (
        calls.join(ends.select(F.col("id").alias("a"), F.col("uri").alias("from_uri"), "file_uri"), "a")
        .join(ends.select(F.col("id").alias("b"), F.col("uri").alias("to_uri")), "b")
        .select("file_uri", "from_uri", "to_uri", F.lit("calls").alias("kind"), (F.col("a") * 100_000_000 + F.col("b")).alias("ordinal"))
    )
    events = table(spark, sf_dir, "events")
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))")
    latest = Window.partitionBy("symbol_uri", "key").orderBy(F.desc("ts"), F.desc("event_id"))
    annotations = (
        events.select(
            F.concat(F.lit("sym:"), "user_id").alias("symbol_uri"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.concat(F.lit("user"), "user_id").alias("author_id"),
            F.lit(100).alias("confidence"), millis.alias("timestamp_ms"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(millis + F.floor(F.col("value") * 100_000)).alias("expires_ms"), "ts", "event_id",
        )
        .withColumn("rn", F.row_number().over(latest))
        .filter("rn = 1")
        .drop("rn", "ts", "event_id")
    )
    held = table(spark, sf_dir, "embeddings").withColumn("model", F.concat(F.lit("m"), F.col("label") % 2))
    of_files = held.filter("label < 5").join(files.select(F.col("id").alias("vec_id"), "uri"), "vec_id").select("uri", F.lit("file").alias("scope"), F.col("embedding").alias("vector"), "model")
    of_symbols = held.join(symbols.select(F.col("id").alias("vec_id"), "uri"), "vec_id").select("uri", F.lit("symbol").alias("scope"), F.col("embedding").alias("vector"), "model")
    nation = table(spark, sf_dir, "nation")
    version = F.concat(F.lit("1.0."), "n_regionkey")
    low = F.concat(F.lower("n_name"), F.lit("_init"))
    slices = nation.select(
        F.lit("cargo").alias("manager"), F.col("n_name").alias("package_name"), version.alias("version"), F.sha2(F.concat(F.lit("cargo:"), "n_name", F.lit("@"), version), 256).alias("package_hash"),
        F.concat(F.lit("lip://cargo/"), "n_name", F.lit("@"), version, F.lit("/lib.rs#"), low).alias("uri"), low.alias("display_name"), F.lit("function").alias("kind"),
        F.concat(F.lit("fn init_"), "n_nationkey", F.lit("()")).alias("signature"), F.lit(100).alias("confidence_score"),
    )
    return Workspace.empty(spark, AS_OF_MS).with_(
        files=files, symbols=symbols, occurrences=occurrences, edges=edges, annotations=annotations, embeddings=of_files.unionByName(of_symbols), slice_symbols=slices, extra={"vectors": vectors(spark, sf_dir)}
    )
