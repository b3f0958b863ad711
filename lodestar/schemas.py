"""Schemas of the relations and the enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOL_KINDS = (
    "unknown", "namespace", "class", "interface", "method", "field", "variable", "function",
    "type_parameter", "parameter", "macro", "enum", "enum_member", "constructor", "type_alias",
)
#: The number of each kind in the surface fingerprint.
KIND_CODES = {kind: code for code, kind in enumerate(SYMBOL_KINDS)}
ROLES = ("definition", "reference", "implementation", "type_binding", "read_access", "write_access")
REFERENCE_KINDS = ("unknown", "call", "read", "write", "type", "implements", "extends")
EDGE_KINDS = ("calls", "data_flows", "control_flows", "instantiates", "inherits", "imports")
VISIBILITIES = ("public", "private", "internal", "protected")
EXTRACTION_TIERS = ("tier1", "tier1p5", "tier2", "tier3_scip")
MODIFIERS_SOURCES = ("proto", "prefix_parse")
INDEXING_STATES = ("cold", "warm_partial", "warm_full")
RISK_LEVELS = ("low", "medium", "high")
EDGES_SOURCES = ("tier1", "scip_with_tier1_edges", "scip_only", "empty")
IMPACT_SOURCES = ("static", "semantic", "both")
MATCH_TYPES = ("exact", "prefix", "fuzzy")
ERROR_CODES = (
    "unknown_message_type", "unknown_model", "embedding_not_configured", "no_embedding",
    "cursor_out_of_range", "index_locked", "invalid_request", "internal",
)
END_REASONS = ("budget_reached", "exhausted", "cursor_out_of_range", "file_not_indexed", "error")
#: Kinds whose change can break a caller.
CALLABLE_KINDS = ("function", "method", "class", "interface", "constructor", "macro")

RANGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_char", "end_line", "end_char")])
RELATIONSHIP = T.StructType([T.StructField("target_uri", T.StringType()), T.StructField("kind", T.StringType())])
COMPLETENESS = T.StructType([T.StructField("score", T.FloatType()), T.StructField("reason", T.StringType())])


FILES = "uri string, text string, language string, revision long, precomputed boolean, content_hash string, module_id string, indexed_at_ms long, edges_source string"
SYMBOLS = (
    "file_uri string, uri string, display_name string, kind string, documentation string, signature string, confidence_score int, "
    "relationships array<struct<target_uri:string,kind:string>>, runtime_p99_ms float, call_rate_per_s float, taint_labels array<string>, blast_radius long, "
    "is_exported boolean, signature_normalized string, modifiers array<string>, visibility string, container_name string, visibility_confidence float, "
    "completeness struct<score:float,reason:string>, extraction_tier string, modifiers_source string, ordinal long"
)
#: What counts for equality of two symbols; telemetry and provenance don't.
STRUCTURAL = (
    "uri", "display_name", "kind", "documentation", "signature", "confidence_score", "relationships", "taint_labels",
    "blast_radius", "is_exported", "signature_normalized", "modifiers", "visibility", "container_name",
)
OCCURRENCES = (
    "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, confidence_score int, role string, "
    "override_doc string, kind string, is_test boolean, ordinal long"
)
EDGES = "file_uri string, from_uri string, to_uri string, kind string, ordinal long"
ANNOTATIONS = "symbol_uri string, key string, value string, author_id string, confidence int, timestamp_ms long, expires_ms long"
EMBEDDINGS = "uri string, scope string, vector array<float>, model string"
SLICES = "manager string, package_name string, version string, package_hash string, content_hash string, uri string, display_name string, kind string, signature string, confidence_score int"
TIER3_SOURCES = "source_id string, tool_name string, tool_version string, project_root string, imported_at_ms long"
DELTAS = (
    "client string, seq long, action string, document struct<uri:string,content_hash:string,language:string,source_text:string,"
    "symbols:array<struct<uri:string,display_name:string,kind:string,signature:string,confidence_score:int,is_exported:boolean>>,"
    "occurrences:array<struct<symbol_uri:string,start_line:int,start_char:int,end_line:int,end_char:int,role:string>>,"
    "edges:array<struct<from_uri:string,to_uri:string,kind:string>>>"
)
EVENT_STREAM = f"schema_version int, emitter_id string, timestamp_ms long, deltas array<struct<{DELTAS.replace('client string', 'client:string').replace(', seq long', ',seq:long').replace(', action string', ',action:string').replace(', document struct', ',document:struct')}>>"
JOURNAL = "op string, seq long, uri string, content_hash string, language string, source_text string, symbol_uri string, key string, value string, author_id string, confidence int, timestamp_ms long, expires_ms long, merkle_root string"
