"""The request surface: a catalogue of operators, and batches of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

VERSION, PROTOCOL = "1.0", 2
#: What changes the index or waits for another service: no members of a batch.
NOT_BATCHABLE = frozenset({"manifest", "delta", "batch", "batch_query", "stream_context", "reindex_files", "reindex_stale", "embed_batch", "embed_text", "prune_deleted", "register_project_root", "register_tier3_source"})


class RequestError(Exception):
    """An answer with a code of schemas.ERROR_CODES."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class UnknownOperator(RequestError):
    def __init__(self, name: str, supported: Sequence[str]) -> None:
        super().__init__("unknown_message_type", f"{name} isn't an operator; supported: {', '.join(supported)}")
        self.supported = list(supported)


@dataclass(frozen=True)
class Answer:
    """A slot of a batch: a result, or the error of this member alone."""

    result: DataFrame | None = None
    error: str | None = None
    code: str | None = None


class Service:
    """Operators by name, each a function of a workspace and parameters that returns a DataFrame."""

    def __init__(self, operators: dict[str, Callable[..., DataFrame]]) -> None:
        self.operators = operators

    def handshake(self) -> dict[str, object]:
        return {"version": VERSION, "protocol": PROTOCOL, "supported": sorted(self.operators)}

    def query(self, name: str, *args: object, **params: object) -> DataFrame:
        if name not in self.operators:
            raise UnknownOperator(name, sorted(self.operators))
        return self.operators[name](*args, **params)

    def batch_query(self, requests: Sequence[tuple[str, tuple, dict]]) -> list[Answer]:
        """Answers in order; a member's error leaves the others alone. DataFrames are lazy, so common relations are planned once each."""
        out = []
        for name, args, params in requests:
            if name in NOT_BATCHABLE:
                out.append(Answer(error=f"{name} can't be part of a batch", code="invalid_request"))
                continue
            try:
                out.append(Answer(self.query(name, *args, **params)))
            except RequestError as e:
                out.append(Answer(error=str(e), code=e.code))
            except Exception as e:  # noqa: BLE001 - each slot answers for itself
                out.append(Answer(error=str(e), code="internal"))
        return out

    def batch(self, requests: Sequence[tuple[str, tuple, dict]]) -> list[Answer]:
        """As batch_query, but refused as a whole if a member can't be part of one."""
        bad = [name for name, _, _ in requests if name in NOT_BATCHABLE]
        if bad:
            raise RequestError("invalid_request", f"{', '.join(bad)} can't be part of a batch")
        return self.batch_query(requests)


def default_service() -> Service:
    from lodestar.operators import graph, lookup, relations, vectors

    names = {
        lookup: ["symbols_at_positions", "query_definition", "query_hover", "query_references", "document_symbols", "file_occurrences", "symbol_by_uri", "symbols_by_name", "workspace_symbols", "similar_symbols", "stale_files", "file_status", "index_status", "abi_hash", "api_surface", "glob_files"],
        relations: ["reverse_deps", "dead_symbols", "resolve_definition", "invalidated_files", "canonicalize", "coverage", "annotation_get", "annotation_list", "annotation_prefix", "batch_annotation_get", "purge_expired"],
        graph: ["blast_radius", "blast_radius_items", "blast_radius_batch", "outgoing_calls", "outgoing_impact", "infer_confidence", "rank_context", "stream_context"],
        vectors: ["nearest", "nearest_by_contrast", "nearest_in_store", "find_counterpart", "query_expansion", "similarity", "similarity_matrix", "centroid", "outliers", "novelty", "terminology", "export_embeddings", "cluster", "find_boundaries", "explain_match", "semantic_diff", "nearest_by_text", "embed_batch"],
    }
    return Service({n: getattr(module, n) for module, own in names.items() for n in own})
