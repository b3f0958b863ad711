"""A workspace: the relations of an indexed codebase as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lodestar import schemas


@dataclass(frozen=True)
class Workspace:
    """Relations by name; as_of_ms takes the place of a clock, so results can be repeated."""

    spark: SparkSession
    files: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    edges: DataFrame
    annotations: DataFrame
    embeddings: DataFrame
    slice_symbols: DataFrame
    tier3_sources: DataFrame
    roots: DataFrame
    as_of_ms: int = 0
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **changes: object) -> Workspace:
        return replace(self, **changes)

    @staticmethod
    def empty(spark: SparkSession, as_of_ms: int = 0) -> Workspace:
        def table(schema: str) -> DataFrame:
            return spark.createDataFrame([], schema)

        return Workspace(
            spark,
            files=table(schemas.FILES),
            symbols=table(schemas.SYMBOLS),
            occurrences=table(schemas.OCCURRENCES),
            edges=table(schemas.EDGES),
            annotations=table(schemas.ANNOTATIONS),
            embeddings=table(schemas.EMBEDDINGS),
            slice_symbols=table(schemas.SLICES),
            tier3_sources=table(schemas.TIER3_SOURCES),
            roots=table("root string"),
            as_of_ms=as_of_ms,
        )
