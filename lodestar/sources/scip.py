"""SCIP index files: a reader and a writer of the protobuf wire format, and the conversions to our relations.

The reader keeps to the fields in use: documents (1 of Index... see FIELDS), their occurrences and symbols, external symbols.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.storage import hadoop_path, stored

#: Field numbers of the messages.
FIELDS = {
    "index": {"metadata": 1, "documents": 2, "external_symbols": 3},
    "metadata": {"version": 1, "tool_info": 2, "project_root": 3, "text_document_encoding": 4},
    "tool": {"name": 1, "version": 2, "arguments": 3},
    "document": {"relative_path": 1, "occurrences": 2, "symbols": 3, "language": 4},
    "occurrence": {"range": 1, "symbol": 2, "symbol_roles": 3, "override_documentation": 4},
    "symbol": {"symbol": 1, "documentation": 3, "relationships": 4, "kind": 5, "display_name": 6, "enclosing_symbol": 8},
    "relationship": {"symbol": 1, "is_reference": 2, "is_implementation": 3, "is_type_definition": 4},
}
DEFINITION, WRITE, READ, TEST = 1, 4, 8, 32
_KINDS = {7: "class", 8: "constructor", 11: "enum", 12: "enum_member", 15: "variable", 17: "function", 21: "interface", 25: "macro", 26: "function", 29: "namespace", 30: "namespace", 37: "parameter", 49: "class", 53: "interface", 54: "type_alias", 55: "type_alias", 58: "type_parameter", 61: "variable", 9: "variable", 35: "namespace", 80: "function", 66: "function"}
_CODES = {"class": 7, "constructor": 8, "enum": 11, "enum_member": 12, "field": 15, "function": 17, "interface": 21, "macro": 25, "method": 26, "namespace": 30, "parameter": 37, "type_alias": 55, "type_parameter": 58, "variable": 61}


# wire format


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def read_message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) in order; length-delimited values as bytes."""
    at, end = 0, len(data)
    while at < end:
        tag, at = (data[at], at + 1) if data[at] < 128 else read_varint(data, at)
        if tag & 7 == 0:
            value, at = read_varint(data, at)
        elif tag & 7 == 2:
            size, at = (data[at], at + 1) if data[at] < 128 else read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {tag & 7} isn't in use")
        yield tag >> 3, value


def varint(n: int) -> bytes:
    out = bytearray()
    n = int(n) & (1 << 64) - 1  # a negative number as its two's complement
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(field: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return varint(field << 3) + varint(value) if value else b""
    raw = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def unpack(value: int | bytes) -> list[int]:
    """Packed or single numbers."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = read_varint(value, at)
        out.append(n - (1 << 64) if n >> 63 else n)
    return out


def _symbol(data: bytes) -> dict:
    f = FIELDS["symbol"]
    out = {"symbol": "", "documentation": [], "relationships": [], "kind": 0, "display_name": "", "enclosing_symbol": ""}
    for k, v in read_message(data):
        if k == f["documentation"]:
            out["documentation"].append(v.decode())
        elif k == f["relationships"]:
            own = dict(read_message(v))
            kind = "implementation" if own.get(3) else "type" if own.get(4) else "reference"
            out["relationships"].append({"target_uri": own.get(1, b"").decode(), "kind": kind})
        elif k == f["kind"]:
            out["kind"] = v
        elif k in (f["symbol"], f["display_name"], f["enclosing_symbol"]):
            out[next(n for n, i in f.items() if i == k)] = v.decode()
    return out


def decode_index(data: bytes) -> Iterator[dict]:
    """The documents of an index; external symbols make a last one, scip://external."""
    external = []
    for k, v in read_message(data):
        if k == FIELDS["index"]["documents"]:
            doc = {"relative_path": "", "language": "", "occurrences": [], "symbols": []}
            f = FIELDS["document"]
            for j, x in read_message(v):
                if j == f["relative_path"]:
                    doc["relative_path"] = x.decode()
                elif j == f["language"]:
                    doc["language"] = x.decode()
                elif j == f["symbols"]:
                    doc["symbols"].append(_symbol(x))
                elif j == f["occurrences"]:
                    own = {"range": [], "symbol": "", "symbol_roles": 0, "override_documentation": []}
                    for n, y in read_message(x):
                        if n == 1:
                            own["range"] += unpack(y)
                        elif n == 2:
                            own["symbol"] = y.decode()
                        elif n == 3:
                            own["symbol_roles"] = y
                        elif n == 4:
                            own["override_documentation"].append(y.decode())
                    doc["occurrences"].append(own)
            yield doc
        elif k == FIELDS["index"]["external_symbols"]:
            external.append(_symbol(v))
    if external:
        yield {"relative_path": "scip://external", "language": "", "occurrences": [], "symbols": external}


DOCUMENT = (
    "relative_path string, language string, occurrences array<struct<range:array<int>,symbol:string,symbol_roles:int,override_documentation:array<string>>>, "
    "symbols array<struct<symbol:string,documentation:array<string>,relationships:array<struct<target_uri:string,kind:string>>,kind:int,display_name:string,enclosing_symbol:string>>"
)


_RELATIONSHIPS = pa.list_(pa.struct([("target_uri", pa.string()), ("kind", pa.string())]))
ARROW = pa.schema([
    ("relative_path", pa.string()), ("language", pa.string()),
    ("occurrences", pa.list_(pa.struct([("range", pa.list_(pa.int32())), ("symbol", pa.string()), ("symbol_roles", pa.int32()), ("override_documentation", pa.list_(pa.string()))]))),
    ("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("documentation", pa.list_(pa.string())), ("relationships", _RELATIONSHIPS), ("kind", pa.int32()), ("display_name", pa.string()), ("enclosing_symbol", pa.string())]))),
])
#: Occurrences and symbols of documents that are held at once; bounds memory, has no effect on results.
HELD = 10_000


def document_batches(data: bytes) -> Iterator[pa.RecordBatch]:
    """The documents of an index, some at a time."""
    held, size = [], 0
    for doc in decode_index(data):
        held.append(doc)
        size += len(doc["occurrences"]) + len(doc["symbols"]) + 1
        if size >= HELD:
            yield pa.RecordBatch.from_pylist(held, ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, ARROW)


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the index files at a path; those whose path leaves the root are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from document_batches(data.as_py())

    rows = spark.read.format("binaryFile").load(path).select("content").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, DOCUMENT)
    return rows.filter((F.col("relative_path") == "scip://external") | S.path_stays_inside(F.col("relative_path")))


# columns


def symbol_to_uri(symbol: Column) -> Column:
    """`scheme manager package version descriptor` as lip://scheme/manager/package@version/descriptor; others below lip://scip/."""
    p = F.split(symbol, " ", 5)
    return F.when(
        (F.size(p) == 5) & ~symbol.startswith("local "), F.concat(F.lit("lip://"), p[0], F.lit("/"), p[1], F.lit("/"), p[2], F.lit("@"), p[3], F.lit("/"), p[4])
    ).otherwise(F.concat(F.lit("lip://scip/"), F.replace(symbol, F.lit(" "), F.lit("_"))))


def uri_to_symbol(uri: Column) -> Column:
    """The inverse, for URIs of that form; others become `local` symbols."""
    m = r"^lip://([^/]+)/([^/]+)/([^@]+)@([^/]*)/(.*)$"
    parts = [F.regexp_extract(uri, m, i) for i in range(1, 6)]
    return F.when(uri.rlike(m), F.concat_ws(" ", *parts)).otherwise(F.concat(F.lit("local "), F.regexp_replace(uri, r"^lip://(scip/)?", "")))


def range_of(numbers: Column) -> Column:
    """[line, start, end] or [line, start, line, end] as a struct; null for others."""
    n = numbers
    three = F.struct(n[0].alias("start_line"), n[1].alias("start_char"), n[0].alias("end_line"), n[2].alias("end_char"))
    four = F.struct(n[0].alias("start_line"), n[1].alias("start_char"), n[2].alias("end_line"), n[3].alias("end_char"))
    return F.when(F.size(n) == 3, three).when(F.size(n) == 4, four)


def kind_of(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p])[code], F.lit("unknown"))


def code_of(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in _CODES.items() for x in p])[kind], F.lit(0))


def role_of(bits: Column) -> Column:
    """Definition, else write, else read access, else reference."""
    has = lambda b: bits.bitwiseAND(b) != 0
    return F.when(has(DEFINITION), "definition").when(has(WRITE), "write_access").when(has(READ), "read_access").otherwise("reference")


def reference_kind_of(bits: Column) -> Column:
    return F.when(bits.bitwiseAND(WRITE) != 0, "write").when(bits.bitwiseAND(READ) != 0, "read").otherwise("unknown")


def is_test(bits: Column) -> Column:
    return bits.bitwiseAND(TEST) != 0


_KEYWORDS = ("fn ", "pub ", "def ", "class ", "func ", "fun ", "function ", "struct ", "enum ", "trait ", "interface ", "type ", "const ", "let ", "var ", "val ", "static ", "async ", "export ", "impl ", "```")


def signature_and_documentation(docs: Column) -> Column:
    """Of several texts the first is the signature; a single one is, if it begins like a declaration."""
    one = F.exists(F.array(*map(F.lit, _KEYWORDS)), lambda k: F.startswith(F.ltrim(F.get(docs, 0)), k))
    none = F.lit(None).cast("string")
    rest = F.nullif(F.array_join(F.slice(docs, F.lit(2), F.greatest(F.size(docs) - 1, F.lit(1))), "\n\n"), F.lit(""))
    return (
        F.when(F.size(docs) >= 2, F.struct(docs[0].alias("signature"), rest.alias("documentation")))
        .when((F.size(docs) == 1) & one, F.struct(docs[0].alias("signature"), none.alias("documentation")))
        .when(F.size(docs) == 1, F.struct(none.alias("signature"), docs[0].alias("documentation")))
        .otherwise(F.struct(none.alias("signature"), none.alias("documentation")))
    )


def container_of(symbol: Column) -> Column:
    """The last name in the descriptor of an enclosing symbol; null for none."""
    last = F.regexp_extract(F.get(F.split(symbol, " ", 5), 4), r"([^/#.:()`\[\]]+)[/#.:()`\[\]]*$", 1)
    return F.nullif(last, F.lit(""))


def modifiers_of(signature: Column) -> Column:
    """The words before the keyword that declares: pub, async, static and so on."""
    known = ["pub", "public", "private", "protected", "internal", "static", "async", "const", "final", "abstract", "override", "open", "sealed", "unsafe", "extern", "export", "default", "virtual", "inline", "readonly", "suspend", "data", "mut"]
    words = F.split(F.ltrim(F.coalesce(signature, F.lit(""))), r"\s+")
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(True).alias("on"))

    def take(acc: Column, w: Column) -> Column:
        on = acc["on"] & w.isin(*known)
        return F.struct(F.when(on, F.concat(acc["held"], F.array(w))).otherwise(acc["held"]).alias("held"), on.alias("on"))

    return F.aggregate(words, start, take, lambda acc: acc["held"])


def to_symbols(documents: DataFrame, confidence: int = 90, root: str = "") -> DataFrame:
    """Symbol rows of SCIP documents."""
    rows = documents.select("relative_path", "language", F.posexplode("symbols").alias("ordinal", "s"))
    both = signature_and_documentation(F.col("s.documentation"))
    rows = rows.withColumn("text", both).withColumn("mods", modifiers_of(F.col("text.signature")))
    name = F.when(F.coalesce(F.col("s.display_name"), F.lit("")) != "", F.col("s.display_name")).otherwise(container_of(F.col("s.symbol")))
    file = F.when(F.col("relative_path") == "scip://external", F.col("relative_path")).otherwise(S.document_uri(F.lit(root), F.col("relative_path")))
    visibility = F.when(F.arrays_overlap("mods", F.array(F.lit("private"))), "private").when(F.arrays_overlap("mods", F.array(F.lit("protected"))), "protected").when(
        F.arrays_overlap("mods", F.array(F.lit("pub"), F.lit("public"), F.lit("export"))), "public"
    )
    return rows.select(
        file.alias("file_uri"), symbol_to_uri(F.col("s.symbol")).alias("uri"), name.alias("display_name"), kind_of(F.col("s.kind")).alias("kind"), F.col("text.documentation").alias("documentation"),
        F.col("text.signature").alias("signature"), F.lit(confidence).alias("confidence_score"), F.transform("s.relationships", lambda r: F.struct(symbol_to_uri(r["target_uri"]).alias("target_uri"), r["kind"].alias("kind"))).alias("relationships"),
        (~F.col("s.symbol").startswith("local ")).alias("is_exported"), F.col("mods").alias("modifiers"), visibility.alias("visibility"), container_of(F.col("s.enclosing_symbol")).alias("container_name"),
        F.lit("tier3_scip").alias("extraction_tier"), F.lit("prefix_parse").alias("modifiers_source"), F.col("ordinal").cast("long").alias("ordinal"),
    )


def to_occurrences(documents: DataFrame, confidence: int = 90, root: str = "") -> DataFrame:
    """Occurrence rows of SCIP documents; those without a proper range are dropped."""
    rows = documents.select("relative_path", F.posexplode("occurrences").alias("ordinal", "o")).withColumn("r", range_of(F.col("o.range"))).filter("r is not null")
    bits = F.coalesce(F.col("o.symbol_roles"), F.lit(0))
    return rows.select(
        S.document_uri(F.lit(root), F.col("relative_path")).alias("file_uri"), symbol_to_uri(F.col("o.symbol")).alias("symbol_uri"), "r.*", F.lit(confidence).alias("confidence_score"), role_of(bits).alias("role"),
        F.nullif(F.array_join("o.override_documentation", "\n\n"), F.lit("")).alias("override_doc"), reference_kind_of(bits).alias("kind"), is_test(bits).alias("is_test"), F.col("ordinal").cast("long").alias("ordinal"),
    )


def verify_import(documents: DataFrame, files: DataFrame, root: str = "", sample: int = 10) -> DataFrame:
    """(uri, indexed) of the first `sample` documents by path: whether the index has them."""
    head = documents.filter("relative_path <> 'scip://external'").select(S.document_uri(F.lit(root), F.col("relative_path")).alias("uri")).orderBy("uri").limit(sample)
    return head.join(files.select("uri", F.lit(True).alias("known")), "uri", "left").select("uri", F.coalesce("known", F.lit(False)).alias("indexed"))


# writer


def encode_document(path: str, language: str, symbols: list[dict], occurrences: list[dict]) -> bytes:
    out = [put(1, path)]
    for o in occurrences:
        numbers = b"".join(varint(n) for n in o["range"])
        out.append(put(2, put(1, numbers) + put(2, o["symbol"]) + put(3, o["symbol_roles"])))
    for s in symbols:
        own = put(1, s["symbol"]) + b"".join(put(3, d) for d in s["documentation"]) + put(5, s["kind"]) + put(6, s["display_name"])
        out.append(put(3, own))
    return b"".join(out) + put(4, language)


def _encoded(symbols: DataFrame, occurrences: DataFrame, root: str) -> DataFrame:
    """(file_uri, data): a document per file. Occurrences and symbols are encoded row by row and joined as bytes, so that no task holds a batch of documents as objects."""

    @F.arrow_udf("binary")
    def occurrence(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, symbol: pa.Array, roles: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (a, b, c, d, symbol, roles)), strict=True)
        return pa.array([put(2, put(1, b"".join(map(varint, r[:4]))) + put(2, r[4]) + put(3, r[5])) for r in rows], pa.binary())

    @F.arrow_udf("binary")
    def symbol(name: pa.Array, docs: pa.Array, kind: pa.Array, display: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (name, docs, kind, display)), strict=True)
        return pa.array([put(3, put(1, n) + b"".join(put(3, x) for x in d) + put(5, k) + put(6, p)) for n, d, k, p in rows], pa.binary())

    bits = F.when(F.col("role") == "definition", DEFINITION).when(F.col("role") == "write_access", WRITE).when(F.col("role") == "read_access", READ).otherwise(0) + F.when(F.col("is_test"), TEST).otherwise(0)
    docs = F.filter(F.array("signature", "documentation"), lambda x: x.isNotNull())
    n = F.coalesce("ordinal", F.lit(0)).alias("n")
    o = occurrences.select("file_uri", F.lit(0).alias("part"), n, occurrence("start_line", "start_char", "end_line", "end_char", uri_to_symbol(F.col("symbol_uri")), bits.cast("int")).alias("data"))
    s = symbols.select("file_uri", F.lit(1).alias("part"), n, symbol(uri_to_symbol(F.col("uri")), docs, code_of(F.col("kind")), "display_name").alias("data"))
    rows = o.unionByName(s).groupBy("file_uri").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY struct(part, n, data))").alias("data"))
    rel = S.relative_path(F.regexp_replace("file_uri", "^lip://local/", ""), root)

    @F.arrow_udf("binary")
    def whole(path: pa.Array, language: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([put(2, put(1, p) + d.as_py() + put(4, g)) for p, g, d in zip(path.to_pylist(), language.to_pylist(), data, strict=True)], pa.binary())

    return rows.select("file_uri", whole(rel, S.detect_language(F.col("file_uri")), "data").alias("data"))


def _head(tool: str, version: str, root: str) -> bytes:
    return put(1, put(2, put(1, tool) + put(2, version)) + put(3, root))


def write_scip(symbols: DataFrame, occurrences: DataFrame, path: str, tool: str = "lodestar", version: str = "1", root: str = "") -> int:
    """Writes one index file and returns its number of documents; texts and call edges have no place in it.

    Documents are encoded in the workers, all at once, and then pass the driver one partition at a time: the format is a single file. The path is of any Hadoop file system.
    """
    rows = stored(_encoded(symbols, occurrences, root)).orderBy("file_uri").select("data")
    fs, at = hadoop_path(symbols.sparkSession, path)
    out, count = fs.create(at, True), 0
    try:
        out.write(bytearray(_head(tool, version, root)))
        for row in rows.toLocalIterator():
            out.write(bytearray(row["data"]))
            count += 1
    finally:
        out.close()
    return count


#: Bytes of an index file of a folder.
PART_BYTES = 8 << 20


def write_scip_folder(symbols: DataFrame, occurrences: DataFrame, path: str, tool: str = "lodestar", version: str = "1", root: str = "") -> int:
    """Writes a folder of index files of about PART_BYTES, each whole, and returns the number of documents; read_scip() reads them side by side.

    Where the folder is of a file system that workers have mounted (file:), tasks write it; else the files pass the driver.
    """
    spark = symbols.sparkSession
    rows, head, most = _encoded(symbols, occurrences, root), _head(tool, version, root), PART_BYTES
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at)
    if fs.getScheme() == "file":
        folder = at.toUri().getPath()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, attempt, k, count, size, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, 0, 0, None

            def close() -> None:  # a task that runs again writes the same names
                if out is not None:
                    out.close()
                    os.replace(out.name, f"{folder}/part-{part:05d}-{k:05d}.scip")

            for batch in batches:
                for data in batch.column(0):
                    if out is None or size >= most:
                        close()
                        k, size = k + (out is not None), 0
                        out = open(f"{folder}/_{part}-{k}-{attempt}", "wb")  # noqa: SIM115
                        out.write(head)
                    held = data.as_py()
                    out.write(held)
                    size, count = size + len(held), count + 1
            close()
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

        return rows.orderBy("file_uri").select("data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    out, count, size, k = None, 0, 0, 0
    try:
        for row in stored(rows).orderBy("file_uri").select("data").toLocalIterator():
            if out is None or size >= most:
                if out is not None:
                    out.close()
                out, size, k = fs.create(hadoop_path(spark, f"{path}/part-{k:05d}.scip")[1], True), 0, k + 1
                out.write(bytearray(head))
            out.write(bytearray(row["data"]))
            size, count = size + len(row["data"]), count + 1
    finally:
        if out is not None:
            out.close()
    return count
