"""Scalar functions as native columns: names, URIs, hashes, vectors, risk and confidence."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.schemas import KIND_CODES

_WORD_END = r"[^\p{L}\p{N}_]+$"


def extract_name(uri: Column) -> Column:
    """What follows the last #; the whole URI without one."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(uri)


def callee_name(uri: Column) -> Column:
    """The bare name of a symbol URI: its fragment up to a parenthesis, without a trailing run of punctuation."""
    return F.regexp_replace(F.substring_index(extract_name(uri), "(", 1), _WORD_END, "")


def uri_part(uri: Column, part: str) -> Column:
    """scope, package, version, path or descriptor of lip://scope/package@version/path#descriptor; null where it has none."""
    pattern = {
        "scope": r"^lip://([^/]+)/",
        "package": r"^lip://[^/]+/([^@/#]+)",
        "version": r"^lip://[^/]+/[^@/#]+@([^/#]+)",
        "path": r"^lip://[^/]+/[^/#]*/([^#]*)",
        "descriptor": r"#(.*)$",
    }[part]
    return F.nullif(F.regexp_extract(uri, pattern, 1), F.lit(""))


def is_valid_uri(uri: Column) -> Column:
    return uri.startswith("lip://") & ~F.contains(uri, F.lit("\0")) & ~F.contains(uri, F.lit(".."))


def uri_to_path(uri: Column) -> Column:
    """The path of a file://, local or bare URI; null for others."""
    bare = ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    local = F.concat(F.lit("/"), F.regexp_replace(F.substring_index(uri, "#", 1), r"^lip://local/+", ""))
    return F.when(uri.startswith("file://"), F.regexp_replace(uri, "^file://", "")).when(uri.startswith("lip://local/"), local).when(bare, uri)


def strip_file_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def relative_path(uri: Column, root: str) -> Column:
    """The path below root; the whole path where it isn't below."""
    path = strip_file_scheme(uri)
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def document_uri(root: Column, rel: Column) -> Column:
    """lip://local/ followed by the joined path, or the relative one without a root."""
    return F.concat(F.lit("lip://local/"), F.when(F.coalesce(root, F.lit("")) == "", rel).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), rel)))


def normalise_root(root: Column) -> Column:
    """Without scheme, doubled and trailing slashes."""
    path = F.regexp_replace(F.regexp_replace(F.trim(root), r"^(file://|lip://local/)", ""), "/+", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


def path_stays_inside(rel: Column) -> Column:
    """Whether a relative path never climbs above where it starts."""
    steps = F.split(rel, "/", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def walk(acc: Column, step: Column) -> Column:
        depth = acc["depth"] + F.when(step == "..", -1).when(step.isin(".", ""), 0).otherwise(1)
        return F.struct(depth.cast("int").alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(steps, start, walk, lambda acc: acc["ok"]) & ~rel.startswith("/")


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text; none of a shorter one."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams; 1 for two without any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it: Catalyst would repeat the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for other sizes or a zero norm."""

    def of(p: Column) -> Column:
        return let(norm(p["a"]) * norm(p["b"]), lambda size: F.when((F.size(p["a"]) == F.size(p["b"])) & (size > 0), dot(p["a"], p["b"]) / size))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def normalise(a: Column) -> Column:
    """The vector in double precision divided by its norm; null for a norm of 0."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def confidence_at(distance: Column) -> Column:
    return F.when(distance == 1, 0.95).when(distance == 2, 0.85).when(distance == 3, 0.75).otherwise(0.5)


def risk(direct: Column, total: Column) -> Column:
    return F.when((direct > 10) | (total > 20), "high").when((direct > 3) | (total > 5), "medium").otherwise("low")


def token_cost(signature: Column, documentation: Column) -> Column:
    """Tokens a symbol takes in a context: a quarter of its bytes, rounded up, and 8."""
    size = F.octet_length(F.coalesce(signature, F.lit(""))) + F.octet_length(F.coalesce(documentation, F.lit("")))
    return F.ceil(size / 4).cast("long") + 8


def age_seconds(indexed_at_ms: Column, as_of_ms: int) -> Column:
    """Whole seconds; null for a time that is yet to come."""
    return F.when(indexed_at_ms <= as_of_ms, F.floor((F.lit(as_of_ms) - indexed_at_ms) / 1000))


def kind_code(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in KIND_CODES.items() for x in p])[kind], F.lit(0))


def not_expired(as_of_ms: int) -> Column:
    return (F.col("expires_ms") == 0) | (F.col("expires_ms") >= as_of_ms)


def lifecycle_state(client_root: Column, stored_root: Column, file_count: Column) -> Column:
    return F.when(F.coalesce(client_root, F.lit("")) == "", "cold").when(client_root == stored_root, "warm_full").when(file_count > 0, "warm_partial").otherwise("cold")


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression, or None if it isn't valid: then it filters nothing.

    * and ? don't cross a slash, ** does; brackets are sets, ! negates one; braces are alternatives.
    """
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return None if depth else f"^{out}$"


def glob_matches(uri: Column, pattern: str | None) -> Column:
    """Whether a path matches: the whole of it if the pattern has a slash, else its last part."""
    regex = glob_regex(pattern) if pattern else None
    if regex is None:
        return F.lit(True)
    path = strip_file_scheme(uri)
    return (path if "/" in pattern else F.substring_index(path, "/", -1)).rlike(regex)


LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "pyi": "python", "dart": "dart", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "go": "go", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "javascriptreact", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
}


def detect_language(uri: Column, hint: Column | None = None) -> Column:
    """The hint, if it names a known language, else that of the extension, else unknown."""
    known = sorted(set(LANGUAGES.values()))
    by_ext = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])[F.lower(F.regexp_extract(uri, r"\.([^./\\]+)$", 1))]
    hinted = F.when(F.lower(hint).isin(known), F.lower(hint)) if hint is not None else F.lit(None).cast("string")
    return F.coalesce(hinted, by_ext, F.lit("unknown"))


_TEST_MARKS = ("/test/", "/tests/", "/__tests__/", "/spec/", "_test.", ".test.", "_spec.", ".spec.", "/test_", "tests.rs")


def is_test_file(uri: Column) -> Column:
    low = F.lower(uri)
    out = F.lit(False)
    for mark in _TEST_MARKS:
        out = out | F.contains(low, F.lit(mark))
    return out
