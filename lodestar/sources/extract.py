"""Symbols, occurrences and call edges from source text: ast for Python, a tokenizer for the other languages.

One pass per file gives all three, so that no text is parsed twice.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CONFIDENCE, VARIABLE_CONFIDENCE, OCCURRENCE_CONFIDENCE = 30, 25, 20


def symbol_uri(file_uri: str, name: str) -> str:
    """lip://local/{path}#{name}, without a second prefix."""
    if file_uri.startswith("lip://local/"):
        return f"{file_uri}#{name}"
    return f"lip://local/{file_uri.removeprefix('file://')}#{name}"


@dataclass
class Extracted:
    """symbols: (name, kind, line, char, signature, exported, modifiers, visibility, container); occurrences: (name, line, char, role, kind); edges: (caller, callee)."""

    symbols: list[tuple] = field(default_factory=list)
    occurrences: list[tuple] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)


# visibility


def infer_visibility(language: str, name: str, modifiers: list[str], exported: bool) -> tuple[str, int]:
    """(visibility, confidence in percent): 100 for a keyword, 80 for a convention, 50 for a default."""
    have = set(modifiers)
    if language in ("java", "kotlin", "swift", "typescript", "javascript", "javascriptreact", "cpp"):
        for word, meaning in (("private", "private"), ("fileprivate", "private"), ("protected", "protected"), ("internal", "internal"), ("public", "public"), ("open", "public")):
            if word in have:
                return meaning, 100
    if language == "rust":
        if "pub(crate)" in have or "pub(super)" in have:
            return "internal", 100
        return ("public", 100) if exported or "pub" in have else ("private", 80)
    if language == "go":
        return ("public", 100) if name[:1].isupper() else ("private", 100)
    if language == "python":
        if name.startswith("__") and name.endswith("__"):
            return "public", 80
        return ("private", 80) if name.startswith("_") else ("public", 80)
    if language == "dart":
        return ("private", 100) if name.startswith("_") else ("public", 100)
    if language in ("c", "cpp"):
        return ("private", 100) if "static" in have else ("public", 80)
    if language in ("typescript", "javascript", "javascriptreact"):
        return ("public", 100) if exported else ("private", 50)
    if language == "swift":
        return "internal", 80
    if language == "kotlin":
        return "public", 80
    return "public", 50


def is_exported(language: str, name: str, modifiers: list[str]) -> bool:
    have = set(modifiers)
    if language == "go":
        return name[:1].isupper()
    if language == "kotlin":
        return not have & {"private", "protected"}
    if language == "swift":
        return not have & {"private", "fileprivate"}
    if language == "rust":
        return any(m.startswith("pub") for m in have)
    if language in ("python", "dart"):
        return not name.startswith("_")
    if language in ("c", "cpp"):
        return "static" not in have
    return "export" in have


# signatures

_ANONYMOUS = {"rust", "typescript", "python", "swift", "kotlin"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*\??\s*$")


def normalize_signature(signature: str, language: str = "rust") -> str:
    """The first line without comments, white space collapsed; in some languages parameter names become _. Idempotent."""
    line = signature.strip().split("\n", 1)[0]
    line = re.sub(r"\s+", " ", line.split("//", 1)[0].split(" #", 1)[0]).strip()
    if language not in _ANONYMOUS:
        return line
    out, depth, part = "", 0, ""
    for i, c in enumerate(line):
        if c in "([{":
            depth += 1
        if depth == 1 and c == ":" and line[i + 1 : i + 2] != ":" and line[i - 1 : i] != ":" and (m := _NAME.search(part)) and part[: m.start()].strip() in ("", "mut", "ref", "&", "&mut", "_", "inout"):
            out, part = out + part[: len(part) - len(part.lstrip())] + "_", ""
            out += c
            continue
        if depth >= 1 and c in "([{" and depth == 1 or (depth == 1 and c == ","):
            out, part = out + part + c, ""
        elif depth >= 1:
            part += c
        else:
            out += c
        if c in ")]}":
            depth -= 1
            if depth == 0:
                out, part = out + part, ""
    return out + part


# Python


def _python(text: str) -> Extracted:
    out = Extracted()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = text.split("\n")
    declared: set[tuple[int, int]] = set()

    def at_name(node: ast.AST, name: str) -> tuple[int, int]:
        line = node.lineno - 1
        for k in range(line, min(line + 3, len(lines))):
            m = re.search(rf"\b{re.escape(name)}\b", lines[k][node.col_offset if k == line else 0 :])
            if m:
                return k, m.start() + (node.col_offset if k == line else 0)
        return line, node.col_offset

    def walk(node: ast.AST, container: str | None, caller: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                function = not isinstance(child, ast.ClassDef)
                kind = ("constructor" if child.name == "__init__" else "method") if function and in_class else "function" if function else "class"
                mods = (["async"] if isinstance(child, ast.AsyncFunctionDef) else []) + [d.id for d in child.decorator_list if isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod", "property")]
                place = at_name(child, child.name)
                declared.add(place)
                head = lines[child.lineno - 1].strip()
                out.symbols.append((child.name, kind, *place, head, is_exported("python", child.name, mods), mods, infer_visibility("python", child.name, mods, True)[0], container))
                out.occurrences.append((child.name, *place, "definition", "unknown"))
                walk(child, child.name, child.name if function else caller, not function)
                continue
            if isinstance(child, ast.Assign) and caller is None:
                for target in child.targets:
                    if isinstance(target, ast.Name):
                        place = (target.lineno - 1, target.col_offset)
                        declared.add(place)
                        out.symbols.append((target.id, "variable", *place, lines[place[0]].strip(), is_exported("python", target.id, []), [], infer_visibility("python", target.id, [], True)[0], container))
                        out.occurrences.append((target.id, *place, "definition", "unknown"))
            if isinstance(child, ast.Call):
                callee = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else None
                if callee and caller:
                    out.edges.append((caller, callee))
            walk(child, container, caller, in_class and not isinstance(child, ast.Lambda))

    walk(tree, None, None, False)
    calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and (n.lineno - 1, n.col_offset) not in declared:
            kind = "call" if id(n) in calls else "write" if isinstance(n.ctx, ast.Store) else "read"
            out.occurrences.append((n.id, n.lineno - 1, n.col_offset, "reference", kind))
        elif isinstance(n, ast.Attribute):
            kind = "call" if id(n) in calls else "write" if isinstance(n.ctx, ast.Store) else "read"
            out.occurrences.append((n.attr, n.end_lineno - 1, n.end_col_offset - len(n.attr.encode()), "reference", kind))
    return out


# other languages

_TOKEN = re.compile(r"(?P<skip>//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`)|(?P<word>[A-Za-z_$][\w$]*(?:\(crate\)|\(super\))?)|(?P<mark>[{}();=.:<>,\[\]&|!+\-*/%?@#])", re.S)
_DECLARES = {
    "rust": {"fn": "function", "struct": "class", "enum": "enum", "trait": "interface", "type": "type_alias", "const": "variable", "static": "variable", "mod": "namespace", "macro_rules": "macro"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type_alias", "const": "variable", "let": "variable", "var": "variable", "namespace": "namespace"},
    "dart": {"class": "class", "enum": "enum", "mixin": "class", "typedef": "type_alias", "extension": "class"},
    "c": {"struct": "class", "enum": "enum", "union": "class", "typedef": "type_alias"},
    "cpp": {"struct": "class", "class": "class", "enum": "enum", "union": "class", "namespace": "namespace", "typedef": "type_alias", "using": "type_alias"},
    "go": {"func": "function", "type": "class", "var": "variable", "const": "variable"},
    "kotlin": {"fun": "function", "class": "class", "interface": "interface", "object": "class", "val": "variable", "var": "variable", "typealias": "type_alias"},
    "swift": {"func": "function", "class": "class", "struct": "class", "enum": "enum", "protocol": "interface", "let": "variable", "var": "variable", "typealias": "type_alias", "extension": "class"},
}
_DECLARES["javascript"] = _DECLARES["javascriptreact"] = _DECLARES["typescript"]
_MODIFIERS = frozenset("pub pub(crate) pub(super) async unsafe extern const static export default abstract public private protected internal fileprivate open final override readonly declare inline virtual suspend data sealed mutating late factory external".split())
_WORDS = frozenset(
    "if else for while loop match return break continue let mut fn struct enum trait impl type const static use mod pub crate self super where as in ref move async await dyn unsafe extern function class interface extends implements new "
    "import export from default var typeof instanceof void null undefined true false this throw try catch finally switch case do yield func package defer go chan map range select fun val object when is override open data init protocol guard "
    "int char float double long short unsigned signed bool string String namespace using template typename public private protected internal final abstract readonly static".split()
)
#: Words that only these languages keep to themselves.
_OWN_WORDS = {"go": {"go", "chan", "map", "range", "defer", "select", "package", "func", "fallthrough"}, "kotlin": {"fun", "val", "when", "object", "data", "companion"}, "swift": {"func", "guard", "init", "protocol", "open"}}
_COMMON_WORDS = _WORDS - frozenset().union(*_OWN_WORDS.values())
_OWNERS = ("class", "interface", "namespace", "enum")
_NOT_CALLS = frozenset({"sizeof", "alignof", "macro_rules"})


def _tokenised(text: str, language: str) -> Extracted:
    out = Extracted()
    declares = _DECLARES.get(language, {})
    reserved = _COMMON_WORDS | _OWN_WORDS.get(language, set())
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines = text.split("\n")
    tokens: list[tuple[str, int, int]] = []
    row = 0
    for m in _TOKEN.finditer(text):
        while row + 1 < len(starts) - 1 and starts[row + 1] <= m.start():
            row += 1
        if m.lastgroup != "skip":
            tokens.append((m.group(), row, len(text[starts[row] : m.start()].encode())))
    closing = _closing(tokens)
    scopes: list[tuple[str, str] | None] = []  # what each open brace belongs to
    pending: tuple[str, str] | None = None
    mods: list[str] = []
    i = 0
    while i < len(tokens):
        word, line, char = tokens[i]
        after = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        before = tokens[i - 1][0] if i else ""
        function = next((s[1] for s in reversed(scopes) if s and s[0] in ("function", "method", "constructor")), None)
        owner = next((s for s in reversed(scopes) if s), None)
        if word == "{":
            scopes.append(pending)
            pending, mods = None, []
        elif word == "}":
            if scopes:
                scopes.pop()
            pending, mods = None, []
        elif word == ";":
            pending, mods = None, []
        elif word in _MODIFIERS and word not in declares:
            mods.append(word)
        elif word == "impl" and language == "rust":
            names = []
            j = i + 1
            while j < len(tokens) and tokens[j][0] not in "{;":
                names.append(tokens[j][0])
                j += 1
            target = names[names.index("for") + 1 :] if "for" in names else names
            held = [n for n in target if re.match(r"[A-Za-z_]", n)]
            pending = ("class", held[0]) if held else None
        elif word in declares and (word != "const" or (after and re.match(r"[A-Za-z_$]", after) and after not in declares)):
            j = i + 1
            if language == "go" and word == "func" and after == "(":  # a receiver
                while j < len(tokens) and tokens[j][0] != ")":
                    j += 1
                j += 1
            while j < len(tokens) and (tokens[j][0] in ("mut", "!", "*", "class") or tokens[j][0] in _MODIFIERS):
                j += 1
            if j < len(tokens) and re.match(r"[A-Za-z_$]", tokens[j][0]):
                name, at_line, at_char = tokens[j]
                kind = declares[word]
                if kind == "function" and (owner and owner[0] in ("class", "interface", "enum") or j > i + 1 and language == "go"):
                    kind = "method"
                if language == "go" and word == "type" and j + 1 < len(tokens):
                    kind = {"interface": "interface", "struct": "class"}.get(tokens[j + 1][0], "type_alias")
                local = kind == "variable" and function is not None
                if not local:
                    _declare(out, language, name, kind, at_line, at_char, lines, mods, owner)
                pending = (kind, name) if kind not in ("variable", "type_alias") else None
                out.occurrences.append((name, at_line, at_char, "definition", "unknown"))
                i, mods = j + 1, []
                continue
        elif re.match(r"[A-Za-z_$]", word):
            named = word not in reserved
            head = after == "(" and named and language in ("c", "cpp", "dart", "typescript", "javascript", "javascriptreact") and function is None
            if head and before not in (".", "=", "(", ",", "new", "return", "!", "&", "@") and _has_body(tokens, closing.get(i + 1)):
                typed = language in ("c", "cpp", "dart") and re.match(r"[A-Za-z_*&>]", before or " ")
                in_class = owner is not None and owner[0] in ("class", "interface")
                if typed or in_class:
                    kind = "constructor" if in_class and word in (owner[1], "constructor") else "method" if in_class else "function"
                    _declare(out, language, word, kind, line, char, lines, mods, owner)
                    out.occurrences.append((word, line, char, "definition", "unknown"))
                    pending, mods = (kind, word), []
                    i += 1
                    continue
            if named:
                call = after == "(" or (after == "!" and language == "rust")
                kind = "call" if call else "write" if after == "=" and (i + 2 >= len(tokens) or tokens[i + 2][0] != "=") else "read"
                out.occurrences.append((word, line, char, "reference", kind))
                if call and function and word not in _NOT_CALLS and word not in reserved:
                    out.edges.append((function, word))
        i += 1
    return out


def _closing(tokens: list[tuple[str, int, int]]) -> dict[int, int]:
    """Where each parenthesis that opens is closed."""
    open_, out = [], {}
    for j, (word, _, _) in enumerate(tokens):
        if word == "(":
            open_.append(j)
        elif word == ")" and open_:
            out[open_.pop()] = j
    return out


def _has_body(tokens: list[tuple[str, int, int]], closed: int | None) -> bool:
    """Whether the parenthesis that is closed there comes before a brace that opens a body, or an arrow; not if it is never closed."""
    if closed is None:
        return False
    rest = [t[0] for t in tokens[closed + 1 : closed + 8]]
    for k, w in enumerate(rest):
        if w == "{" or (w == "=" and rest[k + 1 : k + 2] == [">"]):
            return True
        if w in (";", "=", ")", "}"):
            return False
    return False


def _declare(out: Extracted, language: str, name: str, kind: str, line: int, char: int, lines: list[str], mods: list[str], owner: tuple[str, str] | None) -> None:
    exported = is_exported(language, name, mods)
    signature = lines[line].strip().rstrip("{").strip()
    out.symbols.append((name, kind, line, char, signature, exported, list(mods), infer_visibility(language, name, mods, exported)[0], owner[1] if owner and owner[0] in _OWNERS else None))


def extract(text: str, language: str) -> Extracted:
    return _python(text) if language == "python" else _tokenised(text, language) if language in _DECLARES else Extracted()


# over DataFrames

SYMBOL_ROWS = (
    "file_uri string, uri string, display_name string, kind string, documentation string, signature string, confidence_score int, is_exported boolean, signature_normalized string, "
    "modifiers array<string>, visibility string, container_name string, extraction_tier string, ordinal long, line int, char int"
)
OCCURRENCE_ROWS = "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, confidence_score int, role string, kind string, ordinal long"
EDGE_ROWS = "file_uri string, from_uri string, to_uri string, kind string, ordinal long"


def _struct(rows: str) -> str:
    return "struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in rows.split(", ")) + ">"


def index_rows(uri: str, text: str, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    found = extract(text or "", language)
    symbols = [
        (uri, symbol_uri(uri, n), n, kind, None, sig, VARIABLE_CONFIDENCE if kind == "variable" else CONFIDENCE, exp, normalize_signature(sig, language), mods, vis, owner, "tier1", i, line, char)
        for i, (n, kind, line, char, sig, exp, mods, vis, owner) in enumerate(found.symbols)
    ]
    occurrences = [(uri, symbol_uri(uri, n), line, char, line, char + len(n.encode()), OCCURRENCE_CONFIDENCE, role, kind, i) for i, (n, line, char, role, kind) in enumerate(found.occurrences)]
    edges = [(uri, symbol_uri(uri, a), symbol_uri(uri, b), "calls", i) for i, (a, b) in enumerate(found.edges)]
    return symbols, occurrences, edges


#: Characters of text that are extracted at once; bounds memory, has no effect on results.
CHUNK = 1 << 18


def text_slices(batch: pd.DataFrame, column: str = "text") -> Iterator[pd.DataFrame]:
    """The batch in pieces of about CHUNK characters of text; a longer text is a piece of its own."""
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch[column]])
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield batch.iloc[at:to]
        at = to


def index_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """index_rows() of batches (uri, text, language), piece by piece: a batch has thousands of files, and what is found takes many times their size."""
    names = [[c.strip().split(" ", 1)[0] for c in rows.split(", ")] for rows in (SYMBOL_ROWS, OCCURRENCE_ROWS, EDGE_ROWS)]
    for batch in batches:
        for part in text_slices(batch):
            made = [index_rows(u, t, k) for u, t, k in zip(part["uri"], part["text"], part["language"], strict=True)]
            cols = [[[dict(zip(names[k], row, strict=True)) for row in m[k]] for m in made] for k in range(3)]
            yield pd.DataFrame({"uri": part["uri"].tolist(), "symbols": cols[0], "occurrences": cols[1], "edges": cols[2]})


def index_files(files: DataFrame) -> DataFrame:
    """files (uri, text, language) with arrays symbols, occurrences and edges of each: one parse per file."""
    schema = f"uri string, symbols array<{_struct(SYMBOL_ROWS)}>, occurrences array<{_struct(OCCURRENCE_ROWS)}>, edges array<{_struct(EDGE_ROWS)}>"
    return files.select("uri", "text", "language").mapInPandas(index_batches, schema)


def relation(indexed: DataFrame, name: str) -> DataFrame:
    """One of symbols, occurrences and edges as rows."""
    return indexed.selectExpr(f"inline({name})")


# modules

MANIFESTS = {"Cargo.toml": "cargo", "go.mod": "go", "package.json": "npm", "pyproject.toml": "pip", "setup.py": "pip", "pubspec.yaml": "pub"}


def parse_manifest(file_name: str, text: str) -> str | None:
    """The package name that a manifest gives."""
    if file_name in ("Cargo.toml", "pyproject.toml"):
        sections = ("package",) if file_name == "Cargo.toml" else ("project", "tool.poetry")
        at = None
        for line in text.split("\n"):
            if m := re.match(r"\s*\[([^\]]+)\]", line):
                at = m[1].strip()
            elif at in sections and (m := re.match(r"\s*name\s*=\s*[\"']([^\"']+)[\"']", line)):
                return m[1]
        return None
    pattern = {"go.mod": r"^\s*module\s+(\S+)", "package.json": r"\"name\"\s*:\s*\"([^\"]+)\"", "setup.py": r"\bname\s*=\s*[\"']([^\"']+)[\"']", "pubspec.yaml": r"^name:\s*[\"']?([\w.-]+)"}.get(file_name)
    m = re.search(pattern, text, re.M) if pattern else None
    return m[1] if m else None


def manifest_names(manifests: DataFrame) -> DataFrame:
    """manifests (directory, file_name, text) with name, the package that each gives; null for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse_manifest(f, t or "") for f, t in zip(batch["file_name"], batch["text"], strict=True)]
            yield pd.DataFrame({"directory": batch["directory"], "file_name": batch["file_name"], "name": pd.Series(found, dtype=object)})

    return manifests.select("directory", "file_name", "text").mapInPandas(run, "directory string, file_name string, name string")


def resolve_module_id(files: DataFrame, manifests: DataFrame, hops: int = 12) -> DataFrame:
    """files (uri, symbol) with module_id; manifests (directory, file_name, text).

    In this order: the package of a lip:// slice URI, that of a SCIP symbol of the file (raw or as a URI), the nearest manifest
    at most `hops` folders up.
    """
    from pyspark.sql import functions as F

    kinds = F.create_map(*[F.lit(x) for p in MANIFESTS.items() for x in p])
    held = manifest_names(manifests).filter("name is not null").select("directory", F.concat_ws("/", kinds[F.col("file_name")], "name").alias("module"))
    held = held.groupBy("directory").agg(F.min("module").alias("module"))
    path = F.regexp_replace("uri", "^file://", "")
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(hops), F.size(parts)) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    nearest = files.select("uri", F.posexplode(up).alias("k", "directory")).join(held, "directory").groupBy("uri").agg(F.min_by("module", "k").alias("found"))
    of_slice = F.nullif(F.regexp_extract("uri", r"^lip://((?!local/|scip/)[^/]+/[^@/#]+)", 1), F.lit(""))
    raw = F.split("symbol", " ")
    of_symbol = F.when(F.size(raw) >= 4, F.concat_ws("/", raw[1], raw[2])).otherwise(F.nullif(F.regexp_extract("symbol", r"^lip://[^/]+/([^/]+/[^@/]+)@", 1), F.lit("")))
    return files.join(nearest, "uri", "left").select("uri", F.coalesce(of_slice, of_symbol, "found").alias("module_id"))


def enrich(symbols: DataFrame) -> DataFrame:
    """Symbols of a compiler pass: marked tier2, with normalised signatures, and modifiers and containers they lack."""
    from pyspark.sql import functions as F

    from lodestar.sources.scip import modifiers_of

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normalize_signature(x))

    mods = F.when(F.size(F.coalesce("modifiers", F.array().cast("array<string>"))) > 0, F.col("modifiers")).otherwise(modifiers_of(F.col("signature")))
    return symbols.withColumns({"extraction_tier": F.lit("tier2"), "modifiers": mods, "signature_normalized": normal("signature")})
