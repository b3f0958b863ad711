import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.sources import extract as X
from lodestar.sources import scip as P


def found(text, language):
    e = X.extract(text, language)
    return {(n, k): (exp, vis, owner, mods) for n, k, _, _, _, exp, mods, vis, owner in e.symbols}, e.edges


def test_rust():
    syms, edges = found("pub struct Point { x: i32 }\nimpl Point {\n  pub async fn norm(&self) -> f64 { helper(self.x) }\n}\nfn helper(x: i32) -> f64 { sqrt(x) }\nmod inner {}\n", "rust")
    assert syms["Point", "class"][0] and syms["norm", "method"][2] == "Point" and syms["norm", "method"][3] == ["pub", "async"]
    assert not syms["helper", "function"][0] and syms["helper", "function"][1] == "private"
    assert ("norm", "helper") in edges and ("helper", "sqrt") in edges


def test_python():
    syms, edges = found("class A:\n    def __init__(self):\n        self.b()\n    def _b(self):\n        pass\nasync def run():\n    A()\nX = 1\n", "python")
    assert set(syms) == {("A", "class"), ("__init__", "constructor"), ("_b", "method"), ("run", "function"), ("X", "variable")}
    assert syms["_b", "method"][:3] == (False, "private", "A") and edges == [("__init__", "b"), ("run", "A")]
    assert X.extract("def broken(:", "python").symbols == []


def test_typescript():
    syms, edges = found("export class S {\n  private go(a: number) { other(a); }\n}\nfunction other(x) { return x; }\nexport interface I {}\nexport const k = 1;\n", "typescript")
    assert syms["S", "class"][0] and syms["go", "method"][1] == "private" and not syms["other", "function"][0] and syms["I", "interface"][0] and syms["k", "variable"][0]
    assert edges == [("go", "other")]


@pytest.mark.parametrize(
    ("language", "text", "name", "kind", "exported"),
    [
        ("go", "package p\nfunc (r *R) Get() int { return f() }\nfunc f() int { return 1 }\n", "Get", "method", True),
        ("go", "type t struct { a int }\n", "t", "class", False),
        ("kotlin", "private fun a() { b() }\n", "a", "function", False),
        ("swift", "public struct P { func m() {} }\n", "P", "class", True),
        ("c", "static int add(int a, int b) { return a + b; }\n", "add", "function", False),
        ("cpp", "namespace n { class C { void m() { k(); } }; }\n", "C", "class", True),
        ("dart", "class _P { void m() {} }\n", "_P", "class", False),
    ],
)
def test_other_languages(language, text, name, kind, exported):
    syms, _ = found(text, language)
    assert syms[name, kind][0] is exported


def test_strings_and_comments_hold_nothing():
    e = X.extract('fn a() { // b()\n let s = "c()"; /* d() */ e(); }', "rust")
    assert e.edges == [("a", "e")]


def test_occurrence_kinds():
    e = X.extract("fn a() { x = 1; f(y); }", "rust")
    assert {n: k for n, _, _, r, k in e.occurrences if r == "reference"} == {"x": "write", "f": "call", "y": "read"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("fn foo(x: i32, y: &str) -> bool", "fn foo(_: i32, _: &str) -> bool"),
        ("fn  foo( )   -> bool // note", "fn foo( ) -> bool"),
        ("fn f(m: HashMap<K, V>, g: fn(a: u8) -> u8)", "fn f(_: HashMap<K, V>, _: fn(a: u8) -> u8)"),
        ("fn f(p: std::path::Path)\nsecond", "fn f(_: std::path::Path)"),
        ("fn nothing()", "fn nothing()"),
    ],
)
def test_normalize_signature(raw, want):
    assert X.normalize_signature(raw) == want and X.normalize_signature(want) == want


def test_visibility():
    assert X.infer_visibility("rust", "f", ["pub(crate)"], True) == ("internal", 100)
    assert X.infer_visibility("python", "_f", [], False) == ("private", 80)
    assert X.infer_visibility("go", "F", [], True) == ("public", 100)
    assert X.infer_visibility("typescript", "f", [], False) == ("private", 50)


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("Cargo.toml", '[dependencies]\nname = "no"\n[package]\nname = "serde"\n', "serde"),
        ("go.mod", "module example.com/m\n", "example.com/m"),
        ("package.json", '{"name": "react"}', "react"),
        ("pyproject.toml", '[project]\nname = "a"\n', "a"),
        ("setup.py", "setup(name='b')", "b"),
        ("pubspec.yaml", "name: c\n", "c"),
        ("Cargo.toml", "[workspace]\n", None),
    ],
)
def test_manifests(name, text, want):
    assert X.parse_manifest(name, text) == want


def test_module_ids(spark):
    files = spark.createDataFrame(
        [("lip://cargo/serde@1/x.rs", None), ("file:///r/a/b/c.rs", None), ("file:///r/z.rs", "rust-analyzer cargo my-crate 0.1.0 a.rs#f()."), ("file:///q/x.rs", "lip://rust-analyzer/cargo/k@1/x"), ("file:///none.rs", None)], "uri string, symbol string"
    )
    manifests = spark.createDataFrame([("/r", "Cargo.toml", '[package]\nname = "root"'), ("/r/a", "go.mod", "module m")], "directory string, file_name string, text string")
    got = {r["uri"]: r["module_id"] for r in X.resolve_module_id(files, manifests).collect()}
    assert got == {"lip://cargo/serde@1/x.rs": "cargo/serde", "file:///r/a/b/c.rs": "go/m", "file:///r/z.rs": "cargo/my-crate", "file:///q/x.rs": "cargo/k", "file:///none.rs": None}


def test_index_files(spark):
    files = spark.createDataFrame([("file:///a.rs", "fn a() { b(); }\nfn b() {}", "rust"), ("file:///n.rs", None, "rust"), ("file:///x", "?", "unknown")], "uri string, text string, language string")
    made = X.index_files(files).cache()
    syms = X.relation(made, "symbols").collect()
    assert sorted((r["uri"], r["confidence_score"]) for r in syms) == [("lip://local//a.rs#a", 30), ("lip://local//a.rs#b", 30)]
    assert [(r["from_uri"], r["to_uri"]) for r in X.relation(made, "edges").collect()] == [("lip://local//a.rs#a", "lip://local//a.rs#b")]
    assert X.relation(made, "occurrences").filter("role = 'definition'").count() == 2


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_scip_columns(spark):
    sym = "rust-analyzer cargo my-crate 0.1.0 caller.rs#caller()."
    uri = one(spark, P.symbol_to_uri(F.lit(sym)))
    assert uri == "lip://rust-analyzer/cargo/my-crate@0.1.0/caller.rs#caller()." and one(spark, P.uri_to_symbol(F.lit(uri))) == sym
    assert one(spark, P.symbol_to_uri(F.lit("local 3"))) == "lip://scip/local_3"
    assert one(spark, P.range_of(F.array(*map(F.lit, (1, 2, 3))))).asDict() == {"start_line": 1, "start_char": 2, "end_line": 1, "end_char": 3}
    assert one(spark, P.range_of(F.array(*map(F.lit, (1, 2))))) is None
    assert [one(spark, P.role_of(F.lit(b))) for b in (1, 12, 8, 0, 5)] == ["definition", "write_access", "read_access", "reference", "definition"]
    assert one(spark, P.is_test(F.lit(33))) is True
    assert one(spark, P.kind_of(F.lit(26))) == "function" and one(spark, P.code_of(F.lit("nope"))) == 0
    docs = lambda *x: P.signature_and_documentation(F.array(*map(F.lit, x)))
    assert tuple(one(spark, docs("a", "b", "c"))) == ("a", "b\n\nc") and tuple(one(spark, docs("fn x()"))) == ("fn x()", None) and tuple(one(spark, docs("prose"))) == (None, "prose")
    assert one(spark, P.modifiers_of(F.lit("pub async fn x()"))) == ["pub", "async"]
    assert one(spark, P.container_of(F.lit("s m p 1 a/B#c()."))) == "c"


def test_scip_round_trip(spark, tmp_path):
    syms = spark.createDataFrame(
        [("lip://local/src/a.rs", "lip://rust-analyzer/cargo/k@1/a.rs#f().", "f", "function", "fn f()", "says f", 0)], "file_uri string, uri string, display_name string, kind string, signature string, documentation string, ordinal long"
    )
    occ = spark.createDataFrame([("lip://local/src/a.rs", "lip://rust-analyzer/cargo/k@1/a.rs#f().", 300, 1, 300, 5, "definition", True, 0)], "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, role string, is_test boolean, ordinal long")
    path = str(tmp_path / "index.scip")
    assert P.write_scip(syms, occ, path) == 1
    docs = P.read_scip(spark, path).cache()
    s, o = P.to_symbols(docs).first(), P.to_occurrences(docs).first()
    assert (s["file_uri"], s["uri"], s["display_name"], s["kind"], s["signature"], s["documentation"], s["is_exported"]) == ("lip://local/src/a.rs", "lip://rust-analyzer/cargo/k@1/a.rs#f().", "f", "function", "fn f()", "says f", True)
    assert (o["start_line"], o["end_char"], o["role"], o["is_test"]) == (300, 5, "definition", True)
    assert P.verify_import(docs, spark.createDataFrame([("lip://local/src/a.rs",)], "uri string")).first()["indexed"] is True


def test_scip_drops_paths_that_leave_the_root(spark, tmp_path):
    (tmp_path / "x.scip").write_bytes(P.put(2, P.encode_document("../evil.rs", "rust", [], [])) + P.put(2, P.encode_document("ok.rs", "rust", [], [])) + P.put(3, P.put(1, "s m p 1 ext#")))
    assert sorted(r[0] for r in P.read_scip(spark, str(tmp_path / "x.scip")).select("relative_path").collect()) == ["ok.rs", "scip://external"]


def test_a_declaration_of_any_length_is_found():
    parameters = ", ".join(f"int p{i}" for i in range(2000))
    found = X.extract(f"int add({parameters}) {{ return p0; }}\nint two(int a) {{ return a; }}", "c")
    assert [s[0] for s in found.symbols if s[1] == "function"] == ["add", "two"]


def test_extraction_takes_memory_by_pieces_of_a_batch():
    """5,000 files are one batch of Arrow; found rows are held for a piece of it."""
    text = "\n".join(f"pub fn f{i}(size: i32) {{ g{i}(); h{i}(); }}" for i in range(20))
    batch = pd.DataFrame({"uri": [f"file:///{i}.rs" for i in range(5000)], "text": [text] * 4998 + [None, ""], "language": "rust"})
    tracemalloc.start()
    found = [(len(f), sum(map(len, f["edges"])), max(map(len, f["symbols"]))) for f in X.index_batches(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _, _ in found) == 5000 and sum(e for _, e, _ in found) == 4998 * 40 and found[0][2] == 20
    assert peak < 300e6, peak


def test_scip_folder_has_the_documents_of_the_file(spark, tmp_path, monkeypatch):
    """An index is written by tasks as several whole files, and read by as many."""
    syms = spark.createDataFrame([(f"file:///r/f{i % 5}.rs", f"lip://local//r/f{i % 5}.rs#s{i}", f"s{i}", "function", "fn s()", "doc" if i % 2 else None, i) for i in range(40)], "file_uri string, uri string, display_name string, kind string, signature string, documentation string, ordinal long")
    occ = spark.createDataFrame([(f"file:///r/f{i % 7}.rs", f"lip://local//r/f.rs#s{i}", i * 100, i, i * 100, i + 2, "read_access", i % 3 == 0, i) for i in range(90)], "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, role string, is_test boolean, ordinal long")
    monkeypatch.setattr(P, "PART_BYTES", 10)
    assert P.write_scip_folder(syms, occ, str(tmp_path / "many"), root="/r") == P.write_scip(syms, occ, str(tmp_path / "one.scip"), root="/r") == 7
    files = sorted(x for x in (tmp_path / "many").iterdir() if x.suffix == ".scip")
    assert len(files) == 7 and not [x for x in (tmp_path / "many").iterdir() if x.name[0] == "_"]
    many, one = (sorted(map(repr, P.read_scip(spark, str(tmp_path / x)).collect())) for x in ("many", "one.scip"))
    assert many == one and len(one) == 7
    monkeypatch.setattr(P, "HELD", 20)
    assert [b.num_rows for b in P.document_batches((tmp_path / "one.scip").read_bytes())] != [7]
