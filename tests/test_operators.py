import random
from collections import deque
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import graph as G
from lodestar.operators import ingest as I
from lodestar.operators import lookup as L
from lodestar.operators import relations as R
from lodestar.operators import vectors as V
from lodestar.operators import walks as K
from lodestar.service import NOT_BATCHABLE, RequestError, Service, UnknownOperator, default_service
from lodestar.storage import stored
from lodestar.workspace import Workspace


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def edges(spark, pairs):
    return spark.createDataFrame([("f", a, b, "calls", i) for i, (a, b) in enumerate(pairs)], "file_uri string, from_uri string, to_uri string, kind string, ordinal long")


def symbols(spark, rows):
    """(file, uri, name, exported, confidence)"""
    return spark.createDataFrame(
        [(f, u, n, "function", e, c, f"fn {n}()", None, [], i) for i, (f, u, n, e, c) in enumerate(rows)],
        "file_uri string, uri string, display_name string, kind string, is_exported boolean, confidence_score int, signature string, documentation string, modifiers array<string>, ordinal long",
    )


@pytest.mark.parametrize(
    ("uri", "name"), [("lip://local/a.rs#caller().", "caller"), ("lip://local/a.rs#foo", "foo"), ("lip://x/a#Type#method(+1).", "method"), ("plain", "plain"), ("a#", "")]
)
def test_callee_name(spark, uri, name):
    assert value(spark, S.callee_name(F.lit(uri))) == name


def test_uri_parts(spark):
    uri = F.lit("lip://npm/react@18.2.0/src/index.js#useState")
    assert [value(spark, S.uri_part(uri, p)) for p in ("scope", "package", "version", "path", "descriptor")] == ["npm", "react", "18.2.0", "src/index.js", "useState"]
    assert value(spark, S.is_valid_uri(uri)) and not value(spark, S.is_valid_uri(F.lit("lip://a/../b"))) and not value(spark, S.is_valid_uri(F.lit("http://a")))


@pytest.mark.parametrize(("path", "ok"), [("a/b.rs", True), ("../a", False), ("a/../../b", False), ("a/../b", True), ("./a", True), ("/etc/passwd", False), ("a/b/../../..", False)])
def test_path_guard(spark, path, ok):
    assert value(spark, S.path_stays_inside(F.lit(path))) is ok


@pytest.mark.parametrize(
    ("uri", "pattern", "ok"),
    [("file:///a/b/c.rs", "*.rs", True), ("file:///a/b/c.rs", "/a/*/c.rs", True), ("file:///a/b/d/c.rs", "/a/*/c.rs", False), ("file:///a/b/d/c.rs", "**/c.rs", True), ("file:///x", "[", True), ("file:///a.py", "*.{rs,py}", True)],
)
def test_glob(spark, uri, pattern, ok):
    assert value(spark, S.glob_matches(F.lit(uri), pattern)) is ok


def test_risk_confidence_cost(spark):
    assert [value(spark, S.risk(F.lit(d), F.lit(t))) for d, t in ((0, 0), (3, 5), (4, 4), (0, 6), (11, 11), (0, 21))] == ["low", "low", "medium", "medium", "high", "high"]
    assert [value(spark, S.confidence_at(F.lit(d))) for d in (1, 2, 3, 4)] == [0.95, 0.85, 0.75, 0.5]
    assert value(spark, S.token_cost(F.lit("abcde"), F.lit(None).cast("string"))) == 10
    assert value(spark, S.age_seconds(F.lit(2000), 1000)) is None


def test_trigrams(spark):
    assert value(spark, S.trigram_similarity(F.lit("a"), F.lit("b"))) == 1.0
    assert value(spark, S.trigram_similarity(F.lit("abc"), F.lit("b"))) == 0.0
    assert value(spark, S.trigram_similarity(F.lit("Handler"), F.lit("handler"))) == 1.0


def test_detect_language(spark):
    assert [value(spark, S.detect_language(F.lit(u), F.lit(h).cast("string"))) for u, h in (("a.rs", None), ("a.rs", "Python"), ("a.zig", None), ("b/c.TSX", "nope"))] == ["rust", "python", "unknown", "typescript"]


def test_lifecycle(spark):
    assert [value(spark, S.lifecycle_state(F.lit(c), F.lit(s), F.lit(n))) for c, s, n in (("", "x", 5), ("x", "x", 0), ("y", "x", 1), ("y", "x", 0))] == ["cold", "warm_full", "warm_partial", "cold"]


def queue_bfs(pairs, seed, depth, limit):
    """The literal queue: a node's callers join it in the order of edges; checks come before a node is expanded."""
    back = {}
    for a, b in pairs:
        if a not in back.setdefault(b, []):
            back[b].append(a)
    dist, queue, cut = {seed: 0}, deque([seed]), False
    while queue:
        n = queue.popleft()
        if len(dist) > limit:
            cut = True
            break
        if dist[n] >= depth:
            cut = True
            continue
        for m in back.get(n, []):
            if m not in dist:
                dist[m] = dist[n] + 1
                queue.append(m)
    del dist[seed]
    return dist, cut


@pytest.mark.parametrize("seed", range(6))
def test_limited_blast_radius_is_the_queue(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([8, 30, 60])
    pairs = list(dict.fromkeys((f"s{rng.randrange(n)}", f"s{rng.randrange(n)}") for _ in range(n * 3)))
    pairs = [(a, b) for a, b in pairs if a != b]
    limit = rng.choice([5, 20, 200])
    ws = Workspace.empty(spark).with_(edges=edges(spark, pairs))
    got = G.blast_radius_limited(ws, "s0", 4, limit).collect()
    want, cut = queue_bfs(pairs, "s0", 4, limit)
    assert {r["node"]: r["distance"] for r in got} == want
    assert not got or got[0]["truncated"] == cut


def call_chain(spark):
    names = [("file:///a.rs", "lip://local//a.rs#" + n, n, n == "c", 30) for n in "abc"]
    return Workspace.empty(spark).with_(
        symbols=symbols(spark, names),
        edges=edges(spark, [(names[0][1], names[1][1]), (names[1][1], names[2][1])]),
        files=spark.createDataFrame([("file:///a.rs", 0, "h", "tier1", "cargo/a")], "uri string, indexed_at_ms long, content_hash string, edges_source string, module_id string"),
    )


def test_outgoing_calls_by_depth(spark):
    ws, seeds = call_chain(spark), spark.createDataFrame([("lip://local//a.rs#a",)], "seed string")
    assert [G.outgoing_calls(ws, seeds, d).count() for d in (0, 1, 2, 9)] == [1, 1, 2, 2]


def test_blast_radius_of_a_chain(spark):
    ws = call_chain(spark)
    seeds = spark.createDataFrame([("lip://local//a.rs#c",), ("nowhere",)], "seed string")
    rows = {r["symbol_uri"]: (r["distance"], r["confidence"]) for r in G.blast_radius_items(ws, seeds).collect()}
    assert rows == {"lip://local//a.rs#b": (1, 0.95), "lip://local//a.rs#a": (2, 0.85)}
    out = {r["seed"]: r for r in G.blast_radius(ws, seeds).collect()}
    assert out["nowhere"]["transitive_dependents"] == 0 and out["nowhere"]["risk"] == "low"
    assert out["lip://local//a.rs#c"]["direct_dependents"] == 1


def test_name_bridge_reaches_other_dialects(spark):
    ws = Workspace.empty(spark).with_(
        symbols=symbols(spark, [("file:///lib.rs", "lip://local//lib.rs#helper", "helper", True, 30), ("file:///c.rs", "lip://local//c.rs#run", "run", False, 30)]),
        edges=edges(spark, [("lip://local//c.rs#run", "lip://scip/other#helper().")]),
    )
    seeds = spark.createDataFrame([("lip://local//lib.rs#helper",)], "seed string")
    assert [r["node"] for r in G.callers(ws, seeds).collect()] == ["lip://local//c.rs#run"]
    assert G.callers(ws, seeds, bridge=False).count() == 0


def test_infer_confidence_rules(spark):
    rows = [("f", "a", "a", False, 90), ("f", "b", "b", False, 40), ("f", "c", "c", True, 42), ("f", "d", "d", True, 39), ("f", "e", "e", True, 70)]
    ws = Workspace.empty(spark).with_(symbols=symbols(spark, rows), edges=edges(spark, [("a", "b"), ("b", "e")]))
    assert {r["uri"]: (r["inferred"], r["steps"]) for r in G.infer_confidence(ws).collect()} == {"b": (65, 1), "c": (65, 5)}


def test_upgrade_needs_at_least_the_held_confidence(spark):
    held = symbols(spark, [("f", "a", "a", False, 50), ("f", "b", "b", False, 95)])
    up = spark.createDataFrame([("a", 90, None, "doc"), ("b", 90, "new", None)], "uri string, confidence_score int, signature string, documentation string")
    got = {r["uri"]: (r["confidence_score"], r["signature"], r["documentation"]) for r in G.upgrade_symbols(held, up).collect()}
    assert got == {"a": (90, "fn a()", "doc"), "b": (95, "fn b()", None)}


def test_search_ranks_exact_before_prefix_before_substring(spark):
    ws = Workspace.empty(spark).with_(symbols=symbols(spark, [("f", "1", "Handler", True, 1), ("f", "2", "handle", True, 1), ("f", "3", "HandlerFactory", True, 1), ("f", "4", "myHandler", True, 1)]))
    assert [(r["display_name"], r["match_type"]) for r in L.workspace_symbols(ws, "Handler").collect()] == [("Handler", "exact"), ("HandlerFactory", "prefix"), ("myHandler", "fuzzy")]
    everything = L.workspace_symbols(ws, "").collect()
    assert len(everything) == 4 and everything[0]["match_type"] is None


def test_position_is_start_inclusive_end_exclusive(spark):
    occ = spark.createDataFrame([("f", "s", 0, 11, 0, 21, "definition", False, 1)], "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, role string, is_test boolean, ordinal long")
    probes = spark.createDataFrame([(1, "f", 0, 11), (2, "f", 0, 20), (3, "f", 0, 21), (4, "f", 0, 10), (5, "g", 0, 11)], "probe int, file_uri string, line int, col int")
    got = {r["probe"]: r["symbol_uri"] for r in L.symbols_at_positions(Workspace.empty(spark).with_(occurrences=occ), probes).collect()}
    assert got == {1: "s", 2: "s", 3: None, 4: None, 5: None}


def test_annotations_expire_and_are_replaced(spark):
    cols = "symbol_uri string, key string, value string, author_id string, confidence int, timestamp_ms long, expires_ms long"
    notes = spark.createDataFrame([("s", "a", "1", "u", 100, 1, 0), ("s", "b", "2", "u", 100, 1, 50), ("s", "c", "3", "u", 100, 1, 100)], cols)
    ws = Workspace.empty(spark, 100).with_(annotations=notes)
    assert sorted(r["key"] for r in R.annotation_list(ws, "s").collect()) == ["a", "c"]
    assert R.purge_expired(ws).first()[:] == (2, 1)
    after = R.annotation_set(notes, spark.createDataFrame([("s", "a", "9", "u", 100, 0, 0)], cols))
    assert {r["key"]: r["value"] for r in after.collect()} == {"a": "9", "b": "2", "c": "3"}


def test_canonicalize(spark):
    uris = spark.createDataFrame([("lip://local/src/a.rs#x",), ("lip://local//abs/a.rs",), ("lip://npm/r@1/a",), ("lip://local/none.rs",)], "uri string")
    roots = spark.createDataFrame([("/w",), ("/w/long",)], "root string")
    files = spark.createDataFrame([("lip://local//w/src/a.rs",)], "uri string")
    got = {r["uri"]: r["canonical"] for r in R.canonicalize(uris, roots, files).collect()}
    assert got["lip://local/src/a.rs#x"] == "lip://local//w/src/a.rs#x"
    assert got["lip://local//abs/a.rs"] == "lip://local//abs/a.rs" and got["lip://npm/r@1/a"] == "lip://npm/r@1/a"
    assert got["lip://local/none.rs"] == "lip://local//w/long/none.rs"
    assert R.canonicalize(uris, roots.limit(0), files).filter("uri <> canonical").count() == 0


def vecs(spark, rows):
    return spark.createDataFrame([(u, [float(x) for x in v], "m") for u, v in rows], "uri string, vector array<float>, model string")


def test_vectors_of_other_sizes_or_norm_0_are_skipped(spark):
    pool = vecs(spark, [("a", [1, 0]), ("b", [0, 1]), ("z", [0, 0]), ("c", [1, 0, 0]), ("d", [1, 1])])
    got = V.nearest(pool, "a", 10).collect()
    assert [(r["uri"], r["score"]) for r in sorted(got, key=lambda r: -r["score"])] == [("d", 0.707107), ("b", 0.0)]
    m = {(r["a"], r["b"]): r["similarity"] for r in V.similarity_matrix(pool).collect()}
    assert m["z", "z"] == 1.0 and m["a", "c"] == 0.0 and all(m[a, b] == m[b, a] for a, b in m)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "nope")], "a string, b string")
    assert sorted((r["b"], r["similarity"]) for r in V.similarity(pool, pairs).collect() if r["similarity"] is not None) == [("b", 0.0)]


def test_matrix_and_join_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"u{i:02d}", [rng.choice([-1, 0, 1, 2]) for _ in range(3 if i % 9 else 2)]) for i in range(60)]
    pool = vecs(spark, rows).union(spark.createDataFrame([("none", None, "m"), ("empty", [], "m")], "uri string, vector array<float>, model string"))
    queries = pool.select(F.col("uri").alias("query"), "vector")
    for params in ({}, {"exclude_self": True}, {"min_score": 0.5}, {"exclude_self": True, "pattern": "u[0-3]*"}):
        monkeypatch.setattr(V, "QUERY_ROWS", 1000)
        one = sorted(map(tuple, V.top_k(queries, pool, 4, **params).collect()))
        monkeypatch.setattr(V, "QUERY_ROWS", 0)
        assert one == sorted(map(tuple, V.top_k(queries, pool, 4, **params).collect())) and len(one) > 50


def test_outliers_and_novelty(spark):
    pool = vecs(spark, [("a", [1, 0]), ("b", [1, 0]), ("c", [0, 1])])
    assert {r["uri"]: r["score"] for r in V.outliers(pool).collect()} == {"a": 0.5, "b": 0.5, "c": 0.0}
    assert V.outliers(pool.filter("uri = 'a'")).first()["score"] == 0.0
    got = {r["uri"]: r["novelty"] for r in V.novelty(pool, spark.createDataFrame([("c",), ("a",)], "uri string")).collect()}
    assert got == {"a": 0.0, "c": 1.0}
    assert V.novelty(pool, pool.select("uri")).filter("novelty = 1").count() == 3


def test_cluster_is_first_fit_in_order(spark):
    pool = vecs(spark, [("a", [1, 0]), ("b", [0, 1]), ("c", [1, 1]), ("d", [-1, 0])])
    assert {r["uri"]: r["cluster"] for r in V.cluster(pool, 0.7).collect()} == {"a": 0, "b": 1, "c": 0, "d": 2}


def test_embed_batch_uses_the_cache(spark):
    texts = spark.createDataFrame([("a", "aab"), ("b", None), ("c", "zz")], "uri string, text string")
    cached = spark.createDataFrame([("c", [7.0])], "uri string, vector array<double>")
    got = {r["uri"]: r["vector"] for r in V.embed_batch(texts, V.letter_counts, cached).collect()}
    assert got["a"][:2] == [2.0, 1.0] and got["b"] is None and got["c"] == [7.0]


JOURNAL = """{"op":"upsert_file","seq":1,"uri":"a","content_hash":"1"}
not json
{"op":"upsert_file","seq":2,"uri":"b","content_hash":"2"}

{"op":"remove_file","seq":3,"uri":"b"}
{"op":"annotation_set","seq":4,"symbol_uri":"s","key":"k","value":"old","expires_ms":0}
{"op":"annotation_set","seq":5,"symbol_uri":"s","key":"k","value":"new","expires_ms":0}
{"op":"annotation_set","seq":6,"symbol_uri":"s","key":"gone","value":"x","expires_ms":5}
{"op":"upsert_file","seq":7,"uri":"a","content_hash":"3"}
"""


def test_journal_replays_and_compacts(spark, tmp_path):
    path = tmp_path / "journal"
    path.mkdir()
    (path / "1.json").write_text(JOURNAL)
    files, notes = I.journal_replay(I.journal_open(spark, str(path)))
    assert [(r["uri"], r["content_hash"]) for r in files.collect()] == [("a", "3")]
    assert {r["key"]: r["value"] for r in notes.collect()} == {"k": "new", "gone": "x"}
    I.journal_compact(spark, str(path), str(tmp_path / "next"), 10)
    files2, notes2 = I.journal_replay(I.journal_open(spark, str(tmp_path / "next")))
    assert files2.select("uri", "content_hash").collect() == files.select("uri", "content_hash").collect()
    assert [r["key"] for r in notes2.collect()] == ["k"]


def test_apply_delta_replaces_a_file_and_is_idempotent(spark):
    from lodestar import schemas

    ws = Workspace.empty(spark, 5).with_(
        symbols=spark.createDataFrame([("a", "a#old"), ("b", "b#keep")], "file_uri string, uri string"),
        annotations=spark.createDataFrame([("a#old", "k")], "symbol_uri string, key string"),
    )
    doc = {"uri": "a", "content_hash": "h", "language": "rust", "source_text": None, "symbols": [{"uri": "a#new", "display_name": "new", "kind": "function", "signature": None, "confidence_score": 90, "is_exported": True}], "occurrences": [], "edges": []}
    deltas = spark.createDataFrame([("me", 1, "delete", {**doc, "symbols": []}), ("me", 2, "upsert", doc)], schemas.DELTAS)
    for after in (I.apply_delta(ws, deltas), I.apply_delta(I.apply_delta(ws, deltas), deltas)):
        assert sorted(r["uri"] for r in after.symbols.collect()) == ["a#new", "b#keep"]
        assert [(r["uri"], r["precomputed"]) for r in after.files.collect()] == [("a", True)]
        assert after.annotations.count() == 1
    gone = I.remove_files(I.apply_delta(ws, deltas), spark.createDataFrame([("a",)], "uri string"))
    assert [r["uri"] for r in gone.symbols.collect()] == ["b#keep"] and gone.files.count() == 0


def test_event_stream_round_trip(spark, tmp_path):
    from lodestar import schemas

    deltas = spark.createDataFrame([("c", 1, "upsert", {"uri": "a", "content_hash": "h", "language": "rust", "source_text": "fn a() {}", "symbols": [], "occurrences": [], "edges": []})], schemas.DELTAS)
    I.write_event_stream(deltas, str(tmp_path / "s"), "me", 1)
    assert I.read_event_stream(spark, str(tmp_path / "s")).select("seq", "document.uri", "document.source_text").collect() == [(1, "a", "fn a() {}")]


def test_mounting_a_slice_is_idempotent_and_exact(spark):
    cols = "manager string, package_name string, version string, uri string, confidence_score int"
    held = spark.createDataFrame([("cargo", "serde_json", "1", "u1", 100)], cols)
    new = spark.createDataFrame([("cargo", "serde", "2", "u2", 30)], cols)
    once = I.mount_slice(held, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, I.mount_slice(once, new).collect())) == [("cargo", "serde", "2", "u2", 100), ("cargo", "serde_json", "1", "u1", 100)]


def test_slice_cache_checks_hashes(spark, tmp_path):
    h = "ab" * 32
    cache = I.SliceCache(spark, str(tmp_path))
    symbols_ = spark.createDataFrame([(h, "u")], "content_hash string, uri string")
    cache.insert(symbols_, h)
    assert cache.get(h).count() == 1 and cache.get("cd" * 32) is None and cache.get("../x") is None
    with pytest.raises(ValueError):
        cache.insert(symbols_, "cd" * 32)


def test_scan_directory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_text("?")
    got = I.scan_directory(spark, str(tmp_path)).collect()
    assert [(r["language"], r["text"]) for r in got] == [("python", "x = 1\n")]


def test_service(spark):
    s = Service({"one": lambda: spark.range(1), "bad": lambda: 1 / 0})
    assert s.handshake()["supported"] == ["bad", "one"]
    with pytest.raises(UnknownOperator) as e:
        s.query("two")
    assert e.value.code == "unknown_message_type" and e.value.supported == ["bad", "one"]
    a = s.batch_query([("one", (), {}), ("bad", (), {}), ("two", (), {}), ("delta", (), {})])
    assert a[0].result.count() == 1 and [x.code for x in a[1:]] == ["internal", "unknown_message_type", "invalid_request"]
    with pytest.raises(RequestError):
        s.batch([("one", (), {}), (next(iter(NOT_BATCHABLE)), (), {})])
    assert len(default_service().operators) > 45


def test_helpers():
    assert [I.backoff_seconds(n) for n in (0, 3, 7, 8)] == [1, 8, 128, None]
    assert I.classify_embed_error(404, "model not found") == "unknown_model" and I.classify_embed_error(500, "") == "internal"


@pytest.mark.parametrize("seed", range(3))
def test_walks_are_the_plain_search(seed, monkeypatch):
    """Both traversals, whatever the number of links that are followed at once."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(K, "LINKS", [1 << 21, 40, 1][seed])
    n, m = [(60, 150), (300, 900), (150, 4000)][seed]
    pairs = np.unique(rng.integers(0, n, (m, 2)), axis=0)

    def links(source, target):
        order = np.argsort(source, kind="stable")
        first = np.append(0, np.cumsum(np.bincount(source, minlength=n)))
        return K.Links(SimpleNamespace(first=lambda _: first, numbers=lambda _: target[order].astype("i4")), n)

    def plain(start, depth):
        far, front = {start: 0}, [start]
        for hop in range(1, depth + 1):
            front = [b for a, b in pairs.tolist() if a in front and b not in far]
            far |= dict.fromkeys(front, hop)
        return far

    seeds = np.arange(0, n, 7)
    want = {(int(s), v): h for s in seeds for v, h in plain(int(s), 3).items() if h}
    step, got = K.Step(n, links(pairs[:, 0], pairs[:, 1])), {}
    for own, levels in K.walk(step, seeds, 3):
        for hop, keys in enumerate(levels[1:], 1):
            got |= {(int(own[k >> step.shift]), int(k & (1 << step.shift) - 1)): hop for k in keys}
    assert got == want
    levels = K.Spread(n, links(pairs[:, 1], pairs[:, 0]))(seeds, 3)
    assert {(int(s), int(v)): hop for hop, level in enumerate(levels, 1) for k, s in enumerate(seeds) for v in K.nodes_of(level, k)} == want


def test_traversals_make_no_rows_of_hops(spark, monkeypatch):
    """What a hop reaches is not written: only the edges and names are, once, whatever the depth."""
    written = []
    monkeypatch.setattr(G, "stored", lambda df: written.append(df.columns) or stored(df))
    ws, seeds = call_chain(spark), spark.createDataFrame([("lip://local//a.rs#c",)], "seed string")
    assert {(r["node"], r["distance"]) for r in G.callers(ws, seeds, 4).collect()} == {("lip://local//a.rs#b", 1), ("lip://local//a.rs#a", 2)}
    assert not [c for c in written if "distance" in c or "seed" in c]


def test_a_file_with_callers_has_their_distance(spark):
    """b.rs uses a symbol of a.rs and, two calls away, calls it: its items have distance 2, and it isn't a direct dependent."""
    names = [("file:///a.rs", "lip://local//a.rs#x", "x", True, 30), ("file:///a.rs", "lip://local//a.rs#y", "y", False, 30), ("file:///b.rs", "lip://local//b.rs#z", "z", False, 30)]
    occ = spark.createDataFrame([("file:///b.rs", names[0][1], 0, 0, 0, 2, "reference", False, 1)], "file_uri string, symbol_uri string, start_line int, start_char int, end_line int, end_char int, role string, is_test boolean, ordinal long")
    files = spark.createDataFrame([(f"file:///{f}.rs", 0, "h", "tier1", "c") for f in "ab"], "uri string, indexed_at_ms long, content_hash string, edges_source string, module_id string")
    ws = Workspace.empty(spark).with_(symbols=symbols(spark, names), occurrences=occ, files=files, edges=edges(spark, [(names[1][1], names[0][1]), (names[2][1], names[1][1])]))
    seeds = spark.createDataFrame([(names[0][1],)], "seed string")
    items = {(r["file_uri"], r["symbol_uri"], r["distance"]) for r in G.blast_radius_items(ws, seeds).collect()}
    assert items == {("file:///a.rs", names[1][1], 1), ("file:///b.rs", names[2][1], 2)}
    assert G.blast_radius(ws, seeds).first()[1:3] == (1, 2)


def test_comparisons_in_blocks_are_those_of_all(spark, monkeypatch):
    """Many equal scores, more rows of the query's own name than a block's margin, and blocks of a few rows."""
    rng = random.Random(2)
    rows = [(f"u{i:03d}", [rng.choice([-1, 0, 1]) for _ in range(3)]) for i in range(150)] + [("u007", [1, 1, 1])] * 30
    pool = vecs(spark, rows)
    queries = vecs(spark, rows[:40]).select(F.col("uri").alias("query"), "vector")
    monkeypatch.setattr(V, "QUERY_ROWS", 1000)
    want = [sorted(map(tuple, V.top_k(queries, pool, 6, **p).collect())) for p in ({}, {"exclude_self": True}, {"min_score": 0.9})]
    monkeypatch.setattr(V, "QUERY_ROWS", 0)
    for block in ((7, 40), (512, 4096)):
        monkeypatch.setattr(V, "BLOCK", block)
        assert [sorted(map(tuple, V.top_k(queries, pool, 6, **p).collect())) for p in ({}, {"exclude_self": True}, {"min_score": 0.9})] == want
    plan = V.top_k(queries, pool, 6)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "ArrayAggregate" not in plan and "zip_with" not in plan


def test_cluster_in_rounds_is_the_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"u{i:03d}", rng.normal(size=3 if i % 10 else 2).round(2).tolist()) for i in range(120)] + [("zero", [0, 0, 0])]
    unit = {u: np.array(v) / max(1e-9, np.linalg.norm(v)) for u, v in rows}
    want: dict[str, int] = {}
    for u in sorted(unit):
        near = [want[x] for x in want if len(unit[x]) == len(unit[u]) and round(float(unit[x] @ unit[u]), 6) >= 0.9]
        want[u] = min(near) if near else len(set(want.values()))
    for block, size in (((16, 24), 40), ((512, 4096), 1 << 14)):
        monkeypatch.setattr(V, "BLOCK", block)
        monkeypatch.setattr(V, "ROUND", size)
        assert {r["uri"]: r["cluster"] for r in V.cluster(vecs(spark, rows), 0.9).collect()} == want


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abzAKIiZKİıé \n漢0")), st.text())), st.sampled_from([1, 3, 1 << 20]))
def test_letters_are_those_of_python(texts, limit):
    own = [x for x in texts if x is None or "\ud800" not in ascii(x)]
    got = V.count_letters(pa.array(own, pa.string()), limit).to_pylist()
    assert got == [None if x is None else V.letter_counts([x])[0].tolist() for x in own]


def test_letters_are_counted_in_one_pass(spark):
    texts = spark.createDataFrame([("a", "abc\nKey\nİx\nlast"), ("b", None), ("c", "")], "uri string, text string")
    got = [tuple(r) for r in V.chunks(texts, 2).orderBy("uri", "chunk").collect()]
    assert got == [("a", 0, 0, 1, "abc\nKey"), ("a", 1, 2, 3, "İx\nlast"), ("c", 0, 0, 0, "")]
    plan = V.chunks(texts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert V.explain_match(texts, "key", 1, 2)._jdf.queryExecution().executedPlan().toString().count("replace(") == 0


def test_definitions_make_occurrences_once(spark):
    """Their order within a file is a window over all of them: it isn't in the plan that both uses share."""
    from lodestar.plans.catalog import QUERIES

    plan = QUERIES["query_definition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
