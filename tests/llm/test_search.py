"""Operators that search the corpus, against brute force over whole tables."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, ODD, components, docs, edited, prose, table, texts, words

from lodestar.llm import decontaminate, linededup, minhash, packing, repeats, simhash, textkit
from lodestar.llm.queries import QUERIES


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


# near copies


def plain_groups(rows, radius=22, least=8):
    """Groups of (id, text) rows by comparing all fingerprints."""
    rows = [(i, t) for i, t in rows if i is not None and words(t)]
    f, first = simhash.distinct_words(textkit.words(pa.array([t for _, t in rows], pa.string())))
    prints, size = simhash.simhash(f, first), np.diff(first)
    pairs = []
    for k in range(len(rows)):
        d = np.bitwise_count(prints ^ prints[k]).sum(axis=1)
        near = (d <= radius) & (size >= least) & (size[k] >= least) | (d == 0)
        pairs += [(rows[k][0], rows[int(j)][0]) for j in np.flatnonzero(near) if rows[int(j)][0] != rows[k][0]]
    return {x: r for x, r in components(pairs).items() if x != r}


def test_near_copies_of_the_corpus(spark, corpus):
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_copies(corpus).collect()}
    assert got == plain_groups(texts().items()) and len(got) > 50


def test_near_copies_of_odd_rows(spark):
    base = prose(1, 300)
    rows = [*ODD, (20, base), (21, edited(base, 0.05, 1)), (22, edited(base, 0.06, 2)), (23, base.upper()), (24, prose(2, 300)), (25, "few words"), (26, "few other"), (27, "Few words")]
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert got == plain_groups(rows) == {9: 8, 21: 20, 22: 20, 23: 20, 27: 25}
    assert simhash.near_copies(docs(spark, rows).limit(0)).count() == 0


def test_near_copies_of_divided_tiles(spark, corpus):
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_copies(corpus, tile_rows=40).collect()}
    assert got == plain_groups(texts().items())


# fingerprints


def plain_jaccard(rows, n=3):
    sets = {}
    for i, t in rows:
        w = words(t)
        if i is not None and w:
            sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)})
    held = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    shared = collections.Counter((a, b) for ids in held.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])
    return {p: round(c / (len(sets[p[0]]) + len(sets[p[1]]) - c), 6) for p, c in shared.items()}


def plain_classes(rows, threshold=0.5):
    """{id: (class, links)} of the ids with a word; ids have one text each."""
    texts_ = {i: t for i, t in rows if i is not None and words(t)}
    by_text = collections.defaultdict(list)
    for i, t in texts_.items():
        by_text[t].append(i)
    rep = {i: min(ids) for ids in by_text.values() for i in ids}
    pairs = [p for p, j in plain_jaccard(((i, t) for i, t in texts_.items() if rep[i] == i)).items() if j >= threshold]
    root = components([*pairs, *((i, r) for i, r in rep.items() if i != r)])
    links = collections.Counter(x for p in pairs for x in p)
    return {i: (root.get(i, i), links[rep[i]]) for i in texts_}


def classes(df):
    rows = df.collect()
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_similar_documents_of_the_corpus(spark, corpus):
    want = plain_classes(texts().items())
    got = classes(minhash.similar_documents(corpus))
    assert set(got) == set(want) and all(got[i][1] <= want[i][1] for i in want)
    # pairs just over the threshold may have no band in common
    assert sum(k for _, k in got.values()) >= 0.97 * sum(k for _, k in want.values()) > 100
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_similar_documents_of_odd_rows(spark):
    base = prose(1, 200)
    rows = [*ODD, (20, base), (21, base), (22, edited(base, 0.03, 1)), (23, "one"), (24, "One"), (25, prose(3, 50)), (25, prose(4, 50)), (26, prose(4, 50)), (27, prose(3, 50) + " more")]
    got = classes(minhash.similar_documents(docs(spark, rows)))
    want = plain_classes(r for r in rows if r[0] not in (25, 26, 27))
    assert want[22] == (20, 1) and want[21] == (20, 1) and want[24] == (23, 1) and want[9] == (8, 0)
    # 25 has two texts: one that 26 has, one that 27 has almost; what stands for a text has the links of all of its own
    assert got == want | {25: (25, 1), 26: (25, 1), 27: (25, 1)}
    assert minhash.similar_documents(docs(spark, rows).limit(0)).count() == 0
    assert classes(minhash.similar_documents(docs(spark, rows), broadcast_rows=0)) == got


def test_links_of_large_families_are_counted_in_blocks(spark):
    rows = [(1000 * f + k, edited(prose(f, 80), 0.01 + 0.04 * f, 7 * f + k)) for f in range(4) for k in range(60)]
    rows += [(5000 + k, edited(prose(9, 30) + " " + prose(10 + k // 2, 60), 0.02, k)) for k in range(40)]  # neighbours that share a part only
    want = plain_classes(rows)
    one = classes(minhash.similar_documents(docs(spark, rows)))
    assert sum(k for _, k in one.values()) >= 0.97 * sum(k for _, k in want.values()) > 1000
    for block in (600, 5000):
        assert classes(minhash.similar_documents(docs(spark, rows), block=block)) == one


# repeated passages


def plain_repeats(rows, least=50):
    rows = list(dict.fromkeys((i, t) for i, t in rows if i is not None and t is not None))  # an equal row is one document
    seen = collections.Counter()
    split = [(i, words(t)) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[k : k + least]) for k in range(len(w) - least + 1))
    spans = collections.defaultdict(set)
    for i, w in split:
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                spans[i].update(range(k, k + least))
    out = set()
    for i, held in spans.items():
        for k in held:
            if k - 1 not in held:
                stop = k
                while stop in held:
                    stop += 1
                out.add((i, k, stop))
    return out


def test_repeated_passages_of_the_corpus(spark, corpus):
    got = {tuple(r) for r in repeats.repeated_passages(corpus).collect()}
    want = plain_repeats(texts().items())
    # runs that only touch are one here and there alike where a passage of the least length covers the seam
    assert got == want and len(want) > 50


def test_repeated_passages_of_odd_rows(spark):
    p, q = prose(1, 60), prose(2, 55)
    rows = [
        *ODD, (20, prose(3, 30) + " " + p + " " + prose(4, 200)), (21, p + " " + prose(5, 10)), (22, prose(6, 70) + "\n" + q), (23, q + "\n" + p + " " + q), (24, prose(7, 49)), (25, prose(7, 49)), (26, prose(8, 50)), (27, prose(8, 50)), (28, "a b " * 100),
    ]
    got = {tuple(r) for r in repeats.repeated_passages(docs(spark, rows)).collect()}
    assert got == plain_repeats(rows) and {(20, 30, 90), (21, 0, 60), (26, 0, 50)} <= got and not {24, 25} & {r[0] for r in got}
    assert repeats.repeated_passages(docs(spark, rows).limit(0)).count() == 0
    for shard_words, hot in ((200, 2000), (200_000, 1)):
        assert {tuple(r) for r in repeats.repeated_passages(docs(spark, rows), shard_words=shard_words, hot=hot).collect()} == got


def test_passages_of_hot_anchors(spark):
    p, q = prose(1, 60), prose(2, 20)
    rows = [(k, f"{prose(100 + k, 60)} {p} {prose(300 + k, 60)}") for k in range(40)] + [(100 + k, f"{prose(500 + k, 60)} {q} {prose(700 + k, 60)}") for k in range(40)]
    rows += [(200 + k, prose(100 + k, 60) + " " + p) for k in range(5)] + rows[:2]
    want = plain_repeats(rows)
    for hot in (0, 3, 10, 2000):
        assert {tuple(r) for r in repeats.repeated_passages(docs(spark, rows), hot=hot).collect()} == want


# benchmark


def plain_leaks(rows, items, threshold=0.4):
    out = {}
    tokens = lambda t: (lambda w: w.hash)(textkit.words(pa.array([t], pa.string()), alnum=True))
    items = [(i, tokens(t)) for i, t in items if i is not None and t is not None]
    for d, t in rows:
        if d is None or t is None:
            continue
        w = tokens(t)
        for i, q in items:
            if (score := decontaminate.align(q, w)) >= threshold:
                out[d, i] = max(out.get((d, i), 0), round(score, 6))
    return out


def test_contaminated_of_the_smallest_corpus(spark):
    sf = f"{DATA}/sf0.001"
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    b = table("benchmark", "sf0.001")
    want = plain_leaks(texts("sf0.001").items(), zip(b["item_id"], b["text"], strict=True))
    assert got == want and want


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, doc_id int, score string")


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_edited_benchmark_items_are_found(spark, share):
    items = [(k, prose(k, 40)) for k in range(20)]
    rows = [(k, prose(100 + k, 80) + " " + edited(t, share, k) + " " + prose(200 + k, 300)) for k, t in items] + [(100 + k, prose(300 + k, 400)) for k in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert len(got & {(k, k) for k in range(20)}) >= 18 and not {d for d, _ in got if d >= 100}


def test_contaminated_of_odd_rows(spark):
    item = prose(50, 30)
    rows = [*ODD, (20, item), (20, item), (21, item.upper()), (None, item), (22, item.replace(" ", ", "))]
    items = [(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "two words")]
    got = sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), bench(spark, items)).collect()))
    assert got == [(20, 1, 1.0), (21, 1, 1.0), (22, 1, 1.0)]
    assert decontaminate.contaminated(docs(spark, rows), bench(spark, items).limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, rows).limit(0), bench(spark, items)).count() == 0
    parts = decontaminate.contaminated(docs(spark, rows), bench(spark, items), part_bytes=1)
    assert sorted(map(tuple, parts.collect())) == got


def test_quotes_from_the_middle_of_common_items_are_found(spark):
    item = [f"word{i}" for i in range(38)]
    rows = [(d, " ".join([f"own{d}a", *item[s : s + 18], f"own{d}b"])) for d, s in enumerate(np.random.default_rng(0).integers(0, 21, 300).tolist())]
    rows += [(d, f"other text of document {d}") for d in range(300, 600)]
    found = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), rare_docs=10, common_share=0.0, least_seeds=3)
    assert {r["doc_id"] for r in found.collect()} == set(range(300))


def test_a_leak_in_most_documents_is_still_found(spark):
    item = prose(51, 40)
    rows = [(k, prose(400 + k, 30) + " " + item) for k in range(30)]
    assert decontaminate.contaminated(docs(spark, rows), bench(spark, [(1, item)])).count() == 30


# lines


def plain_lines(rows, depth=2, similarity=0.8, min_docs=3, min_tokens=1):
    """{row: numbers of the lines that go}, line by line."""
    lines = []
    for at, (i, t) in enumerate(rows):
        if i is None or t is None:
            continue
        for n, line in enumerate(t.split("\n")):
            w = tuple("*" if any(c in "0123456789" for c in x) else x for x in words(line))
            if len(w) >= min_tokens:
                lines.append((i, n, w))
    first = {}
    for i, n, w in sorted(lines):
        first.setdefault(w, (i, n))
    leaves = collections.defaultdict(list)
    for w in sorted(first, key=first.get):
        leaves[len(w), w[:depth]].append(w)
    template = {}
    for held in leaves.values():
        docs_ = {i for i, _, w in lines if w in set(held)}
        counted = sum(len({i for i, _, x in lines if x == w}) for w in held)
        if counted < min_docs or len(held) == 1 or not docs_:
            template |= {w: w for w in held}
            continue
        names = {w: np.array([hash(x) & 0x7FFFFFFFFFFFFFFF if x != "*" else 0 for x in w], np.uint64) for w in held}
        template |= {w: held[k] for w, k in zip(held, linededup.grow([names[w] for w in held], similarity), strict=True)}
    ids, firsts = collections.defaultdict(set), {}
    for i, n, w in lines:
        t = template[w]
        ids[t].add(i)
        firsts[t] = min(firsts.get(t, (i, n)), (i, n))
    return {(i, n) for i, n, w in lines if len(ids[template[w]]) >= min_docs and firsts[template[w]] != (i, n)}


def cut(rows, gone):
    out = []
    for i, t in rows:
        own = {n for d, n in gone if d == i and i is not None}
        out.append((i, t if t is None or not own else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in own)))
    return sorted(out, key=str)


def test_dedup_lines_of_the_corpus(spark, corpus):
    rows = list(texts().items())
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(corpus).collect()), key=str)
    want = cut(rows, plain_lines(rows))
    assert got == want and want != sorted(rows, key=str)


def test_short_lines_that_recur_go(spark, tmp_path):
    rows = [(20 + k, f"Read more\n{prose(900 + k, 6)}\nHome\n{k}\n42\nPage {k}\n{k} {k}") for k in range(5)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: t if i == 20 else f"{prose(900 + i - 20, 6)}\n{i - 20}\n{i - 20} {i - 20}" for i, t in rows}


def test_dedup_lines_of_odd_rows(spark):
    log = lambda k: f"user {k} logged in from 10.0.0.{k} today"
    rows = [*ODD, *[(20 + k, f"{prose(900 + k, 6)}\n{log(k)}\nAll rights reserved.\nAll rights reserved.") for k in range(5)], (30, "All Rights RESERVED.\r\n"), (31, "alpha beta gamma delta one\n"), (32, "alpha beta gamma delta two"), (33, "alpha beta gamma delta three")]
    rows += rows[-1:]
    out = linededup.dedup_lines(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == cut(rows, plain_lines(rows))
    got = {r["doc_id"]: (r["text"], r["lines_dropped"]) for r in out}
    assert got[20] == (rows[len(ODD)][1].rsplit("\n", 1)[0], 1)
    assert got[21] == (prose(901, 6), 3) and got[33] == ("", 1) and got[1] == (None, 0) and got[31][1] == 0
    assert linededup.dedup_lines(docs(spark, rows).limit(0)).count() == 0
    beyond = linededup.dropped_lines(docs(spark, rows), broadcast_lines=0)
    assert {(r["id"], r["line"]) for r in beyond.collect()} == plain_lines(rows)


# packing


def test_neighbours_are_the_nearest(spark, corpus):
    base = corpus.selectExpr("doc_id as id", "text")
    prints = packing.sketches(base, 3)
    rows = {r["id"]: np.frombuffer(r["sketch"], ">u2") for r in prints.collect()}
    ids, held = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    found = collections.defaultdict(dict)
    for r in packing.graph(prints, 3, 2, 6).collect():
        found[r["a"]][r["b"]] = found[r["b"]][r["a"]] = r["agree"]
    hits = total = 0
    for k, i in enumerate(ids.tolist()):
        agree = (held == held[k]).sum(axis=1)
        agree[k] = 0
        best = np.sort(agree[agree >= 2])[::-1][:6]
        # ties count alike: as many neighbours of at least that agreement
        got = sorted(found[i].values(), reverse=True)
        total += len(best)
        hits += sum(x >= y for x, y in zip(got, best.tolist()))
        assert all(x == (held[k] == held[int(np.searchsorted(ids, j))]).sum() for j, x in found[i].items())
    assert total > 100 and hits >= 0.9 * total


def recall(prints, queries):
    """How many of the queries' six nearest by agreement, ties alike, the graph has, and of how many."""
    rows = {r["id"]: np.frombuffer(r["sketch"], ">u2") for r in prints.collect()}
    ids, held = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    found = collections.defaultdict(dict)
    for r in packing.graph(prints, 3, 2, 6).collect():
        found[r["a"]][r["b"]] = found[r["b"]][r["a"]] = r["agree"]
    hits = total = 0
    for k in random.Random(1).sample(range(len(ids)), min(queries, len(ids))):
        agree = (held == held[k]).sum(axis=1)
        agree[k] = 0
        best = np.sort(agree[agree >= 2])[::-1][:6]
        total += len(best)
        hits += sum(x >= y for x, y in zip(sorted(found[int(ids[k])].values(), reverse=True), best.tolist()))
    return hits, total


def test_neighbours_are_the_nearest_of_a_larger_table(spark):
    larger = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").selectExpr("doc_id as id", "text")
    hits, total = recall(packing.sketches(larger, 3), 1500)
    assert total > 1500 and hits >= 0.99 * total


def test_neighbours_are_the_nearest_of_large_families(spark):
    rows = []
    for size in (50, 300, 2000):
        for least, share in ((0, 0.6), (1, 0.1)):
            text = prose(size + least, 60)
            rows += [(len(rows) + k, edited(text, share * (k + 1) / size, 7 * size + k)) for k in range(size)]
    rows += [(10_000 + k, rows[k % 3][1]) for k in range(30)]
    base = docs(spark, rows).selectExpr("doc_id as id", "text")
    hits, total = recall(packing.sketches(base, 3), 600)
    assert total > 1500 and hits >= 0.99 * total


def check_pieces(rows, sizes, window):
    at = {}
    for r in rows:
        at.setdefault(r["window"], []).append(r)
    seen = collections.defaultdict(list)
    for w in sorted(at):
        own = sorted(at[w], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(1, len(own) + 1))
        assert sum(r["stop"] - r["start"] for r in own) == window or w == max(at)
        for r in own:
            seen[r["doc_id"]].append((r["start"], r["stop"]))
    assert sorted(at) == list(range(len(at)))
    for i, parts in seen.items():
        assert parts[0][0] == 0 and parts[-1][1] == sizes[i] and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    assert set(seen) == {i for i, n in sizes.items() if n}


def test_pack_holds_every_word_once_in_the_order_of_paths(spark, corpus):
    rows = packing.pack(corpus).collect()
    sizes = {i: len(words(t)) for i, t in texts().items()}
    check_pieces(rows, sizes, 2048)
    prints = packing.sketches(corpus.selectExpr("doc_id as id", "text"), 3)
    e = packing.graph(prints, 3, 2, 6).collect()
    a, b, w = (np.array([r[c] for r in e]) for c in ("a", "b", "agree"))
    nodes, path, place = packing.walk(np.concatenate([a, b]), a, b, w)
    # components don't matter to the paths: those of the whole graph are the same
    alone = [i for i, n in sizes.items() if n and i not in set(nodes.tolist())]
    order = sorted([*zip(path.tolist(), place.tolist(), nodes.tolist()), *((i, 0, i) for i in alone)])
    got = list(dict.fromkeys(r["doc_id"] for r in sorted(rows, key=lambda r: (r["window"], r["piece"]))))
    assert got == [i for _, _, i in order]


def test_large_components_are_divided(spark, corpus):
    base = corpus.selectExpr("doc_id as id", "text")
    edges = packing.stored(packing.graph(packing.sketches(base, 3), 3, 2, 6))
    parts = packing.components(edges)
    whole, cut = (packing.divided(edges, parts, n).collect() for n in (1 << 19, 8))
    assert {(r["a"], r["b"]) for r in whole} == {(r["a"], r["b"]) for r in edges.collect()}
    assert {(r["a"], r["b"]) for r in cut} <= {(r["a"], r["b"]) for r in whole} and len(cut) > 0
    of = {}
    for r in cut:  # a document is in one part
        assert of.setdefault(r["a"], r["part"]) == r["part"] == of.setdefault(r["b"], r["part"])
    words = {r["doc_id"]: len(r["text"].split()) for r in corpus.select("doc_id", "text").collect()}
    held = {}
    for r in packing.pack(corpus, block=8).collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["stop"] - r["start"]
    assert held == {k: v for k, v in words.items() if v}


def test_components_are_walked_whole_whatever_their_size(spark, corpus):
    base = corpus.selectExpr("doc_id as id", "text")
    edges = packing.stored(packing.graph(packing.sketches(base, 3), 3, 2, 6))
    want = {(r["a"], r["b"], r["agree"]) for r in edges.collect()}
    for block in (1, 8, 1 << 19):
        assert {(r["a"], r["b"], r["agree"]) for r in packing.divided(edges, packing.components(edges), block).collect()} == want
    whole, small = (sorted(map(tuple, packing.pack(corpus, block=n).collect())) for n in (1 << 19, 2))
    assert whole == small


def test_walk_of_one_component_in_many_batches(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted((10 * k, 10 * rng.randrange(k)))): rng.randrange(2, 17) for k in range(1, 3000)}
    pairs |= {(-5 - 2 * k, -6 - 2 * k): 3 for k in range(20)}
    edges = spark.createDataFrame([(7, a, b, w) for (a, b), w in pairs.items()], "part int, a long, b long, agree int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = packing.walked(edges, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
    want = packing.walk(np.concatenate([a, b]), a, b, np.array(list(pairs.values())))
    assert sorted(map(tuple, got)) == sorted(zip(*(w.tolist() for w in want), strict=True))


def test_pack_of_odd_rows(spark):
    rows = [*ODD, (-3, "a b c"), (70_000, "d e"), (9, "shorter")]
    got = packing.pack(docs(spark, rows), window=100).collect()
    sizes = collections.defaultdict(int)
    for i, t in rows:
        if i is not None:
            sizes[i] = max(sizes[i], len(words(t)))
    check_pieces(got, sizes, 100)
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0
    random.seed(0)
