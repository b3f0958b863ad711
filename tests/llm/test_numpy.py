"""The numpy parts against plain Python."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import decontaminate, linededup, minhash, packing, pii, quality, repeats, simhash, textkit
from lodestar.llm.common import forest, slices


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \né\t,3", max_size=12)), max_size=8))
def test_words_are_those_of_plain_python(rows):
    w = textkit.words(pa.array(rows, pa.string()))
    of = {}
    for i, text in enumerate(rows):
        want = words(text)
        got = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert [g.replace("B", "b") for g in got] == want
        for word, h in zip(want, w.hash[w.first[i] : w.first[i + 1]].tolist(), strict=True):
            assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (0, 5, 0, 100, 3, 3, 0)], pa.string())], names=["text"])
    for limit in (1, 4, 8, 1000):
        assert pa.Table.from_batches(slices(batch, "text", limit)).column("text").to_pylist() == batch.column(0).to_pylist()
    assert list(slices(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("seed", range(5))
def test_forest_gives_smallest_members(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 40, 30), rng.integers(0, 40, 30)
    node, root = forest(a, b)
    got = dict(zip(node.tolist(), root.tolist(), strict=True))
    from helpers import components

    want = {x: r for x, r in components(zip(a.tolist(), b.tolist())).items() if x != r}
    assert got == want


def test_simhash_is_the_majority_of_bits():
    rows = [prose(i, n) for i, n in enumerate((1, 2, 9, 400, 3))] + ["", None]
    w = textkit.words(pa.array(rows, pa.string()))
    features, first = simhash.distinct_words(w)
    got = simhash.simhash(features, first)
    for i in range(len(rows)):
        f = features[first[i] : first[i + 1]]
        assert len(set(words(rows[i]))) == len(f)
        both = np.stack([textkit.mix(f), textkit.mix(f + np.uint64(0x5851F42D4C957F2D))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(f), 16), axis=1).astype(int).sum(axis=0)
        assert np.array_equal(np.unpackbits(got[i].view(np.uint8)), (2 * bits > len(f)).astype(np.uint8))


@pytest.mark.parametrize("same", [True, False])
def test_close_pairs_are_all_pairs_within_the_radius(same):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    x[100:150] = x[:50] ^ (rng.integers(0, 2**63, (50, 2)).astype(np.uint64) & rng.integers(0, 2**63, (50, 2)).astype(np.uint64) & rng.integers(0, 2**63, (50, 2)).astype(np.uint64))
    y = x if same else np.concatenate([x[140:], x[:30]])
    got = set(zip(*(k.tolist() for k in simhash.close_pairs(x, y, 22, same))))
    want = {(i, j) for i in range(len(x)) for j in range(len(y)) if (not same or i < j) and int(np.bitwise_count(x[i] ^ y[j]).sum()) <= 22}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("radius", [0, 1, 5, 13, 22, 30])
@pytest.mark.parametrize("same", [True, False])
def test_chunks_hold_all_pairs_within_the_radius(radius, same):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**64, (1500, 2), np.uint64)
    x[:, 0] &= np.uint64(0xFF0FFF3FFFFF)  # some chunks have few values
    for k in range(1, 600):  # edits around the radius
        bits = np.zeros(128, np.uint8)
        bits[rng.permutation(128)[: rng.integers(0, radius + 4)]] = 1
        x[600 + k] = x[k // 3] ^ np.packbits(bits).view(np.uint64)
    y = x if same else x[rng.permutation(1500)[:1100]]
    want = set(zip(*(k.tolist() for k in simhash.close_pairs(x, y, radius, same)), strict=True))
    got = [simhash.chunk_pairs(x, y, k, flips, within, radius, same) for flips, within, k in simhash.limits(radius)]
    assert {p for i, j in got for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(want) > 50


def test_chunks_spare_most_comparisons():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, (200_000, 2), np.uint64)
    x[100_000:100_500] = x[:500] ^ np.uint64(0x0100200400801003)
    began = time.process_time()
    got = [simhash.chunk_pairs(x, x, k, flips, within, 22, True) for flips, within, k in simhash.limits(22)]
    took = time.process_time() - began
    assert {p for i, j in got for p in zip(i.tolist(), j.tolist(), strict=True)} >= {(k, 100_000 + k) for k in range(500)}
    assert took < 25, took  # comparing all takes a minute


def suffixes(text, piece):
    own = np.repeat(np.arange(len(piece) - 1), np.diff(piece))
    return [tuple(text[i : piece[own[i] + 1]]) for i in range(len(text))]


@pytest.mark.parametrize("seed", range(30))
def test_corpus_order_is_a_suffix_array(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 40, 6)
    piece = np.concatenate([[0], np.cumsum(sizes)])
    text = rng.integers(1, 2 + seed % 4 * 3, piece[-1]).astype(np.uint32)
    order = repeats.corpus_order(text, piece)
    s = suffixes(text.tolist(), piece)
    assert sorted(order.tolist()) == list(range(len(text)))
    ranks = [s[i] for i in order]
    # suffixes of one length have the order of a suffix array; where they share n values they are neighbours
    for n in (1, 3, 7):
        heads = [r[:n] for r in ranks if len(r) >= n]
        assert len({h for h, _ in itertools.groupby(heads)}) == len([h for h, _ in itertools.groupby(heads)])


@pytest.mark.parametrize("seed", range(10))
def test_repeated_starts(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 50, 60).astype(np.uint32)
    parts = [rng.integers(1, 50, rng.integers(0, 30)).astype(np.uint32) if k % 2 else base[rng.integers(0, 30) : rng.integers(30, 60)] for k in range(8)]
    text, piece = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for place in (np.zeros(len(text), np.int64), rng.integers(0, 2, len(text))):
        seen = {}
        for s_at, s in enumerate(suffixes(text.tolist(), piece)):
            if len(s) >= 10:
                seen.setdefault((s[:10], int(place[s_at])), []).append(s_at)
        want = sorted(i for v in seen.values() if len(v) > 1 for i in v)
        assert np.flatnonzero(repeats.repeated_starts(text, piece, 10, place)).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_every_passage_holds_an_anchor_at_its_own_place(seed):
    passage = prose(seed, 50)
    a, b = prose(100 + seed, 90) + " " + passage + " " + prose(200 + seed, 70), prose(300 + seed, 13) + " " + passage
    w = textkit.words(pa.array([a, b, "short text", "x " * 200]))
    at, name, left, right = repeats.anchors(w, 50)
    # every window has one anchor; that of equal windows is the same
    where = []
    for s in (90, w.first[1] + 13):
        k = np.flatnonzero((left <= s) & (s + 50 <= right))
        assert len(k) == 1 and s <= at[k[0]] <= s + 42
        where.append((int(at[k[0]] - s), int(name[k[0]])))
    assert where[0] == where[1]
    count = np.diff(w.first)
    own = np.searchsorted(w.first, at, side="right") - 1
    assert np.bincount(own, weights=right - left - 49, minlength=4).tolist() == np.maximum(count - 49, 0).tolist()


def test_sliding():
    x = np.random.default_rng(0).integers(0, 100, 57)
    for n in (1, 2, 7, 57):
        assert repeats.sliding(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]
    assert len(repeats.sliding(x, 58, np.minimum)) == 0


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward_enumerates_all_labellings(seed):
    rng = np.random.default_rng(seed)
    first = np.array([0, 3, 3, 4, 9])
    scores, steps = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = quality.forward_backward(scores, first, steps)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, mass, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(scores[a + i] for i in range(b - a) if y[i]) + sum(steps[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += weight
            mass += weight * np.array(y)
            for i in range(b - a - 1):
                moves[y[i], y[i + 1]] += weight
        if b > a:
            want[a:b], want_pairs = mass / total, want_pairs + moves / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def plain_align(item, passage, match=2, mismatch=-1, gap=-1):
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (match if item[i - 1] == passage[j - 1] else mismatch), rows[i - 1][j] + gap, rows[i][j - 1] + gap)
            best = max(best, rows[i][j])
    return best / (match * len(item)) if item else 0.0


@pytest.mark.parametrize("seed", range(20))
def test_align_is_smith_waterman(seed):
    rng = random.Random(seed)
    a, b = [rng.randrange(5) for _ in range(rng.randrange(15))], [rng.randrange(5) for _ in range(rng.randrange(25))]
    assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64)) == pytest.approx(plain_align(a, b) if b else 0.0)


def test_minhash_estimates_jaccard_and_shingles_are_exact():
    rows = ["a b c d", "a b", "", None, prose(1, 300), prose(1, 270) + " " + prose(2, 30)]
    hashes, first = minhash.shingles(textkit.words(pa.array(rows, pa.string())), 3)
    want = []
    for r in rows:
        w = words(r)
        want.append(len(w) - 2 if len(w) >= 3 else min(1, len(w)))
    assert np.diff(first).tolist() == want
    a, b = minhash.permutations(512)
    sig = minhash.signatures(hashes, first, a, b)
    sets = [set(hashes[first[i] : first[i + 1]].tolist()) for i in (4, 5)]
    assert abs((sig[-1] == sig[-2]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.08


@pytest.mark.parametrize("seed", range(10))
def test_walk_follows_its_rule(seed):
    rng = random.Random(seed)
    pairs = {}
    for _ in range(60):
        a, b = sorted(rng.sample(range(30), 2))
        pairs[a, b] = rng.randrange(1, 5)
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    nodes, path, place = packing.walk(np.concatenate([a, b]), a, b, np.array(list(pairs.values())))
    near = {}
    for (x, y), w in pairs.items():
        near.setdefault(x, {})[y] = w
        near.setdefault(y, {})[x] = w
    seen, want = set(), []
    while len(seen) < len(near):
        start = min((n for n in near if n not in seen), key=lambda n: (len(near[n]), n))
        at, k = start, 0
        while at is not None:
            seen.add(at)
            want.append((at, start, k))
            at = min((n for n in near[at] if n not in seen), key=lambda n: (-near[at][n], len(near[n]), n), default=None)
            k += 1
    assert list(zip(nodes.tolist(), path.tolist(), place.tolist(), strict=True)) == want


def test_lines_and_templates():
    own, line, first, hashes = linededup.parse(pa.array(["a b 1\n\n c\nd", None, "", "a b 2"]))
    assert own.tolist() == [0, 0, 0, 3] and line.tolist() == [0, 2, 3, 0] and np.diff(first).tolist() == [3, 1, 1, 3]
    assert np.array_equal(hashes[:3], hashes[-3:])
    t = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 9, 4, 5], [1, 2, 3, 7, 5], [8, 8, 8, 8, 8])]
    assert linededup.grow(t, 0.8) == [0, 0, 2, 3] and linededup.grow([], 0.8) == []


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.3
    accuracy = [0.9, 0.97, 0.8]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    share, tables, p = pii.reliabilities(patterns, count)
    assert abs(share - 0.3) < 0.03
    assert [round(float(t[1, 2]), 1) for t in tables] == [0.9, 1.0, 0.8]


def test_lines_with_marks_give_the_spans_of_the_whole_text():
    for text in texts().values():
        assert sorted(pii._near(text, True, False)) == sorted(pii.spans(text, False))


def test_simhash_links_of_a_large_group_take_memory_by_rows():
    """4,000 near copies of one text have 8 million pairs."""
    rng = np.random.default_rng(1)
    n = 4000
    x = np.tile(np.append(rng.integers(0, 1 << 62, 2), 0), (n, 1)).astype(np.int64)
    for _ in range(4):
        x[np.arange(n), rng.integers(0, 2, n)] ^= np.int64(1) << rng.integers(0, 62, n)
    x[:, 2] = np.arange(n) + 7
    flips, within, chunk = simhash.limits(22)[0]
    tracemalloc.start()
    node, root = simhash.chunk_links(x, x, chunk, flips, within, 22, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(node.tolist()) == list(range(8, n + 7)) and set(root.tolist()) == {7}
    assert peak < 300e6, peak  # 1,673 MB when all pairs were held
    few = x[:200]
    i, j = simhash.chunk_pairs(few[:, :2].view(np.uint64), few[:, :2].view(np.uint64), chunk, flips, within, 22, True)
    links = forest(few[i, 2], few[j, 2])
    assert all(np.array_equal(p, q) for p, q in zip(simhash.chunk_links(few, few, chunk, flips, within, 22, True), links, strict=True))
