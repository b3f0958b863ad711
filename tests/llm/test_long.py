"""Texts of over a megabyte that are one run of something: every operator reads them whole, in linear time."""

import base64
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import docs, prose, words

from lodestar.llm import decontaminate, htmltemplate, linededup, minhash, packing, pii, quality, repeats, simhash, textkit, tokencount

SIZE = 1_200_000
RUNS = {1: " " * SIZE + "x", 2: "\n" * SIZE + "x", 3: base64.b64encode(random.Random(1).randbytes(SIZE * 3 // 4)).decode(), 5: "line\n" * (SIZE // 5), 7: prose(1, SIZE // 12)}


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    for i, t in [*RUNS.items(), (8, prose(2, 50)), (9, "line\nline")]:
        pq.write_table(pa.table({"doc_id": [i], "text": [t]}), f"{path}/{i}.parquet")
    return spark.read.parquet(str(path))


def pages(d):
    return d.selectExpr("doc_id as page_id", "'http://h/' as url", "concat('<p>', text) as html")


OPERATORS = {
    "packing": lambda d, tmp: packing.pack(d),
    "pii": lambda d, tmp: pii.private_spans(d),
    "tokencount": lambda d, tmp: tokencount.token_counts(d, str(tmp / "cache")),
    "simhash": lambda d, tmp: simhash.near_copies(d),
    "repeats": lambda d, tmp: repeats.repeated_passages(d),
    "quality": lambda d, tmp: quality.good_documents(d, d.selectExpr("doc_id", "cast(doc_id > 6 as int) as quality", "0 as toxic")),
    "decontaminate": lambda d, tmp: decontaminate.contaminated(d, d.filter("doc_id = 8").selectExpr("doc_id as item_id", "text")),
    "html": lambda d, tmp: htmltemplate.extract(pages(d)),
    "linededup": lambda d, tmp: linededup.dedup_lines(d),
    "minhash": lambda d, tmp: minhash.similar_documents(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_texts(spark, long_docs, tmp_path, name):
    began = time.time()
    rows = OPERATORS[name](long_docs, tmp_path).collect()
    took = time.time() - began
    assert took < 60, took  # five such texts and all stages of the job
    if name == "packing":
        held = {}
        for r in rows:
            held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["stop"] - r["start"]
        assert held == {i: len(t.split()) for i, t in RUNS.items()} | {8: 50, 9: 2}
    if name == "tokencount":
        assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] > 1 and len(rows) == 7
    if name == "linededup":
        got = {r["doc_id"]: r for r in rows}
        # the line stays once, where it first is, and goes with fewer than three documents nowhere
        assert len(got) == 7 and all(got[i]["text"] == t for i, t in RUNS.items())
    if name == "repeats":
        assert (5, 0, SIZE // 5) in {tuple(r) for r in rows}


def test_many_dropped_lines_of_one_document(spark):
    many = "line\n" * 100_000
    rows = [(1, "line"), (2, many), (3, "other\nline")]
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["lines_dropped"]) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: ("line", 0), 2: ("", 100_000), 3: ("other", 1)} and time.time() - began < 60


@pytest.mark.parametrize("run", ["9" * SIZE, "ab1." * (SIZE // 4), "a.b@c." * (SIZE // 6), "+1 " * (SIZE // 3), "sk-" * (SIZE // 3), "DE12" * (SIZE // 4), "Hans " * (SIZE // 5), "Hans A" + "a" * SIZE + "1", "0f" * (SIZE // 2)])
def test_candidates_of_long_lines_take_linear_time(run):
    began = time.time()
    found = pii._near(run, True, True)
    assert time.time() - began < 10
    if run == "0f" * (SIZE // 2):
        assert [(k, a, b) for k, a, b in found if k == "secret"] == [("secret", 0, SIZE)]


def test_keys_of_any_length_are_secrets():
    for n in (32, 64, 65, 128, 129, 1000):
        key = ("04dbebab91ab8568" * 63)[:n]
        assert [k for k, _, _ in pii.spans(f"token={key} ok", False)] == ["secret"] and pii.votes("secret", key, "token=")[0] == 1
        assert [k for k, _, _ in pii.spans(f"use sk-{key}G ok", False)] == ["secret"]


def test_white_space_is_cut_without_a_change_of_counts():
    whole = tokencount.encoder(tokencount.TOKENIZER, tokencount.PATTERN + "|(?!)")  # another pattern of the same meaning: nothing is cut
    rng, count = random.Random(0), tokencount.encoder(tokencount.TOKENIZER)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Word", "1", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", ".", " " * rng.randrange(900, 1300), "\n" * 1100, "'s"]) for _ in range(rng.randrange(1, 7)))
        assert count([text]) == whole([text]), text[:80]


def test_words_of_runs():
    for text in RUNS.values():
        assert len(textkit.words(pa.array([text[:20_000]])).hash) == len(words(text[:20_000]))
