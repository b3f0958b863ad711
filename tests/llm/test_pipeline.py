"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import pytest
from helpers import DATA, ODD, docs, edited, prose, words
from test_search import check_pieces, cut, plain_groups, plain_leaks, plain_lines

from lodestar.llm import packing, quality
from lodestar.llm.queries import QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus: clean texts, junk, lines that recur, copies, leaks."""
    base = [(100 + k, prose(k, 40) + ".\n" + prose(300 + k, 60) + ".") for k in range(40)]
    junk = [(200 + k, "$$$ ### " * 20 + "\nBUY!! NOW!! " * 5) for k in range(20)]
    common = [(300 + k, prose(700 + k, 60) + ".\nAll rights are reserved by the owner.\n" + prose(800 + k, 30) + ".") for k in range(12)]
    copies = [(400, base[0][1]), (401, edited(base[1][1], 0.05, 3)), (402, base[2][1])]
    item = prose(999, 40)
    leaks = [(500, prose(1000, 80) + " " + item + " " + prose(1001, 80) + "."), (501, prose(1002, 80) + " " + edited(item, 0.15, 5) + ".")]
    rows = [*ODD, *base, *junk, *common, *copies, *leaks, base[5]]
    path = tmp_path_factory.mktemp("sf")
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in base] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage_does_its_work(spark, sf):
    path, rows, item = sf
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    given = spark.read.parquet(f"{path}/documents.parquet")

    one = stages["quality classifier"](spark, given, path).cache()
    model = quality.train(given, spark.read.parquet(f"{path}/labels.parquet"))
    q = {(r["doc_id"], r["keep"]) for r in quality.score(given, model).collect()}
    got = rows_of(one)
    assert one.columns == given.columns and not [i for i, _ in got if i is not None and 200 <= i < 220] and {i for i, _ in got if i is not None} == {i for i, k in q if k and i is not None}
    assert {i for i, _ in rows if i is not None and (100 <= i < 200 or 300 <= i)} <= {i for i, _ in got}

    two = stages["line dedup"](spark, one, path).cache()
    gone = plain_lines(got, min_docs=corpus_pipeline.RECURRING)
    want = [(i, t) for (i, t), (_, before) in zip(cut(got, gone), got, strict=True) if t == before or t.strip()]
    assert rows_of(two) == sorted(want, key=str) and len(gone) == 11 and two.columns == given.columns
    assert all(r["n_chars"] == len(r["text"]) for r in two.filter("doc_id between 300 and 311").collect())

    three = stages["SimHash near-dedup"](spark, two, path).cache()
    dropped = plain_groups(rows_of(two))
    assert rows_of(three) == [(i, t) for i, t in rows_of(two) if i not in dropped] and {400, 401, 402} <= set(dropped) and three.columns == given.columns

    four = stages["benchmark decontamination"](spark, three, path).cache()
    leaked = {i for i, _ in plain_leaks(rows_of(three), [(1, item)])}
    assert rows_of(four) == [(i, t) for i, t in rows_of(three) if i not in leaked] and leaked == {500, 501} and four.columns == given.columns

    five = stages["packing"](spark, four, path).collect()
    sizes = {}
    for i, t in rows_of(four):
        if i is not None:
            sizes[i] = max(sizes.get(i, 0), len(words(t)))
    check_pieces(five, sizes, 2048)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()))
    assert whole == sorted(map(tuple, five))


def test_packing_does_not_depend_on_how_many_documents_are_connected(spark, sf, monkeypatch):
    given = spark.createDataFrame([(k, edited(prose(k // 30, 80), 0.02 * (k % 30), k)) for k in range(120)], "doc_id long, text string")
    whole = sorted(map(tuple, corpus_pipeline.related_packing(spark, given, sf[0]).collect()))
    *others, block = packing.pack.__defaults__
    assert block == 1 << 19
    monkeypatch.setattr(packing.pack, "__defaults__", (*others, 4))  # as if the components were larger than the block
    assert sorted(map(tuple, corpus_pipeline.related_packing(spark, given, sf[0]).collect())) == whole


def test_an_empty_corpus_passes_through(spark, sf):
    path, _, _ = sf
    d = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, path)
    assert d.count() == 0


def test_there_is_one_query_for_each_operator(spark):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 11)]
    out = QUERIES["op2_pii"](spark, f"{DATA}/sf0.001")
    assert "doc_id" in out.columns
