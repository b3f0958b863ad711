"""Token counts, private data, quality and templates: exact round trips, held-out accuracy, plain versions."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, ODD, docs, prose, table, texts
from pyspark.sql import functions as F

from lodestar.llm import htmltemplate, pii, quality, textkit, tokencount
from lodestar.llm.queries import QUERIES

TOKENIZERS = "/opt/tokenizers"

# token counts


def plain_counts(rows, path=tokencount.TOKENIZER):
    count = tokencount.encoder(path)
    normal = lambda t: t.replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n")
    return sorted(((i, None if t is None else count([normal(t)])[0]) for i, t in rows), key=str)


def test_token_counts_of_the_corpus(spark, tmp_path):
    corpus = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = sorted(map(tuple, tokencount.token_counts(corpus, str(tmp_path / "c")).collect()), key=str)
    assert got == plain_counts(texts().items())
    assert spark.read.parquet(str(tmp_path / "c")).count() == len({t.rstrip(" \t\n") for t in texts().values()})


def test_the_cache_encodes_only_misses(spark, tmp_path):
    cache = str(tmp_path / "c")
    rows = [*ODD, (20, "line\r\nnext\r"), (21, "line\nnext"), (22, "line\nnext  \n")]
    some = docs(spark, rows)
    assert sorted(map(tuple, tokencount.token_counts(some, cache).collect()), key=str) == plain_counts(rows)
    held = spark.read.parquet(cache).count()
    assert held == len({(t or "").replace("\r\n", "\n").replace("\r", "\n").rstrip(" \t\n") for _, t in rows if t is not None})
    again = tokencount.token_counts(some, cache)
    assert sorted(map(tuple, again.collect()), key=str) == plain_counts(rows) and spark.read.parquet(cache).count() == held
    # a wrong count in the cache shows that it is what answers
    more = [*rows, (30, "a text of its own")]
    for small in (0, 10):
        assert sorted(map(tuple, tokencount.token_counts(docs(spark, more), cache, small=small).collect()), key=str) == plain_counts(more)
    assert spark.read.parquet(cache).count() == held + 1
    forged = spark.createDataFrame([("t", 7)], "text string, n_tokens long").select(F.lit(tokencount.version(tokencount.TOKENIZER)).alias("tokenizer"), *tokencount.content_key(F.col("text")), "n_tokens")
    forged.write.parquet(str(tmp_path / "forged"))
    assert tokencount.token_counts(docs(spark, [(1, "t")]), str(tmp_path / "forged")).first()["n_tokens"] == 7


def test_versions_are_kept_apart(spark, tmp_path):
    cache = str(tmp_path / "c")
    rows = [(1, "Some Words, and more words"), (2, None), (3, "")]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = f"{TOKENIZERS}/{name}"
        assert sorted(map(tuple, tokencount.token_counts(docs(spark, rows), cache, tokenizer=path).collect()), key=str) == plain_counts(rows, path)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 4
    assert tokencount.token_counts(docs(spark, rows).limit(0), str(tmp_path / "none")).count() == 0
    assert tokencount.version(path) != tokencount.version(f"{TOKENIZERS}/word_bpe_49k.json")


def test_both_kinds_of_one_vocabulary_agree():
    own = list(texts().values())[:200]
    assert tokencount.encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")(own) == tokencount.encoder(f"{TOKENIZERS}/byte_bpe_50k.json")(own)


# private data

PRIVATE = {
    "email": "anna.berg@mail7.example.com", "phone": "+1 (212) 555-7713", "ip": "97.51.17.173", "card": "4539 1488 0343 6467", "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962", "ssn": "219-09-9999", "iban": "DE89 3704 0044 0532 0130 00",
}


def test_planted_spans_are_found_and_decoys_are_not(spark):
    rows, want = [], set()
    for k in range(140):
        kind = list(PRIVATE)[k % 7]
        before, after = prose(k, 20) + " ", " " + prose(500 + k, 20)
        rows.append((k, before + PRIVATE[kind] + after))
        want.add((k, len(before), len(before) + len(PRIVATE[kind]), kind))
    for k in range(60):
        digits = "".join(str(random.Random(k).randrange(10)) for _ in range(16))
        decoys = [digits if not pii.luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10), "999.1.2.300", "version 3.0 of 12 parts", "666-00-0000"]
        rows.append((1000 + k, prose(900 + k, 15) + " " + decoys[k % 4] + " " + prose(k, 15)))
    got = {(r["doc_id"], r["start"], r["stop"], r["kind"]) for r in pii.private_spans(docs(spark, rows)).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert not {i for i, *_ in got if i >= 1000}


def test_private_spans_of_the_corpus(spark):
    corpus = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    got = collections.defaultdict(set)
    for r in pii.private_spans(corpus).collect():
        got[r["doc_id"]].add((r["start"], r["stop"], r["kind"]))
    sure = collections.defaultdict(set)
    for i, t in texts("sf0.1").items():
        for k, a, b in pii.spans(t, False):
            v = pii.votes(k, t[a:b], t[max(0, a - 48) : a])
            if v[0] == 1 and v[1] >= 0 and v[2] >= 0:
                sure[i].add((a, b, k))
    total = sum(map(len, sure.values()))
    assert total > 300 and sum(len(sure[i] & got[i]) for i in sure) >= 0.95 * total
    assert sum(len(got[i] - sure[i]) for i in got) <= 0.05 * total


# what the formats are, written down once more
FORMATS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]*@(?:[A-Za-z0-9-]+[.])+(?:com|org|net|example)(?![\w-])(?![.]\w)",
    "ip": r"(?<![\d.])(?:\d{1,3}[.]){3}\d{1,3}(?![\d.])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])(?:\d{4}(?: \d{4}){3}|\d{13,19})(?![\d-]| \d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: [0-9A-Z]{4}){4,6}(?: [0-9A-Z]{1,3})?(?!\w)",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])",
}


def plain_true(kind, span):
    digits = [int(c) for c in span if c.isdigit()]
    if kind == "ip":
        return all(int(x) < 256 for x in span.split("."))
    if kind == "card":
        return sum(sum(divmod(d * 2, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0
    if kind == "ssn":
        a, b, c = span.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if kind == "iban":
        packed = span.replace(" ", "")
        return int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in packed[4:] + packed[:4])) % 97 == 1
    return kind != "secret" or any(c.isdigit() for c in span) and len(set(span)) >= 8


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_private_spans_against_plain_formats(spark, sf):
    """Every span that formats and checksums, written down here, call private is found in the whole table, and few others of these kinds are."""
    got = {(r["doc_id"], r["start"], r["stop"], r["kind"]) for r in pii.private_spans(spark.read.parquet(f"{DATA}/{sf}/documents.parquet")).collect()}
    want = {(i, m.start(), m.end(), k) for i, t in texts(sf).items() for k, f in FORMATS.items() for m in re.finditer(f, t) if plain_true(k, m.group())}
    assert len(want) > 20 and len(got & want) >= 0.97 * len(want)
    others = {x for x in got if x[3] in FORMATS} - want
    assert len(others) <= 0.03 * len(want)


def test_private_spans_of_odd_rows(spark):
    rows = [*ODD, (None, "write to a.b@example.org now"), (20, "write to a.b@example.org now"), (20, "write to a.b@example.org now"), (21, "é " * 30 + "a.b@example.org")]
    got = sorted(((r["doc_id"], r["start"], r["stop"]) for r in pii.private_spans(docs(spark, rows)).collect()), key=str)
    assert got == [(20, 9, 24), (21, 60, 75), (None, 9, 24)]
    assert pii.private_spans(docs(spark, rows).limit(0)).count() == 0


def test_private_data_of_other_countries(spark):
    phones = ["+33 1 23 45 67 89", "01 23 45 67 89", "+34 612 34 56 78", "+49 30 12345678", "+49 151 23456789", "(030) 1234567", "5551234567", "+15551234567"]
    people = ["Hans Müller", "José García", "María López"]
    for kind, given in (("phone", phones), ("person", people)):
        for x in given:
            assert (kind, 6, 6 + len(x)) in pii.spans(f"alpha {x} beta", True)
    rows = [(k, f"{prose(k, 5)} {'phone' if k % 2 else 'tel'}: {phones[k % 8]} {prose(k + 500, 5)}") for k in range(80)]
    rows += [(100 + k, f"{prose(k, 5)} signed by {people[k % 3]} {prose(k + 500, 5)}") for k in range(30)]
    rows += [(200 + k, f"{prose(k, 5)} {x} {prose(k + 500, 5)}") for k, x in enumerate(["2024-01-15", "3.14159265", "1,234,567", "12 45 78 90"] * 10)]
    got = {(r["doc_id"], r["kind"]) for r in pii.private_spans(docs(spark, rows)).collect()}
    assert got == {(i, "phone" if i < 100 else "person") for i, _ in rows if i < 200}


# quality


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in rows], "doc_id long, quality int, toxic int, text string")


def test_held_out_documents_are_told_apart(spark):
    sf = f"{DATA}/sf0.1"
    corpus, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(corpus, marks.filter("pmod(xxhash64(doc_id, 1), 10) < 7"))
    rows = quality.score(corpus, model).join(marks.filter("pmod(xxhash64(doc_id, 1), 10) >= 7"), "doc_id").toPandas()
    rows.columns = ["doc_id", "score", "keep", "label", "toxic"]
    clean, junk, toxic = rows[(rows.label == 1) & (rows.toxic == 0)], rows[rows.label == 0], rows[(rows.label == 1) & (rows.toxic == 1)]
    assert clean.keep.mean() > 0.97 and junk.keep.mean() < 0.1 and toxic.keep.mean() < 0.2
    # scored alone or in any company, a text has one quality
    some = corpus.limit(40)
    one = {r["doc_id"]: r["quality"] for r in quality.score(some.repartition(40), model).collect()}
    assert one == {r["doc_id"]: r["quality"] for r in quality.score(some.coalesce(1), model).collect()}


def plain_quality(model, text):
    """Of one text, line by line, with sums in logarithms."""
    symbols = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-?\"()"}
    hashes = textkit.words(pa.array([text])).hash.tolist()
    every = [bytes(x).lower() for x in re.findall(rb"[^ \t\n\r\x0b\x0c]+", text.encode())]
    rows, scores, sizes, at = [], [], [], 0
    for line in text.encode().split(b"\n"):
        found = list(re.finditer(rb"[^ \t\r\x0b\x0c]+", line))
        if not found:
            continue
        span, n = line[found[0].start() : found[-1].end()], len(found)
        share = lambda f, span=span: sum(map(f, span)) / len(span)
        again = sum(at + k > 0 and hashes[at + k] == hashes[at + k - 1] for k in range(n)) / n
        row = [1.0, math.log1p(n), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in symbols), share(lambda c: c >= 128), min(len(span) / n / 10, 3)]
        rows.append([*row, float(span[-1:] in b".!?"), again, len(set(hashes)) / len(hashes), math.log1p(len(every))])
        scores.append(sum(model.words[h >> 48] for h in hashes[at : at + n]))
        sizes.append(len(span))
        at += n
    if not rows:
        return 0.0
    for k in range(len(rows)):
        before = [rows[k - 1][c] if k else 0.0 for c in (0, 2, 4, 7, 8)]
        after = [rows[k + 1][c] if k + 1 < len(rows) else 0.0 for c in (0, 2, 4, 7, 8, 9)]
        scores[k] += sum((x - m) / s * w for x, m, s, w in zip(rows[k] + before + after, model.mean, model.spread, model.dense, strict=True))
    total = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    emit = [(0.0, x) for x in scores]  # of bad and of good
    steps = model.steps.tolist()
    ahead = [emit[0]]
    for e in emit[1:]:
        ahead.append(tuple(e[j] + total(ahead[-1][0] + steps[0][j], ahead[-1][1] + steps[1][j]) for j in (0, 1)))
    back = [(0.0, 0.0)]
    for e in reversed(emit[1:]):
        back.append(tuple(total(steps[i][0] + e[0] + back[-1][0], steps[i][1] + e[1] + back[-1][1]) for i in (0, 1)))
    good = [1 / (1 + math.exp(min(700, a[0] + b[0] - a[1] - b[1]))) for a, b in zip(ahead, reversed(back), strict=True)]
    return sum(s * g for s, g in zip(sizes, good, strict=True)) / sum(sizes)


def test_quality_against_a_plain_field(spark):
    """The query's rows over the whole table: each text is scored line by line in Python, with the weights that were learned."""
    sf = f"{DATA}/sf0.01"
    corpus, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(corpus, marks)
    got = {r["doc_id"]: r["quality"] for r in QUERIES["op6_quality"](spark, sf).collect()}
    want = {i: plain_quality(model, t) for i, t in texts().items()}
    sure = {i for i, q in want.items() if abs(q - model.threshold) > 1e-6}
    assert {i for i in sure if want[i] >= model.threshold} == set(got) & sure and 100 < len(got) < len(want)
    assert all(abs(got[i] - want[i]) < 1e-5 for i in set(got) & sure)


def test_training_texts_are_bounded_in_bytes(spark):
    rows = [(k, prose(k, 40)) for k in range(30)]
    some, good = quality.labelled(docs(spark, rows).selectExpr("doc_id as id", "text"), labels(spark, [(k, k % 2, 0) for k in range(30)]), 1000, True, 2000)
    assert 0 < len(some) < 30 and len(some) == len(good) and sum(len(t.as_py().encode()) for t in some) <= 2000


def test_quality_of_odd_rows(spark):
    good = [(100 + k, prose(k, 30) + ".\n" + prose(50 + k, 30) + ".") for k in range(40)]
    bad = [(200 + k, "$$$ ### " * 20 + "\nBUY!! NOW!! " * 5) for k in range(40)]
    rows = [*ODD, *good, *bad]
    marks = labels(spark, [*((i, 1, 0) for i, _ in good), *((i, 0, 0) for i, _ in bad), (100, 1, None), (None, 0, 0), (101, None, 1), (9999, 0, 0)])
    got = quality.good_documents(docs(spark, rows), marks).collect()
    ids = [r["doc_id"] for r in got]
    assert {i for i, _ in good} <= set(ids) and not {i for i, _ in bad} & set(ids) and not {1, 2, 3, 10} & set(ids) and ids.count(9) == 2
    assert all(0 <= r["quality"] <= 1 for r in got)
    for few in (marks.limit(0), marks.filter("quality = 1")):
        untrained = quality.good_documents(docs(spark, rows), few)
        assert untrained.count() == len(rows) and untrained.filter("quality is not null").count() == 0
    assert quality.good_documents(docs(spark, rows).limit(0), marks).count() == 0
    model = quality.train(docs(spark, rows), marks, bound=60)
    kept = quality.kept_rows(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and kept.filter("doc_id >= 200").count() == 0


# templates


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], "page_id long, url string, html string, host string, row string, template string")


def page(k, items=2):
    listed = "".join(f"<li class=a><b>{prose(1000 * k + j, 3)}</b> by <i>{prose(2000 * k + j, 2)}</i></li>" for j in range(items))
    return f"<html><head><title>{prose(k, 4)}</title><style>p {{}}</style></head><body><div id=x>Home &amp; Garden</div><ul>{listed}</ul><p>{prose(3000 + k, 12)}<br/>{prose(4000 + k, 5)}</p><!-- c {k} --><div>Copyright Example Corp</div><script>var t='<p>'+{k};</script></body></html>"


def test_slots_hold_what_differs(spark):
    rows = [(k, f"http://site.example/{k}", page(k, 1 + k % 4)) for k in range(8)]
    got = collections.defaultdict(list)
    for r in htmltemplate.extract(pages(spark, rows)).orderBy("page_id", "slot").collect():
        got[r["page_id"]].append((r["slot"], r["text"]))
    for k in range(8):
        want = [prose(k, 4)]
        for j in range(1 + k % 4):
            want += [prose(1000 * k + j, 3), prose(2000 * k + j, 2)]
        assert [t for _, t in got[k]] == [*want, prose(3000 + k, 12), prose(4000 + k, 5)]
    # one place has one number on pages of as many items
    assert [n for n, _ in got[1]] == [n for n, _ in got[5]] != [n for n, _ in got[2]]
    beyond = htmltemplate.extract(pages(spark, rows), limit=0)
    assert sorted((r["page_id"], r["slot"], r["text"]) for r in beyond.collect()) == sorted((i, s, t) for i, own in got.items() for s, t in own)


def test_an_empty_slot_keeps_its_number(spark):
    page_ = lambda k, title: f"<html><head><title>{title}</title></head><body><div>{prose(k, 5)}</div><p>All rights</p></body></html>"
    rows = [(k, f"http://site.example/{k}", page_(k, "" if k == 3 else prose(90 + k, 2))) for k in range(6)]
    got = collections.defaultdict(dict)
    for r in htmltemplate.extract(pages(spark, rows)).collect():
        got[r["page_id"]][r["slot"]] = r["text"]
    title, body = sorted(got[0])
    assert all(got[k] == {title: prose(90 + k, 2), body: prose(k, 5)} for k in (0, 1, 2, 4, 5)) and got[3] == {body: prose(3, 5)}


def plain_template(own, share=0.5, least_pages=3, least_tokens=3):
    """Tokens of the valid classes of one host's token lists."""
    if len(own) < least_pages:
        return set()
    vectors = collections.defaultdict(list)
    counts = [collections.Counter(t) for t in own]
    for t in sorted({x for c in counts for x in c}):
        v = tuple(c[t] for c in counts)
        support = sum(n > 0 for n in v)
        if support >= max(least_pages, share * len(own)):
            vectors[v].append(t)
    classes = sorted((v for v in vectors.items() if len(v[1]) >= least_tokens), key=lambda v: (-sum(n > 0 for n in v[0]), -len(v[1]), v[1]))
    valid = []
    for n, (v, members) in enumerate(classes):
        blocks = set()
        for t in own:
            seq = [x for x in t if x in set(members)]
            m = len(members)
            rows = [tuple(seq[i : i + m]) for i in range(0, len(seq), m)]
            blocks |= {r if len(set(r)) == m else None for r in rows}
        if len(blocks) == 1 and None not in blocks:
            valid.append((n, members))

    def nested(t, outer, inner):
        marks = [i for i, x in enumerate(t) if x in outer]
        seq = [i for i, x in enumerate(t) if x in inner]
        m = len(inner)
        gaps = [sum(i < j for i in marks) for j in seq]
        return all(gaps[i] == gaps[i + m - 1] for i in range(0, len(gaps), m))

    gone = set()
    for i, (_, a) in enumerate(valid):
        for n, b in valid[i + 1 :]:
            if any(not (nested(t, set(a), set(b)) or nested(t, set(b), set(a))) for t in own if set(t) & set(a) and set(t) & set(b)):
                gone.add(n)
    return {x for n, members in valid if n not in gone for x in members}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_templates_of_the_pages(spark, sf):
    t = table("pages", sf)
    hosts = collections.defaultdict(list)
    for u, h in zip(t["url"], t["html"], strict=True):
        w, _ = htmltemplate.tokens(pa.array([h]))
        hosts[u.split("/")[2].lower()].append(w.hash.view(np.int64).tolist())
    want = {h: plain_template(own) for h, own in hosts.items()}
    base = spark.read.parquet(f"{DATA}/{sf}/pages.parquet")
    base = base.select("page_id", htmltemplate.host().alias("host"), "html", F.xxhash64("page_id", "url", "html").alias("row"))
    got = {r["host"]: set(r["template"]) for r in htmltemplate.templates(base, 0.5, 3, 3, 10**6).collect()}
    assert got == {h: x for h, x in want.items() if x} and got


def test_tokens_of_tags():
    w, tag = htmltemplate.tokens(pa.array(['a<b class="x>y">c d</b >e<br/>f <3 g<!-- <p> --><script>h</script>', None, "<", "<p", "x < y", ""]))
    own = [[(w.raw[a:b].tobytes().decode(), bool(k)) for a, b, k in zip(w.start[lo:hi], w.end[lo:hi], tag[lo:hi])] for lo, hi in zip(w.first[:-1], w.first[1:])]
    assert own[0][:2] == [("a", False), ("<b", True)]
    assert [x for x, k in own[0] if k] == ["<b", "</b", "<br"] and "h" not in [x for x, _ in own[0]]
    assert own[1] == [] and own[3] == [("<p", True)] and own[5] == [] and [x for x, _ in own[4]] == ["x", "<", "y"]
    assert len(textkit.words(pa.array([""])).hash) == 0


def test_extract_of_odd_rows(spark):
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (3, None, "<p>no host"), (4, "", "<p>no &lt;host&gt;"), (None, "http://h/3", "<b>null id</b>"), (5, "HTTP://User@H:80/5", "plain words"), (5, "HTTP://User@H:80/5", "plain words"), (6, "http://one/", "<p>" + prose(1, 20_000))]
    got = sorted(((r["page_id"], r["slot"], r["text"]) for r in htmltemplate.extract(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 0, "no host"), (4, 0, "no <host>"), (None, 0, "null id"), (5, 0, "plain words"), (5, 0, "plain words"), (6, 0, prose(1, 20_000))], key=str)
    assert htmltemplate.extract(pages(spark, rows).limit(0)).count() == 0
