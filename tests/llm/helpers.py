import random

import pyarrow.parquet as pq

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h1 string, keys string, root string, passage string, node string, template string, __cut string, window string"


def docs(spark, rows):
    """rows (doc_id, text) as documents, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, -1, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def table(name, sf="sf0.01"):
    return pq.read_table(f"{DATA}/{sf}/{name}.parquet").to_pydict()


def texts(sf="sf0.01"):
    t = table("documents", sf)
    return dict(zip(t["doc_id"], t["text"], strict=True))


def words(text):
    """As the operators: runs of other than ASCII white space, ASCII letters folded."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def spelt(n):
    """A number as letters: digits make a token variable to some operators."""
    return "w" + "".join(chr(97 + int(c)) for c in str(n))


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(spelt(rng.randrange(vocabulary)) for _ in range(n))


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("q" + spelt(rng.randrange(10**6)) if rng.random() < share else w for w in text.split())


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


#: Nulls, empty and blank texts, one word, a very long word and text, ties and repeated rows.
ODD = [(None, "null id here and some more words to hold on to"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "x" * 50_000), (6, prose(6, 20_000)), (7, "é ß 　 ü"), (8, prose(8, 60)), (9, prose(8, 60)), (9, prose(8, 60)), (None, None), (10, "\n\n\n")]
