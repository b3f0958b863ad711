"""Operator 3, token counts with a digest cache.

The cache is a Parquet folder of (tokenizer, h1, h2, n_tokens): a digest of the tokenizer's file and
settings, 128 bits of the normalised text, and its number of tokens.  Only distinct texts that the cache lacks are encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestar.llm.common import column, content_key, picked, slices, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of the .tiktoken kind splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = re.compile(rf"(?<!{_WHITE}){_WHITE}{{1000,}}")
NORMALISATION = "1: CR LF and CR become LF; trailing spaces, tabs and LF go"
_loaded: dict[tuple[str, str], Callable[[list[str]], list[int]]] = {}


def normalised(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(" \t\n"))


def parts(text: str) -> list[str]:
    """Texts whose counts by PATTERN add up to that of the text, cut around long white space, at which PATTERN would run out of stack.

    Before other characters, PATTERN makes one piece of all white space but its last character.
    """
    out, at = [], 0
    for m in _LONG_BLANK.finditer(text):
        if m.end() < len(text):
            out += [text[at : m.start()], text[m.start() : m.end() - 1]]
            at = m.end() - 1
    return [*out, text[at:]]


def version(path: str, pattern: str = PATTERN) -> str:
    """Digest of a tokenizer: its file, how it splits, and how texts are normalised."""
    rest = pattern if path.endswith(".tiktoken") else ""
    return hashlib.sha256(Path(path).read_bytes() + f"\0{Path(path).suffix}\0{rest}\0{NORMALISATION}".encode()).hexdigest()


def encoder(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """Texts -> numbers of tokens, without special tokens; loaded once per process."""
    if (path, pattern) not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
            bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            cut = parts if pattern == PATTERN else lambda text: [text]
            _loaded[path, pattern] = lambda texts: [sum(len(bpe.encode_ordinary(t)) for t in cut(text)) for text in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            json = Tokenizer.from_file(path)
            json.encode_special_tokens = True
            json.no_padding()
            json.no_truncation()
            _loaded[path, pattern] = lambda texts: [len(e.ids) for e in json.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path, pattern] = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    return _loaded[path, pattern]


def read_cache(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame | None:
    try:
        held = docs.sparkSession.read.parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    # two jobs may have added the same text: counts of one key are equal
    return held.filter(F.col("tokenizer") == tokenizer).groupBy("h1", "h2").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, small: int = 200_000
) -> DataFrame:
    """(doc_id, n_tokens) of every row; `cache` is a folder that all executors share and is added to.

    Texts are normalised (CR LF and CR to LF, trailing spaces, tabs and LF dropped), and the normalised text is what is
    encoded.  Equal normalised texts are encoded once.  Of at most `small` misses against a cache
    that isn't empty, the keys are broadcast to find the texts; beyond, the texts are shuffled by key.
    Very long texts are encoded whole; so is long white space, with the pattern PATTERN or another that can bear it.
    A null text has a null count, an empty one 0.  Null ids and repeated rows are rows like any other.
    Other columns are ignored; an empty table adds nothing to the cache.
    """
    name = version(tokenizer, pattern)
    base = picked(docs, doc_id=id_col, text=text_col).withColumn("text", normalised(F.col("text")))
    texts = base.filter("text is not null").select("text", *content_key(F.col("text")))
    held = read_cache(docs, cache, name)
    if held is not None:
        keys = base.filter("text is not null").select(*content_key(F.col("text"))).distinct()
        wanted = stored(keys.join(held, ["h1", "h2"], "left_anti"))
        few = wanted.limit(small + 1).count() <= small
        texts = texts.join(F.broadcast(wanted) if few else wanted, ["h1", "h2"], "left_semi")
    misses = texts.dropDuplicates(["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern)
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = pa.array(encode(column(batch, "text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, "h1"), column(batch, "h2"), counts], names=["h1", "h2", "n_tokens"])

    counted = misses.mapInArrow(run, "h1 long, h2 long, n_tokens long")
    counted.select(F.lit(name).alias("tokenizer"), "h1", "h2", "n_tokens").write.mode("append").parquet(cache)
    held = read_cache(docs, cache, name)
    rows = base.select("doc_id", *content_key(F.col("text")), F.col("text").isNull().alias("none"))
    joined = rows.join(held, ["h1", "h2"], "left") if held is not None else rows.withColumn("n_tokens", F.lit(None).cast("long"))
    return joined.select("doc_id", F.when(~F.col("none"), F.col("n_tokens")).alias("n_tokens"))
