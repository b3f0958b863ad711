"""Operator 2, private data by weak supervision.

Candidate spans come from loose patterns and a gazetteer of names.  Regex, checksum, gazetteer and context labelers
vote on each; expectation-maximisation over the counts of all vote patterns of the corpus estimates the labelers' reliabilities, and a
logistic span classifier is trained on the resulting probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import textkit
from lodestar.llm.common import column, picked, slices, stored
from lodestar.llm.decontaminate import Lookup

KINDS = ("email", "phone", "ip", "card", "secret", "ssn", "iban", "person")
#: Loose patterns: what might be of a kind.  What may be long is taken whole and only from where it begins, so that long lines take linear time.
CANDIDATES = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)*)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[A-Za-z]*\d)[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])|\b(?:sk|pk|ghp|AKIA)[_-]?[0-9A-Za-z]{16,}+(?!\w))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.+-])(?!00)\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\w+.,-])(?:\(?\+)?\(?\d(?:[ ./()-]{0,3}\d){6,14}(?![\w-]|[.,]\d))"
)
_CAPITAL = "".join(c for c in map(chr, range(0x530)) if c.isupper())
_SURNAME = rf"[{_CAPITAL}](?:[^\W\d_]|['’-](?=[{_CAPITAL}]))+"
#: Strict patterns: what a kind looks like.
STRICT = {
    "email": re.compile(r"[A-Za-z0-9À-￿_][\w.+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "phone": re.compile(
        r"\(?\+\d(?:[ ./()-]{0,3}\d){6,14}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
        r"|\(0\d{1,5}\)[ ./-]{0,3}\d{2,9}(?:[ ./-]\d{2,9}){0,4}|0\d(?:[ .-]\d{2}){4}|0\d{2,5}[ /-]\d{3,9}(?:[ -]\d{2,4}){0,3}"
    ),
    "ip": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "card": re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}"),
    "secret": re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|AKIA)[_-]?[0-9A-Za-z]{16,}"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]+"),
    "person": re.compile(rf"[{_CAPITAL}][^\W\d_]+ {_SURNAME}"),
}
#: What a kind may look like, but other numbers do as well: no vote.
VAGUE = {"phone": re.compile(r"\d{9,11}|[6-9]\d{2}(?: \d{3}){2}|[6-9]\d{2}(?: \d{2}){3}")}
CONTEXT = {
    "email": re.compile(r"(?:e-?mail|mailto|contact|write to|reach)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "phone": re.compile(r"(?:phone|tel|mobile|call|fax|cell|dial|reach)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server|ping|from)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "card": re.compile(r"(?:card|visa|master|amex|credit|debit|pan)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "secret": re.compile(r"(?:token|secret|key|password|passwd|bearer|auth|credential)\s*[=:]?\s*[\"']?\Z", re.I),
    "ssn": re.compile(r"(?:ssn|social|security)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "iban": re.compile(r"(?:iban|account|bank)\W{0,12}\w{0,12}\W{0,4}\Z", re.I),
    "person": re.compile(r"(?:mr|mrs|ms|dr|prof|name is|dear|signed|by|from|contact)\W{0,4}\Z", re.I),
}
AGAINST = re.compile(r"(?:version|release|isbn|doi|section|figure|commit|sha1?|md5|checksum|order|item|part)\W{0,4}(?:no|number)?\W{0,4}\Z", re.I)
#: Common given names; a span of one before another capitalised word may be a person.
NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Mary Patricia Jennifer Linda "
    "Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Dorothy Melissa Deborah Hans Klaus Jürgen Wolfgang Ursula Sabine Pierre Jacques "
    "Jean Michel Camille Élodie François Juan José Luis Carlos María Carmen Javier Miguel Ana Lucía Pablo Sofia Giovanni Marco Giulia Ivan Olga Wei Ming Yuki Hiroshi Ahmed Fatima Mohammed Aisha Priya Raj".split()
)
DOMAINS = frozenset("com org net edu gov mil int info biz io co me us uk de fr es it nl pl ru cn jp in br ca au ch at be se no dk fi eu dev app cloud".split())
VOTERS = ("regex", "checksum", "gazetteer", "context")
SHAPES, WORDS = 64, 256
#: Characters before a span that are read for its context; no pattern of CONTEXT or AGAINST is longer.
REACH = 48
FEATURES = len(KINDS) * (1 + 3 * len(VOTERS)) + SHAPES + WORDS


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def checksum(kind: str, span: str) -> int:
    """1 or -1 where a kind has a rule that spans obey, 0 where it has none."""
    if kind == "card":
        return 1 if luhn(re.sub(r"\D", "", span)) else -1
    if kind == "ip":
        parts = [int(x) for x in span.split(".")]
        return 1 if max(parts) <= 255 and not all(p == 0 for p in parts) else -1
    if kind == "iban":
        packed = span.replace(" ", "")
        packed = packed[4:] + packed[:4]
        return 1 if 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed)) % 97 == 1 else -1
    if kind == "ssn":
        a, b, c = span.split("-")
        return -1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 1
    if kind == "phone":
        if not 8 <= sum(c.isdigit() for c in span) <= 15:
            return -1
        return 1 if STRICT[kind].fullmatch(span) else 0
    if kind == "secret":
        return 1 if len(set(span.lower())) >= 8 else -1
    return 0


def gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
    if kind == "person":
        return 1 if span.split()[0] in NAMES else -1
    if kind == "ip":
        return -1 if span in ("0.0.0.0", "127.0.0.1", "255.255.255.255") else 0
    return 0


def votes(kind: str, span: str, before: str) -> tuple[int, int, int, int]:
    context = 1 if CONTEXT[kind].search(before) else -1 if AGAINST.search(before) else 0
    like = 1 if STRICT[kind].fullmatch(span) else 0 if kind in VAGUE and VAGUE[kind].fullmatch(span) else -1
    return like, checksum(kind, span), gazetteer(kind, span), context


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def shape(span: str, after: str) -> int:
    """What the span is made of: runs of digits, letters and others, and whether it ends where a word does."""
    return _bucket(re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", span)) + (" " if after[:1].isspace() or not after else "x"), SHAPES)


_NAME_AT = re.compile(r"\b(?:" + "|".join(sorted(NAMES)) + rf") {_SURNAME}(?!\w)")


def spans(text: str, names: bool) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the candidates of a text, in characters."""
    out = [(m.lastgroup, m.start(), m.end()) for m in CANDIDATES.finditer(text)]
    if names:
        out += [("person", m.start(), m.end()) for m in _NAME_AT.finditer(text)]
    return [(k, a, b - (text[b - 1] in ".-")) for k, a, b in out]


def candidates(docs: DataFrame) -> DataFrame:
    """(id, start, stop, kind, v0..v3, shape, word) of each candidate span of each text."""
    known = textkit.words(pa.array(sorted(NAMES)), alnum=True).hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(known)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = textkit.buffers(column(batch, "text"))
                marks = np.flatnonzero(((raw >= 48) & (raw <= 57)) | (raw == 64))
                own = np.searchsorted(offsets, marks, side="right") - 1
                digits = np.bincount(own, minlength=batch.num_rows)
                w = textkit.words(column(batch, "text"), alnum=True)
                at, _ = look.find(w.hash)
                named = np.bincount(np.searchsorted(w.first, at, side="right") - 1, minlength=batch.num_rows)
                rows = []
                some = np.flatnonzero(digits + named)
                ids = column(batch, "id").take(pa.array(some)).to_pylist()
                texts = column(batch, "text").take(pa.array(some)).to_pylist()
                for i, name, text in zip(some, ids, texts, strict=True):
                    for kind, a, b in _near(text, bool(digits[i]), bool(named[i])):
                        before = text[max(0, a - REACH) : a]
                        words = before.split()
                        previous = words[-1].lower() if words else ""
                        rows.append((name, a, b, kind, *votes(kind, text[a:b], before), shape(text[a:b], text[b : b + 1]), _bucket(previous, WORDS)))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 10
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()] + [pa.int32()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "start", "stop", "kind", "v0", "v1", "v2", "v3", "shape", "word"])

    return docs.mapInArrow(run, "id long, start int, stop int, kind string, v0 int, v1 int, v2 int, v3 int, shape int, word int")


_MARK = re.compile(r"[\d@]")


def _near(text: str, digits: bool, names: bool) -> list[tuple[str, int, int]]:
    """spans() of the lines that hold a digit or an at sign: no pattern but that of names matches without, or across lines."""
    if names:
        return spans(text, True)
    out, at = [], 0
    while digits and (m := _MARK.search(text, at)):
        left = text.rfind("\n", 0, m.start()) + 1
        right = text.find("\n", m.start())
        right = len(text) if right < 0 else right
        out += [(k, a + left, b + left) for k, a, b in spans(text[left:right], False)]
        at = right
    return out


def reliabilities(patterns: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and how often each occurs.

    Returns the share of positives, the probability of each voter's vote given [negative, positive], as an array
    (voters, 2, 3), and each pattern's probability of being positive.
    """
    voters = patterns.shape[1]
    trust = np.array([2.0, 6.0, 3.0, 2.0])[:voters]
    p = 1 / (1 + np.exp(-(patterns * trust).sum(axis=1) + 1))
    share, table = 0.5, np.full((voters, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * count, p * count])
        total = weight.sum()
        share = float((weight[1].sum() + 1) / (total + 2))
        for v in range(voters):
            for k in range(3):
                hit = patterns[:, v] == k - 1
                # one vote of each kind to begin with, against probabilities of 0
                table[v, :, k] = (weight[:, hit].sum(axis=1) + 0.1) / (weight.sum(axis=1) + 0.3)
        logs = np.log(np.stack([np.full(len(p), 1 - share), np.full(len(p), share)]))
        for v in range(voters):
            logs += np.log(table[v][:, patterns[:, v] + 1])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            p = new
            break
        p = new
    return share, table, p


def encode(kind: np.ndarray, vote: np.ndarray, shapes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The numbers of each row's features that are 1."""
    width = 1 + 3 * len(VOTERS)
    cols = [kind * width]
    cols += [kind * width + 1 + 3 * v + vote[:, v] + 1 for v in range(len(VOTERS))]
    base = len(KINDS) * width
    return np.stack([*cols, base + shapes, base + SHAPES + word], axis=1)


def train(x: np.ndarray, target: np.ndarray, count: np.ndarray, epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier on soft labels, by AdaGrad."""
    w, square = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    share = count / max(1.0, count.sum())
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-w[x].sum(axis=1)))
        g = np.bincount(x.ravel(), weights=np.repeat((target - p) * share, x.shape[1]), minlength=FEATURES) - decay * w / FEATURES
        square += g * g
        w += rate * g / np.sqrt(square)
    return w


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, kind, probability): spans, in characters, that are private data with probability `least` or more.

    Kinds are email, phone, ip, card, secret, ssn, iban and person.  Votes are counted and reliabilities are
    estimated over the whole corpus, for each kind apart; the classifier sees the kind, the votes, the span's shape and the word before it, with
    the corpus' counts of each combination as weights.  Its probability is rounded to 6 digits.
    Candidates of the patterns don't overlap: the one that begins first counts, and of several that begin at one
    place the first of email, secret, iban, ip, ssn, card and phone; names may overlap with others.  Very long texts and spans are read whole.
    Null and empty texts have no spans; neither has an empty table.  Null ids are kept as null.  Spans of repeated rows are counted and given once.
    Other columns are ignored.
    """
    base = picked(docs, id=id_col, text=text_col).filter("text is not null").withColumn("id", F.col("id").cast("long"))
    found = stored(candidates(base).distinct())
    # bounded: kinds x 3**4 votes x 64 shapes x 256 words at most
    seen = found.groupBy("kind", "v0", "v1", "v2", "v3", "shape", "word").count().toPandas()
    weights = np.zeros(FEATURES)
    if len(seen):
        seen = seen.sort_values(list(seen.columns), ignore_index=True)
        vote = seen[["v0", "v1", "v2", "v3"]].to_numpy()
        number = seen["kind"].map({k: i for i, k in enumerate(KINDS)}).to_numpy()
        count = seen["count"].to_numpy(float)
        target = np.zeros(len(seen))
        for k in np.unique(number):
            own = np.flatnonzero(number == k)
            patterns, at = np.unique(vote[own], axis=0, return_inverse=True)
            _, _, p = reliabilities(patterns, np.bincount(at.ravel(), weights=count[own], minlength=len(patterns)))
            target[own] = p[at.ravel()]
        weights = train(encode(number, vote, seen["shape"].to_numpy(), seen["word"].to_numpy()), target, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            kind = np.array([of[k] for k in column(batch, "kind").to_pylist()], np.int64)
            vote = np.stack([column(batch, f"v{v}").to_numpy() for v in range(len(VOTERS))], axis=1)
            x = encode(kind, vote, column(batch, "shape").to_numpy(), column(batch, "word").to_numpy())
            p = 1 / (1 + np.exp(-weights[x].sum(axis=1)))
            out = pa.RecordBatch.from_arrays([column(batch, c) for c in ("id", "start", "stop", "kind")] + [pa.array(np.round(p, 6))], names=["doc_id", "start", "stop", "kind", "probability"])
            yield out.filter(pa.array(p >= least))

    return found.mapInArrow(run, "doc_id long, start int, stop int, kind string, probability double")
