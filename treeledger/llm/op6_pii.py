"""Personal data by boosted trees over generously proposed spans.

Generators propose overlapping spans of many kinds with high recall. Spans of the four base kinds that pass their
rule are always redacted. The others (secrets, local phone numbers, account numbers, written-out addresses and
so on) are judged by boosted trees on their format and surroundings; a threshold calibrated on held-out spans
selects them, and of overlapping spans the surest stays.

The trees are fitted on a bounded sample of documents (``sample_docs``) with labels from strict rules: checksums,
ranges and digit counts, or a word before the span that names a secret. The words that make such labels are
no features.

Cases: null counts as empty text (no spans); equal rows give equal rows; an empty table gives an empty table, a
sample without both classes adds no spans to the base ones; other columns are ignored; texts are read whole and every
pattern is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.boosting import BoostedTrees, platt, sigmoid
from treeledger.llm.common import at_work, prepare

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "key", "token", "iban", "ssn", "local", "mac", "written", "secret")
BASE = 4
SAMPLE_DOCS = 20_000
SAMPLE_SPANS = 20_000
PRECISION = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only; a later start in it can't do better.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = (
    (4, re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])")),
    (5, re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{24,}+(?![A-Za-z0-9_/+=-])")),
    (7, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (8, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (9, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")),
    (10, re.compile(r"(?<![A-Za-z0-9.])[A-Za-z0-9.]{1,64}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,64}+(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]{1,64}+)+")),
)
# Groups of four, of which the last may be partial; the country's length is not known, so ibans() looks for the end by the checksum.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Whatever follows a word that names a secret; the value is looked ahead at, so that it can itself be such a word.
_SECRET = re.compile(r"""(?i)(?:passw\w{0,16}|passphrase|passcode|pwd|secret|token|credential|bearer|(?<![a-z])(?:pass|pin|auth\w{0,16}|(?:\w{1,16}[_-]|api|access|private)?key))s?(?![a-z])["'`)\]]{0,2}(?:\s{0,4}(?:[:=]{1,2}>?|\bis\b)\s{0,4}|\s{1,4})["'`(\[]{0,2}(?=([^\s"'`<>,;]++))""")
_ASSIGNED = re.compile(r"""[:=]>?\s{0,4}["'`(\[]{0,2}\Z""")
_DIGIT = re.compile("[0-9]")
#: One of these is in every word that names a secret, however it is written (dotless i counts as i).
_SECRET_SIGNS = ("pass", "pwd", "secret", "token", "credential", "bearer", "pin", "auth", "key", "\u0131")
_CUE = re.compile(r"(?i)(?:token|secret|passw\w*|key|api|auth\w*|bearer|ssn|iban|account|tel|phone|call|mac)\W{0,6}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ so that long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its rule), each kind leftmost and not overlapping."""
    out = [(0, a, b, True) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        out.append((1, *m.span(), all(len(p.lstrip("0")) < 4 and int(p[-12:]) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) > 6:
            out.append((2, *m.span(), 12 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        out.append((3, *m.span(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def mod97(s: str) -> bool:
    """Whether an account number without spaces has 15 to 34 characters and passes its checksum."""
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers, leftmost: each to the last group at which its checksum is right, or else to its end."""
    out, m = [], _IBAN.search(text)
    while m:
        a, b = m.span()
        ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")]
        end = next((e for e in ends if mod97(text[a:e].replace(" ", ""))), b)
        if len(text[a:end].replace(" ", "")) >= 15:
            out.append((a, end))
        m = _IBAN.search(text, end)
    return out


def more_candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the kinds that the trees judge; they may overlap. A pattern is only tried on a text with the signs that it needs."""
    out = []
    folded = text.casefold()
    digit = _DIGIT.search(text) is not None
    needs = {7: digit, 8: digit, 9: text.count(":") >= 5, 10: "(at" in folded or "[at" in folded}
    for kind, pattern in _MORE:
        if needs.get(kind, True):
            for m in pattern.finditer(text):
                out.append((kind, *m.span()))
    if digit:
        out += [(6, a, b) for a, b in ibans(text)]
    if any(sign in folded for sign in _SECRET_SIGNS):
        for m in _SECRET.finditer(text):
            value = m[1].rstrip(".:!?)]")
            if value:
                out.append((11, m.start(1), m.start(1) + len(value)))
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings."""
    s = text[start:end]
    n = len(s)
    digits, upper, lower = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    vowels = sum(c in "aeiouAEIOU" for c in s)
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    kind_of = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4
    return [
        kind, n, digits, upper, lower, n - digits - upper - lower, len(counts), entropy, digits / n, switches / n, vowels / n,
        kind_of(left[-1:]), kind_of(right[:1]), sum(c.isdigit() for c in left), sum(c.isdigit() for c in right),
        float(left.rstrip(" \"'")[-1:] in (":", "=")), float(left[-1:] in "\"'" and left != ""), len(set(s.lower()) - set("0123456789abcdef")),
        float(kind == 6 and mod97(s.replace(" ", ""))),
    ]


def label(text: str, kind: int, start: int, end: int, good: bool | None) -> bool:
    """The strict rule for training: the base rule, a checksum, or a word before the span or a prefix that names a secret.

    A value after such a word must be assigned to it or be of more than one class of characters, as words of a sentence are not.
    """
    if good is not None:
        return good
    if kind == 10 or kind == 9:
        return True
    if kind == 6 and mod97(text[start:end].replace(" ", "")):
        return True
    if kind == 11:
        s = text[start:end]
        classes = any(c.isdigit() for c in s) + any(c.isupper() for c in s[1:]) + any(c.islower() for c in s) + any(not c.isalnum() for c in s)
        return len(s) > 3 and (classes > 1 or _ASSIGNED.search(text, max(0, start - 12), start) is not None)
    return bool(_CUE.search(text, max(0, start - 24), start) or text.startswith(("AKIA", "ASIA", "ghp_", "sk-"), start))


class Selector:
    """Trees, calibration and threshold; None of them if the sample had one class only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION):
        self.trees = None
        self.threshold = 2.0
        if len(y) < 30 or y.min() == y.max():
            return
        held = np.arange(len(y)) % 3 == 0
        if y[~held].min() == y[~held].max():
            return
        self.trees = BoostedTrees().fit(x[~held], y[~held].astype(float))
        raw = self.trees.score(x[held])
        self.a, self.b = platt(raw, y[held].astype(float))
        p = sigmoid(self.a * raw + self.b)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
        good = np.flatnonzero(right >= precision)
        self.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0

    def chances(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.trees.score(x) + self.b) if self.trees else np.zeros(len(x))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Selector:
    """Fit on the candidate spans of about sample_docs documents, sample_spans spans at most."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, order = [], [], []
            for text in batch.column(1).to_pylist():
                spans = [(k, a, b, ok) for k, a, b, ok in base_candidates(text)] + [(*s, None) for s in more_candidates(text)]
                for kind, a, b, ok in spans:
                    rows.append(features(text, kind, a, b))
                    names.append(label(text, kind, a, b, ok))
                    order.append(int.from_bytes(hashlib.blake2b(text[max(0, a - 40) : b + 40].encode(), digest_size=7).digest(), "big"))
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "y": pa.array(names, pa.bool_()), "o": pa.array(order, pa.int64())})

    rows = part.mapInArrow(run, "x array<double>, y boolean, o long").orderBy("o", "x", "y").limit(sample_spans).collect()
    if not rows:
        return Selector(np.zeros((0, 1)), np.zeros(0, bool))
    return Selector(np.array([r.x for r in rows], float), np.array([r.y for r in rows], bool))


def spans_of(texts: list[str], chooser: Selector) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """For each text its base spans and the added ones, as (start, kind, end)."""
    base: list[list[tuple[int, int, int]]] = []
    more: list[list[tuple[int, int, int]]] = []
    asked, x = [], []
    for i, text in enumerate(texts):
        base.append([])
        more.append([])
        base[i] = sorted((a, k, b) for k, a, b, ok in base_candidates(text) if ok)
        if chooser.trees:
            for k, a, b in more_candidates(text):
                asked.append((i, k, a, b))
                x.append(features(text, k, a, b))
    if asked:
        chance = chooser.chances(np.array(x, float))
        for j in np.lexsort((np.arange(len(asked)), -chance)).tolist():
            i, k, a, b = asked[j]
            if chance[j] < chooser.threshold:
                break
            if all(b <= s or e <= a for s, _, e in [*base[i], *more[i]]):
                more[i].append((a, k, b))
    return base, more


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal(docs: DataFrame, chooser: Selector | None = None, digests: bool = False, redacted: bool = False) -> DataFrame:
    """Per document the counts of base spans, all spans as text and, if asked for, digests or the redacted text.

    A fit on a bounded sample, then one pass without a shuffle.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(chooser or fit(docs))  # a few kilobytes: 40 trees of depth 3
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, spans string" + ", base_sha256 string" * digests + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op6")
        for batch in batches:
            given = batch.column(1).to_pylist()
            base, more = spans_of([t or "" for t in given], model.value)
            out = {"doc_id": batch.column(0)}
            out |= {f"n_{kind}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS[:BASE])}
            out["spans"] = pa.array([joined([*b, *m]) for b, m in zip(base, more, strict=True)], pa.string())
            if digests:
                out["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            if redacted:
                out["redacted"] = pa.array([t if t is None else redact(t, [*b, *m]) for t, b, m in zip(given, base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def without_personal(docs: DataFrame, chooser: Selector | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind, and n_chars to match; texts without spans stay as they are."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(chooser or fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op6")
        for batch in batches:
            given = batch.column(names.index("text")).to_pylist()
            base, more = spans_of([t or "" for t in given], model.value)
            texts = [redact(t, [*b, *m]) if b or m else t for t, b, m in zip(given, base, more, strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                old = batch.column(names.index("n_chars"))
                new["n_chars"] = pa.array([len(t) if b or m else n for t, b, m, n in zip(texts, base, more, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return docs.mapInArrow(run, docs.schema)
