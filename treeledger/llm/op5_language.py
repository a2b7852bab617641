"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

Words are runs of letters. A word's score for a language is the sum of log-likelihood ratios of its letter
triples (its ends included), learned from labelled documents. The script of its first letter rules out the languages
that hardly ever use it. The best sequence of languages over all words, where each switch costs ``penalty``, gives
spans; the language of most letters is the document's.

Fitting uses a bounded, deterministic sample of ``docs_per_language`` documents (by a hash of doc_id) of each of at most ``most_languages`` languages, those
with the most documents; so the model, 128 KB for each language, has a bound whatever the labels hold. Predicting covers every whole text.

Cases: null or letterless text is ``und`` with score 0 and no spans; without learned languages every text is ``und``; ties go to
the language first in alphabetical order; equal texts get equal answers; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import at_work, prepare

BUCKETS = 1 << 15
DOCS_PER_LANGUAGE = 2_000
MOST_LANGUAGES = 256
PENALTY = 12.0
#: Words scored at once times languages.
BLOCK_SCORES = 2_000_000
BLOCK_CHARS = 1 << 20

#: Fixed by Unicode: first code points of the ranges by script, up to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its script number plus 1 if it is a letter, else 0."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint8)
        starts = [s for s, _ in SCRIPTS] + [0x110000]
        for (start, name), end in zip(SCRIPTS, starts[1:], strict=True):
            table[start:end] = SCRIPT_NAMES.index(name) + 1
        table *= np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS.append(table)
    return _LETTERS[0]


class Words:
    """The words of some texts: bucket of every letter's triple, first letter and letters of every word, first word of every text."""

    def __init__(self, texts: list[str]):
        joined = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(joined) != sum(map(len, texts)) + len(texts):  # lower() changed a length
            texts = ["".join(c if len(c.lower()) > 1 else c.lower() for c in t) for t in texts]
            joined = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letters()[joined]
        inside = kind > 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        clean = np.where(inside, joined, 0).astype(np.uint32)
        at = np.flatnonzero(inside)
        before = clean[at - 1] if len(at) and at[0] > 0 else np.concatenate([[0], clean[at[1:] - 1]]).astype(np.uint32) if len(at) else clean[:0]
        triple = before * np.uint32(0x85EBCA6B) ^ clean[at] * np.uint32(0xC2B2AE35) ^ clean[at + 1] * np.uint32(0x27D4EB2F)
        triple ^= triple >> np.uint32(15)
        triple *= np.uint32(0x2C1B3C6D)
        self.buckets = (triple >> np.uint32(17)).astype(np.int64)
        self.sizes = self.ends - self.starts
        self.first_letter = np.cumsum(self.sizes) - self.sizes
        self.script = kind[self.starts].astype(np.int64) - 1
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_starts = np.concatenate([[0], stops[:-1]]) if len(texts) else stops
        self.first_word = np.searchsorted(self.starts, np.concatenate([[0], stops]))


def blocks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Model:
    """Log-likelihood ratios by bucket and language, and the languages that each script leaves."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray], smooth: float = 0.5, share: float = 0.02):
        self.langs = sorted(counts)
        if not self.langs:
            return
        table = np.stack([counts[k] for k in self.langs], 1).astype(np.float64) + smooth
        table = np.log(table / table.sum(0))
        self.table = (table - table.mean(1, keepdims=True)).astype(np.float32)
        use = np.stack([scripts[k] for k in self.langs], 1).astype(np.float64)
        self.allowed = use >= share * np.maximum(1, use.sum(0))
        self.allowed |= ~self.allowed.any(1, keepdims=True)

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages)."""
        if not len(w.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.table[w.buckets], w.first_letter, axis=0)
        return np.where(self.allowed[w.script], out, np.float32(-1e4))

    def paths(self, scores: np.ndarray, first_word: np.ndarray, penalty: float) -> np.ndarray:
        """The best language of each word; all texts step word by word together, the longest first."""
        n_words = np.diff(first_word)
        order = np.argsort(-n_words, kind="stable")
        lengths, begin = n_words[order], first_word[:-1][order]
        langs = scores.shape[1]
        best = np.zeros(len(scores), np.int64)
        if not len(scores):
            return best
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
        switched, top = np.zeros((len(scores), langs), bool), np.zeros(len(scores), np.int16)
        value = scores[begin[: active[0]]].copy()
        for t in range(1, longest):
            n = active[t]
            if n < len(value):
                value, held = value[:n], value[n:]
                best[begin[n : n + len(held)] + t - 1] = held.argmax(1)
            at = begin[:n] + t
            most = value.argmax(1)
            other = value[np.arange(n), most] - penalty
            to = other[:, None] > value
            switched[at], top[at] = to, most
            value = np.where(to, other[:, None], value) + scores[at]
        best[begin[: len(value)] + longest - 1] = value.argmax(1)
        for t in range(longest - 1, 0, -1):
            at = begin[: active[t]] + t
            now = best[at]
            best[at - 1] = np.where(switched[at, now], top[at], now)
        return best

    def label(self, texts: list[str], penalty: float = PENALTY) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters, spans) of each text."""
        limit = max(1, BLOCK_SCORES // max(1, len(self.langs)))
        parts: list[tuple[Words, np.ndarray, int]] = []
        words = 0
        for a, b in blocks(texts, BLOCK_CHARS):
            w = Words(texts[a:b])
            parts.append((w, self.scores(w) if self.langs else np.zeros((len(w.starts), 1), np.float32), b - a))
            words += len(w.starts)
            if words >= limit:
                yield from self._label(parts, penalty)
                parts, words = [], 0
        if parts:
            yield from self._label(parts, penalty)

    def _label(self, parts: list[tuple[Words, np.ndarray, int]], penalty: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        shift = np.cumsum([0] + [len(w.starts) for w, _, _ in parts])
        first = np.concatenate([w.first_word[:-1] + s for (w, _, _), s in zip(parts, shift[:-1], strict=True)] + [shift[-1:]])
        scores = np.concatenate([s for _, s, _ in parts])
        path = self.paths(scores, first, penalty)
        sizes = np.concatenate([w.sizes for w, _, _ in parts])
        starts = np.concatenate([w.starts - np.repeat(w.text_starts, np.diff(w.first_word)) for w, _, _ in parts])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b or not self.langs:
                yield "und", 0.0, []
                continue
            got, long = path[a:b], sizes[a:b]
            share = np.bincount(got, long, len(self.langs))
            cuts = [0, *(np.flatnonzero(np.diff(got)) + 1).tolist(), b - a]
            spans = [(int(starts[a + i]), int(starts[a + j - 1] + sizes[a + j - 1]), self.langs[got[i]]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield self.langs[int(share.argmax())], float(share.max() / share.sum()), spans


def learning(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: every third of documents, by a checksum of doc_id, is held out."""
    return docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1) & F.col("lang").isNotNull())


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Letter triples and scripts by language over the sample; what reaches the driver is a table of languages by buckets."""
    prepare(docs.sparkSession)
    known = learning(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")))
    totals = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not totals:
        return Model({}, {})
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, int(min(1.0, docs_per_language / n) * (1 << 20)) + 1)])
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")]).where("text is not null")  # no share, no sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                counts, scripts = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                for a, b in blocks(texts, BLOCK_CHARS):
                    w = Words(texts[a:b])
                    counts += np.bincount(w.buckets, minlength=BUCKETS)
                    scripts += np.bincount(w.script, w.sizes, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, (counts, scripts) in sums.items():
            both = np.concatenate([counts, scripts])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(both[at], pa.int64())})

    counts = {k: np.zeros(BUCKETS, np.int64) for k in totals}
    scripts = {k: np.zeros(len(SCRIPT_NAMES), np.int64) for k in totals}
    for r in part.select("lang", "text").mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.at < BUCKETS:
            counts[r.lang][r.at] = r.n
        else:
            scripts[r.lang][r.at - BUCKETS] = r.n
    return Model(counts, scripts)


def languages(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, spans. One pass over the texts after the fit; no shuffle of texts."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit(docs))  # languages x buckets: 128 KB for each language
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op5")
        for batch in batches:
            rows = list(shared.value.label([t or "" for t in batch.column(2).to_pylist()], penalty))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([r[0] for r in rows], pa.string()), "score": pa.array([r[1] for r in rows], pa.float64()),
                    "spans": pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in r[2]] for r in rows], spans),
                }
            )

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")


def in_known_languages(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY, least: float = 0.3) -> DataFrame:
    """docs without those that are ``und`` or have less than ``least`` of their letters in one language; a null lang gets the prediction."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op5")
        for batch in batches:
            rows = list(shared.value.label([t or "" for t in batch.column(names.index("text")).to_pylist()], penalty))
            columns = list(batch.columns)
            if "lang" in names:
                lang = batch.column(names.index("lang"))
                columns[names.index("lang")] = pa.array([a if a is not None else r[0] for a, r in zip(lang.to_pylist(), rows, strict=True)], lang.type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([r[0] != "und" and r[1] >= least for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
