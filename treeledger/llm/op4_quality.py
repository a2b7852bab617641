"""Quality by co-training: one classifier sees a document's text only, the other its metadata only.

Both are logistic regressions, fitted on a bounded sample of labelled documents. In each round each view marks the unlabelled
documents of a bounded pool that it is surest about, by its probability calibrated on held-out labels, and hands them to the other view as
pseudo-labels. A view without real signal is never sure, so it hands over nothing. In the end a small regression on the calibrated
log-odds of both views, fitted on the held-out fold, scores every document.

Bounds: ``sample`` labelled documents and ``pool`` unlabelled ones, both chosen by a hash of doc_id. Features are computed for all documents
on the executors, and scoring covers every whole text.

Cases: null text counts as empty, null metadata as values of their own; several labels of one document are averaged; without labels of both classes
every score is the share of good ones (0.5 without labels); equal rows get equal scores; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.boosting import platt, sigmoid
from treeledger.llm.common import byte_rows, byte_table, chunks, prepare, run_hashes, words_of

SAMPLE = 10_000
POOL = 10_000
ROUNDS = 3
SURE = 0.97
#: Pseudo-labels that a view hands over in a round, as a share of the pool, for both classes together.
HANDED = 0.2
WORD_BUCKETS = 96
_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"|", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k
CLASSES = 10
TEXT = CLASSES + 6 + WORD_BUCKETS
META = 64


def text_view(texts: list[bytes]) -> np.ndarray:
    """Shares of letters and signs, repetition, lengths, and hashed words of each text."""
    out = np.zeros((len(texts), TEXT), np.float32)
    for a, b in chunks(texts):
        part = [t.replace(b"\x00", b" ") for t in texts[a:b]]
        raw = np.frombuffer(b"\x00".join(part) + b"\x00", np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in part), np.int64, b - a)
        row = np.repeat(np.arange(b - a), sizes)
        signs = np.bincount(row * CLASSES + _CLASS[raw], minlength=(b - a) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
        signs[:, 0] -= 1  # the byte that ends a text
        out[a:b, :CLASSES] = 4 * signs / sizes[:, None]
        data, starts, ends, firsts = words_of(part, _WORDS)
        hashes = run_hashes(data, starts, ends)
        counts = np.diff(firsts)
        owner = np.repeat(np.arange(b - a), counts)
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[new], minlength=b - a)
        lines = [t.split(b"\n") for t in part]
        extra = out[a:b, CLASSES : CLASSES + 6]
        many = np.maximum(1, counts)
        extra[:, 0] = np.log1p(counts) / 5
        extra[:, 1] = distinct / many
        extra[:, 2] = np.log1p(np.bincount(owner, ends - starts, b - a) / many)
        extra[:, 3] = [len(set(x)) / len(x) for x in lines]
        extra[:, 4] = [np.log1p(len(x)) / 3 for x in lines]
        extra[:, 5] = distinct / np.sqrt(many) / 10
        bags = np.bincount(owner * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=(b - a) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        out[a:b, CLASSES + 6 :] = np.sqrt(bags / many[:, None])
    return out


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Language, source and size by hashed indicators."""
    out = np.zeros((len(langs), META), np.float32)
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, zlib.crc32(f"lang {lang}".encode("utf-8", "replace")) % 14] = 1
        out[i, 14 + zlib.crc32(f"source {source}".encode("utf-8", "replace")) % 33] = 1
        if size is not None:
            out[i, 47 + min(15, max(0, int(size)).bit_length() * 3 // 4)] = 1
            out[i, 63] = np.log1p(max(0, size)) / 10
    return out


class Logistic:
    """Ridge logistic regression by Newton steps, on features scaled to unit spread."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = sigmoid(z @ self.w)
            curve = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


class View:
    """A classifier and its calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held_x: np.ndarray, held_y: np.ndarray):
        self.model = Logistic().fit(x, y, weight)
        self.a, self.b = platt(self.model.score(held_x), held_y)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return np.clip(self.a * self.model.score(x) + self.b, -30, 30)


class CoTrained:
    """Both views after their rounds, and the regression that combines them."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, sure: float = SURE):
        self.share = float(y.mean()) if len(y) else 0.5
        self.views: list[View] | None = None
        self.handed = [0, 0]
        held = np.arange(len(y)) % 3 == 0
        if len(y) < 20 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            return
        x, pool = [text, meta], [pool_text, pool_meta]
        extra: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view was given
        for r in range(rounds + 1):
            self.views = []
            for v in (0, 1):
                at = np.fromiter(extra[v], np.int64, len(extra[v]))
                given = np.fromiter(extra[v].values(), float, len(extra[v]))
                self.views.append(View(np.concatenate([x[v][~held], pool[v][at]]), np.concatenate([y[~held], given]), np.r_[np.ones((~held).sum()), np.full(len(at), 0.5)], x[v][held], y[held]))
            if r == rounds or not len(pool[0]):
                break
            for v in (0, 1):
                p = sigmoid(self.views[v].odds(pool[v]))
                free = np.fromiter((i not in extra[1 - v] for i in range(len(p))), bool, len(p))
                most = max(1, int(HANDED / rounds * len(p)))
                for label, chance in ((1.0, p), (0.0, 1 - p)):
                    good = np.flatnonzero(free & (chance >= sure))
                    part = max(1, int(most * (self.share if label else 1 - self.share)))
                    for i in good[np.argsort(-chance[good], kind="stable")][:part].tolist():
                        extra[1 - v][i] = label
                        self.handed[1 - v] += 1
        both = np.stack([self.views[v].odds(x[v][held]) for v in (0, 1)], 1)
        self.joint = Logistic(ridge=0.1).fit(both, y[held], np.ones(held.sum()))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, both) as probabilities."""
        if self.views is None:
            flat = np.full(len(text), self.share)
            return flat, flat, flat
        both = np.stack([v.odds(x) for v, x in zip(self.views, (text, meta), strict=True)], 1)
        return sigmoid(both[:, 0]), sigmoid(both[:, 1]), sigmoid(self.joint.score(both))


def chosen(docs: DataFrame) -> DataFrame:
    given = set(docs.columns)
    more = [(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def views_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(byte_rows(batch.column(1))), meta_view(*(batch.column(i).to_pylist() for i in (2, 3, 4)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL, rounds: int = ROUNDS) -> CoTrained:
    """Fit on ``sample`` labelled and about ``pool`` other documents; only their features reach the driver."""
    spark = prepare(docs.sparkSession)
    rows = chosen(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    answers = {r[0]: r[1] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    shared = spark.sparkContext.broadcast(answers)  # sample entries
    total = rows.count()
    limit = int(min(1.0, pool / max(1, total)) * (1 << 20)) + 1
    picked = rows.withColumn("pool", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < limit, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [i for i, (d, p) in enumerate(zip(ids, batch.column(5).to_pylist(), strict=True)) if p or d in shared.value]
            part = batch.take(pa.array(keep, pa.int64()))
            text, meta = views_of(part)
            yield pa.RecordBatch.from_pydict({"y": pa.array([shared.value.get(ids[i], -1) for i in keep], pa.int32()), "doc_id": part.column(0), "x": pa.array([np.concatenate(v).tobytes() for v in zip(text, meta, strict=True)], pa.binary())})

    found = picked.mapInArrow(run, "y int, doc_id long, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * (sample + pool)).collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]) if found else np.zeros((0, TEXT + META), np.float32)
    y = np.array([r.y for r in found], np.int64)
    return CoTrained(x[y >= 0, :TEXT], x[y >= 0, TEXT:], y[y >= 0].astype(float), x[y < 0, :TEXT], x[y < 0, TEXT:], rounds)


def quality(docs: DataFrame, labels: DataFrame, model: CoTrained | None = None, keep_at: float = 0.5, **bounds) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score, keep. One pass over the texts after the fit, no shuffle."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit(docs, labels, **bounds))  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = shared.value.score(*views_of(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_score": pa.array(a, pa.float64()), "meta_score": pa.array(b, pa.float64()), "score": pa.array(both, pa.float64()), "keep": pa.array(both >= keep_at, pa.bool_())})

    return chosen(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")
