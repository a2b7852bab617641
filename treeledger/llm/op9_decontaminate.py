"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of the corpus (overlapping windows of words) is a query. A posting carries the share that its term adds to
its item's own score. An item's threshold is the least share that any passage with enough of its shingles can have: the dearest words that
so few missing shingles can take away are found exactly, so retrieval loses nothing that verification would accept. Items lie in
blocks, those of like vocabulary together; a term's list holds the blocks that have it, with its largest share in each.

A passage's terms, in rising order of their largest share anywhere, sum up to the pivot at which the lowest threshold comes into reach: an
item without any term from there on can't get there, so only the lists from the pivot on are read. What they find in a block, with the rest's
largest shares, bounds each item in it; blocks that stay below are skipped, then the rest's own maxima in the block decide, and only then
are items scored. What reaches its threshold is verified: enough of the item's word shingles, of its question as well as its answer, must stand in the passage.
One word changes up to ``shingle`` shingles, so an answer of fewer shingles is no evidence by itself and the whole item decides.

Passages are twice as long as the power of two that holds the item, and begin at every such power, whatever other items there are.
The index is broadcast in shards of at most ``shard_items`` items, one after another: about 12 bytes for each distinct word of an item and 8 for each shingle
(20 MB for 20,000 items of 40 words). More items take more passes over the texts, never a larger index.

Cases: null or short texts have one passage or none; an item of fewer than ``shingle`` words is found if all its words stand in order;
items with equal texts are all reported, null items and items without words are skipped, a null item_id is reported as null; an empty corpus or benchmark gives an empty result; other columns are
ignored; texts are read whole, and repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, at_work, byte_rows, byte_table, chunks, prepare, run_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCK = 8
#: Passages begin at every so many words at least.
STRIDE = 32
#: For sums of shares in floating point.
EPS = 1e-6
SHARD_ITEMS = 20_000
K1, B = 1.2, 0.75

_TABLE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    data, starts, ends, firsts = words_of(texts, _TABLE)
    return run_hashes(data, starts, ends).view(np.int64), firsts


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.int64)
    for k in range(n):
        out = out * np.int64(0x2545F4914F6CDD1D) + words[k : k + count]
    return out


def most_lost(shares: np.ndarray, n: int, missing: int) -> float:
    """The largest sum of shares of words that a text can lack if at most ``missing`` runs of n words are missing.

    A word is lacking only if all runs over it are. Going from left to right, a word adds the runs that the last lacking word doesn't share.
    """
    if missing <= 0:
        return 0.0
    runs = len(shares) - n + 1
    best = np.full((len(shares), missing + 1), -np.inf)  # by last lacking word and runs spent
    far = np.zeros(missing + 1)  # nothing, or any last word too far left to share a run
    for j, share in enumerate(shares.tolist()):
        if j >= n:
            far = np.maximum(far, np.maximum.accumulate(best[j - n]))
        for i in range(max(-1, j - n), j):
            cost = max(0, min(j, runs - 1) - max(j - n + 1, (i if i > j - n else -1) + 1, 0) + 1)
            if cost <= missing:
                before = far if i == max(-1, j - n) else best[i]
                best[j, cost:] = np.maximum(best[j, cost:], before[: missing + 1 - cost] + share)
    return max(0.0, float(best.max()))


class Part:
    """Inverted index of items that take passages of one length."""

    def __init__(self, stride: int, items: list[Item], shingle: int, similarity: float, block: int):
        self.stride, self.block = stride, block
        spread = Counter(w for item in items for w in set(item.words.tolist()))
        # Items whose most frequent term is the same (mostly, of one language) share blocks, which keeps block maxima low.
        self.items = items = sorted(items, key=lambda x: (max((spread[w], w) for w in x.words.tolist()), x.number))
        mean = sum(len(x.words) for x in items) / len(items)
        shares, least = [], []
        for item in items:
            tf = Counter(item.words.tolist())
            score = {w: math.log(1 + (len(items) - spread[w] + 0.5) / (spread[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(item.words) / mean)) for w, f in tf.items()}
            total = sum(score.values())
            share = {w: s / total for w, s in score.items()}
            shares.append(share)
            # So many runs of words are missing at most; a shingle that comes again takes all its places along.
            times = np.sort(np.unique(grams(item.words, item.k), return_counts=True)[1])[::-1]
            missing = len(times) - math.ceil(similarity * len(times) - 1e-9)
            least.append(1 - most_lost(np.array([share[w] / tf[w] for w in item.words.tolist()]), item.k, int(times[:missing].sum())))
        self.least = np.array(least)
        most: dict[int, float] = {}
        for share in shares:
            for w, s in share.items():
                most[w] = max(most.get(w, 0.0), s)
        rising = sorted(most, key=lambda w: (most[w], w))  # terms are numbered by their largest share
        self.most = np.array([most[w] for w in rising])
        known = np.array(rising, np.int64)
        order = np.argsort(known)
        self.words, self.number = known[order], order
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.words & len(self.sieve) - 1] = True
        number = {w: t for t, w in enumerate(rising)}
        self.blocks = -(-len(items) // block)
        self.least_in = np.minimum.reduceat(self.least, np.arange(0, len(items), block))
        # Terms and shares of each item, and the blocks of each term.
        self.item_first = np.cumsum([0] + [len(x) for x in shares])
        self.item_term = np.fromiter((number[w] for x in shares for w in x), np.int64, self.item_first[-1])
        self.item_share = np.fromiter((s for x in shares for s in x.values()), np.float64, self.item_first[-1])
        places = self.item_term * self.blocks + np.repeat(np.arange(len(items)), np.diff(self.item_first)) // block
        order = np.argsort(places, kind="stable")
        self.list_at, lead = np.unique(places[order], return_index=True)
        self.list_most = np.maximum.reduceat(self.item_share[order], lead)
        self.list_first = np.searchsorted(self.list_at, np.arange(len(rising) + 1) * self.blocks)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's term, or the number of terms."""
        out = np.full(len(words), len(self.words), np.int64)
        maybe = np.flatnonzero(self.sieve[words & len(self.sieve) - 1])
        if len(maybe):
            at = np.searchsorted(self.words, words[maybe])
            at[at == len(self.words)] = 0
            hit = self.words[at] == words[maybe]
            out[maybe[hit]] = self.number[at[hit]]
        return out

    def windows(self, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end) of every passage: two strides every stride, so an item lies whole in one."""
        lengths = np.diff(firsts)
        count = np.maximum(1, -(-lengths // self.stride) - 1) * (lengths > 0)
        row = np.repeat(np.arange(len(lengths)), count)
        begin = firsts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * self.stride
        return row, begin, np.minimum(begin + 2 * self.stride, firsts[row + 1])

    def candidates(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items that a passage brings to their threshold."""
        terms = self.terms(words)
        known = np.flatnonzero(terms < len(self.words))
        lo, hi = np.searchsorted(known, begin), np.searchsorted(known, end)
        window, at = spans(lo, hi)
        held = np.unique(window * len(self.words) + terms[known[at]])  # a window's distinct terms, in rising order
        window, term = held // len(self.words), held % len(self.words)
        none = np.zeros(0, np.int64)
        if not len(held):
            return none, none
        first = np.searchsorted(window, np.arange(len(begin) + 1))
        sums = np.concatenate([[0.0], np.cumsum(self.most[term])])
        upto = sums[1:] - sums[first[window]]
        pivot = upto >= self.least.min() - EPS
        below = np.bincount(window[~pivot], minlength=len(begin))  # terms before the pivot
        rest = sums[first[:-1] + below] - sums[first[:-1]]
        # The lists from the pivot on.
        own = np.flatnonzero(pivot)
        who, at = spans(self.list_first[term[own]], self.list_first[term[own] + 1])
        place = window[own][who] * self.blocks + self.list_at[at] % self.blocks
        order = np.argsort(place, kind="stable")
        place = place[order]
        lead = np.flatnonzero(np.diff(place, prepend=-1))
        if not len(lead):
            return none, none
        bound = np.add.reduceat(self.list_most[at][order], lead)
        w, b = place[lead] // self.blocks, place[lead] % self.blocks
        keep = bound + rest[w] >= self.least_in[b] - EPS
        w, b, bound = w[keep], b[keep], bound[keep]
        # The rest's own maxima in the block.
        who, at = spans(first[w], first[w] + below[w])
        bound = bound + np.bincount(who, looked_up(self.list_at, self.list_most, term[at] * self.blocks + b[who]), len(w))
        keep = bound >= self.least_in[b] - EPS
        w, b = w[keep], b[keep]
        # The items themselves.
        who, item = spans(b * self.block, np.minimum((b + 1) * self.block, len(self.items)))
        w = w[who]
        who, at = spans(self.item_first[item], self.item_first[item + 1])
        score = np.bincount(who, np.where(looked_up(held, None, w[who] * len(self.words) + self.item_term[at]), self.item_share[at], 0.0), len(w))
        keep = score >= self.least[item] - EPS
        return w[keep], item[keep]


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the span, place) for every place of lo[i]:hi[i]."""
    size = hi - lo
    who = np.repeat(np.arange(len(size)), size)
    return who, np.arange(len(who)) + np.repeat(lo - np.cumsum(size) + size, size)


def looked_up(keys: np.ndarray, values: np.ndarray | None, asked: np.ndarray) -> np.ndarray:
    """The values of asked keys in a sorted list, 0 where there is none; without values, whether they are there."""
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    hit = keys[at] == asked
    return hit if values is None else np.where(hit, values[at], 0.0)


class Item:
    """One test item: its words, and its shingles of question, answer and both."""

    def __init__(self, number: int, item_id: int | None, words: np.ndarray, answer: int, shingle: int):
        self.number, self.item_id, self.words = number, item_id, words
        self.k = min(shingle, len(words))
        every = grams(words, self.k)
        cut = max(0, max(self.k, len(words) - answer) - self.k + 1)  # shingles of the question
        self.question, self.answer, self.whole = np.unique(every[:cut]), np.unique(every[cut:]), np.unique(every)

    def share(self, words: np.ndarray, similarity: float) -> float:
        """Share of the shingles in the passage, or 0 if the question or an answer of so many shingles as a word can change isn't there."""
        have = grams(words, self.k)
        share = lambda s: float(np.isin(s, have).mean()) if len(s) else 1.0
        got = share(self.whole)
        return got if got >= similarity and share(self.question) >= similarity and (len(self.answer) < self.k or share(self.answer) >= similarity) else 0.0


def answer_words(text: str) -> int:
    """Words of the last sentence, which stands for the answer; 0 if there is one sentence only."""
    sentences = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
    return len(hashed_words([sentences[-1].encode()])[0]) if len(sentences) > 1 else 0


class Index:
    """The items, by the length of the passages they take."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK):
        self.similarity = similarity
        by: dict[int, list[Item]] = {}
        for number, (item_id, text) in enumerate(items):
            words, _ = hashed_words([text.encode()])
            if len(words):
                by.setdefault(max(STRIDE, 1 << (len(words) - 1).bit_length()), []).append(Item(number, item_id, words, answer_words(text), shingle))
        self.parts = [Part(stride, got, shingle, similarity, block) for stride, got in sorted(by.items())]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int | None, float, int]]:
        """(row, item id, share, first word of the passage): for each text and item the best passage."""
        for a, b in chunks(texts):
            words, firsts = hashed_words(texts[a:b])
            best: dict[tuple[int, int], tuple[float, int, int | None]] = {}
            for part in self.parts:
                row, begin, end = part.windows(firsts)
                for w, i in zip(*(x.tolist() for x in part.candidates(words, begin, end)), strict=True):
                    item = part.items[i]
                    got = item.share(words[begin[w] : end[w]], self.similarity)
                    key = (int(row[w]), item.number)
                    if got and got > best.get(key, (0.0,))[0]:
                        best[key] = (got, int(begin[w] - firsts[row[w]]), item.item_id)
            for (r, _), (share, at, item_id) in sorted(best.items(), key=lambda x: x[0]):
                yield a + r, item_id, share, at


def contaminated(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS, **options) -> DataFrame:
    """(doc_id, item_id, share, first_word) for each document and test item found in it.

    No shuffle of texts: the index goes to the documents, shard by shard; with several shards each pass is written before the next begins.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, share double, first_word long"

    def one_pass(known: list[tuple[int | None, str]]) -> tuple[DataFrame, Broadcast]:
        index = spark.sparkContext.broadcast(Index(known, **options))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op9")
            for batch in batches:
                found = list(index.value.search(byte_rows(batch.column(1))))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))], names=["doc_id", "item_id", "share", "first_word"])

        return texts.mapInArrow(run, schema), index

    scratch, done = Scratch(spark), []
    for known, last in shards_of(items, shard_items):
        found, index = one_pass(known)
        if last and not done:
            return found
        done.append(scratch.table(found, f"pass-{len(done)}"))
        index.unpersist()
    return reduce(DataFrame.unionByName, done)


def shards_of(items: DataFrame, most: int) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items in parts of at most ``most``, each with whether it is the last; at least one part, and one held at a time."""
    held: list[tuple[int | None, str]] = []
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if len(held) >= most:
            yield held, False
            held = []
        held.append((r[0], r[1]))
    yield held, True


def without_items(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS, **options) -> DataFrame:
    """docs that hold none of the items, in one pass for each shard of the benchmark and without a shuffle; all passes but the last are written."""
    spark = prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def clean(df: DataFrame, known: list[tuple[int | None, str]]) -> tuple[DataFrame, Broadcast]:
        index = spark.sparkContext.broadcast(Index(known, **options))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_work("op9")
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in index.value.search(byte_rows(batch.column(names.index("text"))))]] = False
                yield batch.filter(pa.array(keep, pa.bool_()))

        return df.mapInArrow(run, schema), index

    scratch, number = Scratch(spark), 0
    for known, last in shards_of(items, shard_items):
        docs, index = clean(docs, known)
        if not last:
            docs = scratch.table(docs, f"pass-{number}", "zstd")
            scratch.clear(f"pass-{number}")
            index.unpersist()
            number += 1
    return docs
