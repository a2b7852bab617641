"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end its encoding. It is found
by walking the vocabulary entries that end at this position (suffix links of an automaton over the
vocabulary give them, longest first) and taking the one that may follow the last token of the shorter
prefix. The distinct pieces of some texts take each step together, in arrays. Two tokens may stand side by side if undoing their merges, latest first, never meets a merge
across the border that would have been made before. Following the stored tokens back from the end
gives the ids that merging by rank gives.

Cases: null counts as empty text; an empty text has no ids; a special token's text inside a document
becomes its id, as the tokenizers library has it without ``encode_special_tokens``; equal rows give equal rows;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from treeledger.llm.common import at_work, chunks, prepare

#: Fixed by the vocabulary's format: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose pieces are encoded together; a longer text is taken by itself.
CHUNK_CHARS = 1 << 20
#: Pieces whose encoding a worker remembers, and the characters of the longest of them; when there are more all are forgotten.
CACHE_PIECES = 150_000
CACHE_PIECE_CHARS = 64
#: Pieces of more bytes are encoded one by one.
STEPPED_BYTES = 256
#: Places of the table that remembers tests of pairs, as a power of two; 8 MB.
MEMO_BITS = 20
#: Pairs remembered besides within one piece that is encoded by itself.
CACHE_PAIRS = 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_pattern() -> re.Pattern:
    """PIECES for characters below 256, their classes spelled out."""
    letter, number, space = ("".join(map(re.escape, regex.findall(p, "".join(map(chr, range(256)))))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    classes = ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]"))
    pattern = PIECES
    for name, spelled in classes:
        pattern = pattern.replace(name, spelled)
    return re.compile(pattern)


class Automaton:
    """Which tokens end at a place: an automaton over the vocabulary in flat arrays, so that many pieces step through it at once.

    A state is a prefix of a token. Its children stand next to each other in the order of their bytes, so a bit set and a count of the
    bits below give the child. ``out`` holds the longest token that ends in a state, ``shorter`` the next shorter one that ends a token.
    """

    def __init__(self, tokens: dict[bytes, int], size: int):
        words, ids = list(tokens), np.fromiter(tokens.values(), np.int64, len(tokens))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, begin = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
        at, states = np.zeros(len(words), np.int64), 1
        levels = []  # (first state, parents, bytes) of each depth
        for depth in range(int(lengths.max(initial=0))):
            longer = np.flatnonzero(lengths > depth)
            found, place = np.unique(at[longer] << 8 | flat[begin[longer] + depth], return_inverse=True)
            levels.append((states, found >> 8, found & 255))
            at[longer] = states + place
            states += len(found)
        self.edges = np.concatenate([[-1], *(parents << 8 | letters for _, parents, letters in levels)])  # into each state
        self.first = np.zeros(states, np.int32)
        self.bits, self.below = np.zeros((states, 4), np.uint64), np.zeros((states, 4), np.int32)
        for start, parents, letters in levels:
            lead = np.flatnonzero(np.diff(parents, prepend=-1))
            self.first[parents[lead]] = start + lead
            np.bitwise_or.at(self.bits, (parents, letters >> 6), np.uint64(1) << (letters & 63).astype(np.uint64))
        self.below[:, 1:] = np.cumsum(np.bitwise_count(self.bits[:, :3]), 1)
        self.fail, self.out = np.zeros(states, np.int32), np.full(states, -1, np.int32)
        self.out[at] = ids
        for depth, (start, parents, letters) in enumerate(levels):
            own = np.arange(start, start + len(parents))
            if depth:
                self.fail[own] = self.step(self.fail[parents], letters)
            none = own[self.out[own] < 0]
            self.out[none] = self.out[self.fail[none]]
        self.shorter = np.full(size, -1, np.int32)
        self.shorter[ids] = self.out[self.fail[at]]

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The state after one more byte each: the longest suffix that a token begins with."""
        now = np.zeros(len(states), np.int32)
        todo, states, words, shift = np.arange(len(states)), states, letters >> 6, (letters & 63).astype(np.uint64)
        while len(todo):
            bits = self.bits[states, words]
            there = (bits >> shift & np.uint64(1)) != 0
            child = self.first[states] + self.below[states, words] + np.bitwise_count(bits & ((np.uint64(1) << shift) - np.uint64(1)))
            now[todo[there]] = child[there]
            more = ~there & (states > 0)
            todo, words, shift, states = todo[more], words[more], shift[more], self.fail[states[more]]
        return now


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = max(by_id) + 1
        self.bytes_of = [by_id.get(i, b"") for i in range(self.size)]
        self.decimal_of = [str(i) for i in range(self.size)]
        self.length_of = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        #: The tokens that a token was merged from, and the rank of that merge (-1: a single byte).
        self.left_half, self.right_half, self.born = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        pairs = np.zeros(len(spec["model"]["merges"]), np.int64)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            pairs[rank] = a * self.size + b
            if self.born[whole] < 0:
                self.left_half[whole], self.right_half[whole], self.born[whole] = a, b, rank
        self._rank_table(pairs)
        self.automaton = Automaton({b: i for b, i in vocab.items() if len(b) == 1 or self.born[i] >= 0}, self.size)
        self.vocab = vocab
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.any_pieces, self.plain_pieces = regex.compile(PIECES), plain_pattern()
        self._cache: dict[str, bytes] = {}
        self._lists: tuple | None = None
        self._memo = np.full(1 << MEMO_BITS, -1, np.int64)

    def _rank_table(self, pairs: np.ndarray) -> None:
        """A hash table with open places from a pair of tokens to the rank of its merge."""
        self.ranks = len(pairs)
        self.table_bits = max(4, int(4 * max(1, len(pairs))).bit_length())
        self.pair_at, self.rank_at = np.full(1 << self.table_bits, -1, np.int64), np.zeros(1 << self.table_bits, np.int32)
        todo, place = np.arange(len(pairs)), self._place(pairs)
        while len(todo):
            free = self.pair_at[place] < 0
            _, lead = np.unique(np.where(free, place, -1), return_index=True)
            lead = lead[free[lead]]
            self.pair_at[place[lead]], self.rank_at[place[lead]] = pairs[todo[lead]], todo[lead]
            left = np.ones(len(todo), bool)
            left[lead] = False
            todo, place = todo[left], (place[left] + 1) % (1 << self.table_bits)

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges; the number of merges if it never does."""
        pairs = left * self.size + right
        place = self._place(pairs)
        held = self.pair_at[place]
        out = np.where(held == pairs, self.rank_at[place], self.ranks)
        todo = np.flatnonzero((held != pairs) & (held >= 0))
        while len(todo):
            place[todo] = (place[todo] + 1) % (1 << self.table_bits)
            held = self.pair_at[place[todo]]
            hit = held == pairs[todo]
            out[todo[hit]] = self.rank_at[place[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves left and right side by side, for each pair; the last answer at a place of a fixed table is remembered."""
        pairs = left.astype(np.int64) * self.size + right
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        held = self._memo[place]
        out = (held & 1).astype(bool)
        todo = np.flatnonzero(held >> 1 != pairs)
        if len(todo):
            out[todo] = self._undone(left[todo], right[todo])
            self._memo[place[todo]] = pairs[todo] << 1 | out[todo]
        return out

    def _undone(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The test itself.

        Undo the latest merge on either side of the border, again and again: no border pair may have been due earlier.
        A border pair of rank r existed from the time both its tokens were made until one of them was merged on.
        At equal ranks the left of two overlapping places merges first, so the right one is undone first.
        """
        ok = np.ones(len(left), bool)
        todo = np.arange(len(left))
        left, right = left.astype(np.int64), right.astype(np.int64)
        until_left, until_right = np.full(len(left), self.ranks, np.int64), np.full(len(left), self.ranks, np.int64)  # rank at which the token at the border was merged on
        while len(todo):
            rank = self.rank_of(left, right)
            due = (rank < self.ranks) & (rank <= until_right) & (rank < until_left)
            ok[todo[due]] = False
            born_left, born_right = self.born[left], self.born[right]
            go = ~due & ((born_left >= 0) | (born_right >= 0))
            todo, left, right, born_left, born_right, until_left, until_right = (x[go] for x in (todo, left, right, born_left, born_right, until_left, until_right))
            later = born_left > born_right
            until_left, until_right = np.where(later, born_left, until_left), np.where(later, until_right, born_right)
            left, right = np.where(later, self.right_half[left], left), np.where(later, right, self.left_half[right])
        return ok

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian int32. All pieces go on byte by byte together, the longest first."""
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > STEPPED_BYTES).tolist():
            out[i] = self._encode_long(pieces[i])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= STEPPED_BYTES]
        if not len(order):
            return out
        data, lengths = np.frombuffer(b"".join(pieces), np.uint8), sizes[order]
        begin = (np.cumsum(sizes) - sizes)[order]
        last = np.zeros(len(data), np.int32)  # the last token of the prefix that ends with each byte
        states = np.zeros(len(order), np.int32)
        for t in range(int(lengths[0])):
            active = int(np.searchsorted(-lengths, -t, side="left"))  # pieces of more than t bytes
            at = begin[:active] + t
            states = self.automaton.step(states[:active], data[at].astype(np.int64))
            token, todo = self.automaton.out[states], np.arange(active)
            while len(todo):
                before = t + 1 - self.length_of[token]
                ok = before == 0
                asked = np.flatnonzero(~ok)
                ok[asked] = self.fits(last[begin[todo[asked]] + before[asked] - 1], token[asked])
                last[at[todo[ok]]] = token[ok]
                todo, token = todo[~ok], self.automaton.shorter[token[~ok]]
        # Follow the stored tokens back from the ends.
        count, place = np.zeros(len(order), np.int64), lengths.copy()
        steps, todo = [], np.arange(len(order))
        while len(todo):
            token = last[begin[todo] + place[todo] - 1]
            steps.append((todo, token))
            count[todo] += 1
            place[todo] -= self.length_of[token]
            todo = todo[place[todo] > 0]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]), "<i4")
        for k, (who, token) in enumerate(steps):
            ids[ends[who] - 1 - k] = token
        flat = ids.tobytes()
        for i, a, b in zip(order.tolist(), (4 * (ends - count)).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = flat[a:b]
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        """One piece by itself, byte by byte."""
        if not self._lists:
            a = self.automaton
            self._lists = (dict(zip(a.edges.tolist(), range(len(a.edges)), strict=True)), a.fail.tolist(), a.out.tolist(), a.shorter.tolist())
        child, fail, out, shorter = self._lists
        last, state, known = [-1] * (len(piece) + 1), 0, {}
        for end, letter in enumerate(piece, 1):
            while (to := child.get(state << 8 | letter)) is None and state:
                state = fail[state]
            state = to or 0
            token = out[state]
            while (before := last[end - len(self.bytes_of[token])]) >= 0:
                ok = known.get((before, token))
                if ok is None:
                    if len(known) >= CACHE_PAIRS:
                        known.clear()
                    ok = known[before, token] = bool(self.fits(np.array([before]), np.array([token]))[0])
                if ok:
                    break
                token = shorter[token]
            last[end] = token
        ids, n = [], len(piece)
        while n > 0:
            ids.append(last[n])
            n -= len(self.bytes_of[last[n]])
        return np.array(ids[::-1], "<i4").tobytes()

    def pieces(self, span: str) -> list[str]:
        """The span cut into pieces; with characters below 256 only by a pattern that spells out the classes, which is faster."""
        try:
            span.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces.findall(span)
        return self.plain_pieces.findall(span)

    def spans(self, text: str) -> list[str]:
        """The text cut at special tokens, which have the odd places."""
        return self.special_re.split(text) if self.special_re and any(s in text for s in self.special) else [text]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. The distinct pieces of some texts that aren't remembered are encoded together."""
        for a, b in chunks(texts, CHUNK_CHARS):
            cut = [[[span] if k % 2 else self.pieces(span) for k, span in enumerate(self.spans(t))] for t in texts[a:b]]
            met = set().union(*(pieces for spans in cut for pieces in spans[::2]))
            if len(self._cache) + len(met) > CACHE_PIECES:
                self._cache = {}
            cache = self._cache
            new = [p for p in met if p not in cache]
            cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
            for spans in cut:
                parts = [struct.pack("<i", self.special[pieces[0]]) if k % 2 else b"".join(map(cache.__getitem__, pieces)) for k, pieces in enumerate(spans)]
                yield np.frombuffer(b"".join(parts), "<i4")
            for p in new:
                if len(p) > CACHE_PIECE_CHARS:
                    del cache[p]

    def decimals(self, ids: list[int]) -> bytes:
        """The ids as decimal numbers, joined by commas."""
        return ",".join(map(self.decimal_of.__getitem__, ids)).encode()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for, special tokens too."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary(path: str | None) -> str:
    """The named file, or the public byte-level vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, digests: bool = False, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, ids array<int> (unless with_ids is false), n_tokens and, if asked for, the digests of ids and decoded text.

    No shuffle: a document is encoded where it is read, so one very common source or text harms nothing.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op10", _CODECS.clear)
        c = codec(vocabulary(path))
        for batch in batches:
            ids, offsets, n, a, b = [], [0], [], [], []
            for found in c.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(found))
                if with_ids:
                    ids.append(found)
                    offsets.append(offsets[-1] + len(found))
                if digests:
                    listed = found.tolist()
                    a.append(hashlib.sha256(c.decimals(listed)).hexdigest())
                    b.append(hashlib.sha256(c.decode(listed)).hexdigest())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
            if digests:
                out |= {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
