"""Fuzzy search for short licence notices.

A notice of m characters that stands in a text with at most k edits keeps at least one of k + 1 pieces
unharmed (pigeonhole), so exact hits of the pieces, found by one automaton for all notices, lead to every
place worth looking at. There the regex library's bounded-error matching decides, and gives span and edits.
Texts are compared as their words with one space between.

Cases: null counts as empty text (no words, no labels, score 0); equal rows give equal rows; an empty table
gives an empty table; other columns are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from treeledger.llm.common import byte_rows, byte_table, prepare

#: Fixed by the contract: phrase as words, label.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

#: Short notices by label; their words are searched.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("notice-reserved", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: Everything in ASCII but digits and letters separates words.
_TABLE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SPACED = bytes(x or 32 for x in _TABLE.tolist())


class Notices:
    """The searcher for one set of notices."""

    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        self.notices = [(label, text, max(1, len(text) // chars_per_edit)) for label, text in notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={k}}}") for _, text, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.notices):
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the stretches of text that can hold it, none longer than the notice and its edits on either side."""
        found: dict[int, set[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            start = end + 1 - length
            for n, at in places:
                _, notice, k = self.notices[n]
                found.setdefault(n, set()).add((max(0, start - at - k), start - at + len(notice) + k))
        return {n: sorted(w) for n, w in found.items()}

    def search(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in text, which must be words joined by single spaces."""
        out = []
        for n, windows in self.windows(text).items():
            label, notice, k = self.notices[n]
            done = 0
            for a, b in windows:
                a = max(a, done)
                if b - a >= len(notice) - k and (m := self.patterns[n].search(text, a, b)):
                    out.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    done = m.end()
        kept: list[tuple[int, int, str, int]] = []  # by start, never overlapping
        for label, start, end, edits in sorted(out, key=lambda x: (x[3], x[1] - x[2], x)):  # of notices at one place the closest stays
            at = bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, label, edits))
        return [(label, start, end, edits) for start, end, label, edits in kept]


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers where phrase starts; words is a text's words with a space before, between and after each."""
    out, needle = [], b" " + phrase + b" "
    at, seen, count = words.find(needle), 0, 0
    while at >= 0:
        count += words.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = words.find(needle, at + 1)
    return out


def scan(text: bytes, notices: Notices) -> tuple:
    """(n_words, n_base, first, last, base labels, all labels, score, spans of notices)."""
    words = text.translate(_SPACED).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" ".join(words)
    base, hits = set(), []
    if b"by" in joined or b"general" in joined or b"reserved" in joined:
        padded = b" " + joined + b" "
        for phrase, label in BASE:
            if got := places(padded, phrase):
                base.add(label)
                hits += got
    spans = notices.search(joined.decode("utf-8", "surrogatepass"))
    sure = max([float(bool(base)), *(1 - edits / (end - start + 1) for _, start, end, edits in spans)])
    labels = base | {s[0] for s in spans}
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), sure, spans


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, end: long, edits: long>>"
)


def licenses(docs: DataFrame, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per document the phrases and notices found; spans count characters of the words joined by spaces.

    One pass, no shuffle: a row is judged where it is read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices, chars_per_edit)
        names = [f.split()[0] for f in SCHEMA.split(", spans")[0].split(", ")][1:]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
        for batch in batches:
            rows = [scan(text, known) for text in byte_rows(batch.column(1))]
            out = {"doc_id": batch.column(0)}
            out |= {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))}
            out["spans"] = pa.array([[dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in r[7]] for r in rows], spans)
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
