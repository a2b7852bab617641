"""Licences, language, personal data, encoding, shards and quality against plain versions, odd rows included."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("node", "score", "n_words", "spans", "label", "tile", "shard", "slot", "component_id", "ids", "at", "pos", "host")


def odd_docs(spark):
    """Null and empty texts, repeated rows, a long text, null metadata, columns with names that operators use."""
    texts = [None, "", "   ", "Hallo Welt und der die das", "Hallo Welt und der die das", "the cat and the dog of the house", "x" * 200_000, "a " * 60_000, "\x00 nul \x00", "日本語 テキスト", "🙂 emoji"]
    rows = [(i, t, None if i % 4 == 3 else ("de" if t and "der" in t else "en"), None if i % 5 == 4 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        df = df.withColumn(c, df["lang"])
    return df


def fails_nowhere(spark, run):
    """run over odd rows and over no rows."""
    docs = odd_docs(spark)
    rows = run(docs).collect()
    assert run(docs.limit(0)).collect() == []
    return docs.collect(), rows


def test_licences(spark):
    from treeledger.llm.op1_license import Notices, licenses, scan

    known = Notices()
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def brute(s):
        w = words.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s))
        hits, labels = [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    hits.append(i)
                    labels.add(label)
        return len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))

    rng = random.Random(1)
    pool = ["cc", "CC", "by", "by-nc", "general", "public", "License", "All", "rights", "RESERVED", "é", "\n", "_"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["cc by cc by", "\x7f", "CC-BY", "cc\x00by"]
    assert all(scan(t.encode(), known)[:5] == brute(t) for t in texts)
    got = scan(b"foo Licensed undr the Apache Licence, Version 2.0 bar", known)
    assert got[5] == "apache-2.0" and got[7] == [("apache-2.0", 4, 48, 2)] and 0.9 < got[6] < 1
    assert scan(b"licensed under cc by nc 4 0", known)[5] == "cc-by,cc-by-nc-4.0"
    docs, rows = fails_nowhere(spark, licenses)
    assert len(rows) == len(docs) and {r.score for r in rows} == {0.0}


def test_seeds_miss_no_notice():
    from treeledger.llm.op1_license import Notices

    known = Notices()
    rng = random.Random(2)
    for label, notice, k in known.notices:
        for _ in range(20):
            t = list(notice)
            for _ in range(k):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], [t[at], "q"], ["q"]])
            text = "one two " + "".join(t) + " three"
            every = [(name, list(p.finditer(text))) for (name, _, _), p in zip(known.notices, known.patterns, strict=True)]  # the library over the whole text
            got = known.search(text)
            for name, matches in every:
                for m in matches:
                    near = [x for x in got if x[1] < m.end() and m.start() < x[2]]
                    assert any(x[0] == name or x[3] <= sum(m.fuzzy_counts) for x in near), (name, text)
            for name, a, b, edits in got:
                assert any(n == name and edits <= most and distance(text[a:b], whole) <= edits for n, whole, most in known.notices), (name, text)


def distance(a, b):
    """Edits between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_language(spark):
    from treeledger.llm.op5_language import BUCKETS, SCRIPT_NAMES, Model, Words, in_known_languages, languages

    rng = random.Random(3)
    vocab = {"de": ["der", "und", "schön", "über", "nicht", "haus"], "en": ["the", "and", "house", "with", "not", "thing"], "ru": ["дом", "это", "мир", "привет"]}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(i, text(k, 30), k, "s", 1) for i, k in enumerate(["de", "en", "ru"] * 60)]
    got = {r.doc_id: r for r in languages(spark.createDataFrame(rows, DOCS)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[r[0]].held_out == (r in held) for r in rows)
    assert all(got[r[0]].lang_pred == r[2] for r in held)
    counts = {k: np.bincount(Words([text(k, 500)]).buckets, minlength=BUCKETS) for k in vocab}
    scripts = {k: np.bincount((w := Words([text(k, 500)])).script, w.sizes, len(SCRIPT_NAMES)) for k in vocab}
    model = Model(counts, scripts)
    a, b = text("de", 40), text("en", 40)
    assert [s[2] for s in next(model.label([f"{a} {b}"]))[2]] == ["de", "en"]
    docs, out = fails_nowhere(spark, languages)
    assert len(out) == len(docs) and all(r.lang_pred == "und" for d, r in zip(docs, out, strict=True) if not d.text or not any(c.isalpha() for c in d.text))
    kept = in_known_languages(odd_docs(spark)).collect()
    assert all(r.text and r.lang for r in kept)


def test_paths_are_the_best_sequences():
    from treeledger.llm.op5_language import Model

    model = Model({k: np.ones(4) for k in "abc"}, {k: np.ones(1) for k in "abc"})

    def brute(s, penalty):
        value, back = s[0].astype(float).copy(), []
        for t in range(1, len(s)):
            best = int(value.argmax())
            stay = [value[k] >= value[best] - penalty for k in range(3)]
            back.append([k if stay[k] else best for k in range(3)])
            value = np.array([value[k] if stay[k] else value[best] - penalty for k in range(3)]) + s[t]
        out = [int(value.argmax())]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    rng = np.random.default_rng(0)
    for _ in range(100):
        n = rng.integers(0, 9, 6)
        first = np.concatenate([[0], n.cumsum()])
        s = rng.integers(-5, 5, (first[-1], 3)).astype(np.float32)
        got = model.paths(s, first, 3.0).tolist()
        for a, b in zip(first, first[1:], strict=False):
            assert b == a or got[a:b] == brute(s[a:b], 3.0)


def test_personal_data(spark):
    from treeledger.llm.op6_pii import KINDS, base_candidates, joined, luhn, personal, redact, without_personal

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    digits = lambda s: re.sub("[^0-9]", "", s)

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        return sorted(out)

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab@@..-+%1234 5()é\n") for _ in range(60)) for _ in range(3000)]
    texts += [".".join(str(rng.randint(0, 300)) for _ in range(9)) for _ in range(200)] + ["call +1 (682) 555-5413, card 4111 1111 1111 1111."]
    assert all(sorted((a, k, b) for k, a, b, ok in base_candidates(t) if ok) == brute(t) for t in texts)
    assert redact(texts[-1], brute(texts[-1])) == "call <PHONE>, card <CARD>."
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts[:200] + texts[-1:])]
    rows += [(1000 + i, f'word token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and {4000 + i}99911112222 end', "en", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in personal(df, digests=True).collect()}
    for i, t, *_ in rows[:201]:
        base = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and got[i].n_ip == sum(k == 1 for _, k, _ in base)
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(filter(None, got[i].spans.split(",")))
    assert sum("token:" in got[1000 + i].spans for i in range(300)) > 250
    docs, out = fails_nowhere(spark, lambda d: personal(d, digests=True))
    assert len(out) == len(docs)
    clean = without_personal(odd_docs(spark)).collect()
    assert [r.text for r in clean] == [d.text for d in docs]


def test_generators_propose_whole_spans():
    from treeledger.llm.op6_pii import KINDS, label, more_candidates

    long = "".join(random.Random(3).choice("abcdefXYZ0123456789") for _ in range(240))
    cases = [
        ("token", "token = {}", long), ("token", "see {} there", "AbCdEfGhIjKlMnOpQrStUvWxYz"), ("key", "id {} end", "A1" * 30),
        ("iban", "pay to {} now", "DE89 3704 0044 0532 0130 00"), ("iban", "pay to {} TODAY", "GB29 NWBK 6016 1331 9268 19"), ("iban", "{}", "NO93 8601 1117 947"), ("iban", "to {}.", "DE89370400440532013000"),
        ("iban", "{} THE SUM", "ES91 2100 0418 4502 0005 1332"), ("iban", "{} ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1332"),
        ("secret", "password: {}", "hunter2"), ("secret", "my password is {}.", "Tr0ub4dor&3"), ("secret", 'DB_PASSWORD="{}"', "correcthorse"), ("secret", "secret key: {}", "abcd"), ("secret", "Bearer {}", "abcDEF"),
    ]
    for kind, around, span in cases:
        text = around.format(span)
        k, a = KINDS.index(kind), text.index(span)
        assert (k, a, a + len(span)) in more_candidates(text), text
        if kind in ("iban", "secret"):
            assert label(text, k, a, a + len(span), None), text
    assert not label("DE88 3704 0044 0532 0130 00", KINDS.index("iban"), 0, 27, None)
    assert not label("the key is here", KINDS.index("secret"), 11, 15, None)


def test_signs_hold_back_no_candidate():
    """Patterns that are only tried on texts with certain signs find what they find in every text."""
    from treeledger.llm.op6_pii import _MORE, _SECRET, ibans, more_candidates

    rng = random.Random(28)
    parts = ["pass", "word", "tok", "en", " : ", "= ", "key", "p\u0131n ", "\u017fecret ", "AA:bb:", "12", "@", "a(at)b(dot)c", "x [AT] y [DOT] z", "DE89 3704 0044 0532 0130 00", " ", "\n", "x" * 30, "-", "555-123-4567", "\u212a", "ey=abc1", "078-05-1120"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [(k, *m.span()) for k, p in _MORE for m in p.finditer(text)] + [(6, a, b) for a, b in ibans(text)]
        values = [(m.start(1), m[1].rstrip(".:!?)]")) for m in _SECRET.finditer(text)]
        assert sorted(more_candidates(text)) == sorted(want + [(11, a, a + len(v)) for a, v in values if v]), text


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from treeledger.llm.op10_bpe import codec, encode, vocabulary

    path = vocabulary(None)
    theirs, ours = tokenizers.Tokenizer.from_file(path), codec(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd  \n\t\r'sé🙂日本<|endoftext|>0123!?$*&") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "", "a" * 5000, " " * 3000, "$$$ *** $$$$", "ab" * 999, "don't we'll", "\x85 x"]
    texts += ["".join(map(chr, rng.choices(range(256), k=80))) for _ in range(500)] + ["".join(rng.choices("abcxyz01", k=n)) for n in (255, 256, 257, 4000)]
    for t, ids, want in zip(texts, ours.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ids.tolist()
        assert ids == want.ids and ours.decimals(ids).decode() == ",".join(map(str, want.ids))
        assert ours.decode(ids).decode() == theirs.decode(want.ids, skip_special_tokens=False) == t
    docs, rows = fails_nowhere(spark, lambda d: encode(d, digests=True))
    for d, r in zip(docs, rows, strict=True):
        want = theirs.encode(d.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_hilbert_curve_steps_by_one():
    from itertools import product

    from treeledger.llm.op8_hilbert import hilbert

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=dims)))
        at = hilbert(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1).max() == 1


def test_shards(spark):
    from treeledger.llm.op8_hilbert import shards

    rows = [(i, "hot" if i % 3 == 0 else f"text {i} é", "en", f"s{i % 7}", 1) for i in range(500)]
    out = shards(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and {r.law for r in out} == {"rows"}
    text = {r[0]: r[1].encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in out)
    assert shards(spark.createDataFrame(rows, DOCS)).select("doc_id", "shard", "slot").collect() and {(r.doc_id, r.shard, r.slot) for r in out} == {tuple(r) for r in shards(spark.createDataFrame(rows, DOCS)).select("doc_id", "shard", "slot").collect()}
    docs, odd = fails_nowhere(spark, shards)
    assert len(odd) == len(docs) and min(r.size for r in odd) == 8


def test_shards_by_brute_force(spark):
    """The order and the cuts worked out row by row, with many values, nulls, ties and repeated rows."""
    import math

    from treeledger.llm.op8_hilbert import hilbert, shards

    rng = random.Random(23)
    rows = []
    for i in range(700):
        text = None if i % 50 == 0 else "x" * rng.choice([0, 1, 3, 17, 90, 400, 5000]) + "é" * (i % 5)
        rows.append((rng.choice([None, *range(300)]), text, rng.choice([None, "de", "en", "fr", "ö"]), rng.choice([None, "hot", "hot", f"s{rng.randrange(90)}"]), 1))
    rows += rows[:40]

    def codes(values):
        known = sorted((v for v in values if v is not None), key=lambda v: v.encode())
        return {None: 0} | {v: 1 + min(62, known.index(v) * 63 // len(known)) for v in set(known)}

    source, lang = codes([r[3] for r in rows]), codes([r[2] for r in rows])
    want = []
    for doc_id, text, la, so, _ in rows:
        data = (text or "").encode()
        point = [min(63, math.floor(math.log2((len(data) + 8) / 8) * 4)), source[so], lang[la]]
        want.append((int(hilbert(np.array([point]), 6)[0]), zlib.crc32(data), -1 if doc_id is None else doc_id, len(data) + 8))
    want.sort()
    whole, more = divmod(len(want), 24)
    place = [(k, i) for k in range(24) for i in range(whole + (k < more))]
    got = sorted((r.shard, r.slot, r.curve, r.text_crc32, -1 if r.doc_id is None else r.doc_id, r["size"]) for r in shards(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(*p, *w) for p, w in zip(place, want, strict=True)]


def test_languages_of_dirty_labels(spark):
    """Of more labels than the model may hold, those of most documents are learned; a table without lang is filtered all the same."""
    from treeledger.llm.op5_language import fit, in_known_languages

    rng = random.Random(24)
    vocab = {"de": ["der", "und", "schön"], "en": ["the", "and", "house"]}
    text = lambda k: " ".join(rng.choice(vocab[k]) for _ in range(20))
    rows = [(i, text(k), k, "s", 1) for i, k in enumerate(["de", "en"] * 40)] + [(100 + i, text("en"), f"dirty {i}", "s", 1) for i in range(30)]
    model = fit(spark.createDataFrame(rows, DOCS), most_languages=2)
    assert model.langs == ["de", "en"]
    kept = in_known_languages(spark.createDataFrame(rows + [(500, "12 34", "en", "s", 1)], DOCS).drop("lang"), model)
    assert kept.columns == ["doc_id", "text", "source", "n_chars"] and kept.count() == len(rows)


def test_metadata_teaches_text():
    """Few labels, metadata that tells all: pseudo-labels of the metadata view make the text view better than its own labels can."""
    from treeledger.llm.op4_quality import CoTrained

    rng = np.random.default_rng(25)

    def draw(n):
        y = rng.integers(0, 2, n).astype(float)
        text = rng.normal(size=(n, 40)) + np.outer(y - 0.5, np.linspace(0.1, 0.9, 40))
        return text, np.c_[y + rng.normal(size=n) * 0.05, rng.normal(size=n)], y

    text, meta, y = draw(60)
    pool_text, pool_meta, _ = draw(2000)
    test_text, test_meta, test_y = draw(3000)
    right = {}
    for rounds in (0, 3):
        model = CoTrained(text, meta, y, pool_text, pool_meta, rounds)
        right[rounds] = float(((model.score(test_text, test_meta)[0] > 0.5) == test_y).mean())
        assert rounds == 0 or model.handed[0] > 100
    assert right[3] > right[0] + 0.02, right


def test_contradicting_labels_are_averaged(spark):
    from treeledger.llm.op4_quality import quality

    rng = random.Random(26)
    rows = [(i, " ".join(rng.choice(["good", "fine", "words"] if i % 2 else ["xx", "yy", "||"]) for _ in range(20)), "en", "s", 1) for i in range(200)]
    labels = [(i, i % 2) for i in range(200) for _ in range(3)] + [(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None), (999, 1)]
    out = quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 200 and all(r.keep == bool(r.doc_id % 2) for r in out)


def test_quality(spark):
    from treeledger.llm.op4_quality import CoTrained, fit, quality

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    y = [int(rng.random() < 0.7) for _ in range(900)]
    rows = [(i, good() if q else junk(), "en", "good" if q and i % 2 else "any", 300) for i, q in enumerate(y)]
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, q, 0) for i, q in enumerate(y) if i < 500], "doc_id long, quality int, toxic int")
    model = fit(df, labels, sample=400, pool=300)
    assert sum(model.handed) > 0
    got = {r.doc_id: r for r in quality(df, labels, model).collect()}
    assert np.mean([got[i].keep == bool(q) for i, q in enumerate(y) if i >= 500]) > 0.97
    none = CoTrained(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)))
    assert none.score(np.zeros((2, 1)), np.zeros((2, 1)))[2].tolist() == [0.5, 0.5]
    docs, out = fails_nowhere(spark, lambda d: quality(d, labels))
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
