"""Near copies, neighbours, decontamination, extraction and the pipeline against plain versions."""

import random
import re
from collections import Counter

import numpy as np

from tests.llm.test_text_operators import DOCS, fails_nowhere, odd_docs

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_rows(rng, n=220):
    """Bases of many lengths with exact and edited copies, chains, common passages and two-word texts."""
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choice(words) for _ in range(25))
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 5, 12, 22, 40, 90, 300]))]
        if rng.random() < 0.3:
            base = base[:15] + common.split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    ids = rng.sample(range(10 * n), len(texts))
    return list(zip(ids, texts, strict=True))


def test_jaccard_join(spark):
    from treeledger.llm.op7_jaccard import near, one_of_each

    rows = near_rows(random.Random(7))
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near(df).collect()} == want
    assert {r.doc_id for r in one_of_each(df).collect()} == {d for d, (_, c) in want.items() if d == c}
    docs, out = fails_nowhere(spark, near)
    assert len(out) == len(docs)
    got = {r.doc_id: r for r in out}
    assert got[0].n_shingles == 0 and got[0].component_id == 0 and got[4].component_id == 3
    kept = one_of_each(odd_docs(spark)).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None).most_common(1)[0][1] == 1 and 4 not in {r.doc_id for r in kept}


def test_tiles_lose_no_link():
    from treeledger.llm.op7_jaccard import bitmap, fold, linked, tiles_of

    rng = np.random.default_rng(8)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 40, 57, 100, 333, 1000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.integers(0, max(1, size // 7) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, size // 9) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            for least in (80, 90):
                if len(b) and 100 * both >= least * (len(a) + len(b) - both):
                    assert linked(a, b, least, 100) and set(tiles_of(a, least, 100)) & set(tiles_of(b, least, 100))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = bitmap(a), bitmap(b)
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())
                assert apart <= len(a) + len(b) - 2 * both


def test_near_copies_stage_by_brute_force(spark):
    """The pipeline's stage keeps one document of each component at similarity 0.8 over five-word shingles."""
    import corpus_pipeline

    rows = near_rows(random.Random(15))
    sets, label = [], list(range(len(rows)))
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert any(100 * len(x & y) < 90 * len(x | y) for x, y in ((shingles(rows[i][1]), shingles(rows[j][1])) for i, j in linked))
    for i, j in linked:
        old, new = label[i], label[j]
        label = [new if x == old else x for x in label]
    want = {min(d for (d, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == want


def test_components_of_long_chains(spark):
    """Chains of thousands of nodes with random ids: one label each, the smallest node."""
    from treeledger.llm.common import Scratch
    from treeledger.llm.components import components

    rng = random.Random(14)
    nodes = rng.sample(range(-(10**9), 10**9), 3200)
    chains = [nodes[:3000], nodes[3000:]]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for c in chains for a, b in zip(c, c[1:], strict=False)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: min(c) for c in chains for x in c}


def test_neighbours(spark):
    from treeledger.llm.op3_hnsw import cosines, nearest

    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[::3] = v[0]  # a third of the rows share a vector
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0, None] + [0.0] * 14, 0), (5200, [], 0), (5250, [1.0, 2.0], 0), (5251, [2.0, 4.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("shard", __import__("pyspark").sql.functions.lit("x"))
    got = {}
    for r in nearest(df, shard_points=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50)) | {5250}
    assert got[5250] == [(1, 5251, 1.0)] or abs(got[5250][0][2] - 1) < 1e-12
    hits = 0
    for q in range(0, 1500, 50):
        s = cosines(v, v[q])
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5].tolist()
        have = sorted(got[q])
        hits += len({h[1] for h in have} & set(want))
        assert [h[0] for h in have] == [1, 2, 3, 4, 5] and all(abs(h[2] - s[h[1]]) < 1e-12 for h in have)
        if q % 3 == 0:
            assert [h[1] for h in have] == want
    assert hits >= 0.9 * 5 * 30
    assert nearest(df.limit(0)).collect() == []


def test_neighbours_with_ties_and_repeated_ids(spark):
    """Equal scores of unequal vectors go to the smaller id; an id that comes again is asked for and answered once."""
    from treeledger.llm.op3_hnsw import nearest

    rows = [(0, [1.0, 0.0]), (9, [0.0, 2.0]), (3, [0.0, -1.0]), (7, [0.0, 1.0]), (5, [3.0, 0.0]), (5, [0.0, 5.0]), (100, [1.0, 1.0]), (100, [-1.0, 0.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, shard_points=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(got[0]) == [(1, 5, 1.0), (2, 100, 0.707107), (3, 3, 0.0), (4, 7, 0.0), (5, 9, 0.0)]
    assert [x[:2] for x in sorted(got[100])] == [(1, 0), (2, 5), (3, 7), (4, 9), (5, 3)] and set(got) == {0, 100}


def test_decontamination(spark):
    from treeledger.llm.op9_decontaminate import contaminated, without_items

    rng = random.Random(10)
    words = [f"w{k}" for k in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, sentence(rng.randint(10, 25)) + " " + sentence(8)) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, items0 := "Same text here for two items. And its answer is this one.") , (94, items0)]
    docs, want = [], set()
    for d in range(150):
        text = [sentence(rng.randint(3, 200)) for _ in range(3)]
        if d % 3 == 0:
            item = items[rng.randrange(40)]
            text.insert(rng.randrange(4), item[1].upper() if d % 2 else item[1])
            want.add((d, item[0]))
        if d % 50 == 7:
            text.append(items[rng.randrange(40)][1].split(".")[0])  # the question only
        docs.append((d, "\n".join(text), "en", "s", 1))
    docs.append((200, f"Before. {items0} After", "en", "s", 1))
    want |= {(200, 93), (200, 94)}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in contaminated(df, bench, shard_items=7).collect()} == want
    assert {r.doc_id for r in without_items(df, bench, shard_items=20).collect()} == {d[0] for d in docs} - {d for d, _ in want}
    assert contaminated(df, bench.limit(0)).collect() == [] and without_items(df, bench.limit(0)).count() == len(docs)
    rows, out = fails_nowhere(spark, lambda d: contaminated(d, bench))
    assert out == []


def test_retrieval_loses_nothing_that_verification_accepts():
    """Items of common and a few dear words, copied with edits, the dear words first: found is exactly what counting shingles of every passage finds."""
    from treeledger.llm.op9_decontaminate import STRIDE, Index, answer_words

    rng = random.Random(19)
    common, rare = [f"c{k}" for k in range(25)], [f"r{k}" for k in range(4000)]
    items = []
    for i in range(80):
        n = rng.choice([3, 8, 20, 25, 33, 40, 64, 70])
        words = [rng.choice(common) for _ in range(n)]
        for _ in range(rng.choice([0, 2, 4])):
            words[rng.randrange(n) if i % 2 else n - 1 - rng.randrange(min(n, 5))] = rng.choice(rare)
        cut = rng.choice([x for x in (0, 3, 9) if x < n])
        items.append((i, " ".join(words[: n - cut]).capitalize() + (". " + " ".join(words[n - cut :]) if cut else "") + "."))
    texts = []
    for i in range(160):
        words = items[rng.randrange(80)][1].replace(".", " ").lower().split()
        dear = [k for k, w in enumerate(words) if w[0] == "r"] or [0]
        for _ in range(rng.choice([0, 1, 2, 4])):
            at = rng.choice(dear) if rng.random() < 0.7 or not words else rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]]) if at < len(words) else []
            dear = [min(k, max(0, len(words) - 1)) for k in dear]
        texts.append(" ".join([*rng.choices(common, k=rng.randrange(200)), *words, *rng.choices(common, k=rng.randrange(90))]))
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    want = set()
    for i, item in items:
        w = item.replace(".", " ").lower().split()
        k, stride = min(5, len(w)), max(STRIDE, 1 << (len(w) - 1).bit_length())
        every, cut = grams(w, k), max(0, max(k, len(w) - answer_words(item)) - k + 1)
        for t, text in enumerate(texts):
            words = text.split()
            for at in range(0, max(1, len(words) - stride), stride):
                have = set(grams(words[at : at + 2 * stride], k))
                share = lambda s: len(set(s) & have) / len(set(s)) if s else 1.0  # noqa: E731, B023
                if share(every) >= 0.8 and share(every[:cut]) >= 0.8 and (len(set(every[cut:])) < k or share(every[cut:]) >= 0.8):
                    want.add((t, i))
    assert len(want) > 60
    encoded = [t.encode() for t in texts]
    assert {(t, i) for t, i, _, _ in Index(items).search(encoded)} == want
    parts = [Index(items[a : a + 13]) for a in range(0, 80, 13)]  # whatever the shards
    assert {(t, i) for x in parts for t, i, _, _ in x.search(encoded)} == want


def test_most_lost_by_brute_force():
    from itertools import product

    from treeledger.llm.op9_decontaminate import most_lost

    rng = np.random.default_rng(20)
    for _ in range(150):
        n = int(rng.integers(1, 5))
        shares, missing = rng.random(int(rng.integers(n, 9))), int(rng.integers(0, 6))
        runs = range(len(shares) - n + 1)
        best = max(sum(s for s, x in zip(shares, lost, strict=True) if x) for lost in product([0, 1], repeat=len(shares)) if sum(any(lost[r : r + n]) for r in runs) <= missing)
        assert abs(most_lost(shares, n, missing) - best) < 1e-9


def test_index_of_many_items_stays_small():
    """What is broadcast grows with the items only, 4 KB each at most, and whole items are found."""
    import pickle

    from treeledger.llm.op9_decontaminate import Index

    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.6)) % 60000}" for _ in range(200_000)]
    items = [(i, " ".join(rng.choices(words, k=40)) + ".") for i in range(2_000)]
    index = Index(items)
    assert len(pickle.dumps(index)) < 2_000 << 12
    texts = [" ".join([*rng.choices(words, k=300), items[i][1], *rng.choices(words, k=300)]).encode() for i in range(0, 400, 4)]
    assert {(t, i) for t, i, _, _ in index.search(texts)} >= {(t, 4 * t) for t in range(100)}


def test_short_answers_hide_no_copy():
    from treeledger.llm.op9_decontaminate import Index

    question = " ".join(f"word{chr(97 + k)}" for k in range(25)) + "?"
    around = "Before it all. {} And then some more."
    for answer in ("Paris.", "In Paris.", "It is in Paris."):
        found = Index([(1, f"{question} {answer}")])
        for changed in (answer, answer.replace("Paris", "Rome"), answer[: -len("Paris.")]):
            assert [i for _, i, _, _ in found.search([around.format(f"{question} {changed}").encode()])] == [1], (answer, changed)
    found = Index([(1, f"{question} The answer to this one has many words of its own.")])
    assert list(found.search([around.format(question).encode()])) == []


def test_extraction(spark):
    from treeledger.llm.op2_extract import extract

    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    pages, want = [], {}
    for i in range(120):
        host = "big.example" if i % 3 else f"h{i}.example"
        paragraphs = [line(rng.randint(5, 40)) + " &amp; x" for _ in range(4)]
        body = "".join(f"<p>{p}</p>" if k else f"<p><b>{p}<br>" for k, p in enumerate(paragraphs))
        plain = i % 2
        inner = f'<div class="x1"><h1>T{i}</h1>{body}</div>' if plain else f"<article><h1>T{i}</h1>{body}</article>"
        html = f"<!DOCTYPE html><html><head><title>{line(3)}</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body><nav><ul><li><a href='/a'>{line(1)}</a></ul></nav><!-- <p>no</p> --><div class=\"ad\">{line(6)}</div><div id='cookie-notice'>We use cookies</div>{inner}<aside>{line(5)}</aside><form><p>{line(2)}</p></form><section class='comments'><p>{line(9)}</p></section><footer>&copy; {host}</footer>" + ("</body></html>" if i % 5 else "")
        pages.append((i, f"https://{host}/{i}?q", html))
        want[i] = "\n".join([f"T{i}", *(p.replace("&amp;", "&") for p in paragraphs)])
    pages += [(500, None, None), (501, "nonsense", ""), (502, "http://e.example/x", "plain  text\n only"), (503, "http://e.example/y", "<p>open <b>tags <script>alert("), (1, pages[1][1], pages[1][2])]
    want |= {500: "", 501: "", 502: "plain text only", 503: "open tags"}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text), r.page_id
    assert extract(df.limit(0)).collect() == []


def test_names_set_aside_minor_containers_only():
    from treeledger.llm.op2_extract import text_of

    def got(html):
        return text_of(html)

    body = "<p>one two three four five six seven eight nine ten</p>"
    text = "one two three four five six seven eight nine ten"
    assert got(f"<div class='content no-sidebar'>{body}</div>") == text
    assert got(f"<div class='post has-comments'>{body}</div><div class='cookie-notice x'>We use cookies</div>") == text
    assert got(f"<div id='search'>{body}</div>") == text
    assert got(f"<article>{body}<p class='notice'>mind <span class='search'>the</span> gap</p><div class='comments'>me too</div></article>") == text + "\nmind the gap"
    assert got("<div class='ad'>buy this</div><div class='ad'>buy that</div>") == "buy this\nbuy that"
    assert got(f"<div class='ad'>buy this{body}") == "buy this\n" + text


def test_main_container_loses_no_text(spark):
    """The same text on hosts of one, four and nine pages."""
    from treeledger.llm.op2_extract import extract

    rng = random.Random(16)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shapes = {
        "article": lambda t: f"<article><h1>{t[0]}</h1><p>{t[1]}</p><div class='body'><p>{t[2]}</p></div></article>",
        "halves": lambda t: f"<div class='page'><h1>{t[0]}</h1><div class='a'><p>{t[2]}</p></div><div class='b'><p>{t[1]}</p></div></div>",
    }
    pages, want = [], {}
    for name, shape in shapes.items():
        for n in (1, 4, 9):
            for _ in range(n):
                t = [line(3), line(14), line(40)]
                want[len(pages)] = set(t)
                pages.append((len(pages), f"http://{name}{n}.example/", f"<html><body><nav>{line(2)}</nav>" + ("<div class='top'>welcome to our pages</div>" if n == 9 else "") + shape(t) + "</body></html>"))
    got = extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: set(r.text.split("\n")) for r in got} == want


def template_pages(rng, host, n, wrap, fixed=True):
    """Pages without article or main or telling names: fixed blocks around and between what differs."""
    line = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    menu = "".join(f"<li>{line(2)}</li>" for _ in range(5))
    legal, hint = line(40), line(6)
    pages, want = [], []
    for i in range(n):
        body = [line(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        offer = f"<div class='q7'><p>{hint}</p></div>" if fixed and i % 10 < 7 else ""  # on seven pages of ten
        pages.append(f"<html><body><div class='x1'><ul>{menu}</ul></div><div class='x2'><div class='x3'>" + wrap(body) + f"</div>{offer}</div><div class='x4'><p>{legal}</p></div></body></html>")
        want.append("\n".join(body))
    return [(f"http://{host}/{i}", p) for i, p in enumerate(pages)], want


def test_templates_decide(spark):
    """Without article, main or names the classes alone tell menus, notices on some pages and legal lines from the text."""
    from treeledger.llm.op2_extract import extract, text_of

    rng = random.Random(17)
    plain = lambda body: "".join(f"<p>{b}</p>" for b in body)
    named = lambda body: "".join(f"<div class='search notice'><p>{b}</p></div>" if k == 0 else f"<p>{b}</p>" for k, b in enumerate(body))
    rows, want = [], {}
    for host, n, wrap in (("a.example", 20, plain), ("b.example", 40, named), ("c.example", 10, lambda body: f"<article>{named(body)}</article>")):
        pages, texts = template_pages(rng, host, n, wrap)
        for (url, html), text in zip(pages, texts, strict=True):
            want[len(rows)] = text
            rows.append((len(rows), url, html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "main", "keys", "key", "classes"):
        df = df.withColumn(c, df["url"])
    got = {r.page_id: r.text for r in extract(df.repartition(7)).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert all(20 <= i < 60 for i in wrong), wrong
    # A named container that every page has is taken for part of the template; its text differs, so it is no article only by its name.
    assert all("\n".join(want[i].split("\n")[1:]) == got[i] for i in wrong)
    assert all(text_of(html) != want[i] for i, _, html in rows[:60])  # each page alone can't tell


def test_classes_by_brute_force():
    """Classes of a host equal those of whole occurrence vectors; copies of one article are no template."""
    from treeledger.llm.op2_extract import Counts, Page, classes_of, page_tokens

    rng = random.Random(18)
    pages = [p for _, p in template_pages(rng, "h", 12, lambda body: "".join(f"<p>{b}</p>" for b in body))[0]]
    pages += [pages[0]] * 13  # copies of one page: its article is on half of all
    counts, vectors = Counts(), []
    for i, html in enumerate(pages):
        tokens = page_tokens(Page(html), "h")
        vectors.append(Counter(k for k, _ in tokens))
        counts.add("h", tokens, (i + 1) * 7919 % 10007 << 20 | i, sum(w for _, w in tokens))
    (n,), table = counts.hosts["h"]
    rows = [dict(zip(("pages", "times", "vector", "place", "words", "total"), got, strict=True), key=k, all_pages=n) for k, got in table.items() if 2 * got[0] >= n]
    whole = {}
    for key in {k for v in vectors for k in v}:
        vector = tuple(v[key] for v in vectors)
        if 2 * sum(x > 0 for x in vector) >= n:
            whole.setdefault(vector, set()).add(key)
    got = {}
    for k, c in classes_of(rows):
        got.setdefault(c, set()).add(k)
    assert {frozenset(x) for c, x in got.items() if c >= 0} <= {frozenset(x) for x in whole.values()}
    assert got[0] == whole[tuple([1] * n)]
    article = {k for k, _ in page_tokens(Page(pages[0]), "h")} - set().union(*(x for v, x in whole.items() if sum(v) > 20))
    assert article and not article & set().union(*(x for c, x in got.items() if c >= 0))


def test_order_and_nesting():
    from treeledger.llm.op2_extract import misplaced

    assert misplaced({1: 0, 2: 1, 3: 2, 4: 3}, {0: [1, 4], 1: [2, 3]}) == set()
    assert misplaced({1: 0, 2: 1, 3: 2, 4: 3}, {0: [1, 4], 1: [3, 2]}) == {1}  # out of order
    assert misplaced({1: 0, 2: 1, 3: 2, 4: 3}, {0: [1, 3], 1: [2, 4]}) == {1}  # crossing
    assert misplaced({1: 0, 4: 3}, {0: [1, 4], 1: [2, 3]}) == set()  # not on this page


def test_deep_and_long_pages():
    from treeledger.llm.op2_extract import text_of

    assert text_of("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    words = "word " * 200_000
    assert text_of(f"<body><article><p>{words}</article>") == words.strip()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocab = {"de": ["der", "und", "schön", "über", "nicht", "haus", "straße"], "en": ["the", "and", "house", "with", "not", "thing", "street"]}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) + rng.choice(["", "er", "en", "ly"]) for _ in range(n))
    rows = [(i, text(k, 60), k, "s") for i, k in enumerate(["de", "en"] * 40)]
    item = "What is the name of the thing in the house with the street? It is not the over thing and house."
    rows += [(100, rows[0][1], "de", "s"), (101, None, None, "s"), (102, "123 456", "en", "s"), (103, f"{text('en', 30)} {item} {text('en', 30)}", "en", "s"), (104, text("en", 40) + " mail jo.1@mail.example.com now", None, "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    every = {r[0] for r in rows}
    assert set(kept["language"]) == every - {101, 102} and kept["language"][104].lang == "en"
    assert set(kept["near_copies"]) == every - {100, 101, 102}
    assert set(kept["benchmark"]) == set(kept["personal_data"]) == every - {100, 101, 102, 103}
    assert kept["personal_data"][104].text.endswith(" mail <EMAIL> now") and kept["personal_data"][0].text == rows[0][1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["personal_data"])


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, no rows: every stage keeps the columns it was given."""
    import corpus_pipeline

    docs = odd_docs(spark)
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            path = str(tmp_path / f"{name}-{rows is docs}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
        out = corpus_pipeline.tokens(spark, now, str(tmp_path))
        assert out.count() == now.count() and (rows is docs) == (out.count() > 0)


def test_queries_with_sql_agree_with_it(spark, tmp_path):
    """The SQL of ``oracle`` on the same rows, edited copies and short answers among them."""
    import duckdb

    from treeledger.llm import oracle
    from treeledger.llm.queries import QUERIES

    rng = random.Random(27)
    rows = near_rows(rng, 150)
    items = [(i, " ".join(rng.choice(rows)[1].split()[:30]).capitalize() + (". And so on." if i % 2 else ".")) for i in range(12)]
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in oracle.ORACLE_SQL.items():
        got = QUERIES[name](spark, str(tmp_path))
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall()) and sorted(names) == sorted(got.columns), name
