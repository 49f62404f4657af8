"""Operators against brute force, exact round trips and held-out accuracy, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlscope.llm import queries as llm_queries
from crawlscope.llm.ann import nearest
from crawlscope.llm.components import connected_components
from crawlscope.llm.common import Scratch
from crawlscope.llm.exact_dedup import drop_copies, exact_dedup
from crawlscope.llm.langid import drop_unidentified, identify
from crawlscope.llm.minhash import drop_near_duplicates, near_duplicates
from crawlscope.llm.mixing import MISSING, mix, rake, sample_to_targets
from crawlscope.llm.packing import pack_texts
from crawlscope.llm.url_filter import judge_pages

DOCS = "doc_id long, text string, lang string, source string, kept string, rep string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", "clash", "clash") for d, t in rows], DOCS)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    out = connected_components(spark.createDataFrame(random.sample(edges, len(edges)), "src long, dst long"), Scratch(spark, "t"))
    got = {r.node: r.component for r in out.collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "src string, dst string"), Scratch(spark, "t")).count() == 0


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_near(rows, k):
    sets = {d: shingles(t, k) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}
    for d, s in sets.items():
        for o in {o for x in s for o in by[x] if o < d}:
            both = len(s & sets[o])
            if 100 * both >= 80 * (len(s) + len(sets[o]) - both):
                a, b = find(parent, d), find(parent, o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(parent, d)) for d, s in sets.items()}


def test_near_duplicates(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 2, 3, 5, 8, 13, 40, 150, 600):
        base = [random.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 4, size // 20, size // 12, size // 8):
            text = list(base)
            for _ in range(edits):
                text[random.randrange(size)] = random.choice(words)
            rows.append((n, random.choice([" ", "\n", "  "]).join(text)))
            n += 1
    hub = [random.choice(words) for _ in range(120)]
    for _ in range(60):  # near copies of one text, many of them less like one another
        text = list(hub)
        for _ in range(random.randrange(1, 9)):
            text[random.randrange(120)] = f"x{random.randrange(10_000)}"
        rows.append((n, " ".join(text)))
        n += 1
    rows += [(900, None), (901, ""), (902, " \n "), (903, "é" * 3_000_000 + " b c d e"), (904, "é" * 3_000_000 + " B C D E")]
    random.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, rows), words=4).collect()}
    assert got == brute_near(rows, 4)


def test_near_duplicate_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (0, "A b c d  e"), (5, "other words stand here now")]
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_duplicates(docs_of(spark, rows)).collect())
    assert out == [(-1, None, False), (0, 0, True), (1, 0, False), (1, 0, False), (5, 5, True)]
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs_of(spark, rows)).collect()) == ["0", "5", "None"]
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = [(i, "same text here") for i in range(10, 60)] + [(1, "sametext here"), (2, "same  text   here"), (3, None), (4, ""), (5, "x" * 100_000), (6, "x" * 100_000 + "\n"), (7, "7"), (7, "7"), (None, "7"), (None, "lone")]
    for share in (0.005, 0.2):
        out = exact_dedup(docs_of(spark, rows), heavy_share=share).collect()
        assert len(out) == len(rows)
        by = {(r.doc_id, r.text_sha256): r for r in out}
        same = hashlib.sha256(b"sametexthere").hexdigest()
        assert all(by[i, same].keep_id == 2 and by[i, same].group_size == 52 for i in (1, 2, *range(10, 60)))
        none = hashlib.sha256(b"").hexdigest()
        assert (by[3, none].keep_id, by[4, none].kept, by[3, none].kept) == (3, False, True)
        assert by[5, hashlib.sha256(b"x" * 100_000).hexdigest()].keep_id == 6
        assert by[None, hashlib.sha256(b"lone").hexdigest()].kept
    assert exact_dedup(docs_of(spark, [])).count() == 0


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 20
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in out.collect())


def test_language_odd_rows(spark):
    train = [(i, "the and of with " * 5, "en", "s", "k", "r") for i in range(40)] + [(100 + i, "der die und nicht " * 5, "de", "s", "k", "r") for i in range(40)]
    odd = [(1000, None, "en", "s", "k", "r"), (1001, "12 !! 34", "en", "s", "k", "r"), (None, "der und die", None, None, None, None), (1002, "", None, "s", "k", "r"), (1003, "und der " * 200_000, None, "s", "k", "r"), (1003, "und der " * 3, None, "s", "k", "r")]
    df = spark.createDataFrame(train + odd, DOCS)
    got = defaultdict(list)
    for r in identify(df).collect():
        got[r.doc_id].append(r.lang_pred)
    assert got[1000] == got[1001] == got[1002] == ["und"] and got[None] == ["de"] and got[1003] == ["de", "de"]
    assert {r.doc_id for r in drop_unidentified(df).collect()} & {1000, 1001, 1002} == set()
    assert [r.lang_pred for r in identify(spark.createDataFrame(odd[:1], DOCS)).collect()] == ["und"]
    assert identify(spark.createDataFrame([], DOCS)).count() == 0


def check_packing(rows, pieces, limit):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packing_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(rows, pack_texts(docs, WORD_BPE, with_ids=False).collect(), 4096) == 0


def test_packing_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "İstanbul ΣΑΣ, d'accord it's.\x1cb a"), (4, "<|endoftext|> x 12,345 ...!!"), (5, "word " * 30_000), (6, "éÅﬁ ǅ")]
    pieces = pack_texts(docs_of(spark, rows), WORD_BPE).collect()
    assert check_packing(rows, pieces, 4096) == 0
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    assert pack_texts(docs_of(spark, []), WORD_BPE).count() == 0


def test_packing_limits(spark):
    random.seed(2)
    rows = [(i, "answer words here " * random.randrange(1, 40), "ask " * random.randrange(1, 60), "x", "y", "z") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    pieces = pack_texts(df, WORD_BPE, limit=256, max_segments=5, max_loss=120, cut=False, prompt_col="lang").collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    assert all(sum(p.length for p in ps) <= 256 and len(ps) <= 5 and sum(p.n_loss for p in ps) <= 120 for ps in by.values())
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_raking(spark):
    random.seed(4)
    cells = [(s, lang, t, random.randrange(1, 500)) for s in "abc" for lang in ("en", "de") for t in ("x", "y")]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"x": 0.7, "y": 0.3}}
    targets = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in goals.items()}
    out = rake(frame, targets, Scratch(spark, "t"), rounds=60, tolerance=1e-6).collect()
    w = np.array([c[3] for c in cells], dtype=float)
    for _ in range(200):
        for i, dim in enumerate(goals):
            for value, share in goals[dim].items():
                m = np.array([c[i] == value for c in cells])
                w[m] *= share * sum(c[3] for c in cells) / w[m].sum()
    got = {(r.source, r.lang, r.topic): r.tokens * r.factor for r in out}
    assert np.allclose([got[c[:3]] for c in cells], w, rtol=1e-3)


def test_raking_of_contradicting_targets(spark):
    """Where empty cells rule the targets out, a warning tells so and the last marginal holds."""
    frame = spark.createDataFrame([("a", "en", "x", 50), ("b", "de", "y", 50)], "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}, "topic": {"x": 0.5, "y": 0.5}}
    targets = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in goals.items()}
    with pytest.warns(UserWarning, match="raking is off by .* after 2 rounds"):
        out = {r.topic: r.tokens * r.factor for r in rake(frame, targets, Scratch(spark, "t"), rounds=2).collect()}
    assert np.allclose([out["x"], out["y"]], [50, 50])


def test_mixing_of_a_very_long_text(spark):
    rows = [(1, "word " * 400_000, "en", "s"), (2, "word", "en", "s"), (3, None, "en", "s")]
    out = {r.doc_id: r for r in sample_to_targets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    # One cell, so every row has probability 1, and texts come through whole.
    assert sorted(out) == [1, 2, 3] and len(out[1].text) == 2_000_000 and out[3].text is None


def test_mixing_rows(spark):
    rows = [(i, "some words " * (i % 7), "en" if i % 3 else None, f"s{i % 4}", "c", "r") for i in range(400)] + [(None, "a b", "en", None, "c", "r"), (5, "dup", "en", "s1", "c", "r")]
    out = mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    assert {r.lang for r in out} == {"en", MISSING}
    assert max(r.probability for r in out) == 1.0 and any(r.kept for r in out)
    again = {(r.doc_id, r.topic, r.n_tokens): r.kept for r in mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert again == {(r.doc_id, r.topic, r.n_tokens): r.kept for r in out}
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    x[500:900] = x[500]
    rows = [(int(i), [float(v) for v in r], 1, "c") for i, r in enumerate(x)]
    bad = [(5000, None, 1, "c"), (5020, [0.0] * 24, 1, "c"), (5040, [float("nan")] + [1.0] * 23, 1, "c"), (5060, [None] + [1.0] * 23, 1, "c"), (5080, [1.0], 1, "c"), (None, [1.0] * 24, 1, "c")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, score string")
    got = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == {i for i in range(3000) if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert len(found) == 20 and [(-v, i) for i, v in found] == sorted((-v, i) for i, v in found)
        assert np.allclose([v for _, v in found], [x[i] @ x[q] for i, _ in found])
        hit += len(set(order) & {i for i, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_nearest_on_embeddings(spark, sf_dir):
    """Recall of the registered query against brute force on the given vectors, and scores in exact order."""
    got = defaultdict(list)
    for r in llm_queries.QUERIES["op6_nearest_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit, total = hit + len(set(order) & set(found)), total + len(order)
    assert hit >= 0.9 * total


def test_nearest_repeats_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clashing = plain.select("*", *[F.lit("x").alias(c) for c in ("vector", "square", "rank", "score", "query_id", "list", "n")])
    out = nearest(clashing).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, nearest(plain).collect()))
    # A repeated id counts once, with the best score of its rows.
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1, 3.0), (0, 2, 2, 2.0)]


def test_nearest_few(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest(spark.createDataFrame([], schema)).count() == 0


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@pytest.mark.parametrize("linked", [False, True])
def test_url_filter(spark, linked):
    html = '<link rel="canonical" href="https://a.net/es/x">' if linked else "<p>"
    rows = [
        (1, "https://A.Example.COM/en/x?q#f", None), (2, "https://www.example.com/en/", None), (3, "http://b.net/es/1", None), (4, "http://b.net/de/1", html),
        (5, "no url", None), (6, None, None), (7, "https://example.com", '<meta http-equiv="refresh" content="0;url=https://a.net/es/x">'), (4, "http://b.net/de/1", html), (8, "x://h.net/fr", None),
    ]
    out = judge_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, rule string"), RULES, usual=False).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4] == ("b.net", "/de/1", None, "allow")  # its alias example.com/ is allowed, and allow goes first
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("example.com", "", None, "allow") and got[8] == ("h.net", "/fr", None, "allow")


def test_url_aliases(spark):
    rows = [(1, "http://b.org/x", '<link href="/y" rel="canonical">'), (2, "https://b.org/y", '<link rel=canonical href="https://c.net/es/1">'), (3, "http://d.org/", None)]
    out = judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in out} == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow")}


def test_usual_forms(spark):
    urls = {1: "http://www.b.net/es", 2: "https://b.org/x/index.html?utm_source=a&p=1&fbclid=z", 3: "http://m.b.org/x/?p=1", 4: "https://b.org/x/?p=2", 5: "http://b.org/y.html?gclid=7"}
    rows = [(i, u, '<link rel=canonical href="https://a.net/es/1">' if i == 3 else None) for i, u in urls.items()]
    out = judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    # The folder of 1 is blocked where its URL has no rule; 2 is an alias of 3, which states a blocked page as canonical.
    assert {r.page_id: (r.rule, r.verdict) for r in out} == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_unrelated_sites_are_no_aliases(spark):
    rules = [("www.io/x/", "block"), ("b.org/p/", "block")]
    urls = {1: "http://m.io/x/1", 2: "http://www.io/x/1", 3: "http://io/x/1", 4: "http://www.m.io/x/1", 5: "http://m.www.io/x/1", 6: "http://www.m.b.org/p", 7: "http://a.org/?ref=1", 8: "http://a.org/"}
    rows = [(i, u, '<link rel=canonical href="http://b.org/p/1">' if i == 7 else None) for i, u in urls.items()]
    got = {r.page_id: r.verdict for r in judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow"}
    assert judge_pages(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def brute_usual(url):
    head, _, rest = url.partition("://")
    rest = rest.split("#")[0]
    body, mark, query = rest.partition("?")
    host, slash, path = body.partition("/")
    labels = host.lower().split(".")
    while len(labels) > 2 and labels[0] in ("www", "m"):
        labels = labels[1:]
    host = ".".join(labels)
    path = re.sub(r"/index\.(html|htm|php)\Z", "/", "/" + path)
    if not re.search(r"(/|\.[A-Za-z0-9]+)\Z", path):
        path += "/"
    drop = {"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"}
    kept = [x for x in query.split("&") if x and x.split("=")[0] not in drop]
    return host + path, "?" + "&".join(kept) if kept else ""


def test_url_filter_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_pages(pages, RULES).collect()}

    def rule(host, path):
        fits = [(len(r), r, a) for r, a in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fits)[1:] if fits else None

    groups, own = defaultdict(set), {}
    for r in pages.select("page_id", "url").collect():
        host, _, path = re.split(r"[?#]", r.url.split("://")[1])[0].partition("/")
        own[r.page_id] = rule(host.lower(), "/" + path)
        form, query = brute_usual(r.url)
        h, _, p = form.partition("/")
        groups[form, query] |= {own[r.page_id], rule(h, "/" + p)}
        own[r.page_id] = (own[r.page_id], (form, query))
    for i, (hit, key) in own.items():
        actions = {x[1] for x in groups[key] if x}
        other = "allow" if "allow" in actions or not actions else "block"
        assert got[i] == (hit if hit else (None, other)), i


def test_url_aliases_by_entities_and_dots(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    goal = "https://a.net/es/x?p=2&amp;r=1"
    rows = [
        (1, "https://a.net/es/x?p=2&r=1", None), (2, "http://b.org/d/2", canonical(goal)), (3, "http://b.org/d/e/3", canonical("../../up")), (4, "http://b.org/up", canonical(goal)),
        (5, "http://b.org/d/5", canonical("./2")), (6, "http://b.org/d/6", f'<meta http-equiv="refresh" content="0;url={goal}">'), (7, "http://b.org/d/\u00e9 x", canonical(goal)),
        (8, "http://b.org/d/8", canonical("http://b.org/d/\u00e9")), (9, "http://b.org/d/\u00e9", canonical(goal)), (10, "http://b.org/d/10", canonical("10?a=1&amp;b=2")), (11, "http://b.org/d/10?a=1&b=2", None),
    ]
    out = judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()
    assert {r.page_id: r.verdict for r in out} == {i: "block" for i in range(1, 10)} | {10: "allow", 11: "allow"}
