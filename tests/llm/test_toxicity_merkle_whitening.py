"""Toxicity, the Merkle manifest and whitening against brute force, and their odd rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm.merkle import manifest
from crawlscope.llm.queries import op11_toxicity, op12_merkle_manifest, op13_embedding_whitening
from crawlscope.llm.toxicity import BLOCK, Calibration, Index, score_toxicity
from crawlscope.llm.whitening import whiten

ROW = "doc_id long, source string, lang string, n_chars long, text string"
LABEL = "doc_id long, toxic int"
VEC = "vec_id long, embedding array<double>"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root, and for each node its siblings (before, behind) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // 16 * 16
            paths[i].append((nodes[a:p], nodes[p + 1 : a + 16]))
            at[i] = p // 16
        nodes = [h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    leaf = lambda r: h(*[encoded(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        rs = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((rs, *tree([leaf(r) for r in rs])))
    root, over = tree([t[1] for t in trees])
    out = []
    for (rs, sub, paths), high in zip(trees, over, strict=True):
        for r, path in zip(rs, paths, strict=True):
            path, given = path + high, dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                given["text"] = r["text"].translate({i: i + 32 for i in range(65, 91)})
            now = leaf(given)
            for before, behind in path:
                now = h(*before, now, *behind)
            out.append((r["doc_id"], leaf(r), sub, root, h(*[x for b, a in path for x in b + a]), now, now == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_manifest_of_all_documents(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op12_merkle_manifest(spark, sf_dir).collect()
    assert ordered(got) == ordered(brute_manifest(rows))
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a", "en", 3, "Abc")],
        [(i, "s", None, 1, "X") for i in range(17)],
        [(i, f"s{i}", None, 1, "X") for i in range(20)],
        [(i, "a" if i % 3 else None, "en", 3, f"Text {i}") for i in range(300)] + [(None,) * 5] * 2 + [(5, "z", None, None, ""), (5, "z", None, None, None), (6, "é", "de", 9, "Ä" * 100_000)],
    ],
)
def test_manifest_of_odd_rows(spark, rows):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    docs = spark.createDataFrame(rows, ROW).select("*", *[F.lit("clash").alias(c) for c in ("pos", "size", "leaf", "at", "tree")])
    assert ordered(manifest(docs).collect()) == ordered(brute_manifest([dict(zip(names, r, strict=True)) for r in rows]))


def test_manifest_paths_prove_untouched_rows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Some Text {i}") for i in range(100)]
    out = manifest(spark.createDataFrame(rows, ROW), tampered=F.lit(False), keep_paths=True).collect()
    assert all(r.verified for r in out)
    for r in out:
        now = r.leaf
        for s in r.path:
            now = h(s.before, now, s.behind)
        assert now == r.root
    assert manifest(spark.createDataFrame([], ROW)).count() == 0


def brute_whitening(rows, k=16):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in sound], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = lambda m: ((n * m - s) / n).astype(float)
    cov = centred(fit).T @ centred(fit) / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, [i for i, _ in sound], [int(((n * r - s) ** 2).sum()) for r in x], centred(x) @ vector / np.sqrt(value), value / np.trace(cov)


def compare_whitening(out, rows):
    n, ids, deviation, white, explained = brute_whitening(rows)
    got = out.toPandas()
    assert set(got["n"]) == {n} and len(got) == len(ids) * white.shape[1]
    assert got.groupby("vec_id")["deviation"].first().to_dict() == dict(zip(ids, deviation, strict=True))
    table = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_all_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare_whitening(op13_embedding_whitening(spark, sf_dir), rows)


def test_whitening_with_repeats_and_slabs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3) * (1, 2, 5)]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(3000, None), (3001, [float("nan"), 1.0, 1.0]), (3002, [float("inf"), 1.0, 1.0]), (3003, [None, 1.0, 1.0])]
    table = spark.createDataFrame(rows, VEC).select("*", F.lit("clash").alias("x"), F.lit(1).alias("pos"))
    compare_whitening(whiten(table), rows)
    compare_whitening(whiten(table, slab=64), rows)


def test_whitening_of_odd_tables(spark):
    assert whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], VEC)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0]), (3, [0.5])], VEC)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whiten(spark.createDataFrame([(1, [0.0, 7.0]), (2, [1.0, 7.0]), (3, [1e30, 7.0])], VEC)).collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat)


def test_index_finds_the_nearest(spark):
    """Blocks that are skipped hold none of the nearest."""
    rng = np.random.default_rng(1)
    idf, rows = rng.uniform(0.5, 3, 60), []
    for i in range(5 * BLOCK):
        f = np.sort(rng.choice(60, rng.integers(0, 6), replace=False))
        rows.append((i, int(rng.integers(2)), f.tolist(), rng.integers(1, 9, len(f)).tolist()))
    index = Index.build(idf, rows)
    dense = np.zeros((len(rows), 60))
    for i, _, f, n in rows:
        dense[i, f] = Index.unit(idf, np.array(f, dtype=int), np.array(n))
    for i, _, f, n in rows[:200]:
        cosine = np.round(dense @ dense[i], 12)
        want = sorted([(-c, j) for j, c in enumerate(cosine) if c > 0])[:15]
        got = [(-c, d) for c, _, d in index.nearest(np.array(f, dtype=int), np.array(n))]
        assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-9) and len(got) == len(want)
        assert all(abs(-c - cosine[d]) < 1e-9 for c, d in got)


def test_calibration_is_monotone():
    votes, toxic = np.array([0.1, 0.2, 0.3, 0.9, 0.95, np.nan, np.nan]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0])
    c = Calibration.fit(votes, toxic, np.ones(7))
    scores = [c(v) for v in np.linspace(0, 1, 50)]
    assert scores == sorted(scores) and scores[0] < 0.5 < scores[-1] and c(None) < 0.3
    assert Calibration.fit(np.empty(0), np.empty(0), np.empty(0))(None) == 0.0


def toxic_rows(n):
    rng = np.random.default_rng(n)
    plain, bad = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], ["nastyone", "vilething", "grossly"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choice(plain, 30).tolist(), int(i % 4 == 0)
        if toxic:
            words[3:3] = rng.choice(bad, 3).tolist()
        rows.append((i, " ".join(words))), labels.append((i, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(1200)
    odd = [(None, rows[0][1]), (5000, None), (5001, ""), (5002, "... 12"), (5003, rows[0][1] * 3000), (8, rows[9][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").select("*", F.lit("x").alias("features"), F.lit(1).alias("toxic"), F.lit(0).alias("score"))
    told = spark.createDataFrame(labels + [(None, 1), (99_999, 1), (12, None), (13, 7)], LABEL)
    out = score_toxicity(docs, told).collect()
    assert len(out) == len(rows) + len(odd)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 8]
    assert len(held) > 300 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert all(r.predicted == truth[r.doc_id] == int(r.score >= 0.7) for r in held)
    assert all(0 <= r.score <= 1 and len(r.evidence) <= 15 and all(e.doc_id != r.doc_id for e in r.evidence) for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[None].predicted == 1 and not by_id[None].held_out and by_id[5003].predicted == 1
    assert {by_id[i].score for i in (5000, 5001, 5002)} == {by_id[5000].score} and by_id[5000].score < 0.2


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        assert {r.predicted for r in score_toxicity(docs, spark.createDataFrame(labels, LABEL)).collect()} == {0}
    assert score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], LABEL)).count() == 0


def test_toxicity_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.9 and ((out["predicted"] == 1) & (out["toxic"] == 0)).mean() < 0.02
