"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bound on the labelled examples: at most so many distinct texts of each label, those with the smallest hashes.
SAMPLE_PER_LABEL = 4_096
#: Most features, those that tell the labels apart best; each stands in LEAST_DF examples, and has this chi-square and this
#: share of the examples' number as chi-square at least.
FEATURES, LEAST_DF, LEAST_CHI2, LEAST_PHI2 = 4_096, 5, 30.0, 0.01
#: A word counts as itself and, if it is longer, by its first so many letters, for inflected forms.
STEMS = (3, 4, 5)
#: Neighbours that vote, and what is added to a distance whose reciprocal is the vote's weight.
NEIGHBOURS, SOFTEN = 15, 0.05
#: Examples in a block of the index, and characters that are split at a time.
BLOCK, CHUNK_CHARS = 256, 4_000_000
THRESHOLD = 0.7


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_CHARS bytes of text, of one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, its code, words by code) of whole texts; words are runs of letters, lower-cased."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"\PL+")
    coded = lists.flatten().dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _forms(words: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places in ``words``, features): each word, and the beginnings of those that are longer."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length > 0)
    yield at, words.take(pa.array(at))
    for n in STEMS:
        at = np.flatnonzero(length > n)
        yield at, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.take(pa.array(at)), 0, n), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string()))


def _pairs(rows: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) with their number."""
    key, n = np.unique(rows.astype(np.int64) * max(n_codes, 1) + codes, return_counts=True)
    return key // max(n_codes, 1), key % max(n_codes, 1), n


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, examples that have it), summed by piece, of (toxic, text)."""
    for batch in batches:
        for part in _chunks(batch, 1):
            rows, codes, words = _words(part.column(1))
            toxic = part.column(0).to_numpy(zero_copy_only=False)
            for at, names in _forms(words):
                coded = names.dictionary_encode()
                to = np.full(len(words), -1)
                to[at] = coded.indices.to_numpy(zero_copy_only=False)
                f = to[codes]
                r, f, _ = _pairs(rows[f >= 0], f[f >= 0], len(coded.dictionary))
                both, n = np.unique(f * 2 + toxic[r], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(both // 2)).cast(pa.string()), pa.array(both % 2, pa.int32()), pa.array(n, pa.int64())], names=["feature", "toxic", "n"]
                )


def _vectors(shared):
    """(doc_id, features, their counts) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for part in _chunks(batch, 1):
                rows, codes, words = _words(part.column(1))
                r_all, f_all = [], []
                for at, names in _forms(words):
                    to = np.full(len(words), -1)
                    to[at] = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False)
                    f = to[codes]
                    r_all.append(rows[f >= 0]), f_all.append(f[f >= 0])
                r, f, n = _pairs(np.concatenate(r_all), np.concatenate(f_all), len(known))
                ends = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(ends), pa.array(a, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), lists(f), lists(n)], names=["doc_id", "features", "counts"])

    return run


@dataclass(frozen=True)
class Index:
    """Unit TF-IDF vectors of labelled examples as postings by feature, with the largest weight in each block of examples."""

    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    block_max: np.ndarray

    @classmethod
    def build(cls, idf: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]]) -> Index:
        """From (doc_id, toxic, features, counts); examples alike are put together, so that blocks differ."""
        vectors = [(d, y, np.array(f, dtype=np.int64), w) for d, y, f, n in rows if len(w := cls.unit(idf, np.array(f, dtype=np.int64), np.array(n)))]
        vectors.sort(key=lambda v: (int(v[2][v[3].argmax()]), -float(v[3].max()), v[0]))
        example = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        feature = np.concatenate([v[2] for v in vectors]) if vectors else np.empty(0, dtype=np.int64)
        weight = np.concatenate([v[3] for v in vectors]) if vectors else np.empty(0)
        order = np.lexsort((example, feature))
        example, feature, weight = example[order], feature[order], weight[order]
        blocks = max(1, -(-len(vectors) // BLOCK))
        cell = feature * blocks + example // BLOCK
        start = np.searchsorted(cell, np.arange(len(idf) * blocks + 1)).astype(np.int64)
        block_max = np.zeros(len(idf) * blocks)
        np.maximum.at(block_max, cell, weight)
        return cls(idf, np.array([v[0] for v in vectors], dtype=np.int64), np.array([v[1] for v in vectors], dtype=np.int64), example, weight, start, block_max.reshape(len(idf), blocks))

    @staticmethod
    def unit(idf: np.ndarray, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * idf[features]
        return w / np.sqrt(np.square(w).sum()) if len(w) else w

    def nearest(self, features: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int, int]]:
        """The ``k`` examples of largest cosine above 0, as (cosine, place, doc_id); ties to the smaller id.

        Blocks come by falling bound, the sum of the query's weights times the block's largest; no
        block whose bound is below the k-th cosine known so far is looked at.
        """
        q = self.unit(self.idf, features, counts)
        if not len(q) or not len(self.ids):
            return []
        blocks = self.block_max.shape[1]
        bound = q @ self.block_max[features]
        found: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(found) == k and bound[b] < found[-1][0] - 1e-9):
                break
            lo, hi = self.start[features * blocks + b], self.start[features * blocks + b + 1]
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            cosine = np.bincount(self.example[at] - b * BLOCK, weights=np.repeat(q, n) * self.weight[at])
            least = found[-1][0] - 1e-9 if len(found) == k else 0
            hits = np.flatnonzero((cosine > 0) & (cosine >= least))
            some = [(round(float(cosine[i]), 12), int(b * BLOCK + i), int(self.ids[b * BLOCK + i])) for i in hits]
            found = sorted([*found, *some], key=lambda s: (-s[0], s[2], s[1]))[:k]
        return found

    def vote(self, near: list[tuple[float, int, int]]) -> float:
        """Share of the toxic among the neighbours, weighted by reciprocal distance."""
        w = 1 / (SOFTEN + 1 - np.array([s[0] for s in near]))
        return float(w @ self.toxic[[s[1] for s in near]] / w.sum())


@dataclass(frozen=True)
class Calibration:
    """Votes to probabilities by isotonic regression, with straight lines between its steps; ``none`` where nothing votes."""

    votes: np.ndarray
    shares: np.ndarray
    none: float

    @classmethod
    def fit(cls, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Calibration:
        """``votes`` are NaN where no example is near; ``weight`` of a row is what it stands for."""
        base = float(weight @ toxic / weight.sum()) if len(toxic) else 0.0
        share = lambda pos, n: (pos + base) / (n + 1)
        silent = np.isnan(votes)
        none = share(float(weight[silent] @ toxic[silent]), float(weight[silent].sum()))
        order = np.argsort(votes[~silent], kind="stable")
        v, y, w = votes[~silent][order], toxic[~silent][order], weight[~silent][order]
        steps: list[list[float]] = []
        for a, b, c in zip(v, y, w, strict=True):
            steps.append([a * c, b * c, c])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                last = steps.pop()
                steps[-1] = [p + q for p, q in zip(steps[-1], last, strict=True)]
        at = np.array([s[0] / s[2] for s in steps])
        return cls(at, np.maximum.accumulate(np.array([share(s[1], s[2]) for s in steps])) if steps else at, none)

    def __call__(self, vote: float | None) -> float:
        return self.none if vote is None or not len(self.votes) else float(np.interp(vote, self.votes, self.shares))


def _neighbours(index, calibration):
    """(doc_id, vote, score, evidence) of (doc_id, features, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, c = index.value, calibration.value if calibration is not None else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)))
            votes, score, evidence = [], [], []
            known: dict[bytes, list[tuple[float, int, int]]] = {}
            for i, d in enumerate(ids):
                f, n = (x[ends[i] : ends[i + 1]] for x in flat)
                key = f.tobytes() + n.tobytes()
                if key not in known:
                    # One more, as a row is no neighbour of its own.
                    known[key] = ix.nearest(f, n, NEIGHBOURS + 1)
                near = [s for s in known[key] if s[2] != d][:NEIGHBOURS]
                votes.append(ix.vote(near) if near else None)
                score.append(c(votes[-1]) if c is not None else 0.0)
                evidence.append([{"doc_id": s[2], "toxic": int(ix.toxic[s[1]]), "cosine": s[0]} for s in near])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64()), pa.array(score, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "vote", "score", "evidence"])

    return run


NEAR_SCHEMA = "doc_id long, vote double, score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, per_label: int, scratch: Scratch) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of the examples, written, and how many labelled texts an example of each label stands for."""
    told = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.where(~held_out(F.col("doc_id")))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"))
    distinct = scratch.write(texts.join(told, "doc_id").groupBy("text_hash", "toxic").agg(F.min("doc_id").alias("doc_id")))
    counts = distinct.groupBy("toxic").agg(F.count("*").alias("all"))
    # A range of the hash that holds more than enough, so that no window sees a whole label.
    low = F.pmod(F.xxhash64("text_hash"), F.lit(1 << 31))
    some = distinct.join(F.broadcast(counts), "toxic").where(low * F.col("all") < F.lit(float(1 << 31)) * (1.5 * per_label + 100))
    first = Window.partitionBy("toxic").orderBy(low, "doc_id")
    picked = scratch.write(some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label).select("doc_id", "toxic"))
    n = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    return picked, {r["toxic"]: r["all"] / n[r["toxic"]] for r in counts.collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` outside the held-out fold: at most ``per_label`` distinct
    texts of each label are the examples. Features are words and beginnings of words that tell the
    examples' labels apart; document frequencies are counted over all rows of ``docs``. A row's
    nearest examples by cosine, itself left out, vote by reciprocal distance, and votes of the
    examples on each other calibrate the score. ``evidence`` lists the neighbours, nearest first.

    A null or empty text, and one without any feature, has no neighbours: its score is the share of
    toxic examples among those without neighbours. Without labels all scores are 0. A doc_id with
    several labels is toxic if one is; labels other than 0 and 1, null ids and labels of absent
    documents teach nothing. Repeated rows each get their row, and a null doc_id is scored and not
    held out. Ties between neighbours go to the smaller id. No rows give no rows; other columns are
    ignored, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        examples, stands_for = _examples(rows, labels, per_label, scratch)
        # At most two times per_label ids.
        sample = rows.join(F.broadcast(examples), "doc_id")
        n = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
        n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
        features: list[str] = []
        if n0 and n1:
            counted = sample.select("toxic", "text").mapInArrow(_document_counts, "feature string, toxic int, n long").groupBy("feature")
            has = counted.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
            a, b = F.col("a").cast("double"), F.col("b").cast("double")
            chi2 = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * F.greatest(n0 + n1 - a - b, F.lit(0.5)) * n0 * n1)
            best = has.where(a + b >= LEAST_DF).select("feature", chi2.alias("chi2")).where(F.col("chi2") >= max(LEAST_CHI2, LEAST_PHI2 * (n0 + n1))).orderBy(F.desc("chi2"), "feature").limit(FEATURES)
            features = sorted(r["feature"] for r in best.collect())
        vectors = scratch.write(rows.mapInArrow(_vectors(sc.broadcast(features)), "doc_id long, features array<int>, counts array<int>"))
        frequency, total = np.ones(len(features)), vectors.count()
        for r in vectors.select(F.explode("features").alias("feature")).groupBy("feature").count().collect():
            frequency[r["feature"]] = r["count"]
        known = vectors.join(F.broadcast(examples), "doc_id").dropDuplicates(["doc_id"])
        known = scratch.write(known)
        index = sc.broadcast(Index.build(np.log1p(total / frequency), [(r["doc_id"], r["toxic"], r["features"], r["counts"]) for r in known.where(F.size("features") > 0).collect()]))
        told = known.select("doc_id", "features", "counts").mapInArrow(_neighbours(index, None), NEAR_SCHEMA).select("doc_id", "vote").join(F.broadcast(examples), "doc_id").toPandas()
        toxic = told["toxic"].to_numpy(dtype=float)
        calibration = sc.broadcast(Calibration.fit(told["vote"].to_numpy(dtype=float), toxic, np.array([stands_for.get(int(y), 1.0) for y in toxic])))
        scored = vectors.mapInArrow(_neighbours(index, calibration), NEAR_SCHEMA)
        return scratch.keep(scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "evidence"))
