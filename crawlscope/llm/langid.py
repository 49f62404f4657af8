"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, absent, releasing, small

#: log2 of the hashed feature space.
BITS = 16
ORDERS = (1, 2, 3)
#: Bound on the training sample: at most so many documents of each language, those with the smallest
#: hashes of their ids among all labelled documents of the training folds.
SAMPLE_PER_LANG = 2_000
#: Languages whose matrix is broadcast together, and whose counts the driver holds at a time; further ones follow in blocks.
BLOCK_LANGS = 128
UNKNOWN = "und"

CHUNK = 1 << 19


def _has_letter(text: str) -> bool:
    """Whether a character of ``text`` is of Unicode category L; fractions and numerals aren't."""
    return any(map(str.isalpha, text))


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower case of each letter of the basic plane; every other character is a space."""
    out = np.full(1 << 16, 32, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(a < 1 << 16, _fold()[a & 0xFFFF], a)


def _features(c: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that start at each place but the last two, one array per order."""
    n = len(c) - 2
    h = np.zeros(n, dtype=np.uint32)
    for k in range(max(ORDERS)):
        h = (h ^ c[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            yield ((h + np.uint32(k)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, their first places, characters): whole texts in chunks, each n-gram in one chunk.

    A text begins after one space and ends before two; a text longer than a chunk is cut where the
    next piece goes on, with one character of the piece before and two of the piece after.
    """
    docs, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        padded = f" {text}  "
        for at in range(0, len(padded) - 2, CHUNK):
            part = _codes(padded[at : at + CHUNK + 2])
            docs.append(i), starts.append(size), parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(docs), np.array(starts), np.concatenate(parts)
                docs, starts, parts, size = [], [], [], 0
    if parts:
        yield np.array(docs), np.array(starts), np.concatenate(parts)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) over a partition of (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    n_docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            n_docs[lang] = n_docs.get(lang, 0) + 1
            for _, _, c in _pieces([text]):
                for f in _features(c):
                    own += np.bincount(f, minlength=1 << BITS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        bucket, n = np.append(at, -1), np.append(own[at], n_docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    """langs[i] has prior[i] and the feature log-probabilities weights[i]."""

    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Log of prior times likelihood of each language for each text, (len(texts), len(langs))."""
        total = np.tile(self.prior, (len(texts), 1))
        for docs, starts, c in _pieces(texts):
            # The last two characters of a piece only end n-grams: their own places weigh nothing.
            ends = np.append(starts[1:], len(c))
            live = np.ones(len(c) - 2, dtype=bool)
            for e in ends[:-1]:
                live[e - 2 : e] = False
            feats = list(_features(c))
            for j, w in enumerate(self.weights):
                s = w[feats[0]]
                for f in feats[1:]:
                    s += w[f]
                s *= live
                np.add.at(total[:, j], docs, np.add.reduceat(s, np.minimum(starts, len(s) - 1), dtype=np.float64))
        return total


def _model(grams: pa.Table, alpha: float) -> Model:
    """From (lang, bucket, n); bucket -1 has the number of documents."""
    names = sorted(set(grams["lang"].to_pylist()))
    n, prior = np.zeros((len(names), 1 << BITS)), np.zeros(len(names))
    coded = grams["lang"].combine_chunks().dictionary_encode()
    row = np.searchsorted(names, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    bucket, value = grams["bucket"].to_numpy(), grams["n"].to_numpy()
    real = bucket >= 0
    n[row[real], bucket[real]] = value[real]
    prior[row[~real]] = value[~real]
    weights = np.log((n + alpha) / (n.sum(axis=1, keepdims=True) + alpha * (1 << BITS)))
    return Model(tuple(names), np.log(prior), weights.astype(np.float32))


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG, alpha: float = 0.1) -> list[Model]:
    """Models of all languages of ``labelled(doc_id, text, lang)``, in blocks by name; rows with a null are left out.

    Counts come from at most ``per_lang`` documents of each language and are summed on the
    executors; BLOCK_LANGS * (2**BITS + 1) counts at most reach the driver at a time.
    """
    rows = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    with Scratch(labelled.sparkSession, "langid") as scratch:
        counts = scratch.write(rows.groupBy("lang").agg(F.count("*").alias("__all")))
        names = sorted(r["lang"] for r in counts.select("lang").collect())
        if not names:
            return []
        # A range of the hash that holds more than enough, so that no window sees a whole language.
        span = F.lit(float(1 << 31))
        low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
        some = rows.select("doc_id", "lang").join(small(counts, size="octet_length(lang)"), "lang").where(low * F.col("__all") < span * (1.5 * per_lang + 100))
        first = Window.partitionBy("lang").orderBy(low, "doc_id")
        ids = some.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_lang).select("doc_id", "lang")
        if len(names) * per_lang <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        sample = rows.join(ids, ["doc_id", "lang"], "left_semi").select("lang", "text")
        if len(names) > BLOCK_LANGS:
            sample = scratch.write(sample)
        out = []
        for at in range(0, len(names), BLOCK_LANGS):
            block = sample.where(F.col("lang").between(names[at], names[min(at + BLOCK_LANGS, len(names)) - 1]))
            out.append(_model(block.mapInArrow(_counting, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow(), alpha))
        return out


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def predict(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row and its whole text.

    A null text, one without a letter, or no model gives ``und`` with score 0. The score is the
    posterior of the predicted language among those of all blocks, from a running maximum and sum;
    ties go to the first in order.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ok = [i for i, t in enumerate(texts) if shared and t and _has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                top, whole = np.full(len(ok), -np.inf), np.full(len(ok), -np.inf)
                for block in shared if ok else ():
                    m = block.value
                    p = m.score([texts[i] for i in ok])
                    most = p.max(axis=1)
                    whole = np.logaddexp(whole, most + np.log(np.exp(p - most[:, None]).sum(axis=1)))
                    for j in np.flatnonzero(most > top):
                        lang[ok[j]] = m.langs[int(p[j].argmax())]
                    top = np.maximum(top, most)
                score[ok] = np.exp(np.minimum(top - whole, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text, lang, ...)``.

    Learns from the text and lang of documents outside the held-out fold. Repeated rows each get
    their row; a null doc_id is predicted, never learned from, and not held out. Without labelled
    rows all is ``und``. Every value of lang is learned, in blocks of BLOCK_LANGS. No rows give no rows;
    other columns are ignored, whatever their names.
    """
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    models = train(docs.where(~fold).select("doc_id", "text", "lang"), per_lang)
    return predict(docs, models).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least: float = 0.5, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` with a predicted language, with their columns.

    Rejected are ``und``, scores below ``least`` and, if ``langs`` is given, other languages. Ids
    that repeat with differing texts are kept if any of them is identified; a null doc_id is kept.
    """
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    if langs is not None:
        good &= F.col("lang_pred").isin(*langs)
    bad = absent(docs, "bad")[0]
    verdict = identify(docs).groupBy("doc_id").agg(F.max(good).alias("ok")).where("NOT ok AND doc_id IS NOT NULL").select(F.col("doc_id").alias(bad))
    return docs.join(verdict, F.col("doc_id") == F.col(bad), "left_anti")
