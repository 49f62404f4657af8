"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimate, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, absent, releasing, small
from .components import connected_components

#: Bands times registers a band. At a Jaccard similarity of 0.8 a pair shares no band with
#: probability (1 - 0.8**6)**52, about 1e-7.
BANDS, ROWS = 52, 6
REGISTERS = BANDS * ROWS
#: Mantissa bits beside the six bits that count leading zeros.
MANTISSA = 10
#: A pair is checked on full sets if its estimate is not this far below the threshold. The
#: estimate's standard deviation at 0.8 is 0.023, so this is eight of them.
SLACK = 0.18
#: Rounds of comparison with one leader a bucket, before members of differing components meet.
STAR_ROUNDS = 2
#: In the last comparison, shingles that at most so many of the remaining documents have are rare.
RARE = 12

CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.Generator(np.random.PCG64(20240607))
    byte_value = rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
    power = np.full(CHUNK + 1, _P, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(CHUNK + 1, pow(_P, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    step = rng.integers(1, _MASK, 16, dtype=np.uint64, endpoint=True) | np.uint64(1)
    donor = rng.random((REGISTERS, REGISTERS), dtype=np.float32)
    band = rng.integers(1, _MASK, (BANDS, ROWS), dtype=np.uint64, endpoint=True) | np.uint64(1)
    salt = rng.integers(1, _MASK, BANDS, dtype=np.uint64, endpoint=True)
    return byte_value, power, inverse, blank, step, donor, band, salt


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of ``data``, a piece of at most CHUNK bytes between blanks."""
    byte_value, power, inverse, blank, *_ = _constants()
    a = np.frombuffer(data, dtype=np.uint8)
    gap = blank[a]
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(byte_value[a] * power[: len(a)], out=total[1:])
    value = (total[end] - total[start]) * inverse[start]
    return _mix(value + (end - start).astype(np.uint64))


def _long_words(data: bytes) -> np.ndarray:
    """As :func:`_word_hashes`, for a text of any length."""
    if len(data) <= CHUNK:
        return _word_hashes(data)
    words, out, size, part = data.split(), [], 0, []
    for w in words:
        if size + len(w) + 1 > CHUNK and part:
            out.append(_word_hashes(b" ".join(part)))
            size, part = 0, []
        if len(w) > CHUNK:
            out.append(np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), dtype=np.uint64))
            continue
        part.append(w)
        size += len(w) + 1
    out.append(_word_hashes(b" ".join(part)))
    return np.concatenate(out)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``.

    A-Z are lower-cased. A text of fewer than ``words`` words gives one shingle, its whole sequence;
    one without words, or null, gives none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    h = _long_words(text.encode("utf-8", "surrogatepass").lower())
    step = _constants()[4]
    n = len(h)
    if not n:
        return h
    k = min(n, words)
    s = h[: n - k + 1] * step[0]
    for i in range(1, k):
        s = s + h[i : n - k + 1 + i] * step[i % 16] + np.uint64(i)
    return np.unique(_mix(s + np.uint64(k)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: leading zeros and mantissa bits per bucket.

    An empty bucket takes over the register of the non-empty bucket that a fixed random order of its
    own names first, so that short texts also fill every band.
    """
    donor = _constants()[5]
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.intp)
    least = np.full(REGISTERS, _MASK, dtype=np.uint64)
    np.minimum.at(least, bucket, _mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)))
    full = np.zeros(REGISTERS, dtype=bool)
    full[bucket] = True
    if not full.all():
        have = np.flatnonzero(full)
        lack = np.flatnonzero(~full)
        least[lack] = least[have[donor[np.ix_(lack, have)].argmin(axis=1)]]
    top = least >> np.uint64(11)  # 53 bits, exact as a float
    exponent = np.frexp(top.astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 63).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of compressed registers."""
    *_, band, salt = _constants()
    h = (_mix((regs.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * band)).sum(axis=1, dtype=np.uint64)
    return _mix(h + salt).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, corrected for registers equal by chance.

    Two unrelated minima of buckets with loads x and y fall into one register with a probability of
    about 0.68 * x * y / (x + y)**2 at one mantissa bit less for each halving.
    """
    same = (a == b).mean(axis=1)
    chance = 0.6797 * 2.0**-MANTISSA * (n_a * n_b) / np.square(n_a + n_b)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _sketch(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, key, regs, keys = [], [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), words)
                    n.append(len(s))
                    if len(s):
                        key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        r = registers(s)
                        regs.append(r.tobytes())
                        keys.append(bands(r))
                    else:
                        key.append(None), regs.append(None), keys.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(words: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (4, 5))
            keep = pa.array(estimate(a, b, n_a, n_b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate component of every row: (doc_id, n_shingles, component_id, kept).

    Documents are linked if ``100 * intersection >= percent * union`` of their distinct
    ``words``-word shingles, confirmed on full sets of 64-bit hashes; component_id is the smallest
    doc_id that links reach, and the document that bears it is kept.

    Equal sets are collapsed to the smallest doc_id before banding, and documents that share no band
    key with another end there. Of the others' shingles, those that stand in one document only can
    be in no intersection: their number bounds the similarity of every pair. Within the bucket of a
    band key, members are compared with one leader, at first the one with the smallest share of
    shingles of its own, for STAR_ROUNDS rounds; then members whose components still differ are
    compared with one another where the bound allows a link: those that share a rare shingle meet
    there, and the others' bound leaves rare shingles out. So no link between components is lost,
    while copies are never expanded into all pairs.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id are one node, whatever their texts. A null doc_id is linked with nothing: its component_id is null, kept false.
    No rows give no rows. Other columns are ignored, whatever their names.
    """
    with Scratch(docs.sparkSession, "near-duplicates") as scratch:
        return scratch.keep(_components(docs, words, percent, id_col, text_col, scratch))


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.write(texts.mapInArrow(releasing(_sketch(words)), "doc_id long, n_shingles long, set_key binary, regs binary, bands array<long>"))
    known = sketch.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.write(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = scratch.write(
        known.join(classes, (known["set_key"] == classes["set_key"]) & (known["doc_id"] == classes["rep"]))
        .select("rep", "n_shingles", "regs", "bands")
        .dropDuplicates(["rep", "n_shingles", "regs"])
    )
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key")
    active = scratch.write(buckets.join(shared, "key"))
    wanted = active.select(F.col("rep").alias("doc_id")).distinct()
    full = scratch.write(texts.join(small(wanted), "doc_id", "left_semi").mapInArrow(releasing(_sets(words)), "rep long, shingles array<long>"))
    # Rows that repeat an id give its sets more than once: what is counted of them bounds nothing.
    often = full.groupBy("rep").agg(F.count("*").alias("sets")).where("sets > 1").select("rep")
    lone = (
        full.select("rep", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
        .where("n = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("lone"))
        .join(often, "rep", "left_anti")
    )
    side = scratch.write(reps.join(wanted, reps["rep"] == wanted["doc_id"], "left_semi").join(lone, "rep", "left").select("rep", "n_shingles", "regs", (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("shared")))
    # A set of which less than this can be shared is similar to none.
    sizes = side.where(100 * F.col("shared") >= percent * F.col("n_shingles")).select("rep", F.col("n_shingles").alias("n"), "shared")
    members_of = scratch.write(active.join(sizes, "rep"))

    def may_link(one: str, two: str) -> Column:
        """The bound on the similarity of ``one`` and ``two``, structs of n and shared."""
        both = F.least(F.col(f"{one}.shared"), F.col(f"{two}.shared"))
        return 100 * both >= percent * (F.col(f"{one}.n") + F.col(f"{two}.n") - both)

    def meet(rows: DataFrame, key: str, also: Column | None = None) -> DataFrame:
        """(rep, other) of the members ``m`` of differing components that share a key and may link."""
        one, two = rows.select(key, F.col("m").alias("one")), rows.select(key, F.col("m").alias("two"))
        both = one.join(two, key).where((F.col("one.comp") < F.col("two.comp")) & may_link("one", "two") & (F.lit(True) if also is None else also))
        return both.select(F.col("one.rep").alias("rep"), F.col("two.rep").alias("other"))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that hold on full sets."""
        a, b = (side.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in ("a", "b"))
        likely = scratch.write(
            pairs.join(a, "a")
            .join(b, "b")
            .select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
            .mapInArrow(releasing(_estimated(percent / 100 - SLACK)), "a long, b long")
        )
        x, y = (full.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        similar = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
        return scratch.write(likely.join(x, "a").join(y, "b").where(similar).select("a", "b").distinct())

    # The sets of one id are one node.
    own = known.join(classes, "set_key").select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    found = scratch.write(own.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")))
    comp, tested = None, None
    if not found.isEmpty():
        comp = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    for turn in range(STAR_ROUNDS + 1):
        if comp is None:
            members = members_of.withColumn("comp", F.col("rep"))
        else:
            members = members_of.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        members = members.select("key", F.struct("rep", "comp", "n", "shared").alias("m"))
        rank = F.struct(F.xxhash64("m.rep", F.lit(turn))) if turn else F.struct(-F.col("m.shared") / F.col("m.n"), "m.rep")
        open_keys = (
            members.groupBy("key")
            .agg(F.min("m.comp").alias("lo"), F.max("m.comp").alias("hi"), F.min_by("m", rank).alias("lead"))
            .where("lo < hi")
            .select("key", "lead")
        )
        if turn < STAR_ROUNDS:
            ends = members.join(open_keys, "key").where((F.col("m.comp") != F.col("lead.comp")) & may_link("m", "lead")).select(F.col("m.rep").alias("rep"), F.col("lead.rep").alias("other"))
        else:
            still = scratch.write(members.join(open_keys, "key", "left_semi"))
            tokens = still.select("m").distinct().join(full, F.col("m.rep") == F.col("rep")).select("m", F.explode("shingles").alias("s"))
            few = tokens.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
            rare = scratch.write(tokens.join(few, "s").select("s", "m", "df"))
            # Two that share a rare shingle meet at it; two that share none are bounded without them.
            scarce = rare.groupBy(F.col("m.rep").alias("rep")).agg(F.count("*").alias("scarce")).join(often, "rep", "left_anti")
            keys = still.groupBy(F.col("m.rep").alias("rep")).agg(F.collect_set("key").alias("keys")).join(scarce, "rep", "left")
            lean = still.join(keys, F.col("m.rep") == F.col("rep")).select(
                "key", F.struct("m.rep", "m.comp", "m.n", (F.col("m.n") - F.coalesce("scarce", F.lit(0))).alias("shared"), "keys").alias("m")
            )
            # A pair meets in the least of the keys it shares, once.
            once = F.col("key") == F.array_min(F.array_intersect("one.keys", "two.keys"))
            ends = meet(rare.where("df > 1"), "s").union(meet(lean.where(100 * F.col("m.shared") >= percent * F.col("m.n")), "key", once))
        pairs = ends.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = links(pairs)
        found = found.unionByName(new)
        comp = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    if comp is not None:
        out = out.join(comp, "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with their columns.

    Rows with a null doc_id stay, since nothing says what they duplicate.
    """
    gone_id = absent(docs, "gone_id")[0]
    gone = near_duplicates(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(options.get("id_col", "doc_id")) == F.col(gone_id), "left_anti")
