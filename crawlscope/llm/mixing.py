"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

DIMS = ("source", "lang", "topic")
#: Value of a null source, language or topic in cells and marginals.
MISSING = "(missing)"
#: Default targets flatten the corpus: shares in proportion to tokens to this power.
FLATTEN = 0.9
ROUNDS, TOLERANCE = 30, 1e-4

#: Topics by the first pattern that a text has; else general.
TOPICS = (
    ("legal", r"(?i)\blicen[sc]e"),
    ("code", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]"),
    ("contact", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]"),
)
GENERAL = "general"


def topic_of(text: Column) -> Column:
    """Topic tag of a text by TOPICS; null texts are general."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in TOPICS], F.lit(GENERAL))


def n_tokens(text: Column) -> Column:
    """Words between blanks of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def flat_targets(cells: DataFrame, power: float = FLATTEN) -> dict[str, DataFrame]:
    """Target shares (value, share) of each dimension from the cells' own tokens."""
    out = {}
    for dim in DIMS:
        marginal = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("goal")).where("goal > 0")
        total = marginal.agg(F.sum("goal")).first()[0]
        out[dim] = marginal.select("value", (F.col("goal") / F.lit(total or 1.0)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``factor``: tokens * factor meets the marginals.

    ``targets`` gives (value, share) for each dimension; shares are taken relative to those of the
    values that have tokens, and a value without a target gets factor 0. Each round rakes to one
    marginal after another and is written, which cuts the lineage; raking ends when no marginal is
    off by more than ``tolerance`` of its target, or after ``rounds`` (as where zero cells make the
    targets contradict each other; the last marginal then holds exactly, and a warning tells how far
    the others are off). All is done on cells, so
    the work of a round does not depend on the number of documents.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for dim in DIMS:
        present = cells.where("tokens > 0").select(F.col(dim).alias("value")).distinct()
        goal = scratch.write(targets[dim].where("share > 0").join(present, "value", "left_semi"))
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        goals[dim] = goal.select(F.col("value").alias(dim), (F.col("share") / F.lit(whole) * F.lit(float(total))).alias("goal"))
    out = scratch.write(cells.withColumn("factor", F.lit(1.0)))
    for _ in range(rounds):
        last = out
        for dim in DIMS:
            now = out.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"))
            step = now.join(goals[dim], dim, "left").select(dim, F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("step"))
            out = out.join(step, dim).withColumn("factor", F.col("factor") * F.col("step")).drop("step")
        out = scratch.write(out.select(*DIMS, "tokens", "factor"))
        scratch.drop(last)
        off = reduce(
            DataFrame.union,
            [
                out.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now")).join(goals[dim], dim).select((F.abs(F.col("now") - F.col("goal")) / F.col("goal")).alias("off"))
                for dim in DIMS[:-1]
            ],
        )
        residual = off.agg(F.max("off")).first()[0] or 0.0
        if residual <= tolerance:
            break
    else:
        if rounds:
            warnings.warn(f"raking is off by {residual:.2g} of a target after {rounds} rounds", stacklevel=2)
    return out


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Calibrated sampling of every row of ``docs(doc_id, text, source, lang, ...)``.

    Returns (doc_id, source, lang, topic, n_tokens, factor, probability, kept). Token counts by
    (source, lang, topic) are raked to ``targets`` (default :func:`flat_targets`); a document is kept
    with the factor of its cell over the largest factor of a cell with tokens, decided by a hash of
    its id, so that the kept tokens are expected to have the target shares and a rerun decides alike.

    Null source, lang or topic is a value of its own, ``(missing)``. Null and blank texts have no
    tokens; they share their cell's probability, 1 where no document of the cell has a token. Rows
    that repeat a doc_id share the hash; that of a null doc_id is of its text. No rows give no rows.
    Other columns are ignored, whatever their names.
    """
    with Scratch(docs.sparkSession, "mixing") as scratch:
        facts = scratch.write(docs.select(*_facts(topic, id_col, text_col)))
        return scratch.keep(_decided(facts, _chances(facts, targets, scratch), seed).select("doc_id", *DIMS, "n_tokens", "factor", "probability", "kept"))


def _facts(topic: Column | None, id_col: str, text_col: str) -> list[Column]:
    """What decides on a row: its cell, tokens and hashes."""
    text = F.col(text_col)
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in DIMS[:2]],
        F.coalesce(topic_of(text) if topic is None else topic, F.lit(MISSING)).alias("topic"),
        n_tokens(text).alias("n_tokens"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("text_hash"),
    ]


def _chances(facts: DataFrame, targets: dict[str, DataFrame] | None, scratch: Scratch) -> DataFrame:
    """(source, lang, topic, factor, probability) of each cell of ``facts``."""
    cells = scratch.write(facts.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, flat_targets(cells) if targets is None else targets, scratch)
    top = raked.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    probability = F.when(F.col("tokens") > 0, F.col("factor") / F.lit(top)).otherwise(1.0)
    return raked.select(*DIMS, "factor", probability.alias("probability"))


def _decided(facts: DataFrame, chances: DataFrame, seed: int) -> DataFrame:
    """``facts`` with (factor, probability, kept)."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.lit("text"), "text_hash")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    draw = F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53))
    return facts.join(small(chances), list(DIMS)).withColumn("kept", draw < F.col("probability"))


def sample_to_targets(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with their columns.

    Each row is written once beside what decides on it, so that texts are matched against once and
    shuffled only where there are too many cells to broadcast. Repeated rows are kept or dropped
    alike; those of one id with different cells each by their own.
    """
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    with Scratch(docs.sparkSession, "mixing") as scratch:
        facts = scratch.keep(docs.select(row.alias("row"), *_facts(topic, id_col, text_col)))
        chances = scratch.keep(_chances(facts, targets, scratch))
        return _decided(facts, chances, seed).where("kept").select("row.*")
