"""Secret scans: key patterns, and strings that a character Markov model calls random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pattern, group whose length counts, and its least length, by kind.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    # Only runs of 32 or more can hold; a run is always taken whole.
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
}
METHOD = "random"
ORDER = [*KINDS, METHOD]

#: Strings that the models judge: 16 or more characters of keys and tokens, a letter and a digit among them.
#: An equals sign before them assigns them; behind them it is base64 padding if no value follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+"
#: What the model of ordinary identifiers learns from.
IDENTIFIER = r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]{7,}+"
#: Bounds on the labelled sample: secrets, and documents that give identifiers, by hash order.
SAMPLE_SECRETS, SAMPLE_DOCS = 20_000, 500
#: Least log-likelihood ratio a transition, in nats: between the identifiers' and the random strings' means.
LEAST_RATIO = 1.0
#: Characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Weight of a follower's own frequency in its transition probabilities, in counts.
BACKOFF = 8.0


def _pieces(text: Column, pattern: str, group: int, kind: str) -> Column:
    """(kind, i, before, size, value): matches with the code points between them, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("b"), found.alias("m"), value.alias("v"))
    return F.when(
        text.rlike(pattern),
        F.transform(
            rows,
            lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x.getField("b")).alias("before"), F.length(x.getField("m")).alias("size"), x.getField("v").alias("value")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,i:int,before:int,size:int,value:string>>"))


def _bigrams(df: DataFrame, value: str) -> DataFrame:
    """``df`` exploded to the transitions of ``value``, the start included."""
    padded = F.concat(F.lit("^"), F.col(value))
    return df.withColumn("bigram", F.explode(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(padded, i, F.lit(2)))))


def train(samples: DataFrame) -> DataFrame:
    """(bigram, ratio) from ``samples(value, label)``: label 1 for random strings, 0 for identifiers.

    First-order transitions, smoothed by BACKOFF counts of the follower's own frequency, so that what
    identifiers never hold counts against them after any character; the ratio is the difference of
    the two log-probabilities. The table has a row for each pair of ALPHABET, whatever the corpus.
    """
    n = _bigrams(samples.where("value IS NOT NULL AND value <> ''"), "value").groupBy("bigram").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    of = lambda chars: F.explode(F.array(*[F.lit(c) for c in chars]))
    grid = samples.sparkSession.range(1).select(of("^" + ALPHABET).alias("a")).select("a", of(ALPHABET).alias("b")).withColumn("bigram", F.concat("a", "b"))
    seen = grid.join(n, "bigram", "left").na.fill(0, ["n1", "n0"])
    after, whole = Window.partitionBy("a"), Window.partitionBy(F.lit(0))

    def p(c: str) -> Column:
        own = (F.sum(c).over(Window.partitionBy("b")) + 0.5) / (F.sum(c).over(whole) + 0.5 * len(ALPHABET))
        return F.log((F.col(c) + BACKOFF * own) / (F.sum(c).over(after) + BACKOFF))

    return seen.select("bigram", (p("n1") - p("n0")).alias("ratio"))


def scan_secrets(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    Base spans are the leftmost non-overlapping matches of each kind that are long enough. The method
    adds spans of kind ``random``: candidates that overlap no base span and whose mean
    log-likelihood ratio under the two Markov models (``model``, default :func:`train` on the base
    values against identifiers of a bounded sample of documents) is at least LEAST_RATIO. Spans are
    kind:start:end in code points, ordered by start and kind and comma-joined.

    A null text is empty: no spans, an empty string, and the digest of an empty string. Repeated
    rows and null ids each get their row. No rows give no rows. Other columns are ignored, whatever
    their names.
    """
    with Scratch(docs.sparkSession, "secrets") as scratch:
        text = F.coalesce(F.col(text_col), F.lit(""))
        pieces = [_pieces(F.col("text"), pattern, group, kind) for kind, (pattern, group, _) in KINDS.items()] + [_pieces(F.col("text"), CANDIDATE, 0, METHOD)]
        rows = scratch.write(
            docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("row", "doc_id", F.concat(*pieces).alias("pieces"))
        )
        so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        least = F.create_map(*[x for k, (_, _, n) in KINDS.items() for x in (F.lit(k), F.lit(n))])
        matches = scratch.write(
            rows.select("row", F.explode("pieces").alias("p"))
            .select("row", "p.*")
            .withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far))
            .withColumn("start", F.col("end") - F.col("size"))
            .where((F.col("kind") == METHOD) | (F.length("value") >= F.element_at(least, F.col("kind"))))
            .select("row", "kind", "start", "end", "value")
        )
        base = matches.where(F.col("kind") != METHOD)
        if model is None:
            secrets = base.select("value", F.xxhash64("row", "start").alias("h")).orderBy("h").limit(SAMPLE_SECRETS).select("value", F.lit(1).alias("label"))
            some = docs.select(text.alias("text"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("d"))
            cut = some.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
            rest = F.col("text")
            for pattern, _, _ in KINDS.values():
                rest = F.regexp_replace(rest, pattern, " ")
            names = some.where(F.col("h") <= F.lit(cut)).select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("value"), F.lit(0).alias("label"))
            # Long strings with digits and both cases may be secrets themselves: their label is not sure.
            unsure = (F.length("value") >= 16) & F.col("value").rlike(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")
            model = scratch.write(train(secrets.unionByName(names.where(~unsure))))
        sides = F.collect_list(F.struct("start", "end"))
        taken = base.groupBy("row").agg(sides.alias("taken"))
        free = (
            matches.where(F.col("kind") == METHOD)
            .join(taken, "row", "left")
            .where(~F.coalesce(F.exists("taken", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), F.lit(False)))
            .drop("taken")
        )
        added = (
            _bigrams(free, "value")
            .join(model, "bigram", "left")
            .groupBy("row", "kind", "start", "end")
            .agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("ratio"))
            .where(F.col("ratio") >= LEAST_RATIO)
            .select("row", "kind", "start", "end")
        )
        place = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
        span = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "end").alias("span"))
        spans = (
            base.select("row", "kind", "start", "end")
            .unionByName(added)
            .groupBy("row")
            .agg(
                *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
                F.array_sort(F.collect_list(F.when(F.col("kind") != METHOD, span))).alias("base"),
                F.array_sort(F.collect_list(span)).alias("every"),
            )
        )
        joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["span"]), ","), F.lit(""))
        return scratch.keep(
            rows.select("row", "doc_id")
            .join(spans, "row", "left")
            .select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"))
        )
