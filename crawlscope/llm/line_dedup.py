"""Line dedup: an exact set-similarity join of lines, later matches removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, absent, lower_ascii

#: Words in a token of a line, and the similarity of two lines' token sets in percent.
WORDS, PERCENT = 5, 80
#: Tokens that a line must share with other lines, in a prefix as much longer, to be looked at again.
DEPTH = 3
#: Most bits of the filter that lines pass before they are shuffled, and bits for each wanted line up to that.
FILTER_BITS, BITS_EACH = 1 << 27, 32
#: Classes with more than this share of the lines get their verdict by broadcast; so many at most have it.
HOT_SHARE = 1 / 2000

#: Place of a line, in the order that decides which of two lines is the later one.
PLACE = ["last", "doc_id", "line_no", "row"]
#: How tables of hashes are written: their values hardly repeat, so that a dictionary would be tried in vain.
HASHES = {"parquet.enable.dictionary": "false"}


def _needed(n: Column, percent: int) -> Column:
    """Least size of a set that can be similar to one of ``n`` tokens."""
    return F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)).cast("int")


def _prefix(n: Column, percent: int, depth: int = 1) -> Column:
    """Tokens of a set of ``n`` among which each similar set has ``depth``, in any common order; all at most."""
    return F.least(n, n - _needed(n, percent) + depth)


def _with_tokens(lines: DataFrame, words: int) -> DataFrame:
    """``lines(line, ...)`` with two hashes of its words, ``k1`` and ``k2``, and the sorted set ``tokens``, without the line.

    A line of fewer words is one token. Only a line with other gaps than single spaces is split by
    the pattern. The word hashes are bound once and stay objects while the tokens are made of them.
    """
    rest = [c for c in lines.columns if c != "line"]
    low = F.col("low")
    odd = low.startswith(" ") | low.endswith(" ")
    for gap in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(low, F.lit(gap))
    even = F.when(odd, F.array_join(F.array_remove(F.split(low, BLANKS), ""), " ")).otherwise(low)

    def tokens(w: Column) -> Column:
        last = F.size(w) - words
        token = lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)])
        return F.when(last < 0, F.array(F.xxhash64(w))).otherwise(F.transform(F.slice(w, F.lit(1), last + 1), token))

    hashes = F.transform(F.split(low, " "), lambda x: F.xxhash64(x))
    return (
        lines.withColumn("low", lower_ascii(F.col("line")))
        .select(*rest, even.alias("low"))
        .select(*rest, F.xxhash64("low").alias("k1"), F.xxhash64(F.lit(1), "low").alias("k2"), F.get(F.transform(F.array(hashes), tokens), 0).alias("tokens"))
        .withColumn("tokens", F.sort_array(F.array_distinct("tokens")))
    )


def _split(texts: DataFrame) -> DataFrame:
    """(last, doc_id, row, line_no, line) of all lines of ``texts``."""
    return texts.select("last", "doc_id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(last, doc_id, row, line_no, raw, line) of the lines of ``texts`` that have words; ``raw`` is a hash of the line."""
    return _split(texts).where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("raw", F.xxhash64("line"))


def _may_be_in(lines: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``lines`` whose ``key`` may be in ``wanted(key)``: all that are, and few others.

    BITS_EACH bits or more for each wanted row, in words of 64, so that what is broadcast is bounded: with more
    than FILTER_BITS / BITS_EACH wanted rows only more of the others pass.
    """
    bits = min(FILTER_BITS, 1 << max(6, (BITS_EACH * wanted.count()).bit_length()))
    at = F.xxhash64(*key)
    word, bit = F.shiftright(at.bitwiseAND(F.lit(bits - 1)), 6), F.shiftright(at, 32).bitwiseAND(F.lit(63)).cast("int")
    words = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    among = lines.withColumn("word", word).join(F.broadcast(words), "word")
    return among.where(F.call_function("shiftright", "bits", bit).bitwiseAND(F.lit(1).cast("long")) == 1).drop("word", "bits")


def line_parts(lines: DataFrame, words: int, percent: int) -> DataFrame:
    """(place, raw, k1, k2, least, prefix) of each line: two hashes of its words and the first tokens by their hashes.

    A line that is similar to another shares ``least`` tokens of its prefix with it.
    """
    n = F.size("tokens")
    return _with_tokens(lines, words).select(
        *PLACE, "raw", "k1", "k2", F.least(_needed(n, percent), F.lit(DEPTH)).alias("least"), F.slice("tokens", F.lit(1), _prefix(n, percent, DEPTH)).alias("prefix")
    )


def _with_partner(parts: DataFrame) -> DataFrame:
    """(k1, shared) of the lines whose prefix has ``shared`` tokens that stand in other lines' prefixes.

    A window and not a join with the counts: Spark doesn't share an exchange between the two sides.
    """
    every = Window.partitionBy("token")
    dealt = parts.select(F.explode("prefix").alias("token"), "k1")
    common = dealt.select("token", "k1", F.min("k1").over(every).alias("x"), F.max("k1").over(every).alias("y")).where("x < y")
    return common.select("token", "k1").distinct().groupBy("k1").agg(F.count("*").alias("shared"))


def _ranked(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, tokens) of the lines of ``sets(id, tokens)`` that can be similar to another, rarest token first.

    ``n`` is the size of the whole set; ``tokens`` are those that another line has too, in order of
    the number of lines that have them. The others are in no intersection: a line of which too few
    are left is similar to none. Tokens are shuffled once.
    """
    every = Window.partitionBy("token")
    dealt = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = dealt.select("id", "n", "token", F.count("*").over(every).alias("df"), F.min("id").over(every).alias("x"), F.max("id").over(every).alias("z")).where("x < z")
    # A set because a repeated row may have given a line twice.
    ranked = common.groupBy("id", "n").agg(F.transform(F.sort_array(F.collect_set(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    return ranked.where(F.size("tokens") >= _needed(F.col("n"), percent))


def _linked(percent: int) -> Column:
    """Whether the profiles ``a`` and ``b`` of :func:`line_links`, met at a token of both prefixes, are similar, and first meet there.

    The filters on length and position come first, then whether the two have met before: alike ones meet at
    many tokens, and their whole sets are compared once.
    """
    n_a, n_b = F.col("a.n"), F.col("b.n")
    # Of sets of n and m tokens, similar ones share at least percent / (100 + percent) * (n + m).
    least = F.ceil(percent * (n_a + n_b) / F.lit(100.0 + percent) - F.lit(1e-9))
    near = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.least("a.rest", "b.rest") + F.least("a.pos", "b.pos") >= least)
    similar = (100 + percent) * F.size(F.array_intersect("a.tokens", "b.tokens")) >= percent * (n_a + n_b)
    # Alike sets mostly share the token just before too, which spares looking at all before.
    before = [F.slice(f"{x}.tokens", F.lit(1), F.col(f"{x}.pos") - 1) for x in "ab"]
    ahead = (F.get("a.tokens", F.col("a.pos") - 2) == F.get("b.tokens", F.col("b.pos") - 2)) | F.arrays_overlap(*before)
    return F.when(near, F.when((F.least("a.pos", "b.pos") > 1) & ahead, False).otherwise(similar)).otherwise(False)


def line_links(sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(id, n_links, earlier) of each line of ``sets(id, tokens)`` that is similar to others: their number and the smallest id below its own.

    Lines that have as many tokens, and the same of them in common with other lines, are alike in all
    intersections. They make one profile, named by its smallest id, and are counted, not paired.
    Every two profiles that have a token of their prefixes in common meet there, and the sets decide
    within the join: only similar pairs leave it, at the first such token. No link is lost.
    """
    alike = Window.partitionBy("n", "tokens")
    ranked = scratch.write(_ranked(sets, percent).select("*", F.min("id").over(alike).alias("profile"), F.count("*").over(alike).alias("lines")))
    size = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), size - _needed(F.col("n"), percent) + 1)
    index = ranked.where("id = profile").select("profile", "lines", "n", "tokens", size.alias("size"), F.posexplode(prefix).alias("i", "token"))
    index = index.select("token", "profile", "lines", "n", "tokens", (F.col("i") + 1).alias("pos"), (F.col("size") - F.col("i") - 1).alias("rest"))
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.profile") < F.col("b.profile")) & _linked(percent))
    ends = [F.struct(F.col(f"{x}.profile").alias("profile"), F.col(f"{y}.profile").alias("other"), F.col(f"{y}.lines").alias("lines")) for x, y in ("ab", "ba")]
    met = scratch.write(pairs.select(F.inline(F.array(*ends))).groupBy("profile").agg(F.sum("lines").alias("others"), F.min("other").alias("other")))
    # Lines of one profile share all its tokens.
    own = (100 + percent) * size >= percent * 2 * F.col("n")
    lines = ranked.select("id", "profile", F.when(own, F.col("lines") - 1).otherwise(0).alias("same"), F.when(own, F.col("profile")).alias("first"))
    both = lines.join(met, "profile", "left").withColumn("earlier", F.least("first", "other"))
    n_links = F.col("same") + F.coalesce("others", F.lit(0))
    return scratch.write(both.select("id", n_links.alias("n_links"), F.when(F.col("earlier") < F.col("id"), F.col("earlier")).alias("earlier")).where("n_links > 0"))


def judge_lines(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on every line that has words: (doc_id, line_no, class_doc, class_line, similar_doc, similar_line, n_links, removed).

    Lines are parts between ``\\n``, numbered from 0; their tokens are ``words``-word shingles with
    A-Z lower-cased. Lines of equal words are one class, named by its first line in order of doc_id
    and line_no. ``n_links`` is the number of other classes that the class is similar to (100 *
    intersection >= percent * union), earlier and later ones; ``similar_doc`` and ``similar_line``
    name the first of them, null if it isn't an earlier one. A line is removed if it isn't the first
    of its class, or if its class has an earlier similar one.

    Null, empty and blank texts have no such lines. Lines of a null doc_id come last in the order.
    Rows that repeat a doc_id follow one another in order of their row; equal places are ties that
    the row's number in the input breaks. No rows give no rows. Other columns are ignored, whatever
    their names.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(texts, words, percent).drop("row")


def _judged(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The verdicts of :func:`judge_lines` on ``texts(row, doc_id, text)``, with their ``row``."""
    with Scratch(texts.sparkSession, "line-dedup") as scratch:
        texts = texts.withColumn("last", F.col("doc_id").isNull())
        parts = scratch.write(line_parts(lines_of(texts), words, percent), **HASHES)
        lines = parts.select(F.struct(*PLACE, "raw").alias("at"), "k1", "k2", "least")
        classes = scratch.write(lines.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("size"), F.max("least").alias("least")), **HASHES)
        # Ids in the order of the lines' places: the smaller is the earlier.
        able = scratch.write(classes.join(_with_partner(parts).hint("shuffle_hash"), "k1").where("shared >= least").select("k1", "k2", "first"), **HASHES)
        known = scratch.write(able.orderBy("first").withColumn("id", F.monotonically_increasing_id()), **HASHES)
        # The first line of each class again, by its place and content: a repeated row may give it twice.
        place = ["doc_id", "line_no", "raw"]
        wanted = known.select("id", *[F.col(f"first.{c}").alias(f"first_{c}") for c in place])
        spots = known.select("first.doc_id", "first.line_no")
        met = _may_be_in(_split(texts).select("doc_id", "line_no", "line"), spots, spots.columns).withColumn("raw", F.xxhash64("line")).join(wanted.hint("shuffle_hash"), [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in place])
        sets = scratch.write(_with_tokens(met.select("id", "line"), words).select("id", "tokens"), **HASHES)
        found = line_links(sets, scratch, percent)
        earlier = known.select(F.col("id").alias("earlier"), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")).alias("similar"))
        linked = scratch.write(found.join(earlier, "earlier", "left").select("id", "n_links", "similar").join(known, "id").select("k1", "k2", "n_links", "similar"))
        # Lines of a class that is most of the corpus don't meet in one task.
        many = F.col("size") > F.lit(HOT_SHARE * lines.count())
        hot = scratch.write(classes.where(many).drop("size", "least").join(linked, ["k1", "k2"], "left"))
        # A line that is alone in its class is its first.
        rest = classes.where(~many & (F.col("size") > 1)).drop("size", "least")
        told = lines.drop("least").join(F.broadcast(hot), ["k1", "k2"]).unionByName(
            lines.drop("least").join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(rest.hint("shuffle_hash"), ["k1", "k2"], "left").withColumn("first", F.coalesce("first", "at")).join(linked.hint("shuffle_hash"), ["k1", "k2"], "left")
        )
        return scratch.keep(
            told.select(
                F.col("at.row").alias("row"),
                F.col("at.doc_id").alias("doc_id"),
                F.col("at.line_no").cast("long").alias("line_no"),
                F.col("first.doc_id").alias("class_doc"),
                F.col("first.line_no").cast("long").alias("class_line"),
                F.col("similar.doc_id").alias("similar_doc"),
                F.col("similar.line_no").cast("long").alias("similar_line"),
                F.coalesce("n_links", F.lit(0)).alias("n_links"),
                ((F.col("at") != F.col("first")) | F.col("similar").isNotNull()).alias("removed"),
            )
        )


def dedup_lines(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` freed of the lines that :func:`judge_lines` removes.

    Blank lines stay, and so do texts of which nothing is left, as empty ones. Null texts stay null,
    and rows with a null doc_id stay as they are. Rows that repeat a doc_id lose their own lines only.
    The columns keep their names and order, whatever they are.
    """
    row, gone = absent(docs, "row", "gone")
    with Scratch(docs.sparkSession, "line-dedup") as scratch:
        rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()))
        texts = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        lost = _judged(texts, words, percent).where("removed AND doc_id IS NOT NULL").groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
        kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n")
        cleaned = rows.join(lost, row, "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept))
        return scratch.keep(cleaned.select(docs.columns))
