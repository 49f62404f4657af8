"""Internationalised host names in their ASCII form, by the Bootstring algorithm of RFC 3492."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parameters of Punycode.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Characters that end a label as a full stop does.
STOPS = "。．｡"
#: Labels with more characters, which no name server takes, stay as they are.
LONGEST = 255


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def _number(delta: Column, bias: Column) -> Column:
    """``delta`` as a number of variable length; its digits' thresholds depend on ``bias``."""
    start = F.struct(delta.alias("left"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, j: Column) -> Column:
        def at(t: Column) -> Column:
            over = acc["left"] - t
            digit = t + F.when(over < 0, over).otherwise(over % (BASE - t))
            return F.struct(_div(over, BASE - t).alias("left"), F.concat(acc["out"], F.substring(F.lit(DIGITS), digit + 1, F.lit(1))).alias("out"), (over < 0).alias("done"))

        return F.when(acc["done"], acc).otherwise(_let(F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), BASE * j - bias)), at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step, lambda acc: acc["out"])


def _adapted(delta: Column, length: Column, first: Column) -> Column:
    """The bias after ``delta`` in a label that now has ``length`` characters."""
    halved = _div(delta, F.when(first, F.lit(DAMP)).otherwise(F.lit(2)))
    bound = (BASE - T_MIN) * T_MAX // 2

    def step(acc: Column, _: Column) -> Column:
        big = acc["d"] > bound
        return F.struct(F.when(big, _div(acc["d"], BASE - T_MIN)).otherwise(acc["d"]).alias("d"), (acc["k"] + F.when(big, F.lit(BASE)).otherwise(F.lit(0))).alias("k"))

    start = _let(halved, lambda h: F.struct((h + _div(h, length)).alias("d"), F.lit(0).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda acc: acc["k"] + _div(BASE * acc["d"], acc["d"] + SKEW))


def _encoded(label: Column) -> Column:
    """A label with characters beyond ASCII as ``xn--`` and its Bootstring form.

    The characters beyond ASCII are put in by rising code point, then place; ``at`` is the place of
    one among those that stand there already. A delta is the distance between two such states.
    """

    def of(codes: Column) -> Column:
        plain = F.filter(codes, lambda c: c < FIRST)
        put = F.sort_array(
            F.filter(
                F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("i"), F.size(F.filter(F.slice(codes, F.lit(1), i), lambda x: x <= c)).alias("at"))),
                lambda s: s["code"] >= FIRST,
            )
        )
        start = F.struct(F.lit("").alias("out"), F.lit(FIRST).alias("code"), F.lit(0).alias("at"), F.lit(BIAS).alias("bias"), F.size(plain).alias("n"))

        def step(acc: Column, s: Column) -> Column:
            delta = (s["code"] - acc["code"]) * (acc["n"] + 1) + s["at"] - acc["at"]
            return _let(delta, lambda d: F.struct(
                F.concat(acc["out"], _number(d, acc["bias"])).alias("out"),
                s["code"].alias("code"),
                (s["at"] + 1).alias("at"),
                _adapted(d, acc["n"] + 1, acc["n"] == F.size(plain)).alias("bias"),
                (acc["n"] + 1).alias("n"),
            ))

        basic = F.array_join(F.transform(plain, lambda c: F.chr(c)), "")
        return F.concat(F.lit("xn--"), basic, F.when(F.size(plain) > 0, "-").otherwise(""), F.aggregate(put, start, step, lambda acc: acc["out"]))

    return _let(F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), F.ascii), of)


def ascii_host(host: Column) -> Column:
    """``host`` lower-cased, its labels with characters beyond ASCII in their ASCII form.

    Characters aren't composed or otherwise mapped before, and labels of more than LONGEST characters
    stay as they are. Null stays null.
    """

    def label(x: Column) -> Column:
        foreign = (F.octet_length(x) > F.char_length(x)) & (F.char_length(x) <= LONGEST)
        return F.when(foreign, _encoded(x)).otherwise(x)

    def of(low: Column) -> Column:
        labels = F.split(F.translate(low, STOPS, "." * len(STOPS)), r"\.")
        return F.when(F.octet_length(low) > F.char_length(low), F.array_join(F.transform(labels, label), ".")).otherwise(low)

    return _let(F.lower(host), of)
