"""Exact addition, subtraction and multiplication of integers of any length, written as decimal text.

Short numbers go through 64-bit arithmetic. Longer ones become arrays of limbs of six digits, least first: products of
two limbs leave room for millions of them in 64 bits, so one pass of carries at the end is enough.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewards import let, let_each

WIDTH = 6
BASE = 10**WIDTH
#: Digits up to which 64 bits hold any sum of two numbers, and digits of both factors for their product.
SHORT = 18


def magnitude(number: Column) -> Column:
    """The digits without sign and leading zeros; zero is "0"."""
    return let(F.regexp_replace(number, r"^\s*[+-]?0*", ""), lambda d: F.when(d == "", "0").otherwise(d))


def limbs(digits: Column) -> Column:
    def cut(padded):
        places = F.sequence(F.lit(0), (F.length(padded) / WIDTH).cast("int") - 1)
        return F.transform(places, lambda i: F.substring(padded, F.length(padded) - WIDTH * (i + 1) + 1, F.lit(WIDTH)).cast("bigint"))
    return let(F.lpad(digits, (F.ceil(F.length(digits) / WIDTH) * WIDTH).cast("int"), F.lit("0")), cut)


def digits_of(parts: Column) -> Column:
    """Carries every limb below the base and writes the number."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("carry"))

    def step(acc, limb):
        return let(limb + acc["carry"], lambda t: let(F.pmod(t, F.lit(BASE)), lambda low: F.struct(
            F.concat(F.lpad(low.cast("string"), WIDTH, "0"), acc["text"]).alias("text"), ((t - low) / BASE).cast("bigint").alias("carry"))))

    return magnitude(F.aggregate(parts, start, step, lambda acc: F.concat(acc["carry"].cast("string"), acc["text"])))


def _limb(a: Column, i: Column) -> Column:
    return F.coalesce(F.get(a, i), F.lit(0).cast("bigint"))


def _limbwise(a: Column, b: Column, sign: int) -> Column:
    """Limbs of a + b or, for a at least b, a - b."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), lambda i: _limb(a, i) + sign * _limb(b, i))


def _times(a: Column, b: Column) -> Column:
    """Every output limb as the sum of its products."""
    def output(k):
        first, last = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
        return F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda total, i: total + F.get(a, i) * F.get(b, k - i))
    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), output)


def _signed(negative: Column, digits: Column) -> Column:
    return F.when(negative & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def _long(a: Column, op: Column, b: Column) -> Column:
    minus_a, minus_b = F.startswith(F.trim(a), F.lit("-")), F.startswith(F.trim(b), F.lit("-"))
    other = F.when(op == "-", ~minus_b).otherwise(minus_b)

    def worked(x, y):
        behind = (F.length(x) < F.length(y)) | ((F.length(x) == F.length(y)) & (x < y))

        def combined(p, q):
            product = _signed(minus_a != minus_b, digits_of(_times(p, q)))
            added = _signed(minus_a, digits_of(_limbwise(p, q, 1)))
            taken = F.when(behind, _signed(other, digits_of(_limbwise(q, p, -1)))).otherwise(_signed(minus_a, digits_of(_limbwise(p, q, -1))))
            return F.when(op == "*", product).when(minus_a == other, added).otherwise(taken)
        return let_each(limbs, x, y, combined)

    return let_each(magnitude, a, b, worked)


def apply(a: Column, op: Column, b: Column) -> Column:
    """``a op b`` as text for op ``*``, ``+`` or ``-`` (anything else counts as ``-``), whatever the length of the numbers."""
    def short(v):
        x, y = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        return F.when(op == "*", x * y).when(op == "+", x + y).otherwise(x - y).cast("string")

    room = F.when(op == "*", F.length(a) + F.length(b)).otherwise(F.greatest(F.length(a), F.length(b)))
    return F.when(room <= SHORT, let(F.array(a.try_cast("bigint"), b.try_cast("bigint")), short)).otherwise(_long(a, op, b))
