"""Step-by-step evaluation of integer equations, as a bounded fold over every row at once. Integers may have any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import integers
from .rewards import _FLOAT, let

_PRODUCT = r"(?s)^(.*?)(\-?\d+)\s*(\*)\s*(\-?\d+)(.*)\z"
_SUM = r"(?s)^(.*?)(\-?\d+)\s*([+\-])\s*(\-?\d+)(.*)\z"
_GROUP = r"(?s)^(.*?)\(([^()]+)\)(.*)\z"
_NUMBER = r"^\s*-?\d+\s*\z"
_MARK = "\u0001"  # between the groups of one match; a control character that no equation holds


def _parts(x: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that covers the whole text, from one match; one part when it does not match."""
    marks = _MARK.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(x, pattern, marks), _MARK, -1)


def _reduce_first(x: Column, pattern: str) -> Column:
    """Replace the leftmost operation of ``pattern`` by its value; null when there is none."""
    return let(_parts(x, pattern, 5), lambda p: F.when(F.size(p) == 5, F.concat(
        F.get(p, F.lit(0)), integers.apply(F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.get(p, F.lit(3))), F.get(p, F.lit(4)))))


def _one_step(x: Column) -> Column:
    """Innermost group first (one operation at a time), then products, then sums; null when nothing applies."""
    def group(s):
        signs = F.regexp_count(s, F.lit(r"[+\-]"))
        partial = let(_reduce_first(s, _SUM), lambda r: F.when(r.isNotNull(), F.concat(F.lit("("), r, F.lit(")"))))
        whole = (F.when(F.rlike(s, F.lit(_NUMBER)), F.trim(s))
                 .otherwise(F.coalesce(_reduce_first(F.trim(s), _PRODUCT), _reduce_first(F.trim(s), _SUM))))
        return F.when(signs > 1, partial).otherwise(whole)

    outside = F.coalesce(_reduce_first(x, _PRODUCT), _reduce_first(x, _SUM))
    return let(_parts(x, _GROUP, 3), lambda p: F.coalesce(
        F.when(F.size(p) == 3, F.concat(F.get(p, F.lit(0)), group(F.get(p, F.lit(1))), F.get(p, F.lit(2)))), outside))


def simplify_steps(equation: Column) -> Column:
    """Every intermediate form of the equation, the equation itself first."""
    def run(start):
        limit = F.regexp_count(start, F.lit(r"[+\-*(]")) * 2
        rounds = F.sequence(F.lit(0), limit)

        # whether a form is the last one is found when it is made; the rounds left over only look at the answer
        first = F.struct(F.array(start).alias("steps"), start.alias("last"), F.rlike(start, F.lit(_FLOAT)).alias("done"))

        def taken(s, nxt):
            return F.when(nxt.isNull(), F.struct(s["steps"].alias("steps"), s["last"].alias("last"), F.lit(True).alias("done"))).otherwise(
                F.struct(F.array_append(s["steps"], nxt).alias("steps"), nxt.alias("last"), F.rlike(nxt, F.lit(_FLOAT)).alias("done")))

        def advance(s, _):
            return F.when(s["done"], s).otherwise(let(_one_step(s["last"]), lambda nxt: taken(s, nxt)))

        return F.aggregate(rounds, first, advance, lambda s: s["steps"])
    return let(F.trim(equation), run)
