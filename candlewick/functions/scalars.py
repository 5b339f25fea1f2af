"""Scalars on columns, with nulls for what has no value and two-valued comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
EQUAL = 1e-9


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is nearly zero."""
    return F.when(F.abs(b) >= TINY, F.try_divide(a, F.when(F.abs(b) >= TINY, b)))


def quotient(a: Column, b: Column) -> Column:
    """As IEEE 754 has it, unguarded: by zero an infinity of the signs' product, NaN for zero by zero. Comparisons put NaN above every number."""
    infinite = F.when(b.cast("string") == "-0.0", float("-inf")).otherwise(float("inf"))  # comparisons take the two zeros for one
    return F.when(b == 0, a * infinite).otherwise(a / F.when(b != 0, b))


def change(frm: Column, to: Column) -> Column:
    return divide(to - frm, frm) * 100


def yes(c: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(c, F.lit(False))


COMPARE = {
    "Gt": lambda a, b: yes(a > b),
    "Lt": lambda a, b: yes(a < b),
    "Gte": lambda a, b: yes(a >= b),
    "Lte": lambda a, b: yes(a <= b),
    "Eq": lambda a, b: yes(F.abs(a - b) < EQUAL),
}
#: Counts are compared as they are.
COUNTS = COMPARE | {"Eq": lambda a, b: yes(a == b)}


def candle(open_: Column, close: Column) -> Column:
    """U, D or N; a bar without open or close is none."""
    return F.when(close > open_, "U").when(close < open_, "D").when(close == open_, "N")


def is_candle(code: Column, kind: str) -> Column:
    """kind: Up, Down, Neutral or Doji; Any holds for every bar that exists."""
    return code.isNotNull() if kind == "Any" else yes(code == {"Up": "U", "Down": "D"}.get(kind, "N"))


def round2(c: Column) -> Column:
    """To hundredths, halves away from zero, by way of the hundredfold."""
    return F.signum(c) * F.floor(F.abs(c) * 100 + 0.5) / 100


def limit_rate(market: Column, code: Column) -> Column:
    """The day's price limit. 0.30 on market 2, 0.20 for codes from 688, 689, 300 and 301, else 0.10."""
    board = F.substring(F.lpad(code.cast("string"), 6, "0"), 1, 3)
    return F.when(market == 2, 0.30).when(board.isin("688", "689", "300", "301"), 0.20).otherwise(0.10)


def limit_price(before: Column, rate: Column, up: bool = True) -> Column:
    return round2(before * (1 + rate if up else 1 - rate))


def both(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
