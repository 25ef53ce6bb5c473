"""Running totals along an array, in built-in expressions.

Appending to an array in aggregate() copies it each time, so n totals would cost
n * n / 2 copies. Here arrays are cut in blocks, and only a block's own totals and the
totals of blocks are appended one by one: n * BLOCK / 2 + (n / BLOCK)**2 / 2 copies, which
grows as n up to tens of millions of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, LEVELS = 256, 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, levels: int = LEVELS) -> Column:
    """op of zero and all values up to and with each place; values is an array<long>, op associative with zero as its neutral value."""
    none = F.array().cast("array<long>")

    def one_by_one(block: Column, first: Column) -> Column:
        step = lambda acc, v: bound(op(acc["last"], v), lambda x: F.struct(x.alias("last"), F.concat(acc["all"], F.array(x)).alias("all")))
        return F.aggregate(block, F.struct(first.alias("last"), none.alias("all")), step, lambda acc: acc["all"])

    def in_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK)))

        def joined(parts: Column) -> Column:
            totals = running(F.transform(parts, lambda b: F.aggregate(b, zero, op)), op, zero, levels - 1)
            return bound(totals, lambda t: F.flatten(F.transform(parts, lambda b, i: one_by_one(b, F.coalesce(F.get(t, i - 1), zero)))))

        return bound(blocks, joined)

    if not levels:
        return one_by_one(values, zero)
    return bound(values, lambda a: F.when(F.size(a) <= BLOCK, one_by_one(a, zero)).otherwise(in_blocks(a)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0).cast("long"))


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))
