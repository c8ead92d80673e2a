"""Vector column functions on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import indexes, let
from lectern.functions.text import run_lengths


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def settled(x: Column, places: int = 6) -> Column:
    """Round in two steps, so that a tie at the last place does not depend on the last bit of the sum."""
    return F.round(F.round(x, 10), places)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector keeps its zeros."""

    def scaled(a):
        return let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n == 0.0, 1.0).otherwise(n)))

    return let(as_doubles(v), scaled)


def unit_or_null(v: Column) -> Column:
    """As `unit`, but a vector that is one zero carries no signal and becomes null."""
    return F.when(~((F.size(v) == 1) & (norm(v) == 0.0)), unit(v))


def pad(v: Column, size: Column) -> Column:
    missing = F.greatest(size - F.size(v), F.lit(0))
    return F.concat(as_doubles(v), F.array_repeat(F.lit(0.0), missing))


def with_bigrams(tokens: Column, joiner: str) -> Column:
    """The tokens followed by their adjacent pairs."""
    return let(
        tokens,
        lambda t: F.concat(
            t, F.transform(indexes(F.size(t) - 1), lambda i: F.concat(F.get(t, i), F.lit(joiner), F.get(t, i + 1)))
        ),
    )


def hash_slots(tokens: Column, dim: int) -> Column:
    """Signed slots of unigrams and adjacent bigrams: array<struct<slot, value>>, two entries per feature."""


    def entries(term, tf):
        def of(h):
            sign = F.when(F.conv(F.substring(h, 17, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0) * tf
            slot = lambda start: (F.conv(F.substring(h, start, 8), 16, 10).cast("long") % dim).cast("int")
            return F.array(
                F.struct(slot(1).alias("slot"), sign.alias("value")),
                F.struct(slot(9).alias("slot"), (sign * 0.5).alias("value")),
            )

        return let(F.sha1(term), of)

    counted = run_lengths(with_bigrams(tokens, "__"))
    return F.flatten(F.transform(counted, lambda p: entries(p["term"], p["tf"])))


def hash_embedding(tokens: Column, dim: int = 384) -> Column:
    """Deterministic text vector: slot sums scaled to unit length, all zeros for no tokens.

    The sums run inside the row over the slots in order, so no shuffle is needed.
    """
    ordered = F.sort_array(hash_slots(tokens, dim))
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("acc"), F.lit(0).alias("slot"))

    def step(acc, e):
        gap = e["slot"] - acc["slot"]
        grown = F.concat(acc["out"], F.array(acc["acc"]), F.array_repeat(F.lit(0.0), gap - 1))
        return F.struct(
            F.when(gap > 0, grown).otherwise(acc["out"]).alias("out"),
            F.when(gap > 0, e["value"]).otherwise(acc["acc"] + e["value"]).alias("acc"),
            e["slot"].alias("slot"),
        )

    def finish(acc):
        return unit(F.concat(acc["out"], F.array(acc["acc"]), F.array_repeat(F.lit(0.0), F.lit(dim - 1) - acc["slot"])))

    return F.aggregate(ordered, zero, step, finish)
