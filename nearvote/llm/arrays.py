"""Array expressions whose cost follows the array: running totals, and stretches of a text. An array that grows by
one value copies itself, and a place in a text is found from its start; so both work on pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that a running total takes in one piece, and how often pieces are cut into pieces.
CHUNK, DEPTH = 64, 2
#: Code points of the pieces of a text.
PIECE = 1024


def running(values: Column, op, zero: int, depth: int = DEPTH) -> Column:
    """By place, `op` (associative, `zero` changes nothing) over all longs before it. Values are taken in pieces of
    CHUNK, as an array that grows by one value copies itself each time."""

    def plain(a: Column) -> Column:
        start = F.struct(F.lit(zero).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    if not depth:
        return plain(values)["out"]

    def joined(parts: Column) -> Column:
        bases = running(F.transform(parts, lambda p: p["at"]), op, zero, depth - 1)
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["out"], lambda y: op(base, y))))

    def cut(a: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / CHUNK).cast("int"))
        return once(F.transform(pieces, lambda i: plain(F.slice(a, i * CHUNK + 1, F.lit(CHUNK)))), joined)

    return once(values, cut)


def once(value: Column, use) -> Column:
    """use(value), for which the value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stretches(text: Column, ranges: Column) -> Column:
    """The stretches (start, length) of a text, in code points, as an array of strings."""

    def take(pieces: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        numbers = F.sequence(F.floor(x["start"] / PIECE).cast("int"), F.floor(F.greatest(end - 1, x["start"]) / PIECE).cast("int"))
        part = lambda i: F.substr(F.coalesce(F.get(pieces, i), F.lit("")), (F.greatest(x["start"] - i * PIECE, F.lit(0)) + 1).cast("int"), F.greatest(F.least(end, (i + 1) * PIECE) - F.greatest(x["start"], i * PIECE), F.lit(0)).cast("int"))
        return F.array_join(F.transform(numbers, part), "")

    return once(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), lambda pieces: F.transform(ranges, lambda x: take(pieces, x)))
