"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in ``doc_id`` order, the numbers go through a keyed
permutation of exactly [0, n), and the permuted place gives the shard (its
remainder) and the slot (its quotient). Shards hold equal counts of rows, at
most one apart. Whoever knows n and the seed can compute the place of a row,
or with ``row_at`` the row of a place, without reading data.

Only DataFrame functions run on the main path.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import numbered

#: Modulus of the round function; halves stay below it, products below 2**62.
PRIME = 2_147_483_647
ROUNDS = 4


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """A multiplier and two addends below PRIME for each round, from the seed."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            x = (x * 48_271 + 11) % PRIME
            three.append(x or 1)
        keys.append(tuple(three))
    return keys


def sides(n: int) -> tuple[int, int]:
    """The two moduli: a * b is at least n and exceeds it by less than a."""
    a = max(2, isqrt(max(n, 1) - 1) + 1)
    return a, max(2, -(-n // a))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _mixed(half: Column, key: tuple[int, int, int]) -> Column:
    k, c, d = (F.lit(x).cast("long") for x in key)
    p = F.lit(PRIME).cast("long")
    return _let((half * k + c) % p, lambda t: _let((t * t + d) % p, lambda u: (u * u + t) % p))


def _pass(pair: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of [0, a * b), on a struct of both halves."""
    for i, key in enumerate(round_keys(seed)):
        pair = _let(pair, _round(F.lit(b if i % 2 else a).cast("long"), key))
    return pair


def _round(side: Column, key: tuple[int, int, int]):
    return lambda s: F.struct(s["r"].alias("l"), ((s["l"] + _mixed(s["r"], key)) % side).alias("r"))


def permuted(row: str, n: int, seed: int) -> Column:
    """The place in [0, n) of the row number in column ``row``.

    A first pass may land outside [0, n), in fewer than a of the a * b
    places; such a row walks on along its cycle. A walk meets only places
    outside before it returns, so as many steps as there are such places
    always suffice, and only the rows concerned take them.
    """
    a, b = sides(n)
    number = lambda s: s["l"] + s["r"] * F.lit(a).cast("long")
    start = F.struct(
        F.expr(f"cast({row} % {a} as bigint)").alias("l"), F.expr(f"cast({row} div {a} as bigint)").alias("r")
    )
    if a * b == n:
        return _let(_pass(start, a, b, seed), number)
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    walk = lambda first: F.aggregate(
        steps, first, lambda s, _: F.when(number(s) < n, s).otherwise(_pass(s, a, b, seed))
    )
    return _let(_pass(start, a, b, seed), lambda s: F.when(number(s) < n, number(s)).otherwise(number(walk(s))))


def place_of(row: int, n: int, seed: int) -> int:
    """``permuted`` for one number, on the driver."""
    a, b = sides(n)
    x = row
    while True:
        left, right = x % a, x // a
        for i, (k, c, d) in enumerate(round_keys(seed)):
            t = (right * k + c) % PRIME
            u = (t * t + d) % PRIME
            left, right = right, (left + (u * u + t) % PRIME) % (b if i % 2 else a)
        x = left + right * a
        if x < n:
            return x


def row_at(place: int, n: int, seed: int) -> int:
    """The row number that ``place_of`` sends to ``place``."""
    a, b = sides(n)
    x = place
    while True:
        left, right = x % a, x // a
        for i, (k, c, d) in reversed(list(enumerate(round_keys(seed)))):
            t = (left * k + c) % PRIME
            u = (t * t + d) % PRIME
            left, right = (right - (u * u + t) % PRIME) % (b if i % 2 else a), left
        x = left + right * a
        if x < n:
            return x


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20_240_607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row``.
    ``size`` is the text's UTF-8 bytes plus 8 and a null text counts as empty.
    Rows are numbered by id (null ids first), then checksum and size; rows
    equal in all three share one meaning, so any order among them gives the
    same table. An empty table gives an empty one. Further columns of
    ``docs`` are ignored, whatever their names.

    Only the narrow digest is sorted; texts are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(digest, F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("_place", permuted("row", max(n, 1), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(f"cast(_place % {shards} as int)").alias("shard"),
        F.expr(f"cast(_place div {shards} as bigint)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
