"""Reproducible pseudo-random draws.

A draw depends only on the replicate number and the row's own key, never on the
partitioning or the retry count, so a re-run task gives the same sample.  All
arithmetic is on 64-bit integers modulo a prime; any SQL engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647          # 2^31 - 1
KEY_BITS = 28               # seven hexadecimal digits
REP_STEP = 1299709


def key_high(*cols: Column | str) -> Column:
    """First 28 bits of the row key's digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 7), 16, 10).cast("long")


def key_low(*cols: Column | str) -> Column:
    """Next 28 bits of the row key's digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 8, 7), 16, 10).cast("long")


def _fifth_power(x: Column) -> Column:
    square = (x * x) % PRIME
    return (((square * square) % PRIME) * x) % PRIME


def draw(rep: Column, high: Column, low: Column) -> Column:
    """A number in [0, PRIME), mixed in two rounds of x -> x^5 (a bijection)."""
    first = _fifth_power((high + rep * REP_STEP + 1) % PRIME)
    return _fifth_power((first + low) % PRIME)


def draw_sql(rep: str, high: str, low: str) -> str:
    """The same draw as a SQL expression."""
    def fifth(x: str) -> str:
        sq = f"(({x})*({x}) % {PRIME})"
        return f"((({sq}*{sq}) % {PRIME})*({x}) % {PRIME})"

    first = fifth(f"(({high}) + ({rep})*{REP_STEP} + 1) % {PRIME}")
    return fifth(f"({first} + ({low})) % {PRIME}")


def draw_columns(df, rep: str, high: str, low: str, out: str):
    """Attach a draw in two steps so that each power is computed once."""
    x = (F.col(high) + F.col(rep) * REP_STEP + 1) % PRIME
    df = df.withColumn("_x", x)
    df = df.withColumn("_s", F.col("_x") * F.col("_x") % PRIME)
    df = df.withColumn("_x", ((F.col("_s") * F.col("_s") % PRIME) * F.col("_x") % PRIME + F.col(low)) % PRIME)
    df = df.withColumn("_s", F.col("_x") * F.col("_x") % PRIME)
    df = df.withColumn(out, (F.col("_s") * F.col("_s") % PRIME) * F.col("_x") % PRIME)
    return df.drop("_x", "_s")


#: Rounds of the shuffle below; a place stays where it was with probability 2^-ROUNDS.
ROUNDS = 20


def round_keys(key: Column, rounds: int = ROUNDS) -> Column:
    """Array of one number in [0, PRIME) per round, from a key in that range."""
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: _fifth_power((key.cast("long") + r * REP_STEP) % PRIME))


def shuffled_place(place: Column, n: Column, keys: Column, back: bool = False) -> Column:
    """Image of ``place`` under a keyed bijection of 0..n-1, for any n up to 2^31; ``back`` gives the inverse.

    Swap-or-not rounds: a key pairs every place with its mirror place, and one bit of a hash of the pair says
    whether the two change places.  Each round is its own inverse, so the way back takes the keys in reverse.  Only
    the places that are asked for are computed.
    """
    n = n.cast("long")

    def swap_or_not(x: Column, key: Column) -> Column:
        mirror = (key % n + n - x) % n
        pair = (key + F.greatest(x, mirror)) % PRIME
        return F.when((pair * pair % PRIME) * pair % PRIME % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.reverse(keys) if back else keys, place.cast("long"), swap_or_not)


def round_keys_sql(key: str, rounds: int = ROUNDS) -> str:
    """The same keys as a SQL expression."""
    fifth = "(((k * k % {p}) * (k * k % {p})) % {p} * k % {p})".format(p=PRIME)
    return (f"list_transform(list_transform(range(1, {rounds + 1}), lambda r: ({key} + r * {REP_STEP}) % {PRIME}), "
            f"lambda k: {fifth})")


def shuffled_place_sql(place: str, n: str, keys: str, back: bool = False) -> str:
    """The same bijection as a SQL expression."""
    keys = f"list_reverse({keys})" if back else keys
    mirror = f"((key % {n} + {n} - x) % {n})"
    pair = f"((key + greatest(x, {mirror})) % {PRIME})"
    return (f"list_reduce({keys}, lambda x, key: CASE WHEN (({pair} * {pair}) % {PRIME}) * {pair} % {PRIME} % 2 = 1 "
            f"THEN {mirror} ELSE x END, CAST({place} AS BIGINT))")
