"""Sets of integer ids as sparse 64-bit words.

A set is kept as rows ``(owner, word, bits)``: id ``p`` is bit ``p & 63`` of
word ``p >> 6``. Unions are ``bit_or`` and sizes are ``sum(bit_count)``, both of
which Spark combines before the shuffle in generated code. A set of far-apart ids costs
one row per id and a dense one 1/64 of that, so nothing depends on the number
of ids in the whole data, and no dense ranking of ids is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def word_index(member: Column) -> Column:
    return F.shiftright(member.cast("long"), 6)


def word_bit(member: Column) -> Column:
    position = member.cast("long").bitwiseAND(F.lit(WORD_BITS - 1).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def word_members(word: Column, bits: Column) -> Column:
    """The ids held by one word, as an array in ascending order."""
    positions = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    held = F.filter(positions, lambda i: F.call_function("getbit", bits, i) == 1)
    return F.transform(held, lambda i: word.cast("long") * WORD_BITS + i)
