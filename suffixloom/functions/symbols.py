"""Scalar functions on contexts and k-mers: strings over ACGT, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(kmer: Column, length: Column | int) -> Column:
    """The first ``length`` symbols; all of them if there are fewer."""
    return F.substring(kmer, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def suffix(context: Column) -> Column:
    """The tree parent: the context without its first symbol."""
    return F.substring(context, 2, 2147483647)


def last(context: Column, length: Column | int) -> Column:
    """The last ``length`` symbols."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(n > 0, F.right(context, n)).otherwise(F.lit(""))


def replace_first(context: Column, symbol: Column | str) -> Column:
    """A sibling: the first symbol replaced.  The empty context has none and stays empty."""
    symbol = F.lit(symbol) if isinstance(symbol, str) else symbol
    return F.when(F.length(context) > 0, F.concat(symbol, suffix(context))).otherwise(context)


def symbol_code(kmer: Column, position: Column | int) -> Column:
    """Code of the symbol at ``position`` from 0: A 0, C 1, G 2, T 3; -1 beyond the end."""
    p = F.lit(position) if isinstance(position, int) else position
    symbol = F.substring(kmer, p + 1, F.lit(1))
    return F.when(symbol == "A", 0).when(symbol == "C", 1).when(symbol == "G", 2).when(symbol == "T", 3).otherwise(-1)


def prefix_index(kmer: Column, length: int) -> Column:
    """The first ``length`` symbols (or as many as there are) as a base-4 number."""
    digits = F.translate(prefix(kmer, length), "ACGT", "0123")
    return F.when(F.length(digits) > 0, F.conv(digits, 4, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def contexts_up_to(length: int) -> int:
    """How many contexts of at most ``length`` symbols there are."""
    return (4 ** (length + 1) - 1) // 3


def first_difference(a: Column, b: Column, skip_a: int = 0, skip_b: int = 0) -> Column:
    """Place from 0 of the first symbol in which ``a`` and ``b`` differ after their skipped prefixes; -1 if ``a`` ends first."""
    x, y = F.substring(a, skip_a + 1, 2147483647), F.substring(b, skip_b + 1, 2147483647)
    n = F.length(x)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    return F.coalesce(F.array_min(differ) - 1, F.lit(-1))


def post_order(context: Column) -> Column:
    """Sort key that puts children before their parents and the root last: the reversed context, descending."""
    return F.reverse(context).desc()


def all_suffixes(context: Column, least: int = 0) -> Column:
    """The context and all its suffixes down to ``least`` symbols, as an array; empty if the context is shorter."""
    n = F.length(context)
    lengths = F.when(n >= least, F.sequence(F.lit(least), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda i: last(context, i))
