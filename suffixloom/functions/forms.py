"""Two forms of contexts: strings over ACGT, and packed numbers.

A packed context of n symbols is the number 4^n plus its base-4 digits (A 0, C 1, G 2, T 3), so contexts of all
lengths have different numbers and the root is 1.  Parents, prefixes, siblings and the post-order are shifts and masks, a
join compares 64-bit numbers, and a row holds 8 bytes whatever the length.  Numbers hold up to ``MOST`` symbols; longer
contexts are strings.  Operators ask ``form`` for the form of the tables that they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import symbols

#: Symbols of a packed context at most (two bits each, and one bit before them, in 63 bits).
MOST = 31


def _n(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def _shifted(n: Column | int) -> Column:
    """4 to the power ``n``."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (_n(n) * 2).cast("int"))


class Text:
    """Contexts as strings."""

    ROOT = ""
    parent = staticmethod(lambda context, depth: symbols.suffix(context))
    last = staticmethod(lambda context, depth, n: symbols.last(context, n))
    prefix = staticmethod(lambda context, depth, n: symbols.prefix(context, n))
    suffixes = staticmethod(lambda context, depth, least=0: symbols.all_suffixes(context, least))
    final = staticmethod(lambda context: F.right(context, F.lit(1)))
    SYMBOLS = ("A", "C", "G", "T")
    depth = staticmethod(F.length)
    text = staticmethod(lambda context, depth: context)
    order = staticmethod(lambda context, depth: [symbols.post_order(context)])


class Packed:
    """Contexts as numbers."""

    ROOT = 1
    SYMBOLS = (0, 1, 2, 3)

    @staticmethod
    def pack(text: Column) -> Column:
        """The number of a string over ACGT of at most ``MOST`` symbols."""
        return F.conv(F.concat(F.lit("1"), F.translate(text, "ACGT", "0123")), 4, 10).cast("bigint")

    @staticmethod
    def text(context: Column, depth: Column | None = None) -> Column:
        return F.substring(F.translate(F.conv(context.cast("string"), 10, 4), "0123", "ACGT"), 2, 2147483647)

    @staticmethod
    def depth(context: Column) -> Column:
        return F.floor((F.length(F.bin(context)) - 1) / 2).cast("int")

    @staticmethod
    def last(context: Column, depth: Column, n: Column | int) -> Column:
        """The last ``n`` symbols (of a context that has so many)."""
        power = _shifted(n)
        return context.bitwiseAND(power - 1).bitwiseOR(power)

    @staticmethod
    def parent(context: Column, depth: Column) -> Column:
        """The context without its first symbol; the root has no parent and stays itself."""
        return F.when(depth > 0, Packed.last(context, depth, depth - 1)).otherwise(context)

    @staticmethod
    def prefix(context: Column, depth: Column, n: Column | int) -> Column:
        """The first ``n`` symbols; all of them if there are fewer."""
        return F.call_function("shiftright", context, (2 * F.greatest(F.lit(0), depth - _n(n))).cast("int"))

    @staticmethod
    def sibling(context: Column, depth: Column, code: Column | int) -> Column:
        """The first symbol replaced by that of ``code``; the root stays itself."""
        rest = F.greatest(depth - 1, F.lit(0))
        return F.when(depth > 0, context.bitwiseAND(_shifted(rest) - 1) + (_n(code) + 4) * _shifted(rest)).otherwise(context)

    @staticmethod
    def code(context: Column, depth: Column, position: Column | int) -> Column:
        """Code of the symbol at ``position`` from 0; -1 beyond the end."""
        p = _n(position)
        at = F.call_function("shiftright", context, (2 * F.greatest(depth - 1 - p, F.lit(0))).cast("int")).bitwiseAND(F.lit(3)).cast("int")
        return F.when(p < depth, at).otherwise(-1)

    @staticmethod
    def final(context: Column) -> Column:
        """Code of the last symbol."""
        return context.bitwiseAND(F.lit(3))

    @staticmethod
    def suffixes(context: Column, depth: Column, least: int = 0) -> Column:
        """The context and all its suffixes down to ``least`` symbols; none if it is shorter."""
        lengths = F.when(depth >= least, F.sequence(F.lit(least), depth)).otherwise(F.array().cast("array<int>"))
        return F.transform(lengths, lambda n: Packed.last(context, depth, n))

    @staticmethod
    def index(context: Column, depth: Column, n: int) -> Column:
        """The first ``n`` symbols (or as many as there are) as a base-4 number."""
        head = Packed.prefix(context, depth, n)
        return head - _shifted(F.least(depth, F.lit(n)))

    @staticmethod
    def order(context: Column, depth: Column) -> list[Column]:
        """Sort keys of the post-order: symbols from the last to the first, falling; of equals the longer first."""
        bits = context - _shifted(depth)
        for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
            m = F.lit(mask).cast("bigint")
            low = F.call_function("shiftrightunsigned", bits, F.lit(width)).bitwiseAND(m)
            bits = low.bitwiseOR(F.call_function("shiftleft", bits.bitwiseAND(m), F.lit(width)))
        return [F.call_function("shiftrightunsigned", bits, F.lit(2)).desc(), depth.desc()]


def form(df: DataFrame, column: str = "context") -> type[Text] | type[Packed]:
    """The form of a table's contexts (or k-mers), by the column's type."""
    return Packed if isinstance(df.schema[column].dataType, LongType) else Text


def packed(df: DataFrame, column: str = "context") -> DataFrame:
    """``df`` with packed contexts; those of more than ``MOST`` symbols are an error."""
    if form(df, column) is Packed:
        return df
    fits = F.when(F.length(column) <= MOST, Packed.pack(F.col(column))).otherwise(F.raise_error(F.lit(f"a packed context has at most {MOST} symbols")).cast("bigint"))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), fits))


def unpacked(df: DataFrame, column: str = "context") -> DataFrame:
    """``df`` with contexts as strings."""
    return df if form(df, column) is Text else df.withColumn(column, Packed.text(F.col(column)))
