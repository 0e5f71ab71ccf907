"""Sets of row numbers as bitmaps, one row per range of 32,768 numbers.

A dense set of a thousand million numbers is 30,000 such rows. Joined by range, they tell of every
row whether its number is in the set, and how many numbers before it are, so the rows themselves
need not be shuffled to meet the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from evalspark.plans.durable import stored

RANGE = 32_768  # fixed: bits of Spark's bitmap aggregates
ROW_BYTES = RANGE // 8 + 64
BROADCAST_BYTES = 128 << 20


def range_of(number: Column) -> Column:
    return F.floor(number / RANGE)


def whole_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType))


def bitmaps(rows: DataFrame, number: str) -> DataFrame:
    """(_range, _bits, _count) of the distinct numbers of a column; nulls are left out."""
    kept = rows.where(F.col(number).isNotNull())
    bits = F.bitmap_construct_agg(F.pmod(F.col(number), F.lit(RANGE)).cast("long"))
    return kept.groupBy(range_of(F.col(number)).alias("_range")).agg(bits.alias("_bits")).withColumn("_count", F.bitmap_count("_bits"))


def ranges_within(rows: DataFrame, number: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the bitmaps of a column are small enough to be sent to every task."""
    most = limit // ROW_BYTES
    return rows.where(F.col(number).isNotNull()).select(range_of(F.col(number)).alias("_range")).distinct().limit(most + 1).count() <= most


def has(number: Column, bits: Column = None) -> Column:
    """Whether the bit of a number is set; null bits hold none."""
    bits = F.col("_bits") if bits is None else bits
    at = F.pmod(number, F.lit(RANGE)).cast("int")
    byte = _byte(bits, F.shiftright(at, 3))
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def rank(number: Column, bits: Column = None) -> Column:
    """How many numbers of the same range are set before a number."""
    bits = F.col("_bits") if bits is None else bits
    at = F.pmod(number, F.lit(RANGE)).cast("int")
    whole = F.shiftright(at, 3)
    rest = _byte(bits, whole).bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7))) - 1)
    return F.coalesce(F.bitmap_count(F.substring(bits, F.lit(1), whole)) + F.bit_count(rest), F.lit(0).cast("long"))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def directory(rows: DataFrame, number: str) -> DataFrame:
    """``bitmaps`` with ``_before``, the numbers in all earlier ranges, stored."""
    sets = stored(bitmaps(rows, number), "bitmaps")
    before = F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    return stored(sets.withColumn("_before", F.coalesce(before, F.lit(0).cast("long"))), "directory")


def without(rows: DataFrame, gone: DataFrame, number: str) -> DataFrame | None:
    """The rows whose number is not in ``gone``, in one narrow pass; None if the numbers of ``gone``
    are spread too thin for that. Rows with a null number stay."""
    if not ranges_within(gone, number):
        return None
    sets = F.broadcast(stored(bitmaps(gone, number), "bitmaps"))  # checked above
    met = rows.join(sets.select(F.col("_range").alias("_gone"), "_bits"), range_of(F.col(number)) == F.col("_gone"), "left")
    return met.where(~has(F.col(number)) | F.col(number).isNull()).select(*rows.columns)
