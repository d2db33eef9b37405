"""Reports of USB input devices: keys typed and paths of pointers, told apart by the length of a report.

Reports are hexadecimal text, with or without colons: 16 digits are a keyboard's (modifier, key), 8 a pointer's with moves of a
byte, 12 one with moves of twelve bits. A stream (a device) is read in its own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.fixed import USB_KEYS, USB_SHIFT


def digits(data: Column) -> Column:
    return F.regexp_replace(data, r"[\s:]", "")


def number(data: Column, at: int, size: int = 2) -> Column:
    return F.conv(F.substring(data, at + 1, size), 16, 10).cast("int")


def signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def pointer_path(reports: DataFrame, stream: str, order: str, data: str) -> DataFrame:
    """(stream, order, x, y): where the pointer stands at reports with a button down, from the sum of all moves before."""
    d = digits(F.col(data))
    wide = F.length(d) == 12
    b2 = number(d, 6)
    dx = F.when(wide, signed(number(d, 4) + F.shiftleft(b2.bitwiseAND(F.lit(15)), 8), 12)).otherwise(signed(number(d, 2), 8))
    dy = F.when(wide, signed(F.shiftright(b2, 4) + F.shiftleft(number(d, 8), 4), 12)).otherwise(signed(number(d, 4), 8))
    down = F.when(wide, number(d, 2) != 0).otherwise(number(d, 0).bitwiseAND(F.lit(7)) != 0)
    rows = reports.where(F.length(d).isin(8, 12) & d.rlike("^[0-9A-Fa-f]+$")).select(stream, order, dx.alias("dx"), dy.alias("dy"), down.alias("down"))
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(stream, order, F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"), "down").where("down").drop("down")


def typed(reports: DataFrame, stream: str, order: str, data: str) -> DataFrame:
    """(stream, text): the keys of a keyboard's reports in order, with either shift key."""
    d = digits(F.col(data))
    keys = F.create_map(*[F.lit(v) for kv in USB_KEYS.items() for v in kv])
    plain = F.element_at(keys, number(d, 4))
    shift = number(d, 0).bitwiseAND(F.lit(0x22)) != 0
    char = F.when(shift, F.upper(F.translate(plain, *USB_SHIFT))).otherwise(plain)
    rows = reports.where((F.length(d) == 16) & d.rlike("^[0-9A-Fa-f]+$")).select(stream, order, char.alias("c")).where("c is not null")
    parts = F.array_sort(F.collect_list(F.struct(order, "c")))
    return rows.groupBy(stream).agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("text"))
