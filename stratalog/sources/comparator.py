"""Orders of keys: a store keeps each key with a sort key, whose bytes are in the wanted order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparator:
    """key and column give the sort key of a key, on the driver and as an expression; keys of one sort key are equal."""

    name: str
    key: Callable[[bytes], bytes]
    column: Callable[[Column], Column]


BYTEWISE = Comparator("bytewise", bytes, lambda k: k)


def _number(key: bytes) -> bytes:
    return int(key.decode().strip("[]"), 0).to_bytes(8, "big")


def _number_column(key: Column) -> Column:
    text = F.regexp_replace(key.cast("string"), r"^\[|\]$", "")
    hexed = F.when(F.startswith(F.lower(text), F.lit("0x")), F.lpad(F.substring(text, F.lit(3), F.length(text)), 16, "0")).otherwise(F.lpad(F.hex(text.try_cast("long")), 16, "0"))
    return F.unhex(hexed)


#: Numbers in brackets, decimal or hexadecimal, such as [20] and [0x14], which are one key.
NUMERIC = Comparator("numbers in brackets", _number, _number_column)
