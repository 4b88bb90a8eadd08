"""Column helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column, digits: int) -> Column:
    """Rounds half up toward plus infinity, as the receipts' consumers do."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half up; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part / whole, digits))


def usd(nano: Column) -> Column:
    return nano / F.lit(1e9)


#: Token classes of a bill with the price column of each. The last two are the parts of a prompt that a cache gave or kept.
CLASSES = {"input_tokens": "nano_in", "output_tokens": "nano_out", "cache_read_tokens": "nano_read", "cache_write_tokens": "nano_write"}


def cost_nano(*classes: str) -> Column:
    """Nano-dollars of the token columns (input and output if none is named); null without a price. Null counts of a class are none; a class without a price of its own costs nothing."""
    own = classes or ("input_tokens", "output_tokens")
    parts = [F.col(c) * F.col(CLASSES[c]) if c in ("input_tokens", "output_tokens") else F.coalesce(F.col(c), F.lit(0)) * F.when(F.col("nano_in").isNotNull(), F.coalesce(CLASSES[c], F.lit(0))) for c in own]
    return reduce(lambda a, b: a + b, parts)
