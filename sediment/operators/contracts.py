"""What rows must keep, as boolean columns: null where a value that is asked for is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bar(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """Prices above zero, the high above all others, the low below them, and a volume of zero or more."""
    return (F.least(open_, high, low, close) > 0) & (high >= F.greatest(open_, low, close)) & (low <= F.least(open_, high, close)) & (volume >= 0)


def in_order(*times: Column) -> Column:
    """No time before one that is listed earlier; null ones are passed over."""
    out, before = F.lit(True), None
    for t in times:
        if before is not None:
            out &= F.coalesce(t >= before, F.lit(True))
        before = t if before is None else F.greatest(before, t)
    return out


def span(text: Column, start: Column, stop: Column, quote: Column) -> Column:
    """A half-open range of the text, not empty, that holds the quote exactly."""
    return (start >= 0) & (start < stop) & (stop <= F.length(text)) & (F.substring(text, start + 1, stop - start) == quote)


def labels(given: Column, none: Column) -> Column:
    """No label twice, and no label at all just where the record says that nothing happened."""
    return (F.size(F.array_distinct(given)) == F.size(given)) & (none == (F.size(given) == 0))


def tradable(as_of: Column, delisted: Column) -> Column:
    """Whether a security is not delisted yet."""
    return delisted.isNull() | (as_of < delisted)
