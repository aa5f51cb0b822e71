"""Text and number formats of the dashboards and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_filled(text: Column, width: int) -> Column:
    """Left-padded by zeros; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def station_key(usaf: Column, wban: Column) -> Column:
    """Name of a station's yearly file without the year."""
    return F.concat_ws("-", zero_filled(usaf, 6), zero_filled(wban, 5))


def shown(value: Column, places: int = 1) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f", value.cast("double")))


def shown_et0(value: Column) -> Column:
    """Missing ``-``; zero and values from 0.01 on with four places, smaller ones as ``1.23e-3``."""
    small = F.regexp_replace(F.format_string("%.2e", value.cast("double")), r"e([+-])0*(\d)", "e$1$2")
    fixed = F.format_string("%.4f", value.cast("double"))
    return F.when(value.isNull(), "-").when((value != 0) & (F.abs(value) < 0.01), small).otherwise(fixed)


def shown_count(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 0), F.lit("0"))


def share_percent(part: Column, whole: Column) -> Column:
    """Percent of the whole; null where the whole is zero."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def white_fields(line: Column) -> Column:
    """Fields parted by runs of white space."""
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def sentinel_to_null(value: Column, sentinel: float = -9999) -> Column:
    return F.nullif(value, F.lit(sentinel).cast("double"))


def aligned_line(fields: list[tuple[Column, int]], last: Column, gap: str = " | ") -> Column:
    """A report line: every field padded to its width (a longer one is cut), then ``last`` as it is."""
    return F.concat_ws(gap, *[F.rpad(c.cast("string"), width, " ") for c, width in fields], last)


def joined_lines(order: str, line: str) -> Column:
    """Aggregate: the lines in the given order, joined by line feeds; for reports of a bounded number of lines."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line]), "\n")
