"""What file names say: years, ids, sites, tiles, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime codes and the date pattern letters that mean the same. Fixed values.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "%"}


def date_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; letters in between are quoted."""
    out, i = "", 0
    while i < len(strftime):
        code = strftime[i : i + 2]
        if code[0] == "%":
            if code not in STRFTIME:
                raise ValueError(f"no pattern for {code!r}")
            out, i = out + STRFTIME[code], i + 2
        else:
            out, i = out + (f"'{code[0]}'" if code[0].isalpha() else code[0]), i + 1
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The last dot-separated token, case kept."""
    return F.element_at(F.split(name, r"\."), -1)


def year_of(stem: Column) -> Column:
    """The last four characters as an integer; anything else is an error."""
    last = F.trim(F.right(stem, F.lit(4)))
    return F.when(last.rlike(r"^[-+]?[0-9]+$"), last.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("no year in "), stem)))


def id_of(stem: Column) -> Column:
    """The integer that the rest of the name begins with, else 0."""
    rest = F.substring(stem, F.lit(1), F.greatest(F.char_length(stem) - 4, F.lit(0)))
    return F.coalesce(F.regexp_extract(rest, r"^\s*([-+]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def date_of(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def archive_site(name: Column) -> Column:
    """Second underscore token of the name before its first dot."""
    return F.get(F.split(F.get(F.split(name, r"\."), F.lit(0)), "_"), F.lit(1))


def archive_year(name: Column) -> Column:
    """First four characters of the last underscore token."""
    return F.left(F.element_at(F.split(F.get(F.split(name, r"\."), F.lit(0)), "_"), -1), F.lit(4))


def tile_row(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1)).cast("int")


def tile_col(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(2)).cast("int")


def parse_date(text: Column) -> Column:
    """A date in any of the usual forms, else null."""
    return F.coalesce(*(F.try_to_date(text, p) for p in ("yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "M/d/yyyy", "yyyy")))


def days_difference(first: Column, second: Column) -> Column:
    """Signed days between two yyyymmdd strings; positive if the second is later."""
    return F.datediff(F.to_date(second, "yyyyMMdd"), F.to_date(first, "yyyyMMdd"))
