"""Text, date and record-field expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[\p{L}\p{N}]+"

# RFC-822 date as written in version records (fixed pattern): weekday, day month year time zone
_RFC822 = (
    r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun),\s+(\d{1,2})\s+"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+(\d{4})\s+"
    r"(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d\s+(?:gmt|utc)$"
)


# Characters that count as whitespace (fixed values)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Drop whitespace of every kind at both ends; null becomes ''."""
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITESPACE))


def squeeze(value: Column) -> Column:
    """Collapse every run of whitespace to one space."""
    return strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def first_token(value: Column) -> Column:
    """Text before the first space ('' for null or empty input)."""
    return F.substring_index(F.coalesce(value, F.lit("")), " ", 1)


def iso_date(value: Column) -> Column:
    """`%Y-%m-%d` text to date; anything else, impossible days included, to null."""
    well_formed = value.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(well_formed, F.try_to_date(value, "yyyy-M-d"))


def rfc822_date(value: Column) -> Column:
    """Calendar date written in an RFC-822 stamp, whatever the session time zone; bad text to null."""
    day, month, year = (F.regexp_extract(value, _RFC822, i) for i in (1, 2, 3))
    written = F.concat_ws(" ", day, F.initcap(month), year)
    return F.when(value.rlike(_RFC822), F.try_to_date(written, "d MMM yyyy"))


def first_version_date(versions: Column) -> Column:
    """Date of the version named `v1`, null where there is none or it cannot be read."""
    v1 = F.filter(versions, lambda v: v["version"] == "v1")
    return rfc822_date(F.get(v1, F.lit(0))["created"])


def author_name(parts: Column) -> Column:
    """`[surname, first, suffix]` to `first surname`; a single part stands alone; none gives null."""
    filled = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return (
        F.when(F.size(filled) >= 2, F.concat_ws(" ", F.get(filled, F.lit(1)), F.get(filled, F.lit(0))))
        .when(F.size(filled) == 1, F.get(filled, F.lit(0)))
    )


def words(value: Column) -> Column:
    """Lower-case words of a whole text."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def parse_vector(value: Column) -> Column:
    """`[0.1 0.2 ...]`, line breaks allowed, to array<float>."""
    flat = F.trim(F.regexp_replace(value, r"[\[\]\s]+", " "))
    return F.when(flat == "", F.array().cast("array<float>")).otherwise(F.split(flat, " +").cast("array<float>"))


def parse_weights(value: Column) -> Column:
    """`{12: 0.5, 34: 1.25}` to map<bigint,float>."""
    flat = F.regexp_replace(value, r"[{}\s]+", "")
    pairs = F.filter(F.split(flat, ","), lambda p: p != "")
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, ":", 1).cast("long").alias("key"),
            F.substring_index(p, ":", -1).cast("float").alias("value"),
        ),
    )
    return F.map_from_entries(entries)
