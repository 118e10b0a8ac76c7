"""Small column functions: markup, JSON, versions, hashes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.arabic import fold_column


def strip_html(c: Column) -> Column:
    """Line breaks for <br>, no other tags."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "<[^>]*>", "")


def strip_html_for_export(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))


def search_key(c: Column) -> Column:
    """How titles and authors are compared."""
    return F.lower(fold_column(c))


def json_strings(c: Column) -> Column:
    """A JSON array of strings; anything else is the empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_clitics(c: Column) -> Column:
    kind = "array<struct<type:string,display:string>>"
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))


def key_value(c: Column) -> Column:
    """``key: value`` as a struct, where the colon stands at index 1 to 39; else the text as value."""
    at = F.instr(c, ":")
    has = at.between(2, 40)
    key, value = F.trim(F.substring(c, F.lit(1), at - 1)), F.trim(F.substring(c, at + 1, F.length(c)))
    return F.struct(F.when(has, key).alias("key"), F.when(has, value).otherwise(c).alias("value"))


def version(c: Column) -> Column:
    """(major, minor, patch), missing parts as 0; a pre-release tag is ignored. Structs compare field by field."""
    parts = F.split(F.element_at(F.split(c, "-"), 1), r"\.")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def version_in_range(v: Column, least: Column, most: Column) -> Column:
    return (least.isNull() | (version(v) >= version(least))) & (most.isNull() | (version(v) <= version(most)))


def full_version(c: Column) -> Column:
    """(major, minor, patch) of what precedes a tag, or null where three numbers of 32 bits don't come first."""
    parts = F.split(F.element_at(F.split(c, "-"), 1), r"\.")
    number = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("bigint"))
    numbers = [F.when(number(i) < 1 << 32, number(i)) for i in range(3)]
    whole = numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.when(whole, F.struct(*[n.alias(name) for n, name in zip(numbers, ("major", "minor", "patch"))]))


def meets_minimum(v: Column, least: Column) -> Column:
    """Whether a version is at least another; what isn't a full version counts as compatible."""
    return F.coalesce(full_version(v) >= full_version(least), F.lit(True))


def sha256_matches(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(F.regexp_replace(expected, "^sha256:", ""))


def rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda n, unit: F.concat((F.floor(s / n)).cast("string"), F.lit(unit))
    return (
        F.when(s < 60, "Just now").when(s < 3600, ago(60, "m ago")).when(s < 86400, ago(3600, "h ago"))
        .when(s < 7 * 86400, ago(86400, "d ago")).otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def label(c: Column, most: int = 40) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def csv_cell(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
