"""String functions of labels, names and text lines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_at(text: Column, pattern: str) -> Column:
    """Parts between matches; empty parts at the end are dropped."""
    return F.split(F.regexp_replace(text, f"(?:{pattern})+$", ""), pattern)


def quoted(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def replace_first(text: Column, pattern: str, by: str) -> Column:
    groups = re.compile(pattern).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{shifted}${groups + 2}")


def rewritten(text: Column, *changes: tuple[str, str]) -> Column:
    """Replacements one after the other."""
    for pattern, by in changes:
        text = F.regexp_replace(text, pattern, by)
    return text


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def groups_of(text: Column, pattern: str, *names: str) -> list[Column]:
    return [F.regexp_extract(text, pattern, i).alias(n) for i, n in enumerate(names, 1)]


def camel_case(text: Column) -> Column:
    """words_of a name -> wordsOfAName."""
    joined = F.regexp_replace(F.initcap(F.regexp_replace(text, r"[\s_\-]+", " ")), " ", "")
    return F.concat(F.lower(F.substring(joined, F.lit(1), F.lit(1))), F.substring(joined, F.lit(2), F.length(joined)))


def spaced(text: Column) -> Column:
    """wordsOfAName -> words of a name."""
    return F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def xml_quoted(text: Column) -> Column:
    return rewritten(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key in which numbers within a text come by value: runs of digits are filled with zeros on the left."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def json_value(text: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def synonyms(text: Column) -> Column:
    """Parts between commas or semicolons, trimmed."""
    return F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def serial_date(days: Column) -> Column:
    """The date of a spreadsheet's serial number (from 61 on, where the calendars agree)."""
    return F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int"))


def interval_text(seconds: Column) -> Column:
    """Days, hours, minutes and seconds that aren't zero, as a text; "ago" after negative ones."""
    left = F.abs(seconds.cast("long"))
    parts = []
    for name, size, over in (("day", 86_400, None), ("hour", 3_600, 86_400), ("minute", 60, 3_600), ("second", 1, 60)):
        n = F.floor((left if over is None else left % over) / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, f" {name}").otherwise(f" {name}s"))))
    text = F.concat_ws(", ", *parts)
    return F.when(seconds == 0, F.lit("0 seconds")).otherwise(F.concat(text, F.when(seconds < 0, " ago").otherwise("")))


def geometric_mean(x: Column) -> Column:
    """An aggregate of one's own: built of others, it stays in the plan."""
    return F.exp(F.avg(F.ln(x)))


def replaced_by(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Each match replaced by what the function makes of it."""
    between = F.split(text, pattern, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), change), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
