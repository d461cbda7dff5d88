"""Page markup as column expressions: elements, visible text, character references."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?"
# names that also count without their semicolon, as the HTML standard lists them
_NAMED = {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}
_BARE = {name: text for name, text in html.entities.html5.items() if not name.endswith(";")}
_BARE_LENGTHS = sorted({len(name) for name in _BARE}, reverse=True)
# references to the C1 range mean the characters of Windows-1252
_C1 = {str(b): bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(128, 160)}


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def elements(page: Column, names: str) -> Column:
    """What stands inside each outermost element of these tags (a pattern), in page order."""
    return F.regexp_extract_all(page, F.lit(rf"(?is)<({names})\b[^>]*>(.*?)</\1\s*>"), F.lit(2))


def tagged_elements(page: Column, names: str) -> Column:
    """The elements themselves, with their tags, in page order."""
    return F.regexp_extract_all(page, F.lit(rf"(?is)<({names})\b[^>]*>.*?</\1\s*>"), F.lit(0))


def _numeric(digits: Column, base: int) -> Column:
    """The character of a number; impossible numbers give the replacement character."""
    number = F.conv(F.right(F.concat(F.lit("0" * 9), digits), F.lit(9)), base, 10).cast("long")
    beyond = F.length(F.regexp_replace(digits, "^0+", "")) > 9
    bad = beyond | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(number)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_table(_C1), number.cast("string")), point)


def _character(reference: Column) -> Column:
    name = F.regexp_replace(reference, "^&|;$", "")
    closed = F.when(reference.endswith(";"), F.try_element_at(_table(_NAMED), name))
    # without its semicolon a name may go on as ordinary text: the longest known one counts
    rest = F.substring(reference, F.lit(2), F.length(reference))
    texts = [F.concat(F.try_element_at(_table(_BARE), F.substring(rest, 1, n)), F.substring(rest, F.lit(n + 1), F.length(rest))) for n in _BARE_LENGTHS]
    return (
        F.when(name.rlike("^#[xX]"), _numeric(F.substring(name, F.lit(3), F.length(name)), 16))
        .when(name.startswith("#"), _numeric(F.substring(name, F.lit(2), F.length(name)), 10))
        .otherwise(F.coalesce(closed, *texts, reference))
    )


def unescaped(text: Column) -> Column:
    """All named and numeric character references as their characters."""
    gaps = F.split(text, REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, found, lambda gap, ref: F.concat(gap, F.coalesce(_character(ref), F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def visible_text(page: Column) -> Column:
    """Tags count as spaces, references as their characters."""
    return single_spaced(unescaped(F.regexp_replace(page, r"<[^>]+>", " ")))
