"""Column expressions on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Persons that name nobody.
PLACEHOLDER_PERSONS = (
    "none", "null", "nan", "unknown", "anonymous", "anonim", "anonimowy", "nieznany", "unknown author", "no rights reserved", "-", "?", "n/a", "na",
    "inaturalist", "gbif", "wikimedia", "wikimedia commons", "mushroom observer",
)
PLACEHOLDER_ENDINGS = (" society", " stowarzyszenie", " association")

#: Accented lower-case letters and the letters they are searched by: what decomposition leaves, and l for ł.
_BASE = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xE0, 0x250) if chr(c).islower()}
_BASE = {c: b for c, b in _BASE.items() if c != b} | {"ł": "l"}
ACCENTED, PLAIN = "".join(_BASE), "".join(_BASE.values())


def squeezed(text: Column) -> Column:
    """Trimmed, with runs of any Unicode white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Squeezed and case-folded; blank gives null."""
    return F.nullif(squeezed(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), F.lit(""))


def placeholder_person(text: Column) -> Column:
    """True for blanks, placeholders and societies."""
    name = folded(text)
    ends = [name.endswith(e) for e in PLACEHOLDER_ENDINGS]
    hit = name.isin(*PLACEHOLDER_PERSONS) | name.contains("mycological society")
    for e in ends:
        hit = hit | e
    return F.coalesce(hit, F.lit(True))


def person(text: Column) -> Column:
    """The folded name, or null for a placeholder."""
    return F.when(~placeholder_person(text), folded(text))


def printable(text: Column, limit: int = 2048) -> Column:
    """Without control and format characters, trimmed and cut to ``limit`` characters; null gives empty."""
    return F.left(F.trim(F.coalesce(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", ""), F.lit(""))), F.lit(limit))


def search_key(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.trim(text)), ACCENTED, PLAIN)


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")
