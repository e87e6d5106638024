"""Identity tokens of the form ``kind:value`` from ids, URLs and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import canonical_url

# Prefixes of occurrence keys and their kinds, longer prefixes first.
PREFIXES = (
    ("inat-obs:", "inat_observation"),
    ("inat-photo:", "inat_photo"),
    ("inat:", "inat_observation"),
    ("mo:", "mo_observation"),
    ("df20:", "df20_observation"),
    ("gbif:", "gbif_occurrence"),
)
EMPTY_IDS = ("none", "null", "nan")


def clean_id(value: Column) -> Column:
    """Trimmed, on one line; null for blanks and words for nothing."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"[\r\n]", " "))
    return F.when((text != "") & ~F.lower(text).isin(*EMPTY_IDS), text)


def id_of_number(value: Column) -> Column:
    """A float id as an integer's text; null unless finite and integral."""
    return F.when(~F.isnan(value) & (F.abs(value) < 9.2e18) & (value == F.floor(value)), value.cast("long").cast("string"))


def occurrence_token(value: Column) -> Column:
    """One typed token for an occurrence key, or null."""
    text = clean_id(value)
    out = F.lit(None).cast("string")
    rest = F.trim(F.regexp_replace(text, r"^[^:]*:", ""))
    photo = (
        F.when(rest == "", None)
        .when(rest.rlike(r"^[0-9]+$"), F.concat(F.lit("inat_photo:"), rest))
        .when(rest.contains("://"), F.concat(F.lit("image:"), canonical_url(rest)))
        .otherwise(F.concat(F.lit("commons:"), rest))
    )
    plain = F.when(text.rlike(r"^[0-9]+$"), F.concat(F.lit("gbif_occurrence:"), text)).otherwise(F.concat(F.lit("occurrence:"), text))
    out = F.when(F.lower(text).startswith("photo:"), photo).otherwise(plain)
    for prefix, kind in reversed(PREFIXES):
        own = F.trim(F.substr(text, F.lit(len(prefix) + 1)))
        out = F.when(F.lower(text).startswith(prefix), F.when(own != "", F.concat(F.lit(f"{kind}:"), own))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of the ids in a URL, in order of kind."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(url, F.lit(pattern), 1), lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_distinct(
        F.concat(
            found("inat_photo", r"(?i)/photos/([0-9]+)"),
            found("inat_observation", r"(?i)inaturalist\.org/observations/([0-9]+)"),
            found("gbif_occurrence", r"(?i)gbif\.org/occurrence/([0-9]+)"),
            F.array(F.concat(F.lit("image:"), canonical_url(url))),
        )
    )


def grid_key(prefix: Column, who: Column, lat: Column, lon: Column, signed_zero: bool = False) -> Column:
    """``grid:...`` of a square of 0.01 degrees, rounded half to even; null without a finite place, a prefix or a person.

    The square around zero is ``0.00``; with ``signed_zero``, places just below
    zero keep their sign (``-0.00``).
    """
    rounded = lambda x: F.rint(x / F.lit(0.01)) * F.lit(0.01)
    cell = lambda x: F.format_string("%.2f", rounded(x) if signed_zero else rounded(x) + F.lit(0.0))
    finite = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    return F.when(finite & prefix.isNotNull() & who.isNotNull(), F.concat_ws(":", F.lit("grid"), prefix, who, cell(lat), cell(lon)))


def usable_place(lat: Column, lon: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def identity_keys(persons: list[Column], places: list[Column], photos: list[Column], observations: list[Column]) -> Column:
    """The distinct keys of a row, persons first: named persons, grid places, photo tokens and observation tokens; blanks give none."""
    one = lambda kind, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.trim(c)))
    keys = [one("person", p) for p in persons] + list(places) + [one("photo", p) for p in photos] + [occurrence_token(o) for o in observations]
    return F.array_distinct(F.array_compact(F.array(*keys)))
