"""Who may see a row: the predicates of publication and of training."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import licences
from .binding import let

# The restricted source, how its licence text calls it, and its dataset names.
RESTRICTED, RESTRICTED_TERMS = "df20", "training-only"
RESTRICTED_DATASETS = ("df20", "danish fungi 2020", "danish_fungi_2020")
SHOWN = ("cc0", "cc-by")


def _low(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit("")) == ""


def https(url: Column) -> Column:
    return F.coalesce(F.lower(F.trim(url)).startswith("https://"), F.lit(False))


def not_https(columns: list[str]) -> Column:
    """Names of the URL columns that hold something other than https, in order; blanks are allowed."""
    return F.array_compact(F.array(*[F.when(~blank(F.col(c)) & ~https(F.col(c)), c) for c in columns]))


def licence_kind(text: Column, url: Column) -> Column:
    """``missing``, the restricted source, a family of the closed table, or ``rejected``."""
    low = _low(text)
    marked = low.contains(RESTRICTED) & low.contains(RESTRICTED_TERMS)
    return (
        F.when(low == "", "missing")
        .when(marked, RESTRICTED)
        .otherwise(F.coalesce(licences.family(licences.parsed(text, url)), F.lit("rejected")))
    )


def marked_restricted(present: list[Column], notes: list[Column], datasets: list[Column]) -> Column:
    """True if an id of the restricted source is there, a note names it, or a dataset field is it."""
    hit = F.lit(False)
    for c in present:
        hit = hit | ~blank(c)
    for c in notes:
        hit = hit | _low(c).contains(RESTRICTED)
    for c in datasets:
        hit = hit | _low(c).isin(*RESTRICTED_DATASETS)
    return hit


def restricted_row(source: Column, licence: Column, marker: Column) -> Column:
    return (_low(source) == RESTRICTED) | (_low(licence) == RESTRICTED) | marker


def unpublished(usage: Column, marker: Column, licence: Column, text: Column, url: Column) -> Column:
    """Usage first, then the marker, then the exact id, then what the licence text says."""
    exact = F.coalesce(licences.usage(licence), F.lit(""))
    return (
        F.when((_low(usage) == "training_only") | marker | (exact == "training_only"), True)
        .when(exact == "publishable", False)
        .otherwise(~licence_kind(text, url).isin(*SHOWN))
    )


def _id_of_url(url: Column) -> Column:
    """The exact id that an https licence URL names; null without one."""
    named = licences.code_and_version(url)
    return F.when(
        https(url),
        let(named, lambda n: F.when(n["code"] == "cc0", F.when(n["version"] == "1.0", "cc0-1.0")).otherwise(F.concat(F.lit("cc-"), n["code"], F.lit("-"), n["version"]))),
    )


def publishable(unverified: Column, usage: Column, licence: Column, creator: Column, image_url: Column, licence_url: Column) -> Column:
    """Verified, of a publishable usage and exact id, credited, an https image, and an https licence URL of the same id."""
    return (
        ~F.coalesce(unverified, F.lit(False))
        & F.coalesce(usage == "publishable", F.lit(False))
        & F.coalesce(licences.usage(licence) == "publishable", F.lit(False))
        & ~blank(creator)
        & https(image_url)
        & F.coalesce(_id_of_url(licence_url) == licence, F.lit(False))
    )


def trainable(unverified: Column, usage: Column, publishable_only: bool = False) -> Column:
    """Not marked unverified and, if asked, not for training only."""
    ok = ~F.coalesce(unverified, F.lit(False))
    return ok & ~F.coalesce(usage == "training_only", F.lit(False)) if publishable_only else ok


def licence_link(explicit: Column, licence: Column, normalized: Column) -> Column:
    """The https URL of a credit: its own, its licence if that is one, or that of the normalised CC0; else null."""
    name = F.upper(F.regexp_replace(F.trim(F.coalesce(normalized, F.lit(""))), r"\s+", " "))
    return (
        F.when(https(explicit), F.trim(explicit))
        .when(https(licence), F.trim(licence))
        .when(name.isin("CC0", "CC0 1.0"), "https://creativecommons.org/publicdomain/zero/1.0/")
    )
