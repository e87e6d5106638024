"""Licence ids: a closed table, the grammar of licence text, and the decision on text and URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import folded

# Exact id, usage, family.
LICENCES = (
    ("cc0-1.0", "publishable", "cc0"),
    ("cc-by-1.0", "publishable", "cc-by"),
    ("cc-by-2.0", "publishable", "cc-by"),
    ("cc-by-2.5", "publishable", "cc-by"),
    ("cc-by-3.0", "publishable", "cc-by"),
    ("cc-by-4.0", "publishable", "cc-by"),
    ("cc-by-nc-1.0", "training_only", "cc-by-nc"),
    ("cc-by-nc-2.0", "training_only", "cc-by-nc"),
    ("cc-by-nc-2.5", "training_only", "cc-by-nc"),
    ("cc-by-nc-3.0", "training_only", "cc-by-nc"),
    ("cc-by-nc-4.0", "training_only", "cc-by-nc"),
    ("cc-by-sa-1.0", "training_only", "cc-by-sa"),
    ("cc-by-sa-2.0", "training_only", "cc-by-sa"),
    ("cc-by-sa-2.5", "training_only", "cc-by-sa"),
    ("cc-by-sa-3.0", "training_only", "cc-by-sa"),
    ("cc-by-sa-4.0", "training_only", "cc-by-sa"),
    ("df20", "training_only", "df20"),
)
# Strictness, words without meaning, known words and codes of licence text, kept statuses, rejected words.
RANKS = {"cc0": 1, "cc-by": 2, "cc-by-nc": 3, "cc-by-sa": 3, "df20": 3}
SKIPPED = ("cc", "creative", "commons", "license", "licence", "international", "unported", "legalcode", "deed")
KNOWN = ("by", "nc", "nd", "sa", "zero", "public", "domain", "publicdomain", "cc0")
CODES = ("by-nc-nd", "by-nc-sa", "by-nd", "by-sa", "by-nc", "by", "nc", "nd", "sa")
STATUS_KEPT = ("approved | expert | evidence", "confident")
REJECTED_WORDS = (
    "by-nc", "by-sa", "by-nd", "noncommercial", "non-commercial", "sharealike", "share-alike", "all rights reserved", "all-rights-reserved",
)

_CC = r"creativecommons\.org/(publicdomain/zero|licenses/([a-z0-9-]+))/([0-9]+\.[0-9]+)"


def _looked_up(key: Column, pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[key]


def usage(licence: Column) -> Column:
    """``publishable``, ``training_only`` or null, by exact id."""
    return _looked_up(licence, [(i, u) for i, u, _ in LICENCES])


def family(licence: Column) -> Column:
    return _looked_up(licence, [(i, f) for i, _, f in LICENCES])


def rank(licence: Column) -> Column:
    """Strictness, 3 to 1; 0 for an id outside the table."""
    return F.coalesce(_looked_up(licence, [(i, RANKS[f]) for i, _, f in LICENCES]), F.lit(0))


def licence_of_url(text: Column) -> Column:
    """``cc0-x`` or ``cc-by-x`` of a licence URL; null for anything stricter or unknown."""
    low = F.lower(F.trim(text))
    bad = F.lit(False)
    for word in REJECTED_WORDS:
        bad = bad | low.contains(word)
    kind, code, version = (F.regexp_extract(low, _CC, i) for i in (1, 2, 3))
    return F.when(bad | (version == ""), None).when(kind == "publicdomain/zero", F.concat(F.lit("cc0-"), version)).when(
        code == "by", F.concat(F.lit("cc-by-"), version)
    )


def _token_code(prose: Column) -> Column:
    """Struct of ``code`` and ``version`` of licence prose; both null unless every word is known."""

    def tokens_of(version: Column) -> Column:
        body = F.when(version == "", prose).otherwise(F.replace(prose, version, F.lit(" ")))
        body = F.concat(F.lit(" "), F.regexp_replace(body, r"[^a-z0-9]+", "  "), F.lit(" "))
        body = F.regexp_replace(body, f" ({'|'.join(SKIPPED)}) ", " ")
        body = F.regexp_replace(body, r" (non +commercial[a-z0-9]*|noncommercial|noncommercialuse) ", " nc ")
        body = F.regexp_replace(body, r" attribution ", " by ")
        body = F.regexp_replace(body, r" (noderivs|noderivatives|noderivative) ", " nd ")
        body = F.regexp_replace(body, r" (sharealike|share +alike) ", " sa ")
        return F.filter(F.split(body, " +"), lambda t: t != "")

    def code_of(version: Column, tokens: Column) -> Column:
        has = lambda w: F.array_contains(tokens, w)
        core = F.array_join(F.filter(tokens, lambda t: t.isin("by", "nc", "nd", "sa")), "-")
        named = prose.rlike(r"\bcc\b") | prose.contains("creativecommons") | has("cc0")
        code = (
            F.when((F.trim(prose) == "") | F.exists(tokens, lambda t: ~t.isin(*KNOWN)), None)
            .when(has("cc0") | (has("zero") & has("public") & has("domain")), "cc0")
            .when(named & core.isin(*CODES), core)
        )
        return let(code, lambda c: F.struct(c.alias("code"), F.when(c.isNotNull() & (version != ""), version).alias("version")))

    version = F.regexp_extract(prose, r"([0-9]+\.[0-9]+)", 1)
    return let(version, lambda v: let(tokens_of(v), lambda t: code_of(v, t)))


def code_and_version(text: Column) -> Column:
    """Struct of ``code`` (null if unknown or contradictory) and ``version`` of licence prose or URL."""

    def merged(low: Column) -> Column:
        kind, part, version = (F.nullif(F.regexp_extract(low, _CC, i), F.lit("")) for i in (1, 2, 3))
        of_url = F.struct(F.when(kind == "publicdomain/zero", F.lit("cc0")).otherwise(part).alias("code"), version.alias("version"))
        return let(of_url, lambda u: let(_token_code(F.regexp_replace(low, r"https?://\S+", " ")), lambda p: joined(u, p)))

    def joined(u: Column, p: Column) -> Column:
        differ = F.coalesce(p["code"] != u["code"], F.lit(False)) | F.coalesce(p["version"] != u["version"], F.lit(False))
        pick = lambda name: F.when(~differ, F.coalesce(p[name], u[name])).alias(name)
        return F.struct(pick("code"), pick("version"))

    return let(F.translate(F.lower(F.trim(text)), "–—", "--"), merged)


def _parsed(t: Column, u: Column, blank: Column) -> Column:
    clash = ~blank & (F.coalesce(u["code"] != t["code"], F.lit(False)) | F.coalesce(u["version"] != t["version"], F.lit(False)))
    version = F.coalesce(t["version"], F.when(~blank & u["code"].isNotNull(), u["version"]))
    licence = F.when(t["code"] == "cc0", F.when(F.coalesce(version, F.lit("1.0")) == "1.0", "cc0-1.0")).otherwise(
        F.concat(F.lit("cc-"), t["code"], F.lit("-"), version)
    )
    return let(licence, lambda x: F.when(~clash & usage(x).isNotNull(), x))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def parsed(text: Column, url: Column) -> Column:
    """The exact id of licence text, its version completed by a URL of the same licence; else null."""
    return let(code_and_version(text), lambda t: let(code_and_version(url), lambda u: _parsed(t, u, _blank(url))))


def photo_decision(text: Column, url: Column) -> Column:
    """Empty when text and https URL agree on a known licence, else the first failing reason."""

    def reason(t: Column, u: Column) -> Column:
        return (
            F.when(_blank(text), "license")
            .when(_blank(url), "license_url_empty")
            .when(~F.lower(F.trim(url)).startswith("https:"), "license_url_not_https")
            .when(t["code"].isNull(), "license")
            .when(u["code"].isNull() | (u["code"] != t["code"]), "license_url_mismatch")
            .when(t["version"].isNotNull() & (u["version"].isNull() | (u["version"] != t["version"])), "license_url_mismatch")
            .when(_parsed(t, u, _blank(url)).isNull(), "license")
            .otherwise("")
        )

    return let(code_and_version(text), lambda t: let(code_and_version(url), lambda u: reason(t, u)))


def status_rejection(status: Column) -> Column:
    """Why an identification status is dropped; empty where it stays."""
    text = folded(status)
    return (
        F.when(text.isNull() | text.isin(*STATUS_KEPT), "")
        .when(text == "unverified", "identification_unverified")
        .otherwise("identification_not_allowlisted")
    )
