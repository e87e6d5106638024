"""Names, numbers and links made from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .ids import usable_place
from .text import person

# Numbers in groups, in long runs and of three digits, links to call, names of cache files;
GROUPED_PHONE, LONG_PHONE, SHORT_PHONE, TEL_LINK = r"[0-9]{2,4}(?:[  -][0-9]{2,4}){2,}", "[0-9]{9,}", "[0-9]{3}", r'(?i)href="tel:([^"]+)"'
CACHE_NAME = r"^([A-Za-z0-9]+)=(.*)__v[0-9]+__[0-9a-f]{20}\.json$"
# image endings, the country code of nine-digit numbers, what marks an extension, and the name of a stored photo.
ENDINGS = (".jpg", ".jpeg", ".png", ".webp")
COUNTRY = "48"
EXTENSION = r"(?i)\b(?:wew|ext|extension)\b|[#,;]"
PHOTO_NAME = r"\A[A-Za-z0-9][A-Za-z0-9_-]*\.(jpg|png|heic|webp)\z"
#: The narrowest preview.
PREVIEW = 448


def first_text(*columns: Column) -> Column:
    """The first column that isn't blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def person_source(observer: Column, author: Column, creator: Column, recorded: Column) -> Column:
    """Which field names the person: the first that holds more than a placeholder."""
    return (
        F.when(person(observer).isNotNull(), "inat_observer")
        .when(person(author).isNotNull() | person(creator).isNotNull(), "author")
        .when(person(recorded).isNotNull(), "recorded_by")
        .otherwise("none")
    )


def occurrence_key(image_key: Column, order: Column, **ids: Column) -> Column:
    """``kind:id`` of the first id that is there (``inat, mo, df20, gbif, photo`` in that order), else of the image, else of the row."""
    options = [F.when(F.coalesce(ids[k], F.lit("")) != "", F.concat(F.lit(f"{k}:"), ids[k])) for k in ("inat", "mo", "df20", "gbif", "photo") if k in ids]
    image = F.when(F.coalesce(image_key, F.lit("")) != "", F.concat(F.lit("photo:"), image_key))
    return F.coalesce(*options, image, F.concat(F.lit("photo:"), order.cast("string")))


def collector_key(observer: Column, author: Column) -> Column:
    squeezed = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    return F.when(squeezed(observer) != "", F.concat(F.lit("inat:"), squeezed(observer))).when(squeezed(author) != "", F.concat(F.lit("author:"), squeezed(author))).otherwise("")


def dataset_name(restricted: Column, commons_file: Column, gbif_id: Column, inat_id: Column, source_url: Column, image_url: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(restricted, "df20")
        .when(has(commons_file) | low(image_url).contains("wikimedia.org") | low(source_url).contains("commons.wikimedia.org"), "commons")
        .when(has(gbif_id) | low(source_url).contains("gbif.org"), "gbif")
        .when(has(inat_id) | low(source_url).contains("inaturalist.org"), "inat")
        .otherwise("external")
    )


def finite(text: Column) -> Column:
    """A finite double, or null."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def whole_count(value: Column) -> Column:
    """A number that counts: finite, whole and not negative; else null."""
    number = finite(value)
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("long"))


def image_ending(url: Column) -> Column:
    """``.jpg``, ``.png`` or ``.webp`` by the path of a URL; ``.jpg`` where it tells nothing."""
    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    out = F.lit(".jpg")
    for e in reversed(ENDINGS):
        out = F.when(path.endswith(e), ".jpg" if e == ".jpeg" else e).otherwise(out)
    return out


def digits_key(value: Column) -> Column:
    """A key of decimal digits only; anything else is null, since it could leave its folder."""
    text = value.cast("string")
    return F.when(text.rlike(r"\A[0-9]+\z"), text)


def safe_stem(value: Column, index: Column) -> Column:
    """A file name's stem of letters, digits, ``-`` and ``_`` with the row's index."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{N}_-]", "-"), r"^[-_]+|[-_]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("photo")), F.lit("-"), F.lpad(index.cast("string"), 5, "0"))


def escaped(identity: Column) -> Column:
    """``%``, ``-``, ``_`` and ``.`` as codes, so that a name can't look like a version."""
    for a, b in (("%", "%25"), ("-", "%2D"), ("_", "%5F"), (".", "%2E")):
        identity = F.replace(identity, F.lit(a), F.lit(b))
    return identity


def unescaped(text: Column) -> Column:
    for a, b in (("%2E", "."), ("%5F", "_"), ("%2D", "-"), ("%25", "%")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cached_identity(name: Column) -> Column:
    """Struct of ``kind`` and ``identity`` of a cache file's name, null if it isn't one."""
    part = lambda i: F.regexp_extract(name, CACHE_NAME, i)
    return F.when(part(1) != "", F.struct(part(1).alias("kind"), unescaped(part(2)).alias("identity")))


def percent(probability: Column) -> Column:
    """One decimal and a per cent sign, clamped to 0 and 100; null unless finite."""
    p = F.when(~F.isnan(probability) & (F.abs(probability) < float("inf")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability)))
    return F.when(p.isNotNull(), F.format_string("%.1f%%", p * 100))


def map_link(lat: Column, lon: Column, platform: Column) -> Column:
    """A link to a place with six decimals for ``ios``, ``android`` or any other platform; null for no place."""

    def link(q: Column) -> Column:
        return (
            F.when(platform == "ios", F.concat(F.lit("https://maps.apple.com/?ll="), q, F.lit("&q="), q))
            .when(platform == "android", F.concat(F.lit("geo:"), q, F.lit("?q="), q))
            .otherwise(F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), q))
        )

    return F.when(usable_place(lat, lon), let(F.format_string("%.6f,%.6f", lat, lon), link))


def tel_link(phone: Column) -> Column:
    """``tel:`` with the digits of a phone number; null for an extension or no digits."""
    text = F.trim(phone)
    number = F.regexp_replace(text, r"[^0-9]", "")
    return F.when((number == "") | text.rlike(EXTENSION), None).when(text.startswith("+"), F.concat(F.lit("tel:+"), number)).when(
        F.length(number) == 9, F.concat(F.lit(f"tel:+{COUNTRY}"), number)
    ).otherwise(F.concat(F.lit("tel:"), number))


def decoded(html: Column) -> Column:
    """Visible text with numeric entities of one character decoded and named ones as a space."""
    from .text import visible_text

    text = F.regexp_replace(visible_text(html), r"(?i)&nbsp;|&#160;", " ")
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,6});"), 1))
    one = lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(c.cast("int")), 8, "0")), "UTF-32"))
    return F.regexp_replace(F.aggregate(codes, text, one), r"(?i)&[a-z]+;", " ")


def phones(text: Column) -> Column:
    """Distinct digits of phone-like numbers: spaced groups of nine digits or more, long runs, and runs of three."""
    edge = lambda body: F.lit(rf"(?<![0-9]){body}(?![0-9])")
    bare = lambda found: F.transform(found, lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    grouped = F.filter(bare(F.regexp_extract_all(text, edge(r"[0-9]{2,4}(?:[  -][0-9]{2,4}){2,}"), 0)), lambda x: F.length(x) >= 9)
    return F.array_distinct(F.concat(grouped, F.regexp_extract_all(text, edge(LONG_PHONE), 0), F.regexp_extract_all(text, edge(SHORT_PHONE), 0)))


def page_phones(html: Column) -> Column:
    """Distinct digits of phone-like numbers in a page's visible text and of its links to call, whatever their length."""
    called = F.transform(F.regexp_extract_all(html, F.lit(TEL_LINK), 1), lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    return F.array_distinct(F.concat(phones(decoded(html)), F.filter(called, lambda x: x != "")))


def photo_name(value: Column, folder: str = "journal-photos") -> Column:
    """A bare file name, or that of a path inside ``folder``; null for anything that could leave the folder."""
    text = F.trim(value)
    bad = text.contains("..") | text.contains("\\") | text.contains("\0") | text.rlike("(?i)%2e|%2f|%5c")
    rest = F.when(~text.contains("/"), text).when(text.contains(f"/{folder}/"), F.substring_index(text, f"/{folder}/", -1))
    return F.when(~bad & rest.rlike(PHOTO_NAME), rest)


def half_up(value: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(value + 0.5)


def preview_widths(width: Column) -> Column:
    """Halvings of a width down to PREVIEW, which comes last; none for a narrow image."""
    steps = F.sequence(F.lit(1), F.lit(20))
    halves = F.filter(F.transform(steps, lambda i: F.floor(width / F.pow(F.lit(2.0), i))), lambda w: w >= PREVIEW)
    ended = F.when((F.size(halves) > 0) & (F.element_at(halves, -1) == PREVIEW), halves).otherwise(F.concat(halves, F.array(F.lit(PREVIEW).cast("long"))))
    return F.when(width <= PREVIEW, F.array().cast("array<bigint>")).otherwise(ended)


def upright_width(width: Column, height: Column, orientation: Column) -> Column:
    """The stored width, or the height where the orientation (5 to 8) swaps the axes; null without a pair."""
    pair = (width >= 1) & (height >= 1)
    return F.when(pair, F.when(orientation.between(5, 8), height).otherwise(width))


def fingerprint(salt: Column) -> Column:
    """The first eight digits of a salt's digest, to tell salts apart without showing them."""
    return F.left(F.sha2(salt, 256), F.lit(8))
