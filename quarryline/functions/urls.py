"""Column expressions on URLs: two canonical forms, the upgrade to https, and a syntax check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _port(netloc: Column) -> Column:
    """The text after the host's colon: empty if there is none."""
    return F.regexp_extract(F.regexp_replace(netloc, r"^.*@", ""), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def _host(netloc: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(netloc, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def _port_ok(port: Column) -> Column:
    return (port == "") | (port.rlike(r"^[0-9]{1,9}$") & (F.coalesce(port.try_cast("int"), F.lit(-1)).between(0, 65535)))


def canonical_url(url: Column) -> Column:
    """Without fragment, query and one trailing slash; scheme and host in lower case, the scheme kept."""
    text = F.regexp_replace(F.trim(url), r"[#?].*$", "")
    text = F.regexp_replace(text, "/$", "")
    scheme, netloc = _part(text, 1), _part(text, 2)
    return F.when((scheme == "") | (netloc == ""), text).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(netloc), _part(text, 3)))


def _split(url: Column, body) -> Column:
    """``body`` of a struct of scheme, netloc, path, query and fragment; those of no URL are empty."""
    names = ("scheme", "netloc", "path", "query", "fragment")
    return let(F.struct(*[_part(url, i + 1).alias(n) for i, n in enumerate(names)]), body)


def force_https(url: Column) -> Column:
    """http becomes https without its port if that is 80 or 443; other schemes stay."""

    def upgraded(text: Column, p: Column) -> Column:
        more = lambda x: F.when(F.length(x) > 1, x).otherwise("")
        tail = F.concat(p["path"], more(p["query"]), more(p["fragment"]))
        user = F.regexp_extract(p["netloc"], r"^(.*)@", 1)
        name, word = F.regexp_extract(user, r"^([^:]*)", 1), F.regexp_extract(user, r"^[^:]*:(.*)$", 1)
        auth = F.when(name == "", "").when(word == "", F.concat(name, F.lit("@"))).otherwise(F.concat(name, F.lit(":"), word, F.lit("@")))

        def with_port(h: Column) -> Column:
            number = F.when((h["port"] == "") | h["port"].rlike("^0*(80|443)$"), "").otherwise(F.concat(F.lit(":"), h["port"].try_cast("int").cast("string")))
            return F.when((h["host"] == "") | ~_port_ok(h["port"]), text).otherwise(F.concat(F.lit("https://"), auth, h["host"], number, tail))

        secure = let(F.struct(_host(p["netloc"]).alias("host"), _port(p["netloc"]).alias("port")), with_port)
        return (
            F.when(p["scheme"] == "https", text)
            .when(F.lower(p["scheme"]) == "https", F.concat(F.lit("https://"), p["netloc"], tail))
            .when(F.lower(p["scheme"]) == "http", secure)
            .otherwise(text)
        )

    text = F.regexp_replace(F.trim(url), "^//", "https://")
    return let(text, lambda t: _split(t, lambda p: upgraded(t, p)))


def canonical_image_url(url: Column) -> Column:
    """The https form without query and fragment; a path of a lone slash stays; blank gives empty."""

    def short(t: Column, p: Column) -> Column:
        path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
        usable = F.lower(p["scheme"]).isin("http", "https") & (p["netloc"] != "")
        return F.when(usable, F.concat(F.lower(p["scheme"]), F.lit("://"), F.lower(p["netloc"]), path)).otherwise(t)

    blank = F.coalesce(F.trim(url), F.lit("")) == ""
    return F.when(blank, "").otherwise(let(force_https(url), lambda t: _split(t, lambda p: short(t, p))))


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, or null: length, control character, scheme, host, port."""
    netloc = _part(url, 2)
    port = _port(netloc)
    return (
        F.when(url.isNull() | (url == "") | (F.length(url) > 8192), "length")
        .when(url.rlike(r"[\p{Cc}\p{Cf}]"), "control")
        .when(~F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), "scheme")
        .when(_host(netloc) == "", "host")
        .when(~_port_ok(port), "port")
        .when((port != "") & ~port.rlike("^0*(80|443)$"), "port")
    )


def resource(url: Column) -> Column:
    """Host in lower case, path and query of an http or https URL as a struct; null for any other text. User, port and fragment don't count."""
    text = F.trim(url)
    host = _host(_part(text, 2))
    query = F.substring(_part(text, 4), 2, 1 << 30)
    return F.when(F.lower(_part(text, 1)).isin("http", "https") & (host != ""), F.struct(host.alias("host"), _part(text, 3).alias("path"), query.alias("query")))
