"""http URLs that may become https: only resources of which a sample was the same both ways, on hosts without a sample that wasn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .lookups import all_agree


def sample_agrees(http_status: Column, https_status: Column, http_sha256: Column, https_sha256: Column) -> Column:
    """Both answers succeeded and the digests of their bodies, 64 characters each, are equal; what isn't known doesn't agree."""
    good = lambda s: s.between(200, 299)
    return F.coalesce(good(http_status) & good(https_status) & (F.length(http_sha256) == 64) & (http_sha256 == https_sha256), F.lit(False))


def trusted_hosts(samples: DataFrame, agrees: Column) -> DataFrame:
    """``host`` of those that have a sample and all of whose samples agree."""
    own = samples.select(F.lower("host").alias("host"), agrees.alias("_agrees")).where("host IS NOT NULL")
    return all_agree(own, "host", F.col("_agrees")).select("host")


def verified_resources(samples: DataFrame, agrees: Column) -> DataFrame:
    """``host, path, query`` of the samples that agree, on trusted hosts; a sample whose URL names another host counts for that host's trust only by its ``host``."""
    own = samples.select(F.lower("host").alias("_host"), urls.resource(F.col("url")).alias("r"), agrees.alias("_agrees")).where("_agrees AND r IS NOT NULL AND r.host = _host")
    return own.select("r.host", "r.path", "r.query").distinct().join(trusted_hosts(samples, agrees), "host", "left_semi")


def upgraded_urls(df: DataFrame, row: str, columns: list[str], samples: DataFrame, agrees: Column) -> DataFrame:
    """All ``columns`` of a row as https, or all as they were with the ``reason`` of the first that can't change.

    https URLs and blanks need nothing. An http URL needs a trusted host
    (``http_host_not_allowlisted``) and its own resource among the verified
    ones (``https_not_verified_for_url``); anything else is
    ``url_not_https``. ``row`` is a key of ``df``. Each URL is looked up by
    its resource, so a row of several is one group of a few lookups.
    """
    hosts = trusted_hosts(samples, agrees).withColumn("_trusted", F.lit(True))
    known = verified_resources(samples, agrees).withColumn("_known", F.lit(True))
    long = df.select(F.col(row).alias("_row"), F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_i", "_url")).where(F.trim("_url") != "")
    scheme = F.lower(F.regexp_extract(F.trim("_url"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    asked = long.where(scheme != "https").withColumn("_r", urls.resource(F.col("_url"))).select("_row", "_i", "_r.*")
    met = asked.join(hosts, "host", "left").join(known, ["host", "path", "query"], "left")
    reason = F.when(F.col("host").isNull(), "url_not_https").when(F.col("_trusted").isNull(), "http_host_not_allowlisted").when(F.col("_known").isNull(), "https_not_verified_for_url")
    told = met.select("_row", "_i", reason.alias("reason")).where("reason IS NOT NULL").groupBy("_row").agg(F.min_by("reason", "_i").alias("reason"))
    joined = df.drop("reason").join(told, F.col(row) == F.col("_row"), "left").drop("_row")
    return joined.withColumns({c: F.when(F.col("reason").isNull(), urls.force_https(F.col(c))).otherwise(F.col(c)) for c in columns})
