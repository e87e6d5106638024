"""Keys of captions by species and pictured feature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of species ids by genus, single species, and the caption keys; the first rule of a feature that fits holds.
GENUS = "amanita_"
KEYS = {
    "C": [("cap", [], [])],
    "W": [("amanitaWhole", [GENUS], []), ("chlorophyllumWhole", [], ["chlorophyllum_rhacodes"]), ("swollenBaseNotVolva", [], ["inocybe_erubescens", "agaricus_xanthodermus"]), ("wholeStemBase", [], [])],
    "Y": [("amanitaYoung", [GENUS], []), ("young", [], [])],
    "": [
        ("undersideStem", [], ["gyromitra_esculenta"]), ("tubes", [], ["suillellus_luridus", "rubroboletus_satanas"]), ("gillsCortina", ["cortinarius_"], ["hypholoma_fasciculare"]),
        ("gillsRing", [GENUS, "galerina_", "agaricus_", "chlorophyllum_"], []), ("gills", [], []),
    ],
}


def feature_key(species: Column, feature: Column) -> Column:
    """``gallery.feature...`` of a species' picture; features other than cap, whole and young show the underside."""

    def first(rules: list) -> Column:
        out = F.lit(rules[-1][0])
        for name, genera, single in reversed(rules[:-1]):
            fits = species.isin(*single)
            for g in genera:
                fits = fits | species.startswith(g)
            out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
        return out

    out = first(KEYS[""])
    for f, rules in KEYS.items():
        out = F.when(feature == f, first(rules)).otherwise(out) if f else out
    return F.concat(F.lit("gallery.feature."), out)
