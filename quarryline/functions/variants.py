"""Values of unknown shape: what a field of a parsed JSON record holds, by its own type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons and warnings of a decision.
REJECTIONS = ("not_a_mushroom", "unknown_mushroom", "unclear")
WARNINGS = ("dangerous_genus", "low_confidence")
#: Unicode's white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def kind(value: Column) -> Column:
    """``STRING``, ``BOOLEAN``, ``NUMBER``, ``ARRAY``, ``OBJECT`` or ``VOID``; null where there is nothing."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(name)


def is_object(value: Column) -> Column:
    """Whether there is an object, without a description of all its fields."""
    return F.try_variant_get(value, "$", "struct<_:string>").isNotNull()


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def string(value: Column, path: str) -> Column:
    """The text at ``path`` as it stands, null for any other type."""
    return F.when(kind(at(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def text(value: Column, path: str) -> Column:
    """The trimmed text at ``path``; null if it is blank or none."""
    return F.nullif(stripped(string(value, path)), F.lit(""))


def number(value: Column, path: str) -> Column:
    """The finite number at ``path``; a number in quotes is none."""
    found = F.when(kind(at(value, path)) == "NUMBER", F.try_variant_get(value, path, "double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def true(value: Column, path: str) -> Column:
    return F.coalesce((kind(at(value, path)) == "BOOLEAN") & F.try_variant_get(value, path, "boolean"), F.lit(False))


def elements(value: Column, path: str) -> Column:
    """The elements of the array at ``path``, null for any other type."""
    return F.when(kind(at(value, path)) == "ARRAY", F.try_variant_get(value, path, "array<variant>"))


def candidates(value: Column, path: str) -> Column:
    """The whole candidates of an array: texts ``id, namePl, nameLatin`` and numbers ``confidence, rank``; others are dropped."""
    texts, numbers = ("id", "namePl", "nameLatin"), ("confidence", "rank")

    def whole(c: Column) -> Column:
        good = F.lit(True)
        for n in texts:
            good = good & string(c, f"$.{n}").isNotNull()
        for n in numbers:
            good = good & number(c, f"$.{n}").isNotNull()
        return good

    one = lambda c: F.struct(*[string(c, f"$.{n}").alias(n) for n in texts], *[number(c, f"$.{n}").alias(n) for n in numbers])
    return F.transform(F.filter(elements(value, path), whole), one)

