"""Numbers that texts claim, held against the numbers counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_claims(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, claim, number) of every match; each pattern's first group is the number, thousands separators allowed.

    ``texts``: path, value. Null texts claim nothing.
    """
    found = [
        texts.select("path", F.lit(name).alias("claim"), F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("number")).withColumn("number", F.regexp_replace("number", "[ ,.]", "").cast("bigint"))
        for name, pattern in patterns.items()
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def drifted_claims(claims: DataFrame, counted: DataFrame) -> DataFrame:
    """Claims whose number is not the counted one: path, claim, number, counted. ``counted``: claim, counted."""
    return claims.join(counted, "claim").filter(~F.col("number").eqNullSafe(F.col("counted"))).select("path", "claim", "number", "counted")


def silent_texts(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """Texts that claim no number at all."""
    return texts.select("path").distinct().join(claims.select("path").distinct(), "path", "left_anti")
