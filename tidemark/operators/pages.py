"""From fetched bytes to comparable text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def normalized_pages(df: DataFrame, raw: str = "raw_bytes", kind: str | None = None) -> DataFrame:
    """Adds raw_sha256, page_text, normalized_sha256 and detection_sha256.

    HTML is stripped in built-in expressions; only rows with entities beyond the
    common ones pass through Python. Binary rows have an empty text and are
    compared by their bytes. Null bytes give nulls.
    """
    kinds = F.col(kind) if kind else F.lit("html")
    based = df.withColumn("__tm_kind", kinds).withColumn("__tm_bare", F.when(F.col("__tm_kind") == "html", T.without_tags(T.decoded(F.col(raw)))))
    rare = based.withColumn("__tm_rare", F.when(T.has_rare_entity(F.col("__tm_bare")), F.col("__tm_bare")))
    plain = F.coalesce(T.unescaped(F.col("__tm_rare")), T.common_entities(F.col("__tm_bare")))
    text = F.when(F.col("__tm_kind") == "html", T.normalized_text(F.col("__tm_plain"))).when(F.col("__tm_kind") == "text", T.normalized_text(T.decoded(F.col(raw)))).otherwise(F.lit(""))
    out = rare.withColumn("__tm_plain", plain).withColumn("page_text", F.when(F.col(raw).isNotNull(), text))
    out = out.withColumn("raw_sha256", T.sha256(F.col(raw)))
    out = out.withColumn("normalized_sha256", F.when(F.col("__tm_kind") == "binary", F.lit("")).otherwise(T.sha256(F.col("page_text"))))
    out = out.withColumn("detection_sha256", F.when(F.col("__tm_kind") == "binary", F.col("raw_sha256")).otherwise(F.col("normalized_sha256")))
    return out.drop("__tm_kind", "__tm_bare", "__tm_rare", "__tm_plain")


def with_title(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds ``out``, the page's own title with all entities decoded, case kept; '' without one. Only rows with rare entities pass through Python."""
    based = df.withColumn("__tm_title", T.title_markup(T.decoded(F.col(raw))))
    rare = based.withColumn("__tm_rare", F.when(T.has_rare_entity(F.col("__tm_title")), F.col("__tm_title")))
    plain = F.coalesce(T.unescaped(F.col("__tm_rare")), T.common_entities(F.col("__tm_title")))
    return rare.withColumn("__tm_plain", plain).withColumn(out, T.collapsed(F.col("__tm_plain"))).drop("__tm_title", "__tm_rare", "__tm_plain")
