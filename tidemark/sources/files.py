"""JSON and text sources with explicit schemas; a malformed file fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = """id string, jurisdiction string, document_class string, url string, authority string, notes string, verified boolean, active boolean,
checked struct<at:string,status:int,reachable:boolean>, verification struct<status:string,verifier:string,at:string,note:string,evidence:string,expires_at:string>,
fetch_policy struct<outcome:string,reviewer:string,at:string,expires_at:string,evidence:string,reason:string>"""
GAP = "jurisdiction string, document_class string, reason string, hosts array<string>, checked string, detail string"
BASELINE = "url string, sha256 string, observed_at string, normalizer_version string, extractor_version string"
#: digest of nothing; it never stands for a page
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_registry(spark: SparkSession, path: str, version: str = "1.0") -> tuple[DataFrame, DataFrame]:
    """Entries and gaps of a registry file.

    Raises for a missing or malformed file, another version, or no entries. Absent
    blocks mean unverified and unreviewed; absent flags mean verified false, active true.
    """
    doc = _document(spark, path, f"registry_version string, sources array<struct<{_colons(ENTRY)}>>, gaps array<struct<{_colons(GAP)}>>")
    head = doc.select("registry_version", F.size("sources").alias("n")).collect()
    if len(head) != 1 or head[0]["registry_version"] != version or (head[0]["n"] or 0) < 1:
        raise ValueError("not a registry of this version with entries")
    entries = doc.select(F.posexplode("sources").alias("position", "s")).select("position", "s.*")
    entries = entries.withColumns({"verified": F.coalesce("verified", F.lit(False)), "active": F.coalesce("active", F.lit(True))})
    return entries, doc.select(F.explode("gaps").alias("g")).select("g.*")


def read_baselines(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """source_id and its baseline. Unknown contract parts are 'unrecorded'; the digest of nothing is refused."""
    doc = _document(spark, path, f"baseline_version string, baselines map<string,struct<{_colons(BASELINE)}>>")
    head = doc.select("baseline_version").collect()
    if len(head) != 1 or head[0][0] != version:
        raise ValueError("not a baseline file of this version")
    rows = doc.select(F.explode("baselines").alias("source_id", "b")).select("source_id", "b.*")
    checked = F.when(F.col("sha256") == EMPTY_SHA256, F.raise_error(F.lit("a baseline of an empty text"))).otherwise(F.col("sha256"))
    return rows.select(
        "source_id", F.coalesce("url", F.lit("")).alias("url"), checked.alias("sha256"), "observed_at",
        F.coalesce("normalizer_version", F.lit("unrecorded")).alias("normalizer_version"), F.coalesce("extractor_version", F.lit("unrecorded")).alias("extractor_version"))


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole text files: path, value."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def _colons(ddl: str) -> str:
    """'a int, b string' as the inside of a struct type."""
    out, depth = [], 0
    for part in ddl.replace("\n", " ").split(","):
        part = part.strip()
        if depth == 0 and " " in part:
            name, kind = part.split(" ", 1)
            part = f"{name}:{kind.strip()}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)
