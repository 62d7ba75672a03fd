"""Lines repeated across one site's documents.

Method: hash the letters of each line, count the distinct documents per site and
hash, keep the hashes over the threshold, join them back, rebuild the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.looks import with_canonical
from tidemark.session import durable

BROADCAST_ROWS = 500_000  # repeated lines (24 bytes each) up to which they are broadcast


def site_of(url: Column) -> Column:
    """Host in lower case without user, port, trailing dot and one leading 'www.'; '' where there is none."""
    rest = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(rest, r"^.*@|:\d*$|\.(:\d*)?$", "")
    return F.regexp_replace(host, r"^www\.", "")


def line_table(df: DataFrame, doc: str, group: str, url: str, text: str) -> DataFrame:
    """Compact lines: doc, s (hash of the site), g (hash of the group), h1, h2 (hash of site and letters), line_no from 1.

    Null texts and lines without letters give no rows. A null url is its own site ''.
    """
    looked = with_canonical(df.select(doc, group, url, text), text, "__tm_text")
    lines = looked.select(
        F.col(doc), F.xxhash64(group).alias("g"), F.col(group).isNull().alias("no_group"), F.coalesce(site_of(F.col(url)), F.lit("")).alias("site"),
        F.posexplode(F.split(letters_lines(F.col("__tm_text")), "\n", -1)).alias("pos", "letters"),
    ).filter(F.col("letters") != "")
    return lines.select(
        F.col(doc), F.xxhash64("site").alias("s"), F.when(~F.col("no_group"), F.col("g")).alias("g"), F.xxhash64(F.lit("a"), "site", "letters").alias("h1"), F.xxhash64(F.lit("b"), "site", "letters").alias("h2"), (F.col("pos") + 1).cast("int").alias("line_no"))


def letters_lines(text: Column) -> Column:
    """A text with only what counts when lines are compared: letters with their accents, case folded; lines stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\n]+", "")


def repeated_lines(lines: DataFrame, doc: str, min_groups: int = 5, min_share: float = 0.0) -> DataFrame:
    """(doc, line_no, n_groups) of every line found in at least ``min_groups`` groups of its site and at least ``min_share`` of them.

    Rows without a group do not count towards the threshold but are found. Counting is
    pre-aggregated per (line, group). The repeated lines are broadcast while their number
    is within bounds; beyond, the join back is salted by the cluster's cores, so a line
    that stands on a third of all documents is spread over all of them.
    """
    grouped = lines.filter(F.col("g").isNotNull())
    counts = grouped.select("s", "h1", "h2", "g").distinct().groupBy("s", "h1", "h2").agg(F.count(F.lit(1)).alias("n_groups"))
    often = counts.filter(F.col("n_groups") >= min_groups)
    if min_share > 0:
        of = grouped.select("s", "g").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("of"))
        often = often.join(of, "s").filter(F.col("n_groups") >= F.col("of") * min_share)
    often = durable(often.select("h1", "h2", "n_groups"))
    if often.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(often), ["h1", "h2"]).select(doc, "line_no", "n_groups")
    salts = lines.sparkSession.sparkContext.defaultParallelism
    spread = often.select("h1", "h2", "n_groups", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = lines.select(doc, "h1", "h2", "line_no", F.pmod(F.xxhash64(doc, "line_no"), F.lit(salts)).cast("int").alias("salt"))
    return salted.join(spread, ["h1", "h2", "salt"]).select(doc, "line_no", "n_groups")


def repeated_lines_of(df: DataFrame, doc: str, group: str, url: str, text: str, min_groups: int = 5, min_share: float = 0.0) -> DataFrame:
    """The whole path from documents to their repeated lines."""
    return repeated_lines(durable(line_table(df, doc, group, url, text)), doc, min_groups, min_share)


def without_lines(df: DataFrame, doc: str, text: str, lines: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the text without the given (doc, line_no) lines.

    Documents without such lines keep their text; null stays null; a text all of
    whose lines go becomes ''. ``doc`` must be unique.
    """
    drop = lines.select(F.col(doc).alias("__tm_doc"), "line_no").distinct().groupBy("__tm_doc").agg(F.collect_set("line_no").alias("__tm_drop"))
    joined = df.join(drop, df[doc] == drop["__tm_doc"], "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col("__tm_drop"), i + 1))
    return joined.withColumn(out, F.when(F.col("__tm_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__tm_doc", "__tm_drop")
