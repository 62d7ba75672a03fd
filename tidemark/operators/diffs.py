"""Differences between two texts, as unified diffs or as rows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import passages

CONTEXT, LIMIT = 2, 4_000


def unified(old: str | None, new: str | None, url: str | None = None, recorded: str | None = None) -> str | None:
    """Unified diff of passages with its header, cut at LIMIT characters; null if either side is.

    Two empty texts are a binary page. Texts of the same passages differ in markup only.
    ``recorded`` names the contract that the old side was recorded under where it had to be
    derived again; the note on it stands before the diff and is never cut.
    """
    if old is None or new is None:
        return None
    note = f"(old side derived again from its bytes, recorded under {recorded})\n\n" if recorded else ""
    at = f" See {url}." if url else ""
    if not old and not new:
        return f"{note}(binary page: no text to compare.{at})"
    a, b = ([x for x in t.split("\n") if x] for t in (old, new))
    out = "\n".join(difflib.unified_diff(a, b, "previous", "current", lineterm="", n=CONTEXT))
    if not out:
        return f"{note}(no difference in passages: the change is in markup.{at})"
    return note + (out if len(out) <= LIMIT else f"{out[:LIMIT]}\n[cut at {LIMIT} characters]")


@F.pandas_udf(StringType())
def _unified_udf(old: pd.Series, new: pd.Series, url: pd.Series, recorded: pd.Series) -> pd.Series:
    return pd.Series([unified(*x) for x in zip(old, new, url, recorded)])


def unified_diffs(changed: DataFrame, old: str, new: str, out: str, url: str | None = None, recorded: str | None = None) -> DataFrame:
    """Adds ``out``. Give it changed rows only: Python sees every row."""
    column = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return changed.withColumn(out, _unified_udf(F.col(old), F.col(new), column(url), column(recorded)))


def passage_rows(changed: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """Passages lost and gained, as a multiset: key, passage, n_removed, n_added. Order does not count."""
    sides = [changed.select(*key, F.explode(passages(F.col(c))).alias("passage"), F.lit(n).alias("n")) for c, n in ((old, -1), (new, 1))]
    sums = sides[0].unionByName(sides[1]).groupBy(*key, "passage").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
    return sums.select(*key, "passage", F.greatest(-F.col("n"), F.lit(0)).cast("bigint").alias("n_removed"), F.greatest(F.col("n"), F.lit(0)).cast("bigint").alias("n_added"))
