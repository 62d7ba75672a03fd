"""Published artifacts: rendered in memory, validated, then written by staging and rename.

What is published is per-jurisdiction summaries and feeds of bounded size; large
tables are written by Spark itself, partitioned.
"""

from __future__ import annotations

import html
import json
import os
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def feed_items(changes: DataFrame) -> DataFrame:
    """change_id, jurisdiction, published_at (ISO), pub_date (RFC 2822), guid and escaped title of changes.

    A record that is no longer active gets a guid of its own from its lifecycle fields.
    """
    at = F.coalesce("lifecycle_at", "observed_at")
    moved = F.concat_ws("-", "change_id", F.lit("lifecycle"), F.substring(T.event_id(F.col("change_id"), F.col("publication_status"), F.col("superseded_by"), F.col("lifecycle_reason"), F.col("lifecycle_actor"), T.iso_utc(F.col("lifecycle_at"))), 1, 16))
    title = F.concat_ws(" ", "jurisdiction", "document_class", "kind")
    return changes.select(
        "change_id", "jurisdiction", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), T.rfc2822(at).alias("pub_date"),
        F.when(F.col("publication_status") == "active", F.col("change_id")).otherwise(moved).alias("guid"), T.xml_escaped(title).alias("title"), T.xml_escaped(F.coalesce("url", F.lit(""))).alias("link"))


def feed_xml(items: DataFrame, title: str) -> str:
    """An RSS 2.0 document of all items, newest first; an empty one says so in a comment. Rows are streamed to the driver."""
    rows = items.orderBy(F.col("published_at").desc(), F.col("change_id").desc()).toLocalIterator()
    body = "\n".join(f"<item><title>{r['title']}</title><link>{r['link']}</link><guid isPermaLink=\"false\">{r['guid']}</guid><pubDate>{r['pub_date']}</pubDate></item>" for r in rows)
    head = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>{head}</title>\n{body or "<!-- nothing published -->"}\n</channel></rss>\n'


def json_rows(df: DataFrame, *sort: str) -> Column:
    """Rows as one JSON string each, fields in their order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def write_changes_by_jurisdiction(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per jurisdiction, written by the executors."""
    df.repartition("jurisdiction").sortWithinPartitions("observed_at", "change_id").write.mode("errorifexists").partitionBy("jurisdiction").json(path)


def baseline_document(latest: DataFrame, registered: list[str], generated_at: str) -> str:
    """The portable baseline file of a registry: hashes by source, and the sources without one.

    ``latest``: source_id, url, sha256, observed_at, normalizer_version,
    extractor_version of registered sources. Bounded by the registry's size.
    """
    rows = {r["source_id"]: r.asDict() for r in latest.filter(F.coalesce("sha256", F.lit("")) != "").collect()}
    baselines = {k: {c: str(v[c]) for c in ("url", "sha256", "observed_at", "normalizer_version", "extractor_version")} for k, v in sorted(rows.items())}
    return json.dumps({"baseline_version": "1.0", "generated_at": generated_at, "registry_sources": len(registered), "unreachable": sorted(set(registered) - set(rows)), "baselines": baselines}, indent=2, ensure_ascii=False) + "\n"


def status_document(run: dict | None, now: str) -> str:
    """Status of the last run as JSON; without a run the state is 'unknown'."""
    return json.dumps({"schema_version": "1.1", "generated_at": now, "state": run["state"] if run else "unknown", "run": {k: str(v) if v is not None else None for k, v in run.items()} if run else None}, indent=2) + "\n"


def publish(rendered: dict[str, str], folder: str) -> None:
    """Writes all files or none: into a staging folder beside the target, then renamed into place."""
    for name in rendered:
        if os.path.isabs(name) or ".." in name.split("/"):
            raise ValueError(f"not a file below the folder: {name}")
    stage = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        for name, text in rendered.items():
            target = os.path.join(stage, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="\n") as f:
                f.write(text)
        old = f"{stage}.old"
        if os.path.exists(folder):
            os.rename(folder, old)
        os.rename(stage, folder)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def registry_document(entries: list[dict], gaps: list[dict], version: str = "1.0") -> str:
    """The registry file: pretty, with each innermost block on one line. Reading it back gives the same entries."""
    text = json.dumps({"registry_version": version, "sources": entries, "gaps": gaps}, indent=2, ensure_ascii=False)
    leaf = re.compile(r'\{((?:"(?:[^"\\]|\\.)*"|[^{}\[\]"])*)\}')
    text = leaf.sub(lambda m: "{" + re.sub(r"\s*\n\s*", " ", m[1]).strip() + "}" if len(m[1]) < 400 else m[0], text)
    if json.loads(text) != {"registry_version": version, "sources": entries, "gaps": gaps}:
        raise ValueError("the rendered registry does not read back")
    return text + "\n"


def receipt_lines(df: DataFrame, path: str) -> None:
    """Appends decisions as JSON lines; an evidence dataset is never rewritten."""
    df.write.mode("append").json(path)


def site_page(title: str, rows: DataFrame, columns: list[str]) -> str:
    """A static page with one table of all rows; everything escaped."""
    cells = rows.select(*[T.xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).toLocalIterator()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{r[c]}</td>" for c in columns) + "</tr>\n" for r in cells)
    return f"<!doctype html>\n<meta charset=\"utf-8\">\n<title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n<table><tr>{head}</tr>\n{body}</table>\n"


def jurisdiction_artifacts(changes: DataFrame, jurisdictions: list[str]) -> dict[str, str]:
    """A feed and a page for every registered jurisdiction, also those without changes."""
    items = feed_items(changes)
    out = {}
    for j in jurisdictions:
        own = items.filter(F.col("jurisdiction") == j)
        slug = "us" if j == "US" else f"us-{j.lower()}"
        out[f"feeds/{slug}.xml"] = feed_xml(own, f"Changes: {j}")
        out[f"{slug}.html"] = site_page(f"Changes: {j}", own.orderBy(F.col("published_at").desc(), F.col("change_id").desc()), ["published_at", "title", "link"])
    return out
