"""Append-only datasets committed run by run.

A run writes ``<root>/<name>/run_id=<id>/`` and then its manifest by rename; readers
see the runs that have a manifest, so a run that died half-way is invisible. One
driver writes at a time; nothing is ever changed in place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = re.compile(r"[0-9a-zA-Z_-]{1,64}")


class RunStore:
    """``root`` lies in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
        """``schemas`` gives each dataset's columns as DDL; a root written under others is refused."""
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        os.makedirs(f"{self.root}/manifests", exist_ok=True)
        digest = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(schemas.items())}
        path = f"{self.root}/schemas.json"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                known = json.load(f)
            if any(known[k] != digest[k] for k in known if k in digest) or set(known) - set(digest):
                raise ValueError("the store was written under other schemas")
        self._place(path, digest)

    @staticmethod
    def _place(path: str, content: object) -> None:
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(content, f, sort_keys=True)
        os.replace(f"{path}.new", path)

    def committed(self) -> list[str]:
        return sorted(n[:-5] for n in os.listdir(f"{self.root}/manifests") if n.endswith(".json"))

    def append(self, run_id: str, frames: dict[str, DataFrame], receipt: dict | None = None) -> None:
        """Writes a run's frames and commits them. A run is committed once; columns must be the dataset's."""
        if not _ID.fullmatch(run_id) or run_id in self.committed():
            raise ValueError(f"run {run_id!r} is malformed or committed already")
        for name, df in frames.items():
            want = self.spark.createDataFrame([], self.schemas[name]).schema
            if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
                raise ValueError(f"{name}: columns differ from the schema")
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run_id}")
        self._place(f"{self.root}/manifests/{run_id}.json", {"datasets": sorted(frames), "receipt": receipt or {}})

    def read(self, name: str) -> DataFrame:
        """All committed rows of a dataset, with their run_id."""
        runs = [r for r in self.committed() if os.path.isdir(f"{self.root}/{name}/run_id={r}")]
        empty = self.spark.createDataFrame([], self.schemas[name] + ", run_id string")
        if not runs:
            return empty
        rows = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/run_id={r}" for r in runs])
        return rows.withColumn("run_id", F.col("run_id").cast("string")) if "run_id" in rows.columns else rows.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"run_id=([^/]+)/", 1))
