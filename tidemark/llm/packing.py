"""Filling fixed-capacity containers with items.

Method: vector best fit. Every container has three residual capacities - tokens,
documents and attention cost (sum of squared lengths). Items come in order of
falling size; each goes to the container, among those that can take it under
every constraint, whose weighted residual norm is least afterwards.
"""

from __future__ import annotations

import base64
import importlib.util
import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
GROUP = 8_000  # items packed together in one task
WEIGHTS = (1.0, 0.02, 0.02)  # of residual tokens, documents and attention cost
MAX_BUDGETS = 1_000

_PIECES = "budget_name string, capacity bigint, group_no bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, container_no bigint"


@cache
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A public byte-level tokenizer from the given folder; never trained, never copied."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) over whole texts. Null and empty texts count 0; rows without an id are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("int64"), "n_tokens": np.array([len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]], dtype=np.int64)})

    known = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    return spread(known).mapInPandas(run, "doc_id bigint, n_tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item; ``sizes`` fall. No item exceeds ``capacity``.

    An item that alone exceeds ``max_cost`` has a container of its own. Full containers are
    taken off the list, so a step looks at the open ones only.
    """
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    caps = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    if n and (sizes.max() > capacity or max_docs < 1):
        raise ValueError("an item alone exceeds a container")
    w = np.asarray(weights, dtype=np.float64)
    smallest = sizes[-1] if n else 0
    rest = np.empty((256, 3))  # residual capacities of the open containers
    names = np.empty(256, dtype=np.int64)
    used, made = 0, 0
    for i in range(n):
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        if need[2] > max_cost:
            out[i] = made
            made += 1
            continue
        after = rest[:used] - need
        able = (after >= 0).all(axis=1)
        if able.any():
            norm = ((after / caps) ** 2) @ w
            norm[~able] = np.inf
            b = int(norm.argmin())
        else:
            if used == len(rest):
                rest, names = np.concatenate([rest, np.empty_like(rest)]), np.concatenate([names, np.empty_like(names)])
            b = used
            rest[b], names[b] = caps, made
            used, made = used + 1, made + 1
        rest[b] -= need
        out[i] = names[b]
        if rest[b, 0] < smallest or rest[b, 1] < 1:
            used -= 1
            rest[b], names[b] = rest[used], names[used]
    return out


def limits(capacity: int, docs_per_token: float = 1 / 8, cost_share: float = 1.0) -> tuple[int, float]:
    """Documents and attention cost a container of ``capacity`` tokens may hold."""
    return max(1, math.ceil(capacity * docs_per_token)), cost_share * float(capacity) ** 2


def _pack(f: pd.DataFrame, docs_per_token: float, cost_share: float, weights: tuple[float, float, float]) -> pd.DataFrame:
    f = f.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    capacity = int(f["capacity"].iloc[0])
    max_docs, max_cost = limits(capacity, docs_per_token, cost_share)
    f["container_no"] = best_fit(f["n_tokens"].to_numpy(), capacity, max_docs, max_cost, weights)
    return f[["budget_name", "capacity", "group_no", "doc_id", "piece_no", "token_start", "n_tokens", "container_no"]]


def pack(
    docs: DataFrame, doc: str, text: str, budgets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, group: int = GROUP,
    docs_per_token: float = 1 / 8, cost_share: float = 1.0, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """Assigns every document to a container, for each budget.

    ``budgets``: budget_name, capacity_tokens (null or less than 1: left out; equal
    names: told apart by capacity). Output: budget_name, capacity_tokens, container_id, doc_id,
    piece_no, token_start, n_tokens. A container holds at most capacity tokens, capacity *
    ``docs_per_token`` documents and an attention cost (sum of squared lengths) of
    ``cost_share`` * capacity ** 2, unless one document alone costs more. At a cost_share of 1
    the tokens alone bind; below, short documents join long ones less and the cost is spread. A document of more tokens than the capacity is
    cut into full pieces and a rest, numbered from 0; no other is cut. Null and empty
    texts have nothing to place and give no rows. Repeated rows are packed each; equal
    doc_ids are not told apart.

    Items are packed in groups of some ``group`` rows drawn by hash, whose number
    grows with the table; each group leaves a container or two less than full.
    """
    sizes = durable(token_counts(docs, doc, text, folder, vocabulary).filter(F.col("n_tokens") > 0))
    rows = budgets.filter(F.col("capacity_tokens") >= 1).select("budget_name", "capacity_tokens").distinct().limit(MAX_BUDGETS + 1).collect()
    if len(rows) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    groups = max(1, -(-sizes.count() // group))
    kinds = "array<struct<budget_name:string,capacity:bigint>>"
    each = sizes.withColumn("b", F.explode(F.array(*[F.struct(F.lit(r["budget_name"]).alias("budget_name"), F.lit(int(r["capacity_tokens"])).cast("bigint").alias("capacity")) for r in rows]).cast(kinds)))
    each = each.select("doc_id", "n_tokens", "b.budget_name", "b.capacity")
    cut = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece_no").cast("bigint") * F.col("capacity")
    pieces = cut.select(
        "budget_name", "capacity", "doc_id", "piece_no", start.alias("token_start"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).alias("group_no"))
    packed = pieces.groupBy("budget_name", "capacity", "group_no").applyInPandas(lambda f: _pack(f, docs_per_token, cost_share, weights), _PIECES)
    name = F.concat_ws("-", F.coalesce("budget_name", F.lit("")), F.col("capacity"), F.col("group_no"), F.col("container_no"))
    return packed.select("budget_name", F.col("capacity").alias("capacity_tokens"), name.alias("container_id"), "doc_id", "piece_no", "token_start", "n_tokens")


def fill(assignment: DataFrame) -> DataFrame:
    """Per budget: containers, tokens placed, the share of room left unused, the least possible number of containers, and the mean and largest attention cost as a share of capacity ** 2."""
    each = assignment.groupBy("budget_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost"))
    cost = F.col("cost") / F.col("capacity_tokens").cast("double") ** 2
    per = each.groupBy("budget_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.avg(cost).alias("mean_cost"), F.max(cost).alias("most_cost"))
    return per.select(
        "budget_name", "capacity_tokens", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"),
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), "mean_cost", "most_cost")


def checks(assignment: DataFrame) -> DataFrame:
    """Per budget: documents placed, containers over capacity, documents whose pieces leave gaps, overlap or are cut without need."""
    per = assignment.groupBy("budget_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_name", "capacity_tokens").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over"))
    own = assignment.groupBy("budget_name", "capacity_tokens", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("piece_no").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.min("token_start").alias("start"))
    broken = (F.col("tokens") != F.col("end")) | (F.col("start") != 0) | (F.col("n") != F.col("pieces")) | (F.col("n") != F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    docs = own.groupBy("budget_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(broken).alias("n_broken"))
    return docs.join(per, ["budget_name", "capacity_tokens"]).select("budget_name", "capacity_tokens", "n_documents", "n_broken", "n_over")
