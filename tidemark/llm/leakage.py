"""Evaluation texts leaking into training text.

Method: rare n-grams of the test items are joined with the n-grams of the corpus;
the documents and items they bring together are aligned by Smith-Waterman over
words (characters in scripts without blanks), which bears edits and gaps. The test
items are the query set: they go to the documents in blocks of bounded size, so the
join and the alignment happen where a document is read and no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, spread

N_WORDS = 3  # words in a seed
N_HAN = 5  # characters in a seed of Han text
MAX_ITEMS = 3  # an n-gram in at most so many different item texts is a seed
STRETCH = 8  # of every so many n-grams of an item the rarest is a seed in any case
EDIT_SPACING = 4  # replaced words this far apart still leave a seed between each two
RARE = 0.3  # share of an item's rare seeds found, of the share of its words found; a word in EDIT_SPACING replaced leaves a third
BLOCK_CHARS = 20_000_000  # characters of item texts sent to the documents at once
MATCH, MISMATCH, GAP = 1, -2, -2
MIN_SEGMENT = 7  # score of the weakest passage that counts; a third of the words of shorter items
MIN_SHARE = 1 / 3
PIECE = 600  # words of an item aligned at once; pieces of longer items must follow in order
WINDOW = 40  # item lengths of a document aligned at once
NEAR = 3  # passages may lie so many item lengths apart

_TOKENS = re.compile(r"[㐀-䶿一-鿿぀-ヿ]|[^\W_㐀-䶿一-鿿぀-ヿ]+")
_HAN = re.compile(r"[㐀-鿿぀-ヿ]")


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation; Han and Kana characters one by one."""
    return _TOKENS.findall(text.lower())


@lru_cache(1 << 17)
def _short_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _hash(word: str) -> int:
    return _short_hash(word) if len(word) <= 64 else xxhash.xxh3_64_intdigest(word) - (1 << 63)


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and whether each is a Han or Kana character."""
    t = tokens(text)
    one = _short_hash if len(max(t, key=len, default="")) <= 64 else _hash
    h = np.fromiter(map(one, t), dtype=np.int64, count=len(t))
    if text.isascii() or not _HAN.search(text):
        return h, np.zeros(len(t), dtype=bool)
    return h, np.fromiter((len(x) == 1 and ("\u3040" <= x <= "\u30ff" or "\u3400" <= x <= "\u9fff") for x in t), dtype=bool, count=len(t))


def seeds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams with their positions: N_WORDS words, N_HAN where all are Han characters."""
    h, han = hashes(text)
    outs, ats = [], []
    for n, pure in ((N_WORDS, False), (N_HAN, True)):
        if len(h) < n or (pure and not han.any()):
            continue
        g = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            g = (g * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : len(h) - n + 1 + k].view(np.uint64) + np.uint64(k + n))
        if not han.any():
            outs.append(g.view(np.int64))
            ats.append(np.arange(len(g)))
            continue
        sums = np.concatenate([[0], np.cumsum(han)])
        inside = sums[n:] - sums[:-n]
        keep = inside == n if pure else inside < n
        outs.append(g[keep].view(np.int64))
        ats.append(np.flatnonzero(keep))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(outs), np.concatenate(ats)


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Smith-Waterman of two hash arrays: best score and the matched (i, j) pairs of its passage."""
    n = len(b)
    rows = np.zeros((len(a) + 1, n + 1), dtype=np.int32)
    step = -GAP * np.arange(n + 1, dtype=np.int32)
    for i, x in enumerate(a):
        prev = rows[i]
        best = np.zeros(n + 1, dtype=np.int32)
        best[1:] = np.maximum(prev[:-1] + np.where(b == x, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(best, 0, out=best)
        rows[i + 1] = np.maximum.accumulate(best + step) - step
    at = int(rows.argmax())
    i, j = divmod(at, n + 1)
    score = int(rows[i, j])
    pairs = []
    while i and j and rows[i, j] > 0:
        here = rows[i, j]
        hit = a[i - 1] == b[j - 1]
        if here == rows[i - 1, j - 1] + (MATCH if hit else MISMATCH):
            if hit:
                pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif here == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, pairs[::-1]


def leaked_share(item: np.ndarray, doc: np.ndarray, hits: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's words found in order in close passages of the document; first and last word there.

    ``hits``: places of seeds in the document. Every cluster of seeds is aligned;
    the best cluster counts. Within one, further passages before and after the best
    are added. Items of more than PIECE words are aligned piece by piece; of the pieces' best
    passages those count that follow in the item's order and make up most words.
    """
    m = len(item)
    if m > PIECE:
        cuts = range(0, m, PIECE)
        found = [(share * min(PIECE, m - k), lo, hi) for k in cuts for share, lo, hi in [leaked_share(item[k : k + PIECE], doc, hits)] if share > 0]
        chains: list[tuple[float, int, int]] = []
        for n, lo, hi in found:
            before = max((c for c in chains if c[2] <= lo and lo - c[2] <= NEAR * m), default=(0.0, lo, lo))
            chains.append((before[0] + n, before[1], hi))
        total, lo, hi = max(chains, default=(0.0, 0, 0))
        return total / m, lo, hi
    best = (0.0, 0, 0)
    reach = NEAR * m
    hits = np.sort(hits)
    cuts = np.flatnonzero(np.diff(hits) > reach)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(hits) - 1]])
    for s, e in zip(starts, ends):
        lo, hi = max(0, int(hits[s]) - m), min(len(doc), int(hits[e]) + m + N_HAN)
        # a cluster longer than a window is aligned window by window, each overlapping the next by half
        for a in range(lo, max(lo + 1, hi - WINDOW * m // 2), WINDOW * m // 2):
            b = min(hi, a + WINDOW * m)
            n, first, last = _passages(item, doc[a:b])
            if n / m > best[0]:
                best = (n / m, a + first, a + last + 1)
    return best


def _passages(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Matched words over the best passage and the passages in order on its two sides."""
    todo = [(0, len(item), 0, len(part))]
    total, first, last = 0, len(part), 0
    least = min(MIN_SEGMENT, -(-len(item) // 3))
    while todo:
        a, b, c, d = todo.pop()
        if b - a < least or d - c < least:
            continue
        score, pairs = local_alignment(item[a:b], part[c:d])
        if score < least:
            continue
        total += len(pairs)
        (i0, j0), (i1, j1) = pairs[0], pairs[-1]
        first, last = min(first, c + j0), max(last, c + j1)
        todo += [(a, a + i0, c, c + j0), (a + i1 + 1, b, c + j1 + 1, d)]
    return total, first, last


@dataclass
class Items:
    """A block of test items as arrays: sorted seeds, the items of each (``at[k] : at[k + 1]`` of ``owners``), token hashes, and the hits that make an alignment worth while."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    at: np.ndarray
    owners: np.ndarray
    needed: np.ndarray
    rare: np.ndarray  # of each seed, whether it is rare
    n_rare: np.ndarray  # rare seeds of each item


def index_items(rows: list[tuple[int, str]]) -> Items:
    """Seeds of a block of items of different texts.

    A seed stands in at most MAX_ITEMS items, or is the rarest of its stretch of the item. A
    document is aligned with an item when it holds as many of its seeds as the least share of
    words leaves intact with one word in EDIT_SPACING replaced, fewer for seeds left out.
    """
    words = [hashes(t)[0] for _, t in rows]
    every = [seeds(t) for _, t in rows]
    flat = np.concatenate([np.unique(g) for g, _ in every] or [np.zeros(0, np.int64)])
    known, counts = np.unique(flat, return_counts=True)
    kept, needed, n_rare = [], [], []
    for g, at in every:
        n = counts[np.searchsorted(known, g)] if len(g) else np.zeros(0, int)
        keep = n <= MAX_ITEMS
        if len(g):
            order = np.lexsort((n, at // STRETCH))
            firsts = np.unique((at // STRETCH)[order], return_index=True)[1]
            keep[order[firsts]] = True
        n_rare.append(len(np.unique(g[n <= MAX_ITEMS])))
        own = np.unique(g[keep])
        kept.append(own)
        # of the words in a passage of the least length, each EDIT_SPACING-th replaced, so many seeds are left
        needed.append(max(1, int(len(own) * MIN_SHARE / EDIT_SPACING * 0.75)))
    grams = np.concatenate(kept or [np.zeros(0, np.int64)])
    owners = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    order = np.argsort(grams, kind="stable")
    sorted_grams, starts = np.unique(grams[order], return_index=True)
    return Items([i for i, _ in rows], words, sorted_grams, np.append(starts, len(grams)), owners[order], np.array(needed, dtype=np.int64), counts[np.searchsorted(known, sorted_grams)] <= MAX_ITEMS, np.array(n_rare, dtype=np.int64))


def candidates(items: Items, g: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
    """(item's index, places of its seeds, share of its rare seeds) for the items of which a document's n-grams hold enough."""
    if not len(items.grams) or not len(g):
        return []
    k = np.minimum(np.searchsorted(items.grams, g), len(items.grams) - 1)
    hit = items.grams[k] == g
    if not hit.any():
        return []
    k, at = k[hit], at[hit]
    lens = items.at[k + 1] - items.at[k]
    ends = np.cumsum(lens)
    who = items.owners[np.repeat(items.at[k], lens) + np.arange(ends[-1]) - np.repeat(ends - lens, lens)]
    where, seed = np.repeat(at, lens), np.repeat(k, lens)
    order = np.argsort(who, kind="stable")
    who, where, seed = who[order], where[order], seed[order]
    cuts = np.flatnonzero(np.diff(who)) + 1
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(who)]):
        own = np.unique(seed[lo:hi])
        if len(own) >= items.needed[who[lo]]:
            of = items.n_rare[who[lo]]
            out.append((int(who[lo]), where[lo:hi], int(items.rare[own].sum()) / of if of else 1.0))
    return out


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc, item, share, first_word, last_word) of every document that holds at least ``min_share`` of an item's words in order.

    Null ids and null and empty texts on either side give no rows; items shorter than a seed
    cannot be found. Ids are bigint. Repeated documents are each reported; items of the same
    text are one until the result.

    Plan: items go to the tasks in blocks of some BLOCK_CHARS characters, one scan of the
    documents a block; documents are read once for each and never shuffled.
    """
    corpus = spread(docs.select(F.col(doc).cast("bigint").alias("id"), F.col(text).alias("text")).dropna())
    tests = items.select(F.col(item).cast("bigint").alias("id"), F.col(item_text).alias("text")).dropna()
    tests = tests.withColumn("copy", F.xxhash64(F.lower("text")))
    apart = durable(tests.groupBy("copy").agg(F.min("id").alias("item"), F.min("text").alias("item_text")))
    total = apart.agg(F.coalesce(F.sum(F.length("item_text").cast("bigint")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    schema = f"{doc} bigint, {item} bigint, share double, first_word bigint, last_word bigint"
    aligned = None
    for block in range(blocks):
        own = apart.filter(F.pmod("copy", F.lit(blocks)) == block).select("item", "item_text").orderBy("item").collect()
        shared = docs.sparkSession.sparkContext.broadcast(index_items([(r["item"], r["item_text"]) for r in own]))
        found = corpus.mapInPandas(_aligned(shared, doc, item, min_share), schema)
        aligned = found if aligned is None else aligned.unionByName(found)
    copies = tests.select("copy", F.col("id").alias("__tm_item")).join(apart.select("copy", "item"), "copy").select(F.col("item").alias(item), "__tm_item")
    return aligned.join(copies, item).drop(item).withColumnRenamed("__tm_item", item).select(doc, item, "share", "first_word", "last_word")


def _aligned(shared, doc: str, item: str, min_share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = shared.value
        for f in frames:
            rows = []
            for d, t in zip(f["id"], f["text"]):
                g, at = seeds(t)
                near = candidates(tests, g, at)
                if not near:
                    continue
                h = hashes(t)[0]
                for k, places, rare in near:
                    if rare < min_share * RARE:
                        continue  # no share that counts could pass below
                    share, lo, hi = leaked_share(tests.words[k], h, places)
                    # sentences of one mould share words, but few of what only this item has
                    if share >= min_share and rare >= share * RARE:
                        rows.append((d, tests.ids[k], share, lo, hi))
            yield pd.DataFrame(rows, columns=[doc, item, "share", "first_word", "last_word"]).astype({doc: "int64", item: "int64", "share": "float64", "first_word": "int64", "last_word": "int64"})

    return run
