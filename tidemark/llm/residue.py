"""Template residue and error-page text.

Method: the address slug, the title and the body terms of a page are compared, and
low-information bodies that mismatch and recur on other addresses are flagged with
the evidence of their hosts. No message is known beforehand: a line counts as residue
when it recurs on hosts and under titles that have nothing to do with it, on bodies far
shorter than their host's, beside no line of the page's own. Detectors know the marks of
unfilled placeholders, repeated tokens and the words around 'lorem ipsum'; an error status and
a body that a script would have to fill are evidence, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import coded_texts, letters, plain, remembered
from tidemark.session import bounded, durable

LOW = 3  # a body of less than one part in so many of its host's usual length is low in information
LOW_SHARE = 0.8  # of a residue line's texts are low in information,
ALONE = 0.5  # ... and so many hold no line of their own,
MISMATCH = 0.5  # ... and in so many the line shares no term with slug or title
TERM = 4  # letters of a term that counts in these comparisons
FILLED = 0.8  # share of filler words in a line that is filler
ERROR = 400  # lowest http status that is evidence of an error

# Marks around unfilled placeholders, as patterns of what is left of a line without its label.
PLACEHOLDERS = [
    r"\{\{.*\}\}", r"\$\{.*\}", r"#\{.*\}", r"%\([^)]*\)[sd]?", r"%%.*%%", r"\[[^\[\]]{1,80}\]", r"\[\[.*\]\]", r"<<.*>>", r"@@.*@@", r"__.*__", r"\{%.*%\}", r"<%.*%>",
]
#: an empty element that a script right behind it is to fill
SHELL = r"(?is)<(div|main|section)\b[^>]*>\s*</\1>\s*<script"
_PLACE = re.compile("|".join(PLACEHOLDERS))
_LABEL = re.compile(r"[^\W\d_][\w ./-]{0,40}:\s*")
_WORDS = re.compile(r"[^\W\d_]+")
_SURE = {"lorem", "ipsum"}


@remembered(1 << 16)
def residue_class(line: str) -> str:
    """'placeholder', 'filler' or ''; by the line's marks alone."""
    p = plain(line).strip()
    if _PLACE.fullmatch(_LABEL.sub("", p, count=1)) or _PLACE.fullmatch(p):
        return "placeholder"
    tokens = p.split()
    return "filler" if len(tokens) >= 3 and len({t.strip(".,") for t in tokens}) == 1 else ""


def filler_share(line: str, vocabulary: set[str]) -> float:
    words = _WORDS.findall(plain(line))
    return sum(w in vocabulary for w in words) / len(words) if words else 0.0


@remembered(1 << 15)
def line_key(line: str) -> int:
    """What residue lines are compared by: letters, or the plain line where it has none."""
    return xxhash.xxh3_64_intdigest(letters(line) or plain(line).strip()) - (1 << 63)


def terms(text: str) -> set[str]:
    return {w for w in _WORDS.findall(plain(text)) if len(w) >= TERM}


def filler_vocabulary(snaps: DataFrame, text: str) -> set[str]:
    """Words of the pseudo-language around 'lorem ipsum', learned from the lines that hold these words.

    A word counts that stands in at least a thousandth of those lines and there in
    most of its lines; so the set has at most some thousand words.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for f in frames:
            for text in f["text"]:
                for line in text.split("\n"):
                    words = set(_WORDS.findall(plain(line)))
                    sure = bool(words & _SURE)
                    n.update((w, sure) for w in words)
                    n["", True] += sure
        yield pd.DataFrame([(w, s, k) for (w, s), k in n.items()], columns=["word", "sure", "n"])

    near = snaps.select(F.col(text).alias("text")).filter(F.col(text).contains("lorem") | F.col(text).contains("ipsum"))
    counts = near.mapInPandas(count, "word string, sure boolean, n bigint")
    sums = durable(counts.groupBy("word").agg(F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("n")))
    total = sums.filter(F.col("word") == "").select(F.col("k").alias("of"))
    kept = sums.filter(F.col("word") != "").join(F.broadcast(total)).filter((F.col("k") >= F.greatest(F.lit(2), F.col("of") / 1000)) & (F.col("k") * 4 >= F.col("n")))
    return _SURE | {r["word"] for r in kept.select("word").collect()}


LINES = "page bigint, site bigint, address bigint, title bigint, n_body int, n_sure int, n_chars bigint, sure_title boolean, overlap int, lines array<struct<key:bigint,n:int,apart:boolean>>"


def _bodies(texts: DataFrame, vocabulary: set[str]) -> DataFrame:
    """Per distinct text what its body says; ``lines`` are those no detector knows, with how often they stand there and whether they mismatch slug and title.

    A line that repeats the title is no evidence for a match. Only hashes travel on.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def digest(x: str) -> int:
        return xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value

        def sure(line: str) -> bool:
            return bool(residue_class(line)) or filler_share(line, words) >= FILLED

        for f in frames:
            rows = []
            for page, site, path, text, codes in zip(f["page"], f["site"], f["path"], f["form"], f["codes"]):
                lines = text.split("\n")
                title = line_key(lines[0])
                body = [x for x, c in zip(lines[1:], codes[1:]) if c == "B" and x.strip()]
                about = terms(path) | terms(lines[0])
                known = [sure(x) for x in body]
                own = Counter(line_key(x) for x, k in zip(body, known) if not k)
                apart = {line_key(x): line_key(x) == title or not terms(x) & about for x, k in zip(body, known) if not k}
                met = terms(" ".join(x for x in body if line_key(x) != title)) & about
                rows.append((
                    page, digest(site), digest(f"{site}\n{path}"), title, len(body), sum(known), sum(map(len, body)), sure(lines[0]), len(met),
                    [{"key": k, "n": n, "apart": apart[k]} for k, n in own.items()]))
            yield pd.DataFrame(rows, columns=["page", "site", "address", "title", "n_body", "n_sure", "n_chars", "sure_title", "overlap", "lines"])

    return texts.select("page", "site", "path", "form", "codes").mapInPandas(run, LINES)


def _several(name: str) -> Column:
    """Whether a group has more than one value; needs no list of them."""
    return (F.min(name) != F.max(name)).alias(f"some_{name}")


def residue_lines(bodies: DataFrame) -> DataFrame:
    """(key) of the lines that are residue, from the rows of :func:`_bodies` with ``low``."""
    each = bodies.select("page", "site", "address", "title", "low", F.explode("lines").alias("x")).select("page", "site", "address", "title", "low", "x.key", "x.apart")
    # all tests of recurrence are pre-aggregated per key; no key gathers its pages
    keys = each.groupBy("key").agg(_several("site"), _several("address"), _several("title"), F.count(F.lit(1)).alias("n"), F.count_if("low").alias("n_low"), F.count_if("apart").alias("n_apart"))
    again = durable(keys.filter("some_address").drop("some_address"))
    met = each.select("page", "key").join(bounded(again.select("key")), "key")
    n_again = met.groupBy("page").agg(F.count(F.lit(1)).alias("again"))
    alone = bodies.select("page", F.size("lines").alias("of")).join(n_again, "page").filter(F.col("again") >= F.col("of")).select("page")
    n_alone = met.join(alone, "page", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_alone"))
    likely = again.filter(F.col("some_site") & F.col("some_title") & (F.col("n_low") >= F.col("n") * LOW_SHARE) & (F.col("n_apart") >= F.col("n") * MISMATCH))
    return likely.join(n_alone, "key").filter(F.col("n_alone") >= F.col("n") * ALONE).select("key")


def residue_evidence(snaps: DataFrame) -> DataFrame:
    """Per snapshot: n_body, n_bad, overlap, host_chars, error_status, shell and ``residue``.

    ``snaps``: snapshot_id, url, fetched_at, normalized_text, http_status, raw_bytes (null: no evidence). A snapshot
    is residue when it has a body and every line of it is a placeholder, filler, or a
    line learned as residue; or when it has no body but such a title; or when a body
    far shorter than its host's waits for a script, or came with an error status, shares
    no term with slug and title and is such lines by half. Pages without body and with
    a normal title are none. Snapshots of one page and text share their evidence.
    """
    coded = coded_texts(snaps, text=True)
    bodies = durable(_bodies(coded.texts, filler_vocabulary(snaps, "normalized_text")))
    hosts = bodies.filter("n_body > 0").groupBy("site").agg(F.percentile_approx("n_chars", 0.5).alias("host_chars"))
    bodies = durable(bodies.join(bounded(hosts), "site", "left").withColumn("low", F.coalesce(F.col("n_chars") * LOW < F.col("host_chars"), F.lit(False))))
    lines = bounded(durable(residue_lines(bodies)))
    hits = bodies.select("page", F.explode("lines").alias("x")).select("page", "x.key", "x.n").join(lines, "key").groupBy("page").agg(F.sum("n").alias("n_learned"))
    titles = bodies.select("page", F.col("title").alias("key")).join(lines, "key", "left_semi").select("page", F.lit(True).alias("learned_title"))
    raw = F.make_valid_utf8(F.col("raw_bytes").cast("string"))
    marks = snaps.select(F.col("snapshot_id").cast("bigint").alias("snapshot_id"), (F.col("http_status") >= ERROR).alias("e"), raw.rlike(SHELL).alias("s"))
    marked = coded.rows.join(marks, "snapshot_id").groupBy("page").agg(F.coalesce(F.bool_or("e"), F.lit(False)).alias("error_status"), F.coalesce(F.bool_or("s"), F.lit(False)).alias("shell"))
    out = bodies.join(hits, "page", "left").join(titles, "page", "left").join(marked, "page", "left").withColumn("n_bad", (F.col("n_sure") + F.coalesce("n_learned", F.lit(0))).cast("int"))
    some = F.col("n_body") > 0
    whole = (some & (F.col("n_bad") >= F.col("n_body"))) | (~some & (F.col("sure_title") | F.coalesce("learned_title", F.lit(False))))
    failed = F.col("error_status") & (F.col("n_bad") * 2 >= F.col("n_body")) & (F.col("overlap") == 0)
    judged = out.select("page", "n_body", "n_bad", "overlap", "host_chars", "error_status", "shell", (whole | (some & F.col("low") & (F.col("shell") | failed))).alias("residue"))
    return coded.rows.join(judged, "page").select("snapshot_id", "n_body", "n_bad", "overlap", "host_chars", "error_status", "shell", "residue")
