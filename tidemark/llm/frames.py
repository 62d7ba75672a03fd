"""Page boilerplate mixed with main content.

Method: pages are paired with their nearest pages by URL path within each host,
their lines are aligned by longest common subsequence, and shared lines are
deleted. No wording is known beforehand. A shared line goes where it belongs to a run of
shared lines at the page's edge; what is deleted so is counted over all pages, and a
line of which enough was deleted is deleted wherever it stands. Headings of link
blocks, the length of these blocks and the words that begin list items rather than
links are counted in the same pass, so that the links, which differ from page to
page, go with their heading.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.looks import look_hash, with_canonical
from tidemark.llm.sites import site_of
from tidemark.plans.ordered import previous_row, range_blocks, running_max
from tidemark.session import bounded, durable

WEEK = 7 * 86_400 * 1_000_000  # microseconds; block of time
VOTES = 0.6  # share of the paired pages that must share a line
# What makes a line a frame line everywhere, as shares of the pages that hold it; a page's versions count as one page.
DELETED = 0.05  # deleted at a page's edge, of the pages where neighbours share it
DELETED_SENTENCE = 0.4  # the same for a sentence, which also stands in bodies
SHARED = 0.2  # shared with neighbours, of all its pages
DELETED_RARE = 0.6  # as DELETED, for lines shared by fewer pages, ...
SHARED_RARE = 0.02  # ... but by so many
LINKS = 0.8  # followed by a line of the page's own that is no sentence: the heading of a link block
CLOSED = 0.1  # of these, the block ends at a shared line or with the page
CLOSED_MOSTLY = 0.5  # the same where the heading itself was not deleted at an edge
BLOCK = 0.99  # of the closed blocks; no block is taken to be longer than these
LISTED = 5  # pages in which a word begins lines without an end mark before it can count as one that begins no link
TITLED = 0.02  # titles begun by such a word, of the lines it begins
CRUMBS = 0.8  # of the lines a word begins that are neither sentences nor shared: breadcrumbs, so it begins breadcrumbs
STARTS = 0.9  # shared with neighbours, of the lines without an end mark that a word begins: it begins frame lines
UNIT = 10_080  # weight of a page, split evenly over its versions

_END = re.compile(r"[.!?。！？…।]['\"”»」)]*$")
_SEPARATED = re.compile(r"\s*[|·/›]\s*")
_CRUMBS = re.compile(r"\s+[>›»]\s+")
_WORD = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"[^\W\d_]+(?: [^\W\d_]+){0,3}:(?=\s)")
_OPENING = "\"'“‘„«¿¡([（「『【《<{"
_UNSPACED = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")  # scripts without blanks


def plain(line: str) -> str:
    """Without accents and letter case."""
    return line.lower() if line.isascii() else "".join(c for c in ud.normalize("NFD", line.lower()) if not ud.combining(c))


def remembered(size: int):
    """A cache of results for short lines; long ones are not kept."""

    def wrap(f):
        kept = lru_cache(size)(f)
        return wraps(f)(lambda line: kept(line) if len(line) <= 300 else f(line))

    return wrap


@remembered(1 << 15)
def letters(line: str) -> str:
    """Letters without accents, and the sign of a copyright notice; what lines are compared by."""
    return "".join(c for c in plain(line) if c.isalpha() or c == "©")


@remembered(1 << 15)
def key_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(letters(line)) - (1 << 63)


@remembered(1 << 15)
def start_of(line: str) -> int:
    """Hash of what a line begins with, 0 without letters: its label up to a colon, a sign, or the first word - two characters where words are not told apart by blanks."""
    label = _LABEL.match(plain(line))
    m = label or _WORD.search(plain(line))
    if m is None:
        return 0
    sign = line.lstrip()[:1]
    word = m[0] if label or not _UNSPACED.match(m[0]) else m[0][:2]
    if not label and ud.category(sign)[0] in "SP" and sign not in _OPENING:
        word = sign
    return xxhash.xxh3_64_intdigest("^" + word) - (1 << 63)


@dataclass
class Lines:
    """A text's lines as they are compared; ``kinds`` has one letter per line.

    T the title, t the title again, n no letters, c a breadcrumb that ends in the
    title, s a sentence, o any other.
    """

    keys: list[int]
    kinds: str
    starts: list[int]


def lines_of(lines: list[str], titles: set[int] | None = None) -> Lines:
    """``titles`` for pieces of a page: the keys of its titles; else the first line is the title."""
    whole = titles is None
    titles = {key_of(lines[0])} if whole else titles
    if whole and not letters(lines[0]):
        titles = set()
    kinds = []
    for i, x in enumerate(lines):
        if whole and i == 0:
            kinds.append("T")
        elif not letters(x):
            kinds.append("n")
        elif key_of(x) in titles:
            kinds.append("t")
        elif len(parts := _CRUMBS.split(x.strip())) > 1 and letters(parts[-1]) and key_of(parts[-1]) in titles:
            kinds.append("c")
        else:
            kinds.append("s" if _END.search(x) else "o")
    return Lines([key_of(x) for x in lines], "".join(kinds), [start_of(x) if k in "Tco" else 0 for x, k in zip(lines, kinds)])


def votes_of(p: Lines, shared: set[int]) -> list[bool]:
    return [k in "cos" and x in shared for k, x in zip(p.kinds, p.keys)]


@dataclass
class Learned:
    """What was learned about the lines of one text."""

    known: set[int]  # frame lines
    heads: set[int]  # of these, headings of link blocks
    listed: set[int]  # first words that begin list items rather than links
    starts: set[int]  # first words that begin frame lines
    crumbs: set[int]  # first words that begin breadcrumbs
    longest: int  # of a link block


NOTHING = Learned(set(), set(), set(), set(), set(), 0)


def deleted(p: Lines, votes: list[bool], learned: Learned = NOTHING) -> list[bool]:
    """The lines that go: breadcrumbs, learned ones, and runs of shared lines at an edge of the page or beside such lines.

    Sentences at that side of a run that faces the body stay. A page all of whose own
    sentences are shared is a copy of its neighbours and is judged by what was learned only.
    In a page that no neighbour shares lines with, first words tell frame lines, too, and lines without an end mark between two lines
    that go are deleted with them, if a sentence stands elsewhere.
    """
    n = len(votes)
    first = 1 if p.kinds[:1] == "T" else 0
    alone = not any(votes)
    flags = [k == "c" or (k in "os" and x in learned.known) or (k == "o" and (s in learned.crumbs or (alone and s in learned.starts))) for k, x, s in zip(p.kinds, p.keys, p.starts)]
    if not any(k == "s" and not v and not f for k, v, f in zip(p.kinds, votes, flags)):
        return flags
    if alone:
        return _enclosed(p, flags, first)
    i = first
    while i < n:
        if not (votes[i] or flags[i]):
            i += 1
            continue
        j = i
        while j < n and (votes[j] or flags[j]):
            j += 1
        lo, hi = i, j
        if i > first and j < n:
            sure = [m for m in range(i, j) if flags[m]]
            lo, hi = (sure[0], sure[-1] + 1) if sure else (j, j)
            while lo < hi and lo > i and p.kinds[lo - 1] != "s":
                lo -= 1
            while lo < hi < j and p.kinds[hi] != "s":
                hi += 1
        elif i == first:
            while hi > lo and p.kinds[hi - 1] == "s" and not flags[hi - 1]:
                hi -= 1
        else:
            while lo < hi and p.kinds[lo] == "s" and not flags[lo]:
                lo += 1
        flags[lo:hi] = [True] * (hi - lo)
        i = j
    return flags


def _enclosed(p: Lines, flags: list[bool], first: int) -> list[bool]:
    out = list(flags)
    last = None  # the line before the run
    for i in range(first, len(flags)):
        if flags[i]:
            if last is not None and last < i - 1:
                out[last + 1 : i] = [True] * (i - last - 1)
            last = i
        elif p.kinds[i] != "o":
            last = None
    return out


def with_links(p: Lines, flags: list[bool], learned: Learned) -> list[bool]:
    """Adds the links below the headings of link blocks."""
    out = list(flags)
    n = len(flags)
    for i in range(n):
        if flags[i] and p.keys[i] in learned.heads:
            j = i + 1
            while j < n and j - i <= learned.longest and p.kinds[j] == "o" and not flags[j] and p.starts[j] not in learned.listed:
                out[j] = True
                j += 1
    return out


COUNTS = "key bigint, len int, pres bigint, loc bigint, vote bigint, link bigint, closed bigint"
_ZERO = (0, 0, 0, 0, 0)


def _count_page(p: Lines, shared: set[int], w: int, out: dict[tuple[int, int], list[int]]) -> None:
    """Adds one page's lines: with ``len`` -1 the counts of a line's key, -3 of a sentence's, -2 those of a first word (link: breadcrumbs, closed: titles), else closed blocks of that length."""
    votes = votes_of(p, shared)
    flags = deleted(p, votes)
    n = len(votes)
    for i in range(n):
        k = p.kinds[i]
        if k in "Tco" and p.starts[i]:
            c = out[p.starts[i], -2]
            if k == "T":
                c[4] += w
            elif k == "c":
                c[3] += w
            else:
                c[0] += w
                c[1] += w * flags[i]
                c[2] += w * (votes[i] or flags[i])
        if k not in "os":
            continue
        c = out[p.keys[i], -3 if k == "s" else -1]
        c[0] += w
        c[1] += w * flags[i]
        c[2] += w * (votes[i] or flags[i])
        j = i + 1
        while k == "o" and j < n and p.kinds[j] == "o" and not votes[j] and not flags[j]:
            j += 1
        if j > i + 1 and (votes[i] or flags[i]):
            c[3] += w
            if j == n or votes[j] or flags[j]:
                c[4] += w
                out[p.keys[i], j - i - 1][4] += w


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: dict[tuple[int, int], list[int]] = defaultdict(lambda: list(_ZERO))

    def drain() -> pd.DataFrame:
        rows = [(*k, *v) for k, v in out.items()]
        out.clear()
        return pd.DataFrame(rows, columns=["key", "len", "pres", "loc", "vote", "link", "closed"])

    for f in frames:
        for keys, kinds, starts, shared, w in zip(f["line_keys"], f["kinds"], f["starts"], f["keys"], f["weight"]):
            _count_page(Lines(keys.tolist(), kinds, starts.tolist()), set(shared.tolist()), int(w), out)
        if len(out) > 200_000:
            yield drain()
    yield drain()


def learn(texts: DataFrame, shared: DataFrame) -> tuple[DataFrame, int]:
    """(key, kind) of lines and first words - k frame line, h heading of a link block, f beginning of frame lines, b of breadcrumbs, l of list items - and the longest link block.

    Counted over all texts that have neighbours; a page's versions weigh as one page.
    """
    counts = texts.select("page", "line_keys", "kinds", "starts").join(shared, "page").select("line_keys", "kinds", "starts", "keys", "weight").mapInPandas(_count, COUNTS)
    names = ["pres", "loc", "vote", "link", "closed"]
    sums = counts.groupBy("key", "len").agg(*[F.sum(c).alias(c) for c in names])
    n, loc, vote = F.col("pres"), F.col("loc"), F.col("vote")
    word = F.col("len") == -2
    rows = F.col("len")
    heading = (rows == -1) & (F.col("link") >= vote * LINKS) & (F.col("link") >= 2 * UNIT)
    closing = heading & (vote >= n * SHARED) & (F.col("closed") >= F.col("link") * CLOSED_MOSTLY)
    # what no neighbour shares can't be learned, and words that begin few lines say nothing
    sums = durable(sums.filter((rows >= 0) | (~word & ((loc >= UNIT / 2) | closing)) | (word & (n + F.col("link") >= LISTED * UNIT))))
    enough = loc >= vote * F.when(rows == -3, DELETED_SENTENCE).when(vote >= n * SHARED, DELETED).otherwise(DELETED_RARE)
    line = sums.filter(rows.isin(-1, -3) & (closing | ((loc >= UNIT / 2) & enough & (vote >= n * F.when(rows == -3, SHARED).otherwise(SHARED_RARE)))))
    head = heading & (F.col("closed") >= F.col("link") * CLOSED)
    lines = line.groupBy("key").agg(F.max(head).alias("head")).select("key", F.when(F.col("head"), "h").otherwise("k").alias("kind"))
    crumbs = F.col("link")
    begun = F.when((crumbs >= LISTED * UNIT) & (crumbs >= (crumbs + n - vote) * CRUMBS), "b").when((vote >= n * STARTS) & (loc >= vote * DELETED), "f").when((n >= LISTED * UNIT) & (F.col("closed") < n * TITLED) & (vote < n * SHARED_RARE), "l")
    words = sums.filter(word).select("key", begun.alias("kind")).filter(F.col("kind").isNotNull())
    blocks = sums.filter(F.col("len") >= 0).join(lines.filter("kind = 'h'").select("key"), "key", "left_semi")
    # one row per length of a block; lengths over 1,000 are one class
    by = blocks.groupBy(F.least("len", F.lit(1_000)).alias("len")).agg(F.sum("closed").alias("n")).orderBy("len").collect()
    total, seen, longest = sum(r["n"] for r in by), 0, 0
    for r in by:
        longest, seen = r["len"], seen + r["n"]
        if seen >= total * BLOCK:
            break
    return lines.unionByName(words), longest


def _learned(found: np.ndarray | None, longest: int) -> Learned:
    """The learned rows of one text."""
    by: dict[str, set[int]] = defaultdict(set)
    for x in () if found is None else found:
        by[x["kind"]].add(int(x["key"]))
    return Learned(by["k"] | by["h"], by["h"], by["l"], by["f"], by["b"], longest)


def path_of(url: Column) -> Column:
    """Path in lower case without query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def query_of(url: Column) -> Column:
    """Query in lower case, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def _edges(pages: DataFrame) -> DataFrame:
    """(a, b): pages next to each other by path within their site, one and two steps apart.

    Blocks come from a range partitioning, so a site of any size is cut into several.
    """
    block = F.col("__tm_range")
    one = previous_row(pages.select("site", "path", "page", "__tm_range"), ["site"], ["path", "page"], block, ["page"]).withColumn("before", F.col("prev.page")).drop("prev")
    two = previous_row(one, ["site"], ["path", "page"], block, ["before"]).withColumn("second", F.col("prev.before"))
    both = two.select(F.col("page").alias("a"), F.explode(F.array("before", "second")).alias("b"))
    return both.filter(F.col("b").isNotNull())


def lcs_keys(a: list[int], b: list[int], bits: int = 1 << 28) -> list[int]:
    """Keys on a longest common subsequence of two key lists.

    Bit-parallel: one row of bits per line of ``a``. Where the rows would take more
    than ``bits``, ``a`` is halved and ``b`` cut where both halves share most, so memory
    stays bounded for pages of any length.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    front, back = a[:lo], a[len(a) - hi :]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    if not a or not b:
        return front + back
    if len(a) > 1 and len(a) * len(b) > bits:
        mid = len(a) // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[:mid - 1 : -1], b[::-1])[::-1]).argmax())
        return front + lcs_keys(a[:mid], b[:cut], bits) + lcs_keys(a[mid:], b[cut:], bits) + back
    rows = _rows(a, b, True)
    i, j = len(a), len(b)
    found = []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                found.append(a[i])
    return front + found[::-1] + back


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """After each line of ``a`` (or the last only) the bits of ``b``; the zeros below a place count the longest subsequence up to there."""
    at: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        at[x] |= 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            rows.append(v)
    return rows or [v]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    v = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts: list[int] = []
        keys: list[int] = []
        for a, b, ka, kb, for_a, for_b in zip(f["a"], f["b"], f["ka"], f["kb"], f["for_a"], f["for_b"]):
            own = {*lcs_keys(ka.tolist()[1:], kb.tolist()[1:])}
            for text, asked in ((a, for_a), (b, for_b)):
                if asked:
                    texts += [text] * (len(own) + 1)
                    keys += [*own, 0]  # key 0 counts the pairs
        yield pd.DataFrame({"page": pd.Series(texts, dtype="int64"), "key": pd.Series(keys, dtype="int64")})


def _nearest_texts(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(page, other): each text with the text nearest in time of each page that its own is paired with.

    ``edges``: a, b, page numbers, each pair once; ``texts``: number, page, at. No pair of pages is
    multiplied out: the texts of both are ordered by time and the last and next ones carried along.
    """
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = F.struct("at", "page"), F.lit(None).cast("struct<at:bigint,page:bigint>")
    asking = ways.join(texts.withColumnRenamed("number", "a"), "a").select("a", "b", "at", "page", other.alias("there"), other.alias("back"), F.lit(True).alias("asks"))
    mirrored = F.struct((-F.col("at")).alias("at"), "page")
    given = ways.join(texts.withColumnRenamed("number", "b"), "b").select("a", "b", "at", "page", own.alias("there"), mirrored.alias("back"), F.lit(False).alias("asks"))
    both = asking.unionByName(given).withColumn("late", -F.col("at"))
    past = durable(running_max(both, ["a", "b"], ["at", "asks", "page"], F.floor(F.col("at") / WEEK), "there", "last"))
    full = running_max(past, ["a", "b"], ["late", "asks", "page"], F.floor(F.col("late") / WEEK), "back", "next")
    nearer = F.col("next").isNull() | (F.col("at") - F.col("last.at") <= -F.col("next.at") - F.col("at"))
    return full.filter("asks").select("page", F.when(F.col("last").isNotNull() & nearer, F.col("last.page")).otherwise(F.col("next.page")).alias("other")).filter(F.col("other").isNotNull())


def shared_keys(texts: DataFrame) -> DataFrame:
    """(page, keys, weight): for each text the keys of the lines most of its nearest pages have too, and its share of its page.

    ``texts``: page (the text's number), site, path, at, line_keys. Every text of a page is
    aligned, with the texts of the neighbours nearest in time. Texts alone on their
    site get no row.
    """
    pages = range_blocks(texts.groupBy("site", "path").agg(F.min("page").alias("page")), ["site", "path", "page"])
    numbered = durable(texts.select("site", "path", "at", "page").join(pages.select("site", "path", F.col("page").alias("number")), ["site", "path"]).select("number", "page", "at"))
    # lineage is cut before each step: the plans of neighbours double with each of them
    wanted = _nearest_texts(durable(_edges(pages)), numbered)
    lower = F.col("page") < F.col("other")
    pairs = wanted.groupBy(F.least("page", "other").alias("a"), F.greatest("page", "other").alias("b")).agg(F.bool_or(lower).alias("for_a"), F.bool_or(~lower).alias("for_b"))
    pairs = durable(pairs).join(texts.select(F.col("page").alias("a"), F.col("line_keys").alias("ka")), "a").join(texts.select(F.col("page").alias("b"), F.col("line_keys").alias("kb")), "b")
    votes = durable(pairs.select("a", "b", "ka", "kb", "for_a", "for_b").mapInPandas(_shared, "page bigint, key bigint").groupBy("page", "key").agg(F.count(F.lit(1)).alias("n")))
    ballots = votes.filter(F.col("key") == 0).select("page", F.col("n").alias("of"))
    kept = votes.filter(F.col("key") != 0).join(ballots, "page").filter(F.col("n") >= F.col("of") * VOTES)
    keys = kept.groupBy("page").agg(F.collect_list("key").alias("keys"))
    versions = numbered.groupBy("number").agg(F.greatest(F.lit(1), F.floor(F.lit(UNIT) / F.count(F.lit(1)))).cast("bigint").alias("weight"))
    return numbered.join(versions, "number").select("page", "weight").join(keys, "page")


def _page_hash() -> list[Column]:
    """Two 64-bit hashes of a page's site and path: fixed width for what may be broadcast."""
    return [F.xxhash64(F.lit(x), "site", "path").alias(n) for x, n in (("a", "p1"), ("b", "p2"))]


def prepared(df: DataFrame) -> DataFrame:
    """Snapshots with site and path; rows without an id or text are left out.

    The query belongs to the path where the path alone does not tell pages apart:
    each query there has one title, and not all titles are the same.
    """
    kept = df.select(F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "url", "fetched_at", "normalized_text").filter(F.col("snapshot_id").isNotNull() & F.col("normalized_text").isNotNull())
    kept = kept.withColumn("site", F.coalesce(site_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit(""))).withColumn("query", query_of(F.col("url"))).drop("url")
    titles = kept.groupBy("site", "path", "query").agg(*[f(F.xxhash64(F.substring_index("normalized_text", "\n", 1))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    apart = titles.groupBy("site", "path").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("one"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("one") & (F.col("lo") != F.col("hi")))
    kept = kept.select("*", *_page_hash()).join(bounded(apart.select(*_page_hash(), F.lit(True).alias("apart"))), ["p1", "p2"], "left").drop("p1", "p2")
    return kept.withColumn("path", F.when(F.col("apart") & (F.col("query") != ""), F.concat("path", F.lit("?"), "query")).otherwise(F.col("path"))).drop("apart", "query")


@dataclass
class Coded:
    """What :func:`coded_texts` gives."""

    rows: DataFrame  # snapshot_id, page: the page's number is the smallest snapshot_id that has the text
    texts: DataFrame  # page, site, path, codes, line_keys - or form, for coded with ``text``
    model: DataFrame  # key, kind as learned
    longest: int  # of a link block


def coded_texts(df: DataFrame, text: bool = False) -> Coded:
    """Codes of every distinct text of a page, with what was learned. ``df`` as in :func:`with_flags`."""
    snaps = prepared(df)
    h1, h2 = look_hash(F.col("normalized_text"))
    hashed = snaps.select("snapshot_id", "site", "path", F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(0)).alias("at"), h1.alias("h1"), h2.alias("h2"))
    by = ["site", "path", "h1", "h2"]
    first = durable(hashed.groupBy(*by).agg(F.min("snapshot_id").alias("page"), F.max("at").alias("at")))
    rows = hashed.select("snapshot_id", *by).join(first.select(*by, "page"), by).select("snapshot_id", "page")
    own = snaps.select(F.col("snapshot_id").alias("page"), "normalized_text").join(first.select("page", "site", "path", "at"), "page")
    names = ["page", "site", "path", "at", *(["form"] if text else [])]

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [lines_of(t.split("\n")) for t in f["form"]]
            f["line_keys"], f["kinds"], f["starts"] = [x.keys for x in each], [x.kinds for x in each], [x.starts for x in each]
            yield f[[*names, "line_keys", "kinds", "starts"]]

    forms = with_canonical(own, "normalized_text", "form").select("page", "site", "path", "at", "form")
    schema = "page bigint, site string, path string, at bigint, " + ("form string, " if text else "") + "line_keys array<bigint>, kinds string, starts array<bigint>"
    # texts are hashed line by line once; from here on only keys travel
    texts = durable(forms.mapInPandas(keyed, schema).dropDuplicates(["page"]))
    shared = durable(shared_keys(texts))
    model, longest = learn(texts, shared)
    model = durable(model)
    asked = texts.select("page", F.explode(F.array_distinct(F.concat("line_keys", "starts"))).alias("key"))
    found = asked.join(bounded(model), "key").groupBy("page").agg(F.collect_list(F.struct("key", "kind")).alias("found"))
    joined = texts.join(shared.select("page", "keys"), "page", "left").join(found, "page", "left")
    last = "form" if text else "line_keys"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            codes = []
            for keys, kinds, starts, shared, found in zip(f["line_keys"], f["kinds"], f["starts"], f["keys"], f["found"]):
                codes.append(codes_of(Lines(keys.tolist(), kinds, starts.tolist()), set() if shared is None else set(shared.tolist()), _learned(found, longest)))
            f["codes"] = codes
            yield f[["page", "site", "path", "codes", last]]

    picked = joined.select("page", "site", "path", *(["form"] if text else []), "line_keys", "kinds", "starts", "keys", "found")
    return Coded(rows, picked.mapInPandas(run, f"page bigint, site string, path string, codes string, {'form string' if text else 'line_keys array<bigint>'}"), model, longest)


def codes_of(p: Lines, shared: set[int], learned: Learned = NOTHING) -> str:
    flags = with_links(p, deleted(p, votes_of(p, shared), learned), learned)
    return "T" + "".join("F" if x else "B" for x in flags[1:])


def with_flags(df: DataFrame) -> DataFrame:
    """snapshot_id, site, path, codes - one letter per line, T the title, F frame, B body - and line_keys.

    ``df``: snapshot_id, url, fetched_at, normalized_text; other columns are not
    read. An empty text is one empty title line. A null url is a page without
    neighbours. Repeated rows are each coded. ``path`` has the query where it tells pages apart.
    """
    return flagged(coded_texts(df))


def flagged(coded: Coded) -> DataFrame:
    return coded.rows.join(coded.texts, "page").select("snapshot_id", "site", "path", "codes", "line_keys")


def frame_lines(coded: DataFrame, doc: str) -> DataFrame:
    """(doc, line_no) of the frame lines."""
    each = coded.select(doc, F.posexplode(F.split("codes", "")).alias("pos", "code"))
    return each.filter(F.col("code") == "F").select(doc, (F.col("pos") + 1).cast("int").alias("line_no"))


def diff_frame_lines(changes: DataFrame, coded: Coded, flags: DataFrame) -> DataFrame:
    """(change_id, line_no) of the frame lines inside unified diffs.

    ``changes``: change_id, url, diff_excerpt; ``flags``: rows of :func:`flagged`. A line's mark does not count. A line is
    frame when the snapshots of the same page have it in their frame and never in
    their body, when it is a frame line everywhere, or as a link below a heading of such in its hunk.
    '@@' lines and null diffs give no rows.
    """
    longest = coded.longest

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            each = [[x[1:] if x[:1] in "+- " else x for x in t.split("\n")] for t in f["form"]]
            f["asked"] = [list({y for x in lines for y in (key_of(x), start_of(x))}) for lines in each]
            yield f

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, nos = [], []
            for c, text, own, titles, learned in zip(f["change_id"], f["form"], f["own"], f["titles"], f["found"]):
                here = _learned(learned, longest)
                if own is not None:  # the page's own snapshots say more than first words
                    here.known |= set(own.tolist())
                    here.starts = set()
                for no in diff_flags(text, here, set() if titles is None else set(titles.tolist())):
                    ids.append(c)
                    nos.append(no)
            yield pd.DataFrame({"change_id": pd.Series(ids, dtype="object"), "line_no": pd.Series(nos, dtype="int32")})

    diffs = changes.select("change_id", "url", "diff_excerpt").filter(F.col("change_id").isNotNull() & F.col("diff_excerpt").isNotNull()).distinct()
    diffs = diffs.withColumn("site", F.coalesce(site_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    diffs = diffs.withColumn("full", F.concat("path", F.lit("?"), query_of(F.col("url"))))
    diffs = with_canonical(diffs, "diff_excerpt", "form").select("change_id", "site", "path", "full", "form", F.monotonically_increasing_id().alias("no"))
    diffs = durable(diffs.mapInPandas(keyed, "change_id string, site string, path string, full string, form string, no bigint, asked array<bigint>"))
    wanted = diffs.select("site", "path").unionByName(diffs.select("site", F.col("full").alias("path"))).select(*_page_hash()).distinct()
    near = flags.select("*", *_page_hash()).join(bounded(wanted), ["p1", "p2"], "left_semi")
    seen = near.select("p1", "p2", F.explode(F.arrays_zip("line_keys", F.split("codes", "").alias("code"))).alias("x"))
    lines = seen.groupBy("p1", "p2", F.col("x.line_keys").alias("key")).agg(F.bool_and(F.col("x.code") == "F").alias("frame"), F.bool_or(F.col("x.code") == "T").alias("title"))
    pages = lines.groupBy("p1", "p2").agg(F.collect_list(F.when(F.col("frame"), F.col("key"))).alias("own"), F.collect_list(F.when(F.col("title"), F.col("key"))).alias("titles"))
    # a page that its query tells apart is known by its full path
    exact = pages.select("p1", "p2", F.struct("own", "titles").alias("exact"))
    for_full = [F.xxhash64(F.lit(x), "site", "full").alias(n) for x, n in (("a", "p1"), ("b", "p2"))]
    of_path = diffs.select("no", *_page_hash()).join(pages.select("p1", "p2", F.struct("own", "titles").alias("near")), ["p1", "p2"]).select("no", "near")
    of_full = diffs.select("no", *for_full).join(exact, ["p1", "p2"]).select("no", "exact")
    learned = diffs.select("no", F.explode("asked").alias("key")).join(bounded(coded.model), "key").groupBy("no").agg(F.collect_list(F.struct("key", "kind")).alias("found"))
    known = diffs.select("no", "change_id", "form").join(of_path, "no", "left").join(of_full, "no", "left").join(learned, "no", "left")
    best = F.coalesce("exact", "near")
    return known.select("change_id", "form", best["own"].alias("own"), best["titles"].alias("titles"), "found").mapInPandas(found, "change_id string, line_no int").distinct()


def diff_flags(text: str, learned: Learned, titles: set[int]) -> list[int]:
    """Numbers, from 1, of the frame lines of one diff."""
    out = []
    hunk: list[tuple[int, str]] = []

    def close() -> None:
        p = lines_of([x for _, x in hunk], titles)
        flags = with_links(p, deleted(p, [False] * len(hunk), learned), learned)
        out.extend(no for (no, _), flag in zip(hunk, flags) if flag)
        hunk.clear()

    for no, line in enumerate(text.split("\n"), 1):
        if line.startswith("@@"):
            close()
        else:
            hunk.append((no, line[1:] if line[:1] in "+- " else line))
    close()
    return out
