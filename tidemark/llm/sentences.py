"""Sentence boundaries across languages and scripts.

Method: abbreviations, collocations and sentence starters are learned without
labels, per language, by log-likelihood ratios over all documents; every period is
then classified with these statistics. Headings and starters of scripts without
periods are learned from the same counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable, spread

# Sentence-ending marks besides the period, and marks that may close a sentence.
ENDERS = "!?。！？।؟｡．॥۔‼⁇"
CLOSERS = "\"'”’»›」』)）]】》〉"
OPENERS = "\"'“‘„«‹「『(（[【《〈¿¡"
# Pairs of marks around quotations and asides.
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "《": "》"}
COUNTS = "lang string, kind string, a string, b string, n bigint"
SCRIPTS = {"th": r"\p{Thai}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}"}
_SCRIPT_RE = {k: regex.compile(v) for k, v in SCRIPTS.items()}
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile("|".join(SCRIPTS.values()))
_LIST = regex.compile(r"[ \t]*(?:[-*•‣◦·–—]|\(?(?:\d{1,3}|[a-zA-Z])\)|\d{1,3}\.)[ \t]+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_LETTER = re.compile("[A-Za-z]")
_STRIP = OPENERS + CLOSERS
_DIGIT = re.compile(r"\d")
_MARK = re.compile("[\\n." + re.escape(ENDERS + CLOSERS) + "]")
_MARK_OR_BLANK = re.compile("[ \\n." + re.escape(ENDERS + CLOSERS) + "]")
_OPEN = re.compile("[" + re.escape("".join(PAIRS) + '"”') + "]")
_SEEN = re.compile(r"\S")
_AHEAD = 160  # characters looked at behind a mark
_BLANK = regex.compile(r"\n[ \t\r]*\n")


def next_place(text: str, k: int) -> int:
    """The next place from ``k`` on that is no white space; the end without one."""
    m = _SEEN.search(text, k)
    return m.start() if m else len(text)


def last_place(text: str, k: int, floor: int = 0) -> int:
    """The last place before ``k`` that is no white space; below ``floor`` without one."""
    k -= 1
    while k >= floor and text[k].isspace():
        k -= 1
    return k


def _script_table() -> np.ndarray:
    """Class of each code point below 0x30000: 0 none, 1 Latin, then the scripts in their order."""
    out = np.zeros(0x30000, dtype=np.uint8)
    for at, pattern in enumerate([_LATIN, *_SCRIPT_RE.values()], 1):
        for m in pattern.finditer("".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x30000)))):
            out[ord(m[0])] = at
    return out


@cache
def _scripts() -> np.ndarray:
    return _script_table()


def script_counts(text: str) -> dict[str, int]:
    """Letters by script in one pass over the code points; of plain ASCII it only says whether there are any."""
    if text.isascii():
        return {"latin": len(text) if _ASCII_LETTER.search(text) else 0}
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.bincount(_scripts()[np.minimum(codes, 0x2FFFF)], minlength=len(SCRIPTS) + 2)
    return dict(zip(["latin", *SCRIPTS], n[1:].tolist()))


def script_of(n: dict[str, int]) -> str | None:
    """The language its script tells, 'latin' for Latin letters, None without letters."""
    ja, zh = n.get("ja", 0), n.get("zh", 0)
    if ja and ja * 8 > zh:
        n = {**n, "ja": ja + zh}
    best = max(n, key=n.get, default=None)
    return best if best and n[best] else None


def script_language(text: str) -> str | None:
    return script_of(script_counts(text))


def base_language(label: str | None) -> str | None:
    """'en' of 'en-US' or 'EN'; None for what is not a two-letter code."""
    if not label:
        return None
    b = label.strip().lower().replace("_", "-").split("-")[0]
    return b if len(b) == 2 else None


@lru_cache(1 << 16)
def _word_of(token: str) -> str:
    w = token.strip(_STRIP + ",;:").lower()
    return "#" if _DIGIT.search(w) else w


def word_of(token: str) -> str:
    """Lower case without quotes and commas at the ends; tokens with digits become '#'. Long tokens are not cached."""
    return _word_of(token) if len(token) <= 64 else _word_of.__wrapped__(token)


def start_form(token: str) -> str:
    """A word as it may begin a sentence: lower case, marked with '=' where it was written so."""
    w = word_of(token).rstrip(".")
    return "=" + w if token.lstrip(_STRIP)[:1].islower() else w


_BARE, _PERIOD, _ENDER, _QUIET, _CAPITAL = 1, 2, 4, 8, 16


@lru_cache(1 << 16)
def _token(t: str) -> tuple[str, int, str, str, str]:
    """A token as it is counted: word; whether without marks behind, with a period, with another mark, with no mark, with a capital; stem; form as a start; kind and word as a follower."""
    w = word_of(t)
    core = t.rstrip(CLOSERS + ",;:")
    bare = t == core
    period = core.endswith(".") and not core.endswith("..")
    stem = (w.rstrip(".!?").strip(_STRIP) if w != "#" else w) if period else ""
    v = w.rstrip(".")
    case = "N" if v == "#" else "L" if t.lstrip(_STRIP)[:1].islower() else "U"
    spoken = w == "#" or any(ch.isalnum() for ch in w)
    ender = core[-1:] in ENDERS and not period
    flags = _BARE * bare | _PERIOD * period | _ENDER * ender | _QUIET * (bare and core[-1:].isalnum()) | _CAPITAL * t[:1].isupper()
    return w, flags, stem, start_form(t) if spoken else "", f"{case} {v}"


def first_key(text: str, at: int = 0) -> str:
    """The first two words at a place, as headings and sentences are told apart by them."""
    words = text[at : at + 80].split(None, 2)[:2]
    return " ".join(word_of(w) for w in words)


def _count_document(text: str, lang: str, out: dict[tuple[str, str], Counter]) -> None:
    if lang == "th":
        for m in regex.finditer(r"(?:^|(?<=[ \n]))\p{Thai}{2}[\p{Thai}]{0,4}", text):
            at = m.start()
            before = text[:at].rstrip(" ")[-1:] if at else "\n"
            sure = before == "\n" or bool(_SCRIPT_RE["th"].match(before))
            out[lang, "th_start" if sure else "th_mid"][m[0]] += 1
        return
    if lang in ("zh", "ja"):
        return
    paragraphs = _BLANK.split(text)
    plain: list[str] = []
    for pn, par in enumerate(paragraphs):
        lines = par.split("\n")
        ended = True
        for i, line in enumerate(lines):
            s = line.strip()
            if not s:
                continue
            item = _LIST.match(line)
            closed = s.rstrip(CLOSERS)[-1:] in "." + ENDERS
            last = i == len(lines) - 1
            if item is None and ended and not closed:
                key = first_key(s)
                following = lines[i + 1].lstrip()[:1] if not last else ""
                if last:
                    kind = "head" if pn < len(paragraphs) - 1 else ""
                elif _LIST.match(lines[i + 1]) or not following.islower():
                    kind = "head"
                else:
                    kind = "wrap"
                if kind:
                    out[lang, kind][key] += 1
                    out[lang, kind + "1"][key.split(" ")[0]] += 1
            ended = closed or item is not None or (last and not closed)
        tokens: list[str] = []
        fresh: set[int] = set()
        for line in lines:
            fresh.add(len(tokens))
            tokens += line.split()
        sure, quiet, small = 0, 0, False
        for i, t in enumerate(tokens):
            w, flags, stem, start, form = _token(t) if len(t) <= 64 else _token.__wrapped__(t)
            if sure or not i:
                small = form[0] == "L"
            if sure and start:
                key = first_key(" ".join(tokens[i : i + 2]))
                out[lang, "start"][start] += 1
                out[lang, "sent"][key] += 1
                out[lang, "sent1"][key.split(" ")[0]] += 1
            elif quiet and flags & _CAPITAL and i not in fresh:
                out[lang, "mid"][w.rstrip(".")] += 1
            sure, quiet = 0, flags & _QUIET
            if not flags & (_PERIOD | _ENDER):
                plain.append(w)
            elif not w:
                continue
            elif flags & _PERIOD:
                out[lang, "per"][stem] += 1
                if i + 1 < len(tokens):
                    nxt = tokens[i + 1]
                    after = (_token(nxt) if len(nxt) <= 64 else _token.__wrapped__(nxt))[4]
                    # small letters go on only in a sentence that does not begin with one itself
                    if t[-1] in ",;:":
                        out[lang, "pair"][stem, "," + after[1:]] += 1
                    elif not small or after[0] != "L":
                        out[lang, "pair"][stem, after] += 1
                sure = flags & _BARE and len(stem) >= 5 and i + 1 < len(tokens)
            else:
                sure = flags & _BARE
    words = out[lang, "tok"]
    words.update(plain)
    words.pop("", None)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def drain() -> pd.DataFrame:
        rows = [(lang, kind, *(k if kind == "pair" else (k, "")), n) for (lang, kind), c in out.items() for k, n in c.items()]
        out.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "a", "b", "n"])

    for f in frames:
        for text, label in zip(f["text"], f["lang"]):
            if not text:
                continue
            lang, seen = base_language(label), script_language(text)
            if seen != "latin":
                lang = seen
            elif lang in SCRIPTS:
                lang = None
            if lang:
                _count_document(text, lang, out)
        if sum(map(len, out.values())) > 200_000:
            yield drain()
    yield drain()


@dataclass
class Model:
    """What one language's counts say."""

    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    ends: dict[str, float] = field(default_factory=dict)  # abbreviation -> share of starters among its capital followers
    numbers: dict[str, float] = field(default_factory=dict)  # abbreviation -> share of numbers among its followers
    heads: dict[str, float] = field(default_factory=dict)  # first words -> share of headings
    common: dict[str, float] = field(default_factory=dict)  # frequent words -> share, to tell languages apart
    th_starters: set[str] = field(default_factory=set)
    cased: bool = True


def dunning(a: int, b: int, ab: int, n: int) -> float:
    """Log-likelihood ratio that ``ab`` of ``a`` happen with a near-certain chance rather than with ``b / n``."""
    p1, p2 = b / n, 0.99
    null = ab * math.log(max(p1, 1e-12)) + (a - ab) * math.log(max(1 - p1, 1e-12))
    alt = ab * math.log(p2) + (a - ab) * math.log(1 - p2)
    return -2 * (null - alt)


def two_sided(a: int, b: int, ab: int, n: int) -> float:
    """Log-likelihood ratio that ``ab`` is more than chance brings two events of counts a and b together."""
    if not (0 < ab <= min(a, b)) or b >= n:
        return 0.0
    p, p1, p2 = b / n, ab / a, (b - ab) / max(n - a, 1)

    def ll(k: float, m: float, q: float) -> float:
        q = min(max(q, 1e-12), 1 - 1e-12)
        return k * math.log(q) + (m - k) * math.log(1 - q)

    return 0.0 if p1 <= p2 else -2 * (ll(ab, a, p) + ll(b - ab, n - a, p) - ll(ab, a, p1) - ll(b - ab, n - a, p2))


def starts(form: str, word: str, k: int, tok: int, per: int, mid: int, of: Counter) -> bool:
    """Whether a form counted ``k`` times behind sure ends is a sentence starter; ``of`` are its language's totals."""
    c, breaks = tok + per, of["start"]
    # with letter case: a capital word that stands in a sentence's midst less often than at its start
    if of["mid"] and form == word and k > 2 * mid:
        return True
    return k / max(c, k) > 0.25 and two_sided(breaks, max(c, k), k, max(of["tok"] + of["per"], breaks + c)) > 10


def abbreviates(word: str, tok: int, k: int, n: int, up: int, begun: int, low: int, number: int, of: Counter) -> tuple[bool, float, float]:
    """Whether a word with ``k`` periods is an abbreviation, and its shares in ``Model.ends`` and ``Model.numbers``.

    Of its ``n`` followers ``up`` have a capital, ``begun`` of these and ``low`` of the others begin sentences.
    """
    c, bare = k + tok, len(word.replace(".", ""))
    going = n - up - number - low
    ends, numbers = (begun + low) / max(up + low, 1), number / max(n, 1)
    score = dunning(c, of["per"], k, of["tok"] + of["per"]) * math.exp(-bare) * (word.count(".") + 1) * max(bare, 1) ** -(50 * tok / c)
    likely = score >= 0.3 or (bare == 1 and k > tok)
    inner = n >= 5 and (going + number) / n > 0.5 and k / c > 0.5
    # a word whose followers all begin sentences merely ends them
    final = n >= 3 and (going + (number if numbers > 0.4 else 0)) / n < 0.1 and ends > 0.5
    return (likely or inner) and not final, ends, numbers


def goes_with(word: str, k: int, per: int, c: int, of: Counter) -> bool:
    """Whether a word seen ``c`` times goes with the abbreviation before it, as it follows ``k`` of its ``per`` periods."""
    share = k / max(per, 1) > (0.002 if word == "#" else 0.05) and (word != "#" or k / max(c, 1) > 0.1)
    return share and two_sided(per, max(c, k), k, of["tok"] + of["per"]) > 7.88


def learn(docs: DataFrame, text: str, lang: str) -> dict[str, Model]:
    """Fits the models on all documents, from all their counts.

    Counts are summed in the tasks and then by key, and every word is judged in the tasks by its own
    sums and its language's totals. The driver gets these totals and what the models hold: starters,
    abbreviations, collocations and the first words that tell headings.
    """
    parts = spread(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))).mapInPandas(_count, COUNTS)
    counts = durable(parts.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    of: dict[str, Counter] = defaultdict(Counter)
    for r in counts.groupBy("lang", "kind").agg(F.sum("n")).collect():
        of[r[0]][r[1]] = r[2]
    models = {k: Model(cased=of[k]["mid"] > 0) for k in sorted(of)}
    words = _wide(counts, "tok", "per", "mid")

    begun = counts.filter((F.col("kind") == "start") & (F.col("n") >= 3)).select("lang", "a", "n", F.regexp_replace("a", "^=+", "").alias("word"))
    begun = begun.filter(~F.col("word").isin("", "#")).join(words, ["lang", "word"], "left").na.fill(0, ["tok", "per", "mid"])

    def starting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["lang"], f["a"], f["word"], f["n"], f["tok"], f["per"], f["mid"])
            yield f.loc[np.array([starts(*r, of[g]) for g, *r in rows], dtype=bool), ["lang", "a"]].assign(kind="start", x=1.0)

    found = begun.mapInPandas(starting, "lang string, a string, kind string, x double")
    starters = []
    for g, a, kind, x in found.unionByName(_headings(counts)).unionByName(_frequent(counts, words, of)).collect():
        m = models[g]
        if kind == "start":
            m.starters.add(a)
            starters.append((g, a))
        elif kind == "head":
            m.heads[a] = x
        elif kind == "th":
            m.th_starters.add(a)
        elif a.isalpha():
            m.common[a] = x

    spark = docs.sparkSession
    case, follower = F.substring("b", 1, 1), F.expr("substring(b, 3)")
    pairs = counts.filter(F.col("kind") == "pair").select("lang", F.col("a").alias("word"), "b", "n", case.alias("case"), follower.alias("follower"))
    pairs = pairs.withColumn("form", F.when(F.col("case") == "U", F.col("follower")).when(F.col("case") == "L", F.concat(F.lit("="), "follower")).otherwise(F.col("b")))
    known = spark.createDataFrame(starters, "lang string, form string").withColumn("begun", F.lit(True))
    pairs = pairs.join(known, ["lang", "form"], "left").withColumn("begun", F.col("begun").isNotNull())
    up, low, number = (F.col("case") == c for c in "ULN")
    sums = {"followers": F.lit(True), "up": up, "ups": up & F.col("begun"), "lows": low & F.col("begun"), "number": number}
    after = pairs.groupBy("lang", "word").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in sums.items()))
    stems = words.filter(F.col("per") > 0).join(after, ["lang", "word"], "left").na.fill(0, [*sums])

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, w, per, *r in zip(f["lang"], f["word"], f["per"], f["tok"], f["followers"], f["up"], f["ups"], f["lows"], f["number"]):
                if w == "#":
                    out.append((g, w, per, False, 0.0, 0.0))
                elif any(ch.isalpha() for ch in w):
                    tok, *seen = r
                    short, ends, numbers = abbreviates(w, tok, per, *seen, of[g])
                    # the shares are asked of abbreviations and of initials only
                    if short or len(w) == 1:
                        out.append((g, w, per, short, ends, numbers))
            yield pd.DataFrame(out, columns=["lang", "word", "per", "short", "ends", "numbers"])

    before = []
    for g, w, per, short, ends, numbers in stems.mapInPandas(judged, "lang string, word string, per bigint, short boolean, ends double, numbers double").collect():
        m = models[g]
        if short:
            m.abbreviations.add(w)
        if short or w == "#":
            before.append((g, w, per))
        if w != "#":
            m.ends[w], m.numbers[w] = ends, numbers

    going = pairs.filter((F.col("n") >= 3) & ~F.col("begun") & (F.col("case") != ",") & (F.col("follower") != ""))
    going = going.join(spark.createDataFrame(before, "lang string, word string, of_word bigint"), ["lang", "word"])
    going = going.join(words.select("lang", F.col("word").alias("follower"), (F.col("tok") + F.col("per")).alias("c")), ["lang", "follower"], "left").na.fill(0, ["c"])

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["lang"], f["word"], f["n"], f["of_word"], f["c"])
            yield f.loc[np.array([goes_with(*r, of[g]) for g, *r in rows], dtype=bool), ["lang", "word", "follower"]]

    for g, w, v in going.mapInPandas(together, "lang string, word string, follower string").collect():
        models[g].collocations.add((w, v))
    return models


def _wide(counts: DataFrame, *kinds: str) -> DataFrame:
    """A row for each language and word, with its sum in each kind."""
    sums = (F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds)
    return counts.filter(F.col("kind").isin(*kinds)).groupBy("lang", F.col("a").alias("word")).agg(*sums)


def _headings(counts: DataFrame) -> DataFrame:
    """Shares of headings by first words: first words ('word *') that mostly begin headings, and the two first words that differ from theirs in this."""
    wide = {k: _wide(counts, "head" + k, "wrap" + k, "sent" + k).filter(F.col("head" + k) > 0) for k in ("", "1")}
    share = {k: F.col("head" + k) / (F.col("head" + k) + F.col("wrap" + k) + F.col("sent" + k)) for k in wide}
    one = wide["1"].select("lang", F.concat("word", F.lit(" *")).alias("first"), share["1"].alias("mostly"))
    two = wide[""].select("lang", F.col("word").alias("a"), F.concat(F.substring_index("word", " ", 1), F.lit(" *")).alias("first"), share[""].alias("x"))
    two = two.filter(F.col("a") != F.col("first")).join(one, ["lang", "first"]).filter((F.col("x") > 0.5) != (F.col("mostly") > 0.5))
    told = one.filter(F.col("mostly") > 0.5).select("lang", F.col("first").alias("a"), F.col("mostly").alias("x"))
    return told.unionByName(two.select("lang", "a", "x")).withColumn("kind", F.lit("head"))


def _frequent(counts: DataFrame, words: DataFrame, of: dict[str, Counter]) -> DataFrame:
    """The forty most frequent words, by which languages are told apart, with their shares; the starters of Thai.

    Each task keeps forty words a language before the shuffle (WindowGroupLimit).
    """
    totals = counts.sparkSession.createDataFrame([(k, max(n["tok"] + n["per"], 1)) for k, n in of.items()], "lang string, total bigint")
    order = Window.partitionBy("lang").orderBy(F.col("tok").desc(), "word")
    first = words.filter(F.col("tok") > 0).select("lang", "word", "tok", F.row_number().over(order).alias("place")).filter(F.col("place") <= 40)
    first = first.join(F.broadcast(totals), "lang").select("lang", F.col("word").alias("a"), F.lit("tok").alias("kind"), (F.col("tok") / F.col("total")).alias("x"))
    thai = _wide(counts, "th_start", "th_mid").filter((F.col("th_start") > F.col("th_mid")) & (F.col("th_start") >= 2))
    return first.unionByName(thai.select("lang", F.col("word").alias("a"), F.lit("th").alias("kind"), F.lit(1.0).alias("x")))


class Splitter:
    """Cuts texts into units by fitted models."""

    def __init__(self, models: dict[str, Model]) -> None:
        self.models = models
        self.latin = [k for k in models if k not in SCRIPTS]
        self.common: dict[str, list[str]] = defaultdict(list)
        for k in self.latin:
            for w in models[k].common:
                self.common[w].append(k)

    def language(self, seen: dict[str, int], score: Counter, label: str | None) -> str:
        """By the letters' scripts and, for Latin ones, by the languages' frequent words."""
        own = base_language(label)
        best = script_of(seen)
        if best != "latin":
            return best or own or "en"
        top = max(score, key=score.get, default=None)
        if own in self.latin and (top is None or score[top] <= 1.4 * score[own] + 1):
            return own
        return top or (self.latin[0] if self.latin else "en")

    def marks(self, text: str) -> tuple[dict[str, int], Counter]:
        """Letters by script, and frequent words by language."""
        seen = script_counts(text)
        score: Counter = Counter()
        if seen["latin"]:
            common = self.common
            for w in _WORD.findall(text.lower()):
                if w in common:
                    score.update(common[w])
        return seen, score

    def protected(self, par: str) -> bytearray:
        """1 for characters inside quotations and asides."""
        flags = bytearray(len(par))
        m = _OPEN.search(par)
        while m:
            i, c = m.start(), m[0]
            end = -1
            if c in PAIRS:
                end = par.find(PAIRS[c], i + 1)
                # a mark that opens anew before the close tells that this one was never closed
                if end > 0 and PAIRS[c] != c and par.find(c, i + 1, end) >= 0:
                    end = -1
            elif c == '"':
                end = par.find('"', i + 1)
            elif i == 0 or par[i - 1].isspace():
                end = par.find("”", i + 1)
            if end < 0 and c in PAIRS and c not in "(（" and len(par) - i <= 120:
                end = len(par)
            if end > i:
                flags[i + 1 : end] = b"\x01" * (end - i - 1)
            m = _OPEN.search(par, max(end, i) + 1)
        return flags

    def split(self, text: str | None, label: str | None) -> list[tuple[int, int]]:
        """Units as (start, end) in characters; null, empty and blank texts have none."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        parts: list[tuple[int, str, dict[str, int], Counter]] = []
        at = 0
        for m in [*_BLANK.finditer(text), None]:
            stop = m.start() if m else len(text)
            parts += [(at + first, par, *self.marks(par)) for first, par in self._by_script(text[at:stop]) if par and not par.isspace()]
            at = m.end() if m else stop
        seen, score = Counter(), Counter()
        for _, _, letters, words in parts:
            seen.update(letters)
            score.update(words)
        whole = self.language(seen, score, label)
        for first, par, letters, words in parts:
            lang = self.language(letters, words, whole) if len(par) > 30 else whole
            for lo, hi in self._paragraph(par, lang, whole):
                while lo < hi and par[lo].isspace():
                    lo += 1
                while hi > lo and par[hi - 1].isspace():
                    hi -= 1
                if hi > lo:
                    out.append((first + lo, first + hi))
        return out

    @staticmethod
    def _by_script(par: str) -> Iterator[tuple[int, str]]:
        """The paragraph, cut where its lines go from Latin letters to another script or back."""
        if par.isascii() or "\n" not in par or not _FOREIGN.search(par) or len(_LATIN.findall(par)) <= 20:
            yield 0, par
            return
        first, kind, at = 0, None, 0
        for line in par.splitlines(keepends=True):
            own = None
            if len(_LATIN.findall(line)) > 20 or len(_FOREIGN.findall(line)) > 5:
                own = script_language(line) == "latin"
            if own is not None and kind is not None and own != kind:
                yield first, par[first:at]
                first = at
            kind = own if own is not None else kind
            at += len(line)
        yield first, par[first:]

    def _paragraph(self, par: str, lang: str, whole: str) -> list[tuple[int, int]]:
        m = self.models.get(lang) or Model()
        outer = self.models.get(whole) or m
        inside = self.protected(par)
        cuts: list[int] = [0]
        start = len(par) - len(par.lstrip())
        item = bool(_LIST.match(par, 0))
        i, n = 0, len(par)
        if item:
            i = _LIST.match(par, 0).end()
        mark = _MARK_OR_BLANK if lang == "th" else _MARK
        while i < n:
            at = mark.search(par, i)
            if at is None:
                break
            i = at.start()
            c = par[i]
            cut = -1
            if c == "\n":
                nxt = i + 1
                while nxt < n and par[nxt] in " \t\r":
                    nxt += 1
                li = _LIST.match(par, i + 1)
                if li and not self._date_item(par, i + 1, li, m):
                    cut = i + 1
                elif self._line_ends(par, start, i, nxt, item, lang, m, outer) and not inside[i]:
                    cut = i + 1
            elif inside[i]:
                pass
            elif c == " " and lang == "th" and not item:
                if self._thai_break(par, i, m):
                    cut = i + 1
            elif c in ENDERS or c == ".":
                j = i + 1
                while j < n and (par[j] in ENDERS or par[j] == "."):
                    j += 1
                k = j
                while k < n and par[k] in CLOSERS:
                    k += 1
                if self._ends(par, start, i, j, k, lang, m) and not (item and c == "." and i < start + 5 and par[start:i].strip().isdigit()):
                    cut = k
                i = k - 1
            elif c in CLOSERS and i and par[i - 1] in "." + ENDERS and inside[i - 1]:
                # an end inside a quotation that the quotation's own end completes
                if self._quote_ends(par, i + 1, lang, m):
                    cut = i + 1
            if cut >= 0 and cut < n:
                cuts.append(cut)
                start = cut
                while start < n and par[start].isspace():
                    start += 1
                li = _LIST.match(par, start) if "\n" in par[cut - 1 : start] else None
                item = li is not None
                i = (li.end() if li else cut) - 1
            i += 1
        cuts.append(n)
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    @staticmethod
    def _date_item(par: str, at: int, li: regex.Match, m: Model) -> bool:
        """A number with a period at a line's start that goes with the word after it, as a day with its month."""
        mark = li[0].strip()
        return mark.endswith(".") and mark[:-1].isdigit() and ("#", word_of((par[li.end() :].split(None, 1) or [""])[0]).rstrip(".")) in m.collocations

    def _line_ends(self, par: str, start: int, i: int, nxt: int, item: bool, lang: str, m: Model, outer: Model) -> bool:
        """Whether the unit that began at ``start`` ends with the line that ends at ``i``, where no mark ends it."""
        if nxt >= len(par):
            return False
        end = last_place(par, i, start)
        if end < start:
            return False
        first = par[nxt]
        if lang in ("zh", "ja"):
            return True
        if lang == "th":
            return self._thai_break(par, i, m) or (bool(_SCRIPT_RE["th"].match(first)) and item)
        following = (par[nxt : nxt + 60].split(None, 1) or [""])[0]
        begun = start_form(following) in m.starters
        if item:
            return not (first.islower() and not begun)
        key = first_key(par, start)
        share = max((x.heads.get(key, x.heads.get(key.split(" ")[0] + " *", 0.0)) for x in (m, outer)), default=0.0)
        if first.islower() and not begun:
            return False
        if not m.cased and not begun and ("#" in key or word_of(following) != "#"):
            return False
        if par[end] in "." + ENDERS + ",;:":
            return False
        return share > 0.5

    @staticmethod
    def _thai_break(par: str, i: int, m: Model) -> bool:
        th = _SCRIPT_RE["th"]
        at, to = last_place(par, i), next_place(par, i)
        before, after = par[at : at + 1] if at >= 0 else "", par[to : to + 6]
        if not after or not th.match(after):
            return bool(after) and par[i] == "\n" and bool(th.match(before)) and not after[0].isdigit() and not after[0].isascii()
        prefix = regex.match(r"\p{Thai}{2}[\p{Thai}]{0,4}", after)
        known = bool(prefix) and prefix[0] in m.th_starters
        return known or bool(th.match(before))

    def _quote_ends(self, par: str, k: int, lang: str, m: Model) -> bool:
        rest = par[k : k + _AHEAD].lstrip(" \t\r")
        if not rest:
            return False
        if rest[0] in ",;:.。，、；：" or rest[0] in ENDERS:
            return False
        if lang in ("zh", "ja"):
            return rest[0] == "\n"
        ahead = rest.split(None, 1)[:1]
        return bool(ahead) and par[k : k + 1].isspace() and ahead[0].lstrip(_STRIP)[:1].isupper() and start_form(ahead[0]) in m.starters

    def _ends(self, par: str, start: int, i: int, j: int, k: int, lang: str, m: Model) -> bool:
        """Whether the marks par[i:j], closed up to k, end a unit."""
        gap = par[k : k + 1].isspace()
        to = next_place(par, k)
        ahead = par[to : to + _AHEAD]
        if not ahead:
            return False
        marks = par[i:j]
        if marks[0] in ENDERS and not (marks[0] in "!?" and ahead[0] in ",;:"):
            return ahead[0] not in ",;:，；、"
        nxt_tok = ahead.split(None, 1)[0]
        word = word_of(nxt_tok).rstrip(".")
        lead = nxt_tok.lstrip(_STRIP)[:1]
        begun = start_form(nxt_tok) in m.starters
        if ahead[0] in ",;:)" or (not gap and ahead[0] in "-/@_"):
            return False
        if len(marks) >= 2 and marks.strip(".") == "":
            if last_place(par, i, start) < start:
                return False
            return gap and lead.isupper() and begun
        at = i
        while at > start and not par[at - 1].isspace():
            at -= 1
        token = par[at:i]
        stem = word_of(token + ".").rstrip(".") if token else ""
        if lang in SCRIPTS and stem.isascii() and stem.isalpha():
            m = self.models.get("en") or m
            begun = start_form(nxt_tok) in m.starters
        if not token or not stem:
            return gap and last_place(par, at, start) >= start
        if not gap:
            before = par[i - 1]
            glued = regex.match(r"[\p{Lu}][\p{Ll}]|[\p{Lu}]\s|[“\"«¿¡„]|\p{Lo}", ahead)
            lower_end = before.islower() or before.isdigit() or before in CLOSERS + "%" or not before.isascii()
            if not glued or not lower_end:
                return False
            if stem == "#":
                return bool(regex.match(r"\p{Lu}", ahead)) and bool(regex.fullmatch(r"[^\p{L}]+", token))
            inner = word_of(regex.split(r"[^\p{L}\p{M}'-]", ahead.lstrip(_STRIP), maxsplit=1)[0])
            return stem not in m.abbreviations and "/" not in token and (inner in m.starters or (len(stem) > 2 and lead.isupper()))
        if stem == "#":
            return ("#", word) not in m.collocations or not regex.fullmatch(r"\d{1,2}", token)
        initial = len(stem) == 1 and stem.isalpha() and lang not in ("zh", "ja", "th")
        if stem not in m.abbreviations and not initial:
            return True
        if (stem, word) in m.collocations and not begun:
            return False
        if nxt_tok[:1] and _DIGIT.match(lead or nxt_tok[0]):
            return not initial and m.ends.get(stem, 0.0) > 0.5 and m.numbers.get(stem, 0.0) < 0.25
        if begun:
            return m.ends.get(stem, 0.0) >= 0.3 and not (initial and m.ends.get(stem, 0.0) < 0.6)
        if lead.islower():
            return False
        return not initial and m.ends.get(stem, 0.0) > 0.6


def split_documents(docs: DataFrame, models: dict[str, Model], doc: str, text: str, lang: str) -> DataFrame:
    """(doc, start_pos, end_pos) for every unit of every document.

    Null ids and null and blank texts give no rows. Offsets count characters from 0, the end is
    exclusive. The models are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Splitter(shared.value)
        for f in frames:
            ids, los, his = [], [], []
            for d, t, g in zip(f["doc"], f["text"], f["lang"]):
                for lo, hi in cutter.split(t, g):
                    ids.append(d)
                    los.append(lo)
                    his.append(hi)
            yield pd.DataFrame({doc: pd.Series(ids, dtype="int64"), "start_pos": pd.Series(los, dtype="int64"), "end_pos": pd.Series(his, dtype="int64")})

    picked = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("doc").isNotNull())
    return spread(picked).mapInPandas(run, f"{doc} bigint, start_pos bigint, end_pos bigint")
