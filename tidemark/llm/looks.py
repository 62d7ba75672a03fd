"""One form for texts that look the same.

Method: characters that fail the normalization quick check (or are invisible,
of another width, joined, or a look-alike) are isolated as segments together
with the starter before them; only the segments are normalized, and the results
are spliced into the unchanged rest. A word whose letters all look alike in several
scripts is written in the script of its line. Texts of plain ASCII never reach Python.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that look like a Latin letter, by script (after Unicode's table of confusables).
CYRILLIC = "а=a е=e о=o р=p с=c у=y х=x і=i ѕ=s ј=j һ=h ԁ=d ԛ=q ԝ=w ѵ=v ӏ=l А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X І=I Ѕ=S Ј=J Һ=H Ԛ=Q Ԝ=W Ѵ=V Ӏ=I"
GREEK = "ο=o ν=v ρ=p ϳ=j ι=i α=a γ=y υ=u κ=k Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϳ=J"
ARMENIAN = "ո=n ս=u ց=g օ=o հ=h զ=q յ=j ք=p Ս=U Օ=O Լ=L Տ=S"
LATIN = "ɑ=a ɡ=g ɩ=i ı=i ʏ=Y ƽ=s"
# Format characters that are seen.
VISIBLE_FORMAT = "0600-0605 06DD 070F 0890-0891 08E2 110BD 110CD"
# Further characters that show nothing.
INVISIBLE = "034F 115F-1160 17B4-17B5 180B-180F 3164 FE00-FE0F FFA0 E0100-E01EF"
# Blanks other than U+0020 that are not of category Zs.
BLANKS = "0009 000B 000C 0085"
# Hyphens that look like U+002D.
HYPHENS = "2010 2011"


def _codes(spec: str) -> set[int]:
    out: set[int] = set()
    for part in spec.split():
        lo, _, hi = part.partition("-")
        out.update(range(int(lo, 16), int(hi or lo, 16) + 1))
    return out


def _pairs(spec: str) -> dict[str, str]:
    return dict(p.split("=") for p in spec.split())


class _Tables:
    """Maps and patterns derived from the Unicode database of the running Python."""

    def __init__(self) -> None:
        visible, invisible = _codes(VISIBLE_FORMAT), _codes(INVISIBLE)
        self.fold: dict[int, str] = {}
        second: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # joining Hangul vowels and finals
        unstable: set[int] = set()
        for o in [*range(0x80, 0x32000), *range(0xE0000, 0xE0200)]:
            c = chr(o)
            cat = ud.category(c)
            if cat in ("Cn", "Cs", "Co") and o not in invisible:
                continue
            if o in invisible or (cat == "Cf" and o not in visible):
                self.fold[o] = ""
                continue
            if cat == "Zs":
                self.fold[o] = " "
                continue
            d = ud.decomposition(c)
            if d.startswith("<"):
                tag, _, rest = d.partition(" ")
                plain = "".join(chr(int(x, 16)) for x in rest.split())
                letters = cat[0] == "L" and len(plain) > 1 and all(ud.category(x)[0] in "LM" for x in plain)
                if tag in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>") or (tag == "<compat>" and letters):
                    self.fold[o] = ud.normalize("NFKC", plain)
            elif d:
                parts = d.split()
                if len(parts) == 2:
                    second.add(int(parts[1], 16))
            if ud.combining(c) or not ud.is_normalized("NFC", c):
                unstable.add(o)
        self.fold.update({o: " " for o in _codes(BLANKS)})
        self.fold.update({o: "-" for o in _codes(HYPHENS)})
        self.fold.update({ord(k): v for k, v in _pairs(LATIN).items()})
        unstable |= second | set(self.fold)
        unstable.discard(10)
        self.segment = re.compile(f"[{self._class(unstable)}]+")
        self.scripts = [(regex.compile(p), m, {v: k for k, v in m.items()}) for p, m in (
            (r"\p{Cyrillic}", _pairs(CYRILLIC)), (r"\p{Greek}", _pairs(GREEK)), (r"\p{Armenian}", _pairs(ARMENIAN)))]
        self.other = re.compile("[\u0370-\u058f]")
        self.word = regex.compile(r"[\p{L}\p{M}]+")
        self.latin = regex.compile(r"\p{Latin}")
        self.shared = {v for _, m, _ in self.scripts for v in m.values()}
        self.bare = cache(self._bare)
        self.one_word = lru_cache(1 << 16)(self._one_word)

    @staticmethod
    def _class(codes: set[int]) -> str:
        out, run = [], None
        for o in sorted(codes) + [sys.maxunicode + 9]:
            if run and o == run[1] + 1:
                run[1] = o
                continue
            if run:
                out.append(f"\\U{run[0]:08x}" + (f"-\\U{run[1]:08x}" if run[1] > run[0] else ""))
            run = [o, o]
        return "".join(out)

    def _bare(self, c: str) -> tuple[str, str]:
        d = ud.normalize("NFD", c)
        return d[0], d[1:]

    def segments(self, text: str) -> str:
        """Normalizes the unstable segments, each with the starter before it, and splices them in."""
        out, done = [], 0
        for m in self.segment.finditer(text):
            at = m.start()
            if at > done and text[at - 1] != "\n":
                at -= 1
            out.append(text[done:at])
            out.append(ud.normalize("NFC", ud.normalize("NFC", text[at : m.end()]).translate(self.fold)))
            done = m.end()
        out.append(text[done:])
        return "".join(out)

    def words(self, text: str) -> str:
        """Decides the script of each word in the lines that hold a letter of another script than Latin."""
        if not self.other.search(text):
            return text
        return "\n".join(self._line(x) if self.other.search(x) else x for x in text.split("\n"))

    def _line(self, line: str) -> str:
        words = [(m.start(), m.end(), *self.one_word(m[0])) for m in self.word.finditer(line)]
        sure = [0] * (len(self.scripts) + 1)
        for _, _, _, own, letters in words:
            if own >= 0:
                sure[own] += letters
        # letters of one script only are the same in all texts that look alike, so all of them decide alike
        main = max(range(len(sure)), key=lambda k: (sure[k], k == len(self.scripts)))
        out, done = [], 0
        for lo, hi, forms, own, _ in words:
            out += [line[done:lo], forms[own if own >= 0 else main]]
            done = hi
        return "".join(out) + line[done:]

    def _one_word(self, w: str) -> tuple[tuple[str, ...], int, int]:
        """A word in the letters of each script and, last, in Latin ones; the script of its letters that belong to one only, -1 without such; their number."""
        bare = [self.bare(c) for c in w]
        n = [0] * (len(self.scripts) + 1)
        latin = []
        for b, marks in bare:
            to = b
            for k, (own, table, _) in enumerate(self.scripts):
                if own.match(b):
                    n[k] += b not in table
                    to = table.get(b, b)
            if to == b and b not in self.shared and self.latin.match(b):
                n[-1] += 1
            latin.append((to, marks))
        first = next((k for k, x in enumerate(n) if x), -1)
        forms = [ud.normalize("NFC", "".join(back.get(b, b) + marks for b, marks in latin)) for _, _, back in self.scripts]
        return (*forms, ud.normalize("NFC", "".join(b + marks for b, marks in latin))), first, n[first] if first >= 0 else 0


@cache
def _tables() -> _Tables:
    return _Tables()


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null stays null. Lines keep their number."""
    if text is None or text.isascii():
        return text if text is None else text.translate({9: " ", 11: " ", 12: " "})
    t = _tables()
    return t.words(t.segments(text))


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def with_canonical(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``, the canonical form of ``column``.

    Null gives null, empty gives empty. Texts of printable ASCII are their own
    form and are not sent to Python, however long.
    """
    plain = F.col(column).isNull() | ~F.col(column).rlike(r"[^\n\x20-\x7e]")
    sent = df.withColumn("__tm_sent", F.when(~plain, F.col(column)))
    return sent.withColumn("__tm_form", _canonical_udf(F.col("__tm_sent"))).withColumn(out, F.coalesce(F.col("__tm_form"), F.col(column))).drop("__tm_sent", "__tm_form")


def look_hash(c: Column) -> list[Column]:
    """Two 64-bit hashes of a text, for comparisons without carrying it."""
    return [F.xxhash64(F.lit("a"), c), F.xxhash64(F.lit("b"), c)]
