"""Text, hash and URL expressions. All are built-in expressions but for the two UDFs at the end."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags that end a passage.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|legend|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
# White space the reference's language knows, besides the line feed.
SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The entities handled without Python, in the order in which they are replaced.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&middot;": "·", "&copy;": "©", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def content_kind(content_type: Column) -> Column:
    """'html', 'text' or 'binary' of a Content-Type; null is binary."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.contains("html") | t.contains("xml"), "html").when(t.startswith("text/") | t.contains("json"), "text").otherwise("binary")


def decoded(raw: Column) -> Column:
    """UTF-8 text of bytes, U+FFFD for what is not valid; null stays null."""
    return F.make_valid_utf8(raw.cast("string"))


def normalized_text(text: Column) -> Column:
    """One passage a line: white space collapsed, lines trimmed, empty lines dropped, lower case."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, f"[{SPACE}]+", " ")
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.lower(F.regexp_replace(t, r"^[ \n]+|[ \n]+$", ""))


def without_tags(markup: Column) -> Column:
    """Markup with scripts, styles, comments and tags turned into blanks and line breaks; entities stay."""
    # an end tag may carry blanks and attributes and still ends its element
    t = F.regexp_replace(markup, r"(?is)<script.*?</script\b[^>]*>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style\b[^>]*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]+>", " ")


def common_entities(text: Column) -> Column:
    for name, plain in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def has_rare_entity(text: Column) -> Column:
    """Whether an entity is left that :func:`common_entities` does not know, or one that it would decode twice."""
    names = "|".join(n[1:-1] for n in ENTITIES)
    return F.coalesce(text.rlike(rf"&(?!(?:{names});)[#A-Za-z]|&amp;[#A-Za-z]"), F.lit(False))


def passages(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x != "")


def excerpt(text: Column, count: int = 12, budget: int = 900) -> Column:
    """The first ``count`` passages while they fit into ``budget`` characters; the one that does not is cut there."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(budget).alias("left"))

    def step(s: Column, x: Column) -> Column:
        out = F.when(s["left"] > 0, F.concat(s["out"], F.array(F.substring(x, F.lit(1), s["left"])))).otherwise(s["out"])
        return F.struct(out.alias("out"), (s["left"] - F.length(x)).alias("left"))

    return F.array_join(F.aggregate(F.slice(passages(text), 1, count), start, step, lambda s: s["out"]), "\n")


def title_markup(markup: Column) -> Column:
    """The first title element's text with tags as blanks, entities as they are; '' without one."""
    return F.regexp_replace(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title\b[^>]*>", 1), r"<[^>]+>", " ")


def collapsed(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}\\n]+", " "))


def public_text_verdict(c: Column) -> Column:
    """'empty', 'control' (control or format characters but line ends and tabs), 'long' (over 16,000 bytes) or 'safe'."""
    held = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(c.rlike(held), "control").when(F.octet_length(c) > 16_000, "long").otherwise("safe")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def change_id(source: Column, previous: Column, new: Column) -> Column:
    """Sixteen hex digits naming a transition; a removal has an empty new hash."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (source, previous, new)]), 256), 1, 16)


def event_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def duration_words(seconds: Column) -> Column:
    """Days from two on, one day, hours from two on, minutes from two on, else seconds."""
    s = seconds.cast("bigint")
    return (
        F.when(s >= 172_800, F.concat(F.floor(s / 86_400).cast("string"), F.lit(" days")))
        .when(s >= 86_400, F.lit("1 day"))
        .when(s >= 7_200, F.concat(F.floor(s / 3_600).cast("string"), F.lit(" hours")))
        .when(s >= 120, F.concat(F.floor(s / 60).cast("string"), F.lit(" minutes")))
        .otherwise(F.concat(s.cast("string"), F.lit(" seconds")))
    )


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def netloc(url: Column) -> Column:
    """Authority of a URL with user and port, in lower case; '' without one."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def url_faults(url: Column) -> Column:
    """Names of the rules a page address breaks, in a fixed order."""
    n = netloc(url)
    return F.array_compact(F.array(
        F.when(~F.lower(url).startswith("https://"), "not-https"),
        F.when(n == "", "no-host"),
        F.when(n.contains("@"), "credentials"),
        F.when(url.contains("#"), "fragment"),
    ))


def strict_date(c: Column) -> Column:
    """A date written yyyy-MM-dd; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def iso_utc(ts: Column) -> Column:
    """A time in UTC as ISO text, with microseconds where there are any."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), r"\.000000", "")


def rfc2822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss +0000")


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """All HTML entities, in one pass; only for rows that :func:`has_rare_entity` picks."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def actor_identity(names: pd.Series) -> pd.Series:
    """A name's canonical, case-folded form; '' where it holds control or format characters or is blank or over 200 bytes."""

    def one(x: str) -> str:
        if any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in x):
            return ""
        y = " ".join(unicodedata.normalize("NFKC", x).split())
        return y.casefold() if 1 <= len(y.encode()) <= 200 else ""

    return names.map(one, na_action="ignore")
