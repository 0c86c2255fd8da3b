"""Text functions as column expressions: Arabic normalisation, templates, escaping and screening."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges and screening patterns that decide which texts are accepted.
DIACRITICS = "[\u064b-\u065f\u0670]"
ARABIC_LETTER = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]"
EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]+"
PHONE = r"(?:\+?\d[\s().-]*){7,}"
RAW_HTML = r"(?i)</?[a-z][^>]*>"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\s*\("
UNSAFE_URL = r"(?i)\b(?:javascript|data):"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CREDENTIAL = r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|Bearer\s+[A-Za-z0-9._~+/-]{12,})\b"
WEB_URL = r"(?i)(?:https?://|www\.)"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,159}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SHA256 = r"^[a-f0-9]{64}$"
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"

# The characters that trimming removes.
WHITE_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Of these, the spaces of Unicode: no tabs, line ends or joiners.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

UNSAFE = {
    "email": EMAIL,
    "phone": PHONE,
    "raw_html": RAW_HTML,
    "markdown_image": MARKDOWN_IMAGE,
    "unsafe_url": UNSAFE_URL,
    "control": CONTROL,
}


def trim(c: Column | str) -> Column:
    """The text without white space at its ends: line ends, tabs and Unicode spaces too."""
    return F.trim(c, F.lit(WHITE_SPACE))


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(trim(c), DIACRITICS, "")


def surface_key(c: Column) -> Column:
    """Key of a surface keyword: lower case without joiners and diacritics."""
    return F.regexp_replace(F.lower(trim(c)), "[_\\-\u064b-\u065f\u0670]", "")


def json_key(c: Column) -> Column:
    """Key of a JSON label: lower case without white space, joiners, quotes and hamza."""
    return F.regexp_replace(F.lower(trim(c)), "(?U)[\\s_\\-\u2018\u2019'`\u0621]", "")


def has_arabic_letter(c: Column) -> Column:
    return c.rlike(ARABIC_LETTER)


def parse_integer(c: Column) -> Column:
    """Signed integer in ASCII, Arabic-Indic or extended digits; null if malformed or out of range."""
    digits = F.translate(c, "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA), 0x2212])), "01234567890123456789-")
    return F.when(c.rlike("^[-\u2212]?[0-9\u0660-\u0669\u06f0-\u06f9]+$"), digits.try_cast("long"))


def strip_comment(line: Column) -> Column:
    """The line before its first `#`, quoted or not."""
    return F.substring_index(line, "#", 1)


def strip_quoted(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', '""')


def tokens_quoted(line: Column) -> Column:
    """Words and quoted strings (with their quotes) of a line; null if a quote is not closed."""
    even = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0
    return F.when(even, F.regexp_extract_all(line, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)))


def placeholders(template: Column) -> Column:
    """Trimmed names of the {name} places of a template, in order."""
    return F.transform(F.regexp_extract_all(template, F.lit(r"\{([^}]*)\}"), F.lit(1)), lambda x: trim(x))


def segments(template: Column) -> Column:
    """A template as an array of (literal, place): each literal with the trimmed name of the place after it, null after the last."""
    parts = F.regexp_extract_all(template, F.lit(r"(?s)([^{]*)\{([^}]*)\}"), F.lit(0))
    literal = lambda p: F.substring_index(p, "{", 1)
    place = lambda p: trim(F.regexp_extract(p, r"(?s)\{([^}]*)\}$", 1))
    cut = F.transform(parts, lambda p: F.struct(literal(p).alias("literal"), place(p).alias("place")))
    used = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    rest = F.substring(template, used + 1, F.length(template))
    return F.concat(cut, F.array(F.struct(rest.alias("literal"), F.lit(None).cast("string").alias("place"))))


def template_fault(template: Column) -> Column:
    """`unterminated` if a place is not closed, `empty` if one has no name; null if the template is sound."""
    parts = segments(template)
    open_ = F.element_at(parts, -1)["literal"].contains("{")
    return F.when(open_, "unterminated").when(F.exists(parts, lambda p: F.coalesce(p["place"] == "", F.lit(False))), "empty")


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; values are literal text, in which no place is looked for.

    Places without a value stay as they are; null values make the result null.
    """
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]) if values else F.create_map().cast("map<string,string>")
    names = [F.lit(n) for n in values]
    kept = lambda p: F.concat(F.lit("{"), p["place"], F.lit("}"))
    filled = lambda p: F.when(p["place"].isin(*names), F.element_at(known, p["place"])).otherwise(kept(p)) if names else kept(p)
    parts = F.transform(segments(template), lambda p: F.when(p["place"].isNull(), p["literal"]).otherwise(F.concat(p["literal"], filled(p))))
    return F.aggregate(parts, F.lit(""), lambda done, p: F.concat(done, p))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def excerpt(c: Column, limit: int = 500) -> Column:
    """White space collapsed, trimmed and cut; null is empty."""
    return F.substring(collapse(F.coalesce(c, F.lit(""))), 1, limit)


def escape_html(c: Column) -> Column:
    # Characters and their entities.
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_public(c: Column) -> Column:
    """HTML-safe text whose @ signs mention nobody."""
    # Characters and their entities; a joiner follows each @.
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("@", "@\u200b")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column) -> Column:
    """Text in which no character has a meaning in Markdown, and none mentions or links."""
    # The characters that get a backslash.
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"([`*_\[\]<>#@|])", r"\\$1")


def table_cell(c: Column) -> Column:
    """Text for a Markdown table cell; null and empty show as a dash."""
    safe = F.regexp_replace(F.replace(escape_public(c), F.lit("|"), F.lit("&#124;")), "\r?\n", "<br>")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(safe)


def base64url(c: Column) -> Column:
    return F.translate(F.rtrim(F.base64(F.encode(c, "utf-8")), F.lit("=")), "+/", "-_")


def unsafe_flags(c: Column) -> dict[str, Column]:
    """One boolean for each kind of unsafe public text.

    A pattern is only tried on texts with the characters that every match needs.
    """
    digits = F.length(c) - F.length(F.translate(c, "0123456789", ""))
    needs = {
        "email": c.contains("@"),
        "phone": digits >= 7,
        "raw_html": c.contains("<"),
        "markdown_image": c.contains("!["),
        "unsafe_url": c.contains(":"),
    }
    return {name: F.coalesce(needs.get(name, F.lit(True)) & c.rlike(pattern), F.lit(False)) for name, pattern in UNSAFE.items()}


def _nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


def normalise_email(c: Column) -> Column:
    """Compatibility-normalised, trimmed, lower-cased address; null if it is none."""
    nfkc = F.pandas_udf(_nfkc, "string")
    mail = F.lower(trim(nfkc(F.coalesce(c, F.lit("")))))
    return F.when(F.length(mail).between(5, 160) & mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), mail)


def json_keys(text: str | None) -> list[str] | None:
    """All object keys of a JSON text at any depth, letters and digits only, in lower case; null if it is no JSON."""
    try:
        todo, found = [json.loads(text)], set()
    except (TypeError, ValueError):
        return None
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            found |= {re.sub("[^A-Za-z0-9]", "", k).lower() for k in x}
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


def _json_keys(texts: pd.Series) -> pd.Series:
    return texts.map(json_keys)


def has_forbidden_key(c: Column, forbidden: tuple[str, ...], parts: tuple[str, ...] = ()) -> Column:
    """Whether a JSON text has a forbidden key, or a key with a forbidden part, at any depth; null if it is no JSON."""
    keys = F.pandas_udf(_json_keys, "array<string>")(c)
    inside = F.exists(keys, lambda k: F.lit(False) if not parts else k.rlike("|".join(map(re.escape, parts))))
    return F.arrays_overlap(keys, F.array(*[F.lit(k) for k in forbidden])) | inside


def iso_utc(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601 UTC with milliseconds (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_millis(c: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 UTC text; null in any other form."""
    return F.when(c.rlike(ISO_UTC), F.unix_millis(F.try_to_timestamp(c)))


def unique_list(items: Column, pattern: str, most: int) -> Column:
    """The different trimmed items in the order of their first use; null if there are more than `most` or one does not match.

    A null list is empty.
    """
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: trim(F.coalesce(x, F.lit(""))))
    return F.when((F.size(trimmed) <= most) & F.forall(trimmed, lambda x: x.rlike(pattern)), F.array_distinct(trimmed))


def _pretty(texts: pd.Series) -> pd.Series:
    from attestia.functions.hashing import json_text, json_value

    def one(text):
        try:
            return json_text(json_value(text), indent="  ") + "\n"
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def pretty_json(c: Column) -> Column:
    """A JSON text with an indent of two spaces and a line end, its keys in their order and its numbers in their
    shortest form; null if it is no JSON."""
    return F.pandas_udf(_pretty, "string")(c)
