"""Text expressions: trimming, slugs, lists in text, code fences, path parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as whitespace at the ends of a text. ASCII blanks, the information
# separators, NEL, and every Unicode space or line separator.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = "```"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (SQL ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def slugify(c: Column, keep_hyphen: bool = False, fallback: str | None = "product") -> Column:
    """Lower-case, turn every run of other characters into one hyphen, trim hyphens.

    ``keep_hyphen`` keeps the hyphens of the input as they are. ``fallback`` replaces an empty slug.
    """
    runs = r"[^a-z0-9-]+" if keep_hyphen else r"[^a-z0-9]+"
    slug = F.btrim(F.regexp_replace(F.lower(c), runs, "-"), F.lit("-"))
    return slug if fallback is None else F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def split_list(c: Column, separator: str = ",") -> Column:
    """Split separated text into trimmed, non-empty items; order and repeats are kept."""
    items = F.transform(F.split(c, f"\\Q{separator}\\E"), strip_ws)
    return F.filter(items, lambda item: item != "")


def strip_json_fence(c: Column) -> Column:
    """Body of the first code fence (optionally tagged json), else the trimmed text.

    The body is what lies between the first two fence marks, so cutting at the marks is enough and
    a text with fewer than two is returned as it is.
    """
    parts = F.split(c, FENCE, 3)
    body = F.regexp_replace(F.get(parts, F.lit(1)), r"\Ajson", "")
    return strip_ws(F.when(F.size(parts) == 3, body).otherwise(c))


# Letters that share their other case with a second letter, and that letter.
TWINS = {
    "ſ": "s", "ı": "i", "ς": "σ", "µ": "μ", "ϐ": "β", "ϑ": "θ",
    "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "ṡ",
}


def lower_case(c: Column) -> Column:
    """Text in lower case, one letter for one letter."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def fold_case(c: Column) -> Column:
    """Text in which two letters are equal when they differ in case only, one letter for one letter.

    Plain replacements: each is one fast byte search, and a text seldom holds any of these letters.
    """
    folded = lower_case(c)
    for twin, main in TWINS.items():
        folded = F.replace(folded, F.lit(twin), F.lit(main))
    return folded


def folded_text(text: str) -> str:
    """``fold_case`` of a constant."""
    folded = text.replace("İ", "i").lower()
    for twin, main in TWINS.items():
        folded = folded.replace(twin, main)
    return folded


def truthy(c: Column) -> Column:
    """NULL for NULL or empty text, else the text."""
    return F.nullif(c, F.lit(""))


def file_name(c: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(c, "/"), -1)


def file_stem(c: Column) -> Column:
    """Last component of a path without its last suffix."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def parent_name(c: Column) -> Column:
    """Name of the directory that holds a path."""
    return F.element_at(F.split(c, "/"), -2)
