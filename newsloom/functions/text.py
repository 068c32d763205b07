"""Text for display and for matching."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that texts mix, and the ones they fold to; digits of two scripts; marks that vanish.
_FOLD_FROM = "يىئكةأإآؤ"
_FOLD_TO = "یییکهاااو"
_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_VANISH = "ـ‌"
_DIACRITICS = "[ً-ْٰۖ-ۭ]"
_WORD = "(?U)[^\\w؀-ۿ]+"


def cleaned(text) -> str:
    return " ".join(unicodedata.normalize("NFC", html.unescape(str(text or ""))).replace(" ", " ").split())


@F.pandas_udf(StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else cleaned(t))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def clean(text: Column) -> Column:
    """Safe to show; entities unescaped, composed, white space collapsed. Only text with an entity or beyond ASCII reaches Python."""
    odd = text.rlike("&|\\P{ASCII}")
    return F.coalesce(_clean(F.when(odd, text)), squeeze(text), F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def fold(text: Column, compose: bool = True) -> Column:
    """For matching only. Text beyond ASCII is brought to NFC, in Python; the rest stays in the JVM. Text that is known to
    be composed may go without."""
    t = F.coalesce(text, F.lit(""))
    if compose:
        t = F.coalesce(_nfc(F.when(t.rlike("\\P{ASCII}"), t)), t)
    t = F.regexp_replace(t, _DIACRITICS, "")
    t = F.translate(t, _FOLD_FROM + _DIGITS + " " + _VANISH, _FOLD_TO + "0123456789" * 2 + " ")
    return squeeze(F.lower(t))


def title_key(title: Column, compose: bool = True) -> Column:
    """Folded, punctuation gone."""
    return squeeze(F.regexp_replace(fold(title, compose), _WORD, " "))


def trigrams(title: Column, compose: bool = True) -> Column:
    """The set of windows of three characters of the key without spaces; a shorter key is its own."""
    key = F.replace(title_key(title, compose), F.lit(" "), F.lit(""))
    letters = F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0))
    n = F.length(key)
    from_ = lambda k: F.slice(letters, F.lit(k), F.greatest(n - 2, F.lit(0)))
    windows = F.zip_with(F.zip_with(from_(1), from_(2), lambda x, y: F.concat(x, y)), from_(3), lambda x, y: F.concat(x, y))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(key)).otherwise(F.array_distinct(windows))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all, 0 if either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / (F.size(left) + F.size(right) - shared))


def content_hash(title: Column, lead: Column, content: Column, compose: bool = True) -> Column:
    """Identity of a story whatever its encoding."""
    raw = F.concat_ws("|", fold(title, compose), fold(lead, compose), F.substring(fold(content, compose), 1, 1500))
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 32)


def embedding_text(title: Column, lead: Column) -> Column:
    """T07."""
    return F.substring(F.trim(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(lead, F.lit("")))), 1, 2000)


def evidence_digest(title: Column, lead: Column, content: Column) -> Column:
    """T10."""
    return F.sha2(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(lead, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 5000)).cast("binary"), 256)


def keywords(text: Column, most: int = 12) -> Column:
    """Split at commas, trimmed, 64 characters each, distinct in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.substring(F.trim(x), 1, 64))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def phone(raw: Column) -> Column:
    """A mobile number as +98 and ten digits, however it was typed: with 0, 98, +98 or 0098 before it or nothing, with
    spaces, dashes and brackets, in other digits; null for what is none."""
    bare = F.regexp_replace(F.translate(F.coalesce(raw, F.lit("")), _DIGITS, "0123456789" * 2), "(?U)[\\s\\-()]", "")
    number = F.regexp_extract(bare, "^(?:\\+98|0098|98|0)?(9[0-9]{9})$", 1)
    return F.when(number != "", F.concat(F.lit("+98"), number))
