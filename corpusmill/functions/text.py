"""Scalar text functions: Column in, Column out, inside the JVM but for split_by."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: letters and digits as the curation patterns see them (a character class body).
TR_WORD = "0-9A-Za-zğüşöçıİĞÜŞÖÇ"
UNICODE_WORD = r"\p{L}\p{N}"

# These patterns decide what counts as money, a period, a date, a number.
MONEY = r"(?iuU)(?:₺|\btl\b|\btry\b|\busd\b|\beur\b|\bgbp\b|%|\byüzde\b|\bmilyon\b|\bmilyar\b|\bbin\b)"
PERIOD = r"(?iuU)\b(çeyrek|ceyrek|q[1-4]|yıllık|yillik|aylık|aylik|yoy|qoq)\b"
TEMPLATE_STEPS = (
    ("<DATE>", r"(?U)\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4})\b"),
    ("<QTR>", r"(?iuU)\b(q[1-4]|[1-4]\.?\s*çeyrek|çeyrek|ceyrek|yoy|qoq)\b"),
    ("<PCT>", r"(?iuU)(%|\byüzde\b)"),
    ("<CUR>", r"(?iuU)(₺|\btl\b|\btry\b|\busd\b|\beur\b|\bgbp\b|\bdolar\b|\beuro\b)"),
    ("<NUM>", r"(?U)\b\d+(?:[.,]\d+)?\b"),
)
# Letters that preprocessing knows, small and great ones, and bounds of a cleaned sentence.
LETTERS, SMALL, GREAT = "a-zA-ZçğıöşüÇĞİÖŞÜ", "a-zçğıöşü", "A-ZÇĞİÖŞÜ"
SENTENCE_MIN, SENTENCE_MAX = 15, 512


def collapse(x: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def casefold(x: Column) -> Column:
    """Lower case with ß as ss and final sigma as sigma, as full case folding has it."""
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def norm_text(x: Column) -> Column:
    return collapse(casefold(x))


def md5_norm(x: Column) -> Column:
    return F.md5(norm_text(x))


def preprocess(x: Column) -> Column:
    """Cleaning before pretraining: digits part from letters, white space collapses, invisible
    characters go, dashes and dots are unified, glued sentences are parted."""
    y = F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?U)(\d+)([{LETTERS}])", "$1 $2")
    y = F.regexp_replace(y, r"(?U)\s+", " ")
    y = F.translate(y, "\u00a0\u2013\u2014\u200b\ufeff", " --")
    y = F.replace(y, F.lit("…"), F.lit("..."))
    y = F.regexp_replace(y, f"([{SMALL}])([{GREAT}][{SMALL}])", "$1. $2")
    return F.trim(y)


def split_sentences(x: Column) -> Column:
    """Sentences of more than 2 characters; line breaks are plain white space."""
    parts = F.split(collapse(x), r"(?<=[.!?…])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def clean_sentences(sentences: Column, low: int = SENTENCE_MIN, high: int = SENTENCE_MAX) -> Column:
    """Sentences of proper length with a letter and two words, closed by a full stop if bare."""
    def fit(s: Column) -> Column:
        return F.length(s).between(low, high) & s.rlike(r"\p{L}") & (F.size(F.split(s, r"(?U)\s+")) >= 2)

    def closed(s: Column) -> Column:
        return F.when(s.rlike(r"[\p{L}\p{N}]$"), F.concat(s, F.lit("."))).otherwise(s)

    return F.transform(F.filter(F.transform(sentences, lambda s: F.trim(s)), fit), closed)


def has_money(x: Column) -> Column:
    return x.rlike(MONEY)


def has_period(x: Column) -> Column:
    return x.rlike(PERIOD)


def is_boilerplate(x: Column, substrings: Sequence[str]) -> Column:
    """Whether the normalised sentence holds any of the (case-folded) substrings."""
    out = F.lit(False)
    for s in substrings:
        out = out | F.contains(norm_text(x), F.lit(s))
    return out


def template(x: Column) -> Column:
    """Dates, quarters, percentages, currencies and numbers give way to marks, in this order."""
    y = casefold(x)
    for mark, pattern in TEMPLATE_STEPS:
        y = F.regexp_replace(y, pattern, f" {mark} ")
    return collapse(y)


def bucket(fin: Column, comp: Column, up: Column, down: Column, legal: Column, modal: Column, rating: Column, num: Column) -> Column:
    """The first bucket, by priority, whose flags are set."""
    return (
        F.when(legal, "legal_reg")
        .when(rating, "rating_action")
        .when(up & ~down, "finance_up")
        .when(down & ~up, "finance_down")
        .when(up & down, "finance_updown")
        .when(modal, "guidance_modal")
        .when(num, "numeric_finance")
        .when(fin | comp, "finance_other")
        .otherwise("other")
    )


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def four_places(x: Column) -> Column:
    return F.format_string("%.4f", x)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "-"), r"^-+|-+$", "")


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def thousands(x: Column) -> Column:
    """An integer with dots between thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def decimal_comma(x: Column, places: int) -> Column:
    return F.translate(F.format_string(f"%.{places}f", x), ".", ",")


def seeded(seed: str, *keys: Column) -> Column:
    """A rank that depends on the seed and the keys only: the order of every sample."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def translated(x: Column, names: dict[str, str]) -> Column:
    """The name of x, or x itself."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(x == k, v).otherwise(out)
    return F.coalesce(out, x)


def split_by(splitter: Callable[[list[str]], list[list[str]]]) -> Callable[[Column], Column]:
    """A sentence splitter for a curation job out of a Python one, which takes a batch of texts
    (and must be picklable); a batch that it fails on is split by split_sentences."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if some.any():
            try:
                out[some] = pd.Series([list(x) for x in splitter(texts[some].tolist())], index=texts.index[some], dtype=object)
            except Exception:  # noqa: BLE001  a splitter that fails is replaced
                pass
        return out

    return lambda x: F.coalesce(run(x), split_sentences(x))
