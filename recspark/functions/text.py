"""Text column functions: review snippets and word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scores import safe_double


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(x: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_text(x, max_len: int) -> Column:
    """Collapse white space, trim, keep the first ``max_len`` characters.

    Those come from the first ``max_len`` characters that are not white space and what lies between
    them, so the rest of a long text is not looked at.
    """
    head = F.regexp_extract(F.coalesce(_c(x), F.lit("")), rf"^(?:\s*+\S){{0,{max_len}}}+", 0)
    flat = F.trim(F.regexp_replace(head, r"\s+", " "))
    return F.substring(flat, 1, max_len)


def rating_phrase(x) -> Column:
    v = safe_double(x)
    near_whole = F.abs(v - F.round(v)) < 1e-6
    tenth = F.bround(v.cast("decimal(12,6)"), 1).cast("decimal(12,1)").cast("string")
    number = F.when(near_whole, F.round(v).cast("int").cast("string")).otherwise(tenth)
    return F.when(
        v.isNotNull() & ~F.isnan(v) & v.between(1, 5), F.concat(number, F.lit(" star rating"))
    ).otherwise(F.lit(""))


def verified_phrase(x) -> Column:
    low = F.lower(_strip(_c(x).cast("string")))
    return (
        F.when(low.isin("true", "1", "yes", "y"), F.lit("verified purchase"))
        .when(low.isin("false", "0", "no", "n"), F.lit("unverified review"))
        .otherwise(F.lit(""))
    )


def style_phrase(x) -> Column:
    """Key/value pairs of a map in key order: colon dropped from keys, blank values skipped."""
    entries = F.array_sort(F.map_entries(_c(x)))

    def phrase(e: Column) -> Column:
        key = _strip(F.regexp_replace(_strip(e["key"]), r":+$", ""))
        value = F.trim(F.regexp_replace(e["value"], r"\s+", " "))
        return F.when(value != "", F.trim(F.concat(key, F.lit(" "), value)))

    phrases = F.filter(F.transform(entries, phrase), lambda p: p.isNotNull())
    return F.coalesce(F.array_join(phrases, " "), F.lit(""))


def _joined(*parts: Column) -> Column:
    """Non-empty parts joined by blanks (each part is evaluated once)."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def review_snippet(
    rating="rating",
    verified="verified",
    style="style",
    summary="summary",
    body="reviewText",
    max_meta_len: int = 120,
    max_summary_len: int = 200,
    max_body_len: int = 400,
) -> Column:
    """One line of text per review: metadata phrases, summary, body. Empty when nothing is usable."""
    meta = _joined(rating_phrase(rating), verified_phrase(verified), style_phrase(style))
    return F.trim(
        _joined(
            clean_text(meta, max_meta_len),
            clean_text(summary, max_summary_len),
            clean_text(body, max_body_len),
        )
    )


def word_tokens(x, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two or more letters, digits or underscores, stop words removed."""
    words = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(stop_words))


def with_bigrams(words) -> Column:
    """Words followed by their adjacent pairs."""
    words = _c(words)
    n = F.size(words)
    firsts = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    seconds = F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, F.concat(words, pairs)).otherwise(words)
