"""Text expressions: normalising, trigrams, Jaccard, words, preparation for embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A window that is not blank, then one character further: one pass over the text, where a substring by its position counts characters from the start each time.
_WINDOW = rf"(?s)(?=(...))(?![{_BLANK}]{{3}})."


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas in ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(_BLANK))


def normalize(c: Column) -> Column:
    return strip(F.lower(c))


def searchable(title: Column, summary: Column, tags: Column, chars: int = 800) -> Column:
    """What is indexed of a memory; content is not."""
    labels = F.when(F.size(tags) > 0, F.concat(F.lit(" "), F.array_join(tags, " "))).otherwise("")
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")), labels)
    return F.left(normalize(text), F.lit(chars))


def trigrams(c: Column) -> Column:
    """Distinct three-character windows of the padded, normalised text; blank text has none."""
    s = F.concat(F.lit("  "), normalize(F.coalesce(c, F.lit(""))), F.lit("  "))
    return F.array_distinct(F.regexp_extract_all(s, F.lit(_WINDOW), 1))


def inner_trigrams(c: Column) -> Column:
    """The trigrams without padding: a text that contains ``c`` has them all. None for fewer than three characters."""
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(grams), lambda g: F.btrim(g, F.lit(_BLANK)) != ""))


def jaccard_of(both: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity by the size of the intersection and of both sets, in single precision; 0 if one is empty."""
    share = (both.cast("double") / (a + b - both)).cast("float").cast("double")
    return F.when((a > 0) & (b > 0), share).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats, in single precision; 0 if one is empty."""
    return jaccard_of(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def is_similar(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return jaccard(trigrams(a), trigrams(b)) >= threshold


def words(q: Column, least: int) -> Column:
    """What spaces separate, of at least so many characters; repeats stay."""
    return F.filter(F.split(q, " "), lambda w: F.length(w) >= least)


def share_contained(ws: Column, text: Column) -> Column:
    """The share of the words that the text contains; 0 without words."""
    n = F.size(ws)
    return F.when(n > 0, F.size(F.filter(ws, lambda w: F.contains(text, w))) / n).otherwise(0.0)


def embedding_text(c: Column, chars: int = 1024) -> Column:
    """Text as it goes into an embedding model.

    No pattern but that of spaces reaches across a space, so what comes before
    one is prepared alone: where it has all characters that are kept, the rest
    of the text is not read.
    """
    c = F.coalesce(c, F.lit(""))
    begin = F.regexp_extract(F.left(c, F.lit(2 * chars)), r"(?s)^(.*)[ \t\n\r]", 1)
    from_begin = bound(_prepared(begin, chars), lambda b: F.when(F.length(b) == chars, b).otherwise(_prepared(c, chars)))
    return F.when(F.length(c) <= 2 * chars, _prepared(c, chars)).otherwise(from_begin)


def _prepared(c: Column, chars: int) -> Column:
    for pattern, to in (
        (r"[^\x20-\x7E\t\n\r]", ""),
        (r"(?i)https?://[^\s]+|www\.[^\s]+", " [URL] "),
        # begins where a run of its characters does, so that a long word is not tried from each of its letters
        (r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", " [EMAIL] "),
        (r"([!?.,;:])\1+", "$1"),
        (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.left(strip(c), F.lit(chars))


def without_orphans(text: str) -> str:
    """Python strings without unpaired surrogates; pairs become their character. (Spark strings cannot hold any.)"""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
