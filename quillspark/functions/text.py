"""Text expressions: tokens, sentences, snippets and heading forms, all built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, stopwords and abbreviations decide which results are right.
TOKEN = r"[A-Za-z]{2,}-\d+|[A-Za-z]{2,}\d+[A-Za-z0-9]*|\d+(?:\.\d+)?|[A-Za-z]+"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with", "this",
    "but", "they", "have", "had", "what", "when", "where", "who", "which", "or", "not", "can", "all", "been", "into", "than", "then", "there", "their", "them", "these", "those",
    "we", "you", "your", "our", "if", "so", "do", "does", "did", "about", "over", "under", "between", "through", "during", "before", "after", "above", "below", "up", "down", "out",
    "off", "again", "further", "once",
)
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "al.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Fig.", "No.", "Vol.", "approx.", "dept.", "Inc.", "Ltd.", "U.S.", "U.K.")
SNIPPET_CHARS = 700


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def is_stopword(token: Column) -> Column:
    return token.isin(list(STOPWORDS))


def search_terms(text: Column) -> Column:
    """Tokens without stopwords, repeats kept; all tokens if nothing is left."""
    every = tokens(text)
    some = F.filter(every, lambda t: ~is_stopword(t))
    return F.when(F.size(some) > 0, some).otherwise(every)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences in order: lines end them, and so does white space after . ! or ? but for the abbreviations."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")

    def cut(line: Column) -> Column:
        held = reduce(lambda x, a: F.replace(x, F.lit(a), F.lit(a.replace(".", "\x02"))), ABBREVIATIONS, F.regexp_replace(line, r"^\s+|\s+$", ""))
        parts = F.split(F.regexp_replace(held, r"([.!?])\s+", "$1\x01"), "\x01")
        return F.transform(parts, lambda s: squeeze(F.replace(s, F.lit("\x02"), F.lit("."))))

    return F.filter(F.flatten(F.transform(lines, cut)), lambda s: s != "")


def singular(term: Column) -> Column:
    t, n = F.lower(term), F.length(term)
    ends = lambda s: t.endswith(s)
    short = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(n <= 2, t)
        .when(ends("ies") & (n > 4), F.concat(short(3), F.lit("y")))
        .when((ends("ches") | ends("shes")) & (n > 5), short(2))
        .when((ends("xes") | ends("ses")) & (n > 4), short(2))
        .when(ends("s") & ~ends("ss"), short(1))
        .otherwise(t)
    )


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(F.substring(s, 1, 48))


def confidence(score: Column, matched: Column) -> Column:
    return F.when((score >= 3) & (matched >= 2), "HIGH").when((score >= 1) | (matched >= 2), "MEDIUM").otherwise("LOW")


def citation(name: Column, start: Column, end: Column, title: Column) -> Column:
    lines = F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat_ws(" | ", name, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("section: "), title)), lines)


def snippet(text: Column, terms: Column) -> Column:
    """The whole text, or a window around the first matched term."""
    n, w = F.length(text), SNIPPET_CHARS
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), F.lower(t)) - 1), lambda p: p >= 0)
    at = F.coalesce(F.array_min(places), F.lit(0))
    start = F.greatest(F.lit(0), at - w // 2)
    start = F.when(F.least(n, start + w) - start < w, F.greatest(F.lit(0), n - w)).otherwise(start)
    part = F.substring(text, start + 1, F.lit(w))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(start + w < n, "...").otherwise(""))
    return F.when(n <= w, text).otherwise(cut)
