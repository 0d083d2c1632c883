"""Phrases cut from sentences, cleaned for display."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.headings import let, strip

# Words kept in capitals.
ACRONYMS = ("QA", "RDF", "OWL", "SPARQL", "BM25", "LLM", "AI")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[.,;:!?]+|[.,;:!?]+$", "")


def _display(word: Column, i: Column) -> Column:
    bare = _bare(word)
    head = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1_000_000))
    shout = (F.length(bare) >= 2) & bare.rlike(r"\p{Lu}") & ~bare.rlike(r"[\p{Ll}\p{Lt}]")
    return F.when(F.upper(bare).isin(list(ACRONYMS)), F.upper(bare)).when(shout, bare).when(i == 0, head).when(bare.rlike(r"^\p{Ll}"), F.lower(bare)).otherwise(bare)


def _clean(phrase: Column, word: Callable[..., Column]) -> Column:
    x = strip(F.regexp_replace(strip(phrase), r"(?i)^(?:the|a|an) ", ""))
    x = F.regexp_replace(x, r"(?is)\s+(?:which|that|where|with)\b.*$", "")
    x = reduce(lambda y, sep: F.substring_index(y, sep, 1), (":", ";", ","), x)
    x = F.regexp_replace(x, r"""^[ \t\n\r.,;:!?"'()\[\]]+|[ \t\n\r.,;:!?"'()\[\]]+$""", "")
    return let(F.trim(F.regexp_replace(x, r"\s+", " ")), lambda y: F.array_join(F.transform(F.split(y, " "), word), " "))


def clean(phrase: Column) -> Column:
    """Without its article, relative clause, what follows : ; or , and outer punctuation; first word capital, acronyms kept."""
    return _clean(phrase, _display)


def bare(phrase: Column) -> Column:
    """As clean, but in the case it has."""
    return _clean(phrase, _bare)


def valid_endpoint(value: Column, sentence: Column) -> Column:
    """3 to 80 characters, no link, found in the sentence."""
    return F.length(value).between(3, 80) & ~value.rlike(r"(?i)https?://|www\.") & F.lower(sentence).contains(F.lower(value))


def trim_span(raw: Column) -> Column:
    """Cuts an entity at a clause word, an example or a separator."""
    x = F.regexp_replace(strip(raw), r"(?is)\s+(?:which|that|where|with|when|because|while|although|this|for|and\s+the)\b.*$", "")
    x = F.regexp_replace(x, r"(?is)(?:\s+for example\b|\s+such as\b|\s+including\b|[:;,.]).*$", "")
    return F.regexp_replace(x, r"""^[ \t\n\r.,;:!?"'()\[\]]+|[ \t\n\r.,;:!?"'()\[\]]+$""", "")


def valid_entity(value: Column) -> Column:
    """3 to 80 characters, a letter among them."""
    return F.length(value).between(3, 80) & value.rlike(r"\p{L}")


def valid_phrase(value: Column) -> Column:
    """A valid entity without link or citation, with at most one comma or semicolon and at most two fifths digits."""
    n = lambda p: F.regexp_count(value, F.lit(p))
    return valid_entity(value) & ~value.rlike(r"(?i)https?://|www\.|://|^http|\[\d+\]|\(\d{4}\)|et al\.") & (n("[,;]") < 2) & (n("[0-9]") <= F.length(value) * 0.4)


def capitalised(sentence: Column) -> Column:
    """Runs of up to six capitalised words, cleaned, 3 to 60 characters; the first spelling of each."""
    found = F.regexp_extract_all(sentence, F.lit(r"\b([A-Z][A-Za-z0-9]*(?:\s+(?:and\s+)?[A-Z][A-Za-z0-9]*){0,5})\b"), F.lit(1))
    some = F.filter(F.transform(found, clean), lambda x: F.length(x).between(3, 60) & F.lower(sentence).contains(F.lower(x)))
    return first_spellings(some)


def first_spellings(values: Column) -> Column:
    """Of values that differ in case only, the first."""
    return let(F.transform(values, F.lower), lambda low: F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
