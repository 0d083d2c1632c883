"""Headings: their normal form, the category they name, and how likely a line of a page is one by its layout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import singular

# Suffixes without meaning, headings without a category, phrases with theirs (the first found counts), heading starts.
WEAK_SUFFIXES = ("for implementation", "for production", "overview", "details", "considerations", "examples", "notes", "summary", "introduction", "background")
WEAK_HEADINGS = ("overview", "details", "summary", "introduction", "background", "notes", "examples", "appendix")
PHRASES = (
    ("open source building blocks", "building_block"), ("open-source building blocks", "building_block"), ("existing architectures", "architecture"),
    ("design patterns", "design_pattern"), ("design pattern", "design_pattern"), ("building blocks", "building_block"), ("building block", "building_block"),
    ("knowledge graph", "knowledge_graph"), ("common capabilities", "capability"), ("future improvements", "improvement"), ("evaluation checklist", "evaluation"),
    ("architectures", "architecture"), ("architecture", "architecture"), ("capabilities", "capability"), ("capability", "capability"),
    ("requirements", "requirement"), ("requirement", "requirement"), ("limitations", "limitation"), ("limitation", "limitation"),
    ("improvements", "improvement"), ("improvement", "improvement"), ("technologies", "technology"), ("technology", "technology"),
    ("principles", "principle"), ("principle", "principle"), ("workflows", "workflow"), ("workflow", "workflow"), ("patterns", "pattern"), ("pattern", "pattern"),
    ("components", "component"), ("component", "component"), ("phases", "phase"), ("phase", "phase"), ("evaluation", "evaluation"), ("conclusion", "conclusion"),
)
STARTS = (
    "existing", "design", "design patterns", "design pattern", "overview", "architecture", "architectures", "open-source", "open source", "common", "future", "requirements",
    "capabilities", "limitations", "conclusion", "ways", "what", "how", "why", "introduction", "background", "summary",
)
LEAST_CONFIDENCE, LEAST_LAYOUT_SCORE, SEMANTIC_CONFIDENCE = 0.65, 5.0, 0.85


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain(title: Column) -> Column:
    """Lower case, punctuation and weak suffixes gone."""
    words = F.regexp_replace(F.replace(F.lower(strip(title)), F.lit("-"), F.lit(" ")), r"[^\p{L}\p{N}_\s]", " ")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    return reduce(lambda x, s: F.regexp_replace(x, rf"\s*{s}$", ""), WEAK_SUFFIXES, words)


def _phrases() -> Column:
    return F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category")) for p, c in PHRASES])


def _of(heading: Column) -> Column:
    """The category of a heading in normal form."""
    design = heading.contains("design")
    direct = F.try_element_at(F.filter(_phrases(), lambda p: heading.contains(p["phrase"]) & ~((p["category"] == "pattern") & design)), F.lit(1))["category"]
    words = F.transform(F.split(heading, " "), singular)
    later = let(F.array_join(words, " "), lambda j: F.try_element_at(F.filter(_phrases(), lambda p: j.contains(p["phrase"])), F.lit(1))["category"])
    alone = F.when((F.size(words) == 1) & ~words[0].isin(list(WEAK_HEADINGS)), words[0])
    found = F.coalesce(F.when(heading.contains("design pattern"), "design_pattern"), direct, later, alone)
    return F.when((heading != "") & ~heading.isin(list(WEAK_HEADINGS)), found)


def category(title: Column) -> Column:
    """The category that a heading or question names, null if none."""
    return let(plain(title), _of)


def category_name(title: Column) -> Column:
    """The category, or the heading's singular words joined by underscores, or general."""
    words = lambda h: F.when(h != "", F.array_join(F.transform(F.split(h, " "), singular), "_"))
    return let(plain(title), lambda h: F.coalesce(_of(h), words(h), F.lit("general")))


def category_confidence(title: Column, name: Column) -> Column:
    """How surely a heading means a category: the first phrase of the category that is in it decides."""

    def score(h: Column) -> Column:
        rate = lambda p: F.when(h == p, 0.95).when(h.startswith(F.concat(p, F.lit(" "))), 0.9).otherwise(0.85)
        first = F.try_element_at(F.filter(_phrases(), lambda p: (p["category"] == name) & h.contains(p["phrase"])), F.lit(1))
        weak = (h == "") | h.isin(list(WEAK_HEADINGS))
        return F.when(weak, 0.2).when(first.isNotNull(), rate(first["phrase"])).when(_of(h) == name, 0.75).otherwise(0.4)

    return let(plain(title), score)


def _blank(line: Column) -> Column:
    return F.coalesce(strip(line), F.lit("")) == ""


def _words(s: Column) -> Column:
    return F.split(s, r"\s+")


def title_cased(s: Column) -> Column:
    """At most twelve words of which three in five, one at least, start with a capital."""
    capital = F.size(F.filter(_words(s), lambda w: w.rlike(r"^\p{Lu}")))
    return (s != "") & (F.size(_words(s)) <= 12) & (capital >= F.greatest(F.lit(1), F.floor(F.size(_words(s)) * 0.6).cast("int")))


def known_start(s: Column) -> Column:
    return F.lower(s).rlike("^(?:" + "|".join(STARTS) + ")")


def _long_next(after: Column) -> Column:
    return (F.length(strip(after)) > 40) & ~strip(after).endswith(":")


def layout_score(line: Column, before: Column, after: Column) -> Column:
    """Evidence for a heading less evidence against it; 0 for a blank line."""
    link, count = r"(?i)https?://|www\.", lambda s, p: F.regexp_count(s, F.lit(p))

    def score(s: Column) -> Column:
        n, letters = F.length(s), count(s, r"\p{L}")
        signs = [
            (1.0, n <= 80), (2.0, title_cased(s)), (1.0, ~s.rlike(r"[.!?]$")), (1.0, _blank(before)), (1.0, _blank(after)),
            (1.0, (letters > 0) & (count(s, r"\p{Lu}") / F.greatest(letters, F.lit(1)) >= 0.35)), (2.0, known_start(s)), (0.5, ~s.rlike(link)),
            (0.5, count(s, "[0-9]") <= F.greatest(F.lit(2), F.floor(n / 8))), (2.0, F.coalesce(_long_next(after), F.lit(False))),
            (-3.0, s.endswith(".")), (-2.0, s.rlike(link)), (-2.0, s.rlike(r"(?i)\[\d+\]|\(\d{4}\)|et al\.")), (-5.0, n > 120),
            (-2.0, s.rlike(r"\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Lt}]")), (-3.0, s.rlike(r"^[\-*•]\s+")), (-2.0, count(s, "[,;]") >= 2), (-2.0, F.size(_words(s)) > 14),
            (-1.0, s.rlike(r"^\d+[.)]\s+") & ~known_start(s)),
        ]
        return F.when(s == "", 0.0).otherwise(reduce(lambda a, b: a + b, [F.when(test, w).otherwise(0.0) for w, test in signs]))

    return let(F.coalesce(strip(line), F.lit("")), score)


def is_layout_heading(line: Column, before: Column, after: Column) -> Column:
    """A line on its own that looks like a title and scores enough."""
    alone = _blank(before) & (_blank(after) | F.coalesce(_long_next(after), F.lit(False)))
    looks = lambda s: (s != "") & ~s.rlike(r"[.!?]$") & (F.size(_words(s)) <= 12) & (title_cased(s) | known_start(s))
    return alone & let(F.coalesce(strip(line), F.lit("")), looks) & (layout_score(line, before, after) >= LEAST_LAYOUT_SCORE)


def is_category_heading(line: Column, before: Column, after: Column) -> Column:
    """A short line under a blank and over text that surely names a category."""
    s = strip(line)
    form = (F.length(s) <= 120) & ~s.rlike(r"[.!?]$") & ~F.lower(s).contains(" is ") & _blank(before) & ~_blank(after)
    return F.coalesce(form & (category_confidence(s, category(s)) >= SEMANTIC_CONFIDENCE), F.lit(False))
