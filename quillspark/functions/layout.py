"""Repair of text whose line ends were lost: headings found inside paragraphs get lines of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings that are looked for, and words that begin the sentence after one.
KNOWN = (
    "Ways to make systems feel intelligent without AI", "What this kind of system really is", "Requirements for evidence quality", "Open-source building blocks", "Existing architectures",
    "Architecture comparison", "Evaluation checklist", "Common capabilities", "Future improvements", "Open source building blocks", "Limitations", "Conclusion", "Introduction", "Overview",
    "Background", "Summary", "Capabilities", "Requirements", "Architectures",
)
FOLLOWING = (
    "The", "A", "An", "For", "In", "When", "This", "These", "If", "Teams", "Users", "It", "Every", "Each", "Better", "Reviewers", "No", "PDF", "Heading", "Lexical", "Multi", "Lineage",
    "Structured", "Section", "Deterministic", "Evidence",
)
PREFIXES = (
    "existing", "architecture", "architectures", "open-source", "open source", "common", "requirements", "conclusion", "future", "capabilities", "limitations", "evaluation", "ways", "what", "how",
    "introduction", "overview", "background",
)


def squeezed_lines(text: Column) -> Column:
    """Blanks and tabs of each line squeezed, its ends stripped."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")), "\n")


def normal_ends(text: Column) -> Column:
    """LF line ends, at most one blank line in a row, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def isolate(text: Column) -> Column:
    """Known headings, longest first, between blank lines where a sentence begins after them."""
    after = r"(?=\s+(?:" + "|".join(FOLLOWING) + r")\b)"
    forms = (r"^({0})" + after, r"(?<=[.!?;:])\s*({0})" + after, r"(?<=[.!?;:])\s*({0})(?=\s+[A-Z])", r"\s+({0})" + after, r"\s+({0})(?=\s+[A-Z])")
    cuts = [form.replace("{0}", phrase) for phrase in sorted(KNOWN, key=len, reverse=True) for form in forms]
    return reduce(lambda x, form: F.regexp_replace(x, form, "\n\n$1\n\n"), cuts, text)


def inline_heading(phrase: Column) -> Column:
    """Whether a phrase may be a heading: 3 to 80 characters, no end mark, no link, title case or a known start."""
    s = F.regexp_replace(phrase, r"^\s+|\s+$", "")
    words = F.split(s, r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    titled = (F.size(words) <= 12) & (capital >= F.greatest(F.lit(1), F.floor(F.size(words) * 0.6).cast("int")))
    return F.length(s).between(3, 80) & ~s.rlike(r"[.!?,;:]$") & ~s.rlike(r"(?i)https?://|www\.") & (F.regexp_count(s, F.lit("[,;]")) < 2) & s.rlike(r"\p{Lu}") & (titled | F.lower(s).rlike("^(?:" + "|".join(PREFIXES) + ")"))


def repaired(text: Column) -> Column:
    """Text of a page with headings on lines of their own. A blank text stays as it is."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    done = F.regexp_replace(squeezed_lines(F.regexp_replace(isolate(lf), r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", text).otherwise(done)
