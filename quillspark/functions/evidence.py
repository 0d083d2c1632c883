"""What an answer shows of its evidence: highlights, lists found in text, lineage points, spans of requirements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.headings import let, strip
from quillspark.functions.phrases import first_spellings

# Lineage phrases and what they mean, forms of listed items, spans of requirements and definitions.
LINEAGE = (
    ("history and traceability", "History and traceability"), ("provenance", "Provenance"), ("which geometry", "Which geometry was used"),
    ("which dataset", "Which dataset was used"), ("solver version", "Solver version"), ("runtime environment", "Runtime environment"),
)
ITEMS = (r"^\s*\d+[.)]\s+(.+)$", r"^\s*[-*•]\s+(.+)$", r"(?i)^\s*(?:the\s+)?(?:first|second|third|fourth|fifth)\s+.+?\s+is\s+(.+?)[.,;]?\s*$", r"(?i)^\s*a\s+(?:second|third|fourth|fifth)\s+.+?\s+is\s+(.+?)[.,;]?\s*$")
SPANS = r"(?i)\b(?:must|shall)(?:\s+[A-Za-z]+)+|\bis\s+defined\s+as\b"


def unmarked(text: Column) -> Column:
    """Without highlight marks."""
    return F.regexp_replace(text, r"\[\[|\]\]", "")


def highlight(text: Column, terms: Column) -> Column:
    """Terms in [[ ]], longest first, in any case; what is marked already stays as it is."""
    piece = lambda done, s: F.struct(done.alias("done"), s.alias("s"))
    # Every second part of a text split at the two marks lies between them.
    cut = lambda s, marked: F.transform(F.split(marked, "[\x01\x02]"), lambda x, i: piece(i % 2 == 1, x))
    start = F.transform(F.split(F.regexp_replace(text, r"(?s)(\[\[.*?\]\])", "\x01$1\x02"), "[\x01\x02]"), lambda x, i: piece(i % 2 == 1, x))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(terms, lambda t: t != "")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])

    def mark(pieces: Column, term: Column) -> Column:
        form = F.concat(F.lit(r"(?i)\Q"), term, F.lit(r"\E"))
        return F.flatten(F.transform(pieces, lambda p: F.when(p["done"], F.array(p)).otherwise(
            F.transform(F.split(F.regexp_replace(p["s"], form, F.lit("\x01[[$0]]\x02")), "[\x01\x02]"), lambda x, i: piece(i % 2 == 1, x)))))

    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(F.array_join(F.transform(F.aggregate(longest, start, mark), lambda p: p["s"]), ""))


def listed(text: Column) -> Column:
    """Items of numbered, bulleted and ordinal lines, 3 to 180 characters, that the text holds; the first spelling of each."""
    def item(line: Column) -> Column:
        found = F.lit(None).cast("string")
        for form in reversed(ITEMS):
            found = F.when(line.rlike(form), F.regexp_extract(line, form, 1)).otherwise(found)
        x = F.regexp_replace(F.regexp_replace(found, r"^[ \t\-•*.;,]+|[ \t\-•*.;,]+$", ""), r"\s+", " ")
        return F.trim(F.regexp_replace(x, r"(?i)^the ", ""))

    some = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n?|\n"), lambda x: item(strip(x)))
    return first_spellings(F.filter(some, lambda x: F.coalesce(F.length(x).between(3, 180) & F.lower(text).contains(F.lower(x)), F.lit(False))))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def listed_answer(question: Column, items: Column) -> Column:
    """A bulleted list under a line that says how many there are."""
    q = F.lower(question)
    kind = F.when(q.contains("architect"), "architecture-related").when(q.contains("different"), "different").otherwise("enumerated")
    head = F.concat(F.lit("The document describes "), F.size(items).cast("string"), F.lit(" "), kind, F.lit(" items from the retrieved evidence:"))
    return F.when(F.size(items) >= 2, F.concat_ws("\n", head, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))


def lineage_answer(text: Column) -> Column:
    """The points of lineage that the text names, null if none."""
    found = F.array_compact(F.array(*[F.when(F.lower(text).contains(p), label) for p, label in LINEAGE]))
    return F.when(F.size(found) > 0, F.concat(F.lit("The document describes lineage using these extracted points:\n"), numbered(found)))


def category_intro(category: Column, count: Column) -> Column:
    label = F.replace(category, F.lit("_"), F.lit(" "))
    return F.when(count == 1, F.concat(F.lit("The document mentions this "), label, F.lit(":"))).otherwise(F.concat(F.lit("The document mentions these "), label, F.lit("s:")))


def preview(text: Column) -> Column:
    """One line of at most 160 characters."""
    return let(F.trim(F.regexp_replace(unmarked(text), r"\s+", " ")), lambda x: F.when(F.length(x) > 160, F.concat(F.substring(x, 1, 157), F.lit("..."))).otherwise(x))


def supporting(answer: Column, cards: Column) -> Column:
    """The answer and up to four cards (``citation``, ``snippet``) that say something."""
    lines = F.filter(F.transform(F.slice(cards, 1, 4), lambda c, i: F.when(preview(c["snippet"]) != "", F.concat(F.lit("- ("), (i + 1).cast("string"), F.lit(") "), c["citation"], F.lit(": "), preview(c["snippet"])))), lambda x: x.isNotNull())
    return F.when(F.size(cards) > 0, F.array_join(F.concat(F.array(answer, F.lit(""), F.lit("Supporting evidence:")), lines), "\n")).otherwise(answer)


def why_matched(terms: Column) -> Column:
    named = F.when(F.size(terms) > 0, F.array_join(terms, ", ")).otherwise("none")
    return F.concat(F.lit("Matched terms: "), named, F.lit(". Ranked using deterministic BM25 over lexical index."))


def requirement_spans(text: Column) -> Column:
    """(label, text, start, end) of requirements ("must", "shall" and the words after) and definitions, in order."""
    text = F.coalesce(text, F.lit(""))
    found, gaps = F.regexp_extract_all(text, F.lit(SPANS), F.lit(0)), F.split(text, SPANS)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["span"])
        label = F.when(x["span"].rlike("(?i)^is"), "DEFINITION").otherwise("REQUIREMENT")
        row = F.struct(label.alias("label"), x["span"].alias("text"), begin.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    pairs = F.transform(found, lambda x, i: F.struct(gaps[i].alias("gap"), x.alias("span")))
    return F.aggregate(pairs, start, step)["out"]
