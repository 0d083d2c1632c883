"""Question intent and entities as column expressions, for a batch of questions in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import headings
from quillspark.functions.phrases import clean
from quillspark.functions.text import tokens

# The patterns of each intent, tried in this order.
REQUIREMENT_ID = r"\b[A-Za-z]{2,}-\d+\b"
REQUIREMENT = (r"\brequirement\b", r"\bshall\b", r"\bmust\b")
COMPARISON = (r"\bcompare\b", r"\bdifference\s+between\b", r"\bvs\.?\b", r"\bversus\b")
LIST = (r"\blist\s+all\b", r"\bshow\s+all\b")
EXPLANATION = (r"^\s*explain\s+(.+?)\??\s*$", r"^\s*what\s+does\s+(.+?)\s+mean\??\s*$", r"^\s*describe\s+(.+?)\??\s*$")
DEFINITION = (r"^\s*what\s+is\s+(.+?)\??\s*$", r"^\s*define\s+(.+?)\??\s*$", r"^\s*meaning\s+of\s+(.+?)\??\s*$")
WHERE = (r"\bwhere\s+.+\bmentioned\b", r"\bfind\b.+\bmentions?\b", r"\bshow\s+mentions?\s+of\b", r"\bwhere\s+is\b")
TABLE = (r"\btable\b", r"\brow\b", r"\bcolumn\b")
INTENTS = (
    ("REQUIREMENT_REFERENCE", (REQUIREMENT_ID, *REQUIREMENT)), ("COMPARISON", COMPARISON), ("LIST_REQUEST", LIST), ("EXPLANATION_LOOKUP", EXPLANATION),
    ("DEFINITION_LOOKUP", DEFINITION), ("WHERE_MENTIONED", WHERE), ("TABLE_LOOKUP", TABLE),
)


def intent(question: Column) -> Column:
    q = F.trim(question)
    any_of = lambda patterns: reduce(lambda a, b: a | b, [q.rlike(f"(?i){p}") for p in patterns])
    return reduce(lambda rest, case: F.when(any_of(case[1]), case[0]).otherwise(rest), reversed(INTENTS), F.lit("GENERAL_SEARCH"))


def entities(question: Column) -> Column:
    """Requirement ids, quoted strings, then the subjects of explanations and definitions; first spelling of each kept."""
    ids = F.regexp_extract_all(question, F.lit(f"({REQUIREMENT_ID})"), F.lit(1))
    quoted = F.transform(F.regexp_extract_all(question, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2)))
    subjects = F.array(*[F.regexp_replace(F.regexp_extract(question, f"(?i){p}", 1), r"^[ ?.]+|[ ?.]+$", "") for p in (*EXPLANATION, *DEFINITION)])
    found = F.concat(ids, quoted, F.filter(subjects, lambda s: s != ""))
    first = lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1
    return F.filter(found, first)


# What shapes retrieval, section search and the question graph.
EXPANSION = {"DEFINITION_LOOKUP": " definition means refers to", "EXPLANATION_LOOKUP": " meaning means definition explanation concept"}
SECTION_INTENTS = ("LIST_REQUEST", "DEFINITION_LOOKUP", "WHERE_MENTIONED", "COMPARISON", "EXPLANATION_LOOKUP")
SECTION_PHRASES = (
    "different", "types of", "type of", "kinds of", "kind of", "what are", "list ", "mentioned", "explain", "meaning", "define", "architecture", "architectures",
    "design pattern", "design patterns", "implementation pattern", "architcture", "architecure", "capability", "capabilities", "lineage",
)
TOPIC_WEAK = (
    "what", "are", "different", "mentioned", "pdf", "document", "explain", "tell", "me", "the", "in", "of", "a", "an", "is", "was", "be", "this", "that", "how", "does", "do",
)
SPELLING = {"architcture": "architecture", "architecure": "architecture", "architectur": "architecture", "architectues": "architectures"}
NUMBER_PAIRS = (
    ("architecture", "architectures"), ("capability", "capabilities"), ("pattern", "patterns"), ("section", "sections"), ("design_pattern", "design_patterns"),
    ("building_block", "building_blocks"), ("improvement", "improvements"), ("requirement", "requirements"), ("limitation", "limitations"),
)
FORWARD = (("uses", "use"), ("contains", "contain"), ("includes", "include"), ("depends_on", r"depend\s+on"), ("refers_to", r"refer\s+to"), ("links_to", r"link\s+to"), ("implements", "implement"))
REVERSE = (("implements", "implements"),)
DEFINED = (r"^what\s+is\s+(.+?)\??\s*$", r"^define\s+(.+?)\??\s*$", r"^explain\s+(.+?)\??\s*$", r"^what\s+does\s+(.+?)\s+mean\??\s*$", r"^describe\s+(.+?)\??\s*$")
WEAK_QUESTION = r"^(?:tell\s+me\s+something|anything|help|what\s+can\s+you\s+find)\b"
NAMED_CATEGORIES = (("design.*pattern|pattern.*design", "design_pattern"), ("architect", "architecture"), ("capabilit", "capability"))
COMPARED = (r"difference\s+between\s+(.+?)\s+and\s+(.+?)\??\s*$", r"compare\s+(.+?)\s+and\s+(.+?)\??\s*$", r"(.+?)\s+vs\.?\s+(.+?)\??\s*$")


def comparison_terms(question: Column) -> Column:
    """The two things compared, none if there is no comparison."""
    rest = F.array().cast("array<string>")
    for p in reversed(COMPARED):
        pair = F.array(*[F.trim(F.regexp_extract(question, f"(?i){p}", g)) for g in (1, 2)])
        rest = F.when(question.rlike(f"(?i){p}"), pair).otherwise(rest)
    return rest


def retrieval_query(question: Column) -> Column:
    """The question with words that its intent adds."""
    what, ids = intent(question), F.array_join(F.regexp_extract_all(question, F.lit(f"({REQUIREMENT_ID})"), F.lit(1)), " ")
    more = F.when((what == "REQUIREMENT_REFERENCE") & (ids != ""), F.concat(F.lit(" "), ids))
    for name, words in EXPANSION.items():
        more = more.when(what == name, words)
    return F.concat(question, more.otherwise(""))


def wants_sections(question: Column) -> Column:
    """Whether whole sections answer a question better than chunks."""
    q = F.lower(F.trim(question))
    return (q != "") & (intent(question).isin(list(SECTION_INTENTS)) | q.rlike("^(?:what are|list)") | q.rlike("|".join(SECTION_PHRASES)))


def with_numbers(terms: Column) -> Column:
    """Terms spelled right, and the other number of those that have one; sorted."""
    right = F.transform(terms, lambda w: F.coalesce(*[F.when(w == a, b) for a, b in SPELLING.items()], w))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (*NUMBER_PAIRS, *[(b, a) for a, b in NUMBER_PAIRS])])
    other = F.transform(F.filter(pairs, lambda p: F.array_contains(right, p["a"])), lambda p: p["b"])
    return F.array_sort(F.array_distinct(F.concat(right, other)))


def topic_terms(question: Column) -> Column:
    return with_numbers(F.filter(F.array_distinct(tokens(question)), lambda w: ~w.isin(list(TOPIC_WEAK))))


def question_graph(question: Column) -> Column:
    """(kind, entity, relation, category) of a question: forward, reverse, definition, category or generic; the first that fits.

    The forms that a question has give raw entities in order; one expression cleans them all and the first plausible one counts.
    """
    q = F.trim(F.regexp_replace(question, r"\s+", " "))
    text = lambda x: F.lit(x).cast("string")
    made = lambda kind, entity=None, relation=None, category=None: F.struct(text(kind).alias("kind"), (text(None) if entity is None else entity).alias("entity"), text(relation).alias("relation"), text(category).alias("category"))
    forms = [(rf"(?i)^what\s+does\s+(.+?)\s+{word}\??\s*$", "forward", relation) for relation, word in FORWARD]
    forms += [(rf"(?i)^what\s+{word}\s+(.+?)\??\s*$", "reverse", relation) for relation, word in REVERSE]
    forms += [(f"(?i){pattern}", "definition", "definition") for pattern in DEFINED]
    found = F.array_compact(F.array(*[F.when(q.rlike(p), made(kind, F.regexp_extract(q, p, 1), relation)) for p, kind, relation in forms]))
    named = F.when(intent(question).isin(*EXPANSION), F.transform(entities(question), lambda e: made("definition", e, "definition")))
    every = F.concat(found, F.coalesce(named, F.array_except(found, found)))
    cleaned = F.transform(every, lambda c: F.struct(c["kind"].alias("kind"), clean(c["entity"]).alias("entity"), c["relation"].alias("relation"), c["category"].alias("category")))
    fits = F.try_element_at(F.filter(cleaned, lambda c: F.length(c["entity"]).between(2, 120) & (F.size(tokens(c["entity"])) > 0)), F.lit(1))
    asks = F.lower(q).rlike("what are|list|different|mentioned")
    rest = F.struct(text("generic").alias("kind"), text(None).alias("entity"), F.when(intent(question).isin("WHERE_MENTIONED", "LIST_REQUEST"), "mentions").alias("relation"), text(None).alias("category"))
    for words, name in reversed(NAMED_CATEGORIES):
        rest = F.when(asks & F.lower(q).rlike(words), made("category", relation="mentions", category=name)).otherwise(rest)
    return F.when((q == "") | q.rlike(f"(?i){WEAK_QUESTION}"), made("generic")).otherwise(F.coalesce(fits, rest))


# What makes a question one that lists, or one about lineage.
LISTED = ("different", "types", "kinds", "mentioned", "architectures", "patterns", "steps", "capabilities", "approaches", "options", "categories", "families", "models")
LINEAGE_VERBS = ("explain", "meaning", "define", "describe", "what")
ENUMERATED = ("architecture", "design_pattern", "pattern", "capability")


def lists(question: Column) -> Column:
    """Whether a question asks for a list."""
    q = F.lower(F.trim(question))
    return (q != "") & (q.rlike("^(?:what are|list)") | q.rlike("|".join(LISTED)))


def about_lineage(question: Column) -> Column:
    q = F.lower(question)
    return q.contains("lineage") & q.rlike("|".join(LINEAGE_VERBS))


def explained(explanation: Column, base: Column) -> Column:
    """The parts of an explanation that say something."""
    return F.concat_ws(" ", *[F.when(F.trim(x) != "", F.trim(x)) for x in (explanation, base)])


def node_id(label: Column, kind: Column) -> Column:
    """The id of a node of a question's graph."""
    return F.concat(F.lit("qnode-"), F.substring(F.sha2(F.concat_ws(":", kind, label).cast("binary"), 256), 1, 10))


def relational(relation: Column, category: Column) -> Column:
    """Whether a question asks for a relation, and not for a definition or a list."""
    r = F.replace(relation, F.lit(" "), F.lit("_"))
    listed = F.coalesce(category.isin(list(ENUMERATED)) | (r == "mentions") & category.isNotNull(), F.lit(False))
    return F.coalesce((r != "") & (r != "definition"), F.lit(False)) & ~listed


def target_category(question: Column, section_title: Column | None = None) -> Column:
    """The category that a question asks for: design patterns and architectures by their words, else the section's, else the question's."""
    q = F.lower(question)
    named = F.when(q.contains("design") & q.contains("pattern"), "design_pattern").when(q.contains("architect"), "architecture")
    return F.coalesce(named, *([headings.category(section_title)] if section_title is not None else []), headings.category(question))


def graphs(asked: DataFrame) -> DataFrame:
    """Questions with ``kind, entity, relation, category``. A generator keeps the rules from being computed once for each use of a column."""
    return asked.select(*asked.columns, F.inline(F.array(question_graph(F.col("question")))))
