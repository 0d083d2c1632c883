"""Entities that a document's own grammars, and the rules for architectures, find in its sentences (``doc_id, ord, sentence``), and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import phrases
from quillspark.functions.headings import let
from quillspark.operators.schema import MOST_COMMON, ORDINALS, STOP

# Forms of ordinal sentences, markers of other categories, rules and phrases of architectures, marks of context.
END = r"(?=\s*[:;.!?]|(?:\s+)(?:which|that|where|with|when|because|this|for)\b|$)"
ORDINAL_LINE = r"(?i)(?:the\s+first|(?:a|the)\s+(?:second|third|fourth|fifth|sixth))\s+.+?\s+is\s+"
FOREIGN = (
    ("design_pattern", (" architecture is ", " architectures ", "most common", "enterprise search stack", "classic qa pipeline", "knowledge-graph stack", "citation graph")),
    ("architecture", (" design pattern is ", " design patterns ")),
    ("building_block", (" architecture is ", " design pattern is ")),
    ("capability", (" architecture is ", " design pattern is ")),
)
RULES = (
    ("second_architecture", r"(?i)(?:a|the)\s+second\s+architecture\s+is\s+(?:the\s+)?(.+?)"), ("third_architecture", r"(?i)(?:a|the)\s+third\s+architecture\s+is\s+(?:the\s+)?(.+?)"),
    ("fourth_architecture", r"(?i)(?:a|the)\s+(?:fourth|fifth)\s+architecture\s+is\s+(?:the\s+)?(.+?)"), ("another_architecture", r"(?i)another\s+architecture\s+is\s+(?:the\s+)?(.+?)"),
    ("first_architecture", r"(?i)the\s+first\s+architecture\s+is\s+(?:the\s+)?(.+?)"),
)
CLASSIC, CLASSIC_NEAR = r"(?i)\b((?:the\s+)?classic\s+QA\s+pipeline)\b", ("second architecture", "this pipeline is still the cleanest conceptual answer", "pipeline is still the cleanest conceptual answer")
NOUNS = ("enterprise search stack", "classic QA pipeline", "ontology and knowledge-graph stack", "traceability and citation graph")
IMPLIED = {"openephyra": ("Classic QA pipeline",)}
FEATURES = ("question analysis", "query generation", "answer extraction", "modular implementation")
CONTEXT = (
    "architecture", "openephyra", "open ephyra", "pipeline", "question analysis", "query generation", "answer extraction", "modular implementation", "enterprise search stack", "ontology",
    "knowledge-graph", "traceability", "citation graph",
)
SCOPE, CONFLICT, BOUNDARY, MISMATCH = "section_scope_violation", "conflicting_category_entity", "category_boundary_violation", "grammar_sentence_mismatch"


def type_form(type_phrases: Column) -> Column:
    """A pattern that fits all type phrases: one phrase, the shortest with an optional beginning, or any of them."""
    plain = F.array_distinct(F.transform(F.filter(type_phrases, lambda p: F.trim(p) != ""), lambda p: F.trim(F.lower(F.regexp_replace(p, r"\s+", " ")))))
    ordered = F.transform(F.array_sort(F.transform(plain, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), lambda x: x["p"])
    words = lambda p: F.array_join(F.transform(F.split(p, " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")

    def made(o: Column) -> Column:
        short, long = F.try_element_at(o, F.lit(1)), F.try_element_at(o, F.lit(-1))
        lead = F.trim(F.substring(long, F.lit(1), F.length(long) - F.length(short)))
        nested = F.concat(F.lit("(?:"), words(lead), F.lit(r"\s+)?"), words(short))
        every = F.concat(F.lit("(?:"), F.array_join(F.transform(o, words), "|"), F.lit(")"))
        return F.when(F.size(o) == 0, r"(?:\w+(?:\s+\w+){0,10})").when(F.size(o) == 1, words(short)).when(long.endswith(short) & (lead != ""), nested).otherwise(every)

    return let(ordered, made)


def forms(templates: Column, type_phrases: Column) -> Column:
    """(rank, form) for each ordinal that a grammar's templates name, for all without templates; the entity is group 1."""
    told = F.lower(F.array_join(templates, " "))
    kind = type_form(type_phrases)
    active = [F.when((F.size(templates) == 0) | told.contains(mark), F.struct(F.lit(n + 1).alias("rank"), F.concat(F.lit(rf"(?i)(?:{'the' if n == 0 else 'a|the'})\s+{name}\s+(?:(?:critical|important|common)\s+)?"), kind, F.lit(r"\s+is\s+(?:the\s+)?(.+?)" + END)).alias("form"))) for n, (mark, name) in enumerate(ORDINALS)]
    return F.array_compact(F.array(*active))


def enumerates(sentence: Column) -> Column:
    """A short sentence of one statement that gives an ordinal."""
    return sentence.rlike(ORDINAL_LINE) & (F.length(sentence) <= 220) & (F.regexp_count(sentence, F.lit(r"\.")) <= 1)


def execute(patterns: DataFrame, sentences: DataFrame) -> DataFrame:
    """``doc_id, category, pattern_name, confidence, rank, ord, entity, sentence`` that grammars find in the sentences of their document, the first of each
    spelling; in order of the ordinals. Only sentences that enumerate meet a grammar, so that of a most common architecture finds nothing."""
    some = sentences.where(enumerates(F.col("sentence"))).select("doc_id", "ord", "sentence")
    rows = patterns.where("family <> 'most_common_enumeration'").select("doc_id", "category", "pattern_name", "confidence", F.explode(forms(F.col("templates"), F.col("type_phrases"))).alias("_f"))
    rows = rows.select("doc_id", "category", "pattern_name", "confidence", "_f.*").join(some, "doc_id").where("sentence rlike form")
    rows = rows.withColumn("entity", phrases.clean(phrases.trim_span(F.expr("regexp_extract(sentence, form, 1)"))))
    rows = rows.where(phrases.valid_entity(F.col("entity")) & F.lower("sentence").contains(F.lower("entity")))
    first = Window.partitionBy("doc_id", "category", "pattern_name", F.lower("entity")).orderBy("rank", "ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "form")


def confidence(count: Column, grammar: Column) -> Column:
    """How sure a grammar's finds are."""
    return F.when(count <= 0, 0.0).otherwise(F.least(F.lit(0.98), 0.45 + 0.14 * count + 0.12 * grammar + F.when(count >= 2, 0.1).otherwise(0.0)))


def speaks_of(sentence: Column, category: Column, type_phrases: Column) -> Column:
    """Whether a sentence holds a type phrase of a category, or its label where it has none."""
    s = F.concat(F.lit(" "), F.lower(sentence), F.lit(" "))
    return F.when(F.size(type_phrases) > 0, F.exists(type_phrases, s.contains)).otherwise(s.contains(F.replace(category, F.lit("_"), F.lit(" "))))


def known(registry: DataFrame, patterns: DataFrame, sentences: DataFrame) -> DataFrame:
    """The registry with ``known``: what each category's grammars find in the sentences that speak of it."""
    scoped = sentences.join(registry.select("doc_id", F.col("category").alias("_c"), "type_phrases"), "doc_id").where(speaks_of(F.col("sentence"), F.col("_c"), F.col("type_phrases")))
    found = execute(patterns, sentences).join(scoped.select("doc_id", F.col("_c").alias("category"), "ord"), ["doc_id", "category", "ord"], "left_semi")
    built = architectures(sentences).select("doc_id", F.lit("architecture").alias("category"), "ord", F.col("value").alias("entity")).join(scoped.select("doc_id", F.col("_c").alias("category"), "ord"), ["doc_id", "category", "ord"], "left_semi")
    names = found.select("doc_id", "category", "entity").union(built.select("doc_id", "category", "entity")).groupBy("doc_id", "category").agg(F.collect_set(F.lower("entity")).alias("known"))
    return registry.join(names, ["doc_id", "category"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def validate(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """hits (``doc_id, category, entity, sentence``, and ``section`` if they have it) with ``reason``, empty where the entity belongs to its category.

    registry: from ``known``. An entity is rejected, in this order, for a section other than its category's, for being known in another
    category that the sentence speaks of, for words of other categories, and for a sentence that isn't the grammar's.
    """
    own = registry.select("doc_id", "category", F.col("section").alias("_section"), F.col("type_phrases").alias("_types"))
    all_ = registry.groupBy("doc_id").agg(F.collect_list(F.struct("category", "type_phrases", "known")).alias("_all"))
    section = F.col("section") if "section" in hits.columns else F.lit("")
    rows = hits.join(own, ["doc_id", "category"], "left").join(all_, "doc_id", "left")
    s = F.concat(F.lit(" "), F.lower("sentence"), F.lit(" "))
    marked = F.lit(False)
    for name, marks in FOREIGN:
        marked = marked | ((F.col("category") == name) & s.rlike("|".join(marks)))
    types = F.coalesce("_types", F.array().cast("array<string>"))
    other = F.exists(F.coalesce("_all", F.array().cast("array<struct<category:string,type_phrases:array<string>,known:array<string>>>")), lambda r: (r["category"] != F.col("category")) & F.array_contains(r["known"], F.lower("entity")) & (speaks_of(F.col("sentence"), r["category"], r["type_phrases"]) | marked))
    scope = (F.trim(F.coalesce("_section", F.lit(""))) != "") & (F.coalesce(section, F.lit("")) != "") & ~F.lower(section).contains(F.lower(F.trim("_section")))
    said = F.col("sentence").rlike(ORDINAL_LINE) & speaks_of(F.col("sentence"), F.col("category"), types)
    reason = F.when(F.trim("sentence") == "", MISMATCH).when(scope, SCOPE).when(other, CONFLICT).when(marked, BOUNDARY).when(~said, MISMATCH).otherwise("")
    return rows.withColumn("reason", reason).drop("_section", "_types", "_all")


def scoped(sentences: DataFrame, registry: DataFrame, category: str) -> DataFrame:
    """The sentences that speak of a category."""
    own = registry.where(F.col("category") == category).select("doc_id", F.col("type_phrases").alias("_t"))
    return sentences.join(own, "doc_id").where(speaks_of(F.col("sentence"), F.lit(category), F.col("_t"))).drop("_t")


def _explicit(sentences: DataFrame) -> DataFrame:
    """What sentences say outright: the most common architecture, ordinals, the classic pipeline in its context, known names."""
    near = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-2, 2)
    around = F.lower(F.array_join(F.collect_list("sentence").over(near), " "))
    c = F.col("sentence")
    place = lambda form: F.regexp_instr(c, F.lit(form))
    one = lambda name, test, at, value: F.when(test, F.struct(at.cast("int").alias("at"), F.lit(name).alias("pattern"), value.alias("value")))
    rules = [one("most_common_architecture", c.rlike(MOST_COMMON), place(MOST_COMMON), F.regexp_extract(c, MOST_COMMON, 1))]
    rules += [one(name, c.rlike(form + STOP), place(form + STOP), F.regexp_extract(c, form + STOP, 1)) for name, form in RULES]
    rules += [one("classic_qa_context", c.rlike(CLASSIC) & F.col("_near").rlike("|".join(CLASSIC_NEAR)), place(CLASSIC), F.regexp_extract(c, CLASSIC, 1))]
    rules += [one("noun_phrase_evidence", F.lower(c).contains(n.lower()), F.instr(F.lower(c), n.lower()), F.substring(c, F.instr(F.lower(c), n.lower()), F.lit(len(n)))) for n in NOUNS]
    rows = sentences.withColumn("_near", around).select("doc_id", "ord", "sentence", F.posexplode(F.array(*rules)).alias("_rule", "_x")).where("_x is not null")
    rows = rows.select("doc_id", "ord", "sentence", "_rule", "_x.at", "_x.pattern", phrases.clean(F.col("_x.value")).alias("value"))
    return rows.where(phrases.valid_phrase(F.col("value")) & F.lower("sentence").contains(F.lower("value")))


def architectures(sentences: DataFrame) -> DataFrame:
    """``doc_id, ord, value, sentence, pattern, inference``: architectures that sentences name, and those that they imply, the first of each spelling.

    A sentence on the modular pipeline implies its family, and so does "this pipeline" after one, or after any sentence on an architecture
    if it is called the cleanest answer. What is named isn't implied again.
    """
    first = Window.partitionBy("doc_id", F.lower("value")).orderBy("ord", "at", "_rule")
    named = _explicit(sentences).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("inference", F.lit("explicit_pattern"))
    low = F.lower("sentence")
    marks = sum((F.when(low.contains(m), 1).otherwise(0) for m in FEATURES), F.lit(0))
    strong = F.col("sentence").rlike(r"(?i)\bopen\s*ephyra\b") & (low.contains("modular implementation") | (marks >= 2))
    context = low.rlike("|".join(CONTEXT))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(strong | context, F.struct(strong.alias("strong"), context.alias("context"))), True).over(before)
    rows = sentences.withColumn("_strong", strong).withColumn("_prior", prior)
    refers = F.col("sentence").rlike(r"(?i)\b(?:this|that)\s+(?:pipeline|architecture)\b") & F.col("_prior").isNotNull() & (F.col("_prior.strong") | (low.contains("cleanest conceptual answer") & F.col("_prior.context")))
    pattern = F.when(F.col("_strong"), "open_ephyra_pipeline_inference").when(refers, F.when(F.col("_prior.strong"), "open_ephyra_pipeline_inference").otherwise("coreference_pipeline_resolution"))
    rows = rows.withColumn("pattern", pattern).where("pattern is not null").withColumn("value", phrases.clean(F.lit(IMPLIED["openephyra"][0])))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", F.lower("value")).orderBy("ord"))).where("_n = 1")
    implied = rows.join(named.select("doc_id", F.lower("value").alias("_v")), (rows.doc_id == named.doc_id) & (F.lower(rows.value) == F.col("_v")), "left_anti")
    keep = ("doc_id", "ord", "value", "sentence", "pattern")
    return named.select(*keep, "at", "inference").unionByName(implied.select(*keep, F.lit(10_000).alias("at"), F.lit("symbolic_inference").alias("inference")))


def enumerated(sentences: DataFrame, patterns: DataFrame, registry: DataFrame) -> DataFrame:
    """``doc_id, category, n, value, sentence, pattern, inference`` of each category: what its grammars find and validation keeps, and for
    architectures the built-in rules too; in order of sentences, the first of each spelling."""
    found = validate(execute(patterns, sentences), known(registry, patterns, sentences)).where("reason = ''")
    found = found.select("doc_id", "category", "ord", F.col("entity").alias("value"), "sentence", F.col("pattern_name").alias("pattern"), F.lit("explicit_pattern").alias("inference"), F.lit(0).alias("at"))
    rows = found.unionByName(architectures(sentences).withColumn("category", F.lit("architecture")))
    one = Window.partitionBy("doc_id", "category", F.lower("value")).orderBy("ord", "at")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    order = Window.partitionBy("doc_id", "category").orderBy("ord", "at")
    return rows.withColumn("n", F.row_number().over(order)).select("doc_id", "category", "n", "value", "sentence", "pattern", "inference")
