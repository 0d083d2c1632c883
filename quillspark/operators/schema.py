"""What a document is about, found from its headings and sentences: categories, ordinal grammars, candidate triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import headings as h
from quillspark.functions import intent as i
from quillspark.functions import phrases
from quillspark.functions import text as t

# Relations and their words; the form of sentences that enumerate; words that show a bad endpoint.
CANDIDATES = (("uses", "uses"), ("contains", "contains"), ("depends on", r"depends\s+on"), ("refers to", r"refers\s+to"), ("links to", r"links\s+to"), ("includes", "includes"), ("consists of", r"consists\s+of"), ("implements", "implements"))
STOP = r"(?=\s*[:;.!?]|(?:\s+)(?:which|that|where|with)\b|$)"
ORDINAL = r"(?i)(the\s+first|(?:a|the)\s+second|(?:a|the)\s+third|(?:a|the)\s+(?:fourth|fifth|sixth))\s+(.+?)\s+is\s+(?:the\s+)?(.+?)" + STOP
JUNK = r"(?i)\b(the|and|or|but|if|when|where|which|that)\s+(the|and|or)\b"
LEAST_HITS = 2


def categories(sections: DataFrame) -> DataFrame:
    """``doc_id, category, source_section, confidence``: the surest heading of each category, the first of equals; weak and numeric names go."""
    # Generators keep the rules from being computed once for each condition.
    once = lambda x: F.explode(F.array(x))
    rows = sections.select("doc_id", "title", "start_line", once(h.category(F.col("title"))).alias("category"))
    rows = rows.select("*", once(h.category_confidence(F.col("title"), F.col("category"))).alias("confidence"))
    rows = rows.where((F.col("confidence") >= h.LEAST_CONFIDENCE) & (F.length("category") > 1) & (F.col("category") != "general") & ~F.col("category").rlike("^[0-9]+$"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "start_line", "title")).alias("_b")
    return rows.groupBy("doc_id", "category").agg(best).select("doc_id", "category", F.col("_b.title").alias("source_section"), (-F.col("_b.c")).alias("confidence"))


def candidates(sentences: DataFrame) -> DataFrame:
    """Distinct triples ``doc_id, subject, relation, object, sentence`` stated at a sentence's start, the first ``ord`` of each."""
    s = F.trim(F.regexp_replace("sentence", r"\s+", " "))
    rows = sentences.select("doc_id", "ord", s.alias("sentence"))

    def stated(name: str, words: str) -> Column:
        p = rf"(?i)^(.{{3,80}}?)\s+{words}\s+(.{{3,80}}?)(?:[.!?]|$)"
        cut = lambda g: phrases.clean(F.regexp_extract("sentence", p, g))
        return F.when(F.col("sentence").rlike(p), F.struct(cut(1).alias("subject"), F.lit(name).alias("relation"), cut(2).alias("object")))

    rows = rows.select("*", F.inline(F.array_compact(F.array(*[stated(*c) for c in CANDIDATES]))))
    good = lambda c: phrases.valid_endpoint(F.col(c), F.col("sentence")) & ~F.col(c).rlike(JUNK)
    key = [F.lower("subject"), "relation", F.lower("object")]
    first = Window.partitionBy("doc_id", *key).orderBy("ord")
    return rows.where(good("subject") & good("object")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ord")


# The ordinals of sentence templates in order, and the sentence of a most common architecture.
ORDINALS = (("the first", "first"), ("second", "second"), ("third", "third"), ("fourth", "fourth"), ("fifth", "fifth"), ("sixth", "sixth"))
MOST_COMMON = r"(?i)the\s+most\s+common\b.+?\barchitecture\s+is\s+(?:the\s+)?(.+?)" + STOP
PLAUSIBLE = "length(category) > 1 and category <> 'general' and not category rlike '^[0-9]+$'"


def chunk_categories(chunks: DataFrame) -> DataFrame:
    """As categories, from the first lines of chunks ``doc_id, start_line, text``: at most 120 characters and no statement with "is"."""
    line = h.strip(F.split("text", "\n")[0])
    rows = chunks.select("doc_id", "start_line", line.alias("title")).where((F.col("title") != "") & (F.length("title") <= 120))
    return categories(rows.where(~(F.col("title").rlike(r"[.?!]$") & F.lower("title").contains(" is "))))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """The surer of two findings of a category; the first of equals."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "_o", "source_section")).alias("_b")
    return both.groupBy("doc_id", "category").agg(best).select("doc_id", "category", F.col("_b.source_section").alias("source_section"), (-F.col("_b.c")).alias("confidence"))


def sentence_categories(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Sentences ``doc_id, category, ord, sentence`` of chunks (with ``section_id``): the category of the chunk's section, else the one that
    its first line names. ``ord`` follows the document."""
    own = h.category(F.col("title"))
    sure = sections.select("doc_id", "section_id", F.when(h.category_confidence(F.col("title"), own) >= h.LEAST_CONFIDENCE, own).alias("_s")).where("_s is not null")
    rows = chunks.join(sure, ["doc_id", "section_id"], "left")
    rows = rows.select("doc_id", F.coalesce("_s", h.category(h.strip(F.split("text", "\n")[0]))).alias("category"), "start_line", F.posexplode(t.sentences(F.col("text"))).alias("_i", "sentence"))
    return rows.select("doc_id", "category", (F.col("start_line").cast("long") * 100_000 + F.col("_i")).alias("ord"), "sentence")


def grammars(sentences: DataFrame) -> DataFrame:
    """Grammars ``doc_id, category, pattern_name, hits, ordinals, type_phrases, triggers, examples, templates, confidence, family`` of sentences
    ``doc_id, category, ord, sentence`` that enumerate, two at least, and of those that name a most common architecture."""
    part = lambda g: F.regexp_extract("sentence", ORDINAL, g)
    rows = sentences.where(F.col("sentence").rlike(ORDINAL)).select("doc_id", "category", "ord", "sentence", F.lower(part(1)).alias("o"), F.lower(F.regexp_replace(part(2), r"\s+", " ")).alias("t"))
    kinds = lambda c: F.array_sort(F.collect_set(c))
    shown = lambda n: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: F.substring(x["sentence"], 1, 200)), 1, n)
    made = rows.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("o").alias("ordinals"), kinds(F.col("t")).alias("type_phrases"), kinds(F.concat_ws(" ", "o", "t", F.lit("is"))).alias("triggers"), shown(5).alias("examples"), F.array_join(F.collect_set("o"), " ").alias("_o"))
    made = made.where(F.col("hits") >= LEAST_HITS).withColumn("confidence", F.least(F.lit(0.98), 0.55 + 0.12 * F.col("hits") + 0.05 * F.col("ordinals")))
    templates = F.array_compact(F.array(*[F.when(F.col("_o").contains(mark), f"The {name} <CATEGORY> is <ENTITY>") for mark, name in ORDINALS]))
    made = made.select("doc_id", "category", F.concat(F.lit("ordinal_"), "category").alias("pattern_name"), "hits", "ordinals", "type_phrases", "triggers", "examples", templates.alias("templates"), "confidence", F.lit("ordinal_pattern_enumeration").alias("family"))
    most = sentences.where((F.col("category") == "architecture") & F.col("sentence").rlike(MOST_COMMON)).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("hits"), shown(3).alias("examples"))
    fixed = {"pattern_name": F.lit("most_common_architecture"), "ordinals": F.lit(0).cast("long"), "type_phrases": F.array(F.lit("architecture")), "triggers": F.array(F.lit("the most common architecture is")), "templates": F.array(F.lit("The most common <CATEGORY> is <ENTITY>")), "confidence": F.lit(0.9), "family": F.lit("most_common_enumeration")}
    return made.unionByName(most.withColumns(fixed).select(*made.columns))


def promoted(patterns: DataFrame) -> DataFrame:
    """Grammars of the category pattern whose type phrases speak of design patterns move to that category."""
    said = F.array_join("type_phrases", " ")
    moved = (F.col("category") == "pattern") & (said.contains("design pattern") | said.contains("critical design"))
    name = F.when(moved & (F.col("pattern_name") == "ordinal_pattern"), "ordinal_design_pattern").otherwise(F.col("pattern_name"))
    return patterns.withColumn("pattern_name", name).withColumn("category", F.when(moved, "design_pattern").otherwise(F.col("category")))


def discover(sections: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Categories (with ``patterns``, the names of their grammars), grammars and candidate triples of documents, from sections and chunks with sections.

    A category without a sentence of its own is held against all sentences of its document.
    """
    found = merged(categories(sections), chunk_categories(chunks)).where(PLAUSIBLE)
    said = sentence_categories(chunks, sections)
    own = said.join(found.select("doc_id", "category"), ["doc_id", "category"], "left_semi")
    bare = found.select("doc_id", "category").join(own.select("doc_id", "category").distinct(), ["doc_id", "category"], "left_anti")
    patterns = promoted(grammars(own.unionByName(bare.join(said.drop("category"), "doc_id").select(*own.columns))))
    design = sections.where(h.category(F.col("title")) == "design_pattern").groupBy("doc_id").agg(F.min_by("title", "start_line").alias("source_section"))
    design = design.join(found.where("category = 'design_pattern'"), "doc_id", "left_anti").select("doc_id", F.lit("design_pattern").alias("category"), "source_section", F.lit(0.95).alias("confidence"))
    names = patterns.groupBy("doc_id", "category").agg(F.array_sort(F.collect_set("pattern_name")).alias("patterns"))
    found = found.unionByName(design).join(names, ["doc_id", "category"], "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    plain = F.transform(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01"), h.strip)
    parts = chunks.select("doc_id", "start_line", F.posexplode(plain).alias("_i", "sentence"))
    return found, patterns, candidates(parts.select("doc_id", (F.col("start_line").cast("long") * 100_000 + F.col("_i")).alias("ord"), "sentence"))


def registry(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, category, section, grammars, type_phrases`` of every category and of every grammar's category. Phrases that speak of another category go."""
    names = patterns.groupBy("doc_id", "category").agg(F.array_sort(F.collect_set("pattern_name")).alias("grammars"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("type_phrases")))).alias("type_phrases"))
    rows = found.select("doc_id", "category", F.col("source_section").alias("section")).join(names, ["doc_id", "category"], "full")
    none = F.array().cast("array<string>")
    kept = F.filter("type_phrases", lambda p: ~(((F.col("category") == "design_pattern") & p.contains("architecture")) | ((F.col("category") == "architecture") & p.contains("design pattern"))))
    return rows.select("doc_id", "category", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("grammars", none).alias("grammars"), F.coalesce(kept, none).alias("type_phrases"))


def primary(patterns: DataFrame) -> DataFrame:
    """The surest grammar of each category, the first by name of equals."""
    order = Window.partitionBy("doc_id", "category").orderBy(F.desc("confidence"), "pattern_name")
    return patterns.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def question_category(asked: DataFrame, found: DataFrame) -> DataFrame:
    """``question_id, doc_id, category, source_section, confidence`` of questions ``question_id, doc_id, question``.

    The category that a question names, from the document if it has it, else with 0.95 and the section that fits; a question that
    names none takes the category whose label or section it holds, the greatest of confidence + 0.1 for each character of the label.
    """
    asked = asked.select("question_id", "doc_id", F.lower("question").alias("_q"), i.target_category(F.col("question")).alias("_t"))
    rows = asked.join(found.select("doc_id", "category", "source_section", "confidence"), "doc_id", "left")
    label = F.replace("category", F.lit("_"), F.lit(" "))
    said = F.col("_q").contains(label) | F.col("_q").contains(F.lower("source_section"))
    said &= ~((F.col("category") == "pattern") & F.col("_q").contains("design") & ~F.col("_q").contains(F.lower("source_section")))
    same = F.col("category") == F.col("_t")
    weight = F.when(F.col("_t").isNull() & said, F.col("confidence") + 0.1 * F.length(label)).when(same, 100.0)
    best = F.max_by(F.struct("category", "source_section", "confidence"), weight)
    near = F.min(F.when(F.lower("source_section").contains(F.replace("_t", F.lit("_"), F.lit(" "))), F.col("source_section")))
    rows = rows.groupBy("question_id", "doc_id", "_t").agg(F.when(F.max(weight).isNotNull(), best).alias("_b"), near.alias("_s"))
    made = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("category"), F.coalesce("_s", F.lit("")).alias("source_section"), F.lit(0.95).alias("confidence")))
    return rows.select("question_id", "doc_id", F.coalesce("_b", made).alias("_c")).where("_c is not null").select("question_id", "doc_id", "_c.*")


def trace(found: DataFrame) -> DataFrame:
    """One line for each category that says how its heading was read."""
    shown = F.concat(F.lit("category_normalized="), "source_section", F.lit(" -> "), "category", F.lit(" ("), F.format_number("confidence", 2), F.lit(")"))
    return found.select("doc_id", "category", shown.alias("line"))


def enumerated(sentences: DataFrame) -> DataFrame:
    """``doc_id, ord, entity`` that sentences ``doc_id, ord, sentence`` enumerate, cleaned; the first spelling of each."""
    entity = phrases.clean(phrases.trim_span(F.regexp_extract("sentence", ORDINAL, 3)))
    form = F.col("sentence").rlike(ORDINAL) & (F.length("sentence") <= 220) & (F.regexp_count("sentence", F.lit(r"\.")) <= 1)
    rows = sentences.where(form).select("doc_id", "ord", "sentence", entity.alias("entity")).where(phrases.valid_endpoint(F.col("entity"), F.col("sentence")))
    first = Window.partitionBy("doc_id", F.lower("entity")).orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", "ord", "entity")
