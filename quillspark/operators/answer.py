"""Answers to a batch of questions, each about one stored document: graph, section or chunk evidence, in this order.

Modes: GRAPH_STRUCTURED (relations of the document's graph), STRUCTURED_EXTRACTIVE (a list composed from evidence),
EVIDENCE_ONLY (cards) and NO_EVIDENCE. Every step is a DataFrame over all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import evidence as e
from quillspark.functions import intent as i
from quillspark.functions import text as t
from quillspark.operators import extract, graph, index, schema, sections, structure

MAX_CARDS, TOP = 3, 5
CARD = "array<struct<rank:int,citation:string,snippet:string,score:double,confidence:string>>"


def _cards(rows: DataFrame) -> DataFrame:
    """question_id, cards of rows ``question_id, rank, citation, snippet, score, confidence``."""
    one = F.struct(F.col("rank").cast("int").alias("rank"), "citation", "snippet", F.col("score").cast("double").alias("score"), "confidence")
    return rows.groupBy("question_id").agg(F.sort_array(F.collect_list(one)).cast(CARD).alias("cards"))


def graph_answers(asked: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """``question_id, answer, cards`` of questions on a relation that the graph answers."""
    some = i.graphs(asked.select("question_id", "doc_id", "question")).where(i.relational(F.col("relation"), F.col("category")))
    found = graph.match(some, edges)
    made = graph.answers(some, found)
    named = found.join(asked.select("question_id", "doc_id"), "question_id").join(documents.select("doc_id", "name"), "doc_id")
    shown = _cards(graph.cards(named, F.col("name"), MAX_CARDS).withColumnRenamed("n", "rank"))
    return made.select("question_id", "answer").join(shown, "question_id", "left")


def structured(rows: DataFrame, patterns: DataFrame, registry: DataFrame) -> DataFrame:
    """``question_id, answer`` of questions ``question_id, doc_id, question, category, text`` that ask for a list or for lineage, composed from their text.

    Entities that a category's grammar finds and validation keeps; architectures by the built-in rules too; else lists in the text, or
    points of lineage. Each text is a document of its own here, under the grammars of its document.
    """
    rows = rows.where(i.lists(F.col("question")) | i.about_lineage(F.col("question")))
    own = rows.select(F.col("question_id").alias("_q"), "doc_id")
    for_question = lambda df: df.join(own, "doc_id").drop("doc_id").withColumnRenamed("_q", "doc_id")
    said = rows.select(F.col("question_id").alias("doc_id"), F.posexplode(t.sentences(F.col("text"))).alias("ord", "sentence"))
    found = extract.enumerated(said, for_question(patterns), for_question(registry))
    found = found.groupBy(F.col("doc_id").alias("question_id"), F.col("category").alias("_c")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("_v"))
    sure = patterns.groupBy("doc_id", F.col("category")).agg(F.max("confidence").alias("_sure"))
    rows = rows.join(found, (rows.question_id == found.question_id) & (F.col("category") == F.col("_c")), "left").select(rows["*"], "_v").join(sure, ["doc_id", "category"], "left")
    n = F.size(F.coalesce("_v", F.array().cast("array<string>")))
    least = F.when(extract.confidence(n, F.coalesce("_sure", F.lit(0.0))) >= 0.65, 1).otherwise(2)
    families = F.concat(F.lit("The document describes these architecture families:\n"), e.numbered(F.col("_v")))
    listed = F.concat(e.category_intro(F.col("category"), n), F.lit("\n"), e.numbered(F.col("_v")))
    made = F.when(F.col("category") == "architecture", F.when(n > 0, families)).when(F.col("category").isNotNull() & (n >= least), listed)
    items = e.listed_answer(F.col("question"), e.listed(F.col("text")))
    answer = F.coalesce(made, F.when(i.about_lineage(F.col("question")), e.lineage_answer(F.col("text"))), F.when(F.col("category").isNull() & i.lists(F.col("question")), items))
    return rows.select("question_id", answer.alias("answer")).where("answer is not null")


def ask(asked: DataFrame, tables: dict[str, DataFrame], save=lambda rows, name: rows, mode: str = "lexical") -> DataFrame:
    """``question_id, doc_id, question, intent, answer_mode, strategy, section, answer, cards`` for every row of asked (``question_id, doc_id, question``).

    tables: those of a store by name. save(rows, name) may write intermediate rows and read them again, which cuts the plan. A blank question, and one about a
    document that isn't stored, has no evidence. mode: see index.retrieve. cards: at most MAX_CARDS.
    """
    docs = tables["documents"].select("doc_id", "name")
    asked = save(asked.select("question_id", "doc_id", "question", i.intent(F.col("question")).alias("intent")).where("trim(question) <> ''").join(docs, "doc_id"), "asked")
    patterns, registry = tables["patterns"], schema.registry(tables["categories"], tables["patterns"])
    by_graph = save(graph_answers(asked, tables["edges"], docs), "by_graph")

    # The best section of the questions that sections answer, with the category that the question asks for.
    wanted = asked.where(i.wants_sections(F.col("question"))).join(by_graph.select("question_id"), "question_id", "left_anti")
    wanted = wanted.join(schema.question_category(wanted, tables["categories"]).select("question_id", F.col("category").alias("_category"), F.col("source_section").alias("_source")), "question_id", "left")
    heads = tables["sections"].join(docs, "doc_id")
    best = sections.search(wanted, heads, 1).join(tables["sections"].select("doc_id", "section_id", "start_line", "end_line"), ["doc_id", "section_id"])
    best = sections.texts(best, tables["chunks"]).join(wanted.select("question_id", "question", "name", "_category"), "question_id")
    best = save(best.where(~sections.lacks_body(F.col("text"), F.col("title"), F.col("name"))), "sections")
    target = F.coalesce(i.target_category(F.col("question"), F.col("title")), "_category")
    composed = structured(best.select("question_id", "doc_id", "question", target.alias("category"), "text"), patterns, registry)
    terms = i.topic_terms(F.col("question"))
    matched = F.filter(terms, lambda w: F.lower("text").contains(w))
    score = F.col("score") + 0.5
    cited = t.citation(F.col("name"), F.col("start_line"), F.col("end_line"), F.col("title"))
    section_cards = _cards(best.select("question_id", F.lit(1).alias("rank"), cited.alias("citation"), t.snippet(F.col("text"), matched).alias("snippet"), score.alias("score"), t.confidence(score, F.size(matched)).alias("confidence")))
    by_section = best.select("question_id", F.col("title").alias("section")).join(section_cards, "question_id").join(composed, "question_id", "left")
    by_section = save(by_section, "by_section")

    # Chunks for the rest; what the cards say may still be a list.
    rest = asked.join(by_graph.select("question_id"), "question_id", "left_anti").join(by_section.select("question_id"), "question_id", "left_anti")
    found = index.retrieve(tables["chunks"], rest.select("question_id", "doc_id", i.retrieval_query(F.col("question")).alias("question")), mode, tables.get("postings"), TOP)
    shown = tables["chunks"].join(docs, "doc_id")
    hits = save(index.evidence(found, shown, most=MAX_CARDS).join(found.select("question_id", "doc_id", "chunk_id", "score"), ["question_id", "doc_id", "chunk_id"]), "hits")
    said = hits.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "snippet"))), lambda x: e.unmarked(x["snippet"])), "\n").alias("text"))
    from_cards = structured(rest.join(said, "question_id").select("question_id", "doc_id", "question", i.target_category(F.col("question")).alias("category"), "text"), patterns, registry)
    by_chunk = _cards(hits).join(from_cards, "question_id", "left")

    none = F.lit(None).cast("string")
    ways = [
        by_graph.select("question_id", F.lit("GRAPH_STRUCTURED").alias("answer_mode"), F.lit("GRAPH").alias("strategy"), none.alias("section"), "answer", "cards"),
        by_section.select("question_id", F.when(F.col("answer").isNull(), "EVIDENCE_ONLY").otherwise("STRUCTURED_EXTRACTIVE"), F.lit("SECTION_LEVEL"), "section", "answer", "cards"),
        by_chunk.select("question_id", F.when(F.col("answer").isNull(), "EVIDENCE_ONLY").otherwise("STRUCTURED_EXTRACTIVE"), F.lit("CHUNK_LEVEL"), none, "answer", "cards"),
    ]
    given = ways[0].union(ways[1]).union(ways[2])
    rows = asked.select("question_id", "doc_id", "question", "intent").join(given, "question_id", "left")
    return rows.withColumn("answer_mode", F.coalesce("answer_mode", F.lit("NO_EVIDENCE"))).withColumn("cards", F.coalesce("cards", F.array().cast(CARD)))


def ask_all(asked: DataFrame, tables: dict[str, DataFrame], k: int = 5, most: int = MAX_CARDS) -> DataFrame:
    """Cards of the best evidence among all documents for ``question_id, question``: ``question_id, rank, doc_id, citation, snippet, score, confidence``.

    Each document gives the chunks of its best section where sections answer the question, else its k best chunks; all are ranked together.
    """
    docs = tables["documents"].select("doc_id", "name")
    best = sections.search(asked.where(i.wants_sections(F.col("question"))), tables["sections"].join(docs, "doc_id"), 1)
    best = best.join(tables["sections"].select("doc_id", "section_id", "start_line", "end_line"), ["doc_id", "section_id"]).join(asked, "question_id")
    by_section = sections.results(best, tables["chunks"], i.topic_terms(F.col("question")))
    each = asked.crossJoin(F.broadcast(docs.select("doc_id"))).join(by_section.select("question_id", "doc_id").distinct(), ["question_id", "doc_id"], "left_anti")
    pairs = each.select(F.struct("question_id", "doc_id").alias("question_id"), "doc_id", i.retrieval_query(F.col("question")).alias("question"))
    by_chunk = index.search(tables["chunks"], pairs, k).join(tables["chunks"].select("doc_id", "chunk_id", "start_line", "end_line", "text", F.col("section_title").alias("title")), ["doc_id", "chunk_id"])
    keep = ("question_id", "doc_id", "title", "start_line", "end_line", "text", "score", "matched")
    both = by_section.select(*keep).unionByName(by_chunk.withColumn("question_id", F.col("question_id.question_id")).select(*keep)).join(docs, "doc_id")
    both = both.withColumn("snippet", t.snippet(F.col("text"), F.col("matched")))
    order = [F.desc("score"), "name", "start_line", "text"]
    one = Window.partitionBy("question_id", t.squeeze(F.lower("snippet"))).orderBy(*order)
    both = both.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= most)
    return both.select("question_id", "rank", "doc_id", t.citation(F.col("name"), F.col("start_line"), F.col("end_line"), F.col("title")).alias("citation"), "snippet", "score", t.confidence(F.col("score"), F.size("matched")).alias("confidence"))


def said(rows: DataFrame) -> Column:
    """All that an answer says, in lower case, without marks."""
    return F.lower(F.concat_ws("\n", "answer", F.transform("cards", lambda c: e.unmarked(c["snippet"]))))


def readiness(text_len: Column, section_count: Column, heading_lines: Column, extracted: Column) -> Column:
    """Whether a document is fit for questions, from its length, sections and heading lines."""
    return (
        F.when(~extracted | (text_len < 80), "RED - NOT_READY").when((section_count < 2) | (heading_lines == 0), "YELLOW - STRUCTURE_WEAK")
        .when((section_count >= 4) & (heading_lines >= 2), "GREEN+ - READY_FOR_EVAL").otherwise("GREEN - READY_FOR_QA")
    )


# What a document's name or categories must hold for the first set of suggested questions, the sets, and sample questions with the mode and section they should find.
SIGNALS = ("architect", "design pattern", "enterprise search", "qa pipeline", "knowledge graph", "symbolic")
NAME_SIGNALS = ("architecture", "symbolic")
SUGGESTED = ("what are different architectures mentioned?", "what are different design patterns mentioned?", "What does Enterprise search stack use?", "What does Classic QA pipeline contain?")
GENERAL = ("What is HPC6 memory policy?", "Where is CPU binding mentioned?", "What is REQ-001?", "List all storage rules")
SAMPLES = (
    ("what are different architectures mentioned in the pdf?", "STRUCTURED_EXTRACTIVE", "Existing architectures"),
    ("what are different design patterns mentioned in the pdf?", "STRUCTURED_EXTRACTIVE", "Design patterns"), ("What does Enterprise search stack use?", "GRAPH_STRUCTURED", None),
)


def suggested(name: Column, categories: Column, edges: Column) -> Column:
    """Questions that suit a document, from its name, the labels of its categories and the edges of its graph."""
    name, labels = F.lower(name), F.lower(F.array_join(categories, " "))
    shown = F.coalesce(edges > 0, F.lit(False)) & (name.rlike("|".join(SIGNALS)) | labels.rlike("|".join(SIGNALS)))
    return F.when(shown | name.rlike("|".join(NAME_SIGNALS)), F.array(*map(F.lit, SUGGESTED))).otherwise(F.array(*map(F.lit, GENERAL)))


def preflight(docs: DataFrame) -> DataFrame:
    """``doc_id, chars, lines, headings, sections, chunks, readiness, outlook`` of documents ``doc_id, text`` (null: not extracted), without storing them.

    outlook: for each sample question the mode, way and section that it will likely get; null unless the readiness is green.
    """
    c = F.col
    rows = structure.lines(docs)
    found = structure.sections(rows)
    of = lambda df, *what: df.groupBy("doc_id").agg(*what)
    made = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), c("text").isNotNull().alias("_read"))
    made = made.join(of(rows, F.count(F.lit(1)).alias("lines")), "doc_id", "left").join(of(found, F.count(F.lit(1)).alias("sections"), F.transform(F.sort_array(F.collect_list(F.struct("start_line", "title"))), lambda x: x["title"]).alias("_titles")), "doc_id", "left")
    made = made.join(of(structure.chunks(rows), F.count(F.lit(1)).alias("chunks")), "doc_id", "left").na.fill(0, ["lines", "sections", "chunks"]).withColumn("headings", c("sections"))
    made = made.withColumn("readiness", readiness(c("chars"), c("sections"), c("headings"), c("_read")))
    text = lambda x: F.lit(x).cast("string")
    likely = lambda q, mode, way, section: F.struct(text(q).alias("question"), text(mode).alias("mode"), text(way).alias("strategy"), section.alias("section"))

    def one(q: str, mode: str, hint: str | None) -> Column:
        other = likely(q, "EVIDENCE_ONLY or NO_EVIDENCE", "CHUNK_LEVEL", text(None))
        if "enterprise" in q.lower():
            other = F.when(F.exists("_titles", lambda t: F.lower(t).contains("architecture")), likely(q, mode, "CHUNK_LEVEL or GRAPH", text(None))).otherwise(other)
        if hint is None:
            return other
        hits = F.filter("_titles", lambda t: F.lower(t).contains(hint.lower()))
        return F.when(F.size(hits) > 0, likely(q, mode, "SECTION_LEVEL", F.try_element_at(hits, F.lit(1)))).otherwise(other)

    outlook = F.when(c("readiness").startswith("GREEN"), F.array(*[one(*s) for s in SAMPLES]))
    return made.select("doc_id", "chars", "lines", "headings", "sections", "chunks", "readiness", outlook.alias("outlook"))
