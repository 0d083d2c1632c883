"""Search of whole sections by their titles, chunks of a section, context around short results, title boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import headings
from quillspark.functions import intent as i
from quillspark.functions import text as t
from quillspark.functions.headings import strip
from quillspark.operators import structure
from quillspark.operators.graph import against

TRAP_LINES, TRAP_FACTOR, LEAST_OTHER, SHORT = 2, 0.25, 1.0, 120


def mirrors_name(title: Column, name: Column) -> Column:
    """Whether a title says no more than the file's name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[\s_\-]+", " ")
    a, b = t.tokens(title), t.tokens(stem)
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    words, common = F.size(F.array_distinct(a)), F.size(F.array_intersect(a, F.filter(b, lambda w: ~w.isin(list(i.TOPIC_WEAK)))))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (common >= F.greatest(F.lit(2), F.floor((words * 2 + 2) / 3))) | ((common >= 2) & (common * 2 >= words)))


def search(asked: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """The k best sections (``doc_id, section_id, title, start_line, end_line, name``) of each document for ``question_id, question``.

    asked may have ``doc_id`` (each asks one document) and ``_category, _source`` (of schema.question_category), which raise sections that fit.
    A section of at most three lines whose title mirrors the document's name counts a quarter, and a better other goes before it.
    """
    own = "doc_id" in asked.columns
    asked = asked.select("question_id", *[F.col("doc_id").alias("_d")] * own, *[F.col(x) for x in ("_category", "_source") if x in asked.columns], F.lower(F.trim("question")).alias("_q"), i.topic_terms(F.col("question")).alias("_terms"), F.array_join(t.tokens(F.col("question")), " ").alias("_words"))
    trap = (F.col("end_line") - F.col("start_line") <= TRAP_LINES) & mirrors_name(F.col("title"), F.col("name"))
    rows = sections.select("*", F.lower(strip(F.col("title"))).alias("_t"), i.with_numbers(F.array_distinct(t.tokens(F.col("title")))).alias("_tt"), F.array_join(t.tokens(F.col("title")), " ").alias("_tw"), trap.alias("trap"))
    c = F.col
    common = F.size(F.array_intersect("_terms", "_tt"))
    held = F.size(F.filter("_terms", lambda w: c("_t").contains(w)))
    extra = lambda test, w: F.when(test, w).otherwise(0.0)
    score = common + held + extra(c("_q").contains(c("_t")), 2.0) + extra((c("_tw") != "") & c("_words").contains(c("_tw")), 1.5) + extra((F.size("_tt") > 0) & (common == F.size("_tt")), 1.0)
    if "_category" in asked.columns:
        score = score + category_boost(c("_category"), c("_source"), c("_q"), c("title"), c("_tc"))
        rows = rows.withColumn("_tc", headings.category(F.col("title")))
    hit = (F.size("_terms") > 0) & (c("doc_id") == c("_d") if own else F.lit(True))
    found = against(asked, rows, hit & (score > 0)).withColumn("score", score * F.when(c("trap"), TRAP_FACTOR).otherwise(1.0))
    place = Window.partitionBy("question_id", "doc_id")
    order = place.orderBy(F.desc("score"), "start_line", "section_id")
    found = found.withColumn("_n", F.row_number().over(order))
    best = F.max(F.when(c("_n") == 1, c("trap"))).over(place)
    other = F.min(F.when(~c("trap") & (c("score") >= LEAST_OTHER), c("_n"))).over(place)
    found = found.withColumn("_n", F.when(best & (c("_n") == other), 0).otherwise(c("_n")))
    found = found.withColumn("rank", F.row_number().over(place.orderBy("_n"))).where(c("rank") <= k)
    return found.select("question_id", "doc_id", "rank", "section_id", "title", "score")


def expand(chunks: DataFrame) -> DataFrame:
    """Chunks with ``context, context_start, context_end``: a short chunk or heading joined with the one before and three after of its section."""
    order = Window.partitionBy("doc_id").orderBy("start_line", "chunk_id")
    near = F.collect_list(F.struct("section_id", "text", "start_line", "end_line")).over(order.rowsBetween(-1, 3))
    s = strip(F.col("text"))
    heading = s.startswith("#") | (~s.contains("\n") & (F.length(s) < 80) & (F.size(F.split(s, r"\s+")) <= 10) & s.rlike(r"^\p{Lu}"))
    short = (F.length(s) < SHORT) | (F.col("chunk_type") == "section") | heading
    mine = F.filter(near, lambda x: x["section_id"] == F.col("section_id"))
    rows = chunks.withColumn("_near", F.when(short, mine))
    wide = F.size("_near") > 1
    text = F.array_join(F.transform("_near", lambda x: x["text"]), "\n\n")
    edge = lambda column, pick: F.when(wide, pick(F.transform("_near", lambda x: x[column]))).otherwise(F.col(column))
    return rows.select(*chunks.columns, F.when(wide, text).otherwise(F.col("text")).alias("context"), edge("start_line", F.array_min).alias("context_start"), edge("end_line", F.array_max).alias("context_end"))


def boost(score: Column, title: Column, chunk_type: Column, terms: Column, intent: Column) -> Column:
    """Score of a chunk whose section title holds a query term: body text gains most, a bare heading loses when an explanation is asked."""
    hit = F.arrays_overlap(t.tokens(title), terms)
    raised = F.when(chunk_type.isin("paragraph", "overflow"), score * 1.35 * 1.2).when((chunk_type == "section") & (intent == "EXPLANATION_LOOKUP"), score * 0.92).otherwise(score * 1.35)
    return F.when(F.coalesce(hit, F.lit(False)) & (score > 0), raised).otherwise(score)


def category_boost(category: Column, source: Column, question: Column, title: Column, title_category: Column) -> Column:
    """What a section gains if it fits the category that a question asks for."""
    t_, label = F.lower(title), F.replace(category, F.lit("_"), F.lit(" "))
    design = category == "design_pattern"
    value = (
        F.when(title_category == category, 6.0).when((F.trim(F.lower(source)) == F.trim(t_)) & (F.trim(source) != ""), 6.0).when(t_.contains(label), 5.0)
        .when(design & t_.contains("design") & t_.contains("pattern"), 5.5).when(design & t_.contains("implementation") & t_.contains("pattern"), 4.5)
        .when(design & question.contains("design") & question.contains("pattern") & t_.contains("pattern"), 4.0)
    )
    return F.coalesce(value, F.lit(0.0))


def overlaps(start: Column, end: Column, section_start: Column, section_end: Column) -> Column:
    return (start <= section_end) & (end >= section_start)


def within(start: Column, end: Column, section_start: Column, section_end: Column) -> Column:
    return (start >= section_start) & (end <= section_end)


def semantic_heading(line: Column) -> Column:
    """A short line that names a category and is no sentence."""
    s = strip(line)
    return (s != "") & (F.length(s) <= 120) & ~F.lower(s).contains(" is ") & ~s.rlike(r"[.!?]$") & headings.category(s).isNotNull()


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Sections of documents whose headings weren't stored: the first lines of section chunks, and lines inside other chunks that name a category; the
    first of each title, all of level 1, each up to the next."""
    rows = chunks.select("doc_id", "chunk_type", "start_line", "end_line", F.posexplode(F.split("text", "\n")).alias("_i", "_l")).withColumn("title", strip(F.col("_l")))
    head = F.col("chunk_type") == "section"
    rows = rows.where((head & (F.col("_i") == 0) & (F.col("title") != "")) | (~head & semantic_heading(F.col("title")))).withColumn("_line", F.col("start_line") + F.col("_i"))
    first = Window.partitionBy("doc_id", F.lower("title")).orderBy((~head).cast("int"), "_line")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    last = F.max("end_line").over(Window.partitionBy("doc_id"))
    ends = chunks.select("doc_id", last.alias("_last")).distinct()
    named = F.when(head, structure.section_id(F.col("_line"), F.col("title"))).otherwise(F.concat(F.lit("derived-"), F.lpad(F.col("_line").cast("string"), 5, "0")))
    rows = rows.select("doc_id", named.alias("section_id"), "title", F.lit(1).alias("level"), F.col("_line").alias("start_line"))
    return ranged(rows, ends)


def ranged(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Sections (``doc_id, section_id, title, level, start_line``) with ends and parents, given each document's ``_last`` line."""
    keep = rows.select("doc_id", "start_line", F.col("section_id").alias("_own"))
    made = structure._ranged(rows.select("doc_id", "start_line", "title", "level"), ends).drop("section_id")
    ids = keep.select("doc_id", F.col("start_line").alias("_p"), F.col("_own").alias("parent"))
    made = made.join(keep, ["doc_id", "start_line"])
    parent = F.regexp_extract("parent_section_id", r"^sec-0*(\d+)", 1).cast("int")
    made = made.withColumn("_p", parent).join(ids, ["doc_id", "_p"], "left")
    return made.select("doc_id", F.col("_own").alias("section_id"), "title", "level", "start_line", "end_line", F.col("parent").alias("parent_section_id"))


def united(stored: DataFrame, derived: DataFrame, ends: DataFrame) -> DataFrame:
    """Stored sections and those derived whose title isn't among them (case and leading # apart), ranged anew."""
    key = F.lower(F.trim(F.regexp_replace("title", r"^#+\s*", "")))
    fresh = derived.withColumn("_k", key).join(stored.select("doc_id", key.alias("_k")).distinct(), ["doc_id", "_k"], "left_anti").drop("_k")
    cols = ("doc_id", "section_id", "title", "level", "start_line")
    return ranged(stored.select(*cols).unionByName(fresh.select(*cols)).dropDuplicates(["doc_id", "start_line"]), ends)


def collect(found: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """The chunks of each section in ``found`` (``doc_id, section_id, title, start_line, end_line`` and other columns): those inside it, else those that overlap it,
    the first ``most``. found's columns, with ``s_start, s_end`` for its lines, then the chunk's ``chunk_type, start_line, end_line, text`` and ``n``."""
    keys = [c for c in found.columns if c not in ("start_line", "end_line")]
    rows = found.select(*keys, F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end")).join(chunks.select("doc_id", "chunk_type", "start_line", "end_line", "text"), "doc_id")
    c = F.col
    rows = rows.where(overlaps(c("start_line"), c("end_line"), c("s_start"), c("s_end"))).withColumn("_in", within(c("start_line"), c("end_line"), c("s_start"), c("s_end")))
    each = [x for x in ("question_id", "doc_id", "section_id") if x in keys]
    rows = rows.withColumn("_any", F.max("_in").over(Window.partitionBy(*each))).where("_in or not _any")
    order = Window.partitionBy(*each).orderBy("start_line", "end_line", "text")
    return rows.withColumn("n", F.row_number().over(order)).where(c("n") <= most).drop("_in", "_any")


def results(found: DataFrame, chunks: DataFrame, terms: Column) -> DataFrame:
    """Chunks of sections as search results: the section's ``score`` and a bonus that falls with the place, and the terms that each holds."""
    rows = collect(found, chunks)
    bonus = F.greatest(F.lit(0.05), 0.5 - (F.col("n") - 1) * 0.02)
    return rows.withColumn("score", F.col("score") + bonus).withColumn("matched", F.array_sort(F.filter(terms, lambda w: F.lower("text").contains(w))))


def texts(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found with ``text``: up to 50 chunks of each section, clipped to it, joined by blank lines; null where it has none."""
    keys = [x for x in ("question_id", "doc_id", "section_id") if x in found.columns]
    rows = collect(found, chunks, 50).withColumn("_t", strip(structure.clip_to_section(F.col("text"), F.col("start_line"), F.col("s_start"), F.col("s_end")))).where("_t <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "_t"))), lambda x: x["_t"]), "\n\n")
    return found.join(rows.groupBy(*keys).agg(joined.alias("text")), keys, "left")


def lacks_body(text: Column, title: Column, name: Column) -> Column:
    """Whether a section's text says no more than its title, or than the document's name."""
    t_ = strip(F.coalesce(text, F.lit("")))
    lines = F.size(F.filter(F.split(t_, "\n"), lambda x: strip(x) != ""))
    return (t_ == "") | (F.lower(t_) == F.lower(strip(title))) | ((lines <= 2) & mirrors_name(title, name))


def by_title(found: DataFrame, title: str) -> DataFrame:
    """The first section of each document whose title is this or holds it."""
    want = title.strip().lower()
    order = Window.partitionBy("doc_id").orderBy("start_line")
    rows = found.where(F.lower(F.trim("title")).contains(want))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def by_category(found: DataFrame, category: str) -> DataFrame:
    return found.where(headings.category(F.col("title")) == category)


def sentences(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, n, sentence`` of each section of a tree: its sentences and list items in order."""
    blocks = nodes.where("node_type in ('paragraph', 'list_item')").select("doc_id", F.col("node_id").alias("_b"), F.col("parent_id").alias("_s"), "node_type", F.col("text").alias("_t"), F.col("ord").alias("_o"))
    items = blocks.where("node_type = 'list_item'").select("doc_id", F.col("_s").alias("node_id"), F.col("_o").alias("ord"), F.col("_t").alias("sentence"))
    own = nodes.where("node_type = 'sentence'").select("doc_id", F.col("parent_id").alias("_b"), "ord", F.col("text").alias("sentence"))
    own = own.join(blocks.where("node_type = 'paragraph'").select("doc_id", "_b", F.col("_s").alias("node_id")).dropDuplicates(["doc_id", "_b"]), ["doc_id", "_b"]).select("doc_id", "node_id", "ord", "sentence")
    return items.unionByName(own).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord"))).select("doc_id", "node_id", "n", "sentence")
