"""A knowledge graph from sentences (``sentence``): relation triples, nodes, edges, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import phrases, text

# Relation and the words that state it, in order.
RELATIONS = (("uses", "uses"), ("contains", "contains"), ("includes", "includes"), ("depends_on", r"depends\s+on"), ("refers_to", r"refers\s+to"), ("links_to", r"links\s+to"), ("implements", "implements"), ("contains", r"consists\s+of"), ("is_a", r"is(?:\s+the)?"))
SPLIT = ("contains", "includes")
# What is no "is a": an ordinal's sentence, and objects of one or two words with such an adjective.
ORDINAL_IS = r"(?i)(?:the\s+)?(?:first|second|third|fourth|fifth|sixth)\s+.+?\s+is\s+"
ADJECTIVES = ("nice", "good", "bad", "warm", "cold", "hot", "new", "old", "large", "small", "high", "low")


def label(value: Column) -> Column:
    """Normalised form of a node's label."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def edge_id(subject: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("edge-"), F.substring(F.sha2(F.concat_ws("|", subject, relation, target).cast("binary"), 256), 1, 12))


def _stated(name: str, words: str) -> Column:
    """The triples of one relation in a sentence, none if it isn't stated."""
    p = rf"(?i)^(.{{3,80}}?)\s+{words}\s+(.+?)(?:[.!?]|$)"
    subject, target = phrases.bare(F.regexp_extract("sentence", p, 1)), F.regexp_extract("sentence", p, 2)
    parts = F.split(target, r"(?i),|\band\b") if name in SPLIT else F.array(target)
    made = F.transform(parts, lambda x: F.struct(subject.alias("subject"), F.lit(name).alias("relation"), phrases.bare(x).alias("object")))
    return F.when(F.col("sentence").rlike(p), made).otherwise(F.array().cast("array<struct<subject:string,relation:string,object:string>>"))


def triples(sentences: DataFrame) -> DataFrame:
    """``subject, relation, object, sentence``, phrases cleaned in the case they have; lists after contains and includes are one triple for each part."""
    found = F.array(*[_stated(name, words) for name, words in RELATIONS])
    sentences = sentences.select(F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("sentence"))
    return _kept(sentences.select("sentence", F.inline(F.flatten(found))).select("subject", "relation", "object", "sentence"))


def _kept(rows: DataFrame) -> DataFrame:
    """Triples whose ends are in the sentence, without vague "is a" statements."""
    rows = rows.where(phrases.valid_endpoint(F.col("subject"), F.col("sentence")) & phrases.valid_endpoint(F.col("object"), F.col("sentence")))
    words = F.split(F.lower("object"), " ")
    short = (F.size(words) <= 2) & F.arrays_overlap(words, F.array(*map(F.lit, ADJECTIVES)))
    vague = F.col("sentence").rlike(ORDINAL_IS) | F.lower("object").contains(" and ") | (F.length("object") > 60) | short
    return rows.where((F.col("relation") != "is_a") | ~vague)


def edges(rows: DataFrame) -> DataFrame:
    """One edge for each (subject, relation, object) by normalised label, with the least sentence: ``edge_id, source, relation, target, sentence``."""
    rows = rows.select(label(F.col("subject")).alias("source"), "relation", label(F.col("object")).alias("target"), "sentence")
    rows = rows.groupBy("source", "relation", "target").agg(F.min("sentence").alias("sentence"))
    return rows.select(edge_id(F.col("source"), F.col("relation"), F.col("target")).alias("edge_id"), "source", "relation", "target", "sentence")


def neighbours(graph: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within depth outgoing edges of each seed (``seed``): ``seed, node, distance``. Each level is one join and one distinct."""
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"))
    front = reached
    for d in range(1, depth + 1):
        step = front.join(graph.select(F.col("source").alias("node"), "target").distinct(), "node").select("seed", F.col("target").alias("node")).distinct()
        front = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(front)
    return reached


# Relations that define, their words, and the scores of a match.
DEFINING = ("definition", "is_a", "refers_to", "mentions", "links_to")
SHOWN = {"depends_on": "depends on", "refers_to": "refers to", "links_to": "links to", "is_a": "is"}
EXACT, PART, RELATION, LEAST_ANSWER = 5.0, 3.0, 5.0, 8.0
#: Questions in one broadcast; larger batches are joined block by block.
BLOCK = 10_000


def match_form(value: Column) -> Column:
    return F.trim(F.regexp_replace(label(value), r"[^\p{L}\p{N}_\s-]+", ""))


def _numbers(base: Column) -> Column:
    short = lambda k: F.substring(base, F.lit(1), F.length(base) - k)
    s = F.when(base.endswith("s") & (F.length(base) > 3), short(1)).when(~base.endswith("s"), F.concat(base, F.lit("s")))
    y = F.when(base.endswith("ies") & (F.length(base) > 4), F.concat(short(3), F.lit("y"))).when(base.endswith("y"), F.concat(short(1), F.lit("ies")))
    return F.array_compact(F.array(base, s, y))


def label_score(asked: Column, found: Column) -> Column:
    """Of two labels in match form: 5 if equal or the same but for number, 3 if one holds the other, else 0."""
    some = (asked != "") & (found != "")
    held = asked.contains(found) | found.contains(asked)
    return F.when(~some, 0.0).when(asked == found, EXACT).when(held, PART).when(F.arrays_overlap(_numbers(asked), _numbers(found)), EXACT).otherwise(0.0)


def against(asked: DataFrame, rows: DataFrame, on: Column, count: int | None = None) -> DataFrame:
    """A stated batch of questions against all rows, in broadcast blocks of about BLOCK questions. count: their number, if it is known."""
    n = max(1, -(-(asked.count() if count is None else count) // BLOCK))
    block = F.pmod(F.xxhash64("question_id"), F.lit(n))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(asked.where(block == k) if n > 1 else asked), on) for k in range(n)])


def _formed(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows with the match form of a label and its numbers, computed once for each row (a generator keeps them from being computed in the join)."""
    return rows.withColumn("_x", F.explode(F.array(F.struct(match_form(F.col(column)).alias("form"))))).select(*rows.columns, F.col("_x.form").alias(f"{prefix}form")).withColumn(f"{prefix}numbers", _numbers(F.col(f"{prefix}form")))


def _agrees(a: str, b: str) -> Column:
    """label_score of labels formed before."""
    c = F.col
    some = (c(f"{a}form") != "") & (c(f"{b}form") != "")
    held = c(f"{a}form").contains(c(f"{b}form")) | c(f"{b}form").contains(c(f"{a}form"))
    return F.when(~some, 0.0).when(c(f"{a}form") == c(f"{b}form"), EXACT).when(held, PART).when(F.arrays_overlap(f"{a}numbers", f"{b}numbers"), EXACT).otherwise(0.0)


def match(asked: DataFrame, graph: DataFrame, k: int = 5) -> DataFrame:
    """The k best matches of questions (``question_id, kind, entity, relation``, and ``doc_id`` if each asks one document's graph) in edges: ``question_id, rank, entity, edge_id, score, sentence``.

    Forward and definition questions match the source and answer the target, reverse ones the other way round. A
    definition without an edge that defines it answers the best node. Ties go to the smaller sentence, then entity. Relations join by equality;
    only edges of an asked relation meet a question's label, whose form is computed once.
    """
    c, by = F.col, ["doc_id"] if "doc_id" in asked.columns else []
    asked = asked.where("kind in ('forward', 'reverse', 'definition')").select("question_id", "kind", *[c(x).alias(f"_{x}") for x in by], F.col("relation").alias("_r"), "entity")
    asked = _formed(asked, "entity", "_q").drop("entity")
    near = [c(x).eqNullSafe(c(f"_{x}")) for x in by]
    count = asked.count()
    wanted = asked.withColumn("_rel", F.explode(F.when(c("kind") == "definition", F.array(*map(F.lit, DEFINING))).otherwise(F.array("_r")))).withColumn("_back", c("kind") == "reverse")
    score = _agrees("_q", "_e")
    side = lambda back, end, other: F.struct(F.lit(back).alias("_end_is_target"), c(end).alias("_end"), c(other).alias("_other"))
    ends = graph.where(c("relation").isNotNull()).select(*by, "edge_id", "relation", "sentence", F.inline(F.array(side(False, "source", "target"), side(True, "target", "source"))))
    bonus = F.when(F.coalesce("sentence", F.lit("")) != "", 1.0).otherwise(0.0)
    on = reduce(lambda x, y: x & y, [c("relation") == c("_rel"), c("_end_is_target") == c("_back"), score > 0, *near])
    found = against(wanted, _formed(ends, "_end", "_e"), on, count).select("question_id", c("_other").alias("entity"), "edge_id", (score + RELATION + bonus).alias("score"), "sentence")
    nodes = graph.select(*by, F.explode(F.array("source", "target")).alias("entity")).distinct()
    lone = asked.where("kind = 'definition'").join(found.select("question_id").distinct(), "question_id", "left_anti")
    seeds = against(lone, _formed(nodes, "entity", "_e"), reduce(lambda x, y: x & y, [score > 0, *near]), count).groupBy("question_id").agg(F.min(F.struct((-score).alias("s"), "entity")).alias("_b"))
    seeds = seeds.select("question_id", "_b.entity", F.lit("").alias("edge_id"), (EXACT - c("_b.s")).alias("score"), F.lit("").alias("sentence"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "sentence", F.lower("entity"))
    both = found.unionByName(seeds).dropDuplicates(["question_id", "entity", "edge_id"])
    return both.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def answers(asked: DataFrame, matches: DataFrame, items: int = 10) -> DataFrame:
    """``question_id, answer, confidence_score`` where the best match reaches LEAST_ANSWER: a numbered list of distinct entities and up to six sentences."""
    first = lambda column: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", column))), lambda x: x[column]))
    rows = matches.groupBy("question_id").agg(F.max("score").alias("confidence_score"), first("entity").alias("_e"), first("sentence").alias("_s")).where(F.col("confidence_score") >= LEAST_ANSWER)
    rows = rows.join(asked.select("question_id", "kind", F.col("entity").alias("_q"), F.col("relation").alias("_r")), "question_id")
    said = F.coalesce(*[F.when(F.col("_r") == a, b) for a, b in SHOWN.items()], "_r")
    intro = F.when(F.col("kind") == "reverse", F.concat(F.lit("The following items implement "), "_q", F.lit(":"))).otherwise(F.concat("_q", F.lit(" "), said, F.lit(":")))
    body = F.array_join(F.transform(F.slice("_e", 1, items), lambda e, n: F.concat((n + 1).cast("string"), F.lit(". "), e)), "\n")
    told = F.slice(F.filter("_s", lambda x: x != ""), 1, 6)
    proof = F.when(F.size(told) > 0, F.concat(F.lit("\n\nSupporting source sentences:\n"), F.array_join(F.transform(told, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return rows.select("question_id", F.concat(intro, F.lit("\n"), body, proof).alias("answer"), "confidence_score")


# The kind of node that holds a category's entities, and the kinds that answer a question for one.
NODE_TYPES = (("architecture", "architecture"), ("design_pattern", "pattern"), ("pattern", "pattern"), ("capability", "capability"), ("requirement", "requirement"), ("tool", "tool"), ("building_block", "tool"))
ANSWERING = (("architecture", ("architecture", "entity")), ("design_pattern", ("pattern", "entity")), ("pattern", ("pattern", "entity")), ("capability", ("capability", "entity")), ("requirement", ("requirement", "entity")), ("tool", ("tool", "entity", "building_block")))
CATEGORY_TYPE, SECTION_BONUS = 3.0, 1.0


def node_type(category: Column) -> Column:
    return reduce(lambda rest, x: F.when(F.lower(F.trim(category)) == x[0], x[1]).otherwise(rest), reversed(NODE_TYPES), F.lit("entity"))


def node_id(value: Column, kind: Column) -> Column:
    return F.concat(F.lit("node-"), F.substring(F.sha2(F.concat_ws(":", kind, label(value)).cast("binary"), 256), 1, 12))


def build(documents: DataFrame, sections: DataFrame, found: DataFrame, entities: DataFrame, said: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``doc_id, node_id, label, normalized, node_type, section, start_line, end_line, category`` and edges ``doc_id, edge_id, source, relation, target, sentence, section, confidence``.

    documents: ``doc_id, name``; sections; found: categories; entities: ``doc_id, section, category, value``; said: ``doc_id, section, start_line, end_line, sentence``;
    candidates: triples of the schema. A document contains its sections, a section its entities and mentions the categories that it names; sentences
    and candidates give relations between entities. Of nodes with one type and label, and edges with one id, the first in this order stays.
    """
    c, none = F.col, F.lit(None)
    node = lambda rank, value, kind, section=None, a=None, b=None, category=None: F.struct(F.lit(rank).alias("_o"), value.alias("label"), (F.lit(kind) if isinstance(kind, str) else kind).alias("node_type"), (none.cast("string") if section is None else section).alias("section"), (none.cast("int") if a is None else a.cast("int")).alias("start_line"), (none.cast("int") if b is None else b.cast("int")).alias("end_line"), (none.cast("string") if category is None else category).alias("category"))
    told = [said.select("doc_id", "section", "start_line", "end_line", F.inline(F.flatten(F.array(*[_stated(name, words) for name, words in RELATIONS]))), "sentence")]
    told = [_kept(told[0]), candidates.select("doc_id", F.lit("").alias("section"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "subject", F.replace("relation", F.lit(" "), F.lit("_")).alias("relation"), "object", "sentence")]
    told = told[0].withColumn("_o", F.lit(0)).unionByName(told[1].withColumn("_o", F.lit(1)))
    named = [
        documents.select("doc_id", node(0, c("name"), "document").alias("_n")), sections.select("doc_id", node(1, c("title"), "section", c("title"), c("start_line"), c("end_line")).alias("_n")),
        entities.select("doc_id", node(2, c("value"), node_type(c("category")), c("section"), category=c("category")).alias("_n")),
        told.select("doc_id", F.explode(F.array(*[node(3, c(x), "entity", c("section"), c("start_line"), c("end_line")) for x in ("subject", "object")])).alias("_n")),
        found.select("doc_id", node(4, F.replace("category", F.lit("_"), F.lit(" ")), "concept", c("source_section"), category=c("category")).alias("_n")),
    ]
    nodes = reduce(DataFrame.unionByName, named).select("doc_id", "_n.*").where(F.trim("label") != "").withColumn("normalized", label(c("label")))
    first = F.min(F.struct("_o", "start_line", "section", "label", "end_line", "category")).alias("_f")
    nodes = nodes.groupBy("doc_id", "node_type", "normalized").agg(first).select("doc_id", node_id(c("normalized"), c("node_type")).alias("node_id"), "_f.label", "normalized", "node_type", "_f.section", "_f.start_line", "_f.end_line", "_f.category")
    edge = lambda source, relation, target, section, sure, sentence=F.lit(""): ("doc_id", source.alias("source"), relation.alias("relation"), target.alias("target"), sentence.alias("sentence"), section.alias("section"), sure.cast("double").alias("confidence"))
    mentions = found.select("doc_id", "category", "source_section", "confidence").join(sections.select("doc_id", "title"), "doc_id").where(F.lower("title").contains(F.lower("source_section")))
    links = [
        sections.join(documents.select("doc_id", "name"), "doc_id").select(*edge(c("name"), F.lit("contains"), c("title"), c("title"), F.lit(0.95))),
        entities.select(*edge(c("section"), F.lit("contains"), c("value"), c("section"), F.lit(0.9))),
        told.select(*edge(c("subject"), c("relation"), c("object"), c("section"), F.lit(0.85), c("sentence"))),
        mentions.select(*edge(c("title"), F.lit("mentions"), F.replace("category", F.lit("_"), F.lit(" ")), c("source_section"), c("confidence"))),
    ]
    links = reduce(DataFrame.unionByName, [x.withColumn("_o", F.lit(n)) for n, x in enumerate(links)])
    key = ["doc_id", "source", "relation", "target"]
    links = links.withColumn("source", label(c("source"))).withColumn("target", label(c("target"))).groupBy(*key).agg(F.min(F.struct("_o", "sentence", "section", "confidence")).alias("_f"))
    return nodes, links.select("doc_id", edge_id(c("source"), c("relation"), c("target")).alias("edge_id"), "source", "relation", "target", "_f.sentence", "_f.section", "_f.confidence")


def by_label(nodes: DataFrame, value: str) -> DataFrame:
    """Nodes whose label is this, whatever its case and blanks."""
    return nodes.where(F.col("normalized") == label(F.lit(value)))


def by_relation(rows: DataFrame, relation: str) -> DataFrame:
    return rows.where(F.col("relation") == F.replace(F.lower(F.trim(F.lit(relation))), F.lit(" "), F.lit("_")))


def category_matches(asked: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k best nodes for questions (``question_id, category``, and ``doc_id`` if each asks one document): ``question_id, rank, entity, node_id, score``.

    A node answers if its type is one of the category's and its category, label or type says so. Ties go to the lower label.
    """
    c = F.col
    asked = asked.where("category is not null").select("question_id", *[c(x).alias("_d") for x in asked.columns if x == "doc_id"], F.replace(F.lower("category"), F.lit("-"), F.lit("_")).alias("_c"))
    allowed = reduce(lambda rest, x: F.when(c("_c") == x[0], F.array(*map(F.lit, x[1]))).otherwise(rest), ANSWERING, F.array(c("_c"), F.lit("entity")))
    words = F.replace("_c", F.lit("_"), F.lit(" "))
    own = F.coalesce(F.lower(c("category")).contains(c("_c")), F.lit(False))
    said = F.when(c("_c") == "design_pattern", c("normalized").contains("pattern")).otherwise(c("normalized").contains(words) | words.contains(c("normalized")) | (c("node_type") == c("_c")))
    fits = F.array_contains(allowed, c("node_type")) & ~c("node_type").isin("document", "section", "concept") & (own | said)
    if "_d" in asked.columns:
        fits &= c("doc_id") == c("_d")
    rows = against(asked, nodes, fits).withColumn("score", CATEGORY_TYPE + EXACT + F.when(F.coalesce("section", F.lit("")) != "", SECTION_BONUS).otherwise(0.0))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.lower("label"), "node_id")
    one = rows.dropDuplicates(["question_id", "normalized"])
    return one.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select("question_id", "rank", c("label").alias("entity"), "node_id", "score")


def category_answer(category: Column, entities: Column) -> Column:
    name = F.replace(category, F.lit("_"), F.lit(" "))
    head = F.when(F.size(entities) == 1, F.concat(F.lit("The document mentions this "), name, F.lit(":"))).otherwise(F.concat(F.lit("The document mentions these "), name, F.lit(" items:")))
    return F.concat(head, F.lit("\n"), F.array_join(F.transform(entities, lambda e, n: F.concat((n + 1).cast("string"), F.lit(". "), e)), "\n"))


def cards(matches: DataFrame, name: Column, most: int = 3) -> DataFrame:
    """Up to ``most`` cards of a question's matches, one for each sentence: ``question_id, n, citation, snippet, score, confidence``."""
    rows = matches.where(F.coalesce("sentence", F.lit("")) != "").withColumn("_k", F.row_number().over(Window.partitionBy("question_id", F.lower(F.trim("sentence"))).orderBy("rank"))).where("_k = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("n") <= most)
    return rows.select("question_id", "n", text.citation(name, F.lit(0), F.lit(0), F.lit(None).cast("string")).alias("citation"), F.col("sentence").alias("snippet"), "score", text.confidence(F.col("score"), F.lit(1)).alias("confidence"))
