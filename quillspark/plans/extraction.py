"""Queries over grammars, validation, evidence, graph nodes, the second index and stored documents, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import evidence, layout, phrases
from quillspark.functions import intent as i
from quillspark.operators import extract, graph, index, schema, sections
from quillspark.plans.catalog import _ASK, _OUTLINE, _POST, QUESTIONS, _chunks, _questions, _table
from quillspark.plans.outline import _PLACED, _outline_parts

ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth")


def _ordinal_sentences(spark, sf_dir):
    """For each region its first six nations by name, as ordinal sentences, and one for its first architecture."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("k", F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_name"))).where("k <= 6")
    said = F.concat(F.lit("The "), F.element_at(F.array(*map(F.lit, ORDINALS)), F.col("k")), F.lit(" trading nation is the "), F.lower("n_name"), F.lit(" union, which trades."))
    return rows.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("nation").alias("category"), F.col("k").cast("long").alias("ord"), said.alias("sentence"), "r_name")


def schema_grammars(spark, sf_dir):
    rows = schema.grammars(_ordinal_sentences(spark, sf_dir))
    return rows.select("doc_id", "category", "pattern_name", "hits", "ordinals", F.array_join("type_phrases", ";").alias("type_phrases"), F.array_join("templates", ";").alias("templates"), F.round("confidence", 6).alias("confidence"), F.array_join("examples", ";").alias("examples"))


def grammar_entities(spark, sf_dir):
    said = _ordinal_sentences(spark, sf_dir)
    return extract.execute(schema.grammars(said), said).select("doc_id", "category", "rank", "ord", "entity")


def entity_validation(spark, sf_dir):
    """Each nation's entity as of its own category, and as one of another that the region's registry knows."""
    said = _ordinal_sentences(spark, sf_dir)
    patterns = schema.grammars(said)
    found = said.select("doc_id", "category", F.col("r_name").alias("source_section"), F.lit(0.9).alias("confidence")).distinct()
    registry = extract.known(schema.registry(found, patterns), patterns, said.select("doc_id", "ord", "sentence"))
    hits = extract.execute(patterns, said).join(said.select("doc_id", "ord", "r_name"), ["doc_id", "ord"])
    asked = F.explode(F.array(F.struct(F.lit("nation").alias("as"), F.col("r_name").alias("section")), F.struct(F.lit("nation").alias("as"), F.lit("Elsewhere").alias("section")), F.struct(F.lit("capability").alias("as"), F.lit("").alias("section"))))
    rows = extract.validate(hits.select("doc_id", "entity", "sentence", asked.alias("_a")).select("doc_id", F.col("_a.as").alias("category"), "entity", "sentence", "_a.section"), registry)
    return rows.select("doc_id", "category", "entity", "section", "reason")


def _numbered(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    text = F.array_join(F.transform("names", lambda x, k: F.concat((k + 1).cast("string"), F.lit(". the "), F.lower(x), F.lit(";"))), "\n")
    return rows.select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name", F.concat(text, F.lit("\nplain line\n- the "), F.element_at(F.transform("names", F.lower), 1)).alias("text"))


def listed_items(spark, sf_dir):
    """Lists of nations, found in text and answered."""
    rows = _numbered(spark, sf_dir)
    return rows.select("doc_id", evidence.listed_answer(F.lit("which different nations"), evidence.listed(F.col("text"))).alias("answer"))


def highlights(spark, sf_dir):
    """The words of every part's type, marked in its name and type."""
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", evidence.highlight(F.concat_ws(" ", "p_name", "p_type", F.lower("p_type")), F.split(F.lower("p_type"), " ")).alias("marked"))


def requirement_spans(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("It must deliver goods. "), "s_name", F.lit(" is defined as a supplier; it Shall be paid, 3 times.")).alias("text"))
    return s.select("s_suppkey", F.inline(evidence.requirement_spans(F.col("text")))).withColumnRenamed("end", "stop").withColumnRenamed("start", "begin")


def capitalised_phrases(spark, sf_dir):
    """Names of every two regions in a sentence."""
    a, b = (_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias(k), F.initcap("r_name").alias(f"{k}_name")) for k in "ab")
    said = F.concat(F.lit("we saw "), "a_name", F.lit(" and "), "b_name", F.lit(", but not "), "a_name", F.lit("."))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.array_join(phrases.capitalised(said), ";").alias("phrases"))


def layout_repair(spark, sf_dir):
    """A heading lost in each supplier's paragraph."""
    s = _table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", layout.repaired(F.concat("s_name", F.lit("  trades. Common capabilities The supplier\ttrades.\n\n\n\nLimitations  None "), "s_suppkey")).alias("text"))


def _built(spark, sf_dir):
    chunks, heads = _outline_parts(spark, sf_dir)
    docs = heads.select("doc_id", F.concat(F.lit("region-"), F.col("doc_id").cast("string")).alias("name")).distinct()
    said = _ordinal_sentences(spark, sf_dir)
    entities = extract.execute(schema.grammars(said), said).select("doc_id", F.lit("").alias("section"), F.lit("capability").alias("category"), F.col("entity").alias("value"))
    none = spark.createDataFrame([], "doc_id long, sentence string, subject string, relation string, object string")
    sentences = said.select("doc_id", F.col("r_name").alias("section"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat("r_name", F.lit(" uses trade lanes.")).alias("sentence")).distinct()
    found = schema.categories(heads).select("doc_id", "category", "source_section", "confidence")
    return graph.build(docs, heads.withColumn("doc_id", F.col("doc_id").cast("long")), found, entities, sentences, none)


def graph_nodes(spark, sf_dir):
    return _built(spark, sf_dir)[0].where("node_type in ('section', 'capability', 'entity', 'document')").select("doc_id", "node_id", "normalized", "node_type")


def category_matches(spark, sf_dir):
    """The capabilities of every region's graph, asked one by one."""
    nodes = _built(spark, sf_dir)[0]
    asked = nodes.select("doc_id").distinct().select(F.col("doc_id").cast("int").alias("question_id"), "doc_id", F.lit("capability").alias("category"))
    return graph.category_matches(asked, nodes, 10).select("question_id", "rank", "entity", "score")


def section_chunks(spark, sf_dir):
    """The chunks of every section of the outlines, first 20."""
    chunks, heads = _outline_parts(spark, sf_dir)
    return sections.collect(heads, chunks).select("doc_id", "section_id", "n", "start_line", "end_line", "chunk_type")


def second_index(spark, sf_dir):
    """Chunks that hold every term of a question, by stored postings and statistics of all chunks."""
    rows = index.second_search(index.postings(_chunks(spark, sf_dir)), _questions(spark))
    return rows.select("question_id", "rank", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


def question_targets(spark, sf_dir):
    """What the questions of the catalog ask for: lists, lineage, categories."""
    q = F.col("question")
    return _questions(spark).select("question_id", i.lists(q).alias("lists"), i.about_lineage(q).alias("lineage"), i.wants_sections(q).alias("sections"))


QUERIES = {
    f.__name__: f
    for f in (
        schema_grammars, grammar_entities, entity_validation, listed_items, highlights, requirement_spans, capitalised_phrases, layout_repair, graph_nodes, category_matches, section_chunks,
        second_index, question_targets,
    )
}

_SAID = f"""named as (select r_regionkey::bigint as doc_id, r_name, n_name, row_number() over (partition by r_regionkey order by n_name) as k from nation join region on n_regionkey = r_regionkey),
said as (select *, lower(n_name) || ' union' as e, 'The ' || ([{', '.join(f"'{x}'" for x in ORDINALS)}])[k] || ' trading nation is the ' || lower(n_name) || ' union, which trades.' as sentence from named where k <= 6),
ent as (select *, upper(left(e, 1)) || substr(e, 2) as entity from said)"""
_NODE = lambda kind, value: f"'node-' || substr(sha256({kind} || ':' || {value}), 1, 12)"

SQL = {
    "schema_grammars": f"""with {_SAID} select doc_id, 'nation' as category, 'ordinal_nation' as pattern_name, count(*) as hits, count(*) as ordinals, 'trading nation' as type_phrases,
string_agg('The ' || ([{', '.join(f"'{x}'" for x in ORDINALS)}])[k] || ' <CATEGORY> is <ENTITY>', ';' order by k) as templates, round(least(0.98, 0.55 + 0.17 * count(*)), 6)::double as confidence, string_agg(sentence, ';' order by k) filter (where k <= 5) as examples from said group by doc_id having count(*) >= 2""",
    "grammar_entities": f"with {_SAID} select doc_id, 'nation' as category, k::int as rank, k as ord, entity from ent",
    "entity_validation": f"""with {_SAID} select doc_id, 'nation' as category, entity, r_name as section, '' as reason from ent union all select doc_id, 'nation', entity, 'Elsewhere', 'section_scope_violation' from ent
union all select doc_id, 'capability', entity, '', 'conflicting_category_entity' from ent""",
    "listed_items": """with t as (select r_regionkey::bigint as doc_id, list(lower(n_name) order by n_name) as names from nation join region on n_regionkey = r_regionkey group by 1)
select doc_id, 'The document describes ' || len(names) || ' different items from the retrieved evidence:' || chr(10) || array_to_string(list_transform(names, lambda x: '- ' || x), chr(10)) as answer from t""",
    "highlights": """with t as (select p_partkey, p_name || ' ' || p_type || ' ' || lower(p_type) as text, list_distinct(string_split(lower(p_type), ' ')) as ws from part),
w as (select *, array_to_string(list_transform(list_sort(list_transform(ws, lambda x: [lpad((1000 - length(x))::varchar, 4, '0'), x])), lambda x: x[2]), '|') as form from t) select p_partkey, regexp_replace(text, '(?i)(' || form || ')', '[[\\1]]', 'g') as marked from w""",
    "requirement_spans": """with t as (select s_suppkey, 'It must deliver goods. ' || s_name || ' is defined as a supplier; it Shall be paid, 3 times.' as text from supplier)
select s_suppkey, label, span as text, (instr(t.text, span) - 1)::int as begin, (instr(t.text, span) - 1 + length(span))::int as stop from t, (values ('REQUIREMENT', 'must deliver goods'), ('DEFINITION', 'is defined as'), ('REQUIREMENT', 'Shall be paid')) v(label, span)""",
    "capitalised_phrases": """with n as (select r_regionkey as k, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') as name from region)
select x.k as a, y.k as b, x.name || ' and ' || y.name || ';' || x.name as phrases from n x join n y on x.k <> y.k""",
    "layout_repair": "select s_suppkey, s_name || ' trades.' || repeat(chr(10), 2) || 'Common capabilities' || repeat(chr(10), 2) || 'The supplier trades.' || repeat(chr(10), 2) || 'Limitations' || repeat(chr(10), 2) || 'None ' || s_suppkey as text from supplier",
    "graph_nodes": f"""with {_OUTLINE}, {_SAID}, a as (select doc_id::bigint as doc_id, 'section' as node_type, lower(case when line like '#%' then regexp_replace(line, '^#+ ', '') else line end) as v from ln where line like '#%' or line like '1.1 %'
  union select r_regionkey, 'document', 'region-' || r_regionkey from region union select doc_id, 'capability', lower(entity) from ent union select doc_id, 'entity', lower(r_name) from named union select doc_id, 'entity', 'trade lanes' from named)
select doc_id, {_NODE('node_type', 'v')} as node_id, v as normalized, node_type from a""",
    "category_matches": f"with {_SAID} select doc_id::int as question_id, row_number() over (partition by doc_id order by lower(entity))::int as rank, entity, 8.0::double as score from ent",
    "section_chunks": f"""with recursive {_PLACED}, near as (select sec.doc_id, sec.section_id, ck.start_line, ck.end_line, ck.chunk_type, ck.start_line >= sec.start_line and ck.end_line <= sec.end_line as inside from sec join ck on ck.doc_id = sec.doc_id and ck.start_line <= sec.end_line and ck.end_line >= sec.start_line),
held as (select *, max(inside::int) over (partition by doc_id, section_id) as any_inside from near), placed as (select *, row_number() over (partition by doc_id, section_id order by start_line, end_line) as n from held where inside or any_inside = 0)
select doc_id, section_id, n::int as n, start_line::int as start_line, end_line::int as end_line, chunk_type from placed where n <= 20""",
    "second_index": f"""with {_ASK}, {_POST}, l as (select doc_id, chunk_id, sum(tf) as dl from p group by 1, 2), w as (select count(*) as n, avg(dl) as avgdl from l), f as (select term, count(*) as df from p group by 1),
s as (select question_id, p.doc_id, p.chunk_id, round(sum((ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score, string_agg(term, ',' order by term) as matched, count(*) as m from p join f using (term) join l using (doc_id, chunk_id) join asked using (term), w group by 1, 2, 3),
a as (select question_id, count(*) as need from asked group by 1), r as (select s.*, row_number() over (partition by question_id order by score desc, doc_id, chunk_id)::int as "rank" from s join a using (question_id) where m = need and score > 0) select question_id, "rank", doc_id, chunk_id, round(score, 6) as score, matched from r where "rank" <= 10""",
    "question_targets": "with q(question_id, text) as (values " + ", ".join(f"({n}, '{q.replace(chr(39), chr(39) * 2)}')" for n, q in enumerate(QUESTIONS)) + f""") select question_id, regexp_matches(lower(trim(text)), '^(what are|list)|{"|".join(i.LISTED)}') as lists, contains(lower(text), 'lineage') and regexp_matches(lower(text), '{"|".join(i.LINEAGE_VERBS)}') as lineage,
  (case when regexp_matches(lower(text), '[a-z][a-z]+-[0-9]+|requirement|shall|must') then false else regexp_matches(lower(text), 'compare|difference between|vs\\.?|versus|^explain .|^describe .|^what does .* mean|^what is .|^define .|^meaning of .|list all|show all|where .*mentioned|find.* mentions?|where is') end) or regexp_matches(lower(text), '^(what are|list)|{"|".join(i.SECTION_PHRASES)}') as sections from q""",
}
