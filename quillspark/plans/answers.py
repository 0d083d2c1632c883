"""Queries over question graphs, graph answers, section search, schema and evaluation, and the SQL that must agree with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import intent as i
from quillspark.functions import text as t
from quillspark.operators import evaluate, graph, schema, sections, structure
from quillspark.plans.catalog import _ANY, _ENTITIES, _outline, _supply, _table
from quillspark.plans.outline import _CLEANED, _FOUND, _PLACED, _SECTIONS, _outline_parts

ASKED = (
    "What does Supplier#000000001 use?", "what does AFRICA contain", "What implements the ASIA?", "What is EUROPE?", "meaning of JAPAN", "What design patterns are mentioned?",
    "list all architectures", "help me", "where is FRANCE mentioned", "What does nothing here use?", "Explain \"the graph store\" and REQ-12", "", "what is ?", "List the different  capabilities",
)
#: Questions about every row of a table: its name column, and what is asked before and after the name.
ABOUT = (("supplier", "s_name", "What does the ", " use?"), ("part", "p_name", "explain a ", ", which is sold"), ("nation", "n_name", "what does ", " depend  on"), ("region", "r_name", "What implements ", "?"), ("part", "p_name", "Where is ", " mentioned?"), ("nation", "n_name", "meaning of (", ")"))
SOUGHT = ("list suppliers of JAPAN", "explain the FRANCE annex", "what are ASIA and EUROPE", "what is the of", "list architecure requirements of BRAZIL")


def _asked(spark):
    return i.graphs(spark.createDataFrame(list(enumerate(ASKED)), "question_id int, question string"))


def _graph(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    more = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat("n_name", F.lit(" implements "), "r_name", F.lit(".")).alias("sentence"))
    return graph.edges(graph.triples(_supply(spark, sf_dir).union(more)))


def question_graphs(spark, sf_dir):
    """Of literal questions and of questions about every supplier, part, nation and region."""
    about = [_table(spark, sf_dir, name).select(F.concat(F.lit(before), column, F.lit(after)).alias("question")) for name, column, before, after in ABOUT]
    rows = reduce(DataFrame.union, about, spark.createDataFrame([(q,) for q in ASKED], "question string")).distinct()
    return i.graphs(rows)


def graph_matches(spark, sf_dir):
    return graph.match(_asked(spark), _graph(spark, sf_dir)).select("question_id", "rank", "entity", "edge_id", "score")


def graph_definitions(spark, sf_dir):
    """What nations and regions are, among sentences that define nothing."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    told = F.array(*[F.concat(*x) for x in (("n_name", F.lit(" is a nation of "), "r_name", F.lit(", which is listed.")), (F.lit("The region "), "r_name", F.lit(" is the home of "), "n_name", F.lit(".")), ("n_name", F.lit(" is large.")), (F.lit("The first nation is "), "n_name", F.lit(".")))])
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.explode(told).alias("sentence"))
    return graph.edges(graph.triples(rows)).select("edge_id", "source", "relation", "target")


def graph_answers(spark, sf_dir):
    asked = _asked(spark)
    rows = graph.answers(asked, graph.match(asked, _graph(spark, sf_dir)))
    return rows.select("question_id", "confidence_score", "answer")


def section_search(spark, sf_dir):
    found = structure.sections(structure.lines(_outline(spark, sf_dir))).withColumn("name", F.concat(F.lit("region-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    asked = spark.createDataFrame(list(enumerate(SOUGHT)), "question_id int, question string")
    return sections.search(asked, found)


def schema_categories(spark, sf_dir):
    return schema.categories(structure.sections(structure.lines(_outline(spark, sf_dir))))


def schema_candidates(spark, sf_dir):
    """Every triple of the supply's sentences and of sentences that relate nations and regions in each way; the first word names the document."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    told = F.array(*[F.concat("n_name", F.lit(f" {name} "), x) for name, _ in schema.CANDIDATES for x in (F.concat("r_name", F.lit(".")), F.lit("it."))])
    rows = _supply(spark, sf_dir).union(n.join(r, n.n_regionkey == r.r_regionkey).select(F.explode(told)))
    return schema.candidates(rows.select(F.substring_index("sentence", " ", 1).alias("doc_id"), F.lit(0).alias("ord"), "sentence"))


def context_windows(spark, sf_dir):
    chunks, _ = _outline_parts(spark, sf_dir)
    rows = sections.expand(chunks.withColumn("chunk_id", F.col("start_line")))
    return rows.select("doc_id", "start_line", "context_start", "context_end", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


def evaluation_summary(spark, sf_dir):
    """A case for each nation: its supplier list must name the nation's region, and must not name another."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    cases = n.select(F.col("n_nationkey").alias("case_id"), F.when(F.col("n_nationkey") % 4 == 0, "NO_EVIDENCE").otherwise("EVIDENCE_ONLY").alias("mode"), F.array("n_name").alias("contains"), F.array(F.lit("ASIA")).alias("not_contains"))
    given = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("case_id"), F.lit("EVIDENCE_ONLY").alias("mode"), F.concat_ws(" ", F.lower("n_name"), "r_name").alias("text"))
    return evaluate.summary(evaluate.checks(cases, given))


QUERIES = {f.__name__: f for f in (question_graphs, graph_matches, graph_definitions, graph_answers, section_search, schema_categories, schema_candidates, context_windows, evaluation_summary)}

_V = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
_FORMS = [(f"^what\\s+does\\s+(.+?)\\s+{word}\\??\\s*$", "forward", name) for name, word in i.FORWARD] + [(f"^what\\s+{word}\\s+(.+?)\\??\\s*$", "reverse", name) for name, word in i.REVERSE] + [(p, "definition", "definition") for p in i.DEFINED]
_ROWS = f"asked(text) as (select distinct * from (values {', '.join(f'({_V(q)})' for q in ASKED)}) union " + " union ".join(f"select {_V(a)} || {column} || {_V(b)} from {name}" for name, column, a, b in ABOUT) + ")"
_INTENT = "case " + " ".join(f"when {_ANY(p)} then '{name}'" for name, p in i.INTENTS) + " else 'GENERAL_SEARCH' end"
#: g: the graph of each question of asked(text). The forms of a question give raw entities in order; the first plausible one counts.
_GRAPHS = f"""aq as (select text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as w, {_INTENT} as intent, {_ENTITIES} as es from asked),
fm as (select text, n, kind, relation, regexp_extract(w, '(?i)' || p, 1) as phrase from aq join (values {", ".join(f"({n}, {_V(p)}, '{kind}', '{name}')" for n, (p, kind, name) in enumerate(_FORMS))}) f(n, p, kind, relation) on regexp_matches(w, '(?i)' || p)
  union all select text, 100 + generate_subscripts(es, 1), 'definition', 'definition', unnest(es) from aq where intent in ({", ".join(f"'{x}'" for x in i.EXPANSION)})),
r as (select distinct phrase from fm), {_CLEANED},
ft as (select text, arg_min(struct_pack(kind := kind, entity := cleaned, relation := relation), n) as f from fm join cl using (phrase) where length(cleaned) between 2 and 120 and len(regexp_extract_all(cleaned, {_V(t.TOKEN)})) > 0 group by 1),
ct as (select aq.*, f, w = '' or regexp_matches(w, {_V("(?i)" + i.WEAK_QUESTION)}) as weak, case when regexp_matches(lower(w), 'what are|list|different|mentioned') then case {" ".join(f"when regexp_matches(lower(w), '{p}') then '{name}'" for p, name in i.NAMED_CATEGORIES)} end end as named from aq left join ft using (text)),
g as (select text as question, case when weak then 'generic' when f is not null then f.kind when named is not null then 'category' else 'generic' end as kind, case when not weak then f.entity end as entity,
  case when not weak then case when f is not null then f.relation when named is not null or intent in ('WHERE_MENTIONED', 'LIST_REQUEST') then 'mentions' end end as relation, case when not weak and f is null then named end as category from ct)"""
_G = f"ids(question_id, text) as (values {', '.join(f'({n}, {_V(q)})' for n, q in enumerate(ASKED))}), asked as (select text from ids), {_GRAPHS}, q as (select question_id, kind, entity, relation, category from g join ids on question = text)"
_FORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim({x})), '\\s+', ' ', 'g'), '[^\\pL\\pN_\\s-]+', '', 'g'))"
_NUM = lambda b: f"[{b}, case when {b} like '%s' and length({b}) > 3 then left({b}, length({b}) - 1) when not {b} like '%s' then {b} || 's' end, case when {b} like '%ies' and length({b}) > 4 then left({b}, length({b}) - 3) || 'y' when {b} like '%y' then left({b}, length({b}) - 1) || 'ies' end]"
_LABEL = lambda a, b: f"(case when {a} = '' or {b} = '' then 0 when {a} = {b} then 5 when contains({a}, {b}) or contains({b}, {a}) then 3 when list_has_any(list_filter({_NUM(a)}, lambda v: v is not null), {_NUM(b)}) then 5 else 0 end)"
_MATCH = f"""{_G}, raw as (select distinct s_name as s, 'uses' as relation, p_name as t, s_name || ' uses ' || p_name || '.' as sentence from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  union all select r_name, 'contains', n_name, r_name || ' contains ' || string_agg(n_name, ', ') over (partition by r_name order by n_name rows between unbounded preceding and unbounded following) || '.' from nation join region on n_regionkey = r_regionkey
  union all select n_name, 'implements', r_name, n_name || ' implements ' || r_name || '.' from nation join region on n_regionkey = r_regionkey),
e as (select lower(trim(s)) as source, relation, lower(trim(t)) as target, min(sentence) as sentence from raw group by 1, 2, 3),
ee as (select *, 'edge-' || substr(sha256(source || '|' || relation || '|' || target), 1, 12) as edge_id, {_FORM('source')} as sf, {_FORM('target')} as tf from e), qq as (select *, {_FORM('entity')} as qf from q),
fr as (select question_id, target as entity, edge_id, {_LABEL('qf', 'sf')} as ls, sentence from qq join ee on kind = 'forward' and qq.relation = ee.relation union all select question_id, source, edge_id, {_LABEL('qf', 'tf')}, sentence from qq join ee on kind = 'reverse' and qq.relation = ee.relation),
nd as (select distinct unnest([source, target]) as entity from e), sd as (select question_id, entity, {_LABEL('qf', _FORM('nd.entity'))} as ls from qq cross join (select entity from nd) nd(entity) where kind = 'definition'),
al as (select question_id, entity, edge_id, ls + 6 as score, sentence from fr where ls > 0 union all select question_id, entity, '', ls + 5, '' from (select *, row_number() over (partition by question_id order by ls desc, entity) as k from sd where ls > 0) where k = 1),
rk as (select *, row_number() over (partition by question_id order by score desc, sentence, lower(entity)) as "rank" from al), mt as (select * from rk where "rank" <= 5)""".replace("sd as (select question_id, entity,", "sd as (select question_id, nd.entity,")
_TOK = lambda x: f"list_transform(regexp_extract_all({x}, '[A-Za-z]{{2,}}-\\d+|[A-Za-z]{{2,}}\\d+[A-Za-z0-9]*|\\d+(?:\\.\\d+)?|[A-Za-z]+'), lambda w: lower(w))"
_SOUGHT = ", ".join(f"({n}, {_V(q.lower())})" for n, q in enumerate(SOUGHT))
_SPELL = lambda w: f"coalesce({', '.join(f'case when {w} = {_V(a)} then {_V(b)} end' for a, b in i.SPELLING.items())}, {w})"
_OTHER = "[" + ", ".join(f"{{'a': {_V(a)}, 'b': {_V(b)}}}" for x, y in i.NUMBER_PAIRS for a, b in ((x, y), (y, x))) + "]"
_TERMS = f"""t0 as (select question_id, q, list_transform(list_filter(list_distinct({_TOK('q')}), lambda w: w not in ({', '.join(map(_V, i.TOPIC_WEAK))})), lambda w: {_SPELL('w')}) as r from asked),
q as (select question_id, q, list_distinct(list_concat(r, list_transform(list_filter({_OTHER}, lambda x: list_contains(r, x.a)), lambda x: x.b))) as ts from t0)"""

SQL = {
    "question_graphs": f"with {_ROWS}, {_GRAPHS} select question, kind, entity, relation, category from g",
    "graph_matches": f'with {_MATCH} select question_id::int as question_id, "rank"::int as "rank", entity, edge_id, score::double as score from mt',
    "graph_definitions": """with g as (select lower(n_name) as source, 'nation of ' || lower(r_name) as target from nation join region on n_regionkey = r_regionkey union select 'region ' || lower(r_name), 'home of ' || lower(n_name) from nation join region on n_regionkey = r_regionkey)
select 'edge-' || substr(sha256(source || '|is_a|' || target), 1, 12) as edge_id, source, 'is_a' as relation, target from g""",
    "graph_answers": f"""with {_MATCH}, a as (select question_id, max(score)::double as confidence_score from mt group by 1),
es as (select question_id, list(entity order by k) as es from (select question_id, entity, min("rank") as k from mt group by 1, 2) group by 1),
ss as (select question_id, list('- ' || sentence order by k) as ss from (select question_id, sentence, min("rank") as k from mt where sentence <> '' group by 1, 2) group by 1)
select question_id::int as question_id, confidence_score, case when kind = 'reverse' then 'The following items implement ' || entity || ':' else entity || ' ' || relation || ':' end || chr(10) || array_to_string(list_transform(es[:10], lambda x, n: n || '. ' || x), chr(10))
  || coalesce(chr(10) || chr(10) || 'Supporting source sentences:' || chr(10) || array_to_string(ss[:6], chr(10)), '') as answer from a join es using (question_id) left join ss using (question_id) join q using (question_id) where confidence_score >= 8""",
    "section_search": f"""with {_SECTIONS}, asked(question_id, q) as (values {_SOUGHT}), {_TERMS}, c as (select question_id, doc_id, section_id, title, start_line, lower(title) as t, {_TOK('title')} as tw, q, {_TOK('q')} as qw, ts from q cross join sec),
s as (select *, (len(list_intersect(ts, list_distinct(tw))) + len(list_filter(ts, lambda x: contains(t, x))) + case when contains(q, t) then 2 else 0 end + case when len(tw) > 0 and contains(array_to_string(qw, ' '), array_to_string(tw, ' ')) then 1.5 else 0 end
  + case when len(tw) > 0 and len(list_intersect(ts, list_distinct(tw))) = len(list_distinct(tw)) then 1 else 0 end)::double as score from c where len(ts) > 0),
r as (select *, row_number() over (partition by question_id, doc_id order by score desc, start_line, section_id) as "rank" from s where score > 0) select question_id::int as question_id, doc_id, "rank"::int as "rank", section_id, title, score from r where "rank" <= 3""",
    "schema_categories": f"with {_SECTIONS}, {_FOUND} select doc_id, category, source_section, confidence from found",
    "schema_candidates": f"""with told as (select distinct s_name as s, 'uses' as relation, p_name as o, p_name as said from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  union all select r_name, 'contains', min(n_name), string_agg(n_name, ', ' order by n_name) from nation join region on n_regionkey = r_regionkey group by 1
  union all select n_name, relation, r_name, r_name from nation join region on n_regionkey = r_regionkey cross join (values {", ".join(f"('{name}')" for name, _ in schema.CANDIDATES)}) w(relation))
select distinct split_part(s, ' ', 1) as doc_id, s as subject, relation, upper(left(o, 1)) || substr(o, 2) as object, s || ' ' || relation || ' ' || said || '.' as sentence from told where length(said) between 3 and 80 and length(o) >= 3""",
    "context_windows": f"""with recursive {_PLACED}, ordered as (select *, row_number() over (partition by doc_id order by start_line) as k from cs),
x as (select a.doc_id, a.start_line, a.text, length(a.text) < 120 or a.chunk_type = 'section' as short, min(b.start_line) as s, max(b.end_line) as e, string_agg(b.text, chr(10) || chr(10) order by b.k) as wide, max(a.end_line) as own from ordered a join ordered b on a.doc_id = b.doc_id and a.section_id = b.section_id and b.k between a.k - 1 and a.k + 3 group by 1, 2, 3, 4)
select doc_id, start_line::int as start_line, (case when short then s else start_line end)::int as context_start, (case when short then e else own end)::int as context_end, sha256(case when short then wide else text end) as context_sha256 from x""",
    "evaluation_summary": """with c as (select n_nationkey % 4 <> 0 as m, r_name = 'ASIA' as bad from nation join region on n_regionkey = r_regionkey)
select count(*) as total_cases, count(*) filter (m and not bad) as passed_cases, avg(m::int)::double as answer_mode_accuracy, 1.0::double as contains_pass_rate, count(*) filter (bad) as not_contains_violations from c""",
}
