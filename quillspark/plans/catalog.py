"""The engine's own queries, each over its whole tables, and the SQL that must agree with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import intent as i
from quillspark.functions import text as t
from quillspark.operators import graph, index, structure

QUESTIONS = (
    "what is anat?", "Explain the reores of thnt", "difference between alpha and beta", "list all tables", "REQ-001 must hold", "where is lineage mentioned?", "what does \"the tionst\" mean?",
    "show the row of thand", "stst oner and edly", "the and of", "compare nterti and ouen", "define 'hein'", "reatti reatti was ble", "describe ISO27001", "find mentions of scope", "in which column is 3.5?",
)
_VALUES = ", ".join(f"({n}, '{q.replace(chr(39), chr(39) * 2)}')" for n, q in enumerate(QUESTIONS))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer partitions than there are cores are spread first, which never happens to a large table."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a chunk."""
    rows = structure.lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_no").alias("chunk_id"), F.col("line").alias("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region: its heading, numbered nations, a blank line and a line for each supplier."""
    r, n, s = (_table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    nation = n.join(r, n.n_regionkey == r.r_regionkey).select("r_regionkey", "n_nationkey", "n_name")
    parts = [
        r.select(F.col("r_regionkey").alias("doc_id"), F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("# "), "r_name").alias("line")),
        nation.select("r_regionkey", "n_nationkey", F.lit(0), F.lit(0).cast("long"), F.concat(F.lit("## "), "n_name")),
        nation.select("r_regionkey", "n_nationkey", F.lit(1), F.lit(0).cast("long"), F.lit("")),
        nation.join(s, F.col("n_nationkey") == F.col("s_nationkey")).select("r_regionkey", "n_nationkey", F.lit(2), "s_suppkey", F.concat("s_name", F.lit(" trades here."))),
        nation.select("r_regionkey", "n_nationkey", F.lit(3), F.lit(0).cast("long"), F.concat(F.lit("1.1 "), "n_name", F.lit(" annex"))),
    ]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "c", "line"))), lambda x: x["line"]), "\n")
    return reduce(DataFrame.union, parts).groupBy("doc_id").agg(text.alias("text"))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences: suppliers use parts; regions contain their nations."""
    line, s, p, n, r = (_table(spark, sf_dir, x) for x in ("lineitem", "supplier", "part", "nation", "region"))
    uses = line.select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    holds = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))
    return uses.select(F.concat("s_name", F.lit(" uses "), "p_name", F.lit(".")).alias("sentence")).union(holds.select(F.concat("r_name", F.lit(" contains "), "names", F.lit("."))))


def document_checksums(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.octet_length("text").cast("long").alias("size_bytes"))


def distinct_documents(spark, sf_dir):
    """Of documents with one checksum the first is stored."""
    return document_checksums(spark, sf_dir).groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def tokenize(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " ").cast("binary"), 256).alias("normalized"))


def postings(spark, sf_dir):
    rows = index.postings(_chunks(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def term_statistics(spark, sf_dir):
    rows = index.term_statistics(index.postings(_chunks(spark, sf_dir)))
    return rows.select("doc_id", "term", "df", "n", F.round("idf", 6).alias("idf"))


def bm25_search(spark, sf_dir):
    rows = index.search(_chunks(spark, sf_dir), _questions(spark))
    return rows.select("question_id", "rank", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


def evidence_cards(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    rows = index.evidence(index.search(chunks, _questions(spark)), chunks)
    return rows.select("question_id", "rank", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "confidence", "citation", F.sha2(F.col("snippet").cast("binary"), 256).alias("snippet_sha256"))


def sentences(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("ord", "sentence"))
    return d.select("doc_id", F.col("ord").cast("long").alias("ord"), F.sha2(F.col("sentence").cast("binary"), 256).alias("sentence_sha256"))


def question_intents(spark, sf_dir):
    q = _questions(spark)
    return q.select("question_id", i.intent(F.col("question")).alias("intent"), F.array_join(t.search_terms(F.col("question")), " ").alias("terms"))


def question_entities(spark, sf_dir):
    return _questions(spark).select("question_id", F.array_join(i.entities(F.col("question")), "; ").alias("entities"))


def section_tree(spark, sf_dir):
    return structure.sections(structure.lines(_outline(spark, sf_dir)))


def paragraph_chunks(spark, sf_dir):
    rows = structure.paragraphs(structure.lines(_outline(spark, sf_dir)))
    name = F.concat(F.lit("region-"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "chunk_type", "start_line", "end_line", structure.chunk_id(name, F.col("start_line"), F.col("end_line"), F.col("text")).alias("chunk_id"))


def graph_edges(spark, sf_dir):
    return graph.edges(graph.triples(_supply(spark, sf_dir))).select("edge_id", "source", "relation", "target")


def graph_neighbours(spark, sf_dir):
    seeds = _table(spark, sf_dir, "region").select(graph.label(F.col("r_name")).alias("seed"))
    return graph.neighbours(graph.edges(graph.triples(_supply(spark, sf_dir))), seeds, 2)


def singular_terms(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.explode(t.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("term")).distinct()
    return words.union(spark.createDataFrame([(w,) for w in ("policies", "branches", "dishes", "boxes", "glasses", "class", "is", "ties")], "term string")).distinct().select("term", t.singular(F.col("term")).alias("singular"))


def audit_events(spark, sf_dir):
    """The oldest hundred events."""
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("message")).orderBy("event_id").limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, document_checksums, distinct_documents, tokenize, postings, term_statistics, evidence_cards, sentences, question_intents, question_entities, section_tree,
        paragraph_chunks, graph_edges, graph_neighbours, singular_terms, audit_events,
    )
}

_TOK = f"list_transform(regexp_extract_all(coalesce(text, ''), '{t.TOKEN}'), lambda x: lower(x))"
_STOP = "(" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + ")"
_LINES = "select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1)::bigint as chunk_id from documents"
_POST = f"""c as ({_LINES}), e as (select doc_id, chunk_id, unnest({_TOK}) as term, generate_subscripts({_TOK}, 1) - 1 as pos from c),
p as (select doc_id, chunk_id, term, count(*) as tf, string_agg(pos::varchar, ',' order by pos) as positions from e where term not in {_STOP} group by 1, 2, 3)"""
_ASK = f"""q(question_id, text) as (values {_VALUES}), qt as (select question_id, {_TOK} as every from q),
qs as (select question_id, every, list_filter(every, lambda x: x not in {_STOP}) as kept from qt),
qa as (select question_id, unnest(case when len(kept) > 0 then kept else every end) as term from qs), asked as (select question_id, term, count(*) as qtf from qa group by 1, 2)"""
_SEARCH = f"""{_ASK}, {_POST}, l as (select doc_id, chunk_id, sum(tf) as dl from p group by 1, 2), d as (select doc_id, count(*) as n, avg(dl) as avgdl from l group by 1),
f as (select doc_id, term, count(*) as df from p group by 1, 2),
s as (select question_id, p.doc_id, p.chunk_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score, string_agg(term, ',' order by term) as matched, count(*) as m
  from p join f using (doc_id, term) join l using (doc_id, chunk_id) join d using (doc_id) join asked using (term) group by 1, 2, 3),
r as (select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_id)::int as "rank" from s where score > 0), top as (select * from r where "rank" <= 10)"""
_HELD = reduce(lambda x, a: f"replace({x}, '{a}', '{a.replace('.', chr(2))}')", t.ABBREVIATIONS, r"regexp_replace(line, '^\s+|\s+$', '', 'g')")
_ANY = lambda patterns: "regexp_matches(trim(text), '(?i)" + "|".join(patterns) + "')"
_OUTLINE = """n as (select r_regionkey, n_nationkey, n_name from nation join region on n_regionkey = r_regionkey),
o(doc_id, a, b, c, line) as (select r_regionkey, -1, 0, 0, '# ' || r_name from region union all select r_regionkey, n_nationkey, 0, 0, '## ' || n_name from n union all select r_regionkey, n_nationkey, 1, 0, '' from n
  union all select r_regionkey, n_nationkey, 2, s_suppkey, s_name || ' trades here.' from n join supplier on s_nationkey = n_nationkey union all select r_regionkey, n_nationkey, 3, 0, '1.1 ' || n_name || ' annex' from n),
ln as (select doc_id, row_number() over (partition by doc_id order by a, b, c, line)::int as line_no, line from o)"""
_GRAPH = """u as (select distinct s_name, p_name from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey),
g as (select distinct lower(trim(s_name)) as source, 'uses' as relation, lower(trim(p_name)) as target from u
  union select lower(r_name), 'contains', lower(n_name) from nation join region on n_regionkey = r_regionkey)"""

_SUBJECTS = ", ".join(f"regexp_replace(regexp_extract(text, '(?i){p}', 1), '^[ ?.]+|[ ?.]+$', '', 'g')" for p in (*i.EXPLANATION, *i.DEFINITION))
_ENTITIES = f"""regexp_extract_all(text, '{i.REQUIREMENT_ID}') || list_transform(regexp_extract_all(text, '"[^"]+"|''[^'']+'''), lambda x: trim(x[2:-2])) || list_filter([{_SUBJECTS}], lambda x: x <> '')"""

SQL = {
    "question_entities": f"""with q(question_id, text) as (values {_VALUES}), f as (select question_id, {_ENTITIES} as es from q)
select question_id::int as question_id, array_to_string(list_filter(es, lambda x, n: list_position(list_transform(es, lambda y: lower(y)), lower(x)) = n), '; ') as entities from f""",
    "document_checksums": "select doc_id, sha256(text) as checksum, strlen(text)::bigint as size_bytes from documents",
    "distinct_documents": "select sha256(text) as checksum, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "tokenize": f"select doc_id, len({_TOK})::bigint as n_tokens, sha256(array_to_string({_TOK}, ' ')) as normalized from documents",
    "postings": f"with {_POST} select doc_id, chunk_id, term, tf, positions from p",
    "term_statistics": f"with {_POST}, z as (select doc_id, count(distinct chunk_id) as n from p group by 1), f as (select doc_id, term, count(*) as df from p group by 1, 2) select doc_id, term, df, n, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from f join z using (doc_id)",
    "bm25_search": f'with {_SEARCH} select question_id, "rank", doc_id, chunk_id, round(score, 6) as score, matched from top',
    "evidence_cards": f"""with {_SEARCH}, x as (select top.*, c.text, coalesce(list_min(list_filter(list_transform(string_split(matched, ','), lambda w: instr(lower(c.text), w) - 1), lambda v: v >= 0)), 0) as anchor from top join c using (doc_id, chunk_id) where score >= 0.01),
y as (select *, greatest(0, anchor - 350) as s0 from x), z as (select *, case when least(length(text), s0 + 700) - s0 < 700 then greatest(0, length(text) - 700) else s0 end as s1 from y),
w as (select *, case when length(text) <= 700 then text else (case when s1 > 0 then '...' else '' end) || substr(text, s1 + 1, 700) || (case when s1 + 700 < length(text) then '...' else '' end) end as snippet from z),
v as (select *, row_number() over (partition by question_id, trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g')) order by "rank") as k from w)
select question_id, "rank", doc_id, chunk_id, case when score >= 3 and m >= 2 then 'HIGH' when score >= 1 or m >= 2 then 'MEDIUM' else 'LOW' end as confidence, 'doc-' || doc_id || ' | lines ' || chunk_id || '-' || chunk_id as citation, sha256(snippet) as snippet_sha256 from v where k = 1""",
    "sentences": f"""with a as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
b as (select doc_id, n, string_split(regexp_replace({_HELD}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ps from a), c as (select doc_id, n, unnest(ps) as s, generate_subscripts(ps, 1) as m from b),
e as (select doc_id, n, m, trim(regexp_replace(replace(s, chr(2), '.'), '\\s+', ' ', 'g')) as s from c) select doc_id, row_number() over (partition by doc_id order by n, m) - 1 as ord, sha256(s) as sentence_sha256 from e where s <> ''""",
    "question_intents": f"with {_ASK} select q.question_id, case " + " ".join(f"when {_ANY(p)} then '{name}'" for name, p in i.INTENTS) + " else 'GENERAL_SEARCH' end as intent, array_to_string(case when len(kept) > 0 then kept else every end, ' ') as terms from q join qs using (question_id)",
    "section_tree": f"""with {_OUTLINE}, h as (select doc_id, line_no as start_line, case when line like '#%' then regexp_replace(line, '^#+ ', '') else line end as title, (case when line like '# %' then 1 else 2 end)::int as level from ln where line like '#%' or line like '1.1 %'),
k as (select *, 'sec-' || lpad(start_line::varchar, 5, '0') || '-' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) as section_id from h)
select doc_id, section_id, title, level, start_line, coalesce((select min(b.start_line) - 1 from k b where b.doc_id = k.doc_id and b.start_line > k.start_line and b.level <= k.level), (select max(line_no) from ln where ln.doc_id = k.doc_id))::int as end_line,
  (select arg_max(b.section_id, b.start_line) from k b where b.doc_id = k.doc_id and b.start_line < k.start_line and b.level < k.level) as parent_section_id from k""",
    "paragraph_chunks": f"""with {_OUTLINE}, m as (select *, line like '#%' or line like '1.1 %' as head, line = '' as blank from ln), b as (select *, head or blank or coalesce(lag(head or blank) over (partition by doc_id order by line_no), true) as cut from m),
r as (select *, sum(cut::int) over (partition by doc_id order by line_no) as run from b), g as (select doc_id, run, case when bool_or(head) then 'section' else 'paragraph' end as chunk_type, min(line_no) as start_line, max(line_no) as end_line, string_agg(line, chr(10) order by line_no) as text from r where not blank group by 1, 2)
select doc_id, chunk_type, start_line, end_line, substr(sha256('region-' || doc_id || start_line || end_line || text), 1, 12) as chunk_id from g""",
    "graph_edges": f"with {_GRAPH} select 'edge-' || substr(sha256(source || '|' || relation || '|' || target), 1, 12) as edge_id, source, relation, target from g",
    "graph_neighbours": f"with {_GRAPH}, s as (select lower(r_name) as seed from region), a as (select distinct seed, target from s join g on source = seed), b as (select distinct seed, g.target from a join g on g.source = a.target where (seed, g.target) not in (select seed, target from a) and g.target <> seed) select seed, seed as node, 0 as distance from s union all select seed, target, 1 from a union all select seed, target, 2 from b",
    "singular_terms": f"""with a as (select p_name || ' ' || p_type as text from part), b as (select unnest({_TOK}) as term from a union select unnest(['policies', 'branches', 'dishes', 'boxes', 'glasses', 'class', 'is', 'ties']))
select term, case when length(term) <= 2 then term when term like '%ies' and length(term) > 4 then left(term, length(term) - 3) || 'y' when (term like '%ches' or term like '%shes') and length(term) > 5 then left(term, length(term) - 2)
  when (term like '%xes' or term like '%ses') and length(term) > 4 then left(term, length(term) - 2) when term like '%s' and term not like '%ss' then left(term, length(term) - 1) else term end as singular from b""",
    "audit_events": "select event_id, user_id, event_type, replace(event_type, '_', ' ') as message from events order by event_id limit 100",
}
