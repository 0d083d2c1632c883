"""Queries over headings, phrases, chunks and document trees, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import headings as h
from quillspark.functions import phrases
from quillspark.operators import answer, schema, structure
from quillspark.plans.catalog import _OUTLINE, _outline, _table

HEADINGS = (
    "Existing Architectures", "Design Patterns for Implementation", "Overview", "patterns", "Capabilities Overview", "Design of patterns", "Open-Source Building Blocks", "Technologies!",
    "Future Improvements", "The evaluation", "Workflows and phases", "Widgets", "common policies here", "Notes", "", "Architecture Details", "Limitations: known", "7 Phases",
)
PHRASES = (
    "the classic qa pipeline which is old", "a Graph Store, and more", "LLM based Thing.", "an iPhone", "RDF owl sparql", "(quoted) \"words\"", "The The band: live", "", "x", "OPEN source WITH care",
)
_SQL_LIST = lambda values: ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def heading_categories(spark, sf_dir):
    """Literal headings and the names of all parts."""
    rows = spark.createDataFrame([(x,) for x in HEADINGS], "title string").union(_table(spark, sf_dir, "part").select("p_name")).distinct()
    c, title = h.category(F.col("title")), F.col("title")
    return rows.select("title", h.plain(title).alias("plain"), c.alias("category"), h.category_name(title).alias("name"), h.category_confidence(title, c).alias("confidence"))


def clean_phrases(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in PHRASES], "phrase string").union(_table(spark, sf_dir, "part").select(F.concat(F.lit("the "), "p_name", F.lit(", which "), "p_type"))).distinct()
    return rows.select("phrase", phrases.clean(F.col("phrase")).alias("cleaned"))


def layout_scores(spark, sf_dir):
    """Every line of every document: its score as a heading and whether it is one."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = structure.lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("_b", F.lag("line").over(order)).withColumn("_a", F.lead("line").over(order))
    near = (F.col("line"), F.col("_b"), F.col("_a"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), h.layout_score(*near).alias("score"), F.coalesce(h.is_layout_heading(*near), F.lit(False)).alias("is_heading"))


def _document_lines(spark, sf_dir):
    return structure.lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def document_chunks(spark, sf_dir):
    """Headings, paragraphs and overflow pieces of every document."""
    rows = structure.chunks(_document_lines(spark, sf_dir))
    return rows.select("doc_id", "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _marked_lines(spark, sf_dir):
    """Lines of every document, every tenth a heading and every fiftieth a higher one, so that all documents have sections."""
    n = F.col("line_no")
    mark = F.when(n % 50 == 1, "# ").when(n % 10 == 1, "## ").otherwise("")
    return _document_lines(spark, sf_dir).withColumn("line", F.concat(mark, "line"))


def marked_sections(spark, sf_dir):
    return structure.sections(_marked_lines(spark, sf_dir))


def marked_chunk_sections(spark, sf_dir):
    """The section that each chunk lies in."""
    rows = _marked_lines(spark, sf_dir)
    chunks = structure.assign_sections(structure.chunks(rows), structure.sections(rows))
    return chunks.select("doc_id", "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "section_id", "section_title")


def marked_categories(spark, sf_dir):
    return schema.categories(marked_sections(spark, sf_dir))


def document_preflight(spark, sf_dir):
    """Whether every document is fit for questions."""
    return answer.preflight(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("outlook")


def _outline_parts(spark, sf_dir):
    rows = structure.lines(_outline(spark, sf_dir))
    found = structure.sections(rows)
    return structure.assign_sections(structure.chunks(rows), found), found


def chunk_sections(spark, sf_dir):
    chunks, _ = _outline_parts(spark, sf_dir)
    return chunks.select("doc_id", "start_line", "end_line", "chunk_type", "section_id")


def document_tree(spark, sf_dir):
    chunks, found = _outline_parts(spark, sf_dir)
    return structure.tree(chunks, found).drop("text")


def section_texts(spark, sf_dir):
    chunks, found = _outline_parts(spark, sf_dir)
    return structure.section_texts(structure.tree(chunks, found)).select("doc_id", "title", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (heading_categories, clean_phrases, layout_scores, document_chunks, marked_sections, marked_chunk_sections, marked_categories, document_preflight, chunk_sections, document_tree, section_texts)}

_SINGULAR = """case when length(w) <= 2 then w when w like '%ies' and length(w) > 4 then left(w, length(w) - 3) || 'y' when (w like '%ches' or w like '%shes') and length(w) > 5 then left(w, length(w) - 2)
  when (w like '%xes' or w like '%ses') and length(w) > 4 then left(w, length(w) - 2) when w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end"""
_PLAIN = r"trim(regexp_replace(regexp_replace(replace(lower(trim(title)), '-', ' '), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
for _s in h.WEAK_SUFFIXES:
    _PLAIN = rf"regexp_replace({_PLAIN}, '\s*{_s}$', '')"
_WEAK = "(" + ", ".join(f"'{w}'" for w in ("", *h.WEAK_HEADINGS)) + ")"
_CASES = lambda column, design: " ".join(f"when contains({column}, '{p}')" + (f" and not contains({column}, 'design')" if design and c == "pattern" else "") + f" then '{c}'" for p, c in h.PHRASES)
_FIRST = " ".join(f"when category = '{c}' and contains(plain, '{p}') then case when plain = '{p}' then 0.95 when starts_with(plain, '{p} ') then 0.9 else 0.85 end" for p, c in h.PHRASES)
_WORDS = r"string_split_regex(s, '\s+')"
_START = "regexp_matches(lower(s), '^(" + "|".join(h.STARTS) + ")')"
_CAPITAL = rf"len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\p{{Lu}}')))"
_TITLE = f"(len({_WORDS}) <= 12 and {_CAPITAL} >= greatest(1, floor(len({_WORDS}) * 0.6)))"
_LONG = "(length(a) > 40 and not a like '%:')"
_N = lambda p: f"len(regexp_extract_all(s, '{p}'))"
_LINK = "regexp_matches(s, '(?i)https?://|www\\.')"
_SIGNS = [
    (1, "length(s) <= 80"), (2, _TITLE), (1, "not regexp_matches(s, '[.!?]$')"), (1, "b = ''"), (1, "a = ''"), (1, f"{_N('\\pL')} > 0 and {_N('\\p{Lu}')} / greatest({_N('\\pL')}, 1) >= 0.35"), (2, _START),
    (0.5, f"not {_LINK}"), (0.5, f"{_N('[0-9]')} <= greatest(2, length(s) // 8)"), (2, _LONG), (-3, "s like '%.'"), (-2, _LINK), (-2, "regexp_matches(s, '(?i)\\[\\d+\\]|\\(\\d{4}\\)|et al\\.')"), (-5, "length(s) > 120"),
    (-2, "regexp_matches(s, '\\p{Ll}') and not regexp_matches(s, '[\\p{Lu}\\p{Lt}]')"), (-3, "regexp_matches(s, '^[\\-*•]\\s+')"), (-2, f"{_N('[,;]')} >= 2"), (-2, f"len({_WORDS}) > 14"), (-1, f"regexp_matches(s, '^\\d+[.)]\\s+') and not {_START}"),
]
_STRIP = lambda x: f"coalesce(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"
_ACRONYMS = "(" + ", ".join(f"'{a}'" for a in phrases.ACRONYMS) + ")"
_SECTIONS = f"""{_OUTLINE}, h as (select doc_id, line_no as start_line, case when line like '#%' then regexp_replace(line, '^#+ ', '') else line end as title, (case when line like '# %' then 1 else 2 end) as level from ln where line like '#%' or line like '1.1 %'),
sec as (select *, 'sec-' || lpad(start_line::varchar, 5, '0') || '-' || substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) as section_id,
  coalesce((select min(b.start_line) - 1 from h b where b.doc_id = h.doc_id and b.start_line > h.start_line and b.level <= h.level), (select max(line_no) from ln where ln.doc_id = h.doc_id)) as end_line from h),
m as (select *, line like '#%' or line like '1.1 %' as head, line = '' as blank from ln), bb as (select *, head or blank or coalesce(lag(head or blank) over (partition by doc_id order by line_no), true) as cut from m),
rr as (select *, sum(cut::int) over (partition by doc_id order by line_no) as run from bb where true)"""
_CHUNKED = f"""{_SECTIONS}, pk as (select rr.*, sum(length(line) + 1) over (partition by doc_id, run order by line_no) as used, sum(length(line) + 1) over (partition by doc_id, run) - 1 as total, row_number() over (partition by doc_id, run order by line_no) as k from rr where not blank),
st(doc_id, run, k, line_no, line, head, total, used, piece) as (select doc_id, run, k, line_no, line, head, total, length(line), 0 from pk where k = 1
  union all select p.doc_id, p.run, p.k, p.line_no, p.line, p.head, p.total, case when st.total > 1200 and st.used + length(p.line) + 1 > 1200 then length(p.line) + 1 else st.used + length(p.line) + 1 end, case when st.total > 1200 and st.used + length(p.line) + 1 > 1200 then st.piece + 1 else st.piece end
  from st join pk p on p.doc_id = st.doc_id and p.run = st.run and p.k = st.k + 1),
g as (select doc_id, run, piece, case when bool_or(head) then 'section' when max(total) > 1200 then 'overflow' else 'paragraph' end as chunk_type, min(line_no) as s0, max(line_no) as end_line, string_agg(line, chr(10) order by line_no) as t0, arg_max(line, line_no) as final from st group by 1, 2, 3),
v as (select *, lag(chunk_type) over w as pt, lag(end_line) over w as pe, lag(final) over w as pl from g window w as (partition by doc_id order by s0)),
j as (select *, coalesce(chunk_type <> 'section' and pt <> 'section' and pe + 1 >= s0 and not starts_with(t0, pl), false) as over from v),
ck as (select doc_id, chunk_type, (s0 - over::int)::bigint as start_line, end_line::bigint as end_line, case when over then pl || chr(10) || t0 else t0 end as text from j)"""
_PLACED = f"""{_CHUNKED}, cs as (select ck.*, (select arg_max(section_id, sec.start_line) from sec where sec.doc_id = ck.doc_id and sec.start_line <= ck.start_line and sec.end_line >= ck.start_line) as section_id from ck)"""
_NODE = lambda kind, a, b, text: f"'{kind}-' || substr(sha256('{kind}:' || {a} || ':' || {b} || ':' || substr({text}, 1, 80)), 1, 10)"
#: Lines of the outline are neither list items nor table rows, so each chunk is one paragraph.
_TREE = f"""{_PLACED}, tops as (select doc_id, section_id, title, start_line as ss, {_NODE('section', 'start_line', 'end_line', 'title')} as sid, end_line from sec),
paras as (select cs.doc_id, ss, sid, cs.start_line, cs.end_line, text, {_NODE('paragraph', 'cs.start_line', 'cs.end_line', 'text')} as pid from cs join tops using (doc_id, section_id) where chunk_type <> 'section'),
sents as (select paras.*, unnest(string_split(text, chr(10))) as sentence, generate_subscripts(string_split(text, chr(10)), 1) as n from paras),
nodes as (select doc_id, ss, -1 as c, -1 as n, sid as node_id, 'document-root' as parent_id, 'section' as node_type, ss as start_line, end_line from tops
  union all select doc_id, ss, start_line, -1, pid, sid, 'paragraph', start_line, end_line from paras
  union all select doc_id, ss, start_line, n, {_NODE('sentence', 'start_line', 'end_line', 'sentence')}, pid, 'sentence', start_line, end_line from sents)"""

#: cl: phrases of r(phrase), cleaned.
_CLEANED = rf"""p1 as (select phrase, trim(regexp_replace(trim(phrase), '^(the|a|an) ', '', 'i')) as x from r), p2 as (select phrase, string_split(string_split(string_split(regexp_replace(x, '\s+(which|that|where|with)\b.*$', '', 'is'), ':')[1], ';')[1], ',')[1] as x from p1),
p3 as (select phrase, string_split(trim(regexp_replace(regexp_replace(x, '^[ \t\n\r.,;:!?"''()\[\]]+|[ \t\n\r.,;:!?"''()\[\]]+$', '', 'g'), '\s+', ' ', 'g')), ' ') as ws from p2),
p4 as (select phrase, list_transform(ws, lambda w: regexp_replace(w, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')) as ws from p3),
cl as (select phrase, array_to_string(list_transform(ws, lambda w, i: case when upper(w) in {_ACRONYMS} then upper(w) when length(w) >= 2 and upper(w) = w and lower(w) <> w then w when i = 1 then upper(left(w, 1)) || substr(w, 2) when regexp_matches(w, '^\p{{Ll}}') then lower(w) else w end), ' ') as cleaned from p4)"""

#: n: lines l of documents, stripped, with the lines before and after; z: with their layout score.
_LAYOUT = f"""l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
n as (select doc_id, line_no, line, {_STRIP('line')} as s, {_STRIP('lag(line) over w')} as b, {_STRIP('lead(line) over w')} as a from l window w as (partition by doc_id order by line_no)),
z as (select *, (case when s = '' then 0 else {" + ".join(f"case when {test} then {w} else 0 end" for w, test in _SIGNS)} end)::double as score from n)"""
_ALONE = f"s <> '' and b = '' and (a = '' or {_LONG}) and not regexp_matches(s, '[.!?]$') and len({_WORDS}) <= 12 and ({_TITLE} or {_START}) and score >= 5"
_SURE = f"""p as (select *, {_PLAIN} as plain from heads), w as (select *, list_transform(string_split(plain, ' '), lambda w: {_SINGULAR}) as ws from p), j as (select *, array_to_string(ws, ' ') as joined from w),
c as (select *, case when plain in {_WEAK} then null when contains(plain, 'design pattern') then 'design_pattern' {_CASES('plain', True)} {_CASES('joined', False)} when len(ws) = 1 and ws[1] not in {_WEAK} then ws[1] end as category from j),
f as (select *, (case when plain in {_WEAK} then 0.2 {_FIRST} when category is not null then 0.75 else 0.4 end)::double as confidence from c)"""
#: found: the categories of sections sec.
_FOUND = f"""heads as (select doc_id, start_line, title from sec), {_SURE}, k as (select *, row_number() over (partition by doc_id, category order by confidence desc, start_line, title) as n from f where confidence >= 0.65 and length(category) > 1 and category <> 'general'),
found as (select doc_id, category, title as source_section, confidence from k where n = 1 and not regexp_full_match(category, '[0-9]+'))"""
_MARK, _APPENDIX, _LABEL, _NUMBER = r"'^(#{1,6})\s+(.+?)\s*$'", r"'(?i)^Appendix\s+([A-Z])(?:\s*[:.\-]\s*(.+))?\s*$'", r"'(?i)^Section\s+(\d+)\s*(?:[:.\-]\s*)?(.*)$'", r"'^(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$'"
_NAMED = lambda word, p: f"'{word} ' || regexp_extract(s, {p}, 1) || case when regexp_extract(s, {p}, 2) <> '' then ': ' || trim(regexp_extract(s, {p}, 2)) else '' end"
#: hd: the lines of documents with title and level where they are headings: by their own form, by layout, or by the category that they name.
_HEADED = rf"""{_LAYOUT}, hheads as (select distinct s as title from z where length(s) <= 120 and not regexp_matches(s, '[.!?]$') and not contains(lower(s), ' is ') and b = '' and a <> ''), {_SURE.replace("from heads)", "from hheads)", 1).replace("p as (select", "hp as (select", 1).replace("from p)", "from hp)", 1).replace("w as (select", "hw as (select", 1).replace("from w)", "from hw)", 1).replace("j as (select", "hj as (select", 1).replace("from j)", "from hj)", 1).replace("c as (select", "hc as (select", 1).replace("from c)", "from hc)", 1).replace("f as (select", "hf as (select", 1)},
own as (select doc_id, line_no, line, s, a, b, case when regexp_matches(s, {_MARK}) then struct_pack(t := regexp_extract(s, {_MARK}, 2), l := length(regexp_extract(s, {_MARK}, 1))::bigint)
  when regexp_matches(s, {_APPENDIX}) then struct_pack(t := {_NAMED('Appendix', _APPENDIX)}, l := 1::bigint) when regexp_matches(s, {_LABEL}) then struct_pack(t := {_NAMED('Section', _LABEL)}, l := 1::bigint)
  when regexp_matches(s, {_NUMBER}) then struct_pack(t := regexp_extract(s, {_NUMBER}, 1) || ' ' || regexp_extract(s, {_NUMBER}, 2), l := len(string_split(regexp_extract(s, {_NUMBER}, 1), '.'))::bigint)
  when length(s) between 4 and 100 and regexp_matches(s, '^[A-Z][A-Z0-9\s\-/&(),]+$') and len(regexp_extract_all(s, '[A-Z]')) >= 3 then struct_pack(t := s, l := 1::bigint)
  when {_ALONE} or (length(s) <= 120 and not regexp_matches(s, '[.!?]$') and not contains(lower(s), ' is ') and b = '' and a <> '' and s in (select title from hf where confidence >= 0.85)) then struct_pack(t := s, l := 1::bigint) end as x from z),
hd as (select doc_id, line_no, line, s, x.t as title, x.l as level from own)"""
_DOCUMENT_SECTIONS = rf"""{_HEADED}, hh as (select doc_id, line_no as start_line, title, level, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from hd where title is not null),
h as (select * exclude (slug), 'sec-' || lpad(start_line::varchar, 5, '0') || '-' || case when slug = '' then 'section' else substr(slug, 1, 48) end as section_id from hh), lasts as (select doc_id, max(line_no) as last from hd group by 1),
sec as (select h.*, coalesce((select min(b.start_line) - 1 from h b where b.doc_id = h.doc_id and b.start_line > h.start_line and b.level <= h.level), last) as end_line,
  (select arg_max(b.section_id, b.start_line) from h b where b.doc_id = h.doc_id and b.start_line < h.start_line and b.level < h.level) as parent_section_id from h join lasts using (doc_id))"""
_DOCUMENT_CHUNKS = _CHUNKED.replace(_CHUNKED[: _CHUNKED.index("m as (select *")], _DOCUMENT_SECTIONS + ",\n").replace("line like '#%' or line like '1.1 %' as head, line = '' as blank from ln", "title is not null as head, s = '' as blank from hd")

_MARKED = lambda sql: sql.replace("n as (select doc_id, line_no, line,", "lm as (select doc_id, line_no, case when line_no % 50 = 1 then '# ' when line_no % 10 = 1 then '## ' else '' end || line as line from l), n as (select doc_id, line_no, line,", 1).replace("from l window", "from lm window", 1)

SQL = {
    "heading_categories": rf"""with r as (select * from (values {_SQL_LIST(HEADINGS)}) t(title) union select p_name from part), p as (select title, {_PLAIN} as plain from r),
w as (select *, list_transform(string_split(plain, ' '), lambda w: {_SINGULAR}) as ws from p), j as (select *, array_to_string(ws, ' ') as joined from w),
c as (select *, case when plain in {_WEAK} then null when contains(plain, 'design pattern') then 'design_pattern' {_CASES('plain', True)} {_CASES('joined', False)} when len(ws) = 1 and ws[1] not in {_WEAK} then ws[1] end as category from j)
select title, plain, category, coalesce(category, case when plain <> '' then array_to_string(ws, '_') end, 'general') as name, (case when plain in {_WEAK} then 0.2 {_FIRST} when category is not null then 0.75 else 0.4 end)::double as confidence from c""",
    "clean_phrases": rf"""with r as (select * from (values {_SQL_LIST(PHRASES)}) t(phrase) union select 'the ' || p_name || ', which ' || p_type from part),
{_CLEANED} select phrase, cleaned from cl""",
    "layout_scores": f"""with {_LAYOUT}
select doc_id, line_no, score, {_ALONE} as is_heading from z""",
    "document_chunks": f"with recursive {_DOCUMENT_CHUNKS} select doc_id, chunk_type, start_line, end_line, sha256(text) as text_sha256 from ck",
    "marked_sections": _MARKED(f"with {_DOCUMENT_SECTIONS} select doc_id, section_id, title, level::int as level, start_line::int as start_line, end_line::int as end_line, parent_section_id from sec"),
    "marked_chunk_sections": _MARKED(f"""with recursive {_DOCUMENT_CHUNKS}, us as (select doc_id, start_line, null::varchar as chunk_type, 0 as e, 0 as side, section_id, title from sec union all select doc_id, start_line, chunk_type, end_line, 1, null, null from ck),
x as (select doc_id, chunk_type, start_line, e, side, last_value(section_id ignore nulls) over w as section_id, last_value(title ignore nulls) over w as section_title from us window w as (partition by doc_id order by start_line, side rows between unbounded preceding and current row))
select doc_id, chunk_type, start_line, e::bigint as end_line, section_id, section_title from x where side = 1"""),
    "marked_categories": _MARKED(f"with {_DOCUMENT_SECTIONS}, {_FOUND} select doc_id, category, source_section, confidence from found"),
    "document_preflight": f"""with recursive {_DOCUMENT_CHUNKS}, number as (select d.doc_id, coalesce(length(text), 0) as chars, text is not null as there, (select count(*) from hd where hd.doc_id = d.doc_id) as lines, (select count(*) from sec where sec.doc_id = d.doc_id) as sections, (select count(*) from ck where ck.doc_id = d.doc_id) as chunks from documents d)
select doc_id, chars::int as chars, lines, sections as headings, sections, chunks, case when not there or chars < 80 then 'RED - NOT_READY' when sections < 2 then 'YELLOW - STRUCTURE_WEAK' when sections >= 4 then 'GREEN+ - READY_FOR_EVAL' else 'GREEN - READY_FOR_QA' end as readiness from number""",
    "chunk_sections": f"with recursive {_PLACED} select doc_id, start_line::int as start_line, end_line::int as end_line, chunk_type, section_id from cs",
    "document_tree": f"with recursive {_TREE} select doc_id, (row_number() over (partition by doc_id order by ss, c, n))::int as ord, node_id, parent_id, node_type, start_line::int as start_line, end_line::int as end_line from nodes",
    "section_texts": f"""with recursive {_TREE}, merged as (select tops.doc_id, tops.sid, tops.title, coalesce(bool_or(contains(lower(text), lower(title))), false) as said, string_agg(text, chr(10) || chr(10) order by paras.start_line) as body from tops left join paras on paras.doc_id = tops.doc_id and paras.sid = tops.sid group by 1, 2, 3)
select doc_id, title, sha256(case when said then coalesce(body, '') when body is null then title else title || chr(10) || chr(10) || body end) as text_sha256 from merged""",
}
