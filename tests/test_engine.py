"""The engine's queries against DuckDB, and its expressions on small rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import headings, intent, phrases, text
from quillspark.operators import evaluate, graph, index, schema, sections, structure
from quillspark.plans import answers, catalog, extraction, outline
from quillspark.sources import files

SQL = catalog.SQL | outline.SQL | answers.SQL | extraction.SQL
QUERIES = catalog.QUERIES | outline.QUERIES | answers.QUERIES | extraction.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, rel.fetchall()))


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_tokens_and_terms(spark):
    assert one(spark, text.tokens, "HPC6 cluster supports REQ-001 and ISO27001 controls.") == ["hpc6", "cluster", "supports", "req-001", "and", "iso27001", "controls"]
    assert one(spark, text.search_terms, "the hpc6 memory") == ["hpc6", "memory"]
    assert one(spark, text.search_terms, "the and of") == ["the", "and", "of"]
    assert one(spark, text.tokens, None) == []


def test_sentences(spark):
    assert one(spark, text.sentences, "Dr. Who came.  It was late!\r\nA line\n\nNew   block? Yes, e.g. this.") == ["Dr. Who came.", "It was late!", "A line", "New block?", "Yes, e.g. this."]
    assert one(spark, text.sentences, "") == one(spark, text.sentences, None) == []


def test_headings(spark):
    rows = ["# Top", "## Sub", "Appendix A: More", "Section 4", "2.3.4 Requirement Details", "INTRODUCTION", "plain words", "1. Introduction"]
    got = spark.createDataFrame(list(enumerate(rows)), "n int, line string").orderBy("n").select(structure.heading(F.col("line")).alias("h")).collect()
    assert [tuple(r.h) if r.h else None for r in got] == [("Top", 1), ("Sub", 2), ("Appendix A: More", 1), ("Section 4", 1), ("2.3.4 Requirement Details", 3), ("INTRODUCTION", 1), None, ("1 Introduction", 1)]


def test_section_ranges(spark):
    docs = spark.createDataFrame([(1, "1. Introduction\nBody\n1.1 Scope\nMore\n2. End\nlast")], "doc_id long, text string")
    got = structure.sections(structure.lines(docs)).orderBy("start_line").collect()
    assert [(r.title, r.level, r.start_line, r.end_line) for r in got] == [("1 Introduction", 1, 1, 4), ("1.1 Scope", 2, 3, 4), ("2 End", 1, 5, 6)]
    assert got[1].parent_section_id == got[0].section_id and got[0].parent_section_id is None


def test_intents(spark):
    cases = {"Explain lineage": "EXPLANATION_LOOKUP", "What is HPC6?": "DEFINITION_LOOKUP", "REQ-001?": "REQUIREMENT_REFERENCE", "A vs B": "COMPARISON", "show all rows": "LIST_REQUEST", "where is X mentioned": "WHERE_MENTIONED", "which table": "TABLE_LOOKUP", "": "GENERAL_SEARCH"}
    for question, want in cases.items():
        assert one(spark, intent.intent, question) == want
    assert one(spark, intent.entities, 'what is REQ-001 or "Big Thing"?') == ["REQ-001", "Big Thing", 'REQ-001 or "Big Thing"']


def test_search_ranks_and_merges(spark):
    chunks = spark.createDataFrame([(1, 1, "hpc6 memory configuration"), (1, 2, "network storage overview"), (1, 3, "hpc6 memory tuning guide")], "doc_id long, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "hpc6 memory")], "question_id int, question string")
    assert [r.chunk_id for r in index.search(chunks, asked).orderBy("rank").collect()] == [1, 3]
    a = spark.createDataFrame([(1, 1, 1, 1.0)], "question_id int, doc_id long, chunk_id long, score double")
    b = spark.createDataFrame([(1, 1, 1, 2.5), (1, 1, 2, 1.5)], "question_id int, doc_id long, chunk_id long, score double")
    assert [(r.chunk_id, r.score) for r in index.merge_results(a, b).orderBy("rank").collect()] == [(1, 2.5), (2, 1.5)]


def test_triples(spark):
    rows = spark.createDataFrame([("Enterprise search stack uses repository connectors.",), ("Pipeline depends on retrieval engine.",), ("Kit contains bolts, nuts and screws.",), ("It rains.",)], "sentence string")
    got = sorted((r.subject, r.relation, r.object) for r in graph.triples(rows).collect())
    assert got == [("Enterprise search stack", "uses", "repository connectors"), ("Kit", "contains", "bolts"), ("Kit", "contains", "nuts"), ("Kit", "contains", "screws"), ("Pipeline", "depends_on", "retrieval engine")]


def test_is_a_triples_and_definitions(spark):
    said = ["The  RDF store is the graph index, which is fast.", "Lineage is a record of origins.", "The first design is a graph.", "Soup is warm.", "Tea is hot water.", "Rain is wind and water.", "The engine uses a fast index, and more."]
    rows = graph.triples(spark.createDataFrame([(x,) for x in said], "sentence string"))
    assert sorted((r.subject, r.relation, r.object) for r in rows.collect()) == [("Lineage", "is_a", "record of origins"), ("RDF store", "is_a", "graph index"), ("engine", "uses", "fast index")]
    asked = spark.createDataFrame([(1, "definition", "Lineage", "definition")], "question_id int, kind string, entity string, relation string")
    assert [(r.entity, r.score) for r in graph.match(asked, graph.edges(rows)).collect()] == [("record of origins", 11.0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.txt").write_bytes(b"one\r\ntwo\rthree")
    found = files.read_text_files(spark, str(tmp_path))
    by = {r.file_name: r for r in found.collect()}
    assert by["a.txt"].text == "one\ntwo\nthree" and by["a.txt"].warning is None and by["b.txt"].text == "café" and by["b.txt"].warning
    assert [r.file_name for r in files.new_documents(found, found.where("file_name = 'b.txt'")).collect()] == ["a.txt"]


def test_heading_categories(spark):
    for title, want in {"Existing Architectures": "architecture", "Design Pattern Overview": "design_pattern", "Overview": None, "Widgets": "widget", "": None}.items():
        assert one(spark, headings.category, title) == want
    assert one(spark, headings.category, None) is None and one(spark, headings.category_name, "Common policies here") == "common_policy_here"


def test_layout_and_category_headings(spark):
    doc = "Existing Architectures\n\nThe first architecture is old.\n\nCommon Ways of Working\n\nwords go on here.\nNot A Heading\nmore"
    rows = structure.headings(structure.lines(spark.createDataFrame([(1, doc)], "doc_id long, text string")))
    assert [r.title for r in rows.where("title is not null").orderBy("line_no").collect()] == ["Existing Architectures", "Common Ways of Working"]


def test_clean_phrase(spark):
    for raw, want in {"the classic qa pipeline which is old": "Classic QA pipeline", " a Graph Store, and more": "Graph Store", "LLM based Thing.": "LLM based Thing", "": ""}.items():
        assert one(spark, phrases.clean, raw) == want
    assert one(spark, phrases.clean, None) is None


def _packed(lines, most=1200):
    """Pieces of a paragraph by the rule, line by line."""
    made, now, used = [], [], 0
    for line in lines:
        need = len(line) + (1 if now else 0)
        if now and used + need > most:
            made, now, used = [*made, now], [], 0
            need = len(line) + 1
        now, used = [*now, line], used + need
    return [*made, now]


def test_overflow_pieces_and_overlap(spark):
    body = [f"line {n} " + "x" * (n * 7 % 300) for n in range(60)] + ["y" * 3000, "end"]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    got = structure.chunks(structure.lines(docs)).orderBy("doc_id", "start_line").collect()
    want = _packed(body)
    texts = ["\n".join(p) if n == 0 else "\n".join([want[n - 1][-1], *p]) for n, p in enumerate(want)]
    assert [r.text for r in got if r.doc_id == 1] == texts and {r.chunk_type for r in got if r.doc_id == 1} == {"overflow"}
    assert [(r.doc_id, r.chunk_type) for r in got if r.doc_id > 1] == [(2, "paragraph")]


def test_document_tree(spark):
    doc = "lost\n\n# Title\n\nThe title is here. It runs on.\n- item one\na | b\nmore text"
    rows = structure.lines(spark.createDataFrame([(1, doc)], "doc_id long, text string"))
    found = structure.sections(rows)
    nodes = structure.tree(structure.assign_sections(structure.chunks(rows), found), found)
    got = [(r.node_type, r.text) for r in nodes.orderBy("ord").collect()]
    assert got == [("section", "Title"), ("paragraph", "The title is here. It runs on."), ("sentence", "The title is here."), ("sentence", "It runs on."), ("list_item", "- item one"), ("table_row", "a | b"), ("paragraph", "more text"), ("sentence", "more text")]
    assert structure.section_texts(nodes).first().text == "The title is here. It runs on.\n\n- item one\n\na | b\n\nmore text"


def test_schema_from_sentences(spark):
    said = ["The first architecture is the Classic QA pipeline.", "The second architecture is a Graph store, which is new.", "The first one is", "Engine depends on fast index.", "engine depends on Fast index."]
    rows = spark.createDataFrame([(1, "architecture", n, x) for n, x in enumerate(said)], "doc_id long, category string, ord int, sentence string")
    g = schema.grammars(rows).collect()
    assert [(r.hits, r.ordinals, list(r.type_phrases), round(r.confidence, 2)) for r in g] == [(2, 2, ["architecture"], 0.89)]
    assert [r.entity for r in schema.enumerated(rows).orderBy("ord").collect()] == ["Classic QA pipeline", "Graph store"]
    assert [(r.subject, r.relation, r.object) for r in schema.candidates(rows).collect()] == [("Engine", "depends on", "Fast index")]


def test_graph_blocks_agree(spark, monkeypatch):
    edges = spark.createDataFrame([("e1", "search stack", "uses", "connectors", "s"), ("e2", "stacks", "uses", "index", "t")], "edge_id string, source string, relation string, target string, sentence string")
    asked = spark.createDataFrame([(1, "forward", "Stack", "uses"), (2, "definition", "connector", "definition"), (3, "reverse", "Index", "uses"), (4, "generic", None, None)], "question_id int, kind string, entity string, relation string")
    whole = sorted(map(tuple, graph.match(asked, edges).collect()))
    assert [(r[0], r[1], r[3]) for r in whole] == [(1, "connectors", 9.0), (1, "index", 9.0), (2, "connectors", 8.0), (3, "stacks", 11.0)]
    monkeypatch.setattr(graph, "BLOCK", 1)
    assert sorted(map(tuple, graph.match(asked, edges).collect())) == whole


def test_title_trap(spark):
    rows = [(1, "a", "Annual Report", 1, 2, "annual_report.txt"), (1, "b", "Report Methods", 3, 30, "annual_report.txt")]
    found = spark.createDataFrame(rows, "doc_id long, section_id string, title string, start_line int, end_line int, name string")
    asked = spark.createDataFrame([(1, "explain the annual report")], "question_id int, question string")
    assert [r.section_id for r in sections.search(asked, found).orderBy("rank").collect()] == ["b", "a"]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "M", ["Alpha"], ["beta"]), (2, "M", None, None), (3, "N", ["x"], [])], "case_id int, mode string, contains array<string>, not_contains array<string>")
    given = spark.createDataFrame([(1, "M", "alpha BETA"), (2, "M", None)], "case_id int, mode string, text string")
    r = evaluate.summary(evaluate.checks(cases, given)).first()
    assert tuple(r) == (3, 1, 2 / 3, 0.5, 1)
    empty = evaluate.summary(evaluate.checks(cases.limit(0), given)).first()
    assert tuple(empty) == (0, 0, 1.0, 1.0, 0)


def test_question_shaping(spark):
    assert one(spark, intent.comparison_terms, "compare a and b?") == ["a", "b"] and one(spark, intent.comparison_terms, "hello") == []
    assert one(spark, intent.retrieval_query, "What is QA?") == "What is QA? definition means refers to"
    assert one(spark, intent.retrieval_query, "see REQ-001") == "see REQ-001 REQ-001" and one(spark, intent.retrieval_query, "plain") == "plain"
    assert [one(spark, intent.wants_sections, q) for q in ("What are phases?", "plain words", "", "A vs B")] == [True, False, False, True]
    assert one(spark, intent.topic_terms, "what are the architcture requirements") == ["architecture", "architectures", "requirement", "requirements"]


def test_clip_and_boost(spark):
    clip = lambda a, b: one(spark, lambda x: structure.clip_to_section(x, F.lit(5), F.lit(a), F.lit(b)), "a\nb\nc")
    assert clip(6, 9) == "b\nc" and clip(20, 30) == "a\nb\nc"
    raised = lambda kind, asked: one(spark, lambda x: sections.boost(F.lit(1.0), x, F.lit(kind), F.array(F.lit("lineage")), F.lit(asked)), "Data Lineage")
    assert [round(raised(*x), 3) for x in (("paragraph", "GENERAL_SEARCH"), ("section", "EXPLANATION_LOOKUP"), ("section", "GENERAL_SEARCH"))] == [1.62, 0.92, 1.35]
    assert one(spark, lambda x: sections.boost(F.lit(1.0), x, F.lit("paragraph"), F.array(F.lit("other")), F.lit("X")), None) == 1.0
