"""Documents stored and asked, end to end; extraction, evidence, readers and layout on small rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import evidence, intent, layout, phrases
from quillspark.operators import answer, evaluate, extract, graph, index, schema, sections, trace
from quillspark.sources import exchange, files, office, store, suites

DOC = """Existing architectures

The most common early architecture is the enterprise search stack.
A second architecture is the classic QA pipeline.
A third architecture is the ontology and knowledge-graph stack.

Design patterns for implementation

The first critical design pattern is section-aware reading.
The second pattern is many-grained indexing.
The third pattern is fixed reading of questions.

Open-source building blocks

For reading, the most useful tools are Alpha Reader and Beta Box.

Relationship examples

Enterprise search stack uses repository connectors.
Classic QA pipeline contains question analysis, search, and answer extraction.
Compliance module implements policy.
"""
CASES = [
    (1, "what are different architectures mentioned in the pdf?", "STRUCTURED_EXTRACTIVE", ["Enterprise search stack", "Classic QA pipeline", "Ontology and knowledge-graph stack"], ["Many-grained indexing", "repository connectors"]),
    (2, "what are different design patterns mentioned in the pdf?", "STRUCTURED_EXTRACTIVE", ["Section-aware reading", "Many-grained indexing", "Fixed reading of questions"], ["Enterprise search stack"]),
    (3, "What does Enterprise search stack use?", "GRAPH_STRUCTURED", ["repository connectors"], ["Many-grained indexing"]),
    (4, "What does Classic QA pipeline contain?", "GRAPH_STRUCTURED", ["question analysis", "search", "answer extraction"], ["repository connectors"]),
    (5, "What implements policy?", "GRAPH_STRUCTURED", ["Compliance module"], ["Enterprise search stack"]),
    (6, "Where is Alpha Reader mentioned?", "EVIDENCE_ONLY", ["Alpha Reader"], []),
    (7, "zebra quagga", "NO_EVIDENCE", [], ["zebra"]),
]


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    held = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    docs = spark.createDataFrame([("a.txt", "c1", len(DOC), DOC), ("again.txt", "c1", len(DOC), DOC), ("b.txt", "c2", 5, "plain"), ("c.txt", "c3", 0, None)], "name string, checksum string, size_bytes long, text string")
    told = held.process(docs)
    return held, {r.name: r for r in told.collect()}, docs


def test_documents_are_stored_once(spark, stored):
    held, told, docs = stored
    assert [r.name for r in held.documents().orderBy("name").collect()] == ["a.txt", "b.txt", "c.txt"] and not any(r.duplicate for r in told.values())
    again = held.process(docs.limit(1).union(docs.where("name = 'd'")))
    assert [r.duplicate for r in again.collect()] == [True] and held.documents().count() == 3
    doc = told["a.txt"].doc_id
    assert held.by_checksum("c1").first().doc_id == doc and held.has_index(doc) and not held.has_index(told["c.txt"].doc_id)
    counts = {r.doc_id: r for r in held.counts().collect()}
    assert counts[doc].sections == 4 and counts[doc].chunks == held.of("chunks", doc).count() and counts[told["c.txt"].doc_id].terms == 0
    assert [r.title for r in held.of("sections", doc).collect()][:2] == ["Existing architectures", "Design patterns for implementation"]
    events = held.audit_events(10).collect()
    assert [r.event_type for r in events].count("document_processed") == 4 and events[-1].event_type == "duplicate_document_detected" and events[-1].message == "Duplicate document detected: a.txt"
    assert held.audit_events(10, doc_id=told["b.txt"].doc_id).count() == 1
    about = {r.doc_id: r for r in held.metadata().collect()}[doc]
    assert {"architecture", "design pattern"} <= set(about.categories) and about.nodes > 10 and about.edges > 10


def test_stored_schema_and_graph(spark, stored):
    held, told, _ = stored
    doc = told["a.txt"].doc_id
    patterns = {r.pattern_name: r for r in held.of("patterns", doc).collect()}
    assert set(patterns) == {"ordinal_architecture", "most_common_architecture", "ordinal_design_pattern"} and patterns["ordinal_design_pattern"].hits == 3
    nodes = held.of("nodes", doc)
    assert {(r.label, r.node_type) for r in graph.by_label(nodes, "classic  qa pipeline").collect()} == {("Classic QA pipeline", "architecture"), ("Classic QA pipeline", "entity")}
    assert {r.target for r in graph.by_relation(held.of("edges", doc), "contains").where("source = 'existing architectures'").collect()} >= {"enterprise search stack", "classic qa pipeline"}
    asked = spark.createDataFrame([(1, doc, "design_pattern"), (2, doc, None)], "question_id int, doc_id long, category string")
    got = graph.category_matches(asked, held.table("nodes")).collect()
    assert {r.entity for r in got} >= {"Many-grained indexing"} and {r.score for r in got} == {9.0}
    assert one(spark, lambda x: graph.category_answer(F.lit("design_pattern"), F.array(x, x)), "a").startswith("The document mentions these design pattern items:\n1. a")


def test_answers_end_to_end(spark, stored, tmp_path):
    """The six kinds of cases and one without evidence, held against what they must and must not say."""
    held, told, _ = stored
    doc = told["a.txt"].doc_id

    def save(rows, name):
        rows.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.schema(rows.schema).parquet(str(tmp_path / name))

    asked = spark.createDataFrame([(n, doc, q) for n, q, *_ in CASES] + [(8, 12345, "What is stored?"), (9, doc, " ")], "question_id int, doc_id long, question string")
    tables = {name: held.table(name) for name in store.TABLES}
    rows = save(answer.ask(asked, tables, save), "answers")
    given = rows.select(F.col("question_id").alias("case_id"), F.col("answer_mode").alias("mode"), answer.said(rows).alias("text"))
    cases = spark.createDataFrame([(n, mode, yes, no) for n, _, mode, yes, no in CASES], "case_id int, mode string, contains array<string>, not_contains array<string>")
    failed = [(r.case_id, r.name) for r in evaluate.checks(cases, given).where("not passed").collect()]
    assert failed == [], given.collect()
    by = {r.question_id: r for r in rows.collect()}
    assert set(by) == set(range(1, 8)) and by[1].section == "Existing architectures" and by[2].strategy == "SECTION_LEVEL" and all(len(r.cards) <= 3 for r in by.values())
    every = answer.ask_all(spark.createDataFrame([(1, "Where is Alpha Reader mentioned?"), (2, "plain")], "question_id int, question string"), tables).collect()
    assert any("Alpha Reader" in r.snippet for r in every if r.question_id == 1) and {r.snippet for r in every if r.question_id == 2 and r.rank == 1} == {"plain"}


def test_validation_reasons(spark):
    registry = spark.createDataFrame([(1, "design_pattern", "Design patterns", ["ordinal_design_pattern"], ["pattern"], ["fast path"]), (1, "architecture", "Architectures", [], ["architecture"], ["search stack"])], "doc_id long, category string, section string, grammars array<string>, type_phrases array<string>, known array<string>")
    hits = [("Fast path", "The first pattern is fast path.", "Design patterns"), ("Fast path", "The first pattern is fast path.", "Other"), ("Search stack", "The first architecture is the search stack.", "Design patterns"), ("Thing", "The most common pattern here is thing.", ""), ("Thing", "A pattern is a thing.", ""), ("Thing", " ", "")]
    rows = spark.createDataFrame([(1, "design_pattern", n, *h) for n, h in enumerate(hits)], "doc_id long, category string, n int, entity string, sentence string, section string")
    got = [r.reason for r in extract.validate(rows, registry).orderBy("n").collect()]
    assert got == ["", extract.SCOPE, extract.CONFLICT, extract.BOUNDARY, extract.MISMATCH, extract.MISMATCH]


def test_implied_architectures(spark):
    said = ["OpenEphyra is a modular implementation of question analysis.", "It is old.", "This pipeline is still the cleanest conceptual answer.", "The weather is nice."]
    rows = spark.createDataFrame([(d, n, x) for d in (1, 2) for n, x in enumerate(said) if d == 1 or n] + [(3, 0, "An ontology helps."), (3, 1, "This pipeline is the cleanest conceptual answer."), (4, 0, "That architecture is fine.")], "doc_id long, ord long, sentence string")
    got = {(r.doc_id, r.ord, r.pattern) for r in extract.architectures(rows).collect()}
    assert got == {(1, 0, "open_ephyra_pipeline_inference"), (3, 1, "coreference_pipeline_resolution")}


def test_question_categories(spark):
    found = spark.createDataFrame([(1, "design_pattern", "Design patterns for use", 0.95), (1, "tool", "Handy things", 0.8)], "doc_id long, category string, source_section string, confidence double")
    asked = spark.createDataFrame([(1, 1, "what are design patterns"), (2, 1, "show tools"), (3, 1, "name all handy things"), (4, 1, "which architectures"), (5, 1, "why so")], "question_id int, doc_id long, question string")
    got = {r.question_id: (r.category, r.confidence) for r in schema.question_category(asked, found).collect()}
    assert got[1] == ("design_pattern", 0.95) and got[3][0] == "tool" and got[4] == ("architecture", 0.95) and 5 not in got


def test_evidence_expressions(spark):
    mark = lambda x: evidence.highlight(x, F.array(F.lit("memory"), F.lit("mem"), F.lit("HPC"), F.lit("")))
    assert one(spark, mark, "hpc Memory mem [[memory]] a.b") == "[[hpc]] [[Memory]] [[mem]] [[memory]] a.b" and one(spark, mark, "") == ""
    assert one(spark, evidence.listed, "1. The first item\n- second one;\nThe third thing is apples.\nfoo\n2) the first item\n- ab") == ["first item", "second one", "apples"]
    assert one(spark, lambda x: evidence.listed_answer(F.lit("which different ones"), evidence.listed(x)), "- one a\n- two b") == "The document describes 2 different items from the retrieved evidence:\n- one a\n- two b"
    assert one(spark, evidence.lineage_answer, "its provenance and solver version") == "The document describes lineage using these extracted points:\n1. Provenance\n2. Solver version"
    assert one(spark, evidence.lineage_answer, "none") is None
    spans = one(spark, evidence.requirement_spans, "It must always hold. X is defined as y and shall be")
    assert [(r.label, r.text, r.start, r.end) for r in spans] == [("REQUIREMENT", "must always hold", 3, 19), ("DEFINITION", "is defined as", 23, 36), ("REQUIREMENT", "shall be", 43, 51)]
    assert one(spark, phrases.capitalised, "The Graph Store and Apache Tika met the Graph Store.") == ["Graph Store and Apache Tika", "Graph Store"]
    cards = lambda x: evidence.supporting(F.lit("A"), F.array(F.struct(F.lit("c").alias("citation"), x.alias("snippet"))))
    assert one(spark, cards, "[[x]]  y") == "A\n\nSupporting evidence:\n- (1) c: x y"
    assert one(spark, evidence.why_matched, ["a", "b"], "array<string>") == "Matched terms: a, b. Ranked using deterministic BM25 over lexical index."
    assert [one(spark, intent.lists, q) for q in ("list them", "What are these", "which steps", "why", "")] == [True, True, True, False, False]
    assert one(spark, intent.about_lineage, "Explain lineage") and not one(spark, intent.about_lineage, "lineage")
    assert one(spark, lambda x: answer.readiness(x, F.lit(4), F.lit(2), F.lit(True)), 100, "int") == "GREEN+ - READY_FOR_EVAL" and one(spark, lambda x: answer.readiness(x, F.lit(1), F.lit(2), F.lit(True)), 100, "int") == "YELLOW - STRUCTURE_WEAK"


def test_layout_repair(spark):
    assert one(spark, layout.repaired, "found it. Existing architectures The most  common.\r\n\n\n\nx ") == "found it.\n\nExisting architectures\n\nThe most common.\n\nx"
    assert one(spark, layout.repaired, "  ") == "  " and one(spark, layout.repaired, None) is None
    assert [one(spark, layout.inline_heading, x) for x in ("Data Model", "ends here.", "all lower", "what it Is", "ab")] == [True, False, False, True, False]


def test_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    said = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    body = said("One") + said(" ") + f"<w:tbl><w:tr><w:tc>{said('a')}</w:tc><w:tc>{said('b')}</w:tc></w:tr><w:tr><w:tc>{said('c')}</w:tc><w:tc>{said('')}</w:tc></w:tr></w:tbl>" + said("Two")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:p xmlns:c="x" xmlns:d="y"><d:creator>Ann</d:creator><d:title></d:title></c:p>')
    (tmp_path / "a.docx").write_bytes(made.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("three")
    (tmp_path / "d.bin").write_text("four")
    by = {r.file_name: r for r in office.read_documents(spark, str(tmp_path)).collect()}
    assert set(by) == {"a.docx", "b.docx", "c.txt"} and by["a.docx"].text == "One\n\na | b\nc |\n\nTwo".replace("c |\n", "c |\n") and by["a.docx"].metadata == {"author": "Ann"}
    assert by["b.docx"].text is None and by["b.docx"].warnings == ["extraction failed: BadZipFile"] and by["c.txt"].text == "three"
    with pytest.raises(ValueError):
        office.read_document(spark, str(tmp_path / "d.bin"))


def test_sections_from_chunks(spark):
    chunks = spark.createDataFrame([(1, "section", 1, 1, "# Alpha"), (1, "paragraph", 3, 6, "some plain words\nDesign Patterns\nand more of it\nThis is a pattern."), (1, "section", 8, 8, "Beta"), (1, "paragraph", 9, 9, "at the end")], "doc_id long, chunk_type string, start_line int, end_line int, text string")
    got = sections.from_chunks(chunks).orderBy("start_line").collect()
    assert [(r.section_id, r.title, r.start_line, r.end_line) for r in got] == [("sec-00001-alpha", "# Alpha", 1, 3), ("derived-00004", "Design Patterns", 4, 7), ("sec-00008-beta", "Beta", 8, 9)]
    stored = spark.createDataFrame([(1, "s1", "alpha", 1, 1)], "doc_id long, section_id string, title string, level int, start_line int")
    ends = spark.createDataFrame([(1, 9)], "doc_id long, _last int")
    both = sections.united(stored, sections.from_chunks(chunks), ends).orderBy("start_line").collect()
    assert [(r.section_id, r.start_line, r.end_line) for r in both] == [("s1", 1, 3), ("derived-00004", 4, 7), ("sec-00008-beta", 8, 9)]
    assert sections.by_title(sections.from_chunks(chunks), "pattern").first().section_id == "derived-00004" and sections.by_category(sections.from_chunks(chunks), "design_pattern").count() == 1


def test_second_index_and_modes(spark):
    chunks = spark.createDataFrame([(1, "a", "fast index of terms"), (1, "b", "fast fast path"), (2, "c", "slow index")], "doc_id long, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "fast index"), (2, "path"), (3, "nothing here")], "question_id int, question string")
    terms = index.postings(chunks)
    second = {(r.question_id, r.chunk_id) for r in index.second_search(terms, asked).collect()}
    assert second == {(1, "a"), (2, "b")}
    hybrid = index.retrieve(chunks, asked, "hybrid", terms)
    assert {(r.question_id, r.chunk_id) for r in hybrid.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "b")} and hybrid.columns == ["question_id", "rank", "doc_id", "chunk_id", "score", "matched"]
    assert {r.question_id for r in index.retrieve(chunks, asked, "second", terms).collect()} == {1, 2}
    with pytest.raises(ValueError):
        index.retrieve(chunks, asked, "none")


def test_literal_and_joined_search_agree(spark, monkeypatch):
    chunks = spark.createDataFrame([(d, c, " ".join(f"w{(d * c + k) % 7}" for k in range(d + c))) for d in range(1, 6) for c in range(1, 6)], "doc_id long, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w6"), (3, "the")], "question_id int, question string")
    want = sorted(map(tuple, index.search(chunks, asked).collect()))
    monkeypatch.setattr(index, "LITERAL_TERMS", 0)
    assert sorted(map(tuple, index.search(chunks, asked).collect())) == want and want


SUITE = """# a suite
document: a.txt

cases:
  - id: list
    question: what are different architectures mentioned in the pdf?
    expected_answer_mode: STRUCTURED_EXTRACTIVE
    expected_retrieval_strategy: SECTION_LEVEL
    expected_section: existing Architectures
    expected_contains:
      - Enterprise search stack
      - "Classic QA pipeline"
    expected_not_contains:
      - Many-grained indexing
  - id: none
    question: 'zebra: quagga'
    expected_answer_mode: NO_EVIDENCE
  - id: wrong
    question: What implements policy?
    expected_answer_mode: EVIDENCE_ONLY
    expected_section: Nowhere
    expected_contains:
      - zebra
    expected_not_contains:
      - compliance
"""


def test_suite_is_read_run_and_reported(spark, tmp_path):
    (tmp_path / "benchmark_docs").mkdir()
    (tmp_path / "benchmark_docs" / "a.txt").write_text(DOC)
    (tmp_path / "questions.yaml").write_text(SUITE)
    name, cases = suites.read_suite(spark, str(tmp_path / "questions.yaml"))
    got = {r.case_id: r for r in cases.collect()}
    assert name == "a.txt" and got["list"].contains == ["Enterprise search stack", "Classic QA pipeline"] and got["none"].question == "zebra: quagga" and got["none"].contains == []
    total, rows = suites.run_suite(spark, str(tmp_path), store.Store(spark, str(tmp_path / "store")))
    total, rows = spark.createDataFrame(total.collect(), total.schema), spark.createDataFrame(rows.collect(), rows.schema)
    by = {r.case_id: r for r in rows.collect()}
    assert by["list"].passed and by["none"].passed and by["list"].section == "Existing architectures"
    assert by["wrong"].failures == ["answer_mode expected EVIDENCE_ONLY, got GRAPH_STRUCTURED", "section expected 'Nowhere', got ''", "missing expected phrase: 'zebra'", "unexpected phrase present: 'compliance'"]
    assert evaluate.summary_text(total).first().text == "total_cases=3\npassed=2\nfailed=1\nanswer_mode_accuracy=66.67%\ncontains_pass_rate=66.67%\nnot_contains_violations=1"
    lines = [r.line for r in evaluate.table_lines(rows).orderBy("n").collect()]
    assert len(lines) == 5 and len(set(map(len, lines))) == 1 and lines[0].startswith("CASE  | STATUS | MODE ") and set(lines[1]) == set("-+") and lines[2].startswith("list  | PASS ")
    report = json.loads(evaluate.report_json(total, rows).first().json)
    assert report["failed_cases"] == 1 and report["success"] is False and [c["case_id"] for c in report["cases"]] == ["list", "none", "wrong"] and report["cases"][1]["actual_section"] is None


def test_suite_errors():
    assert suites.parse("") is None and suites.parse("a:\n- x\n- 'y'\nb:\nc: 1") == {"a": ["x", "y"], "b": "", "c": "1"}
    for bad in ("a: 1\n  b: 2", "- x\ny: 1", "just words"):
        with pytest.raises(ValueError):
            suites.parse(bad)


def test_suite_without_cases(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("document: a.txt\ncases:\n")
    with pytest.raises(ValueError):
        suites.read_suite(spark, str(tmp_path / "q.yaml"))


def test_preflight_and_suggestions(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "short"), (3, None), (4, "plain words. " * 10)], "doc_id long, text string")
    by = {r.doc_id: r for r in answer.preflight(docs).collect()}
    assert by[1].readiness == "GREEN+ - READY_FOR_EVAL" and by[1].sections == 4 and [(x.strategy, x.section) for x in by[1].outlook] == [("SECTION_LEVEL", "Existing architectures"), ("SECTION_LEVEL", "Design patterns for implementation"), ("CHUNK_LEVEL or GRAPH", None)]
    assert by[2].readiness == by[3].readiness == "RED - NOT_READY" and by[3].chars == 0 and by[4].readiness == "YELLOW - STRUCTURE_WEAK" and by[4].outlook is None
    rows = [("Architecture.pdf", [], 0), ("a.txt", ["design pattern"], 3), ("a.txt", ["design pattern"], 0), ("a.txt", [], 9)]
    got = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, name string, categories array<string>, edges long").orderBy("n").select(answer.suggested(F.col("name"), F.col("categories"), F.col("edges")).alias("s")).collect()
    assert [r.s == list(answer.SUGGESTED) for r in got] == [True, True, False, False] and got[2].s == list(answer.GENERAL)


def test_upload_names(spark):
    cases = {"a b.txt": "a b.txt", 'x<y>:"z|?*.pdf': "x_y___z___.pdf", "../a": None, "a/b": None, "a\\b": None, "": None, " ": "upload.bin", ".": "upload.bin"}
    assert {k: one(spark, files.safe_name, k) for k in cases} == cases


def test_what_is_known_as_json(spark, stored):
    held, told, _ = stored
    for kind, names in exchange.KINDS.items():
        tables = {name: held.table(name) for name in names}
        texts = exchange.dump(tables, kind)
        back = exchange.load(texts, kind)
        assert set(back) == set(names) and set(json.loads(texts.where(F.col("doc_id") == told["a.txt"].doc_id).first().json)) == set(names)
        for name in names:
            assert sorted(map(repr, map(tuple, back[name].select(*tables[name].columns).collect()))) == sorted(map(repr, map(tuple, tables[name].collect())))
    bad = spark.createDataFrame([(1, "no json"), (2, None)], "doc_id long, json string")
    assert [rows.count() for rows in exchange.load(bad, "graph").values()] == [0, 0]


def test_trace_lines(spark):
    asked = spark.createDataFrame([(1, "forward", "Alpha", "uses"), (2, "forward", "Gone", "uses")], "question_id int, kind string, entity string, relation string")
    edges = graph.edges(graph.triples(spark.createDataFrame([("Alpha uses beta box.",), ("Alpha uses gamma.",)], "sentence string")))
    found = graph.match(asked, edges)
    by = lambda rows: {r[0]: r.lines for r in rows.collect()}
    got = by(trace.matches(asked, found, edges))
    assert got[1] == ["graph_matching_used=True", "graph_match_count=2", "graph_top_match=alpha --uses--> beta box", "graph_answer_entities=[beta box, gamma]"]
    assert got[2] == ["graph_matching_used=True", "graph_match_count=0", "graph_top_match=", "graph_answer_entities=[]"]
    got = by(trace.answers(asked, found, graph.answers(asked, found)))
    assert got[1] == ["graph_answer_candidate=True", "graph_answer_used=True", "graph_answer_confidence=11.00", "graph_answer_entities=[beta box, gamma]"]
    assert got[2] == ["graph_answer_candidate=False", "graph_answer_used=False", "graph_answer_confidence=0.00", "graph_answer_entities=[]"]
    checked = spark.createDataFrame([(1, "c", 2, "b", "late"), (1, "c", 1, "a", "early"), (1, "c", 0, "x", ""), (2, "c", 0, "y", "")], "doc_id long, category string, ord long, entity string, reason string")
    got = by(trace.validation(checked))
    assert got[1][1:] == ["validated_entities_count=1", "rejected_entities_count=2", "rejected_entities=[a, b]", "rejection_reason=early"] and len(got[2]) == 3
