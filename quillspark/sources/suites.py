"""Suites of questions with expected answers: read from a file, run on a store, reported."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import answer, evaluate
from quillspark.sources import office
from quillspark.sources.store import TABLES, Store

CASE = "case_id string, question string, mode string, contains array<string>, not_contains array<string>, strategy string, section string"
_KEY = re.compile(r"([A-Za-z_][\w-]*):(?:\s+(.*))?$")


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse(text: str):
    """Nested mappings and lists of plain strings, by indentation: the part of YAML that suites need. Blank lines and comments go."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.expandtabs().splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(k: int, indent: int):
        made = None
        while k < len(lines) and lines[k][0] == indent:
            said = lines[k][1]
            item, key = said.startswith("- "), _KEY.match(said)
            if isinstance(made, list) and not item:  # a list may stand as deep as its key: the key's mapping goes on
                break
            if item and not isinstance(made, dict):
                made = made or []
                inner = said[2:].lstrip()
                if _KEY.match(inner):
                    lines[k] = (indent + len(said) - len(inner), inner)
                    value, k = block(k, lines[k][0])
                else:
                    value, k = _scalar(inner), k + 1
                made.append(value)
            elif key and not item:
                made = {} if made is None else made
                if key[2]:
                    made[key[1]], k = _scalar(key[2]), k + 1
                else:
                    deeper = k + 1 < len(lines) and (lines[k + 1][0] > indent or (lines[k + 1][0] == indent and lines[k + 1][1].startswith("- ")))
                    made[key[1]], k = block(k + 1, lines[k + 1][0]) if deeper else ("", k + 1)
            else:
                raise ValueError(f"can't read the line {said!r}")
        return made, k

    made, end = block(0, lines[0][0]) if lines else (None, 0)
    if end < len(lines):
        raise ValueError(f"can't read the line {lines[end][1]!r}")
    return made


def read_suite(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The document's name and the cases (CASE) of a suite's file; without a document or a case, an error."""
    found = parse(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(found, dict):
        raise ValueError("a suite must be a mapping")
    name, cases = str(found.get("document") or "").strip(), [x for x in found.get("cases") or [] if isinstance(x, dict)]
    if not name or not cases:
        raise ValueError("a suite must name a document and hold a case")
    rows = [(x.get("id", x.get("case_id", "")), x["question"], x["expected_answer_mode"], x.get("expected_contains") or [], x.get("expected_not_contains") or [], x.get("expected_retrieval_strategy"), x.get("expected_section")) for x in cases]
    return name, spark.createDataFrame(rows, CASE)


def run_suite(spark: SparkSession, folder: str, held: Store, questions: str = "questions.yaml", documents: str = "benchmark_docs") -> tuple[DataFrame, DataFrame]:
    """Processes a suite's document into a store, asks its questions there, and returns summary and results."""
    name, cases = read_suite(spark, f"{folder}/{questions}")
    files = office.read_document(spark, f"{folder}/{documents}/{name}")
    told = held.process(files.select(F.col("file_name").alias("name"), F.col("checksum_sha256").alias("checksum"), F.col("file_size_bytes").alias("size_bytes"), "text"))
    save = held.scratch("suite")
    asked = cases.select(F.col("case_id").alias("question_id"), "question").join(F.broadcast(told.select("doc_id")))
    rows = save(answer.ask(asked, {t: held.table(t) for t in TABLES}, save), "answers")
    given = rows.select(F.col("question_id").alias("case_id"), F.col("answer_mode").alias("mode"), "strategy", "section", answer.said(rows).alias("text"))
    made = save(evaluate.checks(cases, given), "checks")
    return evaluate.summary(made), evaluate.results(made, given)
