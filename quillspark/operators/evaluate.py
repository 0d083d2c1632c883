"""Checks of answers against expectations, their summary and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADERS = ("CASE", "STATUS", "MODE", "STRATEGY", "SECTION", "FAILURES")
#: What a case may expect besides the mode: its column, what it is called, and whether case and blanks count.
FURTHER = (("strategy", "retrieval_strategy", True), ("section", "section", False))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(x, F.lit("")), F.lit("'"))


def checks(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, n, name, passed, failure``, n in the order of a case. cases: ``case_id, mode, contains, not_contains`` (arrays) and, where a case expects them, ``strategy`` and ``section``;
    answers: ``case_id, mode, text`` and these. A missing answer fails; what a case leaves null or empty isn't checked."""
    c, none = F.col, F.lit(None).cast("string")
    given = answers.select("case_id", c("mode").alias("_m"), F.lower(F.coalesce("text", F.lit(""))).alias("_t"), *[(c(x) if x in answers.columns else none).alias(f"_{x}") for x, *_ in FURTHER])
    rows = cases.join(given, "case_id", "left")
    text = F.coalesce("_t", F.lit(""))
    check = lambda name, passed, failure: F.struct(name.alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), F.when(~F.coalesce(passed, F.lit(False)), failure).alias("failure"))
    expected = lambda name, want, got: F.concat(F.lit(f"{name} expected "), want, F.lit(", got "), got)
    each = lambda column, prefix, test, failure: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda p: check(F.concat(F.lit(prefix), p), test(text.contains(F.lower(p))), F.concat(F.lit(failure), _quoted(p))))
    every = [F.array(check(F.lit("answer_mode"), c("mode") == c("_m"), expected("answer_mode", F.coalesce("mode", F.lit("")), F.coalesce("_m", F.lit("")))))]
    for column, name, exact in FURTHER:
        if column in cases.columns:
            form = (lambda x: x) if exact else (lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
            shown = (lambda x: F.coalesce(x, F.lit(""))) if exact else _quoted
            one = F.array(check(F.lit(name), form(c(column)) == form(c(f"_{column}")), expected(name, shown(c(column)), shown(c(f"_{column}")))))
            every.append(F.when(F.coalesce(F.trim(column), F.lit("")) != "", one).otherwise(F.slice(one, 1, 0)))
    every += [each(c("contains"), "contains:", lambda x: x, "missing expected phrase: "), each(c("not_contains"), "not_contains:", lambda x: ~x, "unexpected phrase present: ")]
    return rows.select("case_id", F.posexplode(F.concat(*every)).alias("n", "_c")).select("case_id", "n", "_c.*")


def summary(made: DataFrame) -> DataFrame:
    """One row of counts and rates; a rate without checks is 1."""
    name, passed = F.col("name"), F.col("passed")
    kinds = {"mode": name == "answer_mode", "has": name.startswith("contains:"), "lacks": name.startswith("not_contains:")}
    counts = [x for k, test in kinds.items() for x in (F.count_if(test).alias(f"{k}_n"), F.count_if(test & passed).alias(f"{k}_ok"))]
    cases = made.groupBy("case_id").agg(F.min("passed").alias("ok"), *counts)
    rate = lambda k: F.when(F.sum(f"{k}_n") > 0, F.sum(f"{k}_ok") / F.sum(f"{k}_n")).otherwise(1.0)
    missed = F.coalesce(F.sum(F.col("lacks_n") - F.col("lacks_ok")), F.lit(0))
    return cases.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("ok").alias("passed_cases"), rate("mode").alias("answer_mode_accuracy"), rate("has").alias("contains_pass_rate"), missed.alias("not_contains_violations"))


def results(made: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, passed, mode, strategy, section, failures`` of each case; failures in the order of their checks."""
    failures = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("n", "failure"))))
    rows = made.groupBy("case_id").agg(F.min("passed").alias("passed"), F.transform(failures, lambda x: x["failure"]).alias("failures"))
    return rows.join(answers.select("case_id", "mode", "strategy", "section"), "case_id", "left").select("case_id", "passed", "mode", "strategy", "section", "failures")


def table_lines(rows: DataFrame) -> DataFrame:
    """``n, line``: results as a padded text table, its header first. A suite's report is small: one task lays it out."""
    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    cells = [F.coalesce(x, F.lit("")) for x in (F.col("case_id").cast("string"), status, F.col("mode"), F.col("strategy"), F.col("section"), F.array_join("failures", "; "))]
    numbered = rows.select(F.row_number().over(Window.orderBy("case_id")).alias("n"), F.array(*cells).alias("cells"))
    spark = rows.sparkSession
    numbered = spark.createDataFrame([(-1, list(HEADERS))], "n int, cells array<string>").unionByName(numbered)
    every = Window.partitionBy()
    widths = [F.max(F.length(F.col("cells")[k])).over(every).alias(f"w{k}") for k in range(len(HEADERS))]
    numbered = numbered.select("n", "cells", *widths)
    padded = F.array_join(F.array(*[F.rpad(F.col("cells")[k], F.col(f"w{k}"), F.lit(" ")) for k in range(len(HEADERS))]), " | ")
    ruler = F.array_join(F.array(*[F.repeat(F.lit("-"), F.col(f"w{k}")) for k in range(len(HEADERS))]), "-+-")
    return numbered.select(F.inline(F.when(F.col("n") == -1, F.array(F.struct("n", padded.alias("line")), F.struct(F.lit(0).alias("n"), ruler.alias("line")))).otherwise(F.array(F.struct("n", padded.alias("line"))))))


def summary_text(row: DataFrame) -> DataFrame:
    """``text``: the summary in lines."""
    share = lambda x: F.format_string("%.2f%%", F.col(x) * 100)
    failed = F.col("total_cases") - F.col("passed_cases")
    parts = (("total_cases", F.col("total_cases")), ("passed", F.col("passed_cases")), ("failed", failed), ("answer_mode_accuracy", share("answer_mode_accuracy")), ("contains_pass_rate", share("contains_pass_rate")), ("not_contains_violations", F.col("not_contains_violations")))
    return row.select(F.concat_ws("\n", *[F.concat(F.lit(f"{name}="), x.cast("string")) for name, x in parts]).alias("text"))


def report_json(row: DataFrame, rows: DataFrame) -> DataFrame:
    """``json``: summary and results as one indented document."""
    case = F.struct("case_id", "passed", F.col("mode").alias("actual_answer_mode"), F.col("strategy").alias("actual_retrieval_strategy"), F.col("section").alias("actual_section"), "failures")
    every = rows.agg(F.sort_array(F.collect_list(case)).alias("cases"))
    failed = F.col("total_cases") - F.col("passed_cases")
    made = F.struct("total_cases", "passed_cases", failed.alias("failed_cases"), "answer_mode_accuracy", "contains_pass_rate", "not_contains_violations", (failed == 0).alias("success"), "cases")
    return row.crossJoin(F.broadcast(every)).select(F.to_json(made, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
