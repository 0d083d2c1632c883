"""Lines that say how an answer came about: matches of a graph, answers, validation. Each is ``key=value``; a list shows its first eight values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 8


def _line(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}="), F.coalesce(value.cast("string"), F.lit("")))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.slice(values, 1, SHOWN), ", "), F.lit("")), F.lit("]"))


def _flag(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def _in_order(value: str, by: str) -> Column:
    """Distinct values (in any case) in their order."""
    every = F.transform(F.sort_array(F.collect_list(F.struct(by, value))), lambda x: x[value])
    low = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def matches(asked: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """``question_id, lines`` of every question: whether and what its graph matched. found: from graph.match or graph.category_matches;
    edges: the graph's, which tell what the best match states."""
    by = ["edge_id", *(["doc_id"] if {"doc_id"} <= set(asked.columns) & set(edges.columns) else [])]
    rows = found if "edge_id" in found.columns else found.withColumn("edge_id", F.lit(""))
    rows = rows.select("question_id", "rank", "entity", "edge_id").join(asked.select("question_id", *by[1:]), "question_id")
    stated = edges.select(*by, F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target").alias("said"))
    rows = rows.join(stated, by, "left").withColumn("said", F.coalesce("said", F.concat(F.lit("node: "), "entity")))
    told = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("said", "rank").alias("top"), _in_order("entity", "rank").alias("e"))
    told = asked.select("question_id").join(told, "question_id", "left")
    lines = F.array(F.lit("graph_matching_used=True"), _line("graph_match_count", F.coalesce("n", F.lit(0))), _line("graph_top_match", F.col("top")), _line("graph_answer_entities", _list(F.col("e"))))
    return told.select("question_id", lines.alias("lines"))


def answers(asked: DataFrame, found: DataFrame, made: DataFrame) -> DataFrame:
    """``question_id, lines`` of every question: whether its graph gave an answer (graph.answers) and how sure it is."""
    e = found.groupBy("question_id").agg(_in_order("entity", "rank").alias("e"))
    rows = asked.select("question_id").join(e, "question_id", "left").join(made.select("question_id", "confidence_score"), "question_id", "left")
    used = F.col("confidence_score").isNotNull()
    lines = F.array(
        _line("graph_answer_candidate", _flag(F.col("e").isNotNull())), _line("graph_answer_used", _flag(used)),
        _line("graph_answer_confidence", F.format_string("%.2f", F.coalesce("confidence_score", F.lit(0.0)))), _line("graph_answer_entities", _list(F.when(used, F.col("e")))),
    )
    return rows.select("question_id", lines.alias("lines"))


def validation(checked: DataFrame) -> DataFrame:
    """``doc_id, category, lines`` of entities that extract.validate has judged (``ord`` gives their order): how many stay, which go and why the first goes."""
    bad = F.col("reason") != ""
    rows = checked.groupBy("doc_id", "category").agg(F.count_if(~bad).alias("kept"), F.sort_array(F.collect_list(F.when(bad, F.struct("ord", "entity", "reason")))).alias("gone"))
    lines = F.array(F.lit("entity_validation_enabled=True"), _line("validated_entities_count", F.col("kept")), _line("rejected_entities_count", F.size("gone")))
    why = F.array(_line("rejected_entities", _list(F.transform("gone", lambda x: x["entity"]))), _line("rejection_reason", F.try_element_at("gone", F.lit(1))["reason"]))
    return rows.select("doc_id", "category", F.when(F.size("gone") > 0, F.concat(lines, why)).otherwise(lines).alias("lines"))
