"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document's expected copies are the target over the source's
words. Within a source, documents stand in order of size; their expected copies are summed up along that order,
one offset in [0, 1) is added, and a document is emitted once for each whole number that its stretch crosses. In size order
a source's taken words stay within about one document of the target. The offset is drawn from a hash of
seed and source, so reruns agree. Positions are exact multiples: rank times the expected copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, Scratch, table
from quillspark.llm.ranks import ranked

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: one row for each source with ``_source``, ``source_size``. Adds ``target``.

    Sources by code point, null last, take the weights in turn. share times all words is dealt by weight; a
    target stops at most times its source's words, and the excess is dealt again to the others by weight. Those
    that stop are the first in order of limit per weight, so one pass in that order finds the final rate.
    There is one row for each source, not for each document, in these windows.
    """
    at = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    whole, past, rest = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))) / F.sum("_w").over(rest)
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_rate", rate)
    free = F.when(F.col("_cap") / F.col("_w") >= F.col("_rate"), F.struct("_k", "_rate"))
    rows = rows.withColumn("_final", F.min(free).over(whole)["_rate"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_final")))
    return rows.select("_source", "source_size", target.alias("target"))


#: Up to so many rows (id, copies) are broadcast to the texts; more are joined.
BROADCAST_COPIES = 2_000_000


def _drawn(rows: DataFrame, scratch: Scratch, seed: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """rows: ``_source, _size, _id`` and others. Adds ``_source_size, _target, _copies``."""
    rows = ranked(rows, "_source", ["_size", "_id"], scratch)
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    goal = scratch.save(targets(sizes, weights, share, most), "targets").toDF("_s", "_source_size", "_target")
    rows = rows.join(F.broadcast(goal) if goal.count() <= 200_000 else goal, F.col("_source").eqNullSafe(F.col("_s")))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("_source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = rows.withColumn("_each", each).withColumn("_offset", offset)
    copies = F.floor(F.col("_rank") * F.col("_each") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_each") + F.col("_offset"))
    return rows.withColumn("_copies", copies.cast("int")).drop("_s", "_rank", "_each", "_offset")


def _named(docs: DataFrame, size_col: str | None, text_col: str, source_col: str, id_col: str) -> list[Column]:
    """Source, size and id under names of their own."""
    size = F.col(size_col).cast("long") if size_col else size_in_words(F.col(text_col))
    return [F.col(source_col).alias("_source"), size.alias("_size"), F.col(id_col).alias("_id")]


def mix(docs: DataFrame, seed: str = "mix", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", size_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with ``_size, _source_size, _target, _copies``: the copies of each row that the mix takes, 0 to ceil(most).

    size_col: a column that holds the size already; the text is not read then. Null texts have size 0; null is a source; rows
    without an id come first among equal sizes; repeated rows are rows of their own. A source without words has target 0 and
    gives no copies. An empty table gives no rows. Columns of docs with one of the four names are replaced, all others are kept.
    """
    made = ("_size", "_source_size", "_target", "_copies")
    rows = docs.select(F.struct("*").alias("_row"), *_named(docs, size_col, text_col, source_col, id_col))
    rows = _drawn(rows, Scratch(docs.sparkSession, "mix"), seed, weights, share, most)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in made], *made)


def repeat(docs: DataFrame, seed: str = "mix", text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as ``mix`` takes it, with the columns of docs as they are.

    Only ids, sources and sizes are sorted; texts meet their number of copies by id. Where an id repeats or is null,
    whole rows are sorted instead, with the same result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = _named(docs, None, text_col, source_col, id_col)
    thin = scratch.save(docs.select(*names), "sizes")
    n = thin.agg(F.count(F.lit(1)).alias("rows"), F.count("_id").alias("ids")).first()
    again = F.expr("sequence(1, _copies)")
    if n.rows == n.ids and thin.groupBy("_id").count().where("count > 1").isEmpty():
        taken = _drawn(thin, scratch, seed, weights, share, most).where("_copies > 0").select("_id", "_copies")
        rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id")).join(F.broadcast(taken) if n.rows <= BROADCAST_COPIES else taken, "_id")
    else:
        rows = _drawn(docs.select(F.struct("*").alias("_row"), *names), scratch, seed, weights, share, most).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(again)).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source", size_in_words(F.col("text")).alias("_n")), size_col="_n")
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


OP6_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nr from d group by source),
w as (select *, case nr % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap from s),
r as (select *, row_number() over o as k,
    ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as rate
  from w window o as (order by cap / w, source nulls last)),
f as (select min_by(rate, k) as final from r where cap / w >= rate),
t as (select source, source_size, case when final is null then cap else least(cap, w * final) end as target from r, f),
e as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as each,
    ('0x' || substr(md5('mix|' || coalesce(t.source, '')), 1, 8))::bigint::double / 4294967296.0::double as u,
    row_number() over (partition by d.source order by d.size, d.doc_id nulls first) as k
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(k * each + u) - floor((k - 1) * each + u)) * size)::bigint as taken from e
"""
