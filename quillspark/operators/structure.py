"""Document structure from numbered lines (``doc_id, line_no, line``): headings, their tree, and paragraph chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import headings as h
from quillspark.functions import text as t

#: Levels that headings can have; numbered headings get one for each part of their number.
LEVELS = 12
#: Paragraphs longer than this are cut.
MAX_CHARS = 1200
# The forms of list items and table rows.
LIST_ITEM = r"^(?:[-*•]|\d+[.)])\s+(?d:.+)"
TABLE_ROW = r"^\|(?d:.+)\|$|^[^|]+\|[^|]+$"


def lines(docs: DataFrame) -> DataFrame:
    """Lines of documents, numbered from 1."""
    each = F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("_n", "line")
    return docs.select("doc_id", each).select("doc_id", (F.col("_n") + 1).alias("line_no"), "line")


def heading(line: Column) -> Column:
    """(title, level) of a heading by its own form, else null: markdown, appendix, section label, numbered, upper case."""
    s = h.strip(line)
    part = lambda p, g: F.regexp_extract(s, p, g)
    made = lambda title, level: F.struct(title.alias("title"), F.lit(level).cast("int").alias("level"))
    mark, appendix, label, number = r"^(#{1,6})\s+(.+?)\s*$", r"(?i)^Appendix\s+([A-Z])(?:\s*[:.\-]\s*(.+))?\s*$", r"(?i)^Section\s+(\d+)\s*(?:[:.\-]\s*)?(.*)$", r"^(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$"
    named = lambda word, p: F.concat_ws(": ", F.concat(F.lit(word), part(p, 1)), F.when(part(p, 2) != "", F.trim(part(p, 2))))
    level = F.size(F.split(part(number, 1), r"\."))
    upper = F.length(s).between(4, 100) & s.rlike(r"^[A-Z][A-Z0-9\s\-/&(),]+$") & (F.regexp_count(s, F.lit("[A-Z]")) >= 3)
    return (
        F.when(s.rlike(mark), F.struct(part(mark, 2).alias("title"), F.length(part(mark, 1)).alias("level")))
        .when(s.rlike(appendix), made(named("Appendix ", appendix), 1))
        .when(s.rlike(label), made(named("Section ", label), 1))
        .when(s.rlike(number), F.struct(F.concat_ws(" ", part(number, 1), part(number, 2)).alias("title"), level.alias("level")))
        .when(upper, made(s, 1))
    )


def headings(rows: DataFrame) -> DataFrame:
    """Lines with ``title, level`` where a line is a heading: by its own form, by layout, or by the category it names."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    near = (F.col("line"), F.lag("line").over(order), F.lead("line").over(order))
    rows = rows.withColumn("_before", near[1]).withColumn("_after", near[2])
    near = (F.col("line"), F.col("_before"), F.col("_after"))
    own = F.struct(h.strip(F.col("line")).alias("title"), F.lit(1).alias("level"))
    found = F.coalesce(heading(F.col("line")), F.when(h.is_layout_heading(*near) | h.is_category_heading(*near), own))
    # A generator keeps filters on title from being pushed below it, which would compute the rules again.
    one = F.array(F.coalesce(found, F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"))))
    return rows.select(*[c for c in rows.columns if c not in ("_before", "_after")], F.inline(one).alias("title", "level"))


def sections(rows: DataFrame) -> DataFrame:
    """``doc_id, section_id, title, level, start_line, end_line, parent_section_id``.

    The parent is the nearest earlier section of a smaller level; a section ends before the next of its own or a
    smaller level. Both come from windows over the document's headings, one running value for each level, so no
    section meets another in a join.
    """
    last = rows.groupBy("doc_id").agg(F.max("line_no").alias("_last"))
    found = headings(rows).where("title is not null").select("doc_id", F.col("line_no").alias("start_line"), "title", "level")
    return _ranged(found, last)


def section_id(start: Column, title: Column) -> Column:
    return F.concat(F.lit("sec-"), F.lpad(start.cast("string"), 5, "0"), F.lit("-"), t.slug(title))


def _ranged(found: DataFrame, last: DataFrame) -> DataFrame:
    """Parents and ends of headings ``doc_id, start_line, title, level``; last: ``doc_id, _last``."""
    found = found.withColumn("section_id", section_id(F.col("start_line"), F.col("title")))
    order = Window.partitionBy("doc_id").orderBy("start_line")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    at = lambda k, value: F.when(F.col("level") == k, value)
    own = F.struct("start_line", "section_id")
    earlier = F.array(*[F.when(F.col("level") > k, F.last(at(k, own), True).over(before)) for k in range(1, LEVELS)])
    later = F.array(*[F.when(F.col("level") >= k, F.first(at(k, F.col("start_line")), True).over(after)) for k in range(1, LEVELS + 1)])
    found = found.withColumn("parent_section_id", F.array_max(earlier)["section_id"]).withColumn("_next", F.array_min(later))
    found = found.join(last, "doc_id")
    return found.select("doc_id", "section_id", "title", "level", "start_line", F.coalesce(F.col("_next") - 1, "_last").alias("end_line"), "parent_section_id")


def _runs(rows: DataFrame, head: Column) -> DataFrame:
    """Lines that aren't blank with the number of their run; a heading is a run of its own."""
    rows = rows.withColumn("_head", head).withColumn("_blank", h.strip(F.col("line")) == "")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    cut = F.col("_head") | F.col("_blank") | F.coalesce(F.lag(F.col("_head") | F.col("_blank")).over(order), F.lit(True))
    return rows.withColumn("_run", F.sum(cut.cast("int")).over(order)).where("not _blank")


def _joined() -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")


def paragraphs(rows: DataFrame) -> DataFrame:
    """Chunks ``doc_id, chunk_type, start_line, end_line, text``: each heading line, and each run of other lines that aren't blank."""
    rows = _runs(headings(rows), F.col("title").isNotNull())
    kind = F.when(F.max("_head"), "section").otherwise("paragraph")
    chunks = rows.groupBy("doc_id", "_run").agg(kind.alias("chunk_type"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), _joined().alias("text"))
    return chunks.drop("_run")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pieces(lengths: pd.Series) -> pd.Series:
    """The piece of each line of a long paragraph: a new one starts where the next line would exceed MAX_CHARS."""

    def pack(sizes) -> list[int] | None:
        if sizes is None:
            return None
        numbers, used, piece = [], 0, 0
        for k, size in enumerate(sizes):
            need = size + 1 if k else size
            if k and used + need > MAX_CHARS:
                piece, used = piece + 1, 0
            used += need
            numbers.append(piece)
        return numbers

    return lengths.map(pack, na_action=None)


def chunks(rows: DataFrame, detect: bool = True) -> DataFrame:
    """As paragraphs, but those over MAX_CHARS become overflow pieces of whole lines, each starting with the last line of the one before.

    A line is never split, so a piece may be longer. Each document's lines meet in one shuffle. detect=False finds no headings.
    """
    rows = _runs(headings(rows), F.col("title").isNotNull()) if detect else _runs(rows, F.lit(False))
    each = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    runs = rows.groupBy("doc_id", "_run").agg(F.max("_head").alias("_head"), each.alias("_lines"))
    sizes = F.transform("_lines", lambda x: F.length(x["line"]))
    total = F.aggregate(sizes, F.lit(-1), lambda a, n: a + n + 1)
    runs = runs.withColumn("_long", ~F.col("_head") & (total > MAX_CHARS)).withColumn("_piece", _pieces(F.when(F.col("_long"), sizes)))
    flat = runs.select("doc_id", "_run", "_head", "_long", F.explode(F.arrays_zip("_lines", F.coalesce("_piece", F.transform("_lines", lambda x: F.lit(0)))).alias("_x")).alias("_x"))
    flat = flat.select("doc_id", "_run", "_head", "_long", F.col("_x")["_lines"]["line_no"].alias("line_no"), F.col("_x")["_lines"]["line"].alias("line"), F.col("_x")["1"].alias("_piece"))
    kind = F.when(F.max("_head"), "section").when(F.max("_long"), "overflow").otherwise("paragraph")
    made = flat.groupBy("doc_id", "_run", "_piece").agg(kind.alias("chunk_type"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), _joined().alias("text"), F.max_by("line", "line_no").alias("_last"))
    order = Window.partitionBy("doc_id").orderBy("start_line")
    before = lambda c: F.lag(c).over(order)
    joined = (F.col("chunk_type") != "section") & (before("chunk_type") != "section") & (before("end_line") + 1 >= F.col("start_line")) & ~F.col("text").startswith(before("_last"))
    made = made.withColumn("_over", F.when(joined, before("_last")))
    begun = F.col("start_line") - F.when(F.col("_over").isNotNull(), 1).otherwise(0)
    return made.select("doc_id", "chunk_type", begun.alias("start_line"), "end_line", F.concat_ws("\n", "_over", "text").alias("text"))


def assign_sections(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with ``section_id, section_title``: the innermost section of their first line, else of the first line in one; null if none.

    Ranges nest, so the innermost section of a line is the last that started: one window over starts, no range join.
    """
    starts = found.select("doc_id", F.col("start_line").alias("_at"), F.lit(0).alias("_side"), F.struct("start_line", "section_id", "title").alias("_s"))
    rows = chunks.select("doc_id", F.col("start_line").alias("_at"), F.lit(1).alias("_side"), F.struct(*chunks.columns).alias("_c"))
    both = starts.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_at", "_side")
    last = F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first("_s", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_in", last).withColumn("_next", coming).where("_c is not null")
    inside = F.coalesce("_in", F.when(F.col("_next")["start_line"] <= F.col("_c")["end_line"], F.col("_next")))
    return both.withColumn("_in", inside).select("_c.*", F.col("_in")["section_id"].alias("section_id"), F.col("_in")["title"].alias("section_title"))


def clip_to_section(text: Column, chunk_start: Column, start: Column, end: Column) -> Column:
    """The lines of a chunk that lie in a section, the whole text if none does."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: (chunk_start + i).between(start, end))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(text)


def chunk_id(name: Column, start: Column, end: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(name, start.cast("string"), end.cast("string"), text).cast("binary"), 256), 1, 12)


def tree(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes ``doc_id, ord, node_id, parent_id, node_type, start_line, end_line, text`` in preorder, below the document node.

    Sections hold paragraphs, list items and table rows; paragraphs hold sentences. chunks: with ``section_id`` (assign_sections).
    Chunks outside sections are no nodes. Blocks come from runs of lines of one kind, within each chunk.
    """
    node = lambda kind, a, b, text: F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, a, b, F.substring(text, 1, 80)).cast("binary"), 256), 1, 10))
    heads = found.select("doc_id", "section_id", F.col("start_line").alias("_s"), node("section", F.col("start_line"), F.col("end_line"), F.col("title")).alias("_sid"), F.col("end_line").alias("_e"), "title")
    body = chunks.where("chunk_type <> 'section' and section_id is not null").select("doc_id", "section_id", F.col("start_line").alias("_c"), F.posexplode(F.split("text", "\n")).alias("_i", "line"))
    s = h.strip(F.col("line"))
    kind = F.when(s.rlike(TABLE_ROW), "table_row").when(s.rlike(LIST_ITEM), "list_item").otherwise("paragraph")
    body = body.withColumn("kind", kind).withColumn("line_no", F.col("_c") + F.col("_i"))
    order = Window.partitionBy("doc_id", "_c").orderBy("_i")
    cut = (F.col("kind") != "paragraph") | F.coalesce(F.lag("kind").over(order) != "paragraph", F.lit(True))
    body = body.withColumn("_b", F.sum(cut.cast("int")).over(order))
    blocks = body.groupBy("doc_id", "section_id", "_c", "_b").agg(F.max("kind").alias("kind"), F.min("line_no").alias("a"), F.max("line_no").alias("b"), _joined().alias("text"))
    blocks = blocks.join(heads.select("doc_id", "section_id", "_s", "_sid"), ["doc_id", "section_id"]).withColumn("_id", node(F.col("kind"), F.col("a"), F.col("b"), F.col("text")))
    c = F.col
    key = lambda *parts: F.array(*[F.lit(p).cast("int") if isinstance(p, int) else p.cast("int") for p in parts])
    made = lambda k, i, parent, kind, a, b, text: F.struct(k.alias("_k"), i.alias("node_id"), parent.alias("parent_id"), kind.alias("node_type"), a.alias("start_line"), b.alias("end_line"), text.alias("text"))
    tops = heads.select("doc_id", made(key(c("_s"), -1, -1, -1), c("_sid"), F.lit("document-root"), F.lit("section"), c("_s"), c("_e"), c("title")).alias("_x"))
    row, para = h.strip(c("text")).rlike(TABLE_ROW), c("kind") == "paragraph"
    own = made(key(c("_s"), c("_c"), c("_b"), -1), c("_id"), c("_sid"), c("kind"), c("a"), c("b"), F.when(para, c("text")).otherwise(h.strip(c("text"))))
    place = lambda n: key(c("_s"), c("_c"), c("_b"), n)
    low = F.transform(t.sentences(c("text")), lambda x, n: made(place(n), node("sentence", c("a"), c("b"), x), c("_id"), F.lit("sentence"), c("a"), c("b"), x))
    odd = F.array(made(place(F.lit(0)), node("table_row", c("a"), c("b"), c("text")), c("_id"), F.lit("table_row"), c("a"), c("b"), h.strip(c("text"))))
    under = F.when(para & row, odd).when(para, low).otherwise(F.array_except(odd, odd))
    rest = blocks.select("doc_id", F.explode(F.concat(F.array(own), under)).alias("_x"))
    ranked = tops.unionByName(rest).select("doc_id", "_x.*")
    return ranked.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_k")).alias("ord"), *[x for x in ranked.columns if x not in ("doc_id", "_k")])


def section_texts(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, title, text`` of each section of a tree: its title, unless a paragraph holds it, and its blocks."""
    tops = nodes.where("node_type = 'section'").select("doc_id", "node_id", F.col("text").alias("title"))
    parts = nodes.where("node_type in ('paragraph', 'list_item', 'table_row')").select("doc_id", F.col("parent_id").alias("node_id"), "node_type", "ord", h.strip(F.col("text")).alias("part"))
    rows = tops.join(parts, ["doc_id", "node_id"], "left")
    said = F.max(F.coalesce((F.col("node_type") == "paragraph") & F.lower("part").contains(F.lower("title")), F.lit(False)))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("part") != "", F.struct("ord", "part")))), lambda x: x["part"])
    grouped = rows.groupBy("doc_id", "node_id", "title").agg(said.alias("_said"), body.alias("_body"))
    return grouped.select("doc_id", "node_id", "title", F.array_join(F.concat(F.when(F.col("_said"), F.array().cast("array<string>")).otherwise(F.array("title")), "_body"), "\n\n").alias("text"))
