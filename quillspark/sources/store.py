"""A store of processed documents: Parquet tables below one folder of any shared store, written in batches.

A batch's rows lie in a folder of each table that bears the batch's name; ``documents`` is written last, and reads see only
batches that it holds, so a batch that failed half-way is never seen and is processed again. Ids are hashes of checksums:
no coordination, and the same on every run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import extract, graph, index, schema, sections, structure

# The tables and their columns; documents comes last in a batch.
TABLES = {
    "sections": "doc_id long, section_id string, title string, level int, start_line int, end_line int, parent_section_id string",
    "chunks": "doc_id long, chunk_id string, chunk_type string, start_line int, end_line int, text string, section_id string, section_title string",
    "postings": "doc_id long, chunk_id string, term string, tf long, positions array<int>",
    "terms": "doc_id long, term string, df long, n long, idf double",
    "tree": "doc_id long, ord int, node_id string, parent_id string, node_type string, start_line int, end_line int, text string",
    "categories": "doc_id long, category string, source_section string, confidence double, patterns array<string>",
    "patterns": "doc_id long, category string, pattern_name string, hits long, ordinals long, type_phrases array<string>, triggers array<string>, examples array<string>, templates array<string>, confidence double, family string",
    "candidates": "doc_id long, sentence string, subject string, relation string, object string",
    "nodes": "doc_id long, node_id string, label string, normalized string, node_type string, section string, start_line int, end_line int, category string",
    "edges": "doc_id long, edge_id string, source string, relation string, target string, sentence string, section string, confidence double",
    "documents": "doc_id long, name string, checksum string, size_bytes long, text string, batch string",
}
AUDIT = "event_type string, message string, details string, doc_id long, created_at timestamp"
# The messages of events.
MESSAGES = (
    ("document_processed", "Document processed: ", "file_name"), ("duplicate_document_detected", "Duplicate document detected: ", "file_name"),
    ("document_processing_failed", "Document processing failed: ", "file_name"), ("question_asked", "Question asked: ", "question"), ("question_failed", "Question processing failed", None),
)


def message(event_type: Column, details: Column) -> Column:
    """The message of an event from its details (a map), or its type in words."""
    said = F.replace(event_type, F.lit("_"), F.lit(" "))
    for name, words, key in reversed(MESSAGES):
        value = details[key] if key else F.lit("x")
        said = F.when((event_type == name) & (F.coalesce(value, F.lit("")) != ""), F.concat(F.lit(words), value) if key else F.lit(words)).otherwise(said)
    return said


def plain_json(**values: Column) -> Column:
    """Compact JSON with sorted keys and without nulls."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        there, files = self._files(f"{self.root}/{name}")
        return files.exists(there)

    def _write(self, name: str, rows: DataFrame, batch: str) -> DataFrame:
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/b={batch}")
        return self.spark.read.schema(columns).parquet(f"{self.root}/{name}/b={batch}")

    def table(self, name: str) -> DataFrame:
        """All rows of whole batches; an empty table before the first."""
        empty = self.spark.createDataFrame([], TABLES[name])
        if not self._exists(name) or not self._exists("documents"):
            return empty
        rows = self.spark.read.schema(TABLES[name] + (", b string" if name != "documents" else "")).parquet(f"{self.root}/{name}")
        if name == "documents":
            return rows.select(*empty.columns)
        done = self.table("documents").select(F.col("batch").alias("b")).distinct()
        return rows.join(F.broadcast(done), "b", "left_semi").select(*empty.columns)

    def of(self, name: str, doc_id: int) -> DataFrame:
        """A document's rows, in their order."""
        order = {"chunks": ("start_line", "chunk_id"), "sections": ("start_line", "section_id"), "tree": ("ord",), "postings": ("chunk_id", "term"), "terms": ("term",)}.get(name, ())
        rows = self.table(name).where(F.col("doc_id") == doc_id)
        return rows.orderBy(*order) if order else rows

    def documents(self) -> DataFrame:
        return self.table("documents").drop("text", "batch").orderBy("doc_id")

    def by_checksum(self, checksum: str) -> DataFrame:
        return self.table("documents").where(F.col("checksum") == checksum)

    def has_index(self, doc_id: int) -> bool:
        return not self.of("terms", doc_id).isEmpty()

    def counts(self) -> DataFrame:
        """``doc_id, sections, chunks, terms`` of every document."""
        number = lambda name: self.table(name).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
        rows = self.table("documents").select("doc_id")
        for name in ("sections", "chunks", "terms"):
            rows = rows.join(number(name), "doc_id", "left")
        return rows.na.fill(0)

    def metadata(self) -> DataFrame:
        """``doc_id, categories, nodes, edges``: labels of a document's categories, and the size of its graph."""
        said = self.table("categories").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.replace("category", F.lit("_"), F.lit(" ")))).alias("categories"))
        number = lambda name: self.table(name).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
        rows = self.table("documents").select("doc_id").join(said, "doc_id", "left").join(number("nodes"), "doc_id", "left").join(number("edges"), "doc_id", "left")
        return rows.select("doc_id", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))

    def process(self, found: DataFrame) -> DataFrame:
        """Stores documents ``name, checksum, size_bytes, text`` that aren't there yet; ``doc_id, name, checksum, duplicate`` of all of them.

        Of rows with one checksum the least name is stored. Each table is written once and read again by the next, so nothing is computed twice.
        """
        batch = uuid.uuid4().hex
        found = found.select("name", "checksum", F.col("size_bytes").cast("long").alias("size_bytes"), F.coalesce("text", F.lit("")).alias("text"))
        fresh = found.join(self.table("documents").select("checksum"), "checksum", "left_anti").groupBy("checksum").agg(F.min(F.struct("name", "size_bytes", "text")).alias("_d"))
        docs = fresh.select(F.xxhash64("checksum").alias("doc_id"), "checksum", "_d.*").withColumn("batch", F.lit(batch))
        columns = TABLES["documents"]
        docs.write.mode("overwrite").parquet(f"{self.root}/incoming/{batch}")
        docs = self.spark.read.schema(columns).parquet(f"{self.root}/incoming/{batch}")
        lines = structure.lines(docs)
        heads = self._write("sections", structure.sections(lines), batch)
        chunks = structure.assign_sections(structure.chunks(lines), heads).join(docs.select("doc_id", "name"), "doc_id")
        chunks = chunks.withColumn("chunk_id", structure.chunk_id(F.col("name"), F.col("start_line"), F.col("end_line"), F.col("text")))
        chunks = self._write("chunks", chunks.dropDuplicates(["doc_id", "chunk_id"]), batch)
        terms = self._write("postings", index.postings(chunks), batch)
        self._write("terms", index.term_statistics(terms), batch)
        tree = self._write("tree", structure.tree(chunks, heads), batch)
        found_, patterns, candidates = schema.discover(heads, chunks)
        categories, patterns, candidates = self._write("categories", found_, batch), self._write("patterns", patterns, batch), self._write("candidates", candidates, batch)
        tops = tree.where("node_type = 'section'").select("doc_id", "node_id", F.col("text").alias("section"), "start_line", "end_line")
        said = sections.sentences(tree).join(tops, ["doc_id", "node_id"]).select("doc_id", "section", "start_line", "end_line", F.col("n").alias("ord"), "sentence")
        scope = said.select("doc_id", "section", (F.col("start_line").cast("long") * 100_000 + F.col("ord")).alias("ord"), "sentence")
        rows = extract.enumerated(scope.drop("section"), schema.primary(patterns), schema.registry(categories, patterns))
        entities = rows.join(scope.select("doc_id", "section", "sentence").dropDuplicates(["doc_id", "sentence"]), ["doc_id", "sentence"]).select("doc_id", "section", "category", "value")
        nodes, edges = graph.build(docs, heads, categories, entities, said, candidates)
        self._write("nodes", nodes, batch)
        self._write("edges", edges, batch)
        before = self.table("documents").select("checksum", F.col("doc_id").alias("_old"))
        told = found.join(before, "checksum", "left").select(F.xxhash64("checksum").alias("doc_id"), "name", "checksum", F.col("_old").isNotNull().alias("duplicate"))
        told.write.mode("overwrite").parquet(f"{self.root}/told/{batch}")
        self._write("documents", docs, batch)
        told = self.spark.read.schema(told.schema).parquet(f"{self.root}/told/{batch}")
        kind = F.when(F.col("duplicate"), "duplicate_document_detected").otherwise("document_processed")
        self.audit(told.select(kind.alias("event_type"), F.create_map(F.lit("file_name"), F.col("name"), F.lit("checksum_sha256"), F.col("checksum")).alias("details"), "doc_id"))
        return told

    def scratch(self, name: str):
        """save(rows, step) that writes intermediate rows below the store and reads them again, in a folder of its own."""
        folder = f"{self.root}/scratch/{name}-{uuid.uuid4().hex}"

        def save(rows: DataFrame, step: str) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{folder}/{step}")
            return self.spark.read.schema(rows.schema).parquet(f"{folder}/{step}")

        return save

    def audit(self, events: DataFrame) -> None:
        """Appends events ``event_type, details`` (map), ``doc_id`` (null for none)."""
        rows = events.select("event_type", message(F.col("event_type"), F.col("details")).alias("message"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("details")))).alias("details"), F.col("doc_id").cast("long").alias("doc_id"), F.current_timestamp().alias("created_at"))
        rows.write.mode("append").parquet(f"{self.root}/audit")

    def audit_events(self, limit: int = 100, doc_id: int | None = None) -> DataFrame:
        """The oldest ``limit`` events, of one document if it is given."""
        rows = self.spark.read.schema(AUDIT).parquet(f"{self.root}/audit") if self._exists("audit") else self.spark.createDataFrame([], AUDIT)
        rows = rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
        return rows.orderBy("created_at", "event_type", "message").limit(limit)

    def clear(self) -> dict[str, bool]:
        """Deletes all tables; which of them were there."""
        gone = {}
        for name in (*TABLES, "audit", "incoming", "told", "scratch"):
            there, files = self._files(f"{self.root}/{name}")
            gone[name] = bool(files.delete(there, True))
        return gone
