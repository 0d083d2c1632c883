"""Inverted index and BM25 search over a table of chunks (``doc_id, chunk_id, text``).

Postings are long rows, one for each document, chunk and term; nothing gathers a term's postings in one place.
Statistics are those of each document's own chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as t

K1, B = 1.5, 0.75
#: Questions are a stated batch; up to so many terms are broadcast.
BROADCAST_TERMS, LITERAL_TERMS = 100_000, 2_000


def postings(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, term, tf, positions``; positions count before stopwords go.

    A chunk is one row (its id is unique in its document), so its postings are made in the row and nothing is shuffled: tokens with their
    places are sorted, and each term's places are the stretch between its first and last token.
    """
    found = F.filter(F.transform(t.tokens(F.col("text")), lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: ~t.is_stopword(x["term"]))
    rows = chunks.select("doc_id", "chunk_id", F.array_sort(found).alias("_t"))
    # One generator keeps the arrays from being computed once for each column.
    rows = rows.withColumn("_w", F.transform("_t", lambda x: x["term"])).withColumn("_p", F.transform("_t", lambda x: x["pos"]))
    begins = F.filter(F.transform("_w", lambda w, i: F.when((i == 0) | (F.get("_w", i - 1) != w), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "chunk_id", "_w", "_p", begins.alias("_b"))
    each = F.transform("_b", lambda b, k: F.struct(F.get("_w", b).alias("term"), (F.coalesce(F.get("_b", k + 1), F.size("_w")) - b).alias("tf"), b.alias("at")))
    rows = rows.select("doc_id", "chunk_id", "_p", F.explode(each).alias("x"))
    return rows.select("doc_id", "chunk_id", "x.term", F.col("x.tf").cast("long").alias("tf"), F.slice("_p", F.col("x.at") + 1, F.col("x.tf")).alias("positions"))


def term_statistics(terms: DataFrame) -> DataFrame:
    """``doc_id, term, df, n, idf`` from postings; n is the document's number of chunks with a term.

    One shuffle by document and term; the chunks of a document are counted over its terms' sets of first terms, as each chunk has one least term.
    """
    each = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = terms.groupBy("doc_id", "chunk_id").agg(F.lit(1).alias("_")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.join(sizes, "doc_id").withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def search(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """questions: ``question_id, question``, and ``doc_id`` if each asks one document. The k best chunks of each: ``question_id, rank, doc_id, chunk_id, score, matched``.

    A term that a question repeats counts each time. Ties go to the smaller doc_id, then start line if chunks have it, then chunk_id.
    Questions are a stated batch. Up to LITERAL_TERMS asked terms are held against each chunk's tokens in one pass, and only chunks that hold one leave
    it; more are joined. Each document's length statistics and matched chunks come from one aggregation.
    """
    by = ["doc_id"] if "doc_id" in questions.columns else []
    asked = questions.select("question_id", *by, F.explode(t.search_terms(F.col("question"))).alias("term")).groupBy("question_id", *by, "term").agg(F.count(F.lit(1)).alias("qtf"))
    words = [r.term for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    kept = F.filter(t.tokens(F.col("text")), lambda x: ~t.is_stopword(x))
    place = F.col("start_line") if "start_line" in chunks.columns else F.lit(0)
    if len(words) <= LITERAL_TERMS:
        # A generator keeps the tokens from being computed once for each use.
        some = chunks.select("doc_id", "chunk_id", place.alias("_line"), F.explode(F.array(kept)).alias("_t"))
        some = some.select("doc_id", "chunk_id", "_line", F.size("_t").alias("dl"), F.filter("_t", lambda x: x.isin(words) if words else F.lit(False)).alias("_h")).where("dl > 0")
        hit = F.when(F.size("_h") > 0, F.struct("chunk_id", "_line", "dl", "_h"))
        docs = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.collect_list(hit).alias("_c")).where(F.size("_c") > 0)
        tf = docs.select("doc_id", "n", "avgdl", F.inline("_c")).select("doc_id", "n", "avgdl", "chunk_id", "_line", "dl", F.explode("_h").alias("term"))
        tf = tf.groupBy("doc_id", "n", "avgdl", "chunk_id", "_line", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        sized = chunks.select("doc_id", "chunk_id", place.alias("_line"), kept.alias("terms")).withColumn("dl", F.size("terms")).where("dl > 0")
        docs = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        tf = sized.select("doc_id", "chunk_id", "_line", "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
        tf = tf.groupBy("doc_id", "chunk_id", "_line", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).join(docs, "doc_id")
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term")))
    rows = tf.join(asked, [*by, "term"])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = 1 - B + B * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    scored = rows.groupBy("question_id", "doc_id", "chunk_id", "_line").agg(F.round(F.sum(part), 9).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "_line", "chunk_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_line")


def second_search(terms: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Search by stored postings (``doc_id, chunk_id, term, tf``), with statistics of all chunks: chunks that hold every term of a question.

    ``question_id, rank, doc_id, chunk_id, score, matched``; scores are BM25 with k1 1.2 and idf ln(N / (df + 1)) + 1; ties go to the smaller chunk.
    """
    asked = questions.select("question_id", F.array_distinct(t.search_terms(F.col("question"))).alias("_q"))
    asked = asked.select("question_id", F.size("_q").alias("_n"), F.explode("_q").alias("term"))
    sizes = terms.groupBy("doc_id", "chunk_id").agg(F.sum("tf").alias("dl"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    rows = terms.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "term")
    df = terms.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = rows.join(F.broadcast(df), "term").join(sizes, ["doc_id", "chunk_id"]).crossJoin(F.broadcast(whole))
    part = (F.log(F.col("n") / (F.col("df") + 1)) + 1) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    found = rows.groupBy("question_id", "doc_id", "chunk_id", "_n").agg(F.round(F.sum(part), 9).alias("score"), F.array_sort(F.collect_set("term")).alias("matched")).where("size(matched) = _n and score > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "chunk_id")
    return found.drop("_n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(chunks: DataFrame, questions: DataFrame, mode: str = "lexical", terms: DataFrame | None = None, k: int = 10) -> DataFrame:
    """mode lexical, second or hybrid (the better score of each chunk); without stored terms, or where they hold nothing for a question, lexical results stand in."""
    if mode not in ("lexical", "second", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    first = search(chunks, questions, k).select("question_id", "rank", "doc_id", "chunk_id", "score", "matched")
    if mode == "lexical" or terms is None:
        return first
    other = second_search(terms, questions, k).select(*first.columns)
    if mode == "second":
        return other.unionByName(first.join(other.select("question_id").distinct(), "question_id", "left_anti"))
    words = first.unionByName(other).groupBy("question_id", "doc_id", "chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"))
    return merge_results(first, other, k).join(words, ["question_id", "doc_id", "chunk_id"]).select(*first.columns)


def merge_results(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Two result lists of ``question_id, doc_id, chunk_id, score``: the greater score of each chunk, k best of each question."""
    cols = ("question_id", "doc_id", "chunk_id")
    both = first.select(*cols, "score").unionByName(second.select(*cols, "score")).groupBy(*cols).agg(F.max("score").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def evidence(results: DataFrame, chunks: DataFrame, name: str = "name", least: float = 0.01, most: int | None = None) -> DataFrame:
    """Cards of search results: ``confidence, citation, snippet``; of equal snippets of a question the best ranked stays, and then the ``most`` best."""
    rows = results.where(F.col("score") >= least).join(chunks, ["doc_id", "chunk_id"])
    rows = rows.withColumn("snippet", t.snippet(F.col("text"), F.col("matched")))
    first = Window.partitionBy("question_id", t.squeeze(F.lower("snippet"))).orderBy("rank")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("_n") <= most)
    cited = t.citation(F.col(name), F.col("start_line"), F.col("end_line"), F.lit(None).cast("string"))
    return rows.select("question_id", "rank", "doc_id", "chunk_id", t.confidence(F.col("score"), F.size("matched")).alias("confidence"), cited.alias("citation"), "snippet")
