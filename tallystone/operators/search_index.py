"""A kept inverted index for BM25 (R04, R05): postings in blocks with the best weight of each, read by term.

Documents fall into blocks by a hash of their ids; a row of the index holds what one term has in one block, so a term of all documents is many rows, too. Rows are
dealt to folders by a hash of the term and sorted by term in them: a search reads the folders and row groups of its terms. A block whose best weights together
can't reach the score of the k-th document found so far is not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.operators.retrieval import B, BROADCAST_QUERIES, IDF_FLOOR, K1, postings, query_terms, top
from tallystone.sources.scratch import written

#: Documents of a block, folders of an index, and blocks that are opened before any is left out.
BLOCK_DOCUMENTS, SHARDS, FIRST_BLOCKS = 4096, 32, 4
INDEX = "term string, block int, n long, best double, entries array<struct<document_id: string, w: double>>, shard int"


def _shard() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int")


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def build_index(documents: DataFrame, path: str, block_documents: int = BLOCK_DOCUMENTS) -> None:
    """Writes the postings of documents (document_id, title, body) and their statistics below path. Texts are split once: their mean length comes from the postings."""
    rows = written(postings(documents), "index-postings")
    n = documents.count()
    rows.agg(F.lit(n).cast("long").alias("n"), (F.coalesce(F.sum("tf"), F.lit(0)) / F.lit(max(n, 1))).alias("mean")).write.parquet(f"{path}/totals")
    totals = documents.sparkSession.read.parquet(f"{path}/totals")
    block = F.pmod(F.xxhash64("document_id"), F.lit(max(1, -(-n // block_documents)))).cast("int")
    weighted = rows.join(F.broadcast(totals)).withColumn("w", _weight(F.col("tf"), F.col("length"), F.col("mean")))
    blocks = weighted.groupBy("term", block.alias("block")).agg(F.count("*").alias("n"), F.max("w").alias("best"), F.collect_list(F.struct("document_id", "w")).alias("entries"))
    dealt = blocks.withColumn("shard", _shard()).repartition("shard", F.pmod("block", F.lit(8))).sortWithinPartitions("shard", "term", "block")
    dealt.write.partitionBy("shard").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")


def _opened(index: DataFrame, asked: DataFrame, pairs: DataFrame, n_terms: DataFrame, near: bool) -> DataFrame:
    """(query_id, document_id, score), rounded so that ties don't depend on the order of the sums, of the documents with all terms of a query in the (query_id, block) pairs. asked: query_id, term, idf."""
    small = F.broadcast if near else lambda df: df
    wanted = written(pairs.join(asked, "query_id").select("query_id", "block", "term", "idf"), "index-wanted")
    # blocks of entries meet by query and block, and only there become rows: where the index is read a document's terms lie apart and nothing would be summed up
    dealt = index.join(small(wanted), ["term", "block"]).select("query_id", "block", "idf", "entries").repartition("query_id", "block")
    rows = dealt.select("query_id", "block", "idf", F.explode("entries").alias("e"))
    met = rows.groupBy("query_id", "block", F.col("e.document_id").alias("document_id")).agg(F.count("*").alias("met"), F.round(F.sum(F.col("idf") * F.col("e.w")), 12).alias("score"))
    return met.join(small(n_terms), "query_id").where("met = n_terms").select("query_id", "document_id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = 20, opened: list[int] | None = None) -> DataFrame:
    """R05 over an index at path: (query_id, rank, document_id, score): documents with all terms of a query, by BM25, ties by id; a query without terms finds nothing.

    opened: gets how many pairs of query and block were opened first and then, and how many there are.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1..200")
    q = written(queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term")), "index-queries")
    near = queries.count() <= BROADCAST_QUERIES
    small = F.broadcast if near else lambda df: df
    n_terms = q.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    terms = q.select("term").distinct().withColumn("shard", _shard())
    index = spark.read.schema(INDEX).parquet(f"{path}/postings")
    if near:
        shards = [r["shard"] for r in terms.select("shard").distinct().collect()]  # SHARDS at most
        index = index.where(F.col("shard").isin(shards))
    index = index.join(small(terms.select("term")), "term", "left_semi")
    # bounds need no entries, which are not read here
    told = written(index.select("term", "block", "n", "best"), "index-bounds")
    df = told.groupBy("term").agg(F.sum("n").alias("df"))
    totals = spark.read.parquet(f"{path}/totals")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    asked = written(q.join(df.join(F.broadcast(totals)).select("term", idf.alias("idf")), "term"), "index-asked")
    bound = told.join(small(asked), "term").groupBy("query_id", "block").agg(F.count("*").alias("met"), F.sum(F.col("idf") * F.col("best")).alias("bound"))
    bound = bound.join(small(n_terms), "query_id").where("met = n_terms").select("query_id", "block", "bound")
    ranked = written(bound.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "index-ranked")
    first = written(top(_opened(index, asked, ranked.where(F.col("k") <= FIRST_BLOCKS).select("query_id", "block"), n_terms, near), limit), "index-first")
    least = first.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    rest = written(ranked.where(F.col("k") > FIRST_BLOCKS).join(least, "query_id", "left").where("least is null or bound >= least - 1e-9").select("query_id", "block"), "index-rest")
    if opened is not None:
        opened += [ranked.where(F.col("k") <= FIRST_BLOCKS).count(), rest.count(), ranked.count()]
    found = first.select("query_id", "document_id", "score").unionByName(_opened(index, asked, rest, n_terms, near))
    return top(found, limit).select("query_id", "rank", "document_id", "score")
