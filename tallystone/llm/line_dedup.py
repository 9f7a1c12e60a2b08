"""Line dedup: lines that recur across documents stay only in the smallest document that holds them.

Hashes of (line, block of documents) are range-partitioned: they are uniform, so the bounds of the ranges are known and no
sample of the texts is needed. Rows are sorted by document and position within a range, each run of equal hashes is streamed
once and its first document found. A block is a hash bucket of documents, so a line that a third of all rows hold is spread over
`blocks` ranges; the first documents of the blocks (at most `blocks` per line) meet in a second, small step. The answer is one
compressed keep bitmap per text, not text. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import WHITE_SPACE, ascii_lower, partitions

#: Lines in one word of a bitmap.
WORD_LINES = 63


def line_key(line: Column) -> Column:
    """The line without space and \\t..\\r at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE_SPACE)))


def text_print(text: Column) -> Column:
    """Tells the texts of rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, pos, line): the text split at \\n; a null or empty text is one empty line."""
    # the print is made before the text is taken apart, once for each text
    rows = docs.select(F.col(id_col).alias("doc_id"), text_print(F.col(text_col)).alias("print"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", "print", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def in_range(value: Column, n: int) -> Column:
    """The number of the range that a uniform 64-bit hash lies in, of n equal ones."""
    return F.least(F.floor((value.cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, print, n_dropped long, bitmap array<struct<word int, bits long>>) per text that loses lines.

    Bit i of the entry `word` is line 63 * word + i: 1 keeps it. Words that keep all their lines are left
    out, so a bitmap is as long as the text has losses. Null ids are never matched as "smallest": such
    rows keep all their lines. Rows that share an id are one document, whose texts have a bitmap each (print is a hash of the
    text); equal rows have one bitmap. An empty table gives no rows. Keys are compared by 96 bits of hash.
    """
    n = partitions(docs.sparkSession)
    key = line_key(F.col("line"))
    hashed = lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col).withColumn("key", key).where(F.length("key") >= min_chars)
    hashed = hashed.select("doc_id", "print", "pos", F.xxhash64("key").alias("h1"), F.hash(F.lit(7), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks or max(64, n))).cast("int").alias("block"))
    run_key = ["range", "h1", "h2", "block"]
    ranged = hashed.withColumn("range", in_range(F.xxhash64("h1", "h2", "block"), n)).repartitionById(n, "range").sortWithinPartitions(*run_key, "doc_id", "pos")
    run = Window.partitionBy(*run_key).orderBy("doc_id", "pos")
    local = ranged.withColumn("repeat", F.col("doc_id") > F.first("doc_id").over(run))
    # first documents of the blocks meet; repeats stay spread by block
    meet = Window.partitionBy("h1", "h2", "group").orderBy("doc_id")
    first = local.withColumn("group", F.when(F.col("repeat"), F.col("block")).otherwise(-1))
    dropped = first.withColumn("late", F.col("repeat") | (F.col("doc_id") > F.first("doc_id").over(meet))).where("late")
    word = (F.col("pos") / WORD_LINES).cast("int")
    bits = dropped.groupBy("doc_id", "print", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD_LINES).cast("int"))).alias("lost"))
    lost = bits.groupBy("doc_id", "print").agg(F.sum(F.bit_count("lost")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("bitmap"))
    return lost.select("doc_id", "print", F.col("n_dropped").cast("long"), "bitmap")


def dropped_positions(bitmap: Column) -> Column:
    """The line numbers that a bitmap drops, ascending."""
    bit = F.sequence(F.lit(0), F.lit(WORD_LINES - 1))
    of_word = F.transform(bitmap, lambda w: F.transform(F.filter(bit, lambda i: F.getbit(w["bits"], i) == 0), lambda i: w["word"] * WORD_LINES + i))
    return F.flatten(of_word)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept_text: the kept lines joined by \\n ('' if none is left).

    Columns of docs with one of these names (in any case) are replaced.
    """
    made = ("n_lines", "n_dropped", "kept_text")
    own = [c for c in docs.columns if c.lower() not in made]
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("__row"), docs[id_col].alias("__of"), docs[text_col].alias("__text"), text_print(docs[text_col]).alias("__p"))
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), F.col("n_dropped").alias("__n"), F.col("bitmap").alias("__bitmap"))
    joined = given.join(marks, (F.col("__of") == F.col("__id")) & (F.col("__p") == F.col("__print")), "left")
    all_lines = F.split(F.coalesce("__text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), dropped_positions(F.col("__bitmap")))
    text = F.when(F.col("__bitmap").isNull(), F.coalesce("__text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    return joined.select("__row.*", F.size(all_lines).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row; other columns of docs play no part."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, blocks)).drop("text")
