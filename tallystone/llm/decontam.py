"""Benchmark decontamination: which documents hold windows of benchmark items, by a prefix-filtered set join.

A window is `window` consecutive words of an item (the whole item if it is shorter). A document that holds
a window holds the window's rarest word, so only that word, the window's prefix under the order "rarest
first", has to meet the documents. Rarity is counted over all documents. A meeting fixes the alignment
(document, item, shift); shifts that would leave the document at either end are dropped (length and
position bounds) and the rest verified word by word over whole windows.

All of it is DataFrame functions. One pass reads the texts: it keeps (row, position, word id) for the
words of the benchmark's vocabulary, and both the rarity counts and the verification work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import ascii_lower, spread_join, written

# Fixed value: what separates words, once A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Tables of at most so many rows are broadcast (about 100 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 500_000


def bench_words(text: Column) -> Column:
    """Words of 0-9, a-z and anything beyond ASCII after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items long, item_ids array<string>) of every row of docs.

    n_hit: words inside an occurrence of any window; item_ids: the items with such windows, as strings in
    order. Items without id or words are ignored, and rows of one item_id count as one item. Rows that
    repeat a doc_id are judged each on its own. Null or empty texts have no words and no hits.
    """
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), bench_words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    words = written(words.withColumn("copy", F.xxhash64("words")), "bench-items")
    vocabulary = written(words.select(F.explode("words").alias("word")).distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-vocabulary")

    row = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", bench_words(F.col("text")).alias("words"))
    spread = row.select("rid", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    seen = spread.join(sized(vocabulary), "word", "left").where("wid is not null or pos is null or pos = 0")
    seen = written(seen.select("rid", "doc_id", "n_words", "pos", "wid"), "bench-seen")

    # each item as one row of its words, in order, with their rarity; a window's prefix is the rarest of its words
    counts = seen.where("wid is not null").groupBy("wid").count()
    position = words.select("item", "copy", F.size("words").alias("n"), F.posexplode("words").alias("j", "word")).join(vocabulary, "word").join(counts, "wid", "left").na.fill(0, ["count"])
    ranked = written(position.groupBy("item", "copy", "n").agg(F.sort_array(F.collect_list(F.struct("j", "count", "wid"))).alias("at")), "bench-ranked")
    width = F.least(F.lit(window), F.col("n"))
    rarest = lambda s: F.array_min(F.transform(F.slice("at", s + 1, width), lambda w: F.struct(w["count"].alias("count"), w["j"].alias("j"), w["wid"].alias("wid"))))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - width), lambda s: F.struct(s.alias("start"), rarest(s).alias("at")))
    prefix = ranked.select("item", "copy", "n", F.explode(windows).alias("w"))
    # a window with a word that no document has cannot occur
    prefix = written(prefix.where("w.at.count > 0").select("item", "copy", "n", "w.start", "w.at.j", "w.at.wid"), "bench-prefix")

    # only prefix words meet
    met = seen.where("wid is not null").select("rid", "n_words", "pos", "wid").join(sized(prefix.select("wid").distinct()), "wid", "left_semi").join(sized(prefix), "wid")
    shift = F.col("pos") - F.col("j")
    last = F.col("start") + F.least(F.lit(window), F.col("n"))
    met = met.withColumn("shift", shift).where((F.col("shift") + F.col("start") >= 0) & (F.col("shift") + last <= F.col("n_words")))
    candidates = written(met.select("rid", "item", "copy", "shift", "start").distinct(), "bench-candidates")

    # verification: every word of the window stands where the alignment puts it
    want = spread_join(candidates, ranked, ["item", "copy"]).select("rid", "item", "copy", "shift", "start", F.explode(F.slice("at", F.col("start") + 1, width)).alias("w"), width.alias("width"))
    want = want.select("rid", "item", "copy", "shift", "start", "width", (F.col("shift") + F.col("w.j")).alias("pos"), F.col("w.wid").alias("wid"))
    rows = candidates.select("rid").distinct()
    have = seen.where("wid is not null").select("rid", "pos", "wid").join(sized(rows), "rid", "left_semi")
    full = want.join(have, ["rid", "pos", "wid"]).groupBy("rid", "item", "copy", "shift", "start", "width").count().where("count = width")
    hits = full.select("rid", "item", F.explode(F.sequence(F.col("shift") + F.col("start"), F.col("shift") + F.col("start") + F.col("width") - 1)).alias("pos"))
    each = hits.groupBy("rid", "pos").agg(F.collect_set("item").alias("items"))
    found = each.groupBy("rid").agg(F.count("*").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    base = seen.where("pos is null or pos = 0").select("rid", "doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"))
    out = base.join(found, "rid", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs whose texts have no hit, with their columns. Each row is judged by its own text, whatever id it shares or lacks."""
    own = F.struct(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    bad = contamination(docs.select(own.alias("doc_id"), docs["text"].alias("text")), items, window).where("n_hit > 0").select("doc_id.*").distinct()
    bad = sized(written(bad, "bench-bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"]), "left_anti")
