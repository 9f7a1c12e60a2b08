"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm import ann, decontam, fixity, group_join, hmm, langid, line_dedup, mixing, near_dup, phrase_dedup, spelling, token_align, token_orc
from tallystone.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    learned = langid.prototypes(docs.where(~F.col("held_out")))
    return langid.predict(docs, learned, ["doc_id", "held_out"])


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of a replica of all pages: one page in 97 has a byte changed, one file in 8 has lost its last record."""
    good = fixity.rendered(table(spark, sf_dir, "pages"))
    harmed = F.concat(F.substring("record", 1, 20), F.lit("?").cast("binary"), F.expr("substring(record, 22)"))
    bad = fixity.leaves(good.withColumn("record", F.when(F.col("page_id") % 97 == 5, harmed).otherwise(F.col("record"))))
    last = F.max("ordinal").over(Window.partitionBy("file"))
    bad = bad.withColumn("last", last).where((F.col("file") % 8 != 3) | (F.col("ordinal") != F.col("last"))).drop("last")
    return fixity.audit(fixity.leaves(good), bad)


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_align.aligned_links(table(spark, sf_dir, "documents"), tokenizer_file(), piece_file())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.linked(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_phrase_dedup": op3_phrase_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_decontamination": op7_decontamination,
    "op8_language_model": op8_language_model,
    "op9_token_orc": op9_token_orc,
    "op10_fixity_audit": op10_fixity_audit,
    "op11_token_alignment": op11_token_alignment,
    "op12_ngram_join": op12_ngram_join,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PAD = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
all_lines AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_PAD}), {_LOWER}) AS key
              FROM texts, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
shared AS (SELECT key, min(doc_id) AS first_doc FROM all_lines WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT a.doc_id, a.i, a.line, (s.key IS NOT NULL AND a.doc_id > s.first_doc) AS late
           FROM all_lines a LEFT JOIN shared s ON a.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE late) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT late), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
            FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s) WHERE len(w) > 0),
places AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS win
           FROM d, (SELECT DISTINCT m FROM windows) AS sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS s) WHERE len(w) >= m),
found AS (SELECT doc_id, s, places.m, item_id FROM places JOIN windows ON places.win = windows.win AND places.m = windows.m),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, LATERAL (SELECT unnest(range(s, s + m)) AS p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""

OP6_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

OP10_SQL = """
WITH made AS (SELECT coalesce(page_id // 512, -1) AS file, page_id, coalesce(url, '') AS url,
                     'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM pages),
recs AS (SELECT file, page_id, row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS ordinal,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:'
                || sha256(coalesce(page_id::VARCHAR, '') || chr(10) || url) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
                || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM made),
placed AS (SELECT *, strlen(rec) AS length, sum(strlen(rec)) OVER (PARTITION BY file ORDER BY ordinal) - strlen(rec) AS low, max(ordinal) OVER (PARTITION BY file) AS last FROM recs),
both_ AS (SELECT *, sha256(ordinal || '|' || low || '|' || length || '|' || sha256(rec)) AS first_hash,
                 CASE WHEN file % 8 = 3 AND ordinal = last THEN NULL
                      ELSE sha256(ordinal || '|' || low || '|' || length || '|' || sha256(CASE WHEN page_id % 97 = 5 THEN substr(rec, 1, 20) || '?' || substr(rec, 22) ELSE rec END)) END AS second_hash FROM placed)
SELECT file, ordinal, low::BIGINT AS low, (low + length)::BIGINT AS high, first_hash, second_hash,
       CASE WHEN second_hash IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS status
FROM both_ WHERE first_hash IS DISTINCT FROM second_hash
"""

OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS sh FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

ORACLE_SQL = {"op12_ngram_join": OP12_SQL, "op1_line_dedup": OP1_SQL, "op6_nearest_neighbours": OP6_SQL, "op7_decontamination": OP7_SQL, "op10_fixity_audit": OP10_SQL}
