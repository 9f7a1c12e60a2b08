"""Fixity of web archives: records with offsets, Merkle trees over them, and audits of replicas.

An archive is a set of files; a file is an ordered run of WARC/1.0 response records, each at a byte offset. Records
are hashed; runs of `fanout` consecutive ordinals hash into a range, ranges into larger ranges, up to one root per file.
An audit compares roots and descends only into ranges whose hashes differ, so intact parts cost one
comparison at the top; what it returns are the record slots that differ, and how.

Hashes chain (ordinal, offset, length, digest), so a moved, missing or added record shows as well as a changed one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import written

CRLF = "\r\n"
NODE = ["file", "level", "node"]


def rendered(pages: DataFrame, file_pages: int = 512) -> DataFrame:
    """(file, page_id, tie, record binary): pages as WARC/1.0 response records, without their places.

    A file holds the pages of `file_pages` consecutive ids. Rows without id go to files -1, -2... of about as many pages, by a hash of what
    they hold; a null url or html is empty. Records are made where pages are read: no page is shuffled.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    body = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF), html)
    name = F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url), 256), F.lit(">"))
    head = F.concat(F.lit("WARC/1.0" + CRLF + "WARC-Type: response" + CRLF + "WARC-Record-ID: "), name, F.lit(CRLF + "WARC-Target-URI: "), url, F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    whole = F.concat(head, body, F.lit(CRLF + CRLF)).cast("binary")
    tie = F.xxhash64("url", "html")
    nameless = max(1, -(-pages.where("page_id is null").count() // file_pages))
    file = F.coalesce(F.floor(F.col("page_id") / file_pages).cast("long"), -1 - F.pmod(tie, F.lit(nameless)))
    return pages.select(file.alias("file"), "page_id", tie.alias("tie"), whole.alias("record"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (file, page_id, tie, length, ...) with ordinal and offset: in a file by id, then by what rows with one id hold."""
    order = Window.partitionBy("file").orderBy("page_id", "tie")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return rows.withColumns({"ordinal": (F.row_number().over(order) - 1).cast("long"), "offset": before})


def records(pages: DataFrame, file_pages: int = 512) -> DataFrame:
    """(file, ordinal, page_id, offset, length, record binary): the archive itself, each record at its place."""
    whole = rendered(pages, file_pages).withColumn("length", F.octet_length("record").cast("long"))
    return placed(whole).select("file", "ordinal", "page_id", "offset", "length", "record")


def leaves(archive: DataFrame) -> DataFrame:
    """(file, ordinal, offset, length, digest, page_id): one leaf per record of an archive, or of rendered records that get their places here.

    Records are hashed where they are read; what is shuffled to place them is their length and digest.
    """
    if "ordinal" in archive.columns:
        return archive.select("file", "ordinal", "offset", "length", F.sha2("record", 256).alias("digest"), "page_id")
    hashed = archive.select("file", "page_id", "tie", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return placed(hashed).select("file", "ordinal", "offset", "length", "digest", "page_id")


def grown(leaf: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """(file, level, node, low, high, hash) of each level, each written once; level 0 are the records."""
    start, end = F.col("offset"), F.col("offset") + F.col("length")
    at = leaf.select("file", F.lit(0).alias("level"), F.col("ordinal").alias("node"), start.alias("low"), end.alias("high"), F.sha2(F.concat_ws("|", "ordinal", "offset", "length", "digest"), 256).alias("hash"))
    out = [written(at, "merkle-0")]
    for level in range(1, levels + 1):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]), "")
        at = out[-1].groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(children, 256).alias("hash"))
        out.append(written(at.select("file", F.lit(level).alias("level"), F.col("parent").alias("node"), "low", "high", "hash"), f"merkle-{level}"))
    return out


def tree(leaf: DataFrame, fanout: int = 16, levels: int = 4) -> DataFrame:
    """(file, level, node, low, high, hash): level 0 are the records, the top level has one root per file.

    Files of more than fanout ** levels records get a root for each run of so many. low and high: the byte range.
    """
    return reduce(DataFrame.unionByName, grown(leaf, fanout, levels))


def audit(first: DataFrame, second: DataFrame, fanout: int = 16, levels: int = 4) -> DataFrame:
    """Record slots in which two replicas differ: (file, ordinal, low, high, first_hash, second_hash, status).

    first, second: leaves. status: CHANGED, MISSING (in second) or ADDED; low and high from first where it has the slot.
    At each level only children of mismatching nodes are compared.
    """
    a, b = grown(first, fanout, levels), grown(second, fanout, levels)
    wrong = None
    for level in range(levels, -1, -1):
        sides = [a[level], b[level]]
        if wrong is not None:
            above = wrong.select(F.col("file").alias("__f"), F.col("node").alias("__p")).distinct()
            sides = [x.join(above, (F.col("file") == F.col("__f")) & (F.floor(F.col("node") / fanout) == F.col("__p")), "left_semi") for x in sides]
        left, right = (x.select("file", "node", F.struct("low", "high").alias(f"{n}_at"), F.col("hash").alias(f"{n}_hash")) for n, x in zip(("first", "second"), sides, strict=True))
        wrong = written(left.join(right, ["file", "node"], "full_outer").where(~F.col("first_hash").eqNullSafe(F.col("second_hash"))), "merkle-wrong")
    at = F.coalesce("first_at", "second_at")
    status = F.when(F.col("second_hash").isNull(), "MISSING").when(F.col("first_hash").isNull(), "ADDED").otherwise("CHANGED")
    return wrong.select("file", F.col("node").alias("ordinal"), at["low"].alias("low"), at["high"].alias("high"), "first_hash", "second_hash", status.alias("status"))
