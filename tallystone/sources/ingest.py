"""Sources, ingest and sinks (S01-S13). A file row: path (relative), content binary, and what later steps add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions.canon import canonical, digest, first_code, short_id, slug, utc_text
from tallystone.functions.trees import tree_digest

# Suffixes that are read, with their media types; code suffixes; folders that are skipped.
MEDIA_TYPES = {
    ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".jsonl": "application/x-ndjson",
    ".py": "text/x-python", ".js": "text/javascript", ".jsx": "text/javascript", ".ts": "text/typescript", ".tsx": "text/typescript",
    ".toml": "application/toml", ".yaml": "application/yaml", ".yml": "application/yaml",
}
CODE_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx", ".toml", ".yaml", ".yml"]
SKIPPED_FOLDERS = [".git", ".venv", "node_modules", "dist", "build", "__pycache__"]
TIME_FIELDS = ["timestamp", "started_at", "occurred_at", "created_at", "time", "date"]
MESSAGE_FIELDS = ["content", "text", "message", "output", "input"]


def suffix(path: Column) -> Column:
    """The last dot and what follows it in the file name, in lower case; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def select_sources(files: DataFrame, include_code: bool = True, also_skip: tuple[str, ...] = ()) -> DataFrame:
    """Files with a known suffix outside the skipped folders; also_skip: more of these, such as an application's own state folder."""
    kept = F.col("path").isNotNull() & suffix(F.col("path")).isin(list(MEDIA_TYPES)) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, [*SKIPPED_FOLDERS, *also_skip])))
    return files.where(kept if include_code else kept & ~suffix(F.col("path")).isin(CODE_SUFFIXES))


def scan_sources(spark: SparkSession, root: str, include_code: bool = True) -> DataFrame:
    """(path relative to root, content) of the source files below a folder of any file system that Spark reads."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    files = read.select(F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "").alias("path"), "content")
    return select_sources(files, include_code)


def admission_report(files: DataFrame, max_files: int = 10_000, max_file_bytes: int = 1 << 20, max_total_bytes: int = 256 << 20) -> DataFrame:
    """(code, path) violations: one row for each bad file, and rows without path for the batch as a whole."""
    size = F.octet_length("content")
    own = files.select("path", first_code((size > max_file_bytes, "FILE_TOO_LARGE"), (~F.expr("is_valid_utf8(content)"), "NOT_UTF8")).alias("code")).where("code is not null").select("code", "path")
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"))
    rules = F.array_compact(F.array(F.when(F.col("n") > max_files, "TOO_MANY_FILES"), F.when(F.col("b") > max_total_bytes, "BATCH_TOO_LARGE")))
    return own.unionByName(total.select(F.explode(rules).alias("code"), F.lit(None).cast("string").alias("path")))


def classify_sources(files: DataFrame, conversations: Column | None = None) -> DataFrame:
    """Files with kind (conversation, code, document), media_type and canonical_type (one of three).

    JSON Lines are conversations, as are rows for which `conversations` holds.
    """
    end = suffix(F.col("path"))
    is_talk = (end == ".jsonl") | (F.coalesce(conversations, F.lit(False)) if conversations is not None else F.lit(False))
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    media = F.when(is_talk, "application/x-ndjson").otherwise(F.coalesce(types[end], F.lit("text/plain")))
    kind = F.when(is_talk, "conversation").when(end.isin(CODE_SUFFIXES), "code").otherwise("document")
    narrow = F.when(media.isin("text/markdown", "application/x-ndjson"), media).otherwise("text/plain")
    return files.withColumns({"kind": kind, "media_type": media, "canonical_type": narrow})


def with_source_id(files: DataFrame) -> DataFrame:
    """source_id = kind:slug-12hex of the relative path."""
    name = F.rtrim(F.substring(slug(F.col("path")), 1, 100), F.lit("-._"))
    return files.withColumn("source_id", F.concat("kind", F.lit(":"), F.when(name == "", "source").otherwise(name), F.lit("-"), F.substring(F.sha2("path", 256), 1, 12)))


def with_revision_id(files: DataFrame) -> DataFrame:
    """Fingerprint of the bytes, and revision_id of source_id, a zero byte and the bytes."""
    whole = F.concat(F.encode("source_id", "UTF-8"), F.expr("X'00'"), F.col("content"))
    return files.withColumns({"fingerprint": digest(F.col("content")), "revision_id": short_id("revision_", whole, 32)})


def parsed_time(text: Column) -> Column:
    """ISO text as a timestamp, UTC where it names no zone; null if it isn't one."""
    return F.try_to_timestamp(F.when(F.length(F.trim(text)) > 0, F.trim(text)))


def captured_at(messages: DataFrame) -> DataFrame:
    """(source_id, captured_at): the earliest time of a conversation's JSON lines; of a line, the first of six fields that holds a valid one.

    messages: source_id, content (binary or text). Sources without any valid time have none.
    """
    lines = messages.select("source_id", F.explode(F.split(F.col("content").cast("string"), "\r\n|\r|\n")).alias("line"))
    at = F.coalesce(*[parsed_time(F.get_json_object("line", f"$.{f}")) for f in TIME_FIELDS])
    return lines.groupBy("source_id").agg(F.min(at).alias("at")).select("source_id", utc_text(F.col("at")).alias("captured_at"))


def manifest(files: DataFrame) -> DataFrame:
    """(batch_id, batch_key): the batch's id by the set of its (source_id, fingerprint), whatever their order.

    Entries are hashed per row and combined by levels of buckets, so no task gets a batch's whole list.
    """
    row = files.select("batch_key", F.sha2(F.concat_ws("|", "source_id", "fingerprint"), 256).alias("h")).distinct()
    return tree_digest(row, ["batch_key"], "h", "h").select(F.concat(F.lit("batch_"), F.substring("digest", 8, 32)).alias("batch_id"), "batch_key")


def incremental_import(items: DataFrame, prior: DataFrame) -> DataFrame:
    """Items with import_status: FAILED with an error_code, UNCHANGED if prior has (source_id, fingerprint), else IMPORTED."""
    seen = prior.select("source_id", "fingerprint").distinct().withColumn("seen", F.lit(True))
    j = items.join(seen, ["source_id", "fingerprint"], "left")
    return j.withColumn("import_status", F.when(F.col("error_code").isNotNull(), "FAILED").when(F.col("seen"), "UNCHANGED").otherwise("IMPORTED")).drop("seen")


def batch_status(items: DataFrame) -> DataFrame:
    """(batch_key, imported, unchanged, failed, status): COMPLETED without failures, FAILED with nothing else, else PARTIAL."""
    n = lambda s: F.count_if(F.col("import_status") == s)
    out = items.groupBy("batch_key").agg(n("IMPORTED").alias("imported"), n("UNCHANGED").alias("unchanged"), n("FAILED").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "COMPLETED").when(F.col("imported") + F.col("unchanged") == 0, "FAILED").otherwise("PARTIAL"))


def immutability_violations(revisions: DataFrame) -> DataFrame:
    """(revision_id, code): one id with several contents, or a declared fingerprint that isn't the content's."""
    many = revisions.groupBy("revision_id").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").select("revision_id", F.lit("REVISION_REDEFINED").alias("code"))
    wrong = revisions.where(F.col("fingerprint") != digest(F.col("content"))).select("revision_id", F.lit("CONTENT_HASH_MISMATCH").alias("code"))
    return many.union(wrong).distinct()


def messages(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines with one row per text of their JSON message: its string fields, or the strings and objects of list fields, two levels deep.

    Adds message_no and message. A line that is no JSON object, or has no text, is its own message.
    """
    v = F.try_parse_json(line_col)
    string = lambda x: F.try_variant_get(x, "$", "string")
    kind = lambda x: F.schema_of_variant(x)
    none = F.array().cast("array<string>")

    def field(x: Column, name: str) -> Column:
        own = F.try_variant_get(x, f"$.{name}", "variant")
        return F.when(kind(own) == "STRING", F.array(string(own))).otherwise(none)

    def in_list(x: Column) -> Column:
        """The texts of a list's items: strings, and the fields of objects."""
        each = lambda i: F.when(kind(i) == "STRING", F.array(string(i))).when(kind(i).startswith("OBJECT"), F.flatten(F.array(*[field(i, f) for f in MESSAGE_FIELDS]))).otherwise(none)
        return F.flatten(F.transform(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")), each))

    def top(name: str) -> Column:
        own = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(kind(own) == "STRING", F.array(string(own))).when(kind(own).startswith("ARRAY"), in_list(own)).otherwise(none)

    texts = F.when(kind(v) == "STRING", F.array(string(v))).when(kind(v).startswith("ARRAY"), in_list(v)).when(kind(v).startswith("OBJECT"), F.flatten(F.array(*[top(f) for f in MESSAGE_FIELDS])))
    texts = F.when(F.size(F.coalesce(texts, none)) > 0, texts).otherwise(F.array(F.col(line_col)))
    return lines.select("*", F.posexplode(texts).alias("message_no", "message"))


# Fixed value: the fields of the three export shapes that are checked.
EXPORT_SCHEMA = "event_id string, event_type string, created_at string, payload string, pages array<struct<citations: array<struct<reference: string>>>>, references array<struct<reference: string>>, context struct<sources: array<string>>, export_version string"


def validate_exports(exports: DataFrame, version: str = "1") -> DataFrame:
    """(export_id, code) of exports that fail their shape's checks. exports: export_id, shape (EVENT, PAGES, CONTEXT), document JSON.

    EVENT needs its three strings and a payload object; PAGES pages whose citations all name a declared reference; CONTEXT the version and sources.
    """
    e = exports.withColumn("d", F.from_json("document", EXPORT_SCHEMA))
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    event = F.when(blank(F.col("d.event_id")) | blank(F.col("d.event_type")) | blank(F.col("d.created_at")) | ~F.coalesce(F.col("d.payload").startswith("{"), F.lit(False)), "EVENT_INVALID")
    pages = F.when(F.coalesce(F.size("d.pages"), F.lit(0)) < 1, "PAGES_INVALID").when(F.col("d.references").isNull(), "REFERENCES_REQUIRED")
    context = F.when(~F.col("d.export_version").eqNullSafe(version), "VERSION_MISMATCH").when(F.col("d.context.sources").isNull(), "SOURCES_REQUIRED")
    code = F.when(F.col("shape") == "EVENT", event).when(F.col("shape") == "PAGES", pages).when(F.col("shape") == "CONTEXT", context).otherwise("SHAPE_UNKNOWN")
    shape = e.select("export_id", code.alias("code")).where("code is not null")
    cited = e.where("shape = 'PAGES'").select("export_id", F.explode("d.pages").alias("p")).select("export_id", F.explode("p.citations").alias("c")).select("export_id", F.col("c.reference").alias("reference"))
    declared = e.where("shape = 'PAGES'").select("export_id", F.explode("d.references").alias("r")).select("export_id", F.col("r.reference").alias("reference"))
    stray = cited.join(declared, ["export_id", "reference"], "left_anti").select("export_id", F.lit("CITATION_UNRESOLVED").alias("code")).distinct()
    return shape.unionByName(stray.join(shape, "export_id", "left_anti"))


def replace_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rebuilds a derived table: df replaces what path held."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def message_json(role: Column, text: Column) -> Column:
    return canonical(F.struct(text.alias("content"), role.alias("role")))
