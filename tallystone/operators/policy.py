"""Disclosure policy over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.canon import first_code


def decoded(ref: Column) -> Column:
    """One percent-decoding; a plus stays a plus, and a malformed reference stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(ref, F.lit("+"), F.lit("%2B"))), ref)


def safe_ref(ref: Column) -> Column:
    """No backslash and no dot segment after up to 8 decodings; a reference that still changes then is unsafe, and so is null."""
    now = F.aggregate(F.sequence(F.lit(1), F.lit(7)), ref, lambda acc, _: decoded(acc))
    path = F.when(F.instr(now, "://") > 0, F.regexp_replace(now, "^.*?://", "")).otherwise(now)
    fine = ~F.contains(now, F.lit("\\")) & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit("."), F.lit("..")))
    return F.coalesce((decoded(now) == now) & fine, F.lit(False))


def label_sources(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """Refs (request_id, source_ref) with the label of the longest root that is a prefix of a safe reference: source_root, sensitivity, data_classes.

    labels is a policy's own short list; references without a match have nulls.
    """
    safe = refs.select("request_id", "source_ref").where(safe_ref(F.col("source_ref")))
    met = safe.join(F.broadcast(labels), F.col("source_ref").startswith(F.col("source_root")))
    best = met.groupBy("request_id").agg(F.max_by(F.struct("source_root", "sensitivity", F.array_sort("data_classes").alias("data_classes")), F.length("source_root")).alias("label"))
    return refs.join(best, "request_id", "left").select(*refs.columns, "label.*")


def disclosure(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """(request_id, allowed, redacted): allowed if fields are requested and all within the scope's; redacted: the scope's paths below requested fields.

    requests: request_id, capability, requested_fields; scopes: capability, allow_fields, redact_paths.
    """
    j = requests.join(F.broadcast(scopes.select("capability", "allow_fields", "redact_paths")), "capability", "left")
    ok = (F.size("requested_fields") > 0) & (F.size(F.array_except("requested_fields", "allow_fields")) == 0)
    below = F.array_sort(F.filter("redact_paths", lambda p: F.array_contains("requested_fields", F.substring_index(p, ".", 1))))
    return j.select("request_id", F.coalesce(ok, F.lit(False)).alias("allowed"), F.coalesce(below, F.array().cast("array<string>")).alias("redacted"))


def decide(requests: DataFrame, bindings: DataFrame, scopes: DataFrame, labels: DataFrame, pins: dict[str, str]) -> DataFrame:
    """(request_id, decision, reason): ALLOW, or DENY with the first reason that holds.

    requests: request_id, request_version, binding_id, claimed_actor_id, endpoint_id, protocol_version, adapter_version, registry_version, capability, operation_type,
    source_ref, requested_fields; bindings: binding_id, actor_id; scopes: capability, operation_types, actor_ids, source_roots, allowed_sensitivities, allow_fields, redact_paths.
    pins: the expected versions and endpoint. Policy tables are short and broadcast.
    """
    j = label_sources(requests, labels).join(F.broadcast(bindings), "binding_id", "left").join(F.broadcast(scopes.withColumn("known", F.lit(True))), "capability", "left")
    j = j.join(disclosure(requests, scopes).select("request_id", "allowed"), "request_id")
    differs = lambda name: ~F.col(name).eqNullSafe(F.lit(pins[name]))
    reason = first_code(
        (differs("request_version"), "REMOTE_REQUEST_VERSION_MISMATCH"),
        (F.col("binding_id").isNull(), "MISSING_TRUST_BINDING"),
        (F.col("actor_id").isNull(), "TRUST_BINDING_NOT_ALLOWED"),
        (~F.col("claimed_actor_id").eqNullSafe(F.col("actor_id")), "ACTOR_BINDING_MISMATCH"),
        (differs("endpoint_id"), "ENDPOINT_PIN_MISMATCH"),
        (differs("protocol_version") | differs("adapter_version"), "REMOTE_VERSION_PIN_MISMATCH"),
        (differs("registry_version"), "REGISTRY_VERSION_MISMATCH"),
        (F.col("known").isNull(), "UNKNOWN_CAPABILITY"),
        (~F.array_contains("operation_types", F.col("operation_type")), "OPERATION_SCOPE_DENIED"),
        (~F.array_contains("actor_ids", F.col("actor_id")), "ACTOR_BINDING_MISMATCH"),
        (F.col("source_root").isNull() | ~F.exists("source_roots", lambda r: F.col("source_ref").startswith(r)), "SOURCE_SCOPE_DENIED"),
        (~F.coalesce(F.array_contains("allowed_sensitivities", F.col("sensitivity")), F.lit(False)), "SENSITIVITY_DENIED"),
        (~F.col("allowed"), "DISCLOSURE_FIELD_DENIED"),
    )
    return j.select("request_id", F.when(reason.isNull(), "ALLOW").otherwise("DENY").alias("decision"), reason.alias("reason"))
