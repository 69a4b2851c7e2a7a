"""Stores of style references, previews and logs: Parquet and JSON tables instead of folders of files.

Sweeps return what stays; ``versions`` holds such tables, so that what stays takes
the place of what was in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
REFERENCE_HOURS, VARIANTS = 24, ("raw", "enhanced")
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def reference_id(when: Column, token: Column) -> Column:
    """``style-ref-`` with the day and the first eight hexadecimal digits of ``token``."""
    return F.concat(F.lit("style-ref-"), F.date_format(when, "yyyyMMdd"), F.lit("-"), F.substring(F.regexp_replace(token, "-", ""), 1, 8))


def references(uploads: DataFrame, token: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the store for uploads (filename, content_type, label, created_at, height, width, fingerprint), with their ``keys``: in a large store a day's uploads can share the eight digits of an id."""
    made = reference_id(F.col("created_at"), token if token is not None else F.uuid())
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    original = F.concat(F.lit("original"), F.coalesce(F.try_element_at(known, F.col("content_type")), F.lit(".bin")))
    meta = F.struct("filename", "content_type", "label", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.array("height", "width").alias("normalized_shape"))
    return uploads.select(*keys, made.alias("reference_id"), original.alias("original"), "created_at", F.to_json(meta).alias("metadata"), F.col("fingerprint"))


def age_hours(created: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(created)) / 3.6e9


def created_at(metadata: Column) -> Column:
    """The time in a row's metadata; null if the metadata is missing, isn't JSON or has none."""
    return F.try_to_timestamp(F.get_json_object(metadata, "$.created_at"))


def loaded_reference(store: DataFrame, wanted: Column, now: Column, hours: float = REFERENCE_HOURS) -> DataFrame:
    """Rows of a reference that is no older than ``hours``; those without metadata or fingerprint count as not found."""
    age = age_hours(created_at(F.col("metadata")), now)
    # What has no time doesn't expire.
    return store.filter((F.col("reference_id") == wanted) & F.col("metadata").isNotNull() & F.col("fingerprint").isNotNull() & F.coalesce(age <= hours, F.lit(True)))


def swept_references(store: DataFrame, now: Column, hours: float = REFERENCE_HOURS) -> DataFrame:
    """What a sweep leaves: rows whose metadata is JSON and not older than ``hours``. Missing or bad metadata goes; without a time it stays."""
    parsed = F.try_parse_json("metadata")
    written = F.get_json_object("metadata", "$.created_at")
    old = age_hours(created_at(F.col("metadata")), now) > hours
    bad = F.col("metadata").isNull() | parsed.isNull() | (written.isNotNull() & created_at(F.col("metadata")).isNull())
    return store.filter(~bad & ~F.coalesce(old, F.lit(False)))


def preview_id(token: Column) -> Column:
    return F.concat(F.lit("preview_"), F.lower(F.regexp_replace(token, "-", "")))


def artifact_url(preview: Column, variant: str) -> Column:
    return F.concat(F.lit("/api/v1/previews/"), preview, F.lit(f"/artifacts/{variant}"))


def artifacts(renders: DataFrame) -> DataFrame:
    """A row an image that is there (preview_id, variant, bytes, url) of renders (preview_id, raw, enhanced)."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("bytes"), artifact_url(F.col("preview_id"), v).alias("url")) for v in VARIANTS])
    return renders.select("preview_id", F.explode(F.filter(each, lambda x: x["bytes"].isNotNull())).alias("a")).select("preview_id", "a.*")


def found_artifacts(store: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests (preview_id, variant) with the stored image's url and size; unknown variants and previews stay with nulls and ``found`` false."""
    known = asked.withColumn("__known", F.col("variant").isin(*VARIANTS))
    joined = known.join(store.select("preview_id", "variant", "url", F.length("bytes").alias("size")), ["preview_id", "variant"], "left")
    return joined.select(*asked.columns, "url", "size", (F.col("__known") & F.col("url").isNotNull()).alias("found"))


def manifests(previews_: DataFrame) -> DataFrame:
    """JSON manifests of previews (preview_id, status, warnings, error_type, error_message, render_ms, enhancement_ms, total_ms, attempts).

    A failed one has its error and no times but the total.
    """
    failed = F.col("status") == "failed"
    error = F.when(failed, F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message")))
    times = F.struct(F.when(~failed, F.col("render_ms")).alias("render"), F.when(~failed, F.col("enhancement_ms")).alias("enhancement"), F.col("total_ms").alias("total"))
    body = F.struct(F.col("preview_id").alias("id"), "status", "warnings", error.alias("error"), times.alias("timings_ms"), F.col("attempts").alias("render_attempts"))
    return previews_.select("preview_id", F.to_json(body).alias("manifest"))
