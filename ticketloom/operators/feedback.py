"""Reviewer corrections as training rows, without evaluation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import leak_key, ticket_text
from .scale import newest
from .tickets import corrected


def eval_keys(*sets: DataFrame) -> DataFrame:
    """Distinct comparison keys of all evaluation texts."""
    out = sets[0].select("text")
    for other in sets[1:]:
        out = out.union(other.select("text"))
    return out.select(leak_key("text").alias("key")).distinct()


def leak_rows(df: DataFrame, keys: DataFrame, *texts: str) -> DataFrame:
    """Ids of rows one of whose texts equals an evaluation text after normalisation.

    Each row contributes its fixed few keys; a semi join never multiplies rows, and Spark
    broadcasts the key set only while its measured size allows it.
    """
    candidates = df.select("row_id", F.explode(F.array_distinct(F.array(*[leak_key(t) for t in texts]))).alias("key"))
    return candidates.join(keys, "key", "left_semi").select("row_id").distinct()


def feedback_export(tickets: DataFrame, predictions: DataFrame, keys: DataFrame) -> DataFrame:
    """Corrected tickets as training rows, oldest correction first.

    Labels are '' where the reviewer did not correct that field; versions come from the newest
    prediction per model; rows matching an evaluation text are left out.
    """
    wanted = corrected(tickets).withColumn("text", ticket_text())
    leaks = leak_rows(wanted.withColumn("row_id", F.col("ticket_id")), keys, "text", "body")
    clean = wanted.join(leaks.withColumnRenamed("row_id", "ticket_id"), "ticket_id", "left_anti")
    version = lambda model: F.max(F.when(F.col("model_name") == model, F.col("model_version")))
    # only the exported tickets' predictions take part
    relevant = predictions.join(clean.select("ticket_id"), "ticket_id", "left_semi")
    versions = (
        newest(relevant, ["ticket_id", "model_name"], ["created_at", "model_version"], ["model_version"])
        .groupBy("ticket_id")
        .agg(
            version("category_classifier").alias("category_model_version"),
            version("urgency_classifier").alias("urgency_model_version"),
        )
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        clean.join(versions, "ticket_id", "left")
        .orderBy("corrected_at", "ticket_id")
        .select(
            F.col("ticket_id").cast("string").alias("ticket_id"),
            "tenant_id",
            "text",
            blank("corrected_category").alias("category"),
            blank("corrected_urgency").alias("urgency"),
            F.coalesce("category", F.lit("")).alias("predicted_category"),
            F.coalesce("urgency", F.lit("")).alias("predicted_urgency"),
            blank("category_model_version").alias("category_model_version"),
            blank("urgency_model_version").alias("urgency_model_version"),
            blank("corrected_by").alias("corrected_by"),
            blank(F.date_format("corrected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).alias("corrected_at"),
        )
    )


def manifest(export: DataFrame) -> DataFrame:
    """Per tenant: rows, labels per kind, and a checksum that does not depend on row order."""
    row = F.md5(F.concat_ws("\u0001", "ticket_id", "text", "category", "urgency").cast("binary"))
    piece = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return export.groupBy("tenant_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("category") != "").alias("category_labels"),
        F.count_if(F.col("urgency") != "").alias("urgency_labels"),
        F.sum(piece).alias("checksum"),
    )


def feedback_rows(export: DataFrame, label: str) -> DataFrame:
    """Text and label of rows whose `label` was corrected."""
    return export.filter(F.col(label) != "").select("text", F.col(label).alias("label"))


def feedback_backlog(export: DataFrame, registry: DataFrame) -> DataFrame:
    """Per served model (model, label, trained_rows): corrections it has not been trained on."""
    counts = export.agg(F.count_if(F.col("category") != "").alias("category"), F.count_if(F.col("urgency") != "").alias("urgency"))
    available = counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("available")) for c in ("category", "urgency")]))
    )
    return registry.join(F.broadcast(available), "label").withColumn(  # two rows
        "backlog", F.greatest(F.col("available") - F.col("trained_rows"), F.lit(0))
    )


def human_label_pool(**sources: DataFrame) -> DataFrame:
    """Union of labelled sources (text, label) with the source's name."""
    out = None
    for name, df in sources.items():
        part = df.select("text", "label", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def training_rows(weak: DataFrame, human: DataFrame, human_weight: float) -> DataFrame:
    """Weak rows at weight 1 and human rows at their weight; a weight of 0 leaves them out."""
    base = weak.select("text", "label", F.lit(1.0).alias("weight"))
    if human_weight == 0:
        return base
    return base.unionByName(human.select("text", "label", F.lit(float(human_weight)).alias("weight")))
