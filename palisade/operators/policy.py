"""Guardrail policies: validation, two-level differences, and applying one table of policies to another.

A policy is a variant (free JSON). Values are compared by their JSON text, in which 1 and 1.0 are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The words a policy may use.
LEVELS = ["strict", "moderate", "permissive"]
PII_MODES = ["redact", "mask", "block"]
LEVEL_FIELDS = ["prompt_injection", "data_exfiltration", "secret_key_detection"]
NONE = "(none)"


def _get(path: str, kind: str = "string"):
    return F.try_variant_get("guardrails", path, kind)


def _text(path: str):
    """A value if it is a JSON string."""
    value = _get(path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", _get(path))


def validate_policies(policies: DataFrame) -> DataFrame:
    """(project_id, errors): all errors of a policy together; an empty array for a valid one."""
    checks = [F.when(~_text(f"$.{f}.level").isin(LEVELS), F.lit(f"guardrails.{f}.level: must be one of {', '.join(LEVELS)}")) for f in [*LEVEL_FIELDS, "pii_detection"]]
    checks.append(F.when(~_text("$.pii_detection.mode").isin(PII_MODES), F.lit(f"guardrails.pii_detection.mode: must be one of {', '.join(PII_MODES)}")))
    kind = F.schema_of_variant(_get("$.toxicity.threshold", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)"), _get("$.toxicity.threshold", "double"))
    checks.append(F.when(~number.between(0, 1), F.lit("guardrails.toxicity.threshold: must be 0.0-1.0")))
    return policies.select("project_id", F.array_compact(F.array(*checks)).alias("errors"))


def entries(policies: DataFrame, value: str = "guardrails") -> DataFrame:
    """(project_id, key, is_object, value) of a policy's first level."""
    out = policies.select("project_id", F.col(value).alias("v")).lateralJoin(policies.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return out.select("project_id", "key", F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")).alias("is_object"), F.col("value"))


def diff_policies(current: DataFrame, desired: DataFrame) -> DataFrame:
    """(project_id, field, old, new): keys whose values differ; where both are objects, their keys one level down."""
    a = entries(current).select("project_id", "key", F.col("is_object").alias("a_object"), F.col("value").alias("a"))
    b = entries(desired).select("project_id", "key", F.col("is_object").alias("b_object"), F.col("value").alias("b"))
    first = a.join(b, ["project_id", "key"], "full_outer").withColumn("both", F.coalesce(F.col("a_object") & F.col("b_object"), F.lit(False)))
    shown = lambda c: F.coalesce(F.to_json(c), F.lit(NONE))
    whole = first.filter("not both").select("project_id", F.col("key").alias("field"), shown(F.col("a")).alias("old"), shown(F.col("b")).alias("new"))
    spark = current.sparkSession
    inner = first.filter("both").select("project_id", F.col("key").alias("top"), "a", "b")

    def sub(side: str) -> DataFrame:
        out = inner.select("project_id", "top", F.col(side).alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        return out.select("project_id", F.concat_ws(".", "top", "key").alias("field"), F.to_json("value").alias(side))

    below = sub("a").join(sub("b"), ["project_id", "field"], "full_outer")
    below = below.select("project_id", "field", F.coalesce("a", F.lit(NONE)).alias("old"), F.coalesce("b", F.lit(NONE)).alias("new"))
    return whole.unionByName(below).filter("old <> new")


def apply_policies(current: DataFrame, desired: DataFrame, dry_run: bool = False) -> DataFrame:
    """The policies with every desired one in the place of its project's; with dry_run the differences."""
    if dry_run:
        return diff_policies(current, desired)
    both = current.select("project_id", F.col("guardrails").alias("a")).join(desired.select("project_id", F.col("guardrails").alias("b")), "project_id", "full_outer")
    return both.select("project_id", F.coalesce("b", "a").alias("guardrails"))


def export_policies(policies: DataFrame) -> DataFrame:
    """(project_id, value): each policy as a JSON document under ``guardrails``."""
    return policies.select("project_id", F.concat(F.lit('{"guardrails":'), F.to_json("guardrails"), F.lit("}")).alias("value"))
