"""Failed calls of a service: their class, and counts by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

ENVELOPE = "error struct<code:string,message:string,type:string,upgrade_url:string,current_plan:string,requests_used:bigint,requests_limit:bigint>"


def envelope(body) -> Column:
    """The error of a body, or null where it has no code and message."""
    e = F.from_json(col(body), ENVELOPE)["error"]
    return F.when(e["code"].isNotNull() & e["message"].isNotNull(), e)


def error_class(status, body) -> Column:
    """auth (401, 403), quota_exceeded (429 with a readable envelope), else api."""
    return F.when(col(status).isin(401, 403), "auth").when((col(status) == 429) & envelope(body).isNotNull(), "quota_exceeded").otherwise("api")


def with_class(errors: DataFrame) -> DataFrame:
    return errors.withColumns({"error": envelope("body"), "error_class": error_class("status", "body")})


def api_error_summary(errors: DataFrame) -> DataFrame:
    """(error_class, code, n, most_used): counts, and the largest share of a quota that was used."""
    used = F.col("error.requests_used") / F.nullif(F.col("error.requests_limit"), F.lit(0))
    return with_class(errors).groupBy("error_class", F.col("error.code").alias("code")).agg(F.count("*").alias("n"), F.round(F.max(used), 6).alias("most_used"))


def verify_summary(checks: DataFrame) -> DataFrame:
    """One row: checks passed and failed, and the status of all."""
    failed = F.count_if(F.col("status") != "ok")
    return checks.agg(F.count_if(F.col("status") == "ok").alias("passed"), failed.alias("failed"), F.when(failed == 0, "ok").otherwise("failed").alias("status"))
