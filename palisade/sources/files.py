"""Inputs and outputs of the library; those of source trees are in ``trees``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import SOURCE_FILES, read_source_files, stream_source_files  # noqa: F401

SCAN_RESULT = "blocked boolean, decision string, confidence double, reason string, threatType string, eventId string, processingTimeMs double"
REDACTION = "original string, redacted string, piiFound array<string>"
REDTEAM = "total_tests int, blocked int, allowed int, block_rate double, results array<struct<test_name:string,prompt:string,decision:string,reason:string,threat_type:string,confidence:double,blocked:boolean,details:string>>"


def read_scan_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_RESULT).json(path).withColumnsRenamed({"threatType": "threat_type", "eventId": "event_id", "processingTimeMs": "processing_time_ms"})


def read_redactions(spark: SparkSession, path: str) -> DataFrame:
    """pii_found is empty where the record has none."""
    return spark.read.schema(REDACTION).json(path).select("original", "redacted", F.coalesce("piiFound", F.array().cast("array<string>")).alias("pii_found"))


def read_redteam(spark: SparkSession, path: str) -> DataFrame:
    """A row for each result of summary documents; details are free JSON."""
    rows = spark.read.schema(REDTEAM).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    return rows.withColumn("details", F.try_parse_json("details"))


def _plain_yaml(text: str):
    """A YAML document of nested mappings, lists of scalars and scalars, as policies are; ValueError for anything else."""
    import json

    def scalar(t: str):
        t = t.strip()
        if t[:1] == "'" and len(t) > 1 and t[-1] == "'":
            return t[1:-1].replace("''", "'")
        if t in ("", "~", "null"):
            return None
        if t[0] in "[{\"-0123456789" or t in ("true", "false"):
            try:
                return json.loads(t)
            except ValueError:
                pass
        if t[0] in "&*!|>%@`[]{}\"'" or ": " in t:
            raise ValueError(t)
        return t

    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", y) if "'" not in y and '"' not in y else y for y in text.splitlines()) if x.strip() and x.strip() != "---" and not x.lstrip().startswith("#")]

    def block(at: int, depth: int):
        out = None
        while at < len(lines) and lines[at][0] == depth:
            said = lines[at][1]
            if said.startswith("- "):
                out = [] if out is None else out
                out.append(scalar(said[2:]))
                at += 1
                continue
            key, colon, value = said.partition(":")
            if not colon or isinstance(out, list) or (value and value[0] != " "):
                raise ValueError(said)
            out, at = {} if out is None else out, at + 1
            if value.strip():
                out[scalar(key)] = scalar(value)
            elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
                out[scalar(key)], at = block(at, lines[at][0])
            else:
                out[scalar(key)] = None
        return out, at

    out, at = block(0, lines[0][0] if lines else 0)
    if at < len(lines):
        raise ValueError(lines[at][1])
    return out


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """(path, guardrails, error): JSON or YAML documents; bad ones are kept with their error.

    Without the yaml module, YAML is read as far as policies go: nested mappings, lists of scalars and scalars.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def decoded(batches):
        import json

        try:
            from yaml import YAMLError, safe_load
        except ImportError:
            YAMLError, safe_load = ValueError, _plain_yaml
        bad = (YAMLError, ValueError, TypeError)  # keys that JSON does not have, among others
        for pdf in batches:
            out = []
            for v in pdf.value:
                try:
                    out.append(json.dumps(safe_load(v), default=str))  # dates as text
                except bad:
                    out.append(None)
            yield pdf.assign(value=out)

    is_yaml = F.col("path").rlike(r"\.ya?ml$")
    plain = docs.filter(~is_yaml)
    texts = plain.unionByName(docs.filter(is_yaml).mapInPandas(decoded, "path string, value string"))
    found = texts.withColumn("doc", F.try_parse_json("value")).withColumn("guardrails", F.try_variant_get("doc", "$.guardrails", "variant"))
    error = F.when(F.col("doc").isNull(), "not readable").when(F.col("guardrails").isNull(), "no top-level guardrails")
    return found.select("path", "guardrails", error.alias("error"))


def read_api_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("method string, status int, error_kind string, body string").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("conv_id", "turn", "role", "text")


def read_attacks(spark: SparkSession, path: str | None = None, prompt: str | None = None) -> DataFrame:
    """(test_name, prompt) from JSON lines, or one custom prompt."""
    if prompt is not None:
        return spark.createDataFrame([("custom", prompt)], "test_name string, prompt string")
    return spark.read.schema("test_name string, prompt string").json(path)


def write_scan_report(files: DataFrame, detections: DataFrame, path: str) -> None:
    """JSON records below a path: ``totals`` of the scan, ``providers`` with their counts, and ``calls``, nested by provider and repository."""
    from ..operators import detect

    for name, table in (("totals", detect.scan_totals(files, detections)), ("providers", detect.provider_summary(detections)), ("calls", detect.provider_report(detections))):
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_text(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Writes a new dataset, never in place; a dry run writes nothing. Gives the rows back either way."""
    if not dry_run:
        df.write.mode("errorifexists").parquet(path)
    return df


def write_policies(policies: DataFrame, path: str) -> None:
    from ..operators.policy import export_policies

    export_policies(policies).select("value").write.mode("errorifexists").text(path)
