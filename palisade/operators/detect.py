"""Calls of provider kits in source files, all providers in one pass.

Files without any telling word are left to the JVM; the others go through one linear pass with a stack of modes
(``functions.lexer``), which gives each call's head, places and argument table. Calls are found with whatever object their name is taken from and at
any depth, in interpolations too, and not in comments, strings, regex literals or JSX text. Unclosed calls are not found. What a call
is of whom, and whether it has a base address, is said by expressions over that table.
"""

from __future__ import annotations

import functools
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer, registry
from ..functions.text import col
from ..sources.shared import small_batches

#: A file without any of these has no call.
TELLING = ["OpenAI", "Anthropic", "cohere", "Cohere", "InferenceClient", "HfInference", "Groq", "genai", "GoogleGenAI", "boto3", "BedrockRuntimeClient"]
#: Text whose calls are held as Python objects at a time, in code points.
PIECE = 1 << 18
#: Last names of heads that may be a kit's, by language.
WANTED = {
    "python": sorted({c for p in registry.PROVIDERS for c in (p[2], p[4]) if c} | {"Client", "ClientV2", "client"}),
    "typescript": sorted({p[5] for p in registry.PROVIDERS}),
}


def language(ext) -> Column:
    return F.when(col(ext) == "py", "python").when(col(ext).isin("ts", "tsx", "js", "jsx"), "typescript")


def grammar(ext) -> Column:
    return F.when(col(ext) == "py", "python").when(col(ext).isin("tsx", "jsx"), "tsx").when(col(ext).isin("ts", "js"), "typescript")


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumns({"language": language("ext"), "grammar": grammar("ext")})


def _provider(head: Column, args: Column, args_start: Column, table: Column) -> Column:
    """The provider of a call's head (names before the bracket) and arguments; null where it is none's."""
    name = F.regexp_replace(head, r"\s", "")
    last = F.regexp_extract(name, r"([A-Za-z0-9_]+)$", 1)
    out = F.lit(None).cast("string")
    for p, _, py, _, py_async, ts, _, _ in registry.PROVIDERS:
        if py and py != "Client":
            out = F.when(last.isin([x for x in (py, py_async) if x]) & ~F.startswith(head, F.lit("new")), F.lit(p)).otherwise(out)
        out = F.when(name == f"new{ts}", F.lit(p)).otherwise(out)
    names_service = lambda a: (a["kind"] == "string") & F.contains(F.substring(args, a["start"] - args_start + 1, a["end"] - a["start"]), F.lit("bedrock-runtime"))
    first = F.get(table, 0)
    service = F.coalesce(first["name"].isNull() & names_service(first), F.lit(False)) | F.exists(table, lambda a: (a["name"] == "service_name") & names_service(a))
    out = F.when(name.isin("cohere.Client", "cohere.ClientV2"), F.lit("cohere")).otherwise(out)
    out = F.when(name.rlike(r"(^|\.)genai\.Client$"), F.lit("gemini")).otherwise(out)
    return F.when((name == "boto3.client") & service, F.lit("bedrock")).otherwise(out)


def py_has_base_url(args) -> Column:
    return F.contains(col(args), F.lit("base_url=")) | F.contains(col(args), F.lit("base_url ="))


def ts_has_base_url(args, param) -> Column:
    """By the provider's parameter, bare or quoted (then with a space after the colon), or by ``base_url:``."""
    args, param = col(args), col(param)
    forms = [F.concat(param, F.lit(":")), F.concat(F.lit('"'), param, F.lit('": ')), F.concat(F.lit("'"), param, F.lit("': "))]
    own = F.lit(False)
    for f in forms:
        own = own | F.contains(args, f)
    return F.coalesce(own, F.lit(False)) | F.contains(args, F.lit("base_url:"))


@F.arrow_udf(lexer.CALLS)
def _found(content: pa.Array, grammar: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    kind, done, held, size = to_arrow_type(lexer.CALLS), [], [], 0
    for t, g in zip(content, grammar, strict=True):
        text = t.as_py()
        held.append(lexer.calls(text, g.as_py(), WANTED))
        size += len(text or "")
        if size >= PIECE:
            done.append(pa.array(held, kind))
            held, size = [], 0
    out = pa.concat_arrays([*done, pa.array(held, kind)])
    pa.default_memory_pool().release_unused()
    return out


def _telling(content: Column) -> Column:
    """Literals one after the other, which is far cheaper than one pattern of them all."""
    return functools.reduce(operator.or_, (F.contains(content, F.lit(t)) for t in TELLING))


def calls(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """A row for each call of a kit: (…, language, provider, head, args, and the fields of ``lexer.CALLS``).

    Places are in code points from 0; line and column count from 1, the column in bytes.
    """
    small_batches(files.sparkSession)
    likely = files.withColumn("language", language("ext")).filter(F.col("language").isNotNull() & _telling(F.col("content")))
    lexed = likely.select(*keep, "language", "content", _found("content", grammar("ext")).alias("found"))
    args = lambda c: F.substring("content", c["args_start"] + 1, c["args_end"] - c["args_start"])
    each = lexed.select(*keep, "language", F.explode(F.transform("found", lambda c: F.struct(c.alias("c"), args(c).alias("args")))).alias("e"))
    rows = each.select(*keep, "language", "e.c.*", "e.args")
    return rows.withColumn("provider", _provider(F.col("head"), F.col("args"), F.col("args_start"), F.col("arguments"))).filter("provider is not null")


def detect_all(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Detections of all providers: (…, provider, line, column, has_base_url, current_base_url)."""
    found = with_provider_info(calls(files, keep))
    has = F.when(F.col("language") == "python", py_has_base_url("args")).otherwise(ts_has_base_url("args", "ts_base_url_param"))
    return found.select(*keep, "language", "provider", "head", "line", "column", has.alias("has_base_url")).withColumn("current_base_url", F.when(F.col("has_base_url"), "(configured)"))


def with_provider_info(detections: DataFrame) -> DataFrame:
    return detections.join(F.broadcast(registry.providers(detections.sparkSession)), "provider")


def filter_provider(detections: DataFrame, provider: str) -> DataFrame:
    return detections.filter(F.col("provider") == provider)


def provider_files(detections: DataFrame, providers: list[str]) -> DataFrame:
    """(provider, path) of the providers that the given names, or other names, stand for."""
    spark = detections.sparkSession
    wanted = registry.values(spark, [(p,) for p in providers], "name string").select(registry.parse_provider("name").alias("provider")).filter("provider is not null")
    return detections.join(F.broadcast(wanted), "provider", "left_semi").select("provider", "path").distinct()


def unprotected(detections: DataFrame) -> DataFrame:
    return detections.filter(~F.col("has_base_url"))


def coverage(detections: DataFrame) -> DataFrame:
    """Adds coverage: ``proxy`` where a base address is set, ``runtime`` where the class can be patched, else ``detect_only``."""
    name = F.element_at(F.split("head", r"\."), -1)
    patched = registry.patched(detections.sparkSession).withColumn("class", F.element_at(F.split("runtime_class", r"\."), -1)).select("provider", F.col("class").alias("_class")).distinct()
    own = detections.withColumn("_class", F.when(F.col("language") == "python", name).otherwise(F.lit("")))
    out = own.join(F.broadcast(patched.withColumn("_patched", F.lit(True))), ["provider", "_class"], "left")
    return out.withColumn("coverage", F.when(F.col("has_base_url"), "proxy").when(F.col("_patched"), "runtime").otherwise("detect_only")).drop("_class", "_patched")


def provider_summary(detections: DataFrame) -> DataFrame:
    """(provider, file_count, instance_count) over all repositories; numbers alone are shuffled."""
    files = detections.groupBy("provider", "repo", "path").agg(F.count("*").alias("n"))
    return files.groupBy("provider").agg(F.count("*").alias("file_count"), F.sum("n").alias("instance_count"))


def provider_report(detections: DataFrame) -> DataFrame:
    """A row for each provider and repository, with its sorted files and calls nested: a list is as long as one repository makes it."""
    return detections.groupBy("provider", "repo").agg(
        F.count_distinct("path").alias("file_count"),
        F.count("*").alias("instance_count"),
        F.sort_array(F.collect_set("path")).alias("files"),
        F.sort_array(F.collect_list(F.struct("path", "line", "column", "has_base_url"))).alias("instances"),
    )


def scan_totals(files: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: files scanned, files with calls, calls, and providers found."""
    of_files = files.agg(F.count("*").alias("files_scanned"))
    of_calls = detections.agg(F.countDistinct("repo", "path").alias("files_with_sdks"), F.count("*").alias("total_instances"), F.countDistinct("provider").alias("providers_found"))
    return of_files.crossJoin(of_calls)  # one row each
