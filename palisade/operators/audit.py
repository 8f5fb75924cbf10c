"""Audits over the files and settings of many repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.registry import values
from ..functions.text import is_newer, lines, mask_key, trim
from .paths import EXCLUDES

CONFIG_FILE, KEY_NAME = ".gateway.json", "GATEWAY_API_KEY"
VERSIONS = ["1.0"]
CONFIG = (
    "version string, api_key string, project_id string, proxy_url string, providers array<string>, exclude_patterns array<string>, backup_enabled boolean, "
    "backup_extension string, env_file string, env_var_name string, framework string, enabled boolean, runtime_mode boolean, "
    "metadata struct<last_applied:timestamp,cli_version:string,files_managed:array<string>,backups:array<string>>"
)


def parse_configs(files: DataFrame, name: str = CONFIG_FILE) -> DataFrame:
    """(repo, …settings): one row for each settings file at a repository's top, with defaults in place of what is missing.

    Settings that are no JSON object, or lack a version, key, address or list of providers, have ``valid`` false.
    """
    own = files.filter((F.col("file_name") == name) & (F.col("depth") == 1)).select("repo", F.from_json("content", CONFIG).alias("c"))
    none = F.array().cast("array<string>")
    defaults = {
        "exclude_patterns": F.array(*[F.lit(x) for x in EXCLUDES]),
        "backup_enabled": F.lit(True),
        "backup_extension": F.lit(".bak"),
        "env_file": F.lit(".env"),
        "env_var_name": F.lit(KEY_NAME),
        "enabled": F.lit(True),
        "runtime_mode": F.lit(False),
    }
    kept = [f.split(" ")[0] for f in CONFIG.split(", ")]
    columns = [F.coalesce(F.col(f"c.{k}"), defaults[k]).alias(k) if k in defaults else F.col(f"c.{k}") for k in kept if k != "metadata"]
    m = F.struct(F.col("c.metadata.last_applied").alias("last_applied"), F.col("c.metadata.cli_version").alias("cli_version"), F.coalesce("c.metadata.files_managed", none).alias("files_managed"), F.coalesce("c.metadata.backups", none).alias("backups"))
    valid = F.col("c.version").isNotNull() & F.col("c.api_key").isNotNull() & F.col("c.proxy_url").isNotNull() & F.col("c.providers").isNotNull()
    return own.select("repo", *columns, m.alias("metadata"), valid.alias("valid"))


def hygiene_checks(files: DataFrame, config: str = CONFIG_FILE, key: str = KEY_NAME) -> DataFrame:
    """(repo, name, status, message): the checks of each repository; of its files only those that the checks read are gathered."""
    top = F.col("depth") == 1
    every = files.select("repo").distinct()
    files = files.filter((top & F.col("file_name").isin(config, ".env", ".gitignore")) | F.endswith("file_name", F.lit(".bak")))
    content = lambda name: F.max(F.when(top & (F.col("file_name") == name), F.coalesce("content", F.lit(""))))
    own = files.groupBy("repo").agg(content(config).alias("config"), content(".env").alias("env"), F.coalesce(content(".gitignore"), F.lit("")).alias("ignore"), F.count_if(F.endswith("file_name", F.lit(".bak"))).alias("backups"))
    own = every.join(own, "repo", "left").withColumns({"ignore": F.coalesce("ignore", F.lit("")), "backups": F.coalesce("backups", F.lit(0).cast("long"))})
    parsed = F.from_json("config", CONFIG)
    valid = parsed["version"].isNotNull() & parsed["api_key"].isNotNull() & parsed["proxy_url"].isNotNull() & parsed["providers"].isNotNull()
    check = lambda name, status, message: F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    ignored = p.is_ignored("ignore", config)
    checks = [
        F.when(F.col("config").isNull(), check("config_file", "warning", "not found")).when(valid, check("config_file", "ok", "valid")).otherwise(check("config_file", "error", "invalid")),
        F.when(valid, F.when(p.is_valid_key(parsed["api_key"]), check("api_key", "ok", "valid format")).otherwise(check("api_key", "error", "invalid format"))),
        F.when(valid, F.when(ignored, check("config_gitignore", "ok", "ignored")).otherwise(check("config_gitignore", "warning", "not ignored"))),
        F.when(F.col("env").isNull(), check("env_file", "warning", "not found")).when(p.has_env_key("env", key), check("env_file", "ok", "has the key")).otherwise(check("env_file", "warning", "lacks the key")),
        F.when(p.has_env_key("env", key), F.when(p.is_ignored("ignore", ".env"), check("env_gitignore", "ok", "ignored")).otherwise(check("env_gitignore", "warning", "not ignored"))),
        F.when(F.col("backups") == 0, check("backups", "ok", "none")).otherwise(check("backups", "warning", F.concat(F.col("backups").cast("string"), F.lit(" found")))),
    ]
    return own.select("repo", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("repo", "c.*")


def repo_health(checks: DataFrame) -> DataFrame:
    """(repo, health, errors, warnings, checks): error beats warning beats healthy."""
    out = checks.groupBy("repo").agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"), F.sort_array(F.collect_list(F.struct("name", "status", "message"))).alias("checks"))
    return out.withColumn("health", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("healthy"))


def validate_configs(configs: DataFrame) -> DataFrame:
    """(repo, errors): the settings that are not valid, all together."""
    wrong = {
        "version": ~F.col("version").isin(VERSIONS),
        "env_file": ~p.is_safe_env_path("env_file"),
        "proxy_url": ~p.is_valid_proxy_url("proxy_url"),
        "env_var_name": ~p.is_valid_env_name("env_var_name"),
        "backup_extension": ~p.is_valid_backup_ext("backup_extension"),
        "api_key": ~p.is_valid_key("api_key"),
    }
    return configs.select("repo", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in wrong.items()])).alias("errors"))


def host_risk(configs: DataFrame, default: str = p.DEFAULT_HOST) -> DataFrame:
    """Repositories whose settings would send a key to an untrusted host."""
    return configs.filter(~p.is_trusted_host("proxy_url", default))


def outdated(configs: DataFrame, latest: str) -> DataFrame:
    return configs.filter(is_newer(F.col("metadata.cli_version"), F.lit(latest)))


def repo_status(configs: DataFrame) -> DataFrame:
    return configs.select(
        "repo",
        F.when(F.col("enabled"), "active").otherwise("disabled").alias("status"),
        F.when(F.col("runtime_mode"), "runtime").otherwise("proxy").alias("mode"),
        mask_key("api_key").alias("api_key"),
        F.size(F.coalesce("providers", F.array().cast("array<string>"))).alias("n_providers"),
        F.size("metadata.files_managed").alias("n_managed"),
        F.size("metadata.backups").alias("n_backups"),
        *["enabled", "runtime_mode", "proxy_url", "providers", "backup_enabled", "env_file", "framework", "exclude_patterns"],
        F.col("metadata.files_managed").alias("managed_files"),
        F.col("metadata.backups").alias("backups"),
        F.col("metadata.cli_version").alias("cli_version"),
        F.col("metadata.last_applied").alias("last_applied"),
    )


def missing_ignores(files: DataFrame, entries: list[str]) -> DataFrame:
    """(repo, entry): required entries that a repository's ignore file lacks, or all where it has none."""
    spark = files.sparkSession
    wanted = files.select("repo").distinct().crossJoin(F.broadcast(values(spark, [(e,) for e in entries], "entry string")))  # a few entries
    said = files.filter((F.col("file_name") == ".gitignore") & (F.col("depth") == 1)).select("repo", F.explode(lines("content")).alias("entry"))
    said = said.select("repo", F.regexp_replace(trim("entry"), "^/", "").alias("entry")).distinct()
    return wanted.join(said, ["repo", "entry"], "left_anti")


def missing_backups(configs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path): recorded backups of which there is no file."""
    return configs.select("repo", F.explode("metadata.backups").alias("path")).distinct().join(files.select("repo", "path"), ["repo", "path"], "left_anti")


def managed_drift(configs: DataFrame, detections: DataFrame) -> DataFrame:
    """(repo, path, state): files that settings record as managed but no call is found in, or the other way round, or both."""
    managed = configs.select("repo", F.explode("metadata.files_managed").alias("path")).distinct().withColumn("managed", F.lit(True))
    found = detections.select("repo", "path").distinct().withColumn("found", F.lit(True))
    both = managed.join(found, ["repo", "path"], "full_outer")
    return both.select("repo", "path", F.when(F.col("managed") & F.col("found"), "both").when(F.col("managed"), "managed_only").otherwise("detected_only").alias("state"))
