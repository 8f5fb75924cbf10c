"""Where programs start, what framework a repository uses, and its languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import language
from .paths import drop_symlinks, prune_skip_dirs

# Names of files in which programs start.
PYTHON_ENTRY = ["main.py", "app.py", "server.py", "run.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py"]
SCRIPT_ENTRY = ["index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.js", "server.ts", "server.js"]
# Frameworks in the order in which they are looked for.
SCRIPT_FRAMEWORKS = [("next", "nextjs"), ("express", "express")]
PYTHON_FRAMEWORKS = ["django", "fastapi", "flask"]


def python_entry_points(files: DataFrame) -> DataFrame:
    """(repo, path): the usual names, and .py files with a main guard, at most three directories deep."""
    near = drop_symlinks(prune_skip_dirs(files, "any_component")).filter("depth <= 3")
    guarded = F.lower("file_name").endswith(".py") & (F.contains("content", F.lit("if __name__ == \"__main__\":")) | F.contains("content", F.lit("if __name__ == '__main__':")))
    return near.filter(F.col("file_name").isin(PYTHON_ENTRY) | F.coalesce(guarded, F.lit(False))).select("repo", "path").distinct()


def ts_entry_points(files: DataFrame) -> DataFrame:
    """(repo, path): what the manifest names and what exists, and the usual names at the top, in src and in lib."""
    manifest = F.from_json("content", "main string, scripts map<string,string>")
    named = files.filter("path = 'package.json'").select("repo", manifest.alias("m"))
    words = F.filter(F.split(F.coalesce(F.element_at("m.scripts", "start"), F.lit("")), r"\s+"), lambda w: F.lower(w).rlike(r"[^/]\.(js|ts)$"))
    listed = named.select("repo", F.explode(F.array_compact(F.concat(F.array("m.main"), words))).alias("path"))
    listed = listed.withColumn("path", F.regexp_replace("path", r"^(\./)+", "")).join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    usual = drop_symlinks(prune_skip_dirs(files, "any_component")).filter(F.col("file_name").isin(SCRIPT_ENTRY) & F.col("path").rlike("^(?:(?:src|lib)/)?(?:[^/]+/)?[^/]+$"))
    return listed.unionByName(usual.select("repo", "path")).distinct()


def detect_framework(files: DataFrame) -> DataFrame:
    """(repo, framework): by the first rule that a file at the repository's top fits."""
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    top = files.filter("depth = 1").withColumn("d", F.when(F.col("file_name") == "package.json", deps))
    keys = F.concat(F.coalesce(F.map_keys("d.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("d.devDependencies"), F.array().cast("array<string>")))
    rules = [F.when(F.col("file_name").isin("next.config.js", "next.config.mjs", "next.config.ts"), F.struct(F.lit(0).alias("place"), F.lit("nextjs").alias("framework")))]
    for i, (dep, name) in enumerate(SCRIPT_FRAMEWORKS):
        rules.append(F.when((F.col("file_name") == "package.json") & F.array_contains(keys, dep), F.struct(F.lit(1 + i).alias("place"), F.lit(name).alias("framework"))))
    for i, manifest in enumerate(["requirements.txt", "pyproject.toml"]):
        for j, name in enumerate(PYTHON_FRAMEWORKS):
            rules.append(F.when((F.col("file_name") == manifest) & F.contains(F.lower("content"), F.lit(name)), F.struct(F.lit(3 + 3 * i + j).alias("place"), F.lit(name).alias("framework"))))
    best = top.select("repo", F.array_min(F.array_compact(F.array(*rules))).alias("best")).filter("best is not null")
    return best.groupBy("repo").agg(F.min_by("best.framework", "best.place").alias("framework"))


def repo_languages(files: DataFrame) -> DataFrame:
    own = files.select("repo", language("ext").alias("language")).filter("language is not null")
    return own.groupBy("repo").agg(F.sort_array(F.collect_set("language")).alias("languages"))
