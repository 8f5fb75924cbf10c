"""Filters on tables of source files by path: (repo, path, file_name, ext, depth, mtime, is_symlink, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Directories that are never looked into, file kinds, and globs that are left out by default.
SKIP_DIRS = ["node_modules", ".git", "dist", "build", "__pycache__", "__tests__", "venv", ".venv", ".next", ".mypy_cache"]
EXTENSIONS = ["ts", "tsx", "js", "jsx", "py"]
EXCLUDES = ["**/*.test.js", "**/*.test.ts", "**/*.spec.js", "**/*.spec.ts", "**/node_modules/**", "**/dist/**", "**/__tests__/**", "**/.venv/**", "**/venv/**"]
MORE_EXCLUDES = ["**/.git/**", "**/__pycache__/**", "**/*.pyc"]
ENV_FILES = [".env", ".env.local", ".env.development", ".env.production", ".env.test", ".env.example"]


def prune_skip_dirs(df: DataFrame, mode: str = "below_root") -> DataFrame:
    """Without files below a skipped directory; ``any_component`` also looks at the file's own name."""
    parts = F.split("path", "/")
    if mode == "below_root":
        parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    elif mode != "any_component":
        raise ValueError("mode: below_root or any_component")
    return df.filter(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIP_DIRS])))


def glob_regex(pattern: str) -> str:
    """An anchored pattern for a glob: ``*`` and ``?`` also cross slashes, ``**/`` stands for any directories, ``[…]`` for a set."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out, i = out + "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]", end + 1
        else:
            out, i = out + {"*": ".*", "?": "."}.get(c, ("\\" + c) if c in "\\.^$+{}()|[]" else c), i + 1
    return out


def exclude_globs(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Without files whose relative path or bare name fits a glob; the defaults hold where no list is given."""
    globs = [*EXCLUDES, *MORE_EXCLUDES] if patterns is None else patterns
    if not globs:
        return df
    regex = "(?s)^(?:" + "|".join(glob_regex(g) for g in globs) + ")$"
    return df.filter(~(F.col("path").rlike(regex) | F.col("file_name").rlike(regex)))


def glob_pattern(glob: Column) -> Column:
    """``glob_regex`` (without its ends) of globs that are data. A set with a range that runs backwards holds no sign."""
    parts = F.regexp_extract_all(glob, F.lit(r"(?s)(?:^|(?<=/))\*\*/|\*\*|\[.[^\]]*\]|."), F.lit(0))

    def sign_set(t):
        inside = F.substring(t, F.lit(2), F.length(t) - 2)
        other = inside.startswith("!")
        signs = F.regexp_replace(F.when(other, F.substring(inside, F.lit(2), F.length(inside))).otherwise(inside), r"([\\\[&^])", r"\\$1")
        backwards = F.exists(F.regexp_extract_all(inside, F.lit("(?s).-."), F.lit(0)), lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
        return F.when(backwards, F.when(other, ".").otherwise("(?!)")).otherwise(F.concat(F.when(other, "[^").otherwise("["), signs, F.lit("]")))

    return F.array_join(F.transform(parts, lambda t: F.when(t == "**/", "(?:.*/)?").when(t.isin("*", "**"), ".*").when(t == "?", ".").when(F.length(t) > 1, sign_set(t)).otherwise(F.regexp_replace(t, r"([\\.^$+{}()|\[\]])", r"\\$1"))), "")


def exclude_by_repo(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Without the files that their own repository's ``exclude_patterns`` fit; defaults hold where a repository has no list.

    configs: (repo, exclude_patterns), one row a repository, as ``audit.parse_configs`` gives them; a list takes the place of the defaults, an empty
    one leaves nothing out. Each distinct list becomes one pattern, whatever the number of repositories that share it.
    """
    named = configs.filter(F.col("exclude_patterns").isNotNull()).select("repo", F.filter("exclude_patterns", lambda g: g.isNotNull()).alias("globs"))
    named = named.withColumn("list", F.sha2(F.to_json("globs"), 256))
    body = F.array_join(F.transform("globs", glob_pattern), "|")
    patterns = named.select("list", "globs").dropDuplicates(["list"]).select("list", F.when(F.size("globs") > 0, F.concat(F.lit("(?s)^(?:"), body, F.lit(")$"))).otherwise("(?!)").alias("__excluded"))
    default = "(?s)^(?:" + "|".join(glob_regex(g) for g in [*EXCLUDES, *MORE_EXCLUDES]) + ")$"
    own = files.join(named.select("repo", "list").join(patterns, "list").select("repo", "__excluded"), "repo", "left").withColumn("__excluded", F.coalesce("__excluded", F.lit(default)))
    return own.filter(~(F.rlike("path", F.col("__excluded")) | F.rlike("file_name", F.col("__excluded")))).select(*[F.col(f"`{c}`") for c in files.columns])


def with_user_excludes(user: list[str]) -> list[str]:
    """The default globs and those of a user, each once."""
    return list(dict.fromkeys([*EXCLUDES, *user]))


def filter_ext(df: DataFrame, exts: list[str] | None = None) -> DataFrame:
    return df.filter(F.col("ext").isin(EXTENSIONS if exts is None else exts))


def drop_symlinks(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_symlink"))


def max_depth(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("depth") <= n)


def select_env_files(df: DataFrame) -> DataFrame:
    return max_depth(prune_skip_dirs(df, "any_component"), 3).filter(F.col("file_name").isin(ENV_FILES))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("mtime"), "path")


def backup_files(df: DataFrame, ext: str = ".bak") -> DataFrame:
    return df.filter(F.endswith("file_name", F.lit(ext)))


#: Parts into which the top of a repository is dealt, as all its directories meet there.
SALTS = 64


def assign_repo_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files with the nearest directory above them that ``roots(repo, root)`` has; null where there is none.

    Distinct directories alone are closed under their parents and resolved there; a file, and its content, is joined once, on its directory. All directories
    of a repository meet its top, which is therefore salted.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = files.select("repo", folder.alias("dir")).distinct().select("repo", "dir", F.explode(above).alias("root"))
    folders = folders.withColumn("salt", F.when(F.col("root") == "", F.pmod(F.xxhash64("dir"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("root") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = roots.select("repo", "root").distinct().withColumn("salt", F.explode(salts))
    nearest = folders.join(known, ["repo", "root", "salt"]).groupBy("repo", "dir").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.withColumn("dir", folder).join(nearest, ["repo", "dir"], "left").select(*[F.col(f"`{c}`") for c in files.columns], "root")


def top_files(detections: DataFrame, n: int = 10) -> DataFrame:
    """The first files of each provider in order of path."""
    by = W.partitionBy("provider").orderBy("path")
    return detections.select("provider", "path").distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def top_instances(detections: DataFrame, n: int = 3) -> DataFrame:
    """The first calls of each file and provider, and how many more there are."""
    own = W.partitionBy("provider", "path")
    ranked = detections.withColumn("rank", F.row_number().over(own.orderBy("line", "column"))).withColumn("more", F.greatest(F.count("*").over(own) - n, F.lit(0)))
    return ranked.filter(F.col("rank") <= n)
