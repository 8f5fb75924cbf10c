"""Environment variables that files define and code uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_api_related
from ..functions.text import lines, trim, unquote


def _numbered(files: DataFrame, keep: list[str]) -> DataFrame:
    return files.select(*keep, F.posexplode(lines("content")).alias("place", "said")).select(*keep, (F.col("place") + 1).alias("line"), "said")


def parse_env(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """(…, line, name, value) of the lines of env files: cut at the first ``=``; one pair of quotes goes; comments are skipped."""
    rows = _numbered(files, list(keep)).withColumn("said", trim("said"))
    rows = rows.filter(~F.startswith("said", F.lit("#")) & F.contains("said", F.lit("=")))
    at = F.instr("said", "=")
    name, value = trim(F.substring("said", F.lit(1), at - 1)), trim(F.substring("said", at + 1, F.length("said")))
    return rows.select(*keep, "line", name.alias("name"), unquote(value).alias("value"))


# The ways to read a variable, in the order in which they are tried.
_PYTHON = ['os.environ["', "os.environ['", 'os.environ.get("', "os.environ.get('", 'os.getenv("', "os.getenv('"]
_SCRIPT = ['process.env["', "process.env['"]


def _quoted_after(ways: list[str]):
    """What stands in quotes from the first way on that a line has: in double quotes if there are any from there, else in single ones."""
    rest = F.lit(None).cast("string")
    for way in reversed(ways):
        at = F.instr("said", way)
        rest = F.when(at > 0, F.substring("said", at, F.length("said"))).otherwise(rest)
    double, single = (F.nullif(F.regexp_extract(rest, f"{q}([^{q}]*){q}", 0), F.lit("")) for q in ('"', "'"))
    found = F.when(F.contains(rest, F.lit('"')), double).otherwise(single)
    return F.substring(found, F.lit(2), F.length(found) - 2)


def python_env_uses(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """(…, line, name, context, language): one variable a line, by the first way that the line has; comments count."""
    rows = _numbered(files, list(keep)).withColumn("name", _quoted_after(_PYTHON)).filter("name is not null")
    return rows.select(*keep, "line", "name", trim("said").alias("context"), F.lit("python").alias("language"))


def ts_env_uses(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """(…, line, name, context, language): ``process.env.NAME`` first; only without it ``process.env["NAME"]`` or with single quotes."""
    rows = _numbered(files, list(keep))
    dotted = F.regexp_extract("said", r"process\.env\.([\p{L}\p{N}_]*)", 1)
    bracket = _quoted_after(_SCRIPT)
    name = F.when(F.contains("said", F.lit("process.env.")), F.nullif(dotted, F.lit(""))).otherwise(bracket)
    return rows.withColumn("name", name).filter("name is not null").select(*keep, "line", "name", trim("said").alias("context"), F.lit("typescript").alias("language"))


def env_inventory(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, state, n_defs, n_uses): names defined only, used only, or both; one pass over the union."""
    both = defs.select("name", F.lit(1).alias("d"), F.lit(0).alias("u")).unionByName(uses.select("name", F.lit(0).alias("d"), F.lit(1).alias("u")))
    out = both.groupBy("name").agg(F.sum("d").alias("n_defs"), F.sum("u").alias("n_uses"))
    return out.withColumn("state", F.when((F.col("n_defs") > 0) & (F.col("n_uses") > 0), "both").when(F.col("n_defs") > 0, "defined_only").otherwise("used_only"))


def env_report(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, place): a row for each API-related definition and each use, in words; nothing is gathered by name."""
    place = lambda what: F.format_string(f"{what} in %s:%d", F.col("path"), F.col("line"))
    return api_related(defs).select("name", place("Defined").alias("place")).unionByName(uses.select("name", place("Used").alias("place")))


def api_related(defs: DataFrame) -> DataFrame:
    return defs.filter(is_api_related("name"))
