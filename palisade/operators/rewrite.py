"""Planning and applying edits that route the found calls through a gateway, over a whole corpus.

``detect.calls`` finds the calls with their argument tables, ``plan_rewrites`` says what becomes of each and gives the splices before its
first argument and behind its last, ``apply_rewrites`` puts a file's splices together. Nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dominant_eol, join_lines, lines, reencode_eol, trim
from . import detect

KEY = ("repo", "path")


def _cut(text: Column, base: Column, start: Column, end: Column) -> Column:
    """What lies between two places of the file, of a text that begins at ``base``."""
    return F.substring(text, start - base + 1, end - start)


def _around(args: Column, base: Column, start: Column, end: Column, last: Column, opening: str, closing: Column, empty, some: Column) -> Column:
    """Edits that put ``closing`` behind the last entry of a bracket; or ``empty`` of its comments where it has no entry.

    Two splices, before the first entry and behind the last, so that the entries themselves stay open to edits of their own.
    """
    edit = lambda a, b, text: F.struct(a.alias("start"), b.alias("end"), text.alias("replacement"))
    inside = _cut(args, base, start + 1, end - 1)
    entry = start + 1 + F.length(inside) - F.length(F.regexp_replace(inside, r"(?U)^\s+", ""))
    tail = trim(F.regexp_replace(trim(_cut(args, base, last, end - 1)), r"^,", ""))
    behind = F.concat(F.lit(","), F.when(tail == "", "").otherwise(F.concat(F.lit("  "), tail)), F.lit("\n"), closing)
    return F.when(some, F.array(edit(start, entry, F.lit(opening)), edit(last, end, behind))).otherwise(F.array(edit(start, end, empty(trim(inside)))))


def _said(comments: Column, before: str) -> Column:
    """Comments of an empty bracket, on a line of their own."""
    return F.when(comments == "", "").otherwise(F.concat(F.lit(before), comments, F.lit("\n")))


def python_edits(proxy_url: str, env_var: str) -> Column:
    """The base address behind the last argument; with the key too where there are none. Comments stay."""
    base = F.lit(f'    base_url="{proxy_url}"\n')
    empty = lambda comments: F.concat(F.lit(f'(\n    api_key=os.environ.get("{env_var}"),\n'), base, _said(comments, "    "), F.lit(")"))
    return _around(F.col("args"), F.col("args_start"), F.col("args_start"), F.col("args_end"), F.col("last"), "(\n    ", F.concat(base, F.lit(")")), empty, F.size("arguments") > 0)


def script_edits(proxy_url: str, env_var: str) -> Column:
    """The base address behind the last entry of the options; an object with the key too where there are none."""
    base, key = (F.concat(F.lit("  "), F.col(c)) for c in ("ts_base_url_param", "ts_api_key_param"))
    url = F.concat(base, F.lit(f': "{proxy_url}"\n'))
    empty = lambda comments: F.concat(F.lit("{\n"), key, F.lit(f": process.env.{env_var},\n"), url, _said(comments, "  "), F.lit("}"))
    args, at = F.col("args"), F.col("args_start")
    own = _around(args, at, F.col("object"), F.col("object_end"), F.col("object_last"), "{\n  ", F.concat(url, F.lit("}")), empty, F.col("object_last") > F.col("object") + 1)
    made = F.concat(F.lit("("), empty(trim(_cut(args, at, at + 1, F.col("args_end") - 1))), F.lit(")"))
    return F.when(F.col("object").isNotNull(), own).otherwise(F.array(F.struct(at.alias("start"), F.col("args_end").alias("end"), made.alias("replacement"))))


def plan_rewrites(files: DataFrame, proxy_url: str, env_var: str = "GATEWAY_API_KEY", keep: tuple[str, ...] = KEY) -> DataFrame:
    """A row for each call: (…, language, provider, line, column, action, edits array<struct<start, end, replacement>>).

    action: rewrite, configured, manual (arguments that are not written out), detect_only (kits without such a
    parameter), not_sdk_module (a class of that name in another module). Edits of a file never overlap: those of a call inside another call's
    arguments lie between the other's.
    """
    found = detect.with_provider_info(detect.calls(files, keep))
    python = F.col("language") == "python"
    bare = F.regexp_extract("head", r"([A-Za-z0-9_]+)$", 1)
    module = F.regexp_extract("head", r"^(.*)\.[A-Za-z0-9_]+$", 1)
    own_module = (F.col("provider") == "cohere") | (module == F.col("py_module")) | (bare == F.col("head"))
    object_text = _cut(F.col("args"), F.col("args_start"), F.col("object"), F.col("object_end"))
    py_action = (
        F.when(F.col("provider").isin("gemini", "bedrock"), "detect_only")
        .when(~own_module, "not_sdk_module")
        .when(detect.py_has_base_url("args"), "configured")
        .when(F.exists("arguments", lambda a: a["kind"] == "splat"), "manual")
        .otherwise("rewrite")
    )
    ts_action = (
        F.when(F.col("ts_base_url_param").isNull(), "detect_only")
        .when(F.col("object").isNotNull(), F.when(detect.ts_has_base_url(object_text, "ts_base_url_param"), "configured").otherwise("rewrite"))
        .when(F.size("arguments") == 0, "rewrite")
        .otherwise("manual")
    )
    found = found.withColumn("action", F.when(python, py_action).otherwise(ts_action))
    edits = F.when(F.col("action") == "rewrite", F.when(python, python_edits(proxy_url, env_var)).otherwise(script_edits(proxy_url, env_var)))
    return found.select(*keep, "language", "provider", "line", "column", "action", edits.alias("edits"))


def has_os_import(content: Column) -> Column:
    r"""Whether a line binds the name os: ``import os``, ``import os.path`` and lists of these, not under another name."""
    return content.rlike(r"(?m)^[ \t]*import [ \t]*(?:[^#\n,]*,)*[ \t]*os(?:\.[\w.]*)?[ \t\r]*(?:,|#|$)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def insertion_line(all_lines: Column) -> Column:
    """Before which line (from 0) an import may stand: after shebang, encoding, docstring and future imports."""
    get = lambda i: F.coalesce(F.get(all_lines, i), F.lit(""))
    coding = lambda i: F.ltrim(get(F.lit(i))).rlike("^#.*coding")
    shebang = F.startswith(get(F.lit(0)), F.lit("#!"))
    first = F.when(shebang, F.when(coding(1), 2).otherwise(1)).when(coding(0), F.when(coding(1), 2).otherwise(1)).otherwise(0)

    def docstring(i):
        def closed(line):
            def after(q):
                rest = F.slice(all_lines, i + 2, F.greatest(F.size(all_lines) - i - 1, F.lit(0)))
                closing = F.array_position(F.transform(rest, lambda x: F.contains(x, F.lit(q))), True).cast("int")
                return _let(closing, lambda c: F.when(F.contains(F.substring(line, F.lit(4), F.length(line)), F.lit(q)), i + 1).when(c > 0, i + 1 + c).otherwise(i))

            return F.when(F.startswith(line, F.lit('"""')), after('"""')).when(F.startswith(line, F.lit("'''")), after("'''")).otherwise(i)

        return _let(F.ltrim(get(i)), closed)

    def futures(start):
        state = F.struct(start.alias("at"), F.lit(0).alias("i"), F.lit(False).alias("over"))

        def step(s, x):
            skip = (s["i"] < start) | s["over"]
            future = F.startswith(F.ltrim(x), F.lit("from __future__ import"))
            return F.struct(F.when(~skip & future, s["i"] + 1).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"), (s["over"] | (~skip & ~future & (trim(x) != ""))).alias("over"))

        return F.aggregate(all_lines, state, step, lambda s: s["at"])

    return _let(first, lambda i: _let(docstring(i), futures))


def ensure_os_import(content: Column) -> Column:
    def put(own):
        def at(i):
            return F.concat(F.slice(own, F.lit(1), i), F.array(F.lit("import os")), F.slice(own, i + 1, F.greatest(F.size(own) - i, F.lit(0))))

        return _let(insertion_line(own), at)

    return _let(content, lambda c: F.when(has_os_import(c), c).otherwise(_let(_let(lines(c), put), lambda x: join_lines(x, c))))


def apply_rewrites(files: DataFrame, plan: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """Files with new_content, modified and needs_manual. A file's edits meet in one row; its content joins them once."""
    counted = F.count_if(F.col("action") == "manual").cast("int").alias("needs_manual")
    edits = plan.groupBy(*keep).agg(F.sort_array(F.flatten(F.collect_list("edits"))).alias("edits"), counted)
    reached = lambda i: F.when(i > 0, F.get("edits", i - 1)["end"]).otherwise(0)
    pieces = F.transform("edits", lambda e, i: F.concat(F.substring("content", reached(i) + 1, e["start"] - reached(i)), e["replacement"]))
    spliced = F.concat(F.array_join(pieces, ""), F.substring("content", F.element_at("edits", -1)["end"] + 1, F.length("content")))
    styled = reencode_eol(spliced, dominant_eol("content"))
    out = files.join(edits, list(keep), "left")
    modified = F.coalesce(F.size("edits") > 0, F.lit(False))
    python = F.col("ext") == "py"
    new = F.when(modified, F.when(python, ensure_os_import(styled)).otherwise(styled)).otherwise(F.col("content"))
    return out.withColumns({"new_content": new, "modified": modified, "needs_manual": F.coalesce("needs_manual", F.lit(0))}).drop("edits")


def rewrite_summary(plan: DataFrame, keep: tuple[str, ...] = KEY) -> DataFrame:
    """One row for each provider: files modified, left as they are, and calls to route by hand; each file counts once a provider."""
    each = plan.groupBy("provider", *keep).agg(F.bool_or(F.col("action") == "rewrite").alias("modified"), F.count_if(F.col("action") == "manual").alias("manual"))
    return each.groupBy("provider").agg(F.count_if("modified").alias("files_modified"), F.count_if(~F.col("modified")).alias("files_unchanged"), F.sum("manual").alias("calls_manual"))
