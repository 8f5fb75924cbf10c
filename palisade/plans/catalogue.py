"""The registered queries of the library and their SQL counterparts (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import predicates, registry, text
from ..operators import audit, detect, entry, envvars, errors, paths, policy, redteam, rewrite, security
from . import snippets as s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text security

def _redacted_sql(column: str, upto: int | None = None) -> str:
    out = column
    for k, p in registry.PII_RULES[:upto]:
        out = f"regexp_replace({out}, {s.quoted(p)}, '[{k.upper()}_REDACTED]', 'g')"
    return out


def _found_sql(column: str) -> str:
    each = [f"CASE WHEN regexp_matches({_redacted_sql(column, i)}, {s.quoted(p)}) THEN '{k}' END" for i, (k, p) in enumerate(registry.PII_RULES)]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


def _scan_sql(column: str) -> dict[str, str]:
    """Columns of the rule of most weight that fits, the first of equals."""
    order = sorted(enumerate(registry.RULES), key=lambda r: (-r[1][2], r[0]))
    case = lambda what, other: "CASE " + " ".join(f"WHEN regexp_matches({column}, {s.quoted(p)}) THEN {what(t, w)}" for _, (t, p, w) in order) + f" ELSE {other} END"
    return {"threat_type": case(lambda t, w: f"'{t}'", "NULL"), "confidence": f"CAST({case(lambda t, w: str(w), '0.0')} AS DOUBLE)"}


_T = _scan_sql("text")


@query(f"SELECT doc_id, {_redacted_sql('text')} AS redacted, array_to_string({_found_sql('text')}, ',') AS found FROM documents")
def redact_documents(spark, sf_dir):
    out = security.redact(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "redacted", F.array_join("pii_found", ",").alias("found"))


@query(f"SELECT lang, pii_type, count(*) AS texts FROM (SELECT lang, unnest({_found_sql('text')}) AS pii_type FROM documents) GROUP BY lang, pii_type")
def pii_types_by_lang(spark, sf_dir):
    return security.pii_summary(security.redact(table(spark, sf_dir, "documents")), "lang")


@query(f"SELECT page_id, {_redacted_sql('html')} AS redacted FROM pages")
def redact_pages(spark, sf_dir):
    return security.redact(table(spark, sf_dir, "pages"), "html").select("page_id", "redacted")


_KEY = s.quoted(dict(registry.PII_RULES)["api_key"])


@query(f"""SELECT doc_id, CAST(place - 1 AS INTEGER) AS place,
    CASE WHEN length(x) <= CASE WHEN starts_with(x, 'pg_live_') THEN 8 WHEN starts_with(x, 'pg_') THEN 3 ELSE 0 END + 4 THEN repeat('*', length(x))
      ELSE CASE WHEN starts_with(x, 'pg_live_') THEN 'pg_live_' WHEN starts_with(x, 'pg_') THEN 'pg_' ELSE '' END || '…' || right(x, 4) END AS masked
  FROM (SELECT doc_id, unnest(m) AS x, generate_subscripts(m, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, {_KEY}) AS m FROM documents))""")
def secrets_masked(spark, sf_dir):
    return security.find_secrets(table(spark, sf_dir, "documents"))


def _unknown_secrets_sql() -> str:
    """The runs' judgement in plain SQL: one row a run, its signs counted by a join of their own."""
    fits = " ".join(f"WHEN regexp_matches(run, '{p}') THEN '{k}'" for k, p, *_ in registry.KEY_ALPHABETS)
    good = " ".join(f"WHEN alphabet = '{k}' THEN n >= {least} AND bits >= {share} * log2(least(n, {size}))" for k, _, size, least, share in registry.KEY_ALPHABETS)
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{registry.KEY_RUN}') AS l FROM documents),
  r AS (SELECT doc_id, i, l[i] AS run, length(l[i]) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
  c AS (SELECT doc_id, i, run, n, sign, count(*) / n AS share FROM (SELECT *, unnest(string_split(run, '')) AS sign FROM r) GROUP BY doc_id, i, run, n, sign),
  e AS (SELECT doc_id, i, run, n, -sum(share * log2(share)) AS bits, CASE {fits} END AS alphabet FROM c GROUP BY doc_id, i, run, n),
  f AS (SELECT *, CASE {good} END AS good FROM e WHERE regexp_matches(run, '[0-9][^0-9]+[0-9]') AND regexp_matches(run, '[A-Za-z]')
    AND (NOT regexp_matches(run, '[+/_=-]') OR len(list_filter(regexp_split_to_array(run, '[+/_=-]'), lambda p: length(p) >= 12 AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]'))) > 0))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, alphabet, round(bits, 4) AS bits,
  CASE WHEN starts_with(run, 'pg_live_') THEN 'pg_live_' WHEN starts_with(run, 'pg_') THEN 'pg_' ELSE '' END || '…' || right(run, 4) AS masked FROM f WHERE good"""


@query(_unknown_secrets_sql())
def secrets_unknown(spark, sf_dir):
    return security.find_unknown_secrets(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, count(*) AS cards, CAST(sum(CASE WHEN total % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM (
    SELECT doc_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * CAST(c[i] AS INTEGER) > 9 THEN 2 * CAST(c[i] AS INTEGER) - 9 ELSE 2 * CAST(c[i] AS INTEGER) END) ELSE CAST(c[i] AS INTEGER) END)) AS total
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS c FROM documents)) GROUP BY doc_id""")
def card_luhn(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("c"))
    return each.groupBy("doc_id").agg(F.count("*").alias("cards"), F.count_if(F.call_function("luhn_check", "c")).alias("valid"))


_CARDS = "list_distinct(list_filter(regexp_extract_all(text, '[0-9]{16}'), lambda c: list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[i] AS INTEGER) WHEN CAST(c[i] AS INTEGER) > 4 THEN 2 * CAST(c[i] AS INTEGER) - 9 ELSE 2 * CAST(c[i] AS INTEGER) END)) % 10 = 0))"


@query(f"SELECT doc_id, list_reduce(list_prepend(text, c), lambda a, x: replace(a, x, '[CREDIT_CARD_REDACTED]')) AS redacted, CASE WHEN len(c) > 0 THEN 'credit_card' ELSE '' END AS found FROM (SELECT doc_id, text, {_CARDS} AS c FROM documents)")
def redact_cards_luhn(spark, sf_dir):
    out = security.redact(table(spark, sf_dir, "documents"), types=["credit_card"], luhn=True)
    return out.select("doc_id", "redacted", F.array_join("pii_found", ",").alias("found"))


@query(f"SELECT doc_id, threat_type, confidence, threat_type IS NOT NULL AS blocked, CASE WHEN threat_type IS NULL THEN 'allow' ELSE 'block' END AS decision, CASE WHEN threat_type IS NULL THEN 'no rule matched' ELSE 'matched ' || threat_type END AS reason FROM (SELECT doc_id, {_T['threat_type']} AS threat_type, {_T['confidence']} AS confidence FROM documents)")
def scan_documents(spark, sf_dir):
    return security.scan_text(table(spark, sf_dir, "documents")).select("doc_id", "threat_type", "confidence", "blocked", "decision", "reason")


@query(f"SELECT source, count(*) AS total, count(t) AS blocked, round(count(t) / count(*), 6) AS block_rate FROM (SELECT source, {_T['threat_type']} AS t FROM documents) GROUP BY source")
def threats_by_source(spark, sf_dir):
    return security.threat_summary(security.scan_text(table(spark, sf_dir, "documents")), "source")


@query(f"SELECT role, count(*) AS total, count(t) AS blocked, round(count(t) / count(*), 6) AS block_rate FROM (SELECT role, {_T['threat_type']} AS t FROM conversations) GROUP BY role")
def threats_by_role(spark, sf_dir):
    return security.threat_summary(security.scan_text(table(spark, sf_dir, "conversations")), "role")


@query(f"SELECT toxic, coalesce(t, '') AS threat_type, count(*) AS n FROM (SELECT doc_id, {_T['threat_type']} AS t FROM documents) JOIN labels USING (doc_id) GROUP BY ALL")
def threat_vs_label(spark, sf_dir):
    """How the word rules fare against the labels; the toxicity words were chosen with labels of this kind in sight."""
    judged = security.scan_text(table(spark, sf_dir, "documents")).select("doc_id", "threat_type").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return judged.groupBy("toxic", F.coalesce("threat_type", F.lit("")).alias("threat_type")).agg(F.count("*").alias("n"))


@query(f"""SELECT conv_id, CASE WHEN count(t) > 0 THEN 'block' ELSE 'allow' END AS decision, max(c) AS confidence,
    coalesce(array_to_string(list_sort(list_distinct(list(t) FILTER (WHERE t IS NOT NULL))), ','), '') AS threats, string_agg(r, chr(10) ORDER BY turn, role, r) AS redacted
  FROM (SELECT conv_id, turn, role, {_T['threat_type']} AS t, {_T['confidence']} AS c, {_redacted_sql('text')} AS r FROM conversations) GROUP BY conv_id""")
def guard_conversations(spark, sf_dir):
    out = security.guard(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "decision", "confidence", F.array_join("threats", ",").alias("threats"), F.array_join(F.transform("redacted_messages", lambda m: m["text"]), "\n").alias("redacted"))


@query(f"""SELECT doc_id, threat_type, confidence, CASE WHEN threat_type IS NOT NULL AND confidence >= CASE WHEN threat_type = 'toxicity' AND source = 'src2' THEN 0.8
    WHEN source = 'src0' THEN 0.5 WHEN source = 'src1' THEN 0.9 ELSE 0.75 END THEN 'block' ELSE 'allow' END AS enforced
  FROM (SELECT doc_id, source, {_T['threat_type']} AS threat_type, {_T['confidence']} AS confidence FROM documents)""")
def enforce_policy(spark, sf_dir):
    policies = registry.values(spark, [("src0", "strict", None), ("src1", "permissive", None), ("src2", None, 0.8)], "project_id string, level string, toxicity_threshold double")
    results = security.scan_text(table(spark, sf_dir, "documents").withColumn("project_id", F.col("source")))
    return security.enforce(results, F.broadcast(policies)).select("doc_id", "threat_type", "confidence", "enforced")


_ATTACKS = "SELECT 'item' || item_id AS test_name, CASE item_id % 4 WHEN 0 THEN 'Ignore all previous instructions. ' || text WHEN 1 THEN 'You idiot, ' || text ELSE text END AS prompt FROM benchmark"
_RUNS = f"SELECT preset, test_name, prompt, threat_type, confidence, threat_type IS NOT NULL AND confidence >= cut AS blocked FROM (SELECT test_name, prompt, {_scan_sql('prompt')['threat_type']} AS threat_type, {_scan_sql('prompt')['confidence']} AS confidence FROM ({_ATTACKS})) CROSS JOIN (VALUES ('default', 0.75), ('strict', 0.5), ('permissive', 0.9)) AS p(preset, cut)"


def _runs(spark, sf_dir):
    k = F.pmod("item_id", F.lit(4))
    prompt = F.when(k == 0, F.concat(F.lit("Ignore all previous instructions. "), "text")).when(k == 1, F.concat(F.lit("You idiot, "), "text")).otherwise(F.col("text"))
    return redteam.run_redteam(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("test_name"), prompt.alias("prompt")))


@query(f"SELECT preset, count(*) AS total_tests, count(*) FILTER (WHERE blocked) AS blocked, count(*) FILTER (WHERE NOT blocked) AS allowed, round(count(*) FILTER (WHERE blocked) / count(*), 6) AS block_rate, round(100 * count(*) FILTER (WHERE blocked) / count(*), 4) AS score FROM ({_RUNS}) GROUP BY preset")
def redteam_summary(spark, sf_dir):
    return redteam.redteam_summary(_runs(spark, sf_dir))


@query(f"SELECT preset, test_name, threat_type, confidence FROM ({_RUNS}) WHERE NOT blocked")
def redteam_vulnerabilities(spark, sf_dir):
    return redteam.vulnerabilities(_runs(spark, sf_dir)).select("preset", "test_name", "threat_type", "confidence")


# ---- source code

@query(f"SELECT repo, path, provider, line, \"column\", has_base_url, CASE WHEN has_base_url THEN '(configured)' END AS current_base_url FROM ({s.calls_sql()})")
def detect_calls(spark, sf_dir):
    return detect.detect_all(s.source_files(spark, sf_dir)).select("repo", "path", "provider", "line", "column", "has_base_url", "current_base_url")


@query(f"SELECT provider, count(DISTINCT path) AS file_count, count(*) AS instance_count FROM ({s.calls_sql()}) GROUP BY provider")
def provider_summary(spark, sf_dir):
    return detect.provider_summary(detect.detect_all(s.source_files(spark, sf_dir)))


@query(f"SELECT provider, repo, count(DISTINCT path) AS file_count, count(*) AS instance_count, string_agg(DISTINCT path, ',' ORDER BY path) AS files, string_agg(path || ':' || line, ',' ORDER BY path, line, \"column\") AS instances FROM ({s.calls_sql()}) GROUP BY provider, repo")
def provider_report(spark, sf_dir):
    out = detect.provider_report(detect.detect_all(s.source_files(spark, sf_dir)))
    places = F.transform("instances", lambda i: F.concat_ws(":", i["path"], i["line"]))
    return out.select("provider", "repo", "file_count", "instance_count", F.array_join("files", ",").alias("files"), F.array_join(places, ",").alias("instances"))


@query(f"SELECT (SELECT count(*) FROM documents WHERE doc_id % {len(s.CASES)} <> 15) AS files_scanned, count(DISTINCT path) AS files_with_sdks, count(*) AS total_instances, count(DISTINCT provider) AS providers_found FROM ({s.calls_sql()})")
def scan_totals(spark, sf_dir):
    files = paths.filter_ext(s.source_files(spark, sf_dir))
    return detect.scan_totals(files, detect.detect_all(files))


@query(f"SELECT provider, path, rank FROM (SELECT provider, path, CAST(row_number() OVER (PARTITION BY provider ORDER BY path) AS INTEGER) AS rank FROM (SELECT DISTINCT provider, path FROM ({s.calls_sql()}))) WHERE rank <= 10")
def top_files(spark, sf_dir):
    return paths.top_files(detect.detect_all(s.source_files(spark, sf_dir)))


@query(f"SELECT provider, path, line, rank, greatest(n - 3, 0) AS more FROM (SELECT provider, path, line, CAST(row_number() OVER (PARTITION BY provider, path ORDER BY line, \"column\") AS INTEGER) AS rank, count(*) OVER (PARTITION BY provider, path) AS n FROM ({s.calls_sql()})) WHERE rank <= 3")
def top_instances(spark, sf_dir):
    return paths.top_instances(detect.detect_all(s.source_files(spark, sf_dir)), 3).select("provider", "path", "line", "rank", "more")


@query(f"SELECT path, line, provider, coverage FROM ({s.calls_sql()})")
def coverage(spark, sf_dir):
    return detect.coverage(detect.detect_all(s.source_files(spark, sf_dir))).select("path", "line", "provider", "coverage")


@query(f"SELECT repo, provider, count(*) AS n FROM ({s.calls_sql()}) WHERE NOT has_base_url GROUP BY repo, provider")
def unprotected(spark, sf_dir):
    return detect.unprotected(detect.detect_all(s.source_files(spark, sf_dir))).groupBy("repo", "provider").agg(F.count("*").alias("n"))


@query(f"SELECT path, provider, line, \"column\", action FROM ({s.calls_sql()})")
def rewrite_plan(spark, sf_dir):
    return rewrite.plan_rewrites(s.source_files(spark, sf_dir), s.PROXY).select("path", "provider", "line", "column", "action")


@query(f"SELECT provider, count(*) FILTER (WHERE m) AS files_modified, count(*) FILTER (WHERE NOT m) AS files_unchanged, CAST(sum(h) AS BIGINT) AS calls_manual FROM (SELECT provider, repo, path, bool_or(action = 'rewrite') AS m, count(*) FILTER (WHERE action = 'manual') AS h FROM ({s.calls_sql()}) GROUP BY ALL) GROUP BY provider")
def rewrite_summary(spark, sf_dir):
    return rewrite.rewrite_summary(rewrite.plan_rewrites(s.source_files(spark, sf_dir), s.PROXY))


# The import goes before a text's comment lines.
_TEXTS = s.values_sql([(k, c[0], *(("import os\n", s.REWRITTEN[c[0]].removeprefix("import os\n")) if s.REWRITTEN.get(c[0], "").startswith("import os\n") else ("", s.REWRITTEN.get(c[0], c[1]))), c[0] in s.REWRITTEN, sum(x[5] == "manual" for x in c[2])) for k, c in enumerate(s.CASES)], "k, file_name, imported, rest, modified, needs_manual")


@query(f"SELECT {s.PATH_SQL} AS path, imported || {s.SAID_SQL} || rest AS new_content, modified, needs_manual FROM documents JOIN {_TEXTS} ON doc_id % {len(s.CASES)} = k")
def rewritten_text(spark, sf_dir):
    files = s.source_files(spark, sf_dir)
    out = rewrite.apply_rewrites(files, rewrite.plan_rewrites(files, s.PROXY))
    return out.select("path", "new_content", "modified", "needs_manual")


_NAMES = s.values_sql([(k, c[0]) for k, c in enumerate(s.CASES)], "k, file_name")
_FILES = f"SELECT doc_id, {s.REPO_SQL} AS repo, {s.PATH_SQL} AS path, file_name FROM documents JOIN {_NAMES} ON doc_id % {len(s.CASES)} = k"


@query(f"SELECT repo, path FROM ({_FILES}) WHERE file_name IN ('app.py', 'guard.py')")
def entry_points(spark, sf_dir):
    files = s.source_files(spark, sf_dir)
    return entry.python_entry_points(files).unionByName(entry.ts_entry_points(files)).distinct()


@query(f"SELECT repo, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM (SELECT repo, CASE WHEN file_name LIKE '%.py' THEN 'python' WHEN file_name LIKE '%.md' THEN NULL ELSE 'typescript' END AS language FROM ({_FILES})) WHERE language IS NOT NULL GROUP BY repo")
def languages(spark, sf_dir):
    return entry.repo_languages(s.source_files(spark, sf_dir)).select("repo", F.array_join("languages", ",").alias("languages"))


_MANIFESTS = [("package.json", '{"dependencies": {"express": "1"}}'), ("requirements.txt", "Flask\nDjango==4\n"), ("next.config.mjs", ""), ("pyproject.toml", 'x = "fastapi"'), ("package.json", "not json"), ("package.json", '{"devDependencies": {"next": "1"}}')]


@query("""SELECT repo, CASE min(place) WHEN 0 THEN 'nextjs' WHEN 1 THEN 'nextjs' WHEN 2 THEN 'express' WHEN 3 THEN 'django' WHEN 4 THEN 'fastapi' END AS framework
  FROM (SELECT 'r' || (doc_id % 97) AS repo, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 4 WHEN 5 THEN 1 END AS place FROM documents) WHERE place IS NOT NULL GROUP BY repo""")
def framework(spark, sf_dir):
    known = registry.values(spark, [(i, *m) for i, m in enumerate(_MANIFESTS)], "k int, file_name string, content string")
    files = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(6)).cast("int").alias("k"), F.concat(F.lit("r"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("repo")).join(F.broadcast(known), "k")
    return entry.detect_framework(files.withColumns({"path": F.col("file_name"), "depth": F.lit(1)}))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'pkg/' || (doc_id % 5) WHEN doc_id % 7 = 1 THEN 'pkg' END AS root FROM documents")
def repo_root(spark, sf_dir):
    k, five = F.pmod("doc_id", F.lit(7)), F.pmod("doc_id", F.lit(5)).cast("string")
    path = F.when(k == 0, F.concat(F.lit("pkg/"), five, F.lit("/src/"), F.col("doc_id").cast("string"))).when(k == 1, F.concat(F.lit("pkg/lib/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("other/"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.lit("m").alias("repo"), path.alias("path"))
    roots = docs.select(F.lit("m").alias("repo"), F.concat(F.lit("pkg/"), five).alias("root")).distinct().unionByName(registry.values(spark, [("m", "pkg")], "repo string, root string"))
    return paths.assign_repo_root(files, roots).select("doc_id", "root")


@query(f"""SELECT repo, path FROM ({_FILES}) WHERE NOT CASE doc_id % 4 WHEN 0 THEN file_name LIKE '%.tsx' OR file_name LIKE '%.md'
  WHEN 1 THEN regexp_matches(path, '^src/d./') OR file_name LIKE 'many.%' OR regexp_matches(file_name, '^[^a-m].*[.]ts$') ELSE false END""")
def excludes_by_repo(spark, sf_dir):
    files = s.source_files(spark, sf_dir)
    number = F.substring("repo", 5, 9).cast("int")
    lists = F.when(number % 4 == 0, F.array(*[F.lit(g) for g in paths.with_user_excludes(["*.tsx", "**/README.*"])])).when(number % 4 == 1, F.array(*[F.lit(g) for g in ("src/d?/*", "**/many.*", "[!a-m]*.ts")])).when(number % 4 == 2, F.array().cast("array<string>"))
    return paths.exclude_by_repo(files, files.select("repo").distinct().withColumn("exclude_patterns", lists)).select("repo", "path")


@query("SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) WHERE NOT regexp_matches(path, '(^|/)node_modules/|[.]pdf$|(^|/)a')")
def exclude_globs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return paths.exclude_globs(pages.withColumn("file_name", text.file_name("path")), ["**/node_modules/**", "*.pdf", "**/a*"]).select("page_id", "path")


@query(f"SELECT path FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'node_modules/x' WHEN 1 THEN 'src/build.py' WHEN 2 THEN 'a/.venv/b/c.py' ELSE 'src/' || doc_id || '.py' END AS path FROM documents) WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE '%/.venv/%'")
def skip_dirs(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(4))
    path = F.when(k == 0, "node_modules/x").when(k == 1, "src/build.py").when(k == 2, "a/.venv/b/c.py").otherwise(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")))
    return paths.prune_skip_dirs(table(spark, sf_dir, "documents").select(path.alias("path")))


@query(f"SELECT path, doc_id % 1000 * 60 AS changed FROM ({_FILES})")
def newest_first(spark, sf_dir):
    """All files in order, by a sort over ranges; the comparison with SQL sorts anew, a test holds the order."""
    return paths.newest_first(s.source_files(spark, sf_dir)).select("path", F.unix_timestamp("mtime").alias("changed"))


# ---- environment variables

@query(s.env_sql(2))
def env_defs(spark, sf_dir):
    files = s.env_files(spark, sf_dir)
    return envvars.parse_env(files.filter(F.col("file_name").isin(paths.ENV_FILES)))


@query(f"SELECT * FROM ({s.env_sql(3)}) WHERE language = 'python'")
def env_uses_py(spark, sf_dir):
    return envvars.python_env_uses(s.env_files(spark, sf_dir).filter("ext = 'py'")).drop("context")


@query(f"SELECT * FROM ({s.env_sql(3)}) WHERE language = 'typescript'")
def env_uses_ts(spark, sf_dir):
    return envvars.ts_env_uses(s.env_files(spark, sf_dir).filter("ext = 'ts'")).drop("context")


def _uses(spark, sf_dir):
    files = s.env_files(spark, sf_dir)
    return envvars.python_env_uses(files.filter("ext = 'py'")).unionByName(envvars.ts_env_uses(files.filter("ext = 'ts'")))


@query(f"""SELECT name, CAST(sum(d) AS BIGINT) AS n_defs, CAST(sum(u) AS BIGINT) AS n_uses, CASE WHEN sum(d) > 0 AND sum(u) > 0 THEN 'both' WHEN sum(d) > 0 THEN 'defined_only' ELSE 'used_only' END AS state
  FROM (SELECT name, 1 AS d, 0 AS u FROM ({s.env_sql(2)}) UNION ALL SELECT name, 0, 1 FROM ({s.env_sql(3)})) GROUP BY name""")
def env_inventory(spark, sf_dir):
    return envvars.env_inventory(env_defs(spark, sf_dir), _uses(spark, sf_dir))


@query(f"SELECT name, 'Defined in ' || path || ':' || line AS place FROM ({s.env_sql(2)}) WHERE name IN ('API_KEY', 'URL') UNION ALL SELECT name, 'Used in ' || path || ':' || line FROM ({s.env_sql(3)})")
def env_report(spark, sf_dir):
    return envvars.env_report(env_defs(spark, sf_dir), _uses(spark, sf_dir))


@query(f"SELECT path, line, name FROM ({s.env_sql(2)}) WHERE name IN ('API_KEY', 'URL')")
def api_related_vars(spark, sf_dir):
    return envvars.api_related(env_defs(spark, sf_dir)).select("path", "line", "name")


# ---- policies

_POLICIES = ['{"toxicity": {"threshold": 0.5}, "pii_detection": {"level": "strict", "mode": "mask"}}', '{"toxicity": {"threshold": 1.5}, "pii_detection": {"level": "none", "mode": "hide"}, "x": 1}', '{"prompt_injection": {"level": "strict"}, "a": null}', '{"prompt_injection": "off", "toxicity": {"threshold": "high"}}']
_BAD = ["guardrails.pii_detection.level: must be one of strict, moderate, permissive", "guardrails.pii_detection.mode: must be one of redact, mask, block", "guardrails.toxicity.threshold: must be 0.0-1.0"]
# What differs from each policy to the next: field, old and new text.
_DIFFS = [
    (0, "toxicity.threshold", "0.5", "1.5"), (0, "pii_detection.level", '"strict"', '"none"'), (0, "pii_detection.mode", '"mask"', '"hide"'), (0, "x", "(none)", "1"),
    (1, "toxicity", '{"threshold":1.5}', "(none)"), (1, "pii_detection", '{"level":"none","mode":"hide"}', "(none)"), (1, "x", "1", "(none)"), (1, "prompt_injection", "(none)", '{"level":"strict"}'), (1, "a", "(none)", "null"),
    (2, "prompt_injection", '{"level":"strict"}', '"off"'), (2, "a", "null", "(none)"), (2, "toxicity", "(none)", '{"threshold":"high"}'),
    (3, "prompt_injection", '"off"', "(none)"), (3, "toxicity.threshold", '"high"', "0.5"), (3, "pii_detection", "(none)", '{"level":"strict","mode":"mask"}'),
]


def _policies(spark, sf_dir, shift: int = 0):
    known = registry.values(spark, [(i, p) for i, p in enumerate(_POLICIES)], "k int, said string")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("project_id"), F.pmod(F.col("doc_id") + shift, F.lit(4)).cast("int").alias("k"))
    return own.join(F.broadcast(known), "k").select("project_id", F.parse_json("said").alias("guardrails"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS project_id, CASE WHEN doc_id % 4 = 1 THEN {s.quoted('; '.join(_BAD))} ELSE '' END AS errors FROM documents")
def policy_validate(spark, sf_dir):
    return policy.validate_policies(_policies(spark, sf_dir)).select("project_id", F.array_join("errors", "; ").alias("errors"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS project_id, field, old, new FROM documents JOIN {s.values_sql(_DIFFS, 'k, field, old, new')} ON doc_id % 4 = k")
def policy_diff(spark, sf_dir):
    return policy.diff_policies(_policies(spark, sf_dir), _policies(spark, sf_dir, 1))


@query("SELECT CAST(doc_id AS VARCHAR) AS project_id, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 END AS threshold FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id + 1) % 4 ELSE doc_id % 4 END AS k FROM documents)")
def policy_apply(spark, sf_dir):
    """Each project has a wanted policy: a new one for even ids, its own for the others."""
    even = F.pmod(F.col("project_id").cast("bigint"), F.lit(2)) == 0
    new, old = _policies(spark, sf_dir, 1), _policies(spark, sf_dir)
    desired = new.withColumnRenamed("guardrails", "new").join(old, "project_id").select("project_id", F.when(even, F.col("new")).otherwise(F.col("guardrails")).alias("guardrails"))
    return policy.apply_policies(old, desired).select("project_id", F.try_variant_get("guardrails", "$.toxicity.threshold", "double").alias("threshold"))


# ---- audits

_CONFIGS = [
    '{"version": "1.0", "api_key": "pg_live_0123456789", "proxy_url": "https://api.example.com/v1", "providers": ["openai"], "metadata": {"cli_version": "1.2.0", "backups": ["a.py.bak"]}}',
    '{"version": "2.0", "api_key": "sk_short", "proxy_url": "http://evil.example.net", "providers": [], "env_file": "../.env", "env_var_name": "lower", "backup_extension": "bak", "enabled": false, "metadata": {"cli_version": "v1.10.0"}}',
    "not json",
]


def _audited(spark, sf_dir):
    """A repository for each document: settings, an ignore file and an env file by its id."""
    k = F.pmod("doc_id", F.lit(4))
    content = lambda *c: F.element_at(F.array(*[F.lit(x) for x in c]), (k + 1).cast("int"))
    made = F.array(
        F.struct(F.lit(audit.CONFIG_FILE).alias("path"), content(*_CONFIGS, None).alias("content")),
        F.struct(F.lit(".gitignore").alias("path"), content(f"/{audit.CONFIG_FILE}\n.env\n", " .env \n", "", None).alias("content")),
        F.struct(F.lit(".env").alias("path"), content(f"export {audit.KEY_NAME}=1\n", f"{audit.KEY_NAME}=\n", "X=1\n", None).alias("content")),
        F.struct(F.lit("a.py").alias("path"), F.lit("").alias("content")),
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("repo"), F.explode(made).alias("f")).select("repo", "f.*").filter("content is not null")
    return rows.withColumns({"file_name": F.col("path"), "depth": F.lit(1)})




@query("SELECT CAST(doc_id AS VARCHAR) AS repo, CASE doc_id % 4 WHEN 0 THEN 'healthy' WHEN 3 THEN 'warning' ELSE 'error' END AS health, CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS errors, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS warnings FROM documents")
def hygiene(spark, sf_dir):
    return audit.repo_health(audit.hygiene_checks(_audited(spark, sf_dir))).select("repo", "health", "errors", "warnings")


@query("SELECT CAST(doc_id AS VARCHAR) AS repo, CASE doc_id % 4 WHEN 0 THEN '' ELSE 'version,env_file,proxy_url,env_var_name,backup_extension,api_key' END AS errors FROM documents WHERE doc_id % 4 < 2")
def config_validate(spark, sf_dir):
    return audit.validate_configs(audit.parse_configs(_audited(spark, sf_dir)).filter("valid")).select("repo", F.array_join("errors", ",").alias("errors"))


@query("SELECT CAST(doc_id AS VARCHAR) AS repo, 'http://evil.example.net' AS proxy_url FROM documents WHERE doc_id % 4 = 1")
def host_risk(spark, sf_dir):
    return audit.host_risk(audit.parse_configs(_audited(spark, sf_dir)).filter("valid")).select("repo", "proxy_url")


@query("SELECT CAST(doc_id AS VARCHAR) AS repo FROM documents WHERE doc_id % 4 = 0")
def outdated(spark, sf_dir):
    return audit.outdated(audit.parse_configs(_audited(spark, sf_dir)), "1.3.0").select("repo")


@query("SELECT CAST(doc_id AS VARCHAR) AS repo, CASE doc_id % 4 WHEN 0 THEN 'active' ELSE 'disabled' END AS status, 'proxy' AS mode, CASE doc_id % 4 WHEN 0 THEN 'pg_live_…6789' ELSE '…hort' END AS api_key, CASE doc_id % 4 WHEN 0 THEN 1 ELSE 0 END AS n_providers, 0 AS n_managed, CASE doc_id % 4 WHEN 0 THEN 1 ELSE 0 END AS n_backups, doc_id % 4 = 0 AS enabled, CASE doc_id % 4 WHEN 0 THEN 'https://api.example.com/v1' ELSE 'http://evil.example.net' END AS proxy_url, CASE doc_id % 4 WHEN 0 THEN '.env' ELSE '../.env' END AS env_file, CASE doc_id % 4 WHEN 0 THEN 'openai' ELSE '' END AS providers, '' AS managed_files, CASE doc_id % 4 WHEN 0 THEN 'a.py.bak' ELSE '' END AS backups, CASE doc_id % 4 WHEN 0 THEN '1.2.0' ELSE 'v1.10.0' END AS cli_version FROM documents WHERE doc_id % 4 < 2")
def repo_status(spark, sf_dir):
    out = audit.repo_status(audit.parse_configs(_audited(spark, sf_dir)).filter("valid"))
    lists = [F.array_join(c, ",").alias(c) for c in ("providers", "managed_files", "backups")]
    return out.select("repo", "status", "mode", "api_key", "n_providers", "n_managed", "n_backups", "enabled", "proxy_url", "env_file", *lists, "cli_version")


@query(f"SELECT repo, entry FROM (SELECT CAST(doc_id AS VARCHAR) AS repo, unnest(CASE doc_id % 4 WHEN 0 THEN ['*.bak'] WHEN 1 THEN ['{audit.CONFIG_FILE}', '*.bak'] ELSE ['{audit.CONFIG_FILE}', '.env', '*.bak'] END) AS entry FROM documents)")
def missing_ignores(spark, sf_dir):
    return audit.missing_ignores(_audited(spark, sf_dir), [audit.CONFIG_FILE, ".env", "*.bak"])


@query("SELECT CAST(doc_id AS VARCHAR) AS repo, 'a.py.bak' AS path FROM documents WHERE doc_id % 4 = 0")
def missing_backups(spark, sf_dir):
    files = _audited(spark, sf_dir)
    return audit.missing_backups(audit.parse_configs(files), files)


# ---- failed calls

_CALLS = [
    ("GET", 401, None, '{"error": {"message": "m", "code": "missing_api_key"}}', "auth", False),
    ("POST", 429, None, '{"error": {"message": "m", "code": "monthly_quota_exceeded", "requests_used": 50, "requests_limit": 100}}', "quota_exceeded", False),
    ("POST", 429, None, "busy", "api", False),
    ("GET", 503, None, "", "api", True),
    ("POST", 503, None, "", "api", False),
    ("POST", None, "connect", None, "api", True),
    ("GET", None, "timeout", None, "api", True),
    ("GET", 422, None, '{"detail": []}', "api", False),
]


def _failed(spark, sf_dir):
    known = registry.values(spark, [(i, *c[:4]) for i, c in enumerate(_CALLS)], "k int, method string, status int, error_kind string, body string")
    return table(spark, sf_dir, "events").withColumn("k", F.pmod("event_id", F.lit(len(_CALLS))).cast("int")).join(F.broadcast(known), "k")


@query("SELECT CASE event_id % 8 WHEN 0 THEN 'auth' WHEN 1 THEN 'quota_exceeded' ELSE 'api' END AS error_class, CASE event_id % 8 WHEN 0 THEN 'missing_api_key' WHEN 1 THEN 'monthly_quota_exceeded' END AS code, count(*) AS n, CAST(max(CASE WHEN event_id % 8 = 1 THEN 0.5 END) AS DOUBLE) AS most_used FROM events GROUP BY ALL")
def error_classes(spark, sf_dir):
    return errors.api_error_summary(_failed(spark, sf_dir))


@query("SELECT event_id, event_id % 8 IN (3, 5, 6) AS retryable FROM events")
def retryable(spark, sf_dir):
    return _failed(spark, sf_dir).select("event_id", predicates.is_retryable("method", "status", "error_kind").alias("retryable"))


@query("SELECT count(*) FILTER (WHERE event_id % 3 <> 0) AS passed, count(*) FILTER (WHERE event_id % 3 = 0) AS failed, 'failed' AS status FROM events")
def verify_summary(spark, sf_dir):
    return errors.verify_summary(table(spark, sf_dir, "events").select(F.when(F.pmod("event_id", F.lit(3)) == 0, "error").otherwise("ok").alias("status")))


# ---- addresses, keys, versions

@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host,
    NOT regexp_matches(url, '[ "''`{}]') AND starts_with(url, 'https://') AS valid_proxy, false AS loopback, starts_with(url, 'https://') AND NOT regexp_matches(url, '[ ]') AND lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) = 'site1.example.com' AS allowed FROM pages""")
def url_predicates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.url_scheme("url").alias("scheme"),
        text.url_host("url").alias("host"),
        predicates.is_valid_proxy_url("url").alias("valid_proxy"),
        predicates.is_loopback("url").alias("loopback"),
        predicates.is_allowed_target("url", ["site1.example.com"]).alias("allowed"),
    )


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pg_live_…' || right('0000' || doc_id, 4) WHEN 1 THEN 'pg_…' || right('0000' || doc_id, 4)
    ELSE CASE WHEN length(CAST(doc_id AS VARCHAR)) <= 4 THEN repeat('*', length(CAST(doc_id AS VARCHAR))) ELSE '…' || right(CAST(doc_id AS VARCHAR), 4) END END AS masked FROM documents""")
def mask_keys(spark, sf_dir):
    k, d = F.pmod("doc_id", F.lit(3)), F.col("doc_id").cast("string")
    key = F.when(k == 0, F.concat(F.lit("pg_live_xxxx0000"), d)).when(k == 1, F.concat(F.lit("pg_yyyy0000"), d)).otherwise(d)
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_key(key).alias("masked"))


@query("""SELECT doc_id, CASE WHEN crlf > lf - crlf THEN 'crlf' ELSE 'lf' END AS eol, right(text, 1) = chr(10) AS trailing, CAST(lf + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS INTEGER) AS n_lines
  FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS lf, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 AS crlf FROM documents)""")
def eol_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(text.dominant_eol("text") == "\r\n", "crlf").otherwise("lf").alias("eol"), text.has_trailing_newline("text").alias("trailing"), F.size(text.lines("text")).alias("n_lines"))


@query("SELECT doc_id, doc_id % 7 > 2 OR (doc_id % 7 = 2 AND doc_id % 11 > 3) AS newer FROM documents")
def versions(spark, sf_dir):
    tag = F.concat(F.when(F.col("doc_id") % 2 == 0, "v").otherwise("cli-v"), (F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 11).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_newer(F.lit("2.3.0"), tag).alias("newer"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'huggingface' WHEN 1 THEN 'gemini' WHEN 2 THEN 'bedrock' WHEN 3 THEN 'openai' END AS provider, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS runtime FROM documents")
def provider_alias(spark, sf_dir):
    k = (F.col("doc_id") % 5).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in ("HF", "google", "AWS-Bedrock", "OpenAI", "other")]), k + 1)
    p = registry.parse_provider(name)
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("provider"), registry.has_runtime(p).alias("runtime"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
