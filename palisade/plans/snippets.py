"""Source files for the queries: each document stands for one file: its whole text as comment lines, then the case that its id picks.

What is expected of a case is written down beside it, by hand, for the SQL that the queries are held against; lines come after the text's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import values

PROXY = "https://proxy.example.com/v1"
REPOS = 40
# name, content, calls as (provider, line, column, configured, coverage, action)
CASES = [
    ("app.py", "from openai import OpenAI\nclient = OpenAI()\n", [("openai", 2, 10, False, "runtime", "rewrite")]),
    ("claude.py", "# Anthropic()\nclient = Anthropic(api_key=key)  # note\n", [("anthropic", 2, 10, False, "runtime", "rewrite")]),
    ("async.py", 'a = AsyncOpenAI()\nb = AsyncGroq(api_key="é")\nx = "é"; c = AsyncInferenceClient(token=k)\n', [("openai", 1, 5, False, "runtime", "rewrite"), ("groq", 2, 5, False, "detect_only", "rewrite"), ("huggingface", 3, 15, False, "runtime", "rewrite")]),
    ("mod.py", "import openai, cohere\nc = openai.AsyncOpenAI(api_key=key)\nd = mymod.OpenAI(k)\ne = cohere.ClientV2(k)\nf = Client(k)\n", [("openai", 2, 5, False, "runtime", "rewrite"), ("openai", 3, 5, False, "runtime", "not_sdk_module"), ("cohere", 4, 5, False, "runtime", "rewrite")]),
    ("gem.py", "x = genai.Client(k)\ny = google.genai.Client()\n", [("gemini", 1, 5, False, "detect_only", "detect_only"), ("gemini", 2, 5, False, "detect_only", "detect_only")]),
    ("aws.py", 'a = boto3.client("s3")\nb = boto3.client("bedrock-runtime", region_name="x")\nc = boto3.client(service_name="bedrock-runtime")\n', [("bedrock", 2, 5, False, "detect_only", "detect_only"), ("bedrock", 3, 5, False, "detect_only", "detect_only")]),
    ("set.py", 'c = OpenAI(api_key=k, base_url="https://x")\n', [("openai", 1, 5, True, "proxy", "configured")]),
    ("splat.py", "c = OpenAI(**cfg)\nd = Groq(**cfg, base_url=u)\ne = Anthropic(f(a, (b)), timeout=3)\n", [("openai", 1, 5, False, "runtime", "manual"), ("groq", 2, 5, True, "proxy", "configured"), ("anthropic", 3, 5, False, "runtime", "rewrite")]),
    ("a.ts", 'import OpenAI from "openai";\nconst c = new OpenAI();\n', [("openai", 2, 11, False, "detect_only", "rewrite")]),
    ("b.tsx", 'const c = new OpenAI({ apiKey: k, baseURL: "https://x" });\nexport const V = () => <div>hi</div>;\n', [("openai", 1, 11, True, "proxy", "configured")]),
    ("c.js", "// new OpenAI()\nconst a = new Anthropic(config);\nconst b = new HfInference({ accessToken: t });\n", [("anthropic", 2, 11, False, "detect_only", "manual"), ("huggingface", 3, 11, False, "detect_only", "rewrite")]),
    ("d.jsx", "const g = new GoogleGenAI({ apiKey: k });\nconst b = new BedrockRuntimeClient({});\nconst n = new openai.OpenAI();\n", [("gemini", 1, 11, False, "detect_only", "detect_only"), ("bedrock", 2, 11, False, "detect_only", "detect_only")]),
    ("none.py", "print('OpenAI()')\n", []),
    ("empty.py", "", []),
    ("win.py", "import os\r\nc = OpenAI(\r\n    api_key=k,\r\n)\r\n", [("openai", 2, 5, False, "runtime", "rewrite")]),
    ("README.md", "OpenAI()\n", []),
    ("deep.py", "a = f().OpenAI()\nb = a[0].Anthropic(k)\nc = x[i](1).y.Groq(" + "(" * 20 + "1" + ")" * 20 + ")\nd = OpenAI(f(\")\")[g(')')], h)\ne = OpenAI((1)\n", [("openai", 1, 5, False, "runtime", "not_sdk_module"), ("anthropic", 2, 5, False, "runtime", "not_sdk_module"), ("groq", 3, 5, False, "detect_only", "not_sdk_module"), ("openai", 4, 5, False, "runtime", "rewrite")]),
    ("many.py", "".join(f"c{i} = Groq(k{i})\n" for i in range(40)), [("groq", i + 1, 6 if i < 10 else 7, False, "detect_only", "rewrite") for i in range(40)]),
    ("guard.py", "if __name__ == '__main__':\n    OpenAI(x=f)\n", [("openai", 2, 5, False, "runtime", "rewrite")]),
    ("noguard.py", "# if __name__ == '__main__'\nx = 1\n", []),
    ("objects.py", '(client\n  .OpenAI())\nx = {}.OpenAI()\ny = "a".Groq(k)\nz = f"{Anthropic(k)} {{OpenAI()}}"\nclass  OpenAI(X): pass\ndef  OpenAI(): pass\nw = client . OpenAI(k)\n', [("openai", 1, 2, False, "runtime", "not_sdk_module"), ("openai", 3, 5, False, "runtime", "not_sdk_module"), ("groq", 4, 5, False, "detect_only", "not_sdk_module"), ("anthropic", 5, 8, False, "runtime", "rewrite"), ("openai", 8, 5, False, "runtime", "not_sdk_module")]),
    ("rock.py", "a = boto3.client(\n    # which\n    'bedrock-runtime')\nb = boto3.client(r\"bedrock-runtime\")\nc = boto3.client('bedrock-runtime-x')\nd = boto3.client(f(), 'bedrock-runtime')\ne = boto3.client('s3', 'bedrock-runtime')\n", [("bedrock", 1, 5, False, "detect_only", "detect_only"), ("bedrock", 4, 5, False, "detect_only", "detect_only"), ("bedrock", 5, 5, False, "detect_only", "detect_only")]),
    ("types.ts", 'const a = new OpenAI<T<U>>({});\nconst b = `${new OpenAI({ apiKey: k })} new Groq()`;\nconst c = s.replace(/"/g, "") + new Anthropic();\n', [("openai", 1, 11, False, "detect_only", "rewrite"), ("openai", 2, 14, False, "detect_only", "rewrite"), ("anthropic", 3, 33, False, "detect_only", "rewrite")]),
    ("view.tsx", 'export const V = () => <p title="new OpenAI()">new OpenAI() isn\'t {new OpenAI(k)}</p>;\nconst w = new Groq({ a, ...b });\n', [("openai", 1, 68, False, "detect_only", "manual"), ("groq", 2, 11, False, "detect_only", "rewrite")]),
    ("nest.py", "c = OpenAI(http=Anthropic(k), **{})\nd = OpenAI(http=Anthropic(k), n=1)  # both\n", [("openai", 1, 5, False, "runtime", "manual"), ("anthropic", 1, 17, False, "runtime", "rewrite"), ("openai", 2, 5, False, "runtime", "rewrite"), ("anthropic", 2, 17, False, "runtime", "rewrite")]),
    ("depths.js", "const a = new OpenAI({ a: " + "{ b: " * 60 + "1" + " }" * 60 + " });\n", [("openai", 1, 11, False, "detect_only", "rewrite")]),
]
# Texts after the edits of the cases above that are rewritten.
REWRITTEN = {
    "app.py": f'import os\nfrom openai import OpenAI\nclient = OpenAI(\n    api_key=os.environ.get("GATEWAY_API_KEY"),\n    base_url="{PROXY}"\n)\n',
    "claude.py": f'import os\n# Anthropic()\nclient = Anthropic(\n    api_key=key,\n    base_url="{PROXY}"\n)  # note\n',
    "async.py": f'import os\na = AsyncOpenAI(\n    api_key=os.environ.get("GATEWAY_API_KEY"),\n    base_url="{PROXY}"\n)\nb = AsyncGroq(\n    api_key="é",\n    base_url="{PROXY}"\n)\nx = "é"; c = AsyncInferenceClient(\n    token=k,\n    base_url="{PROXY}"\n)\n',
    "mod.py": f'import os\nimport openai, cohere\nc = openai.AsyncOpenAI(\n    api_key=key,\n    base_url="{PROXY}"\n)\nd = mymod.OpenAI(k)\ne = cohere.ClientV2(\n    k,\n    base_url="{PROXY}"\n)\nf = Client(k)\n',
    "splat.py": f'import os\nc = OpenAI(**cfg)\nd = Groq(**cfg, base_url=u)\ne = Anthropic(\n    f(a, (b)), timeout=3,\n    base_url="{PROXY}"\n)\n',
    "a.ts": f'import OpenAI from "openai";\nconst c = new OpenAI({{\n  apiKey: process.env.GATEWAY_API_KEY,\n  baseURL: "{PROXY}"\n}});\n',
    "c.js": f'// new OpenAI()\nconst a = new Anthropic(config);\nconst b = new HfInference({{\n  accessToken: t,\n  baseUrl: "{PROXY}"\n}});\n',
    "deep.py": f"import os\na = f().OpenAI()\nb = a[0].Anthropic(k)\nc = x[i](1).y.Groq(" + "(" * 20 + "1" + ")" * 20 + f")\nd = OpenAI(\n    f(\")\")[g(')')], h,\n    base_url=\"{PROXY}\"\n)\ne = OpenAI((1)\n",
    "many.py": "import os\n" + "".join(f'c{i} = Groq(\n    k{i},\n    base_url="{PROXY}"\n)\n' for i in range(40)),
    "guard.py": f"import os\nif __name__ == '__main__':\n    OpenAI(\n    x=f,\n    base_url=\"{PROXY}\"\n)\n",
    "objects.py": f'import os\n(client\n  .OpenAI())\nx = {{}}.OpenAI()\ny = "a".Groq(k)\nz = f"{{Anthropic(\n    k,\n    base_url="{PROXY}"\n)}} {{{{OpenAI()}}}}"\nclass  OpenAI(X): pass\ndef  OpenAI(): pass\nw = client . OpenAI(k)\n',
    "types.ts": f'const a = new OpenAI<T<U>>({{\n  apiKey: process.env.GATEWAY_API_KEY,\n  baseURL: "{PROXY}"\n}});\nconst b = `${{new OpenAI({{\n  apiKey: k,\n  baseURL: "{PROXY}"\n}})}} new Groq()`;\nconst c = s.replace(/"/g, "") + new Anthropic({{\n  apiKey: process.env.GATEWAY_API_KEY,\n  baseURL: "{PROXY}"\n}});\n',
    "view.tsx": f'export const V = () => <p title="new OpenAI()">new OpenAI() isn\'t {{new OpenAI(k)}}</p>;\nconst w = new Groq({{\n  a, ...b,\n  baseURL: "{PROXY}"\n}});\n',
    "nest.py": f'import os\nc = OpenAI(http=Anthropic(\n    k,\n    base_url="{PROXY}"\n), **{{}})\nd = OpenAI(\n    http=Anthropic(\n    k,\n    base_url="{PROXY}"\n), n=1,\n    base_url="{PROXY}"\n)  # both\n',
    "depths.js": "const a = new OpenAI({\n  a: " + "{ b: " * 60 + "1" + " }" * 60 + f',\n  baseURL: "{PROXY}"\n}});\n',
    "win.py": f'import os\r\nc = OpenAI(\r\n    api_key=k,\r\n    base_url="{PROXY}"\r\n)\r\n',
}
# name, content, definitions (line, name, value), uses (line, name)
ENV_CASES = [
    (".env", '# c\nAPI_KEY=abc\n\nNAME = "quoted"\nB=\'x\' # y\nnovalue\n', [(2, "API_KEY", "abc"), (4, "NAME", "quoted"), (5, "B", "'x' # y")], []),
    (".env.local", 'export A=1\n\tT=\t"\nURL="a=b"\n', [(1, "export A", "1"), (2, "T", '"'), (3, "URL", "a=b")], []),
    ("use.py", 'import os\nk = os.environ["API_KEY"]\nv = os.getenv(\'B\', "b")\nw = os.environ.get(\'C\')\n# os.getenv("D")\n', [], [(2, "API_KEY"), (3, "b"), (4, "C"), (5, "D")]),
    ("use.ts", "const a = process.env.NAME;\nconst b = process.env[\"E\"]; const c = process.env['F'];\nconst d = process.env.;\nlet e = process.env['G'];\n", [], [(1, "NAME"), (2, "E"), (4, "G")]),
]


def _picked(documents: DataFrame, cases: list[tuple]) -> DataFrame:
    """repo, path, file_name, ext, depth, is_symlink, mtime, content: a file for each document."""
    mark, end = (F.when(F.col("content").contains("\r\n"), "\r\n").otherwise("\n") if x == "end" else F.when(F.col("file_name").rlike("[.][jt]sx?$"), "// ").otherwise("# ") for x in ("mark", "end"))
    said = F.concat(mark, F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.concat(end, mark)), end)
    spark = documents.sparkSession
    table = values(spark, [(i, c[0], c[1]) for i, c in enumerate(cases)], "k int, file_name string, content string")
    own = documents.select("doc_id", "text", F.pmod("doc_id", F.lit(len(cases))).cast("int").alias("k")).join(F.broadcast(table), "k")
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit("/"), F.col("file_name"))
    return own.select(
        "doc_id",
        "k",
        F.concat(F.lit("repo"), F.pmod("doc_id", F.lit(REPOS)).cast("string")).alias("repo"),
        path.alias("path"),
        "file_name",
        F.when(F.col("file_name").rlike(r"^.+\.[^.]*$"), F.regexp_extract("file_name", r"\.([^.]*)$", 1)).alias("ext"),
        F.lit(3).alias("depth"),
        F.lit(False).alias("is_symlink"),
        F.timestamp_seconds(F.pmod("doc_id", F.lit(1000)) * 60).alias("mtime"),
        F.concat(said, "content").alias("content"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(documents(spark, sf_dir), CASES)


def env_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(documents(spark, sf_dir), ENV_CASES)


def quoted(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        parts = v.replace("'", "''").split("\n")
        joined = "' || chr(10) || '".join(parts)
        return ("'" + joined + "'").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '")
    return str(v)


def values_sql(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows) + f") AS s({names})"


#: How many lines a document's text takes before its case.
SHIFT_SQL = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)"
_MARK = "CASE WHEN regexp_matches(file_name, '[.][jt]sx?$') THEN '// ' ELSE '# ' END"
_END = "CASE WHEN file_name = 'win.py' THEN chr(13) || chr(10) ELSE chr(10) END"
#: A document's text as comment lines.
SAID_SQL = f"{_MARK} || replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), {_END} || {_MARK}) || {_END}"
PATH_SQL = "'src/d' || doc_id || '/' || file_name"
REPO_SQL = f"'repo' || (doc_id % {REPOS})"


def calls_sql() -> str:
    rows = [(k, c[0], c[0].rpartition(".")[2], *call) for k, c in enumerate(CASES) for call in c[2]]
    return f"SELECT {REPO_SQL} AS repo, {PATH_SQL} AS path, provider, line + {SHIFT_SQL} AS line, col AS \"column\", configured AS has_base_url, coverage, action, ext FROM documents JOIN {values_sql(rows, 'k, file_name, ext, provider, line, col, configured, coverage, action')} ON doc_id % {len(CASES)} = k"


def env_sql(kind: int) -> str:
    rows = [(k, c[0], *d) for k, c in enumerate(ENV_CASES) for d in c[kind]]
    names = "k, file_name, line, name, value" if kind == 2 else "k, file_name, line, name"
    more = ", value" if kind == 2 else ", CASE WHEN file_name LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language"
    return f"SELECT {REPO_SQL} AS repo, {PATH_SQL} AS path, line + {SHIFT_SQL} AS line, name{more} FROM documents JOIN {values_sql(rows, names)} ON doc_id % {len(ENV_CASES)} = k"
