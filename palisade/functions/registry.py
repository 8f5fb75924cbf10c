"""Providers and rules as small tables that users extend by adding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col

# Class and parameter names of the providers' kits; none where a kit has no such class or parameter.
# provider, shown, python class, python module, python async class, script class, its base-address and key parameters
PROVIDERS = [
    ("openai", "OpenAI", "OpenAI", "openai", "AsyncOpenAI", "OpenAI", "baseURL", "apiKey"),
    ("anthropic", "Anthropic", "Anthropic", "anthropic", "AsyncAnthropic", "Anthropic", "baseURL", "apiKey"),
    ("cohere", "Cohere", "Client", "cohere", None, "CohereClient", "baseURL", "apiKey"),
    ("huggingface", "HuggingFace", "InferenceClient", "huggingface_hub", "AsyncInferenceClient", "HfInference", "baseUrl", "accessToken"),
    ("gemini", "Gemini", "Client", None, None, "GoogleGenAI", None, None),
    ("groq", "Groq", "Groq", "groq", "AsyncGroq", "Groq", "baseURL", "apiKey"),
    ("bedrock", "AWS Bedrock", None, None, None, "BedrockRuntimeClient", None, None),
]
PROVIDER_SCHEMA = "provider string, display string, py_class string, py_module string, py_async_class string, ts_class string, ts_base_url_param string, ts_api_key_param string"
# Other names of providers.
ALIASES = {"hf": "huggingface", "google": "gemini", "aws": "bedrock", "aws-bedrock": "bedrock"}
# Providers whose classes can be patched in a running process, and those classes.
RUNTIME = {
    "openai": ["openai.OpenAI", "openai.AsyncOpenAI"],
    "anthropic": ["anthropic.Anthropic", "anthropic.AsyncAnthropic"],
    "cohere": ["cohere.Client", "cohere.AsyncClient", "cohere.ClientV2", "cohere.AsyncClientV2"],
    "huggingface": ["huggingface_hub.InferenceClient", "huggingface_hub.AsyncInferenceClient"],
}

# Threat rules: type, pattern, weight. Own choice; patterns stay within what both Java and RE2 know.
RULES = [
    ("prompt_injection", "(?i)ignore (all )?(previous|prior|above) instructions", 0.95),
    ("prompt_injection", "(?i)(reveal|print|show) (me )?(the|your) (system prompt|hidden instructions)", 0.9),
    ("jailbreak", "(?i)(do anything now|developer mode|without any restrictions|pretend you have no rules)", 0.85),
    ("data_exfiltration", "(?i)(send|post|upload) (all|every|the) (data|files|secrets|records) to", 0.8),
    ("secret_key", "pg_[A-Za-z0-9_]{13,}|token = \"[0-9a-f]{40}\"", 0.8),
    ("pii_leakage", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.7),
    ("toxicity", "(?i)(^|[^a-z])(idiot|moron|loser|scum|clown|stupid|disgusting|worthless|pathetic|trash)($|[^a-z])", 0.75),
]
# Kinds of personal data and secrets in the order in which they are taken out, so that longer runs of digits win.
PII_RULES = [
    ("api_key", "token = \"[0-9a-f]{40}\"|pg_[A-Za-z0-9_]{13,}"),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("credit_card", "[0-9]{16}"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("phone", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"),
    ("ipv4", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
]
# Texts of which a rule's finding has one: without them its pattern is not tried. Rules that are not named here are always tried.
NEEDED = {"api_key": ['token = "', "pg_"], "email": ["@"], "ssn": ["-"], "phone": ["+1 ("], "ipv4": ["."]}

# Keys of no known format: a run of signs is judged by the first alphabet that it fits. Own choice; patterns stay within what both Java and RE2 know.
KEY_RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
KEY_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
# alphabet, pattern of a whole run, its size, fewest signs, least share of the entropy that a run of this length can have
KEY_ALPHABETS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 16, 32, 0.8),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", 36, 28, 0.8),
    ("base62", "^[0-9A-Za-z]+$", 62, 20, 0.8),
    ("base64", "^[0-9A-Za-z+/_-]+={0,2}$", 64, 20, 0.8),
]


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows, as an inline relation."""
    names = [p.strip().split(" ", 1) for p in schema.split(", ")]

    def shown(v) -> str:
        return "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)

    body = ", ".join("(" + ", ".join(f"CAST({shown(v)} AS {kind})" for v, (_, kind) in zip(r, names, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(n for n, _ in names)})")


def providers(spark: SparkSession) -> DataFrame:
    return values(spark, PROVIDERS, PROVIDER_SCHEMA)


def patched(spark: SparkSession) -> DataFrame:
    """(provider, runtime_class) of what can be patched in a running process."""
    return values(spark, [(p, c) for p, cs in RUNTIME.items() for c in cs], "provider string, runtime_class string")


def _looked_up(c, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def parse_provider(c) -> Column:
    """The provider that a name or another name stands for, in any case; else null."""
    return _looked_up(F.lower(col(c)), {p[0]: p[0] for p in PROVIDERS} | ALIASES)


def provider_display(c) -> Column:
    return _looked_up(col(c), {p[0]: p[1] for p in PROVIDERS})


def has_runtime(c) -> Column:
    return col(c).isin(list(RUNTIME))
