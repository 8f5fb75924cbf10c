"""Validators and filters of settings, addresses and paths, as boolean Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, url_host, url_scheme

DEFAULT_HOST = "api.example.com"


def is_valid_key(c) -> Column:
    """A service key: its prefix, at least 16 bytes, no white space."""
    t = col(c)
    return F.startswith(t, F.lit("pg_")) & (F.octet_length(t) >= 16) & ~t.rlike(r"(?U)\s")


def is_loopback(url) -> Column:
    """Whether an address's host is 127.0.0.0/8, ::1 or localhost."""
    host = url_host(url)
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.coalesce(host.rlike(rf"^127(\.{octet}){{3}}$") | host.isin("localhost", "[::1]", "::1"), F.lit(False))


def is_valid_proxy_url(url) -> Column:
    """No white space, control sign, quote, brace or backslash; https, or http on a loopback host."""
    clean = ~col(url).rlike("(?U)[\\s\\p{Cntrl}\"'`\\\\{}]")
    return F.coalesce(clean & url_host(url).isNotNull() & ((url_scheme(url) == "https") | ((url_scheme(url) == "http") & is_loopback(url))), F.lit(False))


def is_trusted_host(url, default: str = DEFAULT_HOST) -> Column:
    return F.coalesce((url_host(url) == default) | is_loopback(url), F.lit(False))


def is_host_split(key_source, url_source, url, allowed, default: str = DEFAULT_HOST) -> Column:
    """Whether a key from elsewhere would be sent to an untrusted host that a repository's own settings name."""
    return (col(url_source) == "config") & (col(key_source) != "config") & ~is_trusted_host(url, default) & ~col(allowed)


def is_allowed_target(url, hosts: list[str] | None = None) -> Column:
    """A loopback host, or https to one of the allowed hosts."""
    hosts = [h.lower() for h in hosts or [DEFAULT_HOST]]
    return F.coalesce(is_loopback(url) | ((url_scheme(url) == "https") & url_host(url).isin(hosts)), F.lit(False))


def is_safe_env_path(c) -> Column:
    """A relative path that stays in its project, by the rules of either kind of system."""
    t = col(c)
    return ~(t.rlike(r"^[/\\]") | t.rlike("^[A-Za-z]:") | F.array_contains(F.split(t, r"[/\\]"), ".."))


def is_valid_backup_ext(c) -> Column:
    return col(c).rlike(r"^[.][A-Za-z0-9]+\z")


def is_valid_env_name(c) -> Column:
    return col(c).rlike(r"^[A-Z_][A-Z0-9_]*\z")


def is_finding(blocked, decision) -> Column:
    return F.coalesce(col(blocked), F.lit(False)) | F.coalesce(col(decision) == "block", F.lit(False))


def is_retryable(method, status, error_kind) -> Column:
    """Whether a failed call may be sent again: reads after any transport error or 502 to 504, others if they never connected."""
    read = F.upper(col(method)) == "GET"
    kind = F.coalesce(col(error_kind), F.lit(""))
    again = F.when(read, kind.isin("timeout", "connect", "request") | F.coalesce(col(status).isin(502, 503, 504), F.lit(False))).otherwise(kind == "connect")
    return F.coalesce(again, F.lit(False))


def has_env_key(content, key: str) -> Column:
    """Whether a line sets a key, with or without ``export``."""
    return F.coalesce(col(content).rlike(rf"(?m)^(?:export )?\Q{key}\E="), F.lit(False))


def is_ignored(content, pattern: str) -> Column:
    """Whether an ignore file has a pattern as a line, with or without a slash before it."""
    return F.coalesce(col(content).rlike(rf"(?m)^[ \t]*/?\Q{pattern}\E[ \t\r]*$"), F.lit(False))


#: The words that make a variable one of an API.
API_WORDS = ["API", "KEY", "SECRET", "TOKEN", "URL", "ENDPOINT", "BASE", "OPENAI", "ANTHROPIC", "COHERE", "HUGGINGFACE"]


def is_api_related(name) -> Column:
    return F.upper(col(name)).rlike("|".join(API_WORDS))
