"""Secrets of no known format: planted keys, ordinary runs, odd rows."""

import base64
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from palisade.functions import registry, text
from palisade.operators import security

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Runs of 20 signs and more that are nothing secret.
ORDINARY = [
    "123e4567-e89b-12d3-a456-426614174000",
    "getUserAccountInformation2",
    "src/main/java/com/Example2/FooBar/Impl3.java",
    "2024-01-15T10-22-33-000Z-export",
    "Rechtsschutzversicherungsgesellschaften",
    "123456789012345678901234567890",
    "a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1",
    "release-notes-for-version-2-and-version-3",
    "00000000000000000000000000000000000000ff0",
    "MAX_NUMBER_OF_RETRIES_V2_FOR_HOST_7",
]


def planted(n: int = 60) -> dict[str, list[str]]:
    """Keys of five formats that no rule names."""
    r = random.Random(7)
    draw = lambda signs, k: "".join(r.choices(signs, k=k))
    return {
        "hex": [draw("0123456789abcdef", 64) for _ in range(n)],
        "capital hex": [draw("0123456789ABCDEF", 32) for _ in range(n)],
        "base36": [draw(LOWER + DIGITS, 40) for _ in range(n)],
        "base62": [draw(LOWER + LOWER.upper() + DIGITS, 48) for _ in range(n)],
        "base64": [base64.b64encode(r.randbytes(40)).decode() for _ in range(n)],
    }


def test_planted_keys_are_found_and_ordinary_runs_are_not(spark):
    keys = planted()
    rows = [(i, kind, f"config: {k}, then words") for i, (kind, k) in enumerate((kind, k) for kind, own in keys.items() for k in own)]
    found = security.find_unknown_secrets(spark.createDataFrame(rows, "doc_id long, kind string, text string"), keep=("doc_id", "kind"))
    got = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count_distinct("doc_id").alias("n")).collect()}
    for kind, own in keys.items():
        assert got.get(kind, 0) >= 0.9 * len(own), got
    rest = spark.createDataFrame(list(enumerate(ORDINARY)), "doc_id long, text string")
    assert security.find_unknown_secrets(rest).collect() == []


def test_entropy_by_hand(spark):
    texts = ["", "aaaa", "ab", "abcd", "aab=", "pg_9F" * 3, None]
    want = [None if t is None else -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) + 0.0 for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.entropy("t", registry.KEY_SIGNS)).collect()]
    for a, b in zip(got, want, strict=True):
        assert (a is None and b is None) or abs(a - b) < 1e-9


def test_odd_rows(spark):
    key = planted(1)["base62"][0]
    rows = [(1, None), (2, ""), (3, f"{key} {key}"), (3, f"{key} {key}"), (None, "x" * 2_000_000 + " " + key), (4, "a1" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("own")).withColumn("alphabet", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["place"], r["alphabet"], r["masked"]) for r in security.find_unknown_secrets(df).collect())
    shown = "…" + key[-4:]
    assert got == [(0, 0, "base62", shown), (3, 0, "base62", shown), (3, 0, "base62", shown), (3, 1, "base62", shown), (3, 1, "base62", shown)]
    assert security.find_unknown_secrets(df.limit(0)).collect() == []
