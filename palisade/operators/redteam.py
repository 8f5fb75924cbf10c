"""Attack corpora: run under presets, score, and list what passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from .security import scan_text

# Presets, and the least confidence that blocks under each.
PRESETS = [("default", 0.75), ("strict", 0.5), ("permissive", 0.9)]


def presets(spark) -> DataFrame:
    return registry.values(spark, PRESETS, "preset string, cut double")


def select_attack(attacks: DataFrame, name: str) -> DataFrame:
    """The attacks of one name."""
    return attacks.filter(F.col("test_name") == name)


def run_redteam(attacks: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(preset, test_name, prompt, decision, reason, threat_type, confidence, blocked): each attack is judged once, then set against
    each preset; the library's own presets are three rows, broadcast, and a caller's are left to Spark."""
    judged = scan_text(attacks.select("test_name", "prompt"), "prompt").drop("blocked", "decision")
    pairs = judged.crossJoin(F.broadcast(presets(attacks.sparkSession)) if chosen is None else chosen)
    blocked = F.col("threat_type").isNotNull() & (F.col("confidence") >= F.col("cut"))
    return pairs.select("preset", "test_name", "prompt", F.when(blocked, "block").otherwise("allow").alias("decision"), "reason", "threat_type", "confidence", blocked.alias("blocked"))


def redteam_summary(results: DataFrame) -> DataFrame:
    """Totals and rate of each preset; score is the rate in percent. Presets without results have no row."""
    rate = F.count_if("blocked") / F.count("*")
    return results.groupBy("preset").agg(
        F.count("*").alias("total_tests"),
        F.count_if("blocked").alias("blocked"),
        F.count_if(~F.col("blocked")).alias("allowed"),
        F.round(rate, 6).alias("block_rate"),
        F.round(rate * 100, 4).alias("score"),
    )


def vulnerabilities(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("blocked"))
