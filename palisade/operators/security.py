"""Text security: threat classification, redaction, guarding of conversations, secrets and policies.

All are stateless projections over a text column, so that they run on streams as on tables; only the roll-ups group.
Rules are rows (type, pattern, weight); a null text is as an empty one for detection and stays null when redacted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.text import col, entropy, mask_key

MODES = ("redact", "mask", "block")
# The least confidence that blocks at each level.
CUTS = {"strict": 0.5, "moderate": 0.75, "permissive": 0.9}


def scan_text(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """Adds blocked, decision, confidence, reason and threat_type: those of the rule of most weight that fits (the first of equals)."""
    rules = rules or registry.RULES
    hits = F.array_compact(F.array(*[F.when(col(text).rlike(p), F.struct(F.lit(float(w)).alias("confidence"), F.lit(-i).alias("place"), F.lit(t).alias("threat_type"))) for i, (t, p, w) in enumerate(rules)]))
    best = F.array_max(hits)
    blocked = best.isNotNull()
    return df.withColumns(
        {
            "blocked": blocked,
            "decision": F.when(blocked, "block").otherwise("allow"),
            "confidence": F.coalesce(best["confidence"], F.lit(0.0)),
            "reason": F.when(blocked, F.concat(F.lit("matched "), best["threat_type"])).otherwise("no rule matched"),
            "threat_type": best["threat_type"],
        }
    )


def _pii(types: list[str] | None) -> list[tuple[str, str]]:
    unknown = set(types or []) - {k for k, _ in registry.PII_RULES}
    if unknown:
        raise ValueError(f"unknown types: {sorted(unknown)}")
    return [(k, p) for k, p in registry.PII_RULES if types is None or k in types]


def _valid_cards(text: Column) -> Column:
    """Marks card numbers that pass the checksum, so that others are left alone."""
    parts = F.split(text, "[0-9]{16}", -1)
    cards = F.regexp_extract_all(text, F.lit("[0-9]{16}"), F.lit(0))
    each = F.transform(cards, lambda c, i: F.concat(F.get(parts, i), F.when(F.call_function("luhn_check", c), "[CREDIT_CARD_REDACTED]").otherwise(c)))
    return F.when(text.rlike("[0-9]{16}"), F.concat(F.array_join(each, ""), F.element_at(parts, -1))).otherwise(text)


def _masked_findings(text: Column, pattern: str, valid=None) -> Column:
    """Each finding by its last four characters, where ``valid`` holds of it."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = lambda h: mask_key(h) if valid is None else F.when(valid(h), mask_key(h)).otherwise(h)
    return F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda a, h: F.concat(a, shown(h))), ""), F.element_at(parts, -1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule(kind: str, pattern: str, mode: str, cards: bool):
    """One rule's step: from struct<text, found> to the next."""

    def check(card):
        return F.call_function("luhn_check", card)

    def step(acc):
        t = acc["text"]
        hit = t.rlike(pattern)
        if kind in registry.NEEDED:
            hit = reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in registry.NEEDED[kind]]) & hit
        if cards:
            hit = hit & F.exists(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), check)
        if mode == "mask":
            new = _masked_findings(t, pattern, check if cards else None)
        else:
            new = _valid_cards(t) if cards else F.regexp_replace(t, pattern, f"[{kind.upper()}_REDACTED]")
        return F.when(hit, F.struct(new.alias("text"), F.concat(acc["found"], F.array(F.lit(kind))).alias("found"))).otherwise(acc)

    return step


def judged(text: str | Column = "text", types: list[str] | None = None, mode: str = "redact", luhn: bool = False) -> Column:
    """struct<text, found>: a text without its findings, and their types in the order of the rules.

    One pass: each rule is looked for once, in what the rules before it leave. luhn: card numbers have to pass the checksum, in all modes.
    """
    if mode not in MODES:
        raise ValueError(f"mode: one of {MODES}")
    state = F.struct(col(text).alias("text"), F.array().cast("array<string>").alias("found"))
    for k, p in _pii(types):
        state = _let(state, _rule(k, p, mode, luhn and k == "credit_card"))
    if mode == "block":
        return _let(state, lambda acc: F.struct(F.when(F.size(acc["found"]) == 0, acc["text"]).alias("text"), acc["found"].alias("found")))
    return state


def redacted(text: str | Column = "text", types: list[str] | None = None, luhn: bool = False) -> Column:
    """The text with each finding given way to ``[<TYPE>_REDACTED]``. luhn: card numbers have to pass the checksum."""
    return judged(text, types, "redact", luhn)["text"]


def pii_found(text: str | Column = "text", types: list[str] | None = None, luhn: bool = False) -> Column:
    """The types found, in the order of the rules; each is looked for in what the ones before it leave."""
    return judged(text, types, "redact", luhn)["found"]


def redact(df: DataFrame, text: str = "text", types: list[str] | None = None, mode: str = "redact", luhn: bool = False) -> DataFrame:
    """Adds redacted and pii_found. mode ``mask`` keeps the last four characters of a finding; ``block`` gives null where there is any."""
    inner = "__judged"
    while inner in df.columns:
        inner += "_"
    out = df.withColumn(inner, judged(text, types, mode, luhn))
    return out.withColumns({"redacted": F.col(f"{inner}.text"), "pii_found": F.col(f"{inner}.found")}).drop(inner)


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each secret key in a text: its place among them and the masked value."""
    pattern = dict(registry.PII_RULES)["api_key"]
    return df.select(*keep, F.posexplode(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))).alias("place", "secret")).select(*keep, "place", mask_key("secret").alias("masked"))


def key_candidates(c: str | Column, alphabets=None) -> Column:
    """array<struct<secret, alphabet, bits>>: the runs of a text that look drawn at random, in its order; a null text has none.

    A run's alphabet is the first that it fits. It is a secret if it has the alphabet's fewest signs, letters, digits in two places at least (names
    end in a number, keys have digits throughout), and the least share of log2(the lesser of its length and the alphabet's size)
    as bits a sign. Runs of several parts (paths, slugs, times) need a part of 12 signs with small and capital letters and digits.
    """
    alphabets = registry.KEY_ALPHABETS if alphabets is None else alphabets

    def judged_by(run):
        def fits(size, least, share):
            return (F.length(run) >= least) & (bits(run) >= share * F.log2(F.least(F.length(run), F.lit(size)).cast("double")))

        name = good = None
        for kind, pattern, size, least, share in alphabets:
            own = run.rlike(pattern)
            name = F.when(own, kind) if name is None else name.when(own, kind)
            good = F.when(own, fits(size, least, share)) if good is None else good.when(own, fits(size, least, share))
        part = F.exists(F.split(run, "[+/_=-]"), lambda p: (F.length(p) >= 12) & p.rlike("[0-9]") & p.rlike("[a-z]") & p.rlike("[A-Z]"))
        drawn = run.rlike("[0-9][^0-9]+[0-9]") & run.rlike("[A-Za-z]") & (~run.rlike("[+/_=-]") | part)
        return F.when(drawn & good, F.struct(run.alias("secret"), name.alias("alphabet"), F.round(bits(run), 4).alias("bits")))

    def bits(run):
        return entropy(run, registry.KEY_SIGNS)

    return F.coalesce(F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(registry.KEY_RUN), F.lit(0)), judged_by), lambda x: x.isNotNull()), F.array())


def find_unknown_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), alphabets=None) -> DataFrame:
    """A row for each secret of no known format: its place among them, alphabet, bits a sign and masked value (see ``key_candidates``).

    A projection and an explode, no shuffle. Equal rows are each judged by themselves; texts without a secret, empty and null ones give no row.
    """
    each = df.select(*keep, F.posexplode(key_candidates(text, alphabets)).alias("place", "found"))
    return each.select(*keep, "place", "found.alphabet", "found.bits", mask_key("found.secret").alias("masked"))


def guard(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: the turns' decisions rolled up, and its redacted messages by turn."""
    judged = scan_text(messages, text).withColumn("redacted", redacted(text))
    return judged.groupBy(conv).agg(
        F.when(F.bool_or("blocked"), "block").otherwise("allow").alias("decision"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("threat_type")).alias("threats"),
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col("redacted").alias("text")))).alias("redacted_messages"),
    )


def enforce(results: DataFrame, policies: DataFrame, project: str = "project_id") -> DataFrame:
    """Results with their project's decision. policies: (project_id, level, toxicity_threshold); other projects are moderate.

    The level sets the least confidence that blocks; toxicity is judged by its own threshold where there is one.
    """
    level = F.coalesce("level", F.lit("moderate"))
    cut = reduce(lambda out, kv: F.when(level == kv[0], kv[1]).otherwise(out), CUTS.items(), F.lit(CUTS["moderate"]))
    cut = F.when((F.col("threat_type") == "toxicity") & F.col("toxicity_threshold").isNotNull(), F.col("toxicity_threshold")).otherwise(cut)
    return results.join(policies, project, "left").withColumn("enforced", F.when(F.col("threat_type").isNotNull() & (F.col("confidence") >= cut), "block").otherwise("allow"))


def pii_summary(redactions: DataFrame, *by: str) -> DataFrame:
    """How many texts hold each type of personal data."""
    return redactions.select(*by, F.explode("pii_found").alias("pii_type")).groupBy(*by, "pii_type").agg(F.count("*").alias("texts"))


def threat_summary(results: DataFrame, *by: str) -> DataFrame:
    blocked = F.count_if("blocked")
    return results.groupBy(*by).agg(F.count("*").alias("total"), blocked.alias("blocked"), F.round(blocked / F.count("*"), 6).alias("block_rate"))
