"""Personal data: candidate spans, boosted trees and calibrated thresholds, with DataFrame expressions alone.

*Generators* propose spans by patterns of high recall; they may overlap. *Features* of a candidate are of its format
(digits, separators, letters, case, its kind's check) and of its context (whether the word before tells its kind or another's, the
characters on both sides), each of a few values. No labels of personal data exist, so that training makes its own: in places of the corpus' own texts it
*plants* values of each added generator, made from hashes, and *masks* others: things of the same pattern that are nothing personal (long words and
identifiers from the text around, groups of digits, numbers that no office gives out, "look [at] this. Then"). The label is which of both a candidate is; no feature holds it:
words that tell a kind stand before both, only more often before planted values, and some formats (runs of digits alone) are made alike on both sides.
*Boosting*: Spark counts these candidates by pattern of features, fold and label; regression trees of depth two are boosted under
the logistic loss on fold 0 of that table of counts. *Calibration*: for each generator the least score at which, in fold 1, the share of planted values (one
masked one more assumed) is ``PRECISION``. Folds are by hash of the place. A candidate of the corpus is added by its score alone.

Training takes about ``PLANTED`` places: one in each of as many distinct texts drawn by hash; of smaller tables several in each. All else goes through all texts.

What passes the checks of the four base kinds always stays. The method adds candidates of the other patterns (``ADDED``) where they overlap none of
those. Matches of base patterns that fail their check are not added.

A text's spans are one expression over that text: nothing is shuffled, and ``redact`` cuts the same spans. Spans are in code
points from 0, end exclusive; of ties in the start the kind's order decides. Null texts have no spans (and stay null in
``redact``); very long texts are gone through whole; rows are kept one to one, repeated rows and null keys too; ``redact`` keeps
other columns, ``spans`` does not carry them. Empty tables give no rows; where no text has words to plant values among, base spans alone are found.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "token"]
TREES, RATE, PRECISION = 40, 0.4, 0.95
#: Code points of context that are looked at before a candidate.
CONTEXT = 24

# The patterns are written so that none looks at a character more than a few times: a match starts where the character
# before does not belong to it, or where the match before ended, and possessive parts are never given up again.
GENERATORS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++", "at)|at]"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("phone", r"(?<![0-9+])[(]?[0-9]{3}[)]?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("token", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", None),
]
# The generators (from 0) whose matches are the base patterns' own.
BASE_GENERATORS = {0: "email", 2: "ip", 3: "card", 4: "phone"}
# The generators whose matches the method may add.
ADDED = [1, 5, 6, 7]
#: Places in which values of each generator are planted and masked for training.
PLANTED = 8_000
# Words before a candidate that tell its kind.
CUES = {
    "email": ["mail", "email", "e-mail", "contact", "write"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "mastercard", "amex", "iban"],
    "phone": ["phone", "tel", "telephone", "call", "mobile", "fax", "cell"],
    "ssn": ["ssn", "social", "security"],
    "token": ["token", "key", "secret", "password", "apikey", "api_key", "bearer"],
}


def _likely(text: Column, g: int) -> Column:
    """Whether a generator finds anything in a text: by what it needs first, as most texts have none of it."""
    _, pattern, needs = GENERATORS[g]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in needs.split("|")]) & text.rlike(pattern) if needs else text.rlike(pattern)


def _matched(text: Column, pattern: str) -> Column:
    """array<struct<m, before, after>>: each match of a pattern, and what lies between it and its neighbours."""
    match, gap = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.arrays_zip(match.alias("m"), F.slice(gap, F.lit(1), F.size(match)).alias("before"), F.slice(gap, F.lit(2), F.size(match)).alias("after"))


def _shown(g: int):
    def one(x, i):
        return F.struct(F.lit(g).alias("gen"), i.alias("i"), F.length(x["before"]).alias("gap"), x["m"].alias("match"), F.right(x["before"], F.lit(CONTEXT)).alias("before"), F.left(x["after"], F.lit(1)).alias("after"))

    return one


def _found(text: Column) -> Column:
    """array<struct<gen, i, gap, match, before, after>> of all generators; gap: code points since the match before."""
    every = []
    for g, (_, pattern, _needs) in enumerate(GENERATORS):
        shown = F.transform(_matched(text, pattern), _shown(g))
        every.append(F.when(_likely(text, g), shown).otherwise(F.array().cast("array<struct<gen:int,i:int,gap:int,match:string,before:string,after:string>>")))
    return F.concat(*every)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))


def _luhn(match: Column) -> Column:
    d = _digits(match)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def checked(gen: Column, match: Column) -> Column:
    """Whether a candidate's format passes its kind's check."""
    n = F.length(_digits(match))
    return (
        F.when(gen == 2, _octets(match))
        .when(gen == 3, _luhn(match))
        .when(gen == 4, n.between(9, 15))
        .when(gen == 5, match.rlike("^[(]?[2-9]"))
        .when(gen == 6, ~match.rlike("^(000|666|9)|-00-|-0000$"))
        .otherwise(gen.isin(0, 1))
    )


def kind(gen: Column) -> Column:
    return reduce(lambda out, g: F.when(gen == g, F.lit(GENERATORS[g][0])).otherwise(out), range(len(GENERATORS)), F.lit(None).cast("string"))


def cue(before: Column) -> Column:
    """The kind that the last words before a candidate tell, or an empty text."""
    words = F.lower(before)
    return reduce(lambda out, k: F.when(words.rlike(rf"(?:^|[^a-z])(?:{'|'.join(CUES[k])})[^a-z0-9]{{1,6}}(?:(?:is|number|no|at|me)[^a-z0-9]{{1,4}})?$"), F.lit(k)).otherwise(out), CUES, F.lit(""))


def features(gen: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """Of a few values each: their product bounds the table that training collects."""
    n, size = F.length(_digits(match)), F.length(match)
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z0-9]"), 2).otherwise(3)
    lower, upper = match.rlike("[a-z]"), match.rlike("[A-Z]")
    joints = F.length(F.regexp_replace(match, "[^_-]", ""))
    told = cue(before)
    return {
        "gen": gen,
        "digits": F.when(n <= 3, n).when(n <= 6, 4).when(n <= 9, 5).when(n <= 11, 6).when(n <= 19, 7).otherwise(8),
        "apart": F.when(match.rlike("[.] "), 4).when(match.rlike("[()]"), 3).when(match.rlike("[0-9][ -][0-9]"), 2).when(match.rlike(r"[0-9]\.[0-9]"), 1).otherwise(0),
        "letters": F.when(n == size, 0).when(n * 4 >= size, 1).when(n > 0, 2).otherwise(3),
        "case": F.when(lower & upper, 3).when(upper, 2).when(lower, 1).otherwise(0),
        "joints": F.least(joints, F.lit(3)),
        "passes": checked(gen, match).cast("int"),
        "cue": F.when(told == "", 0).when(told == kind(gen), 1).otherwise(2),
        "left": side(F.right(before, F.lit(1))),
        "right": side(after),
    }


NAMES = ["gen", "digits", "apart", "letters", "case", "joints", "passes", "cue", "left", "right"]


def _drawn(of: list[str], number: Column) -> Column:
    """One of a few texts, by a number."""
    return F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(number, F.lit(len(of))) + 1).cast("int"))


def _values(n, words: Column) -> tuple[dict[int, Column], dict[int, Column]]:
    """Planted and masked values by generator. n(k): the k-th number of a place, by hash; words: text around it."""
    hexes = F.concat(F.md5(n(1).cast("string")), F.md5(n(2).cast("string")))
    digits = F.rpad(F.concat(*[F.abs(n(k)).cast("string") for k in (3, 4)]), 40, "7")
    part = lambda a, size: F.substring(digits, a, size)
    name = F.substring(F.translate(hexes, "0123456789", "klmnorstuy"), F.lit(1), F.pmod(n(5), F.lit(6)).cast("int") + 3)
    home = F.substring(F.translate(hexes, "0123456789", "aeioubdgpz"), 20, 7)
    signs = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "-")
    some = lambda of, k: reduce(lambda out, i: F.when(F.pmod(n(k), F.lit(len(of))) == i, of[i]).otherwise(out), range(1, len(of)), of[0])
    at, dot = _drawn([" [at] ", "(at)", " (at) "], n(6)), _drawn([".", " [dot] ", "(dot)"], n(7))
    area = F.concat((F.pmod(n(8), F.lit(6)) + 2).cast("string"), part(1, 2))
    ssn = lambda head: F.concat(head, F.lit("-1"), part(5, 1), F.lit("-1"), part(7, 3))
    number = part(4, 3), part(8, 4)
    good = {
        1: F.concat(name, at, home, dot, _drawn(["com", "org", "net", "de"], n(9))),
        5: some([F.concat(F.lit("("), area, F.lit(") "), number[0], F.lit("-"), number[1]), F.concat_ws("-", area, *number), F.concat_ws(".", area, *number), F.concat_ws(" ", area, *number)], 10),
        6: ssn(area),
        7: some([F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.upper(F.substring(hexes, 1, 40)), F.substring(signs, 1, 36), F.concat(F.lit("sk_live_"), F.regexp_replace(F.substring(signs, 1, 24), "-", "x")), part(1, 32)], 11),
    }
    joined = lambda sep: F.substring(F.regexp_replace(words, "[^A-Za-z]+", sep), F.lit(1), F.pmod(n(12), F.lit(24)).cast("int") + 24)
    three = F.regexp_extract(words, r"([A-Za-z]+)[^A-Za-z]+[A-Za-z]", 1), F.regexp_extract(words, r"[A-Za-z][^A-Za-z]+([A-Za-z]+)[^A-Za-z]", 1)
    bad = {
        1: F.concat(three[0], _drawn([" [at] ", " (at) "], n(6)), three[1], F.lit(". "), F.initcap(three[0])),
        5: some([F.concat_ws(" ", part(1, 3), *number), F.concat_ws(".", part(1, 3), *number), F.concat_ws(" ", part(1, 3), *number), F.concat_ws("-", F.concat(F.lit("0"), part(1, 2)), *number)], 10),
        6: some([ssn(F.lit("000")), ssn(F.lit("666")), ssn(F.concat(F.lit("9"), part(1, 2))), F.concat(area, F.lit("-00-"), part(5, 4)), F.concat(area, F.lit("-1"), part(5, 1), F.lit("-0000"))], 10),
        7: some([joined(""), joined("-"), joined("_"), F.lower(joined("")), F.upper(joined("_")), F.repeat(_drawn(["-", "_"], n(13)), F.pmod(n(12), F.lit(40)).cast("int") + 24), joined(""), part(1, 32)], 11),
    }
    return good, bad


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gen, match, before, after, label, fold): values planted (label 1) and masked (0), in about PLANTED places each."""
    h = F.xxhash64(F.col(text))
    texts = docs.filter(F.length(F.trim(text)) > 0)
    count = max(1, texts.count())
    share, places = min(1.0, PLANTED / count), -(-PLANTED // count)
    own = texts.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select(h.alias("h"), F.col(text).alias("t")).dropDuplicates(["h"])
    own = own.select("h", "t", F.explode(F.sequence(F.lit(0), F.lit(2 * len(ADDED) * places - 1))).alias("v"))
    n = lambda k: F.xxhash64("h", "v", F.lit(k))
    gen, label = reduce(lambda out, i: F.when(F.pmod(F.floor(F.col("v") / 2), F.lit(len(ADDED))) == i, ADDED[i]).otherwise(out), range(len(ADDED)), F.lit(-1)), F.pmod(F.col("v"), F.lit(2)).cast("int")
    # Of a text that may be very long, its places alone are carried on.
    own = own.select("h", "v", F.explode(F.array(F.substring("t", F.pmod(n(20), F.length("t")).cast("int") + 1, F.lit(240)))).alias("words"))
    words = F.col("words")
    good, bad = _values(n, words)
    match = reduce(lambda out, g: F.when(gen == g, F.when(label == 1, good[g]).otherwise(bad[g])).otherwise(out), ADDED, F.lit(None).cast("string"))
    kinds = list(CUES)
    told = lambda k: F.concat(_drawn(CUES[k], n(21)), _drawn([": ", " = \"", "=", " ", " is ", " number: "], n(22)))
    said = lambda of: reduce(lambda out, k: F.when(of == k, told(k)).otherwise(out), kinds, F.lit(""))
    other = _drawn(kinds, n(23))
    draw = F.pmod(n(24), F.lit(16))
    # Of 16: planted 8 with a word that tells their kind, 1 with another's; masked 1 and 4.
    lead = F.when(draw < F.when(label == 1, 8).otherwise(1), said(kind(gen))).when((draw < F.when(label == 1, 9).otherwise(5)) & (other != kind(gen)), said(other)).otherwise("")
    lead = F.when(F.pmod(n(25), F.lit(4)) == 0, F.upper(lead)).otherwise(lead)
    before = F.right(F.concat(F.regexp_extract(F.left(words, F.lit(60)), r"^[\s\S]*\s", 0), lead), F.lit(CONTEXT))
    after = _drawn([" ", ".", ",", '"', "\n", ""], n(26))
    fold = F.pmod(n(27), F.lit(2)).cast("int")
    place = F.struct(*[c.alias(name) for name, c in (("gen", gen), ("match", match), ("before", before), ("after", after), ("label", label), ("fold", fold))])
    # A generator keeps the optimizer from putting these long expressions in place of each use of their columns.
    made = own.select(F.explode(F.array(place)).alias("c")).select("c.*")
    fits = reduce(lambda a, b: a | b, [(F.col("gen") == g) & F.col("match").rlike(f"^(?:{GENERATORS[g][1]})$") for g in ADDED])
    return made.filter(fits)


def learn(docs: DataFrame, text: str = "text") -> dict:
    """Trees and thresholds, from values planted and masked in the places of a table's texts."""
    c = planted(docs, text)
    v = {n: x.cast("int") for n, x in features(*[F.col(x) for x in ("gen", "match", "before", "after")]).items()}
    counted = c.select(*[v[n].alias(n) for n in NAMES], "fold", "label").groupBy(*NAMES, "fold", "label").agg(F.count("*").alias("n"))
    return fitted(sorted((tuple(r[n] for n in NAMES), r.fold, r.label, r.n) for r in counted.collect()))  # bounded by the features' values


def fitted(rows: list[tuple[tuple[int, ...], int, int, int]]) -> dict:
    """The model of a table of counts: (features, fold, label, candidates)."""
    seen = defaultdict(lambda: [0, 0])
    for x, fold, label, n in rows:
        if fold == 0:
            seen[x] = [seen[x][0] + n, seen[x][1] + n * label]
    model = {"trees": boosted(seen), "thresholds": {}}
    for g in ADDED:
        own = threshold([(logit(model, x), n, n * label) for x, fold, label, n in rows if fold == 1 and x[0] == g])
        if own is not None:
            model["thresholds"][g] = own
    return model


def threshold(held: list[tuple[float, int, int]]) -> float | None:
    """The least score at which the share of positives among candidates at or over it is high enough; ties go together."""
    out, n, y = None, 0, 0
    for z in sorted({z for z, *_ in held}, reverse=True):
        n, y = n + sum(m for s, m, _ in held if s == z), y + sum(p for s, _, p in held if s == z)
        if y >= PRECISION * (n + 1):
            out = z
    return out


def boosted(counts: dict[tuple[int, ...], list[int]]) -> list:
    """Trees (feature, value, if equal, otherwise) from the candidates and positives of each pattern."""
    z, trees = dict.fromkeys(counts, 0.0), []
    splits = sorted({(i, v) for x in counts for i, v in enumerate(x)})
    for _ in range(TREES if counts else 0):
        p = {x: 1 / (1 + math.exp(-z[x])) for x in counts}
        g = {x: counts[x][1] - counts[x][0] * p[x] for x in counts}
        h = {x: counts[x][0] * p[x] * (1 - p[x]) for x in counts}
        tree = _grown(sorted(counts), 2, splits, g, h)
        trees.append(tree)
        for x in z:
            z[x] += follow(tree, x)
    return trees


def _grown(part: list, depth: int, splits: list, g: dict, h: dict):
    """A tree of the part's patterns: the split of most gain at each node, the first of equals; leaves by a Newton step."""

    sums: dict[tuple[int, int], list] = {}
    for x in part:
        for split in enumerate(x):
            own = sums.setdefault(split, [0.0, 0.0, 0])
            own[0], own[1], own[2] = own[0] + g[x], own[1] + h[x], own[2] + 1
    whole_g, whole_h = sum(g[x] for x in part), sum(h[x] for x in part)
    best = None
    for i, v in splits if depth else ():
        yes_g, yes_h, count = sums.get((i, v), (0.0, 0.0, 0))
        if 0 < count < len(part):
            s = yes_g**2 / (yes_h + 1.0) + (whole_g - yes_g) ** 2 / (whole_h - yes_h + 1.0)
            if best is None or s > best[0] + 1e-12:
                best = (s, i, v)
    if best is None:
        return RATE * whole_g / (whole_h + 1.0)
    _, i, v = best
    yes, no = [x for x in part if x[i] == v], [x for x in part if x[i] != v]
    return i, v, _grown(yes, depth - 1, splits, g, h), _grown(no, depth - 1, splits, g, h)


def follow(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] == tree[1] else tree[3]
    return tree


def logit(model: dict, x: tuple[int, ...]) -> float:
    return sum(follow(t, x) for t in model["trees"])


def selected(model: dict, g: int, values: dict[str, Column]) -> Column:
    """Whether the trees' score of a generator's candidate reaches its threshold. The generator is known, so that its splits are taken beforehand."""
    if g not in model["thresholds"]:
        return F.lit(False)

    def grown(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        name, value, yes, no = NAMES[tree[0]], tree[1], tree[2], tree[3]
        if name == "gen":
            return grown(yes if value == g else no)
        return F.when(values[name] == value, grown(yes)).otherwise(grown(no))

    return reduce(lambda a, b: a + b, [grown(t) for t in model["trees"]], F.lit(0.0)) >= F.lit(model["thresholds"][g] - 1e-9)


def base(gen: Column, match: Column) -> Column:
    return gen.isin(*BASE_GENERATORS) & checked(gen, match)


_SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string,base:boolean>>"


def _kept(text: Column, g: int, model: dict) -> Column:
    """A generator's spans that stay."""
    k = GENERATORS[g][0]

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        before, gen = F.right(x["before"], F.lit(CONTEXT)), F.lit(g)
        if g in BASE_GENERATORS:
            keep = base(gen, x["m"])
        else:
            named = features(gen, x["m"], before, F.left(x["after"], F.lit(1)))
            packed = F.struct(*[named[n].cast("int").alias(n) for n in NAMES])
            keep = _let(packed, lambda v: selected(model, g, {n: v[n] for n in NAMES}))
        span = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(k)).alias("order"), end.cast("long").alias("end"), F.lit(k).alias("kind"), F.lit(g in BASE_GENERATORS).alias("base"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)
    return F.when(_likely(text, g), F.aggregate(_matched(text, GENERATORS[g][1]), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found_spans(text: Column, model: dict) -> Column:
    """array<struct<start, order, end, kind, base>> of a text, in order; an added span overlaps no base span."""
    own = F.concat(*[_kept(text, g, model) for g in BASE_GENERATORS])
    more = F.concat(*[_kept(text, g, model) for g in ADDED])
    free = lambda fixed: F.filter(more, lambda a: ~F.exists(fixed, lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    return _let(own, lambda fixed: F.array_sort(F.array_distinct(F.concat(fixed, free(fixed)))))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """(key, spans) of every row, spans being array<struct<start, order, end, kind, base>> in order."""
    model = model or learn(docs, text)
    return docs.select(F.col(key).alias(key), found_spans(F.coalesce(F.col(text), F.lit("")), model).alias("spans"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(line(own), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with each of its ``spans`` given way to ``[KIND]``; of spans that overlap the first gives the mark for all."""
    model = model or learn(docs, text)
    t = F.col(text)

    def step(acc, s):
        piece = F.substring(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        marked = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] >= acc["at"], marked).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, acc["at"].cast("int") + 1, F.length(t)))), "")
    cut = _let(found_spans(t, model), lambda found: F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(t))
    return docs.withColumn(text, F.when(t.isNotNull(), cut))
