"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of a text, lower-cased (A-Z) and cut at ASCII white space, and one end. The most frequent
``MODELLED`` words make classes of ``SLOTS`` words each; every other word belongs to one of ``TAILS`` tail classes by its
last letters. p(word | context) = p(class | context) * p(word | class, context). Both are log-linear in the word before, the two
words before (hashed) and, as skip features, the second and third word before; context words are taken as themselves if modelled
and by hash if not, so that every word of the corpus is evidence. Inside a tail class a word has its smoothed share
(c + 0.5) / (N_k + 0.5 * (V_k + 1)), so that the model sums to one over known words and unknown ones.

What is learnt grows with the corpus: counts cover all training texts and stay a table, the buckets of hashed pairs grow with the
root of the training tokens (``buckets``), and training goes over all training texts, in ``ROUNDS`` parts: in
a round each task starts from the broadcast weights, takes gradient steps over its texts and gives the change of
the weights; the changes are averaged by Spark, weighted by tokens, in two levels, and make the next round's weights. Of
the counts the ``HEAD`` most frequent tokens at most are broadcast, down to a count that a histogram gives; tokens beyond these meet
their counts in a join.

Null texts are as empty ones (their end is their one token); very long ones are scored whole. Without training texts all counts are
zero and the model is the base. Among tokens of one count the order is that of their bytes. Repeated rows and null keys are each scored;
other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES, SLOTS, TAILS = 28, 36, 12
MODELLED = CLASSES * SLOTS
#: Context words: modelled ones, hashed others, and the start of a text.
OTHERS = 1024
START = MODELLED + OTHERS
SYMBOLS = START + 1
#: Least and most buckets of hashed pairs; their weights are broadcast.
PAIRS = 8192, 32_768
HEAD, ROUNDS, TASK_TOKENS = 200_000, 2, 6_000_000
STEP, BATCH = 0.15, 4_096
#: Rows that are added up as one piece, and logarithms whose exponentials, and sums of some dozens of these, float32 holds.
PIECE, IN_RANGE = 16, 60
#: Weights in a row of a task's change.
BLOCK = 16_384
END = b""


def buckets(total: int) -> int:
    """Buckets of hashed pairs for so many training tokens: a power of two, their root or more."""
    return min(max(1 << math.ceil(math.log2(math.sqrt(max(total, 1)))), PAIRS[0]), PAIRS[1])


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


class Words:
    """What is broadcast of the counts: the most frequent tokens in order, and the totals."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head], dtype=np.float64)
        own = np.arange(len(head))
        self.target = np.where(own < MODELLED, own, MODELLED + np.array([tail(w) for w, _ in head], dtype=np.int64))
        self.context = np.where(own < MODELLED, own, MODELLED + np.array([zlib.crc32(w) % OTHERS for w, _ in head], dtype=np.int64))
        self.total, self.distinct = total, distinct
        self.base = np.log10(total + 0.5 * (distinct + 1))
        self.inside = np.array([np.log10(n + 0.5 * (v + 1)) for n, v in (tails.get(k, (0, 0)) for k in range(TAILS))])
        self.tails = np.array([tails.get(k, (0, 0))[0] for k in range(TAILS)], dtype=np.float64)

    def ranks(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, own, repeat(-1)), dtype=np.int64, count=len(own))

    def symbols(self, own: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token what it is as a target and as a context."""
        target, context = (x[rank] if len(x) else np.zeros(len(rank), dtype=np.int64) for x in (self.target, self.context))
        for i in np.flatnonzero(rank < 0).tolist():
            target[i], context[i] = MODELLED + tail(own[i]), MODELLED + zlib.crc32(own[i]) % OTHERS
        return target, context


def start(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Weights that give the unigram shares: the biases are logarithms of counts; slots without a word are shut."""
    pairs = buckets(w.total)
    a, b = np.zeros((1 + 3 * SYMBOLS + pairs, CLASSES + TAILS), dtype=np.float32), np.zeros((CLASSES + 2 * pairs, SLOTS), dtype=np.float32)
    words = np.zeros(MODELLED)
    words[: min(MODELLED, len(w.count))] = w.count[:MODELLED]
    a[0, :CLASSES] = np.log(words.reshape(CLASSES, SLOTS).sum(axis=1) + 0.5)
    a[0, CLASSES:] = np.log(w.tails + 0.5)
    b[:CLASSES] = np.where(words > 0, np.log(np.maximum(words, 1)), -60).reshape(CLASSES, SLOTS)
    return a, b


def contexts(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets of many texts in one array, context words in another, each text after three starts, and the places of the texts' tokens."""
    sizes = np.array([len(t) for t, _ in texts], dtype=np.int64)
    target, context = (np.full(int(sizes.sum()) + 3 * len(texts), START, dtype=np.int64) for _ in range(2))
    place = np.arange(int(sizes.sum())) + 3 * np.repeat(np.arange(1, len(texts) + 1), sizes)
    if texts:
        target[place], context[place] = (np.concatenate(x) for x in zip(*texts, strict=True))
    return target, context, place


def rows(context: np.ndarray, place: np.ndarray, pairs: int) -> np.ndarray:
    """(5, n) rows of the class table: bias, one word before, skips over one and two, and the hashed pair."""
    one, two, three = context[place - 1], context[place - 2], context[place - 3]
    pair = (one * 40_503 + two * 2_654_435_761) % pairs
    return np.stack([np.zeros_like(one), 1 + one, 1 + SYMBOLS + two, 1 + 2 * SYMBOLS + three, 1 + 3 * SYMBOLS + pair])


def inner_rows(context: np.ndarray, place: np.ndarray, group: np.ndarray, pairs: int) -> np.ndarray:
    """(3, n) rows of the word table: the class's bias, and class with the word before and with the one before that, hashed."""
    one, two = context[place - 1], context[place - 2]
    return np.stack([group, CLASSES + (one * CLASSES + group) * 40_503 % pairs, CLASSES + pairs + (two * CLASSES + group) * 40_503 % pairs])


def logits(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows that each column of ``at`` names, less something for each that keeps their exponentials and the sums of these in range."""
    z = np.take(table, at[1], axis=0)
    more = np.empty_like(z)
    for r in at[2:]:
        z += np.take(table, r, axis=0, out=more, mode="clip")
    z += table[0] if not at[0].any() else np.take(table, at[0], axis=0, out=more, mode="clip")
    # Highest values by token take long; mostly all are below and all means above what is in range.
    if len(z) and not (z.max() <= IN_RANGE and row_sums(z).min() >= -IN_RANGE * z.shape[1]):
        z -= z.max(axis=1, keepdims=True)
    return z


def row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], dtype=z.dtype)


def log_softmax(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = logits(table, at)
    z -= np.log(row_sums(np.exp(z)))[:, None]
    return z


def log_shares(table: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What ``log_softmax`` has for each token's target alone."""
    z = logits(table, at)
    own = z[np.arange(len(z)), target]
    return own - np.log(row_sums(np.exp(z, out=z)))


def summed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of ``rows``, sum of the values of each); rows: (k, n) numbers for n values.

    The k * n pairs are sorted by number. Runs of a number are added up place by place, long runs in pieces first, so that each addition is of many rows at once.
    """
    n = len(values)
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16) if flat.max() < 1 << 16 else flat, kind="stable")
    own, value = flat[order], order % n
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(first, append=len(own))
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    total = np.empty((len(first), values.shape[1]), dtype=values.dtype)
    many = int(np.count_nonzero(size > PIECE))
    if many:
        pieces = -(-size[:many] // PIECE)
        start = np.cumsum(pieces) - pieces
        run = np.repeat(np.arange(many), pieces)
        begin = first[run] + PIECE * (np.arange(len(run)) - start[run])
        left = first[run] + size[run] - begin
        longest = np.argsort(-np.minimum(left, PIECE), kind="stable")
        back = np.empty_like(longest)
        back[longest] = np.arange(len(longest))
        part = np.empty((len(run), values.shape[1]), dtype=values.dtype)
        layers(values, value, begin[longest], np.minimum(left, PIECE)[longest], part)
        np.add.reduceat(np.take(part, back, axis=0), start, axis=0, out=total[:many])
    layers(values, value, first[many:], size[many:], total[many:])
    return own[first], total


def layers(values: np.ndarray, value: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    """Puts into ``out`` the sums of values by runs of ``value`` from these places on, the longest runs first."""
    if not len(begin):
        return
    np.take(values, value[begin], axis=0, out=out, mode="clip")
    for j in range(1, int(size[0])):
        m = int(np.count_nonzero(size > j))
        out[:m] += np.take(values, value[begin[:m] + j], axis=0)


def put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] = rows``, each row as one item, which takes half the time."""
    item = np.dtype((np.void, table.dtype.itemsize * table.shape[1]))
    np.put(table.view(item), at, rows.view(item))


def groups(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each target is modelled, and its class."""
    known = target < MODELLED
    return known, np.where(known, target // SLOTS, target - MODELLED + CLASSES)


def scores(a: np.ndarray, b: np.ndarray, target: np.ndarray, context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """ln p of each token: of its class and, for a modelled word, of the word in its class."""
    out, pairs = np.zeros(len(place)), len(a) - 1 - 3 * SYMBOLS
    for at in range(0, len(place), BATCH):
        own = place[at : at + BATCH]
        known, group = groups(target[own])
        out[at : at + BATCH] = log_shares(a, rows(context, own, pairs), group)
        if known.any():
            k = np.flatnonzero(known)
            out[at + k] += log_shares(b, inner_rows(context, own[k], group[k], pairs), target[own[k]] % SLOTS)
    return out


class Steps:
    """Gradient steps from some weights, with a step length for each weight that shrinks with its gradients."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.tables = [a.copy(), b.copy()]
        self.squares = [np.full(x.shape, 1e-4, dtype=np.float32) for x in self.tables]
        self.pairs = len(a) - 1 - 3 * SYMBOLS

    def step(self, which: int, at: np.ndarray, target: np.ndarray) -> None:
        table, squares, n = self.tables[which], self.squares[which], len(target)
        g = logits(table, at)
        np.exp(g, out=g)
        g *= (1 / (n * row_sums(g)))[:, None]
        g[np.arange(n), target] -= 1 / n
        # The rows that some token has, and the sum of the gradients of each. A bias that all tokens have needs no sorting.
        if at[0].any():
            met, total = summed(g, at)
        else:
            met, total = summed(g, at[1:])
            if met.all():
                met, total = np.r_[met, 0], np.concatenate([total, np.zeros((1, g.shape[1]), dtype=g.dtype)])
            total[met == 0] += g.sum(axis=0)
        seen = np.take(squares, met, axis=0)
        seen += total * total
        put(squares, met, seen)
        total /= np.sqrt(seen, out=seen)
        total *= STEP
        put(table, met, np.subtract(np.take(table, met, axis=0), total, out=total))

    def learn(self, target: np.ndarray, context: np.ndarray, place: np.ndarray) -> None:
        for at in range(0, len(place), BATCH):
            own = place[at : at + BATCH]
            known, group = groups(target[own])
            self.step(0, rows(context, own, self.pairs), group)
            if known.any():
                k = own[known]
                self.step(1, inner_rows(context, k, group[known], self.pairs), target[k] % SLOTS)


def counted(texts: DataFrame) -> DataFrame:
    """(token, n) over all rows of a binary column ``text``."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(tokens(t))
                if len(counts) > HEAD:
                    yield flat(counts)
                    counts.clear()
        yield flat(counts)

    def flat(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, head: int = HEAD) -> Words:
    """The bounded part of the counts that tasks need: ``head`` tokens at most, and totals by tail class."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count whose tokens, with all of higher counts, are ``head`` at most: counts of one step are less than 5 % apart.
    step = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, head
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # some hundred steps
        room -= r.v
        if room < 0:
            break
        least = r.n
    top = counts.filter(F.col("n") >= least).toArrow().to_pylist() if least is not None else []
    most = sorted(((r["token"], r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    # The tail classes hold all but the modelled words: all tokens by class, less those.
    last = F.expr("substring(token, greatest(length(token) - 1, 1), 2)")
    tails = {r.k: [r.n, r.v] for r in counts.groupBy(F.pmod(F.crc32(last), F.lit(TAILS)).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for w, n in most[:MODELLED]:
        k = tail(w)
        tails[k] = [tails[k][0] - n, tails[k][1] - 1]
    return Words(most, totals[0], totals[1], {k: tuple(x) for k, x in tails.items()})


def train(texts: DataFrame, words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The weights after a pass over all rows of a binary column ``text`` and a column ``part`` (0 to rounds - 1)."""
    spark = texts.sparkSession
    a, b = start(words)
    if not words.total:
        return a, b
    shared_words = spark.sparkContext.broadcast(words)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((a, b))
        own = texts.filter(F.col("part") == r).select("text").coalesce(max(1, -(-words.total // (rounds * TASK_TOKENS))))

        def learn(batches, shared=shared):
            w, (a, b) = shared_words.value, shared.value
            steps, n, held, size = Steps(a, b), 0, [], 0
            for batch in batches:
                for part in common.steps(batch, 0):
                    for t in part.column(0).to_pylist():
                        t = tokens(t)
                        held.append(w.symbols(t, w.ranks(t)))
                        size += len(t)
                        if size >= 4 * BATCH:
                            steps.learn(*contexts(held))
                            n, held, size = n + size, [], 0
            if held:
                steps.learn(*contexts(held))
                n += size
            if n:
                change = np.concatenate([(x - y).ravel() for x, y in zip(steps.tables, (a, b), strict=True)])
                parts = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "change"])

        # Averages of averages, so that no group holds more changes than the root of the tasks.
        some = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(-(-words.total // (rounds * TASK_TOKENS))) + 1))
        changes = own.mapInArrow(learn, "block int, n long, change binary").withColumn("some", some)
        first = changes.groupBy("block", "some").applyInPandas(averaged, "block int, n long, change binary")
        got = first.groupBy("block").applyInPandas(averaged, "block int, n long, change binary").collect()  # the size of the weights
        flat = np.concatenate([np.frombuffer(x.change, dtype=np.float32) for x in sorted(got, key=lambda x: x.block)])
        a, b = a + flat[: a.size].reshape(a.shape), b + flat[a.size :].reshape(b.shape)
    return a, b


def averaged(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["n", "change"])
    n = int(group.n.sum())
    total = sum(np.frombuffer(c, dtype=np.float32).astype(np.float64) * (k / n) for c, k in zip(group.change, group.n, strict=True))
    return pd.DataFrame({"block": [int(group.block.iloc[0])], "n": [n], "change": [total.astype(np.float32).tobytes()]})


def score(docs: DataFrame, training=None, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; training: a condition on rows to learn from (all by default)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), (F.lit(True) if training is None else training).alias("train"))
    learnt = own.filter("train").select("text", F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("part"))
    counts = common.written(counted(learnt))
    words = known_words(counts, head)
    weights = train(learnt, words, rounds)
    shared = spark.sparkContext.broadcast((words, *weights))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        w, a, b = shared.value
        log = np.log10(w.count + 0.5)
        for batch in batches:
            for part in common.steps(batch, 1):
                held, facts, rest = [], [], []
                for t in part.column(1).to_pylist():
                    t = tokens(t)
                    rank = w.ranks(t)
                    target, context = w.symbols(t, rank)
                    held.append((target, context))
                    seen = rank[rank >= 0]
                    logs = log[seen]
                    loose = seen >= MODELLED
                    # What a token has in the base, and words of a tail class in the model, beside the joined counts.
                    inner = logs[loose].sum() - np.bincount(target[target >= MODELLED] - MODELLED, minlength=TAILS) @ w.inside
                    facts.append((len(t), len(seen), logs.sum() - len(t) * w.base, inner))
                    rest.append(list(Counter(t[i] for i in np.flatnonzero(rank < 0).tolist()).items()))
                model = np.add.reduceat(scores(a, b, *contexts(held)), np.r_[0, np.cumsum([len(h) for h, _ in held])[:-1]]) / np.log(10)
                n, k, base, inner = (np.array(x) for x in zip(*facts, strict=True))
                loose = pa.array([[{"token": x, "times": c} for x, c in r] for r in rest], pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(base.astype(float)), pa.array((model + inner).astype(float)), loose], names=["key", "n_tokens", "n_known", "base", "model", "rest"])

    schema = f"key {kind}, n_tokens long, n_known long, base double, model double, rest array<struct<token:binary,times:bigint>>"
    scored = common.written(own.select("key", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    loose = scored.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.times")
    if words.distinct > len(words.count):  # else the broadcast words are all there are
        loose = loose.join(counts, "token", "left")
    else:
        loose = loose.withColumn("n", F.lit(None).cast("long"))
    n = F.coalesce("n", F.lit(0))
    sums = loose.groupBy("row").agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("logs"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.drop("rest").join(sums, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
