"""Repair of conversations' turn structure at the least cost, by the auction algorithm for shortest paths.

A conversation is repaired by edits: Keep a row (0), Rerole it to user or assistant (3), Delete it (4; blank rows and
duplicates have to go), Insert a turn with an empty text (3); a truncated row that stays costs 3 more. The initials of the roles have to read
``(s?(ua)+)?`` afterwards. Rows and what has been read so far (start, s, u, a) make an integer-cost lattice, and the cheapest edits are its shortest
path. Bertsekas' auction keeps a price for each node and a path from the origin: at the path's tip it raises the price
to the least cost of going on (contraction, a step back), or, where the price is that already, goes on along that arc (extension).
Every node is an origin once, from the last layer to the first, and a path that meets a settled node ends there; all prices then equal the distances to
the end, so that exactly the arcs of shortest paths are tight, and following the least letter among tight arcs
gives the edits whose initials are least in ASCII.

A conversation may hold a third of all rows. Rows are put in order by a range shuffle over conversation, turn, role and text, and cut into
pieces of at most ``PIECE`` rows. Pieces of a conversation that is cut meet as 4 x 4 costs from state to state alone; composed from the last piece to
the first they price the far end of each piece, and then every piece is solved on its own, from each state at which it may be entered. Only the digest of a
whole conversation is sequential by nature: it streams through one task in bounded memory.

Rows are taken by turn, null turns first; ties by role, then by text; rows equal in all these are repeats, and
stay in one range. A null role or text is one space. A null conversation id is a conversation of its own. An initial other than s, u, a is no legal neighbour
and cannot be kept, nor can a row without a role. Very long texts are taken whole. Empty tables give no rows. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows that one task solves at a time.
PIECE = 1 << 16
#: Conversations that are cut, up to which their list is broadcast; beyond it is shuffled.
LISTED = 100_000
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTS = (USER, USER, ASSISTANT, USER)
#: Costs from each state to the end of a conversation without rows left: only the start and an assistant's turn may end it.
FINAL = (0, NEVER, NEVER, 0)
ROLES = {USER: "u", ASSISTANT: "a"}


def _arcs(initial: str, gone: bool, short: bool) -> list[list[tuple[str, int, bool, int]]]:
    """Arcs out of each state at a row: (edit and new role, cost, whether the row is used up, next state), by letter."""
    out = []
    for q in range(4):
        own = [("D-", 4, True, q), ("I" + ROLES[WANTS[q]], 3, False, WANTS[q])]
        if not gone:
            extra = 3 if short else 0
            if initial in KEEPS[q]:
                own.append(("K-", extra, True, KEEPS[q][initial]))
            own.append(("R" + ROLES[WANTS[q]], 3 + extra, True, WANTS[q]))
        out.append(own)
    return out


ARCS = {(i, gone, short): _arcs(i, gone, short) for i in ("s", "u", "a", "") for gone in (False, True) for short in (False, True)}
#: Behind the last row of a conversation: its end, or one more turn.
LAST = [[("", FINAL[q], True, 0), ("I" + ROLES[WANTS[q]], 3, False, WANTS[q])] for q in range(4)]


def prices(rows: list[tuple], ends: tuple | None) -> list[list[int]]:
    """The price of each layer's four states, converged to the distance to the end, by auctions from every node.

    rows: keys of ARCS. ends: the costs behind the last row from each state; None where the conversation ends there.
    """
    layers = [ARCS[r] for r in rows]
    if ends is None:
        layers, ends = [*layers, LAST], (0,)
    out = [list(ends)]
    for arcs in reversed(layers):
        further, here, settled = out[-1], [0] * 4, [False] * 4
        if arcs is not LAST and further[USER] >= NEVER and further[ASSISTANT] >= NEVER:
            # These two lead to each other alone: without a way on they have none, and their prices would rise for ever.
            here[USER:], settled[USER:] = [NEVER] * 2, [True] * 2
        for origin in (ASSISTANT, USER, SYSTEM, START):
            path = [origin]
            while path and not settled[path[-1]]:
                tip = path[-1]
                least, out_of_layer, to = NEVER, True, tip
                for _, cost, used, q in arcs[tip]:
                    whole = cost + (further[q] if used else here[q])
                    if whole < least:
                        least, out_of_layer, to = whole, used, q
                if here[tip] < least:  # contraction
                    here[tip] = least
                    if least >= NEVER:
                        settled[tip] = True
                    if len(path) > 1:
                        path.pop()
                elif out_of_layer:  # the path has met a settled node, and all of it is tight
                    break
                else:  # extension
                    path.append(to)
            for q in path:
                settled[q] = True
        out.append(here)
    return out[::-1]


def trace(rows: list[tuple], price: list[list[int]], last: bool, state: int) -> tuple[list[str], int]:
    """The edits at each row along the tight arcs of the least letters, and the state behind them."""
    out = []
    for i, arcs in enumerate([ARCS[r] for r in rows] + ([LAST] if last else [])):
        done, used = "", False
        while not used:
            edit, _, used, state = next(a for a in arcs[state] if a[1] + price[i + a[2]][a[3]] == price[i][state])
            done += edit
        out.append(done)
    if last:
        out[-2:] = [out[-2] + out[-1]]
    return out, state


def _streamed(df: DataFrame, keys: list[str], order: list[str], schema: str, group: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """The rows that ``group(key, rows)`` makes of each group, whose rows come in order, one after the other."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    width, fields = len(keys), T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (out for key, own in itertools.groupby(rows, lambda row: row[:width]) for out in group(key, (row[width:] for row in own)))
        while some := list(itertools.islice(made, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), target.types, strict=True)], schema=target)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)


def _kind(initial: str, blank: bool, duplicate: bool, truncated: bool) -> tuple:
    return (initial if initial in "sua" else "", blank or duplicate, truncated)


def _pieces(key, rows):
    """Costs of a piece from each of four states (by row) to each of four, or to the end; its first and last initials."""
    conv, piece = key
    noted = list(rows)
    kinds = [_kind(*r[:4]) for r in noted]
    if noted[0][5]:
        costs = prices(kinds, None)[0]
    else:
        ways = [prices(kinds, tuple(0 if q == r else NEVER for q in range(4)))[0] for r in range(4)]
        costs = [ways[r][q] for q in range(4) for r in range(4)]
    yield conv, piece, costs, noted[0][0], noted[-1][0]


def _ends(key, rows):
    """From the last piece to the first: what lies behind each piece (none behind the last), and the initial before it."""
    pieces = list(rows)
    behind = None
    for i, (piece, costs, _, _) in enumerate(pieces):
        before = pieces[i + 1][3] if i + 1 < len(pieces) else None
        yield *key, piece, behind, before
        behind = costs if behind is None else [min(NEVER, *(costs[4 * q + r] + behind[r] for r in range(4))) for q in range(4)]


def _solved(key, rows):
    """The edits at each row of a piece, for every state at which it may be entered."""
    conv, piece = key
    ends, last, before, cut, noted = None, True, None, False, []
    for at, initial, blank, duplicate, truncated, behind, previous in rows:
        if at < 0:
            ends, last, before, cut = behind, behind is None, previous, True
        else:
            noted.append((at, initial, blank, duplicate, truncated))
    kinds = [_kind(*r[1:]) for r in noted]
    price = prices(kinds, None if last else tuple(ends))
    initials = [before, *[r[1] for r in noted]]
    for entry in range(4) if cut else (START,):
        if price[0][entry] >= NEVER:
            continue
        edits, state = trace(kinds, price, last, entry)
        for i, ((at, initial, blank, duplicate, truncated), done) in enumerate(zip(noted, edits, strict=True)):
            letters = done[::2]
            cost = 3 * letters.count("I") + 4 * letters.count("D") + 3 * letters.count("R") + (3 if truncated and "D" not in letters else 0)
            illegal = initials[i] is not None and initials[i] + initial not in ("su", "ua", "au")
            yield conv, piece, at, cut, entry, state if i + 1 == len(noted) else None, done, cost, int(blank), int(duplicate), int(truncated), int(illegal)


def _entries(key, rows):
    """The state at which the path of a whole conversation enters each of its pieces."""
    state = START
    for piece, own in itertools.groupby(rows, lambda r: r[0]):
        yield *key, piece, state
        state = {entry: after for _, entry, after in own}[state]


class Repair:
    """Conversations under repair: ``rows()`` are the edits in order, ``faults()`` the counts by conversation.

    Intermediate tables lie in the shared folder; ``clear()`` deletes them when no result reads them any more.
    """

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.scratch = common.Scratch(turns.sparkSession)
        common.small_batches(turns.sparkSession)
        named = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
        self.ids = named.schema["conv_id"].dataType.simpleString()
        # Texts decide between equal turns and roles alone, so that their beginnings are enough to deal rows out.
        order = ["conv_id", "turn", "role"]
        ranged = named.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
        self.ordered = self.scratch.written(ranged.withColumn("at", F.monotonically_increasing_id()))
        self.solved = self._solve(self._noted())

    def _noted(self) -> DataFrame:
        """Each row's initial and its first fault, without its text."""
        stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
        slim = self.ordered.select(
            "conv_id",
            "at",
            F.floor(F.col("at") / F.lit(PIECE)).alias("piece"),
            F.substring("role", 1, 1).alias("initial"),
            (stripped == "").alias("blank"),
            (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("open"),
            "role",
            F.sha2("text", 256).alias("said"),
        )
        first = slim.filter(~F.col("blank")).groupBy("conv_id", "role", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        duplicate = ~F.col("blank") & F.col("first").isNull()
        marked = slim.join(first, "at", "left").select("conv_id", "piece", "at", "initial", "blank", duplicate.alias("duplicate"), (F.col("open") & ~F.col("blank") & ~duplicate).alias("truncated"))
        return self.scratch.written(marked)

    def _solve(self, noted: DataFrame) -> DataFrame:
        key = f"conv_id {self.ids}, piece long"
        cut = self.scratch.written(noted.groupBy("conv_id").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("lo < hi"))
        several = cut.count()
        ends = None
        if several:
            listed = F.broadcast(cut) if several <= LISTED else cut
            own = noted.join(listed.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")))
            own = own.select("conv_id", "piece", "initial", "blank", "duplicate", "truncated", "at", (F.col("piece") == F.col("hi")).alias("is_last"))
            costs = _streamed(own, ["conv_id", "piece"], ["at"], f"{key}, costs array<long>, head string, tail string", _pieces)
            # One row a piece from here on.
            ends = _streamed(costs.withColumn("back", -F.col("piece")).select("conv_id", "back", "piece", "costs", "head", "tail"), ["conv_id"], ["back"], f"{key}, behind array<long>, before string", lambda k, rows: _ends(k, (r[1:] for r in rows)))
        nothing = [F.lit(None).cast("array<long>").alias("behind"), F.lit(None).cast("string").alias("before")]
        told = noted.select("conv_id", "piece", "at", "initial", "blank", "duplicate", "truncated", *nothing)
        if ends is not None:
            told = told.unionByName(ends.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
        out = f"{key}, at long, cut boolean, entry int, after int, edits string, cost long, blank long, duplicate long, truncated long, illegal long"
        solved = self.scratch.written(_streamed(told, ["conv_id", "piece"], ["at"], out, _solved))
        whole = solved.filter(~F.col("cut"))
        if ends is None:
            return whole
        exits = solved.filter(F.col("cut") & F.col("after").isNotNull()).select("conv_id", "piece", "entry", "after")
        entries = _streamed(exits, ["conv_id"], ["piece"], f"{key}, state int", _entries).select(F.col("conv_id").alias("id"), F.col("piece").alias("of"), "state")
        parts = solved.filter("cut").join(entries, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("of")) & (F.col("entry") == F.col("state")), "left_semi")
        return whole.unionByName(parts)

    def rows(self) -> DataFrame:
        """(conv_id, at, step, edit, turn, role, text): one row an edit, in the order of ``at`` and ``step``.

        edit: K, R, D or I. Deleted rows keep what they were; inserted ones have no turn and an empty text.
        """
        steps = F.expr("transform(sequence(0L, length(edits) div 2 - 1), i -> substring(edits, int(2 * i + 1), 2))")
        edits = self.solved.select("at", F.posexplode(steps).alias("step", "done"))
        edit, new = F.substring("done", 1, 1), F.when(F.col("done").endswith("u"), "user").when(F.col("done").endswith("a"), "assistant")
        added = edit == "I"
        joined = edits.join(self.ordered, "at")
        return joined.select("conv_id", "at", "step", edit.alias("edit"), F.when(~added, F.col("turn")).alias("turn"), F.coalesce(new, "role").alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text"))

    def faults(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost) of each conversation that has rows."""
        turns = self.ordered.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().groupBy("conv_id")
        gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        counted = ["blank", "duplicate", "truncated", "illegal", "cost"]
        sums = self.solved.select("conv_id", *counted)
        both = sums.unionByName(gaps, allowMissingColumns=True)
        return both.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["gaps", *counted]])

    def clear(self) -> None:
        self.scratch.clear()


def _told(key, rows):
    audit, said, any_yet = [], hashlib.sha256(), False
    for _, _, edit, role, text in rows:
        audit.append(edit)
        if edit != "D":
            said.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
            any_yet = True
    yield *key, "".join(audit), said.hexdigest()


def digests(turns: DataFrame, repair: Repair) -> DataFrame:
    """Of every conversation of ``turns``: faults, cost, the edits' initials, and the SHA-256 of the repaired rows."""
    told = _streamed(repair.rows().select("conv_id", "at", "step", "edit", "role", "text"), ["conv_id"], ["at", "step"], f"conv_id {repair.ids}, audit string, repaired_sha256 string", _told)
    parts = turns.select("conv_id").distinct().unionByName(repair.faults(), allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return parts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], *[F.coalesce(F.max(c), F.lit(d)).alias(c) for c, d in nothing.items()])


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a fifth of the rows damaged, by the crc32 of "conv_id:turn" modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"))
