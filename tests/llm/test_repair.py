"""Repair of conversations, held against a plain search over all edits and a plain version of the whole query."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from palisade.llm import repair

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by a search that takes the least (cost, audit) first; rows: (role, text, fault)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in step[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], lines + (f"{role}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for letter, more, new in [("K", extra, role), ("R", 3 + extra, "user"), ("R", 3 + extra, "assistant")]:
                    if new[:1] in step[last]:
                        heapq.heappush(heap, (cost + more, audit + letter, i + 1, step[last][new[:1]], lines + (f"{new}:{text}",)))


def plain(turns):
    """The whole query, row by row."""
    kept = {}
    for conv, turn, role, text in turns:
        own = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, noted = set(), []
        for _, role, text in rows:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            noted.append((role, text, fault))
        known = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(noted)
        count = [sum(f == kind for _, _, f in noted) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(noted, noted[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, conversations, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage"]
    texts = ["Fine.", "Why?", "no end", " ", "", None, "So it is!\n", "Fine.", "é…", "x. \x85"]
    for c in range(conversations):
        for t in range(rng.randrange(longest)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                yield c if c else None, rng.choice([t, t, t, t + 5, None]), rng.choice(roles[: rng.choice([2, 9])]), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}."


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    turns = df.select("conv_id", "turn", "role", "text")
    out = repair.digests(turns, repair.Repair(repair.damaged(turns)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_prices_and_traces_against_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), str(i), rng.choice([None, None, None, "blank", "truncated"])) for i in range(rng.randrange(1, 9))]
        kinds = [repair._kind(role[:1], fault == "blank", False, fault == "truncated") for role, _, fault in rows]
        price = repair.prices(kinds, None)
        edits, _ = repair.trace(kinds, price, True, repair.START)
        cost, audit, _ = cheapest(rows)
        assert price[0][repair.START] == cost
        assert "".join(e[::2] for e in edits) == audit


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_equals_the_plain_version(spark, monkeypatch, piece):
    """With conversations in one piece and cut into pieces of three rows; nulls, ties, repeats, odd roles among them."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = list(made(random.Random(piece), 60, 12)) + [(77, t, "user" if t % 2 else "system", "hot.") for t in range(90)] + [(-5, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", at string").repartition(7)
    assert result(df) == plain(rows)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "cut of"), (1, 3, "user", "cut of")], SCHEMA)
    own = repair.Repair(df)
    rows = own.rows().orderBy("at", "step").collect()
    cost, audit, lines = cheapest([("system", "S.", None), ("assistant", "A.", None), ("user", "cut of", "truncated"), ("user", "cut of", "duplicate")])
    assert "".join(r.edit for r in rows) == audit and own.faults().first().cost == cost
    assert tuple(f"{r.role}:{r.text}" for r in rows if r.edit != "D") == lines
    assert all(r.turn is None and r.text == "" for r in rows if r.edit == "I")
    own.clear()


def test_empty_and_wholly_dropped(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    gone = next((c, t) for c in range(100) for t in range(10) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = result(spark.createDataFrame([(*gone, "user", "x.")], SCHEMA))
    assert got == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_the_table(spark, sf_dir="/root/testdata/sf0.001"):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert result(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
