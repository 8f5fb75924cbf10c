"""Chat formatting: conversations as one text with a loss mask, by Spark expressions alone.

The turns of a conversation are collected as structs and sorted by turn; adjacent turns of one role become one
block, in which a mark keeps them apart, so that no turn is lost. Blocks are

    system     [SYS] ... [/SYS]
    user       [INST] ... [/INST]
    assistant  <s> ... </s>
    others     [ROLE] role [/ROLE] ... [END]          (no spaces around the marks; [NEXT] between the turns of a block)

A control string inside a text, or one with backslashes after its first sign, gets one backslash more there
(``</s>`` becomes ``<\\/s>``); reading back takes one away. So the escaping is reversible, and no text holds a mark.

Null texts and roles are as empty ones. Turns that tie are in the order of role and text; repeated rows are turns
of their own; a null turn comes first, and rows with a null conversation form one. An empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NEXT, ROLE, ROLE_ENDS, END = "[NEXT]", "[ROLE]", "[/ROLE]", "[END]"
_TAIL = r"(?:/?s>|/?SYS\]|/?INST\]|/?ROLE\]|NEXT\]|END\])"
_ESCAPE, _UNESCAPE = rf"([<\[]\\*+)(?={_TAIL})", rf"([<\[]\\*)\\(?={_TAIL})"
_BLOCK = r"(?s)(?:\[SYS\]|\[INST\]|<s>|\[ROLE\].*?\[/ROLE\]).*?(?:\[/SYS\]|\[/INST\]|</s>|\[END\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_ENDS))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(END)
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss): the text of each conversation, and the spans (code points, end exclusive) of it that
    the loss is taken over: the assistant's texts, without any mark."""
    # Texts are escaped after the rows are collected, so that each is shuffled once.
    piece = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    piece = piece.select("conv", F.struct("turn", "role", "text").alias("t"))
    rows = piece.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # The merge: a turn opens a block where the role before differs, and closes one where the role after does.
    before = lambda i: F.try_element_at("t", i)["role"]  # noqa: E731  places count from 1
    role_ = lambda t: t["role"]

    def pieces(t, i):
        first = (i == 0) | ~before(F.when(i > 0, i).otherwise(1)).eqNullSafe(role_(t))
        last = ~before(i + 2).eqNullSafe(role_(t))
        head = F.when(first, opening(role_(t))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), F.when(last, closing(role_(t))).otherwise(F.lit("")).alias("tail"), (role_(t) == "assistant").alias("learn"))

    rows = rows.select("conv", F.transform("t", pieces).alias("p"))
    rows = rows.select("conv", "p", F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(acc, p):
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.when(p["learn"], F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((b + F.length(p["tail"])).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return rows.select(F.col("conv").alias(conv), "formatted", F.aggregate("p", start, walk, lambda acc: acc["spans"]).alias("loss"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))

    def turns(b):
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (opens, closes) in MARKS.items():
            mine = F.startswith(b, F.lit(opens))
            role = F.when(mine, F.lit(name)).otherwise(role)
            body = F.when(mine, F.substring(b, F.lit(len(opens) + 1), F.length(b) - len(opens) - len(closes))).otherwise(body)
        ends = F.instr(b, ROLE_ENDS)
        other = F.substring(b, F.lit(len(ROLE) + 1), ends - len(ROLE) - 1)
        rest = F.substring(b, ends + len(ROLE_ENDS), F.length(b) - ends + 1 - len(ROLE_ENDS) - len(END))
        role, body = F.coalesce(role, unescaped(other)), F.coalesce(body, rest)
        return F.transform(F.split(body, r"\[NEXT\]"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(out: DataFrame, conv: str = "conv_id") -> DataFrame:
    turns, learnt = read_back(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss"))
    read = out.select(conv, "formatted", turns.alias("turns"), learnt.alias("learnt"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for the digests of all conversations and the added one.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|NEXT\]|END\])')) AS body
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(body
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 6
        ELSE CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 13 + length(role) END END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0
        ELSE CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 5 END END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
