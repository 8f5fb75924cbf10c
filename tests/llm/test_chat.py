import hashlib

from palisade.llm import chat

ROWS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, 0, "system", "s"),
    (2, 0, "user", None), (2, 1, None, "x"), (2, 2, "tool", "[END] <\\s> <\\\\s> [ROLE]"), (2, 3, "[/ROLE]", "[NEXT][NEXT"),
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "user", "é\U0001f600\n"), (4, 5, "user", "<" * 50 + "[" + "\\" * 9),
    (None, 1, "assistant", "long " * 30000),
]


def test_digests_read_back(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert len(got) == 6
    for conv in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in ROWS if c == conv))
        mask = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest(), conv
        assert (r.loss_chars, r.loss_sha256) == (len(mask), hashlib.sha256(mask.encode()).hexdigest())


def test_formatted(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert got[1].formatted == "[SYS]s[/SYS][INST]a[/INST]<s>b[NEXT]c</s>"
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss] == ["b", "c"]
    assert got[-1].formatted == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(df)).collect() == []
