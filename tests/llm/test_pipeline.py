"""Every stage against a plain version of it: in Python, row by row, from the stage's own input."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from palisade.llm import common, pii, toxicity
from palisade.llm.registered import tokenizer_path

from . import test_decontaminate, test_nearcopies, test_pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `__score` double, n_removed long, row string, gen int"
BAD, GOOD = "you utter zorgle", "we like the garden and the sea"
ITEM = "one two three four five six seven eight nine ten eleven"


def texts():
    """Clean and toxic texts, copies, near copies, passages, personal data, and odd rows."""
    out = [(i, f"{GOOD} {i} with words of its own {i * 7} {i * 11}" + (f" {BAD} {i}" if i % 5 == 0 else "")) for i in range(150)]
    long = [f"w{j}" for j in range(200)]
    out += [(200, " ".join(long)), (201, " ".join(long)), (202, " ".join([*long[:120], "x", *long[121:]])), (203, " ".join(long[:100]))]
    out += [(300, f"before {ITEM} after"), (301, ITEM), (302, "mail a.b@c.de or call +1 (555) 123-4567, ssn: 123-45-6789"), (303, "ip 10.0.0.1")]
    out += [(400, None), (401, ""), (402, " .,! "), (403, "x" * 100_000), (404, "y " * 50_000), (405, f"{GOOD} twice"), (405, f"{GOOD} twice"), (None, f"{GOOD} none")]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", -1, 0.5, 7, "r", 3) for k, t in texts()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None), (None, "q r s")], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    labels = [(i, int(i % 5 == 0)) for i in range(150) if i % 3] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top)


def test_stages(spark, sf, monkeypatch):
    inputs = []

    def noted(stage):
        return lambda spark, docs, sf_dir: (inputs.append(docs), stage(spark, docs, sf_dir))[1]

    monkeypatch.setattr(c, "STAGES", [(name, noted(stage)) for name, stage in c.STAGES])
    rows = c.run(spark, sf).collect()
    seen = {}
    for (name, _), docs, out in zip(c.STAGES, inputs, inputs[1:], strict=False):
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert (r.lang, r.source, r["__score"], r.row, r.gen) == ("en", "s", 0.5, "r", 3) and r.n_removed == 7
        seen[name] = ([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()])
        if name in ("decontamination", "personal_data"):
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())

    before, after = seen["toxicity"]
    weights = toxicity.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), training=common.fold() != 0)
    judged = lambda t: weights[""] + sum(weights.get(x, 0) for x in toxicity.features(t))
    assert sorted(after, key=str) == sorted((x for x in before if judged(x[1]) < 0), key=str)
    assert {k for k, _ in before} - {k for k, _ in after} == {i for i in range(0, 150, 5)}

    before, after = seen["near_copies"]
    assert sorted((k for k, _ in after if k is not None)) == test_nearcopies.brute([x for x in before if x[0] is not None])
    assert set(after) <= set(before) and (None, f"{GOOD} none") in after and {k for k, _ in after} & {200, 201, 202, 203} == {200, 203}

    before, after = seen["decontamination"]
    hit = {r[0] for r in test_decontaminate.brute(before, [(1, ITEM), (None, "q r s")]) if r[5]}
    assert hit == {300, 301} and sorted(after, key=str) == sorted([*(x for x in before if x[0] not in hit), (300, "before  after")], key=str)

    before, after = seen["personal_data"]
    found = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(before, "doc_id long, text string")).collect()}
    for (k, t), (_, new) in zip(sorted(before, key=str), sorted(after, key=lambda x: str((x[0], dict(before)[x[0]]))), strict=True):
        if t is not None:
            assert [len(x) for x in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SSN|TOKEN)\]", new)] == [b - a for a, b in zip([0, *(s.end for s in found[k])], [*(s.start for s in found[k]), len(t)], strict=True)], t
            assert test_pii.brute(new)[:4] == (0, 0, 0, 0)
    assert dict(after)[302] == "mail [EMAIL] or call [PHONE], ssn: [SSN]"

    library = Tokenizer.from_file(tokenizer_path())
    assert len(rows) == len(after)
    for r in rows:
        assert r.token_ids == library.encode(dict(after)[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        common.table(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert c.run(spark, str(tmp_path)).collect() == []
