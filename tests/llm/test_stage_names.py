"""Every stage that hands on whole rows, with columns whose names hold dots, blanks, backticks, capitals, or the stage's own names."""

import pytest

from kinfold.llm import bagminhash, decontaminate, exact_dedup, mixing

NAMES = ("x.y", "a b", "b`c", "KEY", "own", "found", "_kf", "_kf_row", "row", "similarity", "copies_", "doc.id")


@pytest.fixture
def docs(spark):
    rows = [(1, "one two three four five six seven", "s"), (2, "one two three four five six seven", "s"), (3, None, None), (3, None, None), (4, "", "t"), (5, "alpha beta gamma delta epsilon zeta eta theta", "t")]
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(rows)], ", ".join(["doc_id long, text string, source string", *(f"`{n.replace('`', '``')}` string" for n in NAMES)]))


@pytest.mark.parametrize("stage", ["exact", "near", "decontaminate", "mix"])
def test_columns_stay_as_they_are(spark, docs, stage):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    run = {"exact": exact_dedup.drop_exact, "near": bagminhash.drop_near, "decontaminate": lambda d: decontaminate.clean(d, items), "mix": mixing.mixed}[stage]
    out = run(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = {tuple(r)[: len(docs.columns)] for r in out.collect()}
    assert rows and rows <= {tuple(r) for r in docs.collect()}
    if stage == "decontaminate":
        assert {r[0] for r in rows} == {1, 2, 3, 4}
    if stage in ("exact", "near"):
        assert len([r for r in rows if r[0] in (1, 2)]) == 1
