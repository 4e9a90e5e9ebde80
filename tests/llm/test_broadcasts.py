"""Tables that grow with the documents are merged by key, however small Spark takes them for: the driver holds none."""

import pytest

from lumenlake.llm import components, simhash

TEXTS = ["one two three four five six", "one two three four five six", "seven eight nine ten", "a b c d e f g h", None] * 3


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are stored on the way."""
    seen = []
    for module, name in ((simhash, "saved"), (components, "cut_lineage")):
        before = getattr(module, name)

        def noted(df, *rest, before=before):
            seen.append(planned(df))
            return before(df, *rest)

        monkeypatch.setattr(module, name, noted)
    return seen


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")


def test_groups_broadcast_only_hot_keys(docs, plans):
    found = simhash.groups(docs)
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)
    assert planned(found).count("BroadcastHashJoin") == 1
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: [0, 0, 2, 3, 4][k % 5] for k in range(15)}


def test_near_duplicates_broadcast_only_hot_keys(docs, plans):
    kept = simhash.keep_one(docs)
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join([*plans, planned(kept)])
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    found = simhash.near_duplicates(docs)
    assert "Broadcast" not in "".join(plans) and planned(found).count("BroadcastHashJoin") == 1
