"""The positional index against the phrase test on the texts themselves."""

import pytest
from pyspark.sql import functions as F

from checks import model as M
from lumenlake.functions.text import text_matches
from lumenlake.operators import phrase_index as P

TEXTS = {
    "a": "One two, three. One TWO!",
    "b": "two one three",
    "c": "to be or not to be",
    "d": "Ação rápida; ação lenta",
    "e": "",
    "f": None,
    "g": "the the the end",
    "h": "one, two one three two one two",
}
CASES = [
    ["one two"], ["two three", "one"], ["to be or not to be"], ["be to"], ["acao lenta"], ["AÇÃO"], ["the the"],
    ["the the the the"], ["one two", "one two", "two one"], ["missing"], ["one missing"], ["..."], ["one", "..."], ["two one two"],
]


def _texts(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id string, ocr_text string")


def _found(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("terms", CASES, ids=str)
def test_matches_equal_the_test_on_the_texts(spark, terms):
    texts = _texts(spark, TEXTS)
    expected = _found(texts.where(text_matches(F.col("ocr_text"), terms)).select("id"))
    assert _found(P.phrase_matches(P.build_phrase_index(texts, 3), terms)) == expected


def test_no_terms_are_refused_and_an_empty_table_has_no_matches(spark):
    index = P.build_phrase_index(_texts(spark, TEXTS).limit(0), 3)
    assert P.phrase_matches(index, ["one"]).count() == 0
    with pytest.raises(ValueError):
        P.phrase_matches(index, [])


def test_entries_of_texts_without_a_key_are_left_out_and_positions_ascend(spark):
    texts = spark.createDataFrame([(None, "one two"), ("a", "x one x x")], "id string, ocr_text string")
    rows = {r.token: [(e.id, e.positions) for e in r.entries] for r in P.build_phrase_index(texts, 1).collect()}
    assert rows == {"one": [("a", [1])], "x": [("a", [0, 2, 3])]}


def test_updates_rewrite_only_the_chunks_they_touch(spark, tmp_path):
    chunks, path, staged = 8, str(tmp_path / "index"), str(tmp_path / "staged")
    texts = {f"k{i}": f"word{i % 7} common phrase number {i}" for i in range(60)}
    P.write_phrase_index(P.build_phrase_index(_texts(spark, texts), chunks), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").glob("chunk=*/*.parquet")}
    change = {"k3": "something else", "k5": None, "new": "common phrase"}
    changed = _texts(spark, change)
    redone = P.update_phrase_index(spark.read.parquet(path), changed, chunks)
    redone.write.parquet(staged)
    P.write_phrase_index(spark.read.parquet(staged), path)
    touched = {f"chunk={r.chunk}" for r in changed.select(P.chunk_of("id", chunks)).collect()}
    after = set((tmp_path / "index").glob("chunk=*/*.parquet"))
    assert {p for p in before if p.parent.name not in touched} == {p for p in after if p.parent.name not in touched}
    assert touched and not {p for p in before if p.parent.name in touched} & after
    now = _texts(spark, {k: v for k, v in (texts | change).items() if v is not None})
    for terms in (["common phrase"], ["something"], ["number 5"], ["word3 common"]):
        expected = _found(now.where(text_matches(F.col("ocr_text"), terms)).select("id"))
        assert _found(P.phrase_matches(spark.read.parquet(path), terms)) == expected


def test_a_search_reads_only_wanted_tokens_and_a_bucketed_index_is_not_shuffled(spark):
    texts = M.texts(spark, "/root/testdata/sf0.001")
    P.save_phrase_index(P.build_phrase_index(texts, 16), "phrases_bucketed", 4)
    found = P.phrase_matches(spark.table("phrases_bucketed"), ["and the", "of"])
    expected = _found(texts.where(text_matches(F.col("ocr_text"), ["and the", "of"])).select("id"))
    assert _found(found) == expected and expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "In(token, [and,of,the])" in plan and "ocr_text" not in plan


def test_building_shuffles_the_texts_only(spark):
    plan = P.build_phrase_index(_texts(spark, TEXTS), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_positions_are_stored_by_their_differences(spark, tmp_path):
    import pyarrow.parquet as pq

    P.write_phrase_index(P.build_phrase_index(M.texts(spark, "/root/testdata/sf0.001"), 1), str(tmp_path / "index"))
    file = next((tmp_path / "index").glob("chunk=*/*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    coded = next(v for k, v in columns.items() if "positions" in k)
    assert "DELTA_BINARY_PACKED" in coded and "RLE_DICTIONARY" not in coded


def test_chunks_follow_the_texts_and_each_is_a_piece(spark, monkeypatch):
    texts = _texts(spark, TEXTS)
    assert P.chunks_for(texts) == P.chunks_for(texts.limit(0)) == 16
    monkeypatch.setattr(P, "CHUNK_BYTES", 4)
    octets = sum(len((t or "").encode()) for t in TEXTS.values())
    assert P.chunks_for(texts) == -(-octets // 4)
    assert P.build_phrase_index(texts, 23).rdd.getNumPartitions() == 23
