"""Every operator and stage on null, empty, long, repeated and clashing input, and on empty tables."""

import pytest

import corpus_pipeline
from lumenlake.llm import (
    decontamination,
    language_id,
    language_model,
    licences,
    mixing,
    neighbours,
    quality,
    simhash,
    substrings,
    toxicity,
)

CLASHING = "chunk octets key size part node print words score features label rest vector turn kept taken weight n id _row virtual_finish rank round start row".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
PLAIN = "a quiet river runs below the old town and the people walk along it every day in spring"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, f"{PLAIN} number {k} {k * k}", "en", "s1") for k in range(1, 9)]
    rows += [(20, None, "en", "s1"), (21, "", "en", None), (22, " \t\n", None, "s2"), (23, LONG, "de", "s2"), (None, PLAIN, "en", "s2")]
    rows += [(None, None, None, None), (24, PLAIN, "en", "s1"), (24, PLAIN, "en", "s1"), (25, PLAIN, None, "s3"), (26, "ünï çödé ﷽ 😀", "fr", "s3")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 2), int(k % 3 == 0)) for k in range(1, 9)] + [(None, 1, 1), (24, None, None), (23, 0, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, LONG[:400]), (2, None), (3, ""), (None, "two words"), (1, LONG[:400])], "item_id long, text string")


def _ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


ONE_ROW_EACH = {
    "simhash": lambda d, lab, b: simhash.groups(d),
    "near": lambda d, lab, b: simhash.near_duplicates(d),
    "mixing": lambda d, lab, b: mixing.mix(d),
    "language": lambda d, lab, b: language_id.identify_documents(d),
    "substrings": lambda d, lab, b: substrings.remove_repeats(d, chunk_bytes=2000),
    "toxicity": lambda d, lab, b: toxicity.score_documents(d, lab),
    "quality": lambda d, lab, b: quality.score_documents(d, lab),
    "model": lambda d, lab, b: language_model.score_texts(d, units=20),
}
FEWER_ROWS = {
    "licences": lambda d, lab, b: licences.scan_licences(d),
    "leaks": lambda d, lab, b: decontamination.find_leaks(d, b),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_document(odd, labels, bench, name):
    assert _ids(ONE_ROW_EACH[name](odd, labels, bench)) == _ids(odd)


@pytest.mark.parametrize("name", [*ONE_ROW_EACH, *FEWER_ROWS])
def test_empty_tables(none, labels, bench, name):
    operator = (ONE_ROW_EACH | FEWER_ROWS)[name]
    assert operator(none, labels.limit(0), bench).count() == 0
    assert operator(none, labels, bench.limit(0)).count() == 0


def test_defined_results(odd, labels, bench):
    found = {r.doc_id: r for r in substrings.remove_repeats(odd).collect() if r.doc_id}
    assert (found[20].n_words, found[21].n_words, found[22].n_removed) == (0, 0, 0)
    assert found[24].n_removed == 18 and found[24].n_words == 18
    groups = {r.doc_id: r for r in simhash.groups(odd).select("doc_id", simhash.hex_print().alias("f"), "component_id").collect()}
    assert {groups[k].f for k in (20, 21, 22)} == {"0" * 16} and {groups[k].component_id for k in (20, 21, 22)} == {20}
    assert groups[25].component_id == groups[24].component_id
    languages = {r.doc_id: r for r in language_id.identify_documents(odd).collect()}
    assert {languages[k].lang_pred for k in (20, 21, 22)} == {"und"} and languages[20].score == 0
    texts = {r.doc_id: r for r in language_model.score_texts(odd, units=20).collect()}
    assert {texts[k].n_tokens for k in (20, 21, 22)} == {1}
    leaks = decontamination.find_leaks(odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(23, 1)}
    sizes = {r.doc_id: r for r in mixing.mix(odd).collect()}
    assert sizes[20].size == sizes[21].size == 0 and sizes[23].size == 60_000 and sizes[23].taken <= 180_000
    assert licences.scan_licences(odd).count() == 0


def test_labels_without_rows_or_with_one_class(odd, labels):
    for operator in (toxicity.score_documents, quality.score_documents):
        assert {r.score for r in operator(odd, labels.limit(0)).collect()} == {0.0}
        ones = labels.where("doc_id is not null").selectExpr("doc_id", "1 as quality", "1 as toxic")
        assert {r.score for r in operator(odd, ones).collect()} == {1.0}


def test_vectors(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, key string")
    found = neighbours.nearest(table, neighbours.F.col("vec_id") % 20 == 0, 5).collect()
    valid = dict(rows[:60])
    for query in (0, 20, 40):
        scores = sorted(((-sum(a * b for a, b in zip(valid[query], v)), k) for k, v in valid.items() if k != query))[:5]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == query] == [(k, -s) for s, k in scores]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert neighbours.nearest(table.limit(0), neighbours.F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, none, labels, bench, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, odd, str(tmp_path))
    assert out.columns[: len(odd.columns)] == odd.columns
    if name != "mixing":
        assert out.dtypes == odd.dtypes
    out.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_judge_each_row_by_its_own_text(spark):
    words = [f"w{k}" for k in range(300)]
    near = " ".join(w if k != 150 else "changed" for k, w in enumerate(words))
    rows = [(None, near), (1, " ".join(words)), (None, PLAIN), (7, "another text of more than five words"), (7, LONG[:400]), (None, LONG[:400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()}
    assert kept == {rows[1], rows[2], rows[3], rows[4]}
    item = spark.createDataFrame([(1, LONG[:400])], "item_id long, text string")
    clean = sorted((r.text for r in decontamination.without_leaks(docs, item).collect()), key=len)
    assert clean == sorted((text for _, text in rows[:4]), key=len)


def test_toxic_rows_without_an_id_go(spark):
    rows = [(k, f"plain words number {k} of a calm day" if k % 4 else f"you are zorb and scum {k}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    more = [(None, "you are zorb and scum 8"), (None, "plain words number 9 of a calm day"), (9, "you are zorb and scum 12")]
    kept = [(r.doc_id, r.text) for r in toxicity.keep_clean(spark.createDataFrame(rows + more, "doc_id long, text string"), labels).collect()]
    assert all("zorb" not in text for _, text in kept)
    assert (None, more[1][1]) in kept and rows[9] in kept
