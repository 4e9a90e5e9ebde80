import json

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import candidates, paging, selections, spec_tables, specs
from lumenlake.operators.predicates import default_registry
from lumenlake.operators.specs import Catalog, all_specs, any_spec, filters_to_spec, not_spec, predicate
from lumenlake.registry import Registry, UnsupportedQuery

BIG = predicate("metadata.core", "eq", {"field": "minFileSize", "value": 1000})
SHOT = predicate("content.screenshot", "eq", {"field": "screenshot", "value": True})
BLUR = predicate("quality.visual", "eq", {"field": "minBlur", "value": 0.55})
FAVORITE = predicate("metadata.core", "eq", {"field": "favorite", "value": True})


@pytest.fixture(scope="module")
def catalog(spark):
    assets = spark.createDataFrame(
        [
            ("a", "photo", 100, 1500, False),
            ("b", "photo", 100, None, False),
            ("c", "photo", 100, 500, True),
            ("d", "video", 200, 5000, False),
            ("e", "photo", 300, 1000, False),
        ],
        "id string, media_type string, created_at bigint, file_size bigint, favorite boolean",
    )
    quality = spark.createDataFrame(
        [("a", 0.9, 0.1, 2), ("b", None, None, None), ("c", 0.2, 0.8, 1)],
        "id string, blur_score double, quality_score double, face_count int",
    )
    content = spark.createDataFrame([("a", True), ("b", None)], "id string, is_screenshot boolean")
    texts = spark.createDataFrame(
        [("a", "Invoice No. 10-20 for João"), ("b", "   "), ("c", "snake_case straße")], "id string, ocr_text string"
    )
    memberships = spark.createDataFrame(
        [("a", True, True, 3), ("b", False, True, 1)],
        "id string, in_duplicate boolean, in_similar boolean, memberships bigint",
    )
    return Catalog(assets, quality, content, texts, memberships)


def ids(catalog, spec):
    return {r.id for r in specs.apply_spec(catalog, spec).select("id").collect()}


def text(*terms):
    return predicate("text.ocr", "containsAny", {"field": "ocrTerms", "value": list(terms)})


def test_unknown_values_match_neither_predicate_nor_negation(catalog):
    assert ids(catalog, BIG) == {"a", "d", "e"}
    assert ids(catalog, not_spec(BIG)) == {"c"}
    assert ids(catalog, BLUR) == {"a"}
    assert ids(catalog, not_spec(BLUR)) == {"c"}
    assert ids(catalog, SHOT) == {"a"}
    assert ids(catalog, not_spec(SHOT)) == {"b", "c", "d", "e"}


def test_empty_and_is_everything_and_empty_or_is_nothing(catalog):
    assert ids(catalog, specs.EVERYTHING) == set("abcde")
    assert ids(catalog, any_spec()) == set()
    assert ids(catalog, all_specs(BIG, not_spec(any_spec(SHOT, FAVORITE)))) == {"d", "e"}


def test_text_terms_are_whole_token_phrases_joined_with_and(catalog):
    assert ids(catalog, text("10 20")) == {"a"}
    assert ids(catalog, text("JOAO", "invoice")) == {"a"}
    assert ids(catalog, text("invoi")) == set()
    assert ids(catalog, text("snake case")) == {"c"}
    assert ids(catalog, text("strasse")) == set()
    assert ids(catalog, text("invoice", "--")) == set()
    assert ids(catalog, not_spec(text("invoice"))) == set("bcde")


def test_duplicate_means_exact_or_visual_and_similar_means_all(catalog):
    duplicate = predicate("duplicate.exact", "eq", {"field": "duplicate", "value": True})
    similar = predicate("similarity.perceptual", "eq", {"field": "similar", "value": False})
    document = predicate("content.document", "eq", {"field": "document", "value": True})
    assert ids(catalog, duplicate) == {"a"}
    assert ids(catalog, similar) == {"c", "d", "e"}
    assert ids(catalog, document) == {"a", "c"}


@pytest.mark.parametrize(
    "leaf",
    [
        predicate("people.face", "eq", {"field": "hasFaces", "value": True}),
        predicate("metadata.core", "containsAny", {"field": "people", "value": ["x"]}),
        predicate("metadata.core", "eq", {"field": "albums", "value": True}),
        predicate("quality.visual", "eq", {"field": "minBlur", "value": True}),
        predicate("text.ocr", "containsAny", {"field": "ocrTerms", "value": []}),
    ],
)
def test_unsupported_leaves_refuse_the_whole_spec(catalog, leaf):
    with pytest.raises(UnsupportedQuery):
        specs.apply_spec(catalog, any_spec(BIG, leaf))


def test_favorites_are_excluded_by_default(catalog):
    assert ids(catalog, filters_to_spec({"mediaTypes": ["photo"]})) == {"a", "b", "e"}
    assert ids(catalog, filters_to_spec({"mediaTypes": ["photo"]}, {"favorites": False})) == {"a", "b", "c", "e"}


def test_refinement():
    current = specs.refine(None, BIG, "new")
    current = specs.refine(current, SHOT, "restrict")
    assert current == {"type": "and", "children": [BIG, SHOT]}
    assert specs.refine(current, FAVORITE, "exclude")["children"][2] == not_spec(FAVORITE)
    assert specs.refine(current, SHOT, "remove") == {"type": "and", "children": [BIG]}
    assert specs.refine(current, FAVORITE, "broaden") == any_spec(current, FAVORITE)
    other = predicate("content.screenshot", "eq", {"field": "screenshot", "value": False})
    assert specs.refine(current, other, "replace") == all_specs(BIG, other)
    context = {"request": {"ranking": {"strategy": "largest"}}, "operations": ["restrict"] * 32}
    later = specs.refine_request(context, {"expression": BIG}, "restrict", last=32)
    assert len(later["operations"]) == 32 and later["request"]["ranking"] == {"strategy": "largest"}


def test_limits():
    deep = SHOT
    for _ in range(25):
        deep = not_spec(deep)
    with pytest.raises(ValueError):
        specs.check_limits(deep)
    with pytest.raises(ValueError):
        specs.check_limits(any_spec(*[SHOT] * 65))
    specs.check_limits(any_spec(*[SHOT] * 64))


@pytest.mark.parametrize("strategy", ["newest", "largest", "worst-quality", "most-redundant", "least-important"])
def test_pages_concatenate_to_the_sorted_read(catalog, strategy):
    request = {"expression": specs.EVERYTHING, "ranking": {"strategy": strategy}}
    wide = specs.wide_catalog(catalog, [], (strategy,))
    whole = [r.id for r in wide.orderBy(*default_registry().ranking(strategy).order()).collect()]
    seen, cursor = [], None
    while True:
        rows, cursor = paging.search(catalog, request, limit=2, cursor=cursor)
        seen += [r.id for r in rows]
        if cursor is None:
            break
    assert seen == whole


def test_result_budget_and_cursor_binding(catalog):
    request = {"expression": specs.EVERYTHING, "target": {"maxResults": 3}}
    first, cursor = paging.search(catalog, request, limit=2)
    second, end = paging.search(catalog, request, limit=2, cursor=cursor)
    assert (len(first), len(second), end) == (2, 1, None)
    with pytest.raises(ValueError, match="CURSOR_QUERY_MISMATCH"):
        paging.search(catalog, {"expression": SHOT}, cursor=cursor)
    with pytest.raises(ValueError):
        paging.search(catalog, request, limit=201)


def test_candidates_state_reasons_of_the_spec(catalog):
    spec = all_specs(BIG, any_spec(SHOT, predicate("similarity.perceptual", "eq", {"field": "similar", "value": True})))
    rows = {r.id: r for r in candidates.cleanup_candidates(catalog, spec).collect()}
    assert rows["a"].reasons == ["screenshot", "similar", "large-media"]
    assert rows["a"].confidence == pytest.approx(0.8) and rows["a"].recoverable_bytes == 1500
    totals = {r.reason: (r.candidates, r.bytes) for r in candidates.reason_totals(candidates.cleanup_candidates(catalog, spec)).collect()}
    assert totals["similar"] == (1, 1500)


def test_registry_refuses_duplicates_and_prefers_priority():
    registry = Registry()
    registry.register_predicate("x.y", lambda f, v: F.lit(False) if v else None)
    registry.register_predicate("x.y", lambda f, v: F.lit(True), "better", priority=5)
    with pytest.raises(ValueError):
        registry.register_predicate("x.y", lambda f, v: None)
    registry.register_ranking("r", F.lit(1), True)
    with pytest.raises(ValueError):
        registry.register_ranking("r", F.lit(1), True)
    assert "true" in str(registry.predicate("x.y", None, 1))
    with pytest.raises(UnsupportedQuery):
        registry.ranking("missing")


def test_stored_specs_as_tables(spark):
    tree = all_specs(BIG, not_spec(SHOT), any_spec())
    rows = spark.createDataFrame([("s1", json.dumps(tree)), ("s2", "{broken"), ("s3", json.dumps(any_spec()))], "spec_id string, spec string")
    leaves = spec_tables.explode_predicates(rows).orderBy("spec_id", "position").collect()
    assert [(r.capability, r.negated, r.value) for r in leaves] == [
        ("metadata.core", False, "1000"),
        ("content.screenshot", True, "true"),
    ]
    limits = {r.spec_id: (r.nodes, r.depth) for r in spec_tables.spec_limits(rows).collect()}
    assert limits == {"s1": (5, 2), "s2": (None, None), "s3": (1, 0)}
    coverage = {r.spec_id: (r.available, r.status) for r in spec_tables.spec_coverage(rows).collect()}
    assert coverage == {"s1": (2, "complete"), "s2": (0, "unreadable"), "s3": (0, "complete")}


def test_selections(spark, catalog):
    requests = spark.createDataFrame(
        [("s", " Trip ", None, i) for i in ("a", "a", "b", "zz", "")] + [("t", "  ", None, "a"), ("u", "x" * 121, None, "a")],
        "selection_id string, name string, spec string, id string",
    )
    headers, members = selections.save_selections(requests, catalog.assets, 5)
    assert [(r.selection_id, r.name) for r in headers.collect()] == [("s", "Trip")]
    assert {r.id for r in members.collect()} == {"a", "b"}
    refused = {tuple(r) for r in selections.selection_rejects(requests).collect()}
    assert refused == {("t", "INVALID_NAME"), ("u", "INVALID_NAME")}
    wanted = spark.createDataFrame([("s",), ("nope",)], "selection_id string")
    left, left_members, report = selections.delete_selections(headers, members, wanted)
    assert left.count() == 0 and left_members.count() == 0
    assert {tuple(r) for r in report.collect()} == {("s", True), ("nope", False)}
