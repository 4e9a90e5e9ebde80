"""Keyset pages, caps, offsets and page numbers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import MAX_PAGE
from lumenlake.operators.specs import (
    EVERYTHING,
    Catalog,
    compile_spec,
    fingerprint,
    ranking_of,
    wide_catalog,
)
from lumenlake.plans.ordering import prefix_totals, row_numbers, rows_between
from lumenlake.registry import Ranking, Registry


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")
    return limit


def seek(ranking: Ranking, value: object, key_value: object, key: str = "id") -> Column:
    """Rows after a position of the order. Nulls come first in rising and last in falling order, as Spark sorts them."""
    sort, by_key = ranking.value, F.col(key)
    if ranking.descending:
        if value is None:
            return sort.isNull() & (by_key < key_value)
        return (sort < value) | sort.isNull() | ((sort == value) & (by_key < key_value))
    if value is None:
        return sort.isNotNull() | (by_key > key_value)
    return (sort > value) | ((sort == value) & (by_key > key_value))


def keyset_page(
    df: DataFrame, ranking: Ranking, limit: int, after: tuple | None = None, key: str = "id"
) -> DataFrame:
    """The next ``limit`` rows plus one that tells whether more follow, with their ``sort_value``."""
    rows = df if after is None else df.where(seek(ranking, *after, key=key))
    return rows.withColumn("sort_value", ranking.value).orderBy(*ranking.order(key)).limit(limit + 1)


#: Up to so many rows, the first ones of an order are kept by every task on the way; beyond, slices are counted first.
SHALLOW = 10_000


def max_results(df: DataFrame, ranking: Ranking, count: int, key: str = "id") -> DataFrame:
    """At most ``count`` rows over all pages of an order; a large count is cut from slices, by many tasks."""
    order = ranking.order(key)
    if count <= SHALLOW:
        return df.orderBy(*order).limit(count)
    return rows_between(df, order, 0, count).drop("position")


def offset_page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows of a total order after the first ``offset``, in order; see :func:`deep_page` for large offsets."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset + limit > SHALLOW:
        return deep_page(df, order, offset, limit).drop("position")
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page at any depth, with the position of its rows: only the slices that hold it are sorted."""
    return rows_between(df, order, offset, offset + limit).orderBy("position")


def export_pages(df: DataFrame, order: Sequence[Column], page_size: int) -> DataFrame:
    """Add the page number (from 1) and position of every row of the whole order.

    The order must be total. Many tasks sort their own range; see ``ordered_totals``.
    """
    numbered = row_numbers(df, order, "position")
    if page_size < 1:
        raise ValueError("page_size must be positive")
    page = F.ceil(F.col("position") / F.lit(page_size)).cast("bigint")
    return numbered.withColumn("page", page)


def recoverable_target(
    df: DataFrame, order: Sequence[Column], target_bytes: int, size: str = "file_size"
) -> DataFrame:
    """Smallest prefix of an order whose known sizes reach a target, with the running sum.

    An extension: requests can state such a target, but a page search does not act on it.
    """
    known = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    summed = prefix_totals(df, order, "running_bytes", known, target_bytes)
    return summed.where(F.col("running_bytes") - known < F.lit(target_bytes))


def search(
    catalog: Catalog,
    request: dict,
    limit: int = 50,
    cursor: str | None = None,
    registry: Registry | None = None,
) -> tuple[list, str | None]:
    """Run a request and return one page of rows and the next cursor.

    This is an action; it fetches at most ``limit`` + 1 rows. A cursor belongs
    to one request and is refused for any other.
    """
    check_limit(limit)
    identity = fingerprint(request)
    after, consumed = None, 0
    if cursor is not None:
        held = json.loads(cursor)
        if held["query"] != identity:
            raise ValueError("CURSOR_QUERY_MISMATCH")
        after, consumed = (held["value"], held["id"]), held["consumed"]
    most = (request.get("target") or {}).get("maxResults")
    size = limit if most is None else min(limit, max(0, most - consumed))
    spec = request.get("expression", EVERYTHING)
    strategy = (request.get("ranking") or {}).get("strategy", "newest")
    wide = wide_catalog(catalog, [spec], (strategy,)).where(compile_spec(spec, registry))
    if size == 0:
        return [], None
    rows = keyset_page(wide, ranking_of(request, registry), size, after)
    fetched = rows.select(*catalog.assets.columns, "sort_value").collect()
    if most is not None:
        fetched = fetched[: most - consumed]
    page = fetched[:size]
    if len(fetched) <= size or not page:
        return page, None
    last = page[-1]
    position = {"query": identity, "value": last.sort_value, "id": last.id, "consumed": consumed + len(page)}
    return page, json.dumps(position)


def intersect_sets(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def union_sets(*sets: DataFrame, key: str = "id") -> DataFrame:
    return reduce(DataFrame.unionByName, sets).dropDuplicates([key])


def subtract_sets(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")
