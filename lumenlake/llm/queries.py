"""Registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlake.llm import (
    byte_pairs,
    conversations,
    decontamination,
    filter_audit,
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
from lumenlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under the function's name."""
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a window of a document with a smaller id."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


SQL["op6_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (
    select doc_id, i, array_to_string(ws[i : i + 12], ' ') k
    from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w where len(ws) >= 13)
),
least as (select k, min(doc_id) m from win group by k),
gone as (
    select distinct doc_id, i + o pos
    from (select doc_id, i from win join least using (k) where doc_id > m), range(13) r(o)
),
kept as (
    select doc_id, string_agg(word, ' ' order by pos) text, count(*) n
    from (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) pos from w) anti join gone using (doc_id, pos)
    group by doc_id
)
select w.doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed,
    sha256(coalesce(kept.text, '')) kept_sha256
from w left join kept using (doc_id)
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, and its source's target."""
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL["op3_mixing"] = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
        md5(coalesce(doc_id::varchar, '') || ':0') turn
    from documents
),
s as (
    select *, 1 + (rank - 1) % 3 weight, 3 * source_size cap
    from (select *, row_number() over (order by encode(source) nulls last) rank from (select source, sum(size)::bigint source_size from d group by source))
),
l as (
    select *, ((sum(source_size) over () - coalesce(sum(cap) over filled, 0))
        / (sum(weight) over () - coalesce(sum(weight) over filled, 0)))::double lev
    from s window filled as (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)
),
t as (
    select source, rank, source_size, weight,
        least(cap::double, weight * (select lev from l where lev < cap / weight order by cap / weight limit 1)) target
    from l
),
q as (
    select row_number() over () row, d.*, rank, source_size, target,
        sum(size) over (partition by d.source order by turn, doc_id rows unbounded preceding) - size before
    from d join t on d.source is not distinct from t.source
),
r as (
    select *, before + k * source_size start, least(size, floor(target)::bigint - before - k * source_size) inside
    from q, range(3) r(k) where size > 0 and before + k * source_size < target
),
e as (
    select row, rank, start first, inside length, target from r where inside > 0
    union all
    select row, rank, start + inside, size - inside, target from r where size > inside
),
c as (select *, sum(length) over (order by (first + length) / target, rank, first rows unbounded preceding) served from e),
f as (select row, sum(least(length, (select sum(size) from d) - served + length)) taken from c
    where (select sum(size) from d) - served + length > 0 group by row)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from q left join f using (row)
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix of all documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the class-based model and the unigram base."""
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its lines."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return conversations.trie(table(spark, sf_dir, "conversations"))


# The unsigned CRC-32 of an id's digits, by a table of 256 remainders.
SQL["op11_prefix_trie"] = r"""
with recursive bits as (
    select i, 0 k, i::ubigint v from range(256) t(i)
    union all
    select i, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from bits where k < 8
),
crc as (select list(v order by i) t from bits where k = 8),
turns as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, id) pos, id, words
    from (
        select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) id,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) words
        from conversations where conv_id is not null
    )
),
convs as (
    select conv_id, conv_id - conv_id % 20 base, (xor(list_reduce(
        list_concat([4294967295::ubigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::ubigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint) % 4)::bigint h
    from (select distinct conv_id from turns), crc
),
built as (
    select conv_id, row_number() over (partition by conv_id order by own, pos) pos, id, words
    from (
        select c.conv_id, 0 own, t.pos, t.id, t.words from convs c join turns t on t.conv_id = c.base where t.pos <= h
        union all
        select c.conv_id, 1, t.pos, t.id, t.words from convs c join turns t on t.conv_id = c.conv_id where t.pos > h
    )
),
paths as (
    select conv_id, pos depth, words, string_agg(id, '') over (partition by conv_id order by pos) path from built
    union all
    select conv_id, 0, 0, '' from convs
),
last as (select conv_id, max(depth) depth from paths group by conv_id),
node as (select depth, path, min(conv_id) conv_id, count(*) n, any_value(words) words from paths group by depth, path),
kids as (select left(path, 32 * (depth::int - 1)) path, count(*) n from node where depth > 0 group by 1),
below as (
    select left(path, 32 * up::int) path, sum((n - 1) * words) saved, count(*) filter (leaf) leaves
    from (
        select node.*, kids.path is null leaf, unnest(range(0, node.depth + 1)) up from node left join kids using (path)
    )
    group by 1
),
ends as (
    select path, string_agg(conv_id::varchar, ',' order by conv_id) ids from paths join last using (conv_id, depth) group by path
)
select node.conv_id, node.depth::bigint depth, up.conv_id parent_conv_id, node.n::bigint n_convs,
    coalesce(kids.n, 0)::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens,
    sha256(coalesce(ids, '')) ends_sha256
from node left join kids using (path) join below using (path) left join ends using (path)
    left join node up on up.path = left(node.path, 32 * (node.depth::int - 1)) and node.depth > 0
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
with labelled as (
    select doc_id, max(coalesce((quality = 1)::int, 0)) good, max(coalesce((toxic = 1)::int, 0)) toxic from labels group by doc_id
),
docs as (
    select coalesce(lang, '') part, coalesce(text, '') text, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
        coalesce(d.doc_id > min(d.doc_id) over (partition by coalesce(text, '')), false) repeated
    from documents d left join labelled using (doc_id)
),
masks as (
    select part, good, toxic,
        case when len(ws) < 200 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
        || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) then 'C' else '' end
        || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when repeated then 'E' else '' end fails
    from (select *, regexp_extract_all(text, '[^ 	-
]+') ws from docs)
),
counted as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from masks group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (
    select a.l || b.l || c.l || d.l || e.l o
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps as (
    select part, o filter_order, step, substr(o, step, 1) f,
        sum(n) filter (translate(fails, substr(o, 1, step), '') = fails) kept,
        sum(n) filter (contains(fails, f) and translate(fails, substr(o, 1, step - 1), '') = fails) removed,
        sum(n) filter (contains(fails, f)) failing, sum(n) filter (fails = f) unique_fails,
        sum(good) filter (contains(fails, f) and translate(fails, substr(o, 1, step - 1), '') = fails) good_lost,
        sum(toxic) filter (contains(fails, f) and translate(fails, substr(o, 1, step - 1), '') = fails) toxic_lost
    from counted, orders, (select unnest([1, 2, 3, 4, 5]) step)
    group by part, o, step
)
select part, filter_order, step::int step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed,
    (coalesce(failing, 0) - coalesce(removed, 0))::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
    coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
    (sum(coalesce(removed, 0)) over (partition by part, f))::bigint shapley
from steps
"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_pairs.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
