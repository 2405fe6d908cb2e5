"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    bpe, decontam, html_text, neardup, negatives, quality, rules, secret_scan, shards, substrings, token_count, urls,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.find(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
with cut as (
    select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages),
parts as (
    select page_id, url,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        '^^' || regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
            'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0/.:?=&#_%-]', '~', 'g') || '$' as signs
    from cut),
rules(action, site, start) as (values
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled as (
    select row_number() over () as id, p.*, r.rule, r.action
    from parts p left join lateral (
        select site || start as rule, action from rules
        where (p.host = site or ends_with(p.host, '.' || site)) and starts_with(p.path, start)
        order by length(site || start) desc limit 1) r on true),
grams as (
    select id, action, substr(signs, i, 3) as gram
    from (select id, action, signs, unnest(range(1, length(signs) - 1)) as i from ruled)),
counts as (
    select gram, cast(count(*) filter (action = 'allow') as double) as a, cast(count(*) filter (action = 'block') as double) as b
    from grams group by gram),
sums as (
    select gram, a, b,
        (sum(a) over (partition by substr(gram, 3, 1)) + 1) / (sum(a) over () + 40) as a0,
        (sum(b) over (partition by substr(gram, 3, 1)) + 1) / (sum(b) over () + 40) as b0,
        sum(a) over (partition by substr(gram, 2, 2)) as a2, sum(a) over (partition by substr(gram, 2, 1)) as a1,
        sum(b) over (partition by substr(gram, 2, 2)) as b2, sum(b) over (partition by substr(gram, 2, 1)) as b1,
        sum(a) over (partition by substr(gram, 1, 2)) as actx, sum(b) over (partition by substr(gram, 1, 2)) as bctx
    from counts),
ratios as (
    select gram, ln((a + 5 * (a2 + 5 * a0) / (a1 + 5)) / (actx + 5)) - ln((b + 5 * (b2 + 5 * b0) / (b1 + 5)) / (bctx + 5)) as ratio
    from sums),
scored as (select id, avg(ratio) as score from grams join ratios using (gram) group by id),
bins as (
    select least(greatest(cast(floor(score * 50) as bigint), -500), 500) as bin,
        count(*) filter (action = 'allow') as a, count(*) filter (action = 'block') as b
    from scored join ruled using (id) where action is not null group by 1),
errors as (
    select bin, coalesce(sum(a) over w / greatest(sum(a) over (), 1), 0) - coalesce(sum(b) over w / greatest(sum(b) over (), 1), 0) as error
    from bins window w as (order by bin rows between unbounded preceding and 1 preceding)),
best as (select bin from errors order by round(error, 9), bin limit 1)
select page_id, host, path, rule,
    coalesce(action, case when score >= coalesce((select bin from best), 0) / 50e0 then 'allow' else 'block' end) as verdict
from ruled join scored using (id)
"""


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"))


def op6_training_order_shards(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, folder, "documents")
    ordered = shards.in_training_order(docs, ranks, public_tokenizers.PATTERN, key=20240229, end_id=50256)
    return shards.shards(ordered)


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
items as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
sizes as (select distinct least(10, len(w)) as size from items where len(w) > 0),
windows as (
    select item_id, size, array_to_string(w[i:i + size - 1], ' ') as words
    from (select item_id, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
          from items where len(w) > 0)),
places as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as words
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
found as (select p.doc_id, p.i, p.size, x.item_id from places p join windows x using (size, words)),
hits as (
    select doc_id, count(distinct pos) as n_hit
    from (select doc_id, unnest(range(i, i + size)) as pos from found) group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
    from (select distinct doc_id, item_id from found) group by doc_id)
select docs.doc_id, cast(len(docs.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(table(spark, folder, "documents"), vocabulary_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, folder, "embeddings"), anchor=vec_id % 50 == 0, label=shifted)


OP11_SQL = r"""
with whole as (
    select row_number() over () as id, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: floor(256 * cast(c as double))) as q
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
scored as (
    select a.id as anchor, a.vec_id as anchor_id, r.id, r.vec_id, a.label = r.label as same,
        cast(list_dot_product(a.q, r.q) as bigint) as score
    from whole a join whole r on a.vec_id % 50 = 0 and a.id <> r.id),
positives as (
    select anchor, anchor_id, id as positive, vec_id as positive_id, score as positive_score
    from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id, id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s using (anchor, anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor, positive order by score desc, vec_id, id)
qualify row_number() over w <= 3
"""


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


_ALL = [
    op1_quality_classifier, op2_secret_scans, op3_url_filters, op4_minhash_near_dedup, op5_suffix_array_dedup,
    op6_training_order_shards, op7_benchmark_decontamination, op8_token_counts, op9_quality_rules, op10_byte_bpe,
    op11_hard_negatives, op12_embedding_whitening, op13_html_extraction,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op3_url_filters": OP3_SQL, "op7_benchmark_decontamination": OP7_SQL, "op11_hard_negatives": OP11_SQL}
