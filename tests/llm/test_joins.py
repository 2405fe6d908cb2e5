"""Operators that compare texts with others: near-dedup, repeats, decontamination, shards, BPE, pipeline."""

from __future__ import annotations

import collections
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.oracle_check import canonical, connect, same

from tapeloom.llm import bpe, components, decontam, neardup, quality, queries, shards, substrings

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def frame(spark, texts: dict):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def copies(seed: int = 1, groups: int = 12, size: int = 14) -> dict:
    """Groups of edited copies, from hardly to much changed, and texts that share long passages."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**5)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(40, 160))]
        for _ in range(size):
            edited = [word() if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            texts.append(" ".join(edited + (passage if r.random() < 0.3 else [])))
    r.shuffle(texts)
    return {3 * i + 1: t for i, t in enumerate(texts)}


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    texts = copies()
    got = neardup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()
    want = brute.near_components(texts, size, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(brute.shingles(texts[r.doc_id], size)) and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_split_lists_and_families_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_ROWS", 4)
    monkeypatch.setattr(neardup, "FAMILY_SHINGLES", 500)
    texts = copies(seed=3, groups=3, size=40)
    got = neardup.near_duplicates(frame(spark, texts), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(texts, 3, 85)


@pytest.mark.parametrize(("size", "percent", "family"), [(3, 85, 300), (5, 80, 150), (3, 100, 200)])
def test_large_families_are_dealt_by_size_and_lose_no_link(spark, monkeypatch, size, percent, family):
    monkeypatch.setattr(neardup, "FAMILY_SHINGLES", family)
    r = random.Random(9)
    base = [f"w{r.randrange(10**5)}" for _ in range(400)]
    texts = {i: " ".join(base[: 40 + 3 * i]) for i in range(120)}  # each contains the ones before it: links only between neighbours in size
    texts |= {200 + i: texts[i] for i in range(0, 120, 7)}
    got = neardup.near_duplicates(frame(spark, texts), shingle=size, percent=percent).collect()
    assert {x.doc_id: x.component_id for x in got} == brute.near_components(texts, size, percent)


def test_filters_of_any_size_lose_nothing(spark, monkeypatch):
    for least in (6, 28):
        monkeypatch.setattr(neardup, "FILTER_BITS", least)
        monkeypatch.setattr(decontam, "FILTER_BITS", least)
        monkeypatch.setattr(neardup, "filter_bits", lambda n, bits: bits)
        monkeypatch.setattr(decontam, "filter_bits", lambda n, bits: bits)
        texts = copies(seed=4, groups=4, size=8)
        got = neardup.near_duplicates(frame(spark, texts), shingle=3, percent=85).collect()
        assert {x.doc_id: x.component_id for x in got} == brute.near_components(texts, 3, 85)
        words = [t.split() for t in texts.values()]
        items = frame(spark, {i: " ".join(w[5:25]) for i, w in enumerate(words[::5])}).withColumnRenamed("doc_id", "item_id")
        found = {x.doc_id: x.n_hit for x in decontam.contamination(frame(spark, texts), items).collect()}
        assert all(found[i] >= 20 for i in list(texts)[::5])


def test_columns_named_like_keys_stay(spark):
    names = ["row_key", "_row_key", "first_key", "hit_key", "own_key", "key", "id"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["one two three four five six"] * 2 + ["seven eight nine ten eleven twelve", None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, "seven eight nine ten eleven twelve")], "item_id bigint, text string")
    kept = neardup.keep_one(docs, shingle=3, percent=85)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[2], rows[3]])
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted([rows[0], rows[1], rows[3]])


def test_near_duplicates_of_odd_rows(odd, odd_texts, nothing):
    got = neardup.near_duplicates(odd, shingle=3, percent=85).collect()
    want = brute.near_components(odd_texts, 3, 85)
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(brute.shingles(odd_texts[r.doc_id], 3)))
    assert all(r.kept for r in got if r.doc_id is None)
    kept = neardup.keep_one(odd, shingle=3, percent=85)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
    assert neardup.near_duplicates(nothing).count() == 0


def test_rows_without_or_with_shared_ids_are_judged_for_themselves(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    a, b, c, d, hit = (" ".join(word() for _ in range(60)) for _ in range(5))
    rows = [(5, a), (None, a), (5, a), (3, a), (3, b), (None, c), (None, c), (7, d), (8, d + " x"), (9, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    kept = sorted(map(tuple, neardup.keep_one(docs, shingle=3, percent=85).collect()), key=key)
    assert kept == sorted([(3, a), (3, b), (None, c), (7, d), (9, None), (None, None), (None, "")], key=key)
    items = spark.createDataFrame([(1, hit)], "item_id bigint, text string")
    rows = [(None, f"x {hit} y"), (None, a), (1, b), (1, hit), (2, hit), (2, hit), (4, c), (4, c), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(map(tuple, decontam.drop_contaminated(docs, items).collect()), key=key)
    assert kept == sorted([(None, a), (1, b), (4, c), (4, c), (6, None)], key=key)


def passages(seed: int = 5) -> dict:
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("abcdefgé \n") for _ in range(n))
    shared = [letters(n) for n in (380, 400, 401, 420, 500, 700, 1500)]
    texts = {}
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(shared) if r.random() < 0.5 else letters(r.randint(1, 300))
            parts.append(p[r.randrange(40) : len(p) - r.randrange(40)] if r.random() < 0.5 else p)
        texts[i] = "".join(parts)
    return texts | {1000: None, 1001: "", 1002: "ab" * 900, 1003: "x" * 399, 1004: "x" * 400, 1005: "y" * 400, 1006: "y" * 401}


@pytest.mark.parametrize("bucket", [8192, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    monkeypatch.setattr(substrings, "PIECE", 1 << 20 if bucket > 3 else 1500)
    texts = passages()
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(frame(spark, texts)).collect()}
    assert got == dict(zip(texts, brute.repeats([(t or "").encode() for t in texts.values()]), strict=True))


def test_repeats_of_odd_rows(spark, odd, odd_texts, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id not in (6, 7)]
    small = odd.where("doc_id is null or doc_id not in (6, 7)")
    want = brute.repeats([(t or "").encode() for _, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = substrings.remove_repeats(small).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    long = {r.doc_id: r for r in substrings.remove_repeats(odd).where("doc_id in (6, 7)").collect()}
    assert long[6].n_removed == long[6].n_bytes and long[7].n_removed == long[6].n_bytes
    assert substrings.remove_repeats(nothing).count() == 0


def test_a_phrase_repeated_for_a_long_way_is_sent_on_once_a_chunk(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    line = " ".join(word() for _ in range(8)) + "\n"
    texts = {i: word() + " " + line * r.randrange(40, 80) + " ".join(word() for _ in range(9)) for i in range(30)}
    texts |= {i: " ".join(word() for _ in range(120)) + line * (i % 3 * 9) for i in range(30, 36)}
    docs = frame(spark, texts)
    offered = substrings._anchor_rows(docs.selectExpr("doc_id as key", "text").coalesce(1)).where("gram is not null")
    assert offered.groupBy("gram", "context").count().where("count > 1").count() == 0
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    assert got == dict(zip(texts, brute.repeats([t.encode() for t in texts.values()]), strict=True))


def test_decontamination_equals_sql(spark):
    got = queries.op7_benchmark_decontamination(spark, "/root/testdata/sf0.01").toPandas()
    want = connect("/root/testdata/sf0.01").execute(queries.SQL["op7_benchmark_decontamination"]).df()
    ok, why = same(canonical(got), canonical(want))
    assert ok, why


def test_decontamination_of_odd_rows_and_short_items(spark, odd, odd_texts, nothing):
    items = [
        (3, "one"), (10, "ONE, two!"), (2, None), (4, "..."), (None, "one"), (7, " ".join(odd_texts[8].split()[40:70])),
        (8, " ".join(odd_texts[8].split()[40:70])), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (6, "a b a b a b a b a b a"),
    ]
    table = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id bigint, text string, words string")
    windows = brute.item_windows([x for x in items if x[0] is not None])
    got = decontam.contamination(odd, table).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"]) == brute.contamination(odd_texts[r.doc_id], windows)
    kept = decontam.drop_contaminated(odd, table)
    assert kept.columns == odd.columns
    clean = {i for i, t in odd_texts.items() if not brute.contamination(t, windows)[1]}
    assert {r.doc_id for r in kept.collect()} == clean | {None}
    assert decontam.contamination(nothing, table).count() == 0
    assert {r.n_hit for r in decontam.contamination(odd, table.where("false")).collect()} == {0}


def test_items_without_id_count_as_hits_as_in_sql(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join(words[:12])), (2, " ".join(words[20:35])), (3, "nothing of it"), (4, " ".join(words))]
    items = [(None, " ".join(words[:11])), (None, " ".join(words[1:12])), (7, " ".join(words[20:30]))]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op7_benchmark_decontamination(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ok, why = same(canonical(got), canonical(con.execute(queries.SQL["op7_benchmark_decontamination"]).df()))
    assert ok, why
    assert dict(zip(got.doc_id, got.n_hit, strict=True)) == {1: 12, 2: 10, 3: 0, 4: 22}
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = decontam.drop_contaminated(table, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert [r.doc_id for r in kept.collect()] == [3]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 65537])
def test_permutation_is_one_to_one(n):
    slots = shards.Permutation(n, 99)(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 17 or (slots != shards.Permutation(n, 100)(np.arange(n))).any()


def test_shards_hold_every_sequence_and_resume(odd, tmp_path):
    texts = [r.text for r in odd.select("text").collect()]
    ordered = shards.in_training_order(odd, RANKS, public_tokenizers.PATTERN, key=1, end_id=50256, length=128)
    shards.write_shards(ordered, str(tmp_path / "shards"), per_shard=50)
    table = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    rows = sorted((r.slot, bytes(r.ids)) for r in shards.read_slots(table, 0, per_shard=50).collect())
    assert [s for s, _ in rows] == list(range(len(rows)))
    want = collections.Counter()
    for t in texts:
        ids = CODER.encode_ordinary(t or "")
        ids += [50256] * (128 - len(ids) % 128)
        want.update(np.array(ids[i : i + 128], np.uint16).tobytes() for i in range(0, len(ids), 128))
    assert want == collections.Counter(data for _, data in rows)
    later = sorted((r.slot, bytes(r.ids)) for r in shards.read_slots(table, 333, per_shard=50).collect())
    assert later == rows[333:]
    assert {r.stride for r in table.collect()} == {256}
    # ids before the padding: each text's own and one end id, the rest of a sequence is end ids
    real = [(r.n_ids, np.frombuffer(bytes(r.ids), np.uint16)) for r in shards.read_slots(table, 0, per_shard=50).collect()]
    assert sum(n for n, _ in real) == sum(len(CODER.encode_ordinary(t or "")) + 1 for t in texts)
    assert all(1 <= n <= 128 and (ids[n:] == 50256).all() for n, ids in real)


def test_shards_of_no_rows(nothing):
    ordered = shards.in_training_order(nothing, RANKS, public_tokenizers.PATTERN, key=1, end_id=50256)
    assert shards.shards(ordered).count() == 0


def test_encoding_equals_the_library(odd, odd_texts, nothing, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 2000)
    got = bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            text = odd_texts[r.doc_id] or ""
            ids = CODER.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
    assert bpe.encode_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_decoding_gives_the_texts_back(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 2000)
    encoded = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    got = collections.Counter((r.doc_id, r.text, bytes(r.data)) for r in bpe.decode(encoded, RANKS).collect())
    rows = odd.select("doc_id", "text").collect()
    assert got == collections.Counter((r.doc_id, r.text or "", (r.text or "").encode()) for r in rows)
    assert bpe.decode(bpe.encode_documents(nothing, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    half = next(i for t, i in RANKS.items() if t == b"\xc3")
    cut = spark.createDataFrame([(1, np.array([half], "<i4").tobytes()), (2, None), (3, b"")], "doc_id bigint, ids binary")
    assert {r.doc_id: (r.data, r.text) for r in bpe.decode(cut, RANKS).collect()} == {1: (b"\xc3", None), 2: (None, None), 3: (b"", "")}
    with pytest.raises(ValueError, match="no token"):
        bpe.decoded(np.array([-1], "<i4").tobytes(), bpe.token_table(RANKS))


def test_digests_are_taken_from_the_assembled_ids():
    pieces = [np.array([CODER.encode_ordinary(w)[0]]) for w in (" the", " of")]
    make, _ = bpe._digest_row(pieces, bpe.token_table(RANKS))
    assert make(np.array([1, 0, 1]))[2] == brute.sha(b"".join(CODER.decode_single_token_bytes(int(pieces[k][0])) for k in (1, 0, 1)))


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    root = brute.near_components(texts, 5, 80)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    windows = brute.item_windows(items)
    left = {i: brute.redacted(t) for i, t in texts.items() if root[i] == i and not brute.contamination(t, windows)[1]}
    got = {r.doc_id: np.frombuffer(r.ids, np.int32).tolist() for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: CODER.encode_ordinary(t) for i, t in left.items()}
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
