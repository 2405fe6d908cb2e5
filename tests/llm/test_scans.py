"""Operators that judge each text: classifier, secrets, URLs, token counts, rules."""

from __future__ import annotations

import random
import string

import numpy as np
import public_tokenizers
import pytest
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.oracle_check import canonical, connect, same
from tokenizers import Tokenizer

from tapeloom.llm import quality, queries, rules, secret_scan, token_count, urls

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_quality_reaches_held_out_accuracy(spark):
    got = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.quality == held.predicted).mean() >= 0.97


def test_isotonic_equals_least_squares_blocks():
    r = np.random.default_rng(3)
    total, good = r.integers(1, 9, 40).astype(float), r.random(40)
    knots, values = quality.isotonic(np.arange(40.0), total, good * total)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    # min-max formula of isotonic regression
    mean = lambda i, j: (good[i : j + 1] * total[i : j + 1]).sum() / total[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(sorted(set(np.round(want, 9))), values)


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, 1), (None, 1), (11, None)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(odd, model).columns == odd.columns
    blank = quality.fit(odd, labels.where("false"))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}
    assert quality.score(nothing, quality.fit(nothing, labels)).count() == 0


def test_secrets_equal_brute_force(small, small_texts, odd, odd_texts):
    for docs, texts in ((small, small_texts), (odd, odd_texts)):
        models = secret_scan.train(docs)
        for r in secret_scan.find(docs, models).where("doc_id is not null").collect():
            spans = brute.base_secrets(texts[r.doc_id])
            assert r.base_sha256 == brute.sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans))
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_models_find_random_strings_and_leave_words(spark, small):
    models = secret_scan.train(small)
    r = random.Random(4)
    key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    plain = ["thatbleheringtionhandthereandwith", "=" * 60, "z" * 50, "aber-nicht-der-andere-und-mit-von"]
    docs = spark.createDataFrame([(0, f"é {key} end"), *[(i + 1, t) for i, t in enumerate(plain)]], "doc_id bigint, text string")
    got = {x.doc_id: x.spans for x in secret_scan.find(docs, models).collect()}
    assert got == {0: "random:2:42", **{i + 1: "" for i in range(len(plain))}}
    assert secret_scan.redact(docs, models).where("doc_id = 0").first().text == "é [SECRET] end"


def test_models_find_random_parts_of_runs(spark, small):
    models = secret_scan.train(small)
    r = random.Random(5)
    key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts, secrets = [], []
    for _ in range(20):
        long, short, tail, last, both = key(32), key(24), key(40), key(32), key(40)
        texts += [
            f"é private_key={long} end", f"client_key_for_service={short} x", f"path/words/and/{last}",
            f"AKIA{'Q7' * 8}/{tail} x", f"{'0123456789ab' * 2}-{tail}", f"{both}/ordinary/words/and/others/{tail}",
        ]
        secrets += [[long], [short], [last], [tail], [tail], [both, tail]]
    plain = ["aber-nicht-der-andere-und-mit-von", "path/words/and/others/and/the/rest", "=" * 30 + "AKIA" + "Q7" * 8]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in secret_scan.redact(docs, models).collect()}
    left = [s for i, own in enumerate(secrets) for s in own if any(s[k : k + 8] in got[i] for k in range(len(s) - 7))]
    assert len(left) <= 2 and not any("AKIA" in t or "0123456789ab" in t for t in got.values())
    assert [got[len(texts) + i] for i in range(3)] == [plain[0], plain[1], "=" * 30 + "[SECRET]"]


@pytest.mark.parametrize("each", [1, 40])
def test_models_find_random_strings_where_they_are_frequent(spark, small_texts, each):
    r = random.Random(6)
    base64 = string.ascii_letters + string.digits + "+/"
    secrets, rows = {}, []
    for i, t in small_texts.items():
        own = ["".join(r.choice(base64) for _ in range(40)) for _ in range(each if i % 3 == 0 else 0)]
        hexes = " ".join("".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(5))
        secrets[i] = own
        rows.append((i, " ".join([t or "", hexes, *own])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in secret_scan.redact(docs, secret_scan.train(docs)).collect()}
    left = sum(s in got[i] for i, own in secrets.items() for s in own)
    assert left <= 0.02 * sum(map(len, secrets.values()))
    assert all(got[i] == " ".join([brute.redacted(small_texts[i] or ""), *["[SECRET]"] * 5]) for i, own in secrets.items() if not own)


def test_names_of_keys_and_words_as_values_teach_no_random_string(spark):
    r = random.Random(7)
    key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    words = ["summer", "holiday", "garden", "window", "paper", "river", "mountain", "orange"]
    rows = [f"the {r.choice(words)} of the {r.choice(words)} password={key(16)} and api_key: {key(24)} token={'-'.join(r.sample(words, 3))}" for _ in range(400)]
    models = secret_scan.train(spark.createDataFrame([(t,) for t in rows], "text string"))
    plain = ["password_password_password", "api_key_token_password_secret", "summer-holiday-garden-window-paper"]
    secrets = [key(32) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*plain, *[f"private_key={s}" for s in secrets]])), "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in secret_scan.redact(docs, models).collect()}
    assert [got[i] for i in range(len(plain))] == plain
    assert sum(s in got[len(plain) + i] for i, s in enumerate(secrets)) == 0


def brute_stretches(ratio, text: str, threshold: float) -> list[tuple[int, int]]:
    """Random parts of a run, one by one: all of it, or the best stretch widened to separators, then what is left."""
    code = lambda c: secret_scan.LETTERS.decode().index(c) if c in secret_scan.LETTERS.decode() else secret_scan.SIZE - 1
    size, out, rest = secret_scan.SIZE, [], [(0, len(text))]
    padded = [size - 1, size - 1, *[code(c) for c in text]]
    over = [float(ratio[(padded[i] * size + padded[i + 1]) * size + padded[i + 2]]) - threshold for i in range(len(text))]
    while rest:
        a, b = rest.pop()
        if b - a < secret_scan.MIN_RUN:
            continue
        if sum(over[a:b]) > 0:
            out.append((a, b))
            continue
        best = max(((sum(over[i:j]), -j, -i) for i in range(a, b) for j in range(i + secret_scan.MIN_RUN, b + 1)))
        if best[0] <= 0:
            continue
        low, high = -best[2], -best[1]
        while low > a and text[low - 1] not in "=/_-":
            low -= 1
        while high < b and text[high] not in "=/_-":
            high += 1
        out.append((low, high))
        rest += [(a, low), (high, b)]
    return sorted(s for s in out if len(set(text[s[0] : s[1]])) >= secret_scan.MIN_DISTINCT)


def test_added_spans_equal_brute_force(spark, small):
    models = secret_scan.train(small)
    r = random.Random(8)
    letters = string.ascii_letters + string.digits
    parts = lambda: r.choice([lambda: "".join(r.choice(letters) for _ in range(r.randrange(5, 45))), lambda: "ordinary", lambda: "thehering", lambda: "Q7" * 5])()
    runs = ["".join(parts() + r.choice(["", "=", "/", "_", "-"]) for _ in range(r.randrange(1, 6))) for _ in range(150)]
    runs = [t for t in runs if not brute.base_secrets(t)]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id bigint, text string")
    got = {x.doc_id: x.spans for x in secret_scan.find(docs, models).collect()}
    for i, t in enumerate(runs):
        want = brute_stretches(models.ratio, t, secret_scan.THRESHOLD) if len(t) >= secret_scan.MIN_RUN else []
        assert got[i] == ",".join(f"random:{a}:{b}" for a, b in want), t
    assert sum(bool(s) for s in got.values()) > 40


def test_secrets_of_no_rows_and_redaction(odd, odd_texts, nothing):
    models = secret_scan.train(nothing)
    assert secret_scan.find(nothing, models).count() == 0
    got = secret_scan.redact(odd, models)
    assert got.columns == odd.columns
    for r in got.where("doc_id is not null").collect():
        text = odd_texts[r.doc_id]
        assert r.text == (None if text is None else brute.redacted(text))


def test_urls_equal_sql(spark):
    got = queries.op3_url_filters(spark, "/root/testdata/sf0.01").toPandas()
    want = connect("/root/testdata/sf0.01").execute(queries.SQL["op3_url_filters"]).df()
    ok, why = same(canonical(got), canonical(want))
    assert ok, why


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("https://WWW.Example.org/es/x?q#f", "www.example.org", "/es/x", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ("http://a.org", "a.org", "", None), ("x://a.com/fr/?", "a.com", "/fr/", "com/fr/"),
    ("http://a.net/b://c", "a.net", "/b://c", None), ("no scheme", "", "", None), (None, "", "", None), ("://?x", "", "", None),
])
def test_url_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, 0.0)], "page_id bigint, url string, ratio double")
    got = urls.judge(pages).first()
    assert (got.host, got.path, got.rule) == (host, path, rule) and got.verdict in ("allow", "block")


def test_urls_repeated_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/b")] * 3 + [(None, "http://x.com/de/1")], "page_id bigint, url string")
    got = sorted((r.page_id or 0, r.verdict) for r in urls.judge(pages).collect())
    assert got == [(0, "block"), (1, "allow"), (1, "allow"), (1, "allow")]
    assert urls.judge(pages.where("false")).count() == 0


def test_token_counts_equal_the_library(small, small_texts, odd, odd_texts, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    for docs, texts in ((small, small_texts), (odd, odd_texts)):
        for r in token_count.token_counts(docs, VOCABULARY).where("doc_id is not null").collect():
            text = texts[r.doc_id] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_count.token_counts(nothing, VOCABULARY).count() == 0


def test_token_counts_of_random_strings():
    library, vocabulary = Tokenizer.from_file(VOCABULARY), token_count.read_vocabulary(VOCABULARY)
    r = random.Random(9)
    words = ["".join(r.choice("aabcdeéß中") for _ in range(r.randint(1, 40))) for _ in range(500)] + ["a" * 999, "ab" * 500]
    got = token_count.merge_counts(words, vocabulary).tolist()
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_special_strings_are_one_token(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["<|endoftext|>", "a<|startoftext|><|endoftext|> b", "<|ENDOFTEXT|>", "Σ ΑΣ ǅ İ ﬁ e\u0301"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in token_count.token_counts(docs, VOCABULARY).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_rules_equal_brute_force(small, small_texts, odd, odd_texts, nothing):
    for docs, texts in ((small, small_texts), (odd, odd_texts)):
        for r in rules.quality_rules(docs).where("doc_id is not null").collect():
            counts = brute.rule_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
            whole, fits, n, out = brute_bands(texts[r.doc_id])
            assert (r.base_failed, r.ratio, r.kept) == (failed, whole, not failed and fits and 2 * out <= n)
    assert rules.quality_rules(nothing).count() == 0


def brute_bands(text):
    import zstandard

    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)

    def inside(b):
        low, high = [(x, y) for least, x, y in rules.BANDS if len(b) >= least][-1]
        return low <= ratio(b) <= high

    data = (text or "").encode()
    if not data:
        return 1.0, True, 0, 0
    parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    return ratio(data), inside(data), len(parts), sum(not inside(p) for p in parts)


def test_bands_reject_repetition_and_noise(spark):
    r = random.Random(2)
    noise = " ".join("".join(r.choice(string.ascii_letters + string.digits) for _ in range(12)) for _ in range(500))
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(150)]
    prose = " ".join(r.choice(words) for _ in range(500))
    copied = " ".join(f"{a}{b}" for a in words[:25] for b in ("x", "y")) + " "
    docs = spark.createDataFrame([(0, noise), (1, prose), (2, copied * 12)], "doc_id bigint, text string")
    assert {x.doc_id: x.kept for x in rules.quality_rules(docs).collect()} == {0: False, 1: True, 2: False}


def test_small_tables_run(spark):
    for name in ("op2_secret_scans", "op8_token_counts", "op9_quality_rules"):
        assert queries.QUERIES[name](spark, SMALL).count() == 200
