"""Corpus operators against plain versions on small hand-made tables: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing extra columns."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinops.llm import (
    block_dedup,
    embedding_dedup,
    fair_mix,
    html_extract,
    length_buckets,
    ngram_join,
    quality_cascade,
    suffix_dedup,
    textops,
    token_orc,
    toxicity_crf,
)
from clinops.llm.common import even_bin, shuffled
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, texts, extra="", values=(), ids=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i],
                     len(t or ""), *values))
    return spark.createDataFrame(rows, DOC + extra)


def corpus(n=60, seed=1):
    """Random words with exact copies, near copies, shared passages, periodic and long texts."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["é" * k for k in range(1, 6)]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = make(70), make(30)
    texts = [None, "", "   ", "one two", "a" * 700, "ab " * 300, "x\ny\n" * 120]
    for _ in range(n):
        t = make(rng.choice([3, 40, 120, 200]))
        if rng.random() < 0.3:
            t += " " + passage + " " + make(20)
        if rng.random() < 0.3:
            t = line + "\n" + t
        texts.append(t)
    base = make(150).split(" ")
    for _ in range(12):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[20]] * 3 + [texts[25]] * 2 + [make(6000)]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_word_bounds_match_the_pattern(texts):
    import pyarrow as pa

    for a, b, buf, offs in textops.text_chunks(pa.array(texts)):
        starts, ends, first = textops.word_bounds(buf, offs)
        for r in range(b - a):
            got = [bytes(buf[s:e]).decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])]
            assert got == brute.words(texts[a + r])


def test_suffix_dedup(spark, texts):
    out = suffix_dedup.drop_repeats(frame(spark, texts)).collect()
    want = brute.suffix(list(enumerate(texts)), suffix_dedup.WIDTH)
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want
    assert any(v[1] for v in want.values())


@pytest.mark.parametrize("block, grouped", [(9500, 0), (4000, 1)])
def test_suffix_dedup_never_sorts_a_large_bucket(spark, monkeypatch, block, grouped):
    """A passage that many texts hold between different neighbours: its edges share a bucket in every text.  The third
    cut makes them small enough to sort, or their strings are grouped by their bytes."""
    rng = random.Random(5)
    make = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = make(400)
    texts = [make(150) + passage + make(150) for _ in range(40)] + [make(500), None]
    sizes, sort = [], suffix_dedup.sorted_spans

    def watched(fine, width):
        sizes.append(fine.groupBy("key").agg(F.sum(F.col("n") + width).alias("b")).agg(F.max("b")).first()[0] or 0)
        return sort(fine, width)

    cuts, cut = [], suffix_dedup.finer_runs
    equal, group = [], suffix_dedup.equal_strings
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "sorted_spans", watched)
    monkeypatch.setattr(suffix_dedup, "finer_runs", lambda *a: cuts.append(a[2]) or cut(*a))
    monkeypatch.setattr(suffix_dedup, "equal_strings", lambda *a: equal.append(1) or group(*a))
    out = suffix_dedup.drop_repeats(frame(spark, texts)).collect()
    want = brute.suffix(list(enumerate(texts)), suffix_dedup.WIDTH)
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want
    assert all(want[i][1] >= 400 for i in range(40))
    assert len(sizes) == 2 and max(sizes) <= block
    assert cuts == [192] and len(equal) == grouped


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 99, 400).astype(np.uint8)
    text = np.concatenate([base, base[50:350], rng.integers(97, 99, 900).astype(np.uint8), base[:330]])
    at = np.arange(len(text) - 200)
    got = suffix_dedup.sort_bucket(np.concatenate((text, np.zeros(400, np.uint8))), at, 200)
    keys = [text[i : i + 200].tobytes() for i in at]
    order = {k: sum(x < k for x in keys) for k in set(keys)}
    assert got.tolist() == [order[k] for k in keys]


def test_block_dedup(spark, texts):
    out = block_dedup.drop_repeats(frame(spark, texts), bitmap_bits=16).collect()
    want = brute.blocks([(i, i, t) for i, t in enumerate(texts)], 50)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == want
    assert any(v[1] for v in want.values())


def test_block_dedup_small_bitmap_loses_nothing(spark, texts):
    full = block_dedup.drop_repeats(frame(spark, texts), bitmap_bits=16).select("id", "kept_sha256")
    crowded = block_dedup.drop_repeats(frame(spark, texts), bitmap_bits=7).select("id", "kept_sha256")
    assert full.exceptAll(crowded).count() == 0


def test_dedup_with_repeated_and_null_ids(spark):
    long = " ".join("t%d" % i for i in range(80))
    ids = [5, 5, None, 2, None]
    df = frame(spark, [long, long, long, "short text", None], ids=ids)
    out = block_dedup.drop_repeats(df, bitmap_bits=16).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"]) for r in out) == [
        (False, 2, 2, 0), (False, 5, 80, 0), (False, 5, 80, 0), (True, 0, 0, 0), (True, 0, 80, 80)]
    out = suffix_dedup.drop_repeats(df).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 0] + [len(long)] * 3


def test_ngram_join(spark, texts):
    out = ngram_join.join(frame(spark, texts)).collect()
    want = brute.jaccard(list(enumerate(texts)))
    assert {r["id"]: (r["n_links"], r["class_id"]) for r in out} == want
    assert sum(r["is_first"] for r in out) == len({v[1] for v in want.values()})


def test_ngram_join_blocks_count_each_pair_once(spark, monkeypatch):
    rng = random.Random(3)
    base = ["v%d" % i for i in range(200)]
    made = []
    for k in range(50):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = "n%d_%d" % (k, rng.randrange(9))
        made.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", 8)
    out = ngram_join.join(frame(spark, made)).collect()
    assert {r["id"]: (r["n_links"], r["class_id"]) for r in out} == brute.jaccard(list(enumerate(made)))


def test_ngram_join_repeated_rows_keep_one(spark):
    df = frame(spark, ["a b c d e f g", "a b c d e f g", "z", None, None], ids=[3, 3, 9, None, 4])
    out = ngram_join.join(df).collect()
    assert sorted((r["n_links"], r["is_first"]) for r in out if r["id"] == 3) == [(1, False), (1, True)]
    assert all(r["is_first"] and r["n_links"] == 0 for r in out if r["id"] != 3)


def test_pruning_keeps_pairs_at_the_threshold():
    need = ngram_join.least_matches(0.8, 1e-6)
    assert list(need) == [30, 60, 90, 120, 150] and need[150] < 0.8 * 150 and need[30] >= 5


def test_ngram_join_finds_pairs_at_a_low_threshold(spark):
    rng = random.Random(11)
    make = lambda k: ["v%d" % rng.randrange(10**6) for _ in range(k)]
    texts = []
    for _ in range(40):  # 100 of 196 shingles in common
        both = make(104)
        texts += [" ".join(both + make(48)), " ".join(both + make(48))]
    out = {r["id"]: r["n_links"] for r in ngram_join.join(frame(spark, texts), threshold=0.5).collect()}
    assert out == {i: 1 for i in range(80)}
    assert ngram_join.rows_per_band(ngram_join.THRESHOLD) == ngram_join.ROWS
    with pytest.raises(ValueError):
        ngram_join.rows_per_band(0.05)


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 8))
    near = base[:10].repeat(3, 0) + 0.1 * rng.normal(size=(30, 8))
    rows = [list(map(float, v)) for v in np.concatenate((base, near, base[:4], 2.5 * base[3:5]))]
    return rows + [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7,
                   [1.0, 2.0], [2.0, 4.0]]


@pytest.mark.parametrize("cell,block", [(1024, 1024), (7, 5)])
def test_embedding_dedup(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = list(enumerate(vectors()))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cell string, home int")
    out = embedding_dedup.near_duplicates(table, cell=cell, exact=True).collect()
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in out} == brute.cosine(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)


def test_embedding_dedup_over_many_cells(spark):
    """Production parameters on enough vectors for eight cells: recall, no false link, exact mode whole."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(7500, 24))
    near = np.repeat(base[:400], 3, 0) + 0.15 * rng.normal(size=(1200, 24))
    x = np.concatenate((base, near))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(x) // embedding_dedup.CELL == 8 and want.sum() > 2000
    found = {r["id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table).collect()}
    found = np.array([found[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    whole = {r["id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table, exact=True).collect()}
    assert [whole[i] for i in range(len(x))] == want.tolist()


def test_embedding_dedup_visits_grow_with_the_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, visit = embedding_dedup.visits(x, embedding_dedup.spherical_kmeans(x, 40), 0.95, embedding_dedup.PROBES)
    assert visit.sum(1).max() <= embedding_dedup.PROBES - 1


def test_quality_cascade(spark, texts):
    out = {r["id"]: r for r in quality_cascade.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = brute.words(t)
        seen, twice = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                twice.update(p for k in at for p in range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(twice))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdict_does_not_depend_on_the_order():
    import pyarrow as pa

    col = pa.array(corpus(seed=5) + ["### %%% a b " * 30, "- x y z\n- u v w\n- p q r\n" * 9, "the " * 50, "7 8 9 10 " * 40])
    orders = [list(quality_cascade.RULES), list(quality_cascade.RULES)[::-1], [x for x, _, _ in quality_cascade.plan_cascade(col)]]
    kept = [np.concatenate([quality_cascade.cascade(p, o) for p in quality_cascade.pieces(col)]) for o in orders]
    assert (kept[0] == kept[1]).all() and (kept[0] == kept[2]).all() and 0 < kept[0].sum() < len(col)


def test_fair_mix(spark, texts):
    sources = [random.Random(i).choice(["a", "b", "c", "é", None]) for i in range(len(texts))]
    df = frame(spark, texts, sources=sources)
    out = fair_mix.fair_mix(df, rows_per_bin=4).collect()
    again = fair_mix.fair_mix(df.repartition(5), rows_per_bin=4).collect()
    assert {r["id"]: r["taken"] for r in out} == {r["id"]: r["taken"] for r in again}
    # the bins are a way to compute, not part of the result
    assert {r["id"]: r["taken"] for r in out} == {r["id"]: r["taken"] for r in fair_mix.fair_mix(df).collect()}
    size = {i: len(brute.words(t)) for i, t in enumerate(texts)}
    assert {r["id"]: r["size"] for r in out} == size
    total = sum(size.values())
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - min(1.5 * total, 2 * total)) < 1e-6
    for s in set(sources):
        mine = [r for r in out if r["source"] == s]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * max(size.values())


def test_fair_mix_targets_share_the_excess(spark):
    df = frame(spark, ["w " * 10] * 1 + ["w " * 100] * 1 + ["w " * 1000] * 1, sources=["a", "b", "c"])
    got = {r["source"]: r["target"] for r in fair_mix.fair_mix(df).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 1445.0}


def test_fair_mix_with_a_source_without_words(spark):
    df = frame(spark, ["", None, "  ", "w " * 10, "w " * 30, "w " * 20], sources=["a", "a", "a", "b", "b", "c"])
    out = {r["id"]: (r["source_size"], r["target"], r["taken"]) for r in fair_mix.fair_mix(df).collect()}
    assert [out[i] for i in range(3)] == [(0, 0.0, 0)] * 3
    assert sum(out[i][2] for i in range(3, 6)) > 0
    rest = fair_mix.fair_mix(df.where("source <> 'a'"), weights=(2, 1, 5)).collect()
    assert {r["id"]: (r["source_size"], r["target"], r["taken"]) for r in rest} == {i: out[i] for i in range(3, 6)}


def best_padding(lengths, counts, k):
    """Least padding by trying all cuts."""
    from functools import lru_cache

    n = len(lengths)

    @lru_cache(None)
    def least(j, k):
        if j == 0:
            return 0
        if k == 0:
            return 10**18
        return min(least(i, k - 1) + sum((lengths[j - 1] - lengths[x]) * counts[x] for x in range(i, j)) for i in range(j))

    return least(n, k)


def test_length_buckets_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 14)
        lengths = sorted(rng.sample(range(1, 60), n))
        counts = [rng.randrange(1, 30) for _ in range(n)]
        for k in (1, 2, 3, 5):
            bounds = length_buckets.best_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1] and bounds == sorted(set(bounds))
            padding = sum((min(b for b in bounds if b >= x) - x) * c for x, c in zip(lengths, counts))
            assert padding == best_padding(tuple(lengths), tuple(counts), k)


def test_length_buckets_batches(spark, texts):
    out = length_buckets.pack(frame(spark, texts), n_buckets=4, token_budget=500, rows_per_bin=4).collect()
    assert len(out) == len(texts)
    batches = {}
    for r in out:
        assert r["n_tokens"] == len(brute.words(texts[r["id"]]))
        if r["n_tokens"] == 0:
            assert r["batch_id"] is None
            continue
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault(r["batch_id"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for rows in batches.values():
        assert len({r["bucket"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 500


def test_length_buckets_of_tokens(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = length_buckets.pack(frame(spark, texts), n_buckets=4, token_budget=500, tokenizer=tokenizer_path()).collect()
    for r in out:
        n = len(t.encode(texts[r["id"]] or "", add_special_tokens=False).ids)
        assert r["n_tokens"] == (n + 1 if n else 0) and (r["batch_id"] is None) == (n == 0)
    batches = {}
    for r in out:
        if r["batch_id"] is not None:
            batches.setdefault(r["batch_id"], []).append(r)
    assert all(len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 500 for rows in batches.values())


@pytest.mark.parametrize("ids, kind", [
    (lambda i: None if i % 3 else i, "long"), (lambda i: 7 if i % 3 else i, "long"), (lambda i: f"d{i % 40}", "string"),
    (lambda i: i / 7, "double"), (lambda i: None, "string")])
def test_order_of_null_and_repeated_ids_is_spread_and_agrees(spark, ids, kind):
    """A third of all rows has one id, and half of those one text: bins stay even, and reruns agree."""
    rows = [(ids(i), "w " * (1 + i % 5) + ("same" if i % 2 else f"t{i}"), "s%d" % (i % 2), "x") for i in range(600)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, size string")
    again = spark.createDataFrame(rows[::-1], df.schema).repartition(7)
    order = [shuffled(x, "doc_id", "s:", ["source", "text"], [F.col("text").alias("t"), F.col("source").alias("s")])
             for x in (df, again)]
    h = [sorted((r["t"], r["s"], r["h"]) for r in x.collect()) for x in order]
    assert h[0] == h[1] and len({x[2] for x in h[0]}) == 600
    bins = order[0].groupBy(even_bin(F.col("h"), F.lit(10))).count().collect()
    assert len(bins) == 10 and max(r["count"] for r in bins) < 120
    taken = [sorted((str(r["id"]), r["source"], r["size"], r["taken"]) for r in fair_mix.fair_mix(x, rows_per_bin=50).collect())
             for x in (df, again)]
    assert taken[0] == taken[1] and sum(x[3] for x in taken[0]) > 0
    packed = length_buckets.pack(df, n_buckets=3, token_budget=60, rows_per_bin=20).collect()
    assert len(packed) == 600 and len({(r["batch_id"], r["slot"]) for r in packed}) == 600
    assert fair_mix.mixed_rows(df).columns == df.columns


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_orc_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tricky = ["It's 3.5kg!! <|endoftext|> ÀÉ naïve ﬁ  x　y", "don't WE'LL", "a.b,c;d 12345 é́ ...", "x\x0by\x1cz"]
    full = texts + tricky
    ids = list(range(len(full)))[::-1]
    df = frame(spark, full, ids=ids)
    token_orc.write(df, str(tmp_path / "t"), path, files=3)
    stored = {r["doc_id"]: r["ids"] for r in spark.read.orc(str(tmp_path / "t")).collect()}
    t = Tokenizer.from_file(path)
    for i, x in zip(ids, full):
        assert stored[i] == t.encode(x or "", add_special_tokens=False).ids + [1]
    got = {r["doc_id"]: r for r in token_orc.read_digests(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i in sorted(got):
        raw = np.array(stored[i], dtype="<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(stored[i]), zlib.crc32(raw))
        start += len(stored[i])


def test_token_orc_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    full = ["Two  spaces and\ttabs\n\nlines", "  lead", None, "", "CaseD Words don't <|endoftext|> x"]
    token_orc.write(frame(spark, full), str(tmp_path / "t"), path, end_id=50256)
    t = Tokenizer.from_file(path)
    stored = {r["doc_id"]: r["ids"] for r in spark.read.orc(str(tmp_path / "t")).collect()}
    assert stored == {i: t.encode(x or "", add_special_tokens=False).ids + [50256] for i, x in enumerate(full)}
    assert token_orc.encoder(tokenizer_path(), 1).by_words and not token_orc.encoder(path, 50256).by_words


def test_token_orc_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_orc, "INDEX_ROWS", 1000)
    rows = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    token_orc.write(rows, str(tmp_path / "t"), tokenizer_path(), files=4)

    def read(ids):
        found = token_orc.lookup(spark, str(tmp_path / "t"), ids)
        got = {r["doc_id"]: r["ids"] for r in found.collect()}
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return got, scan.metrics().apply("numOutputRows").value()

    got, n = read([12_346, None])
    assert list(got) == [12_346] and got[12_346][-1] == 1 and 0 < n <= 2000
    got, n = read([12_346, 39_998])
    assert sorted(got) == [12_346, 39_998] and n <= 4000
    # inside the ranges of the files, but in no Bloom filter (or in few by chance)
    got, n = read([12_345])
    assert got == {} and n <= 1000
    assert read([])[0] == {}


def test_token_orc_files_have_indexes_and_order(spark, texts, tmp_path):
    from pyarrow import orc

    token_orc.write(frame(spark, texts), str(tmp_path / "t"), tokenizer_path(), files=4)
    low = -1
    for f in sorted((tmp_path / "t").glob("*.orc")):
        held = orc.ORCFile(str(f)).read(["doc_id"]).column(0).to_pylist()
        assert held == sorted(held) and (not held or held[0] > low)
        low = held[-1] if held else low
    plan = spark.read.orc(str(tmp_path / "t")).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan._jdf.queryExecution().toString()
    assert plan.count() == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept.</div><div class="ad">Buy, buy, buy now.</div>
<div id="content"><h1>Title &amp; more</h1><p><b>First&nbsp;line.<br><p>Second,   line
 with a <a href="x">link</a> in it, and more words to read.</p><ul><li>one item<li>two items</ul>
<form><p>Your mail, please</p><input></form><p>Short.</p><p>Third &#8212; end.</div>
<aside><p>Other, things, to, read.</p></aside><section class="comments"><p>Great, great, article, thanks!</p></section>
<footer><p>&copy; me, 2020</p></footer>"""


def test_html_extraction():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Title & more", "First line.", "Second, line with a link in it, and more words to read.", "one item", "two items",
        "Short.", "Third — end."]
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("plain &lt;b&gt; text, 1 < 2") == "plain <b> text, 1 < 2"
    deep = "<div>" * 5000 + "<p>deep, text here</p>"
    assert html_extract.main_text(deep) == "deep, text here"
    assert html_extract.main_text("<article><header><h1>H</h1></header><p>a</p><div class='share'><p>x</p></div>"
                                  "<p>b<!-- c --></p></article><p>outside, of it</p>") == "H\n\na\n\nb"


LONG = "A long sentence, with some commas, that goes on, and on, for the length of a real paragraph of text. " * 3


@pytest.mark.parametrize("wrapper", ["class='sidebar-layout'", "id='page' class='header-fixed'", "class='nav-open'",
                                     "class='comments-open'"])
def test_html_wrapper_named_by_layout_keeps_the_article(wrapper):
    comments = "<div id='comments'>" + f"<p>{LONG}said a reader</p>" * 9 + "</div>"
    page = (f"<body><div {wrapper}><article><h1>Head</h1><p>{LONG}one</p><p>{LONG}two</p></article>"
            f"<div class='sidebar'><p>Buy, now.</p></div>{comments}</div></body>")
    assert html_extract.main_text(page).split("\n\n") == ["Head", LONG + "one", LONG + "two"]


@pytest.mark.parametrize("name", ["discussion", "related-work", "social-science", "notice"])
def test_html_sections_with_common_names_stay(name):
    page = (f"<article><h1>Head</h1><p>{LONG}one</p><p>{LONG}two</p><section id='{name}'><p>{LONG}three</p></section>"
            f"<div class='{name}'><a href='x'>{LONG}</a></div><div class='{name}'>Tell a friend</div></article>")
    assert html_extract.main_text(page).split("\n\n") == ["Head", LONG + "one", LONG + "two", LONG + "three"]


def test_html_article_keeps_its_siblings_and_link_lists():
    page = (f"<body><main><ul><li><a href='/'>Home page</a></li></ul><h1>Head</h1><p>{LONG}lead</p>"
            f"<article><p>{LONG}one</p><p>{LONG}two</p><ul><li><a href='s'>Source, a book</a></li></ul></article>"
            f"<article><p>{LONG}three</p><p>{LONG}four</p></article><p>{LONG}after</p></main></body>")
    assert html_extract.main_text(page).split("\n\n") == [
        "Head", LONG + "lead", LONG + "one", LONG + "two", "Source, a book", LONG + "three", LONG + "four"]


@pytest.mark.parametrize("inner", [
    "<div class='menu-section'><p>%s</p></div>", "<div class='chapter-header'><p>%s</p></div>",
    "<div class='ad-hoc-networks'><p>%s</p></div>", "<p class='reply-to-critics'>%s</p>", "<p id='skip-lists'>%s</p>",
    "<pre class='hidden-markov'>%s</pre>", "<section id='discussion'><p>%s</p></section>"])
def test_html_names_that_hold_a_word_of_furniture_lose_nothing_inside(inner):
    holders = ["<article>%s</article>", "<div class='sidebar'><a href='x'>Menu</a></div><div>%s</div>"]
    for holder in holders[:1] if "discussion" in inner else holders:  # outside an article that name speaks of comments
        for said in ("A short end.", (LONG + "inside").strip()):
            page = holder % (f"<h1>Head</h1><p>{LONG}one</p><p>{LONG}two</p>" + inner % said + f"<p>{LONG}three</p>")
            assert html_extract.main_text(f"<body>{page}</body>").split("\n\n") == [
                "Head", LONG + "one", LONG + "two", said, LONG + "three"]


@pytest.mark.parametrize("name", ["ad-slot", "sidebar-widget", "newsletter-signup", "comment-list", "site-footer", "cookie-bar"])
def test_html_names_of_furniture_go_inside_an_article(name):
    page = (f"<article><div class='header'><h1>Head</h1></div><p>{LONG}one</p><div class='{name}'><p>{LONG}not</p></div>"
            f"<p>{LONG}two</p><div class='nav-of-parts'><a href='x'>Part two</a></div></article>")
    assert html_extract.main_text(page).split("\n\n") == ["Head", LONG + "one", LONG + "two"]


@pytest.mark.parametrize("tag", ["form", "fieldset", "form role='form' class='page-form'"])
def test_html_forms_around_the_page_are_wrappers(tag):
    end = tag.split()[0]
    controls = "<input type='hidden' name='s'>" * 20 + "<input type='text'><button>Search the site</button>"
    login = "<form><p>Your name, please <input></p><label>Password</label><input type='password'></form>"
    text = f"<h1>Head</h1><p>{LONG}one</p>{login if end != 'form' else ''}<p>{LONG}two</p>"
    for inner in (f"<div id='content'>{text}</div>", f"<article>{text}</article>", text):
        page = f"<html><body><{tag}>{controls}<nav><a href='/'>Home</a></nav>{inner}</{end}></body></html>"
        assert html_extract.main_text(page).split("\n\n") == ["Head", LONG + "one", LONG + "two"]
    assert html_extract.main_text(f"<body>{login}</body>") == ""


def test_html_time_is_linear():
    n = 1 << 20
    hard = ["<a " * (n // 3), "<a " * (n // 6) + ">" + "x" * (n // 2), "<a ='" * (n // 5) + ">", "<a =\">\" " * (n // 8) + "'",
            "<a =\">\" <b='>' " * (n // 16), "<!-" * (n // 3), "<b>" * (n // 12) + "</i>" * (n // 12) + "<div>" * 1000,
            "<li><ul>" + "<div>" * (n // 16) + "<li></li>" * (n // 16), "<script>" + "</script " * (n // 9),
            "<div class='x-ad'>" * (n // 40) + "<p class='ad'>a</p>" * (n // 40), "&" * n, "<![CDATA[" * (n // 9)]
    for page in hard:
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 10, page[:30]


def test_html_extraction_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", "")], "page_id long, url string, html string")
    out = html_extract.extract(df).collect()
    assert [(r["id"], r["n_chars"]) for r in out][1:] == [(2, 0), (2, 0)] and out[0]["n_chars"] == len(out[0]["text"])


def toxic_corpus(n=400, seed=8):
    rng = random.Random(seed)
    vocab = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["badword", "vileterm", "grossling"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([15, 60, 200]))]
        toxic = i % 4 == 0
        for _ in range(rng.choice([1, 2, 5]) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "!", "***", "x"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "?? 12")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    field = toxicity_crf.train_on(docs, labels, max_toxic=80, max_clean=200)
    out = {r["id"]: r for r in toxicity_crf.score(docs, field).collect()}
    held = [(out[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(out[i]["predicted"] == 0 and 0 <= out[i]["score"] <= 1 for i in (9001, 9002, 9003))
    i, text, _ = next(r for r in rows if r[2] and out[r[0]]["spans"])
    s = out[i]["spans"][0]
    assert text.encode()[s["start"] : s["end"]].decode().startswith(("badword", "vileterm", "grossling"))
    assert toxicity_crf.clean_rows(docs, field).count() == sum(r["predicted"] == 0 for r in out.values())
    flags = docs.select("doc_id", toxicity_crf.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def test_toxicity_sample_is_bounded_in_rows_and_segments(spark, monkeypatch):
    rows = toxic_corpus(40)
    texts = [r[1] for r in rows] + ["z copy %d" % i for i in range(200)]
    ids = list(range(40)) + [7] * 200
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity_crf, "train", lambda *a: seen.append(a))
    toxicity_crf.train_on(frame(spark, texts, ids=ids), labels, max_toxic=5, max_clean=40, max_segments=9)
    got, toxic, segments = seen[0]
    assert len(got) <= 45 and toxic.sum() == 5 and segments == 9


def test_gap_marginals_equal_full_forward_backward():
    rng = np.random.default_rng(1)
    field = toxicity_crf.Field(np.zeros(0, np.uint64), np.zeros(1), -2.0, rng.normal(size=(2, 2)), -1.0,
                               np.zeros(0)).ready()
    n = 40
    e = np.full(n, field.bias)
    at = np.array([0, 3, 4, 17, 39])
    e[at] += rng.normal(size=5) * 3
    full, _, _ = toxicity_crf.segment_marginals(e[None], np.array([n]), field)
    assert np.allclose(toxicity_crf.marginals(e[at], at, field, n), full[0, at])
    full, _, _ = toxicity_crf.segment_marginals(e[None, 1:38], np.array([37]), field)
    assert np.allclose(toxicity_crf.marginals(e[at[1:4]], at[1:4] - 1, field, 37), full[0, at[1:4] - 1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert suffix_dedup.drop_repeats(docs).count() == 0
    assert block_dedup.drop_repeats(docs, bitmap_bits=16).count() == 0
    assert ngram_join.join(docs).count() == 0
    assert fair_mix.fair_mix(docs).count() == 0
    assert length_buckets.pack(docs).count() == 0
    assert quality_cascade.judge(docs).count() == 0
    assert token_orc.digests(docs, tokenizer_path()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_crf.score(docs, toxicity_crf.train_on(docs, labels)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extra_columns_with_clashing_names(spark, texts):
    extra = ", block int, bucket int, node int, copies int, start int, size int, id int, z int, rank int, spans int"
    df = frame(spark, texts, extra, tuple(range(10)))
    plain = frame(spark, texts)
    for op, cols in ((suffix_dedup.drop_repeats, ["id", "kept_sha256"]), (ngram_join.join, ["id", "n_links", "class_id"]),
                     (fair_mix.fair_mix, ["id", "taken"]), (length_buckets.pack, ["id", "batch_id", "slot"]),
                     (quality_cascade.judge, ["id", "n_words"])):
        assert op(df).select(*cols).exceptAll(op(plain).select(*cols)).count() == 0
    assert set(fair_mix.mixed_rows(df).columns) == set(df.columns)


def test_components(spark):
    from clinops.llm.common import components

    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.closure({x for e in edges for x in e}, edges)
    assert {k: got.get(k, k) for k in want} == want
