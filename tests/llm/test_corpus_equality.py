"""Equality of words and runs: inputs made to collide under polynomial hashes modulo a power of two."""

import numpy as np
import pytest

from clinops.llm import block_dedup, ngram_join, quality_cascade, suffix_dedup, textops, token_orc
from tests.llm import brute
from tests.llm.test_corpus_ops import frame


def twins(a="a", b="b", order=10):
    """The Thue-Morse word of 2**order letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1 << order)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


ONE, TWO = twins()


@pytest.mark.parametrize("pair", [twins(), twins("ab", "zz", 9), twins("x", "é", 11), twins("abcdefgh", "hgfedcba", 8)])
def test_hashes_of_twins_differ(pair):
    def words(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return textops.word_hashes(buf, np.array([0]), np.array([len(buf)]))[0]

    assert words(pair[0]) != words(pair[1])


def test_run_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 500).astype(np.uint8)
    both = np.concatenate((x, rng.integers(0, 256, 77).astype(np.uint8), x))
    h = textops.rolling_hash(textops.prefix_hash(both), 40)
    assert (h[:461] == h[577:577 + 461]).all() and len(np.unique(h[:461])) == 461
    start = np.array([3, 580])
    a, b = textops.span_hash(textops.prefix_hash(both), start, start + 100)
    assert a == b
    big = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    w = textops.window_hashes(np.concatenate((big, big)), 8)
    assert (w[:293] == w[300:593]).all() and len(np.unique(w[:300])) == 300


def test_block_dedup_keeps_a_window_that_differs(spark):
    lead = " ".join(f"w{i}" for i in range(49))
    texts = [f"{lead} {ONE}", f"{lead} {TWO}", f"{lead} {ONE}"]
    out = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in block_dedup.drop_repeats(frame(spark, texts)).collect()}
    assert out == brute.blocks([(i, i, t) for i, t in enumerate(texts)], 50) and out[1][1] == 0 and out[2][1] == 50


def test_ngram_join_does_not_link_twins(spark):
    texts = [" ".join([ONE] * 5), " ".join([TWO] * 5), " ".join([ONE] * 5)]
    out = {r["id"]: r["n_links"] for r in ngram_join.join(frame(spark, texts)).collect()}
    assert out == {0: 1, 1: 0, 2: 1}


def test_quality_counts_of_twins(spark):
    texts = [" ".join([ONE] * 8 + [f"x{i}" for i in range(8)] + [TWO] * 8)]
    out = quality_cascade.judge(frame(spark, texts)).collect()
    assert out[0]["n_repeat_words"] == 0


def test_token_ids_of_twins(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [ONE, TWO, f"{TWO} {ONE}"]
    token_orc.write(frame(spark, texts), str(tmp_path / "t"), path, files=1)
    got = {r["doc_id"]: r["ids"] for r in spark.read.orc(str(tmp_path / "t")).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_suffix_dedup_of_twins(spark):
    texts = [ONE, TWO, "q" * 50 + ONE[:300] + "r", ONE[100:] + TWO[:150]]
    out = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix_dedup.drop_repeats(frame(spark, texts)).collect()}
    assert out == brute.suffix(list(enumerate(texts)), suffix_dedup.WIDTH)
