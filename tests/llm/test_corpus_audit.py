"""WARC index, collocations and filter audit against plain versions on small hand-made tables."""

import base64
import hashlib
import heapq
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinops.llm import collocations, filter_audit, warc
from tests.llm import brute
from tests.llm.test_corpus_ops import corpus, frame

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def texts():
    return corpus()


# ---------------------------------------------------------------- WARC


def pages(spark, texts, ids=None, urls=None, kind="long"):
    rows = [(i if ids is None else ids[i], f"http://www.e{i % 7}.org/p/{i}?q=1#x" if urls is None else urls[i], t)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAGE.replace("page_id long", f"page_id {kind}"))


def plain_captures(rows, least=0):
    """{page_id: (bytes, digest, type, refers_to)} for unique ids."""
    lead, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = lead.setdefault(b, i)
        again = first != i and len(b) >= least
        out[i] = (len(b), digest, "revisit" if again else "response", first if again else None)
    return out


def found(df):
    return {r["id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_warc_round_trip(spark, texts):
    odd = ["\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\n", "é \x00\x85", None, "", "x" * (3 << 20)]
    texts = texts + odd + odd
    ids = random.Random(3).sample(range(1000), len(texts))
    out = warc.index(pages(spark, texts, ids).repartition(5))
    assert found(out) == plain_captures(list(zip(ids, texts)))


def test_warc_small_payloads_are_all_responses(spark):
    texts = ["ab", "ab", "abcd", "abcd", "", ""]
    assert found(warc.index(pages(spark, texts), least=3)) == plain_captures(list(enumerate(texts)), 3)


def test_warc_null_and_repeated_ids(spark):
    texts, ids = ["same"] * 5 + ["other"], [None, 4, 4, 9, None, None]
    got = sorted((str(r["id"]), r["record_type"], r["refers_to"]) for r in warc.index(pages(spark, texts, ids)).collect())
    want = [("4", "response", None), ("4", "revisit", 4), ("9", "revisit", 4), ("None", "revisit", 4),
            ("None", "revisit", 4), ("None", "response", None)]
    assert got == sorted(want, key=lambda t: (t[0], t[1]))


def test_warc_text_ids_and_odd_urls(spark):
    urls = [None, "", "no url", "http://[bad/", "HTTP://User@WWW.A.org:80/x y\n", "https://a.org:8443?z"]
    ids = ["a b", "%", "é", "x\r\ny", "", "-"]
    out = {r["id"]: r for r in warc.index(pages(spark, ["t"] * 6, ids, urls, "string")).collect()}
    assert set(out) == set(ids) and {r["refers_to"] for r in out.values()} == {None, ""}
    keys = [out[i]["url_key"] for i in ids]
    assert keys[0] == keys[1] == "" and keys[4].startswith("org,a)/x%20y") and keys[5] == "org,a:8443)/?z"


def test_warc_index_is_in_global_order_and_locates_records(spark, texts, tmp_path):
    n = len(texts) * 4
    df = pages(spark, texts * 4, urls=[f"http://e{i % 3}.org/" if i % 2 else f"http://e{i}.com/a" for i in range(n)])
    df = df.withColumn("at", F.expr("timestamp'2024-03-01 00:00:00' - make_interval(0,0,0,page_id % 11)"))
    out = warc.index(df.repartition(6), str(tmp_path / "w"), date_col="at")
    files = sorted((tmp_path / "w" / "index").glob("part-*"))
    rows = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    keys = [(r["url_key"], r["date"], r["__row"]) for r in rows]
    assert len(keys) == n and keys == sorted(keys) and len({k[1] for k in keys}) == 11
    for r in out.sample(0.1, 3).collect():
        raw = (tmp_path / "w" / "archive" / r["file"]).read_bytes()
        piece = raw[r["offset"] : r["offset"] + r["length"]]
        assert piece.startswith(b"WARC/1.1\r\n") and raw[r["offset"] + r["length"] :].startswith(warc.ENDS)
        assert warc.split_record(piece)[0]["capture"] == str(r["id"])


def test_warc_merge_of_many_ranges(spark, tmp_path):
    rows = [(i, "k%d" % (i % 3), "d%02d" % (i * 7 % 50), False) for i in range(3000)]
    runs = warc.sorted_runs(spark.createDataFrame(rows, "__row long, url_key string, date string, id_text string")
                            .repartition(7))
    warc.merge_runs(runs, str(tmp_path / "i"), merge_rows=200)
    files = sorted((tmp_path / "i").glob("part-*"))
    got = [(r["url_key"], r["date"], r["__row"]) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == sorted((k, d, i) for i, k, d, _ in rows) and len(files) > 8


def test_warc_damaged_record_raises():
    archive = "00000000-0000-4000-8000-000000000000"
    good = warc.record(archive, 0, 1, "1", "http://a.org/", warc.CAPTURED_AT, b"payload", None, None)
    lead = warc.lead_lines(archive).encode()
    assert warc.capture(good + warc.ENDS, lead)["payload_bytes"] == 7
    for bad in (good[:-1], good.replace(b"payload", b"pAyload")):
        with pytest.raises(ValueError):
            warc.capture(bad, lead)


def test_loser_tree_merges_like_heapq():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(9), j) for _ in range(rng.randrange(6))) for j in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))
    keys = [rng.randrange(50) for _ in range(400)]
    assert [keys[i] for i in warc.merged_order(keys)] == sorted(keys)


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    best, longer = {}, Counter()
    for (lang, w), a in f.items():
        if a < least or len(w) < 2:
            continue
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                longer[key] = max(longer[key], a)
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        best[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], score)
    out = []
    for lang in n:
        keep = [(-v[3], -v[0], " ".join(w).encode(), v) for (x, w), v in best.items()
                if x == lang and not 100 * longer[x, w] >= 80 * v[0]]
        for rank, (_, _, phrase, (a, l, r, score)) in enumerate(sorted(keep)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], score))
    return sorted(out)


def phrase_rows(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "x|y", "\x1f", "a\x0bb", "Zz"]
    passage = " ".join(rng.choice(vocab) for _ in range(90))
    rows = [(None, None), ("en", ""), ("en", " \t. ,;"), ("und", "w1 w2. w1 w2"), ("en", "a " * 5000), ("fr", "one, two")]
    for i in range(200):
        words = [rng.choice(vocab) + rng.choice(["", "", "", ".", ",", "\n", " \t"]) for _ in range(rng.choice([3, 30, 200]))]
        rows.append((rng.choice(["en", "de", None]), " ".join(words) + (" " + passage if i % 3 == 0 else "")))
    rows += [rows[10]] * 40
    return rows


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_collocations(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string")
    want = plain_collocations(rows, 30, 25)
    assert len(want) > 20 and got(collocations.collocations(df, top=25)) == want


def test_collocations_over_several_rounds(spark):
    """Bitmaps too small for all frequent phrases: dealt to rounds, nothing is lost or counted twice."""
    rows = phrase_rows(5)
    df = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string")
    assert got(collocations.collocations(df, least=20, bits=10)) == plain_collocations(rows, 20, 2000)


def test_collocations_long_text_and_empty_table(spark):
    rows = [("en", ("alpha beta gamma. " * 4 + "delta Alpha beta ") * 17000)]  # over one chunk of the text reader
    df = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string")
    assert len(rows[0][1]) > 1 << 20 and got(collocations.collocations(df)) == plain_collocations(rows, 30, 2000)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_chunks_cover_every_word_once():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "."]) for _ in range(n)) for n in (0, 1, 5, 400)] + ["q " * 900]
    raw = b"".join(t.encode() for t in texts)
    offs = np.cumsum([0, *(len(t) for t in texts)])
    row, chunk, own = collocations.chunks_of(np.frombuffer(raw, np.uint8), offs)
    for i, t in enumerate(texts):
        words = [w for c, k, o in zip(chunk.to_pylist(), row, own) if k == i for w in re.split("[ \n]", c)[:o]]
        assert words == re.findall(r"[^ .]+", t)
    assert max(own) <= collocations.MOST and isinstance(chunk, pa.Array)


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    fails = {}
    for k, (d, t, part) in enumerate(rows):
        t = t or ""
        w = brute.words(t)
        mine = {"A"} if len(w) < 200 else set()
        if 100 * len(set(w)) < 50 * len(w):
            mine.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            mine.add("C")
        if re.search(r"[#$%&*|]", t):
            mine.add("D")
        key = lambda x: (x is None, x or 0)
        if any((u or "") == t and key(e) < key(d) for e, u, _ in rows):
            mine.add("E")
        fails[k] = mine
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        at = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = list(at)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in fails[k]]
                alive = [k for k in alive if f not in fails[k]]
                shapley[f] += len(gone)
                failing = sum(f in fails[k] for k in at)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), failing - len(gone), sum(fails[k] == {f} for k in at),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in cols] for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark, texts):
    rng = random.Random(4)
    long = [" ".join(f"v{rng.randrange(900)}" for _ in range(250)) for _ in range(20)]
    texts = texts + long + [t + " $5" for t in long[:6]] + [t.upper() for t in long[:4]] + [long[0]] * 3 + ["é" * 3, "A"]
    ids = rng.sample(range(500), len(texts))
    ids[3] = ids[4] = None
    ids[7] = ids[8]
    sources = [rng.choice(["s1", "s2", None, ""]) for _ in texts]
    labels = [(d, rng.randrange(2), rng.choice([0, 1, None])) for d in ids if d is not None and rng.random() < 0.6]
    labels += labels[:5] + [(None, 1, 1), (9999, 1, 1)]
    docs = frame(spark, texts, ", good string, gone int", ("x", 1), ids=ids, sources=sources)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(filter_audit.audit(docs, marks))
    assert got == plain_audit(list(zip(ids, texts, sources)), labels) and len(got) == 3 * 600


def test_filter_audit_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, ["x"]).limit(0), marks).collect() == []
    assert audited(filter_audit.audit(frame(spark, ["x", None, ""]), marks)) == plain_audit(
        [(0, "x", "s"), (1, None, "s"), (2, "", "s")], [])


def test_empty_pages(spark):
    out = warc.index(pages(spark, ["x"]).limit(0))
    assert out.collect() == [] and out.columns[0] == "id"
