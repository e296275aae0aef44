"""Awkward input of the corpus operators: repeated rows, missing ids, odd bytes, hot keys, long texts."""

import hashlib
import json
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.llm import ann, bpe, common, hamming, langid, ngram_join, packing, pii, queries, sharding, suffix_dedup, warc
from tests.llm.test_operators import CLASH, SCHEMA, components_plain, rows_of, shingles_plain, words


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def test_words_of_every_class_of_characters(reference_tokenizer):
    made, rng = bpe.ByteBPE(queries.vocabulary(), cache_entries=2000), random.Random(2)
    some = [chr(rng.choice([rng.randrange(1, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(3000)]
    texts = [f"a{c}1{c}. {c}" for c in some] + ["".join(rng.choice(list("ab'sdtmrevl 1\n\t.é日") + ["  ", "'s", "'re", "<|endoftext|>", "<|endo", "ftext|>"]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    want = reference_tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, w in zip(texts, made.encode_block(texts), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == w.ids, text


def test_bytes_that_are_no_text():
    made = bpe.ByteBPE(queries.vocabulary())
    rows = [b"ab\xff cd", b"plain", "é".encode()[:1], "é".encode()[1:], b""]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids, cut = made.encode_rows(at, np.frombuffer(b"".join(rows), np.uint8))
    again = made.encode_block([r.decode("utf-8", "replace") for r in rows])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [np.frombuffer(x, "<u4").tolist() for x in again]
    assert made.decode_rows(ids, cut) == [r.decode("utf-8", "replace").encode() for r in rows]


@pytest.mark.parametrize("where, name, value", [("model", "ignore_merges", True), ("model", "byte_fallback", True), ("pre_tokenizer", "use_regex", False), ("added_tokens", "lstrip", True)])
def test_other_files_are_refused(tmp_path, where, name, value):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    (spec[where][0] if where == "added_tokens" else spec[where])[name] = value
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.ByteBPE(str(tmp_path / "other.json"))


def test_repeated_rows_are_encoded_and_packed_as_often(spark, monkeypatch, reference_tokenizer):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", -1)  # offsets by a join
    rows = [(1, "the same words"), (1, "the same words"), (2, None), (2, None), (None, "x y"), (3, words(random.Random(0), 3000))]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.round_trip(df, queries.vocabulary()).collect()) == sorted((i or 0, len(reference_tokenizer.encode(t or "").ids)) for i, t in rows)
    pieces = packing.pack(df, queries.vocabulary(), 64).collect()
    assert sum(p["length"] for p in pieces) == sum(1 + len(reference_tokenizer.encode(t or "").ids) for _, t in rows)
    assert sorted(p["sequence_id"] * 64 + p["offset"] for p in pieces) == np.cumsum([0, *[p["length"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))]]).tolist()[:-1]


def test_shards_follow_the_permutation_of_row_numbers(spark):
    rows = [(i % 700 if i % 11 else None, f"t{i % 5}" if i % 7 else None) for i in range(1000)] + [(5000, "a" * 3_000_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sharding.shard(df.repartition(5)).collect()
    number = np.array([r["row_number"] for r in got])
    assert sorted(number.tolist()) == list(range(len(rows)))
    shard, slot = sharding.Feistel(len(rows), 20).locate(number, 16)
    assert [(r["shard"], r["slot"]) for r in got] == list(zip(shard.tolist(), slot.tolist(), strict=True))
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["size"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, sharding.shard(df.repartition(2)).collect()))


def test_codes_of_other_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (-x[7]).tolist()), (400, []), (401, None)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    codes, bits = hamming.sign_codes(df)
    assert bits == 20 and sum(hamming.widths(10**9, 64)) == 64 and max(hamming.widths(10**9, 64)) <= hamming.WIDEST
    got = {}
    for r in hamming.search(codes, codes.where("vec_id % 50 = 0"), 10, bits=bits).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    signs = [(i, np.array(v) > 0) for i, v in rows if v]
    for q, s in signs:
        if q % 50 == 0 and q < 300:
            assert got[q] == sorted((int((t != s).sum()), i) for i, t in signs if i != q)[:10]
    with pytest.raises(Exception, match="components"):
        hamming.sign_codes(df.union(df.select(F.lit(900).cast("long"), F.array_repeat(F.lit(1.0), 19), *CLASH)))[0].collect()
    with pytest.raises(ValueError):
        hamming.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>"))


def test_an_id_with_two_vectors_is_one_however_rows_lie(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, (2 * x[i] + 1).tolist()) for i in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = {}
    for i, v in rows:
        one[i] = min(v, one.get(i, v))
    got = [sorted(map(tuple, ann.search(t, t.where("vec_id % 20 = 0"), 20).collect())) for t in (df.repartition(1), df.repartition(7))]
    assert got[0] == got[1]
    for q in range(0, 200, 20):
        want = sorted((-float(np.dot(one[q], one[i])), i) for i in one if i != q)[:20]
        assert [r[2] for r in got[0] if r[0] == q] == [i for _, i in want]


def plain_removed(rows, least):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - least + 1):
            first.setdefault(t[p : p + least], i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < i:
                gone[p : p + least] = True
        out[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_passages_in_many_batches_and_with_hot_hashes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rng = random.Random(8)
    passage, phrase = words(rng, 30), "a phrase that goes round "
    rows = [(i, (words(rng, rng.randrange(5, 200)) + (passage if i % 3 == 0 else "") + phrase + words(rng, 20)).encode()) for i in range(120)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, b"z" * 20_000), (203, b"z" * 9000)]
    df = clashing(spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3))
    want = plain_removed(rows, 50)
    for hot in (1, 4, 256):
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, 50, hot=hot).collect()} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("batches")]


def test_passages_in_rounds_leave_no_pieces_on_disk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "ROUND_BYTES", 4000, raising=False)
    rng, root = random.Random(4), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    passages = [words(rng, 25) for _ in range(6)]
    rows = [(i, (words(rng, rng.randrange(5, 60)) + passages[i % 6] + words(rng, 20) + passages[i * i % 6]).encode()) for i in range(90)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    there = set(root.glob("*"))
    for hot in (2, 256):
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, 50, hot=hot).collect()} == plain_removed(rows, 50)
    assert Counter(p.name.partition("-")[0] for p in set(root.glob("*")) - there) == {"batches": 2, "masks": 8}


def test_spent_tables_of_the_pipeline_are_removed(spark):
    import corpus_pipeline

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there, rng = set(root.glob("*")), random.Random(9)
    texts = [words(rng, 60) for _ in range(20)]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(20))
    assert Counter(p.name.partition("-")[0] for p in set(root.glob("*")) - there) == {"first": 1}
    there = set(root.glob("*"))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert Counter(p.name.partition("-")[0] for p in set(root.glob("*")) - there) == {"personal_data": 1, "packing": 1, "bases": 1}


def test_buckets_of_pieces_follow_what_is_shared(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PIECE_HASHES", 4, raising=False)
    rng = random.Random(6)
    once = [(i, words(rng, 80, 10**6)) for i in range(24)]
    for rows, most in ((once, 16), (once + [(100 + i, t) for i, t in once], 2000)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        _, told = suffix_dedup._found(df, 50, False)
        buckets = told.where("bucket >= 0").select("bucket").distinct().count()
        assert buckets <= most and (most == 16 or buckets > 16)
        assert sum(r["n_removed"] > 0 for r in suffix_dedup.dedup(df).collect()) == len(rows) - 24


def test_shuffle_files_of_written_tables_go_at_once(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there, usual = files.getAllFiles().size(), spark.conf.get(common.CLEANUP)
    table = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if files.getAllFiles().size() <= there:
            break
        time.sleep(0.1)
    assert files.getAllFiles().size() <= there and table.count() == 7 and spark.conf.get(common.CLEANUP) == usual


def test_memory_of_a_batch_is_given_back_after_its_last_block(monkeypatch):
    given = []
    monkeypatch.setattr(common, "trim", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([b"some words", None, b"", b"and others"], pa.binary())], ["t"])
    for _ in bpe.encoded_blocks(batch, "t", queries.vocabulary()):
        assert not given
    assert given == [1] and list(common.blocks(np.array([0, 3, 9, 10]), 5)) == [(0, 1), (1, 2), (2, 3)] and given == [1, 1]


def test_hot_keys_are_looked_up_like_all_others(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i in range(300) for k in [i % 50 if i % 3 else 7]] + [(99, 1)], "k long, i long")
    counts = rows.where("k < 99").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    for share in (1, 10, 4096):
        monkeypatch.setattr(common, "HOT_KEYS", share)
        got = sorted((r["k"], r["i"], r["v"]) for r in common.looked_up(rows, counts, "k", 301, "n").collect() if r["v"] is not None)
        assert got == sorted((r["k"], r["i"], r["k"] * 10) for r in rows.where("k < 99").collect())
        assert common.looked_up(rows, counts, "k", 301, "n").count() == 301


def test_long_lists_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 2)
    monkeypatch.setattr(ngram_join, "SEEN", 3)
    rng = random.Random(12)
    base = words(rng, 60, 5000).split()
    texts = []
    for k in range(90):  # near copies of many sizes, some equal, some linked only through others
        w = base[: rng.randrange(30, 61)]
        if k % 3:
            w = w + [f"z{rng.randrange(4)}"] * rng.randrange(3)
        texts.append(" ".join(w))
    texts += [words(rng, 40, 5000) for _ in range(20)]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    sets = {i: shingles_plain(t) for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_plain(sets, linked)
    assert ngram_join.list_parts(ngram_join.TABLE[0], 4000)[30:].min() > 1 and ngram_join.list_parts(ngram_join.TABLE[0], 4000)[12] == 1
    got = rows_of(ngram_join.join(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(x), want[i]) for i, x in sets.items()}


def test_bands_hold_every_pair_that_can_link():
    n = np.arange(1, 400)
    e = np.zeros(len(n), ngram_join.ENTRY)
    e["n"], e["h"] = n, 7
    both, bucket = ngram_join._in_bands(e, np.full(len(n), 3), 80, 16)
    assert bucket.min() >= 16 and bucket.max() < 32
    lists = [set(x) for x in zip(both["h"][: len(n)].tolist(), both["h"][len(n) :].tolist(), strict=True)]
    assert all(lists[a - 1] & lists[b - 1] for a in n.tolist() for b in range(a, min(399, a * 5 // 4) + 1))
    assert not lists[0] & lists[398]


def test_join_of_missing_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(4, a), (2, a), (2, a), (None, a), (None, b), (9, b + " tail"), (None, ""), (None, None), (6, "  ")] + [(100 + i, b + f" tail{i}") for i in range(300)]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4))
    got = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()), key=str)
    n, m = 56, 57
    want = [("4", n, 2), ("2", n, 2), ("2", n, 2), ("None", n, 2), ("None", n, None), ("9", m, 9), ("None", 0, None), ("None", 0, None), ("6", 0, 6)] + [(str(100 + i), m, 9) for i in range(300)]
    assert got == sorted(want, key=str)


def test_languages_decoded_plainly(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "to"], "bb": ["str", "ung"], "cc": ["eau", "que"], "dd": ["zo", "wi"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[k], k=2)) for _ in range(20)), k) for i, k in enumerate(rng.choices(list(sounds), k=160))]
    rows += [(0, rows[0][1], rows[0][2]), (None, "katoto kato", None), (500, "ka" * 400_000, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(df)
    for r in langid.predict(df, model).collect():
        if r["doc_id"] is None or r["doc_id"] > 20 or r["doc_id"] == 0:
            continue
        x = langid.FOLD[np.frombuffer(rows[r["doc_id"]][1].encode(), np.uint8)].tolist()
        f = np.array(model.bias, float)
        for p in range(len(x) - 2):
            h = ((x[p] * 0x9E3779B1) ^ (x[p + 1] * 0x85EBCA77) ^ (x[p + 2] * 0xC2B2AE3D)) & 0xFFFFFFFF
            f += 30 * model.weights[((h * 0x27D4EB2F) & 0xFFFFFFFF) >> (32 - model.bits)] / (len(x) - 2)
        loss = [float(sum(model.trust[k] * np.log1p(np.exp(-f[k] * code[k])) for k in range(len(f)))) for code in model.codes]
        assert r["lang_pred"] == model.languages[int(np.argmin(loss))]
        assert abs(r["score"] - 1 / sum(np.exp(-4 * (x - min(loss))) for x in loss)) < 1e-4
    assert langid.predict(df, model).count() == len(rows)
    with pytest.raises(ValueError):
        langid.fit(df, most_languages=3)


def test_context_by_whole_words(spark):
    near, far, part = "tel +49 30 1234567", "+49 30 1234567", "hotel +49 30 1234567"
    at = {t: pii.score(t, *pii.spans_of(t)[0]) for t in (near, far, part)}
    assert at[near] > at[far] == at[part]
    code = "GB82 WEST 1234 5698 7654 32"
    assert [k for k, *_ in pii.spans_of(f"iban {code}")] == ["iban"] and not pii.spans_of(f"serial {code}") and pii.spans_of(f"serial {code}", least=0.5)
    text = "x " * 500_000 + "me@example.org"
    df = clashing(spark.createDataFrame([(1, text), (1, text), (None, "1.2.3.4")], "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["spans"]) for r in pii.find(df).collect()) == sorted([("1", 1, 0, "email:1000000:1000014")] * 2 + [("None", 0, 1, "ip:0:7")])


def test_pages_without_id_or_url_and_repeated_ones(spark):
    html = "<p>" + "y" * 200
    rows = [(1, "http://a/", html), (1, "http://a/", html), (2, None, html), (None, "http://b/", html), (3, "http://c/", None), (4, "http://d/", "short")]
    fields = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").columns
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in fields:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    got = warc.archive(df, least=100).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(i), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, _, t in rows)
    assert {r["record_type"] for r in got if r["page_id"] in (3, 4)} == {"response"} and [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 2] == [("revisit", 1)]


def test_stages_on_awkward_tables(spark):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (None, "some words of a text", "en", "s", 3), (2, "", "en", "s", 0)]
    for some in (rows, rows[:1], []):
        docs = clashing(spark.createDataFrame(some, SCHEMA))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packed":
                assert out.columns == docs.columns, name
            out.collect()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared|shares"):
        runtime.scratch(Session(), "x")
    assert zlib.crc32(b"") == 0
