"""Each corpus operator against a brute-force version on small tables with awkward rows."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, hamming, langid, ngram_join, packing, pii, queries, sharding, suffix_dedup, warc
from plumbline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "part", "bucket", "batch", "rank", "row_number", "n", "sig", "slot", "kept", "d", "t", "leader", "group"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, empty and null texts, a long one, letters of several bytes."""
    rng = random.Random(3)
    passage, base = words(rng, 40), [words(rng, rng.randrange(20, 120)) for _ in range(30)]
    texts = [*base, base[3], base[3], base[4] + " tail", "head " + base[5], base[6].replace("w1", "W1"), passage + "\n" + words(rng, 30), words(rng, 25) + passage, passage]
    near = base[7].split()
    near[10:12] = ["other", "words"]
    texts += [" ".join(near), "", " \t\n", None, "one", "two words", "Two  WORDS", "é" * 60, "x" + "é" * 60, "a" * 300, "a" * 90, words(rng, 4000), "日本語 " * 40]
    return [(i * 3 % 101, t, "en" if t else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def nothing(df):
    return df.where("false")


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        f = sharding.Feistel(n, seed=9)
        p = f.place(np.arange(n))
        assert sorted(p.tolist()) == list(range(n)) and (f.row(p) == np.arange(n)).all()
    f = sharding.Feistel(1000)
    shard, slot = f.locate(np.arange(1000), 7)
    assert (f.row_at(shard, slot, 7) == np.arange(1000)).all()
    with pytest.raises(ValueError):
        sharding.Feistel(0)


def test_shards(spark, docs):
    more = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard(more, 16).collect()
    again = sharding.shard(more.repartition(5), 16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = defaultdict(list)
    for r in got:
        sizes[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(got) == more.count()
    assert sharding.shard(nothing(docs)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[100:140] = x[100] + rng.normal(0, 0.01, (40, 16))
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (None, x[0].tolist()), (1060, [None] * 16), (5, x[5].tolist())]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))


def test_ann_recall(spark, vectors):
    x, table = vectors
    s = ann.Settings(rows_per_list=64, block=100)
    got = ann.search(table, table.where("vec_id % 20 = 0"), 20, settings=s).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    assert set(by) == set(range(0, 900, 20))
    for q, found in by.items():
        near = x @ x[q]
        best = [k for k in np.lexsort((np.arange(900), -near)) if k != q][:20]
        ids = [i for i, _ in found]
        hits += len(set(best) & set(ids))
        assert len(set(ids)) == 20 and q not in ids and np.allclose([c for _, c in found], near[ids], rtol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(by)) >= 0.9
    assert ann.search(nothing(table), nothing(table)).count() == 0
    few = table.where("vec_id < 5")
    assert ann.search(few, few, 20).count() == 20


def test_ann_ties_at_the_rank_border(spark):
    rng = np.random.default_rng(4)
    better = np.concatenate([np.ones((15, 8)), np.arange(15)[:, None] + 1.0], 1)
    straddling = np.concatenate([better, np.tile([1.0] * 8 + [0.5], (21, 1)), rng.normal(0, 0.1, (364, 9))])
    quantised = rng.integers(-1, 2, (600, 6)).astype(float)
    for x, block in ((straddling, 4096), (quantised, 4096), (quantised, 100)):
        order = rng.permutation(len(x))
        x = x[order] + np.where((x[order] == 0).all(1), 1.0, 0.0)[:, None]
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        some = [0, 7, int(np.argmax(x[:, -1]))]
        got = defaultdict(list)
        for r in ann.search(table, table.where(F.col("vec_id").isin(some)), 20, settings=ann.Settings(rows_per_list=1024, block=block)).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        for q in some:
            near = np.einsum("ij,j->i", x, x[q])
            assert got[q] == [k for k in np.lexsort((np.arange(len(x)), -near)) if k != q][:20]


def test_ann_recall_by_reach(spark):
    """About 93 lists of which 8 are read whatever the ratio."""
    x = np.random.default_rng(8).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(table, table.where("vec_id % 40 = 0"), 20, settings=ann.Settings(rows_per_list=64, least_lists=8)).collect():
        got[r["query_id"]].add(r["vec_id"])
    near = x[::40] @ x.T
    near[np.arange(150), np.arange(0, 6000, 40)] = -np.inf
    assert sum(len(got[40 * i] & set(np.argsort(-n)[:20].tolist())) for i, n in enumerate(near)) / 3000 >= 0.95


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(1)
    g = ann.build(rng.normal(size=(4000, 8)), 300, 6.0)
    q = g.aimed(rng.normal(size=(50, 8)))
    ids, far = g.search(q, 32)
    d = np.sqrt(((q[:, None] - g.centroids[None]) ** 2).sum(2))
    assert (np.diff(far, axis=1) >= 0).all()
    assert np.mean([len(set(np.argsort(d[i])[:10]) & set(ids[i, :10])) for i in range(50)]) > 9


def removed_plain(rows, least):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - least + 1):
            w = t[p : p + least]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < i:
                gone[p : p + least] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("least", [50, 20, 5])
def test_suffix_dedup(spark, docs, least):
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in rows_of(suffix_dedup.dedup(docs, least)).items()}
    want = removed_plain(corpus(), least)
    assert got == want and sum(w[1] for w in want.values()) > 500


def test_suffix_dedup_edges(spark, docs):
    assert suffix_dedup.dedup(nothing(docs)).count() == 0
    rows = [(1, "ab" * 40), (1, "ab" * 40), (2, "ab" * 40), (None, "ab" * 40), (0, "short"), (9, "short")]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(-1, 0), (0, 0), (1, 0), (1, 0), (2, 80), (9, 0)]
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, 3)


def test_intervals_by_brute_force():
    rng = random.Random(5)
    text = np.array([rng.randrange(97, 100) for _ in range(600)], np.uint8)
    start = np.arange(0, 560)
    doc = np.array([rng.randrange(6) for _ in start])
    for least in (3, 8, 9, 14):
        raw = text.tobytes()
        want = [any(doc[j] < doc[i] and raw[j : j + least] == raw[i : i + least] for j in start) for i in start]
        assert suffix_dedup.shared_windows(text, start, doc, least).tolist() == want


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, "small"), (7, "http://c d", "small"), (5, "u", None), (6, "u", ""), (8, "http://e", "é" * 60), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).repartition(3)
    got = rows_of(warc.archive(pages), "page_id")
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 1) if i in (3, 9) else ("response", None))
    assert warc.archive(nothing(pages)).count() == 0
    manifest = warc.write(pages, f"file://{tmp_path}/w").collect()
    assert sum(m["records"] for m in manifest) == len(rows)
    payloads = {h["X-Page-ID"]: b for m in manifest for h, b in warc.records(m["path"], lambda e: e["page"] == 8)}
    assert payloads == {"8": ("é" * 60).encode()}
    for m in manifest:
        with zipfile.ZipFile(m["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64_directory():
    body, name = b"hello" * 3, b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    raw = local + body + central + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = warc.Package(lambda o, n: raw[o : o + n], len(raw))
    assert p.member(name.decode()) == body
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
    with pytest.raises(ValueError):
        warc.Package(lambda o, n: squeezed.getvalue()[o : o + n], len(squeezed.getvalue())).member("x")
    with pytest.raises(ValueError):
        warc.Package(lambda o, n: b"no zip here"[o : o + n], 11)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good[k](m)]


def test_pii_spans_by_brute_force():
    rng = random.Random(2)
    alphabet = ["a", "b@", "@", ".", "c.d", "1", "22", "4111 1111 1111 1111", "192.168.1.1", "+49 (30) 123456-7", " ", "-", "é", "+", "4111111111111111"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))
        assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == plain_spans(text), text


def test_pii(spark, docs):
    text = "Mail éa.b@x.org or call +49 30 1234567; card 4111 1111 1111 1111, order 4111 1111 1111 1112, host 10.0.0.256 10.0.0.1, IBAN DE89 3704 0044 0532 0130 00."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("t", F.lit("clash"))
    got = rows_of(pii.find(df))
    r = got[1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_iban"]) == (1, 1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text)).encode()).hexdigest()
    assert len(r["scores"].split(",")) == len(r["spans"].split(",")) == 5
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    near, far = "card 4111111111111111", "serial 4111111111111111"
    assert pii.score(near, *pii.spans_of(near)[0]) > pii.score(far, *pii.spans_of(far)[0])
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert "[EMAIL]" in masked[1] and "[IBAN]" in masked[1] and "4111 1111 1111 1111" not in masked[1] and masked[2] is None
    assert pii.find(nothing(docs)).count() == 0


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def awkward():
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdeh tionsé\n'1.") for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, "a  b\n\n c", " x", "x ", "it's  I'll don't", "<|endoftext|>a <|endoftext|> b", "aaaa" * 300, "🙂🙂 日本語", "\x1c \x1c a", " a   b", "1234567890 12 3.14", "internationalization of governments"]


def test_bpe_matches_the_library(reference_tokenizer):
    made = bpe.ByteBPE(queries.vocabulary(), cache_entries=500)
    texts = awkward()
    want = [e.ids for e in reference_tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 100):
        for text, got, ids in zip(texts[i : i + 100], made.encode_block(texts[i : i + 100]), want[i : i + 100], strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids, text
            assert made.decode(np.array(ids)).decode() == reference_tokenizer.decode(ids, skip_special_tokens=False)


def test_exact_merging_in_both_ways():
    made = bpe.ByteBPE(queries.vocabulary())
    rng = random.Random(4)
    some = ["".join(rng.choice("athebnciodr") for _ in range(rng.randrange(1, 20))).encode() for _ in range(500)]
    data, ends = np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(w) for w in some])
    ids, which = made.exact_all(data, ends - [len(w) for w in some], ends)
    assert [ids[which == i].tolist() for i in range(len(some))] == [made.exact(w) for w in some]


def test_bpe_frames(spark, docs, reference_tokenizer):
    path = queries.vocabulary()
    got = rows_of(bpe.round_trip(docs, path))
    for i, t, *_ in corpus():
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = rows_of(bpe.decode(bpe.encode(docs, path), path))
    assert {k: r["text"] for k, r in back.items()} == {i: t or "" for i, t, *_ in corpus()}
    assert bpe.round_trip(nothing(docs), path).count() == 0


def test_hamming(spark, vectors):
    x, table = vectors
    x = np.concatenate([x] * 4, 1)
    wide = table.withColumn("embedding", F.flatten(F.array_repeat("embedding", 4)))
    codes = wide.select("vec_id", hamming.sign_code("embedding").alias("code"), F.lit("clash").alias("seg"))
    got = defaultdict(list)
    for r in hamming.search(codes, codes.where("vec_id % 50 = 0"), 10).orderBy("rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    signs = {i: v > 0 for i, v in enumerate(x)} | {1020: np.zeros(64, bool)}
    assert set(got) == {q for q in signs if q % 50 == 0}
    for q, found in got.items():
        assert found == sorted((int((signs[i] != signs[q]).sum()), i) for i in signs if i != q)[:10]
    assert hamming.search(nothing(codes), nothing(codes)).count() == 0


def shingles_plain(t, n=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_plain(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_ngram_join(spark, docs):
    rng = random.Random(8)
    rows = list(corpus())
    base = words(rng, 200, 5000).split()
    for k in range(60):  # a group of near copies, some of which link only through others
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w), "en", "s", 0))
    sets = {i: shingles_plain(t) for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_plain(sets, linked)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in rows_of(ngram_join.join(df)).items()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert ngram_join.join(nothing(df)).count() == 0


def test_links_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**60, 80, dtype=np.uint64))
    sets = []
    for _ in range(300):
        own = base.copy()
        own[rng.integers(0, 80, 6)] = rng.integers(0, 2**60, 6, dtype=np.uint64)
        sets.append(np.unique(own))
    h, s = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 100 * len(k := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(k))}
    assert {(int(a), int(b)) for a, b in zip(*ngram_join.links(h, s, 80), strict=True)} == want
    half = np.arange(300) % 2 == 0
    across = {(a, b) for a, b in want if half[a] != half[b]}
    assert {(int(a), int(b)) for a, b in zip(*ngram_join.links(h, s, 80, half), strict=True)} == across


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    base = words(rng, 150, 5000).split()
    rows = []
    for k in range(50):
        w = list(base)
        w[rng.randrange(150)] = f"z{k}"
        rows.append((k, " ".join(w), "en", "s", 0))
    got = rows_of(ngram_join.join(spark.createDataFrame(rows, SCHEMA)))
    assert {r["component_id"] for r in got.values()} == {0}


def test_components(spark):
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 150), rng.randrange(150, 200)) for _ in range(80)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_plain({n for p in pairs for n in p}, pairs)
    want.pop(300)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain_in_random_order(spark):
    order = list(range(1000))
    random.Random(7).shuffle(order)
    got = components(spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, 0) for k in range(1000)}


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(spark, docs, reference_tokenizer, window):
    pieces = packing.pack(docs, queries.vocabulary(), window).collect()
    ids = {i: [*reference_tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    for i, some in by_doc.items():
        at = 0
        for p in sorted(some, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    last = max(by_sequence)
    for k, some in by_sequence.items():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at == window or k == last
    assert packing.pack(nothing(docs), queries.vocabulary()).count() == 0


def test_language(spark, docs):
    rng = random.Random(7)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["str", "pf", "ung"], "cc": ["eau", "que", "oir"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[k], k=2)) for _ in range(30)), k) for i, k in enumerate(random.Random(1).choices(list(sounds), k=300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "k", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("t", F.lit("clash"))
    got = rows_of(langid.identify(df))
    truth = {i: k for i, _, k in rows[:300]}
    for i in got:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[903]["lang_pred"] in sounds
    unlabelled = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df.where("lang = 'aa' or lang is null")).collect()} == {"aa", "und"}
    assert langid.identify(nothing(df)).count() == 0
    code = langid.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= code.shape[1] // 4


def test_pipeline_by_brute_force(spark, docs, tmp_path, reference_tokenizer):
    import corpus_pipeline

    rows = [r for r in corpus()]
    rows += [(500, "Write to me at someone@example.org about the words that nobody else has written here", "en", "s", 0), (501, "#### 1234 !!!", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    sets = {i: shingles_plain(t) for i, t in kept}
    part = components_plain(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = [(i, t) for i, t in kept if part[i] == i]
    first = {}
    for i, t in kept:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    left = {}
    for i, t in kept:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        if t := bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore"):
            left[i] = pii.masked(t)
    got = defaultdict(int)
    for p in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        got[p["doc_id"]] += p["length"]
    assert got == {i: 1 + len(reference_tokenizer.encode(t, add_special_tokens=False).ids) for i, t in left.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packed"]


def test_near_duplicates_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " tail"), (4, c), (4, d), (4, d), (7, d + " tail"), (9, c), (9, e), (None, ""), (None, ""), (3, ""), (3, ""), (8, f)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    one = [x for x in got if x[0] is None and x[1]]
    assert len(one) == 1 and one[0][1] in (b, b + " tail")
    want = [(1, a), (3, ""), (4, c), (4, d), (8, f), (9, e), (None, ""), (None, "")]
    assert sorted((x for x in got if x not in one), key=str) == sorted(want, key=str)
