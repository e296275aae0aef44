"""Language identification with error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one linear classifier per bit looks at n-gram frequencies. Decoding adds up each
bit's loss against each codeword, weighted by how well the bit was learnt, and takes the least. A small lead over
the second is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, blocks

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Lower case for ASCII letters, one mark for everything else below 0x80: digits and signs say nothing of a language.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of bits
    bits: int  # of the feature hash

    @property
    def n_features(self) -> int:
        return 1 << self.bits


def grams(at: np.ndarray, data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of rows laid end to end, and the row of each; trigrams across two rows are left out."""
    x = FOLD[data]
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(size - 2, 0))
    if not row.size:
        return np.zeros(0, np.int64), row
    n = len(row)
    start = np.arange(n) + np.repeat(at[:-1] - at[0] - (np.cumsum(np.maximum(size - 2, 0)) - np.maximum(size - 2, 0)), np.maximum(size - 2, 0))
    h = (x[start] * np.uint32(0x9E3779B1)) ^ (x[start + 1] * np.uint32(0x85EBCA77)) ^ (x[start + 2] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)).astype(np.int64), row


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All splits in two for up to 5 languages; beyond, the best of some random codes by least distance of any pair."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, float).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if (np.abs(code.sum(0)) < n).all() and apart.min() > most:
            best, most = code, apart.min()
    return best


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: remainder 2 is held out of training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, per_language: int = 600, bits: int = 12, rounds: int = 200, most_languages: int = 500) -> Model:
    """Fits on a bounded sample: of each language, the `per_language` labelled documents outside the held-out
    remainder whose id hashes least. Whole texts count; only n-gram frequencies of the sample reach the driver
    (at most languages x per_language x 2^bits numbers). More than `most_languages` different labels are an error,
    since everything that is held grows with their number."""
    known = docs.where((bucket_of(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(shares) > most_languages:
        raise ValueError(f"over {most_languages} different labels")
    if not shares:
        return Model((), np.ones((0, 0)), np.zeros((1 << bits, 0)), np.zeros(0), np.zeros(0), bits)
    # an id is in the sample if its hash is under its language's cut, which leaves about per_language of them
    below = {lang: 2 * min(1.0, per_language / n) - 1 for lang, n in shares.items()}
    cuts = F.create_map(*[F.lit(x) for lang, b in sorted(below.items()) for x in (lang, int(b * (1 << 63)) if b < 1 else (1 << 63) - 1)])
    cut = F.element_at(cuts.cast("map<string,bigint>"), F.col("lang"))
    sample = known.where(F.xxhash64(F.col("doc_id")) <= cut).select("lang", F.col("text").cast("binary").alias("t"))

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = as_bytes(batch.column("t"))
            for i, j in blocks(at):
                out = []
                for k in range(i, j):
                    g, _ = grams(at[k : k + 2], data[at[k] : at[k + 1]], bits)
                    out.append(np.bincount(g, minlength=1 << bits).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array(out, pa.binary())], ["lang", "counts"])

    rows = sample.mapInArrow(counts, "lang string, counts binary").collect()
    languages = tuple(sorted(shares))
    label = np.array([languages.index(r["lang"]) for r in rows], int)
    x = np.stack([np.frombuffer(r["counts"], "<f4") for r in rows]) if rows else np.zeros((0, 1 << bits), np.float32)
    return train(languages, label, x, bits, rounds)


def train(languages: tuple[str, ...], label: np.ndarray, x: np.ndarray, bits: int, rounds: int) -> Model:
    """Logistic regression of every code bit at once, by accelerated gradient steps."""
    codes = codewords(len(languages))
    n_bits = codes.shape[1]
    if not n_bits or not len(x):
        return Model(languages, codes, np.zeros((1 << bits, n_bits)), np.zeros(n_bits), np.ones(n_bits), bits)
    x = (30 * x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)  # single precision throughout, or BLAS would copy x in each step
    y = codes[label].astype(np.float32)
    share = np.bincount(label, minlength=len(languages))[label]
    each = (1 / np.maximum(share, 1))[:, None].astype(np.float32)
    each /= each.sum()
    w, v, b = np.zeros((x.shape[1], n_bits), np.float32), np.zeros((x.shape[1], n_bits), np.float32), np.zeros(n_bits, np.float32)
    step = np.float32(4) / max(1e-9, float((each * (x * x).sum(1, keepdims=True)).sum() + 1))
    for k in range(rounds):
        g = each * (-y / (1 + np.exp(np.clip(y * (x @ v + b), -30, 30))))
        new = v - np.float32(step) * (x.T @ g + np.float32(1e-6) * v)
        b = b - np.float32(step) * g.sum(0)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    right = ((np.sign(x @ w + b) == y) * each).sum(0)
    trust = np.log(np.clip(right, 0.5, 1 - 1e-3) / (1 - np.clip(right, 0.5, 1 - 1e-3))) + 1e-3
    return Model(languages, codes, w, b, trust / trust.sum(), bits)


def _outputs(at: np.ndarray, data: np.ndarray, model: Model, weights: np.ndarray) -> np.ndarray:
    """Bit values of rows laid end to end. A row of fewer than three bytes has the bias alone."""
    g, row = grams(at - at[0], data[at[0] : at[-1]], model.bits)
    n = len(at) - 1
    out = np.zeros((n, weights.shape[1]))
    if row.size and out.shape[1]:
        first = np.concatenate([[0], np.nonzero(np.diff(row))[0] + 1])
        sums = np.stack([np.add.reduceat(weights[:, k][g], first, dtype=np.float64) for k in range(weights.shape[1])], 1)
        out[row[first]] = 30 * sums / np.diff(np.append(first, len(row)))[:, None]
    return out + model.bias


def _judged(texts: pa.Array, model: Model, weights: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language (their count: undetermined), score and ambiguity of each text."""
    at, data = as_bytes(texts)
    letters = np.fromiter((LETTER.search(str(data[a:b].data, "utf-8")) is not None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), bool, len(at) - 1)
    best = np.full(len(at) - 1, len(model.languages))
    top, close_call = np.zeros(len(best)), np.zeros(len(best), bool)
    if len(model.languages):
        for i, j in blocks(at):
            f = _outputs(at[i : j + 1], data, model, weights)
            loss = (np.logaddexp(0, -f[:, None, :] * model.codes[None]) * model.trust).sum(2) if model.codes.shape[1] else np.zeros((j - i, 1))
            share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            best[i:j], top[i:j] = share.argmax(1), share.max(1)
            if share.shape[1] > 1:
                two = np.sort(share, 1)[:, -2:]
                close_call[i:j] = two[:, 1] - two[:, 0] < close
    best[~letters], top[~letters], close_call[~letters] = len(model.languages), 0, True
    return best, top, close_call


def _share(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model, model.weights.astype(np.float32)))  # 2^bits x code bits numbers, whatever the input


def predict(docs: DataFrame, model: Model, close: float = 0.1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every whole text, without a shuffle.

    A null text, and one without a letter, is `und` with score 0, and so is every text if nothing was learnt. The
    score is the best language's share of exp(-loss); `ambiguous` is set if the second one's is within `close` of
    it. Repeated rows give repeated results. A null id isn't held out. Other columns are ignored.
    """
    shared = _share(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value[0].languages, UNDETERMINED], object)
        for batch in batches:
            best, top, close_call = _judged(batch.column("t"), *shared.value, close)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(top), pa.array(close_call)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = F.coalesce(bucket_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text has a language: `und` goes, ambiguous texts stay."""
    shared, at = _share(docs, model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, _ = _judged(batch.column(at), *shared.value, 0)
            yield batch.filter(pa.array(best < len(shared.value[0].languages)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, per_language: int = 600, bits: int = 12) -> DataFrame:
    """predict() with a model that fit() learns from the same documents: held-out rows and those without a label take
    no part in it. An empty table gives no rows."""
    return predict(docs, fit(docs, per_language, bits))
