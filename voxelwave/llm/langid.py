"""Operator 5: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased code points; a term's frequency is its share of the text's n-grams, its
inverse document frequency comes from all learning rows. Weights are learned by follow-the-regularised-leader (proximal,
per-coordinate rates) with elastic-net penalties on a bounded sample: at most ``PER_LANG`` rows a language, fewer with
many languages, so that all of them are learned within ``MAX_ROWS`` rows (one row a language at least). A quarter of that sample
is kept aside to fit the temperature of the softmax.

Scoring is one narrow pass: a text's logits are the mean, over its n-grams, of the rows of one (features x languages) table,
whose size is that of 65,536 weights a language, so its broadcast is bounded by their number.

Cases: a null text, or one without a letter, gets ``und`` with score 0. Without any learning row every text is ``und``. A
row whose id is null is never learned from and counts as not held out. Equal learning rows count once in the sample, rows that
share an id count each; document frequencies count all. Equal logits go to the first language in code point order. Texts of
any length are read whole, in blocks. Repeated rows repeat in the result. An empty table gives an empty table. Extra columns
are ignored, or kept by ``keep_identified``, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelwave.llm.rows import pick, place, plain
from voxelwave.runtime import ship

FEATURES = 1 << 16
GRAMS = (1, 2, 3)
PER_LANG = 512
MAX_ROWS = 1 << 15
CHUNK = 1024
SALTS = 256
BLOCK_CHARS = 1 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 0.05, 2e-4, 1e-3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each n-gram by place (len(GRAMS), chars), FEATURES where it would cross a text's end; and the text offsets."""
    lower = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)
    chars = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.full((len(GRAMS), len(chars)), FEATURES, np.int32)
    code = np.zeros(len(chars), np.uint64)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    for k, n in enumerate(GRAMS):
        m = len(chars) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + chars[n - 1 :]
        h = (code ^ (code >> np.uint64(29))) * _MULTIPLIERS[k]
        out[k, :m] = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift
        for back in range(1, n):
            ends = offsets[1:] - back
            out[k, ends[ends >= offsets[:-1]]] = FEATURES
    return out, offsets


def gram_counts(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths - n + 1, 0) for n in GRAMS)


def _text_blocks(texts: list[str | None]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= BLOCK_CHARS):
            size += len(texts[to] or "")
            to += 1
        yield [t or "" for t in texts[at:to]]
        at = to


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (FEATURES + 1, langs): idf * weight, the last row zero
    bias: np.ndarray
    temperature: float


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows; sums go through salted partial sums of fixed-size chunks."""
    ship(rows.sparkSession)

    def count(batches):
        total = np.zeros(FEATURES + 1, np.int64)
        n = 0
        for b in batches:
            for texts in _text_blocks(b.column(0).to_pylist()):
                grams, offsets = hashed(texts)
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    n += 1
                    seen = np.zeros(FEATURES + 1, bool)
                    seen[grams[:, a:z]] = True
                    total += seen
        if n:
            total[FEATURES] = n
            parts = [total[a : a + CHUNK] for a in range(0, FEATURES + 1, CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(keys, t):
        total = sum(np.frombuffer(c, np.int64) for c in t.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([keys[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    parts = rows.select("text").mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    sums = parts.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    total = np.zeros(FEATURES + 1, np.int64)
    for r in sums.collect():  # a fixed number of rows
        total[r.chunk * CHUNK : r.chunk * CHUNK + len(r.counts) // 8] = np.frombuffer(r.counts, np.int64)
    return total[:FEATURES], int(total[FEATURES])


def sample(rows: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, features, shares) of at most PER_LANG different rows of every language, least hash of the row first."""
    ship(rows.sparkSession)
    keyed = rows.select("lang", "text", F.xxhash64("id", "lang", "text").alias("h"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    found = sizes.collect()  # one row a language
    per = max(1, min(PER_LANG, MAX_ROWS // max(1, len(found))))
    langs = rows.sparkSession.createDataFrame(found, sizes.schema)
    # a hash threshold leaves about four times the rows wanted of a language (of 16 at least, so that none is left without),
    # however many it has; equal rows are one key
    wide = 4 * max(per, 16)
    near = F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * wide / F.col("n")
    keys = keyed.join(F.broadcast(langs), "lang").where((F.col("n") <= wide) | near).select("lang", "h").distinct()
    w = W.partitionBy("lang").orderBy("h")
    picked = keys.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per).select(F.col("lang").alias("_lang"), F.col("h").alias("_h"))
    # at most MAX_ROWS rows, or one a language: a bounded broadcast
    chosen = keyed.join(F.broadcast(picked), (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_lang"))).select("lang", "h", "text")

    def run(batches):
        for b in batches:
            both = []
            for t in b.column(2).to_pylist():
                grams, _ = hashed([t or ""])
                f, n = np.unique(grams, return_counts=True)
                real = f < FEATURES
                f, n = f[real], n[real]
                both.append(f.astype("<i4").tobytes() + (n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.binary())], ["lang", "h", "fv"])

    # equal rows become one before anything comes to the driver
    one = chosen.mapInArrow(run, "lang string, h long, fv binary").groupBy("lang", "h").agg(F.min("fv").alias("fv"))
    out = []
    for r in one.collect():
        n = len(r.fv) // 8
        out.append((r.lang, r.h, np.frombuffer(r.fv, "<i4", n), np.frombuffer(r.fv, "<f4", n, 4 * n).astype(float)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def fit(examples: list[tuple[str, int, np.ndarray, np.ndarray]], df: np.ndarray, n: int) -> Model | None:
    langs = sorted({e[0] for e in examples})
    if not langs:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    place = {lang: k for k, lang in enumerate(langs)}
    data = [(place[lang], f, v * idf[f]) for lang, _, f, v in examples]
    learnt = {d[0] for k, d in enumerate(data) if k % 4 != 3}
    # a language all of whose rows would be kept aside is learned from them
    aside = [k % 4 == 3 and d[0] in learnt for k, d in enumerate(data)]
    kept_aside = [d for d, a in zip(data, aside) if a]
    learn = [d for d, a in zip(data, aside) if not a]
    z, g2 = np.zeros((FEATURES + 1, len(langs))), np.zeros((FEATURES + 1, len(langs)))
    bias_at = FEATURES

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(g2[f])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learn)):
            y, f, x = learn[k]
            f, x = np.append(f, bias_at), np.append(x, 1.0)
            w = weights(f)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            was = g2[f]
            g2[f] = was + g * g
            z[f] += g - (np.sqrt(g2[f]) - np.sqrt(was)) / ALPHA * w
    w = weights(np.arange(FEATURES + 1))
    table = np.zeros((FEATURES + 1, len(langs)), np.float32)
    table[:FEATURES] = w[:FEATURES] * idf[:, None]
    raw = np.array([x @ w[f] + w[bias_at] for _, f, x in kept_aside or learn])
    y = np.array([d[0] for d in kept_aside or learn])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return Model(langs, table, w[bias_at], float(grid[int(np.argmin(loss))]))


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = [], []
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    for part in _text_blocks(texts):
        grams, offsets = hashed(part)
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        logits = np.zeros((len(part), len(model.langs)))
        if len(full):
            for row in grams:
                logits[full] += np.add.reduceat(model.table[row], offsets[:-1][full], axis=0)
        logits /= np.maximum(gram_counts(lengths), 1)[:, None]
        p = _softmax((logits + model.bias) / model.temperature)
        best = p.argmax(1)
        for k, t in enumerate(part):
            known = lettered(t)
            lang.append(model.langs[best[k]] if known else "und")
            score.append(min(1.0, float(p[k, best[k]])) if known else 0.0)
    return lang, score


def learn(rows: DataFrame) -> Model | None:
    """A model from (id, text, lang) rows."""
    ship(rows.sparkSession)
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    examples = sample(rows)
    if not examples:
        return None
    return fit(examples, *document_frequencies(rows))


def predict(df: DataFrame, model: Model | None, text: str) -> DataFrame:
    """All columns, and lang_pred and score after them. ``text`` names the text column. Narrow."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = df.columns
    at = names.index(text)

    def run(batches):
        m = shared.value
        for b in batches:
            lang, score = predict_batch(m, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _model(df: DataFrame) -> Model | None:
    return learn(pick(df, "doc_id", "text", "lang").where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(pick(df, "doc_id", "text"), _model(df), "text").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.35) -> DataFrame:
    """Rows whose language is found with a calibrated score of ``least`` or more; all columns."""
    out = predict(plain(df), _model(df), place(df, "text"))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*df.columns)
