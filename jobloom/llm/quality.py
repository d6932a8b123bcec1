"""Quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is cut into chunks of
`CHUNK` bytes and each chunk, so the whole text, is compressed with either; the sizes, summed, give the normalised
difference (bad - good) / (bad + good). A logistic model over this difference and the compressed size per byte (which
tells endless repetition from prose) makes it a probability; the model is fitted on labelled texts that no dictionary
has seen.

What is learnt comes from bounded samples, taken by hash over all labelled rows: at most `DICT_ROWS` texts of each class
for the dictionaries (a piece of at most `PIECE` characters of each, from a place chosen by hash), and at most `CAL_ROWS`
texts of each class, whole, for the calibration. Rows whose crc32(doc_id) mod 4 is 2 are never learnt from. Labels, lang,
source and doc_id are no inputs of a score.

Defined cases: a null text is scored as the empty text, whose difference and size are 0; a null doc_id counts as the
empty string for the folds; null labels are ignored, as are documents with contradicting ones; with labels of one class
only, or none, the score is the smoothed share of good ones; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import extended, pick, raw, sealed, table, unsealed

NAME = "op1_quality"
SQL = None
DICT_ROWS = 2000
CAL_ROWS = 6000
PIECE = 8192
DICT_BYTES = 262144
CHUNK = 512
LEVEL = 3
THRESHOLD = 0.7


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; of few texts, their bytes themselves."""
    parts = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    own = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **own)


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The normalised difference of the compressed sizes, and the log of the size per byte with the good dictionary."""
    if not text:
        return 0.0, 0.0
    empty = len(good.compress(b""))
    g = b = 0
    for i in range(0, len(text), CHUNK):
        part = text[i : i + CHUNK]
        g += len(good.compress(part)) - empty
        b += len(bad.compress(part)) - empty
    g, b = max(g, 1), max(b, 1)
    return (b - g) / (b + g), float(np.log(g / len(text)))


def terms(diff: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(diff), 10 * diff, 10 * np.abs(diff), size, size * size], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, by Newton's method; only the intercept, smoothed, where there is one class."""
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]


def _measured(docs: DataFrame, good: bytes, bad: bytes, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text and keys): keys, diff and size."""
    sent = docs.sparkSession.sparkContext.broadcast((good, bad))  # at most 2 * DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = (compressor(x) for x in sent.value)
        for batch in batches:
            found = np.array([features(t or b"", g, b) for t in raw(batch.column("text"))], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(found[:, 0]), pa.array(found[:, 1])], [*keys, "diff", "size"])

    docs = pick(docs, list(dict.fromkeys([*keys, "text"])))
    return docs.mapInArrow(run, extended(docs, [*keys], "diff double, size double"))


def fold(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality) outside the held-out fold."""
    docs = pick(docs, ["doc_id", "text"])
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top"))
    known = known.filter("q = top").drop("top").withColumn("fold", fold()).filter("fold <> 2").withColumn("h", F.xxhash64("doc_id"))

    def sample(folds: tuple[int, ...], n: int) -> DataFrame:
        """The first n ids of each class by hash, with their class: bounded, so it may be broadcast."""
        own = known.filter(F.col("fold").isin(*folds))
        ids = [own.filter(F.col("q") == q).orderBy("h", "doc_id").limit(n).select("doc_id", "q") for q in (0, 1)]
        return F.broadcast(ids[0].union(ids[1]))

    start = 1 + F.expr(f"pmod(xxhash64(doc_id), greatest(1, length(text) - {PIECE} + 1))").cast("int")
    pieces = docs.join(sample((0, 1), DICT_ROWS), "doc_id").withColumn("piece", F.substring("text", start, PIECE))
    pieces = pieces.groupBy("doc_id", "q").agg(F.min("piece").alias("piece"))
    texts: tuple[list, list] = ([], [])
    for row in sorted(pieces.collect()):
        texts[row.q].append((row.piece or "").encode("utf-8", "surrogatepass"))
    good, bad = dictionary(texts[1]), dictionary(texts[0])
    chosen = docs.join(sample((3,), CAL_ROWS), "doc_id")
    measured = _measured(chosen.select("doc_id", "text"), good, bad).groupBy("doc_id").agg(F.min("diff").alias("diff"), F.min("size").alias("size"))
    rows = sorted(measured.join(known.select("doc_id", "q", "fold"), "doc_id").select("doc_id", "diff", "size", "q").collect())
    # The sample may thin out the larger class: the weights give each class back its share among the labelled rows.
    shares = {r.q: r.n for r in known.filter("fold = 3").groupBy("q").agg(F.count("*").alias("n")).collect()}
    x = terms(np.array([r.diff for r in rows], float), np.array([r["size"] for r in rows], float))
    y = np.array([r.q for r in rows], float)
    w = fit_logistic(x, y)
    if len(shares) == 2 and 0 < y.sum() < len(y):
        w[0] += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, w.tolist())


def score(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and score (0 to 1, higher: good likelier) of each row of docs (text and keys)."""
    w, size = model.weights, F.col("size")
    logit = w[0] + w[1] * 10 * F.col("diff") + w[2] * 10 * F.abs("diff") + w[3] * size + w[4] * size * size  # as in terms()
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))
    return _measured(docs, model.good, model.bad, keys).select(*keys, (1 / (1 + F.exp(-logit))).alias("score"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    return unsealed(score(sealed(docs), model, ("rest", "text")).filter(F.col("score") >= threshold), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
