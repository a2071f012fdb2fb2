"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a good labelled document before a bad one) train a linear
score by logistic loss on feature differences. The threshold is the quantile of
the training scores at the share of bad documents, and scores are moved so that
it lies at ``CUT``.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers

#: A document is kept from this score on.
CUT = 0.3
#: At most this many labelled rows are used for fitting: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Partners that each labelled document is paired with.
PARTNERS = 8
RIDGE = 1e-3

_MARKS = b"!#$%&*|.,:;-_=+<>/\\()[]{}\"'?@~^`"
_CLASSES = np.zeros((8, 256))
_CLASSES[0, ord("A") : ord("Z") + 1] = 1
_CLASSES[1, ord("a") : ord("z") + 1] = 1
_CLASSES[2, ord("0") : ord("9") + 1] = 1
_CLASSES[3, list(b" \t\r\x0b\x0c")] = 1
_CLASSES[4, ord("\n")] = 1
_CLASSES[5, 128:] = 1
_CLASSES[6, list(_MARKS)] = 1
_CLASSES[7, list(b"!#$%&*|<>{}[]\\^~_=")] = 1


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: shares of characters, words and lines of several kinds. Empty texts give zeros but for a flag."""
    n = len(text)
    if not n:
        return np.append(1.0, np.zeros(FEATURES - 1))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = _CLASSES @ counts / n
    marks = counts[list(b"!#$%&*|.,?")] / n
    words = text.split()
    m = max(1, len(words))
    same = sum(map(operator.eq, words, words[1:])) / m
    distinct = len(set(words)) / m
    shout = sum(map(bytes.isupper, words)) / m
    title = sum(map(bytes.istitle, words)) / m
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / m
    lines = text.split(b"\n")
    lines_distinct = len(set(lines)) / len(lines)
    length = np.log1p(n)
    word = sum(map(len, words)) / m
    base = np.array([same, shout, alone, title, distinct, lines_distinct, word / 10, *shares, *marks])
    steep = np.log1p(1000 * np.array([same, shout, alone, shares[0], shares[7], shares[2], *marks]))
    # distinct words fall with length by themselves
    return np.concatenate([[0.0, length / 10, np.log1p(m) / 10, distinct * length / 10, np.log(distinct + 1e-3)], base, steep])


FEATURES = 5 + 7 + 8 + 10 + 6 + 10


def fit_pairs(x: np.ndarray, good: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scales of the score: Newton steps on the logistic loss of feature differences."""
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    z = x / scale
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(x.shape[1])
    if not len(up) or not len(down):
        return w, scale
    a = np.concatenate([np.repeat(up, PARTNERS), rng.choice(up, PARTNERS * len(down))])
    b = np.concatenate([rng.choice(down, PARTNERS * len(up)), np.repeat(down, PARTNERS)])
    d = z[a] - z[b]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = d.T @ p / len(d) - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w, scale


class Ranker:
    """A fitted score: ``scores`` of raw feature rows lie in 0 to 1."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.fitted = bool(good.any() and not good.all())
        self.w, self.scale = fit_pairs(x, good)
        raw = x / self.scale @ self.w
        self.threshold = float(np.quantile(raw, 1 - good.mean())) if self.fitted else 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        at = x / self.scale @ self.w - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def _with_features(rows: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text, and ``x``."""
    kept = [f for f in rows.schema.fields if f.name != text_col]

    def run(batches):
        for batch in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(x, pa.list_(pa.float64()))], names=[*[f.name for f in kept], "x"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def held_out(doc_id) -> F.Column:
    """Rows that are never fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Ranker:
    """Fit on at most ``fit_rows`` labelled documents that are not held out.

    Labels that are null or have a null id are left out; of several labels of one
    document the smallest holds, and of several texts of one id the one with the
    smallest features. Null and empty texts have features too, and texts are read
    whole. Without a pair of a good and a bad document, as in an empty table, all scores
    are 0.5.
    """
    prepare_workers(docs.sparkSession, 512)
    one = F.col("id")
    sample = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("y"))
        .filter("id is not null and y is not null")
        .filter(~held_out(one))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # The sample is bounded, so it is broadcast and no text is shuffled.
    # One row an id, however often the documents repeat it, so what comes to the driver is bounded too.
    described = _with_features(texts.join(F.broadcast(sample), "id"), "text").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = described.toPandas().sort_values("id")
    if not len(rows):
        return Ranker(np.zeros((1, FEATURES)), np.ones(1, bool))
    return Ranker(np.vstack(rows["x"].to_numpy()), rows["y"].to_numpy() > 0)


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``score`` and ``predicted`` of each row; other columns are ignored.

    Null and empty texts get a score too. Repeated rows and null ids stay as they
    are. An empty table gives an empty result. Texts are read whole, however long.
    """
    prepare_workers(docs.sparkSession, 512)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.vstack([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ranker.scores(x))], names=["id", "score"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows that score ``CUT`` or more, with the input's columns.

    Null and empty texts are scored like others; repeated rows are kept or dropped
    alike, and ids and other columns, whatever their names, play no part. An empty
    table stays empty.
    """
    prepare_workers(docs.sparkSession, 512)
    text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.vstack([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(text)])
                kept = batch.filter(pa.array(ranker.scores(x) >= CUT))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
