"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed into ``BUCKETS``: words, word pairs,
byte trigrams and pairs of word shapes.  Each indicator is scaled by the log
ratio of its smoothed class shares (naive Bayes), and a linear hinge-loss model
is fitted to the scaled indicators by dual coordinate descent.  A logistic
curve over margins of rows left out of a fold turns margins into probabilities.

The fit takes at most ``MAX_TRAIN`` labelled documents, chosen by hash of their
id over the whole table; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, U64, as_bytes, grams, mix, words
from .scratch import small_batches

BUCKETS = 1 << 18
#: Bound of the labelled documents that the model is fitted on.
MAX_TRAIN = 10_000
_STAMP = np.full(BUCKETS, -1, dtype=np.int64)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + U64(salt)) & U64(BUCKETS - 1)).astype(np.int64)


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small code of each word: first letter and rest upper case, digits, marks at the end and inside, length class."""
    up, digit, mark = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (_UPPER, _DIGIT, _MARK))
    length = ends - starts
    first = _UPPER[raw[starts]].astype(np.int64)
    rest = (up[ends] - up[starts] - first) * 2 > length
    last = _MARK[raw[ends - 1]]
    many = mark[ends] - mark[starts]
    sized = np.searchsorted([2, 4, 8, 16, 32], length, side="right")
    return first + 2 * rest + 4 * (digit[ends] > digit[starts]) + 8 * last + 16 * np.minimum(many, 3) + 64 * sized


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct buckets of each text's n-grams. An empty text has none."""
    for w in words(texts, SPACED):
        raw = w.raw
        n = len(w.starts)
        single, pair = _slot(w.hashes, 1), _slot(grams(w.hashes, 2), 2)
        shape = _shapes(raw, w.starts, w.ends) if n else np.zeros(0, dtype=np.int64)
        twice = np.zeros(n, dtype=np.int64)
        twice[1:] = w.hashes[1:] == w.hashes[:-1]
        shape = shape * 2 + twice
        shapes = _slot(shape[:-1].astype(U64) * U64(4096) + shape[1:].astype(U64), 3) if n > 1 else shape[:0]
        low = raw.astype(U64)
        triple = _slot((low[:-2] << U64(16)) | (low[1:-1] << U64(8)) | low[2:], 4) if len(low) > 2 else shape[:0]
        for i in range(w.hi - w.lo):
            s = w.of(i)
            if s.stop == s.start:
                yield np.zeros(0, dtype=np.int64)
                continue
            a, b = int(w.base[i]), int(w.base[i + 1]) - 1
            found = np.concatenate([single[s], pair[s.start : s.stop - 1], shapes[s.start : s.stop - 1], triple[a : max(a, b - 2)]])
            order = np.arange(len(found))
            _STAMP[found] = order
            yield found[_STAMP[found] == order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [f.astype(np.int32) for f in features(as_bytes(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold")), pa.array([f.tobytes() for f in lists], pa.binary())], names=["id", "label", "fold", "buckets"])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of min (|w|^2 + b^2) / 2 + cost * sum max(0, 1 - y (w x + b)), by dual coordinate descent.

    Each dual variable stays in the box [0, cost] of the linear hinge loss.  The
    bias is the weight of a constant feature.  Rows are scaled indicators,
    normalised to unit length so that long texts do not dominate.
    """
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
    square = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for k in rng.permutation(len(rows)):
            r, v = rows[k], values[k]
            slope = y[k] * (w[r] @ v + bias) - 1.0
            new = min(cost, max(0.0, alpha[k] - slope / square[k]))
            step = (new - alpha[k]) * y[k]
            if step:
                w[r] += step * v
                bias += step
                alpha[k] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def class_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed indicator counts of the classes."""
    p, q = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def margin(row: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    v = ratio[row]
    return float(w[row] @ v / max(np.sqrt((v * v).sum()), 1e-12) + bias)


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b])
        s = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> dict:
    """Model: scaled weights (ratio and w), bias and curve. ``y`` is 1 or -1; one class gives a constant score."""
    share = (np.sum(y > 0) + 1) / (len(y) + 2)
    flat = {"ratio": np.zeros(BUCKETS, dtype=np.float32), "w": np.zeros(BUCKETS, dtype=np.float32), "bias": 0.0, "a": 0.0, "b": float(np.log(share / (1 - share)))}
    if len(set(y.tolist())) < 2:
        return flat
    left, seen = [], []
    for part in (0, 1):
        inside, outside = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
        if len(set(y[inside].tolist())) < 2 or not len(outside):
            continue
        some = [rows[k] for k in inside]
        ratio = class_ratio(some, y[inside])
        w, bias = descend(some, y[inside], ratio)
        left += [margin(rows[k], ratio, w, bias) for k in outside]
        seen += y[outside].tolist()
    ratio = class_ratio(rows, y)
    w, bias = descend(rows, y, ratio)
    a, b = _platt(np.array(left), np.array(seen)) if len(set(seen)) == 2 else (2.0, 0.0)
    return {"ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "bias": bias, "a": a, "b": b}


def _fit_here(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, y, fold = [], [], []
    for g in groups:
        rows += [np.frombuffer(b, dtype=np.int32) for b in g["buckets"]]
        y += np.where(g["label"] == 1, 1, -1).tolist()
        fold += g["fold"].tolist()
    m = fit(rows, np.array(y), np.array(fold))
    yield pd.DataFrame({"ratio": [m["ratio"].tobytes()], "w": [m["w"].tobytes()], "bias": [m["bias"]], "a": [m["a"]], "b": [m["b"]]})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> dict:
    """Fit on at most ``max_train`` labelled documents, chosen by the hash of their id, one row each.

    Rows whose label is null or neither 0 nor 1, or whose id is null, are not
    used; of several labels of one id the smallest counts, of several texts one
    (the least by its buckets), and labels without a document use nothing of the
    bound.  Without usable rows of both classes the model scores everything by
    the class share.  One task fits, on ``max_train`` lists of at most
    ``BUCKETS`` numbers whatever the texts' lengths; only the model (about 2 MB)
    reaches the driver.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    usable = usable.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    chosen = usable.withColumn("h", F.xxhash64(F.lit(17), "id")).orderBy("h", "id").limit(max_train).select("id", "label", (F.pmod("h", F.lit(2))).cast("int").alias("fold"))
    # at most max_train rows of three numbers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "fold", "text")
    kept = rows.mapInArrow(_rows, "id long, label int, fold int, buckets binary").groupBy("id", "label", "fold").agg(F.min("buckets").alias("buckets"))
    got = kept.repartition(1).sortWithinPartitions("label", "buckets").mapInPandas(_fit_here, "ratio binary, w binary, bias double, a double, b double").collect()
    if not got:
        return fit([], np.zeros(0), np.zeros(0))
    r = got[0]
    return {"ratio": np.frombuffer(r["ratio"], dtype=np.float32), "w": np.frombuffer(r["w"], dtype=np.float32), "bias": r["bias"], "a": r["a"], "b": r["b"]}


def _score(batches: Iterator[pa.RecordBatch], model, text_col: str, row_col: str | None) -> Iterator[pa.RecordBatch]:
    m = model.value
    ratio, w = m["ratio"].astype(np.float64), m["w"].astype(np.float64)
    both = ratio * w
    for batch in batches:
        z = []
        for f in features(as_bytes(batch.column(batch.num_columns - 1) if row_col is None else batch.column(row_col).field(text_col))):
            length = np.sqrt((ratio[f] ** 2).sum())
            z.append(both[f].sum() / max(length, 1e-12) + m["bias"])
        p = 1 / (1 + np.exp(-np.clip(m["a"] * np.array(z) + m["b"], -35, 35)))
        kept = batch.num_columns - (row_col is None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p, pa.float64())], names=[*batch.schema.names[:kept], "score"])


def score(docs: DataFrame, model: dict, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), row_col: str | None = None) -> DataFrame:
    """Columns ``keep`` and the score, the probability of label 1, of every whole text.

    ``row_col`` names a struct among ``keep`` of which the text is a field; it
    is then not sent twice.  Null and empty texts have no n-grams and get the
    score of the bias alone.  Repeated rows score alike, an empty table gives no
    rows, and columns that ``keep`` does not name are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # a name of its own for the text, should it be kept too
    rows = docs.select(*keep, *([] if row_col else [F.col(text_col).alias("__scored")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(partial(_score, model=spark.sparkContext.broadcast(model), text_col=text_col, row_col=row_col), f"{schema}, score double")


def held_out(id_column):
    """The fold of contract: crc32 of the id as text, mod 5, is 0; labels of such rows are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))
