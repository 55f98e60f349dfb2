"""Text quality by compression: how well dictionaries of good and of bad text compress a document.

Two zstandard dictionaries are built from labelled text.  A text's compressed sizes under both and
without any, each relative to its length, and the normalised difference of the first two make a score
by logistic regression, fitted on labelled rows that the dictionaries have not seen.

Fitting uses a bounded sample: ``DICTIONARY_ROWS`` rows of each label and ``CALIBRATION_ROWS`` rows in
their natural proportion, those of the smallest md5 of their id, without texts over ``LONGEST_FITTED``
characters.  Scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftlog.llm.columns import field, map_batches, slices, texts_of, without

DICTIONARY_ROWS = 1_000  # of each label
CALIBRATION_ROWS = 4_000
LONGEST_FITTED = 32_768
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
PENALTY = 1e-3


@dataclass(frozen=True)
class Model:
    good: bytes  # dictionaries
    bad: bytes
    low: tuple[float, ...]  # range of the features among the rows of the regression: beyond it they count as its edge
    high: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the first is the intercept


def _compressors(good: bytes, bad: bytes) -> list:
    import zstandard

    out = []
    for content in (good, bad, b""):
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        if content:
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(LEVEL)
            options["dict_data"] = dictionary
        out.append(zstandard.ZstdCompressor(**options).compress)
    return out


def _features(compressors: list, texts: list[str]):
    """The normalised difference, the sizes' logarithms relative to the text, and its length."""
    import numpy as np

    size = np.empty((len(texts), 4))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        size[i] = *(len(c(data)) for c in compressors), len(data) + 8
    good, bad, plain, raw = size.T
    return np.column_stack([
        (bad - good) / (bad + good), np.log(good / raw), np.log(bad / raw), np.log(plain / raw), np.log(raw) / 10])


def _products(base):
    import numpy as np

    n = base.shape[1]
    return np.column_stack([base, *(base[:, i] * base[:, j] for i in range(n) for j in range(i, n))])


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    data = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it is the dictionary
        return b"\n".join(data)[:DICTIONARY_BYTES]


def _logistic(x, y):
    """Newton's method with a small quadratic penalty."""
    import numpy as np

    z = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(z.shape[1]), PENALTY * np.r_[0, np.ones(x.shape[1])]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty + 1e-9), slope)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit_texts(dictionary_rows: list[tuple[str, int]], calibration_rows: list[tuple[str, int]]) -> Model:
    """With only one label, or none, every text gets that label's share (a half without labels)."""
    import numpy as np

    good, bad = (_dictionary([t for t, label in dictionary_rows if label == kind]) for kind in (1, 0))
    rows = calibration_rows or dictionary_rows
    labels = np.array([label for _, label in rows], float)
    base = _features(_compressors(good, bad), [t for t, _ in rows]) if rows else np.zeros((1, 5))
    x = _products(base)
    edges = tuple(base.min(0).tolist()), tuple(base.max(0).tolist())
    if not good or not bad or labels.min(initial=1) == labels.max(initial=0):
        share = (sum(label for _, label in dictionary_rows) + labels.sum() + 1) / (len(dictionary_rows) + len(rows) + 2)
        zeros = (0.0,) * x.shape[1]
        return Model(good, bad, *edges, zeros, (1.0,) * x.shape[1], (float(np.log(share / (1 - share))), *zeros))
    center, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - center) / scale, labels)
    return Model(good, bad, *edges, tuple(center.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    use: Column | None = None,
) -> Model:
    """Fit on rows of ``labels`` (of label 0 or 1, and where ``use``, over its columns, holds) that have a text.

    The sample of ids is bounded, so it is broadcast; an id with several texts counts with the smallest.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.filter(use) if use is not None else known
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    place = F.md5(F.col("id").cast("string"))
    known = known.withColumn("place", place).withColumn("part", F.conv(F.substring("place", -1, 1), 16, 10).cast("int") % 2)
    by_label = Window.partitionBy("label").orderBy("place")
    picked = known.filter("part = 0").withColumn("n", F.row_number().over(by_label)).filter(
        F.col("n") <= DICTIONARY_ROWS).drop("n").unionByName(
        known.filter("part = 1").orderBy("place").limit(CALIBRATION_ROWS))
    texts = documents.select(documents[doc_id].alias("id"), documents[text].alias("text")).filter(
        F.length("text") <= LONGEST_FITTED)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "part", "label", "place").agg(
        F.min("text").alias("text")).collect()  # at most 2 * DICTIONARY_ROWS + CALIBRATION_ROWS
    rows.sort(key=lambda r: r.place)
    return fit_texts(*([(r.text, r.label) for r in rows if r.part == part] for part in (0, 1)))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out``, the calibrated chance (0 to 1) of label 1; null is scored as the empty text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = without(df.columns if keep is None else keep, [out])
    schema = T.StructType([*(field(df, c) for c in kept), T.StructField(out, T.DoubleType(), False)])
    width = len(kept)

    def make(batches):
        import numpy as np
        import pyarrow as pa

        m = sent.value
        compressors = _compressors(m.good, m.bad)
        low, high, center, scale, w = map(np.array, (m.low, m.high, m.center, m.scale, m.weights))
        for batch in batches:
            for part in slices(batch, width):
                base = np.clip(_features(compressors, texts_of(part.column(width))), low, high)
                x = (_products(base) - center) / scale
                p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(p)], names=schema.names)

    return map_batches(df.select(*(df[c] for c in kept), df[text].alias("__text")), make, schema)
