"""Quality by compression.

Two zstandard dictionaries are built, one from well-labelled and one from
badly labelled text. A text is compressed in pieces with either; the
difference of the two sizes over the text's length says which dictionary
knows it better. A logistic curve, fitted on labelled texts that neither
dictionary has seen, turns the difference into a probability.

Fitting uses a bounded sample of the labelled rows: ``SAMPLE_DOCS`` of each
label, ``SAMPLE_PIECES`` pieces of each text for the dictionaries. All labels
are counted, and the curve weighs each label by its true share. Scoring
reads every whole text inside the tasks, without a shuffle; the model (two
dictionaries of ``DICTIONARY_BYTES`` and a few floats) travels in the task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revledger.llm.common import only, prepare

PIECE = 2048
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: labelled rows of each label that the model is fitted on, at most
SAMPLE_DOCS = 1500
#: pieces of a sampled text that go into a dictionary, at most
SAMPLE_PIECES = 8
FOLDS = 5
THRESHOLD = 0.3


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def spread(items: list, n: int) -> list:
    """``n`` of the items at even steps, or all if fewer."""
    return items if len(items) <= n else [items[i * len(items) // n] for i in range(n)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few."""
    raw = b"".join(samples)
    if len(samples) >= 32 and len(raw) > 4 * DICTIONARY_BYTES:
        try:
            return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstd.ZstdError:
            pass  # the trainer refuses samples that are too alike
    return raw[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of a text with each dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for d in (good, bad, b""):
            known = zstd.ZstdCompressionDict(d) if d else None
            if known is not None:
                known.precompute_compress(level=LEVEL)
            self.coders.append(zstd.ZstdCompressor(level=LEVEL, dict_data=known,
                                                   write_content_size=False))

    def features(self, text: str | None) -> list[float]:
        """Difference of sizes, plain size, both for each byte of the text;
        short texts count less."""
        parts = pieces(text)
        n = sum(map(len, parts))
        if not n:
            return [0.0, 0.0, 0.0]
        good, bad, plain = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        trust = n / (n + 40.0)
        difference = (bad - good) / n
        return [trust * max(-0.3, min(0.3, difference)), trust * (bad - good) / (bad + good),
                trust * (min(plain / n, 1.0) - 0.5)]


@dataclass
class QualityModel:
    """Dictionaries and the calibration curve over :meth:`Sizes.features`."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    bias: float = 0.0

    def scorer(self):
        sizes, w, b = Sizes(self.good, self.bad), self.weights, self.bias

        def score(text: str | None) -> float:
            z = b + sum(x * y for x, y in zip(w, sizes.features(text)))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
        return score


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50,
              counts: np.ndarray | None = None):
    """Logistic regression by Newton steps on scaled features. ``counts``
    says how many rows each row stands for (one)."""
    c = np.ones(len(x)) if counts is None else counts * (len(x) / counts.sum())
    mean = (c[:, None] * x).mean(axis=0)
    scale = np.maximum(np.sqrt((c[:, None] * (x - mean) ** 2).mean(axis=0)), 1e-6)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (c * (p - y)) + penalty @ w
        hessian = (a * (c * (p * (1 - p) + 1e-9))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return (w[:-1] / scale).tolist(), float(w[-1])


def held_out(id_col: str = "doc_id"):
    """The rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0,
                      F.lit(False))


def known_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, label) of the documents that are not held out. A document
    with both labels counts as bad; rows without id or label are left out."""
    return (only(labels, doc_id="doc_id", label=label_col)
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.min("label").alias("label")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
                    sample_docs: int = SAMPLE_DOCS):
    """[(text, label)] of at most ``sample_docs`` rows of each label that are
    not held out (:func:`known_labels`), in the order of a hash of their id."""
    ids = known_labels(labels, label_col).withColumn("_order", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = [ids.filter(F.col("label") == q).orderBy("_order", "doc_id").limit(sample_docs)
              for q in (0, 1)]
    # at most 2 * sample_docs rows: a proven bound
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = only(docs, _id="doc_id", text="text")
    found = texts.join(chosen, F.col("_id") == F.col("doc_id")).select("doc_id", "label", "_order", "text")

    def cut(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"doc_id": r["doc_id"], "label": int(r["label"]), "_order": r["_order"],
                  "parts": spread(pieces(r["text"]), SAMPLE_PIECES)} for r in rows],
                schema=pa.schema([("doc_id", pa.int64()), ("label", pa.int32()),
                                  ("_order", pa.int64()), ("parts", pa.list_(pa.binary()))]))

    parts = found.mapInArrow(cut, "doc_id long, label int, _order long, parts array<binary>")
    parts = parts.groupBy("doc_id", "label", "_order").agg(F.min("parts").alias("parts"))
    return [(r["parts"] or [], r["label"]) for r in parts.orderBy("_order", "doc_id").collect()]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Dictionaries from every other sampled text, the curve from the rest,
    in which each label has the weight of all its documents that are not held
    out, so that the size of the sample does not move the scores. With labels of one kind only, or none, every score is their share
    (smoothed)."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, sample_docs)
    counts = known_labels(labels, label_col).filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()
    total = {0: 0, 1: 0} | {int(r["label"]): r["count"] for r in counts}
    share = (total[1] + 1) / (total[0] + total[1] + 2)
    flat = QualityModel(bias=float(np.log(share / (1 - share))))
    known, rest = [], []
    for q in (0, 1):
        rows = [s for s in sample if s[1] == q]
        known.append([p for parts, _ in rows[::2] for p in parts])
        rest += rows[1::2]
    if not all(map(any, known)) or len({q for _, q in rest}) < 2:
        return flat
    bad, good = map(build_dictionary, known)
    sizes = Sizes(good, bad)
    x = np.array([sizes.features(b"".join(parts).decode("utf-8", "replace")) for parts, _ in rest])
    y = np.array([q for _, q in rest], dtype=float)
    weights, bias = fit_curve(x, y, counts=np.where(y == 1, total[1] / y.sum(), total[0] / (len(y) - y.sum())))
    return QualityModel(good, bad, weights, bias)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone.

    A null or empty text gets the curve's value for no evidence. Repeated
    rows stay repeated, extra columns are ignored."""
    prepare(docs.sparkSession)
    base = only(docs, doc_id=id_col, text=text_col)

    def run(batches):
        one = model.scorer()
        for b in batches:
            scores = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, score double")
