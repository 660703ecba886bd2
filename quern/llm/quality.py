"""Compression classifier: how much better good text's dictionary packs a text than bad text's.

Two zstandard dictionaries are trained on labelled text, one of each class. A text is cut
into windows of ``WINDOW`` bytes and each is compressed with either dictionary and without
one. With the length of the text this gives four sizes, and the difference of any two over
their sum (six normalised size differences, the first of which compares the dictionaries) is
all that the score is made of: a ridge logistic regression on them and their products,
fitted on labelled texts that the dictionaries haven't seen, calibrates them into the
probability of label 1.

The sample is bounded: of each class the ``PER_CLASS`` labelled rows of the smallest id
hash, alternately for the dictionaries and for calibration; of a dictionary text all pieces
of ``PIECE`` bytes are used. Labels of rows whose crc32(id as text) mod 3 is 1 are held out
and never read in training. The score uses the text alone. Scoring is one pass without a
shuffle; the model is about 230 kB.

Edge cases: a null text is an empty one; empty texts get the score of size zero; rows with a
null id are scored and not held out; equal texts get equal scores; of several labels for one
id the lowest counts, null labels none; without labels of both classes every score is the
share of label 1 (0.5 without labels); with too little text for training, the pieces
themselves are the dictionary; empty tables give empty results; result columns replace
input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_bounded, materialize, text_bytes, tidied

WINDOW, LEVEL, DICTIONARY_BYTES = 2048, 3, 112_640
PER_CLASS, PIECE = 4000, 1024
RIDGE = 4.0  # of every weight but the constant, whatever the size of the sample


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes] | None  # good, bad
    trained: tuple[bool, bool]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float  # of label 1

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data, trained in zip(self.dictionaries, self.trained):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return [*out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]

    def probability(self, sizes: np.ndarray) -> np.ndarray:
        """sizes: rows of the four sizes (length, packed with the good dictionary, with the bad, without)."""
        if self.dictionaries is None:
            return np.full(len(sizes), self.share)
        z = (features(sizes) - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def packed_sizes(text: bytes, packers: list[zstandard.ZstdCompressor]) -> tuple[int, ...]:
    parts = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]
    return len(text), *(sum(len(p.compress(x)) for x in parts) for p in packers)


def features(sizes: np.ndarray) -> np.ndarray:
    """One, the normalised differences of the sizes, and their products."""
    n, good, bad, plain = np.asarray(sizes, "f8").reshape(-1, 4).T
    d = [(x - y) / np.maximum(x + y, 1) for x, y in ((bad, good), (plain, good), (plain, bad), (n, good), (n, bad), (n, plain))]
    return np.stack([np.ones_like(n), *d, *(d[i] * d[j] for i in range(6) for j in range(i, 6))], 1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression, by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w, ridge = (x - mean) / scale, np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + ridge @ w**2 / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return mean, scale, w


def _dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes(), True
    except zstandard.ZstdError:  # too few samples
        return b"".join(pieces)[:DICTIONARY_BYTES], False


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, piece = [], []
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            cut = [t.as_py()[i : i + PIECE] for i in range(0, len(t.as_py()), PIECE)]
            label += [y] * len(cut)
            piece += cut
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(piece, pa.binary())], ["label", "piece"])


def _sizes(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.value.compressors()
        for batch in batches:
            found = [packed_sizes(t.as_py(), packers) for t in batch.column(1)]
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["label", "n", "good", "bad", "plain"])

    return run


def is_held_out(key) -> object:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    none = QualityModel(None, (False, False), np.zeros(0), np.zeros(0), np.zeros(0), share)
    if len(total) < 2:
        return none
    listed = [(r.id, y, i % 2) for y in (0, 1) for i, r in enumerate(known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS).collect())]
    kind = known.schema["id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(listed, f"id {kind}, label int, part int"))  # 2 * PER_CLASS rows at most
    sample = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text")).join(chosen, "id").select("label", "text", "part")
    sample = materialize(sample, "quality-sample")
    pieces: tuple[list[bytes], list[bytes]] = ([], [])
    for r in sample.where("part = 0").select("label", "text").mapInArrow(_pieces, "label int, piece binary").collect():
        pieces[r.label].append(bytes(r.piece))
    if not pieces[0] or not pieces[1]:
        return none
    made = [_dictionary(sorted(p)) for p in (pieces[1], pieces[0])]
    model = QualityModel((made[0][0], made[1][0]), (made[0][1], made[1][1]), np.zeros(0), np.zeros(0), np.zeros(0), share)
    sizes = sample.where("part = 1").select("label", "text").mapInArrow(_sizes(spark.sparkContext.broadcast(model)), "label int, n bigint, good bigint, bad bigint, plain bigint").collect()
    sizes.sort(key=tuple)  # whatever order the tasks end in, the same model
    y = np.array([r.label for r in sizes], "f8")
    if len(set(y.tolist())) < 2:
        return none
    model.mean, model.scale, model.weights = _calibrate(features(np.array([r[1:] for r in sizes])), y)
    return model


def _score(model, text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        packers = m.compressors() if m.dictionaries else None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                texts = [t.as_py() or b"" for t in batch.column(text_at).cast(pa.binary())]
                sizes = np.array([packed_sizes(t, packers) if packers else (len(t), 0, 0, 0) for t in texts], "f8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(m.probability(sizes))], schema)], schema=schema)

    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``score_col``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select(*[c for c in docs.columns if c.lower() != score_col.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    return byte_bounded(kept).mapInArrow(tidied(_score(docs.sparkSession.sparkContext.broadcast(model), kept.columns.index(text_col), to_arrow_schema(schema))), schema)
