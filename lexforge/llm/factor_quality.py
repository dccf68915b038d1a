"""Quality classifier: a factorisation machine.

Features are hashed words (log counts, scaled to length 1), structure statistics and the
stored length, each cut into steps. Every pair of features interacts through the product of
their low-rank vectors, and the sum over all pairs is had in linear time as half the
difference of the square of the sum and the sum of the squares.

The machine is fitted on the driver, on at most ``sample`` labelled rows chosen by hash;
scoring reads whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, sums, text_parts, word_hashes, word_spans

WORD_BITS = 16
STEPS = 12


@dataclass(frozen=True)
class Fit:
    sample: int = 6000
    rank: int = 8
    epochs: int = 16
    rate: float = 0.08
    decay: float = 1e-3
    seed: int = 3


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "digit": _class(b"0123456789"),
    "symbol": _class(b"#*$%&<>^~=_@\\{}[]"),
    "bar": _class(b"|"),
    "shout": _class(b"!?"),
    "stop": _class(b".,;:"),
    "line": _class(b"\n"),
    "wide": np.concatenate([np.zeros(128, np.uint8), np.ones(128, np.uint8)]),
}
STATS = [*CLASSES, "word length", "words", "distinct", "line words", "stored length"]


def _step(share: np.ndarray, top: float = 1.0) -> np.ndarray:
    """Steps on a square-root scale: fine near zero, where most shares lie."""
    return np.clip(np.sqrt(np.clip(share / top, 0, 1)) * (STEPS - 1), 0, STEPS - 1).astype(np.int64)


def featurise(texts: pa.Array, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts end to end, and each text's first (n + 1).

    ``stored`` holds the stored lengths, negative where unknown.
    """
    data, offs = text_parts(texts)
    begin, end, first = word_spans(data, offs)
    docs = len(offs) - 1
    h = word_hashes(LOWER[data], begin, end)
    doc = np.repeat(np.arange(docs), np.diff(first))
    key, n = np.unique((doc.astype(np.uint64) << np.uint64(WORD_BITS)) | (h >> np.uint64(64 - WORD_BITS)), return_counts=True)
    owner = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    value = 1 + np.log(n)
    cuts = np.searchsorted(owner, np.arange(docs + 1))
    scale = np.sqrt(sums(value * value, cuts))
    value = value / np.maximum(scale, 1e-9)[owner]

    size, words = np.maximum(np.diff(offs), 1), np.diff(first)
    counts = {name: sums(table[data].astype(np.int64), offs) for name, table in CLASSES.items()}
    steps = [_step(counts[name] / size, 0.5) for name in CLASSES]
    steps.append(np.clip(size / np.maximum(words, 1), 0, STEPS - 1).astype(np.int64))
    steps.append(np.clip(np.log2(words + 1), 0, STEPS - 1).astype(np.int64))
    steps.append(_step(np.diff(cuts) / np.maximum(words, 1)))
    steps.append(np.clip(np.log2(words / (counts["line"] + 1) + 1), 0, STEPS - 1).astype(np.int64))
    steps.append(np.where(stored < 0, 0, 1 + np.clip(np.log2(np.maximum(stored, 1)) / 2, 0, STEPS - 2)).astype(np.int64))
    extra = np.stack([(1 << WORD_BITS) + k * STEPS + s for k, s in enumerate(steps)], 1)

    width = extra.shape[1]
    starts = cuts + width * np.arange(docs + 1)
    number, out = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32)
    at = np.arange(len(key)) + width * owner
    number[at], out[at] = (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32), value
    place = (starts[1:] - width)[:, None] + np.arange(width)
    number[place], out[place] = extra, 1 / np.sqrt(width)
    return number, out, starts


class Machine:
    def __init__(self, rule: Fit):
        rng = np.random.default_rng(rule.seed)
        n = (1 << WORD_BITS) + len(STATS) * STEPS
        self.bias, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, rule.rank)).astype(np.float32)

    def raw(self, number: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Linear part plus half of (square of sums - sum of squares)."""
        vx = self.v[number] * value[:, None]
        s = sums(vx, starts)
        return self.bias + sums(self.w[number] * value, starts) + 0.5 * ((s * s).sum(1) - sums((vx * vx).sum(1), starts))

    def gradient(self, number: np.ndarray, value: np.ndarray, starts: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the logistic loss summed over rows: by the bias, the features met, and by their weights and vectors."""
        row = np.repeat(np.arange(len(label)), np.diff(starts))
        vx = self.v[number] * value[:, None]
        s = sums(vx, starts)
        z = self.bias + sums(self.w[number] * value, starts) + 0.5 * ((s * s).sum(1) - sums((vx * vx).sum(1), starts))
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - label).astype(np.float32)
        used, inv = np.unique(number, return_inverse=True)
        dw, dv = np.zeros(len(used), np.float32), np.zeros((len(used), self.v.shape[1]), np.float32)
        np.add.at(dw, inv, g[row] * value)
        np.add.at(dv, inv, (g[row] * value)[:, None] * (s[row] - vx))
        return float(g.sum()), used, dw, dv

    def fit(self, number, value, starts, label, rule: Fit) -> Machine:
        rng = np.random.default_rng(rule.seed)
        gw, gv, gb = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        rate = label.mean()
        self.bias = float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
        for _ in range(rule.epochs):
            order = rng.permutation(len(label))
            for part in np.array_split(order, max(1, len(order) // 128)):
                n = starts[part + 1] - starts[part]
                row = np.repeat(np.arange(len(part)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[part][row]
                cut = np.concatenate([[0], np.cumsum(n)])
                db, used, dw, dv = self.gradient(number[at], value[at], cut, label[part])
                dw += rule.decay * self.w[used]
                dv += rule.decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += db**2
                self.w[used] -= rule.rate * dw / np.sqrt(gw[used])
                self.v[used] -= rule.rate * 0.3 * dv / np.sqrt(gv[used])
                self.bias -= 0.02 * db / np.sqrt(gb)
        return self


def _stored(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)


def _inputs(df: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    stored = F.col(length_col).cast("long") if length_col and length_col in df.columns else F.lit(-1).cast("long")
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), stored.alias("stored"))


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, length_col: str | None = "n_chars", rule: Fit = Fit()) -> Machine:
    """A machine fitted on at most ``rule.sample`` rows of ``labels`` (id, label 0 or 1).

    Null labels and ids are left out; an id with several labels counts with the greatest.
    Without labelled rows the machine scores 0.5 on the whole.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(rule.seed), "id"), "id").limit(rule.sample)  # the sample's bound is the broadcast's bound
    rows = _inputs(df, id_col, text_col, length_col).join(F.broadcast(chosen), "id").select("id", "text", "stored", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                number, value, starts = featurise(part.column(1), _stored(part))
                blobs = [[x[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])] for x in (number, value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), *(pa.array(b, pa.binary()) for b in blobs)], names=["id", "label", "number", "value"])

    got = rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, label double, number binary, value binary").toArrow().sort_by("id")
    machine = Machine(rule)
    if not got.num_rows:
        return machine
    numbers = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("number")]
    values = [np.frombuffer(x.as_buffer(), np.float32) for x in got.column("value")]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    return machine.fit(np.concatenate(numbers), np.concatenate(values), starts, got.column("label").to_numpy(), rule)


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """(id, score) of each row, the score in 0..1. Null texts count as empty; empty texts get
    the score of their statistics alone. Repeated rows are scored each; an empty table gives
    an empty one; there are no ties to break. Other columns are dropped, so names cannot clash."""
    model = df.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.__new__(Machine)
        m.bias, m.w, m.v = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                z = m.raw(*featurise(part.column(1), _stored(part))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    out = _inputs(df, id_col, text_col, length_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)
