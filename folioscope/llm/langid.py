"""Language identification by a byte-level convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window and classified by softmax. The
network is trained in numpy on labelled text and applied to every window of every text: windows have a fixed length,
and a document's probabilities are the means over its windows, weighted by the bytes that each holds.

Defined results: a null or empty text, or one without letters, gets language ``und`` and confidence 0; texts are read
whole, of any length; rows with a null doc_id are classified too; repeated rows each get their own row; ties go to the
language that sorts first; extra columns, of any names, are ignored (``identify``) or kept
(``reject``); an empty table gives an empty result, and no labelled rows give ``und`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common, textkit

WINDOW = 128
WIDTHS = (2, 3, 4)
#: Bound of the labelled rows that the network is fitted on; all rows are then classified.
TRAIN_ROWS = 3000
#: Labelled rows that a language needs.
LEAST_ROWS = 15
REJECT_CONFIDENCE = 0.9
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """Multi-width byte convolution, ReLU, max pooling, softmax."""

    labels: list[str]
    dim: int = 4
    filters: int = 12
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        wide = max(WIDTHS)
        kernel = rng.normal(0, 0.5, (wide, self.dim, self.filters * len(WIDTHS)))
        for k, width in enumerate(WIDTHS):
            kernel[width:, :, k * self.filters : (k + 1) * self.filters] = 0
        self.weights = {
            "embed": rng.normal(0, 1, (256, self.dim)).astype(np.float32),
            "kernel": kernel.reshape(wide * self.dim, -1).astype(np.float32),
            "shift": np.zeros(self.filters * len(WIDTHS), np.float32),
            "head": rng.normal(0, 0.3, (self.filters * len(WIDTHS), len(self.labels))).astype(np.float32),
            "bias": np.zeros(len(self.labels), np.float32),
        }

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of each place and its successors: (windows, places, width x dim)."""
        embedded = self.weights["embed"][windows]
        places = windows.shape[1] - max(WIDTHS) + 1
        return np.concatenate([embedded[:, k : k + places] for k in range(max(WIDTHS))], axis=2)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        w = self.weights
        columns = self._columns(windows)
        out = np.empty((len(windows), columns.shape[1], w["kernel"].shape[1]), np.float32)
        np.matmul(columns, w["kernel"], out=out)
        pooled = np.maximum(out.max(axis=1) + w["shift"], 0)
        return pooled @ w["head"] + w["bias"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.logits(windows)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on cross entropy; gradients by hand."""
        self.start()
        w, rng = self.weights, np.random.default_rng(self.seed + 1)
        wide, total = max(WIDTHS), self.filters * len(WIDTHS)
        mask = np.zeros((wide, self.dim, total), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[:width, :, k * self.filters : (k + 1) * self.filters] = 1
        mask = mask.reshape(wide * self.dim, total)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x, n = windows[rows], len(rows)
                columns = self._columns(x)
                conv = columns @ w["kernel"]
                best = conv.argmax(axis=1)
                pooled = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + w["shift"]
                active = np.maximum(pooled, 0)
                z = active @ w["head"] + w["bias"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), target[rows]] -= 1
                p /= n
                back = (p @ w["head"].T) * (pooled > 0)
                picked = np.take_along_axis(columns[:, :, None, :], best[:, None, :, None], 1)[:, 0]
                grad_embed = np.zeros_like(w["embed"])
                into = (back[:, :, None] * w["kernel"].T[None]).reshape(n, total, wide, self.dim)
                for k in range(wide):
                    np.add.at(grad_embed, np.take_along_axis(x, best + k, 1), into[:, :, k])
                grads = {
                    "embed": grad_embed,
                    "kernel": np.einsum("nf,nfk->kf", back, picked) * mask,
                    "shift": back.sum(axis=0),
                    "head": active.T @ p,
                    "bias": p.sum(axis=0),
                }
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, one after another: (windows x WINDOW bytes, text number, bytes held).

    A text's last window is moved back to end with the text, so that it is full where the text is long enough; its
    weight is the bytes that no earlier window holds. Shorter texts are padded with zeros.
    """
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), count)
    if not len(doc):
        return np.zeros((0, WINDOW), np.uint8), doc, doc
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    held = np.minimum(WINDOW, lengths[doc] - nth * WINDOW)
    start = np.maximum(0, np.minimum(nth * WINDOW, lengths[doc] - WINDOW))
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    at = (offsets[doc] + start)[:, None] + np.arange(WINDOW)
    out = padded[at]
    short = lengths[doc] < WINDOW
    out[short] = np.where(np.arange(WINDOW) < lengths[doc][short][:, None], out[short], 0)
    return out, doc, held


def classify(model: ByteCnn, texts: pa.Array) -> np.ndarray:
    """(texts, labels) mean probabilities; zero rows for texts without letters."""
    out = np.zeros((len(texts), len(model.labels)))
    for at, part in textkit.chunks(texts):
        raw, offsets = textkit.buffers(pc.utf8_lower(part))
        windows, doc, held = windows_of(raw, offsets)
        letter = (windows >= 128) | ((windows >= 97) & (windows <= 122))
        weight = held * letter.any(axis=1)
        probs = np.empty((len(windows), len(model.labels)), np.float32)
        for k in range(0, len(windows), 64):
            probs[k : k + 64] = model.probabilities(windows[k : k + 64])
        for label in range(len(model.labels)):
            out[at : at + len(part), label] = np.bincount(doc, probs[:, label] * weight, len(part))
        total = np.bincount(doc, weight, len(part))
        out[at : at + len(part)] /= np.maximum(total, 1)[:, None]
    return out


def train(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, seed: int = 11, least: int = LEAST_ROWS) -> ByteCnn | None:
    """A network fitted on at most ``rows`` labelled documents, as many of each language, three random windows of each.

    None where no row is labelled. A language needs ``least`` labelled rows to be learnt, whatever its share; of more
    than rows / least languages the most frequent are learnt.
    """
    labelled = docs.where(F.col(label).isNotNull() & (F.length("text") > 0)).select("doc_id", "text", F.col(label).alias("_label"))
    counts = labelled.groupBy("_label").count().where(F.col("count") >= least).orderBy(F.desc("count"), "_label").limit(max(1, rows // least)).collect()
    if not counts:
        return None
    quota = rows // len(counts)
    # Rows with the lowest seeded hashes of each language: about a third more than needed is sent, the rest goes here.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["_label"], int(min(1.0, quota * 1.35 / r["count"]) * (1 << 30)))])
    mark = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / share[F.col("_label")]
    picked = labelled.withColumn("_mark", mark).where("_mark < 1").orderBy("_mark", "doc_id").limit(2 * rows)
    sample = picked.toPandas().groupby("_label", sort=False).head(quota)
    names, label = sorted(r["_label"] for r in counts), "_label"
    rng = np.random.default_rng(seed)
    picked, target = [], []
    for text, name in zip(sample["text"], sample[label], strict=True):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        found, _, _ = windows_of(raw, np.array([0, len(raw)]))
        for k in rng.permutation(len(found))[:3]:
            picked.append(found[k])
            target.append(names.index(name))
    model = ByteCnn(names)
    model.fit(np.stack(picked), np.array(target))
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """(doc_id, lang, lang_pred, confidence, p_declared) of every row; the last is null where ``lang`` is not learnt."""
    schema = "doc_id long, lang string, lang_pred string, confidence double, p_declared double"

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            declared = batch.column("lang").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *_judge(model, batch.column("text"), declared)],
                names=["doc_id", "lang", "lang_pred", "confidence", "p_declared"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(common.lean(batches), schema)


def _judge(model: ByteCnn | None, texts: pa.Array, declared: list) -> list[pa.Array]:
    if model is None:
        none = [None] * len(texts)
        return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts)), pa.array(none, pa.float64())]
    p = classify(model, texts)
    best, top = p.argmax(axis=1), p.max(axis=1)
    place = {name: k for k, name in enumerate(model.labels)}
    own = [float(p[k, place[name]]) if name in place else None for k, name in enumerate(declared)]
    names = [model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, top, strict=True)]
    return [pa.array(names), pa.array(top), pa.array(own, pa.float64())]


def reject(docs: DataFrame, model: ByteCnn | None, confidence: float = REJECT_CONFIDENCE) -> DataFrame:
    """docs without the rows whose language cannot be told, or is another than the declared with that confidence.

    Rows that declare no language, or one that was not learnt, stay where some language was recognised. Without a
    model nothing is rejected. All columns are kept; the decision is made in the same pass over the text.
    """
    if model is None:
        return docs
    schema = docs.schema

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            declared = batch.column(schema.names.index("lang")).to_pylist()
            names, top, own = (x.to_pylist() for x in _judge(model, batch.column(schema.names.index("text")), declared))
            keep = [
                name != UNKNOWN and (o is None or name == d or t < confidence)
                for name, t, o, d in zip(names, top, own, declared, strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(common.lean(batches), schema)
