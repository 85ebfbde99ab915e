"""Quality classifier: a byte-level convolutional network in numpy.

``filters`` learned filters of ``width`` bytes run over every place of a text. A filter is a table with a weight for each
byte value at each of its places, so a response is a sum of look-ups. Responses are max-pooled over chunks of ``chunk``
places (the bytes of neighbouring chunks overlap by width - 1), the chunks cover the whole text, their pooled responses
are averaged, and a small hidden layer combines the averages into one probability.

Fitting takes a bounded sample: at most ``per_class`` labelled documents of each class, of each at most ``fit_chunks``
chunks evenly spread over the whole text, and a few words of it as a text of their own, in one task. Scoring reads every byte of every text, map-only.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import bounded_batches, held_out, table
from agentlens.llm.labelled import labelled

WIDTH, FILTERS, HIDDEN, CHUNK = 5, 16, 12, 512
SLICE = 1 << 16


def responses(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(places, filters) of the bytes ``data``; the last width - 1 bytes start no place."""
    n = len(data) - len(tables) + 1
    out = tables[0].take(data[:n], axis=0)
    for k in range(1, len(tables)):
        out += tables[k].take(data[k : k + n], axis=0)
    return out


def pooled(text: bytes, tables: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The mean over chunks of each filter's largest response, from 0 up; long texts are taken in slices."""
    w = len(tables)
    data = np.frombuffer(text + bytes(max(0, w - len(text))), np.uint8)
    places, total, n = len(data) - w + 1, np.zeros(tables.shape[2], np.float64), 0
    for i in range(0, places, SLICE):
        r = responses(data[i : min(i + SLICE, places) + w - 1], tables)
        best = np.maximum.reduceat(r, np.arange(0, len(r), chunk), axis=0)
        total += np.maximum(best, 0).sum(axis=0)
        n += len(best)
    return total / n


def empty_model() -> dict[str, np.ndarray]:
    """Scores everything 0.5."""
    return {"tables": np.zeros((WIDTH, 256, FILTERS), np.float32), "u": np.zeros((FILTERS, HIDDEN)), "c": np.zeros(HIDDEN), "v": np.zeros(HIDDEN), "d": np.zeros(1)}


def head(model: dict[str, np.ndarray], features: np.ndarray) -> np.ndarray:
    z = np.maximum(features @ model["u"] + model["c"], 0) @ model["v"] + model["d"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chunks_of(text: str | None, fit_chunks: int, chunk: int = CHUNK) -> bytes:
    """At most ``fit_chunks`` chunks, evenly spread from the first to the last, zero bytes where a text ends early."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = chunk + WIDTH - 1
    n = max(1, -(-len(data) // chunk))
    at = sorted(set(np.linspace(0, n - 1, min(n, fit_chunks)).round().astype(int)))
    return b"".join(data[i * chunk : i * chunk + size].ljust(size, b"\0") for i in at)


def crop(text: str | None) -> str:
    """A short stretch of whole words from a place and of a length that the text decides: short texts are judged too."""
    words = (text or "").split()
    pick = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    n = 1 + pick % 12
    at = (pick >> 8) % max(1, len(words) - n)
    return " ".join(words[at : at + n])


def fit(blobs: list[bytes], y: np.ndarray, epochs: int = 10, rate: float = 0.01, keep: float = 0.85, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the cross entropy; class 1 has the part ``keep`` of the weight, whatever its part of the sample. The gradient of max pooling goes to the bytes of the
    winning place only."""
    if len(set(y.tolist())) < 2:
        return empty_model()
    rng, size = np.random.default_rng(seed), CHUNK + WIDTH - 1
    model = empty_model() | {"tables": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "u": rng.normal(0, 0.4, (FILTERS, HIDDEN)), "v": rng.normal(0, 0.4, HIDDEN)}
    moments = {k: [np.zeros_like(x, np.float64), np.zeros_like(x, np.float64)] for k, x in model.items()}
    weight = np.where(y == 1, keep / y.mean(), (1 - keep) / (1 - y.mean()))
    chunks = [np.frombuffer(b, np.uint8).reshape(-1, size) for b in blobs]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 32):
            at = order[i : i + 32]
            data = np.concatenate([chunks[j] for j in at])
            owner = np.repeat(np.arange(len(at)), [len(chunks[j]) for j in at])
            per = np.bincount(owner, minlength=len(at))
            r = model["tables"][0][data[:, :CHUNK]]
            for k in range(1, WIDTH):
                r += model["tables"][k][data[:, k : k + CHUNK]]
            win = r.argmax(axis=1)
            best = np.take_along_axis(r, win[:, None, :], axis=1)[:, 0, :]
            features = np.zeros((len(at), FILTERS))
            np.add.at(features, owner, np.maximum(best, 0))
            features /= per[:, None]
            inner = features @ model["u"] + model["c"]
            hidden = np.maximum(inner, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model["v"] + model["d"], -30, 30)))
            dz = (p - y[at]) * weight[at] / len(at)
            dh = np.outer(dz, model["v"]) * (inner > 0)
            df = (dh @ model["u"].T / per[:, None])[owner] * (best > 0)
            dt = np.zeros((WIDTH, 256, FILTERS))
            for k in range(WIDTH):
                np.add.at(dt[k], (np.take_along_axis(data, win + k, axis=1), np.arange(FILTERS)[None, :]), df)
            grads = {"tables": dt, "u": features.T @ dh, "c": dh.sum(0), "v": hidden.T @ dz, "d": np.array([dz.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + 1e-5 * model[k]
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                model[k] = (model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(model[k].dtype)
    return model


def _saved(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, fit_chunks: int = 6) -> dict[str, np.ndarray]:
    """The model of at most 2 * per_class documents of fit_chunks + 1 chunks at most; the empty one without both labels."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cut_off in (lambda t: t, crop):
                yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "blob": [chunks_of(cut_off(t), fit_chunks) for t in b["text"]]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "blob"])
        return pd.DataFrame({"model": [_saved(fit(pdf["blob"].tolist(), pdf["y"].to_numpy(np.float64)))]})

    rows = labelled(docs, labels, label, per_class).select("doc_id", "y", "text").mapInPandas(cut, "doc_id long, y int, blob binary")
    made = rows.groupBy().applyInPandas(train, "model binary").collect()
    return dict(np.load(io.BytesIO(made[0]["model"]))) if made else empty_model()


def scores(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    """The network's probability for each text; 0 for null and empty ones."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    features = np.array([pooled(t, model["tables"]) for t in data]).reshape(len(data), -1)
    return np.where([len(t) > 0 for t in data], head(model, features), 0.0)


def scored(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """``docs`` with doc_id and text's score and predicted. Null and empty texts score 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(score=scores(b["text"].tolist(), shipped.value))

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= 0.5).

    The score is the network's probability of quality 1. Labels of held-out ids (crc32 of the id modulo 3 is 1) are never
    used, nor any other column than text. Null and empty texts score 0. Without labels of both classes every other text
    scores 0.5. Repeated rows are scored each by itself; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    return scored(docs, fitted(docs, labels, per_class=per_class))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns: each is judged where it is read, by its
    text alone (null and empty ones go), and nothing is shuffled. Repeated rows and null ids are rows like others."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class=per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text").to_pylist(), shipped.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
