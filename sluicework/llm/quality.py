"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from character-class and word statistics by
a small network; gated attention weighs the encodings, and the weighted sum is scored. Only document
labels are needed: the attention learns which passages carry the label. Every passage of every whole
text is encoded and weighed.

The network is fitted on the driver, with numpy, on a bounded sample (``FIT_ROWS`` labelled rows, in
the order of a hash of the id, with all their passages). Passages are encoded where the texts are
read; the driver gets the encodings alone. Scoring is a map over the rows.

Edge cases: a null or empty text is one empty passage and gets a score; without labelled rows every
score is 0.5; repeated rows each get a row; a document with several labels counts as bad if any says
so; of several texts with one id the least is learned from; rows with a null id are never learned from
and count as held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, code_points, runs, word_hashes
from .common import numbered, read_table, release, restored, whole

FIT_ROWS = 5_000
PASSAGE = 600
HIDDEN, GATE = 24, 12
#: Character classes; letters, digits and white space come from Unicode.
SIGNS = ".,!?|%*#&$-_'\"()[]{}:;<>/\\@=+~^`"


@cache
def class_table() -> np.ndarray:
    def kind(c: str) -> int:
        if c == "\n":
            return 0
        if c.isspace():
            return 1
        if c.isdigit():
            return 2
        if c.isalpha():
            return (3 if c.islower() else 4) if ord(c) < 128 else (5 if not c.isupper() else 6)
        return 8 + SIGNS.index(c) if c in SIGNS else 7

    return np.array([kind(chr(i)) for i in range(0x10000)] + [7], np.int64)


CLASSES = 8 + len(SIGNS)
COARSE = 10
FEATURES = CLASSES + COARSE * COARSE + 14


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, number of passages of each text)."""
    cps, bounds = code_points(texts)
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(cps)) - bounds[doc]
    place = first[doc] + at // PASSAGE
    cls = class_table()[np.minimum(cps, 0x10000)]
    length = np.bincount(place, minlength=n).astype(np.float64)
    safe = np.maximum(length, 1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :CLASSES] = np.bincount(place * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES) / safe[:, None]
    rough = np.minimum(cls, COARSE - 1)
    if len(cps) > 1:
        same = place[1:] == place[:-1]
        pair = (rough[:-1] * COARSE + rough[1:])[same]
        out[:, CLASSES : CLASSES + COARSE * COARSE] = np.bincount(place[1:][same] * COARSE * COARSE + pair, minlength=n * COARSE * COARSE).reshape(n, -1) / safe[:, None]
    start, end = runs(cls > 1, bounds)
    if len(start):
        where, size = place[start], end - start
        hashes = word_hashes(cps, start, end)
        words = np.bincount(where, minlength=n)
        per = np.maximum(words, 1)
        key = hashes ^ (where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, index = np.unique(key, return_index=True)
        distinct = np.bincount(where[index], minlength=n)
        step = np.zeros(len(start), bool)
        step[1:] = (hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])
        # Two-word repeats inside the document: text that runs in circles.
        two = hashes.copy()
        two[:-1] = hashes[:-1] * np.uint64(3) + hashes[1:]
        two ^= doc[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, inverse, times = np.unique(two, return_inverse=True, return_counts=True)
        again = np.bincount(where, weights=times[inverse] > 1, minlength=n)
        tail = out[:, -14:]
        tail[:, 0] = distinct / per
        tail[:, 1] = np.bincount(where, weights=step, minlength=n) / per
        tail[:, 2] = again / per
        tail[:, 3] = np.bincount(where, weights=size, minlength=n) / per / 10
        for j, (low, high) in enumerate(((1, 1), (2, 2), (3, 3), (4, 5), (6, 8), (9, 13), (14, 1 << 60))):
            tail[:, 4 + j] = np.bincount(where, weights=(size >= low) & (size <= high), minlength=n) / per
        tail[:, 11] = np.log1p(words) / 5
        tail[:, 12] = words / safe
    out[:, -1] = np.log1p(length) / 7
    return out, counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention and scorer; ``params`` are plain arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    def forward(self, x: np.ndarray, counts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.params
        x = (x - p["mean"]) / p["scale"]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.maximum(x @ p["w"] + p["b"], 0)
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        alpha = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(alpha[:, None] * h, first)
        logit = z @ p["o"] + p["c"]
        if keep is not None:
            keep |= {"x": x, "first": first, "h": h, "t": t, "g": g, "alpha": alpha, "z": z}
        return logit

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, k = self.params, {}
        d = (sigmoid(self.forward(x, counts, k)) - y) / len(y)
        out = {"o": k["z"].T @ d, "c": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * p["o"], counts, axis=0)
        dalpha = (dz * k["h"]).sum(1)
        centre = np.repeat(np.add.reduceat(dalpha * k["alpha"], k["first"]), counts)
        de = k["alpha"] * (dalpha - centre)
        out["a"] = (k["t"] * k["g"]).T @ de
        dt, dg = de[:, None] * p["a"] * k["g"] * (1 - k["t"] ** 2), de[:, None] * p["a"] * k["t"] * k["g"] * (1 - k["g"])
        out["v"], out["u"] = k["h"].T @ dt, k["h"].T @ dg
        dh = (k["alpha"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (k["h"] > 0)
        out["w"], out["b"] = k["x"].T @ dh, dh.sum(0)
        return out

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, **options) -> AttentionModel:
        parts = [features(texts[a:b]) for a, b in chunks(texts, 200_000)]
        if not parts:
            return cls.fit_passages(*features([""]), np.array([0.5]), **options)
        return cls.fit_passages(np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts]), labels, **options)

    @classmethod
    def fit_passages(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, *, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        """Fit to encoded passages, ``counts`` of them for each label."""
        rng = np.random.default_rng(seed)
        first = np.concatenate([[0], np.cumsum(counts)])
        base = float(np.clip(labels.mean(), 0.02, 0.98))
        p = {
            "mean": x.mean(0, dtype=np.float64), "scale": x.std(0, dtype=np.float64) + 0.02,
            "w": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.1, HIDDEN), "c": np.array([np.log(base / (1 - base))]),
        }
        model = cls(p)
        m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        for epoch in range(epochs if len(set(labels.tolist())) > 1 else 0):
            order = rng.permutation(len(counts))
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for s in range(0, len(order), batch):
                take = order[s : s + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in take])
                step += 1
                for k, g in model.gradients(x[rows], counts[take], labels[take]).items():
                    g = g + decay * p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for a, b in chunks(texts):
            x, counts = features(texts[a:b])
            out.append(sigmoid(self.forward(x.astype(np.float64), counts)))
        return np.concatenate(out) if out else np.zeros(0)


def remainder(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, fold: int):
    """Whether a row is kept from learning; those with a null id are."""
    return F.coalesce(remainder(id_col, folds) == fold, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, keep, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, how=F.min) -> DataFrame:
    """id, y, text of at most ``rows`` labelled rows, taken in the order of a hash of the id.

    The ids are chosen first, so that what is sent to the tasks that read the texts is bounded.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep).groupBy(F.col(id_col).alias("id")).agg(how(label).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def scored(docs: DataFrame, score, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in ``carry`` and a ``score`` of each row's whole text."""
    names = [id_col, *[c for c in carry if c != id_col]]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            values = pa.array(np.asarray(score(texts), np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), values], [*names, "score"])

    types = dict(docs.dtypes)
    return docs.select(*names, whole(text_col).alias("_body")).mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + ", score double")


def kept(docs: DataFrame, score, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores at least ``least``, with all their columns."""
    renamed, names = numbered(docs)
    columns = list(names.values())

    def run(batches):
        for batch in batches:
            values = np.asarray(score(batch.column(len(columns)).to_pylist()), np.float64)
            rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], columns)
            yield rows.filter(pa.array(values >= least))

    schema = ", ".join(f"{n} {t}" for n, t in renamed.dtypes)
    return restored(renamed.select(*columns, whole(names[text_col]).alias("body")).mapInArrow(run, schema), names)


def fit_quality(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    def encode(batches):
        for batch in batches:
            found = [features([text])[0] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"])

    chosen = labelled_texts(docs, labels, "quality", keep=~held_out("doc_id", 5, 0))
    kind = dict(docs.dtypes)["doc_id"]
    rows = chosen.mapInArrow(encode, f"id {kind}, y double, x binary").orderBy(F.xxhash64("id"), "id").select("y", "x").toArrow()
    if not len(rows):
        return AttentionModel.fit([], np.zeros(0))
    sizes = np.array([len(x) // (4 * FEATURES) for x in rows.column("x").to_pylist()])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    y = rows.column("y").to_numpy()
    del rows
    model = AttentionModel.fit_passages(x, sizes, y)
    del x
    release()
    return model


def op5(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    out = scored(docs, model.score)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
