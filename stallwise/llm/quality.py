"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded from
what its bytes and words look like; a gated attention, learned with the encoder from the
documents' labels, weighs the passages, and the weighted sum is scored. Language, source and
ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.llm.rolling import Powers, Words

PASSAGE = 50
# The fit uses at most so many labelled documents, all passages of each.
SAMPLE = 4_000
HIDDEN, GATES = 16, 8
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
FOLDS = 5

LOWER, UPPER, DIGIT, POINT, BANG, SIGN, HIGH, SPACE = range(8)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:], KINDS[32] = LOWER, UPPER, DIGIT, HIGH, SPACE
KINDS[[ord(c) for c in ".,;:'?-()\""]] = POINT
KINDS[ord("!")] = BANG
FEATURES = 16


def passages(text: str | None, powers: Powers) -> np.ndarray:
    """One row of features per passage of ``PASSAGE`` words; a text without words is one row of zeros."""
    words = Words((text or "").encode().split(), powers)
    n = words.count
    if not n:
        return np.zeros((1, FEATURES))
    first = np.arange(0, n, PASSAGE)
    sizes = np.diff(np.append(first, n)).astype(float)
    kinds = KINDS[words.bytes]
    begins = words.starts[first]
    spans = np.diff(np.append(begins, len(kinds))).astype(float)
    shares = [np.add.reduceat(kinds == k, begins, dtype=np.int64) / spans for k in range(SPACE)]
    hashes = words.grams(1)
    lengths = (words.ends - words.starts).astype(float)
    same = np.append(False, hashes[1:] == hashes[:-1]).astype(float)
    ends = kinds[words.ends - 1]
    loud = (kinds[words.starts] == UPPER) & (kinds[np.maximum(words.starts, words.ends - 2)] != LOWER) & (lengths > 1)
    bare = (lengths == 1) & (ends == SIGN)
    # Distinct words of a passage: the last one is filled up with numbers that occur once.
    padded = np.concatenate([hashes, np.arange((-n) % PASSAGE, dtype=np.uint64)]).reshape(-1, PASSAGE)
    padded = np.sort(padded, axis=1)
    distinct = 1 + (padded[:, 1:] != padded[:, :-1]).sum(1) - np.append(np.zeros(len(first) - 1), (-n) % PASSAGE)
    per_word = [
        np.add.reduceat(x, first) / sizes
        for x in (lengths, same, (ends == SIGN).astype(float), (ends == BANG).astype(float), loud.astype(float), bare.astype(float), (ends == POINT).astype(float))
    ]
    return np.stack([*shares, *per_word, distinct / sizes, np.log1p(sizes)], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        return sigmoid(forward(x, starts, self.weights)["logit"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(x: np.ndarray, starts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Encodings, gates, attention of each passage in its bag, and the bags' logits."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["score"] + w["score0"]}


def gradients(x: np.ndarray, starts: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    f = forward(x, starts, w)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    wrong = (sigmoid(f["logit"]) - y) / len(y)
    dz = wrong[:, None] * w["score"]
    towards = (dz[bag] * h).sum(1)
    de = a * (towards - np.add.reduceat(a * towards, starts)[bag])
    dt, dg = de[:, None] * w["attend"] * g * (1 - t**2), de[:, None] * w["attend"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h**2)
    return {
        "encode": x.T @ dh, "encode0": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg,
        "attend": ((t * g) * de[:, None]).sum(0), "score": f["z"].T @ wrong, "score0": wrong.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Adam over shuffled batches of bags; without any bag a model that scores one half."""
    rng = np.random.default_rng(seed)
    d = FEATURES
    w = {
        "encode": rng.normal(0, d**-0.5, (d, HIDDEN)), "encode0": np.zeros(HIDDEN),
        "tanh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)),
        "attend": rng.normal(0, GATES**-0.5, GATES), "score": np.zeros(HIDDEN), "score0": np.zeros(1),
    }
    if not bags:
        return Model(np.zeros(d), np.ones(d), w)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(0), np.maximum(everything.std(0), 1e-3)
    bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            sizes = [len(bags[i]) for i in mine]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            found = gradients(np.concatenate([bags[i] for i in mine]), starts, labels[mine], w)
            step += 1
            for k, grad in found.items():
                grad = grad + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        out = [passages(text.as_py(), powers).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "bag"])


def scoring(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            bags = [passages(x.as_py(), powers) for x in batch.column("text")]
            if bags:
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(int)
                scores = model.scores(np.concatenate(bags), starts)
            else:
                scores = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(scores, pa.float64())], ["doc", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows from which nothing is learned; a null id counts as an empty one and is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents, chosen by a hash of doc_id.

    ``labels`` (doc_id, quality): null labels are ignored; a document with several labels
    counts as good if most of them say so. Held-out documents and null ids are not used. Of
    rows with the same doc_id the text of the smallest hash is used.
    """
    usable = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    present = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by the sample size; a passage of 50 words comes back as 128 bytes.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row of each document, whatever its id repeats.
    own = F.struct(F.xxhash64("text").alias("hash"), "text")
    texts = texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(own).alias("own")).select("label", "own.text")
    rows = texts.mapInArrow(encoding, "label double, bag binary").collect()
    rows = sorted(((r["label"], bytes(r["bag"])) for r in rows), key=lambda r: (r[1], r[0]))
    bags = [np.frombuffer(b).reshape(-1, FEATURES) for _, b in rows]
    return fit(bags, np.array([y for y, _ in rows]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): every row of ``docs`` as a struct, and its score from 0 to 1.

    All passages of a text count. A null or empty text is one passage of nothing and is scored
    like any other.
    """
    rows = docs.select(F.struct("*").alias("doc"), "text")
    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(scoring(model), schema)
