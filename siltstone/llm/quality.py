"""Quality by attention-based multiple-instance learning: passages are encoded, weighed by gated attention that is
learned from document labels, and the weighted passage is scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch
from siltstone.llm.labels import labelled_sample
from siltstone.llm.shingles import U, mix, word_hashes

#: Words of a passage, and labelled documents that training reads.
PASSAGE, SAMPLE = 128, 8_000
#: Sizes of a passage's encoding and of the attention's hidden layer.
CODE, HIDDEN = 12, 8

#: Classes of bytes whose shares describe a passage: fixed values.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"%$#&*", b".", b",", b"\n", b"<>{}[]=;", b"-_/\\:'\"()?@+^~`"]
#: Signed sums of hashed words, a passage's bag of words.
HASHED = 32
SHAPE = len(CLASSES) + 6 + HASHED


def passages(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of SHAPE numbers for each passage of PASSAGE words of the whole texts, and each text's number of passages.
    A text without words has one passage, all zeros."""
    words, edge = word_hashes(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    n_words = np.diff(edge)
    counts = np.maximum(1, -(-n_words // PASSAGE))
    out = np.zeros((counts.sum(), SHAPE))
    if not len(words):
        return out, counts
    code = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(CLASSES):
        code[list(chars)] = i + 1
    code[0x80:] = len(CLASSES) + 1
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    gap = space[data]
    head = ~gap & np.concatenate([[True], gap[:-1]])
    text_at = np.repeat(np.arange(len(parts)), lengths + 1)[: len(data)]
    nth = np.cumsum(head) - 1 - edge[text_at]
    row = (np.cumsum(counts) - counts)[text_at] + np.maximum(0, nth) // PASSAGE
    width = len(CLASSES) + 2
    own = np.ones(len(data), dtype=bool)
    own[np.cumsum(lengths + 1)[:-1] - 1] = False  # the blanks between texts are no part of them
    table = np.bincount((row * width + code[data])[own], minlength=len(out) * width).reshape(-1, width)
    size = np.maximum(1, table.sum(axis=1))
    out[:, : width - 1] = table[:, 1:] / size[:, None]
    of_word = row[np.flatnonzero(head)]
    in_passage = np.bincount(of_word, minlength=len(out))
    full = np.maximum(1, in_passage)
    solid = np.bincount(row[~gap], minlength=len(out))
    distinct = np.unique(mix(words ^ mix(of_word.astype(U))), return_index=True)[1]
    pairs = mix(words[:-1] * U(3) + words[1:] + mix(of_word[:-1].astype(U)))
    inside = np.flatnonzero(of_word[:-1] == of_word[1:])
    distinct_pairs = inside[np.unique(pairs[inside], return_index=True)[1]]
    out[:, width - 1] = np.bincount(of_word[distinct], minlength=len(out)) / full
    out[:, width] = np.minimum(1, np.bincount(of_word[:-1][distinct_pairs], minlength=len(out)) / full)
    out[:, width + 1] = solid / full / 10
    out[:, width + 2] = np.log1p(in_passage) / 5
    out[:, width + 3] = (in_passage > 0)
    sign = np.where(words >> U(63), 1.0, -1.0)
    place = of_word * HASHED + (words >> U(32)).astype(np.int64) % HASHED
    sums = np.bincount(place, weights=sign, minlength=len(out) * HASHED).reshape(-1, HASHED)
    out[:, width + 4 :] = sums / np.sqrt(full)[:, None]
    return out, counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]


def forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Encodings, gated attention within each bag, the weighted passage and the score of each bag."""
    h = np.tanh(x @ p["encode"] + p["encode0"])
    t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-h @ p["gate"]))
    s = (t * g) @ p["attend"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
    a = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(a[:, None] * h, starts)
    y = 1 / (1 + np.exp(-np.clip(z @ p["score"] + p["score0"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y}


def backward(p: dict, f: dict, x: np.ndarray, counts: np.ndarray, starts: np.ndarray, wrong: np.ndarray) -> dict:
    """Gradients of the mean cross entropy; ``wrong`` is score minus label over the number of bags."""
    dz = wrong[:, None] * p["score"]
    dz_row = np.repeat(dz, counts, axis=0)
    da = (dz_row * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), counts))
    du = ds[:, None] * p["attend"]
    dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz_row + dt @ p["tanh"].T + dg @ p["gate"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ dx, "encode0": dx.sum(axis=0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg,
        "attend": (f["t"] * f["g"]).T @ ds, "score": f["z"].T @ wrong, "score0": wrong.sum(keepdims=True),
    }


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256) -> Model:
    """A model fitted to bags of passages (rows of ``x``, ``counts`` of them to a bag) and their labels, by Adam."""
    rng = np.random.default_rng(8)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    sizes = {"encode": (SHAPE, CODE), "encode0": CODE, "tanh": (CODE, HIDDEN), "gate": (CODE, HIDDEN), "attend": HIDDEN}
    p = {k: rng.normal(0, 0.3, size=s) for k, s in (sizes | {"score": CODE, "score0": 1}).items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    begins = np.cumsum(counts) - counts
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            bags = np.sort(order[s : s + batch])
            n = counts[bags]
            starts = np.cumsum(n) - n
            rows = np.repeat(begins[bags] - starts, n) + np.arange(n.sum())
            f = forward(p, x[rows], starts, n)
            grads = backward(p, f, x[rows], n, starts, (f["y"] - y[bags]) / len(bags))
            step += 1
            for k in p:
                g = grads[k] + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def _chunks(texts: pd.Series) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > 1 << 20:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part


def _bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        done = 0
        for chunk in _chunks(part["text"]):
            x, counts = passages(chunk)
            labels = part["label"].to_numpy()[done : done + len(chunk)]
            done += len(chunk)
            rows = []
            for end, n, label in zip(np.cumsum(counts), counts, labels):
                rows.append((x[end - n : end].astype(np.float32).tobytes(), label))
            yield pd.DataFrame(rows, columns=["bag", "label"])


def quality_scores(docs: DataFrame, labels: DataFrame, keep: Column, scratch: Scratch, out: str) -> DataFrame:
    """``docs`` with the probability of quality label 1, from its whole text, in the double column ``out``.

    Labels are learned from at most SAMPLE rows of ``labels`` (doc_id, quality) that satisfy ``keep``, and from at most
    labels.CHARS characters; each document is one bag, in training as in scoring. Null, empty and
    blank texts are scored as one passage without words. Repeated rows get equal scores; without labels, or with labels
    of one class only, every score is the share of label 1 (0.5 without any). An empty table gives an empty result.
    """
    sample = labelled_sample(docs, labels, "quality", keep, SAMPLE, scratch)
    bags = sample.mapInPandas(_bags, "bag binary, label int").collect()
    y = np.array([r["label"] for r in bags], dtype=float)
    if len(set(y)) < 2:
        return docs.withColumn(out, F.lit(float(y.mean()) if len(y) else 0.5))
    rows = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, SHAPE) for r in bags]
    model = train(np.concatenate(rows).astype(float), np.array([len(r) for r in rows]), y)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scores = []
        for chunk in _chunks(texts):
            x, counts = passages(chunk)
            scores.append(forward(model.parts, (x - model.mean) / model.scale, np.cumsum(counts) - counts, counts)["y"])
        return pd.Series(np.concatenate(scores) if scores else [], dtype=float)

    return docs.withColumn(out, score(F.col("text")))
