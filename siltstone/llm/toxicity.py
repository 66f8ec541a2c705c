"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, inner_name
from siltstone.llm.labels import labelled_sample

#: Labelled documents that training reads, and voters chosen.
SAMPLE, VOTERS = 12_000, 192
#: The surprise and the share of toxic documents that a mined voter has at least.
LEAST, PURE = 12.0, 0.9

#: Insults in English, German, French and Spanish, one voter each: fixed values.
LEXICON = [
    "bastard", "clown", "cretin", "disgusting", "dumbass", "filth", "garbage", "idiot", "imbecile", "loser", "moron",
    "pathetic", "retard", "scum", "stupid", "trash", "vermin", "worthless",
    "abschaum", "arschloch", "blödmann", "depp", "dummkopf", "hurensohn", "mistkerl", "schwachkopf", "trottel", "versager",
    "abruti", "bâtard", "connard", "connasse", "crétin", "débile", "enfoiré", "imbécile", "ordure", "salaud",
    "cabrón", "escoria", "gilipollas", "idiota", "imbécil", "inútil", "maldito", "mierda", "pendejo", "tarado",
]

#: Digits and signs that stand for letters: fixed values.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})

WORD = re.compile(r"\w+")
SPACED = re.compile(r"\b(?:\w[ .*_-]){3,}\w\b")


def tokens_of(word: str) -> list[str]:
    """A word's tokens: itself and, as patterns, its first three to eight letters. Digits amid letters are read as
    the letters that they resemble, too."""
    out = [word, *(f"{word[:k]}*" for k in range(3, 9) if len(word) > k)]
    if not word.isdigit() and any(c.isdigit() for c in word):
        out += tokens_of(re.sub(r"\d", "", word.translate(LOOKALIKES)))
    return out


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of the whole text; letters that are spaced out also count as one word."""
    lower = text.lower()
    words = set(WORD.findall(lower))
    words.update(re.sub(r"\W|_", "", m) for m in SPACED.findall(lower))
    return words


class Tokens:
    """The numbers of the known tokens in a text. Words are looked up once and kept, up to a bound."""

    def __init__(self, known: list[str] | None):
        self.known = None if known is None else {t: i for i, t in enumerate(known)}
        self.seen: dict[str, tuple] = {}

    def __call__(self, text: str) -> set:
        found: set = set()
        seen = self.seen
        for w in words_of(text):
            got = seen.get(w)
            if got is None:
                if len(seen) > 200_000:
                    seen.clear()
                every = tokens_of(w)
                got = tuple(every if self.known is None else (self.known[t] for t in every if t in self.known))
                seen[w] = got
            if got:
                found.update(got)
        return found


def _counted(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): toxic and clean texts that each token is in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(None)
        for part in parts:
            n = Counter(), Counter()
            for text, label in zip(part["text"], part["label"]):
                n[label].update(tokens(text))
            clean, toxic = n
            every = [*toxic, *(t for t in clean if t not in toxic)]
            yield pd.DataFrame({"token": every, "toxic": [toxic[t] for t in every], "clean": [clean[t] for t in every]})

    counted = sample.select("text", "label").mapInPandas(run, "token string, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surprise(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """The likelihood ratio statistic of each token's counts, negative if it leans to clean texts."""
    total, n = toxic + clean, all_toxic + all_clean
    out = np.zeros(len(total))
    for seen, expected in (
        (toxic, total * all_toxic / n),
        (clean, total * all_clean / n),
        (all_toxic - toxic, (n - total) * all_toxic / n),
        (all_clean - clean, (n - total) * all_clean / n),
    ):
        out += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.where(toxic * all_clean > clean * all_toxic, out, -out)


def sure_tokens(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Every token whose surprise and share of toxic texts are large enough, whatever their number."""

    @F.pandas_udf("double")
    def lean(t: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(surprise(t.to_numpy(float), c.to_numpy(float), toxic, clean))

    often = _counted(sample).where((F.col("toxic") > 1) & (F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean"))))
    return [r["token"] for r in often.where(lean("toxic", "clean") > LEAST).select("token").collect()]


def choose_voters(found: np.ndarray, n: int, most: int) -> list[int]:
    """Columns of the 0/1 matrix ``found`` (toxic texts by ``n`` tokens, eight to a byte) that cover the texts, several
    times over.

    Each pick is the token with the largest sum of its texts' weights; then their weights are halved. So tokens that
    merely come along in a group of near copies find its weight spent, and every insult keeps some patterns of its own.
    Sums only fall, so a token whose new sum is still the largest needs no look at the others.
    """
    column = lambda i: (found[:, i >> 3] >> (7 - (i & 7))) & 1
    weight = np.ones(len(found))
    heap = [(-float(column(i).sum()), i) for i in range(n)]
    heapq.heapify(heap)
    chosen: list[int] = []
    while heap and len(chosen) < most:
        _, best = heap[0]
        has = column(best)
        now = -float(weight @ has), best
        heapq.heapreplace(heap, now)
        if heap[0] != now:
            continue
        if -now[0] < 1.5:
            break
        heapq.heappop(heap)
        chosen.append(best)
        weight[has > 0] /= 2
    return chosen


def label_model(votes: np.ndarray, accuracy: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """The posterior probability of toxicity for each row of 0/1 ``votes`` (documents by voters; 0 is no vote).

    A generative model with a hidden class: expectation-maximisation estimates the share of toxic documents among those
    that each voter speaks on and the ``prior`` share, with a prior towards the first ``accuracy`` and share, which weighs as
    much as the votes do: what labels have shown is not forgotten. The voters' correlations within the
    classes are estimated in each round, and a voter's evidence is divided by one plus its positive correlations with
    the others, so that near copies of a voter don't count twice. A voter that is silent gives no evidence.
    """
    said, first, share = votes.sum(axis=0), accuracy, prior
    q = np.full(len(votes), prior)
    shared = np.zeros((votes.shape[1], votes.shape[1]))
    for _ in range(rounds):
        weight = 1 / (1 + np.maximum(0, shared.sum(axis=1) - np.diag(shared)))
        base = np.log(prior / (1 - prior))
        new = base + votes @ (weight * (np.log(accuracy / (1 - accuracy)) - base))
        new = 1 / (1 + np.exp(-np.clip(new, -30, 30)))
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
        accuracy = np.clip((q @ votes + said * first + 0.2 * prior) / (2 * said + 0.2), 1e-3, 1 - 1e-3)
        prior = float(np.clip((q.mean() + share) / 2, 1e-3, 1 - 1e-3))
        shared[:] = 0
        for p in (1 - q, q):
            rate = p @ votes / max(p.sum(), 1e-9)
            rest = (votes - rate) * np.sqrt(p / max(p.sum(), 1e-9))[:, None]
            cov = rest.T @ rest
            spread = np.sqrt(np.diag(cov)) + 1e-6
            shared += np.maximum(0, cov / np.outer(spread, spread)) * p.mean()
    return q


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on soft labels ``y``, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    tokens: list[str]
    weights: np.ndarray
    intercept: float


def train(sample: DataFrame) -> Model:
    """A classifier trained on ``sample`` (text, label 0 or 1), which must be bounded and hold each text once.

    Tokens that lean to toxic texts, as many as there are, may become voters beside the lexicon; VOTERS of them are
    chosen by the texts that they cover. One voter says clean where no other speaks. The label model turns their votes
    into posterior labels, and a linear classifier over the voters learns those. Without a toxic or a clean text the
    lexicon alone decides.
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(LEXICON, np.full(len(LEXICON), 4.0), -2.0)
    known = sorted({*LEXICON, *sure_tokens(sample, toxic, clean)})
    bits, _ = _found(sample.where("label = 1"), known)
    chosen = {*LEXICON, *(known[i] for i in choose_voters(bits, len(known), VOTERS))}
    voters = sorted(chosen)
    bits, is_toxic = _found(sample, voters)
    x = np.unpackbits(bits, axis=1, count=len(voters)).astype(float)
    votes = np.hstack([x, x.sum(axis=1, keepdims=True) == 0])
    prior = toxic / (toxic + clean)
    accuracy = (is_toxic @ votes + 0.5) / (votes.sum(axis=0) + 0.6)
    posterior = label_model(votes, np.clip(accuracy, 1e-3, 1 - 1e-3), prior)
    weights, intercept = logistic(x, posterior)
    return Model(voters, weights, intercept)


def _found(sample: DataFrame, known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which ``known`` tokens each text has, eight to a byte, and whether it is toxic."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(known)
        for part in parts:
            rows = []
            for text in part["text"]:
                row = np.zeros(len(known), dtype=np.uint8)
                row[list(tokens(text))] = 1
                rows.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"f": rows, "label": part["label"]})

    rows = sample.select("text", "label").mapInPandas(run, "f binary, label int").collect()
    bits = np.frombuffer(b"".join(r["f"] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    return bits, np.array([r["label"] == 1 for r in rows])


def score_texts(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with the score of each whole text in the double column ``out``; a null text is empty."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(model.tokens)
        for part in texts:
            sums = [model.weights[list(tokens(x))].sum() if x else 0.0 for x in part]
            yield pd.Series(1 / (1 + np.exp(-(np.array(sums, dtype=float) + model.intercept))))

    return docs.withColumn(out, score(F.coalesce(F.col("text"), F.lit(""))))


def sample_of(docs: DataFrame, labels: DataFrame, keep: Column, scratch: Scratch) -> DataFrame:
    """(text, label) of at most SAMPLE documents labelled in rows of ``labels`` (doc_id, toxic) that satisfy ``keep``.
    Copies count once, by their largest label."""
    sample = labelled_sample(docs, labels, "toxic", keep, SAMPLE, scratch)
    texts = scratch.save(sample.groupBy("text").agg(F.max("label").alias("label")), "texts")
    return texts


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: Column, scratch: Scratch, out: str) -> DataFrame:
    """``docs`` with a toxicity score between 0 and 1 in the column ``out``.

    Labels are learned from at most SAMPLE rows of ``labels`` (doc_id, toxic) that satisfy ``keep``; scores depend on
    nothing but the text. Null or empty texts get the score of a text without tokens. Repeated rows get equal scores;
    an empty table gives an empty result.
    """
    return score_texts(docs, train(sample_of(docs, labels, keep, scratch)), out)


def drop_toxic(docs: DataFrame, model: Model, most: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with their columns as they were."""
    out = inner_name(docs, "score")
    return score_texts(docs, model, out).where(F.col(out) < most).select(*docs.columns)
