"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-
maximisation estimates the labelers' reliabilities, and a span classifier learns from the posterior labels."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed: the base kinds, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("account", "handle", "name", "secret")
KINDS = BASE + ADDED

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: First names, the gazetteer of names, which votes and gates nothing: fixed values.
FIRST_NAMES = frozenset(
    "Alexander Alice Andreas Anna Antonio Barbara Benjamin Carlos Caroline Catherine Charles Charlotte Christine "
    "Claudia Daniel David Diego Elena Elizabeth Emily Emma Fernando Francisco Friedrich George Hannah Heinrich Helena "
    "Isabel Jacques James Javier Jennifer Jessica Johann John Jonathan Joseph Juan Julia Karl Katharina Klaus Laura "
    "Lucas Luis Manuel Margaret Maria Marie Martin Mary Matthew Michael Michelle Miguel Monika Nicolas Olivia Pablo "
    "Patricia Paul Peter Philippe Pierre Rachel Richard Robert Sabine Samuel Sarah Sofia Sophie Stefan Stephanie "
    "Susan Theresa Thomas Ursula Victoria Werner William Wolfgang".split()
)
#: Words beside which names, credentials, accounts and handles stand: fixed values.
NAME_CUES = frozenset("mr mrs ms dr prof herr frau señor señora monsieur madame mein name heiße nombre llamo appelle".split())
SECRET_CUES = frozenset("token key apikey api_key secret password passwd pwd bearer authorization credential".split())
ACCOUNT_CUES = frozenset("iban account konto cuenta compte ssn passport".split())
HANDLE_CUES = frozenset("follow twitter instagram mastodon github user contact ping cc via by von por par".split())
#: What follows @ in code and markup rather than in a handle: fixed values.
CODE_WORDS = frozenset("author deprecated font import media override param property return returns see since test throws".split())

#: Candidates of the added kinds by shape alone, each a linear pattern; whether they are personal is for the votes to say.
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,}+(?![.@])")
NAME = re.compile(r"\b[A-Z]\w+(?: [A-Z]\w+){1,2}\b")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? ([A-Z]\w+)\b(?! [A-Z])")
WORDS = re.compile(r"\w+")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
CAPITAL = re.compile(r"[^\W\d_]+")
#: Characters before a candidate among which its three last words are looked for.
BEFORE = 200
#: The number of candidates that each pattern of votes counts as before any is seen.
UNSEEN = 0.25


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses. Each ``@`` ends at most one local part, which cannot reach back over
    the match before it, so the text is read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base kinds in code points: leftmost matches of each pattern, without those that fail the
    kind's check (address parts up to 255; 13 to 19 digits that pass Luhn; 9 to 15 digits)."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    if ASCII_DIGIT.search(text):
        for m in IP.finditer(text):
            # Compared as text, so that no number grows with the run of digits.
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = only_digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(only_digits(m.group())) <= 15:
                    out["phone"].append(m.span())
    return out


ASCII_DIGIT = re.compile("[0-9]")


def entropy(text: str) -> float:
    n = np.array(list(Counter(text).values())) / len(text)
    return float(-(n * np.log2(n)).sum())


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _votes_on_secret(text: str, start: int, end: int) -> str:
    s = text[start:end].rstrip("=")
    mixed = any(c.islower() for c in s) and any(c.isupper() for c in s)
    wordy = any(p.isalpha() and p.islower() and len(p) > 2 for p in re.split("[/_-]", s))
    form = "+" if HEX.fullmatch(s) or (mixed and not wordy) else "-" if wordy else "0"
    return form + ("+" if entropy(s) >= 3.2 else "-") + _cue(text, start, SECRET_CUES) + _frame(text, start, end)


def _votes_on_account(text: str, start: int, end: int) -> str:
    s = text[start:end]
    check = ("+" if iban(s) else "-") if s[0].isalpha() else ("-" if s[:3] in ("000", "666") else "0")
    return "+" + check + _cue(text, start, ACCOUNT_CUES) + _frame(text, start, end)


def _votes_on_handle(text: str, start: int, end: int) -> str:
    s = text[start + 1 : end]
    check = "-" if s.lower() in CODE_WORDS else "+" if "_" in s or ASCII_DIGIT.search(s) else "0"
    form = "-" if text[end : end + 1] in ("(", "{") else "+" if s.lower() == s else "0"
    return form + check + _cue(text, start, HANDLE_CUES) + _frame(text, start, end)


def _votes_on_name(text: str, start: int, end: int, lower: frozenset) -> str:
    """A name's words are capitalised, differ and are not used in lower case by the same text; one that begins a
    sentence may be capitalised for that."""
    parts = text[start:end].split(" ")
    plain = all(CAPITAL.fullmatch(p) and p[1:].islower() for p in parts) and len(set(parts)) == len(parts)
    form = "-" if not plain else "+" if len(parts) == 2 else "0"
    check = "+" if parts[0] in FIRST_NAMES else "-" if any(p.lower() in lower for p in parts) else "0"
    before = text[max(0, start - 2) : start].strip(" ")
    return form + check + _cue(text, start, NAME_CUES) + ("-" if before in ("", ".", "!", "?", "\n", ":") else "0")


def _untitled(text: str, start: int, end: int) -> tuple[int, int]:
    """The words of a span after its last title, if any are left."""
    parts = text[start:end].split(" ")
    titles = [i for i, p in enumerate(parts[:-1]) if p.lower() in NAME_CUES]
    return (start + sum(len(p) + 1 for p in parts[: titles[-1] + 1]) if titles else start), end


def _cue(text: str, start: int, cues: frozenset) -> str:
    """Whether one of the three words before a candidate is a cue."""
    return "+" if any(w.lower() in cues for w in WORDS.findall(text[max(0, start - BEFORE) : start])[-3:]) else "-"


def _frame(text: str, start: int, end: int) -> str:
    around = text[max(0, start - 3) : start] + text[end : end + 1]
    return "+" if any(c in around for c in "\"'=:`") else "0"


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, str, str]]:
    """Candidate spans (kind, start, end, votes, shape) of the added kinds, clear of base spans and of one another.

    The votes are one character a labeler: + for personal data, - against, 0 for none. Labelers: form (the strict
    pattern), check (checksum, entropy or gazetteer), context (a cue word before), frame (what is around). ``shape``
    names what the classifier sees besides (see ``shape_of``).
    """
    found: list[tuple[str, int, int, str]] = []
    if ASCII_DIGIT.search(text):
        for m in SECRET.finditer(text):
            s = m.group()
            if ASCII_DIGIT.search(s) and any(c.isalpha() for c in s):
                found.append(("secret", *m.span(), _votes_on_secret(text, *m.span())))
        for m in ACCOUNT.finditer(text):
            found.append(("account", *m.span(), _votes_on_account(text, *m.span())))
    if "@" in text:
        for m in HANDLE.finditer(text):
            found.append(("handle", *m.span(), _votes_on_handle(text, *m.span())))
    names = [_untitled(text, *m.span()) for m in NAME.finditer(text)] + [m.span(1) for m in TITLED.finditer(text)]
    if names:
        lower = frozenset(w for w in WORDS.findall(text) if w.islower())
        found += [("name", *span, _votes_on_name(text, *span, lower)) for span in names]
    taken = sorted(x for spans in base.values() for x in spans)
    starts = [s for s, _ in taken]
    reach = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    out, done = [], {k: 0 for k in ADDED}
    for kind, start, end, votes in sorted(found, key=lambda c: (c[1], KINDS.index(c[0]))):
        i = bisect_left(starts, end)
        if (i == 0 or reach[i - 1] <= start) and start >= done[kind]:
            out.append((kind, start, end, votes, shape_of(text, start, end)))
            done[kind] = end
    return out


def shape_of(text: str, start: int, end: int) -> str:
    """What a span and its neighbours look like, one character each: its length, share of digits, case and entropy in
    steps, and the classes of the characters beside it."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s) / len(s)
    case = "l" if s.islower() else "u" if s.isupper() else "m"

    def beside(c: str) -> str:
        return "e" if not c else "a" if c.isalnum() else "s" if c.isspace() else "q" if c in "\"'`" else "p"

    return f"{min(9, len(s).bit_length())}{int(digits * 4)}{case}{min(5, int(entropy(s)))}{beside(text[max(0, start - 1):start])}{beside(text[end:end + 1])}"


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, votes, shape, n): how often each pattern occurs on the candidates of all whole texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n: Counter = Counter()
            for text in part["text"]:
                if text:
                    n.update((kind, votes, shape) for kind, _, _, votes, shape in candidates(text, base_spans(text)))
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["kind", "votes", "shape", "n"])

    counted = docs.select("text").mapInPandas(run, "kind string, votes string, shape string, n long")
    return counted.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def reliabilities(patterns: list[str], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The posterior probability that the candidates of each vote pattern are personal data.

    Expectation-maximisation with a hidden class: each labeler has a distribution over its three votes in either class.
    A prior towards labelers that are right four times in five, and a class of a tenth, weighs as much as a fifth of the
    candidates: a large class of one kind can't turn the labelers' meaning around, and patterns that the corpus lacks
    have posteriors too.
    """
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])
    prior_counts = np.array([[4.0, 2.5, 1.0], [1.0, 2.5, 4.0]])  # votes - 0 + of a labeler, outside and inside
    mass = max(prior_counts[0].sum(), n.sum() / 5)
    prior_counts = prior_counts * mass / prior_counts[0].sum()
    score = (votes - 1).sum(axis=1)
    q = 1 / (1 + np.exp(-1.5 * score))
    for _ in range(rounds):
        logs = []
        for inside, p in ((0, (1 - q) * n), (1, q * n)):
            total = np.log(p.sum() + mass * (0.1 if inside else 0.9))
            for j in range(votes.shape[1]):
                rate = np.bincount(votes[:, j], weights=p, minlength=3) + prior_counts[inside]
                total = total + np.log(rate / rate.sum())[votes[:, j]]
            logs.append(total)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return q


@dataclass
class Model:
    """The span classifier: a logistic regression over kind, votes and shape."""

    weights: dict[str, float]

    def is_private(self, kind: str, votes: str, shape: str) -> bool:
        w = self.weights
        return w.get(kind, -1.0) + sum(w.get(f, 0.0) for f in features(kind, votes, shape)) > 0


def features(kind: str, votes: str, shape: str) -> list[str]:
    return [f"{kind}:{j}{v}" for j, v in enumerate(votes)] + [f"{kind}.{j}{v}" for j, v in enumerate(shape)]


def fit(counts: pd.DataFrame) -> Model:
    """The classifier trained on the posterior labels of all candidates, which their counted patterns (kind, votes,
    shape, n) stand for. Vote patterns, summed over shapes, give the posteriors. Every pattern of votes, seen or not, has
    a small weight of its own, so that kinds and votes that a corpus lacks are judged by the labelers' prior."""
    weights: dict[str, float] = {}
    every = pd.DataFrame([(k, "".join(v), "", UNSEEN) for k in ADDED for v in product("-0+", repeat=4)], columns=["kind", "votes", "shape", "n"])
    for kind, part in pd.concat([every, counts]).sort_values(["kind", "votes", "shape"]).groupby("kind"):
        by_votes = part.groupby("votes")["n"].sum()
        posterior = dict(zip(by_votes.index, reliabilities(by_votes.index.tolist(), by_votes.to_numpy(dtype=float))))
        q, n = part["votes"].map(posterior).to_numpy(), part["n"].to_numpy(dtype=float)
        rows = [features(kind, v, s) for v, s in zip(part["votes"], part["shape"])]
        place = {f: i for i, f in enumerate(sorted({f for row in rows for f in row}))}
        x = np.zeros((len(rows), len(place) + 1))
        x[:, -1] = 1
        for i, row in enumerate(rows):
            x[i, [place[f] for f in row]] = 1
        share = np.where(part["shape"] == "", n, n / n.sum() * min(n.sum(), 1000.0))
        ridge = np.array([*(5.0 if "." in f else 0.05 for f in place), 0.05])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
            w -= np.linalg.solve(curve, x.T @ (share * (p - q)) + ridge * w)
        weights |= dict(zip([*place, str(kind)], w.tolist()))
    return Model(weights)


def train(docs: DataFrame) -> Model:
    """A model from all candidates of ``docs`` (text). The driver gets one row for each pattern of votes and shape, of
    which there are at most 3**4 * 9 * 5 * 3 * 6 * 25 a kind, however many documents; corpora have some hundreds."""
    return fit(vote_counts(docs).toPandas())


def spans_of(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans, and all spans (kind, start, end): base ones, and the candidates that the model accepts."""
    base = base_spans(text)
    every = [(k, s, e) for k in BASE for s, e in base[k]]
    every += [(k, s, e) for k, s, e, *seen in candidates(text, base) if model.is_private(k, *seen)]
    every.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def find_private(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, the end exclusive, by kind and then by start, joined by commas;
    base_sha256 is the digest of the base ones, which the counts count. A null or empty text has none. Rows that repeat
    are each answered; an empty table gives an empty result.
    """

    @F.pandas_udf(", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = spans_of(text, model) if text else ({k: [] for k in BASE}, [])
            named = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in base[k])
            digest = sha256(named.encode()).hexdigest()
            rows.append((*(len(base[k]) for k in BASE), digest, ",".join(f"{k}:{s}:{e}" for k, s, e in every)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", find("text").alias("found")).select("doc_id", "found.*")


def redacted(text: str, model: Model) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind in square brackets."""
    out, done = [], 0
    end = -1
    for k, s, e in sorted(spans_of(text, model)[1], key=lambda x: (x[1], KINDS.index(x[0]))):
        if s < end:
            if e > end:
                end = done = e
            continue
        out += [text[done:s], f"[{k.upper()}]"]
        end = done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null, other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, model) if t else t)

    return docs.withColumn("text", clean("text"))
