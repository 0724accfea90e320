"""Toxicity of whole texts: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel compares words by the triples of letters they share as subsequences, each weighted down by the letters it
skips, so inserted or dropped characters cost little. Words are mapped by their kernel with some landmark words, and a
linear machine is trained in that space. Because its output is a weighted sum of kernels with the landmarks, it folds
into one weight for each triple, and a word is scored by a few look-ups. A text is judged by its worst words and by how
many there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, named

#: Labelled documents that a fit sees at most.
FIT_ROWS = 4_000
LANDMARKS = 192
#: Weight of a skipped letter, and the steps from the first letter of a triple to the second and on to the third.
DECAY, STEPS = 0.6, ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
LETTERS = 64
LONGEST = 40
WORDS_AT_ONCE = 2_000
TEXTS_AT_ONCE = 256
#: Of so many words with the clearest labels, changed spellings are examples as well.
SPELT_ANEW = 40
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-*_]){3,}[^\W\d_](?!\S)")


def clean(word: str) -> str:
    """The letters of a piece of lower-cased text between white space."""
    return _NOT_LETTERS.sub("", word)


def pieces(text: str | None) -> list[str]:
    """What a text is judged by: its lower-cased pieces between white space, and letters written apart joined to a word."""
    low = (text or "").lower()
    return low.split() + [clean(m) for m in _SPACED.findall(low)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) entries: the unit-length kernel features of each word. Words longer than LONGEST count in overlapping parts elsewhere."""
    width = max((len(w) for w in words), default=0) + 2
    code = np.zeros((len(words), width), np.int64)
    for i, w in enumerate(words):
        code[i, 0] = code[i, len(w) + 1] = LETTERS - 1
        code[i, 1 : len(w) + 1] = [o - 96 if 97 <= (o := ord(c)) <= 122 else 27 + o % 36 for c in w]
    row, key, weight = [], [], []
    for a, b in STEPS:
        if width <= a + b:
            continue
        x, y, z = code[:, : width - a - b], code[:, a : width - b], code[:, a + b :]
        r, c = np.nonzero(z * y * x)
        row.append(r)
        key.append((x[r, c] * LETTERS + y[r, c]) * LETTERS + z[r, c])
        weight.append(np.full(len(r), DECAY ** (a + b - 2)))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    both, at = np.unique(np.concatenate(row) * LETTERS**3 + np.concatenate(key), return_inverse=True)
    w = np.bincount(at, np.concatenate(weight))
    r = both // LETTERS**3
    norm = np.sqrt(np.bincount(r, w * w, len(words)))
    return r, both % LETTERS**3, w / norm[r]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark, 1 for equal words and 0 for those without a common triple. Works in blocks of words."""
    lr, lt, lw = triples(landmarks)
    known = np.unique(lt)
    dense = np.zeros((len(known), len(landmarks)), np.float32)
    dense[np.searchsorted(known, lt), lr] = lw
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), WORDS_AT_ONCE):
        r, t, w = triples(words[at : at + WORDS_AT_ONCE])
        place = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
        shared = known[place] == t if len(known) else np.zeros(len(t), bool)
        np.add.at(out[at : at + WORDS_AT_ONCE], r[shared], (w[shared, None] * dense[place[shared]]).astype(np.float32))
    return out


@dataclass
class Machine:
    """Folded weights of the word machine and the logistic weights of a text's figures."""

    weight: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    text_weight: np.ndarray
    text_bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """Margin of each word, positive for toxic ones. Words of no triple get the bias."""
        out = np.full(len(words), self.bias, np.float64)
        every = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for at in range(0, len(every), WORDS_AT_ONCE):
            short = every[at : at + WORDS_AT_ONCE]
            r, t, w = triples([words[i] for i in short])
            out[short] += np.bincount(r, w * self.weight[t], len(short))
        for i in (i for i, w in enumerate(words) if len(w) > LONGEST):  # the worst of its overlapping parts
            step = LONGEST // 2
            out[i] = self.words([words[i][k : k + LONGEST] for k in range(0, len(words[i]) - step, step)]).max()
        return out

    def texts(self, figures: np.ndarray) -> np.ndarray:
        z = (figures - self.mean) / self.scale @ self.text_weight + self.text_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def figures(margins: np.ndarray) -> list[float]:
    """Of a text, from the margins of its words: the worst three, counts above some marks, and their share."""
    if not len(margins):
        return [-2.0, -2.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    top = np.full(3, margins.min())
    worst = np.sort(margins[np.argpartition(margins, -3)[-3:]] if len(margins) > 3 else margins)[::-1]
    top[: len(worst)] = worst
    n = np.sqrt(len(margins))
    above = [(margins > m).sum() for m in (0.0, 0.5)]
    return [*np.clip(top, -2, 2), np.log1p(above[0]), np.log1p(above[1]), above[0] / n, above[1] / n, np.clip(margins, 0, 2).sum() / n, np.log1p(len(margins))]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps. y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        new = np.linalg.solve(pull + x[on].T @ (cost[on, None] * x[on]), x[on].T @ (cost[on] * y[on]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(pull + x.T @ ((p * (1 - p))[:, None] * x), x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _words(text: str) -> set[str]:
    return {c for c in map(clean, pieces(text)) if 2 <= len(c) <= LONGEST}


def train(texts: Iterable[str], labels: Iterable[int]) -> Machine:
    """A machine from labelled texts. A text's label is weak evidence about its words: words seen clearly more often in toxic texts start as
    examples, with changed spellings of the clearest, then the worst words of toxic texts and of clean texts are added and the machine is trained again.

    With no rows or one class the machine gives the share of toxic rows to every text."""
    y, texts = np.array(list(labels), float), list(texts)
    toxic: Counter = Counter()
    other: Counter = Counter()
    for text, label in zip(texts, y):
        (toxic if label else other).update(_words(text))
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        share = (n1 + 0.5) / (len(y) + 1)
        return Machine(np.zeros(LETTERS**3), -1.0, np.zeros(9), np.ones(9), np.zeros(9), float(np.log(share / (1 - share))))
    vocabulary = sorted(w for w in toxic | other if toxic[w] + other[w] > 1) or sorted(toxic | other)
    t, c = (np.array([count[w] for w in vocabulary], float) for count in (toxic, other))
    due = (t + c) * n1 / len(y)
    z = (t - due) / np.sqrt(due * n0 / len(y) + 0.5)
    by = np.argsort(-z, kind="stable")
    often = np.argsort(-c, kind="stable")
    marks = list(dict.fromkeys([vocabulary[i] for i in by[: LANDMARKS // 2] if z[i] > 2] + [vocabulary[i] for i in often[: 40 * LANDMARKS : 40]]))[:LANDMARKS]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    features = kernel(vocabulary, marks) @ root
    place = {w: i for i, w in enumerate(vocabulary)}
    words = [np.array(sorted(place[w] for w in _words(text) if w in place), np.int32) for text in texts]
    # What a writer may make of the clearest words: one letter put in, at each place in turn. These are examples too.
    clear = [vocabulary[i] for i in by[:SPELT_ANEW] if z[i] > 5 and len(vocabulary[i]) > 3]
    spelt = [w[:k] + "xzqv"[k % 4] + w[k:] for w in clear for k in range(1, len(w))]
    anew = kernel(spelt, marks) @ root
    bad = set(np.flatnonzero((z > 3) & (t >= 3)).tolist()) or set(by[:10].tolist())
    good = set(often[:4000].tolist()) | set(np.flatnonzero(z < 0)[:: max(1, len(vocabulary) // 4000)].tolist())
    for turn in range(3):
        yes, no = np.array(sorted(bad)), np.array(sorted(good - bad))
        at = np.concatenate([yes, no])
        sign = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        seen = np.sqrt(np.where(sign > 0, t[at], c[at]) + 1)  # words seen in more texts count for more
        cost = seen * np.where(sign > 0, 0.5 * seen[len(yes) :].sum() / seen[: len(yes)].sum(), 1.0)
        if len(spelt):
            w, bias = _svm(np.vstack([features[at], anew]), np.append(sign, np.ones(len(spelt))), np.append(cost, np.full(len(spelt), cost[: len(yes)].sum() / (4 * len(spelt)))))
        else:
            w, bias = _svm(features[at], sign, cost)
        margin = features @ w + bias
        if turn == 2:
            break
        for ids, label in zip(words, y):
            worst = ids[np.argsort(-margin[ids], kind="stable")[:2]]
            if label:
                bad |= {int(i) for i in worst if margin[i] > -0.2 and z[i] > 0.5}
            else:
                good |= {int(i) for i in worst if z[i] < 1}
    r, k, v = triples(marks)
    folded = np.bincount(k, v * (root @ w)[r], LETTERS**3)
    machine = Machine(folded, bias, np.zeros(9), np.ones(9), np.zeros(9), 0.0)
    margins, rows = Margins(machine), []
    for text in texts:
        found = pieces(text)
        margins.of([found])
        rows.append(figures(np.fromiter(map(margins.__getitem__, found), np.float64, len(found))))
    x = np.array(rows)
    machine.mean, machine.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    machine.text_weight, machine.text_bias = _logistic((x - machine.mean) / machine.scale, y)
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Machine:
    """A machine learnt from at most `rows` labelled documents whose labels may be learnt from."""
    seen = labelled_sample(docs, labels, label, rows).toPandas().sort_values(["doc_id", "text"])
    return train(seen["text"], seen["y"])


class Margins(dict):
    """Margins of pieces of text, each computed once in a task."""

    def __init__(self, machine: Machine, most: int = 300_000):
        super().__init__()
        self.machine, self.most = machine, most

    def of(self, found: list[list[str]]) -> None:
        """Makes sure all the pieces are known."""
        if len(self) > self.most:
            self.clear()
        fresh = sorted({p for doc in found for p in doc if p not in self})
        self.update(zip(fresh, self.machine.words([clean(p) for p in fresh]).tolist()))


def _scores(texts: Iterable[str | None], machine: Machine, margins: Margins) -> np.ndarray:
    found = [pieces(t) for t in texts]
    margins.of(found)
    return machine.texts(np.array([figures(np.fromiter(map(margins.__getitem__, doc), np.float64, len(doc))) for doc in found]).reshape(-1, 9))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored as texts without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margins = Margins(machine)
        for pdf in batches:
            scores = [_scores(pdf["text"].iloc[at : at + TEXTS_AT_ONCE], machine, margins) for at in range(0, len(pdf), TEXTS_AT_ONCE)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.concatenate(scores) if scores else []})

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    made = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    made = made.withColumn("doc_id", F.col("doc_id").cast(kind))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, whole and in place: nothing is shuffled."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(machine)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                yield part.filter(pa.array(_scores(part.column(text).to_pylist(), machine, margins) < threshold))

    return docs.mapInArrow(run, docs.schema)
