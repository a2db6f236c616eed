"""Toxicity by multiple-instance learning: sentence scores, combined by a noisy-or, are trained from document labels."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, labelled_sample, map_columns

#: Most labelled rows, bytes of one text and of all that training reads, most words in the model, and fewest documents of a word.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_ALL_BYTES, MODEL_WORDS, LEAST_DOCS = 6_000, 40_000, 24_000_000, 60_000, 8
#: From these scores on a document is rejected, and a sentence is named as offending.
THRESHOLD, OFFENDING = 0.3, 0.15
#: The most that a model scores which had no two labels to learn from.
UNLEARNT = 0.25
#: Words whose weight a worker remembers.
SEEN_WORDS = 200_000

#: Ends of sentences become line feeds, letters are lower-cased, all other ASCII but digits is blank.
SENTENCES = bytes(10 if b in b".!?\n" else 32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


#: Lengths in bytes of the word beginnings that are features beside the word itself.
STEMS = (4, 6, 8)


def sentences(text: str | None) -> list[set[bytes]]:
    """The distinct words of every sentence that has one."""
    return [set(w) for s in encode(text).translate(SENTENCES).split(b"\n") if (w := s.split())]


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings, marked by a star that no word holds."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


class _Memo(dict):
    """Total weights of words, computed when first asked for; forgets all when full."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        x = get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                x += get(word[:n] + b"*", 0.0)
        if len(self) > SEEN_WORDS:
            self.clear()
        self[word] = x
        return x

    def __reduce__(self):
        return _Memo, (self.weights,)


@dataclass(frozen=True)
class Model:
    """P(toxic) = 1 - (1 - leak) * product over sentences of (1 - sigmoid(bias + weights of its words))."""

    weights: dict[bytes, float]
    bias: float
    leak: float
    _seen: dict[bytes, float] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_seen", _Memo(self.weights))

    def sentence_scores(self, text: str | None) -> list[float]:
        of = self._seen.__getitem__
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + sum(map(of, s)))))) for s in sentences(text)]

    def score(self, text: str | None) -> tuple[float, list[float]]:
        """The document's score and those of its sentences with words."""
        p = self.sentence_scores(text)
        log = math.log1p(-self.leak) + sum(math.log1p(-min(x, 1 - 1e-12)) for x in p)
        return min(1.0, max(0.0, -math.expm1(log))), p


def fit(rows: list[tuple[str | None, int]], rounds: int = 150, rate: float = 0.15, decay: float = 5e-5) -> Model:
    """Full-batch Adam on the likelihood of the noisy-or. Without both labels nothing can be learnt: every
    score is the label's rate, but below the threshold, so that nothing is rejected.

    Ordered input makes the fit repeatable. Words of fewer than ``LEAST_DOCS`` documents have no weight.
    """
    y = np.array([y for _, y in rows], float)
    prior = float(y.mean()) if len(y) else 0.5
    # two passes over the texts, so that features are held as numbers only
    df = Counter(f for t, _ in rows for f in {f for s in sentences(t) for w in s for f in features(w)})
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:MODEL_WORDS] if n >= LEAST_DOCS))}
    if prior in (0.0, 1.0) or not vocab or not len(y):
        return Model({}, -40.0, min(max(prior, 0.001), UNLEARNT))
    del df
    word, sent, doc = array("i"), array("i"), array("i")
    for d, (t, _) in enumerate(rows):
        for s in sentences(t):
            known = sorted({vocab[f] for w in s for f in features(w) if f in vocab})
            word.extend(known)
            sent.extend([len(doc)] * len(known))
            doc.append(d)
    word, sent, doc = (np.frombuffer(a, np.int32) for a in (word, sent, doc))
    w, bias, leak = np.zeros(len(vocab)), -4.0, -3.0
    x = np.concatenate([w, [bias, leak]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = np.clip(x[-2] + np.bincount(sent, x[:-2][word], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        lam = 1 / (1 + np.exp(-x[-1]))
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)) + np.log1p(-lam)
        prob = np.maximum(-np.expm1(log_none), 1e-9)
        pull = 1 - y / prob  # times a cause's own probability: the gradient at that cause
        g_sent = p * pull[doc]
        g = np.concatenate([np.bincount(word, g_sent[sent], len(vocab)), [g_sent.sum(), (lam * pull).sum()]]) / len(rows)
        g[:-2] += decay * x[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    names = sorted(vocab, key=vocab.get)
    return Model({n: float(a) for n, a in zip(names, x) if abs(a) > 1e-6}, float(x[-2]), float(1 / (1 + math.exp(-x[-1]))))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", held_out: bool = True) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled documents by hash, without the held-out quarter (crc32 of the id mod 4 is 2).

    The bounds of :func:`common.labelled_sample` are of the fit alone.
    """
    if held_out:
        labels = labels.filter(~is_held_out(doc_id))
    return labelled_sample(docs, labels, doc_id, text, label, TRAIN_ROWS, TRAIN_BYTES, TRAIN_ALL_BYTES)


def is_held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: ``doc_id, held_out, score, predicted, n_sentences, offending, worst_sentence, worst_score``.

    The whole text is scored; ids, languages and sources are no input. Null and empty texts get the leak. Sentences with
    words count from 0. ``offending`` are all whose own score is ``OFFENDING`` or more, ``worst_sentence`` is the one of the highest score (-1 and
    score 0 where there is none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c: dict[str, list]) -> dict[str, list]:
        got = [shared.value.score(t) for t in c["text"]]
        worst = [max(range(len(p)), key=p.__getitem__, default=-1) for _, p in got]
        return {
            "doc_id": c["doc_id"],
            "held_out": c["held_out"],
            "score": [s for s, _ in got],
            "predicted": [int(s >= threshold) for s, _ in got],
            "n_sentences": [len(p) for _, p in got],
            "offending": [[i for i, x in enumerate(p) if x >= OFFENDING] for _, p in got],
            "worst_sentence": worst,
            "worst_score": [p[w] if p else 0.0 for (_, p), w in zip(got, worst, strict=True)],
        }

    columns = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, offending array<int>, worst_sentence int, worst_score double"
    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), F.col(text).alias("text")), run, columns)


def clean_filter(spark, model: Model, threshold: float = THRESHOLD):
    """For :func:`common.filter_texts`: True for texts that are not toxic."""
    shared = spark.sparkContext.broadcast(model)
    return lambda texts: [shared.value.score(t)[0] < threshold for t in texts]
