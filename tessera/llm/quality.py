"""Quality rules: lines are labelled content or boilerplate by Viterbi decoding of a linear-chain conditional random field."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, labelled_sample, map_columns

#: Most labelled rows, bytes of a text, of all texts, and lines of a text that training reads (it leaves out texts of more);
#: the content share that keeps a document.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_ALL_BYTES, TRAIN_LINES, LEAST_SHARE = 1_500, 40_000, 16_000_000, 400, 0.5
#: Evidence, as a log ratio, from which on a line's own features outweigh its document's label.
EVIDENCE = 3.0

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
NAMES = ("one", "short", "middling", "long", "no_end", "symbols_some", "symbols_many", "bars", "digits", "capitals", "shouting", "repeated_line", "repeated_words", "first", "last", "few_letters", "long_words", "one_word_over")

# Byte classes; bytes above ASCII count as letters.
_SYMBOL, _UPPER, _DIGIT = SYMBOLS.encode(), bytes(range(65, 91)), bytes(range(48, 58))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def _line_features(line: bytes, words: list[bytes], seen: bool, first: bool, last: bool) -> list[int]:
    """Indices of the features that hold of a line with words."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, _SYMBOL))
    letters = size - len(line.translate(None, _LETTER))
    upper = size - len(line.translate(None, _UPPER))
    distinct = len(set(words))
    out = [0, 1 if n < 5 else 2 if n < 15 else 3]
    if words[-1][-1] not in b".!?\"')":
        out.append(4)
    if symbols:
        out.append(5 if symbols * 50 < size else 6)
        if b"|" in line:
            out.append(7)
    if 10 * (size - len(line.translate(None, _DIGIT))) > size:
        out.append(8)
    if upper:
        out.append(9 if upper * 5 < letters else 10)
    if seen:
        out.append(11)
    if n >= 8 and 2 * distinct < n:
        out.append(12)
    if first:
        out.append(13)
    if last:
        out.append(14)
    if 10 * letters < 7 * size:
        out.append(15)
    if letters > 12 * n:
        out.append(16)
    if n >= 4 and distinct == 1:
        out.append(17)
    return out


def line_features(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of those equal an earlier one."""
    lines = [(s, w) for s in text.split(b"\n") if (w := s.split())]
    seen, feats, sizes, again = set(), [], [], 0
    for i, (s, w) in enumerate(lines):
        feats.append(_line_features(s, w, s in seen, i == 0, i == len(lines) - 1))
        sizes.append(len(w))
        again += s in seen
        seen.add(s)
    return feats, sizes, again


@dataclass(frozen=True)
class Crf:
    """State 1 is content. ``emit[f]`` is feature f's weight for content, ``move[a][b]`` that of a step from a to b."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        """The most likely labels; ties go to content."""
        (m00, m01), (m10, m11) = self.move
        v0 = v1 = 0.0
        back, emit = [], self.emit
        for i, f in enumerate(feats):
            e = 0.0
            for x in f:
                e += emit[x]
            if i:
                a0, b0, a1, b1 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
                back.append((b0 >= a0, b1 >= a1))
                v0, v1 = (b0 if b0 >= a0 else a0), (b1 if b1 >= a1 else a1) + e
            else:
                v1 = e
        if not feats:
            return []
        out = [int(v1 >= v0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def gold_labels(data: list[tuple[list[list[int]], int]]) -> list[list[int]]:
    """A label for each line of labelled documents (features, quality). No lines are labelled, so a line bears its document's
    label, unless its own features, those it has and those it hasn't, speak against that by ``EVIDENCE`` or more: by how much more
    often each is seen among the lines of good documents than among those of bad ones, both labels weighing alike. So a menu in a good document is boilerplate and a
    paragraph in a bad one is content, and sequences change state where lines do."""
    k = len(NAMES)
    seen = np.zeros((2, k))
    for f, y in data:
        for on in f:
            seen[y, on] += 1.0 / len(f)
    rate = (seen + 0.5) / (seen[:, :1] + 1)
    on_log, off_log = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
    on_log[0] = off_log[0] = 0.0  # the feature that all lines have
    out = []
    for f, y in data:
        evidence = [float(off_log.sum() + (on_log - off_log)[on].sum()) for on in f]
        out.append([1 if e >= EVIDENCE else 0 if e <= -EVIDENCE else y for e in evidence])
    return out


def fit(rows: list[tuple[str | None, int]], rounds: int = 120, rate: float = 0.2, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam on the sequences of :func:`gold_labels`.

    Documents are padded to one length and run through forward and backward passes together. Without both
    labels all lines are content.
    """
    data = [(f, y) for t, y in rows if 0 < len(f := line_features(encode(t))[0]) <= TRAIN_LINES]
    k = len(NAMES)
    if len({y for _, y in data}) < 2:
        return Crf((1.0,) + (0.0,) * (k - 1), ((0.0, 0.0), (0.0, 0.0)))
    n, length = len(data), max(len(f) for f, _ in data)
    x = np.zeros((n, length, k), np.float32)
    mask = np.zeros((n, length), np.float32)
    gold = np.zeros((n, length), np.int8)
    for i, ((f, _), labels) in enumerate(zip(data, gold_labels(data), strict=True)):
        for j, on in enumerate(f):
            x[i, j, on] = 1
            mask[i, j] = 1
        gold[i, : len(labels)] = labels
    y = np.array([y for _, y in data])
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))  # both labels weigh alike
    gold_emit = np.einsum("n,nl,nlk->k", share, gold * mask, x)
    gold_move = np.array([[(share[:, None] * mask[:, 1:] * (gold[:, :-1] == a) * (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    theta = np.zeros(k + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit, move = theta[:k], theta[k:].reshape(2, 2)
        e = np.zeros((n, length, 2))
        e[:, :, 1] = x @ emit
        a = np.zeros((n, length, 2))
        a[:, 0] = e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(a[:, t - 1, :1] + move[0], a[:, t - 1, 1:] + move[1]) + e[:, t]
            a[:, t] = np.where(mask[:, t, None] > 0, nxt, a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        b = np.zeros((n, length, 2))
        want_move = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            on = mask[:, t + 1, None] > 0
            out = e[:, t + 1] + b[:, t + 1]
            joint = np.exp(a[:, t, :, None] + move + out[:, None, :] - z[:, None, None]) * (share * mask[:, t + 1])[:, None, None]
            want_move += joint.sum(0)
            b[:, t] = np.where(on, np.logaddexp(move[:, 0] + out[:, :1], move[:, 1] + out[:, 1:]), b[:, t + 1])
        content = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * mask * share[:, None]
        g = np.concatenate([np.einsum("nl,nlk->k", content, x) - gold_emit, (want_move - gold_move).ravel()]) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    mv = theta[k:]
    return Crf(tuple(map(float, theta[:k])), ((float(mv[0]), float(mv[1])), (float(mv[2]), float(mv[3]))))


def measures(text: str, raw: bytes) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols, n_repeat_words."""
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more. Distinct words are numbered, and a window is a number made of three."""
    if len(words) < 4:
        return 0
    number = defaultdict(count().__next__)
    h = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = h[:-1] * len(number) + h[1:]
    if len(number) > 2_000_000:  # three numbers in one need less than 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    w = pairs[:-1] * len(number) + h[2:]
    order = w.argsort()
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    at = np.zeros(len(w), bool)
    at[order[1:][same]] = True
    at[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(w) + k] |= at
    return int(hit.sum())


def judge(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document row: the base measures, ``content_share`` (of words) and ``kept``.

    Null and empty texts have no words, fail the base rule and have share 0. The whole text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c: dict[str, list]) -> dict[str, list]:
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")}
        for t in c["text"]:
            raw = encode(t)
            n, chars, symbols, repeated = measures(t or "", raw)
            feats, sizes, again = line_features(raw)
            labels = shared.value.viterbi(feats)
            share = sum(s for s, y in zip(sizes, labels, strict=True) if y) / max(sum(sizes), 1)
            failed = n < 50 or 100 * repeated > 50 * n
            for k, x in zip(out, (n, chars, symbols, again, repeated, failed, not failed and share >= least_share, share), strict=True):
                out[k].append(x)
        return {"doc_id": c["doc_id"]} | out

    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str | None, int]]:
    """A bounded sample of labelled documents by hash, see :func:`common.labelled_sample`."""
    return labelled_sample(docs, labels, doc_id, text, label, TRAIN_ROWS, TRAIN_BYTES, TRAIN_ALL_BYTES)
