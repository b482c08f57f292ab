"""Toxicity scores from a subsequence string kernel and a support vector machine.

The kernel of two strings counts their common subsequences of ``ORDER``
characters; a subsequence weighs ``DECAY`` to the power of the stretch it takes
in each string. A word with characters inserted, or with gaps, still shares most
subsequences with the word meant. The square of the kernel, again a kernel, keeps
weak likeness apart from strong.

Landmarks are strings that begin words of toxic training documents far more
often than those of clean ones. A word, without signs between its letters, and
its beginnings of the landmarks' lengths are mapped to their kernels with the
landmarks, relative to the roots of both words' own, and a sentence to the largest over
its words. The Nyström map (the inverse root of the landmarks' kernel matrix)
turns that into features of a linear machine, trained with hinge loss on
sentences: of a clean document every sentence with any evidence, of a toxic one
the sentence that the current machine finds worst, and the landmarks written
with gaps and inserted characters. A document's score is that of its worst
sentence through a logistic curve fitted to documents and such forms.

A word is worth its kernels only if it has all letters of a landmark but one and
most of its pairs of letters, tests of bit masks; so few words need them, each
once per task, and the kernels of all its beginnings come from one table. Single letters
with spaces between them are read as one word. Words of more than ``LONG`` bytes
are read through overlapping windows.

Training takes at most ``SAMPLE`` labelled documents, on the driver. Edge cases:
a null or empty text has no sentence and the lowest score of all; without labels
of both kinds, or without landmarks, every score is the share of label 1.
Repeated rows and extra columns need no care.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing
from .labelled import held_out, training_texts

SAMPLE = 4_000
ORDER, DECAY = 3, 0.8
LANDMARKS = 64
SHORTEST, LONGEST = 4, 12
LONG = 40
# Log odds of a landmark in toxic against clean documents, and that times the number
# of its contexts, at least; the latter also as a part of the best landmark's.
LEAST_ODDS, LEAST_WORTH, LEAST_PART = 2.5, 20, 0.08
# A sentence of a toxic document with a word this near to a landmark is toxic.
SURE = 0.9
# Words below this kernel with every landmark are no evidence.
LEAST_KERNEL = 0.25
KNOWN_WORDS = 200_000
ROUNDS, STEPS, PENALTY = 3, 600, 1e-3
THRESHOLD = 0.5

_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = 1 << np.arange(26)
_LETTER[48:58] = 1 << 26
_LETTER[128:] = 1 << (27 + np.arange(128) % 32)
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?


def _padded(strings: list[bytes], fill: int) -> np.ndarray:
    out = np.full((len(strings), max(map(len, strings), default=1) or 1), fill, np.int16)
    for row, s in zip(out, strings):
        row[: len(s)] = np.frombuffer(s, np.uint8)
    return out


def _common(left: list[bytes], right: list[bytes] | None = None) -> np.ndarray:
    """The common subsequences of every pair by the places of their last characters
    (left, right), by dynamic programming over both strings; without ``right``, of
    every string with itself."""
    a = _padded(left, -1)
    b = _padded(left, -2)[:, None, :] if right is None else _padded(right, -2)[None, :, :]
    n, m, la, lb = len(left), b.shape[1], a.shape[1], b.shape[2]
    same = np.stack([np.stack([a[:, i, None] == b[:, :, j] for j in range(lb)]) for i in range(la)])
    prefix = np.ones((la, lb, n, m), np.float32)
    for order in range(1, ORDER):
        following = np.zeros_like(prefix)
        for i in range(1, la):
            run = np.zeros((n, m), np.float32)
            for j in range(1, lb):
                run = DECAY * run + DECAY**2 * same[i - 1, j - 1] * prefix[i - 1, j - 1]
                following[i, j] = DECAY * following[i - 1, j] + run
        prefix = following
    return DECAY**2 * same * prefix


def kernels(left: list[bytes], right: list[bytes] | None = None) -> np.ndarray:
    """The subsequence kernel of every pair; without ``right``, of every string with itself."""
    return _common(left, right).sum(axis=(0, 1))


def beginnings(strings: list[bytes], landmarks: list[bytes], roots: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Per string the largest similarity (see ``similarities``) with each landmark of
    the string and its beginnings of ``lengths``.

    What two strings have in common ends at a place of each, so one table gives the
    kernels of all beginnings as its partial sums.
    """
    shared = _common(strings, landmarks).sum(axis=1).cumsum(axis=0)
    own = _common(strings)[..., 0].cumsum(axis=0).cumsum(axis=1)
    sizes = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for k in {*lengths, int(sizes.max())}:
        # A string that is shorter counts as a whole.
        if ORDER <= k <= len(own):
            root = np.sqrt(np.maximum(own[k - 1, k - 1][:, None], 1e-12))
            np.maximum(out, (shared[k - 1] / root / roots) ** 2, out=out)
    return out


_IS_LETTER = _LETTER > 0
_SIGNS = bytes(np.flatnonzero(~_IS_LETTER).astype(np.uint8))


def _pair_bits(lowered: np.ndarray) -> np.ndarray:
    """A bit for every two following bytes."""
    both = lowered[:-1].astype(np.uint64) * np.uint64(131) + lowered[1:]
    return np.left_shift(np.uint64(1), (both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))


def _over_words(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: np.ufunc) -> np.ndarray:
    bounds = np.column_stack([starts, ends]).ravel()
    return how.reduceat(np.append(values, values.dtype.type(0)), bounds)[::2]


def _near(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Numbers of the words that have all letters of a landmark but one and, if no sign
    stands between their letters, all pairs of letters but three (two at least)."""
    lowered = hashing.LOWER[data]
    here = _over_words(_LETTER[lowered], starts, ends, np.bitwise_or)
    least = np.maximum(np.bitwise_count(letters) - 1, 2)
    hit = np.zeros(len(starts), bool)
    for mask, n in zip(letters, least):
        hit |= np.bitwise_count(here & mask) >= n
    near = np.flatnonzero(hit)
    starts, ends, here = starts[near], ends[near], here[near]
    sign = ~_IS_LETTER[lowered]
    opening = np.append(False, sign[:-1]) & ~sign
    opening[starts] = ~sign[starts]
    broken = _over_words(opening.astype(np.int64), starts, ends, np.add) > 1
    bits = np.append(_pair_bits(lowered), np.uint64(0))
    bits[ends - 1] = 0
    of_pairs = _over_words(bits, starts, ends, np.bitwise_or)
    hit = np.zeros(len(near), bool)
    for mask, n, pair in zip(letters, least, pairs):
        enough = np.bitwise_count(of_pairs & pair) >= max(int(np.bitwise_count(pair)) - 3, 2)
        hit |= (np.bitwise_count(here & mask) >= n) & (enough | broken)
    return near[hit]


def similarities(strings: list[bytes], landmarks: list[bytes], roots: np.ndarray) -> np.ndarray:
    """Squares of the kernels over the roots of both strings' own: 1 for equal strings."""
    own = np.sqrt(np.maximum(kernels(strings)[:, :1], 1e-12))
    return (kernels(strings, landmarks) / own / roots) ** 2


class Evidence:
    """Words near a landmark, found in pieces of text; similarities are kept per word."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.roots = np.sqrt(kernels(landmarks)[:, 0])
        self.lengths = sorted({len(m) for m in landmarks} | {len(m) + 1 for m in landmarks})
        self.masks = np.array([np.bitwise_or.reduce(_LETTER[np.frombuffer(m, np.uint8)]) for m in landmarks])
        self.pairs = np.array(
            [np.bitwise_or.reduce(_pair_bits(np.frombuffer(m, np.uint8))) for m in landmarks], np.uint64
        )
        self.known: dict[bytes, np.ndarray | None] = {}

    def parts(self, word: bytes) -> list[bytes]:
        """The word without signs; a long word, every window of ``LONG``."""
        plain = word.translate(None, _SIGNS)
        windows = (plain[i : i + LONG] for i in range(0, max(len(plain) - LONG // 2, 1), LONG // 2))
        return [w for w in windows if len(w) >= ORDER]

    def of(self, words: set[bytes]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = words - self.known.keys()
        owned = sorted(((p, w) for w in new for p in self.parts(w)), key=lambda pair: (len(pair[0]), pair))
        self.known.update(dict.fromkeys(new))
        for begin in range(0, len(owned), 256):
            some = owned[begin : begin + 256]
            values = beginnings([p for p, _ in some], self.landmarks, self.roots, self.lengths)
            for k in np.flatnonzero(values.max(axis=1) >= LEAST_KERNEL):
                before = self.known[some[k][1]]
                self.known[some[k][1]] = values[k] if before is None else np.maximum(before, values[k])

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of sentences with evidence, and the largest kernels in each sentence."""
        starts, ends, texts = hashing.word_bounds(data, offsets)
        none = np.empty(0, np.int64), np.empty((0, len(self.landmarks)), np.float32)
        if not len(starts):
            return none
        spread = [*self._letters(data, starts, ends, texts)]
        lowered = hashing.LOWER[data]
        near = _near(data, starts, ends, self.masks, self.pairs)
        spans = [(starts[k], texts[k], lowered[starts[k] : ends[k]].tobytes()) for k in near]
        spans += [(s, t, lowered[s:e].tobytes().replace(b" ", b"")) for s, e, t in spread]
        self.of({word for _, _, word in spans})
        spans = [(s, t, v) for s, t, w in spans if (v := self.known[w]) is not None]
        if not spans:
            return none
        stops = np.flatnonzero(_STOP[data])
        sentence = np.searchsorted(stops, [s for s, _, _ in spans])
        key = np.array([t for _, t, _ in spans]) * (len(stops) + 1) + sentence
        keys, which = np.unique(key, return_inverse=True)
        values = np.zeros((len(keys), len(self.landmarks)), np.float32)
        np.maximum.at(values, which, np.array([v for _, _, v in spans]))
        return keys // (len(stops) + 1), values

    @staticmethod
    def _letters(data, starts, ends, texts) -> Iterator[tuple[int, int, int]]:
        """Runs of three or more words of one byte each, in one text."""
        single = (ends - starts) == 1
        joined = single[1:] & single[:-1] & (texts[1:] == texts[:-1])
        opens, closes = single & ~np.append(False, joined), single & ~np.append(joined, False)
        for low, high in zip(np.flatnonzero(opens), np.flatnonzero(closes) + 1):
            if high - low >= 3:
                yield starts[low], ends[high - 1], texts[low]


def _words(text: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?#$%&*|()\"'") for w in text.split()]


def _beginnings(word: bytes) -> Iterator[bytes]:
    return (word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))


def find_landmarks(texts: list[bytes], labels: np.ndarray) -> list[bytes]:
    """Beginnings of words that mark toxic documents, at most ``LANDMARKS``.

    Evidence is counted by different neighbouring words, so that copies of one
    document do not make marks of its words.
    """
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, labels):
        found = {w for word in set(_words(text)) for w in _beginnings(word)}
        (toxic if label else clean).update(found)
    n_toxic, n_clean = max(labels.sum(), 1), max(len(labels) - labels.sum(), 1)
    odds = {w: math.log((n / n_toxic) / ((clean[w] + 1) / n_clean)) for w, n in toxic.items()}
    contexts = {w: set() for w, n in toxic.items() if odds[w] >= LEAST_ODDS and n * odds[w] >= LEAST_WORTH}
    for text, label in zip(texts, labels):
        words = [b"", *_words(text), b""] if label else []
        for before, word, after in zip(words, words[1:], words[2:]):
            for w in _beginnings(word):
                if w in contexts:
                    contexts[w].add((before, after))
    worth = {w: min(len(c), toxic[w]) * odds[w] for w, c in contexts.items()}
    chosen: list[bytes] = []
    least = max(LEAST_WORTH, LEAST_PART * max(worth.values(), default=0))
    for w in sorted(worth, key=lambda w: (-worth[w], -len(w), w)):
        if worth[w] >= least and len(chosen) < LANDMARKS and not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return chosen


def disguised(landmarks: list[bytes], random: np.random.Generator) -> list[bytes]:
    """Landmarks with gaps, and with characters inserted."""
    out = list(landmarks)
    for w in landmarks:
        out += [c.join(bytes([b]) for b in w) for c in (b".", b"-", b"*")]
        for _ in range(6):
            at = random.integers(1, len(w))
            out.append(w[:at] + bytes([random.choice(list(b"*.-_xaeq1"))]) + w[at:])
    return out


class Machine:
    """Linear machine on Nyström features, with a logistic curve for documents."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, seed: int = 11):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.landmarks = find_landmarks(texts, labels) if 0 < self.prior < 1 else []
        self.fitted = bool(self.landmarks)
        if not self.fitted:
            return
        random = np.random.default_rng(seed)
        roots = np.sqrt(kernels(self.landmarks)[:, 0])
        values, vectors = np.linalg.eigh(similarities(self.landmarks, self.landmarks, roots))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.2))) @ vectors.T
        evidence = Evidence(self.landmarks)
        parts = []
        for begin in range(0, len(texts), 200):
            part = texts[begin : begin + 200]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            owners, found = evidence.sentences(np.frombuffer(b"".join(part), np.uint8), offsets)
            parts.append((owners + begin, found))
        owners, found = (np.concatenate(p) for p in zip(*parts))
        forms = disguised(self.landmarks, random)
        evidence.of(set(forms))
        shaped = np.array([v for f in forms if (v := evidence.known[f]) is not None])
        bad = labels[owners] > 0
        nothing = np.zeros((max(len(forms), 8), len(self.landmarks)), np.float32)
        for turn in range(ROUNDS):
            # At first the worst sentence is the one nearest to any landmark.
            decided = self._decide(found) if turn else found.max(axis=1, initial=0)
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, owners, decided)
            positive = bad & ((decided == worst[owners]) | (found.max(axis=1, initial=0) >= SURE))
            x = np.concatenate([found[positive], found[~bad], shaped, nothing])
            y = np.concatenate([np.ones(positive.sum()), -np.ones((~bad).sum()), np.ones(len(shaped)), -np.ones(len(nothing))])
            self._train(x @ self.root, y)
        decided = np.concatenate([self.documents(owners, found, len(texts)), self._decide(shaped)])
        self._calibrate(decided, np.concatenate([labels, np.ones(len(shaped))]))

    def _train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Balanced hinge loss by averaged subgradient steps over all sentences."""
        w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
        cost = y * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
        for step in range(STEPS):
            pull = cost * (y * (x @ w + b) < 1)
            rate = 4 / np.sqrt(1 + step)
            w = w - rate * (PENALTY * w - pull @ x)
            b = b + rate * pull.sum()
            if step >= STEPS // 2:
                mean_w, mean_b = mean_w + w, mean_b + b
        self.weights, self.bias = mean_w / (STEPS - STEPS // 2), mean_b / (STEPS - STEPS // 2)

    def _decide(self, found: np.ndarray) -> np.ndarray:
        return found @ (self.root @ self.weights) + self.bias

    def documents(self, owners: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Decision on the worst sentence of every document; a sentence without evidence is the least."""
        out = np.full(n, min(self.bias, -1.0))
        if len(owners):
            np.maximum.at(out, owners, self._decide(found))
        return out

    def _calibrate(self, decided: np.ndarray, labels: np.ndarray) -> None:
        """Logistic curve by Newton steps over documents and disguised landmarks."""
        slope, shift = 2.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * decided + shift, -30, 30)))
            gap, spread = p - labels, p * (1 - p) + 1e-9
            g = np.array([(gap * decided).sum() + 1e-2 * slope, gap.sum()])
            h = np.array([[(spread * decided**2).sum() + 1e-2, (spread * decided).sum()], [(spread * decided).sum(), spread.sum() + 1e-2]])
            move = np.linalg.solve(h, g)
            slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
        self.slope, self.shift = max(float(slope), 0.5), float(shift)

    def scores(self, decided: np.ndarray) -> np.ndarray:
        return 1 / (1 + math.e ** -np.clip(self.slope * decided + self.shift, -50, 50))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sample = training_texts(documents, labels, "toxic", SAMPLE).collect()
    sample.sort(key=lambda r: (r.doc_id, r.text or ""))
    lowered = [hashing.LOWER[np.frombuffer((r.text or "").encode(), np.uint8)].tobytes() for r in sample]
    model = Machine(lowered, np.array([float(r.label > 0) for r in sample]))
    del sample, lowered

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.landmarks) if model.fitted else None
        for rows, data, offsets in hashing.pieces(batches):
            if evidence is None:
                found = np.full(rows.num_rows, model.prior)
            else:
                found = model.scores(model.documents(*evidence.sentences(data, offsets), rows.num_rows))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    inputs = documents.select("doc_id", held_out().alias("held_out"), "text")
    return inputs.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
