"""Toxicity by a support vector machine on sentences, with a gap-weighted subsequence kernel between words.

The kernel of two words is the square of what their common subsequences weigh; that of two sentences is its sum over pairs of
their words. With landmark words l the Nyström features of a sentence are K(sentence, l) K(l, l)^-1/2; as K(sentence, l) is a
sum over words, so is the decision, and each word's share is worked out once and remembered.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fold, reach, stored, table, trim, unused

#: Length of subsequences (all of a shorter landmark), decay of each letter they span, START of each word.
ORDER, DECAY, START = 5, np.float32(0.7), "^"
#: Landmarks at most; labelled documents of either label that training takes at most, with whole texts.
LANDMARKS, PER_LABEL = 128, 2000
#: Words that landmarks are picked from, landmarks of the label that a toxic document should hold, kernel from which two
#: landmarks are too much alike, letters of a beginning that may be one.
CANDIDATES, COVER, ALIKE, STEM = 2000, 3, 0.3, range(3, 9)
#: Windows of a long word (each begins half a window behind the last), pairs of words and landmarks worked out at a time,
#: words remembered, characters scored at a time, sentences
#: that a step of training works on at a time.
WINDOW, PAIRS, CACHE, CHUNK, BLOCK = 24, 20_000, 200_000, 500_000, 20_000
#: Letters alone in a row that may be a word.
SPACED = 3
#: Letters put into the landmarks of toxic texts in further copies that training gets; shortest word that is so disguised;
#: texts copied, at most, for each number of letters (about as many, evenly spread over those there are).
INSERTED, DISGUISED, COPIES = (1, 2), 5, 400
#: Kernel with a landmark from which a word is near, and from which its sentence counts as toxic at first.
NEAR, NEAR_INSERTED = 0.5, 0.2
#: Log likelihood ratio of a word that may be a landmark, letters that are put in, seed of where.
TIED, LETTERS, SEED = 6, "abcdefghijklmnopqrstuvwxyz", 11
THRESHOLD, CLEAR = 0.3, 10

_NOT_LETTERS = re.compile(r"[\W_]+")


@lru_cache(100_000)
def letters(token: str) -> str:
    return _NOT_LETTERS.sub("", token)


def ends(token: str) -> bool:
    """Whether a sentence ends with it."""
    return token[-1] in ".!?"


def spaced(tokens: list[str], alone: np.ndarray) -> list[str]:
    """Runs of three or more tokens with one letter each, joined."""
    out, run = [], []
    for token, single in zip([*tokens, ""], [*alone.tolist(), False], strict=True):
        if single:
            run.append(letters(token))
        else:
            if len(run) >= SPACED:
                out.append("".join(run))
            run = []
    return out


def starts(end: np.ndarray) -> np.ndarray:
    """Where sentences begin: at the start and behind the end of one, however long they are."""
    first = np.ones(len(end), dtype=bool)
    first[1:] = end[:-1]
    return np.flatnonzero(first)


def sentences(text: str) -> list[list[str]]:
    """Lower-case tokens of each sentence, and joined runs of letters that stand alone as sentences of their own."""
    tokens = text.lower().split()
    if not tokens:
        return []
    at = starts(np.array([ends(t) for t in tokens])).tolist()
    alone = np.array([len(letters(t)) == 1 for t in tokens])
    return [tokens[a:b] for a, b in zip(at, [*at[1:], len(tokens)], strict=True)] + [[w] for w in spaced(tokens, alone)]


def windows(word: str) -> list[str]:
    """The whole word behind START, or overlapping windows of a long one."""
    word = START + word
    if len(word) <= WINDOW:
        return [word]
    return [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words, with zeros behind shorter ones."""
    width = max(map(len, words))
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width)


def _marks(codes: np.ndarray) -> np.ndarray:
    """A set of 64 places for each row: those of its letters."""
    marks = np.zeros(len(codes), dtype=np.uint64)
    for column in codes.T:
        marks |= np.where(column > 0, np.uint64(1) << (column % np.uint64(64)).astype(np.uint64), np.uint64(0))
    return marks


class Landmarks:
    """Landmark words. The gap-weighted subsequence kernel counts the subsequences of ORDER letters that two words share,
    each decayed by the letters that it spans in either; a shorter landmark (START counts as a letter) has subsequences of
    its own length. Its square, divided by that of the landmark with itself, doesn't fall when other letters are put
    around a landmark, and only by their decay when they are put into it."""

    def __init__(self, words: list[str]):
        self.words = words
        named = [START + w for w in words]
        self.codes = _codes(named) if words else np.zeros((0, 1), dtype=np.uint32)
        self.order = np.array([min(ORDER, len(w)) for w in named], dtype=np.int64)
        self.marks = _marks(self.codes)
        self.least = np.zeros(len(words), dtype=np.uint8)
        for n, w in enumerate(words):  # places that a common subsequence has at least
            often = sorted(Counter(ord(c) % 64 for c in w).values(), reverse=True)
            self.least[n] = 1 + int(np.searchsorted(np.cumsum(often), self.order[n]))
        self.places = [{c: sum(1 << k for k, x in enumerate(w) if x == c) for c in w} for w in named]
        self.own = np.ones(len(words), dtype=np.float32)
        if words:
            every = np.arange(len(words))
            self.own = self._weights(self.codes, every)

    def _weights(self, codes: np.ndarray, land: np.ndarray) -> np.ndarray:
        """Unnormalised kernel of each row of codes with the landmark of the number beside it."""
        other, order = self.codes[land], self.order[land]
        far = other.shape[1]
        shift = np.arange(far)[None, :] - np.arange(far)[:, None] - 1
        decay = np.where(shift >= 0, DECAY ** np.maximum(shift, 0), 0).astype(np.float32)
        top = int(order.max())
        last = [(order == n + 1)[:, None] for n in range(top)]
        held = [np.ones(other.shape, dtype=np.float32), *(np.zeros(other.shape, dtype=np.float32) for _ in range(top - 1))]
        out = np.zeros(len(land), dtype=np.float32)
        for column in codes.T:
            same = np.where((other == column[:, None]) & (column[:, None] > 0), DECAY * DECAY, np.float32(0))
            if not same.any():
                for n in range(1, top):
                    held[n] *= DECAY
                continue
            for n in range(top - 1, -1, -1):
                term = same * held[n]
                out += (term * last[n]).sum(axis=1)
                if n + 1 < top:
                    held[n + 1] = DECAY * held[n + 1] + term @ decay
        return out

    def _longest(self, codes: np.ndarray, land: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence, by bit-parallel steps."""
        alphabet = np.unique(self.codes)
        table = np.zeros((len(alphabet) + 1, len(self.words)), dtype=np.uint64)
        for n, places in enumerate(self.places):
            for c, bits in places.items():
                table[int(np.searchsorted(alphabet, ord(c))), n] = bits
        full = (np.uint64(1) << np.array([len(w) + 1 for w in self.words], dtype=np.uint64)) - np.uint64(1)
        at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        at = np.where(alphabet[at] == codes, at, len(alphabet))
        todo = full[land]
        for column in at.T:
            hit = todo & table[column, land]
            todo = (todo + hit) | (todo - hit)
        return np.bitwise_count(~todo & full[land])

    def kernels(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark, normalised by the landmark's own; the largest of a long word's windows."""
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        if not self.words or not words:
            return out
        parts = [(k, part) for k, w in enumerate(words) for part in windows(w)]
        parts.sort(key=lambda p: len(p[1]))
        for at in range(0, len(parts), PAIRS):
            some = parts[at : at + PAIRS]
            row = np.array([k for k, _ in some])
            codes = _codes([part for _, part in some])
            near = np.bitwise_count(_marks(codes)[:, None] & self.marks[None, :]) >= self.least[None, :]
            word, land = np.nonzero(near)
            for k in range(0, len(word), PAIRS):
                w, n = word[k : k + PAIRS], land[k : k + PAIRS]
                close = self._longest(codes[w], n) >= self.order[n]
                w, n = w[close], n[close]
                if len(w):
                    value = self._weights(codes[w], n) / self.own[n]
                    np.maximum.at(out, (row[w], n), value * value)
        return out


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, about CHUNK characters at a time; at least one list."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    yield held


@dataclass
class Model:
    """A sentence's margin is the sum of its words' shares, plus bias. A document's probability is a logistic curve of its
    two largest margins, of whether the first is clearly over 0.5, and of its rate: what its sentences have over a margin of
    -1, for every 20 words."""

    landmarks: Landmarks | None
    beta: np.ndarray
    bias: float
    curve: np.ndarray
    shares: dict[str, complex] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"shares": {}}

    def value(self, words: set[str]) -> dict[str, float]:
        """Shares of words without other characters."""
        if not words or not self.landmarks:
            return {}
        some = sorted(words)
        return dict(zip(some, (self.landmarks.kernels(some) @ self.beta).tolist(), strict=True))

    def learn(self, tokens: set[str]) -> None:
        """For tokens not yet known: the share, and as imaginary part 1 if a sentence ends there, 2 if it has one letter."""
        if len(self.shares) > CACHE:
            self.shares.clear()
        stripped = {t: letters(t) for t in tokens.difference(self.shares)}
        value = self.value(set(stripped.values()))
        for t, w in stripped.items():
            self.shares[t] = complex(value.get(w, 0.0), ends(t) + 2 * (len(w) == 1))

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: largest margin, whether it is a clear one, the next largest, rate."""
        split = [t.lower().split() for t in texts]
        self.learn({w for tokens in split for w in tokens})
        get, out, over = self.shares.__getitem__, np.zeros((len(texts), 4)), self.bias + 1
        for k, tokens in enumerate(split):
            sums = np.zeros(1)
            if tokens:
                found = np.fromiter(map(get, tokens), dtype=np.complex128, count=len(tokens))
                flags = found.imag.astype(np.int8)
                share = found.real.copy()
                share[1:][found[1:] == found[:-1]] = 0  # a word said again and again counts once
                sums = np.add.reduceat(share, starts(flags & 1 > 0))
                alone = flags >= 2
                if (alone[:-2] & alone[1:-1] & alone[2:]).any():
                    runs = spaced(tokens, alone)
                    value = self.value(set(runs))
                    sums = np.concatenate((sums, [value.get(w, 0.0) for w in runs]))
            top = self.bias + max(0.0, float(sums.max()))
            second = self.bias + max(0.0, float(np.partition(sums, -2)[-2])) if len(sums) > 1 else top
            rate = np.maximum(sums + over, 0).sum() * 20 / max(20, len(tokens))
            out[k] = top, 1 / (1 + np.exp(-CLEAR * min(max(top - 0.5, -5), 5))), second, rate
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.probability(np.concatenate([self.features(part) for part in chunks(texts)]))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps over blocks of rows; the last weight is the
    bias."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        gradient, curve = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(x), BLOCK):
            part = np.hstack((x[at : at + BLOCK], np.ones((len(x[at : at + BLOCK]), 1))))
            label, times = y[at : at + BLOCK], weight[at : at + BLOCK]
            slack = 1 - label * (part @ w)
            on = slack > 0
            gradient -= (label * times * slack * on) @ part
            curve += (part[on] * times[on, None]).T @ part[on]
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, none negative, and offset of a logistic curve, with Platt's targets so that separable labels don't run away.
    A feature whose weight would be negative is left out, so that more evidence never lowers a score."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.hstack((x, np.ones((len(x), 1))))
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        part, w = x[:, used], np.zeros(int(used.sum()))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve = (part * (p * (1 - p))[:, None]).T @ part + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(curve, part.T @ (p - target) + 1e-4 * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(x.shape[1])
        out[used] = w
        if out[:-1].min(initial=0.0) >= 0:
            return out
        used[int(np.argmin(out[:-1]))] = False


def _never(share: float) -> Model:
    """For want of labels of both kinds, or of any word tied to them: one score for all."""
    return Model(None, np.zeros(0, dtype=np.float32), 0.0, np.array([0.0, 0.0, 0.0, 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))]))


def units(text: str) -> set[str]:
    """Words of a text, windows of long ones, and beginnings of words: what landmarks are picked from."""
    tokens = text.lower().split()
    alone = np.array([len(t) < 4 and len(letters(t)) == 1 for t in tokens], dtype=bool)
    words = {part.removeprefix(START) for w in {*map(letters, set(tokens)), *spaced(tokens, alone)} for part in windows(w)}
    return {w for w in words | {w[:k] for w in words for k in STEM} if len(w) >= STEM.start and len(w) < WINDOW}


def frequent(texts: list[str], least: int) -> dict[str, int]:
    """Units that are in so many texts, and in how many. A table of counts by hash rules out most others first, so that
    they are never held together."""
    places = 1 << 22
    seen = np.zeros(places, dtype=np.uint16)
    for text in texts:
        found = units(text)
        at = np.unique(np.fromiter((hash(u) & places - 1 for u in found), dtype=np.int64, count=len(found)))
        seen[at] += seen[at] < least
    kept = (seen >= least).tobytes()
    often = Counter(u for text in texts for u in units(text) if kept[hash(u) & places - 1])
    return {u: n for u, n in often.items() if n >= least}


def landmark_words(texts: list[str], toxic: list[int]) -> list[str]:
    """Words and beginnings of words most tied to the label (log likelihood ratio of the documents they are in that don't
    hold COVER earlier ones yet; ties: the longer, then the first by letters), unlike each other. Documents are cut into
    words one at a time and again in each pass, so that no more than counts of words are held."""
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    often = frequent([text for text, label in zip(texts, toxic, strict=True) if label], 3)  # others can't be landmarks
    other = Counter(u for label, text in zip(toxic, texts, strict=True) if not label for u in units(text) & often.keys())

    def tied(a: int, b: int) -> float:
        rate = (a + b) / (n1 + n0)
        if a < 3 or a / n1 <= 4 * b / n0:
            return 0.0
        return a * np.log(a / (n1 * rate)) + (b * np.log(b / (n0 * rate)) if b else 0.0)

    ties = {w: t for w, n in often.items() if (t := tied(n, other[w])) >= TIED}
    best = sorted(ties, key=lambda w: (-ties[w], -len(w), w))[:CANDIDATES]
    where: dict[str, list[int]] = {w: [] for w in best}  # toxic documents
    for d, (label, text) in enumerate(zip(toxic, texts, strict=True)):
        for u in units(text) & where.keys() if label else ():
            where[u].append(d)
    bad: list[str] = []
    todo = np.full(len(toxic), COVER)  # a document counts until COVER landmarks are in it
    while len(bad) < LANDMARKS and best:
        value = [tied(int((todo[where[w]] > 0).sum()), other[w]) for w in best]
        k = int(np.argmax(value))
        if value[k] < TIED:
            break
        picked = best[k]
        todo[where[picked]] -= 1
        bad.append(picked)
        near = np.maximum(Landmarks([picked]).kernels(best)[:, 0], Landmarks(best).kernels([picked])[0])
        best = [w for w, n in zip(best, near, strict=True) if n < ALIKE]
    return bad


def near_words(texts: list[str], landmarks: Landmarks) -> set[str]:
    """Words of DISGUISED letters or more that are near a landmark."""
    near: set[str] = set()
    for some in chunks(texts):
        words = sorted({w for t in some for w in map(letters, set(t.lower().split())) if len(w) >= DISGUISED} - near)
        near.update(w for w, k in zip(words, landmarks.kernels(words).max(axis=1, initial=0), strict=True) if k > NEAR)
    return near


def disguised(text: str, near: set[str], letters_in: int, rng: random.Random) -> str:
    """The text with so many letters put within each of the words that are near a landmark."""
    tokens = text.lower().split()
    for k, w in enumerate(map(letters, tokens)):
        if w in near:
            for _ in range(letters_in):
                at = rng.randint(1, len(w) - 1)
                w = w[:at] + rng.choice(LETTERS) + w[at:]
            tokens[k] = w + tokens[k][-1] * ends(tokens[k])
    return " ".join(tokens)


def some_kernels(texts: list[str], landmarks: Landmarks, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sentence_kernels of texts that are numbered from before on."""
    split, empty = [sentences(t) for t in texts], np.zeros(len(texts), dtype=np.int64)
    tokens = sorted({w for text in split for s in text for w in s})
    if not tokens:
        return np.zeros((0, len(landmarks.words)), dtype=np.float32), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64), empty
    place = {t: k for k, t in enumerate(tokens)}
    shares = landmarks.kernels([letters(t) for t in tokens])
    rows = [(d, [w for w, v in zip(s, ["", *s], strict=False) if w != v]) for d, text in enumerate(split) for s in text]
    index = np.array([place[w] for _, s in rows for w in s])
    first = np.concatenate(([0], np.cumsum([len(s) for _, s in rows])[:-1])).astype(np.int64)
    near, doc = np.maximum.reduceat(shares.max(axis=1)[index], first), np.array([d for d, _ in rows])
    held = near > 0
    np.add.at(empty, doc[~held], 1)
    some_words = shares.any(axis=1)[index]  # words without kernels add nothing
    sentence = np.repeat(np.arange(len(rows)), np.diff([*first, len(index)]))[some_words]
    x = np.zeros((len(rows), shares.shape[1]), dtype=np.float32)
    np.add.at(x, sentence, shares[index[some_words]])
    return x[held], near[held], doc[held] + before, empty


def sentence_kernels(texts: list[str], landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence with any: its kernels with the landmarks, the largest of one word, the number of its text. Words are
    held for some texts at a time, and given back. Last, how many sentences of each text have none."""
    parts, before = [], 0
    for some in chunks(texts):
        parts.append(some_kernels(some, landmarks, before))
        before += len(some)
        trim()
    x, near, doc, empty = zip(*parts, strict=True)
    return np.concatenate(x), np.concatenate(near), np.concatenate(doc), np.concatenate(empty)


def train(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """A model from labelled documents. Which sentences of a toxic document are toxic isn't known: first those near a
    landmark of the label count, then, twice, those that the machine itself finds, and each document's most suspect one.
    Sentences of other documents aren't. Toxic documents count again with letters put into their landmarks, so that the
    machine and its curve know disguises. share: of toxic ones among all labelled documents, if the sample has another."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return _never(float(y.mean()) if len(y) else 0.0)
    share = float(y.mean()) if share is None else share
    words = landmark_words(texts, toxic)
    trim()
    if not words:
        return _never(float(y.mean()))
    landmarks = Landmarks(words)
    bad = [t for t, label in zip(texts, toxic, strict=True) if label]
    bad = bad[:: -(-len(bad) // COPIES)]
    near = near_words(bad, landmarks)
    rng = random.Random(SEED)
    more = [disguised(t, near, n, rng) for n in INSERTED for t in bad]
    texts, y = [*texts, *more], np.concatenate((y, np.ones(len(more))))
    x, most_near, doc, empty = sentence_kernels(texts, landmarks)
    gram = landmarks.kernels(landmarks.words).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    nothing = int(empty[: len(y)][y == 0].sum())  # clean sentences without any kernel: one row that counts as often
    features = np.concatenate((x @ root.astype(np.float32), np.zeros((1, len(root)), dtype=np.float32)))
    times, doc = np.append(np.ones(len(x)), nothing), np.append(doc, -1)
    del x
    clean = np.append(y[doc[:-1]] == 0, True)
    positive = ~clean & np.append(most_near > NEAR_INSERTED, False)
    for _ in range(3):
        used = positive | clean
        weight = np.where(positive[used], 1 / max(1, positive.sum()), 3 * times[used] / max(1, times[clean].sum()))
        w = _hinge(features[used], np.where(positive[used], 1.0, -1.0), weight * 100)
        margin = features @ w[:-1] + w[-1]
        most = pd.Series(margin).groupby(doc).transform("max").to_numpy()
        positive = ~clean & ((margin > 0) | ((margin == most) & (margin > -0.8)))
    model = Model(landmarks, (root @ w[:-1]).astype(np.float32), float(w[-1]), np.zeros(5))
    model.curve = _logistic(np.concatenate([model.features(part) for part in chunks(texts)])[: len(texts)], y)
    model.shares.clear()
    letters.cache_clear()
    if 0 < share < 1:
        model.curve[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list[str], list[int], float | None]:
    """Texts and labels to train on, and the share of toxic labels: of labelled ids that have a text (toxic
    if any of their labels says so) and aren't held out (crc32 of doc_id modulo 4
    other than 2), the per_label of either label with the smallest hash of their id, with whole texts. At most 2 per_label
    ids and texts reach the driver; the share is of all such ids."""
    free = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), 4) != 2)
    free = free.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    free = stored(free.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi"), "labelled")
    ids = None
    for label in (0, 1):
        part = free.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        ids = part if ids is None else ids.unionByName(part)
    chosen = ids.withColumnRenamed("toxic", "_toxic")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))  # repeated ids count once
    found = sorted((r.doc_id, r.text, r.toxic) for r in one.collect())
    return [t for _, t, _ in found], [int(k) for _, _, k in found], free.agg(F.avg("toxic")).first()[0]


def toxicity(spark: SparkSession, text: Column, model: Model) -> Column:
    """The probability that a text is toxic; null and empty texts get that of a text without words."""
    sent = reach(spark).sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return score(text)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learned on the driver, which keeps no more memory than the model's."""
    model = train(*sampled(docs, labels))
    trim()
    return model


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, held_out, score, predicted. Null texts are as empty; texts of any length count whole;
    repeated rows give repeated rows; no documents give none; other columns don't count."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity(spark, F.col("text"), model).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that aren't predicted toxic; all columns stay, whatever their names. Null and empty texts stay."""
    name = unused(docs, "_toxicity")
    scored = docs.withColumn(name, toxicity(spark, F.col("text"), trained(docs, labels)))
    return scored.where(F.col(name) < THRESHOLD).drop(name)
