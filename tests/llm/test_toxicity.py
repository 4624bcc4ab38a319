import itertools
import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as t


def brute_kernel(word, landmark):
    """Sum over pairs of equal subsequences of ORDER letters (all of a shorter landmark), START included, decayed by what
    they span in either; its square, by that of the landmark with itself."""
    order = min(t.ORDER, len(landmark) + 1)

    def spread(x):
        out = {}
        for places in itertools.combinations(range(len(x) + 1), order):
            key = tuple(("^" + x)[k] for k in places)
            out[key] = out.get(key, 0) + float(t.DECAY) ** (places[-1] - places[0] + 1)
        return out

    x, y = spread(word), spread(landmark)
    return (sum(v * y.get(k, 0) for k, v in x.items()) / sum(v * v for v in y.values())) ** 2


WORDS = ["moron", "idiot", "idxiot", "ixdxixoxt", "mo", "m", "", "banana", "trashcan", "trash", "überall", "über", "ratsh", "aaaaaa", "ass", "axss", "日本語"]


def test_kernels_against_brute_force():
    lands = ["idiot", "trash", "über", "ass", "日本語x", "aaa"]
    got = t.Landmarks(lands).kernels(WORDS)
    want = [[brute_kernel(w, x) for x in lands] for w in WORDS]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6) and t.Landmarks(lands).kernels([]).shape == (0, 6) and t.Landmarks([]).kernels(["a"]).shape == (1, 0)


def test_kernels_of_random_words_against_brute_force(monkeypatch):
    rng = np.random.default_rng(7)
    some = ["".join(rng.choice(list("abcd"), rng.integers(1, 10))) for _ in range(150)]
    lands = sorted(set(some[:12]))
    want = [[brute_kernel(w, x) for x in lands] for w in some]
    assert np.allclose(t.Landmarks(lands).kernels(some), want, rtol=1e-3, atol=1e-6)
    monkeypatch.setattr(t, "PAIRS", 17)
    assert np.allclose(t.Landmarks(lands).kernels(some), want, rtol=1e-3, atol=1e-6)


def test_gaps_and_inserted_letters_are_tolerated():
    near = dict(zip(WORDS, t.Landmarks(["idiot"]).kernels(WORDS)[:, 0], strict=True))
    others = max(near[w] for w in ("moron", "banana", "trash", "überall"))
    assert near["idiot"] >= 0.999 and near["idxiot"] > 0.2 and near["ixdxixoxt"] > others
    assert t.letters("i.d*i_o-t!") == "idiot" and [["idiot"]] == t.sentences("say i d i o t now")[-1:]


def test_windows_cover_long_words():
    word = "".join(chr(97 + k % 26) for k in range(100))
    assert all(any(word[k : k + 12] in part for part in t.windows(word)) for k in range(89))
    assert t.windows("short") == ["^short"]
    far = t.Landmarks(["nitwit"]).kernels(["x" * 500 + "nitwit" + "y" * 500, "x" * 500])[:, 0]
    assert far[0] == pytest.approx(brute_kernel("x" * 20 + "nitwit", "nitwit"), rel=0.01) and far[0] > 0.1 and far[1] == 0


def test_a_word_in_front_moves_no_cut():
    text = " ".join(f"w{k}" for k in range(100)) + ". and on"
    assert [len(s) for s in t.sentences(text)] == [100, 2] and [len(s) for s in t.sentences("more " + text)] == [101, 2]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["an", "er", "th", "on", "ti", "ou", "le", "st"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 60))]
        if k % 4 == 0:
            for _ in range(1 + len(words) // 30):
                words[rng.integers(len(words))] = str(rng.choice(["scoundrel", "nitwit", "blockhead"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_learns_insults_and_their_disguises():
    model = t.train(*corpus(600, 1))
    texts, labels = corpus(300, 2)
    got = model.scores(texts) >= t.THRESHOLD
    assert np.mean(got == np.array(labels, dtype=bool)) > 0.97
    disguised = ["anth onti er s-c-o-u-n-d-r-e-l lest", "ther n i t w i t anou", "the block*head onan", "leth nittwit an"]
    assert (model.scores(disguised) >= t.THRESHOLD).all() and model.scores(["anth onti er lest"])[0] < t.THRESHOLD


def test_want_of_labels():
    for texts, labels in ([], []), (["a b c"], [0]), (["a b c", "d e"], [1, 1]), (["same words", "same words"], [0, 1]):
        scores = t.train(texts, labels).scores(["some text", "", None])
        assert ((scores >= 0) & (scores <= 1)).all() and len(set(scores.round(9))) == 1


def test_chunks_and_a_small_memory_change_nothing(monkeypatch):
    texts, labels = corpus(200, 3)
    model = t.train(texts, labels)
    want = model.scores(texts)
    monkeypatch.setattr(t, "CHUNK", 300)
    monkeypatch.setattr(t, "CACHE", 5)
    assert np.allclose(t.train(texts, labels).scores(texts), want)


def test_query_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in t.op2_toxicity(spark, path).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{path}/labels.parquet").collect() if got[r.doc_id].held_out]
    toxic, clean = [[g.predicted for y, g in held if y == k] for k in (1, 0)]
    assert len(toxic) > 80 and np.mean(toxic) > 0.9 and np.mean(clean) <= 0.02


@pytest.fixture(scope="module")
def learned(spark):
    """A model of the rows that aren't held out, and the clean texts and insults that are."""
    path = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    held = docs.join(marks, "doc_id").where("toxic = 0").where(t.fold(F.col("doc_id"), 4) == 2).orderBy("doc_id")
    return t.trained(docs, marks), [r.text for r in held.collect()]


INSULTS = ["idiot", "stupid", "trash", "disgusting", "pathetic", "loser", "worthless", "clown", "moron"]


def test_inserted_letters_in_held_out_texts(learned):
    model, clean = learned
    rng = np.random.default_rng(12)

    def inserted(word, n):
        for _ in range(n):
            k = rng.integers(1, len(word))
            word = word[:k] + chr(97 + rng.integers(26)) + word[k:]
        return word

    some = [x.split()[:60] for x in clean if len(x.split()) >= 60][:200]

    def caught(change):
        texts = []
        for words in some:
            words = list(words)
            for w in rng.choice(INSULTS, 2, replace=False):
                words.insert(rng.integers(len(words) + 1), change(str(w)))
            texts.append(" ".join(words))
        return float(np.mean(model.scores(texts) >= t.THRESHOLD))

    assert len(some) == 200
    assert np.mean(model.scores([" ".join(x) for x in some]) >= t.THRESHOLD) <= 0.02
    assert np.mean(model.scores(clean) >= t.THRESHOLD) <= 0.02
    assert caught(lambda w: w) > 0.97 and caught(lambda w: ".".join(w)) > 0.97 and caught(" ".join) > 0.9
    assert caught(lambda w: inserted(w, 1)) >= 0.9 and caught(lambda w: inserted(w, 2)) >= 0.8


def brute_score(model, text):
    """The score by definition: margins of sentences as sums over words of brute-force kernels, then the curve."""
    margins, over = [], model.bias + 1
    for s in t.sentences(text):
        words = [w for w, before in zip(s, ["", *s], strict=False) if w != before]
        kernels = np.array([[brute_kernel(t.letters(w), x) for x in model.landmarks.words] for w in words])
        margins.append(float((kernels @ model.beta).sum()))
    margins.sort(reverse=True)
    top = model.bias + max(0.0, margins[0] if margins else 0.0)
    second = model.bias + max(0.0, margins[1]) if len(margins) > 1 else top
    rate = sum(max(0.0, m + over) for m in margins or [0.0]) * 20 / max(20, len(text.split()))
    clear = 1 / (1 + np.exp(-t.CLEAR * min(max(top - 0.5, -5), 5)))
    x = np.array([top, clear, second, rate]) @ model.curve[:-1] + model.curve[-1]
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def test_scores_against_brute_force():
    model = t.train(*corpus(400, 8))
    texts, _ = corpus(12, 9)
    texts += ["", "blockhead. blockhead blockhead! ok", "s-c-o-u-n-d-r-e-l x", "n i t w i t"]
    assert np.allclose(model.scores(texts), [brute_score(model, x) for x in texts], atol=1e-4)


def test_landmarks_are_unlike_each_other(learned):
    words = learned[0].landmarks.words
    gram = learned[0].landmarks.kernels(words)
    assert (gram - np.diag(np.diag(gram))).max() < t.ALIKE and {"idiot", "trash", "stupid", "moron", "clown"} <= set(words)


def test_odd_rows(spark):
    texts, labels = corpus(400, 4)
    docs = spark.createDataFrame([(k, x, 9.0) for k, x in enumerate([*texts, None, "", "x" * 100_000, "nitwit " * 5000])] * 2 + [(None, "nitwit", 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(1, None), (None, 1), (2, 7), (99_999, 1)], "doc_id long, toxic int")
    docs = docs.withColumn("_toxicity", F.lit("mine"))
    kept = t.not_toxic(spark, docs, marks)
    assert kept.columns == docs.columns and {r._toxicity for r in kept.select("_toxicity").distinct().collect()} == {"mine"}
    ids = {r.doc_id for r in kept.collect()}
    assert {400, 401, 402} <= ids and 403 not in ids and None not in ids
    nothing = docs.limit(0)
    assert t.not_toxic(spark, nothing, marks).collect() == [] and t.not_toxic(spark, docs, marks.limit(0)).count() == docs.count()
    scored = docs.select(t.toxicity(spark, F.col("text"), t.trained(docs, marks)).alias("s")).collect()
    assert len(scored) == docs.count()


def test_sample_holds_long_documents_whole(spark):
    texts, labels = corpus(80, 6)
    texts[0], texts[1] = "nitwit " * 4000, "anth onti " * 9000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    want = sorted((x, y) for k, (x, y) in enumerate(zip(texts, labels, strict=True)) if zlib.crc32(str(k).encode()) % 4 != 2)
    found, toxic, _ = t.sampled(docs, marks)
    assert max(map(len, found)) > 20_000 and sorted(zip(found, toxic, strict=True)) == want


def test_repeated_labels_and_ids_without_a_text_take_no_places(spark):
    texts, labels = corpus(120, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = [(k, y) for k, y in enumerate(labels)]
    want = t.sampled(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), 20)
    more = [(k, y) for k, y in marks for _ in range(30)] + [(k, k % 2) for k in range(1000, 1400)]
    assert len(want[0]) == 40 and t.sampled(docs, spark.createDataFrame(more, "doc_id long, toxic int"), 20) == want


def test_the_driver_keeps_little_of_what_training_took():
    code = """
import random, re, sys
import pandas as pd
from pyspark.sql import SparkSession
from tessera.llm import toxicity as t

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(4, 9)))
texts = [" ".join([word() for _ in range(300)] + ["you", "moron."] * (k % 2)) for k in range(600)]
t.sampled = lambda docs, labels: (texts, [k % 2 for k in range(600)], None)
before = held()
model = t.trained(None, None)
assert model.landmarks.words
print(held() - before)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(t.__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1"}, check=True)
    assert float(run.stdout) < 40
