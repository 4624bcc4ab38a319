import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language as g


def letters_of(gram):
    return tuple(int(gram) >> shift & (1 << g.BITS) - 1 for shift in (2 * g.BITS, g.BITS, 0))


def test_counts_of_trigrams_by_hand():
    grams, counts = g.trigram_counts("Ab-ab")
    a, b = ord("a"), ord("b")
    assert {letters_of(n): int(c) for n, c in zip(grams, counts, strict=True)} == {(0, a, b): 2, (a, b, 0): 2, (b, 0, a): 1}
    assert len(g.trigram_counts("")[0]) == len(g.trigram_counts("1 2 !")[0]) == 0


def brute_profile(text):
    """The sum over all places of the product of three rotated letter vectors."""
    codes = [0]
    for x in (text or "").lower():
        c = ord(x) if x.isalpha() else 0
        if c or codes[-1]:
            codes.append(c)
    codes += [0] * (codes[-1] != 0)
    out = np.zeros(g.DIM)
    for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
        if y or (x and z):
            out += np.roll(g.letter_vector(x).astype(float), 2) * np.roll(g.letter_vector(y).astype(float), 1) * g.letter_vector(z)
    return out


def test_long_texts_are_counted_as_short_ones(monkeypatch):
    text = "Ein Text, der über viele Stücke geht. " * 20
    whole = g.trigram_counts(text)
    monkeypatch.setattr(g, "STEP", 7)
    for part, all_ in zip(g.trigram_counts(text), whole, strict=True):
        assert np.array_equal(part, all_)


def test_every_letter_has_a_vector_of_its_own():
    letters = [ord(x) for x in "abzéèßяекпαω日本語"]
    some = np.stack([g.letter_vector(c) for c in letters]).astype(float)
    assert np.abs(some @ some.T / g.DIM - np.eye(len(some))).max() < 0.2
    gram = (letters[0] << 2 * g.BITS) | (letters[8] << g.BITS) | letters[12]
    assert np.array_equal(g.trigram_vector(gram), np.roll(g.letter_vector(letters[0]), 2) * np.roll(g.letter_vector(letters[8]), 1) * g.letter_vector(letters[12]))


def test_profiles_against_brute_force(monkeypatch):
    texts = ["The end. The  END!", "привет, мир", "x", "a1b", "日本語 text " * 30]
    want = [brute_profile(t) for t in texts]
    monkeypatch.setattr(g, "_vectors", g._Vectors)
    assert all(np.allclose(g.profile(t), w) for t, w in zip(texts, want, strict=True))
    monkeypatch.setattr(g, "KNOWN", 8)
    monkeypatch.setattr(g, "AT_ONCE", 5)
    assert all(np.allclose(g.profile(t), w) for t, w in zip(texts, want, strict=True))


def test_query_against_brute_force(spark, sf_dir):
    """Everything is in the sample at this size, so prototypes are sums over all rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    vectors = {d.doc_id: brute_profile(d.text) for d in docs}
    sums = {}
    for d in docs:
        length = np.linalg.norm(vectors[d.doc_id])
        if zlib.crc32(str(d.doc_id).encode()) % 3 != 1 and d.lang and length:
            sums[d.lang] = sums.get(d.lang, 0) + vectors[d.doc_id] / length
    for r in g.op4_language(spark, sf_dir).collect():
        v = vectors[r.doc_id]
        cosines = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in sums.items()} if v.any() else {"und": 0.0}
        best = max(cosines.values())
        assert abs(r.score - max(0.0, best)) < 1e-4 and cosines[r.lang_pred] > best - 1e-4


def test_scripts_share_nothing(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("привет мир как дела", "ru"), ("мир и дела", "ru"), ("здравей свят как си", "bg"), ("свят и сила", "bg"), ("καλημέρα κόσμε", "el"), ("κόσμε καλό", "el"), ("как дела мир", None), ("свят как си", None), ("κόσμε", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = g.prototypes(df)
    got = {r.doc_id: r.p.lang for r in df.select("doc_id", g.predicted_language(spark, F.col("text"), learned).alias("p")).collect()}
    assert [got[k] for k in (6, 7, 8)] == ["ru", "bg", "el"]


def test_many_languages_are_all_learned_or_refused(spark, monkeypatch):
    df = spark.range(600).selectExpr("id as doc_id", "concat('word', conv(id + 1000, 10, 36)) as text", "concat('l', id) as lang")
    assert len(g.prototypes(df)) == 600
    monkeypatch.setattr(g, "LANGUAGES", 500)
    with pytest.raises(ValueError, match="languages"):
        g.prototypes(df)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in g.op4_language(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    right = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert len(right) > 200 and np.mean(right) > 0.98
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())


def test_odd_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the and of with", "en"), ("le la les des", "fr"), (None, "fr"), ("", None), ("12 $", "en"), ("日本語", None), ("the " * 300_000, None), ("les des", None), (None, None)])] * 2
    df = spark.createDataFrame([(i, t, lang, 0.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    learned = g.prototypes(df.select("doc_id", "text", "lang"))
    assert set(learned) == {"en", "fr"}
    got = df.select("doc_id", g.predicted_language(spark, F.col("text"), learned).alias("p")).collect()
    named = {r.doc_id: r.p.lang for r in got}
    assert named[0] == named[6] == "en" and named[1] == named[7] == "fr" and {named[k] for k in (2, 3, 4, 8)} == {"und"} and named[5] in learned
    assert [r.p.score for r in got if r.doc_id in (2, 3, 4, 8)] == [0.0] * 8
    kept = g.known_language(spark, df.withColumn("_language", F.lit("x")), df)
    assert kept.columns == [*df.columns, "_language"] and sorted(r.doc_id for r in kept.collect()) == [0, 0, 1, 1, 6, 6, 7, 7]
    assert {r.doc_id for r in g.known_language(spark, df, df, wanted={"fr"}).collect()} == {1, 7}
    nothing = df.limit(0)
    assert g.prototypes(nothing.select("doc_id", "text", "lang")) == {} and g.known_language(spark, nothing, nothing).collect() == []
    assert {r.p.lang for r in df.select(g.predicted_language(spark, F.col("text"), {}).alias("p")).collect()} == {"und"}


@pytest.mark.parametrize("text", ["a", "é", "ß", "日"])
def test_one_letter_is_enough(text):
    assert g.profile(text) is not None
