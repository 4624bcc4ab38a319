"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fold, reach, stored, table, unused

#: Components of a hypervector, seed of letters' vectors, bits of a code point.
DIM, SEED, BITS = 1024, 7, 21
#: Documents of one language, about, that its prototype is bundled from.
PER_LANGUAGE = 1500
#: Languages that may be learned, far more than there are; over that, `lang` doesn't hold languages, which is an error.
#: A prototype takes 4 KB, so this bounds what the driver gathers and workers hold.
LANGUAGES = 20_000
UNKNOWN = "und"
#: A unit profile's components are summed as whole multiples of this, so that no order of sums matters.
UNIT = 2.0**-40
#: Trigrams whose vectors a worker remembers, trigrams bundled and characters counted at a time.
KNOWN, AT_ONCE, STEP = 16_384, 2048, 1 << 20
#: Cosine that a text must have with some prototype to be in a known language: two standard deviations of chance.
CHANCE = 2 / DIM**0.5


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(20_000)
def letter_vector(c: int) -> np.ndarray:
    """The random vector of -1 and 1 of a letter, by its code point; 0 is the boundary of words."""
    return np.random.default_rng([SEED, c]).choice(np.array([-1, 1], dtype=np.int8), DIM)


def trigram_vector(gram: int) -> np.ndarray:
    """A trigram's hypervector: its letters' vectors, rotated two, one and no places, multiplied."""
    letters = [letter_vector(gram >> shift & (1 << BITS) - 1) for shift in (2 * BITS, BITS, 0)]
    return np.roll(letters[0], 2) * np.roll(letters[1], 1) * letters[2]


class _Vectors:
    """Vectors of trigrams met, each made once; forgotten when there are too many."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.empty((KNOWN, DIM), dtype=np.int8)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(DIM, dtype=np.float32)
        for at in range(0, len(grams), AT_ONCE):
            some = grams[at : at + AT_ONCE].tolist()
            if len(self.place) + len(some) > KNOWN:
                self.place.clear()
            places = []
            for g in some:
                k = self.place.get(g)
                if k is None:
                    k = self.place[g] = len(self.place)
                    self.rows[k] = trigram_vector(g)
                places.append(k)
            out += counts[at : at + AT_ONCE] @ self.rows[places].astype(np.float32)
        return out


@lru_cache(1)
def _vectors() -> _Vectors:
    return _Vectors()


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of lower-case letters that occur, as three code points in one number, and how often; runs of other
    characters are one boundary. Both empty without a letter."""
    is_letter, tail, parts = _is_letter(), np.zeros(1, dtype=np.int64), []
    data = text.lower().encode("utf-32-le", "surrogatepass")
    for at in range(0, len(data), 4 * STEP):
        found = np.frombuffer(data, dtype="<u4", count=min(STEP, (len(data) - at) // 4), offset=at).astype(np.int64)
        found = np.concatenate((tail, np.where(is_letter[found], found, 0)))
        if at + 4 * STEP >= len(data):
            found = np.concatenate((found, [0]))
        found = found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]
        grams = (found[:-2] << 2 * BITS) | (found[1:-1] << BITS) | found[2:]
        parts.append(np.unique(grams[(found[1:-1] != 0) | (found[:-2] != 0) & (found[2:] != 0)], return_counts=True))
        tail = found[-2:]
    if not parts:
        return np.array([], dtype=np.int64), np.array([], dtype=np.float32)
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.float32)


def profile(text: str | None) -> np.ndarray | None:
    """The bundle of a text's trigrams; None without a letter."""
    grams, counts = trigram_counts(text or "")
    return _vectors().bundle(grams, counts) if len(grams) else None


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Each language's prototype: the bundle of the unit profiles of about per_language of docs(doc_id, text, lang): those
    whose id has a hash in the share per_language / count of all hashes; all, if there are fewer. Rows without a language,
    an id or a letter don't count; repeated rows count each. Bundles are added up where they lie, by language and
    component, and one vector a language reaches the driver. No documents give no prototypes."""
    reach(docs.sparkSession)
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    common = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if common.count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values, which can't be languages")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("n") < F.lit(per_language << 20)
    chosen = known.join(F.broadcast(common), "lang").where(share)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text, strict=True):
                if (vector := profile(text)) is not None and (length := float(np.linalg.norm(vector.astype(np.float64)))):
                    sums[lang] = sums.get(lang, 0) + np.rint(vector.astype(np.float64) / length / UNIT).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})

    parts = chosen.select("lang", "text").mapInPandas(bundle, "lang string, bundle array<long>")
    added = parts.select("lang", F.posexplode("bundle").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x.v).alias("bundle"))
    sums = {r.lang: np.array(r.bundle, dtype=np.float64) for r in rows.toLocalIterator()}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items()) if v.any()}


def predicted_language(spark: SparkSession, text: Column, learned: dict[str, np.ndarray]) -> Column:
    """A struct lang, score: the language whose prototype has the largest cosine with the text's profile (ties: the first
    by name) and that cosine, at least 0; `und` and 0 for texts that are null, have no letter, or if nothing was learned."""
    reach(spark)
    names = list(learned)
    sent = spark.sparkContext.broadcast(np.array([learned[n] for n in names], dtype=np.float32))

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for text in texts:
            vector = profile(text) if names else None
            lang, score = UNKNOWN, 0.0
            if vector is not None:
                cosines = sent.value @ vector / max(1e-9, float(np.linalg.norm(vector)))
                best = int(np.argmax(cosines))
                lang, score = names[best], float(min(1.0, max(0.0, cosines[best])))
            langs.append(lang)
            scores.append(score)
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict(text)


def learned_from(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents that aren't held out (crc32 of doc_id modulo 3 other than 1)."""
    return prototypes(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), 3) != 1))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, held_out, lang_pred, score. Null texts and those without a letter are `und`; texts of any
    length count whole; repeated rows give repeated rows; no documents give none; other columns don't count."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), predicted_language(spark, F.col("text"), learned_from(docs)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def known_language(spark: SparkSession, docs: DataFrame, train: DataFrame, wanted: Collection[str] | None = None, least: float = CHANCE) -> DataFrame:
    """docs whose text is predicted to be in a language (in one of those wanted, if given) with a cosine of at least
    `least`: texts without a letter go, and those that are no nearer to any language than chance. All columns stay,
    whatever their names. If nothing could be learned, letters alone decide."""
    learned = learned_from(train)
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = unused(docs, "_language")
    found = docs.withColumn(name, predicted_language(spark, F.col("text"), learned))
    kept = (F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)
    if wanted is not None:
        kept &= F.col(f"{name}.lang").isin(sorted(wanted))
    return found.where(kept).drop(name)
