import numpy as np
import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, pieces, token_counts

PATH, MODEL = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "\x1c\x1d x", "don't  'S\n\n x\t", "²³1½ ª", "a" * 5000, "一二三 12", "՘a՘", "👨‍👩 ok", "  　x", "é" * 300, "ab " * 2000, "\r\n\x85\x0b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(PATH)


def check(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want and own.count(text) == len(want), text


def test_ids_and_counts_are_the_library_s(own, library):
    for text in TEXTS:
        check(own, library, text)


def test_every_latin_and_punctuation_character(own, library):
    for c in [*range(0x530), *range(0x2000, 0x2070)]:
        check(own, library, f"a{chr(c)}a1{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}a  {chr(c)} \n")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    check(own, library, text)


def test_without_the_proof_the_library_merges(library, monkeypatch):
    monkeypatch.setattr(bpe.ByteBpe, "_ranked", lambda self: None)
    slow = bpe.ByteBpe(PATH)
    for text in TEXTS:
        check(slow, library, text)


def test_whole_tokens_are_one_token(own, library):
    for text in list(own.whole)[::97]:
        assert library.encode(text, add_special_tokens=False).ids == [own.whole[text]]
    assert " the" in own.whole and len(own.whole) > 45_000


def test_a_small_cache_gives_the_same(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    tight = bpe.ByteBpe(PATH, own.whole)
    for text in ["qzx vbnm wrtp lkjh mnbv", "qzx wrtp mnbv lkjh vbnm"]:
        check(tight, library, text)


def test_query_over_odd_rows(spark, library):
    texts = [*TEXTS, None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, *texts])], "doc_id long, text string, n_tokens string")
    got = df.select("doc_id", token_counts.token_count(spark, F.col("text"), PATH).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in [*texts, *texts]]
    assert df.limit(0).select(token_counts.token_count(spark, F.col("text"), PATH)).collect() == []


def test_query_over_the_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in token_counts.op6_token_counts(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len(docs[r.doc_id].encode()), len(library.encode(docs[r.doc_id], add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(MODEL)


def chunked(model, text, size):
    """Encoding by chunks of a given size, as the plan does it."""
    whole, reach, parts = pieces.marked(text), 2 * model.longest, []
    for at in range(0, len(whole), size):
        low = max(0, at - reach)
        parts.append((whole[low : at + size + reach], at - low, min(len(whole), at + size) - low))
    last = len(parts) - 1
    matrices = [pieces.transfer(model, *p, k == 0, k == last) for k, p in enumerate(parts)]
    states, out = pieces.boundary_states(matrices), []
    for k, p in enumerate(parts):
        left, right = pieces._ends(model, *p, k == 0, k == last)
        out += pieces.trace(model, *p, left[states[k]], right[states[k + 1]])
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aabeinrstth   \n日é😀▁"), min_size=1, max_size=150), st.integers(17, 60))
def test_chunks_give_the_library_s_pieces(model, text, size):
    assert chunked(model, text, size) == model.library.encode(text)


@pytest.mark.parametrize("text", ["a" * 3000, "abc" * 1000, " " * 500, "the" * 700 + " " * 40 + "x", "日本" * 300, "\n" * 200])
def test_long_runs(model, text):
    assert chunked(model, text, 100) == model.library.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_words_give_the_library_s_pieces(model, text):
    ids = model.encode(pieces.marked(text))
    assert ids == model.library.encode(text) and model.decode(ids) == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_decoding_any_ids(model, ids):
    assert model.decode(ids) == model.library.decode(ids)


def test_the_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    mats = [np.where(rng.random((3, 3)) < 0.3, -np.inf, rng.standard_normal((3, 3))) for _ in range(9)]
    step = [mats[0]]
    for m in mats[1:]:
        step.append(pieces.product(step[-1], m))
    for a, b in zip(pieces.prefixes(mats), step, strict=True):
        assert np.allclose(np.nan_to_num(a, neginf=-1e9), np.nan_to_num(b, neginf=-1e9))


def test_giant_and_odd_documents(spark, model):
    texts = ["", None, "x", "word " * 9000, "word " * 9000, "q" * 20_000, "▁ a", "ab  c\n" * 6000]
    df = spark.createDataFrame([(7 if k in (3, 4) else k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.chunks, np.frombuffer(r.ids, dtype="<i4").tolist(), r.round_trip) for r in pieces.encoded(df, MODEL).collect())
    want = sorted((7 if k in (3, 4) else k, max(1, -(-(len(t or "") + 1) // pieces.CHUNK)), model.library.encode(t or ""), True) for k, t in enumerate(texts))
    assert got == want
    assert pieces.encoded(df.limit(0), MODEL).collect() == []


def test_pieces_of_the_table(spark, sf_dir):
    import zlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), zlib.crc32(np.array(ids, dtype="<i4").tobytes()))
    rows = pieces.op10_pieces(spark, sf_dir).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.n_pieces, r.ids_crc32) for r in rows} == want and all(r.round_trip for r in rows)


def test_the_driver_loads_no_tokenizer(spark, sf_dir, own, monkeypatch):
    def never(*_):
        raise AssertionError("a tokenizer on the driver")

    from tessera.llm import packing

    monkeypatch.setattr(bpe.ByteBpe, "__init__", never)
    monkeypatch.setattr(bpe, "_PROVED", {})
    assert bpe.proved(spark, PATH) == own.whole
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.length for r in packing.token_pieces(spark, docs, PATH).orderBy("doc_id").collect()] == [3, 1]
