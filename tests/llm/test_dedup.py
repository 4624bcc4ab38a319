import re
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exact_dedup as e
from tessera.llm import simhash as s
from tessera.llm.components import components

DOCS = "doc_id long, text string, group_size string"


def test_exact_query(same_as_duckdb):
    same_as_duckdb(e.op8_exact_dedup, e.OP8_SQL)


def brute_exact(rows):
    """keep_id, group_size of each text's group."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_exact_groups_with_hot_and_odd_rows(spark):
    rows = [(k, "hot text") for k in range(300)] + [(1000, "hot  text\n"), (1001, "hot  text"), (1002, ""), (1003, None), (1004, " \t"), (5, "hot text"), (2000, "é"), (2001, "é ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    got = e.exact_groups(df).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        for r in by_id[doc_id]:
            assert (r.keep_id, r.group_size, r.text_sha256) == (*want[bare], sha256(bare.encode()).hexdigest())
    assert sum(r.kept for r in got) == len(want) and {r.doc_id for r in got if r.kept} == {v[0] for v in want.values()}
    assert e.exact_groups(df.limit(0)).collect() == []


def test_exact_keep_one(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (1, "a b", "q"), (2, "ab", "r"), (1, "x", "s"), (3, "c", "t"), (3, "c", "u"), (None, None, "v"), (4, "", "w")], DOCS)
    kept = sorted((r.doc_id or 0, r.text or "") for r in e.keep_one(df).collect())
    assert kept == [(0, ""), (1, "a b"), (1, "x"), (3, "c"), (4, "")]
    assert e.keep_one(df).columns == df.columns


def brute_simhash(text, words):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abÀÉß \n\t\x0b Z"), max_size=60), st.integers(1, 5))
def test_fingerprint(text, words):
    assert s.simhash(text, words) == brute_simhash(text, words)


def test_fingerprint_of_long_and_odd_texts(monkeypatch):
    assert s.simhash(None, 4) == s.simhash(" \n", 4) == 0
    long = " ".join(str(k % 977) for k in range(3000))
    monkeypatch.setattr(s, "STEP", 100)
    assert s.simhash(long, 4) == brute_simhash(long, 4)


def brute_groups(prints, radius):
    """Smallest id that each id reaches."""
    ids = sorted(prints)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if low[j] < low[i] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    low[i], changed = low[j], True
    return low


def test_links_connect_what_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(25)], dtype=np.uint64)
    prints = np.unique(prints)
    ids = np.arange(len(prints))
    a, b = s.star_links(np.zeros(len(prints), dtype=int), prints, ids, 4)
    low = {int(i): int(i) for i in ids}
    for _ in ids:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            low[x] = low[y] = min(low[x], low[y])
    assert low == brute_groups(dict(zip(ids.tolist(), map(int, prints), strict=True)), 4)
    assert len(a) < 10 * len(prints)
    far = np.abs(s.pivot_table(prints)[:, None, :].astype(int) - s.pivot_table(prints)[None]).max(axis=2)
    assert (far <= np.bitwise_count(prints[:, None] ^ prints[None])).all()


def test_keys_widen_with_the_number_of_fingerprints():
    assert [s.equal_blocks(n, 4) for n in (0, 10**5, 10**7, 10**9, 10**11)] == [2, 2, 3, 4, 5]
    assert s.equal_blocks(10**30, 4) < 64


@pytest.mark.parametrize("radius, tile, group", [(4, 8192, 4), (6, 8192, 4), (4, 8, 4), (4, 8192, 0)])
def test_near_links_lose_no_link(spark, monkeypatch, radius, tile, group):
    monkeypatch.setattr(s, "TILE", tile)
    if not group:
        monkeypatch.setattr(s, "equal_blocks", lambda n, r: 4)
    rng = np.random.default_rng(radius)
    prints = {}
    for g in range(12):
        base = int(rng.integers(0, 2**63)) * 2 + g % 2
        for _ in range(10):
            prints[len(prints)] = base ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 2), replace=False))
    unique = {v: k for k, v in reversed(prints.items())}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for v, k in unique.items()], "print long, id long")
    found = {r.node: r.component for r in components(s.near_links(df, radius)).collect()}
    want = brute_groups({k: v for v, k in unique.items()}, radius)
    assert {k: found.get(k, k) for k in want} == want


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 300)] + [(5, 5), (300, 7), (7, 300), (900, 800)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(100, 141)) and all(found[k] == 7 for k in range(200, 301)) and found[900] == found[800] == 800 and 5 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_groups_of_documents(spark):
    words = [f"w{k}" for k in range(400)]
    edited = words[:200] + ["other"] + words[201:]
    texts = [(9, " ".join(words)), (3, " ".join(words).upper()), (4, " ".join(edited)), (5, "quite another text of some words"), (6, ""), (7, None), (8, " \n"), (8, " \n")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)
    got = s.near_groups(df, 4, 4).collect()
    prints = {i: brute_simhash(t, 4) for i, t in texts}
    want = brute_groups(prints, 4)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i, _ in texts)
    assert s.near_groups(df.limit(0)).collect() == []
    kept = s.keep_one(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()}) == [3, 5, 6]


def test_rows_of_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(s, "TILE", 50)
    texts = ["one text of many rows"] * 400 + [""] * 300 + [f"text number {k} of its own" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_groups(df, 4, 0).collect()}
    prints = {k: brute_simhash(x, 4) for k, x in enumerate(texts)}
    first = {}
    for k, x in prints.items():
        first.setdefault(x, k)
    assert got == {k: (f"{x:016x}", first[x]) for k, x in prints.items()}


def test_near_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_simhash(t, 4) for i, t in docs.items()}
    want = brute_groups(prints, 4)
    got = s.op9_simhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i in docs)


def brute_shingles(text, words=5):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))}


def brute_alike(docs, least=0.8):
    """Smallest id that each id reaches over pairs with that Jaccard similarity."""
    sets = {i: brute_shingles(x) for i, x in docs.items()}
    low = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("tile, common", [(8192, 100_000), (4, 100_000), (8192, 0)])
def test_near_copies_from_eight_to_nine_tenths_go(spark, monkeypatch, tile, common):
    monkeypatch.setattr(s, "TILE", tile)
    monkeypatch.setattr(s, "COMMON", common)
    rng = np.random.default_rng(8)
    passage, docs = [f"common{k}" for k in range(60)], {}
    for base in range(30):
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)] + passage * (base % 3 == 0)
        docs[len(docs)] = " ".join(words)
        for edits in (3, 4, 5, 6, 8):  # the similarity of the last is under 0.8
            other = list(words)
            for k in range(edits):
                other[15 + k * 20] = f"new{rng.integers(10**6)}"
            docs[len(docs)] = " ".join(other)
    sets = {i: brute_shingles(x) for i, x in docs.items()}
    shares = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(0, len(docs), 6) for j in range(i + 1, i + 5)]
    far = [(s.simhash(docs[i], 5) ^ s.simhash(docs[j], 5)).bit_count() for i in range(0, len(docs), 6) for j in range(i + 1, i + 5)]
    assert sum(0.8 <= x < 0.9 for x in shares) > 60 and sum(x >= 0.8 and n > 6 for x, n in zip(shares, far, strict=True)) > 10
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], DOCS)
    want = brute_alike(docs)
    assert {r.doc_id: r.component_id for r in s.alike_groups(df).collect()} == want
    assert sorted(r.doc_id for r in s.keep_one(df).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("size", [150, 1500])
def test_possible_pairs_keep_every_near_copy(size):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[: size - n], rng.integers(0, 2**64, n, dtype=np.uint64)))) for n in (size * k // 150 for k in (0, 4, 8, 12, 15, 16, 40))]
    wide = [s.sketch(x, s.WIDE) if len(x) > s.NARROW else None for x in sets]
    pdf = pd.DataFrame({"id": range(len(sets)), "comp": range(len(sets)), "size": [len(x) for x in sets], "sketch": [s.sketch(x) for x in sets], "wide": wide})
    a, b = s.possible_pairs(np.zeros(len(sets), dtype=int), pdf)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    alike = {(min(p), max(p)) for p in alike}
    assert len(alike) > 300 and alike <= found and len(found) < 2000 and len(a) == len(found)
    assert s.possible_pairs(np.zeros(0, dtype=int), pdf.head(0))[0].tolist() == []


def test_few_bits_without_common_shingles_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: brute_shingles(x) for i, x in texts.items()}
    got = {r.doc_id: r.component_id for r in s.alike_groups(docs).collect()}
    want = {i: i for i in sets}
    where = {}
    for i, found in sets.items():
        for x in found:
            where.setdefault(x, set()).add(i)
    pairs = {(i, j) for found in where.values() for i in found for j in found if i < j}
    pairs = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(50):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(got.values())) < len(got)
