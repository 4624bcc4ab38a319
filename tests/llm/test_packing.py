import random
import zlib

import numpy as np
import public_tokenizers as files
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as p

PATH = files.path("byte_bpe_50k.json")


def check(rows, texts, capacity=2048):
    """rows of a packing hold exactly the pieces of texts (doc_id, text), gapless, in sequences within capacity."""
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(w[3] for w in want) // capacity)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(p.op7_packing(spark, sf_dir).collect(), docs)
    assert used <= least + 1


def test_odd_documents(spark):
    texts = [(1, ""), (2, None), (3, "a<|endoftext|>b"), (3, "a<|endoftext|>b"), (4, "word " * 5000), (5, "x" * 30_000), (6, " ".join(map(str, range(1023))))]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, piece string")
    check(p.pack(p.token_pieces(spark, df, PATH)).collect(), texts)
    assert p.pack(p.token_pieces(spark, df.limit(0), PATH)).collect() == []


@pytest.mark.parametrize("lengths", ["any", "large", "equal"])
def test_levels_of_shards(spark, monkeypatch, lengths):
    monkeypatch.setattr(p, "SHARD", 60)
    rng = random.Random(4)
    sizes = [{"any": rng.randint(1, 2048), "large": rng.randint(1100, 2047), "equal": 1024}[lengths] for _ in range(400)]
    df = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = p.pack(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    down = p.best_fit(sorted(range(400), key=lambda k: -sizes[k]), sizes, 2048)
    assert len(fill) <= len(down.items) * 1.04 + 1  # many small shards; half of each level's pieces at most move on


def test_crossover_keeps_every_document_once():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(80)]
        order = list(range(80))
        people = []
        for _ in range(2):
            rng.shuffle(order)
            people.append(p.best_fit(order, sizes, 100))
        child = p.crossover(*people, sizes, rng)
        assert sorted(i for b in child.items for i in b) == list(range(80))
        assert all(child.free[b] == 100 - sum(sizes[i] for i in items) >= 0 for b, items in enumerate(child.items))


def test_evolution_never_loses_to_its_elite():
    rng = random.Random(8)
    sizes = [rng.randint(200, 1500) for _ in range(150)]
    start = p.best_fit(sorted(range(150), key=lambda k: -sizes[k]), sizes, 2048)
    end, _ = p.evolve(sizes, [start.items], 2048, rng)
    assert p.fitness(end) >= p.fitness(start) and sorted(i for b in end.items for i in b) == list(range(150))
    assert len(p.evolve([1024] * 4, [], 2048, rng)[0].items) == 2


@pytest.mark.parametrize("low, high, saved", [(500, 1100, 40), (600, 1400, 1), (20, 600, 1)])
def test_crossovers_save_bins_beyond_best_fit(low, high, saved):
    rng = random.Random(3)
    sizes = [rng.randint(low, high) for _ in range(4096)]
    plain = len(p.best_fit(sorted(range(4096), key=lambda k: -sizes[k]), sizes, 2048).items)
    first, begun = p.evolve(sizes, [], 2048, random.Random(1))
    end, more = p.evolve(sizes, [first.items], 2048, random.Random(2), ordered=True)
    assert begun + more > 0 and len(end.items) <= plain - saved and len(end.items) >= p.fewest(sizes, 2048)
    assert sorted(i for b in end.items for i in b) == list(range(4096))
    assert all(f == 2048 - sum(sizes[i] for i in b) >= 0 for f, b in zip(end.free, end.items, strict=True))


def test_fewest_is_a_lower_bound():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        least = fewest_by_trying(sizes, 20)
        assert -(-sum(sizes) // 20) <= p.fewest(sizes, 20) <= least
    assert p.fewest([11] * 7, 20) == 7 and p.fewest([11, 9] * 3, 20) == 3


def fewest_by_trying(sizes, capacity):
    best = len(sizes)

    def put(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for b in range(len(free)):
            if free[b] >= sizes[k]:
                put(k + 1, [*free[:b], free[b] - sizes[k], *free[b + 1 :]])
        put(k + 1, [*free, capacity - sizes[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("doc_id", [7, None])
def test_one_repeated_id_is_dealt_by_row(spark, monkeypatch, doc_id):
    """20,000 pieces of one document id, or without one, meet in groups of at most SHARD."""
    sizes = [1 + 37 * k % 1500 for k in range(20_000)]
    df = spark.createDataFrame([(doc_id, 0, 0, n, 0) for n in sizes], "doc_id long, piece int, start long, length long, ids_crc32 long")
    monkeypatch.setattr(p, "EPOCHS", 1)
    monkeypatch.setattr(p, "CHILDREN", 5)
    settle = p._settle

    def watched(*given):
        run = settle(*given)

        def checked(key, pdf):
            if len(pdf) > p.ISLANDS * p.SHARD:
                raise ValueError(f"a group of {len(pdf)} rows")
            return run(key, pdf)

        return checked

    monkeypatch.setattr(p, "_settle", watched)
    rows = p.pack(df).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sorted(r.length for r in rows) == sorted(sizes) and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(sizes) // 2048) * 1.01
