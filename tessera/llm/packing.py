"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import reach, stored, table

CAPACITY = 2048
#: Pieces that one population packs, and the share of it that is dealt, so that chance doesn't go beyond it; populations of
#: the same pieces (islands); times that elites migrate.
SHARD, DEALT, ISLANDS, EPOCHS = 4096, 0.9, 2, 2
#: Parents; children of an epoch, at most, and how many in a row may save no bin.
POPULATION, CHILDREN, PATIENCE = 4, 200, 30
#: Largest shares of the giver's well-filled bins that a child gets, and of its own emptiest bins that are dissolved.
INJECTED, DISSOLVED = 0.3, 0.1
#: A bin with at most this share of room left is final, as are the fuller bins with half of a shard's pieces; the pieces of
#: others move on to a merged shard.
ROOM = 0.004


def token_pieces(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document is its ids by the tokenizer of the file at path, then the id end; null is as empty, so each document has at
    least one id. If longer than capacity it is cut so that all pieces but the first have capacity ids."""
    whole = reach(spark).sparkContext.broadcast(bpe.proved(spark, path))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.loaded(path, whole.value)
        for pdf in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(pdf.doc_id.astype(object), pdf.text, strict=True):
                ids = encoder.encode(text) if text else []
                ids.append(end)
                data = memoryview(np.array(ids, dtype="<u4").tobytes())
                first = (len(ids) - 1) % capacity + 1
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if k == 0 else stop - capacity
                    for name, value in zip(rows, (doc_id, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True):
                        rows[name].append(value)
            yield pd.DataFrame(rows).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins under construction; room[r] has the bins with r free, mask has bit r where there are any."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.mask = capacity, [], [], 0
        self.room: dict[int, list[int]] = {}

    def file(self, b: int, free: int) -> None:
        self.free[b] = free
        self.room.setdefault(free, []).append(b)
        self.mask |= 1 << free

    def add_bin(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self.file(len(self.items) - 1, free)

    def best_fit(self, item: int, size: int) -> None:
        """Into the bin that it leaves least room in, else a new one."""
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        held = self.room[free]
        b = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        self.items[b].append(item)
        self.file(b, free - size)


def fitness(bins: Bins) -> float:
    """Mean squared fill: fewer and fuller bins score higher."""
    return sum((1 - f / bins.capacity) ** 2 for f in bins.free) / max(1, len(bins.items))


def fewest(sizes: list[int], capacity: int) -> int:
    """Bins that no packing can do without: the total, or, for any k, a bin for each item over half the capacity and what the
    items from k up to that need beyond the room beside those of at most capacity - k."""
    held = np.sort(np.array(sizes, dtype=np.int64))
    sums = np.concatenate(([0], np.cumsum(held)))
    k = np.arange(1, capacity // 2 + 1)
    small, half, large = np.searchsorted(held, k), np.searchsorted(held, capacity // 2, side="right"), np.searchsorted(held, capacity - k, side="right")
    rest = sums[half] - sums[np.minimum(small, half)] - ((large - half) * capacity - (sums[large] - sums[half]))
    need = len(held) - half + np.maximum(0, -(-rest // capacity))
    return int(max(-(-sums[-1] // capacity), need.max(initial=0)))


def best_fit(order: list[int], sizes: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for item in order:
        bins.best_fit(item, sizes[item])
    return bins


def exchange(bins: Bins, displaced: list[int], sizes: list[int], rng: random.Random) -> list[int]:
    """Each bin with room, in random order, trades one item for the displaced one that fills it best, if any does. Returns
    the items displaced then, shortest first: shorter ones, which fit more easily."""
    order = sorted(displaced, key=sizes.__getitem__)
    lengths = [sizes[i] for i in order]
    open_bins = [b for b, f in enumerate(bins.free) if f]
    rng.shuffle(open_bins)
    for b in open_bins:
        room, items, gain = bins.free[b], bins.items[b], 0
        for k, item in enumerate(items):
            at = bisect_right(lengths, sizes[item] + room) - 1
            if at >= 0 and lengths[at] - sizes[item] > gain:
                gain, given, taken = lengths[at] - sizes[item], k, at
                if gain == room:
                    break
        if gain:
            item, items[given] = items[given], order.pop(taken)
            del lengths[taken]
            at = bisect_right(lengths, sizes[item])
            order.insert(at, item)
            lengths.insert(at, sizes[item])
            bins.free[b] = room - gain
    return order


def crossover(giver: Bins, taker: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Whole well-filled bins of giver go into taker; taker's bins that hold a copy of their documents are dissolved, and
    some of its emptiest. The documents so displaced trade places with shorter ones, and those left are put back by best
    fit, longest first."""
    full = sorted(range(len(giver.items)), key=giver.free.__getitem__)
    full = full[: max(1, len(full) // 2)]
    injected = rng.sample(full, max(1, int(len(full) * rng.uniform(0, INJECTED))))
    taken = {i for b in injected for i in giver.items[b]}
    own, displaced = [], []
    for b in sorted(range(len(taker.items)), key=taker.free.__getitem__):
        if taken.isdisjoint(taker.items[b]):
            own.append(b)
        else:
            displaced += [i for i in taker.items[b] if i not in taken]
    kept = max(0, len(own) - max(1, int(len(own) * rng.uniform(0, DISSOLVED))))
    displaced += [i for b in own[kept:] for i in taker.items[b]]
    child = Bins(giver.capacity)
    child.items = [list(p.items[b]) for p, some in ((giver, injected), (taker, own[:kept])) for b in some]
    child.free = [p.free[b] for p, some in ((giver, injected), (taker, own[:kept])) for b in some]
    left = exchange(child, displaced, sizes, rng)
    for b, free in enumerate(child.free):
        child.file(b, free)
    for item in reversed(left):
        child.best_fit(item, sizes[item])
    return child


def founder(sizes: list[int], capacity: int, rng: random.Random, spread: float | None) -> Bins:
    """A best-fit packing in random order, or, with a spread, longest first but for errors of lengths up to that share."""
    order = list(range(len(sizes)))
    if spread is None:
        rng.shuffle(order)
    else:
        seen = [s * rng.uniform(1 - spread, 1 + spread) for s in sizes]
        order.sort(key=seen.__getitem__, reverse=True)
    return best_fit(order, sizes, capacity)


def evolve(sizes: list[int], seeds: list[list[list[int]]], capacity: int, rng: random.Random, ordered: bool = False) -> tuple[Bins, int]:
    """The best packing of one island after an epoch, and the crossovers that it took. The population are elites that came
    in and founders: in random order, or (ordered) more or less longest first. It ends where no packing can have fewer bins,
    or after PATIENCE children in a row that saved none."""
    least = fewest(sizes, capacity)
    people = []
    for seed in seeds:
        people.append(Bins(capacity))
        for items in seed:
            people[-1].add_bin(items, capacity - sum(sizes[i] for i in items))
    while len(people) < POPULATION:
        people.append(founder(sizes, capacity, rng, 0.2 * (len(people) + 1) / POPULATION if ordered else None))
    scores, crossovers, idle = [fitness(p) for p in people], 0, 0
    best = min(len(p.items) for p in people)
    while best > least and idle < PATIENCE and crossovers < CHILDREN:
        giver, taker = rng.sample(people, 2)
        people.append(crossover(giver, taker, sizes, rng))
        scores.append(fitness(people[-1]))
        crossovers, idle = crossovers + 1, idle + 1
        if len(people[-1].items) < best:
            best, idle = len(people[-1].items), 0
        worst = min(range(len(people)), key=lambda k: (-len(people[k].items), scores[k]))
        del people[worst], scores[worst]
    return max(people, key=lambda p: (-len(p.items), fitness(p))), crossovers


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The island's pieces, once for each elite that came in (origin; none at first)."""
        shard, island = key
        pdf = pdf.sort_values(["origin", *_COLUMNS], ignore_index=True)
        first = pdf[pdf.origin == pdf.origin.iloc[0]]
        sizes, seeds = first.length.tolist(), []
        if epoch:
            for _, elite in pdf.groupby("origin"):
                seeds.append([g.tolist() for _, g in pd.Series(range(len(elite))).groupby(elite.bin.to_numpy())])
        best, _ = evolve(sizes, seeds, capacity, random.Random(f"{shard} {island} {epoch}"), ordered=island % 2 == 1)
        bins = np.empty(len(sizes), dtype=np.int64)
        for b, items in enumerate(best.items):
            bins[items] = b
        score = -len(best.items) + fitness(best)
        return first.assign(shard=shard, island=island, bin=bins, score=score)[["shard", "island", "bin", "score", *_COLUMNS]]

    return run


def _settle(capacity: int, level: int, room: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The best island's bins as sequences. Those with little room left are final, and the fuller ones up to half of the
        pieces; so at most half move on, and always the emptiest bin if it has room."""
        best = pdf.sort_values(["score", "island"], ascending=[False, True]).island.iloc[0]
        pdf = pdf[pdf.island == best].sort_values(["bin", *_COLUMNS], ignore_index=True)
        by_bin = pdf.groupby("bin").length.agg(["sum", "size"]).sort_values(["sum", "size"], kind="stable")
        moved = (by_bin["sum"] < capacity - room) & ((by_bin["size"].cumsum() <= len(pdf) // 2) | (np.arange(len(by_bin)) == 0))
        return pdf[_COLUMNS].assign(
            sequence_id=2 * (((level << 57) | (int(key[0]) << 14)) + pdf["bin"]) + 1,
            offset=pdf.groupby("bin").length.cumsum() - pdf.length,
            final=~moved.reindex(pdf["bin"]).to_numpy(),
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces of token_pieces, plus sequence_id and offset; other columns are left out.

    Pieces of full length are sequences by themselves. The rest is dealt, by the number of its row and not by any value, into
    shards of at most SHARD pieces; each shard has ISLANDS populations, and after each epoch the elite of an island migrates
    to the next one. Bins of a shard's best packing that are as good as full are final, as are its fuller bins with half of
    the pieces; the pieces of its other bins meet those of other shards in a next level, half the size at most, until one
    shard is left. Pieces are rows of their own and never joined by doc_id, so repeated rows and ids, and rows with a null
    id, are packed as often as they come. No documents give no rows; ties of lengths go by the order of columns."""
    reach(pieces.sparkSession)
    pieces = stored(pieces.select(*_COLUMNS, F.monotonically_increasing_id().alias("row")), "pieces")
    full = pieces.where(F.col("length") == capacity).select(*_COLUMNS, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, level = [full], pieces.where(F.col("length") < capacity), 0
    left = rest.count()
    while left:
        shards = -(-left // int(SHARD * DEALT)) if left > SHARD else 1
        shard = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards))
        state = rest.select(*_COLUMNS, shard.alias("shard"), F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("origin"))
        state = state.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
        for epoch in range(EPOCHS):
            elites = state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), f"shard long, island int, bin long, score double, {_ITEM}")
            to = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS))))
            state = elites.select(*_COLUMNS, "shard", "bin", F.col("island").alias("origin"), to.alias("island"))
        settled = elites.groupBy("shard").applyInPandas(_settle(capacity, level, int(capacity * ROOM)), f"{_ITEM}, sequence_id long, offset long, final boolean")
        settled = stored(settled.withColumn("row", F.monotonically_increasing_id()), f"level{level}")
        open_bins = settled.where("not final")
        left, level = open_bins.count() if shards > 1 else 0, level + 1
        done.append((settled.where("final") if left else settled).drop("final", "row"))
        rest = open_bins.select(*_COLUMNS, "row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most CAPACITY tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null texts are as empty; texts of any length are cut as token_pieces says; repeated rows give repeated pieces; an empty
    table gives no rows; columns but doc_id and text don't count."""
    import public_tokenizers

    return pack(token_pieces(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
