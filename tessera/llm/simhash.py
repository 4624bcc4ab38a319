"""Near duplicates. By SimHash: blocks of equal bits propose pairs, pivot distance tables discard them, bits decide. By
similarity of shingle sets: shared rare shingles propose pairs, sizes and parity sketches discard them, the sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import reach, sized, stored, table, without
from tessera.llm.components import components

BITS, SEED = 64, 42
#: Reference fingerprints of the pivot tables: hashes of 0, 1, 2 ..., spread like fingerprints of unrelated texts.
PIVOTS = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) for k in range(16)], dtype=np.uint64)
#: Rows of one key that a task compares at a time; more are dealt out as tiles.
TILE = 8192
#: Fingerprints that may have a key in common by chance; with more fingerprints keys get wider.
GROUP = 4
#: Shingles whose bits are summed at a time.
STEP = 1 << 14
#: Least share of common shingles in all shingles of two near copies, as a fraction.
ALIKE, OF = 4, 5
#: Bits of a parity sketch, and of the wider one that pairs are held against too: before their sets meet, and, of sets with
#: more than NARROW hashes, for which the other says little, before a pair is named at all.
SKETCH, WIDE, NARROW = 512, 4096, 800
#: Documents sampled to find common shingles, and common shingles that are kept.
SAMPLED, COMMON = 10_000, 100_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """A hash of each run of so many words, repeats included; of all words if there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and white space of ASCII
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(found))
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(found) - size + 1)


def simhash(text: str | None, words: int) -> int:
    """The fingerprint of a text's shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), STEP):
        part = np.unpackbits(hashes[k : k + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :])


def star_links(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each key, what pairs at most radius bits apart connect: not all pairs, but a
    spanning star or tree for each.

    Rows are ordered by key and first pivot distance; the distance of two fingerprints is at least the largest
    difference of their coordinates in the pivot table, so only neighbours within radius in that order are paired, the
    other coordinates discard most of those, and the bits decide the rest."""
    near = pivot_table(prints)
    order = np.lexsort((near[:, 0], keys))
    keys, prints, ids, near = keys[order], prints[order], ids[order], near[order].astype(np.int16)
    root = np.arange(len(keys))
    left = np.arange(len(keys))
    links_a, links_b = [], []
    step = 1
    while len(left):
        left = left[left < len(keys) - step]
        right = left + step
        left = left[(keys[left] == keys[right]) & (near[right, 0] - near[left, 0] <= radius)]
        right = left + step
        live = root[left] != root[right]
        a, b = left[live], right[live]
        kept = np.abs(near[a] - near[b]).max(axis=1, initial=0) <= radius
        a, b = a[kept], b[kept]
        kept = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        a, b = a[kept], b[kept]
        if len(a):
            links_a.append(ids[a])
            links_b.append(ids[b])
            while True:  # the smaller root of each link, until all agree; so that linked rows aren't paired again
                low = np.minimum(root[a], root[b])
                if (low == root[a]).all() and (low == root[b]).all():
                    break
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
        step += 1
    if not links_a:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    return np.concatenate(links_a), np.concatenate(links_b)


def _by_tile(found: Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]]):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by key and tile. The last key of a batch waits for the next; a key in one tile has a bounded number of rows."""
        held: pd.DataFrame | None = None

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            key, tile = pdf.key.to_numpy(), pdf.tile.to_numpy()
            starts = np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
            a, b = found(np.cumsum(starts), pdf)
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf.key == pdf.key.iloc[-1]) & (pdf.tile == pdf.tile.iloc[-1])
            held = pdf[last]
            if not last.all():
                yield done(pdf[~last])
        if held is not None:
            yield done(held)

    return link


def tiles(keyed: DataFrame, by: str) -> DataFrame:
    """keyed(key, ...) with tile, dealt and sorted by key and tile: keys with over TILE rows are cut into parts by the
    column `by`, and each pair of parts is a tile of its own."""
    counts = stored(keyed.groupBy("key").count().where(F.col("count") > TILE), "hot_keys")
    if counts.isEmpty():
        tiled = keyed.withColumn("tile", F.lit(0))
    else:
        parts = counts.select("key", F.ceil(F.col("count") / TILE * 2).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
        tiled = keyed.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, "part") * F.col("parts") + F.greatest(o, "part"))
        tiled = tiled.select(*keyed.columns, F.explode(others).alias("tile"))
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")


def equal_blocks(fingerprints: int, radius: int) -> int:
    """How many blocks make a key: two at least, and so many that a key has about GROUP fingerprints by chance at most."""
    equal = 2
    while fingerprints > GROUP << BITS * equal // (radius + equal) and equal < BITS - radius:
        equal += 1
    return equal


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """prints(print, id): different fingerprints, each with its id. Returns links (a, b) of ids that connect what all
    pairs within radius bits connect.

    A fingerprint is cut into radius + e blocks. Every pair within radius agrees in e whole blocks at least, so it shares one
    of the keys made of e blocks. e grows with the number of fingerprints (`equal_blocks`), so that groups by chance stay
    small. Keys with over TILE fingerprints are cut into parts; each pair of parts is a tile of its own, so that no task gets
    an unbounded group and no pair is lost."""
    equal = equal_blocks(prints.count(), radius)
    blocks = radius + equal
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    masks = [sum(some) for some in combinations(block, equal)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.array(*[F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])
    keyed = prints.select("print", "id", F.explode(key).alias("key"))
    return tiles(keyed, "print").mapInPandas(_by_tile(lambda n, pdf: star_links(n, pdf.print.to_numpy().view(np.uint64), pdf.id.to_numpy(), radius)), "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, radius: int = 6) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over fingerprints at most radius bits apart).

    Null and empty texts have fingerprint zero and link like any other; texts of any length count whole; columns but doc_id
    and text don't count. Rows repeated with one doc_id come out as often.
    Rows with a null doc_id get component_id by the others of their fingerprint. An empty table gives no rows. Copies
    have one fingerprint and count as one node, whatever their number."""
    reach(docs.sparkSession)
    rows = stored(docs.select("doc_id", fingerprint(F.col("text"), words).alias("print")), "prints")
    nodes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    group = components(near_links(nodes.where("id is not null").select("print", "id"), radius))
    low = nodes.join(sized(group.withColumnRenamed("node", "id")), "id", "left").select("print", "n", F.coalesce("component", "id").alias("component_id"))
    low = stored(low, "lowest")
    hot = low.where(F.col("n") > TILE).drop("n")  # at most one in TILE rows; their rows are decided where they lie
    usual = rows.join(sized(hot.select("print")), "print", "left_anti").join(sized(low.where(F.col("n") <= TILE).drop("n")), "print")
    both = usual.unionByName(rows.join(sized(hot), "print"))
    return both.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Different hashes in order; texts without words have one set, which no other text has."""
    found = np.unique(hashes)
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def prefix(found: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first of a set's hashes in an order that all sets share, rare ones first: so many that two near copies have
    one of them in common. times: how often each hash of common (sorted) was seen."""
    size = len(found) - (ALIKE * len(found) + OF - 1) // OF + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, times[at], 0)))]
    return found[:size]


def sketch(found: np.ndarray, places: int = SKETCH) -> np.ndarray:
    """Whether the number of hashes that fall in each of so many places is odd. Two sketches differ in no more bits than
    their sets have hashes that the other lacks."""
    return np.packbits(np.bincount((found % np.uint64(places)).astype(np.int64), minlength=places) & 1).view(np.int64)


def possible_pairs(keys: np.ndarray, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids within each key, in different components, that sizes and sketches leave as possible near copies; each
    once for all the keys at hand."""
    none = np.zeros(0, dtype=np.int64)
    if not len(pdf):
        return none, none
    order = np.lexsort((pdf["size"].to_numpy(), keys))
    keys, size, ids, comp = keys[order], pdf["size"].to_numpy()[order].astype(np.int64), pdf.id.to_numpy()[order], pdf.comp.to_numpy()[order]
    # unsigned, as counts of negative numbers would be those of their absolute values
    bits = np.stack(pdf.sketch.to_numpy())[order].view(np.uint64)
    large = np.flatnonzero(size > NARROW)
    place = np.full(len(size), -1)
    place[large] = np.arange(len(large))
    wide = np.stack(pdf.wide.to_numpy()[order][large]).view(np.uint64) if len(large) else np.zeros((0, 1), dtype=np.uint64)
    left, found = np.arange(len(keys)), [np.zeros((0, 2), dtype=np.int64)]
    step = 1
    while len(left):
        left = left[left < len(keys) - step]
        right = left + step
        left = left[(keys[left] == keys[right]) & (ALIKE * size[right] <= OF * size[left])]  # sizes only grow
        right = left + step
        other = comp[left] != comp[right]
        a, b = left[other], right[other]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        kept = (OF + ALIKE) * apart <= (OF - ALIKE) * (size[a] + size[b])
        a, b = a[kept], b[kept]
        both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
        apart = np.bitwise_count(wide[place[a[both]]] ^ wide[place[b[both]]]).sum(axis=1, dtype=np.int64)
        far = both[(OF + ALIKE) * apart > (OF - ALIKE) * (size[a[both]] + size[b[both]])]
        pairs = np.stack((ids[np.delete(a, far)], ids[np.delete(b, far)]), axis=1)
        found.append(np.sort(pairs, axis=1))
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes seen in two or more of about SAMPLED documents (the most frequent COMMON of them), sorted, and how often.
    They only make the order of prefixes a good one; whatever they are, no pair is lost."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(shingle_hashes(t, words)).view(np.int64) for t in texts])

    every = max(1, docs.count() // SAMPLED)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.explode(hashes("text")).alias("hash"))
    seen = some.groupBy("hash").count().where("count > 1").orderBy(F.desc("count"), "hash").limit(COMMON).toPandas()
    common, times = seen["hash"].to_numpy(dtype=np.int64).view(np.uint64), seen["count"].to_numpy(dtype=np.int64)
    order = np.argsort(common)
    return common[order], times[order]


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) of ids of nodes(id, size, sketch) that sizes and sketches leave as possible near copies."""
    for n in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(n), F.struct("size", "sketch").alias(f"of_{n}")), n)
    bits = F.zip_with("of_a.sketch", "of_b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    sizes, apart = [F.col("of_a.size"), F.col("of_b.size")], F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    pairs = pairs.where(ALIKE * F.greatest(*sizes) <= OF * F.least(*sizes))
    return pairs.where((OF + ALIKE) * apart <= (OF - ALIKE) * (sizes[0] + sizes[1])).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of pairs(a, b) of doc_ids whose sets are alike, by the sets themselves. Only texts in some pair are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            sets = [shingle_set(shingle_hashes(t, words)) for t in pdf.text]
            wide = [sketch(x, WIDE) for x in sets]
            yield pd.DataFrame({"id": pdf.doc_id, "size": [len(x) for x in sets], "sketch": wide, "set": [x.view(np.int64) for x in sets]})

    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair_ids")
    sets = stored(docs.select("doc_id", "text").join(sized(ids), "doc_id").mapInPandas(cut, "id long, size int, sketch array<long>, set array<long>"), "cut")
    pairs = stored(possible(pairs, sets.select("id", "size", "sketch")).distinct(), "possible")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(OF * both >= ALIKE * (F.size("x") + F.size("y") - both))
    return stored(found.select("a", "b"), "verified")


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few hundred rows at a time, so that what is made of them stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            yield pdf.iloc[at : at + 256]


def alike_groups(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over pairs with a Jaccard similarity of ALIKE / OF or more of
    their sets of shingles) for each row of docs(doc_id, text) with a doc_id. Null and empty texts have one set; texts of
    any length count whole; rows repeated with one doc_id come out as often; no documents give no rows; columns but doc_id
    and text don't count.

    Pairs to verify come from SimHash (fingerprints at most radius bits apart, `near_links`), which connects most of a group
    of copies, and, so that no pair is lost, from shared shingles: near copies share one among the rarest few of each
    (`prefix`). A shingle of two texts names its pair at once. For one of more texts a star is verified first; then all pairs
    that are in different components still, less those that sizes and sketches rule out. Shingles with many documents are
    dealt out in tiles. Equal sets count as one node."""
    spark = reach(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    common, times = common_shingles(docs, words)
    sent = spark.sparkContext.broadcast((common, times))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            hashes = [shingle_hashes(t, words) for t in pdf.text]
            sets = [shingle_set(x) for x in hashes]
            yield pd.DataFrame(
                {
                    "id": pdf.doc_id,
                    "size": [len(x) for x in sets],
                    "print": np.array([majority(x) for x in hashes], dtype=np.uint64).view(np.int64),
                    "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                    "sketch": [sketch(x) for x in sets],
                    "wide": [sketch(x, WIDE) if len(x) > NARROW else None for x in sets],
                    "keys": [prefix(x, *sent.value).view(np.int64) for x in sets],
                }
            )

    rows = stored(docs.select("doc_id", "text").mapInPandas(describe, "id long, size int, print long, digest binary, sketch array<long>, wide array<long>, keys array<long>"), "shingled")
    again = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").drop("n"), "equal_sets")
    first = rows.join(sized(again), "digest").where("id = first").drop("first").dropDuplicates(["digest"])
    single = rows.join(sized(again.select("digest")), "digest", "left_anti")
    described = stored(single.unionByName(first.select(*rows.columns)).select("id", "size", "print", "sketch", "wide", "keys"), "sets")
    nodes = described.select("id", "size", "sketch")
    keyed = described.select("id", F.explode("keys").alias("key"))
    seen = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1"), "shared_keys")
    shared = stored(keyed.join(sized(seen.where("n > 2").select("key", "low")), "key").select("key", "id", "low"), "shared")
    stars = shared.where("id <> low").groupBy("id", "low").count().groupBy("id")
    stars = stars.agg(F.array(F.max(F.struct("count", "low")).low, F.min("low"), F.max("low")).alias("lows"))
    stars = stars.select(F.explode(F.array_distinct("lows")).alias("a"), F.col("id").alias("b"))
    copies = described.groupBy("print").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    copies = stored(copies, "prints")
    near = near_links(copies.select("print", "id"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    twins = copies.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    firsts = near.union(twins).union(seen.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))).union(stars).distinct()
    firsts = stored(possible(stored(firsts, "first_pairs"), nodes), "possible")
    links = verified(docs, firsts, words)
    group = components(links)
    placed = shared.join(group, shared.id == group.node, "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    placed = stored(placed, "placed")
    mixed = stored(placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "mixed")
    met = placed.join(sized(mixed), "key").join(described.select("id", "size", "sketch", "wide"), "id").select("key", "id", "comp", "size", "sketch", "wide")
    pairs = tiles(met, "id").mapInPandas(_by_tile(possible_pairs), "a long, b long")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more = verified(docs, pairs.join(firsts, ["a", "b"], "left_anti"), words)
    group = stored(components(links.union(more)), "groups")
    low = group.select(F.col("node").alias("id"), "component")
    to_first = rows.select("id", "digest").join(sized(again), "digest", "left").select("id", F.coalesce("first", "id").alias("node"))
    return to_first.join(sized(low.withColumnRenamed("id", "node")), "node", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id. All columns stay, whatever their names; rows with a null doc_id
    stay; rows repeated with one doc_id go or stay together."""
    groups = stored(alike_groups(docs.select("doc_id", "text"), words), "near_groups")
    return without(docs, groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_groups of documents with four words and four bits; what it does with odd rows is said there."""
    return near_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
