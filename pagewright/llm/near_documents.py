"""One document of each group of near copies: shards, BK-trees over SimHash in each, exact similarity for links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .components import connected_components
from .shared import by_batch, stored
from .simhash import shingle_hashes, simhash

#: Min-hashes of a document, and how many of them make a shard key; BANDS keys use them in turn.
#: Documents at similarity 0.8 share at least one of 8 keys of 3 with 99.7 percent chance.
HASHES, BAND, BANDS = 64, 3, 8
#: Fingerprints of five-word shingles at similarity 0.8 differ by 9.7 +- 2.9 bits.
RADIUS = 18
#: Share of equal min-hashes from which a link is looked at exactly (0.8 less two and a half deviations).
LEAST_EQUAL = 0.68
#: Shards of more rows are cut into parts of about so many, each with a tree of its own.
SHARD_ROWS = 1_024
#: Shingles a part of a shard is meant to hold when it is searched again.
PART_SHINGLES = 1_000_000
#: Odd multipliers that turn one shingle hash into HASHES of them.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(k), 42) | 1 for k in range(HASHES)], np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each multiplied hash; a text without words has zeros."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at:at + 4096] * MULTIPLIERS[:, None]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    return least if len(hashes) else np.zeros(HASHES, np.uint64)


def text_node() -> Column:
    """The number that stands for a text: equal texts have the same."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, fp, signature, keys) of each row."""
    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("fp", "signature", "keys")}
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(text, words)
            least = min_hashes(hashes)
            keys = [xxhash.xxh64_intdigest(least[k * BAND:(k + 1) * BAND].tobytes(), k) >> 1 for k in range(BANDS)]
            out["fp"].append(simhash(hashes))
            out["signature"].append(least.astype(np.uint8).tobytes())
            out["keys"].append(keys)
        return {"doc_id": batch.column(0), "node": batch.column(1), **out}

    return by_batch(docs.select(F.col("doc_id").cast("long"), text_node().alias("node"), "text"), work,
                    "doc_id long, node long, fp long, signature binary, keys array<long>")


def similar_in_shard(nodes: np.ndarray, prints: np.ndarray, signatures: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, node) of a shard that connect what looks similar: at most one per row and group.

    A row searches the tree of those before it, only along edges within the radius, and is linked to each group that
    holds a row with enough equal min-hashes, the most equal first. The links are not verified yet: what a link that
    fails was to connect is for :func:`joining_links`.
    """
    tree, over, found = BKTree(), list(range(len(nodes))), []

    def top(i: int) -> int:
        while over[i] != i:
            over[i] = over[over[i]]
            i = over[i]
        return i

    for i, fp in enumerate(prints.astype(np.uint64).tolist()):
        near = np.array(tree.near(fp, RADIUS), np.int64)
        if len(near):
            equal = (signatures[near] == signatures[i]).mean(axis=1)
            for j in near[np.argsort(-equal, kind="stable")][: int((equal >= LEAST_EQUAL).sum())].tolist():
                if (a := top(i)) != (b := top(j)):
                    over[a] = b
                    found.append((int(nodes[i]), int(nodes[j])))
        tree.add(fp)
    return found


def joining_links(nodes: np.ndarray, roots: np.ndarray, hashes: pa.ListArray, least: float) -> list[tuple[int, int]]:
    """Verified links (node, node) of a part that join its groups: at most one less than it has groups.

    Every row outside the part's largest group is held against all rows of other groups by exact similarity, so no such
    pair is left out; pairs that fail, and those within what is joined already, leave no trace.
    """
    _, group, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    largest = sizes.argmax()
    offsets = hashes.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    filled = np.flatnonzero(size)
    _, local = np.unique(hashes.flatten().to_numpy(), return_inverse=True)
    starts = (offsets - offsets[0])[:-1]
    member, common, found = np.zeros(local.max(initial=-1) + 1, bool), np.zeros(len(nodes), np.int64), []
    for i in filled[group[filled] != largest].tolist():
        own = local[starts[i]:starts[i] + size[i]]
        # An overlap of `least` needs sizes that are not further apart.
        likely = (group != group[i]) & (size >= least * size[i]) & (size * least <= size[i])
        if not likely.any():
            continue
        member[own] = True
        common[filled] = np.add.reduceat(member[local].astype(np.int32), starts[filled])
        member[own] = False
        for j in np.flatnonzero(likely & (common >= least * (size + size[i] - common))).tolist():
            if group[j] != group[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                if group[i] == largest:
                    group[group == group[j]] = largest
                elif group[j] == largest:
                    group[group == group[i]] = largest
                else:
                    group[group == group[j]] = group[i]
    return found


def in_parts(rows: DataFrame, columns: list[str], work: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(a, b): the pairs that `work` finds in the columns of each part of (shard, key, part), which stays whole.

    Shards order their rows differently, so that their trees tend to connect a group by different links.
    """
    place = ["shard", "key", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            starts, ends, out = np.r_[0, cuts], np.r_[cuts, len(keys)], []
            for k in np.flatnonzero(ends - starts > 1):
                part = table.slice(starts[k], ends[k] - starts[k]).combine_chunks()
                out += work(*(part[name].chunk(0) for name in columns))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def keys_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
            return np.column_stack([batch[name].to_numpy() for name in place])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = keys_of(batch)
            same = (keys == keys[-1]).all(axis=1)
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            # What came before the last part of this batch is whole, and so is all that is held if a part ends at its start.
            if first or (held and (keys_of(held[-1].slice(held[-1].num_rows - 1)) != keys[:1]).any()):
                table = pa.Table.from_batches([*held, batch.slice(0, first)])
                yield finished(table, keys_of(table))
                held = []
            held.append(batch.slice(first))
        if held:
            table = pa.Table.from_batches(held)
            yield finished(table, keys_of(table))

    dealt_rows = rows.select(*place, *columns).repartition(*place).sortWithinPartitions(
        *place, F.xxhash64("node", "shard"), "node")
    return dealt_rows.mapInArrow(run, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(parts: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes to look at exactly, from the trees of each part of (shard, key, part, node, fp, signature)."""
    def work(nodes: pa.Array, prints: pa.Array, signatures: pa.Array) -> list[tuple[int, int]]:
        bytes_ = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, HASHES)
        return similar_in_shard(nodes.to_numpy(), prints.to_numpy(), bytes_)

    return in_parts(parts, ["node", "fp", "signature"], work)


def pieces_of(rows: Column) -> Column:
    """Parts that so many rows are cut into."""
    return F.ceil(rows / SHARD_ROWS).cast("long")


def dealt(pieces: Column) -> Column:
    """The part of a row. Shards deal their rows differently, so that parts of a group meet in other shards."""
    return F.pmod(F.xxhash64("shard", "node"), pieces)


def groups(docs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of linked nodes: verified links from the shards that the keys of (node, fp, signature, keys) name.

    First the trees of each shard give links that connect what looks similar, at most one per row and group. Some are not
    similar enough on the whole texts, and what they were to connect may be connected by other pairs. So each shard whose
    rows are in several groups of verified links is searched again, with the shingles of its rows, for pairs between its
    groups; they are verified where they are found, and only links that join groups leave the task.

    A shard of more than SHARD_ROWS rows is searched in parts first; most of it is one group of copies, which its parts and
    the other shards connect. The rows outside the shard's largest group are then held against all of its rows, in blocks,
    so that cutting a shard loses no link and no task holds a whole one. Parts are smaller where texts are long.
    """
    keyed = texts.select(F.posexplode("keys").alias("shard", "key"), "node", "fp", "signature").withColumn(
        "shard", F.col("shard").cast("long"))
    place = ["shard", "key"]
    large = stored(keyed.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS), "large-shards")
    first = keyed.join(large, place, "left").withColumn("part", F.coalesce(dealt(pieces_of(F.col("n"))), F.lit(0)))
    looked = stored(candidates(first), "pairs")
    links = verified(docs, texts, looked, words, least)
    roots = connected_components(stored(links, "found-links"))
    rooted = keyed.select(*place, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = stored(rooted.groupBy(*place, "root").agg(F.count("*").alias("k")).groupBy(*place).agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("n"),
        (F.sum("k") - F.max("k")).alias("m")).where("m > 0"), "open-shards")
    open_rows = stored(rooted.join(several, place), "open-rows")
    if open_rows.isEmpty():
        return roots
    sets = stored(shingle_sets(docs, texts, open_rows.select("node").distinct(), words), "open-shingles")

    # Parts hold about SHARD_ROWS rows and PART_SHINGLES shingles of everyone, and as many of the others.
    weighed = open_rows.join(sets.select("node", F.size("hashes").alias("size")), "node")
    loads = weighed.groupBy(*place).agg(
        F.greatest(pieces_of(F.first("n")), F.ceil(F.sum("size") / PART_SHINGLES)).alias("parts"),
        F.greatest(pieces_of(F.first("m")), F.ceil(F.sum(F.when(F.col("root") != F.col("main"), F.col("size"))) / PART_SHINGLES))
        .alias("blocks"))
    cut = open_rows.join(loads, place)

    def up_to(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    # Part p of all rows meets block b of the others in part p * blocks + b.
    everyone = cut.withColumn("p", dealt(F.col("parts"))).withColumn("b", F.explode(up_to("blocks")))
    others = cut.where("root <> main").withColumn("b", dealt(F.col("blocks"))).withColumn("p", F.explode(up_to("parts")))
    met = everyone.unionByName(others.where("parts > 1 OR blocks > 1")).withColumn(
        "part", F.col("p") * F.col("blocks") + F.col("b")).dropDuplicates([*place, "part", "node"])

    def work(nodes: pa.Array, rooted_: pa.Array, hashes: pa.ListArray) -> list[tuple[int, int]]:
        return joining_links(nodes.to_numpy(), rooted_.to_numpy(), hashes, least)

    new = stored(in_parts(met.join(sets, "node"), ["node", "root", "hashes"], work), "joining-links")
    # The groups so far are stars already: few rounds join them through the new links.
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))


def shingle_sets(docs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the different shingles of the nodes, in ascending order, from their whole texts."""
    wanted = nodes.join(texts, "node").select(F.xxhash64("node", "least").alias("key"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "hashes": [
            np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]}

    # One row stands for all copies of a text: the one with the smallest doc_id, and of those alike any.
    rows = docs.select(text_node().alias("node"), F.col("doc_id").cast("long"), "text").join(
        wanted, F.xxhash64("node", "doc_id") == F.col("key"), "left_semi")
    return by_batch(rows.select("node", "text"), work, "node long, hashes array<long>").dropDuplicates(["node"])


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose shingle sets have Jaccard similarity of at least `least`, from the whole texts again."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(shingle_sets(docs, texts, nodes, words), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without near copies: of each group of linked texts the row with the smallest doc_id stays.

    Texts are linked if their sets of shingles of `words` words have a Jaccard similarity of at least `least`; equal texts
    are one text from the start, so thousands of copies cost no more than a count. NULL counts as empty, all empty texts
    are copies of each other. Of rows that are alike one stays; a NULL doc_id stays only where its group has no other.
    Columns stay as they are.
    """
    rows = stored(sketches(docs, words), "sketches")
    texts = stored(rows.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("signature").alias("signature"),
        F.any_value("keys").alias("keys")), "texts")
    roots = groups(docs, texts, words, least)
    grouped = texts.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    first = F.min_by(F.struct("node", "least"), F.struct(F.col("least").isNull(), "least", "node"))
    stay = grouped.groupBy("root").agg(first.alias("s")).select("s.node", F.col("s.least").alias("of_doc"))
    key = F.xxhash64("node", "of_doc").alias("__key")
    marked = docs.withColumn("__key", F.xxhash64(text_node(), F.col("doc_id").cast("long")))
    # Keyed by text and doc_id, so that copies of one text are spread, and rows that are alike meet.
    return marked.join(stay.select(key), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
