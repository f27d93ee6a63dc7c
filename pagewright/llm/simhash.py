"""SimHash fingerprints and near-duplicate groups through BK-trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import linked
from .components import connected_components
from .shared import by_batch, stored, table

#: Bits per fingerprint, and words whose bits are counted at a time.
BITS, CHUNK = 64, 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, ASCII lower case, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - size + 1].tolist()
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)),
                       np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row, from the whole text; NULL and empty texts have fingerprint zero."""
    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "fp": [simhash(shingle_hashes(t, words)) for t in texts]}

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, fp long")


def block_keys(fps: DataFrame, radius: int, extra: int = 3) -> DataFrame:
    """(shard, key, fp): each fingerprint once per choice of `extra` blocks out of radius + extra.

    Two fingerprints within the radius differ in at most `radius` blocks, so they agree on all bits of some
    choice and meet in its shard: no link is lost. A shard holds fingerprints that agree on about
    64 * extra / (radius + extra) bits.
    """
    edges = [round(BITS * i / (radius + extra)) for i in range(radius + extra + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in choice)
             for choice in combinations(range(radius + extra), extra)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("shard"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(signed)))
    return fps.select("fp", F.explode(keys).alias("k")).select("k.shard", "k.key", "fp")


def near_groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, fp).

    Rows with equal fingerprints are one node. Distinct fingerprints within `radius` bits are linked by the BK-tree
    of each shard they share; component_id is the smallest doc_id reachable, the row's own included.
    Trees are built where a shuffle brings their shard together: as they grow with the data they are not broadcast.
    NULL doc_ids stay in the result and never name a component unless it has no other.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(linked(block_keys(distinct, radius), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    prints = stored(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return near_groups(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
