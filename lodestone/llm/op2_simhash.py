"""SimHash near-dedup with covering locality-sensitive hashing.

Bit i of a fingerprint has the code m(i), a nonzero vector of radius + 1 bits. Table v, for each of the 2**(radius+1) - 1
nonzero vectors v, keeps the bits whose code has an odd number of ones in common with v. The codes of `radius` differing
bits lie in a subspace of at most `radius` dimensions, so some v is orthogonal to all of them: its table keeps none of these
bits, and the two fingerprints meet there. No pair within the radius is missed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, slices, table
from lodestone.llm.components import connected_components

RADIUS = 3
#: A bucket of more fingerprints is dealt out by further bits; one with 12 free bits holds no more than this.
BUCKET = 4096

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash, unsigned; 0 without a word."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    shingles = [b" ".join(words)] if n < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter(map(_hash, shingles), np.uint64, max(1, n - width + 1))
    ones = np.zeros(64, np.int64)
    for i, j in slices(len(h), 1 << 15):
        ones += np.unpackbits(h[i:j].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks, as unsigned 64-bit numbers."""
    codes = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(64) if (1 + i % codes & v).bit_count() % 2) for v in range(1, codes + 1)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Adds to the mask, in turn, each of radius + 1 parts of the free bits: of these one is equal in a pair within the radius."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_groups(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(first, other) for the others that links reach from the first, over all groups of distinct fingerprints."""
    rest, out = np.sort(fps), []
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            near = np.bitwise_count(np.bitwise_xor(rest, todo.pop()).view(np.uint64)) <= radius
            if near.any():
                todo += (found := rest[near]).tolist()
                out += [(int(first), int(x)) for x in found]
                rest = rest[~near]
    return out


def _links(radius: int, batches):
    for b in batches:
        links = []
        for fps in b.column(0):
            fps = fps.values.to_numpy(zero_copy_only=False)
            if len(fps) == 2:
                if ((int(fps[0]) ^ int(fps[1])) & (2**64 - 1)).bit_count() <= radius:
                    links.append((int(fps[0]), int(fps[1])))
            else:
                links += linked_groups(fps, radius)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct fp. Pairs (u, v) within the radius that connect whatever all such pairs connect.

    Buckets with one member are left out before any is gathered; one with over `bucket` members is dealt out by
    finer_masks(), again and again: a bucket whose mask leaves k bits free holds 2**k distinct fingerprints at most, so none
    that reaches a task is larger than `bucket`, and no pair is lost.
    """
    assert bucket >= 64
    masks, out = covering_masks(radius), None
    frame = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    while True:
        frame = frame.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(frame.groupBy("mask", "key").count().where("count > 1"))
        member = frame.join(sizes, ["mask", "key"])
        small = member.where(F.col("count") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        links = small.select("fps").mapInArrow(partial(_links, radius), "u long, v long")
        out = links if out is None else out.union(links)
        if sizes.where(F.col("count") > bucket).isEmpty():
            return out
        below = {_signed(m): [_signed(x) for x in finer_masks(m, radius)] for m in masks}
        masks = sorted({x & (2**64 - 1) for v in below.values() for x in v})
        finer = F.create_map(*(x for k, v in below.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        frame = cut(member.where(F.col("count") > bucket).select("fp", F.explode(finer[F.col("mask")]).alias("mask")))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Only the id and text columns are read, so other columns may have any name. A null text counts as empty: fingerprint zero,
    linked like any other. A null id keeps its row, and links through it hold, but it is never a component_id; a component of
    null ids has a null component_id. Repeated rows stay. An empty table gives no rows. Texts may be of any length.
    """
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = cut(got.mapInArrow(_fingerprints, f"id {got.schema['id'].dataType.simpleString()}, fp long"))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = connected_components(near_links(classes.select("fp"), radius, bucket)).select(F.col("node").alias("fp"), "component")
    classes = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = cut(classes)
    least = cut(classes.groupBy("component").agg(F.min("first").alias("component_id")))
    of_class = cut(classes.join(least, "component").select("fp", "component_id"))
    return prints.join(of_class, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
