"""Benchmark decontamination by greedy string tiling.

Words are the maximal runs of letters, digits and underscores, lower-cased. Seeds are the Karp-Rabin hashes of all runs of
`min_match` words. Documents meet test items on seeds in a shuffled join; only seeds that pass a Bloom filter of the items'
seeds (of a fixed size) enter it. Each pair that may reach the threshold is tiled: the longest matches between unmarked words
are marked again and again, found by running Karp-Rabin, so that reordered passages count in full.
"""

import heapq
import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, rolling, table, word_hashes

MIN_MATCH = 5
#: Share of an item's words that tiles in one document cover.
COVERAGE = 0.5
#: Bits of the filter, a power of two: 2**25 are 4 MB.
BITS = 1 << 25
#: Bytes of a filter that are merged at once.
SEGMENT = 1 << 16
#: Pairs of places that are compared at once, and how many words further in a step.
PAIRS, STEP = 1 << 14, 64
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode("utf8", "surrogatepass") for w in _WORD.findall((text or "").lower())]


def seeds(text: str | None, k: int) -> np.ndarray:
    return rolling(word_hashes(words_of(text)), k)


def tiles(pattern: list, text: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length), longest first.

    Each round looks for matches of at least `length` unmarked words; matches of over twice that restart the round with their
    length, as running Karp-Rabin does, and those found are marked from the longest down. Where a part of one is marked, what is
    left of it waits for its turn, so that the tiles are those of plain greedy tiling.
    """
    ids: dict = {}
    p = np.array([ids.setdefault(w, len(ids)) for w in pattern], np.uint64)
    t = np.array([ids.setdefault(w, len(ids)) for w in text], np.uint64)
    free_p, free_t, out = np.ones(len(p), bool), np.ones(len(t), bool), []
    length = max(min_match, min(len(p), 4 * min_match))
    while True:
        found, longest = _matches(p, t, free_p, free_t, length), 0
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        waiting = [(-n, i, j) for n, i, j in found]
        heapq.heapify(waiting)
        while waiting:
            n, i, j = heapq.heappop(waiting)
            free = free_p[i : i - n] & free_t[j : j - n]
            if free.all():
                free_p[i : i - n] = free_t[j : j - n] = False
                out.append((i, j, -n))
            elif free.any():
                edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8))).tolist()
                for x, y in zip(edges[::2], edges[1::2]):
                    if y - x >= length:
                        heapq.heappush(waiting, (x - y, i + x, j + x))
        if length == min_match:
            return out
        length = max(min_match, length // 2)


def _matches(p, t, free_p, free_t, length) -> list[tuple[int, int, int]]:
    """(length, i, j) of the matches of unmarked words, at least `length` long, that can't be extended to the left."""
    if len(p) < length or len(t) < length:
        return []
    open_p, open_t = (np.flatnonzero(np.convolve(f, np.ones(length, int), "valid") == length) for f in (free_p, free_t))
    hp, ht = rolling(p + np.uint64(1), length), rolling(t + np.uint64(1), length)
    by_hash = open_p[np.argsort(hp[open_p], kind="stable")]
    first, last = (np.searchsorted(hp[by_hash], ht[open_t], side) for side in ("left", "right"))
    near = first < last
    open_t, first, many = open_t[near], first[near], (last - first)[near]
    whole, at, out = np.r_[0, np.cumsum(many)], 0, []
    while at < len(open_t):
        # Places of the text, with those of the item that have their hash: a bounded number of pairs at once.
        upto = max(at + 1, int(np.searchsorted(whole, whole[at] + PAIRS, "right")) - 1)
        n, shift = many[at:upto], first[at:upto] - (whole[at:upto] - whole[at])
        i, j = by_hash[np.arange(n.sum()) + np.repeat(shift, n)], np.repeat(open_t[at:upto], n)
        goes_back = (i > 0) & (j > 0) & (p[i - 1] == t[j - 1]) & free_p[i - 1] & free_t[j - 1]
        out += _extended(p, t, free_p, free_t, i[~goes_back], j[~goes_back], length)
        at = upto
    return out


def _extended(p, t, free_p, free_t, i, j, length) -> list[tuple[int, int, int]]:
    """(length, i, j) of the pairs of places from which at least `length` unmarked words agree; all pairs go on together."""
    n, going = np.zeros(len(i), int), np.arange(len(i))
    while len(going):
        x, y = ((k[going] + n[going])[:, None] + np.arange(STEP) for k in (i, j))
        inside = (x < len(p)) & (y < len(t))
        x, y = np.minimum(x, len(p) - 1), np.minimum(y, len(t) - 1)
        same = inside & (p[x] == t[y]) & free_p[x] & free_t[y]
        run = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        n[going] += run
        going = going[run == STEP]
    enough = n >= length
    return list(zip(n[enough].tolist(), i[enough].tolist(), j[enough].tolist()))


def _item_seeds(k: int, batches):
    for b in batches:
        items, found, times, sizes = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s, n = np.unique(seeds(t, k), return_counts=True)
            items += [i] * len(s)
            times.append(n)
            sizes += [len(words_of(t))] * len(s)
            found.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(items, b.schema.field(0).type), *(pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (found, times)), pa.array(sizes, pa.int32())], ["item", "seed", "times", "item_words"])


def _bits(bits: int, batches):
    """The filter of a task's seeds, in segments; those without a bit are left out."""
    mask, size = np.zeros(bits // 8, np.uint8), min(SEGMENT, bits // 8)
    for b in batches:
        at = b.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
        np.bitwise_or.at(mask, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    for i in range(0, bits // 8, size):
        part = mask[i : i + size]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // size]), pa.array([part.tobytes()])], ["segment", "bits"])


def _either(group: pa.Table) -> pa.Table:
    """Of one segment: the bits that any task has."""
    whole = reduce(np.bitwise_or, (np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")))
    return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([whole.tobytes()])})


def seed_filter(item_seeds: DataFrame, bits: int = BITS) -> bytes:
    """A Bloom filter, with one hash function, of the seeds in the only column: bits / 8 bytes on the driver, however many there
    are, made by as many tasks as the cluster has cores."""
    cores = item_seeds.sparkSession.sparkContext.defaultParallelism
    parts = item_seeds.coalesce(cores).mapInArrow(partial(_bits, bits), "segment long, bits binary").groupBy("segment").applyInArrow(_either, "segment long, bits binary")
    mask, size = np.zeros(bits // 8, np.uint8), min(SEGMENT, bits // 8)
    for row in parts.toLocalIterator():
        mask[row.segment * size : row.segment * size + size] = np.frombuffer(row.bits, np.uint8)
    return mask.tobytes()


def _suspects(shared, bits: int, k: int, batches):
    """(rid, seed) of the distinct seeds that pass the filter."""
    mask = np.frombuffer(shared.value, np.uint8)
    for b in batches:
        rid, found = [], []
        for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = seeds(t, k)
            at = s & np.uint64(bits - 1)
            s = np.unique(s[(mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)])
            rid.append(np.full(len(s), r, np.int64)), found.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (rid, found)], ["rid", "seed"])


def _tile(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, longest, covered, spans = [], [], [], []
        for text, item in zip(b.column("text").to_pylist(), b.column("item_text").to_pylist()):
            found = tiles(words_of(item), words_of(text), k)
            n.append(len(found)), covered.append(sum(x[2] for x in found)), longest.append(max((x[2] for x in found), default=0))
            spans.append([{"start": j, "length": m} for _, j, m in sorted(found, key=lambda x: x[1])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("item"), b.column("item_words"), pa.array(covered, pa.int64()), pa.array(n, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, kind)], ["id", "item", "item_words", "covered", "n_tiles", "longest_tile", "tiles"])


def leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, bits: int = BITS) -> DataFrame:
    """One row per pair of a document and a test item whose tiles cover at least `coverage` of the item's words: the id, the
    item, item_words, covered, n_tiles, longest_tile, coverage, tiles (start and length in words of the document).

    Null and empty texts match nothing, nor do items under min_match words. Rows of equal id and text count once, as do rows of
    equal item and item text; null ids and items are kept as they are. Only the named columns are read. Empty tables give no
    rows. Texts of any length are read whole. Any number of documents may hold an item: seeds meet in a join
    that Spark splits where skewed, and no pair of documents is made. A seed that many documents hold meets each item that has
    it once: what the join gives is bounded by the documents' seeds times the items that share one. A pair whose words repeat
    takes time with the product of the item's words and the text's, in blocks of a bounded size.
    """
    spark = docs.sparkSession
    got = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = cut(tests.select(F.xxhash64(item_col, item_text_col).alias("iid"), F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("item_text")).dropDuplicates(["iid"]))
    item_seeds = cut(items.select("iid", "item_text").mapInArrow(partial(_item_seeds, min_match), "item long, seed long, times long, item_words int"))
    shared = spark.sparkContext.broadcast(seed_filter(item_seeds.select("seed"), bits))
    suspects = got.select("rid", "text").mapInArrow(partial(_suspects, shared, bits, min_match), "rid long, seed long")
    # A tile of n words starts n - min_match + 1 seeds in the item, at least n / min_match: no pair that may reach the threshold is lost.
    pairs = suspects.join(item_seeds, "seed").groupBy("rid", "item", "item_words").agg(F.sum("times").alias("seeds")).where(F.col("seeds") * min_match >= coverage * F.col("item_words"))
    pairs = cut(pairs.select("rid", F.col("item").alias("iid"), "item_words"))
    texts = got.join(pairs.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"])
    both = pairs.join(texts, "rid").join(items, "iid").select("id", "item", "item_words", "text", "item_text")
    kind = f"id {got.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, item_words int, covered long, n_tiles long, longest_tile long, tiles array<struct<start:long,length:long>>"
    found = both.mapInArrow(partial(_tile, min_match), kind).where(F.col("covered") >= coverage * F.col("item_words"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("item_words").cast("long").alias("item_words"), "covered", "n_tiles", "longest_tile", (F.col("covered") / F.col("item_words")).alias("coverage"), "tiles")


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that leak a test item; a row with a null id goes only with its own text. Both sides of the last join
    have a shuffle of their own, so that Spark splits a row that is repeated often."""
    row = fresh(docs, "row")
    found = leaks(docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")), tests, "row", "text", **options).select(F.col("row").alias(row))
    return docs.join(found, F.xxhash64(id_col, text_col) == F.col(row), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
