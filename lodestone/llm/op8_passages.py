"""Substring dedup with compact windows.

The tokens of a text are its shingles of five words. Under one hash function the Cartesian tree of a text's token hashes
groups all its subsequences by the place of their least hash: a compact window (l, c, r) stands for every [i, j] with
l <= i <= c <= j <= r, all of which have the min-hash at c. Of these only the subsequences of the length of the shortest passage
matter, as a longer passage holds such a stretch that is as similar as the whole: for them a window is an interval of starts,
and the intervals of one hash function follow each other. The intervals of two hash functions are joined by a sweep; the pair of
min-hashes is a key, at most as many as both have windows. Texts that share a key in one of the bands are candidates, verified
word by word.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mixed, rolling, table, word_hashes
from lodestone.llm.components import connected_components
from lodestone.llm.op1_decontaminate import seed_filter
from lodestone.llm.op4_lines import SEGMENT, Seen, _merge

SHINGLE, WORDS, SIMILARITY, BANDS = 5, 50, 0.8, 3
#: The most bits of the filter of keys, a power of two: 2**28 are 32 MB. It only saves shuffles.
BITS = 1 << 28
#: Shingles that are worked on at once; a longer text is cut into parts that overlap by a passage.
BATCH = 1 << 16
#: Texts of a bucket that meet as many others in one task.
BLOCK = 256


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """A hash for each run of k words, A-Z lower-cased."""
    return rolling(word_hashes((text or b"").lower().split()), k)


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """of(x[p : p + width]) for each p."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def compact_windows(h: np.ndarray, width: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive) of the nodes of h's Cartesian tree that span `width` places or more, by c. Equal values: the first
    is the least. A zero in h ends a text: no window holds it. With `reach`, l and r are at most so far from c."""
    n = len(h)
    if n < width:
        return (np.empty(0, np.int64),) * 3
    least = _slide(h, width, np.minimum)
    # c is the least of some width places if the greatest of the minima that it takes part in is its own value.
    padded = np.concatenate([np.zeros(width - 1, h.dtype), least, np.zeros(width - 1, h.dtype)])
    c = np.flatnonzero((_slide(padded, width, np.maximum) == h) & (h > 0))
    levels, far = [h], n if reach is None else min(n, reach)
    while 1 << len(levels) <= far and len(levels[-1]) > (1 << (len(levels) - 1)):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    left, right, own = c.copy(), c.copy(), h[c]  # both inclusive
    for j in range(len(levels) - 1, -1, -1):
        t, step = levels[j], 1 << j
        at = left - step
        ok = at >= 0
        ok[ok] = t[at[ok]] > own[ok]
        left[ok] -= step
        at = right + 1
        ok = at + step <= n
        ok[ok] = t[at[ok]] >= own[ok]
        right[ok] += step
    if reach is not None:
        left, right = np.maximum(left, c - reach), np.minimum(right, c + reach)
    wide = right - left + 1 >= width
    return left[wide], c[wide], right[wide]


def starts_of(windows: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, c), ascending, of the stretches of `width` places that each window stands for. Each stretch has one least
    place, so a window's starts end where the next one's begin, or where no stretch fits before the text ends."""
    l, c, r = windows
    first, last = np.maximum(l, c - width + 1), np.minimum(c, r - width + 1)
    some = first <= last
    return first[some], c[some]


def _band_keys(flat: np.ndarray, ends: np.ndarray, width: int, bands: int, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band (first start, key) of the stretches of `width` shingles that have a pair of min-hashes in common,
    ascending; texts end before the places `ends`.

    Two min-hashes under `apart` places apart share words and say little more than one: then those of the next band's functions
    take the second's place, if they lie further off.
    """
    found = []
    for k in range(2 * bands):
        # 32 bits order the tokens; keys are made of all 64.
        h = np.zeros(max(len(flat), int(ends[-1]) + 1), np.uint32)
        h[: len(flat)] = mixed(flat ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32)
        h[h == 0] = 1
        h[ends] = 0
        found.append(starts_of(compact_windows(h, width, width - 1), width))
    for band in range(bands):
        own = [found[(2 * band + i) % (2 * bands)] for i in range(4)]
        # All functions' windows stand for the same stretches: at each start the windows that hold it meet.
        start = np.unique(np.concatenate([s for s, _ in own]))
        a, b, *others = (c[np.searchsorted(s, start, "right") - 1] for s, c in own)
        second = b
        for c in others[::-1]:
            second = np.where(np.abs(c - a) >= apart, c, second)
        b = np.where(np.abs(b - a) >= apart, b, second)
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(start)]
        start, a, b = start[new], a[new], b[new]
        yield start, mixed(flat[a] + np.uint64(band + 1) + mixed(flat[b]))


def keys_of(texts: list[np.ndarray], width: int, bands: int, apart: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, key) for the texts' shingle hashes, distinct."""
    parts, owner = [], []
    for i, s in enumerate(texts):
        if len(s) >= width:
            parts += [s, np.zeros(1, np.uint64)]
            owner.append(np.full(len(s) + 1, i, np.int32))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    flat, owner = np.concatenate(parts), np.concatenate(owner)
    out_i, out_k = [], []
    ends = np.cumsum([len(p) for p in parts])[1::2] - 1
    for start, key in _band_keys(flat, ends, width, bands, apart):
        _, first = np.unique(key ^ mixed(owner[start].astype(np.uint64) + np.uint64(1)), return_index=True)
        out_i.append(owner[start[first]]), out_k.append(key[first].view(np.int64))
    return np.concatenate(out_i), np.concatenate(out_k)


def _in_batches(batches, k: int, width: int):
    """(text hashes, shingle arrays) of some BATCH shingles; a long text comes in parts of that size."""
    ids, parts, size = [], [], 0
    for b in batches:
        for t, text in zip(b.column(0).to_pylist(), b.column(1)):
            whole = shingles(text.as_py(), k)
            for i in range(0, max(1, len(whole) - width + 1), BATCH):
                ids.append(t), parts.append(whole[i : i + BATCH + width - 1])
                size += len(parts[-1])
                if size >= BATCH:
                    yield ids, parts
                    ids, parts, size = [], [], 0
    if ids:
        yield ids, parts


def _keys(width: int, bands: int, k: int, batches):
    for ids, parts in _in_batches(batches, k, width):
        i, key = keys_of(parts, width, bands, k)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.asarray(ids, np.int64)[i])], ["key", "th"])


def _build(bits: int, batches):
    """Filters of the keys seen once and twice, in segments. Columns: key, th."""
    seen = Seen(bits)
    for b in batches:
        seen.add(b.column(0).to_numpy().view(np.uint64))
    size = min(SEGMENT, bits // 8)
    for i in range(0, bits // 8, size):
        once, twice = seen.once[i : i + size], seen.twice[i : i + size]
        if once.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // size]), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["segment", "once", "twice"])


def _suspects(shared, bits: int, batches):
    seen = Seen(8)
    seen.bits, seen.twice = bits, np.frombuffer(shared.value, np.uint8)
    for b in batches:
        yield b.filter(pa.array(seen.has_twice(b.column(0).to_numpy().view(np.uint64))))


def _repeated(spark: SparkSession, keys: DataFrame, bits: int) -> DataFrame:
    """keys without most of those that occur once. The filter has four bits for each row of keys, up to `bits`: beyond, more
    rows are passed on, and the result is the same."""
    bits = min(bits, 1 << max(16, (4 * keys.count()).bit_length()))
    parts = keys.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(partial(_build, bits), "segment long, once binary, twice binary")
    whole, size = np.zeros(bits // 8, np.uint8), min(SEGMENT, bits // 8)
    for row in parts.groupBy("segment").applyInArrow(_merge, "segment long, twice binary").toLocalIterator():
        whole[row.segment * size : row.segment * size + size] = np.frombuffer(row.twice, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())
    return keys.mapInArrow(partial(_suspects, shared, bits), "key long, th long")


def _named(shared, bits: int, batches):
    """The rows whose first column the filter has."""
    mask = np.frombuffer(shared.value, np.uint8)
    for b in batches:
        at = b.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
        yield b.filter(pa.array((mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))


def passages(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Spans of shingles, (start, end) in a and in b, end exclusive, at least `width` long, whose sets have the similarity.

    In b, places whose shingle a holds count 1 and others as much less than nothing as makes the share of hits that the
    similarity needs break even; the longest stretch from a place on is tried first, then purer ones. In a, the stretch along
    the commonest offset of the hits answers to it.
    """
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    at = np.minimum(np.searchsorted(ranked, b), len(a) - 1)
    hits = ranked[at] == b
    # Runs of hits and of others, in turn; most texts have few.
    edge = np.r_[0, np.flatnonzero(hits[1:] != hits[:-1]) + 1, len(b)].tolist()
    runs = [(x, y, bool(hits[x])) for x, y in zip(edge, edge[1:])]
    offset = order[at] - np.arange(len(b))
    need = 2 * similarity / (1 + similarity)

    def stretches(i: int) -> list[int]:
        """The last runs of the stretches from run i on that may do: the longest with the share of hits, the best by score, the
        best by a stricter score, and run i alone."""
        found = []
        for loss in (need / (1 - need), 4 * need / (1 - need)):
            score, best, end, longest = 0.0, 0.0, i, i
            for j in range(i, len(runs)):
                x, y, hit = runs[j]
                score += (y - x) if hit else -loss * (y - x)
                if hit and score >= 0:
                    longest = j
                if hit and score >= best:
                    best, end = score, j
                if score < -loss * width / 8:
                    break
            found += [longest, end]
        return list(dict.fromkeys([*found, i]))

    def answer(i: int, end: int) -> tuple[int, int, int, int] | None:
        own = offset[i:end][hits[i:end]]
        shifts, votes = np.unique(own, return_counts=True)
        near = own[np.abs(own - shifts[votes.argmax()]) <= width] + np.arange(i, end)[hits[i:end]][np.abs(own - shifts[votes.argmax()]) <= width]
        sb = np.unique(b[i:end])
        # Where shingles repeat, offsets say little: then any stretch of a that holds nothing else will do.
        inside = np.isin(a, sb)
        edges = np.r_[0, np.flatnonzero(inside[1:] != inside[:-1]) + 1, len(a)].tolist()
        for x, y in [(int(near.min()), int(near.max()) + 1), *((x, y) for x, y in zip(edges, edges[1:]) if inside[x])]:
            if y - x >= width * similarity:
                sa = np.unique(a[x:y])
                common = int(np.isin(sa, sb, assume_unique=True).sum())
                if common >= similarity * (len(sa) + len(sb) - common):
                    return x, y, i, end
        return None

    out, i = [], 0
    while i < len(runs):
        last = i
        if runs[i][2]:
            for end in stretches(i):
                if runs[end][1] - runs[i][0] >= width and (found := answer(runs[i][0], runs[end][1])):
                    out.append(found)
                    last = end
                    break
        i = last + 1
    return out


def _verify(width: int, similarity: float, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict = {}

    def of(name, text):
        if name not in kept:
            if len(kept) >= 64:
                kept.clear()
            kept[name] = shingles(text.as_py(), k)
        return kept[name]

    for batch in batches:
        out = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("ta"), batch.column("tb")):
            out += [(a, b, *x) for x in passages(of(a, ta), of(b, tb), width, similarity)]
        yield _spans(out)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64() if i < 2 else pa.int32()) for i in range(6)], ["a", "b", "a_start", "a_end", "b_start", "b_end"])


def stretches_of(s: np.ndarray, wanted: set[int], width: int, bands: int, apart: int = SHINGLE) -> list[tuple[int, int, np.ndarray]]:
    """(key, first place, shingles) of the stretches of a text's shingles s that its windows with a wanted key cover, those of
    equal shingles once."""
    out: dict = {}
    for i in range(0, max(1, len(s) - width + 1), BATCH):
        part = s[i : i + BATCH + width - 1]
        for start, key in _band_keys(part, np.array([len(part)]), width, bands, apart):
            last = np.r_[start[1:], len(part) - width + 1]
            for x, y, k in zip(start.tolist(), last.tolist(), key.view(np.int64).tolist()):
                if k in wanted:
                    held = part[x : y + width - 1]
                    out.setdefault((k, held.tobytes()), (k, i + x, held))
    return list(out.values())


def _contexts(width: int, bands: int, k: int, batches):
    """Columns: th, keys, text."""
    for b in batches:
        for th, keys, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            found = stretches_of(shingles(text.as_py(), k), set(keys), width, bands, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([th] * len(found), pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2].view(np.int64) for x in found], pa.list_(pa.int64()))], ["key", "th", "at", "held"])


def links_between(rows: list[tuple], width: int, similarity: float) -> list[tuple]:
    """rows: (th, component, outside, left, at, held) of one bucket: outside if the component isn't the bucket's largest, left if
    the row is to meet all others here. Links (th, th, spans) that join whatever components similar stretches join, and one
    at least of each left text that has any. Of two outside texts the lesser is the left one."""
    ids = {x: i for i, x in enumerate(np.unique(np.concatenate([x[5] for x in rows if x[3]])).tolist())}
    number = [np.fromiter((ids.get(x, -1) for x in r[5].tolist()), np.int64, len(r[5])) for r in rows]
    has = np.zeros((len(rows), len(ids) + 1), np.uint8)
    for i, n in enumerate(number):
        has[i, n] = 1
    has[:, -1] = 0
    plain = np.array([len(np.unique(r[5])) == len(r[5]) for r in rows])
    least = np.array([width if x else min(len(np.unique(r[5][i : i + width])) for i in range(len(r[5]) - width + 1)) for r, x in zip(rows, plain)])
    need = int(np.ceil(2 * similarity / (1 + similarity) * width - 1e-9))
    comp = np.array([x[1] for x in rows])
    outside, left = np.array([x[2] for x in rows]), np.array([x[3] for x in rows])
    th = np.array([x[0] for x in rows])
    joined: dict = {}

    def root(c):
        while (up := joined.get(c, c)) != c:
            c = up
        return c

    out, linked = [], set()
    for i in np.flatnonzero(left).tolist():
        # Stretches without a repeated shingle are as similar only if so many of one's places are held by the other.
        hits = np.cumsum(has[:, number[i]], axis=1, dtype=np.int32)
        best = (hits[:, width - 1 :] - np.concatenate([np.zeros((len(rows), 1), np.int32), hits[:, :-width]], axis=1)).max(axis=1)
        common = has[:, np.unique(number[i])].sum(axis=1)
        enough = np.where(plain & plain[i], best >= need, common >= similarity / (1 + similarity) * (least + least[i]) - 1e-9)
        near = enough & (th != th[i]) & (~outside | (th > th[i]))
        for j in np.flatnonzero(near).tolist():
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x == y and (int(th[i]) in linked and (not outside[j] or int(th[j]) in linked)):
                continue
            if found := passages(rows[i][5], rows[j][5], width, similarity):
                joined[max(x, y)] = min(x, y)
                linked |= {int(th[i]), int(th[j])}
                u, v = rows[i][4], rows[j][4]
                out += [(int(th[i]), int(th[j]), a + u, b + u, c + v, d + v) for a, b, c, d in found]
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """spans: (th, start, end). (th, passages): those that overlap or touch are one."""
    order = W.partitionBy("th").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn("n", F.sum("new").over(order))
    whole = marked.groupBy("th", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs that holds a passage of at least `words` words which another document holds as well, or nearly so
    (similarity of the sets of shingles): the id, class_id (the smallest id that such links reach), n_copies (rows with the
    same text), passages (start and end in words, merged, end exclusive, of the pairs compared).

    Copies of a text are one text here, and are told apart again at the end. In a bucket of texts that share a key each is
    compared to the least one. Where that leaves a bucket with more than one component, those outside the largest are compared,
    around the key, with all others of the bucket, in blocks of about `block` by `block` texts that give links alone: no link
    between components is lost, whatever the bucket's size, and no pair without one becomes a row. Null and empty texts and
    texts under `words` words have no passage. Null ids keep their rows; they are no class_id. Repeated rows count as copies.
    Only the named columns are read. An empty table gives no rows. Texts of any length are read whole, in parts of bounded size.
    """
    spark, width = docs.sparkSession, words - shingle + 1
    kind = "a long, b long, a_start int, a_end int, b_start int, b_end int"
    got = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    keys = cut(got.select("th", "text").mapInArrow(partial(_keys, width, bands, shingle), "key long, th long"))
    suspects = cut(_repeated(spark, keys, bits))
    least = cut(suspects.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("z")).where("a < z").select("key", "a"))

    def chosen(rows: DataFrame, names: DataFrame, schema: str) -> DataFrame:
        """The rows whose first column names has, and a few others, chosen by a filter of a bounded size: only they are shuffled."""
        few = min(1 << 26, 1 << max(16, (16 * names.count()).bit_length()))
        mask = spark.sparkContext.broadcast(seed_filter(names, few))
        return rows.mapInArrow(partial(_named, mask, few), schema)

    def texts(names: DataFrame, name: str) -> DataFrame:
        """The texts named, and a few others, each once."""
        some = chosen(got.select("th", "text"), cut(names.select(F.col(name).alias("seed")).distinct()), "th long, text binary")
        return some.dropDuplicates(["th"]).select(F.col("th").alias(name), F.col("text").alias("t" + name))

    rows = cut(chosen(suspects, least.select(F.col("key").alias("seed")), "key long, th long").join(least, "key").distinct())

    pairs = cut(rows.where("th <> a").select("a", F.col("th").alias("b")).distinct())
    # The heads' texts are written, so that Spark splits one that most pairs have.
    both = pairs.join(texts(pairs, "b"), "b").join(cut(texts(pairs, "a")), "a")
    links = cut(both.mapInArrow(partial(_verify, width, similarity, shingle), kind))
    component = cut(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("th"), "component"))
    # Buckets with more than one component are those with a text of another component than the least text's. They are found by
    # the pairs, of which there are few next to the rows, and only their rows are shuffled.
    of = lambda name, own: component.select(F.col("th").alias(name), F.col("component").alias(own))
    apart = pairs.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    apart = cut(apart.select(F.col("b").alias("th"), "a"))
    split = chosen(rows.select("th", "key", "a"), apart.select(F.col("th").alias("seed")), "th long, key long, a long")
    split = cut(split.join(apart, ["th", "a"]).select("key").distinct())
    rows = chosen(rows.select("key", "th"), split.select(F.col("key").alias("seed")), "key long, th long").join(split, "key")
    rows = cut(rows.join(component, "th", "left").select("key", "th", F.coalesce("component", "th").alias("component")))
    # What is outside the largest.
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    sizes = cut(sizes.select("key", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("n_left"), F.ceil(F.col("n") / block).cast("int").alias("n_right")))
    rows = cut(rows.join(sizes, "key").withColumn("outside", F.col("component") != F.col("largest")).drop("largest"))
    wanted = cut(rows.groupBy("th").agg(F.collect_set("key").alias("keys")))
    held = wanted.join(texts(wanted, "th"), "th").select("th", "keys", "tth").mapInArrow(partial(_contexts, width, bands, shingle), "key long, th long, at int, held array<long>")
    held = cut(rows.join(held, ["key", "th"]))
    left, right = F.pmod(F.xxhash64("th"), F.col("n_left")), F.pmod(F.xxhash64("th"), F.col("n_right"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = ["th", "component", "outside", "at", "held", "key"]
    dealt = held.where("outside").select(*here, left.alias("i"), every("n_right").alias("j"), right.alias("own")).where("j <> own").select(*here, F.lit(True).alias("left"), "i", "j")
    dealt = dealt.union(held.select(*here, left.alias("own"), every("n_left").alias("i"), right.alias("j")).select(*here, (F.col("outside") & (F.col("i") == F.col("own"))).alias("left"), "i", "j"))

    def meet(group: pa.Table) -> pa.Table:
        names = ("th", "component", "outside", "left", "at")
        mine = list(zip(*(group.column(c).to_pylist() for c in names), (np.array(x.as_py(), np.int64).view(np.uint64) for x in group.column("held"))))
        return pa.Table.from_batches([_spans(links_between(mine, width, similarity) if any(r[3] for r in mine) else [])])

    # As many partitions as asked for: rows are few next to the work that they make.
    dealt = dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "key", "i", "j")
    links = cut(links.union(dealt.groupBy("key", "i", "j").applyInArrow(meet, kind)))
    spans = links.select(F.col("a").alias("th"), F.col("a_start").alias("start"), (F.col("a_end") + shingle - 1).alias("end")).union(links.select("b", "b_start", F.col("b_end") + shingle - 1))
    n_words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    members = cut(got.select("id", "th", n_words.alias("n_words")))
    classes = members.groupBy("th").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"))
    component = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("th"), "component")
    classes = classes.join(_merged(spans), "th", "left").join(component, "th", "left")
    classes = cut(classes.where(F.col("passages").isNotNull() | ((F.col("n_copies") > 1) & (F.col("n_words") >= words))).withColumn("component", F.coalesce("component", "th")))
    class_ids = cut(classes.groupBy("component").agg(F.min("first").alias("class_id")))
    own = F.when(F.col("n_copies") > 1, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))).otherwise(F.col("passages"))
    of_text = cut(classes.join(class_ids, "component").select("th", "class_id", "n_copies", own.alias("passages")))
    return members.select("id", "th").join(of_text, "th").select(F.col("id").alias(id_col), "class_id", "n_copies", "passages")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).withColumn("n_passages", F.size("passages").cast("long"))


QUERIES = {"op8_passages": op8_passages}
ORACLES: dict[str, str] = {}
