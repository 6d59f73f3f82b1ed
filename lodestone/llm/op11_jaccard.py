"""Documents whose sets of word n-grams are nearly the same, by a grouped prefix join.

The n-grams of all documents are put in one order, rare ones first. Two sets that are similar enough share an n-gram among the
first of each, its prefix. Sets with the same prefix and size are one group; groups meet by the n-grams of their prefixes, pairs
of groups pass by their sizes and the places of the n-gram, pairs of members by a sketch that never underrates, and what is left is
compared exactly.

Where many sets share an n-gram, each is compared to one of them first, and then only what that has not brought together.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mixed, rolling, table, word_hashes
from lodestone.llm.components import connected_components
from lodestone.llm.op1_decontaminate import seed_filter

SHINGLE, PERCENT = 3, 90
#: The n-grams' documents are counted in so many counters at most (one byte each where they are broadcast), sent in segments.
COUNTERS, SEGMENT = 1 << 24, 1 << 18
#: Words of 64 bits of a sketch.
SKETCH = 16
#: Sets that meet in a task; the nearest that a set is compared to, in turn.
BLOCK, NEAREST = 2048, (8, None)
#: Digests that a task remembers, so that copies next to each other give one row.
SEEN = 1 << 16


def ngram_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of k words, A-Z lower-cased, ascending; of all words if there are fewer."""
    words = (text or b"").lower().split()
    return np.unique(rolling(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A set as similar shares ceil(percent * n / 100) of the n at least, so one of so many."""
    return n - -(-percent * n // 100) + 1


def sketch_of(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of hashes fall on it: two sets differ by as many hashes as their sketches by bits, or more."""
    bits = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _counter(s: np.ndarray, counters: int) -> np.ndarray:
    return (mixed(s) & np.uint64(counters - 1)).astype(np.int64)


def _read(k: int, counters: int, batches):
    """Columns: id, th, text. A row for each document, and the counters of the n-grams' documents in segments."""
    held, size, last = np.zeros(counters, np.uint32), min(SEGMENT, counters), None
    for b in batches:
        last, sets = b, [ngram_set(x.as_py(), k) for x in b.column(2)]
        for s in sets:
            held[_counter(s, counters)] += 1  # two of a set on one counter count once
        nothing = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary())], ["id", "th", "digest", "n", "segment", "counts"])
    for i in range(0, counters if last is not None else 0, size):
        if (part := held[i : i + size]).any():
            packed = zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, last.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([i // size], pa.int32()), pa.array([packed], pa.binary())], ["id", "th", "digest", "n", "segment", "counts"])


def _levels(batches):
    """Columns: segment, counts. The steps of the summed counts, four for each doubling."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for segment, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            held[segment] = held[segment] + part if segment in held else part.astype(np.uint64)
    for segment, n in held.items():
        level = np.minimum(255, np.floor(4 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["segment", "level"])


def _prefixes(shared, k: int, percent: int, batches):
    """Columns: text. Each set with its group, sketch and prefix; of sets that the task has just read the first."""
    levels, seen = np.frombuffer(shared.value, np.uint8), set()
    for b in batches:
        out = []
        for text in b.column(0):
            s = ngram_set(text.as_py(), k)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            if not len(s) or digest in seen:
                continue
            seen.add(digest)
            if len(seen) > SEEN:
                seen.clear()
            order = (levels[_counter(s, len(levels))].astype(np.uint64) << np.uint64(56)) | (mixed(s) >> np.uint64(8))
            prefix = s[np.argsort(order, kind="stable")[: prefix_length(len(s), percent)]]
            out.append((digest, len(s), xxhash.xxh3_64_intdigest(prefix.tobytes(), len(s)) - (1 << 63), sketch_of(s), prefix.view(np.int64)))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["digest", "n", "grp", "sketch", "prefix"])


def _among(shared, column: int, batches):
    """The rows whose number in the column the filter has."""
    mask = np.frombuffer(shared.value, np.uint8)
    for b in batches:
        at = b.column(column).to_numpy().view(np.uint64) & np.uint64(8 * len(mask) - 1)
        yield b.filter(pa.array((mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))


def _few(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows whose number in `column` is in names, and a few others, by a filter of 8 MB at most: only they are shuffled."""
    bits = min(1 << 26, 1 << max(16, (16 * names.count()).bit_length()))
    mask = rows.sparkSession.sparkContext.broadcast(seed_filter(names, bits))
    return rows.mapInArrow(partial(_among, mask, rows.columns.index(column)), rows.schema)


def overlap(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """The n-grams that sets of sizes a and b share if they are similar."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)


def _needed(a, b, percent: int):
    return -(-percent * (a + b) // (100 + percent))


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH)


def _near(percent: int, batches):
    """Columns: a, b, na, nb, sa, sb. The pairs that the sketches let pass."""
    for b in batches:
        if b.num_rows:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            apart = np.bitwise_count(_bits(b.column("sa")) ^ _bits(b.column("sb"))).sum(axis=1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(apart <= na + nb - 2 * _needed(na, nb, percent)))


def near_in_block(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, left: np.ndarray, sketch: np.ndarray, percent: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the rows of one block (i, j): pairs of a left row and another that may be similar and are of two components, for each left
    row among the `nearest` by sketch of those that may be similar; and whether there are others."""
    rows, out_i, out_j, more = np.flatnonzero(left), [], [], False
    step = max(1, (1 << 18) // len(n))
    for k in range(0, len(rows), step):
        own = rows[k : k + step]
        need = _needed(n[own][:, None], n[None, :], percent)
        rest = n - pos
        may = (100 * np.minimum(n[own][:, None], n) >= percent * np.maximum(n[own][:, None], n)) & (np.minimum(rest[own][:, None], rest) >= need)
        may[np.arange(len(own)), own] = False
        i, j = np.nonzero(may)
        apart = np.bitwise_count(sketch[own[i]] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        near = apart <= n[own[i]] + n[j] - 2 * need[i, j]
        i, j, apart = i[near], j[near], apart[near]
        if nearest is not None and len(i):
            order = np.lexsort((j, apart, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            cross = comp[own[i]] != comp[j]
            more = more or bool((cross & (rank >= nearest)).any())
            i, j = i[cross & (rank < nearest)], j[cross & (rank < nearest)]
        else:
            cross = comp[own[i]] != comp[j]
            i, j = i[cross], j[cross]
        out_i.append(own[i]), out_j.append(j)
    return np.concatenate([np.empty(0, np.int64), *out_i]), np.concatenate([np.empty(0, np.int64), *out_j]), more


def _blocks(percent: int, nearest: int | None, batches):
    """Columns: token, i, j, left, g, n, pos, comp, sketch, the rows of a block next to each other. Pairs, and rows without a pair
    that name the tokens of blocks with more of them."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table):
        g = t.column("g").to_pylist()
        comp = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)[1]
        left = t.column("left").to_numpy()
        i, j, more = near_in_block(t.column("n").to_numpy(), t.column("pos").to_numpy(), comp, left, _bits(t.column("sketch")), percent, nearest)
        pairs = {(min(g[x], g[y]), max(g[x], g[y])) for x, y in zip(i.tolist(), j.tolist())}
        return [(None, a, b) for a, b in pairs] + [(t.column("token")[0].as_py(), None, None)] * more

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["token", "a", "b"])

    def runs(t: pa.Table) -> list[int]:
        key = [t.column(c).to_numpy() for c in ("token", "i", "j")]
        return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist(), t.num_rows]

    for b in batches:
        held.append(b)
        if b.num_rows:
            # The last run may go on in the next batch.
            t = pa.Table.from_batches(held)
            edge = runs(t)
            rows = [x for u, v in zip(edge[:-2], edge[1:-1]) if v - u > 1 for x in done(t.slice(u, v - u))]
            held = t.slice(edge[-2]).to_batches()
            yield out(rows)
    if held:
        t = pa.Table.from_batches(held)
        yield out(done(t) if t.num_rows > 1 else [])


def _sets(k: int, batches):
    for b in batches:
        sets = [ngram_set(x.as_py(), k) for x in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "hashes"])


def _similar(percent: int, batches):
    """Columns: a, b, ha, hb. The pairs whose sets are similar."""
    for batch in batches:
        ok = []
        for ha, hb in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
            a, b = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            ok.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Join:
    """The sets of one corpus and what is known of their links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.members, self.k, self.percent = docs, classes, members, k, percent
        self.links = self.component = None

    def components(self) -> None:
        """Tells the components of all links so far."""
        found = connected_components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        self.component = cut(found.select(F.col("node").alias("g"), F.col("component").alias("c")))

    def stars(self) -> None:
        """Names each linked set by its head's head: sets of one name are linked, though linked ones may have two names. That is
        enough to leave out what needs no comparison, and takes one join."""
        up = self.links.select(F.col("b").alias("g"), F.col("a").alias("up"))
        above = self.links.select(F.col("b").alias("up"), F.col("a").alias("c"))
        self.component = cut(up.join(above, "up", "left").select("g", F.coalesce("c", "up").alias("c")))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that aren't known to be connected."""
        if self.component is None:
            return pairs
        of = lambda name, own: self.component.select(F.col("g").alias(name), F.col("c").alias(own))
        found = pairs.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
        return found.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def verify(self, pairs: DataFrame) -> None:
        """Adds the similar ones of the pairs (a, b) to the links."""
        if pairs.isEmpty():
            return
        named = cut(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(self.classes.select("digest", "th"), "digest"))
        # The filter lets some others pass, whose sets nothing asks for.
        texts = _few(self.docs.select("th", "text"), "th", named.select(F.col("th").alias("seed"))).dropDuplicates(["th"])
        sets = cut(texts.select("text").mapInArrow(partial(_sets, self.k), "digest binary, hashes binary"))
        of = lambda name: sets.select(F.col("digest").alias(name), F.col("hashes").alias("h" + name))
        found = cut(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(partial(_similar, self.percent), "a binary, b binary"))
        self.links = found if self.links is None else self.links.union(found)

    def star(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows: (token, grp, n, pos). Compares each set to the least of those heads of its buckets that it may be similar to; a
        bucket's head is its least group. Returns the heads and the pairs with other heads that no links connect."""
        order = F.struct(F.xxhash64("grp").alias("o"), "grp", "n", "pos")
        heads = rows.groupBy("token").agg(F.min(order).alias("h"), F.count("*").alias("groups"))
        heads = cut(heads.select("token", F.col("h.grp").alias("head"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"), "groups"))
        n, hn = F.col("n"), F.col("hn")
        may = (100 * F.least(n, hn) >= self.percent * F.greatest(n, hn)) & (F.least(n - F.col("pos"), hn - F.col("hpos")) >= overlap(n, hn, self.percent))
        groups = cut(rows.join(heads, "token").where(may).select("head", "grp").distinct())
        first = self.members.groupBy("grp").agg(F.min(F.struct("digest", "n", "sketch")).alias("x"))
        first = first.join(groups.select(F.col("head").alias("grp")).distinct(), "grp", "left_semi").select(F.col("grp").alias("head"), F.col("x.digest").alias("a"), F.col("x.n").alias("na"), F.col("x.sketch").alias("sa"))
        pairs = groups.join(cut(first), "head").join(self.members.select("grp", F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "grp").where("a <> b")
        near = cut(pairs.mapInArrow(partial(_near, self.percent), "a binary, b binary").distinct())
        # A head comes before its sets in the order of heads, so that these links have no circle.
        self.verify(cut(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
        if self.links is not None:
            self.stars()
        return heads, cut(self.apart(near))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """rows: (token, grp, n, pos). The members of the buckets with more than one component, with that, and sizes of the bucket."""
        held = rows.join(self.members.select("grp", F.col("digest").alias("g")), "grp").select("token", "grp", "n", "pos", "g")
        if self.component is not None:
            held = held.join(self.component, "g", "left").withColumn("comp", F.coalesce("c", "g")).drop("c")
        else:
            held = held.withColumn("comp", F.col("g"))
        held = cut(held)
        sizes = held.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
        return held.join(cut(sizes.select("token", "all", F.col("most.m").alias("m"), F.col("most.comp").alias("largest"))), "token")

    def rest(self, held: DataFrame, nearest: int | None) -> tuple[DataFrame, DataFrame]:
        """held: rows of mixed(). (pairs that may be similar, tokens of buckets with others). What is outside a bucket's largest
        component meets all others, in blocks."""
        left = F.col("comp") != F.col("largest")
        n_left, n_right = F.ceil((F.col("all") - F.col("m")) / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
        held = held.withColumns({"outside": left, "n_left": n_left, "n_right": n_right}).drop("grp", "all", "m", "largest")
        held = held.join(self.members.select(F.col("digest").alias("g"), "sketch"), "g")
        own = lambda n: F.pmod(F.xxhash64("g"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        here = ["token", "g", "n", "pos", "comp", "sketch"]
        # A row of the left and of the right block of one pair of blocks comes once, as a left one.
        dealt = held.select(*here, "outside", own("n_left").alias("li"), own("n_right").alias("rj"), "n_left", "n_right")
        lefts = dealt.where("outside").select(*here, F.col("li").alias("i"), every("n_right").alias("j"), F.lit(1).cast("byte").alias("left"))
        rights = dealt.select(*here, "outside", "li", every("n_left").alias("i"), F.col("rj").alias("j")).where("not outside or i <> li").select(*here, "i", "j", F.lit(0).cast("byte").alias("left"))
        key = ["token", "i", "j"]
        blocks = lefts.select(*key, "left", *here[1:]).union(rights.select(*key, "left", *here[1:]))
        found = cut(blocks.repartition(*key).sortWithinPartitions(*key, "g").mapInArrow(partial(_blocks, self.percent, nearest), "token long, a binary, b binary"))
        return cut(found.where("a is not null").select("a", "b").distinct()), cut(found.where("a is null").select("token").distinct())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: the id, n_shingles and component_id, the smallest id that links reach, itself included. Two
    documents link if 100 * intersection >= percent * union of their sets of word n-grams.

    A text with fewer words than an n-gram has one, of all its words. Null and empty texts, and those of white space, have none
    and are linked with nothing. Null ids keep their rows and links through them hold, but they are no component_id; a component
    of null ids has a null one. Repeated rows stay and are copies. Only the named columns are read. An empty table gives no rows.
    Texts of any length are read whole. N-grams are compared by 64-bit, sets by 128-bit hash.

    Copies and texts with equal sets are one set from the start, and no copies are paired. Which n-grams are rare is told by
    counters of a fixed number, which order them and change no result. In each bucket of sets that share a prefix n-gram all are
    compared to one head; then what lies outside the bucket's largest component to the others, nearest sketches first, in blocks
    of a bounded size. So no link between components is lost, and pairs become rows only if
    size, place and sketch allow a link that isn't there yet. Sketches that differ by b bits belong to sets that differ by b or more.
    """
    assert shingle >= 1 and 0 < percent <= 100 and counters & (counters - 1) == 0
    counters = min(counters, 1 << max(12, (256 * docs.count()).bit_length()))
    sc, text = docs.sparkSession.sparkContext, F.col(text_col)
    got = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    schema = f"id {got.schema['id'].dataType.simpleString()}, th long, digest binary, n long, segment int, counts binary"
    read = cut(got.mapInArrow(partial(_read, shingle, counters), schema))
    rows = read.where("segment is null").select("id", "th", "digest", "n")
    levels, size = np.zeros(counters, np.uint8), min(SEGMENT, counters)
    for r in read.where("segment is not null").select("segment", "counts").repartition("segment").mapInArrow(_levels, "segment int, level binary").toLocalIterator():
        levels[r.segment * size : r.segment * size + size] = np.frombuffer(r.level, np.uint8)
    shared = sc.broadcast(levels.tobytes())
    classes = cut(rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.min("th").alias("th")))
    sets = cut(got.select("text").mapInArrow(partial(_prefixes, shared, shingle, percent), "digest binary, n long, grp long, sketch binary, prefix array<long>"))
    members = cut(sets.select("digest", "n", "grp", "sketch").dropDuplicates(["digest"]))
    places = sets.select("grp", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "grp", "n", "pos")
    tokens = cut(places.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("token"))
    buckets = _few(places, "token", tokens.select(F.col("token").alias("seed"))).join(tokens, "token", "left_semi").distinct()
    # A group of several sets is a bucket of its own: its members have all of a prefix in common.
    many = cut(members.groupBy("grp").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.max("n").alias("n")).where("x < y").select("grp", "n"))
    buckets = cut(buckets.select("token", "grp", "n", F.col("pos").cast("int")).union(many.select(F.xxhash64("grp", F.lit("group")), "grp", "n", F.lit(0))))
    join = _Join(got, classes, members, shingle, percent)
    heads, pending = join.star(buckets)
    # A head with one set has met all others of its bucket, and in a bucket of two groups nothing is left to compare then.
    several = heads.join(many.select(F.col("grp").alias("head")).distinct(), "head", "left_semi").select(F.col("token").alias("t"))
    open_ = heads.join(cut(several), F.col("token") == F.col("t"), "left").where("groups > 2 or t is not null")
    open_ = cut(open_.select("token", F.when(F.col("t").isNull(), F.col("head")).alias("met")))
    left = cut(buckets.join(open_, "token").where("met is null or grp <> met").select("token", "grp", "n", "pos"))
    held = cut(join.mixed(left))
    for nearest in NEAREST:
        pairs, more = join.rest(held, nearest)
        # The first time with what the heads have left.
        join.verify(cut(join.apart(pairs if pending is None else pairs.union(pending).distinct())))
        pending = None
        if more.isEmpty():
            break
        join.components()
        held = cut(join.mixed(left.join(more, "token", "left_semi")))
    if join.links is not None:
        join.components()
        classes = classes.join(join.component.withColumnRenamed("g", "digest"), "digest", "left").withColumn("c", F.coalesce("c", "digest"))
        classes = cut(classes)
        least = cut(classes.groupBy("c").agg(F.min("first").alias("component_id")))
        classes = classes.join(least, "c").select("digest", "component_id")
    else:
        classes = classes.select("digest", F.col("first").alias("component_id"))
    linked = rows.where("n > 0").join(cut(classes), "digest").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op11_jaccard": op11_jaccard}
ORACLES = {
    "op11_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * common >= {PERCENT} * (n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS c FROM edge UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.c), s.doc_id)) AS component_id FROM s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
}
