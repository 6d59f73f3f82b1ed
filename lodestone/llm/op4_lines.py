"""Line dedup with two Bloom filters.

A first pass notes in one filter the keys seen once and in another those seen twice. Each task builds both for its own rows;
merged, a bit pattern that two tasks hold counts as seen twice. Only lines whose key passes the second filter are shuffled,
grouped by the key itself, counted exactly and given the document that keeps them. A false positive costs a shuffled row and
never changes the result. The filters have bits in proportion to the text, up to a number, so what is sent to the tasks is
bounded for any input; beyond it more lines are shuffled. Of the texts only those that lose a line are shuffled.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, cut, mixed, table
from lodestone.llm.op1_decontaminate import seed_filter

#: The most bits of a filter, a power of two: 2**28 are 32 MB. Once they fill up, more lines are shuffled.
BITS = 1 << 28
#: Bytes of text for each bit of a filter.
BIT_BYTES = 8
#: Bytes of a filter that are merged at once.
SEGMENT = 1 << 16
MIN_CHARS, MIN_DOCS = 40, 5
_SPACES = SPACES.encode()


def line_keys(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has at least min_chars code points."""
    out = []
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(_SPACES).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf8", "replace")) >= min_chars):
                out.append((i, key))
    return out


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit numbers for each hash."""
    return np.stack([h & np.uint64(bits - 1), mixed(h) & np.uint64(bits - 1)]).astype(np.int64)


class Seen:
    """The filters of one task: bytes, one per bit while it fills them."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def _has(self, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (which[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def _put(self, which: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(which, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def add(self, h: np.ndarray) -> None:
        """Hashes may repeat within a call: then they count as seen twice."""
        a, b = places(h, self.bits)
        old = self._has(self.once, a) & self._has(self.once, b)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        again |= old
        for at in (a, b):
            self._put(self.twice, at[again])
            self._put(self.once, at)

    def has_twice(self, h: np.ndarray) -> np.ndarray:
        a, b = places(h, self.bits)
        return self._has(self.twice, a) & self._has(self.twice, b)


def _build(bits: int, min_chars: int, batches):
    seen = Seen(bits)
    for b in batches:
        for i in range(0, b.num_rows, 512):
            seen.add(hashes([k for t in b.column(0)[i : i + 512] for k in {k for _, k in line_keys(t.as_py(), min_chars)}]))
    size = min(SEGMENT, bits // 8)
    for i in range(0, bits // 8, size):
        once, twice = seen.once[i : i + size], seen.twice[i : i + size]
        if once.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // size]), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["segment", "once", "twice"])


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one segment: the bits that any task has twice or two tasks have once."""
    once = twice = None
    for b in batches:
        for a, c in zip(b.column("once"), b.column("twice")):
            a, c = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(c.as_py(), np.uint8)
            once, twice = (a.copy(), c.copy()) if once is None else (once | a, twice | c | once & a)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([twice.tobytes()])], ["segment", "twice"])


def twice_filter(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> bytes:
    """The merged filter of keys seen twice: bits / 8 bytes on the driver, however large docs is.

    As many tasks as the cluster has cores read docs, so what they send to be merged follows the cluster and not the input.
    """
    parts = docs.select("text").coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(partial(_build, bits, min_chars), "segment long, once binary, twice binary")
    whole, size = np.zeros(bits // 8, np.uint8), min(SEGMENT, bits // 8)
    for row in parts.groupBy("segment").applyInArrow(_merge, "segment long, twice binary").collect():
        whole[row.segment * size : row.segment * size + size] = np.frombuffer(row.twice, np.uint8)
    return whole.tobytes()


def _suspects(shared, bits: int, min_chars: int, batches):
    seen = Seen(8)
    seen.bits, seen.twice = bits, np.frombuffer(shared.value, np.uint8)
    for b in batches:
        rid, ids, at, keys = [], [], [], []
        for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if found := line_keys(t.as_py(), min_chars):
                for (i, k), yes in zip(found, seen.has_twice(hashes([k for _, k in found]))):
                    if yes:
                        rid.append(r), ids.append(d), at.append(i), keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, b.schema.field(1).type), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], ["rid", "id", "line", "key"])


def _passed(shared, bits: int, changed: bool, batches):
    """The rows whose document may lose lines, or those that certainly lose none. Columns: id, rid, text."""
    mask = np.frombuffer(shared.value, np.uint8)
    for b in batches:
        at = b.column(1).to_numpy().view(np.uint64) & np.uint64(bits - 1)
        may = (mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        yield b.filter(pa.array(may == changed))


def _whole(shared, bits: int, batches):
    for b in _passed(shared, bits, False, batches):
        total = [((t.as_py() or b"").count(b"\n") + 1) for t in b.column(2)]
        kept = pc.fill_null(b.column(2), b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(np.zeros(b.num_rows, np.int64)), kept], ["id", "rid", "n_lines", "n_dropped", "kept"])


def _drop(batches):
    for b in batches:
        total, dropped, kept = [], [], []
        for t, gone in zip(b.column("text"), b.column("gone")):
            lines = (t.as_py() or b"").split(b"\n")
            gone = set(gone.as_py() or ())
            total.append(len(lines)), dropped.append(len(gone))
            kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t.as_py() or b"")
        columns = [c for n, c in zip(b.schema.names, b.columns) if n not in ("text", "gone")]
        names = [n for n in b.schema.names if n not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_lines", "n_dropped", "kept"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, changed_only: bool = False) -> DataFrame:
    """One row per row of docs: id, row_hash (xxhash64 of id and text), n_lines, n_dropped, kept_text (string).

    A line's key is the line stripped of white space and with A-Z lower-cased; keys of at least min_chars code points in at
    least min_docs documents (ids) go, but in the document with the largest id that holds them. Repeated rows of an id count as
    one document and fare alike. All null ids count as one document, smaller than all others. A null or empty text is one empty line. Other columns aren't read. An
    empty table gives no rows. A document of any length is one row; its lines are cut once. bits: of the filters, by the size
    of the text if None. changed_only: only the rows that lose a line.
    """
    spark = docs.sparkSession
    got = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if bits is None:
        size = got.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = min(BITS, 1 << max(16, (size // BIT_BYTES).bit_length()))
    shared = spark.sparkContext.broadcast(twice_filter(got, bits, min_chars))
    kind = got.schema["id"].dataType.simpleString()
    suspects = cut(got.mapInArrow(partial(_suspects, shared, bits, min_chars), f"rid long, id {kind}, line int, key binary"))
    # Written before it is joined: Spark broadcasts it by its size, or splits a line with most rows.
    repeated = cut(suspects.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs))
    gone = suspects.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("rid", F.col("id").alias("of")).agg(F.collect_set("line").alias("gone"))
    gone = cut(gone)
    few = min(1 << 26, 1 << max(16, (16 * gone.count()).bit_length()))
    mask = spark.sparkContext.broadcast(seed_filter(gone.select(F.col("rid").alias("seed")), few))
    schema = f"id {kind}, rid long, n_lines long, n_dropped long, kept binary"
    rows = got.select("id", "rid", "text")
    may = rows.mapInArrow(partial(_passed, mask, few, True), f"id {kind}, rid long, text binary").join(gone.withColumnRenamed("rid", "own"), (F.col("rid") == F.col("own")) & F.col("id").eqNullSafe(F.col("of")), "inner" if changed_only else "left")
    out = may.select("id", "rid", "text", "gone").mapInArrow(_drop, schema)
    if not changed_only:
        out = out.union(rows.mapInArrow(partial(_whole, mask, few), schema))
    return out.select(F.col("id").alias(id_col), F.col("rid").alias("row_hash"), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, coalesce(r.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
