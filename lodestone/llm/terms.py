"""Sums of a value per term over the terms of each document, where neither the terms nor the values fit in one machine.

Terms are counted once over all documents. The most frequent ones, up to a fixed number, are broadcast with their values; the
occurrences of all others, a small share in any language, are joined to theirs by a shuffle. No term is left out.

`extract` gives the terms of a text, repeats included: a list of str (kind string) or bytes (binary), or an array of int64
from 0 on (long).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most terms that are broadcast, and their most bytes.
HEAD, HEAD_BYTES = 1 << 18, 1 << 25
#: A task sends its counts on when it holds so many terms.
HELD = 1 << 18


def _binary(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.binary()


def _counted(extract: Callable[[bytes], list], kind: str, batches):
    """Counts of terms, those of training rows apart. Columns: train, text."""
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out():
        for train, found in held.items():
            n = pa.array(list(found.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), _binary(kind)), n, n if train else pa.array(np.zeros(len(found), np.int64))], ["term", "n", "n_train"])
            found.clear()

    for b in batches:
        for train, text in zip(b.column(0).to_pylist(), b.column(1)):
            held[train].update(extract(text.as_py() or b""))
            if len(held[True]) + len(held[False]) >= HELD:
                yield from out()
    yield from out()


def _merged(rows: list[np.ndarray]) -> np.ndarray:
    """Rows (term, n, n_train), terms ascending and distinct."""
    whole = np.concatenate([np.empty((0, 3), np.int64), *rows])
    whole = whole[np.argsort(whole[:, 0], kind="stable")]
    if not len(whole):
        return whole
    first = np.flatnonzero(np.r_[True, whole[1:, 0] != whole[:-1, 0]])
    return np.column_stack([whole[first, 0], np.add.reduceat(whole[:, 1], first), np.add.reduceat(whole[:, 2], first)])


def _counted_numbers(extract: Callable[[bytes], np.ndarray], kind: str, batches):
    whole, raw, size = np.empty((0, 3), np.int64), {True: [], False: []}, 0

    def taken_in():
        parts = [whole]
        for train, keys in raw.items():
            key, n = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
            parts.append(np.column_stack([key, n, n * train]))
            keys.clear()
        return _merged(parts)

    out = lambda x: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["term", "n", "n_train"])
    for b in batches:
        for train, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw[train].append(key := extract(text.as_py() or b""))
            if (size := size + len(key)) >= 8 * HELD:
                whole, size = taken_in(), 0
                if len(whole) >= 8 * HELD:
                    yield out(whole)
                    whole = whole[:0]
    yield out(taken_in())


def term_counts(docs: DataFrame, extract: Callable, text: str = "text", train: Column | None = None, kind: str = "binary") -> DataFrame:
    """(term, n, n_train): how often each term occurs in all rows and in those where `train` holds. Counted in each task first."""
    rows = docs.select((F.lit(True) if train is None else train).alias("train"), F.col(text).cast("binary").alias("text"))
    counted = _counted_numbers if kind == "long" else _counted
    return rows.mapInArrow(partial(counted, extract, kind), f"term {kind}, n long, n_train long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def frequent(values: DataFrame, names: list[str], limit: int = HEAD, most_bytes: int = HEAD_BYTES) -> tuple[list[bytes] | np.ndarray, np.ndarray]:
    """values: (term, n, *names). The terms above a frequency, at most `limit` of `most_bytes` bytes, and a row of values for
    each. All terms of one step of frequency come or none, so the choice doesn't depend on any order. Terms of over 256 bytes
    are left to the join."""
    long = F.octet_length(F.col("term").cast("string")) > 256
    values = values.where(~long)
    step = F.floor(8 * F.log2("n"))
    total, size, least = 0, 0, math.inf
    for row in sorted(values.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("term").cast("string"))).alias("size")).collect(), key=lambda x: -x["step"]):
        total, size = total + row["n"], size + row["size"]
        if total > limit or size > most_bytes:
            break
        least = row["step"]
    numeric = values.schema["term"].dataType.simpleString() == "bigint"
    if least == math.inf:
        return np.empty(0, np.int64) if numeric else [], np.empty((0, len(names)))
    got = values.where(step >= least).select("term", *names).toArrow()
    if numeric:
        key = got.column(0).to_numpy()
        order = np.argsort(key)
        return key[order], np.stack([got.column(n).to_numpy().astype(np.float64)[order] for n in names], axis=1)
    return got.column(0).to_pylist(), np.stack([got.column(n).to_numpy().astype(np.float64) for n in names], axis=1)


_built: dict = {}


def _head(shared) -> tuple[dict, np.ndarray]:
    """The places of the broadcast terms, looked up once in each worker, and their values."""
    terms, values = shared.value
    if _built.get("of") is not terms:
        _built["of"], _built["at"] = terms, {t: i for i, t in enumerate(terms)}
    return _built["at"], values


def _summed(shared, extract, names, kind, batches):
    """One row for each document with what the broadcast terms give, and one for each other term that it holds."""
    at, values = _head(shared)
    get = at.get
    for b in batches:
        row, term, freq, own, first = [], [], [], np.zeros((b.num_rows, len(names))), np.zeros(b.num_rows, np.int64)
        for i, text in enumerate(b.column("text")):
            found = Counter(extract(text.as_py() or b""))
            first[i] = len(row)
            row.append(i), term.append(f"\x00 {i}" if kind == "string" else b"\x00 %d" % i), freq.append(0)
            place, count = [], []
            for w, n in found.items():
                if (k := get(w)) is None:
                    row.append(i), term.append(w), freq.append(n)
                else:
                    place.append(k), count.append(n)
            if place:
                own[i] = np.asarray(count, np.float64) @ values[place]
        part = np.zeros((len(row), len(names)))
        part[first] = own
        take = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "rid", "size")), pa.array(term, _binary(kind)), pa.array(freq, pa.int64()), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(len(names)))], ["id", "rid", "size", "term", "freq", *(f"part_{n}" for n in names)])


def _summed_numbers(shared, extract, names, kind, batches):
    keys, values = shared.value
    for b in batches:
        row, term, freq, part = [], [], [], []
        for i, text in enumerate(b.column("text")):
            key, n = np.unique(extract(text.as_py() or b""), return_counts=True)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            own = np.zeros((1 + len(key) - int(known.sum()), len(names)))
            own[0] = n[known] @ values[at[known]]
            row.append(np.full(len(own), i, np.int32)), term.append(np.r_[np.int64(-1 - i), key[~known]]), freq.append(np.r_[np.int64(0), n[~known]]), part.append(own)
        if row:
            take, part = pa.array(np.concatenate(row)), np.concatenate(part)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "rid", "size")), pa.array(np.concatenate(term)), pa.array(np.concatenate(freq)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(len(names)))], ["id", "rid", "size", "term", "freq", *(f"part_{n}" for n in names)])


def sums(docs: DataFrame, extract: Callable, values: DataFrame, missing: dict[str, Column], limit: int = HEAD) -> DataFrame:
    """docs: (id, rid, size, text binary), rid a hash of the text. values: (term, n, *names), names being those of `missing`.
    One row per row of docs: id, rid, size, *names, the sums of the values over all terms of the text, repeats counted.

    A term without values counts what `missing` says. Equal rows are summed together and given back as often as they came.
    """
    names = list(missing)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(values, names, limit))
    term = values.schema["term"].dataType.simpleString()
    kind = f"id {docs.schema['id'].dataType.simpleString()}, rid long, size long, term {term}, freq long, " + ", ".join(f"part_{n} double" for n in names)
    rows = docs.select("id", "rid", "size", "text").mapInArrow(partial(_summed_numbers if term == "bigint" else _summed, shared, extract, names, term), kind)
    # A document's own row has a term that no text has; its place in the batch spreads these rows over the join's partitions.
    rows = rows.join(values.select("term", *names), "term", "left")
    total = {n: F.sum(F.col(f"part_{n}") + F.when(F.col("freq") > 0, F.col("freq") * F.coalesce(F.col(n), m)).otherwise(0.0)) for n, m in missing.items()}
    out = rows.groupBy("id", "rid", "size").agg(F.sum((F.col("freq") == 0).cast("int")).alias("copies"), *(v.alias(n) for n, v in total.items()))
    return out.select("id", "rid", "size", *((F.col(n) / F.col("copies")).alias(n) for n in names), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")
