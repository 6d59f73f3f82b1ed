"""How far the sources of a language lie apart, by the words that they use.

Terms with the same counts in every source have the same share of every distance. So the terms of a language are grouped by their
sparse vector of (source, count); each pair of sources is evaluated once for a distinct vector and counts as often as there are
terms with it. Only the terms that tell a source from its language are named again.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: A task sends its counts on when it holds so many.
HELD = 1 << 18
#: Cells (vectors by sources) of a block, and the sources whose pairs one task evaluates.
CELLS, SLICE = 1 << 18, 256
#: Letters of A-Z become small, other ASCII is blank, what isn't ASCII stays.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def _counted(most: int, batches):
    """Columns: lang, source, text. Occurrences of each term and the rows that hold it, summed over what the task has read."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms_of(text.as_py() or b"")
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size >= most:
                yield from out()
                size = 0
    yield from out()


def smoothed(count: np.ndarray, n: np.ndarray, v: int, prior: int = PRIOR, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + prior) / (n + prior * v)), exact."""
    if int(count.max(initial=0)) + prior >= 2**62 // scale:
        count, n = count.astype(object), n.astype(object)
    return (1 + scale * (count + prior) // (n + prior * v)).astype(np.int64)


def _evaluated(prior: int, scale: int, top: int, vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """vectors: lang, block, slice, vec, m, first. groups: lang, block, slice, source, n, v, sources; all sources of the
    language, those of the slice first said by `mine`. Rows of pairs (first null) and of the vectors that tell most."""
    lang, v = groups.column("lang")[0].as_py(), groups.column("v")[0].as_py()
    names, n = groups.column("source").combine_chunks(), groups.column("n").to_numpy()
    mine, m, r = np.flatnonzero(groups.column("mine").to_numpy(zero_copy_only=False)), vectors.column("m").to_numpy().astype(np.int64), vectors.num_rows
    count = np.zeros((r, len(names)), np.int64)
    if r:
        vec = vectors.column("vec").combine_chunks()
        entry, at = vec.flatten(), np.repeat(np.arange(r), vec.value_lengths().to_numpy())
        count[at, pa.compute.index_in(entry.field("source"), names).to_numpy()] = entry.field("n").to_numpy()
    v = max(v, 1)  # without terms there is nothing to sum
    p = smoothed(count, n[None, :], v, prior, scale)
    plain = smoothed(np.zeros(len(names), np.int64), np.where(n < 0, 0, n), v, prior, scale)
    q = smoothed(count.sum(axis=1), np.full(r, int(n.sum())), v, prior, scale)
    first = vectors.column("first").to_pylist()
    utf8 = np.argsort(np.array([x.encode() for x in first], object), kind="stable")
    place = np.empty(r, np.int64)
    place[utf8] = np.arange(r)
    out: list[tuple] = []
    for i in mine.tolist():
        rows = np.flatnonzero(count[:, i])
        # Against the distance that sources without the term have.
        rest = np.abs(plain[i] - plain)
        more = m[rows, None] * (np.abs(p[rows][:, [i]] - p[rows]) - rest)
        own, other = more.sum(axis=0) + int(m.sum()) * rest, (more * (count[rows] == 0)).sum(axis=0)
        for j in range(len(names)):
            if j != i:
                out += [(i, j, None, int(own[j])), (j, i, None, int(other[j]))]
        f = p[rows, i] - q[rows]
        told = np.flatnonzero(f > 0)
        told = told[np.lexsort((place[rows[told]], -f[told]))][:top]
        out += [(i, None, first[rows[x]], int(f[x])) for x in told.tolist()]
    here = lambda k: pa.array([x[k] for x in out], pa.int32())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": names.take(here(0)), "item": names.take(here(1)), "first": pa.array([x[2] for x in out], pa.string()), "value": pa.array([x[3] for x in out], pa.int64())})


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source from each other of its language (part pair), and the
    terms that it uses more than its language does, the first `top` (part term).

    A null lang, source or text counts as ''. A row is a document: repeated rows count each, ids aren't read, nor any column but
    the named ones. A source without a kept term is a group like others; a language without one gives pairs of value 0; one with a
    single source gives no pairs. Values are exact; equal ones are ranked by the item's UTF-8. An empty table gives no rows. Texts
    may be of any length. Counts are summed in each task before the shuffle, so a source, language or term may hold most rows.
    Distinct vectors are dealt to blocks of a bounded number of cells; to each come the sizes of the sources of its language,
    as many as a group of the result has rows. No pair of sources is emitted for a vector, only the sums of a block.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(partial(_counted, HELD), "lang string, source string, term string, n long, docs long")
    # One shuffle, by (lang, term), serves both sums.
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = found.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = cut(kept.select("lang", "term", "vec"))
    vectors = cut(kept.groupBy("lang", "vec").agg(F.count("*").alias("m"), F.min("term").alias("first")))
    sizes = vectors.select("lang", "m", F.explode("vec").alias("x")).groupBy("lang", "x.source").agg(F.sum(F.col("m") * F.col("x.n")).alias("n"))
    groups = rows.select("lang", "source").distinct().join(cut(sizes), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = cut(groups)
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.count("*").alias("vectors")), "lang", "left").na.fill(0, ["v", "vectors"])
    blocks, slices = F.greatest(F.lit(1), F.ceil(F.col("vectors") * F.col("sources") / CELLS)).cast("int"), F.ceil(F.col("sources") / SLICE).cast("int")
    of_lang = cut(of_lang.select("lang", "v", blocks.alias("blocks"), slices.alias("slices")))
    key = ["lang", "block", "slice"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = vectors.join(of_lang, "lang").select("lang", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int").alias("block"), "vec", "m", "first", every("slices").alias("slice"))
    sides = groups.join(of_lang, "lang").select("lang", "source", "n", "v", "slices", every("blocks").alias("block")).select("lang", "source", "n", "v", "slices", "block", every("slices").alias("slice"))
    sides = sides.withColumn("mine", F.pmod(F.xxhash64("source"), F.col("slices")) == F.col("slice")).drop("slices")
    got = dealt.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(partial(_evaluated, prior, scale, top), "lang string, source string, item string, first string, value long")
    got = cut(got)
    ranked = lambda by: F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), by))
    pairs = got.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked("item").alias("rank"))
    # A vector after `top` others, by value and least term, has `top` terms before its own.
    told = cut(got.where("item is null").withColumn("rank", ranked("first")).where(F.col("rank") <= top).select("lang", "source", "first", "value"))
    chosen = cut(vectors.join(told.select("lang", "first").distinct(), ["lang", "first"], "left_semi").select("lang", "vec", "first"))
    least = kept.join(chosen, ["lang", "vec"]).withColumn("place", F.row_number().over(W.partitionBy("lang", "first").orderBy("term"))).where(F.col("place") <= top)
    terms = told.join(least.select("lang", "first", "term"), ["lang", "first"]).withColumn("rank", ranked("term")).where(F.col("rank") <= top)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS cnt, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.n + {PRIOR} * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
whole AS (SELECT f.lang, f.term, 1 + ({SCALE}::HUGEINT * (sum(f.cnt) + {PRIOR})) // (any_value(t.n) + {PRIOR} * any_value(v.v)) AS q
  FROM f JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) t ON t.lang = f.lang GROUP BY f.lang, f.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT f.lang, f.source, f.term AS item, f.p - w.q AS value FROM f JOIN whole w ON w.lang = f.lang AND w.term = f.term WHERE f.cnt > 0 AND f.p > w.q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}""",
}
