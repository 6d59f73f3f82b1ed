"""Each stage against a brute-force version, over documents whose other columns have names that the stages might use."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from lodestone.llm import op1_decontaminate as op1
from lodestone.llm.common import cut

CLASHING = ["_id", "_hash", "_source", "_text", "_row", "rid", "row", "own", "kept", "before", "id_", "hash_", "host_", "gone_", "target", "Copies", "key", "th"]
SPACES = " \t\n\x0b\x0c\r"


def lower(x):
    return x.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    line, menu, item = words(10), words(12), words(30)
    out = [(i, f"{words(rng.randint(30, 90))}\n{words(20)}" + (f"\n{line}" if i % 5 == 0 else "") + (f"\n  {menu.upper()}" if i % 3 == 0 else ""), f"s{i % 4 if i % 9 else 0}") for i in range(90)]
    base = words(120)
    out += [(200 + i, base, "s1") for i in range(5)] + [(210, words(70) + " " + item, "s2"), (211, f"{words(60)}\n{item}\n{words(30)}", None)]
    out += [out[1], out[1], (None, words(80), "s1"), (None, None, None), (300, "", "s3"), (301, None, "s0"), (302, "short text", "s0"), (303, (words(4) + " ") * 40, "s2")]
    return out, item


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows[0]], "doc_id long, text string, source string, n_chars long")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars", *(F.lit(7).alias(x) for x in CLASHING)).repartition(3).cache()


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality_stage(spark, docs, rows):
    words = lambda t: (t or "").encode().split()
    key = lambda x: lower(" ".join(w.decode() for w in x.encode().split()))
    held, hosts = defaultdict(set), defaultdict(set)
    for n, (i, t, s) in enumerate(rows[0]):
        doc = i if i is not None else ("text", t)
        hosts[s].add(doc)
        for x in (t or "").split("\n"):
            if words(x):
                held[s, key(x)].add((doc, i))
    common = {k: min((i for _, i in v if i is not None), default=None) for k, v in held.items() if len({d for d, _ in v}) > 5 and len({d for d, _ in v}) > 0.1 * len(hosts[k[0]])}
    assert common
    want = Counter()
    for i, t, s in rows[0]:
        w = words(t)
        sh = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + x for k in range(len(w) - 2) if sh[tuple(w[k : k + 3])] > 1 for x in range(3)}
        ls = (t or "").split("\n")
        gone = [words(x) and (s, key(x)) in common and common[s, key(x)] != i for x in ls]
        n = sum(len(words(x)) for x, g in zip(ls, gone) if g)
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and not (n and (len(w) - n < 0.3 * len(w) or len(w) - n < 50)):
            left = "\n".join(x for x, g in zip(ls, gone) if not g)
            want[i, left, s, len(left)] += 1
    out = c.quality(spark, docs, "")
    assert out.columns == docs.columns and multiset(out, "doc_id", "text", "source", "n_chars") == want


def test_lines_stage(spark, docs, rows):
    key = lambda x: lower(x.strip(SPACES))
    held = defaultdict(set)
    for i, t, _ in rows[0]:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    top = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in held.items() if len(v) >= 5}
    assert len(top) > 1
    want = Counter()
    for i, t, s in rows[0]:
        left = t if t is None else "\n".join(x for x in t.split("\n") if key(x) not in top or top[key(x)] == i)
        want[i, left, s, len(left or "")] += 1
    out = c.lines(spark, docs, "")
    assert out.columns == docs.columns and multiset(out, "doc_id", "text", "source", "n_chars") == want


def test_near_dedup_stage(spark, docs, rows):
    import xxhash

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t, _ in rows[0]]
    label = list(range(len(prints)))
    for _ in range(4):
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, (i, t, s) in zip(label, rows[0]):
        least[k] = min(least.get(k, (True, 0, None, None)), (i is None, i or 0, t, s), key=lambda x: x[:2])
    out = c.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert multiset(out, "doc_id") == Counter((None if n else i,) for n, i, _, _ in least.values())


def test_decontamination_stage(spark, docs, rows, tmp_path):
    item = rows[1]
    spark.createDataFrame([(1, item), (2, "a b"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = lambda t: sum(n for *_, n in op1.tiles(op1.words_of(item), op1.words_of(t))) >= 0.5 * len(item.split())
    want = Counter((i, t) for i, t, _ in rows[0] if not leaks(t))
    out = c.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and multiset(out, "doc_id", "text") == want and sum(want.values()) == len(rows[0]) - 2


def test_mixture_stage(spark, docs, rows):
    out = c.mixture(spark, docs, "")
    assert out.columns == [x for x in docs.columns if x.lower() not in c.ADDED] + list(c.ADDED)
    got, size = out.collect(), Counter()
    for _, t, s in rows[0]:
        size[s] += len((t or "").encode().split())
    # Targets by plain water filling.
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if 2 * size[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        budget -= sum(2.0 * size[s] for s in over)
        free -= over
    taken, have = Counter(), Counter((i, t) for i, t, _ in rows[0])
    assert not Counter((r.doc_id, r.text) for r in got) - have
    for r in got:
        assert r.size == len(r.text.split()) and r.taken == r.copies * r.size and 1 <= r.copies <= 2 and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len((t or "").split()) for _, t, x in rows[0] if x == s)
    assert multiset(c.mixture(spark, docs.repartition(5), ""), "doc_id", "copies") == Counter((r.doc_id, r.copies) for r in got)


def test_pipeline_stage_by_stage(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for i, (_, stage) in enumerate(c.STAGES):
        docs = cut(stage(spark, docs, d))
        seen.append(docs.count())
        assert docs.columns[: len(columns)] == columns and (i == 4 or len(docs.columns) == len(columns))
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[1] and seen[-1] > 0.3 * seen[0]
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        empty = cut(stage(spark, empty, d))
    assert empty.count() == 0
