"""Operators 11 to 13 against brute force, and their odd inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import op11_jaccard, op12_divergence, op13_whiten
from lodestone.llm.op11_jaccard import jaccard_join, near_in_block, ngram_set, prefix_length, sketch_of
from lodestone.llm.op12_divergence import source_divergence
from lodestone.llm.op13_whiten import jacobi, whiten

DOCS = "doc_id long, text string, lang string, source string"


def divergence(rows, min_docs, top=50, prior=5, scale=10**9):
    """All sources of a language against each other, term by term."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for own, source, words in docs:
            if own == lang:
                df.update(set(words))
                counts[source].update(words)
        kept = {t for t, n in df.items() if n >= min_docs}
        for source in counts:
            counts[source] = {t: n for t, n in counts[source].items() if t in kept}
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        share = lambda c: (lambda n: {t: 1 + scale * (c.get(t, 0) + prior) // (n + prior * len(kept)) for t in kept})(sum(c.values()))
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s))
            terms = sorted(((q[t] - p[s][t], t.encode()) for t in kept if counts[s].get(t) and p[s][t] > q[t]))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed,cells,held", [(1, 1 << 18, 1 << 18), (2, 64, 40), (3, 16, 8)])
def test_divergence_against_brute_force(spark, monkeypatch, seed, cells, held):
    rnd = random.Random(seed)
    monkeypatch.setattr(op12_divergence, "CELLS", cells)
    monkeypatch.setattr(op12_divergence, "SLICE", 4 if seed > 1 else 256)
    monkeypatch.setattr(op12_divergence, "HELD", held)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ä", "é", "ÉA", "zß", "日本"]
    rows = [(i % 70, " ".join(rnd.choices(words, [1 / (1 + k) for k in range(len(words))], k=rnd.randint(0, 40))), rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "b", "ä", "c", "d", "e", "f", None])) for i in range(200)]
    rows += [(1000 + i, "Equal words-here, 12 TERMS", "en", "hot") for i in range(100)]  # one source, all alike
    rows += [(None, None, "fr", "x"), (None, "", "fr", "y"), (7, "once only", "fr", "z"), (8, "alone", "single", "s")]
    got = source_divergence(spark.createDataFrame(rows, DOCS), min_docs=4, top=5).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == divergence(rows, 4, 5)


def test_divergence_of_long_texts_and_terms_alike(spark):
    # 400 terms with one vector: the first of them by UTF-8 are named, and all count in the distances.
    alike = " ".join(f"t{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")
    rows = [(1, alike * 1 + " common" * 50_000, "en", "a"), (2, "common other", "en", "b"), (3, "common common", "en", "c")]
    got = source_divergence(spark.createDataFrame(rows, DOCS), min_docs=1).collect()
    assert {tuple(r) for r in got} == divergence(rows, 1)


def test_divergence_of_nothing_and_with_other_columns(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, f"word here {i}", "en", "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    plain = {tuple(r) for r in source_divergence(docs).collect()}
    clash = docs.selectExpr("*", "1 as term", "2 as n", "3 as vec", "4 as m", "5 as block", "6 as value", "7 as rank", "8 as item", "9 as docs")
    assert {tuple(r) for r in source_divergence(clash).collect()} == plain == divergence(rows, 30)


def test_shares_are_exact_beyond_64_bits():
    count, n = np.array([[10**12, 3]]), np.array([[10**13, 7]])
    assert op12_divergence.smoothed(count, n, 3).tolist() == [[1 + 10**9 * (10**12 + 5) // (10**13 + 15), 1 + 10**9 * 8 // 22]]


VECTORS = "vec_id long, embedding array<float>, label int"


def _expected(vectors):
    """x of each row, n, S, eigenvalues and vectors of the distinct x."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(s, float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], u[:, ::-1], centred


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 12)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.5, 0.2, 0.1, 0.1, 0.05, 0.02, 0.01]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]).astype(np.float32)
    vectors = [*base.tolist(), *[base[7].tolist()] * 400]  # a hot vector counts once in the fit
    odd = [(None, None, 0), (1, [], 0), (2, [None] * 12, 0), (3, [math.nan] * 12, 0), (4, [math.inf, *[0.0] * 11], 0), (5, [1.0] * 5, 0)]
    rows = [(i if i % 50 else None, v, 1) for i, v in enumerate(vectors)]
    got = whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(7)).collect()
    x, n, s, e, u, _ = _expected(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n} and n <= 300
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        by[r.vec_id][r.component].append(r)
    for k in range(4):
        want = [(np.array(v) - np.array(s) / n) @ u[:, k] / math.sqrt(e[k]) for v in x]
        sign = 1.0 if by[1][k + 1][0].whitened * want[1] > 0 else -1.0
        for i, w in enumerate(want):
            if i % 50:
                (r,) = by[i][k + 1]
                assert r.whitened == pytest.approx(sign * w, abs=1e-9)
                assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[i], s))
                assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-10)
    assert len(by[None][1]) == len(vectors) // 50
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_jacobi_keeps_small_eigenvalues():
    # A scaled matrix: eigenvalues over 16 powers of ten, each right to its own size.
    scale = np.diag(10.0 ** -np.arange(0, 9))
    rng = np.random.default_rng(1)
    core = np.eye(9) + 0.05 * (lambda m: m + m.T)(rng.normal(size=(9, 9)))
    e, u = jacobi(scale @ core @ scale)
    assert np.all(e > 0) and np.all(np.diff(e) <= 0)
    assert np.allclose(u.T @ u, np.eye(9), atol=1e-13)
    assert np.prod(e) == pytest.approx(np.linalg.det(core) * np.prod(np.diag(scale) ** 2), rel=1e-9)
    rest = (u.T @ (scale @ core @ scale) @ u) - np.diag(e)
    assert np.abs(rest).max() < 1e-14
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitening_of_few_equal_and_no_vectors(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 1)], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    alike = whiten(spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(5)], VECTORS)).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike} == {(k, 1, 0, None, None, None) for k in (1, 2)}
    # A constant dimension: its component has no variance; the others are whitened.
    flat = whiten(spark.createDataFrame([(i, [i / 8, 0.5], 1) for i in range(9)], VECTORS)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None} and {r.explained for r in flat if r.component == 1} == {1.0}
    assert flat[0].identity_error < 1e-12


def test_whitening_beyond_long_and_with_other_columns(spark):
    big = whiten(spark.createDataFrame([(1, [1e12, 0.0], 1), (2, [-1e12, 1.0], 1), (3, [1.0, 1e30], 1)], VECTORS)).collect()
    assert {r.deviation for r in big} == {None} and len(big) == 6
    # Saturated ends of a long.
    assert op13_whiten.GRID == 256
    docs = spark.createDataFrame([(i, [i / 8, i * i / 64], 1) for i in range(9)], VECTORS)
    clash = docs.selectExpr("*", "1 as id", "2 as x", "3 as ok", "4 as n", "5 as component", "6 as d")
    told = lambda df: sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in whiten(df).collect())
    assert told(clash) == told(docs) and len(told(docs)) == 18


def joined(texts, k=3, percent=90):
    """(number of n-grams, component) of each text, all compared with all. The component is the least index."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def changed(rnd, base, n):
    out = base[:]
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"n{rnd.randrange(10**6)}"
    return " ".join(out)


def near_texts(seed):
    """Clusters about the threshold, chains, boilerplate that most share, copies, short, empty and null texts."""
    rnd = random.Random(seed)
    word = lambda n, kinds: [f"w{rnd.randrange(kinds)}" for _ in range(n)]
    texts: list = []
    for size, count, most in ((300, 60, 10), (60, 40, 3), (1500, 12, 60), (25, 30, 1)):
        base = word(size, 5000)
        texts += [changed(rnd, base, rnd.randint(0, most)) for _ in range(count)]
    chain = word(200, 5000)
    for _ in range(40):
        texts.append(" ".join(chain))
        at = rnd.randrange(195)
        chain = chain[:at] + [f"c{rnd.randrange(10**6)}"] + chain[at + 1 :]
    hot = word(80, 5000)
    texts += [" ".join(hot + word(rnd.randint(1, 12), 50)) for _ in range(60)]
    texts += [" ".join(word(rnd.randint(1, 12), 3)) for _ in range(80)]
    texts += [" ".join(word(rnd.randint(20, 200), 60)) for _ in range(60)]
    texts += ["same Text here " * 9, "SAME text here " * 9, "same text here  \n" * 12] * 20
    texts += [None, "", " \t\n", "one", "ONE", "one two", "one\x0btwo", "one two three", "\u00c9a b c", "\u00e9a b c", " ".join(word(20_000, 10**6))]
    rnd.shuffle(texts)
    return texts


def components_of(rows):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed,block,nearest", [(1, 2048, (8, None)), (2, 3, (1, 2, None)), (3, 7, (1, None))])
def test_jaccard_join_against_brute_force(spark, monkeypatch, seed, block, nearest):
    for name, x in (("BLOCK", block), ("NEAREST", nearest)):
        monkeypatch.setattr(op11_jaccard, name, x)
    texts = near_texts(seed)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(5)
    got = components_of(jaccard_join(docs, counters=1 << 12).collect())
    assert got == [(i, n, c) for i, (n, c) in enumerate(joined(texts))]
    assert len({c for _, _, c in got}) < 0.7 * len(texts)


def test_jaccard_join_of_other_sizes_and_thresholds(spark):
    texts = near_texts(9)[:200]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    got = components_of(jaccard_join(docs, shingle=2, percent=60).collect())
    assert got == [(i, n, c) for i, (n, c) in enumerate(joined(texts, 2, 60))]


def test_jaccard_join_of_nothing_null_ids_and_other_columns(spark):
    assert jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard_join(spark.createDataFrame([(5, None, None, None), (None, "", None, None)], DOCS)).collect() == [(5, 0, 5), (None, 0, None)]
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(None, a, "en", "s"), (9, a + " more", "en", "s"), (4, a + " more still", "en", "s"), (4, a + " more still", "en", "s"), (None, "alone here now", "en", "s"), (None, "alone here now", "en", "s"), (7, "other", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as th", "2 as digest", "3 as n", "4 as grp", "5 as token", "6 as id", "7 as c", "8 as component_id")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs).collect())
    assert got == {(None, 98, 4): 1, (9, 99, 4): 1, (4, 100, 4): 2, (None, 1, None): 2, (7, 1, 7): 1}


def test_filters_of_the_join_lose_nothing():
    rnd = random.Random(4)
    for _ in range(300):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(1, 150))]
        a, b = (ngram_set(changed(rnd, base, rnd.randint(0, 4)).encode()) for _ in range(2))
        common = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(sketch_of(s), np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * common
        if 100 * common >= 90 * (len(a) + len(b) - common):
            assert np.intersect1d(a[: prefix_length(len(a))], b[: prefix_length(len(b))]).size  # the order is that of the hashes
            n, pos = np.array([len(a), len(b)]), np.array([0, 0])
            i, j, more = near_in_block(n, pos, np.array([0, 1]), np.array([1, 0]), np.stack([x, y]), 90, 1)
            assert (i.tolist(), j.tolist(), more) == ([0], [1], False)
