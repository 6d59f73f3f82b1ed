"""Each operator against a brute-force version, and on nulls, empty and repeated rows, ties, empty tables and clashing names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import op1_decontaminate as op1
from lodestone.llm import op2_simhash as op2
from lodestone.llm import op3_mix as op3
from lodestone.llm import op4_lines as op4
from lodestone.llm import op5_tokens as op5
from lodestone.llm import op6_language as op6
from lodestone.llm import op7_quality as op7
from lodestone.llm import op8_passages as op8
from lodestone.llm import op9_urls as op9
from lodestone.llm import op10_ppm as op10
from lodestone.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, copies int, id string"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared lines, nulls, empty and repeated rows and one long text."""
    rng = random.Random(11)
    line = words(rng, 12)
    out = []
    for i in range(60):
        lines = [words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"  {line.upper() if i % 8 else line}\t")
        out.append((i, "\n".join(lines), "en", "src0" if i % 3 else "src1"))
    base = words(rng, 300)
    out += [(100 + i, base if i < 6 else base + f" extra{i}", "en", "src0") for i in range(10)]
    out += [(200, None, None, None), (201, "", "en", "src2"), (202, " \t\n", "en", "src2"), (203, "--- 12 ***", "en", "src1"), (204, words(rng, 9000), "en", "src1")]
    out += [out[0], out[0], (None, out[1][1], "en", "src0"), (None, None, None, None)]
    return [(*x, len(x[1] or ""), "f", 1, "i") for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df):
    return Counter(map(tuple, df.collect()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400 + i) for i in range(1, 50)]
    least = {}
    for u, v in edges:
        least.setdefault(u, u), least.setdefault(v, v)
    for _ in range(400):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in least.items() if any(k in e for e in edges if e[0] != e[1])}


def simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def test_simhash(docs, empty, rows):
    prints = [(r[0], simhash(r[1])) for r in rows]
    label = list(range(len(prints)))
    for _ in range(5):
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (d, _), c in zip(prints, label):
        least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
    want = Counter((d, f"{f:016x}", least[c]) for (d, f), c in zip(prints, label))
    assert multiset(op2.simhash_near_dedup(docs)) == want
    assert op2.simhash_near_dedup(empty).count() == 0


def test_covering_masks_miss_no_pair():
    rng, masks = random.Random(4), op2.covering_masks()
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        hit = [m for m in masks if not diff & m]
        assert hit and all(any(not diff & f for f in op2.finer_masks(m)) for m in hit)


def test_simhash_deals_out_large_buckets(spark):
    rng = random.Random(6)
    fps = sorted({sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.component for r in connected_components(op2.near_links(df, bucket=64)).collect()}
    assert found == {min(fps)}


def lines_brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(r[0])
    top = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in held.items() if len(v) >= 5}
    for r in rows:
        ls = (r[1] or "").split("\n")
        kept = [x for x in ls if key(x) not in top or top[key(x)] == r[0]]
        yield r[0], len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("bits", [None, 1 << 10])
def test_line_dedup(docs, rows, empty, bits):
    out = op4.line_dedup(docs, bits=bits).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert multiset(out) == Counter(lines_brute(rows))
    assert op4.line_dedup(empty).count() == 0


def test_quality(docs, rows, empty):
    got = op7.quality_rules(docs)
    for r in got.collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id and len([w for w in (x[1] or "").encode().split()]) == r.n_words) or ""
        w = text.encode().split()
        sh = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if sh[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ls = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got.count() == len(rows) and op7.quality_rules(empty).count() == 0


def test_quality_drops_furniture_and_keeps_one(spark):
    rng = random.Random(1)
    menu = words(rng, 100)
    docs = spark.createDataFrame([(i, menu + f"\nown {i} " + words(rng, 20), "h") for i in range(20)] + [(50 + i, words(rng, 80), "h") for i in range(20)], "doc_id long, text string, source string")
    assert {r.doc_id for r in op7.quality_rules(docs).where("kept").collect()} == {0, *range(50, 70)}


def test_mixture(docs, rows, empty):
    out = op3.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    assert all(r.taken <= 2 * r.size for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    total = sum(r.size for r in out)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size and abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    again = op3.mix_sources(docs.repartition(7))
    assert multiset(again.drop("rid")) == Counter(tuple(v for k, v in r.asDict().items() if k != "rid") for r in out)
    assert op3.mix_sources(empty).count() == 0


def test_tokens(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows)
    assert multiset(op5.token_counts(docs, path)) == want
    # All terms by the join, none broadcast.
    assert multiset(op5.token_counts(docs, path, head=0)) == want
    assert op5.token_counts(empty, path).count() == 0


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), op5.Splitter(path)
    for t in ["a<|endoftext|>b <|startoftext|>", "ΑΣ İ ǅ e\u0301", "中文'll '’s½²\x00", "\x00<|endoftext|>", "don't  DON'T 12's", ""]:
        assert sum(own.tokens(p) for p in own.split(t)) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_language(spark):
    rng = random.Random(3)
    make = {"xx": lambda: "".join(rng.choice("abc") + rng.choice("ou") for _ in range(3)), "yy": lambda: "".join(rng.choice("klm") + rng.choice("ei") for _ in range(3))}
    rows = [(i, " ".join(make[lang]() for _ in range(rng.randint(20, 60))), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    mixed = " ".join([make["xx"]() for _ in range(30)] + [make["yy"]() for _ in range(70)])
    odd = [(1000, None, "xx"), (1001, "12 - 34", "xx"), (1002, "", None), (1003, mixed, None), (1003, mixed, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = op6.identify_languages(df, F.col("doc_id") % 4 != 2)
    by = {r.doc_id: r for r in got.collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(by[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "yy" and 0.6 < by[1003].score < 0.8
    assert got.count() == len(rows) + len(odd)
    assert {r.lang_pred for r in op6.identify_languages(df, F.lit(False)).collect()} == {"und"}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, start, step = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    post, _ = op6.forward_backward(scores, np.array([4]), start, step)
    want, z = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = math.exp(start[path[0]] + sum(scores[0, i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        z += p
        for i, y in enumerate(path):
            want[i, y] += p
    assert np.allclose(post[0], want / z)


def test_leaks_also_reordered(spark, docs, empty):
    rng = random.Random(9)
    item = words(rng, 40).split()
    tests = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short"), (3, None), (4, "a " * 30)], "item_id long, text string")
    text = lambda *p: words(rng, 80) + " " + " ".join(p) + " " + words(rng, 80)
    rows = [(1, text(*item)), (2, text(*item[20:], "gap", *item[:20]).upper()), (3, text(*item[:15])), (4, None), (5, ""), (6, text(*item)), (6, text("a " * 30)), (None, text(*item))]
    got = op1.leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests)
    assert {(r.doc_id, r.item_id, r.n_tiles) for r in got.collect()} == {(1, 1, 1), (2, 1, 2), (6, 1, 1), (6, 4, 1), (None, 1, 1)}
    left = op1.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), tests)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert op1.leaks(empty, tests).count() == 0 and op1.leaks(docs, tests.limit(0)).count() == 0


def test_tiles_match_plain_greedy():
    rng = random.Random(8)
    for _ in range(60):
        p, t = [rng.choice("abc") for _ in range(rng.randint(0, 25))], [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        covered = lambda found: sum(n for _, _, n in found)
        fp, ft, plain = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in fp and j + n not in ft:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            fp |= set(range(i, i + n))
            ft |= set(range(j, j + n))
            plain.append((i, j, n))
        found = op1.tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] for i, j, n in found)
        assert len({x for i, _, n in found for x in range(i, i + n)}) == covered(found) and max((n for *_, n in found), default=0) == max((n for *_, n in plain), default=0)


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        h, want = rng.integers(0, 15, n).astype(np.uint64), []
        for c in np.flatnonzero(h):
            l = r = int(c)
            while l > 0 and h[l - 1] > h[c]:
                l -= 1
            while r + 1 < n and h[r + 1] >= h[c]:
                r += 1
            if r - l + 1 >= width:
                want.append((l, int(c), r))
        assert list(zip(*(x.tolist() for x in op8.compact_windows(h, width)))) == want


def test_passages(spark, docs, rows, empty):
    rng = random.Random(12)
    shared = words(rng, 70, 5000)
    near = shared.split()
    near[35] = "changed"
    more = [(500 + i, f"{words(rng, 60 + i, 5000)} {shared if i % 2 else ' '.join(near)} {words(rng, 50, 5000)}") for i in range(8)] + [(600 + i, words(rng, 200, 5000)) for i in range(8)]
    got = {r.doc_id: r for r in op8.repeated_passages(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
    assert {500 + i for i in range(8)} <= set(got) and not {600 + i for i in range(8)} & set(got)
    assert {got[500 + i].class_id for i in range(8)} == {500}
    for i in range(8):
        assert any(p.start <= 61 + i and p.end >= 60 + i + 69 for p in got[500 + i].passages)
    assert {100 + i for i in range(10)} <= set(got) and {got[100 + i].class_id for i in range(10)} == {100} and got[100].n_copies == 6
    assert op8.repeated_passages(empty).count() == 0


def test_urls(spark):
    page = lambda i, url, *links: (i, url, "<p>" + "".join(f'<a class=x href="{u}">x</a>' for u in links))
    rows = [
        page(1, "https://Good.ORG/a?x#y", "http://friend.net/1", "/own"), page(2, "http://bad.com/de/1"), page(3, "http://friend.net"), page(4, "http://spam.net/x", "http://bad.com/q", "//bad.com"),
        page(5, "http://www.example.org/en/12"), page(6, "http://x.example.org/es/"), page(7, None), page(8, "no url"), page(9, "http://bad.com/fr/1"), page(10, "http://lone.net/?a://b"), (11, "http://org/", None), (11, "http://org/", None), (None, "http://bad.com/en", ""),
    ]
    got = op9.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert by[1] == ("good.org", "/a", "org/", "allow") and by[2] == ("bad.com", "/de/1", "com/de/", "block") and by[3][2:] == (None, "allow") and by[4] == ("spam.net", "/x", None, "block")
    assert by[5] == ("www.example.org", "/en/12", "example.org/en/1", "block") and by[6][2:] == ("example.org/es/", "block") and by[7] == by[8] == ("", "", None, "allow")
    assert by[9][2:] == ("com/fr/", "allow") and by[10] == ("lone.net", "/", None, "allow") and got.count() == len(rows)
    assert op9.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pagerank_matches_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 4)]
    seeds = {"a": 0.5, "d": 0.5}
    got = {r.host: r.score for r in op9.propagate(spark.createDataFrame(edges, "u string, v string, n long"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), tolerance=1e-10).collect()}
    p, out = {**dict.fromkeys("abcd", 0.0), **seeds}, Counter()
    for u, _, n in edges:
        out[u] += n
    for _ in range(200):
        new = {h: 0.15 * seeds.get(h, 0.0) for h in p}
        for u, v, n in edges:
            new[v] += 0.85 * p[u] * n / out[u]
        p = new
    assert all(abs(got.get(h, 0.0) - x) < 1e-6 for h, x in p.items())


@pytest.mark.parametrize("heads", [{}, {"head": 0, "gram_head": 0}])
def test_ppm(spark, docs, rows, empty, heads):
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    k, ctx, count = op10.ORDER, [defaultdict(Counter) for _ in range(op10.ORDER + 1)], Counter()
    line = lambda t: b"\n" * k + b" ".join((t or "").encode().lower().split()) + b"\n"
    for r in rows:
        if learned(r[0]):
            count.update(op10.tokens((r[1] or "").encode()))
            x = line(r[1])
            for p in range(k, len(x)):
                for j in range(k + 1):
                    ctx[j][x[p - j : p]][x[p]] += 1
    n, v = sum(count.values()), len(count)

    def score(t):
        x, s = line(t), 0.0
        for p in range(k, len(x)):
            gone = set()
            for j in range(k, -1, -1):
                c = {b: m for b, m in ctx[j].get(x[p - j : p], {}).items() if b not in gone}
                if x[p] in c:
                    s += math.log10((2 * c[x[p]] - 1) / (2 * sum(c.values())))
                    break
                if c:
                    s += math.log10(len(c) / (2 * sum(c.values())))
                gone |= set(ctx[j].get(x[p - j : p], {}))
            else:
                s -= math.log10(256 - len(gone))
        return s

    train = F.col("doc_id").isNotNull() & ~op10.held_out(F.col("doc_id"), 7)
    got = op10.score_texts(docs, train, **heads).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows[:20] + rows[70:]:
        t = op10.tokens((r[1] or "").encode())
        want[r[0]].append((len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), score(r[1])))
    for r in got:
        if r.doc_id in want:
            assert any(tuple(r)[1:] == pytest.approx(w, rel=1e-9) for w in want[r.doc_id]), r
    assert op10.score_texts(empty, F.lit(True)).count() == 0


def test_passages_of_all_that_share_a_key(spark):
    """Copies edited step by step: the ends of a chain differ, and its links go through the middle."""
    rng, rows = random.Random(21), []
    for c in range(12):
        now = words(rng, 60, 5000).split()
        for i in range(9):
            rows.append((100 * c + i, " ".join(now)))
            now[(7 * i + 3) % 60] = f"edit{c}x{i}"
    rng.shuffle(rows)
    th = {r.doc_id: r.th for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th")).collect()}
    width = op8.WORDS - op8.SHINGLE + 1
    sh = {d: op8.shingles(t.encode()) for d, t in rows}
    held = defaultdict(set)
    for d, s in sh.items():
        for k in op8.keys_of([s], width, op8.BANDS)[1].tolist():
            held[k].add(d)
    pairs = {tuple(sorted((x, y), key=th.get)) for v in held.values() for x in v for y in v if x < y}
    edges = [(x, y) for x, y in pairs if op8.passages(sh[x], sh[y], width, op8.SIMILARITY)]
    least = {d: d for e in edges for d in e}
    for _ in range(20):
        for x, y in edges:
            least[x] = least[y] = min(least[x], least[y])
    got = {r.doc_id: r.class_id for r in op8.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(least.values())) < len(least) / 3 and got == least


def test_language_reads_text_without_blanks_whole(spark):
    rng = random.Random(4)
    make = {"xx": lambda: "".join(rng.choice("abc") + rng.choice("ou") for _ in range(3)), "yy": lambda: "".join(rng.choice("klm") + rng.choice("ei") for _ in range(3))}
    rows = [(i, " ".join(make[lang]() for _ in range(40)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    run = "".join(make["xx"]() for _ in range(7)) + "".join(make["yy"]() for _ in range(60))
    df = spark.createDataFrame(rows + [(500, run, None), (501, "".join(make["xx"]() for _ in range(70)), None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in op6.identify_languages(df, F.col("doc_id") < 500).collect()}
    assert by[500].lang_pred == "yy" and 0.7 < by[500].score < 0.98 and by[501].lang_pred == "xx"


def test_language_sample_counts_distinct_texts_and_takes_long_ones(spark):
    rng = random.Random(5)
    rows = [("copy of one text", "xx")] * 3000 + [(words(rng, 20), "xx") for _ in range(40)] + [(words(rng, 9000), "zz"), ("長" * 30000, "yy")]
    got = op6.training_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 10)
    count = Counter(lang for _, lang in got)
    assert count == {"xx": 10, "zz": 1, "yy": 1} and all(1000 < len(t.encode()) <= op6.TEXT_BYTES for t, lang in got if lang != "xx")
    assert set(next(t for t, lang in got if lang == "zz").split()) <= {f"w{i}" for i in range(400)}


def test_tiles_cover_what_plain_greedy_covers():
    item = [f"i{n}" for n in range(20)]
    text = ["x", *item[:9], "y", *item[5:14], "z"]
    assert sum(n for *_, n in op1.tiles(item, text, 5)) == 14
    rng = random.Random(18)
    for _ in range(300):
        p, t = [rng.choice("ab") for _ in range(rng.randint(0, 25))], [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        fp, ft, plain = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in fp and j + n not in ft:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            fp |= set(range(i, i + n))
            ft |= set(range(j, j + n))
            plain.append((i, j, n))
        assert op1.tiles(p, t, 3) == plain


def test_keys_are_those_of_all_stretches():
    rng = np.random.default_rng(7)
    for _ in range(150):
        width, texts = int(rng.integers(2, 9)), [rng.integers(1, 9 if rng.random() < 0.5 else 2**60, int(rng.integers(0, 60))).astype(np.uint64) for _ in range(3)]
        want = set()
        for t, s in enumerate(texts):
            for i in range(len(s) - width + 1):
                part = s[i : i + width]
                h = [(op8.mixed(part ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32)).astype(np.uint32) for k in (0, 1)]
                a, b = (part[int(np.maximum(x, 1).argmin())] for x in h)
                want.add((t, int(op8.mixed(np.array([a]) + np.uint64(1) + op8.mixed(np.array([b]))).view(np.int64)[0])))
        i, key = op8.keys_of(texts, width, 1, 0)
        assert set(zip(i.tolist(), key.tolist())) == want and len(i) == len(want)
        # A long text in parts has the keys of the whole.
        long = np.concatenate(texts)
        parts = [long[i : i + 11 + width - 1] for i in range(0, max(1, len(long) - width + 1), 11)]
        assert {x for p in parts for x in op8.keys_of([p], width, 3, 2)[1].tolist()} == set(op8.keys_of([long], width, 3, 2)[1].tolist())


def test_near_passages_against_brute_force(spark):
    """Passages of 60 to 120 words, some of whose words are changed, in texts of their own: links of all pairs, compared word by word."""
    rng, rows = random.Random(31), []
    for c in range(40):
        base = words(rng, rng.randint(60, 120), 9000).split()
        for i in range(4):
            now = [w if rng.random() > 0.012 else f"new{c}x{i}x{j}" for j, w in enumerate(base)]
            rows.append((10 * c + i, " ".join([words(rng, rng.randint(20, 80), 9000), *now, words(rng, rng.randint(20, 80), 9000)])))
    rows += [(5000 + i, words(rng, 150, 9000)) for i in range(60)]
    width = op8.WORDS - op8.SHINGLE + 1
    sh = {d: op8.shingles(t.encode()) for d, t in rows}

    def similar(a, b):
        """Whether any stretch of `width` shingles of each has the similarity, both sliding along one offset."""
        for shift in range(-len(a) + width, len(b) - width + 1):
            lo, hi = max(0, -shift), min(len(a), len(b) - shift)
            same = a[lo:hi] == b[lo + shift : hi + shift]
            if same.sum() >= 0.6 * width:
                for i in range(lo, hi - width + 1):
                    x, y = set(a[i : i + width].tolist()), set(b[i + shift : i + shift + width].tolist())
                    if len(x & y) >= op8.SIMILARITY * len(x | y):
                        return True
        return False

    want = {d for c in range(40) for d in range(10 * c, 10 * c + 4) for e in range(10 * c, 10 * c + 4) if d != e and similar(sh[d], sh[e])}
    got = {r.doc_id: r.class_id for r in op8.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 120 and not set(got) - {d for d, _ in rows if d < 5000}
    assert len(want & set(got)) >= 0.95 * len(want) and all(got[d] // 10 == d // 10 for d in got)


def test_passages_in_blocks_and_of_repetitive_texts(spark):
    """A bucket that is dealt out in blocks gives the classes of one block; texts of one word over and over stay cheap."""
    rng, rows = random.Random(33), []
    line = words(rng, 20, 9000)
    for c in range(60):
        own = words(rng, 60, 9000)
        rows += [(10 * c, f"{own} {line} {words(rng, 40, 9000)}"), (10 * c + 1, f"{words(rng, 30, 9000)} {own} {line}")]
    rows += [(9000, "again " * 60000), (9001, "again " * 200 + words(rng, 40, 9000)), (9002, "b c " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.class_id for r in op8.repeated_passages(df).collect()}
    parts = {r.doc_id: r.class_id for r in op8.repeated_passages(df, block=7).collect()}
    assert whole == parts == {**{10 * c + i: 10 * c for c in range(60) for i in (0, 1)}, 9000: 9000, 9001: 9000}


def test_blocks_lose_no_link():
    """All pairs of different components that exact comparison links are joined, whatever is dealt where."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        base, rows = rng.integers(1, 2**60, 60).astype(np.uint64), []
        for i in range(30):
            held = base.copy()
            held[rng.integers(0, 60, int(rng.integers(0, 14)))] = rng.integers(1, 2**60, 1).astype(np.uint64)[0]
            rows.append((i, i if i > 8 else 0, i > 8, i > 8, 0, held))
        joined = {}

        def root(x, up):
            while up.get(x, x) != x:
                x = up[x]
            return x

        want = {}
        for i in range(30):
            for j in range(i):
                if op8.passages(rows[i][5], rows[j][5], 46, 0.8) or rows[i][1] == rows[j][1]:
                    x, y = root(i, want), root(j, want)
                    want[max(x, y)] = min(x, y)
        for a, b, *_ in op8.links_between(rows, 46, 0.8) + [(i, 0) for i in range(1, 9)]:
            x, y = root(a, joined), root(b, joined)
            joined[max(x, y)] = min(x, y)
        assert [root(i, joined) for i in range(30)] == [root(i, want) for i in range(30)]


def test_posteriors_of_whole_sequences():
    rng = np.random.default_rng(5)
    count, k = np.array([3, 0, 200, 1, 7]), 4
    scores, start, step = rng.normal(size=(count.sum(), k)), rng.normal(size=k), rng.normal(size=(k, k))
    got, at = op6.posteriors(np.exp(scores), count, np.exp(start), np.exp(step)), 0
    for n in count.tolist():
        if n:
            want, _ = op6.forward_backward(scores[None, at : at + n], np.array([n]), start, step)
            assert np.allclose(got[at : at + n], want[0])
        at += n


def test_words_of_switched_text_are_labelled(spark):
    rng = random.Random(6)
    make = {"xx": lambda: "".join(rng.choice("abc") + rng.choice("ou") for _ in range(3)), "yy": lambda: "".join(rng.choice("klm") + rng.choice("ei") for _ in range(3))}
    rows = [(i, " ".join(make[lang]() for _ in range(40)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    mixed = " ".join([make["xx"]() for _ in range(100)] + [make["yy"]() for _ in range(150)] + [make["xx"]() for _ in range(60)])
    df = spark.createDataFrame(rows + [(500, mixed, None), (501, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: [(x.start, x.end, x.lang) for x in r.runs] for r in op6.label_words(df, F.col("doc_id") < 500).collect()}
    assert got[500] == [(0, 100, "xx"), (100, 250, "yy"), (250, 310, "xx")] and got[501] == []


def test_mixture_draws_equal_rows_apart(spark):
    rows = [(7, "one two three four five six seven eight nine ten " * 2, "s")] * 400 + [(None, f"a{i} " * 20, "s") for i in range(400)] + [(1000 + i, "x " * 20, "t") for i in range(400)]
    got = op3.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for which in (lambda r: r.doc_id == 7, lambda r: r.doc_id is None):
        copies = Counter(r.copies for r in got if which(r))
        m = next(r.target / r.source_size for r in got if which(r))
        assert len(copies) == (1 if m == int(m) else 2) and abs(sum(k * n for k, n in copies.items()) - 400 * m) < 60


def test_frequent_terms_have_a_byte_budget(spark):
    from lodestone.llm.terms import frequent

    df = spark.createDataFrame([(b"a" * 300, 10**6, 1.0), *((f"t{i:03}".encode(), 2 ** (i % 8), float(i)) for i in range(200))], "term binary, n long, x double")
    assert len(frequent(df, ["x"])[0]) == 200 and all(len(t) < 256 for t in frequent(df, ["x"])[0])
    some = frequent(df, ["x"], most_bytes=300)[0]
    assert 0 < sum(map(len, some)) <= 300


def test_tiles_of_repetitive_texts():
    """A word that fills the item and the text meets itself everywhere; the tiles are still those of plain greedy."""
    began = time.time()
    assert op1.tiles([b"a"] * 200, [b"a"] * 32_000) == [(0, 0, 200)]
    assert sorted(op1.tiles([b"a"] * 60 + [b"b"] + [b"a"] * 40, [b"a"] * 5_000)) == [(0, 0, 60), (61, 60, 40)]
    two = [b"a", b"b"] * 100
    assert op1.tiles(two, [b"b"] + two * 50) == [(0, 1, 200)]
    assert op1.tiles([str(i).encode() for i in range(20_000)], [b"x"] + [str(i).encode() for i in range(20_000)]) == [(0, 1, 20_000)]
    assert time.time() - began < 20


def test_word_features_of_many_words_at_once():
    """The labeller took the features of each distinct word by itself, in Python."""
    lexicon = frozenset({"haus", "für", "x"})
    words = ["a", "haus", "für", "x", "12", "--", "日本語", "\ud800z", "😀", "ß9é", "ab" * 20, "x" * 3]
    got, starts, letters = op6.features_of(words, lexicon)
    ends = [*starts[1:].tolist(), len(got)]
    assert [got[i:j].tolist() for i, j in zip(starts.tolist(), ends)] == [op6.features(w, lexicon) for w in words]
    assert letters.tolist() == [any(c.isalpha() for c in w) for w in words]
