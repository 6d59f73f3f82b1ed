import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunk, clean, dedup, dialogue, live, search
from lodestone.plans import kb
from lodestone.sources import files


def test_cooldown_boundary(spark):
    rows = spark.createDataFrame([(i, "c", "k", t) for i, t in enumerate([0.0, 44.9, 45.0, 90.0])], "i long, call string, kind string, t double")
    assert [r.emitted for r in live.cooldown(rows, ["call", "kind"], "t", 45.0, "i").orderBy("i").collect()] == [True, False, True, True]


def test_controller_boundaries():
    c = live.Controller()
    assert c.consider("a", 0.649, "x", 0)[1] == "below_threshold"
    assert c.consider("a", 0.65, "one two three four", 0)[1] is None
    assert c.consider("a", 0.9, "five", 44.9)[1] == "cooldown"
    assert c.consider("a", 0.9, "one two three four five", 45)[1] == "duplicate_evidence"  # 4 of 5
    assert c.consider("a", 0.9, "one two three nine", 46)[1] is None  # 3 of 5: not above 0.6
    assert c.n == 5


def test_disclosure_boundary(spark):
    lines = spark.createDataFrame([("a", 0, "hello", "agent", 7.9), ("b", 0, "hello", "agent", 8.0), ("c", 0, "this call is being recorded", "agent", 9.0)], "call string, turn long, text string, speaker string, t_end double")
    assert [r.call for r in live.signals(lines, "call", "turn", "text").collect()] == ["b"]


def test_batch_fold_equals_streaming_operator(spark, tmp_path):
    from lodestone.streaming.nudges import rocksdb, stream_nudges

    rng = random.Random(3)
    rows = [(f"c{i % 3}", rng.choice("ab"), rng.choice([0.5, 0.7, 0.9]), 10, float(t), 0, rng.choice(["x y z", "p q", "r"])) for i, t in enumerate(range(0, 600, 7))]
    schema = "call string, kind string, confidence double, priority int, t double, seq int, evidence string"
    df = spark.createDataFrame(rows, schema)
    want = live.nudges(df.select("call", "kind", "confidence", F.col("t").alias("t_end"), "evidence", "seq"), "call", ["t_end", "seq"]).select("call", "id", "suppressed", "reason").collect()
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rocksdb(spark)
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "ck"))
    q = stream_nudges(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("nudged").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.checkpointLocation")
    assert sorted(map(tuple, spark.table("nudged").select("call", "id", "suppressed", "reason").collect()), key=str) == sorted(map(tuple, want), key=str)


def test_percentiles_are_nearest_rank(spark):
    rows = [("a", 5.0)] + [("b", x) for x in (1.0, 2.0)] + [("c", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("d", float(x)) for x in range(1, 6)]
    got = {r.k: r.p50_ms for r in live.latency_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": 5.0, "b": 1.0, "c": 3.0, "d": 3.0}


def test_quantiles_by_refinement(spark):
    rng = random.Random(6)
    groups = {"even": [float(i) for i in range(1000)], "far": [1e-300, 1.0, 1e300, -1e308, 1e308, 5.0], "ties": [3.0] * 500 + [4.0] * 499, "one": [7.0], "odd": [rng.gauss(0, 1) ** 9 for _ in range(777)], "tiny": [1 + i * 2.0**-52 for i in range(40)], None: [0.0, -0.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("even", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for bins in (2, 256):
        got = {(r.g, r.share): (r.n, r.x) for r in live.quantile_values(df, "g", "v", [0.0, 0.5, 0.95, 1.0], bins).collect()}
        assert got == {(g, s): (len(vs), sorted(vs)[round(s * (len(vs) - 1))]) for g, vs in groups.items() for s in (0.0, 0.5, 0.95, 1.0)}
    assert live.latency_summary(df.limit(0), "g", "v").count() == 0


def test_filter_fallback(spark):
    rows = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("r", 1, "y")], "q string, id long, m string")
    assert search.with_fallback(rows, ["q"], F.col("m") == "x").orderBy("q", "id").select("q", "id").collect() == [("q", 1), ("r", 1)]


def test_exact_duplicate_tie_keeps_the_earlier(spark):
    rows = spark.createDataFrame([(2, "A b", "2024"), (1, "a  B!", "2024"), (3, "a b", "2023"), (4, None, None)], "id long, t string, d string")
    got = {r.id: r.keeper for r in dedup.exact_duplicates(rows, "id", "t", ["d"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(20)] for _ in range(8)]
    texts = [" ".join(x if rng.random() > 0.1 else rng.choice(words) for x in rng.choice(base)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("m", F.lit("m"))

    def sim(a, b):
        sh = lambda w: {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
        j = lambda x, y: len(x & y) / len(x | y)
        a, b = a.split(), b.split()
        return max(j(sh(a), sh(b)), 0.9 * j({x for x in a if len(x) > 2}, {x for x in b if len(x) > 2}))

    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and round(sim(texts[a], texts[b]), 6) >= 0.55}
    assert {(r.a, r.b) for r in dedup.near_duplicates(df, "id", "t", "m").collect()} == want and want


def test_near_duplicates_compare_lengths_by_distinct_words(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta " * 5), (3, "a b c d e f"), (4, "a b c d e f g")], "id long, t string").withColumn("m", F.lit("m"))
    got = {(r.a, r.b): r.similarity for r in dedup.near_duplicates(rows, "id", "t", "m").collect()}
    assert got == {(1, 2): 0.9, (3, 4): 0.8}


def test_true_tables(spark):
    assert live.PRIORITY["payment_difficulty"] == 70 and live.PRIORITY["buying_signal"] == 40 and live.PRIORITY["topic_shift"] == 20
    gone = ["We use cookies here", "x All rights reserved", "©owner", "* Copyright 2024", "FAQ", "Privacy policy | x", "limited period offer!", "Exported by y", "-----", "(Superseded by z, retained for reference)", "window.dataLayer = 1", "  "]
    stay = ["a cookie jar", "back to top", "see the faq", "--", "we were superseded by y", "window.datalayer", "© 2024", "gtag(1)"]
    lines = spark.createDataFrame([(1, "\n".join(gone + stay))], "id long, t string")
    got = {r.line: r.status for r in clean.clean_lines(clean.lines_of(lines, "id", "t")).collect()}
    assert [x for x in gone + stay if got[x] == "kept"] == stay
    assert clean.record_ids(spark.createDataFrame([("IN", "faq", 1)], "m string, c string, o int"), "m", "c", ["o"]).first()["record_id"] == "kb_in_faq_001"


def test_conflicting_facts_are_flagged_on_their_records(spark):
    rows = spark.createDataFrame([(1, "about 8,900 network hospitals, average of 7 working days"), (2, "9,500+ network hospitals"), (3, "average of 7 working days"), (4, None)], "id long, t string")
    got = {r.id: r.flags for r in clean.conflict_flags(clean.facts(rows, "id", F.col("t"))).collect()}
    assert got == {1: ["conflicting_fact:network_hospitals"], 2: ["conflicting_fact:network_hospitals"]}


def test_chunk_packer_overlap():
    unit = lambda n, c: " ".join([c] * n)
    assert chunk.pack([unit(100, "a"), unit(72, "b"), unit(80, "c")]) == [unit(100, "a"), unit(72, "b"), unit(72, "b") + " " + unit(80, "c")]
    assert chunk.pack([unit(80, "a"), unit(73, "b"), unit(70, "c")]) == [unit(80, "a"), unit(73, "b"), unit(70, "c")]
    assert chunk.pack([]) == []


def test_heading_stack(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "## B", "x", "# C", "y"])], "id long, line_no long, line string")
    got = [(r.line, r.h1, r.h2) for r in chunk.with_headings(lines).where("NOT is_heading").orderBy("line_no").collect()]
    assert got == [("x", "A", "B"), ("y", "C", None)]


def test_loaders_never_raise(tmp_path, spark):
    (tmp_path / "a.html").write_text("<title>T | site</title><nav>no</nav><h1>H</h1><p>one<p>two<table><tr><th>f<th>x</tr><tr><td>r<td>1</tr></table>")
    (tmp_path / "b.md").write_text("# Top\n## Sub\ntext\n| k | v |\n|---|---|\n| a | 1 |\n")
    (tmp_path / "c.csv").write_text("plan,x\nA,1\nB,2\nA,3\n")
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.xyz").write_text("?")
    (tmp_path / "f.txt").write_text(" \n")
    (tmp_path / "_g.txt").write_text("hidden")
    (tmp_path / "h.csv").write_text("plan,x\n")
    (tmp_path / "i.html").write_text("<div>in no paragraph</div>")
    got = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, [(str(tmp_path), "M", "en")]).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.html": "ok", "b.md": "ok", "c.csv": "ok", "d.json": "failed", "e.xyz": "failed", "f.txt": "empty", "h.csv": "failed", "i.html": "empty"}
    assert got["a.html"].title == "T" and [s.text for s in got["a.html"].sections] == ["one\ntwo", "r - x: 1."]
    assert [s.text for s in got["c.csv"].sections] == ["(row 2) plan: A; x: 1.\n(row 4) plan: A; x: 3.", "(row 3) plan: B; x: 2."]
    assert [(s.text, s.kind) for s in got["b.md"].sections] == [("a - v: 1.", "table"), ("text", "prose")]
    assert got["c.csv"].title == "C" and got["h.csv"].error.startswith("ValueError") and got["i.html"].title == "i"


def test_html_goes_by_headings(spark):
    page = """<html><head><title>Our plans | A site</title><style>p {}</style></head><body>
<div class="site-header x"><p>Top</p></div><div role="navigation"><ul><li>Home</li></ul></div><header><h1>Not me</h1></header>
<main><p>Before any heading</p><h1 id="top">1. OUR COVER</h1><div class="cookie-banner"><p>We use cookies<div>and more</div></p></div>
<p>One <b>bold</b> word<p>Left open<ul><li>first<ul><li>inner</li></ul></li><li><p>in an item</p></li></ul>loose text<div>in a div</div>
<h3>Is it so?</h3><p>It is.</p><span class="promo">Buy</span>
<table><tr><th>Feature<th>A<th>B</tr><tr><td>Room<td>1<td>2</tr><tr><td>short</td></tr><tr></tr></table><p>After the table</p>
<h2>Second</h2><ol><li>x</ol><aside><p>no</p></aside><h4></h4><p>Under nothing</p></main><p>Outside</p><footer><p>Foot last updated on 05/06/2024</p></footer></body></html>"""
    title, got = files.html_sections(page, "pages/faq.html")
    assert title == "Our plans"
    assert got == [
        ([], "Before any heading", "", "prose"),
        (["Our Cover"], "One bold word\nLeft open\n- first inner\n- in an item", "top", "list"),
        (["Our Cover", "Is It So?"], "It is.", "Is It So?", "faq"),
        (["Our Cover", "Is It So?"], "Room - A: 1; B: 2.\nshort", "table", "table"),
        (["Our Cover", "Is It So?"], "After the table", "Is It So?", "prose"),
        (["Our Cover", "Second"], "- x", "Second", "list"),
        (["Our Cover", "Second"], "Under nothing", "Our Cover > Second", "prose"),
    ]
    assert files.load("x/faq.html", page.encode())["updated"] == "2024-06-05"
    assert files.html_sections("<p>no body</p></div></p>", "a/b.html") == ("b", [([], "no body", "", "prose")])
    assert files.html_sections("<div role=navigation><p>x", "b.html")[1] == [] and files.html_sections(None)[1] == []
    assert files.html_sections("<nav><div><p>x</nav><p>y<br>z</p>")[1] == [([], "y z", "", "prose")]
    assert files.html_sections("<table><tr><td>only</td></tr><tr><td>a</td></tr></table>")[1] == [([], "a", "table", "table")]


def test_html_against_a_plain_reader():
    """Random well-formed pages, read by the standard library's XML tree."""
    import xml.etree.ElementTree as ET

    rng = random.Random(8)

    def block(depth):
        kind = rng.choice(["p", "p", "h1", "h2", "h3", "h4", "ul", "table", "div", "nav", "promo"])
        if kind in ("div", "nav") and depth < 3:
            return f"<{kind}>" + "".join(block(depth + 1) for _ in range(rng.randint(0, 3))) + f"</{kind}>"
        if kind == "promo":
            return "<div class='a promo'><p>buy</p></div>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>i{rng.randrange(99)}</li>" for _ in range(rng.randint(0, 3))) + "</ul>"
        if kind == "table":
            w = rng.randint(1, 3)
            return "<table>" + "".join("<tr>" + "".join(f"<td>c{rng.randrange(99)}</td>" for _ in range(w)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        return f"<{kind if kind[0] in 'ph' else 'p'}>t{rng.randrange(999)} <b>x</b></{kind if kind[0] in 'ph' else 'p'}>"

    def plain(root):
        out, stack, held = [], [], []
        done = lambda: (out.append((list(stack), "\n".join(held))) if held else None, held.clear())
        words = lambda e: " ".join(t.strip() for t in e.itertext() if t.strip())

        def walk(e):
            for c in e:
                if c.tag == "nav" or "promo" in c.get("class", "").split():
                    continue
                if c.tag[0] == "h" and c.tag != "html":
                    done()
                    stack[:] = [*stack[: int(c.tag[1]) - 1], files.heading_name(words(c))]
                elif c.tag == "p":
                    held.append(words(c))
                elif c.tag == "ul":
                    held.extend(f"- {words(i)}" for i in c)
                elif c.tag == "table":
                    done()
                    if text := files.table_text([[words(x) for x in r] for r in c]):
                        out.append((list(stack), text))
                    continue
                walk(c) if c.tag not in ("ul", "p") else None

        walk(root)
        done()
        return out

    for _ in range(200):
        page = "<main>" + "".join(block(0) for _ in range(rng.randint(0, 12))) + "</main>"
        assert [(h, t) for h, t, _, _ in files.html_sections(page)[1]] == plain(ET.fromstring(page)), page


def test_other_loaders_by_section():
    md = files.markdown_sections("# 1. TOP\nintro\n## a part\nline  \n| k | v |\n|---|:-:|\n| a | 1 |\n| b |\nafter\n\n\nmore\n#### deep\ny\n## 2. next\n\nz\n")
    assert md == ("Top", [([], "intro", "", "prose"), (["A Part"], "a - v: 1.\nb", "A Part", "table"), (["A Part"], "line\nafter", "A Part", "prose"), (["A Part"], "more", "A Part", "prose"), (["A Part", "Deep"], "y", "A Part > Deep", "prose"), (["Next"], "z", "Next", "prose")])
    assert files.text_sections("My title\nhere\n\nHEAD ONE\nbody\nb2\n\nHEAD TWO\n \npara\n-----\nq") == ("My Title", [([], "My title\nhere", "", "prose"), (["Head One"], "body\nb2", "Head One", "prose"), (["Head Two"], "para", "Head Two", "prose"), (["Head Two"], "q", "Head Two", "prose")])
    assert files.csv_text("plan,sum_insured_rs,x\nA,1,\nB,,2\n")[1] == [(["A"], "(row 2) plan: A; sum insured: 1.", "rows for A", "table"), (["B"], "(row 3) plan: B; x: 2.", "rows for B", "table")]
    form = '{"form_name": "F", "version": 2, "sections": [{"title": "T", "fields": [{"name": "dateOfBirth", "type": "date", "required": true, "label": "Birth", "options": [1, 2], "help": "h"}, {"name": "x"}]}]}'
    assert files.form_text(form) == ("F", [(["T"], "Field date_of_birth (date, required): Birth. Options: 1, 2. h.\nField x (text, optional): .", "T", "form")], "2")
    pdf = files.pdf_lines(["SECTION A - COVER\nA.1 Room rent\nx y\nEXCLUSIONS LIST\nz", "w", " \n"])
    assert pdf == ("Section A - Cover", [(["Cover", "Room Rent"], "A.1 Room rent x y", "page 1", "prose"), (["Cover", "List"], "EXCLUSIONS LIST z", "page 1", "prose"), (["Cover", "List"], "w", "page 2", "prose")])
    with pytest.raises(ValueError):
        files.pdf_lines(["", " "])


def test_files_come_in_order_of_root_and_path(tmp_path, spark):
    for name in ("a/z.txt", "a/b/x.txt", "a-c/y.txt", ".h/n.txt", "b.txt", "skip.md"):
        (tmp_path / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / name).write_text("t")
    (tmp_path / "none").mkdir()
    (tmp_path / "zero.txt").write_text("t")
    roots = [(str(tmp_path / "one"), "M", "en"), (str(tmp_path / "zero.txt"), "N", "de"), (str(tmp_path / "none"), "O", "fr")]
    found = files.in_file_order(files.discover(spark, roots, ["skip.md"]).select("path", "market", "root"))
    assert [(r.path.rpartition(str(tmp_path) + "/")[2], r.market) for r in found.collect()] == [("one/a/b/x.txt", "M"), ("one/a/z.txt", "M"), ("one/a-c/y.txt", "M"), ("one/b.txt", "M"), ("zero.txt", "N")]


def test_transcripts_are_masked_in_both_forms(tmp_path, spark):
    import json

    from lodestone.functions import pii

    turns = spark.createDataFrame([("c", 1, "agent", "Mail me at a.b@example.org"), ("c", 0, None, None), ("d", 0, "user", "")], "conv string, turn int, role string, text string")
    masked = files.masked_transcripts(turns, "conv", "turn", "role", "text")
    got = {(r.call, r.turn): r for r in masked.collect()}
    plain = json.dumps({"conv": "c", "turn": 1, "role": "agent", "text": "Mail me at a.b@example.org"}, separators=(",", ":"))
    assert got["c", 1].json == pii.masked(plain)[0] and "a.b@" not in got["c", 1].json + got["c", 1].line and got["c", 1].line.startswith("agent: ")
    assert got["c", 0].line == ": " and got["d", 0].line == "user: "
    files.write_transcripts(masked, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out" / "txt" / "call=c").glob("*.txt")) for x in f.read_text().splitlines()]
    assert lines == [got["c", 0].line, got["c", 1].line] and (tmp_path / "out" / "json" / "call=d").is_dir()


def test_scripts_and_outcomes(spark):
    turns = live.scripted(spark, {"s": [("agent", 2, "a"), ("customer", 3.5, "b")]}).orderBy("turn").collect()
    assert [(r.t_start, r.t_end) for r in turns] == [(0.0, 2.0), (2.0, 5.5)]
    shown = spark.createDataFrame([("s", "x", False), ("s", "y", True), ("q", "x", False)], "call string, kind string, suppressed boolean")
    expected = spark.createDataFrame([("s", ["x"]), ("t", ["x"]), ("q", []), ("r", [])], "call string, kinds array<string>")
    assert {r.call: r.passed for r in live.outcomes(shown, expected).collect()} == {"s": True, "t": False, "q": False, "r": True}


def test_record_by_id(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "record_id string, n int")
    assert [r.n for r in search.by_id(records, "record_id", "b").collect()] == [2] and search.by_id(records, "record_id", "z").isEmpty()


def test_qualification_and_version(spark):
    q = lambda s, m: spark.createDataFrame([(s,)], "s map<string,string>").select(dialogue.qualify(F.col("s"), F.lit(m)).alias("q")).first()["q"]
    assert q({"name": "x"}, "IN").status == "Incomplete"
    assert q({"name": "x", "age": "62", "city": "Pune", "conditions": "heart attack"}, "IN").status == "Referred"
    assert q({"name": "x", "age": "60 yrs"}, "PH").status == "Referred"
    cardiac = q({"name": "x", "age": "62", "city": "Pune", "conditions": "heart attack"}, "IN")
    assert cardiac.reasons == ["senior plan with medical examination", "cardiac history is referred"] and cardiac.medical and len(cardiac.disclaimers) == 2
    assert q({"name": "x", "age": "50", "city": "Agra", "health": "cancer"}, "IN").reasons == ["age in range for Single", "medical examination by age", "declared condition"]
    assert q({"name": "x", "age": "50", "city": "Agra", "age_conflict": "y"}, "IN").disclaimers == dialogue.DISCLAIMERS["conflict"]
    life = {"name": "x", "age": "40", "members": "credit life at Bank of Isles"}
    lent = spark.createDataFrame([(life,)], "s map<string,string>").select(dialogue.qualify(F.col("s"), F.lit("PH"), ["bank of isles"]).alias("q")).first()["q"]
    assert q(life, "PH").status == "Not Eligible" and lent.status == "Qualified" and q(life, "PH").plan == "Credit Life"
    assert clean.kb_version("2024-05-01", "b", ("2024.05.01-2", "a")) == "2024.05.01-3" and clean.kb_version("2024-05-01", "a", None) == "2024.05.01-1"
    s = spark.createDataFrame([("My name is Ann Lee, I am 45 years, born 1960, two kids",)], "t string").select(dialogue.extract_slots(F.col("t"), as_of_year=2024).alias("s")).first()["s"]
    assert s["name"] == "Ann Lee" and s["age"] == "45" and "age_conflict" in s


@pytest.mark.parametrize("name", ["bm25_topk", "turn_clock", "table_to_text", "normalized_terms", "document_dates", "page_dates", "scenario_outcomes", "scripted_nudges", "call_nudges", "clean_lines", "record_quality", "kb_categories", "kb_search", "kb_answers", "kb_search_hybrid", "phrase_hits", "phrase_labels", "expanded_turns"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from lodestone.plans import registry

    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "part", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, d), db.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(db.sql(registry.ORACLES[name]).df()[cols].itertuples(index=False, name=None), key=str)


def test_cosine_topk_takes_every_hundredth_row(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(450, 8)).astype("float32")
    v[200:230] = v[7]  # ties
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = v.astype(float) / (np.linalg.norm(v.astype(float), axis=1) + 1e-9)[:, None]
    want = {}
    for q in range(0, 450, 100):
        cos = np.round(unit @ unit[q], 6)
        for rank, i in enumerate([i for i in sorted(range(450), key=lambda i: (-cos[i], i)) if i != q][:5]):
            want[q, rank + 1] = (i, cos[i])
    got = {(r.query_id, r.rank): (r.vec_id, r.cosine) for r in kb.cosine_topk(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    key = lambda df: sorted(tuple(r) for r in search.ranked(df.withColumn("cosine", F.round("cosine", 6)), "query_id", "cosine", 5).collect())
    assert key(search.cosines(q, rows, 5, block=2)) == key(search.cosines(q, rows, 5))


def test_fusion_keeps_documents_of_one_side(spark, tmp_path):
    texts = ["alpha beta", "gamma delta", "alpha gamma", "omega", "alpha"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha"), (9, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0]), (50, [1.0, 0.0])]  # 4 and item 9 have none, 50 is no document
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.item_id, r.doc_id): r.score for r in kb.hybrid_fusion(spark, str(tmp_path)).collect()}
    bm25 = {(r.item_id, r.id): r.bm25_norm for r in search.max_normalised(kb._index(spark, str(tmp_path)).scores(spark.read.parquet(f"{tmp_path}/benchmark.parquet"), "item_id", F.col("text")), "item_id", "bm25").collect()}
    cos = {(0, 0): 1.0, (0, 1): 0.5**0.5, (0, 3): 1.0}
    assert set(bm25) == {(0, 0), (0, 2), (0, 4), (9, 1), (9, 2)}
    assert got == {k: pytest.approx(0.5 * bm25.get(k, 0.0) + 0.5 * cos.get(k, 0.0), abs=1e-5) for k in bm25.keys() | cos.keys()}


def test_csv_sections_hold_all_rows_in_bounded_texts(spark, tmp_path):
    rows = [(i + 1, "hot" if i % 3 else f"b{i % 2}", f"part {i}", i % 50) for i in range(2500)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, b, name, size in rows:
        want.setdefault((b, (k - 1) // 1000), []).append(f"(row {k + 1}) p brand: {b}; p name: {name}; p size: {size}.")
    import hashlib

    got = {(r.heading, r.section): r.text_md5 for r in kb.csv_grouped(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5("\n".join(v).encode()).hexdigest() for k, v in want.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_cooldown_streams_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", None if i % 11 == 0 else "k", float(rng.randrange(40000))) for i in range(20000)]
    want, last = {}, {}
    for i, c, k, t in sorted(rows, key=lambda x: (x[3], x[0])):
        want[i] = (c, k) not in last or t - last[c, k] >= 45.0
        last[c, k] = t if want[i] else last[c, k]
    got = live.cooldown(spark.createDataFrame(rows, "i long, call string, kind string, t double"), ["call", "kind"], "t", 45.0, "i")
    assert {r.i: r.emitted for r in got.collect()} == want and "collect_list" not in _plan(got)


def test_keepers_stream_a_large_group(spark):
    rng = random.Random(3)
    when = {i: f"2020-{rng.randrange(1, 13):02d}" for i in range(120)}
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if rng.random() < 0.5] + [(200, 201), (201, 202)]
    when |= {200: "2020-01", 201: "2020-01", 202: "2020-02"}
    gone = {}
    for a, b in sorted(pairs):
        if not (a in gone and b in gone):
            loser, keeper = (a, b) if a in gone or (b not in gone and when[b] > when[a]) else (b, a)
            gone.setdefault(loser, keeper)
    got = dedup.resolve_near(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(when.items()), "id long, d string"), "id", ["d"])
    assert {r.id: r.superseded_by for r in got.collect()} == gone and "flatmapgroups" not in _plan(got)


def _recall(index, exact, q, probes):
    found = {(r.query_id, r.id) for r in index.search(q, 5, probes).collect()}
    return len(found & exact) / len(exact)


def test_vector_lists_against_the_exact_scan(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import vectors

    # The given vectors, which hardly lie in groups, at two sizes: seven tenths of the lists.
    for sf in ("sf0.01", "sf0.1"):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
        q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
        exact = {(r.query_id, r.id) for r in search.ranked(search.cosines(q, e, 5).withColumn("cosine", F.round("cosine", 6)), "query_id", "cosine", 5).collect()}
        index = vectors.VectorLists(e)
        assert _recall(index, exact, q, -(-7 * len(index.shared.value) // 10)) >= 0.9
        assert _recall(index, exact, q, len(index.shared.value)) == 1.0
    # Vectors in groups, one of them with a third of all rows: a tenth of the lists, in blocks of few rows.
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    group = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 40, 1500))
    x = centre[group] + 0.15 * rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, []), (9002, [1.0]), (9003, [float("nan")] * 16), (None, x[0].tolist()), (9004, [0.0] * 16)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    q = e.where("id % 100 = 0 AND id < 9000").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    whole = e.where("id < 9000 AND id IS NOT NULL")
    exact = {(r.query_id, r.id) for r in search.ranked(search.cosines(q, whole, 5).withColumn("cosine", F.round("cosine", 6)), "query_id", "cosine", 5).collect()}
    monkeypatch.setattr(vectors, "ROWS", 10)
    index = vectors.VectorLists(e, sample=700)
    assert index.rows.count() == 1501 and index.sizes.agg(F.max("blocks")).head()[0] >= 3
    assert _recall(index, exact, q, 4) >= 0.9
    nothing = vectors.VectorLists(e.limit(0))
    assert nothing.search(q, 5, 1).count() == 0 and index.search(q.limit(0), 5, 1).count() == 0


def test_near_duplicates_move_no_pairs_of_frequent_words(spark, monkeypatch):
    """Texts that share their words but are no near copies: pairs become rows only where their sketches allow it."""
    import random

    rng, seen, real = random.Random(3), [], dedup._candidates
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 120)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.replace(t.split()[0], "other", 1)) for i, t in enumerate(texts[:20])] + [(2000 + i, "one two") for i in range(3)]
    monkeypatch.setattr(dedup, "LEAST_BLOCK", 64)
    monkeypatch.setattr(dedup, "_candidates", lambda *a: seen.append(real(*a).count()) or real(*a))
    df = spark.createDataFrame(rows, "id long, t string").withColumn("m", F.lit("x"))
    found = {(r.a, r.b) for r in dedup.near_duplicates(df, "id", "t", "m").collect()}
    assert found == {(i, 1000 + i) for i in range(20)} and seen[0] <= 40


def test_retrieval_verdict_makes_one_index(spark, monkeypatch):
    made, real = [], kb.search.Index.scores
    monkeypatch.setattr(kb.search.Index, "scores", lambda self, *a: made.append(self) or real(self, *a))
    assert kb.retrieval_verdict(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1


def test_the_best_scores_are_found_without_moving_pairs(spark, monkeypatch):
    """What scores() leaves for the k best of each class is what all pairs give, copies and ties included, and no pair is written."""
    rng, written, real = random.Random(5), [], search.cut
    words = ["common", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choices(words, [40] + [1] * 30, k=rng.randint(1, 12))) for _ in range(400)]
    texts += texts[:100] + ["", "common"]
    docs = spark.createDataFrame([(i, t, f"k{i % 3}") for i, t in enumerate(texts)], "id long, text string, kind string").repartition(3)
    items = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=6)), i % 2) for i in range(40)] + [("none", "absent", 0)], "q string, text string, want int")
    classes = spark.createDataFrame([(w, f"k{k}", (w + k) % 2) for w in range(2) for k in range(2)], "want int, kind string, class int")
    index = search.Index(docs, "id", F.col("text"))
    every = index.scores(items, "q", F.col("text")).withColumn("bm25", F.round("bm25", 6)).join(docs, "id").join(items.drop("text"), "q").join(classes, ["want", "kind"]).collect()
    monkeypatch.setattr(search, "cut", lambda df: written.append(real(df)) or written[-1])
    found = {c: index.scores(items, "q", F.col("text"), 3, *c).collect() for c in ((), (docs.select("id", "kind"), classes))}
    assert max(w.count() for w in written) < len(every) / 4
    plain = index.scores(items, "q", F.col("text")).withColumn("bm25", F.round("bm25", 6)).collect()
    first = lambda rows, key, of: {k: sorted((of(r), r.id) for r in rows if key(r) == k)[:3] for k in {*map(key, rows)}}
    assert first(found[()], lambda r: r.q, lambda r: -r.bm25) == first(plain, lambda r: r.q, lambda r: -r.bm25)
    top, named = {}, {(r.q, r.id): r["class"] for r in every}
    for r in every:
        top[r.q] = max(top.get(r.q, 0.0), r.bm25)
    share = lambda r: -round(r.bm25 / top[r.q], 6) if top[r.q] > 0 else 0.0
    some = next(v for c, v in found.items() if c)
    assert first(some, lambda r: (r.q, named[r.q, r.id]), share) == first(every, lambda r: (r.q, r["class"]), share)


def test_repeated_lines_are_told_apart_and_only_once_moved(spark):
    """Lines were shuffled with their texts and norms several times; rows with one id and rows without one stay as they are."""
    long, other = "this line is in several of the documents", "and another that only two of them have"
    rows = [(3, f"{long}\nown three"), (1, f"{other}\n{long.upper()}!\n{long}"), (1, f"{long}\nx"), (None, f"{other}\nwe use cookies, {long}"), (2, f"we use cookies, {long}\n{long}")]
    lines = clean.lines_of(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    at = lambda got: sorted((r.id is not None, r.id or 0, r.line_no, r.line, r.status) for r in got.collect())

    def want(threshold):
        all_lines = lines.collect()
        docs, first = {}, {}
        for r in all_lines:
            docs.setdefault(r.norm, set()).add(r.id)
            if "cookies" not in r.line:
                key = (r.id is not None, r.id or 0, r.line_no)
                first[r.norm] = min(first.get(r.norm, key), key)
        status = lambda r: "boilerplate" if "cookies" in r.line else "repeated" if len(r.norm) > 25 and len(docs[r.norm]) >= threshold and (r.id is not None, r.id or 0, r.line_no) != first[r.norm] else "kept"
        return sorted((r.id is not None, r.id or 0, r.line_no, r.line, status(r)) for r in all_lines)

    for threshold in (1, 2, 3, 4):
        got = clean.clean_lines(lines, threshold)
        assert at(got) == want(threshold) and sorted(got.columns) == sorted([*lines.columns, "status"])
    plan = clean.cleaned_documents(clean.clean_lines(lines))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan[: plan.find("Initial Plan") if "Initial Plan" in plan else None].splitlines() if "Exchange" in x]
    assert len(moved) <= 3 and "norm#" not in plan


def test_explained_hits_move_no_texts(spark):
    """Few hits go to the documents, whose texts stay where they are, also where a table of the documents' size would be moved."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        plan = kb.explained_hits(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_near_duplicates_lose_no_pair_of_sizes_and_blocks(spark, monkeypatch):
    """Copies changed by little or much, longer and shorter, over many blocks, against brute force."""
    import random

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}x" for _ in range(4000)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([2, 5, 12, 40, 120]))]
        texts.append(text)
        for share in (0.05, 0.2, 0.35):
            other = [w if rng.random() > share else rng.choice(words) for w in text]
            texts += [other, text[: max(1, int(len(text) * (1 - share)))], text + other[: int(len(text) * share)]]
    texts = ["K" + " ".join(t) + "İ\n é?" for t in texts] + ["", "?!", None]
    monkeypatch.setattr(dedup, "LEAST_BLOCK", 8)
    df = spark.createDataFrame([*enumerate(texts)], "id long, t string").withColumn("m", F.lit("x"))
    norm = [r.n for r in df.orderBy("id").select(X.norm_text(F.coalesce("t", F.lit(""))).alias("n")).collect()]
    assert norm == [b" ".join(dedup._words(t)).decode() for t in texts]
    sets = {}
    for i, t in enumerate(norm):
        w = t.split()
        if w and t not in norm[:i]:
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}, {x for x in w if len(x) > 2}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {}
    for a in sets:
        for b in (b for b in sets if b > a):
            s, (na, nb) = jaccard(sets[a][0], sets[b][0]), sorted((len(sets[a][1]), len(sets[b][1])))
            s = round(s if na == 0 or na < 0.5 * nb else max(s, 0.9 * jaccard(sets[a][1], sets[b][1])), 6)
            if s >= 0.55:
                want[a, b] = s
    assert {(r.a, r.b): r.similarity for r in dedup.near_duplicates(df, "id", "t", "m").collect()} == want and len(want) > 100


def test_near_duplicates_look_at_few_pairs(monkeypatch):
    """Pairs that share no rare word are not even looked at, though all texts share their frequent words."""
    import numpy as np
    import pyarrow as pa

    rng, looked, real = np.random.default_rng(7), [], dedup._alike
    often = [f"often{i}" for i in range(60)]
    texts = [" ".join([*rng.choice(often, 40, replace=False), *(f"rare{x}" for x in rng.integers(0, 100_000, 40))]) for _ in range(1000)]
    texts += [t.replace(t.split()[3], "other") for t in texts[:20]]

    class Shared:
        value = {}

    for kind, (token, _) in dedup._sets(pa.array(texts[:1000])).items():
        found, n = np.unique(token, return_counts=True)
        Shared.value[kind] = found[n > 2], n[n > 2]
    columns = [pa.array([x] * len(texts)) for x in ("x",)] + [pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)]
    rows = pa.RecordBatch.from_arrays(columns, ["market", "id", "parent", "text"])
    t = pa.Table.from_batches([b for b in dedup._sketched(Shared, {"sh": 0.55, "un": 0.61}, [rows]) if b.column("kind")[0].as_py() == "un"])
    side = dedup._Side(t, 8)
    monkeypatch.setattr(dedup, "_alike", lambda left, right, p, q, x: looked.append(len(p)) or real(left, right, p, q, x))
    pairs = {(int(a), int(b)) for p, q in dedup._near(side, side, 0.61, True) for a, b in zip(p, q) if a != b}
    assert pairs >= {(i, 1000 + i) for i in range(20)} and sum(looked) < 20_000  # of 519,690


def test_best_scores_leave_out_pairs_that_cannot_be_among_them(monkeypatch):
    """The k best by rare terms are those of all pairs, for two classes of records, and few pairs are scored by all terms."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import scoring

    rng, scored, real = np.random.default_rng(3), [], scoring.Best._by_all_pairs
    words, n = np.array([f"t{x}" for x in range(3000)]), 12_000
    share = 1 / np.arange(1, 3001) ** 0.8
    draw = lambda m: words[rng.choice(3000, m, p=share / share.sum())]
    tokens = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([draw(40).tolist() for _ in range(n)])], ["id", "tokens"])
    posts = pa.Table.from_batches(scoring.counted(iter([tokens]))).append_column("kind", pa.array(np.arange(n, dtype=np.int32) % 3))
    queries = [sorted(set(draw(8).tolist())) for _ in range(200)]
    weight = {w: float(np.log(1 / min(0.9, x)) / 2) for w, x in zip(words, 40 * share / share.sum())}
    table = np.array([[0, 1, 0], [0, 0, -1], [-1, -1, -1]], np.int16)
    block = scoring.Block.of(pa.array(range(200)), queries, [[weight[t] for t in q] for q in queries], 40.0, want=np.arange(200) % 3, by_kind=table)

    class Shared:
        value = [block]

    monkeypatch.setattr(scoring.Best, "_by_all_pairs", lambda self, b, *a: scored.append(b.num_rows) or real(self, b, *a))
    got = {}
    for b in scoring.best(Shared, iter(posts.combine_chunks().to_batches()), 3):
        for q, i, v in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault((q, int(table[q % 3, i % 3])), []).append((-v, i))
    scores, shared = block.scored(posts.combine_chunks().to_batches()[0])
    for q in range(200):
        for c in range(2):
            own = [(-round(float(scores[q, i]), 6) + 0.0, i) for i in np.flatnonzero(shared[q] & (table[q % 3][np.arange(n) % 3] == c))]
            assert sorted(got.get((q, c), []))[:3] == sorted(own)[:3]
    assert sum(scored) < n // 3


def test_expand_asks_for_the_query_once(spark):
    rows = spark.createDataFrame([("old price",), ("cold",), (None,)], "said string")
    expanded = search.expand(F.upper("said"), {"old": ["age"], "price": ["premium"], "x": ["y"]})
    assert [r[0] for r in rows.select(expanded).collect()] == ["OLD PRICE age premium", "COLD", None]
    assert str(expanded).count("said") == 1
