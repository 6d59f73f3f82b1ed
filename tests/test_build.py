"""The knowledge-base build: from files to published records, twice, and stopped half-way."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import store
from lodestone.operators import build as B
from lodestone.sources import files

HOSPITALS = "The plan has about {} network hospitals in all large towns of the country and in many of the smaller ones, where members are treated without payment."


def write(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


@pytest.fixture()
def sources(tmp_path):
    root = tmp_path / "in"
    write(root, "web/index.html", f"<title>Home | S</title><main><h1>About us</h1><p>{HOSPITALS.format('9,500')}</p><p>All rights reserved</p><p>Write to ann.lee@example.org for more of it, upto 5/3/2024.</p></main> last updated on 01/02/2024")
    write(root, "web/faq.html", "<title>Faq</title><main><h2>Claims</h2><h3>How long does a claim take?</h3><p>Claims take an average of 7 working days, and the same footer line stands here twice.</p><h3>Other</h3><p>too short</p></main>")
    write(root, "docs/brochure_2023.txt", f"BROCHURE\n\nabout us\n{HOSPITALS.format('8,900')}\n\nClaims take an average of 9 working days as a rule in this edition.")
    write(root, "docs/rules.md", "# Rules v2.1\n## Terms\nClaims take an average of 7 working days, and the same footer line stands here twice.\nGrace period and renewal are what the definition of the policy means by it.\n")
    write(root, "docs/copy.md", "# Copy\n## Terms\nGrace period and renewal are what the definition of the policy means by it!\n\nDated October 2024\n")
    write(root, "rates/plan_rates.csv", "plan,sum_insured_rs,annual_premium_rs_excl_gst\nGold,5,0\nGold,10,900\nBlue,5,700\n")
    write(root, "bad.json", "{")
    write(root, "empty.txt", " ")
    return root


def docs_of(spark, root):
    return files.read_documents(spark, [(str(root), "IN", "en")])


def test_two_builds(spark, sources, tmp_path):
    folder = str(tmp_path / "kb")
    assert B.current(spark, folder) is None
    first = B.build(spark, docs_of(spark, sources), folder, "2024-05-01")
    records = {r.record_id: r for r in first.table("records").collect()}
    by_file = lambda name: [r for r in sorted(records.values(), key=lambda r: r.n) if r.path.endswith(name)]
    documents = {r.path.rpartition("/in/")[2]: r for r in first.table("documents").collect()}
    assert {k: r.status for k, r in documents.items() if r.status != "ok"} == {"bad.json": "failed", "empty.txt": "empty"}
    assert documents["web/index.html"].doc_date == "2024-02-01" and documents["docs/rules.md"].doc_version == "2.1" and documents["docs/brochure_2023.txt"].superseded
    # Numbered in the order of files; furniture, personal data and dates are gone.
    assert [r.n for r in sorted(records.values(), key=lambda r: r.n)] == list(range(len(records)))
    (home,) = by_file("index.html")
    assert home.title == "Home > About Us" and "rights" not in home.content and "[EMAIL]" in home.content and home.pii_types == ["EMAIL"] and "up to 2024-03-05" in home.content
    # The line that stands in two documents is kept in the first of them only.
    footer = "the same footer line stands here twice"
    assert [r.path.rpartition("/")[2] for r in records.values() if footer in r.content] == ["rules.md"]
    assert by_file("faq.html") == []
    # Equal texts but for a mark: the dated one stays. The old edition loses against the page, though it comes first.
    rules, copy, old = by_file("rules.md")[0], by_file("copy.md")[0], by_file("brochure_2023.txt")
    assert copy.content.startswith("Grace period")
    assert [r.superseded for r in old] == [True, True] and not home.superseded and not rules.superseded
    assert "older_edition" in old[0].quality_flags
    gold, blue = by_file("plan_rates.csv")
    assert gold.category == "premium_pricing" and gold.record_id == "kb_in_premium_pricing_001" and blue.record_id == "kb_in_premium_pricing_002" and gold.locator == "rows for Gold"
    assert gold.quality_flags == ["zero_premium_value"] and blue.quality_flags == []
    assert "conflicting_fact:network_hospitals" in home.quality_flags and "conflicting_fact:claim_tat_days" in rules.quality_flags
    assert first.manifest["kb_version"] == "2024.05.01-1" and first.manifest["documents"] == {"empty": 1, "failed": 1, "ok": 6} and first.manifest["pieces_taken_over"] == 0
    assert first.manifest["active"] == sum(not r.superseded for r in records.values()) == first.active().count()
    hits = first.index().scores(spark.createDataFrame([(1, "network hospitals")], "q long, t string"), "q", F.col("t")).collect()
    assert [r.id for r in hits] == [home.record_id]

    # One file changes, one goes: all other pieces are taken over, and the changed record gets a version.
    write(sources, "rates/plan_rates.csv", "plan,sum_insured_rs,annual_premium_rs_excl_gst\nGold,5,800\nBlue,5,700\n")
    (sources / "docs/copy.md").unlink()
    second = B.build(spark, docs_of(spark, sources), folder, "2024-05-01")
    now = {r.record_id: r for r in second.table("records").collect()}
    # Gold, Blue (in another row), and the rules, which get back the line that the copy had before them.
    assert second.manifest["pieces_made"] == 3 and second.manifest["pieces_taken_over"] == first.table("pieces").count() - 4
    assert now[gold.record_id].version == "1.1" and now[blue.record_id].version == "1.1" and now[home.record_id].version == "1.0"
    assert now[home.record_id].content == home.content and "Grace period" in next(r.content for r in now.values() if r.path.endswith("rules.md"))
    assert second.manifest["kb_version"] == "2024.05.01-2" and B.current(spark, folder).path == second.path
    # The first build can still be read as it was.
    assert first.table("records").count() == len(records)


def test_a_stopped_build_leaves_the_old_one(spark, sources, tmp_path, monkeypatch):
    folder = str(tmp_path / "kb")
    first = B.build(spark, docs_of(spark, sources), folder, "2024-05-01")
    for step in ("records_of", "publish"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(B, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
            B.build(spark, docs_of(spark, sources), folder, "2024-05-02")
    left = B.current(spark, folder)
    assert left.path == first.path and left.manifest == first.manifest and left.active().count() == first.manifest["active"]
    assert left.index().posts.count() > 0


def test_a_build_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = B.build(spark, docs_of(spark, tmp_path / "in"), str(tmp_path / "kb"), "2024-05-01")
    assert got.manifest["records"] == 0 and got.table("records").columns == B.RECORD


def test_duplicates_of_records(spark):
    base = " ".join(f"word{i}" for i in range(30))
    rows = [
        (0, "a0", "IN", "p0", base, "2024-01-01", "1.0", False), (1, "a1", "IN", "p1", base.upper() + "!", "2024-02-01", "1.0", False),  # equal: the later date stays
        (2, "a2", "IN", "p2", base + " more", "2024-03-01", "1.0", True),  # near, superseded from the start: loses though newer
        (3, "a3", "PH", "p3", base + " other", "2024-03-01", "1.0", False),  # another market
        (4, "a4", "IN", "p1", base + " same document", "2023-01-01", "1.0", False),  # of p1: only compared to p2
        (5, "a5", "IN", "p5", base + " once more", None, "1.0", False),
    ]
    schema = "n long, record_id string, market string, path string, content string, doc_date string, doc_version string, superseded boolean"
    got = {r.n: r.dup_flags for r in B.superseded_records(spark.createDataFrame(rows, schema)).collect()}
    names = lambda k: [f.partition(" ")[0] for f in got.get(k, [])]
    assert names(0) == ["exact_duplicate_of:a1"] and names(3) == [] and names(1) == []
    assert names(2) == ["near_duplicate_of:a1", "near_duplicate_of:a4"] and names(4) == []
    # 5 has no date: it loses to 1, and then, superseded, to 4; 2 and 5 are both superseded: the less recent loses.
    assert names(5) == ["near_duplicate_of:a1", "near_duplicate_of:a2", "near_duplicate_of:a4"]


def test_numbers_go_on_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    got = [r.n for r in B.numbered(rows, ["k"]).orderBy("k").select("n").collect()]
    assert got == list(range(5000))


def test_a_build_leaves_nothing_but_itself(spark, tmp_path, monkeypatch):
    """What the steps write for themselves is deleted with them, and texts are written three times on the way."""
    text = "A line of a document that is long enough to be told apart by its key, with the number {} in it.\nThe same line stands in each of the documents, and stays in the first."
    write(tmp_path / "in", "a.txt", text.format(1))
    write(tmp_path / "in", "b.txt", text.format(2))
    shared, whole, real = tmp_path / "shared", [], store.kept

    def kept(df, path):
        out = real(df, path)
        if "/lodestone-" in path and any("long enough to be told" in str(r) for r in out.collect()):
            whole.append(out.columns)
        return out

    shared.mkdir()
    monkeypatch.setattr(store, "folder", lambda spark: str(shared))
    monkeypatch.setattr(store, "kept", kept)
    monkeypatch.setattr(B, "kept", kept)
    got = B.build(spark, docs_of(spark, tmp_path / "in"), str(tmp_path / "kb"), "2024-05-01")
    assert [r.content.count("same line stands") for r in got.table("records").orderBy("n").collect()] == [1, 0]
    assert list(shared.iterdir()) == [] and got.manifest["lines"] == {"lines": 4, "boilerplate": 0, "irrelevant": 0, "repeated": 1, "kept": 3}
    # The documents read, their sections and the records; what near duplicates are told by has no text.
    assert len(whole) == 3
