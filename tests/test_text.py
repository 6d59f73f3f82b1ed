from pyspark.sql import functions as F

from lodestone.functions import pii
from lodestone.functions import text as X


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "t string").select(of(F.col("t")).alias("x")).first()["x"]


def test_dates_become_iso(spark):
    assert one(spark, "on 5/3/2024, Mar 7, 2024 and 21st March 2024; 45/3/2024", X.normalize_dates) == "on 2024-03-05, 2024-03-07 and 2024-03-21; 45/3/2024"
    assert one(spark, "call 1800-022-055 or 1234-012-34", X.normalize_dates) == "call 1800-022-055 or 1234-012-34"
    assert one(spark, "12 Mar 2024 Apr 2025, 7-dec-2021, Smarch 1, 2020, 31/13/2024, 01/12/2024", X.normalize_dates) == "2024-03-12 Apr 2025, 2021-12-07, Smarch 1, 2020, 31/13/2024, 2024-12-01"
    assert one(spark, None, X.normalize_dates) is None
    assert one(spark, "none", X.first_date) is None
    assert one(spark, "from 31/12/2023 to 1/1/2024", X.first_date) == "2023-12-31"


def test_first_date_is_the_earliest(spark):
    assert one(spark, "in October 2023, since 2020-01-02", X.first_date) == "2023-10-01"
    assert one(spark, "Smarch 12, 2020; 07-feb-2021, 3/4/2019", X.first_date) == "2021-02-07"
    assert one(spark, "5 May 2019", X.first_date) == "2019-05-05"
    assert one(spark, "x" * 600 + " 2020-01-02", X.first_date) is None and one(spark, None, X.first_date) is None and one(spark, "", X.first_date) is None


def test_page_says_when_it_was_updated(spark):
    of = lambda t: X.page_date(t, F.lit("2020-01-02"))
    assert one(spark, "<i>last updated on 31/12/2024</i>", of) == "2024-12-31" and one(spark, "updated 31/12/2024", of) == "2020-01-02"


def test_terms(spark):
    of = lambda t: X.normalize_text(t, names=["Acme Plus"])
    assert one(spark, "Co payments  upto Rs. 5 lacs on 5/3/2024, ACME PLUS", of) == "co-payment up to Rs 5 lakh on 2024-03-05, Acme Plus"
    assert one(spark, "PEDs of 2 yrs, peds", X.normalize_terms) == "pre-existing disease of 2 years, peds" and one(spark, None, of) is None


def test_white_space_at_the_edges(spark):
    assert one(spark, "\n abc \t d \n e\n ", X.normalize_whitespace) == "abc d\ne"
    assert one(spark, "\u00a0it\u2019s \u2013 so\u2014", X.normalize_whitespace) == "it's - so-"


def test_versions(spark):
    for text, version in (("Plan v2.1 of", "2.1"), ("Version 3", "1.0"), ("VERSION 2024.3,", "2024.3"), ("version 1.2.3", "1.2.3"), ("", "1.0"), ("x" * 800 + " v2.1", "1.0"), ("rev2.1", "1.0")):
        assert one(spark, text, X.version_of) == version


def test_questions_on_a_call(spark):
    call = lambda t: X.is_question(t, X.ASKED)
    assert one(spark, "magkano po", call) and not one(spark, "magkano po", X.is_question) and one(spark, " Berapa ", call) and one(spark, "so?", X.is_question)


def test_loaders_name_things_like_the_columns(spark):
    from lodestone.sources.files import field_name, heading_name

    for h in ("3. Pre-existing disease (PED) grid", "SECTION A - COVER", "A Plan for you", "a plan for you", "ROOM RENT - DON'T", "2.1) Claims: ", "section B - x", "", "OPD cover", "12", "Section 4. what \u2013 now"):
        assert one(spark, h, X.standardize_heading) == heading_name(h), h
    for n in ("dateOfBirth", "Some-Field", "member_name", "memberName", "sum_insured_rs", "Sum Insured", "mobile_no", "mobileNo", "fullName", "DOB", "annual_premium_rs_excl_gst", "x__y"):
        assert one(spark, n, X.standardize_field_name).replace("_", " ") == field_name(n), n


def test_rules_apply_in_order(spark):
    assert one(spark, "a b", lambda t: X.rewrite(t, [("a", "b"), ("b b", "c")])) == "c"


def test_headings_and_names(spark):
    assert one(spark, "3. Pre-existing disease (PED) grid", X.standardize_heading) == "Pre-existing Disease (PED) Grid"
    assert one(spark, "SECTION A - COVER", X.standardize_heading) == "Cover"
    assert one(spark, "a plan for you", X.standardize_heading) == "A Plan For You" and one(spark, "A plan for you", X.standardize_heading) == "Plan For You"
    assert one(spark, "PRE-EXISTING DISEASE", X.standardize_heading) == "Pre-Existing Disease"
    assert one(spark, "dateOfBirth", X.standardize_field_name) == "date_of_birth"
    assert one(spark, "sum_insured_rs", X.standardize_field_name) == "sum_insured" and one(spark, "membername", X.standardize_field_name) == "membername"
    assert one(spark, "Some-Field", X.standardize_field_name) == "some_field"
    assert one(spark, "/A b.html", X.slug) == "a_b_html"


def test_tokens_and_shingles(spark):
    assert one(spark, "The Policies cover buses, class-action boss's x", X.tokenize) == ["policy", "cover", "buse", "class-action", "boss'"]
    assert one(spark, "a b c d", X.shingles) == ["a b c", "b c d"]
    assert one(spark, "a b", X.shingles) == ["a b"]
    assert one(spark, "", X.shingles) == []


def test_pii_precedence_and_mask():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "mail a.b@c.org, card 4111 1111 1111 1111, policy POL-123456, Dr. Ann Lee"
    assert pii.masked(text) == ("mail [EMAIL], card [CARD], [POLICY_NO], [NAME]", ["CARD", "EMAIL", "NAME", "POLICY_NO"])
    assert pii.masked(None) == (None, []) and pii.masked("") == ("", [])
    assert pii.find("2024-01-15 and 15-01-2024") == []


def test_a_question_s_word_ends_by_the_letters_named(spark):
    rows = spark.createDataFrame([("Doó ción",), ("Do we",), ("does_it",), ("Is",), ("Sure?",)], "t string")
    got = rows.select(X.is_question(F.col("t")).alias("a"), X.is_question(F.col("t"), letters=X.ASCII_LETTERS).alias("b")).collect()
    assert [r.a for r in got] == [False, True, False, True, True] and [r.b for r in got] == [True, True, False, True, True]


def test_turn_routes_matches_its_sql_on_accents(spark, tmp_path):
    import duckdb

    from lodestone.plans import live

    spark.createDataFrame([(1, 0, "Doó ción"), (1, 1, "Isña. Raado"), (2, 0, "how so"), (2, 1, None)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(tuple, live.turn_routes(spark, str(tmp_path)).collect())) == sorted(db.execute(live.ORACLES["turn_routes"]).fetchall())


def test_rounded_again_agrees_with_sql(spark):
    import duckdb

    values = [i / 1000 for i in range(1001)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.rounded(F.col("v"), 2).alias("x")).collect()]
    assert got == [r[0] for r in duckdb.execute("select round(v, 2) from (select unnest(?::double[]) as v)", [values]).fetchall()]


def test_a_text_is_computed_once_in_replacements(spark):
    """Replacements one after the other don't double the work of those before, and guarded patterns find what the plain ones do."""
    import re

    from pyspark.sql import functions as F

    from lodestone.functions import text as X

    # \s of Java is trimmed at both ends, a single blank stays, and a tab is one blank.
    said = " \t\u000b a  b\tc \n d\n\n e 31/12/2024 on Mar 7, 2024, 3rd May 2021 \f\r"
    df = spark.createDataFrame([(said,)], "t string")
    out = df.select(X.normalize_dates(X.normalize_whitespace(F.col("t"))).alias("x"))
    assert out.head().x == "a b c\nd\n\ne 2024-12-31 on 2024-03-07, 2021-05-03"
    assert out._jdf.queryExecution().analyzed().toString().count("translate(") == 1
    for p in [p for p, _ in X.TERMS] + [r"\bab|cd", r"\b(\d)?x", r"\bx?y", "plain"]:
        assert X._guarded(p).endswith(p)
    assert [X._guarded(p) for p in (r"\bab|cd", r"\b(\d)?x", r"\bx?y")] == [r"\bab|cd", r"\b(\d)?x", r"\bx?y"]
    assert X._guarded(r"(?i)\byrs?\b") == r"(?=[yY])(?i)\byrs?\b"
    norm = lambda t: re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", t.lower())).strip(" ")
    texts = ["a b", "  A--b  ", "é x.\ny", "", "a . b", ". a", "a\t b\n"]
    assert [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.norm_text(F.col("t")).alias("n")).collect()] == [norm(t) for t in texts]


def test_masking_keeps_no_batch_of_texts(spark):
    """Texts go to Python by small numbers of rows, and only those that may have a finding where just kinds are asked for."""
    from pyspark.sql import functions as F

    texts = ["mail a@b.co", "NIK: 1234567890123456", "card 4111 1111 1111 1111", "1234 5678 9012", "ABCDE1234F", "1234-5678-9012-3456", "policy no ABC-12345", "+1 (555) 010-9999", "DOB: 1/2/1990", "Dr. Ann Lee", "Ginang Ana Cruz", "nothing here", "", None, "tel ٠١٢٣٤٥٦٧٨٩٠"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", pii.mask("t").alias("m"), pii.kinds("t").alias("k"), pii.may_have("t").alias("h"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = out.collect()
    assert [((r.m.masked, r.m.kinds), r.k) for r in rows] == [(pii.masked(t), pii.masked(t)[1]) for t in texts]
    assert all(r.h for r in rows if r.k) and not any(r.h for r in rows if r.t in ("nothing here", "", None))
