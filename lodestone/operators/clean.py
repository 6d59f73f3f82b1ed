"""Line cleaning across documents, record ids, versions, manifests, quality flags, classification."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.store import cut

# Lines that are furniture of a page, and those that say nothing.
BOILERPLATE = [
    r"(?i)we use cookies",
    r"(?i)all rights reserved",
    r"(?i)^\W*(©|copyright)\b",
    r"(?i)^(home|plans|faq|partners|claims|customer login|accept)$",
    r"(?i)privacy policy\s*\|",
    r"(?i)limited period offer",
    r"(?i)^(exported by|internal only|contains customer details)",
    r"^-{3,}$",
    r"(?i)^\(?superseded by .*retained for reference\)?$",
]
IRRELEVANT = [r"\bwindow\.dataLayer\b", r"^\s*$"]
# Flags of a record, and facts that records may contradict each other in, with the number of groups.
RECORD_FLAGS = {
    "zero_premium_value": r"(?i)premium[^.\n]*:\s*0\b|annual premium excl gst:\s*0\b",
    "placeholder_value": r"(?i)pending approval|tbd|to be confirmed",
    "explicit_outdated_statement": r"(?i)THIS LINE IS OUTDATED|legacy text",
}
FACTS = {
    "essential_entry_age": (r"(?i)essential[^.\n]{0,80}?entry age (\d{2})\s*(?:to|-)\s*(\d{2})", 2),
    "network_hospitals": (r"(?i)(\d[\d,]{3,6})\+?\s*network hospitals", 1),
    "claim_tat_days": (r"(?i)average of (\d+) working days", 1),
    "members": (r"(?i)(\d\.\d) million members", 1),
}
# Categories and their keywords; the weight of a question mark is damped.
CATEGORIES = {
    "waiting_periods": ["waiting period", "30 days", "36 months", "24 months", "12 months", "survival period", "initial waiting"],
    "exclusions": ["exclusion", "not covered", "excluded", "cosmetic", "infertility", "self-inflicted", "war", "experimental"],
    "claims": ["claim", "cashless", "reimbursement", "pre-authorisation", "discharge", "settle", "network hospital", "documents"],
    "eligibility_underwriting": ["entry age", "underwrit", "medical examination", "medical test", "bmi", "loading", "accept", "decline", "refer", "hba1c", "tobacco", "smoker", "ppme", "pre-policy"],
    "qualification_rules": ["lead", "qualified", "referred", "not eligible", "voice agent", "tele-sales", "capture"],
    "premium_pricing": ["premium", "rate", "gst", "discount", "pay monthly", "frequency", "annual premium", "cost", "price", "zone"],
    "objection_handling": ["objection", "approved response", "do not:", "reframe", "competitor", "discuss with my spouse"],
    "compliance": ["disclosure", "solicitation", "prohibited", "must not", "recorded for quality", "do-not-call", "rebating", "section 41"],
    "product": ["sum insured", "floater", "room rent", "restoration", "rider", "maternity", "add-on", "plan", "cover", "benefit", "feature"],
    "policy_terms": ["means", "definition", "grace period", "free look", "free-look", "renewal", "renewab", "cancellation", "nomination", "grievance", "portab"],
    "partnership": ["partner", "commission", "outlet", "posp", "corporate agent"],
    "forms": ["field ", "proposal form", "required)", "optional)"],
    "customer_service": ["ticket", "resolution:", "issue:"],
    "company": ["irdai", "licensed", "head office", "branches", "since 2011", "members", "settlement ratio", "about"],
    "faq": ["?"],
}
DAMP = {"faq": 0.4}
# What the name of a record's file adds to a category. Names of particular products are left to the caller.
PRIORS = [
    (r"underwriting_rules", "eligibility_underwriting", 2.0),
    (r"objection", "objection_handling", 4.0),
    (r"compliance", "compliance", 4.0),
    (r"plan_rates", "premium_pricing", 4.0),
    (r"proposal_form", "forms", 5.0),
    (r"customer_service", "customer_service", 3.0),
    (r"partners", "partnership", 3.0),
    (r"policy_wording", "policy_terms", 1.5),
    (r"faq", "faq", 1.0),
    (r"plans\.html|brochure", "product", 1.5),
    (r"index\.html", "company", 1.5),
    (r"bancassurance|philippines", "product", 1.2),
    (r"indonesia|cicilan", "product", 1.2),
]
# Kinds of cover that a text names, and the intents of a category.
PRODUCTS = {
    "essential": r"(?i)\bessential\b",
    "family_shield": r"(?i)\bfamily shield\b",
    "senior_care": r"(?i)\bsenior care\b",
    "critical_illness_rider": r"(?i)\bcritical illness\b",
    "hospital_cash_rider": r"(?i)\bhospital cash\b",
    "copay_waiver_rider": r"(?i)\bco-payment waiver\b",
    "opd_rider": r"\bOPD\b",
    "credit_life": r"(?i)\bcredit life\b",
}
INTENTS = {
    "product": ["product"], "premium_pricing": ["product", "faq"], "policy_terms": ["policy"], "waiting_periods": ["policy", "faq"],
    "exclusions": ["policy"], "claims": ["policy", "faq"], "eligibility_underwriting": ["qualification"], "qualification_rules": ["qualification"],
    "objection_handling": ["objection"], "compliance": ["compliance"], "faq": ["faq"], "partnership": ["product"], "forms": ["qualification"],
    "customer_service": ["faq"], "company": ["product", "faq"],
}


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, norm), from 0 on."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line")).withColumn("norm", X.norm_line(F.col("line")))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, each with its own regard to case."""
    # Apart, a pattern that begins with plain letters is looked for by these.
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def repeated_lines(lines: DataFrame, threshold: int = 2, min_chars: int = 25) -> DataFrame:
    """(norm, n_docs) of the lines longer than min_chars that at least `threshold` documents hold."""
    return lines.where(F.length("norm") > min_chars).groupBy("norm", "id").agg(F.lit(1)).groupBy("norm").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= threshold)


def clean_lines(lines: DataFrame, threshold: int = 2, min_chars: int = 25, boilerplate=BOILERPLATE, irrelevant=IRRELEVANT) -> DataFrame:
    """Adds `status`: boilerplate, irrelevant, repeated (not the first in document order) or kept.

    Lines longer than min_chars are told apart by the MD5 of their norm. By it a line's documents and its first holder are found,
    as grouped minima and maxima, so that a line that most documents hold is counted in each task first. Only these keys are
    moved; what repeats is told to its document by number, and a text is moved once, to its document.
    """
    flagged = cut(keyed(lines, min_chars, boilerplate, irrelevant).drop("norm"))
    repeats = repeats_of(flagged, threshold).withColumn("_repeat", F.lit(True))
    both = flagged.withColumn("_repeat", F.lit(False)).unionByName(repeats, allowMissingColumns=True).repartition("id")
    out = both.withColumn("_any", F.max("_repeat").over(W.partitionBy("id", "line_no", "_key"))).where(~F.col("_repeat"))
    out = out.withColumn("status", F.coalesce("own", F.when(F.col("_any"), "repeated"), F.lit("kept"))).withColumn("norm", X.norm_line(F.col("line")))
    return out.select(*lines.columns, "status")


def keyed(lines: DataFrame, min_chars: int = 25, boilerplate=BOILERPLATE, irrelevant=IRRELEVANT) -> DataFrame:
    """Adds own (what pattern drops the line, or null) and _key (the MD5 of the norm of lines longer than min_chars)."""
    flagged = lines.withColumn("own", F.when(any_of(F.col("line"), boilerplate), "boilerplate").when(any_of(F.col("line"), irrelevant), "irrelevant"))
    return flagged.withColumn("_key", F.when(F.length("norm") > min_chars, F.unhex(F.md5("norm"))))


def repeats_of(flagged: DataFrame, threshold: int) -> DataFrame:
    """flagged: _key (null for lines that are not told apart), id, line_no and own (what pattern drops a line, or null). (_key, id,
    line_no) of the lines without a pattern that at least `threshold` documents hold, but for the first in document order."""
    held, at = flagged.select("_key", "id", "line_no", "own").where("_key IS NOT NULL"), F.struct("id", "line_no")
    # Repeats are counted over all lines; the first occurrence only over those that no pattern drops.
    often = held.groupBy("_key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bool_or(F.col("id").isNull()).alias("no_id"), F.min(F.when(F.col("own").isNull(), at)).alias("first")).where("first IS NOT NULL")
    if threshold >= 2:
        often = often.where("a <> b OR (no_id AND a IS NOT NULL)")
    often = cut(often.select("_key", "first"))
    if threshold > 2:
        docs = held.join(often, "_key", "left_semi").groupBy("_key", "id").agg(F.lit(1)).groupBy("_key").agg(F.count("*").alias("n"))
        often = cut(often.join(docs.where(F.col("n") >= threshold), "_key", "left_semi"))
    return held.where("own IS NULL").join(often, "_key").where(at != F.col("first")).select("_key", "id", "line_no")


def cleaned_documents(lines: DataFrame) -> DataFrame:
    """clean_lines() put together again: (id, text, raw_chars, clean_chars)."""
    kept = F.when(F.col("status") == "kept", F.struct("line_no", "line"))
    out = lines.groupBy("id").agg(F.sum(F.length("line")).alias("raw_chars"), F.sum(F.when(F.col("status") == "kept", F.length("line")).otherwise(0)).alias("clean_chars"), F.array_sort(F.collect_list(kept)).alias("kept"))
    return out.select("id", F.array_join(F.transform("kept", lambda x: x.line), "\n").alias("text"), "raw_chars", "clean_chars")


def cleaning_stats(lines: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return lines.agg(F.count("*").alias("lines"), n("boilerplate").alias("boilerplate"), n("irrelevant").alias("irrelevant"), n("repeated").alias("repeated"), n("kept").alias("kept"))


def record_ids(records: DataFrame, market: str, category: str, order: list[str]) -> DataFrame:
    """Adds record_id kb_<market in small letters>_<category>_<nnn>, numbered within market and category in document order. Records are dealt by
    ranges of that order and numbered within each, after those of the ranges before, so that a large category takes many tasks."""
    dealt = cut(records.repartitionByRange(market, category, *order).withColumn("_range", F.spark_partition_id()))
    group = [F.col(market).alias("_m"), F.col(category).alias("_c"), F.col("_range").alias("_r")]
    before = F.sum("count").over(W.partitionBy("_m", "_c").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    counts = cut(dealt.groupBy(*group).count().withColumn("_before", F.coalesce(before, F.lit(0))).drop("count"))
    own = dealt.withColumn("_n", F.row_number().over(W.partitionBy(market, category, "_range").orderBy(*order)))
    same = F.col(market).eqNullSafe(F.col("_m")) & F.col(category).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r"))
    n = F.col("_n") + F.col("_before")
    return own.join(counts, same).withColumn("record_id", F.format_string("kb_%s_%s_%03d", F.lower(market), F.col(category), n)).select(*records.columns, "record_id")


def versioned(records: DataFrame, previous: DataFrame, id_col: str = "record_id", hash_col: str = "content_hash") -> DataFrame:
    """Adds version: 1.1 where the last build had the record with another hash, else 1.0."""
    old = previous.select(F.col(id_col), F.col(hash_col).alias("_old"))
    return records.join(old, id_col, "left").withColumn("version", F.when(F.col("_old") != F.col(hash_col), "1.1").otherwise("1.0")).drop("_old")


def content_digest(records: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """SHA-1, 8 digits, of the sorted hashes; over digests of 4,096 ranges of them, so no task needs all."""
    part = F.substring(hash_col, 1, 3)
    ranges = records.groupBy(part.alias("part")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(hash_col)), "")).alias("d"))
    return ranges.agg(F.count("*").alias("ranges"), F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat("part", "d"))), "")), 1, 8).alias("digest"))


def kb_version(today: str, digest: str, last: tuple[str, str] | None) -> str:
    """YYYY.MM.DD-N; N goes up only on the same day and with another digest. last: (version, digest)."""
    day = today.replace("-", ".")
    if last is None or last[0].partition("-")[0] != day:
        return f"{day}-1"
    n = int(last[0].partition("-")[2])
    return f"{day}-{n + (last[1] != digest)}"


def manifest(records: DataFrame, market: str, category: str) -> DataFrame:
    """One row: n, by_market and by_category as maps."""
    m = records.groupBy(F.col(market).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("by_market"), F.sum("count").alias("n"))
    c = records.groupBy(F.col(category).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("by_category"))
    return m.crossJoin(c).select("n", "by_market", "by_category")  # one row each


def document_flags(docs: DataFrame, text: str, file: str, date: str, before: str = "2024-01-01", old_file: str = "2023") -> DataFrame:
    """Adds flags and superseded. Dates are compared as strings."""
    stale = F.col(text).rlike("(?i)superseded by|retained for reference|outdated")
    older = F.col(file).contains(old_file) | F.coalesce(F.col(date) < before, F.lit(False))
    return docs.withColumn("flags", F.array_compact(F.array(F.when(stale, "contains_outdated_text"), F.when(older, "older_edition")))).withColumn("superseded", older)


def record_flags(text: Column, rules: dict[str, str] = RECORD_FLAGS) -> Column:
    """Names of the patterns that the text has, in the rules' order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in rules.items())))


def facts(records: DataFrame, id_col: str, text: Column, patterns: dict[str, tuple[str, int]] = FACTS) -> DataFrame:
    """patterns: fact -> (pattern, number of groups). (id, fact, value) of all matches; a value is its groups joined by -. The
    records are read once, whatever the number of patterns."""

    def found(fact: str, pattern: str, n: int) -> Column:
        groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, n + 1)))
        value = lambda x: F.array_join(F.filter(F.array(*(x[f"g{g}"] for g in range(1, n + 1))), lambda v: v != ""), "-")
        return F.transform(groups, lambda x: F.struct(F.lit(fact).alias("fact"), value(x).alias("value")))

    every = F.flatten(F.array(*(F.coalesce(found(f, p, n), F.array().cast("array<struct<fact:string,value:string>>")) for f, (p, n) in patterns.items())))
    return records.select(F.col(id_col).alias("id"), F.explode(every).alias("x")).select("id", "x.fact", "x.value")


def conflicts(found: DataFrame, shown: int = 3) -> DataFrame:
    """(fact, value, n_records, first_ids) of the facts with more than one value. Ids are kept to the smallest few by value."""
    rows = cut(found.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256))))
    sizes = rows.groupBy("fact", "value").agg(F.count("*").alias("n_records"))
    # The smallest ids of each part of a value's records, then of all: no task needs all records of a value.
    some = rows.withColumn("nth", F.row_number().over(W.partitionBy("fact", "value", "part").orderBy("id"))).where(F.col("nth") <= shown)
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("fact", "value").orderBy("id"))).where(F.col("nth") <= shown)
    by_value = some.join(sizes, ["fact", "value"]).groupBy("fact", "value", "n_records").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x.id.cast("string")), ", ").alias("first_ids"))
    many = rows.groupBy("fact", "value").agg(F.lit(1)).groupBy("fact").agg(F.count("*").alias("values")).where("values > 1").select("fact")
    return by_value.join(many, "fact", "left_semi")


def conflict_flags(found: DataFrame) -> DataFrame:
    """(id, flags): conflicting_fact:<fact> for each record that states a fact of which records state more than one value."""
    some = found.distinct()
    many = cut(some.groupBy("fact", "value").agg(F.lit(1)).groupBy("fact").agg(F.count("*").alias("values")).where("values > 1").select("fact"))
    return some.join(many, "fact", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.concat(F.lit("conflicting_fact:"), "fact"))).alias("flags"))


def keyword_score(title: Column, text: Column, keywords: list[str]) -> Column:
    """Counts keywords in title and text: the first occurrence 1, each of four more 0.3, twice that if the title has it."""
    return _keyword_score(F.lower(F.concat(title, F.lit("\n"), text)), F.lower(title), keywords)


def _keyword_score(whole: Column, head: Column, keywords: list[str]) -> Column:
    """As keyword_score(), of lower-cased text that has the title in it."""

    def score(k: str) -> Column:
        weight = F.when(F.contains(head, F.lit(k)), 2.0).otherwise(1.0)
        many = X.let(F.regexp_count(whole, F.lit(re.escape(k))), lambda n: (1.0 + 0.3 * F.least(n - 1, F.lit(4.0))) * weight)
        # Most keywords are not there, and plain letters are found without a pattern.
        return F.when(F.contains(whole, F.lit(k)), many).otherwise(0.0)

    return reduce(lambda a, b: a + b, map(score, keywords), F.lit(0.0))


def classify(records: DataFrame, title: Column, text: Column, categories: dict[str, list[str]] = CATEGORIES, fallback: str = "faq", damp: dict[str, float] | None = None, file: Column | None = None, priors: list[tuple[str, str, float]] = ()) -> DataFrame:
    """Adds category, subcategory and category_score. Ties go to the category named first; without a hit it is `fallback`.
    priors: (pattern, category, weight) in turn add the weight to the category of a record whose file has the pattern."""

    def scores(x: Column) -> Column:
        out = []
        for i, (c, kws) in enumerate(categories.items()):
            score = _keyword_score(x["whole"], x["head"], kws)
            for pattern, category, weight in priors if file is not None else ():
                if category == c:
                    score = score + F.when(F.coalesce(file, F.lit("")).rlike(pattern), weight).otherwise(0.0)
            out.append(F.struct((-F.round(score * (damp or {}).get(c, 1.0), 6)).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("name")))
        return F.array_sort(F.array(*out))

    # Lower-cased once for each record, not for each keyword.
    base = F.struct(F.lower(F.concat(title, F.lit("\n"), text)).alias("whole"), F.lower(title).alias("head"))
    out = records.withColumn("_s", X.let(base, scores))
    best, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    sub = F.when((-second.neg >= 0.6 * -best.neg) & (-second.neg > 1), second["name"])
    return out.withColumn("category", F.when(best.neg < 0, best["name"]).otherwise(fallback)).withColumn("subcategory", sub).withColumn("category_score", -best.neg + 0.0).drop("_s")


def tags(text: Column, patterns: dict[str, str] = PRODUCTS) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in patterns.items())))


def intents(category: Column, table: dict[str, list[str]] = INTENTS, extra: Column | None = None) -> Column:
    """Sorted, distinct intents of a category and, where given, of the tags."""
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(known[category], F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(own if extra is None else F.concat(own, extra)))


def first_per(records: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first record of each group: a grouped minimum, no sort of a group."""
    return records.groupBy(by).agg(F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r")).select("r.*")


def tail(log: DataFrame, position: str, n: int, value: str, schema: str) -> DataFrame:
    """The last n lines, those that are no JSON dropped after, latest first."""
    last = log.orderBy(F.col(position).desc()).limit(n)
    return last.withColumn("parsed", F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).where(F.col("parsed._bad").isNull() & F.col(value).isNotNull()).orderBy(F.col(position).desc())
