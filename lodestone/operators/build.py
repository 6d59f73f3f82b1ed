"""Building a knowledge base: documents to cleaned, masked, classified, numbered, deduplicated and flagged records, with an index
and a manifest.

A build goes to a folder of its own and is published by one file, CURRENT, that is renamed into place when all else is written:
readers see the old build or the new one. Chunks of sections that an earlier build had, by the hash of all that they are made of,
are taken over; cutting, masking and classifying runs on the others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import pii
from lodestone.functions import text as X
from lodestone.functions.store import cut, kept, place, scratch
from lodestone.operators import chunk, clean, dedup
from lodestone.operators.search import Index

#: A line in so many documents is furniture but for the first.
REPEATED = 2
STALE = r"(?i)superseded by|retained for reference|outdated"
RECORD = ["record_id", "n", "path", "market", "language", "source_type", "title", "content", "chunk_index", "kind", "locator", "category", "subcategory", "products", "intent_types", "pii_types", "content_hash", "version", "doc_version", "doc_date", "token_estimate", "quality_flags", "superseded"]


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """rows with a number from 0 on, in order. They are dealt by ranges of the order and numbered within each, after the ranges
    before, so that no task has all."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("count").over(W.partitionBy(F.lit(1)).orderBy("_of").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = cut(dealt.groupBy(F.col("_range").alias("_of")).count().withColumn("_before", F.coalesce(before, F.lit(0))).drop("count"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, own - 1).join(starts, F.col("_range") == F.col("_of")).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_of", "_before")


def cleaned_sections(docs: DataFrame, numbers: DataFrame, threshold: int = REPEATED) -> tuple[DataFrame, DataFrame]:
    """docs: row, sections and further columns; numbers: (row, n). docs' rows with n for each section that has text without
    furniture: (n, section, headings, locator, kind, text in normal form, the further columns); and one row of counts of lines by status.

    Lines are told by their keys and never moved. Whether each of a section's lines stays is told to its text, which moves once.
    """
    found = docs.select(*(c for c in docs.columns if c != "sections"), F.posexplode("sections").alias("section", "s"))
    split = F.split(F.coalesce("s.text", F.lit("")), "\n")
    lines = found.select("row", "section", F.posexplode(split).alias("at", "line")).withColumn("norm", X.norm_line(F.col("line")))
    keys = cut(clean.keyed(lines).drop("line", "norm"))
    keys = cut(keys.join(numbers, "row").select("row", F.struct("n", "row").alias("id"), F.struct("section", "at").alias("line_no"), "own", "_key"))
    repeats = cut(clean.repeats_of(keys, threshold).select("id", "line_no"))
    marks = keys.select("id", "line_no", F.col("own").isNotNull().alias("gone")).union(repeats.select("id", "line_no", F.lit(True)))
    # A line that repeats comes twice, the second time as gone: the last of each place says what it is.
    marks = marks.groupBy("id", "line_no.section").agg(F.array_sort(F.collect_list(F.struct("line_no.at", "gone"))).alias("m"))
    last = F.filter("m", lambda x, i: ~F.get(F.col("m"), i + 1)["at"].eqNullSafe(x["at"]))
    marks = cut(marks.select(F.col("id.row").alias("row"), F.col("id.n").alias("n"), "section", F.transform(last, lambda x: x["gone"]).alias("gone")))
    stays = F.filter(F.zip_with(split, "gone", lambda line, gone: F.when(~gone, line)), lambda x: x.isNotNull())
    # inline() makes the normal form once for a row, though it is asked for twice.
    text = F.inline(F.array(F.struct(X.normalize_text(F.array_join(stays, "\n")).alias("text"))))
    rows = found.join(marks, ["row", "section"]).select("*", text).where("text <> ''")
    count = lambda s: F.count_if(F.coalesce("own", F.lit("")) == s)
    counts = keys.agg(F.count("*").alias("lines"), count("boilerplate").alias("boilerplate"), count("irrelevant").alias("irrelevant")).crossJoin(repeats.agg(F.count("*").alias("repeated")))
    counts = counts.withColumn("kept", F.col("lines") - F.col("boilerplate") - F.col("irrelevant") - F.col("repeated"))
    return rows.select("n", "section", "s.headings", "s.locator", "s.kind", "text", *(c for c in docs.columns if c not in ("row", "sections"))), counts


def dated(docs: DataFrame) -> DataFrame:
    """docs with doc_version and doc_date, from their head."""
    version = F.coalesce("version", F.when(F.col("head").isNotNull(), X.version_of(F.col("head"))), F.lit("1.0"))
    return docs.withColumns({"doc_version": version, "doc_date": F.coalesce("updated", X.first_date(F.col("head")))}).drop("head", "updated", "version")


def flagged_documents(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """dated() documents with flags, superseded and clean_chars, from what is left of their sections."""
    left = sections.groupBy("n").agg(F.max(F.regexp_extract("text", STALE, 0)).alias("stale"), F.sum(F.length("text")).alias("clean_chars"))
    known = docs.join(left, "n", "left").withColumns({"clean_chars": F.coalesce("clean_chars", F.lit(0)), "stale": F.coalesce("stale", F.lit(""))})
    return clean.document_flags(known, "stale", "path", "doc_date").drop("stale")


def piece_key(title: Column, kind: Column, file: Column, text: Column) -> Column:
    """Of all that a section's chunks are made of, behind the lengths that tell where each part ends."""
    parts = (F.coalesce(x, F.lit("")) for x in (title, kind, file, text))
    return F.sha1(F.concat(*(F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in parts)))


def _once(titled: DataFrame) -> DataFrame:
    """(key, title, kind, path, text) of titled's sections, each key once, the first one's: only those with a key that came before are
    told, by number, and no text is moved where Spark finds these few."""
    places = titled.select("key", F.struct("n", "section").alias("place"))
    several = cut(places.groupBy("key").agg(F.count("*").alias("times"), F.min("place").alias("first")).where("times > 1").select("key", "first"))
    later = cut(places.join(several, "key").where("place <> first").select("place.*"))
    return titled.join(later, ["n", "section"], "left_anti").select("key", "title", "kind", "path", "text")


def pieces_of(sections: DataFrame) -> DataFrame:
    """sections: key, title, kind, path, text, each key once. (key, piece, content, pii_types, category, subcategory, products,
    intent_types, token_estimate): chunks with personal data masked, by category."""
    own = ["title", "kind", "path"]
    cuts = chunk.chunks(sections, "key", "text", "kind", also=own).select(F.col("id").alias("key"), F.col("chunk_index").alias("piece"), F.trim("content").alias("content"), "token_estimate", "also")
    rows = cuts.withColumn("m", pii.mask("content")).select("key", "piece", "token_estimate", F.col("m.masked").alias("content"), F.col("m.kinds").alias("pii_types"), *(f"also.{c}" for c in own))
    named = clean.classify(rows, F.col("title"), F.col("content"), damp=clean.DAMP, file=F.col("path"), priors=clean.PRIORS)
    products = clean.tags(F.concat(F.col("title"), F.lit("\n"), F.col("content")))
    faq = F.when(F.col("kind") == "faq", F.array(F.lit("faq"))).otherwise(F.array().cast("array<string>"))
    return named.select("key", "piece", "content", "pii_types", "category", "subcategory", products.alias("products"), clean.intents(F.col("category"), extra=faq).alias("intent_types"), "token_estimate")


def superseded_records(records: DataFrame) -> DataFrame:
    """records: n, record_id, market, path, content, doc_date, doc_version, superseded. (n, dup_flags, lost): what exact and near
    duplicates say of a record.

    Of equal texts the most recent stays, the first among equals. Of those left, pairs of near duplicates of one market and of
    different documents are taken in order: one that is superseded already loses, else the less recent, else the later.
    """
    dated = records.withColumn("_date", F.coalesce("doc_date", F.lit("0000-00-00")))
    names = records.select(F.col("n").alias("keeper"), F.col("record_id").alias("keeper_id"))
    exact = dedup.exact_duplicates(dated, "n", "content", ["_date", "doc_version"]).where("is_duplicate").select(F.col("id").alias("n"), "keeper")
    exact = cut(exact.join(names, "keeper").select("n", F.concat(F.lit("exact_duplicate_of:"), "keeper_id").alias("flag"), F.lit(0).alias("at"), F.lit(-1).cast("long").alias("other")))
    # No two texts of those left are equal.
    left = dated.join(exact.select("n"), "n", "left_anti")
    pairs = cut(dedup.near_duplicates(left, "n", "content", "market", "path", distinct=True))
    near = dedup.resolve_near(pairs, left, "n", ["_date", "doc_version"], superseded="superseded", every=True)
    alike = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "similarity")
    near = near.select(F.col("id").alias("n"), F.col("superseded_by").alias("keeper")).join(names, "keeper").withColumns({"x": F.least("n", "keeper"), "y": F.greatest("n", "keeper")}).join(alike, ["x", "y"])
    near = near.select("n", F.concat(F.lit("near_duplicate_of:"), "keeper_id", F.format_string(" (jaccard=%.2f)", "similarity")).alias("flag"), F.lit(1).alias("at"), F.col("keeper").alias("other"))
    both = exact.union(near).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("at", "other", "flag"))).alias("f"))
    return both.select("n", F.transform("f", lambda x: x.flag).alias("dup_flags"), F.lit(True).alias("lost"))


def records_of(docs: DataFrame, sections: DataFrame, pieces: DataFrame, previous: DataFrame | None) -> DataFrame:
    """The records of the sections' pieces, with ids, versions against the previous records, duplicates and flags. They are numbered
    without their texts, which then move to their numbers once."""
    dated = docs.select(F.col("n").alias("doc"), "path", "market", "language", "source_type", "doc_version", "doc_date", "flags", "superseded")
    placed = sections.select(F.col("n").alias("doc"), "section", "key", "title", "kind", "locator")
    names = placed.select("doc", "section", "key").join(pieces.select("key", "piece", "category"), "key").join(dated.select("doc", "market"), "doc")
    names = names.withColumn("chunk_index", (F.row_number().over(W.partitionBy("doc").orderBy("section", "piece")) - 1).cast("int"))
    names = cut(clean.record_ids(cut(numbered(names, ["doc", "chunk_index"])), "market", "category", ["n"]).drop("market", "category"))
    rows = names.join(placed.drop("key"), ["doc", "section"]).join(dated, "doc").join(pieces, ["key", "piece"])
    rows = rows.withColumn("content_hash", X.content_hash(F.col("title"), F.col("content")))
    rows = clean.versioned(rows, previous) if previous is not None else rows.withColumn("version", F.lit("1.0"))
    rows = cut(rows)
    spark, at = rows.sparkSession, place(rows.sparkSession)
    with scratch(spark):
        lost = kept(superseded_records(rows), at)
    conflicts = clean.conflict_flags(clean.facts(rows, "n", F.col("content"))).select(F.col("id").alias("n"), F.col("flags").alias("conflicts"))
    none = F.array().cast("array<string>")
    out = rows.join(lost, "n", "left").join(cut(conflicts), "n", "left")
    flags = F.concat("flags", F.coalesce("dup_flags", none), clean.record_flags(F.col("content")), F.coalesce("conflicts", none))
    return out.withColumns({"quality_flags": flags, "superseded": F.col("superseded") | F.coalesce("lost", F.lit(False))}).select(RECORD)


@dataclass
class Build:
    """A published build: its folder, manifest, and tables."""

    spark: SparkSession
    path: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        """records, documents, pieces."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def active(self) -> DataFrame:
        return self.table("records").where("NOT superseded")

    def index(self) -> Index:
        return Index.load(self.spark, f"{self.path}/index")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def current(spark: SparkSession, folder: str) -> Build | None:
    """The published build of a folder, if there is one."""
    _, path, conf = _files(spark, f"{folder}/CURRENT")
    if not path.getFileSystem(conf).exists(path):
        return None
    name = spark.read.text(f"{folder}/CURRENT").head()[0]
    return Build(spark, f"{folder}/{name}", json.loads(spark.read.text(f"{folder}/{name}/manifest").head()[0]))


def publish(spark: SparkSession, folder: str, name: str) -> None:
    """Names the build in CURRENT: the file is written beside and renamed over the old one, in one step of the file system."""
    jvm, target, conf = _files(spark, f"{folder}/CURRENT")
    beside = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    context.rename(context.makeQualified(beside), context.makeQualified(target), how)


def build(spark: SparkSession, docs: DataFrame, folder: str, today: str) -> Build:
    """docs: rows of files.read_documents(), or such as have its columns. Builds anew beside what `folder` has, and publishes it.

    today: YYYY-MM-DD, for the version. Documents that failed or are empty give no records and are told in the table documents,
    with their error. A document without sections, an empty table and null texts give no records. The manifest has counts alone:
    whatever grows with the documents is in the tables.
    """
    old, name = current(spark, folder), f"build-{uuid.uuid4().hex}"
    at = f"{folder}/{name}"
    # What a step has written for itself goes with the step.
    with scratch(spark) as shared:
        with scratch(spark) as cleaned:
            with scratch(spark):
                docs = dated(docs.withColumn("title", X.normalize_text(F.col("title"))))
                docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
                numbers = cut(numbered(docs.select("row", "root", F.split("path", "/").alias("_parts")), ["root", "_parts"]).select("row", "n"))
                sections, lines = cleaned_sections(docs.where("status = 'ok'").select("row", "sections", F.col("title").alias("of"), "path"), numbers)
                titled = sections.withColumn("title", X.title_path(F.col("of"), F.coalesce("headings", F.array().cast("array<string>"))))
                titled = titled.withColumn("key", piece_key(F.col("title"), F.col("kind"), F.col("path"), F.col("text"))).select("n", "section", "key", "title", "kind", "locator", "path", "text")
                titled = kept(titled, f"{cleaned}/titled")
                documents = kept(flagged_documents(docs.drop("sections").join(numbers, "row").drop("row"), titled), f"{at}/documents")
                lines = lines.head().asDict()
            wanted, taken = _once(titled), 0
            if old is None:
                pieces = pieces_of(wanted)
            else:
                # A section that the old build cut into no piece is cut again, into none.
                known = cut(old.table("pieces").join(wanted.select("key"), "key", "left_semi"))
                fresh = cut(wanted.join(known.select("key").distinct(), "key", "left_anti"))
                pieces, taken = known.union(pieces_of(fresh).select(known.columns)), known.count()
            pieces = kept(pieces, f"{at}/pieces")
            titled = kept(titled.drop("path", "text"), f"{shared}/titled")
        with scratch(spark):
            records = kept(records_of(documents, titled, pieces, old.table("records").select("record_id", "content_hash") if old else None), f"{at}/records")
    active = records.where("NOT superseded")
    with scratch(spark):
        Index(active, "record_id", F.concat_ws("\n", "title", "title", "content")).save(f"{at}/index")
        digest = (clean.content_digest(records).head() or {"digest": ""})["digest"] or ""
    last = (old.manifest["kb_version"], old.manifest["content_digest"]) if old else None
    counts = lambda rows, c: {r[0]: r[1] for r in rows.groupBy(c).count().orderBy(c).limit(1000).collect()}
    found = {
        "kb_version": clean.kb_version(today, digest, last), "content_digest": digest, "records": records.count(), "active": active.count(),
        "documents": counts(documents, "status"), "superseded_documents": documents.where("superseded").count(), "categories": counts(active, "category"), "markets": counts(active, "market"),
        "pieces_taken_over": taken, "pieces_made": pieces.count() - taken, "lines": lines, "masked": records.where(F.size("pii_types") > 0).count(),
    }
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(f"{at}/manifest")
    publish(spark, folder, name)
    return Build(spark, at, found)
