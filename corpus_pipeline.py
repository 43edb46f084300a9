"""Corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelark.functions.storage import scratch_path, scratch_scope, write_through
from framelark.llm.exact_dedup import drop_copies
from framelark.llm.ngram_join import ngram_jaccard
from framelark.llm.packing import pack_documents
from framelark.llm.quality import classify_quality, text_hash
from framelark.llm.queries import vocabulary_path
from framelark.llm.shipping import shipped
from framelark.llm.suffix_dedup import suffix_dedup

#: The greedy and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def text_key(id_column: str, text: Column | str) -> Column:
    """One number for an id (null is one too) and the hash of a text."""
    return F.xxhash64(id_column, F.lit(1), text)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows whose ``key`` is not in the one column of ``gone``; a null key stays."""
    name = free_name(docs, "_gone")
    gone = gone.toDF(name)
    return docs.join(gone, key == gone[name], "left_anti")


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A row is judged by its text, so repeated ids are judged one by one and equal rows alike; null and
    empty texts are scored like any other. An empty table, and one without labels, keeps everything.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify_quality(docs, labels, threshold=0.3)
    rejected = scored.filter("predicted = 0").select(text_key("doc_id", "text_hash")).distinct()
    return without(docs, write_through(rejected, "rejected"), text_key("doc_id", text_hash(docs["text"])))


@shipped
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest ``doc_id`` stays. Null counts as empty; rows with a null id stay."""
    return drop_copies(docs, keep="max")


@shipped
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity of 0.8 or more), the row with the smallest ``doc_id`` stays.

    Rows are told apart by id and text: a text of its own under a repeated id is not lost with
    the other. Rows with a null id stay; texts without words are linked with nothing.
    """
    key = F.when(docs["doc_id"].isNotNull(), text_key("doc_id", text_hash(docs["text"])))
    rows = docs.select(key.alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("text"))
    found = ngram_jaccard(rows, id_col="row", words=5, threshold=(80, 100)).filter("row IS NOT NULL")
    found = write_through(found.select("row", F.col("component_id").alias("one")), "near")
    linked = found.filter("row <> one").select("one").distinct()
    members = found.join(linked, "one", "left_semi").join(rows.select("row", "id"), "row").distinct()
    members = write_through(members, "members")
    stays = members.groupBy("one").agg(F.min(F.struct("id", "row")).getField("row").alias("first"))
    gone = members.join(stays, "one").filter("row <> first").select("row").distinct()
    return without(docs, write_through(gone, "gone"), key)


@shipped
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-byte passages are cut from all but the first document; emptied documents go.

    A character that a cut splits goes with it. ``n_chars`` is counted anew. Rows with a null id
    neither cut nor lose anything; texts that were empty before stay.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup(docs, carry=rest, window=50, as_text=True)
    out = cut.filter("n_removed < n_bytes OR n_bytes = 0").select("doc_id", F.col("kept").alias("text"), *(["carried.*"] if rest else []))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


@shipped
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens; null and empty texts are an end token alone."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("suffix-array dedup", passages),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        out = scratch_path(spark, f"stage{n}")
        with scratch_scope(spark):  # what only this stage needs goes
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
