"""The corpus pipeline: documents through the training-data operators, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, repeats, toxicity
from tessera.llm.queries import tokenizer
from tessera.llm.shared import WORD, discard, keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject.

    Rows without doc_id stay: nothing is decided of them. Rows that share a doc_id go if one of them is rejected. Null and
    empty texts are scored like labelled documents without words; long ones whole; a table without rows gives none.
    Columns beyond COLUMNS are dropped, whatever their names.
    """
    judged = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = judged.where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Documents without words and rows without doc_id are like no other and stay. Rows that share a doc_id go if the text of
    one of them is in the group of a smaller doc_id. Ties in similarity are links; an empty table gives no rows. Columns
    beyond COLUMNS are dropped, whatever their names.
    """
    groups = jaccard.similar_groups(docs, width=5, num=4, den=5)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def trim(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a document with a smaller doc_id holds.

    A letter cut by a passage's edge goes with it; documents of which no word is left go. Documents that lose nothing stay
    as they are, null and empty texts and rows without doc_id among them; rows that share a doc_id are each trimmed; an
    empty table gives no rows. Columns beyond COLUMNS are dropped, whatever their names.
    """
    out = repeats.remove_repeats(docs, carry=("lang", "source", "n_chars", "text"))
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("carried.text"))
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    return out.where(~cut | F.col("kept_text").rlike(WORD)).select("doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes of it: whole copies and the words of its chosen blocks, joined;
    none, and it goes.

    Rows without doc_id are mixed by their texts like others. Null, empty and blank texts have no words to take and go.
    Wholly equal rows each get what one of them takes. An empty table gives no rows. Columns beyond COLUMNS are dropped,
    whatever their names.
    """
    key = F.xxhash64("text_key", "source").alias("key")
    taken = mixing.mix(docs).where("taken > 0")
    took = taken.groupBy(F.col("doc_id").alias("id"), key).agg(F.array_sort(F.collect_list(F.struct("size", "taken", "ranges"))).alias("takes"))
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(F.col("text").cast("string"))).withColumn("key", F.xxhash64("text_key", "source"))
    numbered = keyed.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("text_key")))
    out = numbered.join(took, numbered.doc_id.eqNullSafe(took.id) & (numbered.key == took.key)).where("i <= size(takes)")
    out = out.withColumn("took", F.element_at("takes", F.col("i"))).withColumn("ranges", F.col("took.ranges"))
    copies, rest = F.expr("CAST(took.taken div took.size AS INT)"), F.expr("took.taken % took.size")
    # the words are bound to a name, else they would be split for each range anew
    words = F.expr(r"transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws -> flatten(transform(ranges, r -> slice(ws, CAST(r.first + 1 AS INT), CAST(r.after - r.first AS INT)))))[0]")
    text = F.concat_ws("\n", F.array_repeat("text", copies), F.when(rest > 0, F.array_join(words, " ")))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens; rows are pieces.

    Null and empty texts are the end token alone; a null doc_id stays null; rows that share a doc_id are documents of
    their own; documents of any length are cut where they must be; an empty table gives no rows; other columns are dropped.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("suffix-array dedup", trim),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Tokenizers, models and seeded hashes aren't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's rows written and read again as the next one's input.

    Rows that share a doc_id stay or go together in the first two stages. A stage's rows are removed once the next ones
    are written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
