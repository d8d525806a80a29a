"""The corpus pipeline: toxic documents out, near copies out, secrets masked, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return
the columns of ``documents``; whatever further columns ``docs`` has stay as they are, also where their names
are those of an operator's outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventstrand.llm import minhash, mixing, packing, secrets, toxicity
from eventstrand.llm.common import Scratch, table, words_of
from eventstrand.llm.tokens import BYTE_BPE, vocabulary_path

CONTEXT = 2048
# At similarity 0.8 a pair misses all of 40 bands of 5 coordinates once in 8 million.
SIMILAR_PERCENT, BANDS = 80, 40


def _aside(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as ``__doc``, beside the columns an operator reads."""
    return docs.select(F.struct("*").alias("__doc"), *[c.alias(name) for name, c in columns.items()])


def _with_text(docs: DataFrame, changed: DataFrame, text: Column) -> DataFrame:
    """The rows kept aside with another text, and its length where the text is another."""
    # a column of its own: lambdas inside ``text`` would read the new column of the same name
    changed = changed.withColumn("__new", text)
    new, old = F.col("__new"), F.col("__doc.text")
    n_chars = F.when(new.eqNullSafe(old), F.col("__doc.n_chars")).otherwise(F.length(new).cast("long"))
    values = {"text": new, "n_chars": n_chars}
    return changed.select(*[values.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels outside its test fold, does not reject.

    Whole texts are scored; null and empty ones stay.  Repeated rows are judged alike, row by row.  An empty
    table gives no rows.
    """
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_aside(docs, text=F.col("text")), model)
    return scored.where("predicted = 0").select("__doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies.

    Texts that share an id are told apart: of an id that stays, one row stays for each different set of
    shingles, and repeated rows are one.  Rows without id all stay.  An empty table gives no rows.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), percent=SIMILAR_PERCENT, bands=BANDS)
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "same").agg(F.min("text_key").alias("__text_key"))
    keyed = docs.where("doc_id IS NOT NULL").withColumn("__text_key", minhash.text_key(F.col("text")))
    rows = keyed.join(kept.drop("same"), ["doc_id", "__text_key"], "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced in the whole text; null and empty texts stay as they are.

    Repeated rows are masked row by row.  An empty table gives no rows.
    """
    found = secrets.find_secrets(_aside(docs, text=F.col("text")))
    return _with_text(docs, found, secrets.mask(F.col("text"), F.col("secret_spans")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more with the further words it takes.

    Documents from which nothing is taken go.  Words taken beyond whole repeats are joined by a space.
    """
    sized = _aside(
        docs, doc_id=F.col("doc_id"), source=F.col("source"), size=mixing.sizes_of(F.col("text"))
    )
    mixed = mixing.mix(sized)
    text = F.col("__doc.text")
    more = F.filter(words_of(text), lambda w, i: mixing.chosen(i))
    part = F.when(F.col("taken") > F.col("copies") * F.col("size"), F.array(F.array_join(more, " "))).otherwise(
        F.array().cast("array<string>")
    )
    whole = F.when(F.col("size") > 0, F.array_repeat(text, F.col("copies").cast("int"))).otherwise(F.array().cast("array<string>"))
    repeated = mixed.select("__doc", F.explode(F.concat(whole, part)).alias("__text"))
    return _with_text(docs, repeated, F.col("__text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents, one row per piece; a null or empty text is its end id alone.

    Every row is packed, repeated ones too; long texts are cut into pieces.  An empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary_path(BYTE_BPE), end_id=0, capacity=CONTEXT)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

# The stages learn a model, hash shingles and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
