"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are redacted, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``,
and returns a DataFrame in the same columns (the last one adds token ids).  Every
stage works on all rows that its predecessor kept.  ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.llm import jaccard_join, piece_codec, secret_scan, source_mixing, toxicity
from tasklathe.llm.sparkio import release, rewritten, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a model of the labelled ones that may be learnt from.

    Null and empty texts get the model's constant, which stays below; texts are
    scored whole, equal ones alike, repeats each for itself.  Other columns stay,
    one named ``__toxicity`` apart.  An empty table stays empty.
    """
    model = toxicity.fit(toxicity.labelled_part(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest doc_id.

    Documents without words (null, empty, blank) link with nothing and all stay;
    null ids come last within a group, and of rows equal in id the one with the
    smaller text digest stays.  Texts are compared whole.  Other columns stay; an
    empty table stays empty.
    """
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every reported span replaced by its kind; ``n_chars`` follows where a text changed.

    Null and empty texts stay as they are; spans that overlap go as one, however
    long the text.  Rows are handled each alone, so repeats and ids don't matter.
    Other columns stay; an empty table stays empty.
    """
    found = secret_scan.scan(docs)
    found = found.withColumn("__text", secret_scan.redact(F.col("text"), F.col("spans")))
    new = {"text": F.col("__text"), "n_chars": F.when(F.size("spans") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    Documents without words stand once for each complete epoch of their source.
    A null source is one of its own.  Rows that share an id share a draw, null
    ids too; see ``mix`` for their order.  Other columns stay; an empty table
    stays empty.
    """
    words = source_mixing.words(F.col("text"))
    mixed = source_mixing.mix(docs, words, source_mixing.quality(words))
    once = F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("__copy")
    return mixed.where("copies > 0").select(*docs.columns, once).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Documents with ``n_tokens`` and ``token_ids``, checked against the library.

    Null texts read as empty and give the two marks alone; whole texts are
    encoded.  Rows stay as they are, repeats too; columns of those names are
    replaced.  A text whose ids or decoding differ from the library's ends the
    job with an error.  An empty table stays empty.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encode_texts(docs, model_path).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]
#: Stages that fit models, follow links and encode have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = rewritten(docs)
            release(before)
    return docs
