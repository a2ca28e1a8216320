"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Rows alike in all columns are told apart by nothing and handled alike; null texts fail the quality
rules. All stages but the last return the columns of documents.
"""

from pyspark.sql import functions as F

from wardframe.llm import packing, pii, quality, repeats, simhash
from wardframe.llm.common import table, vocabulary, written

#: Bytes of a passage that the repeat stage removes: about fifty words of five letters or less
#: and more than any list of common words that texts share by chance.
PASSAGE = 200


def _sized(docs):
    """n_chars again, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns \
        else docs


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules keep, as they are; limits come from the labelled ones."""
    return quality.passing(docs, bands=quality.fit_bands(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of fingerprints that links of three bits or fewer connect: the
    smallest id's, a null id last."""
    return simhash.one_of_each(docs)


def repeated_passages(spark, docs, sf_dir):
    """Texts without the later places of passages; a text that had nothing else is empty."""
    return _sized(repeats.without_repeats(docs, PASSAGE))


def personal_data(spark, docs, sf_dir):
    """Texts with personal data replaced by its kind."""
    return _sized(pii.redacted(docs))


def pack(spark, docs, sf_dir):
    """Pieces of the packed sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("repeated passages", repeated_passages), ("personal data", personal_data),
          ("packing", pack)]

#: Fingerprints, suffix order, the tagger and the tokenizer are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
