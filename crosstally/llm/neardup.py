"""Groups of copies by two passes, for where fingerprints alone find too few near ones.

Two passes find links. SimHash with anchor-point covering links fingerprints that differ in three bits at most; it finds exact copies and very near ones.
The n-gram Jaccard join links documents whose five-word shingles have a similarity of 0.8 or more, each link verified on the whole sets. A group is
what either pass connects; the document with the smallest id of a group stays.

Defined cases are those of both operators: documents without words are copies of one another, rows with a null doc_id stay, rows of one doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store
from .jaccard import near_documents
from .simhash import components, keep_first, near_duplicates

SHINGLE, PERCENT = 5, 80


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, component_id of every document: component_id is the smallest doc_id that links of either pass reach."""
    store = Store(docs.sparkSession, "neardup")
    found = near_duplicates(docs).select("doc_id", "component_id").unionByName(near_documents(docs, shingle, percent).select("doc_id", "component_id"))
    found = store.put(found.filter("doc_id is not null").distinct())
    linked = store.put(components(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))))
    own = found.select("doc_id").distinct()
    return own.join(linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; all columns stay."""
    return keep_first(docs, groups(docs, shingle, percent).filter("doc_id = component_id").select("doc_id"))
