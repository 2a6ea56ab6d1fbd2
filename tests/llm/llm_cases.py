"""Small tables for the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that steps of the operators use for columns of their own.
CLASHING = ("_gone", "_again", "count", "n", "a", "b", "h", "ha", "hb", "sign", "bands", "bucket", "head", "good", "_text", "c0", "_epoch", "_mixing_epoch", "epoch", "domain", "_whole", "_cut", "_leaf_source", "tokens", "node", "line", "_id", "sections", "digest", "payload", "similarity", "item_id", "range", "_on")


def docs_of(spark, rows, lang="en", source="src1"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


LONG = "a fairly ordinary sentence about rivers and towns number {} ; "


def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and columns of clashing names."""
    from pyspark.sql import functions as F

    same = "it was a bright cold day in april and the clocks were striking thirteen when the train came in"
    rows = [
        (1, same, "en", "src1", len(same)), (2, same.upper(), "en", "src2", len(same)), (3, None, None, None, None), (4, "", "de", "src3", 0), (4, "", "de", "src3", 0), (5, "   \n\t", "fr", None, 5),
        (None, same, None, "src1", None), (None, None, None, None, None), (6, "".join(LONG.format(i) for i in range(20_000)), "es", "src4", None), (7, "einzig", "xx", "nowhere", 6), (1, same, "en", "src1", len(same)),
    ]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)), F.create_map(F.lit("k"), F.lit(1)).alias("some map"))
