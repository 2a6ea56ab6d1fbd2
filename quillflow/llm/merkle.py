"""Operator 10: Merkle fingerprints of documents over paragraphs and sections.

A paragraph is a line. A section ends after a blank paragraph, and after one whose hash starts with hexadecimal 0 or 1
(one in eight on average), so that an insertion moves no other section's bounds. With SHA-256 and a letter that keeps
the levels apart: paragraph = H('P' text), section = H('S' its paragraph hashes), root = H('R' the section hashes).
Equal roots mean equal texts; where roots differ, the sections and then the paragraphs that differ locate the edits.
All of it is built-in expressions within one row: no shuffle.

Defined results: an empty text is one blank paragraph in one section. A null text has a null root, no section, and one
row whose section columns are null. Rows with a null or repeated doc_id each have their own tree. Other columns aren't
read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import spread

_BLANK = "sha2('P', 256)"


def _h(kind: str, x: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), x), 256)


def trees(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections): sections are strings of paragraph hashes with a separator after each."""
    paragraphs = F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda p: _h("P", p))
    ends = lambda h: F.substring(h, 1, 1).isin("0", "1") | (h == F.expr(_BLANK))
    marked = F.array_join(F.transform(paragraphs, lambda h: F.concat(h, F.when(ends(h), "#").otherwise(","))), "")
    cut = docs.select("doc_id", F.filter(F.split(marked, "#", -1), lambda s: s != "").alias("sections"))
    hashes = cut.select("*", F.transform("sections", lambda s: _h("S", s)).alias("section_hashes"))
    return hashes.select("doc_id", _h("R", F.array_join("section_hashes", "")).alias("root"), "sections", "section_hashes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, section_no, section_hash, n_paragraphs, paragraphs), a row for each section."""
    cut = trees(spread(docs)).select("doc_id", "root", F.posexplode_outer(F.arrays_zip("section_hashes", "sections")).alias("section_no", "s"))
    count = F.floor((F.length("s.sections") + 1) / 65).cast("long")
    return cut.select("doc_id", "root", F.col("section_no").cast("long").alias("section_no"), F.col("s.section_hashes").alias("section_hash"), count.alias("n_paragraphs"), F.col("s.sections").alias("paragraphs"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, side, section_no, paragraph_no) of paragraphs that only the left or right version of a document has.

    Takes documents tables with unique doc_id; rows with a null one can't be told apart and take no part. Documents with equal roots take no part beyond the join on doc_id; of
    the others only sections without an equal one on the other side are opened. paragraph_no counts within the
    section. A document that one side lacks differs whole; one whose parts only changed places gives a row with side
    'order' and null numbers.
    """
    a, b = trees(left.filter("doc_id is not null")), trees(right.filter("doc_id is not null"))
    pair = a.select("doc_id", F.col("root").alias("ra"), F.col("sections").alias("sa")).join(b.select("doc_id", F.col("root").alias("rb"), F.col("sections").alias("sb")), "doc_id", "full")
    pair = pair.filter(~F.col("ra").eqNullSafe(F.col("rb")))
    empty = F.array().cast("array<string>")
    pair = pair.select("doc_id", F.coalesce("sa", empty).alias("sa"), F.coalesce("sb", empty).alias("sb"))
    split = lambda s: F.filter(F.split(s, ",", -1), lambda x: x != "")

    def only(own: str, other: str, side: str) -> DataFrame:
        theirs = F.flatten(F.transform(F.array_except(other, own), split))
        opened = pair.select("doc_id", theirs.alias("theirs"), F.col(other).alias("others"), F.posexplode(own).alias("section_no", "s"))
        opened = opened.filter(~F.array_contains("others", F.col("s"))).select("doc_id", "theirs", "section_no", F.posexplode(split(F.col("s"))).alias("paragraph_no", "p"))
        return opened.filter(~F.array_contains("theirs", F.col("p"))).select("doc_id", F.lit(side).alias("side"), "section_no", "paragraph_no")

    moved = F.array_sort(F.flatten(F.transform("sa", split))) == F.array_sort(F.flatten(F.transform("sb", split)))
    order = pair.filter(moved).select("doc_id", F.lit("order").alias("side"), F.lit(None).cast("int").alias("section_no"), F.lit(None).cast("int").alias("paragraph_no"))
    return only("sa", "sb", "left").union(only("sb", "sa", "right")).union(order)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: sha256('P' || x)) AS h FROM documents),
s AS (SELECT doc_id, list_filter(string_split(array_to_string(list_transform(h, lambda x: x || CASE WHEN x[1] IN ('0', '1') OR x = sha256('P') THEN '#' ELSE ',' END), ''), '#'), lambda x: x <> '') AS sections FROM p),
r AS (SELECT doc_id, sections, list_transform(sections, lambda x: sha256('S' || x)) AS hashes FROM s)
SELECT doc_id, sha256('R' || array_to_string(hashes, '')) AS root, CAST(i - 1 AS BIGINT) AS section_no, hashes[i] AS section_hash,
  CAST((length(sections[i]) + 1) // 65 AS BIGINT) AS n_paragraphs, sections[i] AS paragraphs
FROM (SELECT *, unnest(range(1, len(sections) + 1)) AS i FROM r)
"""
