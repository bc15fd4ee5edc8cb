"""Remove lines that many sites share.

Each line's sites are counted by HyperLogLog sketches that merge as Spark
aggregates. Lines whose estimate is near the threshold are counted exactly, so
the outcome is that of exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise

#: Sites from which a line is boilerplate.
SITES = 5
#: Register bits of a sketch: a relative error of about 1.04 / sqrt(2 ** bits).
SKETCH_BITS = 10
#: Estimates this many standard errors around the threshold are counted exactly.
ERRORS = 8.0


def _line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line: two hashes, so that no two lines are taken for one."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(docs: DataFrame, site: str) -> DataFrame:
    """(h1, h2, site) for each line that has a character other than a blank; a null site counts as one site."""
    lines = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
        F.explode(split_lines(F.col("text"))).alias("line"),
    ).where(F.length(F.trim("line")) > 0)
    return lines.select("site", *_line_key(F.col("line")))


def shared_lines(
    docs: DataFrame, site: str = "source", sites: int = SITES, bits: int = SKETCH_BITS
) -> DataFrame:
    """(h1, h2): hashes of the lines that occur on at least ``sites`` sites.

    Copies on one site count once. Sketches are built where the rows are and only
    merged after the shuffle, so a line on a third of all rows costs one sketch a
    task.
    """
    keys = _keys(docs, site)
    error = 1.04 / (2 ** (bits / 2))
    margin = max(1.0, ERRORS * error * sites)
    spread = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(bits)).alias("sketch"))
    spread = spread.where(F.col("n") >= sites).select(
        "h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")
    ).where(F.col("estimate") >= sites - margin)
    spread = materialise(spread, "lines-spread")
    sure = spread.where(F.col("estimate") > sites + margin).select("h1", "h2")
    near = spread.where(F.col("estimate") <= sites + margin).select("h1", "h2")
    exact = (
        keys.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites).select("h1", "h2")
    )
    return materialise(sure.unionByName(exact), "lines-shared")


def remove_shared_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) for each row of ``docs``.

    ``kept`` is the text without its boilerplate lines, the others joined by \\n
    as they were. Blank lines stay. Null and empty texts give one line and an
    empty text. Repeated rows are documents of their own. Lines are looked up by
    hash in one shuffle of (hash, row, place); the text itself moves only where
    Spark joins a document with the places of its boilerplate lines.
    """
    shared = shared_lines(docs, site, sites)
    rows = materialise(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", split_lines(F.col("text")).alias("lines")), "lines-rows"
    )
    places = (
        rows.select("row", F.posexplode("lines").alias("place", "line"))
        .where(F.length(F.trim("line")) > 0)
        .select("row", "place", *_line_key(F.col("line")))
        .join(shared, ["h1", "h2"], "left_semi")
        .groupBy("row").agg(F.collect_list("place").alias("places"))
    )
    whole = rows.join(places, "row", "left")
    gone = F.coalesce("places", F.array().cast("array<int>"))
    # The difference is one pass over a set, so a text of a million removed lines takes a million steps.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    return whole.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n").alias("kept"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` without shared lines; null and empty texts are one empty line, repeated rows are cut alike."""
    cleaned = remove_shared_lines(documents(spark, sf_dir))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_chars_kept"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
shared AS (
  SELECT line FROM lines WHERE length(trim(line)) > 0 GROUP BY line HAVING count(DISTINCT site) >= {SITES})
SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed,
       coalesce(length(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE s.line IS NULL)), 0) AS n_chars_kept,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE s.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.line = s.line GROUP BY doc_id
"""
