"""Site-relative line deduplication (operator 1), in DataFrame functions only.

For each host: the pages that hold a line, divided by the host's pages, is the line's frequency.
Lines above ``ratio`` are boilerplate and go from all of the host's pages.  What stands on one page of a
host is no repetition, so a line counts from ``min_pages`` = 2 pages on; beyond that the ratio alone
decides, on small hosts as on large ones.  With ``copies_once`` pages of a host with equal texts are one
page where pages are counted, so that a text does not become boilerplate by being copied.

* A page's lines are made distinct within its row, so what is shuffled for the counts is a 16-byte
  digest a distinct line, summed before the shuffle; texts are not.
* The lines of a very large host are spread by (host, digest); only the host totals and the
  boilerplate lines are joined, in plain equi-joins that Spark may broadcast or split by itself.
* The boilerplate lines are written and counted.  While they are few (``BROADCAST_LINES`` in all,
  ``HOST_LINES`` of a host) each host's are sent to the tasks as one array, and texts stay where they
  are.  Beyond that the digests of a page's boilerplate lines come back to the page by a join, never
  more than ``lines a page / ratio`` different ones a host.  Both ways give the same rows.

Defined cases: null texts stay null with no lines and count as pages; a null host is a host of its
own; lines without any character other than 0x20 and 0x09 to 0x0D are kept and not counted; a page all
of whose lines go has an empty text; repeated rows, and rows that share an id, are pages each (with
``copies_once`` one, if their texts are equal) and are all kept; an empty table gives an empty result;
other columns are passed on unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

RATIO, MIN_PAGES = 0.05, 2
#: Boilerplate lines that are sent to all tasks: some 6 MB.
BROADCAST_LINES, HOST_LINES = 200_000, 1000

#: A line that counts has a character other than ASCII white space.
_SAYS = r"[^\x20\x09-\x0D]"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, *, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """host (null-safe struct), digest, pages, total: the lines to drop."""
    pages = docs.select(_site(host).alias("_h"), text.alias("_t"), F.array_distinct(F.split(text, "\n")).alias("_l"))
    if copies_once:  # copies meet within a task first, and only digests are shuffled
        digests = F.transform(F.filter("_l", lambda x: x.rlike(_SAYS)), _digest)
        pages = pages.groupBy("_h", _digest(F.col("_t")).alias("_k")).agg(F.first(digests).alias("_l"))
        lines = pages.select("_h", F.explode("_l").alias("_d"))
    else:
        lines = pages.select("_h", F.explode("_l").alias("_line")).filter(F.col("_line").rlike(_SAYS)).select("_h", _digest(F.col("_line")).alias("_d"))
    total = pages.groupBy("_h").agg(F.count(F.lit(1)).alias("_total"))
    counts = lines.groupBy("_h", "_d").agg(F.count(F.lit(1)).alias("_pages"))
    often = counts.filter(F.col("_pages") >= min_pages)
    return often.join(total, "_h").filter(F.col("_pages") > F.col("_total") * F.lit(ratio))


def _site(host: Column) -> Column:
    """A host as a value that joins: null is one host."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("null"))


def drop_boilerplate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = False,
    copies_once: bool = False,
    broadcast_lines: int = BROADCAST_LINES,
    host_lines: int = HOST_LINES,
) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text_col``; with ``counts`` also n_lines, n_removed."""
    host, text = F.col(host_col), F.col(text_col)
    bad = boilerplate(docs, host=host, text=text, ratio=ratio, min_pages=min_pages, copies_once=copies_once).select("_h", "_d")
    bad = stored(bad, "boilerplate")
    most, total = bad.groupBy("_h").count().agg(F.max("count"), F.sum("count")).first()
    rows = docs.select(F.struct("*").alias("_row"), _site(host).alias("_h"), text.alias("_t"))
    if (total or 0) <= broadcast_lines and (most or 0) <= host_lines:
        rows = rows.join(F.broadcast(bad.groupBy("_h").agg(F.collect_set("_d").alias("_drop"))), "_h", "left")
    else:  # pages are told apart by a digest of id and text: equal rows lose the same lines
        key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text)))
        lines = docs.select(key.alias("_k"), _site(host).alias("_h"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("_line"))
        lines = lines.filter(F.col("_line").rlike(_SAYS)).select("_k", "_h", _digest(F.col("_line")).alias("_d"))
        drop = lines.join(bad, ["_h", "_d"]).groupBy("_k", "_h").agg(F.collect_set("_d").alias("_drop"))
        rows = docs.select(F.struct("*").alias("_row"), key.alias("_k"), _site(host).alias("_h"), text.alias("_t"))
        rows = rows.join(drop, ["_k", "_h"], "left")
    keep = F.filter(F.split("_t", "\n"), lambda x: ~x.rlike(_SAYS) | ~F.array_contains(F.col("_drop"), _digest(x)))
    rows = rows.withColumn("_kept", F.when(F.col("_drop").isNotNull(), keep))
    new = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join("_kept", "\n"))
    cols = [(new if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns]
    if counts:
        n = F.when(F.col("_t").isNull(), 0).otherwise(F.size(F.split("_t", "\n"))).cast("long")
        k = F.when(F.col("_t").isNull(), 0).otherwise(F.size("_kept")).cast("long")
        cols += [n.alias("n_lines"), F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(n - k).alias("n_removed")]
    return rows.select(*cols)


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The query's rows in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, text, coalesce('=' || source, 'null') AS h, string_split(text, chr(10)) AS ls FROM documents),
     total AS (SELECT h, count(*) AS n FROM d GROUP BY h),
     one AS (SELECT h, unnest(list_distinct(ls)) AS line FROM d),
     bad AS (SELECT one.h, line FROM one JOIN total USING (h) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
             GROUP BY one.h, line, n HAVING count(*) >= {min_pages} AND count(*) > n * CAST({ratio} AS DOUBLE)),
     badl AS (SELECT h, list(line) AS bl FROM bad GROUP BY h),
     k AS (SELECT doc_id, text, ls, CASE WHEN bl IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bl, x)) END AS kept
           FROM d LEFT JOIN badl USING (h))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = len(ls) THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed
FROM k"""
