"""Line deduplication by site-relative frequency.

Pages are grouped by site; a line's ratio is the number of the site's pages that hold it over all the site's pages. Lines at or
above the ratio are boilerplate and go from every page that holds them, all lines of a page if need be; only a line that no
second page of its site holds is repeated nowhere, however few pages there are. With `whole_above` (off unless given) a text
that would lose more than that share of its characters stays as it is: a near copy of many pages, which would no longer be like them afterwards.

Lines are compared without spaces around them; blank lines are never counted or dropped. A null text stays null, an empty one
empty, and neither is a page; null sites form one site. Repeated rows are pages each. Very long texts are split whole. Columns
named lines_total or lines_dropped are replaced; any other name may be in use. Counts are sums over (site, line), combined before
each shuffle, so a site with a third of all rows is spread by its lines; what is kept per site is at most (lines a page / ratio)
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import stored

RATIO, MIN_PAGES = 0.02, 2


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line_key, pages, site_pages) of lines at or above the ratio; line_key is the line's xxhash64."""
    own = df.where(F.col(text_col) != "").select(F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    totals = own.groupBy("site").agg(F.count("*").alias("site_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = own.select("site", F.explode(keys).alias("line_key")).groupBy("site", "line_key").agg(F.count("*").alias("pages"))
    frequent = counts.where(F.col("pages") >= min_pages)
    return frequent.join(totals, "site").where(F.col("pages") >= ratio * F.col("site_pages"))


def drop_boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, whole_above: float | None = None) -> DataFrame:
    """df's columns with boilerplate lines out of text, then lines_total and lines_dropped."""
    kept = [c for c in df.columns if c not in ("lines_total", "lines_dropped")]
    found = boilerplate(df, site_col, text_col, ratio, min_pages)
    by_site = stored(found.groupBy("site").agg(F.collect_list("line_key").alias("flagged")), "boilerplate")
    # df's own columns travel in a struct, so that no name of theirs can meet one of these
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.col(text_col).alias("text"), F.split(text_col, "\n").alias("lines"))
    met = own.join(by_site, "site", "left")
    # the page's own flagged lines first, by hash: a site's list is looked through once a page, not once a line
    met = met.withColumn("gone", F.array_intersect(F.transform("lines", lambda x: F.xxhash64(F.trim(x))), F.coalesce("flagged", F.array().cast("array<bigint>"))))
    met = met.withColumn("left", F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("gone", F.xxhash64(F.trim(x)))))
    whole = F.coalesce(F.size("left") == F.size("lines"), F.lit(True))
    if whole_above is not None:
        size = lambda c: F.aggregate(F.transform(c, lambda x: F.length(F.trim(x))), F.lit(0), lambda a, b: a + b)
        whole = whole | F.coalesce(size("left") < (1 - whole_above) * size("lines"), F.lit(True))
    met = met.withColumn("whole", whole)
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.array_join("left", "\n"))
    dropped = F.when(F.col("whole"), 0).otherwise(F.size("lines") - F.size("left")).cast("long")
    total = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    return met.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in kept], total.alias("lines_total"), dropped.alias("lines_dropped"))


#: The same by DuckDB over documents, in the columns of the query.
SQL = f"""
WITH own AS (SELECT doc_id, source, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT site, lines FROM own WHERE text <> ''),
totals AS (SELECT site, count(*) AS site_pages FROM pages GROUP BY site),
counted AS (SELECT site, line, count(*) AS pages FROM (SELECT site, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM pages) WHERE line <> '' GROUP BY site, line),
flagged AS (SELECT site, list(line) AS keys FROM counted JOIN totals USING (site) WHERE pages >= {MIN_PAGES} AND pages >= {RATIO} * site_pages GROUP BY site),
cut AS (SELECT own.*, list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(keys, []), trim(x, ' '))) AS kept FROM own LEFT JOIN flagged USING (site)),
judged AS (SELECT *, len(kept) = len(lines) AS whole FROM cut)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL WHEN whole THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS lines_total, CAST(CASE WHEN text IS NULL OR whole THEN 0 ELSE len(lines) - len(kept) END AS BIGINT) AS lines_dropped
FROM judged
"""
