"""Boilerplate lines by site-relative frequency.

A line's ratio is the number of a host's pages that contain it over all pages of the host.
Lines that exceed the ratio are dropped from all pages of that host. At most
(lines per page) / ratio lines of a host can exceed it, so a host's boilerplate is a
short list: pages are joined with it on the host alone and filtered in place, and the exploded
lines are only ever counted (combined before the shuffle). The page totals and the lists are
written and broadcast where they are small, so pages are not shuffled; where they are not,
Spark splits the partition of a hot host.

Defined cases: lines are trimmed of blanks for comparison, and empty lines are kept; a line
repeated within a page counts once; hosts with fewer than `min_pages` pages, and pages without
a host, keep all lines; a null body has no lines and gives an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_whole
from .urlfilter import split_url

RATIO, MIN_PAGES = 0.5, 4
#: Lines of a page end at line feeds and after these closing tags of raw HTML.
ENDS = "(</p>|</div>|</nav>|</footer>|</h1>|</head>|<br>)"


def drop_boilerplate(pages: DataFrame, url: str = "url", body: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES, ends: str = ENDS) -> DataFrame:
    """All columns of pages, and host, n_lines, n_dropped, kept_text."""
    clean = {c: f"__{c}" for c in ("host", "n_lines", "n_dropped", "kept_text") if c in pages.columns}
    pages = pages.withColumnsRenamed(clean) if clean else pages
    host, body = split_url(F.col(url))[0], F.coalesce(F.col(body), F.lit(""))
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, ends, "$1\n"), "\n"))
    rows = pages.withColumns({"host": host, "__lines": lines})
    line = lambda x: F.trim(x)
    named = rows.where(F.col("host") != "")
    totals = named.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    seen = named.select("host", F.explode(F.array_distinct(F.transform("__lines", line))).alias("line")).where(F.col("line") != "")
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n"))
    # the smallest host that counts already rules out most lines
    often = counts.where(F.col("n") > ratio * min_pages)
    common = often.join(small_or_whole(totals, "totals"), "host").where(F.col("n") > ratio * F.col("pages"))
    lists = common.groupBy("host").agg(F.collect_list("line").alias("__common"))
    out = rows.join(small_or_whole(lists, "lists"), "host", "left")
    common_of = F.coalesce("__common", F.array().cast("array<string>"))
    out = out.withColumn("__kept", F.filter("__lines", lambda x: ~F.array_contains(common_of, line(x))))
    return out.withColumns(
        {"n_lines": F.size("__lines"), "n_dropped": F.size("__lines") - F.size("__kept"), "kept_text": F.array_join("__kept", "\n")}
    ).drop("__lines", "__kept", "__common")
