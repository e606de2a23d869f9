"""Line dedup by site-relative frequency, in DataFrame operations only.

Lines that stand on a large share of a host's pages are that site's boilerplate. Pages are counted for each host and for
each (host, line); a line goes if its pages divided by the host's exceed a ratio, however few pages the host has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, spread_join


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Array of a page's lines: tags end a line, and blank lines don't count. Case and inner spaces stay."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def site_lines(pages: DataFrame, id_col: str, host: Column, lines: Column, ratio: float = 0.3) -> DataFrame:
    """page id, host, n_lines, n_dropped, kept_text (remaining lines joined by newlines) of every row.

    A line goes where its pages are more than `ratio` of its host's pages, on every host: where a host has fewer than
    1/ratio pages every line does, and its pages come out empty. Null hosts and texts count as ''; a page without lines
    keeps the empty text; repeated rows count as pages and come out each; a null page id is an identifier like others.

    What exceeds the ratio on a host is at most (lines of an average page) / ratio lines, so a host's list of them stays
    small; hosts of so few pages that any line exceeds it need no list. Hosts with a large share of all pages are dealt over
    several tasks, others are joined as they are."""
    base = pages.select(F.col(id_col).alias(id_col), host.alias("host"), lines.alias("lines"))
    hosts = cut(base.groupBy("host").agg(F.count("*").alias("n")))
    hot = hot_keys(hosts, "host")
    hosts = hosts.withColumnRenamed("n", "pages")
    every = F.col("pages") * ratio < 1
    each = base.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = spread_join(each, hosts.where(~every), "host", hot, "line").where(F.col("n") > F.col("pages") * ratio)
    known = cut(hosts.join(common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("common")), "host", "left"))
    marked = spread_join(base, known, "host", hot, id_col)
    stay = F.when(every, F.array().cast("array<string>")).when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", x)))
    out = marked.withColumn("_kept", stay)
    size = F.size("lines").cast("long")
    return out.select(id_col, "host", size.alias("n_lines"), (size - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("kept_text"))
