"""Facts from stored web pages; fetching is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P
from pitchline.functions import text as X


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, heading, sides named in the heading, venue, link count and visible text."""
    h = F.col(html)
    out = pages.withColumns({"title": X.tag_text(h, "title"), "heading": X.tag_text(h, "h1"), "body_text": X.strip_tags(h)})
    return out.withColumns({
        "team1": X.heading_side(F.col("heading"), 1), "team2": X.heading_side(F.col("heading"), 2),
        "venue": X.venue_fact(h, F.col("body_text"), P.UNKNOWN), "n_links": F.size(X.hrefs(h)),
    })


def of_series(pages: DataFrame, series: str) -> DataFrame:
    """Pages whose heading names the series."""
    return pages.filter(F.contains(F.lower("heading"), F.lit(series.lower())))


def link_inventory(
    texts: DataFrame, text: str, first_pattern: str, second_pattern: str, first_url: Column, second_url: Column
) -> DataFrame:
    """One row per id found by either URL pattern; the missing link is rebuilt from the id.

    Group 1 of both patterns is the id; ``first_url``/``second_url`` are
    expressions over ``link_id``.
    """
    def found(pattern: str, name: str) -> DataFrame:
        urls = texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("_u"))
        ids = urls.select(F.regexp_extract("_u", pattern, 1).try_cast("bigint").alias("link_id"), "_u")
        return ids.filter(F.col("link_id").isNotNull()).groupBy("link_id").agg(F.min("_u").alias(name))

    both = found(first_pattern, "first_link").join(found(second_pattern, "second_link"), "link_id", "full")
    return both.select("link_id", F.coalesce("first_link", first_url).alias("first_link"),
                       F.coalesce("second_link", second_url).alias("second_link"))
