"""Links, titles and dates out of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cleaning import dedupe

# Anchors with their text; the whole page is searched.
# The third group is what follows inside the same list item, block or article.
ANCHOR = (r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
          r'((?:(?!<a\b|</li>|</div>|</article>).)*)')
DATE = r"\d{1,2}\s+[A-Z][a-z]+\s+\d{4}"


def extract_links(pages: DataFrame, page: str, url: str, html: str, pattern: str) -> DataFrame:
    """One row per anchor whose target matches ``pattern``: target, title and a date in its text."""
    anchors = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2)).alias("body"),
        F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(3)).alias("tail"),
    )
    found = pages.select(page, url, F.posexplode(anchors).alias("position", "a"))
    found = found.filter(F.col("a.href").rlike(pattern))

    def text(c):
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))

    dated = F.regexp_extract(F.concat_ws(" ", text("a.body"), text("a.tail")), f"({DATE})", 1)
    return found.select(page, url, "position", F.trim("a.href").alias("href"), text("a.body").alias("title"),
                        F.nullif(dated, F.lit("")).alias("date_text"))


def absolute_urls(links: DataFrame, base: str, href: str = "href", out: str = "link_url") -> DataFrame:
    """Resolve targets against the page they were found on, then one row per resulting URL.

    Queries and fragments of the page are dropped first; ``base`` is the page URL column.
    """
    page = F.regexp_replace(F.col(base), r"[?#].*$", "")
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    site = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)", 1)
    folder = F.when(page.rlike("^[^:]+://[^/]+$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    h = F.col(href)
    full = (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("#") | (h == ""), F.concat(F.regexp_replace(F.col(base), "#.*$", ""), h))
        .otherwise(F.concat(folder, h))
    )
    resolved = links.withColumn(out, full)
    return dedupe(resolved, [out], [c for c in links.columns])
