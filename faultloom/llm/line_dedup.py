"""Removal of boilerplate lines by their frequency relative to the site.

A line is boilerplate of a site if the share of the site's pages that contain it
exceeds a ratio.  Pages are grouped by host; for each line the pages that contain it
are divided by the host's page total.

Scale.  Lines travel as 128-bit hashes, counted with map-side combine, so a hot host
or a very common line is a few rows a task.  A page with n lines adds n to the counts
of its host, so a host has at most ``mean lines a page / ratio`` boilerplate lines:
these alone are gathered, after the ratio is applied, in one small hash table per host,
which pages get by a join on the host.  Each page is filtered where it lies.  Neither
pages nor lines are collected per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest128, materialize

RATIO = 0.08
LEAST_PAGES = 5

# What separates lines in HTML, and what is not text there.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    r"h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)"
    r"(?:[\x20\t\r\n/][^>]*)?>"
)
TAG = r"<[^>]*>"
BLANKS = r"[\x20\t\r\f\x0B]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def html_text(html: Column) -> Column:
    """The visible text of a page, one block a line, without blank lines."""
    text = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.transform(F.split(F.regexp_replace(text, BLANKS, " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _hash(line: Column) -> Column:
    a, b = digest128(line)
    return F.struct(a.alias("a"), b.alias("b"))


def _slot(hashed: Column, slots: Column) -> Column:
    return F.pmod(hashed["a"], slots.cast("long")).cast("int")


def _table(hashes: Column) -> Column:
    """Hashes as an array of slots of about eight each, by their first half."""
    slots = F.ceil(F.size(hashes) / 8).cast("int")
    return F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.filter(hashes, lambda x: _slot(x, slots) == i))


def _listed(table: Column, hashed: Column) -> Column:
    """Whether a hash is in such a table; only its slot is looked through."""
    return F.array_contains(F.element_at(table, _slot(hashed, F.size(table)) + 1), hashed)


def drop_page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``drop_site_lines`` on the visible text of HTML pages: ``id_col, host, text`` and the counts.

    The text is made once and written, as lines are read twice.  Null pages are empty,
    null or malformed addresses are of the host ``''``; other columns are not read.
    """
    texts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), html_text(F.col(html_col)).alias("text"))
    return drop_site_lines(materialize(texts, "texts"), "text", "host", **options)


def drop_site_lines(
    pages: DataFrame, text_col: str, host_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, and three counts.

    Added columns: ``host_pages``, ``n_lines`` and ``n_dropped`` (they replace columns
    of these names).  Lines are compared after trimming blanks; lines that are empty
    then are never boilerplate and stay as they are.  A line is dropped if it is on at
    least ``least_pages`` pages of the host and on more than ``ratio`` of them; a page
    counts once however often it repeats the line, and equal rows are pages of their
    own.  Null hosts form one site.  A null text has no lines and stays null; a text
    of which every line goes becomes empty.  An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in ("host_pages", "n_lines", "n_dropped")]
    trimmed = lambda x: F.trim(x, F.lit(" \t\r\f\x0b"))
    lines = F.split(F.col(text_col), "\n", -1)
    site = F.struct(F.col(host_col).isNull().alias("n"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("h"))
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: trimmed(x) != ""), lambda x: _hash(trimmed(x))))
    own = pages.select(site.alias("site"), hashes.alias("hashes"))
    # One pass: a null hash stands for the page itself, so totals come with the counts.
    marks = F.concat(F.coalesce("hashes", F.array().cast("array<struct<a:long,b:long>>")), F.array(F.lit(None).cast("struct<a:long,b:long>")))
    counts = own.select("site", F.explode(marks).alias("hash")).groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter((F.col("n") >= least_pages) | F.col("hash").isNull()), "lines")
    sites = counts.filter(F.col("hash").isNull()).select("site", F.col("n").alias("site_pages"))
    # Only what passes the ratio is gathered: at most mean lines a page / ratio, whatever the site's size.
    frequent = counts.filter(F.col("hash").isNotNull()).join(sites, "site").filter(F.col("n") > F.lit(ratio) * F.col("site_pages"))
    frequent = frequent.groupBy("site").agg(F.collect_list("hash").alias("hashes")).select("site", _table(F.col("hashes")).alias("boilerplate"))
    # Written out, so that the join may split a hot host's pages over tasks.
    per_site = materialize(sites.join(frequent, "site", "left"), "sites").select(*(F.col(c).alias(f"__{c}") for c in ("site", "site_pages", "boilerplate")))
    split, boilerplate = F.col("__lines"), F.col("__boilerplate")
    stays = F.filter(split, lambda x: (trimmed(x) == "") | ~_listed(boilerplate, _hash(trimmed(x))))
    out = (
        pages.select(*kept, site.alias("__site"), lines.alias("__lines"))
        .join(per_site, "__site")
        .withColumn("__kept", F.when(boilerplate.isNotNull(), stays).otherwise(split))
    )
    return out.select(
        *(F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in kept),
        F.col("__site_pages").alias("host_pages"),
        F.greatest(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
