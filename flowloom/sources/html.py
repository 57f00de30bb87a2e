"""Links and template events by regular expression, in generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HREF = r'<a\s[^>]*href="([^"]+)"'
NUXT_LINK = r'<(?:NuxtLink|nuxt-link)\s[^>]*\bto="([^"]+)"'
VUE_EVENT = r'(?:@|v-on:)([A-Za-z][\w:-]*)(?:\.[\w.]+)?="([^"]*)"'


def links(pages: DataFrame, pattern: str = HREF) -> DataFrame:
    """(page_id, ordinal, href), ordinals from 0 in the order of the page."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("ordinal", "href"))
