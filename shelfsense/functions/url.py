"""Absolute form of a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as a browser reports it on the page at ``base``."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(F.regexp_like(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(path, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(href == "", base)
        .when(F.length(folder) > F.length(origin) + 1, F.concat(folder, href))
        .otherwise(F.concat(origin, F.lit("/"), href))
    )
