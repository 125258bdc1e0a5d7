"""Licence text normalisation and the permissive-licence gate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col

# The licences that may enter a corpus.
ALLOWED = (
    "cc0",
    "creative commons cc0",
    "cc0-1.0",
    "cc0 1.0",
    "public domain",
    "pdm",
    "cc-by",
    "cc by",
    "cc-by-3.0",
    "cc-by-4.0",
    "oga-by",
    "oga-by-3.0",
    "mit",
    "apache-2.0",
    "bsd-2-clause",
    "bsd-3-clause",
    "mixed permissive",
)
# Any of these anywhere in the text denies it.
DENIED_PARTS = ("nc", "nd", "noncommercial", "no derivatives", "all rights reserved", "unknown")
# Versioned attribution licences written with a space.
ALLOWED_PREFIXES = ("cc-by ", "cc by ")


def normalize_license(license_text: Column | str) -> Column:
    unified = F.regexp_replace(F.translate(F.lower(col(license_text)), "_", "-"), r"(?U)\s+", " ")
    return F.trim(unified)


def is_allowed_license(license_text: Column | str) -> Column:
    """True only for a known permissive licence; NULL and blank text are not allowed."""
    return normalize_license(F.coalesce(col(license_text), F.lit(""))).rlike(_allowed_pattern())


def _allowed_pattern() -> str:
    """The whole rule as one pattern, so that the text is normalised and searched once per row."""
    denied = "|".join(re.escape(part) for part in DENIED_PARTS)
    exact = "|".join(re.escape(name) for name in ALLOWED)
    prefixes = "|".join(re.escape(prefix) for prefix in ALLOWED_PREFIXES)
    return f"^(?!.*(?:{denied}))(?:(?:{exact})$|(?:{prefixes}))"
