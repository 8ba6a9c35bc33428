"""Text normalisation and tokens as Column expressions (JVM side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a URL path that never identify a product.
PATH_STOPWORDS = [
    "products", "product", "item", "items", "furniture", "pdp", "p",
    "catalog", "shop", "buy", "detail", "details", "view", "page",
]

# Patterns that decide what is stripped from texts and URLs.
PROTOCOL_PATTERN = r"https?://(www\.)?"
TOP_DOMAIN_PATTERN = r"\.com|\.org|\.net"
HOST_PATTERN = r"https?://[^/]+/"
QUERY_PATTERN = r"\?.*$"
EXTENSION_PATTERN = r"\.(html|htm|php|asp|aspx)$"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind on both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Collapse runs of whitespace to one space and strip."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower-case words of letters, digits and hyphens; NULL becomes the empty text."""
    c = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    c = F.regexp_replace(c, PROTOCOL_PATTERN, "")
    c = F.regexp_replace(c, TOP_DOMAIN_PATTERN, "")
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s\-]", " "))


def _bare_path(url: Column) -> Column:
    path = F.coalesce(url.cast("string"), F.lit(""))
    for pattern in (HOST_PATTERN, QUERY_PATTERN, EXTENSION_PATTERN):
        path = F.regexp_replace(path, pattern, "")
    return path


def url_path_text(url: Column) -> Column:
    """Path of a URL as normalised text."""
    return normalize_text(F.regexp_replace(_bare_path(url), r"[-_/]", " "))


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _identifying(word: Column) -> Column:
    mixed = word.rlike("[a-z]") & word.rlike("[0-9]")
    return ~word.isin(PATH_STOPWORDS) & (mixed | (F.length(word) >= 3))


def product_tokens(url: Column) -> Column:
    """Distinct identifying tokens of a URL path, hyphenated words kept whole, sorted."""
    path = F.regexp_replace(F.lower(_bare_path(url)), r"[^a-z0-9\-]", " ")
    return F.array_sort(F.array_distinct(F.filter(words(path), _identifying)))


def comparable_url(url: Column) -> Column:
    """Identifying words of a URL path in order, hyphens split, joined by one space."""
    path = F.regexp_replace(F.lower(_bare_path(url)), r"[-_/]", " ")
    path = F.regexp_replace(path, r"[^a-z0-9 ]", " ")
    return F.array_join(F.filter(words(path), _identifying), " ")


def sku_components(sku: Column) -> Column:
    """Parts of a SKU between hyphens, underscores and blanks, in order."""
    return F.filter(F.split(normalize_text(sku), r"[\-_\s]+"), lambda p: p != "")


def sku_items(sku: Column) -> Column:
    """Trimmed lower-case entries of a ';'-separated SKU list."""
    entries = F.split(strip(F.coalesce(sku.cast("string"), F.lit(""))), ";")
    return F.filter(F.transform(entries, lambda s: F.lower(strip(s))), lambda s: s != "")


# Windows of 2 to 4 characters, blanks only at their ends. Look-ahead lets them overlap;
# the last dot moves on by a whole character, also one beyond 16 bits.
GRAM_PATTERNS = [r"(?s)(?=(..)).", r"(?s)(?=(.[^ ].)).", r"(?s)(?=(.[^ ][^ ].))."]


def text_grams(text: Column) -> Column:
    """All character windows of length 2 to 4 of each blank-padded word, with repeats.

    Between words joined by one blank these are the windows without a blank inside, found by one
    scan of the text for each length.
    """
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    grams = F.transform(F.array(padded), lambda p: F.concat(*[
        F.regexp_extract_all(p, F.lit(pattern), F.lit(1)) for pattern in GRAM_PATTERNS]))[0]
    return F.when(F.size(words(text)) > 0, grams).otherwise(F.array().cast("array<string>"))
