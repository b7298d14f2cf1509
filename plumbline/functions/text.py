"""Text expressions. Patterns use ASCII classes only, so every regex engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, the special characters that cleaning drops, and URLs.
SPACES = " \t\r\n\f"
SPACE_PATTERN = r"[ \t\r\n\f]+"
SPECIAL_CLASS = r"\x00-\x08\x0B\x0E-\x1F\x7F#$%&()*+/:;<=>@\[\\\]^_`{|}~"
SPECIAL_PATTERN = f"[{SPECIAL_CLASS}]+"
URL_PATTERN = r"(https?://|www\.)[^ \t\r\n\f]+"
# Fixed value: tokens kept per text.
MAX_TOKENS = 512


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_length(col: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(col).cast("string")).cast("int")


def clean_text(col: Column | str) -> Column:
    """Drop URLs and special characters, collapse white space, trim.

    Runs of special characters and white space become one blank in one pass,
    and texts without a URL mark skip the URL pass.
    """
    source = _col(col)
    has_url = source.contains("://") | source.contains("www.")
    no_urls = F.when(has_url, F.regexp_replace(source, URL_PATTERN, " ")).otherwise(source)
    return F.trim(F.regexp_replace(no_urls, f"[{SPECIAL_CLASS}{SPACES}]+", " "))


def _split(col: Column | str, limit: int) -> Column:
    trimmed = F.btrim(_col(col), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_PATTERN, limit)
    )


def tokens(col: Column | str) -> Column:
    """White-space tokens of the whole text; an empty text has none."""
    return _split(col, -1)


def token_count(col: Column | str) -> Column:
    """How many white-space tokens the whole text has."""
    return F.size(tokens(col))


def truncate_tokens(col: Column | str, limit: int = MAX_TOKENS) -> Column:
    """The first ``limit`` white-space tokens, joined by one blank.

    Splitting stops after them; what follows stays one piece and is dropped.
    """
    return F.array_join(F.slice(_split(col, limit + 1), 1, limit), " ")
