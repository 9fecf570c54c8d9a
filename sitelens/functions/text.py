"""Text expressions: pure Column functions that stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import constants as K


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text: Column | str) -> Column:
    """Search tokens of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(K.TOKEN_PATTERN), F.lit(0))


def folded(text: Column | str) -> Column:
    """Caseless form: lower case with sharp s spelled out."""
    return F.replace(F.lower(column(text)), F.lit("ß"), F.lit("ss"))


def plain_tokens(text: Column | str) -> Column:
    """Distinct letter-and-digit tokens for overlap search."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(K.PLAIN_TOKEN_PATTERN), F.lit(0)))


def collapsed(text: Column | str) -> Column:
    """Caseless text with white space runs as single spaces."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term is a substring; short terms match inside words, as they are meant to."""
    out = None
    for term in terms:
        hit = F.contains(text, F.lit(term))
        out = hit if out is None else out | hit
    return out


def normalised(text: Column | str) -> Column:
    """Unix line ends, no trailing white space on lines, no blank lines at either end."""
    unix = F.regexp_replace(F.regexp_replace(column(text), "\r\n", "\n"), "\r", "\n")
    right = F.regexp_replace(unix, r"[ \t\f\x0b]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(right, r"^(\s*\n)+", ""), r"\s+$", "")


def section_heading(text: Column | str) -> Column:
    """First line of at most 160 characters that is all upper case or numbered; null if none."""
    lines = F.transform(F.split(normalised(text), "\n"), lambda x: F.trim(x))

    def is_heading(x: Column) -> Column:
        upper = (F.upper(x) == x) & (F.lower(x) != x)
        return (F.length(x) > 0) & (F.length(x) <= K.HEADING_CHARS) & (upper | F.rlike(x, F.lit(K.HEADING_PATTERN)))

    return F.get(F.filter(lines, is_heading), F.lit(0))


def window_starts(text: Column, size: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Start offsets of overlapping windows that cover the text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - F.lit(size)) / F.lit(float(step)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def asset_status(text: Column | str) -> Column:
    """Status a page speaks of: negations first, then markers in order, over the whole page."""
    low = folded(text)
    out = F.when(contains_any(low, K.NEGATED_STATUS), "UNKNOWN")
    for marker, status in K.STATUS_MARKERS:
        out = out.when(F.contains(low, F.lit(marker)), status)
    return out.otherwise("UNKNOWN")


def number(text: Column) -> Column:
    """A number with thousands separators."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def path_stem(path: Column) -> Column:
    """Last path part without its extension."""
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def stable_dataset_id(path: Column | str, domain: Column) -> Column:
    """Domain, slug of the stem and twelve hex digits of the lower-cased path's SHA-1."""
    low = F.lower(F.replace(column(path), F.lit("\\"), F.lit("/")))
    name = slug(path_stem(low))
    return F.concat_ws("-", domain, F.when(name == "", "dataset").otherwise(name), F.substring(F.sha1(low.cast("binary")), 1, 12))


def stable_document_id(path: Column | str) -> Column:
    p = column(path)
    name = F.substring(slug(path_stem(p)), 1, 70)
    return F.concat_ws("-", F.lit("rag"), F.when(name == "", "document").otherwise(name), F.substring(F.sha1(F.lower(p).cast("binary")), 1, 12))


def parsed_pages(pinpoint: Column | str) -> tuple[Column, Column]:
    """First and last page of a pinpoint such as ``pp. 3-5``; null without one."""
    p = column(pinpoint)
    start = F.nullif(F.regexp_extract(p, K.PAGE_PATTERN, 1), F.lit("")).cast("int")
    end = F.nullif(F.regexp_extract(p, K.PAGE_PATTERN, 2), F.lit("")).cast("int")
    return start, F.coalesce(end, start)


def citation(title: Column, issuer: Column, page_start: Column, page_end: Column, heading: Column, pinpoint: Column) -> Column:
    """Issuer and title with, in order of preference, page, section or pinpoint."""
    prefix = F.when(issuer.isNotNull() & (issuer != ""), F.concat(issuer, F.lit(" — "), title)).otherwise(title)
    page = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(
        F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("–"), page_end.cast("string"))
    )
    return (
        F.when(page_start.isNotNull(), F.concat(prefix, F.lit(", "), page))
        .when(heading.isNotNull() & (heading != ""), F.concat(prefix, F.lit(", section "), heading))
        .when(pinpoint.isNotNull() & (pinpoint != ""), F.concat(prefix, F.lit(", "), pinpoint))
        .otherwise(prefix)
    )


def safe_file_name(text: Column | str, fallback: str = "report") -> Column:
    name = F.regexp_replace(F.regexp_replace(F.trim(column(text)), "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", fallback).otherwise(name)


def redacted_paths(text: Column | str) -> Column:
    """Absolute paths in diagnostics replaced by a marker."""
    return F.regexp_replace(column(text), K.ABSOLUTE_PATH_PATTERN, "<path>")


def duration_seconds(text: Column | str) -> Column:
    """Seconds of a duration such as ``1m30s`` or ``250ms``; null without one."""
    found = F.regexp_extract_all(F.lower(column(text)), F.lit(r"\d+(?:\.\d+)?(?:ms|s|m|h)"), F.lit(0))
    unit = lambda x: F.regexp_extract(x, "(ms|s|m|h)$", 1)
    scale = lambda u: F.when(u == "ms", 0.001).when(u == "s", 1.0).when(u == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + F.regexp_extract(x, r"^[\d.]+", 0).cast("double") * scale(unit(x)))
    return F.when(F.size(found) > 0, total)
