"""Answer-text clean-up and short display strings as column expressions
(F1-F5, F8, F10, F11, F13).  Everything is built-in Spark SQL functions, so
it runs inside whole-stage codegen with no Python in the task.

Regex dialect: Java.  Patterns start with ``(?U)`` where the reference relies
on Unicode classes: ``\\s`` then covers the no-break space and its kin, as
``str.strip`` and ``str.split`` do; word characters are ``\\p{L}\\p{N}_`` (F10).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
PMID_PREFIX = r"(?iU)\bPMID[:\s#]*"
PMID_PATTERN = PMID_PREFIX + r"([0-9]{5,9})\b"
EG_DEBRIS_PATTERN = r"(?U)\(e\.g\.\s*,?\s*on\s+[^)]{0,80}\)"
SEE_DEBRIS_PATTERN = r"(?U)\(see\s*\)"
CITATION_MARKER_PATTERN = "【[^【】]*】"
BLANK_RUN_PATTERN = r"[ \t]+"
NEWLINE_RUN_PATTERN = r"\n{3,}"
SPACE_BEFORE_MARK_PATTERN = r"(?U)\s+([.,;:!?])"
SNIPPET_LEN = 120
TITLE_LEN = 48
KEYWORD_LEN = 80
MAX_TOOL_CONTENT = 6000
ELLIPSIS = "…"
NEW_CONVERSATION = "New conversation"
WIKI_URL = "https://en.wikipedia.org/wiki/"
PUBMED_URL = "https://pubmed.ncbi.nlm.nih.gov/{}/"
NCBI_URL = "https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id="


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """``" ".join(s.strip().split())``."""
    return strip_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def cut(c: Column, n: int, tail: str = ELLIPSIS) -> Column:
    """First ``n`` characters, plus ``tail`` when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def snippet(text: Column, max_len: int = SNIPPET_LEN) -> Column:
    """single-line preview."""
    return cut(collapse_ws(text), max_len)


def title_from_text(text: Column, max_len: int = TITLE_LEN) -> Column:
    """conversation title; blank → 'New conversation'."""
    s = collapse_ws(F.coalesce(text, F.lit("")))
    return F.when(s == "", F.lit(NEW_CONVERSATION)).otherwise(cut(s, max_len))


def content_cap(text: Column, limit: int = MAX_TOOL_CONTENT) -> Column:
    """tool output fed back to the model, capped with a note."""
    n = F.length(text)
    note = F.concat(F.lit("\n\n[...truncated — "), (n - limit).cast("string"),
                    F.lit(" chars omitted]"))
    return F.when(n > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def pmid_mentions(text: Column) -> Column:
    """All PMIDs cited in ``text``, in order, repeats kept (ARRAY<STRING>)."""
    return F.regexp_extract_all(text, F.lit(PMID_PATTERN), 1)


def strip_pmids(text: Column, fake: Column) -> Column:
    """remove every citation of the PMIDs in ``fake``, then the debris.

    Blanks are squeezed and long newline runs cut even when nothing was
    removed (as in the reference)."""
    removed = F.aggregate(
        fake, text,
        lambda acc, p: F.regexp_replace(
            acc, F.concat(F.lit(PMID_PREFIX), p, F.lit(r"\b")), F.lit("")))
    s = F.regexp_replace(removed, EG_DEBRIS_PATTERN, "")
    s = F.regexp_replace(s, SEE_DEBRIS_PATTERN, "")
    s = F.regexp_replace(s, BLANK_RUN_PATTERN, " ")
    s = F.regexp_replace(s, NEWLINE_RUN_PATTERN, "\n\n")
    return strip_ws(s)


def citation_marker_count(text: Column) -> Column:
    """Number of 【…】 markers; texts without '【' skip the regex."""
    return F.when(text.contains("【"), F.regexp_count(text, F.lit(CITATION_MARKER_PATTERN))) \
        .otherwise(F.when(text.isNotNull(), F.lit(0)))


def strip_citation_markers(text: Column) -> Column:
    """delete 【…】 markers; tidy only when at least one was found."""
    s = F.regexp_replace(text, CITATION_MARKER_PATTERN, "")
    s = F.regexp_replace(s, BLANK_RUN_PATTERN, " ")
    s = F.regexp_replace(s, SPACE_BEFORE_MARK_PATTERN, "$1")
    s = F.regexp_replace(s, NEWLINE_RUN_PATTERN, "\n\n")
    return F.when(citation_marker_count(text) > 0, strip_ws(s)).otherwise(text)


def clean_term(term: Column) -> Column:
    """keep word characters (any script's letters and digits, and
    ``_``), whitespace and hyphens."""
    return F.regexp_replace(strip_ws(term), r"(?U)[^\p{L}\p{N}_\s\-]", "")


def wiki_url(title: Column) -> Column:
    return F.concat(F.lit(WIKI_URL), F.replace(title, F.lit(" "), F.lit("_")))


def pubmed_url(pmid: Column) -> Column:
    """PubMed link; only all-digit ids count (NULL otherwise)."""
    p = pmid.cast("string")
    return F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), p,
                                                  F.lit("/")))


def ncbi_url(tax_id: Column) -> Column:
    return F.concat(F.lit(NCBI_URL), tax_id.cast("string"))


def lineage_items(lineage: Column) -> Column:
    """';'-separated ancestors, trimmed, blanks dropped (ARRAY<STRING>)."""
    return F.filter(F.transform(F.split(lineage, ";"), lambda x: F.trim(x)), lambda x: x != "")
