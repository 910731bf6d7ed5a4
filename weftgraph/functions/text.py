"""Column functions on ids, links and texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The quote marks dropped, and the punctuation and space collapsed, before texts are matched.
QUOTES = "[‘’“”`'\"]+"
PUNCTUATION = r"[\s\-–—.,;:()]+"
#: A speaker's lead-in at the head of a transcript passage (fixed value).
SPEAKER_PREFIX = r"(?i)^\s*(?:P(?:articipant)?\s*\d+|R|I|Researcher|Interviewer)(?:\s*[\[(]\s*[\d:.,]+\s*[\])])?\s*:\s*"
#: A quoted term at the head of a definition (fixed value).
TERM = r"(?i)^\s*['\"`‘“]+([^'\"`’”]+?)['\"`’”]+(?=\s*(?:,|means\b|is\b|shall\b|$))"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def derive_doc_id(stem: Column | str, interviews: bool = False) -> Column:
    """Lower case, ``-`` and space to ``_``. With ``interviews``, as the thematic pack names its files, white space at the ends goes
    and ``interview``, separators and a number become one word; no other name does."""
    plain = F.lower(stem)
    if not interviews:
        return F.translate(plain, "- ", "__")
    bare = F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")
    numbered = r"(?U)^(interview)[\s_\-]+(\d+)$"
    return F.when(bare.rlike(numbered), F.regexp_replace(bare, numbered, "$1$2")).otherwise(F.translate(bare, "- ", "__"))


def sanitize_id(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_]", "_")


def slugify(c: Column | str, length: int = 40) -> Column:
    """Sanitised, cut to ``length``, then stripped of ``_`` at the ends."""
    return F.btrim(F.substring(sanitize_id(c), 1, length), F.lit("_"))


def subtheme_slug(c: Column | str, length: int = 50) -> Column:
    """Sanitised, stripped of ``_`` at the ends, then cut; ``subtheme`` if nothing is left."""
    slug = F.substring(F.btrim(sanitize_id(c), F.lit("_")), 1, length)
    return F.when(slug == "", F.lit("subtheme")).otherwise(slug)


def strip_link(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"^\[\[(.+?)\]\]$", "$1"))


def wrap_link(c: Column | str) -> Column:
    """``[[value]]``; what already begins with ``[[`` stays."""
    return F.when(col(c).startswith("[["), col(c)).otherwise(F.concat(F.lit("[["), col(c), F.lit("]]")))


def wrap_links(properties: Column | str, datatype_props: list[str]) -> Column:
    """A property map with object values wrapped; nulls and empty strings go, and so do properties they leave empty."""
    full = F.transform_values(col(properties), lambda k, v: F.filter(v, lambda x: x.isNotNull() & (x != "")))
    wrapped = F.transform_values(full, lambda k, v: F.when(k.isin(datatype_props), v).otherwise(F.transform(v, wrap_link)))
    return F.map_filter(wrapped, lambda k, v: F.size(v) > 0)


def normalize_for_match(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), QUOTES, ""), PUNCTUATION, " "))


def strip_speaker_prefix(c: Column | str) -> Column:
    return F.regexp_replace(c, SPEAKER_PREFIX, "")


def definition_term(c: Column | str) -> Column:
    """The quoted term that a definition begins with, else null."""
    found = F.trim(F.regexp_extract(F.trim(c), TERM, 1))
    return F.when(found != "", found)


def _prefixes(body: Column, lengths: tuple[int, ...]) -> list[Column]:
    return [F.trim(F.substring(body, 1, n)) for n in lengths]


def search_variants(c: Column | str, style: str = "default") -> Column:
    """Needles for finding a source text again, most specific first, without repeats.

    ``default`` drops quotes, ``thematic`` drops the speaker's lead-in; both give the first 80, 50 and 30 characters.
    ``compliance`` puts the quoted forms of a definition's term before prefixes of 50 and 30. Prefixes under 15
    characters are left out. Null gives an empty list.
    """
    full = F.trim(c)
    bare = F.regexp_replace(full, QUOTES, "")
    long_enough = lambda xs: F.filter(F.array(*xs), lambda x: F.length(x) >= 15)
    if style == "thematic":
        out = long_enough(_prefixes(F.btrim(strip_speaker_prefix(full), F.lit(" '\"")), (80, 50, 30)))
    elif style == "compliance":
        term = definition_term(full)
        quoted = [F.concat(F.lit(a), term, F.lit(b)) for a, b in (("'", "'"), ('"', '"'), ("‘", "’"), ("“", "”"))]
        out = F.concat(F.array_compact(F.array(*quoted, term)), long_enough(_prefixes(bare, (50, 30))))
    else:
        out = long_enough(_prefixes(bare, (80, 50, 30)))
    return F.coalesce(F.array_distinct(out), F.array().cast("array<string>"))


def estimate_chunks(n_chars: Column | str, max_chars: int) -> Column:
    n = col(n_chars)
    return F.when(n <= 0, F.lit(0)).when(n <= max_chars, F.lit(1)).otherwise(F.ceil(n / F.lit(max_chars))).cast("int")


def chunk_doc_id(doc_id: Column | str, index: Column | str, n_chunks: Column | str) -> Column:
    return F.when(col(n_chunks) > 1, F.concat(col(doc_id), F.lit("_c"), col(index).cast("string"))).otherwise(col(doc_id))


def enrich_source_section(section: Column | str, index: Column | str, n_chunks: Column | str, hint: Column | str) -> Column:
    """``chunk i/n (hint) / section`` where a document has several chunks."""
    hinted = F.when(F.coalesce(col(hint), F.lit("")) != "", F.concat(F.lit(" ("), col(hint), F.lit(")"))).otherwise(F.lit(""))
    lead = F.concat(F.lit("chunk "), (col(index) + 1).cast("string"), F.lit("/"), col(n_chunks).cast("string"), hinted)
    own = F.trim(F.coalesce(col(section), F.lit("")))
    return F.when(col(n_chunks) <= 1, col(section)).when(own != "", F.concat(lead, F.lit(" / "), own)).otherwise(lead)


def normalize_for_lookup(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\-_]", ""))
