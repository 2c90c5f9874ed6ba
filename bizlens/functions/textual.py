"""Text, hash and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import col

# UTF-8 byte pairs as they look after a wrong cp1252 read, with their repair.
MOJIBAKE = {
    "â€”": "—", "â€“": "–", "â€™": "’", "â€œ": "“", "â€¦": "…",
    "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã¸": "ø", "Ã¥": "å", "Ã±": "ñ", "Ã§": "ç",
}

# Fixed patterns: titles that are page furniture rather than news.
JUNK_TITLE = r"(?i)^\s*(home|menu|search|login|log in|sign in|subscribe|read more|next|previous|cookies?( policy| settings| preferences)?|accept( all)?( cookies)?|skip to (main )?(content|navigation)|image( \d+)?|photo|logo|lot \d+|auction( \d+)?)?\s*$"

# Legal forms, as they stand behind a name.
LEGAL_FORMS = r"[\s,]+(b\.?v\.?|n\.?v\.?|gmbh|inc|ltd|llc|a/?s|aps|ag|sa|s\.a\.|plc|corp|co)\.?\s*$"


def content_hash(*cols: Column | str) -> Column:
    """SHA-256 of the joined values; NULL and '' hash differently."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def is_junk_title(title: Column | str) -> Column:
    return F.coalesce(col(title).rlike(JUNK_TITLE), F.lit(True))


def relabel_language(text: Column | str, lang: Column | str, cyrillic_as: str = "uk") -> Column:
    """A text written in Cyrillic but tagged with a Latin-script language gets the other tag."""
    return F.when(col(text).rlike(r"\p{IsCyrillic}") & (col(lang) == "en"), F.lit(cyrillic_as)).otherwise(col(lang))


def repair_mojibake(text: Column | str) -> Column:
    out = col(text)
    for broken, fixed in MOJIBAKE.items():
        out = F.replace(out, F.lit(broken), F.lit(fixed))
    return out


def normalise_name(name: Column | str) -> Column:
    """Lower case, the legal form behind the name dropped, everything but letters and digits reduced to one blank.

    A name that has neither letters nor digits stays as it is, so it never equals another name.
    """
    bare = F.regexp_replace(F.lower(col(name)), LEGAL_FORMS, "")
    plain = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lower(col(name)))


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens of the whole text."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.lit(1.0) - F.try_divide(F.levenshtein(col(a), col(b)).cast("double"), longest.cast("double"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays."""
    return F.try_divide(
        F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
    )


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two numeric arrays; NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mentions_any(cols: list[Column | str], terms: list[str]) -> Column:
    """Case-insensitive search for any term in any column."""
    hit = F.lit(False)
    for c in cols:
        for term in terms:
            pattern = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            hit = hit | F.coalesce(col(c).ilike(f"%{pattern}%"), F.lit(False))
    return hit
