"""Text functions of columns. All are native expressions, so they stay in whole-stage code generation.

Word characters are said as Unicode classes, since Java's \\w is ASCII unless told otherwise.
"""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter and full names of languages, by two-letter code.
LANGUAGES = {"en": ("eng", "english"), "fr": ("fre", "fra", "french"), "de": ("ger", "deu", "german"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"), "it": ("ita", "italian"), "zh": ("chi", "zho", "chinese"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"), "ar": ("ara", "arabic")}
#: Frequent words by language, for the vote.
VOTES = {"en": ("the", "of", "and", "to", "in", "is"), "fr": ("le", "la", "les", "des", "et", "que"), "de": ("der", "die", "und", "das", "ein", "nicht"), "es": ("el", "los", "del", "para", "con", "que")}


def blank_to_null(c: Column) -> Column:
    """Missing is null, never an empty or blank string."""
    return F.when(F.trim(c) != "", c)


def norm_doi(c: Column) -> Column:
    """A DOI without resolver or scheme, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"^(?i:https?://(dx\.)?doi\.org/|doi:\s*)", "")))


def find_doi(c: Column) -> Column:
    """The first DOI anywhere in a text, lower-cased; null if none."""
    return blank_to_null(F.lower(F.regexp_extract(c, r"10\.[0-9]{4,}[^\s]*", 0)))


def norm_title(c: Column) -> Column:
    """Lower-cased, letters, digits, underscores and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def norm_near(c: Column) -> Column:
    """Lower-cased ASCII letters and digits, anything else a space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r" +", " "))


def norm_text(c: Column) -> Column:
    """Without zero-width characters, written-out line breaks and the five basic entities; white space single."""
    c = F.regexp_replace(c, "[​‌‍﻿]", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit(" ")), r"\s+", " "))


#: A character of two bytes or more that was read byte by byte in Windows-1252: a lead byte's letter and what its following bytes look like there.
_GARBLED = "[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}"


def _bytes_of(garbled: str) -> bytes:
    """The bytes that a garbled character was read from; those that Windows-1252 leaves open stand for themselves."""
    return b"".join(c.encode("cp1252") if ord(c) > 0xFF or not 0x80 <= ord(c) < 0xA0 else bytes([ord(c)]) for c in garbled)


def repair(text: str) -> str:
    """Characters that were decoded by the wrong table, put right as far as their bytes are UTF-8, twice for what was garbled twice; then entities of HTML, twice."""

    def right(m: re.Match) -> str:
        for end in range(len(m[0]), 1, -1):
            try:
                return _bytes_of(m[0][:end]).decode() + m[0][end:]
            except UnicodeError:
                continue
        return m[0]

    for _ in range(2):
        text = re.sub(_GARBLED, right, text)
    return html.unescape(html.unescape(text))


def repaired(c: Column) -> Column:
    """repair of a column. Only texts with an ampersand or a garbled character travel to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repair(t))

    return F.coalesce(run(F.when(c.rlike("&|" + _GARBLED), c)), c)


def norm_text_whole(c: Column) -> Column:
    """As norm_text, with every entity, entities of entities and garbled characters; empty for null."""
    c = F.regexp_replace(repaired(c), "[\u200b\u200c\u200d\u2060\ufeff\u00ad]", "")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(c, r"\\[ntr]", " "), r"[\s\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")), F.lit(""))


def norm_language(c: Column) -> Column:
    """The two-letter code of a code or name; regional parts go; null if unknown."""
    head = F.lower(F.trim(F.split_part(F.translate(c, "_", "-"), F.lit("-"), F.lit(1))))
    out = F.when(head.isin(*LANGUAGES), head)
    for code, names in LANGUAGES.items():
        out = out.when(head.isin(*names), F.lit(code))
    return out


def vote_language(c: Column, votes: Mapping[str, Sequence[str]] = VOTES) -> Column:
    """The language whose frequent words are most of a text's; the first of equals; null without any."""
    tokens = F.split(F.lower(c), r"[^\p{L}]+")
    counts = []
    for i, (k, w) in enumerate(votes.items()):
        counts.append(F.struct(F.size(F.filter(tokens, _among(list(w)))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")))
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"])


def _among(words: list[str]):
    return lambda t: t.isin(*words)


def from_inverted_index(index: Column) -> Column:
    """The text of a map from word to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def clean_abstract(c: Column, least: int = 20, stubs: Sequence[str] = ("no abstract available", "access to this document")) -> Column:
    """Without tags, white space single; empty if shorter than least or a stub."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    stub = F.lit(False)
    for s in stubs:
        stub = stub | F.contains(F.lower(c), F.lit(s))
    return F.when((F.length(c) < least) | stub, "").otherwise(c)


def first_paragraph(c: Column, least: int = 50) -> Column:
    """The first paragraph of more than so many characters; null if none."""
    return F.try_element_at(F.filter(F.transform(F.split(c, "\n"), lambda p: F.trim(p)), lambda p: F.length(p) > least), F.lit(1))


def token_count(c: Column) -> Column:
    """Tokens between white space."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def abstract_status(c: Column, generated: Column, most: int = 1000) -> Column:
    """missing, generated, too_long or original."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(generated, "generated").when(token_count(c) > most, "too_long").otherwise("original")


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance's share of the longer text."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_sorted(c: Column) -> Column:
    """The words of the normalised title in order."""
    return F.array_join(F.array_sort(F.split(norm_title(c), " ")), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the sorted words."""
    return edit_similarity(token_sorted(a), token_sorted(b))


def author_tokens(c: Column) -> Column:
    """The distinct parts of a name, two letters or longer."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)))


def same_author(a: Column, b: Column) -> Column:
    """Whether a's last part is a part of b, or b's of a."""
    x, y = F.split(F.lower(F.trim(a)), r"[^\p{L}\p{N}_]+"), F.split(F.lower(F.trim(b)), r"[^\p{L}\p{N}_]+")
    return F.array_contains(y, F.element_at(x, -1)) | F.array_contains(x, F.element_at(y, -1))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Pieces of size characters that overlap; the last may be shorter; none of an empty text."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - F.lit(overlap)), F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def first_json(c: Column) -> Column:
    """The first flat JSON object in a text; null if none."""
    return blank_to_null(F.regexp_extract(c, r"\{[^{}]*\}", 0))


def slug(c: Column) -> Column:
    """Anything but letters, digits, _ and - as _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_")


def is_email(c: Column) -> Column:
    return c.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def clean_term(c: Column, stops: Sequence[str] = ()) -> Column:
    """Whether a term is worth listing: three letters or more, no digit, not a stop word."""
    return (F.length(c) >= 3) & ~c.rlike("[0-9]") & ~c.isin(*stops)


def length_class(c: Column, most: int = 1000) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(token_count(c) > most, "too_long").otherwise("ok")


def title_overlap(a: Column, b: Column, share: float = 0.7) -> Column:
    """Equal, or the shared words are more than a share of a's."""
    x, y = F.array_distinct(F.split(norm_title(a), " ")), F.array_distinct(F.split(norm_title(b), " "))
    return (norm_title(a) == norm_title(b)) | (F.size(F.array_intersect(x, y)) / F.size(x) > share)


def fold(c: Column) -> Column:
    """Lower-cased, the accents of Western European letters taken off."""
    return F.translate(F.lower(c), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def hits(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text holds."""
    out = F.lit(0)
    for t in terms:
        out = out + F.when(F.contains(c, F.lit(t)), 1).otherwise(0)
    return out.cast("long")


def any_of(c: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any of the terms; false for null."""
    return F.coalesce(hits(c, terms) > 0, F.lit(False))
