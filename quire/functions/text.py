"""Column functions on the text of lines and topics. All stay in the JVM but ``matched_ratio``."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# --- fixed values -----------------------------------------------------------------------------

#: Phrases that are wholly procedural, after lower-casing and removal of all but letters and spaces.
PROCEDURAL_PHRASES = (
    "objection", "objection form", "objection to form",
    "objection foundation", "objection to foundation",
    "objection asked and answered", "objection relevance",
    "objection vague", "objection compound",
    "objection calls for speculation", "objection hearsay",
    "objection nonresponsive", "move to strike",
    "let the record reflect", "let me read that back",
    "can i have that read back", "please read the question back",
    "can you read that back", "read that back please",
    "off the record", "back on the record",
    "go off the record", "lets go off the record",
    "stipulated", "so stipulated", "same objection",
    "continuing objection", "standing objection",
    "noted", "noted for the record",
)

#: Patterns of procedural notes.
NOTE_PATTERNS = (
    r"(?i)^\((?:exhibit|deposition exhibit)\s+(?:no\.?\s*)?\d+\s+(?:was\s+)?marked",
    r"(?i)^\((?:recess|break|lunch)\s+(?:taken|had|from)",
    r"(?i)^\((?:discussion|conference)\s+(?:held\s+)?off\s+the\s+record",
    r"(?i)^\((?:whereupon|thereupon)",
    r"(?i)^\(the\s+(?:deposition|examination|proceeding)\s+(?:was\s+)?(?:recessed|adjourned|concluded|resumed)",
    r"^---+$",
    r"^\*\s*\*\s*\*",
)

#: Words that are no keywords.
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "you", "your", "he", "she", "it", "its", "they", "them", "their", "this", "that", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "a", "an", "the", "and", "but", "or", "if", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "into", "about", "between", "through", "not", "no", "so", "than", "too", "very", "just", "also", "then", "there", "here", "when",
    "where", "how", "what", "which", "who", "whom",
)

#: White space of any kind.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

SPEAKERS = r"MR\.\s+[A-Z]+|MS\.\s+[A-Z]+|THE\s+WITNESS|THE\s+REPORTER|THE\s+VIDEOGRAPHER|THE\s+COURT"
STAMP = r"(\d{2}:\d{2})\s*$"

# --- lines ------------------------------------------------------------------------------------


def stripped(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def not_blank(c: Column) -> Column:
    return stripped(c) != ""


def timestamp_of(content: Column) -> Column:
    """The clock time at the end of a line, or null."""
    return F.nullif(F.regexp_extract(content, STAMP, 1), F.lit(""))


def without_timestamp(content: Column, stamp: Column) -> Column:
    return F.when(stamp.isNotNull(), stripped(F.regexp_replace(content, STAMP, ""))).otherwise(stripped(content))


# \b for letters of any script, as a one-letter tag before an accented letter is none
_NAMED = rf"(?i)^(?:BY\s+)?({SPEAKERS}|[QA](?![\p{{L}}\p{{N}}_]))[\.:\s]*(.*)"


def tag_of(content: Column) -> Column:
    """The name or letter with which a line begins, in capitals, or an empty text.

    A continuation that begins with the article "a" is taken for an answer, as the letter is.
    """
    return F.upper(F.regexp_extract(content, _NAMED, 1))


def speaker_named(tag: Column, attorney: Column, witness: Column) -> Column:
    """The speaker of a tag in a standard form, or null if it is empty. A null name isn't shown."""
    return (
        F.when(tag == "", F.lit(None))
        .when(tag == "Q", F.concat(F.lit("QUESTION"), F.coalesce(F.concat(F.lit(" ("), attorney, F.lit(")")), F.lit(""))))
        .when(tag == "A", F.concat(F.lit("ANSWER"), F.coalesce(F.concat(F.lit(" ("), witness, F.lit(")")), F.lit(""))))
        .otherwise(tag)
    )


def spoken(content: Column, tag: Column) -> Column:
    """What follows the speaker's name; the whole content if its tag is empty."""
    return F.when(tag != "", stripped(F.regexp_extract(content, _NAMED, 2))).otherwise(content)


def short_witness(name: Column) -> Column:
    """The last word of a name, in capitals."""
    return F.upper(F.try_element_at(F.split(stripped(name), r"\s+"), F.lit(-1)))


def short_attorney(name: Column) -> Column:
    return F.upper(stripped(F.regexp_replace(name, r"(?i)^(?:MR\.|MS\.)\s*", "")))


def compact_line(page: Column, line: Column, speaker: Column, text: Column) -> Column:
    """[P07:L12] SPEAKER: text"""
    return F.concat(F.format_string("[P%02d:L%02d] ", page, line), F.when(speaker != "", F.concat(speaker, F.lit(": "))).otherwise(""), text)


def coordinate(page: Column, line: Column) -> Column:
    return F.format_string("Page %d, Line %d", page, line)


# --- noise ------------------------------------------------------------------------------------


def letters_only(c: Column) -> Column:
    return stripped(F.regexp_replace(F.lower(c), r"(?U)[^a-z\s]", ""))


#: With which two letters noise begins: all that most lines are tried for.
_NOISE_STARTS = r"\A[^a-z]*+(?:" + "|".join(f"{a}[^a-z]*{b}" for a, b in sorted({p[:2] for p in (*PROCEDURAL_PHRASES, "same", "continuing", "standing")})) + ")"


def is_pure_noise(text: Column) -> Column:
    """A line that is nothing but an objection or another procedural phrase."""

    def judged(plain: Column) -> Column:
        return (
            plain.isin(*PROCEDURAL_PHRASES)
            | (plain.startswith("objection") & (word_count(plain) <= 5))
            | plain.rlike(r"^(?:same|continuing|standing)\s+objection")
        )

    # bound to a name, so that letters are taken out once
    noise = F.element_at(F.transform(F.array(letters_only(text)), judged), 1)
    return F.when(F.lower(text).rlike(_NOISE_STARTS), noise).when(text.isNotNull(), F.lit(False))


def is_note(text: Column) -> Column:
    out = F.lit(False)
    for pattern in NOTE_PATTERNS:
        out = out | text.rlike(pattern)
    return out


def word_count(c: Column) -> Column:
    """The number of words between white space; an empty text has none."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


# --- keywords and comparison ------------------------------------------------------------------


def keywords(c: Column) -> Column:
    """Runs of a-z of the lower-cased text, longer than two letters and no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def keyword_overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set of keywords that the other has, too; 0 if either is empty."""

    def share(p: Column) -> Column:
        least = F.least(F.size(p["a"]), F.size(p["b"]))
        return F.when(least > 0, F.size(F.array_intersect(p["a"], p["b"])) / least).otherwise(F.lit(0.0))

    # bound to a name, so that both are computed once
    both = F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    return F.element_at(F.transform(F.array(both), share), 1)


def plain(c: Column) -> Column:
    """Lower case, without all but letters a-z, digits and white space; white space stays as it is."""
    return F.lower(F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s]", ""))


def normalized(c: Column) -> Column:
    """``plain``, without white space at either end."""
    return stripped(plain(c))


@F.pandas_udf(DoubleType())
def _ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def matched_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, popular characters of long ones disregarded; not symmetric."""
    return _ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """What ``matched_ratio`` can't exceed, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2 * F.least(F.length(a), F.length(b)) / total).otherwise(F.lit(1.0))


# --- intervals --------------------------------------------------------------------------------


def linear(page: Column, line: Column, lines_per_page: int = 25) -> Column:
    return (page - 1) * lines_per_page + line


def line_span(sp: Column, sl: Column, ep: Column, el: Column) -> Column:
    """The number of lines of an interval, at least one on a page of its own."""
    return F.when(sp == ep, F.greatest(F.lit(1), el - sl + 1)).otherwise((25 - sl + 1) + 25 * F.greatest(F.lit(0), ep - sp - 1) + el)


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared lines as a share of the smaller interval, by linear places; 0 if that has none."""
    least = F.least(a_end - a_start + 1, b_end - b_start + 1)
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)
    return F.when(least > 0, shared / least).otherwise(F.lit(0.0))


def touches(asp: Column, asl: Column, aep: Column, ael: Column, bsp: Column, bsl: Column, bep: Column, bel: Column) -> Column:
    """b begins within a, within three lines of its end, or at the top of the next page when a ends at the bottom."""
    after = (asp > bep) | ((asp == bep) & (asl > bel))
    near = (bsp < aep) | ((bsp == aep) & (bsl <= ael + 3)) | ((bsp == aep + 1) & (ael >= 23) & (bsl <= 3))
    return ~after & near
