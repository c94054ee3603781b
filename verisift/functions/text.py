"""Text functions as column expressions, and their plain-Python twins for literal questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions.common import strings

# Results depend on these lists being exactly so.
STOPWORDS = (
    "a about after all also am an and any are as at be because been being between both but by can could did do does doing done "
    "during each few for from further had has have having he her here hers him his how however i if in into is it its itself just "
    "me more most much my no nor not now of off on once only or other our ours out over own same she should so some such than that "
    "the their them then there these they this those through to too under until up us very was we were what when where which while "
    "who whom why will with would you your yours"
).split()
SUFFIXES = ["ing", "ed", "es", "s"]
WH_WORDS = ["who", "what", "when", "where", "why", "how", "which"]
NEGATION_CUES = [
    "not", "no", "never", "none", "nothing", "neither", "nor", "no longer", "without", "cannot", "can't", "won't", "wouldn't",
    "shouldn't", "doesn't", "don't", "didn't", "isn't", "aren't", "wasn't", "weren't", "hardly", "barely", "rarely", "denies",
    "denied", "deny", "refutes", "refuted", "refute", "contradicts", "contradicted", "disputes", "disputed", "rejects", "rejected",
    "disproves", "disproved", "debunks", "debunked", "debunk", "false", "falsely", "untrue", "incorrect", "inaccurate", "myth",
    "ceased", "cease", "stopped", "halted", "lacks", "lacking", "absent", "fails", "failed", "contrary", "instead", "rather",
]
MIN_TERM = 3
#: White space and control characters but LF; a stretch of them becomes one space. Single spaces are not touched.
_GAP = "\\x00-\\x09\\x0B-\\x1F\\x20\\x7F\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_GAPS, _GAPS_AND_LINES = (f"[{c}&&[^ ]][{c}]*| [{c}]+" for c in (_GAP, _GAP + "\\x0A"))


def normalize_text(x: Column) -> Column:
    """Line ends to LF, control characters and white-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), _GAPS_AND_LINES, " "))


def normalize_lines(x: Column) -> Column:
    """Normalised, non-empty lines of a text as an array."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\\r\\n?", "\n"), _GAPS, " ")
    return F.array_remove(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), "")


def plain(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), "[\\u2018\\u2019\\u02BC`]", "'")
    return F.regexp_replace(x, "[^\\p{L}\\p{N}'\\s]+", " ")


def tokenize(x: Column) -> Column:
    return F.array_remove(F.split(plain(F.coalesce(x, F.lit(""))), "\\s+"), "")


def variants(token: Column) -> Column:
    """The token, then its stem for each suffix that it ends with; every suffix is tried on the token itself."""
    stems = [F.when(token.endswith(s) & (F.length(token) >= len(s) + MIN_TERM), F.substring(token, F.lit(1), F.length(token) - len(s))) for s in SUFFIXES]
    return F.array_compact(F.array(token, *stems))


def match_term(token: Column, terms: list[str]) -> Column:
    """First variant of the token that is a term; null for short tokens and for no match."""
    known = strings(terms)
    return F.when(F.length(token) >= MIN_TERM, F.get(F.filter(variants(token), lambda v: F.array_contains(known, v)), F.lit(0)))


def term_forms(terms: list[str]) -> dict[str, str]:
    """Every token that matches a term, with the term: a term itself, or one with a suffix; the first variant that is a
    term counts."""
    forms = {t: t for t in terms}
    for suffix in SUFFIXES:
        for t in terms:
            forms.setdefault(t + suffix, t)
    return forms


def split_sentences(line: Column) -> Column:
    return F.array_remove(F.transform(F.split(line, "(?<=[.!?;])\\s+"), lambda s: F.trim(s)), "")


def has_negation_cue(x: Column) -> Column:
    cues = "|".join(re.escape(c).replace("\\ ", " ") for c in NEGATION_CUES)
    text = F.trim(F.regexp_replace(plain(F.coalesce(x, F.lit(""))), "\\s+", " "))
    return text.rlike(f"(?<![A-Za-z0-9_])(?:{cues})(?![A-Za-z0-9_])")


def count_wh_words(x: Column) -> Column:
    return F.size(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]+"), lambda w: w.isin(WH_WORDS)))


def word_count(x: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(x, F.lit("")), "\\s+"), ""))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def hash_question(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def truncate(x: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space, with an ellipsis."""
    head = F.substring(x, 1, limit)
    at_space = F.regexp_extract(head, "(?s)^(.+) ", 1)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.when(at_space != "", at_space).otherwise(head)), F.lit("…")))


def question_terms(question: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Terms of a literal question, and each of its words with its variants."""
    text = re.sub("[‘’ʼ`]", "'", question.lower())
    text = "".join(c if c.isalnum() or c == "'" or c.isspace() else " " for c in text)
    groups: dict[str, list[str]] = {}
    usable = lambda w: len(w) >= MIN_TERM and w not in STOPWORDS
    for w in text.split():
        if usable(w) and w not in groups:
            stems = [w, *[w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) >= len(s) + MIN_TERM]]
            groups[w] = list(dict.fromkeys(v for v in stems if usable(v)))
    return list(dict.fromkeys(v for g in groups.values() for v in g)), list(groups.items())
