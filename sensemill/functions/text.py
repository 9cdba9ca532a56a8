"""Text functions: display cleaning, search keys, glosses, stems, token sets, digests.

Everything but Unicode normalisation and blake2b is a native expression; those two are Arrow-batched
pandas functions.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ------------------------------------------------------------------------------------
#: Letters that Unicode decomposition doesn't take apart.
FOLDS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}
STOPWORDS = (
    "a an the of to in for with on at by from as into like over after between under above behind during without within upon about "
    "against among through and or but nor so yet not no something someone one who that which is are was were be been being his her "
    "its their your our my this these those other another such very more most less least often usually typically generally "
    "particularly used"
).split()
SYNONYMS = {
    "kid": "child", "ill": "sick", "illness": "sickness", "movie": "film", "couch": "sofa", "tiny": "small", "huge": "large", "big": "large",
    "highway": "road", "assist": "help", "buy": "purchase", "begin": "start", "end": "finish", "cottage": "house", "physician": "doctor",
}
AMERICAN = {"colour": "color", "centre": "center", "metre": "meter", "organisation": "organization", "recognise": "recognize", "realise": "realize"}
#: The first suffix that fits is replaced, in up to four passes.
SUFFIXES = [
    ("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""),
    ("ers", "er"), ("or's", "or"), ("er's", "er"), ("'s", ""), ("ees", "ee"), ("oes", "o"), ("s", ""), ("e", ""), ("y", "i"),
]
CANONICAL_POS = ["noun", "verb", "adjective", "adverb", "phrase", "other"]
POS_ALIASES = {
    "modal auxiliary": "verb", "be-verb": "verb", "do-verb": "verb", "have-verb": "verb", "auxiliary verb": "verb",
    "adj": "adjective", "adv": "adverb", "prep_phrase": "phrase", "proverb": "phrase", "adv_phrase": "phrase",
    "n": "noun", "v": "verb", "a": "adjective", "s": "adjective", "r": "adverb",
}  # fmt: skip  (every other value is "other")
RELATION_GROUPS = {
    "synonym": ["similar"],
    "hypernym": ["hypernym", "instance_hypernym"],
    "hyponym": ["hyponym", "instance_hyponym"],
    "related": ["mero_part", "mero_member", "mero_substance", "holo_part", "holo_member", "holo_substance", "derivation", "domain_topic", "domain_region", "causes", "entails"],
}
# -------------------------------------------------------------------------------------------------
#: Each word of a synonym pair to the smaller of the two; a later pair overrides an earlier one.
CANON = {w: min(a, b) for a, b in SYNONYMS.items() for w in (a, b)}


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def collapsed(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_display(c: Column) -> Column:
    return collapsed(nfc(c))


def _fold(x: str) -> str:
    for a, b in FOLDS.items():
        x = x.replace(a, b)
    return "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _fold(x))


@F.pandas_udf(T.StringType())
def _casefolded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _fold(unicodedata.normalize("NFC", x).casefold()))


def search_key(c: Column) -> Column:
    """Case-folded, without diacritics and punctuation (the underscore stays)."""
    return nfc(collapsed(F.regexp_replace(_casefolded(c), r"[^\p{L}\p{N}_\s]", " ")))


def clean_gloss(c: Column) -> Column:
    """Without leading parenthesised labels and a trailing sense number."""
    out = F.trim(F.regexp_replace(collapsed(c), r"^(\([^)]*\)\s*)+", ""))
    return F.trim(F.regexp_replace(out, r"[;,]?\s*\d+\.$", ""))


def american_spelling(c: Column) -> Column:
    for uk, us in AMERICAN.items():
        c = F.regexp_replace(F.regexp_replace(c, rf"\b{uk}\b", us), rf"\b{uk.capitalize()}\b", us.capitalize())
    return c


def canonical_pos(c: Column) -> Column:
    key = F.lower(F.trim(c))
    return F.coalesce(F.when(key.isin(CANONICAL_POS), key), F.try_element_at(_mapping(POS_ALIASES), key), F.lit("other"))


def wordnet_pos(synset_pos: Column) -> Column:
    return canonical_pos(F.split(synset_pos, "-")[0])


def significant_tokens(key: Column) -> Column:
    """Sorted distinct tokens of three characters or more that are no stop words, synonyms as one."""
    kept = F.filter(F.split(key, " "), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.try_element_at(_mapping(CANON), t), t))))


def gloss_depth(gloss: Column) -> Column:
    """How many white-space tokens have two letters or digits at least."""
    return F.size(F.filter(F.split(gloss, r"\s+"), lambda t: F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def same_meaning(a: Column, b: Column) -> Column:
    """Token sets that mean the same: equal, one inside the other (two tokens at least), or close."""
    both, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (small > 0) & ((a == b) | ((both == small) & (small >= 2)) | (jaccard(a, b) >= 0.75) | ((F.size(a) == F.size(b)) & (jaccard(a, b) >= 0.6)))


def definition_similarity(a: Column, b: Column) -> Column:
    both, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    j = jaccard(a, b)
    return F.when(small == 0, 0.0).when(a == b, 0.95).when((both == small) & (small >= 2), 0.90).when(j >= 0.75, j).otherwise(j / 2)


@F.pandas_udf(T.StringType())
def _blake(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=6).hexdigest())


def gloss_digest(tokens: Column) -> Column:
    return _blake(F.array_join(tokens, " "))


def sense_key(headword: Column, pos: Column, digest: Column) -> Column:
    return F.concat_ws("|", headword, pos, digest)


def stem(token: Column) -> Column:
    """Light suffix stripping; a token keeps three characters at least. Tokens of three characters stay."""

    def once(t: Column) -> Column:
        out = t
        for suffix, to in reversed(SUFFIXES):
            base = F.substring(t, F.lit(1), F.length(t) - len(suffix))
            out = F.when(t.endswith(suffix) & (F.length(t) - len(suffix) + len(to) >= 3) & (F.length(t) - len(suffix) >= 3), F.concat(base, F.lit(to))).otherwise(out)
        return F.when(F.length(t) <= 3, t).otherwise(out)

    for _ in range(4):
        token = F.get(F.transform(F.array(token), once), F.lit(0))
    return token


def inline_polish(gloss: Column) -> Column:
    found = F.regexp_extract_all(gloss, F.lit(r"(?i)\((?:płsk\.|pl:|Polish:\s*)([^)]+)\)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def clean_example(c: Column) -> Column:
    out = collapsed(c)
    return F.when(F.length(out).between(3, 300) & out.rlike(r"[\p{L}\p{N}]"), out)


def embed_text(headword: Column, pos: Column, gloss: Column, examples: Column) -> Column:
    parts = F.transform(F.concat(F.array(headword, pos, gloss), F.slice(examples, 1, 2)), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def relation_group(relation: Column) -> Column:
    return F.coalesce(F.try_element_at(_mapping({r: g for g, rs in RELATION_GROUPS.items() for r in rs}), relation), relation)


def category_matches(token: Column, candidates: Column) -> Column:
    """A query token and a category's words: equal, or both four characters or more and one starts the other."""
    return F.exists(candidates, lambda c: (c == token) | ((F.length(c) >= 4) & (F.length(token) >= 4) & (F.startswith(c, token) | F.startswith(token, c))))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_multi(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def clipboard_line(headword: Column, translations: Column, definition: Column) -> Column:
    """headword, its first three translations and its definition; a dash where there are none."""
    some = F.array_join(F.slice(translations, 1, 3), ", ")
    return F.concat_ws(" — ", headword, F.when(some == "", "—").otherwise(some), F.coalesce(blank_to_null(definition), F.lit("—")))


def usable_headword(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\p{L}\p{N}]") & ~F.contains(c, F.lit("&")), F.lit(False))


#: Tags that are flags.
TAG_FLAGS = {"obsolete": "obsolete", "archaic": "archaic", "rare": "rare", "US": "american", "UK": "british"}


def tag_flag(tag: Column) -> Column:
    """The flag of a tag, null for tags that are none."""
    return F.try_element_at(_mapping(TAG_FLAGS), F.trim(tag))


def key_list(c: Column) -> Column:
    """The distinct parts of a comma-separated parameter, trimmed, without blank ones, in their first order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def punctuation_twin(query: Column) -> Column:
    """The search key of a one-word query that holds quotes, stars or brackets, where that is another word; else null.
    Phrases, exclusions and longer queries keep their own syntax."""
    q = F.trim(query)
    key = search_key(q)
    return F.when(q.rlike(r"^[^\s\-!\"][^ ]*$") & q.rlike(r"[\"'`*()]") & (key != "") & (key != q) & ~F.contains(key, F.lit(" ")), key)
