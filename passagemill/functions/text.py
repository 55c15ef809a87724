"""Text functions as column expressions: tokens, literals, keys, clauses, indexable text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped by the tokenizer.
STOPWORDS = (
    "a an and are as at be been but by for from has have how i if in into is it its of on or "
    "that the their then there these they this to was were what when where which who will with "
    "we our us can could would should may might do does did not no nor"
).split()
# What separates tokens (all but letters, digits, underscore and the joiners), and the joiners.
TOKEN_SPLIT = r"[^\p{L}\p{N}_\-/+]+"
JOINERS = r"[-/+]"


def is_mix(t: Column) -> Column:
    """Lower-case ASCII letters and digits only, with at least one of each."""
    return t.rlike("^[a-z0-9]+$") & t.rlike("[a-z]") & t.rlike("[0-9]")


def is_rare_literal(t: Column) -> Column:
    """An identifier rather than a word: a letter-digit mix of three or more characters."""
    return is_mix(t) & (F.length(t) >= 3)


def _forms(raw: Column) -> Column:
    """The forms one raw token is indexed under: itself, joined, and its parts."""
    parts = F.filter(F.split(raw, JOINERS), lambda p: (p != "") & ((F.length(p) > 1) | p.rlike(r"^\p{N}+$")))
    return F.when(raw.rlike(JOINERS), F.concat(F.array(raw, F.regexp_replace(raw, JOINERS, "")), parts)).otherwise(F.array(raw))


def tokenize(text: Column, drop_stopwords: bool = True, keep_short_mix: bool = True) -> Column:
    """Array of tokens in order, repeats kept. Null and empty texts give an empty array."""
    raw = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda x: F.regexp_replace(x, r"^[-/+]+|[-/+]+$", ""))
    forms = F.flatten(F.transform(F.filter(raw, lambda x: x != ""), _forms))

    def keep(t: Column) -> Column:
        long_enough = (F.length(t) > 2) | ((F.length(t) == 2) & is_mix(t)) if keep_short_mix else F.length(t) > 2
        return long_enough & ~t.isin(STOPWORDS) if drop_stopwords else long_enough

    return F.filter(forms, keep)


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of n tokens joined by '_'; the tokens themselves for n <= 1."""
    if n <= 1:
        return tokens
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "_"))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def norm_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def indexable_text(title: Column, section: Column, text: Column, context: Column | None = None) -> Column:
    """What the indexers see: heading line, optional context line, passage; null parts are skipped."""
    heading = F.concat(F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(section, F.lit("")))
    return F.concat_ws("\n", heading, *([context] if context is not None else []), text)


def gist(abstract: Column) -> Column:
    """The first sentence of 40 to 320 characters, else the first 220 characters."""
    first = F.regexp_extract(abstract, r"^(.{39,319}?[.!?])(\s|$)", 1)
    return F.when(first != "", first).otherwise(F.substring(abstract, 1, 220))


def normalise_pmcid(raw: Column) -> Column:
    """'PMC' and digits, else null."""
    t = F.upper(F.trim(raw))
    digits = F.regexp_extract(t, r"^(PMC)?([0-9]+)$", 2)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def strip_tags(markup: Column) -> Column:
    """Markup with its tags removed and white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


#: White space between clauses, as what surrounds it says.
CLAUSE_GAP = r"(?<=[.;:!?])\s+(?=[A-Z(\[])"

#: Sentence ends as both engines can split them: a mark is put between the end and the next capital.
MARK = "\u0001"


def clauses(text: Column) -> Column:
    """Clauses: cut at white space after one of .;:!? and before a capital or an opening bracket."""
    return F.split(F.regexp_replace(text, r"([.;:!?])\s+([A-Z(\[])", "$1" + MARK + "$2"), MARK)


def numbers(text: Column) -> Column:
    """The numeric literals of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\b[0-9]+(?:[.,][0-9]+)?\b)"), F.lit(1))


def masked(text: Column, patterns: list[str]) -> Column:
    """A text without what the patterns match in any case, white space collapsed: what is left to judge it by."""
    for p in patterns:
        text = F.regexp_replace(text, f"(?i){p}", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
