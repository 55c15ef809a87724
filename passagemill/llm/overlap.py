"""Same or near-same records across splits, by winnowing fingerprints.

A record's text is folded (case, accents, character forms, punctuation, citation marks, number words) and written
without spaces. Of the rolling hashes of its ``GRAM``-character stretches the minimum of every ``WINDOW`` in a row is
selected, so any shared stretch of ``GRAM + WINDOW - 1`` characters shares a selected hash. Records of an evaluation
split meet training records that share selected hashes; seeds found once in both texts are chained in order, the
stretches between them are aligned, and what the alignment leaves over decides.

Two texts make the same statement if their content words align in order, where
* a word matches an equal one, another spelling or inflection of it, or, from four letters on, one a slip away;
* numbers, symbols (words with a digit or an inner capital) and negations match exactly, but for spaces inside them;
* a content word replaced by another one, or put in anywhere but before the statement (a lead-in), is another statement;
* two words a slip apart that the collection both knows well are different words, not a slip (``DISTINCT``);
* small words are ignored, and ``COVERAGE`` of the content words of either text must align.

What keeps the join small: equal texts are folded into one class per side first; of each text only the rarest hashes
join (prefix filtering), enough to meet every text sharing ``SHARED`` of them; and a hash joins together with the digits
of the text in order, which must be equal by the second rule however they are spaced or joined to letters.

Judged sets (``set_overlaps``) overlap if the sets of two records share at least a given part of their union: both
sides join on the rarest members that any such pair must share, and the overlap is then counted exactly.

Defined results
* null, blank and punctuation-only texts match nothing; null record ids and splits are left out;
* repeated rows count once; equal texts across splits match with coverage 1;
* texts shorter than ``GRAM`` are one hash; texts of any length are fingerprinted and aligned whole, by one algorithm;
* texts of small words only are compared by all their words; pairs have the smaller id first.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.leakage import one_slip
from passagemill.operators.setjoin import rarest, similar_sets
from passagemill.session import cut_lineage, spread

GRAM, WINDOW = 8, 4
#: Part of a text's hashes that a match must share, and part of its content words that must align.
SHARED, COVERAGE = 0.2, 0.6
#: The rarer of two words a slip apart is a slip if one text has it, or if the other is this many times as frequent.
DISTINCT = 50
#: Rows of a gap aligned with their bit rows kept; longer gaps are halved (linear memory).
ROWS = 256

_CITATION = re.compile(r"\[[\d\s,;–-]*\]|\(\s*refs?\.?\s*[\d\s,;–-]+\)|\([\d\s,;–-]+\)|\([^()]*\bet al\b[^()]*\)|(?<=[^\W\d])[⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[,–-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*", re.I)
_UNSEEN = re.compile("[­​-‏⁠-⁤﻿]+")
_WORD = re.compile(r"[^\W_]+")
#: Words that carry no statement. English function words, hedges and lead-ins; then verbs of reporting.
SMALL = frozenset(
    "a about also almost an and are as at be been being brief briefly but by cent clearly commonly did do does for frequently from had has "
    "have in indeed into is it its least less like likely mainly many more moreover most mostly much namely near nearly notably of "
    "often on once only onto or over partly per quite rather roughly so some still such than that the their them then there "
    "these they this those thus to toward towards under up upon usually very was were which while with within "
    "appear appeared appears confirm confirmed confirms demonstrate demonstrated demonstrates describe described describes find finds found "
    "indicate indicated indicates observe observed observes prove proved proven proves report reported reports reveal revealed reveals "
    "see seen show showed shown shows suggest suggested suggests uncover uncovered uncovers".split()
)
#: Words that turn a statement round. Fixed values.
NEGATIONS = frozenset("cannot fail failed fails lack lacked lacks neither never no none nor not without".split())
#: "no less than" says "at least", "no more than" says "at most": the negation in them turns nothing round.
_LEAST_MOST = re.compile(r"\bnot? (less|fewer|more) than\b")
#: Number words. Fixed values; tens join with the unit after them.
UNITS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()) if n > 1}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def fold(text: str | None) -> list[str]:
    """The folded words of a text without citation marks: symbols in upper case, all others in lower case.

    A word is a symbol if it holds a digit, or a capital after its first letter in a text that also has lower-case words.
    """
    if not text:
        return []
    t = unicodedata.normalize("NFKC", _CITATION.sub(" ", _UNSEEN.sub("", text)))
    t = "".join(c for c in unicodedata.normalize("NFKD", _CITATION.sub(" ", t)) if not unicodedata.combining(c))
    words = _WORD.findall(t)
    mixed = any(w.islower() for w in words)
    out: list[str] = []
    tens = 0
    for w in words:
        low = w.casefold()
        if low in TENS:
            tens = TENS[low]
            out.append(str(tens))
            continue
        if low in UNITS:
            n = UNITS[low]
            if tens and n < 10:
                out[-1] = str(tens + n)
            else:
                out.append(str(n))
        elif any(c.isdigit() for c in w):
            out.append("".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in w).upper())
        else:
            out.append(w.upper() if mixed and w[1:] != w[1:].lower() else low)
        tens = 0
    return [w for w in _LEAST_MOST.sub(r"\1", " ".join(out)).split(" ") if w]


def numbers(words: list[str]) -> str:
    """The digits of a text in order, which no spacing changes."""
    return "".join(c for w in words for c in w if c.isdigit())


def is_symbol(word: str) -> bool:
    return word != word.lower() or any(c.isdigit() for c in word)


def spelling(word: str) -> str:
    """A word without what British and American spelling and its inflection differ in: a key, not a word."""
    w = re.sub(r"([aeiou]?[b-df-hj-np-tv-xz])ou?r(?=$|s$|ed$|ing$|al$)", r"\1or", word.replace("ae", "e").replace("oe", "e"))
    w = re.sub(r"y[sz]", "yz", re.sub(r"i[sz](?=e|ing|ation)", "iz", w))
    w = re.sub(r"([b-df-hj-np-tv-z])\1", r"\1", w)
    w = re.sub(r"tre(?=s?$)", "ter", re.sub(r"ogue$", "og", w))
    for end, instead in (("ically", "ic"), ("ical", "ic"), ("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 4 and not w.endswith(("ss", "us", "is")):
            return w[: len(w) - len(end)] + instead
    return w


def same_word(a: str, b: str) -> bool:
    """Equal but for case, or two words (no symbols) of another spelling or inflection, or one slip apart."""
    x, y = a.lower(), b.lower()
    if x == y:
        return True
    if is_symbol(a) or is_symbol(b) or x in NEGATIONS or y in NEGATIONS or max(len(x), len(y)) < 4:
        return False
    return spelling(x) == spelling(y) or one_slip(x, y)


def winnow(chars: str) -> tuple[np.ndarray, np.ndarray]:
    """(selected hashes, their places) of a string; the rightmost minimum of every window."""
    x = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(GRAM, len(x))
    h = np.zeros(len(x) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(1_000_003) + x[j : len(x) - k + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w = min(WINDOW, len(h))
    back = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    at = np.unique(np.arange(len(back)) + w - 1 - back.argmin(axis=1))
    return h[at].view(np.int64), at


def chain(a: str, b: str) -> list[tuple[int, int]]:
    """The longest chain of seeds in the same order in both strings, as places; a seed is a selected hash that each
    string holds once, so there are never more seeds than hashes."""
    once = lambda s: {h: p for h, p, n in zip(*(x.tolist() for x in _firsts(*winnow(s)))) if n == 1}
    pa_, pb = once(a), once(b)
    seeds = sorted((p, pb[h]) for h, p in pa_.items() if h in pb)
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, (_, q) in enumerate(seeds):
        n = bisect_left(ends, q)
        before.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(q)
            last.append(i)
        else:
            ends[n], last[n] = q, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(seeds[i])
        i = before[i]
    return out[::-1]


def _firsts(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return values, places[first], n


def rejoin(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Both texts with words that one of them writes in two or three parts written as the other one does: "PD L1" as
    "PDL1", "5 mg" as "5mg", "per cent" as "percent"."""
    known = {w.lower() for w in a} | {w.lower() for w in b}

    def joined(words: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(words):
            for n in (3, 2, 1):
                part = words[i : i + n]
                if n == 1 or (len(part) == n and "".join(part).lower() in known):
                    whole = "".join(part)
                    out.append(whole.upper() if any(is_symbol(w) for w in part) else whole)
                    i += n
                    break
        return out

    return joined(a), joined(b)


def partners(a: list[str], b: list[str]) -> dict[str, list[str]]:
    """For each word of ``a`` the words of ``b`` it matches, found by shared keys rather than by trying all."""
    keys: dict[str, set[str]] = defaultdict(set)

    def keys_of(w: str) -> list[str]:
        x = w.lower()
        return [x] if is_symbol(w) or len(x) < 3 else [x, spelling(x), *(x[:i] + x[i + 1 :] for i in range(len(x)))]

    for w in set(b):
        for k in keys_of(w):
            keys[k].add(w)
    return {w: [v for v in {v for k in keys_of(w) for v in keys.get(k, ())} if same_word(w, v)] for w in set(a)}


def _masks(a: list[str], b: list[str], match: dict[str, list[str]]) -> list[int]:
    """For each word of ``a`` the places of ``b`` it matches, as bits."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    held: dict[str, int] = {}
    for w in set(a):
        m = 0
        for v in match[w]:
            m |= at.get(v, 0)
        held[w] = m
    return [held[w] for w in a]


def _rows(masks: list[int], width: int) -> list[int]:
    """The bit rows of the longest-common-subsequence table: a zero at j of row i marks a step of its length there."""
    full = (1 << width) - 1
    v, out = full, [full]
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(row: int, width: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of the second list."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((width + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:width]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str], match: dict[str, list[str]]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence under ``match``, by bit rows and halving: memory grows with the
    lengths, not with their product."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n <= ROWS:
            masks = _masks(a[i0:i1], b[j0:j1], match)
            rows = _rows(masks, m)
            i, j = n, m
            while i and j:
                bit = 1 << (j - 1)
                if rows[i] & bit:  # no step at j: the last word of b is not needed
                    j -= 1
                elif not rows[i - 1] & bit:  # the step was there without word i
                    i -= 1
                else:
                    out.append((i0 + i - 1, j0 + j - 1))
                    i, j = i - 1, j - 1
            continue
        mid = (i0 + i1) // 2
        head = _lengths(_rows(_masks(a[i0:mid], b[j0:j1], match), m)[-1], m)
        tail = _lengths(_rows(_masks(a[mid:i1][::-1], b[j0:j1][::-1], match), m)[-1], m)[::-1]
        cut = j0 + int((head + tail).argmax())
        stack += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return sorted(out)


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of word places that match: words under the chained seeds, and the gaps between them aligned."""
    starts_a = np.cumsum([0, *map(len, a)]).tolist()
    starts_b = np.cumsum([0, *map(len, b)]).tolist()
    match = partners(a, b)
    out: list[tuple[int, int]] = []

    def gap(i0: int, i1: int, j0: int, j1: int) -> None:
        out.extend((i0 + i, j0 + j) for i, j in common(a[i0:i1], b[j0:j1], match))

    i = j = 0
    for p, q in chain("".join(a).lower(), "".join(b).lower()):
        # the first whole word that starts inside the seed in both texts
        x, y = bisect_left(starts_a, p), bisect_left(starts_b, q)
        if x < i or y < j or x >= len(a) or y >= len(b) or starts_a[x] - p != starts_b[y] - q or starts_a[x] - p >= GRAM or not same_word(a[x], b[y]):
            continue
        gap(i, x, j, y)
        out.append((x, y))
        i, j = x + 1, y + 1
    gap(i, len(a), j, len(b))
    return out


def _small_keys() -> dict[str, list[str]]:
    keys: dict[str, list[str]] = defaultdict(list)
    for w in sorted(SMALL):
        if len(w) >= 5:
            for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
                keys[k].append(w)
    return keys


_SMALL_KEYS = _small_keys()


def _slip_of_small(word: str, slips: set[tuple[str, str]]) -> bool:
    """Whether a word left over is one slip from a small word of five or more letters; if so it is noted."""
    if is_symbol(word) or word in NEGATIONS:
        return False
    for k in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))):
        for small in _SMALL_KEYS.get(k, ()):
            if one_slip(word, small):
                slips.add((word, small))
                return True
    return False


def compare(a: list[str], b: list[str], coverage: float = COVERAGE) -> tuple[float, list[tuple[str, str]]] | None:
    """(part of the content words that align, slips) of two texts that make the same statement; None if they do not.

    The slips are the pairs of different words taken for one; whether the collection knows both is for the caller.
    """
    a, b = rejoin(a, b)
    if not a or not b or numbers(a) != numbers(b):
        return None
    content = lambda words: [w for w in words if w.lower() not in SMALL]
    x, y = content(a), content(b)
    if not x or not y:
        x, y = a, b
    pairs = align(x, y)
    if not pairs or len(pairs) < coverage * max(len(x), len(y)):
        return None
    i = j = 0
    slips: set[tuple[str, str]] = set()
    for p, q in [*pairs, (len(x), len(y))]:
        over = x[i:p], y[j:q]
        left, right = ([w for w in side if not _slip_of_small(w, slips)] for side in over)
        if left or right:
            lead_in = i == j == 0 and not all(over) and not any(is_symbol(w) or w in NEGATIONS for w in left + right)
            if not lead_in:
                return None
        i, j = p + 1, q + 1
    slips |= {(x[p], y[q]) for p, q in pairs if x[p].lower() != y[q].lower() and spelling(x[p].lower()) != spelling(y[q].lower())}
    return len(pairs) / max(len(x), len(y)), sorted(slips)


def is_slip(a: int, b: int) -> bool:
    """Whether of two words a slip apart, found in so many texts, the rarer is a slip of the other."""
    return min(a, b) <= 1 or min(a, b) * DISTINCT <= max(a, b)


# the Spark side

_PREPARED = pa.schema([("record", pa.string()), ("side", pa.string()), ("norm", pa.string()), ("digits", pa.string())])


def prepare(records: DataFrame) -> DataFrame:
    """record, side, norm, digits of records (record, side, text) whose text has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for record, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = fold(text)
                if w:
                    for column, value in zip(out, (record, side, " ".join(w), numbers(w))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _PREPARED)], schema=_PREPARED)

    return records.select("record", "side", "text").mapInArrow(run, "record string, side string, norm string, digits string")


def fingerprints(classes: DataFrame) -> DataFrame:
    """cls, side, digits, print, n: the distinct selected hashes of each class and their number."""
    schema = pa.schema([("cls", pa.string()), ("side", pa.string()), ("digits", pa.string()), ("print", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for cls, side, norm, digits in zip(*(c.to_pylist() for c in batch.columns)):
                prints = np.unique(winnow(norm.replace(" ", "").lower())[0]).tolist()
                for h in prints:
                    for column, value in zip(out, (cls, side, digits, h, len(prints))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return classes.select("cls", "side", "norm", "digits").mapInArrow(run, "cls string, side string, digits string, print long, n int")


def text_overlaps(records: DataFrame, coverage: float = COVERAGE, shared: float = SHARED) -> DataFrame:
    """left, right, coverage: training and evaluation records (record, side, text) with the same statement.

    ``side`` is 'train' or 'eval'. Equal texts are one class a side, so only texts that differ are compared.
    """
    prepared = prepare(records.where(F.col("record").isNotNull() & F.col("side").isNotNull() & F.col("text").isNotNull()).distinct()).withColumn("cls", F.md5(F.lower("norm")))
    # read six times below, so folded once; hashed by class for the aggregates and to keep the fingerprinting on all cores
    prepared = spread(cut_lineage(prepared), "cls")
    # of equal texts the one that marks its symbols: capitals sort first
    classes = prepared.groupBy("cls", "side").agg(F.min("norm").alias("norm"), F.first("digits").alias("digits"))
    prints = fingerprints(classes)
    few = rarest(prints, ["cls", "side"], "print", F.ceil(F.col("n") * F.lit(shared)))
    train = few.where("side = 'train'").select(F.col("cls").alias("a"), "print", "digits")
    other = few.where("side = 'eval'").select(F.col("cls").alias("b"), "print", "digits")
    pairs = train.join(other, ["print", "digits"]).select("a", "b").distinct()
    text = classes.select("cls", "side", "norm")
    pairs = pairs.join(text.where("side = 'train'").select(F.col("cls").alias("a"), F.col("norm").alias("x")), "a")
    pairs = pairs.join(text.where("side = 'eval'").select(F.col("cls").alias("b"), F.col("norm").alias("y")), "b")
    slip = pa.struct([("u", pa.string()), ("v", pa.string())])
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("coverage", pa.float64()), ("slips", pa.list_(slip))])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                same = (1.0, []) if a == b else compare(x.split(" "), y.split(" "), coverage)
                if same is not None:
                    for column, value in zip(out, (a, b, same[0], [{"u": u, "v": v} for u, v in same[1]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    found = spread(pairs.select("a", "b", "x", "y"), "a").mapInArrow(verify, "a string, b string, coverage double, slips array<struct<u: string, v: string>>")
    found = _without_distinct_words(found, classes)
    members = prepared.select("cls", "side", "record").distinct()
    left = members.where("side = 'train'").select(F.col("cls").alias("a"), F.col("record").alias("left"))
    right = members.where("side = 'eval'").select(F.col("cls").alias("b"), F.col("record").alias("right"))
    return found.join(left, "a").join(right, "b").select("left", "right", "coverage")


def _without_distinct_words(found: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, coverage of the pairs none of whose slips are two words that the collection both knows (``is_slip``).

    The number of different texts with a word is counted over all texts; a word that only rejoining made counts none.
    """
    words = classes.select("cls", F.explode(F.array_distinct(F.split(F.lower("norm"), " "))).alias("word")).distinct()
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    of = lambda c, name: df.select(F.col("word").alias(c), F.col("df").alias(name))
    slips = found.select("a", "b", "coverage", F.explode_outer("slips").alias("s")).select("a", "b", "coverage", F.lower("s.u").alias("u"), F.lower("s.v").alias("v"))
    counted = slips.join(of("u", "m"), "u", "left").join(of("v", "n"), "v", "left")
    less, more = F.least(F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))), F.greatest(F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0)))
    known = F.col("u").isNotNull() & (less > 1) & (less * DISTINCT > more)
    return counted.groupBy("a", "b").agg(F.first("coverage").alias("coverage"), F.max(known).alias("_known")).where(~F.col("_known")).drop("_known")


def set_overlaps(members: DataFrame, least: int = 3, part: float = 0.5) -> DataFrame:
    """left, right, coverage: train and eval records whose member sets share ``part`` or more of their union.

    ``members`` holds record, side, member. Records with fewer than ``least`` members are left out.
    """
    own = members.dropna().select(F.col("record").alias("owner"), "member", "side")
    return similar_sets(own, part, F.col("side") == "train", F.col("side") == "eval", least)


def ordered(pairs: DataFrame) -> DataFrame:
    """query_lo, query_hi of pairs, each once."""
    return pairs.select(F.least("left", "right").alias("query_lo"), F.greatest("left", "right").alias("query_hi")).distinct()
