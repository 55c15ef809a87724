"""Evaluation texts leaking into training text: a BM25 index of the test items, searched with block-max WAND.

The held-out items are the small side: the inverted index of a block of them, bounded in number and characters, goes
to every worker, and further items are further blocks. The training documents are only scanned, once per block, without
a shuffle.

1. Words are runs of letters and digits after folding case, accents and character forms; invisible characters, tags,
   bracketed citation numbers and hyphens at line ends are ignored.
2. A word of the corpus stands for the index terms it equals or, for terms of four or more letters, differs from by
   one slip (a letter wrong, missing, extra or swapped with its neighbour), found by shared deletions.
3. A training passage is a maximal run of ``RUN`` or more words that each stand for some term; no shorter run can
   hold ``RUN`` consecutive item words.
4. Each passage is a BM25 query. Postings lie in blocks of items with a maximum impact each; WAND moves its cursors by
   term maxima and skips blocks whose maxima cannot reach the threshold. Impacts of an item are divided by the least
   score any ``RUN`` of its words can have, so the threshold 1 loses no item.
5. Retrieved items are verified: the longest stretch of consecutive words shared by passage and item.

Defined results
* null, empty and blank texts hold nothing; items shorter than ``RUN`` words are never found;
* repeated rows count once; a document holding an item several times gives one row with the longest stretch;
* extra columns are ignored; an empty item table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
#: Items and characters of one block, about: its index is held by every worker. Further blocks take further scans.
BLOCK_MAX_ITEMS, BLOCK_MAX_CHARS = 50_000, 50_000_000
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75
#: Entries kept in a worker's memo of corpus words.
MEMO = 500_000

_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|sup|sub|span|small|font)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_CITATION = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_LINE_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t]*(?=\w)")
_UNSEEN = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]+")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The folded words of a text."""
    plain = text.isascii()
    if not plain:
        text = _UNSEEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        plain = text.isascii()
        if not plain:
            text = _UNSEEN.sub("", text)
    if "[" in text:
        text = _CITATION.sub(" ", text)
    if "\n" in text and ("-" in text or not plain):
        text = _LINE_HYPHEN.sub("", text)
    if plain:
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold())


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_slip(a: str, b: str) -> bool:
    """Whether two words are equal or one letter wrong, missing, extra or swapped with its neighbour apart."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


class ItemIndex:
    """Block-max inverted index of the items' words."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        self.run = run
        docs = [(i, words(t or "")) for i, t in sorted(items)]
        docs = [(i, w) for i, w in docs if len(w) >= run]
        self.ids = [i for i, _ in docs]
        self.terms: dict[str, int] = {}
        self.items = [array("i", [self.terms.setdefault(x, len(self.terms)) for x in w]) for _, w in docs]
        self.near: dict[str, list[int]] = defaultdict(list)
        for t, k in self.terms.items():
            if len(t) >= 4 and t.isalpha():
                for v in {t} | _deletions(t):
                    self.near[v].append(k)
        self.names = list(self.terms)
        n = len(docs)
        mean = sum(map(len, self.items)) / n if n else 1.0
        df = Counter(t for w in self.items for t in set(w))
        idf = {t: log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(self.items):
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(w).items()}
            least = min(sum(impact[t] for t in set(w[s : s + run])) for s in range(len(w) - run + 1))
            for t, x in impact.items():
                postings[t].append((d, x / least))
        #: term -> (items, impacts, block ends, block maxima, term maximum)
        self.postings: dict[int, tuple[list[int], list[float], list[int], list[float], float]] = {}
        for t, p in postings.items():
            at, x = [d for d, _ in p], [v for _, v in p]
            ends = [at[min(i + BLOCK_ITEMS, len(at)) - 1] for i in range(0, len(at), BLOCK_ITEMS)]
            tops = [max(x[i : i + BLOCK_ITEMS]) for i in range(0, len(at), BLOCK_ITEMS)]
            self.postings[t] = (at, x, ends, tops, max(tops))
        self.memo: dict[str, tuple[int, ...]] = {}

    def senses(self, word: str) -> tuple[int, ...]:
        """The terms a corpus word stands for."""
        found = set()
        own = self.terms.get(word)
        if own is not None:
            found.add(own)
        if len(word) >= 3 and word.isalpha():
            for v in {word} | _deletions(word):
                for k in self.near.get(v, ()):
                    if k not in found and one_slip(word, self.names[k]):
                        found.add(k)
        return tuple(sorted(found))

    def search(self, terms: set[int], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items whose summed impact over ``terms`` reaches the threshold, by block-max WAND."""
        lists = [self.postings[t] for t in terms if t in self.postings]
        cursors = [[p[0][0], 0, p, 0] for p in lists]  # item, place, postings, block
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2][4]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # block maxima of the lists up to the pivot, moved to the block that can hold the pivot item
            block_bound, next_item = 0.0, None
            for c in cursors[: pivot + 1]:
                ends, b = c[2][2], c[3]
                while b < len(ends) and ends[b] < item:
                    b += 1
                c[3] = b
                if b < len(ends):
                    block_bound += c[2][3][b]
                    next_item = ends[b] + 1 if next_item is None else min(next_item, ends[b] + 1)
            if block_bound >= threshold:
                if cursors[0][0] == item:
                    score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append(item)
                    target = item + 1
                else:
                    target = item
            else:
                target = max(item + 1, min(next_item or item + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60))
            for c in cursors[: pivot + 1]:
                at, i = c[2][0], c[1]
                if c[0] < target:
                    # whole blocks below the target are passed by their ends
                    b = c[3]
                    while b < len(c[2][2]) and c[2][2][b] < target:
                        b += 1
                    i = max(i, b * BLOCK_ITEMS)
                    while i < len(at) and at[i] < target:
                        i += 1
                    c[0], c[1], c[3] = (at[i] if i < len(at) else -1), i, b
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def longest_shared(self, passage: list[tuple[int, ...]], item: int) -> int:
        """Length of the longest stretch of consecutive words shared by a passage and an item."""
        places: dict[int, list[int]] = defaultdict(list)
        for j, t in enumerate(self.items[item]):
            places[t].append(j)
        best, before = 0, {}
        for senses in passage:
            now = {}
            for t in senses:
                for j in places.get(t, ()):
                    now[j] = before.get(j - 1, 0) + 1
            if now:
                best = max(best, max(now.values()))
            before = now
        return best

    def leaks(self, text: str) -> dict[int, int]:
        """item place -> longest shared stretch, for the items of which ``text`` holds ``run`` or more words."""
        memo, seen = self.memo, words(text)
        if len(seen) < self.run:
            return {}
        for w in set(seen):
            if w not in memo:
                memo[w] = self.senses(w)
        flags = bytes(1 if memo[w] else 0 for w in seen)
        found: dict[int, int] = {}
        at = flags.find(b"\x01" * self.run)
        while at >= 0:
            end = flags.find(b"\x00", at)
            end = len(flags) if end < 0 else end
            passage = [memo[w] for w in seen[at:end]]
            for item in self.search({t for s in passage for t in s}):
                n = self.longest_shared(passage, item)
                if n >= self.run:
                    found[item] = max(found.get(item, 0), n)
            at = flags.find(b"\x01" * self.run, end)
        if len(memo) > MEMO:
            memo.clear()
        return found


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared_words", pa.int32()), ("item_words", pa.int32())])


@lru_cache(2)
def _index(items: tuple[tuple[int, str], ...], run: int) -> ItemIndex:
    return ItemIndex(list(items), run)


def item_blocks(items: DataFrame, block_items: int, block_chars: int) -> list[list[tuple[int, str]]]:
    """The distinct items with a text, in blocks of bounded number and size; each block is fetched on its own.

    Only the running totals per hash bucket come to the driver before: one row per bucket, of about a block's items.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, ceil(2 * n / block_items), ceil(2 * chars / block_chars))
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [sorted((r[0], r[1]) for r in (rows if parts == 1 else rows.where(bucket == p)).collect()) for p in range(parts)] if n else []


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_items: int = BLOCK_MAX_ITEMS, block_chars: int = BLOCK_MAX_CHARS) -> DataFrame:
    """doc_id, item_id, shared_words, item_words of every document holding ``run`` or more words of an item.

    The index of a block of items goes to every worker, so a block is bounded; more items than one block holds are
    searched block by block, each over all documents, and the results are joined.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items, block_items, block_chars):
        held = spark.sparkContext.broadcast(tuple(block))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held.value, run)
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        for item, n in index.leaks(text).items():
                            for column, value in zip(out, (doc, index.ids[item], n, len(index.items[item]))):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _LEAKS)], schema=_LEAKS)

        found = slim.mapInArrow(scan, "doc_id long, item_id long, shared_words int, item_words int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, shared_words int, item_words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("shared_words").alias("shared_words"), F.max("item_words").alias("item_words"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items and documents per split and source of the items; items without a leak count in ``items``."""
    each = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max(F.col("shared_words") / F.col("item_words")).alias("coverage"))
    one = items.select("item_id", "split", "source").distinct().join(each, "item_id", "left")
    return one.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("docs").alias("leaked_items"),
        F.coalesce(F.sum("docs"), F.lit(0)).alias("leaks"),
        F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 6).alias("mean_coverage"),
    )
