"""Byte-level BPE encoding of a corpus with a public rank file, in batched numpy rounds.

Texts are split into words by the vocabulary's pattern. The distinct new words of a block go into length-bucketed
padded matrices of byte ids. Each round looks up every adjacent pair in an open-addressing hash table, merges the
leftmost pair of least rank in every row, moves the rest of the row one place left and drops finished rows. Words
seen before come from a bounded per-worker memo.

Defined results
* null, empty texts: ``[]``; a blank text is encoded like any other;
* strings of special tokens in a text are ordinary text, no special tokens are added;
* one row per input row, so repeated rows stay; extra columns are dropped;
* texts of any length are encoded whole; words above ``LONG`` bytes merge all places of the least pair per round,
  which gives the same ids.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes above which a word is encoded on its own; entries kept in the memo; texts per block.
LONG, MEMO, BLOCK = 256, 400_000, 1024
_NONE = np.int32(2**31 - 1)


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public rank file."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge (which is also its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << int(np.ceil(np.log2(max(16, 4 * len(left)))))
        self.mask = np.int64(size - 1)
        self.shift = np.int64(20)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, _NONE, dtype=np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            winners = todo[free][first]
            self.keys[slots], self.values[slots] = key[winners], merged[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> self.shift) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``_NONE`` where a pair does not merge."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class BytePairEncoder:
    """Encoder of one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*(np.array(c, dtype=np.int32) for c in zip(*pairs)))
        self.ranks = ranks
        self.memo: dict[str, list[int]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by length-bucketed matrices."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = [whole]
            elif len(b) > LONG:
                out[i] = self._long(b)
            else:
                buckets.setdefault(len(b) if len(b) <= 12 else -(-len(b) // 8) * 8, []).append(i)
        for width, rows in buckets.items():
            matrix = np.full((len(rows), width), -1, dtype=np.int32)
            sizes = np.array([len(raw[i]) for i in rows])
            flat = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.uint8)]
            matrix[np.arange(width)[None, :] < sizes[:, None]] = flat
            for i, ids in zip(rows, self._merge(matrix, sizes)):
                out[i] = ids
        return out

    def _merge(self, a: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        done: list[list[int]] = [[]] * len(a)
        live = np.arange(len(a))
        cols = np.arange(a.shape[1])
        while len(live):
            rank = self.table.get(a[:, :-1].ravel(), a[:, 1:].ravel()).reshape(len(a), -1) if a.shape[1] > 1 else np.full((len(a), 1), _NONE, dtype=np.int32)
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(a)), at]
            over = best == _NONE
            if over.any():
                for r in np.flatnonzero(over):
                    done[live[r]] = a[r, : sizes[r]].tolist()
                keep = ~over
                a, live, sizes, at, best = a[keep], live[keep], sizes[keep], at[keep], best[keep]
                if not len(live):
                    break
            shifted = np.concatenate([a[:, 1:], np.full((len(a), 1), -1, dtype=np.int32)], axis=1)
            a = np.where(cols[None, : a.shape[1]] > at[:, None], shifted, a)
            a[np.arange(len(a)), at] = best
            sizes = sizes - 1
            a = a[:, : max(1, int(sizes.max()))]
        return done

    def _long(self, word: bytes) -> list[int]:
        a = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        while len(a) > 1:
            rank = self.table.get(a[:-1], a[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            # of overlapping places (as in a run of equal ids) every second one counts, from the left of each run
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            first = at[np.concatenate([[True], np.diff(at) > 1])]
            at = at[(at - first[run]) % 2 == 0]
            a = a.copy()
            a[at] = best
            a = np.delete(a, at + 1)
        return a.tolist()

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts)."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        split = [_words(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in memo]
        if new:
            memo.update(zip(new, self.encode_words(new)))
        get = memo.__getitem__
        ids: list[int] = []
        offsets = [0]
        for words in split:
            ids.extend(chain.from_iterable(map(get, words)))
            offsets.append(len(ids))
        return np.array(ids, dtype=np.int32), np.array(offsets, dtype=np.int32)


# The vocabulary's split pattern. ASCII texts take the same pattern with its classes written out, which ``re`` runs faster.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WHITE = r"\t-\r \x85\xa0  -     　"
_UNICODE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


@lru_cache(1)
def _unicode_pattern():
    import regex

    return regex.compile(_UNICODE)


def _words(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() else _unicode_pattern().findall(text)


@lru_cache(2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a rank file, one per Python worker."""
    return BytePairEncoder(path)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ids: one Arrow pass, no shuffle.

    ``vocabulary`` (or the setting ``spark.passagemill.vocabulary``) is the path of a rank file on the driver; it is shipped
    with the job, so workers need no copy of their own.
    """
    spark = documents.sparkSession
    path = vocabulary or spark.conf.get("spark.passagemill.vocabulary", None) or default_vocabulary()
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    id_type = documents.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, offsets = bpe.encode_block(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>")
