"""Subject area of each document: a seeded non-negative factorisation of the document-term matrix.

Fit. A bounded sample of labelled documents (``MAX_FIT``, by hash of the id) gives a document-term matrix of words and
adjacent word pairs. It is factored into one component per subject and language and a background per language. Components are
seeded from the curators' labels, which anchor them (a zero seed stays zero), backgrounds from the languages, and
refined by alternating multiplicative updates under the generalised Kullback-Leibler divergence; wrong labels and
unlabelled subjects are absorbed by the updates.

Apply. The factor of terms is small, so it goes to every worker and all documents are read once, without a shuffle.
A term's column of the factor says which components it comes from; adjacent terms of one kind are a mention, with their
columns added. A document is folded in: with the columns fixed, the same multiplicative updates give the mixture of
components of its mentions, and then, with the document's mixture as prior, that of each sentence. A sentence is about the
largest component of its mixture, and a document's shares are those of its sentences.

Defined results
* null, empty and blank texts, and texts about no subject, have no row in ``found``;
* labels are compared in lower case with blanks trimmed and inner blanks as ``_``; unknown labels are ignored;
* repeated label rows count once; repeated documents give a row each with the same mixture;
* entities, tags, invisible characters, character forms, accents and doubly encoded UTF-8 are folded away;
* with no usable label nothing can be fitted and the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBJECTS = ("tumor_biology", "clinical_trials", "immunotherapy", "imaging", "epidemiology", "law_ethics", "software", "exercise")
#: Labelled documents the factors are fitted on, at most.
MAX_FIT = 1600
#: Terms looked at, at most; the most frequent ones always kept; share of the documents a term must be in.
MAX_TERMS, COMMON, MIN_SHARE = 20_000, 300, 0.004
#: A term seeds a subject from this many times the usual number of documents.
LIFT = 2.0
MAX_BACKGROUND, ROUNDS, FOLD_ROUNDS = 8, 20, 12
#: Mentions that the document's mixture counts as in each of its sentences.
PRIOR = 0.4
#: Share of a term's mass that one subject must have for the term to bear it.
BEARING = 0.5
#: Share of a document's subject sentences from which it is about a subject.
SHARE = 0.25
BLOCK = 512
#: Short words that link the parts of one term in the corpus languages.
LINKS = ("d", "de", "del", "des", "du", "la", "l", "of")

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_UNSEEN = re.compile("[­​-‏⁠-⁤﻿]+")
_MARKS = re.compile("[̀-ͯ]+")
_TOKENS = re.compile(r"[^\W_]+|[.!?](?=[\s\"”»')\]\[]|$)|\n[ \t\r]*\n")
_TOKENS_ASCII = re.compile(r"[a-z0-9]+|[.!?](?=[\s\"')\]\[]|$)|\n[ \t\r]*\n")


def repair(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read again; other text as it is."""
    if "Ã" in text or "Â" in text:
        out, at = [], 0
        for m in re.finditer("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}", text):
            for code in ("cp1252", "latin-1"):
                try:
                    fixed = m.group().encode(code).decode("utf-8")
                except UnicodeError:
                    continue
                out += [text[at : m.start()], fixed]
                at = m.end()
                break
        return "".join([*out, text[at:]])
    return text


def tokens(text: str) -> list[str]:
    """Folded words, with sentence ends (``.``, ``!``, ``?``, blank lines) as tokens of their own."""
    plain = text.isascii()
    if not plain:
        text = repair(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        plain = text.isascii()
    if plain:
        return _TOKENS_ASCII.findall(text.lower())
    folded = _MARKS.sub("", unicodedata.normalize("NFKD", _UNSEEN.sub("", text))).casefold()
    return _TOKENS.findall(folded)


def _is_end(token: str) -> bool:
    return not token[0].isalnum()


def sentence_words(text: str) -> list[list[str]]:
    """The folded words of each sentence."""
    out: list[list[str]] = [[]]
    for t in tokens(text):
        if _is_end(t):
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def factor(v: np.ndarray, w: np.ndarray, h: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Alternating multiplicative updates of v ~ w h under the generalised KL divergence; zeros of w and h stay."""
    tiny = 1e-9
    for _ in range(rounds):
        h *= (w.T @ (v / (w @ h + tiny))) / (w.sum(axis=0)[:, None] + tiny)
        w *= ((v / (w @ h + tiny)) @ h.T) / (h.sum(axis=1)[None, :] + tiny)
    return w, h


def fold_in(h: np.ndarray, v: np.ndarray, row: np.ndarray, prior: np.ndarray | float = 0.0, rounds: int = FOLD_ROUNDS) -> np.ndarray:
    """The mixtures of rows that were not in the fit: w of v ~ w h with h fixed, by the same multiplicative updates.

    ``h`` holds a component vector per observation (adding up to 1), ``v`` its count and ``row`` (ascending) the row it
    is in; every row has one. ``prior`` is added to each row's mass in each round. Rows of the result add up to 1.
    """
    starts = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
    own = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(row)]])))
    w = np.full((len(starts), h.shape[1]), 1.0 / h.shape[1])
    for _ in range(rounds):
        part = w[own] * h
        part *= (v / (part.sum(axis=1) + 1e-12))[:, None]
        w = np.add.reduceat(part, starts, axis=0) + prior
        w /= w.sum(axis=1, keepdims=True) + 1e-12
    return w


def _languages(v: np.ndarray, langs: list[str | None]) -> np.ndarray:
    """A background group per document: its language where that is a frequent one, corrected by the nearest centre."""
    clean = [(x or "").strip().lower() for x in langs]
    names = [x for x, n in Counter(clean).most_common(MAX_BACKGROUND) if x and n >= max(2, 0.02 * len(clean))]
    if not names:
        return np.zeros(len(langs), dtype=int)
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    group = np.array([names.index(x) if x in names else -1 for x in clean])
    for _ in range(2):
        centres = np.array([unit[group == g].mean(axis=0) if (group == g).any() else np.zeros(v.shape[1]) for g in range(len(names))])
        group = (unit @ centres.T).argmax(axis=1)
    return group


class SubjectModel:
    """Term shares per subject, from a seeded factorisation of labelled documents."""

    def __init__(self, texts: list[str], labels: list[set[str]], langs: list[str | None], subjects: tuple[str, ...] = SUBJECTS) -> None:
        self.subjects = subjects
        docs = []
        for t in texts:
            c: Counter = Counter()
            for s in sentence_words(t):
                s = [w for w in s if not w.isdigit() and w not in LINKS]
                c.update(s)
                c.update(zip(s, s[1:]))
            docs.append(c)
        df = Counter(t for c in docs for t in c)
        least = max(3, int(MIN_SHARE * len(docs)))
        kept = [t for t, n in sorted(df.items(), key=lambda x: (-x[1], str(x[0]))) if n >= least][:MAX_TERMS]
        at = {t: i for i, t in enumerate(kept)}
        v = np.zeros((len(docs), len(kept)), dtype=np.float32)
        for d, c in enumerate(docs):
            for t, n in c.items():
                if t in at:
                    v[d, at[t]] = n
        there = (v > 0).astype(np.float32)
        group = _languages(v[:, :1000], langs)
        groups = int(group.max()) + 1 if len(group) else 1
        usual = np.array([there[group == g].mean(axis=0) if (group == g).any() else np.zeros(len(kept)) for g in range(groups)])
        # one component per subject and language, as words of a subject only meet words of their own language;
        # a term seeds it if clearly more of its documents have the term than of the language at large
        k = len(subjects)
        own = np.array([[s in x for s in subjects] for x in labels], dtype=np.float32).reshape(len(docs), k)
        here = np.eye(groups, dtype=np.float32)[group]
        cell = (own[:, :, None] * here[:, None, :]).reshape(len(docs), k * groups)
        have = cell.T @ there
        expected = np.tile(usual, (k, 1)) * cell.sum(axis=0)[:, None] + 1e-6
        seeds = (have >= LIFT * expected) & (have - expected >= 3 * np.sqrt(expected)) & (have >= (3 if len(docs) > 300 else 2))
        common = np.zeros(len(kept), dtype=bool)
        common[:COMMON] = True
        use = np.flatnonzero(seeds.any(axis=0) | common)
        v, seeds, have, usual = v[:, use], seeds[:, use], have[:, use], usual[:, use]
        h = np.vstack([np.where(seeds, have, 0.0), usual + 1e-3]).astype(np.float32)
        w = ((own[:, :, None] + 0.02) * here[:, None, :]).reshape(len(docs), k * groups)
        w = np.hstack([w, here]).astype(np.float32)
        w, h = factor(v, w, h)
        mass = h * w.sum(axis=0)[:, None]
        share = mass[: k * groups].reshape(k, groups, -1).sum(axis=1) / (mass.sum(axis=0) + 1e-9)
        bears = dict(zip((kept[u] for u in use), share.T))
        total = {kept[u]: float(v[:, i].sum()) for i, u in enumerate(use)}
        # a pair bears a subject if both of its words are subject words rather than background
        topical = {t for t, x in bears.items() if isinstance(t, str) and x.sum() >= BEARING}
        pairs = {t: x for t, x in bears.items() if isinstance(t, tuple) and x.max() >= BEARING and t[0] in topical and t[1] in topical}
        # a word bears one by itself if it is mostly met outside such pairs: "apoptosis", but not "state"
        paired: Counter = Counter()
        for t in pairs:
            for x in set(t):
                paired[x] += total[t]
        alone = {t: bears[t] for t in topical if bears[t].max() >= BEARING and paired[t] < 0.5 * total[t]}
        self._pack(alone, pairs)

    def _pack(self, alone: dict[str, np.ndarray], pairs: dict[tuple[str, str], np.ndarray]) -> None:
        """Arrays for lookup: word weights, and pair codes in order with their weights."""
        k = len(self.subjects)
        self.words = {t: i for i, t in enumerate(sorted({*alone, *(x for p in pairs for x in p)}))}
        self.word_weights = np.array([alone.get(t, np.zeros(k)) for t in self.words], dtype=np.float64).reshape(-1, k)
        n = len(self.words)
        codes = sorted((self.words[x] * n + self.words[y], (x, y)) for x, y in pairs)
        self.pair_codes = np.array([c for c, _ in codes], dtype=np.int64)
        self.pair_weights = np.array([pairs[p] for _, p in codes], dtype=np.float64).reshape(-1, k)
        self.alone, self.pairs = alone, pairs

    def mixtures(self, texts: list[str | None]) -> np.ndarray:
        """Sentences per subject (rows: texts, columns: subjects)."""
        k, n = len(self.subjects), max(1, len(self.words))
        get = ({t: -3 for t in LINKS} | {".": -2, "!": -2, "?": -2} | self.words).get
        ids: list[int] = []
        sizes = []
        for t in texts:
            before = len(ids)
            if t:
                for x in tokens(t):
                    i = get(x)
                    if i is None:
                        ids.append(-2 if x[0] == "\n" else -1)
                    elif i != -3:
                        ids.append(i)
            ids.append(-2)
            sizes.append(len(ids) - before)
        a = np.array(ids, dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        weight = np.zeros((len(a), k))
        both = np.flatnonzero((a[:-1] >= 0) & (a[1:] >= 0))
        if len(self.pair_codes) and len(both):
            code = a[both] * n + a[both + 1]
            place = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            hit = self.pair_codes[place] == code
            np.add.at(weight, both[hit], self.pair_weights[place[hit]])
            np.add.at(weight, both[hit] + 1, self.pair_weights[place[hit]])
        single = np.flatnonzero((a >= 0) & (weight.sum(axis=1) == 0))
        weight[single] = self.word_weights[a[single]]
        inside = weight.sum(axis=1) > 0
        start = inside & ~np.concatenate([[False], inside[:-1]])
        if not start.any():
            return np.zeros((len(texts), k))
        mention = np.cumsum(start) - 1
        places = np.flatnonzero(start)
        bears = np.zeros((len(places), k))
        np.add.at(bears, mention[inside], weight[inside])
        bears /= bears.sum(axis=1, keepdims=True)
        # the document's mixture, then that of each of its sentences with the document's as prior; of mentions that
        # weigh the same the first counts a little more
        document = fold_in(bears, np.ones(len(places)), doc[places])
        sentence_of = np.cumsum(a == -2)[places]
        keys, first = np.unique(sentence_of, return_index=True)
        counts = np.ones(len(places))
        counts[first] += 0.01
        of = doc[places[first]]
        docs, row = np.unique(of, return_inverse=True)
        sentence = fold_in(bears, counts, sentence_of, PRIOR * document[row])
        out = np.zeros((len(texts), k))
        np.add.at(out, (of, sentence.argmax(axis=1)), 1.0)
        return out


def clean_label(c):
    """A label as it is compared."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def fit(documents: DataFrame, labels: DataFrame, subjects: tuple[str, ...] = SUBJECTS, max_fit: int = MAX_FIT) -> SubjectModel | None:
    """The model of a bounded, hash-ordered sample of labelled documents; None without a usable label."""
    own = labels.select("doc_id", clean_label(F.col("subject")).alias("subject")).where(F.col("subject").isin(*subjects) & F.col("doc_id").isNotNull())
    per_doc = own.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = texts.join(F.broadcast(per_doc), "doc_id").dropDuplicates(["doc_id"]).collect()  # per_doc has at most max_fit rows
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    return SubjectModel([r["text"] for r in rows], [set(r["subjects"]) for r in rows], [r["lang"] for r in rows], subjects)


_OUT = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("sentences", pa.int32()), ("share", pa.float64())])
_DDL = "doc_id long, subject string, sentences int, share double"


def mixtures(documents: DataFrame, model: SubjectModel | None) -> DataFrame:
    """doc_id, subject, sentences, share: the subjects of every document that is about any."""
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], _DDL)
    held = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array(m.subjects, dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts = m.mixtures(part.column(1).to_pylist())
                ids = np.array(part.column(0).to_pylist(), dtype=object)
                d, s = np.nonzero(counts)
                share = counts[d, s] / counts.sum(axis=1)[d]
                yield pa.RecordBatch.from_arrays([pa.array(ids[d].tolist(), pa.int64()), pa.array(names[s].tolist(), pa.string()), pa.array(counts[d, s].astype(np.int32)), pa.array(share)], schema=_OUT)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, _DDL)
