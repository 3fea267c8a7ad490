"""Language identification by rank-order profiles.

A profile lists a language's most frequent n-grams of one to three characters in order
of frequency. A document's own most frequent n-grams are compared with each profile:
the out-of-place distance adds up how far each n-gram's rank is from its rank in the
profile, or the length of the profile if it isn't there. The nearest profile wins.

N-grams are taken from lower-case words of letters with a mark at both ends. Equal
counts share their mean rank, so that short texts don't depend on the order of ties.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go
to the language that sorts first; rows without a language or text teach nothing; repeated
rows are predicted alike; extra columns are not read; an empty table gives an
empty table; without any profile all texts are ``und``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._scratch import ship
from loomgraph.llm._worker import lean
from loomgraph.llm.mixing import uniform

PROFILE = 600
DOCUMENT = 400
_EDGE = 1  # the mark of a word's end; 0 fills short n-grams
_SLICE = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams, each of three 21-bit characters, and the text each is from."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    if len(keep):
        keep[0] = True
    letter, owner = letter[keep], owner[keep]
    c = np.where(letter, points[keep], _EDGE)
    if len(c) and letter[0]:
        c, letter, owner = np.concatenate([[_EDGE], c]), np.concatenate([[False], letter]), np.concatenate([owner[:1], owner])
    one = c[letter]
    pairs = letter[:-1] | letter[1:]
    two = (c[:-1] | c[1:] << 21)[pairs]
    middle = letter[1:-1]
    three = (c[:-2] | c[1:-1] << 21 | c[2:] << 42)[middle]
    of_pair = np.where(letter[:-1], owner[:-1], owner[1:])[pairs]
    return np.concatenate([one, two, three]), np.concatenate([owner[letter], of_pair, owner[1:-1][middle]])


def _text_slices(column: pa.Array):
    """Runs of texts of bounded size; a longer text stands alone."""
    run, size, at = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if run and size + len(t) > _SLICE:
            yield at, run
            run, size, at = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def held_out(key: Column) -> Column:
    """Rows that teach nothing: CRC-32 of the key as text leaves 2 modulo 4. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language: n-gram codes, most frequent first. A profile has ``size`` n-grams at most, and languages are few."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for at, texts in _text_slices(b.column(0)):
                codes, owner = _grams(texts)
                own = langs[at : at + len(texts)][owner]
                for name in set(own):
                    counts.setdefault(name, []).append(np.unique(codes[own == name], return_counts=True))
            for name, parts in counts.items():
                codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                codes, where = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(np.bincount(where, n).astype(np.int64))], names=schema.names)

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(lean(run), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for name, gram in counts.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").select("lang", "gram").collect():
        profiles.setdefault(name, []).append(gram)
    return profiles


class Ranker:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.longest = max([len(p) for p in profiles.values()], default=0)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1.0)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(profiles[name], np.int64))
            self.ranks[at, k] = np.arange(1, len(at) + 1)

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        """Language and score (1: all n-grams in place; 0: none in the profile) of one text's n-grams."""
        if not len(codes) or not self.names:
            return "und", 0.0
        codes, n = np.unique(codes, return_counts=True)
        order = np.argsort(-n, kind="stable")[:DOCUMENT]
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        width = np.diff(np.append(first, len(n)))
        own = np.repeat(first + (width + 1) / 2, width)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.longest, np.minimum(np.abs(ranks - own[:, None]), self.longest))
        total = off.sum(axis=0)
        best = int(np.argmin(total))
        return self.names[best], float(1 - total[best] / (self.longest * len(codes)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        ranker = Ranker(profiles)
        for b in batches:
            names, scores = [], []
            for _, texts in _text_slices(b.column(1)):
                codes, owner = _grams(texts)
                order = np.argsort(owner, kind="stable")
                codes = codes[order]
                edges = np.searchsorted(owner[order], np.arange(len(texts) + 1)).tolist()
                for i in range(len(texts)):
                    name, score = ranker.predict(codes[edges[i] : edges[i + 1]])
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_learned: int = 4000, seed: int = 1) -> DataFrame:
    """Per row: key, held_out, lang_pred, score.

    :param max_learned: profiles are learned from about so many documents of each language at most, those of the least
        random numbers; all of them if there are fewer. Held-out rows are never learned from.
    """
    free = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    shares = [(r[0], min(1.0, max_learned / r[1])) for r in free.groupBy(F.col(lang).cast("string")).count().collect()]
    wanted = F.lit(False)
    for name, share in shares:
        wanted = wanted | ((F.col(lang) == name) & (uniform(F.col(key), seed) < share))
    profiles = learn(free.filter(wanted), text, lang)
    found = predict(docs, profiles, key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
