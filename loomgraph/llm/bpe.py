"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word there is exactly one token that ends its encoding.
A suffix automaton over the vocabulary yields, position by position, every
token that is a suffix of the prefix; the one that is kept is the one whose
pair with the last token of the shorter prefix is *compatible*, that is, merging
their joint text gives back the same two tokens. Following the stored tokens
back from the end of the word gives the exact ids, in time linear in the word
but for the number of candidate tokens, with no merge queue.

Defined results: a null text is an empty one and has no tokens; strings of
special tokens inside a text give the special ids; repeated rows, ties and
extra columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._scratch import ship
from loomgraph.llm._worker import lean

#: White space as the tokenizer's ``\\s`` has it (Unicode White_Space).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(f"[^{_SPACE}]+")
_ONLY_PYTHON_SPACE = regex.compile("[\x1c-\x1f]")
#: Bytes of the younger half of a worker's cache, which is reached before it becomes the older half; what an entry takes besides its characters.
_CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 200
_CACHE_CHUNK_CHARS = 64
_PAIRS = 150_000
#: Characters that are worked on at a time; a longer text stands alone.
_RUN = 1 << 20
_NEVER = 1 << 62


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of symbols.

    After reading a text the automaton is in the state of the longest suffix that
    occurs in a token, of size n. The tokens that are suffixes of the text are found along a
    chain, longest first: ``best`` of the state, then ``shorter`` of each token; those
    longer than n don't count.

    Most states lead to one other state, by one symbol: these two are held in flat lists (``sole``, ``target``),
    and only states with several ways have a table of their own (``ways``). Symbols are code points.
    """

    def __init__(self, tokens: dict[str, int]):
        self.ways: list[dict[int, int] | None] = [{}]
        self.link, self.length = [-1], [0]
        self._ints = list(range(1 << 10))  # one object for each state's number
        for text in tokens:
            last = 0
            for symbol in map(ord, text):
                last = self._extend(last, symbol)
        top = max(tokens.values(), default=-1) + 1
        self.wide, self.shorter = [0] * top, [-1] * top
        ends: list[list[int] | None] = [None] * len(self.link)
        for text, token in tokens.items():
            state = 0
            for symbol in map(ord, text):
                state = self.ways[state][symbol]
            ends[state] = [*(ends[state] or ()), token]
            self.wide[token] = len(text)
        self.best = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            below = self.best[self.link[state]]
            for token in sorted(ends[state] or (), key=self.wide.__getitem__):
                self.shorter[token] = below
                below = token
            self.best[state] = below
        self.sole, self.target = [-1] * len(self.link), [0] * len(self.link)
        for state, ways in enumerate(self.ways):
            if len(ways) < 2:
                self.ways[state] = None
                for self.sole[state], self.target[state] in ways.items():
                    pass
        del self._ints

    def step(self, state: int, symbol: int) -> int | None:
        ways = self.ways[state]
        if ways is not None:
            return ways.get(symbol)
        return self.target[state] if self.sole[state] == symbol else None

    def _state(self, length: int, link: int, ways: dict[int, int]) -> int:
        at = len(self.link)
        if at == len(self._ints):
            self._ints += range(at, 2 * at)
        self.link.append(link)
        self.length.append(length)
        self.ways.append(ways)
        return self._ints[at]

    def _extend(self, last: int, symbol: int) -> int:
        ways, link, length = self.ways, self.link, self.length
        q = ways[last].get(symbol)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p != -1 and symbol not in ways[p]:
            ways[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = ways[p][symbol]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, symbol, q)
        return cur

    def _clone(self, p: int, symbol: int, q: int) -> int:
        ways, link = self.ways, self.link
        twin = self._state(self.length[p] + 1, link[q], dict(ways[q]))
        link[q] = twin
        while p != -1 and ways[p].get(symbol) == q:
            ways[p][symbol] = twin
            p = link[p]
        return twin


class PrefixBpe:
    """Exact encoder and decoder for a ``tokenizers`` BPE file with a word-end suffix.

    :param path: a JSON file of the tokenizers library; its normalizer is NFC,
        white space to one space, lower case; its words are split by its own pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = _byte_alphabet()
        size = max(max(self.vocab.values()), *self.special.values(), 0) + 1
        self.names = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = t
        #: For each token the two it is merged from (-1: none) and the number of its merge.
        self.left, self.right, self.born = (array("i", [-1]) * size for _ in range(3))
        #: Number of the merge of a pair.
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left << 32 | right] = n
            if self.born[made] >= 0:
                raise ValueError(f"token {a + b!r} is made by two merges")
            self.left[made], self.right[made], self.born[made] = left, right, n
            if max(self.born[left], self.born[right]) >= n:
                raise ValueError(f"merge {n} comes before its parts")
        reachable = {t: i for t, i in self.vocab.items() if self.born[i] >= 0 or len(t.removesuffix(self.suffix) or t) == 1}
        end = "\0"  # stands for the word-end suffix: no byte is mapped to it
        self.end = end
        self.automaton = SuffixAutomaton({(t.removesuffix(self.suffix) + end if self.suffix and t.endswith(self.suffix) and t != self.suffix else t): i for t, i in reachable.items()})
        self.fits: dict[int, bool] = {}
        #: Packed ids of chunks, and those of the time before that weren't asked for again.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, _CACHE_BYTES
        self.single = [struct.pack("<I", i) for i in range(size)]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens gives the two tokens back.

        Only a merge across the border can break them. Merging is undone step by step, the latest
        merge first, so that the two tokens at the border at any time are met: each is alive from
        its own merge to the merge that swallows it. A merge of two of them breaks the pair
        if both are alive when its turn comes. Of two merges with one rank the
        one further left comes first.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        fits, rank, born, a, b, a_dies, b_dies = True, self.rank, self.born, left, right, _NEVER, _NEVER
        while True:
            turn = rank.get(a << 32 | b)
            if turn is not None and turn < a_dies and turn <= b_dies:
                fits = False
                break
            a_born, b_born = born[a], born[b]
            if b_born >= a_born:
                if b_born < 0:
                    break
                b, b_dies = self.left[b], b_born
            else:
                a, a_dies = self.right[a], a_born
        if len(self.fits) >= _PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the words (pre-tokens as mapped bytes), which are best sorted.

        What is stored for a prefix holds for all words that begin with it, so only
        the part of a word that differs from the word before is worked out.
        """
        fits, compatible = self.fits, self.compatible
        fits, compatible, found = self.fits.get, self.compatible, self.automaton
        ways, sole, target = found.ways, found.sole, found.target
        link, sizes, best, wide, shorter = found.link, found.length, found.best, found.wide, found.shorter
        states, spans, last = [0], [0], [-1]
        before_word = ""
        for word in words:
            symbols = word + self.end
            shared, most = 0, min(len(symbols), len(before_word))
            if shared < most and symbols[: most - 1] == before_word[: most - 1]:
                shared = most - 1
            while shared < most and symbols[shared] == before_word[shared]:
                shared += 1
            del states[shared + 1 :], spans[shared + 1 :], last[shared + 1 :]
            state, size, at = states[shared], spans[shared], shared
            before_word = symbols
            for symbol in map(ord, symbols[shared:]):
                at += 1
                while True:
                    around = ways[state]
                    if around is not None:
                        to = around.get(symbol)
                    else:
                        to = target[state] if sole[state] == symbol else None
                    if to is not None or not state:
                        break
                    state = link[state]
                    size = sizes[state]
                token = -1
                if to is not None:
                    state = to
                    size += 1
                    token = best[state]
                    while token >= 0:
                        length = wide[token]
                        if length <= size:
                            if length == at:
                                break
                            before = last[at - length]
                            if before >= 0:
                                known = fits(before << 32 | token)
                                if known or known is None and compatible(before, token):
                                    break
                        token = shorter[token]
                states.append(state)
                spans.append(size)
                last.append(token)
            ids = []
            while at:
                token = last[at]
                if token < 0:
                    raise ValueError(f"no encoding for {word!r}")
                ids.append(token)
                at -= wide[token]
            ids.reverse()
            yield ids

    def _words_of(self, chunk: str) -> list[str]:
        """The pre-tokens of a normalised chunk; the plain cases need no pattern."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[-1] in ".," and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def prepare(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of chunks without white space; each distinct word is encoded once."""
        made, cache, older = {}, self.cache, self.older
        missing = []
        for chunk in chunks:
            hit = cache.get(chunk)
            if hit is None:
                hit = older.get(chunk)
                if hit is None:
                    missing.append(chunk)
                    continue
                cache[chunk] = hit
                self.held += _ENTRY_BYTES + len(chunk)
            made[chunk] = hit
        plain = [c.lower() if c.isascii() else self.normalizer.normalize_str(c) for c in missing]
        split = [self._words_of(c) for c in plain]
        words = {w for parts in split for w in parts}
        mapped = {w if w.isascii() and w.isalnum() else w.encode("utf-8").decode("latin-1").translate(self.bytes): w for w in words}
        order, single = sorted(mapped), self.single
        known = {mapped[m]: single[ids[0]] if len(ids) == 1 else struct.pack(f"<{len(ids)}I", *ids) for m, ids in zip(order, self.encode_words(order))}
        fresh = {c: known[parts[0]] if len(parts) == 1 else b"".join([known[w] for w in parts]) for c, parts in zip(missing, split)}
        made |= fresh
        if max(map(len, missing), default=0) > _CACHE_CHUNK_CHARS:
            fresh = {c: hit for c, hit in fresh.items() if len(c) <= _CACHE_CHUNK_CHARS}
        cache |= fresh
        self.held += _ENTRY_BYTES * len(fresh) + sum(map(len, fresh))
        if self.held > self.cache_bytes:  # what was used lately stays one more turn
            self.cache, self.older, self.held = {}, cache, 0
        return made

    def _pieces(self, text: str) -> list[str]:
        """The text's chunks, and special tokens as pieces of their own, after a space."""
        if any(x in text for x in self.special):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [*self._chunks(text[at : m.start()]), " " + m[0]]
                at = m.end()
            return out + self._chunks(text[at:])
        return self._chunks(text)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return _CHUNK.findall(text) if _ONLY_PYTHON_SPACE.search(text) else text.split()

    def packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        pieces, size = [], 0
        for text in texts:  # runs of bounded size; a longer text ends one
            pieces.append(self._pieces(text or ""))
            size += len(text or "")
            if size > _RUN:
                yield from self._packed(pieces)
                pieces, size = [], 0
        yield from self._packed(pieces)

    def _packed(self, pieces: list[list[str]]) -> Iterator[bytes]:
        ready = self.prepare({c for p in pieces for c in p if c[0] != " "})
        for content, i in self.special.items():  # no chunk begins with a space
            ready[" " + content] = self.single[i]
        for p in pieces:
            yield b"".join([ready[c] for c in p])

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text."""
        for packed in self.packed(texts):
            ids = np.frombuffer(packed, "<u4")
            decoded = hashlib.sha256()
            for at in range(0, len(ids), _RUN):
                decoded.update(((" " if at else "") + self.decode(ids[at : at + _RUN].tolist())).encode())
            yield len(ids), hashlib.sha256(packed).hexdigest(), decoded.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.packed([text])), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a space: the file names no decoder."""
        return " ".join([self.names[i] for i in ids])


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


_CODERS: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    """One coder for each worker process."""
    if path not in _CODERS:
        _CODERS[path] = PrefixBpe(path)
        gc.freeze()  # the automaton needs no look from the garbage collector
    return _CODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text`` as an array column ``out``."""
    ship(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = schema.names[:-1]

    def run(batches):
        bpe = coder(path)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype("int32") for x in bpe.packed(t.as_py() for t in b.column(text))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
            flat = np.concatenate(ids) if ids else np.zeros(0, "int32")
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made], names=[*names, out])

    return docs.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of ``ids`` as a column ``out``; null ids give an empty text."""
    ship(encoded.sparkSession)
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    names = schema.names[:-1]

    def run(batches):
        bpe = coder(path)
        for b in batches:
            made = pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made], names=[*names, out])

    return encoded.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache_bytes: int = _CACHE_BYTES) -> DataFrame:
    """Per row: ``key``, n_tokens, ids_sha256, decoded_sha256; ids and texts never leave the worker.

    One pass without a shuffle; memory is bounded by a batch and a cache of chunks.

    :param cache_bytes: half of the cache of a worker; with less, more words are encoded again.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = coder(path)
        bpe.cache_bytes = cache_bytes
        for b in batches:
            done = list(bpe.digests(t.as_py() for t in b.column(1)))
            n, a, d = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)
