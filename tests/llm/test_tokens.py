"""BPE and token counts against the libraries."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import bpe, token_counts
from odd import ODD, ROWS

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def samples(n=1500):
    r = random.Random(4)
    return [t or "" for t in ODD] + ["".join(r.choice("aeiothrns'.!1 \té́日<|>-ß") for _ in range(r.randrange(60))) for _ in range(n)] + ["a<|startoftext|>b <|endoftext|>", "x\x1cy", "İI ΣΑΣ", "ﬁ½①"]


def test_bpe_is_exact(library):
    mine = bpe.PrefixBpe(WORDS)
    for t in samples():
        want = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_compatible_pairs():
    """The border test against merging the joint symbols one merge at a time."""
    mine = bpe.PrefixBpe(WORDS)
    r = random.Random(5)
    made = [i for i, n in enumerate(mine.born) if n >= 0]

    def spell(token):
        return [token] if mine.born[token] < 0 else spell(mine.left[token]) + spell(mine.right[token])

    def merge(symbols):
        while True:
            ranks = [(mine.rank.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            rank, i = min(ranks, default=(1 << 60, 0))
            if rank == 1 << 60:
                return symbols
            symbols = symbols[:i] + [mine.vocab[mine.names[symbols[i]] + mine.names[symbols[i + 1]]]] + symbols[i + 2 :]

    for _ in range(4000):
        a, b = r.choice(made[:20000]), r.choice(made[:20000])
        if not mine.names[a].endswith("</w>"):
            assert mine.compatible(a, b) == (merge(spell(a) + spell(b)) == [a, b])


def test_suffix_automaton():
    tokens = {"a": 1, "ab": 2, "bab": 3, "abab": 4, "b": 5}
    s = bpe.SuffixAutomaton(tokens)
    for text in ("abababb", "bbaab", "xabab"):
        state = size = 0
        for at, c in enumerate(text):
            while state and s.step(state, ord(c)) is None:
                state = s.link[state]
                size = s.length[state]
            to = s.step(state, ord(c))
            state, size = (0, 0) if to is None else (to, size + 1)
            found, token = [], s.best[state]
            while token >= 0:
                found += [token] if s.wide[token] <= size else []
                token = s.shorter[token]
            assert found == sorted((i for t, i in tokens.items() if text[: at + 1].endswith(t)), key=lambda i: -s.wide[i])


_MEMORY = """
import random, sys
sys.path.insert(0, {root!r})
from loomgraph.llm import bpe
import public_tokenizers
r = random.Random(3)
coder = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
coder.cache_bytes = 16 << 20
for _ in range(40):
    words = ["".join(r.choice("etaoinshrdlucm") for _ in range(r.randrange(4, 12))) for _ in range(10_000)]
    assert sum(n for n, *_ in coder.digests([" ".join(words[k : k + 500]) for k in range(0, 10_000, 500)])) > 10_000
held = lambda c: sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in c.items()) + sys.getsizeof(c)
peak = int(open("/proc/self/status").read().split("VmHWM:")[1].split()[0]) // 1024  # ru_maxrss would count the parent's
print(peak, held(coder.cache) >> 20, held(coder.older) >> 20, len(coder.fits))
"""


def test_memory_is_bounded():
    """A worker with the pipeline's cache that has seen 400,000 distinct words."""
    code = _MEMORY.format(root=str(Path(__file__).resolve().parents[2]))
    peak, young, old, pairs = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert max(young, old) <= 1.5 * 16 + 4
    assert pairs <= bpe._PAIRS
    assert peak < 190  # reading the file included


def test_bpe_query_shape(docs_of, library):
    docs = docs_of(ROWS)
    rows = bpe.digests(docs, WORDS).collect()
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
    coded = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    assert {r["decoded"] for r in coded.filter("doc_id = 4").collect()} == {"a</w> b</w> c</w> d</w>"}
    assert bpe.digests(docs.limit(0), WORDS).count() == 0


def test_token_counts(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = token_counts.PieceCounter(PIECES)
    for t in [*samples(), "  a   b ", "▁", "▁▁x ▁", "<s> </s><unk>", "a\n\nb"]:
        assert mine.count(t) == len(library.encode(t))
    rows = token_counts.count_tokens(docs_of(ROWS), PIECES, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in ROWS]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs_of(ROWS).limit(0), PIECES).count() == 0


def test_token_counts_beyond_the_head(docs_of, monkeypatch):
    """Most pre-tokens are counted after the shuffle, long ones have digests, and batches are handed on in parts."""
    monkeypatch.setattr(token_counts, "_BATCH_ROWS", 50)
    monkeypatch.setattr(token_counts, "_AT_ONCE", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = ["y" * 64, "y" * 63, "z" * 65, "é" * 90 + "a", hashlib.sha256(("▁" + "z" * 65).encode()).hexdigest()]
    texts = [*samples(200), *long, *long, " ".join(long * 3), "▁▁" + "▁".join(long)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, t) for t in long] + [(None, None)]
    want = sorted(str((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100)) for i, t in rows)
    for head in (0, 3):
        got = token_counts.count_tokens(docs_of(rows), PIECES, limit=100, head=head, summary=8)
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_frequent(docs_of):
    """Whatever has more than two in ``summary`` of all pre-tokens is found, with its pieces."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 5000)}" for _ in range(100))) for i in range(300)] + ROWS
    tally = Counter(p for _, t in rows for p in token_counts.pre_tokens(t))
    for head, summary in ((1000, 40), (40, 40), (100_000, 10_000)):
        got = {r["pre"]: r["pieces"] for r in token_counts.frequent(docs_of(rows).select("text"), PIECES, head, summary).collect()}
        must = {token_counts.key_of(p) for p, n in tally.items() if n * summary > 2 * sum(tally.values())}
        assert must
        assert must <= set(got) and len(got) <= head
        want = {token_counts.key_of(p): len(library.encode(p[1:])) or 1 for p in tally}
        assert all(want[p] == n for p, n in got.items())
    assert set(got) == set(want)


def test_counted_once(spark):
    """Entries of one pre-token, over several Arrow batches, have the same count."""
    rows = [(i, f"▁word{i % 7}" if i % 8 else "0" * 64, i % 3 + 1, None if i % 8 else 9) for i in range(100)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = token_counts.counted_once(spark.createDataFrame(rows, "row long, pre string, n long, pieces long"), PIECES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(i, n * (k or len(library.encode(p[1:])))) for i, p, n, k in rows]
