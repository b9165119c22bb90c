"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

Texts are split by the vocabulary's pattern. The distinct words of a chunk of texts, sorted as bytes, are
a trie in depth-first order: the stack holds one state for each prefix on the path to the current word,
and words below a shared prefix reuse it. The state of a prefix is the last token of its encoding. It is
the one token that ends the prefix such that it and the last token of what comes before stay apart when
merged, so a word's encoding is read off backwards along its path.

Two tokens stay apart if no merge ever crosses their border: on the left side, the symbol at the border
grows by merges of rising rank, as it does on the right, and a crossing merge happens if its rank comes
before the next merge of either side (of equal ranks, the leftmost is first). This needs a vocabulary
where each token's own encoding is itself, and a merge's rank is above those of its parts.

Which tokens end a prefix comes from an automaton over all tokens, whose state is part of the prefix's state.
A chunk has at most CHUNK characters (or one text); encodings of words are kept between chunks, at most
CACHE of them. Nothing depends on how texts are dealt out.

Defined results: null and empty texts have no ids; the added special token is one id wherever its string
stands; a lone id list that isn't UTF-8 decodes with replacement characters; repeated rows are encoded each.
A vocabulary file of another kind raises ValueError.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Fixed value: the pattern that splits text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 500_000
CACHE = 250_000
#: Pairs of tokens whose outcome is kept, at most.
PAIRS = 300_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """Raise ValueError unless a file is of the one kind that is encoded here: byte-level BPE behind PATTERN (which such files name by use_regex), without normalising."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    odd += [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or odd:
        raise ValueError(f"the vocabulary isn't plain byte-level BPE{': ' + ', '.join(odd) if odd else ''}")


class Vocabulary:
    """Tokens, merges and border chains of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        of = byte_alphabet()
        self.ids = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank: dict[int, int] = {}  # of a pair, as left * size + right
        self.size = size
        split = [None] * size
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(of[c] for c in left), bytes(of[c] for c in right)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[i * size + j] = r
            split[k] = (i, j, r)
        # chains: the symbols that stand at a token's edge in turn, each with the rank that ends it
        self.right = [None] * size
        self.left = [None] * size
        self.split = split
        self._automaton()
        self.apart: dict[int, bool] = {}

    def _automaton(self) -> None:
        """States are the prefixes of tokens. A state's token is its longest ending that is one; shorter ones follow by `shorter`."""
        step: dict[int, int] = {}  # (state << 8 | byte) to state
        depth, token = [0], [-1]
        for t, i in self.ids.items():
            s = 0
            for b in t:
                n = step.get(s << 8 | b)
                if n is None:
                    n = step[s << 8 | b] = len(depth)
                    depth.append(depth[s] + 1)
                    token.append(-1)
                s = n
            token[s] = i
        fail, shorter = [0] * len(depth), [0] * len(depth)
        for key, n in sorted(step.items(), key=lambda x: depth[x[1]]):
            s, b = key >> 8, key & 255
            if s:
                f = fail[s]
                while f and f << 8 | b not in step:
                    f = fail[f]
                f = step.get(f << 8 | b, 0)
                fail[n] = f
                shorter[n] = f if token[f] >= 0 else shorter[f]
        self.step, self.fail, self.shorter, self.depth, self.token = step, fail, shorter, depth, token

    def _chain(self, token: int, side: int) -> list[tuple[int, int]]:
        out, end = [], NEVER
        while True:
            out.append((token, end))
            if self.split[token] is None:
                return out[::-1]
            end = self.split[token][2]
            token = self.split[token][side]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes together is just a, b."""
        known = self.apart.get(a * self.size + b)
        if known is not None:
            return known
        x = self.right[a]
        if x is None:
            x = self.right[a] = self._chain(a, 1)
        y = self.left[b]
        if y is None:
            y = self.left[b] = self._chain(b, 0)
        i = j = 0
        ok = True
        rank, size = self.rank, self.size
        while True:
            s, s_end = x[i]
            t, t_end = y[j]
            r = rank.get(s * size + t)
            if r is not None and r < s_end and r <= t_end:
                ok = False
                break
            if s_end == NEVER and t_end == NEVER:
                break
            if s_end <= t_end:
                i += 1
            else:
                j += 1
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[a * self.size + b] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in depth-first order of the trie of all words."""
        step, fail, shorter, depth, tokens = self.step.get, self.fail, self.shorter, self.depth, self.token
        known, apart, n_ids = self.apart.get, self.stay_apart, self.size
        states = [0]  # of each prefix on the path, the automaton's state,
        last: list[int] = []  # the last token,
        size: list[int] = []  # and its length
        before = b""
        for word in sorted(words):
            shared = 0
            for p, q in zip(before, word):
                if p != q:
                    break
                shared += 1
            del states[shared + 1 :], last[shared:], size[shared:]
            s = states[-1]
            for end in range(shared, len(word)):
                b = word[end]
                while (n := step(s << 8 | b)) is None and s:
                    s = fail[s]
                s = n or 0
                states.append(s)
                c = s if tokens[s] >= 0 else shorter[s]
                while c:
                    token, start = tokens[c], end + 1 - depth[c]
                    if not start:
                        break
                    ok = known(last[start - 1] * n_ids + token)
                    if apart(last[start - 1], token) if ok is None else ok:
                        break
                    c = shorter[c]
                else:
                    raise ValueError("no token fits: the vocabulary lacks a byte, or a token doesn't encode to itself")
                last.append(token)
                size.append(depth[c])
            at, out = len(word), []
            while at:
                out.append(last[at - 1])
                at -= size[at - 1]
            yield word, out[::-1]
            before = word


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        names = [s for s in self.vocabulary.special if s]
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + ")") if names else None

    def _pieces(self, text: str) -> list:
        """The words of a text; special tokens as numbers."""
        if self.mark is None or not self.mark.search(text):
            return self.words(text)
        out: list = []
        for i, part in enumerate(self.mark.split(text)):
            out += [self.vocabulary.special[part]] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        pieces = [self._pieces(t) for t in texts]
        new = set().union(*pieces) - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*pieces)
        special = {w for w in new if isinstance(w, int)}
        for w in special:
            self.known[w] = w.to_bytes(4, "little")
        for word, ids in self.vocabulary.encode_words([w.encode() for w in new - special]):
            self.known[word.decode()] = pack(f"<{len(ids)}I", *ids)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        if chunk and n + len(t) > CHUNK:
            yield chunk
            chunk, n = [], 0
        chunk.append(t)
        n += len(t)
    if chunk:
        yield chunk


def _encoder(path: str) -> Encoder:
    """A worker process's encoder for a file; it stays, with the words it knows, for the worker's later tasks."""
    kept = sys.modules.setdefault("_helixmark_kept", types.ModuleType("_helixmark_kept")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _part(encoder: Encoder, b: pa.RecordBatch, both: bool) -> pa.RecordBatch:
    texts = [t or "" for t in b.column(1).to_pylist()]
    ids = [x for c in _chunks(texts) for x in encoder.encode(c)]
    columns = [b.column(0), pa.array(ids, pa.binary())]
    if both:
        columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids), and with `decoded` the text that the ids decode to.

    ids is binary, little-endian unsigned 32-bit numbers. path: the vocabulary file, on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield _part(encoder, b.slice(at, 256), decoded)

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [encoder.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
