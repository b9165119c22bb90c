"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test questions and answers.

Texts are normalised in bytes: A-Z become small, and words are runs of digits, letters a-z and anything
outside ASCII. A window is `WINDOW` consecutive words of an item's text; a text of fewer words, but not none, is
one window. Each distinct word of the items is one symbol, all other words share another, so a document is a
string with a symbol for each word, which the automaton reads once: it finds every occurrence of
every window, overlapping ones too. Only for documents with hits, places of words are mapped back
to the original: spans are code points of the text as given, end exclusive.

The automaton is built in each worker from the items' words, which are broadcast: at most `WORDS_PER_PASS` words.
Items beyond that are dealt into further passes, each with an automaton of its own, whose hits are added
to those of the passes before; long items are cut into pieces that overlap by a window less a word. Documents are never
shuffled, and a document is read whole, once a pass.

Defined results: null and empty texts have no words and no hits; items without words never occur; a null item_id is
written as the empty string; items that share an item_id are one item; windows that several items share count for each of them;
repeated rows and equal doc_ids are documents of their own; empty tables give empty results, or documents without hits; input
columns with the name of an output give way to it.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running
from .common import bounded_batches, discard, materialise

WINDOW = 10
#: Words of a piece of an item, besides the overlap.
PIECE = 1_000
#: Words of one automaton; it takes some 700 bytes for each.
WORDS_PER_PASS = 400_000
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_OUTPUT = "n_words bigint, ranges array<int>, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_FOLD).split()


def symbol(n: int) -> str:
    """A character for the n-th word; 0 is kept for words that no item has, and surrogates are left out."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)


class Matcher:
    """The automaton over the windows of (item, words of a piece)."""

    def __init__(self, pieces: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, piece in pieces:
            text = "".join([self.symbols.setdefault(w, symbol(len(self.symbols))) for w in piece.split()])
            for at in range(max(1, len(text) - window + 1)):
                windows.setdefault(text[at : at + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        self.items = [sorted(v) for v in windows.values()]
        for n, w in enumerate(windows):
            self.automaton.add_word(w, (len(w), n))
        if windows:
            self.automaton.make_automaton()
        self.ones = bytes([1]) * window

    def scan(self, text: bytes, ranges: list[int] = (), items: Iterable[str] = ()) -> tuple[int, list[int], list[dict], list[str]]:
        """Number of words, ranges of hit words (from, to, ...; to exclusive), their spans, and the sorted items; with those of earlier passes."""
        words = words_of(text)
        found: set[int] = set()
        if self.items:
            line = "".join([self.symbols.get(w, "\0") for w in words])
            marks = bytearray(len(words))
            for end, (size, n) in self.automaton.iter(line):
                marks[end + 1 - size : end + 1] = self.ones[:size]
                found.add(n)
        if not found:
            return len(words), list(ranges), self.spans(text, ranges), list(items)
        for a, b in zip(ranges[::2], ranges[1::2]):
            marks[a:b] = b"\1" * (b - a)
        change = np.flatnonzero(np.diff(np.frombuffer(marks, np.int8), prepend=0, append=0))
        return len(words), change.tolist(), self.spans(text, change), sorted(set(items).union(*[self.items[n] for n in found]))

    @staticmethod
    def spans(text: bytes, ranges) -> list[dict]:
        """Code points, from and to, of ranges of words."""
        if not len(ranges):
            return []
        raw = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(_IN_WORD[raw].astype(np.int8), prepend=0, append=0))
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        r = np.asarray(ranges)
        return [{"start": a, "end": b} for a, b in zip(places[edges[2 * r[::2]]].tolist(), places[edges[2 * r[1::2] - 1]].tolist())]


def pieces(items: DataFrame, columns: tuple[str, ...] = ("text",), window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item, piece, n) of items (item_id and text columns, such as questions and answers): words in order, and their number, by pieces that overlap so that each window lies within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, *texts in zip(*[c.to_pylist() for c in b.columns]):
                for words in map(words_of, [t for t in texts if t]):
                    for at in range(0, max(len(words) - window + 1, min(len(words), 1)), piece):
                        part = words[at : at + piece + window - 1]
                        out.append((item or "", b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["item", "piece", "n"])

    bounded_batches(items.sparkSession)
    return items.select(F.col("item_id").cast("string"), *[F.col(f"`{c}`").cast("string").cast("binary") for c in columns]).mapInArrow(run, "item string, piece binary, n bigint").distinct()


def _kept(key: str, make):
    """A worker process's object for a key; the one of the key before goes."""
    kept = sys.modules.setdefault("_helixmark_matcher", types.ModuleType("_helixmark_matcher")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def _pass(docs: DataFrame, chosen: list[tuple[str, bytes]], window: int) -> DataFrame:
    """docs (given columns, __hx_text, outputs of earlier passes) with the hits of some pieces added."""
    told, key = docs.sparkSession.sparkContext.broadcast(chosen), uuid.uuid4().hex
    schema = T.StructType.fromDDL(_OUTPUT)
    names = [f"__hx_{f.name}" for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _kept(key, lambda: Matcher(told.value, window))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
        for b in batches:
            at = b.schema.names.index("__hx_text")
            had = zip(*[b.column(b.schema.names.index(n)).to_pylist() for n in (names[1], names[3])])
            found = [matcher.scan(t or b"", ranges or [], items or []) for t, (ranges, items) in zip(b.column(at).to_pylist(), had)]
            columns = [b.column(k) for k in range(b.num_columns) if b.schema.names[k] not in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)]], [n for n in b.schema.names if n not in names] + names)

    own = [f for f in docs.schema if f.name not in names]
    return docs.mapInArrow(run, T.StructType([*own, *[T.StructField(n, f.dataType) for n, f in zip(names, schema)]]))


def scan(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("text",), window: int = WINDOW, words_per_pass: int = WORDS_PER_PASS, keep_text: bool = False) -> DataFrame:
    """docs, without the text unless kept, with n_words, n_hit, items (sorted ids) and spans (start, end in code points of the text)."""
    outputs = ("n_words", "n_hit", "items", "spans")
    given = [c for c in docs.columns if c.lower() not in outputs and (keep_text or c.lower() != "text")]
    bounded_batches(docs.sparkSession)
    rows = materialise(pieces(items, columns, window), "leak-pieces", few=True)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-total // words_per_pass))
    if passes > 1:
        dealt = materialise(running(rows, ["item", "piece"], {"before": F.col("n")}).withColumn("pass", F.floor(F.col("before") / words_per_pass)), "leak-passes", few=True)
        chosen = [dealt.where(F.col("pass") == k) for k in range(passes)]
    else:
        chosen = [rows]
    df = docs.select(*[F.col(f"`{c}`") for c in given], F.col("text").cast("binary").alias("__hx_text"), *[F.lit(None).cast(f.dataType).alias(f"__hx_{f.name}") for f in T.StructType.fromDDL(_OUTPUT)])
    for k, part in enumerate(chosen):
        before = df
        df = _pass(df, [(r["item"], bytes(r["piece"])) for r in part.select("item", "piece").collect()], window)  # at most words_per_pass words, and a piece
        if k + 1 < len(chosen):
            df = materialise(df, "leak-hits")  # so that one automaton at a time is in memory
            discard(before)
    n_hit = F.expr("aggregate(transform(__hx_ranges, (x, i) -> CASE WHEN i % 2 = 1 THEN x ELSE -x END), 0L, (a, x) -> a + x)")
    return df.select(*[F.col(f"`{c}`") for c in given], F.col("__hx_n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("__hx_items").alias("items"), F.col("__hx_spans").alias("spans"))


def decontaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, **options) -> DataFrame:
    """docs of which at most that share of words is hit (none, unless given), with their own columns."""
    clash = {c: f"__hx_own_{c}" for c in docs.columns if c.lower() in ("n_words", "n_hit", "items", "spans")}
    out = scan(docs.withColumnsRenamed(clash), items, keep_text=True, **options).where(F.col("n_hit") <= most * F.col("n_words"))
    return out.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
