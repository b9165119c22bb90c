"""Ranked lexical search over a two-level quantised index.

The index is a table with a row for each block of documents: its terms, and for each term its postings, as (document,
byte, tf). The byte is the posting's impact (saturated frequency, from 0 to 1,000,000), rounded up to 255
steps: the first level. tf and the document's length are the second. A search adds up the bytes of a query's terms for all documents of a block, which
gives an upper bound of each score, and a lower one (a byte less a step). Every document whose upper
bound reaches the k-th greatest lower bound, or the k-th score found so far in the task, is rescored exactly in 64-bit integers.
A task ends with the k best of each query; these few rows are ranked over all tasks. Postings are never shuffled.

A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's length factor m is 25 + (75 * n * N) div L,
its score the sum of weight * ((10**9 * tf) div (1000 * tf + 8 * m)) over the query's terms, repeats included.

Blocks have at most `BLOCK_DOCS` documents and, but for a longer single text, `BLOCK_WORDS` terms, whatever the table's size. Queries
are broadcast, at most `TERMS_PER_PASS` distinct terms of all items; more are dealt into passes over the written index.

Defined results: null and empty texts, and those without terms, are never found and don't count in N; items without
terms have no rows; repeated rows are documents (or items) of their own, ranked one after another; of equal scores the lesser doc_id
comes first, null last; empty tables give no rows; other input columns don't matter.
"""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running
from .common import bounded_batches, discard, materialise
from .decontamination import words_of

K = 10
BLOCK_DOCS, BLOCK_WORDS = 4_096, 1_000_000
TERMS_PER_PASS = 500_000
STEPS, TOP = 255, 1_000_000
#: A posting's document is a number of 16 bits in its block.
DOC_BITS = 16
#: Of each byte: the greatest impact that it stands for, and the least.
UPPER = np.arange(STEPS + 1, dtype=np.int64) * TOP // STEPS
LOWER = np.concatenate([[0], UPPER[:-1] + 1])


@dataclass
class Index:
    """The written blocks, number of documents with terms, and number of all terms."""

    blocks: DataFrame
    n: int
    length: int


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturated frequency of postings, in integers."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def to_bytes(x: np.ndarray) -> np.ndarray:
    """Impacts in steps, rounded up."""
    return (-(-x * STEPS // TOP)).astype(np.uint8)


def _width(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the greatest of them needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


class _Block:
    """Documents of a block under construction."""

    def __init__(self):
        self.docs: list = []
        self.sizes: list[int] = []
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.words: list[np.ndarray] = []

    def add(self, doc, words: list[bytes]) -> None:
        self.docs.append(doc)
        self.sizes.append(len(words))
        self.words.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))

    def row(self, n_docs: int, length: int) -> tuple:
        keys = np.concatenate(self.words)
        keys = (keys << DOC_BITS) + np.repeat(np.arange(len(self.docs)), self.sizes)
        keys, tf = np.unique(keys, return_counts=True)  # by term, then by document
        m = np.array([25 + 75 * n * n_docs // length for n in self.sizes], np.int64)
        term, doc = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1)
        offsets = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        values = to_bytes(impact(tf, m[doc]))
        return self.docs, m.tobytes(), list(self.vocabulary), offsets.tobytes(), doc.astype("<u2").tobytes(), values.tobytes(), _width(tf).tobytes()


def index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> Index:
    """The index of all of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words_of(t or b"")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "length"])

    texts = docs.select(F.col("text").cast("binary"))
    n_docs, length = texts.mapInArrow(counted, "n bigint, length bigint").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "length")]).first()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("docs", T.ArrayType(kind)), *T.StructType.fromDDL("m binary, terms array<binary>, offsets binary, doc binary, bytes binary, tf binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, of_docs = _Block(), 0, None

        def written() -> pa.RecordBatch:
            row = block.row(n_docs, length)
            kinds = [pa.list_(of_docs), pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], schema.names)

        for b in batches:
            of_docs = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text or b"")
                if not words:
                    continue
                if block.docs and (len(block.docs) == block_docs or size + len(words) > block_words):
                    yield written()
                    block, size = _Block(), 0
                block.add(doc, words)
                size += len(words)
        if block.docs:
            yield written()

    blocks = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
    return Index(materialise(blocks, "lexical-index"), n_docs, length)


def _questions(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts, n) of items with any term; terms are distinct."""
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("terms array<binary>, counts array<int>, n bigint, digest string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [Counter(words_of(t or b"")) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())), pa.array([len(c) for c in counted], pa.int64()), b.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pc.greater(columns[3], 0))

    return items.select("item_id", F.col("text").cast("binary"), F.sha2("text", 256)).mapInArrow(run, schema)


class Queries:
    """Items of a pass: for each the places of its terms among all terms, and weights."""

    def __init__(self, terms: list[bytes], rows: list[tuple[list[int], list[int]]]):
        self.terms, self.rows = pa.array(terms, pa.binary()), rows

    def met(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's terms: the queries' terms among them (their numbers), and where they stand in the block."""
        at = pc.index_in(terms, value_set=self.terms)
        here = np.flatnonzero(np.asarray(at.is_valid()))
        return at.drop_null().to_numpy(zero_copy_only=False), here


class Best:
    """The k best documents of each query, over the blocks of a task."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.found: list[list[tuple]] = [[] for _ in queries.rows]  # (-score, no doc_id, doc_id)
        self.rescored = 0

    def add(self, block: dict) -> None:
        m = np.frombuffer(block["m"], np.int64)
        offsets = np.frombuffer(block["offsets"], np.int64)
        doc, level = np.frombuffer(block["doc"], "<u2"), np.frombuffer(block["bytes"], np.uint8)
        tf = np.frombuffer(block["tf"], f"<u{len(block['tf']) // max(len(level), 1) or 1}")
        numbers, here = self.queries.met(block["terms"])
        place = dict(zip(numbers.tolist(), here.tolist()))
        bounds = np.zeros((2, len(m)), np.int64)
        for q, (terms, weights) in enumerate(self.queries.rows):
            lists = [(w, offsets[p], offsets[p + 1]) for t, w in zip(terms, weights) if w and (p := place.get(t)) is not None]
            if not lists:
                continue
            bounds[:] = 0
            for w, a, b in lists:
                at, step = doc[a:b], level[a:b]
                bounds[0, at] += (w * UPPER)[step]
                bounds[1, at] += (w * LOWER)[step]
            found = self.found[q]
            least = -found[-1][0] if len(found) == self.k else 1
            if len(m) >= self.k:
                least = max(least, int(np.partition(bounds[1], len(m) - self.k)[len(m) - self.k]))
            chosen = np.flatnonzero(bounds[0] >= least)
            if len(chosen):
                self._rescore(found, chosen, lists, doc, tf, m, block["docs"])

    def _rescore(self, found: list, chosen: np.ndarray, lists: list, doc: np.ndarray, tf: np.ndarray, m: np.ndarray, docs: pa.Array) -> None:
        self.rescored += len(chosen)
        score = np.zeros(len(chosen), np.int64)
        for w, a, b in lists:
            at = np.searchsorted(doc[a:b], chosen)
            has = np.flatnonzero(at < b - a)
            has = has[doc[a:b][at[has]] == chosen[has]]
            score[has] += w * impact(tf[a:b][at[has]], m[chosen[has]])
        # of many equal scores at the end, each has to be compared by doc_id
        if len(chosen) > self.k:
            keep = score >= max(1, int(np.partition(score, len(score) - self.k)[len(score) - self.k]))
        else:
            keep = score > 0
        for c, s in zip(chosen[keep].tolist(), score[keep].tolist()):
            d = docs[c].as_py()
            found.append((-s, d is None, d if d is not None else 0))
        found.sort()
        del found[self.k :]


def _kept(key: str, make):
    """A worker process's object for a key; the one of the key before goes."""
    kept = sys.modules.setdefault("_helixmark_queries", types.ModuleType("_helixmark_queries")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def _frequencies(index: Index, terms: list[bytes]) -> list[int]:
    """How many documents have each of the terms."""
    told, key = index.blocks.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _kept(key, lambda: Queries(told.value, []))
        total = np.zeros(len(told.value), np.int64)
        for b in batches:
            for terms, offsets in zip(b.column(0), b.column(1).to_pylist()):
                number, here = queries.met(terms.values)
                total[number] += np.diff(np.frombuffer(offsets, np.int64))[here]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["number", "n"])

    counts = index.blocks.select("terms", "offsets").mapInArrow(run, "number bigint, n bigint").groupBy("number").agg(F.sum("n"))
    out = [0] * len(terms)
    for number, n in counts.collect():  # at most a row for each term of the pass
        out[number] = n
    return out


def _pass(index: Index, rows: list, item_kind: T.DataType, number: int, k: int) -> DataFrame:
    """The k best documents of each task for some items: (item, item_id, doc_id, score)."""
    spark = index.blocks.sparkSession
    terms = sorted(set().union(*[map(bytes, r["terms"]) for r in rows]))
    place = {t: n for n, t in enumerate(terms)}
    weight = [math.floor(1000 * math.log((2 * index.n + 2) / (2 * df + 1))) for df in _frequencies(index, terms)]
    asked = [([place[bytes(t)] for t in r["terms"]], [weight[place[bytes(t)]] * c for t, c in zip(r["terms"], r["counts"])]) for r in rows]
    told, key = spark.sparkContext.broadcast((terms, asked, [r["item_id"] for r in rows])), uuid.uuid4().hex
    kind = index.blocks.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_kind), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        best = Best(_kept(key, lambda: Queries(*told.value[:2])), k)
        for b in batches:
            for n in range(b.num_rows):
                block = {c: b.column(i)[n] for i, c in enumerate(b.schema.names)}
                best.add({c: v.values if c in ("docs", "terms") else v.as_py() for c, v in block.items()})
        ids = told.value[2]
        out = [((number << 32) + q, ids[q], None if no else d, -s) for q, found in enumerate(best.found) for s, no, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(to_arrow_schema(schema))], schema.names)

    return index.blocks.mapInArrow(run, schema)


def search(index: Index, items: DataFrame, k: int = K, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """The k best documents of each item (item_id, text) with a score above 0: (item_id, rank, doc_id, score)."""
    rows = materialise(_questions(items), "lexical-queries", few=True)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = -(-total // terms_per_pass)
    if passes > 1:
        dealt = running(rows, ["item_id", "digest"], {"before": F.col("n")}).withColumn("pass", F.floor(F.col("before") / terms_per_pass))
        dealt = materialise(dealt, "lexical-passes", few=True)
        chosen = [dealt.where(F.col("pass") == p) for p in range(passes)]
    else:
        chosen = [rows]
    found = None
    for number, part in enumerate(chosen):
        # at most terms_per_pass terms, and those of one item
        one = _pass(index, part.collect(), items.schema["item_id"].dataType, number, k)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
