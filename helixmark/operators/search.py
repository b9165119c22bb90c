"""Search of patterns in long sequences: tiles, an index of minimizers, and alignment of what the index offers.

Sequences are cut into tiles, so that no row is longer than a tile, however long a sequence is. Each position belongs to
one tile; a tile's row also has the letters around it that a pattern may need. A pattern is cut into so many disjoint
parts that one of them occurs as it is in every hit. What a part and a tile share is a minimizer: of each run of w successive
substrings of k letters that with the least hash, the leftmost of equal ones. A part of k + w - 1 letters has the minimizer of its first run
in common with each place where it occurs. k and w follow from a pattern's length class, so short patterns don't
make the seeds of long ones short. The seed join carries hashes, ids and offsets only; candidates, one row for each place, meet
their tile afterwards. A sieve of the patterns' seeds, of a fixed size, keeps most of a tile's other minimizers within the task that makes them. Patterns with parts under `LEAST` letters
are compared with every place of the tiles, in blocks of patterns. Patterns of the same letters and centre are searched once.

Building a search runs jobs: tiles, patterns and candidates are written, so that Spark knows their sizes. It bounds the session's Arrow batches (1,000 rows or 8 MB), and tasks
work on `ROWS` rows at a time, so what a task holds doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise

#: Letters that a tile owns, at least.
STEP = 2_048
#: Sequences of more letters have their tiles dealt to all tasks.
LONG = 1_000_000
#: Length classes: least letters of a part, k, w; k + w - 1 letters are needed.
CLASSES = ((32, 16, 17), (16, 12, 5), (11, 11, 1), (8, 8, 1), (5, 5, 1))
LEAST = CLASSES[-1][0]
#: Stands for any letter in a pattern.
ANY = "\0"
#: Short patterns that a tile is compared with in one row.
BLOCK = 256
#: Rows that a task works on at a time.
ROWS = 64
#: Words of 64 bits of a sieve.
SIEVE = 1 << 14
_OUTSIDE, _FACTOR = 0x110000, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tiles:
    """Rows (subject_id, tile, start, length, seq): of each sequence and tile the first letter's place and the sequence's length."""

    rows: DataFrame
    step: int
    margin: int


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of sequences small: by default they have up to 10,000 rows or 64 MB, twice for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def tiled(subjects: DataFrame, longest: int, step: int | None = None, long: int | None = None) -> Tiles:
    """Tiles of (subject_id, seq) for patterns of at most `longest` letters; null and empty sequences have none.

    Sequences of at most `long` letters are cut where they are, others' tiles are dealt to all tasks.
    """
    bounded_batches(subjects.sparkSession)
    margin = max(longest, 32)
    step, long = max(step or STEP, margin), LONG if long is None else long
    kind = subjects.schema["subject_id"].dataType
    schema = T.StructType([T.StructField("subject_id", kind), *T.StructType.fromDDL("tile bigint, start bigint, length bigint, seq string")])

    def batch(ids: pa.Array, rows: list) -> pa.RecordBatch:
        n, tile, start, length, seq = zip(*rows)
        columns = [ids.take(pa.array(n)), *[pa.array(x, pa.int64()) for x in (tile, start, length)], pa.array(seq, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows = []
            for n, seq in enumerate(b.column(1).to_pylist()):
                for p in range(0, len(seq or ""), step):
                    start = max(0, p - margin)
                    rows.append((n, p // step, start, len(seq), seq[start : p + step + margin]))
                    if len(rows) == 256:
                        yield batch(b.column(0), rows)
                        rows = []
            if rows:
                yield batch(b.column(0), rows)

    s = subjects.select("subject_id", F.col("seq").cast("string").alias("seq"))
    wide = max(int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions")), subjects.sparkSession.sparkContext.defaultParallelism)
    short = s.where(F.length("seq") <= long).mapInArrow(run, schema)
    rows = short.unionByName(s.where(F.length("seq") > long).mapInArrow(run, schema).repartition(wide, "subject_id", "tile"))
    return Tiles(materialise(rows, "search-tiles"), step, margin)


def from_pieces(pieces: DataFrame, longest: int, step: int | None = None) -> Tiles:
    """Tiles as of tiled, of sequences that are pieces (subject_id, start, seq), from 0 and without gaps or overlaps: no row ever holds a sequence."""
    bounded_batches(pieces.sparkSession)
    margin = max(longest, 32)
    step = max(step or STEP, margin)
    p = pieces.select("subject_id", F.col("start").cast("long").alias("from"), "seq").where(F.length("seq") > 0).withColumn("to", F.col("from") + F.length("seq"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("from") - margin) / step)), F.floor((F.col("to") - 1 + margin) / step)
    lo, hi = F.greatest("from", F.col("tile") * step - margin), F.least("to", (F.col("tile") + 1) * step + margin)
    cut = p.withColumn("tile", F.explode(F.sequence(first, last))).withColumns({"start": lo, "stop": hi})
    cut = cut.select("subject_id", "tile", "start", F.expr("substring(seq, int(start - from) + 1, int(stop - start))").alias("seq"))
    each = F.array_sort(F.collect_list(F.struct("start", "seq")))  # of a tile
    rows = cut.groupBy("subject_id", "tile").agg(F.min("start").alias("start"), F.array_join(F.transform(each, lambda x: x["seq"]), "").alias("seq"))
    length = p.groupBy("subject_id").agg(F.max("to").alias("length"))
    rows = rows.join(length, "subject_id").where(F.col("tile") * step < F.col("length"))
    return Tiles(materialise(rows.select("subject_id", "tile", "start", "length", "seq"), "search-tiles"), step, margin)


def hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """A hash of each substring of k letters."""
    n = max(0, len(letters) - k + 1)
    out, wide = np.zeros(n, np.uint64), letters.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _FACTOR + wide[j : j + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def minimal(h: np.ndarray, w: int) -> np.ndarray:
    """The places that are least in some run of w, the leftmost of equal ones."""
    if w == 1 or len(h) < w:
        return np.arange(len(h) if w == 1 else 0)
    runs = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(runs.argmin(1) + np.arange(len(runs)))


def sieve(seeds: DataFrame) -> np.ndarray:
    """A bit for each rest of a seed by 64 * SIEVE, set if a seed (seed) has it: at most SIEVE numbers, however many seeds."""
    word = F.expr(f"cast((seed >> 6) & {SIEVE - 1} AS int)").alias("word")
    rows = seeds.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 AS int))")).alias("bits")).collect()
    out = np.zeros(SIEVE, np.int64)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out.view(np.uint64)


def minimizers(tiles: Tiles, k: int, w: int, ends: int | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(seed, subject_id, tile, p, length) of all sequences; ends: only places within so many letters of an end; only: those that a sieve lets through."""
    kind, step = tiles.rows.schema["subject_id"].dataType, tiles.step
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("subject_id", kind), *T.StructType.fromDDL("tile bigint, p bigint, length bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows, seeds, places = [], [], []
            for n, (tile, start, length, seq) in enumerate(zip(*[c.to_pylist() for c in b.columns[1:]])):
                h = hashes(codes(seq), k)
                p = minimal(h, w)
                at = p + start
                own = (at >= tile * step) & (at < (tile + 1) * step)
                if ends is not None:
                    own &= (at < ends) | (at >= length - ends - k)
                if only is not None:
                    x = h[p]
                    own &= (only[(x >> np.uint64(6)) & np.uint64(SIEVE - 1)] >> (x & np.uint64(63))) & np.uint64(1) > 0
                rows.append(np.full(int(own.sum()), n))
                seeds.append(h[p[own]].view(np.int64))
                places.append(at[own])
            at = pa.array(np.concatenate(rows) if rows else [], pa.int64())
            both = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (seeds, places)]
            yield pa.RecordBatch.from_arrays([both[0], b.column(0).take(at), b.column(1).take(at), both[1], b.column(3).take(at)], schema.names)

    rows = tiles.rows if ends is None else tiles.rows.where((F.col("tile") * step < ends) | ((F.col("tile") + 1) * step >= F.col("length") - ends - k))
    return rows.select("subject_id", "tile", "start", "length", "seq").mapInArrow(run, schema)


def _stretch(letters: str) -> tuple[int, int]:
    """From and to of the longest stretch without free letters, the first of equal ones."""
    best, at = (0, 0), 0
    for part in letters.split(ANY):
        if len(part) > best[1] - best[0]:
            best = (at, at + len(part))
        at += len(part) + 1
    return best


def part_seeds(patterns: DataFrame, parts: int, classes: tuple) -> DataFrame:
    """(key, from, seed, k, w, size) of each part of patterns (key, letters)."""
    schema = "key bigint, `from` bigint, seed bigint, k int, w int, size bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, z = _stretch(letters)
                found = [c for c in classes if c[0] <= (z - a) // parts]
                if not found:
                    continue
                _, k, w = found[0]
                for j in range(parts):
                    begin = a + j * (z - a) // parts
                    h = hashes(codes(letters[begin : begin + k + w - 1]), k)
                    p = int(h.argmin())
                    out.append((key, begin + p, int(h[p].view(np.int64)), k, w, len(letters)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(),) * 2 + (pa.int64(),))], ["key", "from", "seed", "k", "w", "size"])

    return patterns.select("key", "letters").mapInArrow(run, schema)


def candidates(tiles: Tiles, patterns: DataFrame, parts: int, classes: tuple = CLASSES, ends: int | None = None) -> DataFrame:
    """(key, size, subject_id, tile, at, length): where a part of a pattern occurs, `at` is the pattern's first letter's place, which may be below 0."""
    seeds = materialise(part_seeds(patterns, parts, classes), "search-seeds", few=True)
    found = None
    for k, w in sorted(tuple(r) for r in seeds.select("k", "w").distinct().collect()):  # a row for each class
        mine = seeds.where((F.col("k") == k) & (F.col("w") == w))
        one = minimizers(tiles, k, w, ends, sieve(mine)).join(mine, "seed")
        one = one.select("key", "size", "subject_id", "tile", (F.col("p") - F.col("from")).alias("at"), "length")
        found = one if found is None else found.unionByName(one)
    if found is None:
        schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("subject_id", tiles.rows.schema["subject_id"].dataType), *T.StructType.fromDDL("tile bigint, at bigint, length bigint")])
        return seeds.sparkSession.createDataFrame([], schema)
    return found


@F.pandas_udf(T.IntegerType())
def differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places where two texts of one length differ; free letters of the first don't."""
    sizes, out = a.str.len().to_numpy(), np.zeros(len(a), np.int32)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        few = max(1, 2_000_000 // int(size))
        for part in (rows[k : k + few] for k in range(0, len(rows), few)):
            x, y = (np.array(t.iloc[part].tolist(), f"U{size}").view(np.uint32).reshape(len(part), size) for t in (a, b))
            out[part] = ((x != y) & (x != 0)).sum(1)
    return pd.Series(out)


def _places(rows: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (tile, start, length, seq) as one array of letters, with so many outside ones around each, and where each row's letters begin."""
    pad = np.full(size, _OUTSIDE, np.uint32)
    parts, first, at = [pad], [], len(pad)
    for *_, seq in rows:
        letters = codes(seq)
        first.append(at)
        parts += [letters, pad]
        at += len(letters) + len(pad)
    return np.concatenate(parts), np.array(first, np.int64)


def _block_hits(rows: list, patterns: list, step: int, mismatches: int, min_coverage: float) -> Iterator[tuple]:
    """(key, row, at, lo, hi, mismatches, letter), all arrays but the key, of patterns in rows (tile, start, length, seq) that are searched together."""
    pad = max(len(p["letters"]) for p in patterns)
    text, first = _places(rows, pad)
    tile, start, length = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
    inside, unlike = text != _OUTSIDE, {}
    for p in patterns:
        letters, centre = p["letters"], p["centre"]
        size = len(letters)
        need = max(1, int(np.ceil(min_coverage * size - 1e-9)))
        count = np.zeros(len(text) - size + 1, np.int8 if size < 128 else np.int32)
        for j, c in enumerate(letters):
            if c != ANY:
                if c not in unlike:
                    unlike[c] = ((text != ord(c)) & inside).view(np.int8)
                count += unlike[c][j : j + len(count)]
        x = np.flatnonzero(count <= mismatches)
        row = np.maximum(np.searchsorted(first - pad, x, "right") - 1, 0)
        at = x - first[row] + start[row]
        lo, hi = np.maximum(0, -at), np.minimum(size, length[row] - at)
        good = (at >= np.where(tile[row] == 0, need - size, tile[row] * step)) & (at < (tile[row] + 1) * step) & (hi - lo >= need) & (lo <= centre) & (centre < hi)
        if good.any():
            x = x[good]
            yield p["key"], row[good], at[good], lo[good], hi[good], count[x], text[x + centre]


def _compared(tiles: Tiles, patterns: DataFrame, mismatches: int, min_coverage: float) -> DataFrame:
    """Hits of few short patterns, each compared with every place: (key, subject_id, at, lo, hi, mismatches, letter)."""
    known = patterns.count()
    n = max(1, -(-known // BLOCK))
    chunk = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    lists = patterns.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("key", "letters", "centre")).alias("patterns"))
    lists = materialise(lists, "search-blocks", few=True)
    spark = tiles.rows.sparkSession
    # short sequences are few bytes, and much work: they are dealt to all tasks
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = tiles.rows.repartition(wide) if known else tiles.rows
    rows = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(lists, "chunk")
    kind, step = tiles.rows.schema["subject_id"].dataType, tiles.step
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("subject_id", kind), *T.StructType.fromDDL("at bigint, lo bigint, hi bigint, mismatches int, letter string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, patterns = None, []  # a chunk's list stands in each of its rows
        for b in batches:
            chunks = b.column(5).to_numpy()
            for chunk in np.unique(chunks):
                mine = np.flatnonzero(chunks == chunk)
                if chunk != last:
                    last, patterns = chunk, b.column(6)[int(mine[0])].as_py()
                for part in (mine[k : k + ROWS] for k in range(0, len(mine), ROWS)):
                    few = b.take(pa.array(part))
                    for key, row, at, lo, hi, count, letter in _block_hits(list(zip(*[c.to_pylist() for c in few.columns[1:5]])), patterns, step, mismatches, min_coverage):
                        columns = [pa.array(np.full(len(row), key), pa.int64()), few.column(0).take(pa.array(row)), *[pa.array(v, pa.int64()) for v in (at, lo, hi)]]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int32)), pa.array(list(map(chr, letter)), pa.string())], schema.names)

    return rows.select("subject_id", "tile", "start", "length", "seq", "chunk", "patterns").mapInArrow(run, schema)


def _numbered(patterns: DataFrame) -> DataFrame:
    """Patterns with a key of their own; those without letters are left out."""
    return materialise(patterns.where(F.length("letters") > 0).withColumn("key", F.monotonically_increasing_id()), "search-patterns", few=True)


def search(subjects: DataFrame | None, patterns: DataFrame, mismatches: int = 0, min_coverage: float = 1.0, tiles: Tiles | None = None) -> DataFrame:
    """Every ungapped hit of patterns (letters, centre and any other columns) in sequences (subject_id, seq).

    A row has the other columns of the pattern, subject_id, at (the place of the pattern's first letter, from 0, below 0 where it hangs
    over), lo and hi (which of its letters lie on the sequence), mismatches, and letter, the sequence's at the pattern's centre. A hit has at most `mismatches`
    letters that differ, lies on the sequence with its centre and at least min_coverage of its letters. The letter `ANY` in a pattern agrees with all.
    """
    p = _numbered(patterns.select("letters", "centre").distinct())
    given = [c for c in patterns.columns if c not in ("letters", "centre")]
    who = materialise(patterns.join(p, ["letters", "centre"]).select("key", *given), "search-names", few=True)
    longest = p.agg(F.coalesce(F.max(F.length("letters")), F.lit(0))).first()[0]
    t = tiles or tiled(subjects, longest)
    if longest > t.margin:
        raise ValueError(f"the tiles are for patterns of at most {t.margin} letters")
    # a stretch of that share of the letters holds at least share * parts - 2 whole parts
    fine = int(np.ceil((mismatches + 3) / min_coverage))
    stretch = F.array_max(F.transform(F.split("letters", ANY), F.length))  # of letters that aren't free
    indexed = F.floor(stretch / (mismatches + 1)) >= LEAST
    if min_coverage < 1:
        indexed = indexed & (F.floor(stretch / fine) >= 1) & ~F.contains("letters", F.lit(ANY))
    within = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length"))
    found = candidates(t, p.where(indexed), mismatches + 1).where(within)
    if min_coverage < 1:
        over = candidates(t, p.where(indexed), fine, tuple((k, k, 1) for k in (11, 7, 5, 3, 2, 1)), ends=longest)
        found = found.unionByName(over.where(~within & (F.least("size", F.col("length") - F.col("at")) - F.greatest(F.lit(0), -F.col("at")) >= min_coverage * F.col("size"))))
    places = materialise(found.groupBy("key", "subject_id", "at").agg(F.min("tile").alias("tile")), "search-candidates")
    df = places.join(t.rows, ["subject_id", "tile"]).join(p, "key")
    df = df.withColumns({"lo": F.greatest(F.lit(0), -F.col("at")), "hi": F.least(F.length("letters"), F.col("length") - F.col("at"))})
    df = df.withColumns({"__a": F.expr("substring(letters, int(lo) + 1, int(hi - lo))"), "__b": F.expr("substring(seq, int(at + lo - start) + 1, int(hi - lo))")})
    df = df.where((F.col("centre") >= F.col("lo")) & (F.col("centre") < F.col("hi"))).withColumn("mismatches", differing("__a", "__b"))
    out = ["subject_id", "at", "lo", "hi", "mismatches", "letter"]
    letter = F.expr("substring(__b, int(centre - lo) + 1, 1)")
    good = df.where(F.col("mismatches") <= mismatches).withColumn("letter", letter).select("key", *out)
    short = _compared(t, p.where(~indexed), mismatches, min_coverage).select("key", *out)
    return good.unionByName(short).join(who, "key").select(*given, *out)


# gapped ---------------------------------------------------------------------------------------------

#: Scores of aligned letters that agree or differ, of opening a gap, and of each letter in it.
AGREE, DIFFER, OPEN, EXTEND = 1, -3, -5, -2
_LOW = -(10**6)


def best_scores(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """The scores of local_alignments alone, a whole row of the band at a time."""
    n, size = a.shape
    width = 2 * shift + 1
    h = np.zeros((n, width), np.int32)
    e = np.full((n, width), _LOW, np.int32)
    best = np.zeros(n, np.int32)
    slope = (EXTEND * np.arange(width)).astype(np.int32)
    for i in range(size):
        row = b[:, i : i + width]
        x = np.maximum(h, 0) + np.where(a[:, i : i + 1] == row, AGREE, DIFFER).astype(np.int32)
        x[row == 0] = _LOW
        e[:, :-1] = np.maximum(h[:, 1:] + (OPEN + EXTEND), e[:, 1:] + EXTEND)
        e[:, -1] = _LOW
        np.maximum(x, e, out=x)
        # a gap in `a` that began at any earlier place of the row
        h = x.copy()
        np.maximum(h[:, 1:], np.maximum.accumulate(x - slope, 1)[:, :-1] + slope[1:] + OPEN, out=h[:, 1:])
        np.maximum(best, h.max(1), out=best)
    return best


def local_alignments(a: np.ndarray, b: np.ndarray, shift: int) -> dict[str, np.ndarray]:
    """Best local alignments of rows of `a` with rows of `b`, affine gaps, in a band: row i of a meets b from i to i + 2 * shift.

    a: n x L letters; b: n x (L + 2 * shift) letters, those outside a sequence as 0. Of equally good ends the first in `a`, then in `b`; on a tie
    a pair of letters comes before a gap. Returns score, from and to in both (to exclusive), mismatches, gap openings, and aligned columns.
    """
    n, size = a.shape
    width = 2 * shift + 1
    # for each state and place of the band: score, and of its path: first in a, first in b, mismatches, gaps, columns
    fields = 6
    best = np.zeros((8, n), np.int64)

    def fresh():
        x = np.zeros((fields, n, width), np.int64)
        x[0] = _LOW
        return x

    h, e = fresh(), fresh()  # h: any; e: a's letter stands against a gap
    for i in range(size):
        new_h, new_e = fresh(), fresh()
        f = np.zeros((fields, n), np.int64)  # b's letter stands against a gap
        f[0] = _LOW
        for d in range(width):
            j = i + d
            same = (a[:, i] == b[:, j]) & (b[:, j] != 0)
            pair = h[:, :, d].copy()
            start = pair[0] <= 0
            pair[:, start] = 0
            pair[1, start], pair[2, start] = i, j
            pair[0] += np.where(same, AGREE, DIFFER)
            pair[0, b[:, j] == 0] = _LOW
            pair[3] += ~same
            pair[5] += 1
            if d + 1 < width:  # from the row before, one place on in the band: the same letter of b
                opened, longer = h[:, :, d + 1].copy(), e[:, :, d + 1].copy()
                opened[0] += OPEN + EXTEND
                opened[4] += 1
                longer[0] += EXTEND
                gap = np.where(opened[0] >= longer[0], opened, longer)
                gap[5] += 1
                new_e[:, :, d] = gap
            cell = np.where(pair[0] >= new_e[0, :, d], pair, new_e[:, :, d])
            if d:
                opened, longer = new_h[:, :, d - 1].copy(), f.copy()
                opened[0] += OPEN + EXTEND
                opened[4] += 1
                longer[0] += EXTEND
                f = np.where(opened[0] >= longer[0], opened, longer)
                f[5] += 1
                cell = np.where(cell[0] >= f[0], cell, f)
            new_h[:, :, d] = cell
            better = cell[0] > best[0]
            best[:6, better] = cell[:, better]
            best[6, better], best[7, better] = i + 1, j + 1
        h, e = new_h, new_e
    names = ("score", "a_from", "b_from", "mismatches", "gaps", "aligned", "a_to", "b_to")
    return dict(zip(names, best))


def gapped(subjects: DataFrame, patterns: DataFrame, edits: int = 4, min_coverage: float = 0.8, tiles: Tiles | None = None) -> DataFrame:
    """Local alignments with gaps of patterns (letters, centre and any other columns) in sequences (subject_id, seq).

    Every alignment of at least min_coverage of a pattern's letters with at most `edits` letters replaced, put in or left out is found: it holds
    the pattern's middle, one of whose parts occurs as it is. Around each such place, shifted by up to `edits`, the best local alignment is computed, if
    its score is one that such an alignment can have; its ends are trimmed by its score. Rows: the pattern's other columns, subject_id, score, a_from, a_to (of the pattern, from 0, to exclusive), b_from, b_to (of the sequence), mismatches, gaps (openings),
    aligned (columns), identity, coverage (columns by letters), and `at`, where the pattern's centre falls on the sequence counting from the alignment's beginning
    (its end, where the pattern has a column from_end that says so), with its letter.
    Of alignments of a pattern that begin, or end, at the same places the best stays. Patterns whose middle has fewer letters than parts raise an error.
    """
    p = _numbered(patterns)
    longest = p.agg(F.coalesce(F.max(F.length("letters")), F.lit(0))).first()[0] + 3 * edits
    rim = F.floor((1 - min_coverage) * F.length("letters")).cast("int")  # what an alignment may lack on a side
    middle = p.select("key", F.substring("letters", rim + 1, F.length("letters") - 2 * rim).alias("letters"), rim.alias("rim"))
    if not middle.where(F.length("letters") <= edits).isEmpty():
        raise ValueError(f"with {edits} edits and a coverage of {min_coverage} there are patterns with too few letters")
    t = tiles or tiled(subjects, longest)
    if longest > t.margin:
        raise ValueError(f"the tiles are for patterns of at most {t.margin - 3 * edits} letters")
    given = [c for c in patterns.columns if c not in ("letters", "centre")]
    found = candidates(t, middle, edits + 1, (*CLASSES[:-1], *((k, k, 1) for k in range(7, 0, -1)))).join(middle.select("key", "rim"), "key").withColumn("at", F.col("at") - F.col("rim"))
    # neighbouring shifts see the same alignments: a place stands for as many shifts as the band allows
    band = 2 * edits
    places = found.groupBy("key", "subject_id", (F.floor(F.col("at") / max(edits, 1)) * max(edits, 1)).alias("at")).agg(F.min("tile").alias("tile"))
    places = materialise(places, "search-places")
    df = places.join(t.rows, ["subject_id", "tile"]).join(p.select("key", "letters"), "key")
    # letters from at - band to at + size + band, those outside the sequence as 0
    first = F.col("at") - band
    left, skip = F.greatest(F.lit(0), -first).cast("int"), F.greatest(F.lit(0), first - F.col("start")).cast("int")
    window = F.concat(F.repeat(F.lit(ANY), left), F.substring("seq", skip + 1, (F.length("letters") + 2 * band - left).cast("int")))
    df = df.select("key", "subject_id", "letters", F.col("at").alias("place"), F.rpad(window, F.length("letters") + 2 * band, F.lit(ANY)).alias("window"))
    kind = t.rows.schema["subject_id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("subject_id", kind), *T.StructType.fromDDL("score int, a_from bigint, a_to bigint, b_from bigint, b_to bigint, mismatches int, gaps int, aligned int, window string, place bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters, windows, starts = (b.column(k).to_pylist() for k in (2, 4, 3))
            sizes = np.array([len(x) for x in letters])
            for size in np.unique(sizes):  # patterns of one length together
                rows = np.flatnonzero(sizes == size)
                both = np.stack([codes(letters[k]) for k in rows]), np.stack([codes(windows[k]) for k in rows])
                # each edit costs a letter that agrees, and a gap of one letter at most
                good = best_scores(*both, band) >= max(1, np.ceil(min_coverage * size) + edits * (OPEN + EXTEND - AGREE))
                if not good.any():
                    continue
                rows = rows[good]
                found = local_alignments(both[0][good], both[1][good], band)
                keep = found["aligned"] >= min_coverage * size
                if not keep.any():
                    continue
                at, rows = np.array(starts)[rows[keep]] - band, rows[keep]
                f = {k: v[keep] for k, v in found.items()}
                take = pa.array(rows)
                columns = [pa.array(f["score"], pa.int32()), pa.array(f["a_from"], pa.int64()), pa.array(f["a_to"], pa.int64()), pa.array(f["b_from"] + at, pa.int64()), pa.array(f["b_to"] + at, pa.int64())]
                columns += [pa.array(f[k], pa.int32()) for k in ("mismatches", "gaps", "aligned")]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *columns, b.column(4).take(take), pa.array(at, pa.int64())], schema.names)

    hits = df.mapInArrow(run, schema)
    rank = F.struct((-F.col("score")).alias("s"), "mismatches", "gaps", "aligned", "a_from", "a_to", "b_from", "b_to")
    for side in ("from", "to"):  # of those that begin, then of those that end, at one place
        rest = F.struct("score", "mismatches", "gaps", "aligned", "window", "place", *[c for c in ("a_from", "a_to", "b_from", "b_to") if not c.endswith(side)])
        hits = hits.groupBy("key", "subject_id", f"a_{side}", f"b_{side}").agg(F.min_by(rest, rank).alias("r")).select("key", "subject_id", f"a_{side}", f"b_{side}", "r.*")
    df = hits.join(p.select("key", *given, "centre", F.length("letters").alias("size")), "key").where((F.col("a_from") <= F.col("centre")) & (F.col("centre") < F.col("a_to")))
    backwards = F.col("from_end") if "from_end" in given else F.lit(False)
    df = df.withColumn("at", F.when(backwards, F.col("b_to") - F.col("a_to") + F.col("centre")).otherwise(F.col("b_from") - F.col("a_from") + F.col("centre")))
    unpaired = 2 * F.col("aligned") - (F.col("a_to") - F.col("a_from")) - (F.col("b_to") - F.col("b_from"))
    df = df.withColumn("identity", (F.col("aligned") - F.col("mismatches") - unpaired) / F.col("aligned"))
    letter = F.substring("window", (F.col("at") - F.col("place") + 1).cast("int"), F.lit(1))
    df = df.withColumn("letter", letter).where((F.col("letter") != ANY) & (F.col("letter") != ""))
    return df.select(*given, "subject_id", "score", "a_from", "a_to", "b_from", "b_to", "mismatches", "gaps", "aligned", "identity", (F.col("aligned") / F.col("size")).alias("coverage"), "at", "letter")
