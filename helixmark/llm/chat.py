"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered canonically.

A row is a text of one turn or of many. With by_line, each of its lines is an observation, so that a line
without a marker can open a turn; else it is cut into blocks: its start, and each line that begins with a
speaker marker, opens one. Hidden states are the roles; an observation is its marker's class, its length,
and whether it has a question, a list or code. What follows a role depends on the step: to a marker or a new
row, to an unmarked line, to one after a blank line. Probabilities are smoothed counts over labelled rows.
Viterbi finds the likeliest roles; unmarked lines of one role are then rendered as one turn, without its
marker, and `continues` tells the turns that go on with the row before (same role, no marker).

No transcript is gathered in one task: rows are sorted by transcript and place over range partitions,
and one transcript may span many of them. A first pass gives, for the first and the last transcript of
each partition, the best score from each role before to each role at its end (products of max-plus
matrices are associative). The driver chains these, at most two small rows per partition, into what
comes before and after; a second pass over the same checkpointed partitions decodes with these as its
ends. The result is exactly that of Viterbi over the whole transcript.

Defined results: null and empty texts are blocks without words; rows with equal place are ordered by
text; a null id is a transcript of its own; repeated rows are blocks of their own; an empty table gives
an empty result; of equal scores the first role in ROLES wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir

ROLES = ("system", "user", "assistant", "tool")
#: Speaker names by class.
SPEAKERS = {
    "system": ["system", "sys", "instruction", "instructions", "context"],
    "user": ["user", "human", "customer", "client", "question", "q", "prompt", "student", "me"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "a", "model", "chatbot", "support", "response"],
    "tool": ["tool", "function", "observation", "result", "api"],
}
_CLASS = {name: k for k, names in SPEAKERS.items() for name in names}
_NAMES = "|".join(sorted(_CLASS, key=len, reverse=True))
#: "User:", "[user]", "### User", "<|user|>", "**User**:", "User -"; otherwise a capitalised name and a colon.
MARKER = re.compile(rf"\s*(?:[#>*]+\s*)?(?:[\[(<|*]+\s*({_NAMES})\s*[\])>|*]+\s*:?|({_NAMES})\s*(?::| -|>)|#+\s*({_NAMES})\s*:?\s*$)[ \t]*", re.I)
NAME = re.compile(r"\s*([A-Z][\w.-]{1,20}):[ \t]+")
CLASSES = ("none", *SPEAKERS, "name")
OBSERVED = {"marker": len(CLASSES), "length": 10, "question": 2, "listing": 2}
SMOOTH = 0.5
#: Letters of a transcript's undecided chunks, beyond which what nothing later can change is written.
HELD = 1 << 22


def marker_of(line: str) -> tuple[str, int]:
    """Class of the line's speaker marker, and where its text starts."""
    m = MARKER.match(line)
    if m:
        return _CLASS[next(g for g in m.groups() if g).lower()], m.end()
    m = NAME.match(line)
    return ("name", m.end()) if m else ("none", 0)


def blocks(text: str | None) -> list[tuple[str, str]]:
    """(marker class, text without marker) of each block of a row."""
    out: list[tuple[str, list[str]]] = []
    for line in (text or "").split("\n"):
        kind, at = marker_of(line)
        if kind == "none" and out:
            out[-1][1].append(line)
        else:
            out.append((kind, [line[at:]] if kind != "none" else [line]))
    return [(k, "\n".join(lines).strip("\n")) for k, lines in out]


def lines(text: str | None) -> list[tuple[str, str, int, int]]:
    """(marker class, text without marker, step, number) of each line of a row; a blank line goes with the one before it."""
    out: list[list] = []
    blank = False
    for number, line in enumerate((text or "").split("\n")):
        if not line.strip():
            blank = True
            if out:
                out[-1][1] += "\n"
            continue
        kind, at = marker_of(line)
        out.append([kind, line[at:], 0 if kind != "none" or not out else 2 if blank else 1, number])
        blank = False
    return [tuple(x) for x in out] or [("none", "", 0, 0)]


def _cut(text: str | None, by_line: bool) -> list[tuple[str, str, int, int]]:
    return lines(text) if by_line else [(kind, t, 0, k) for k, (kind, t) in enumerate(blocks(text))]


def observe(kind: str, text: str) -> tuple[int, ...]:
    n = len(text.split())
    return CLASSES.index(kind), min(n.bit_length(), 9), int("?" in text), int(bool(re.search(r"^\s*(?:[-*•]|\d+[.)])\s|```", text, re.M)))


@dataclass
class Model:
    """Logarithms of probabilities: of the first role, of role after role, of each observation by role, and of role after role at steps 1 and 2."""

    start: np.ndarray
    after: np.ndarray
    seen: list[np.ndarray]
    within: np.ndarray | None = None

    def step(self, k: int) -> np.ndarray:
        return self.within[k - 1] if k else self.after

    def emissions(self, obs: list[tuple[int, ...]]) -> np.ndarray:
        return sum(table[:, [o[k] for o in obs]].T for k, table in enumerate(self.seen))


def arranged(rows: DataFrame, ident: str, place: str, text: str, *keep: Column) -> DataFrame:
    """Rows (ident, place, text, kept columns), sorted over range partitions that stay as they are."""
    shared_dir(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    df = rows.select(F.col(ident).alias("ident"), F.col(place).alias("place"), F.col(text).alias("text"), *keep)
    df = df.withColumn("__hx_tie", F.rand(7))  # so that equal rows, which are alike, can go to several partitions
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "ident", "place", "text", "__hx_tie").sortWithinPartitions("ident", "place", "text", "__hx_tie").drop("__hx_tie").checkpoint()


def _runs(batches: Iterator[pa.RecordBatch], letters: int = HELD) -> Iterator[tuple[object, list]]:
    """Consecutive rows of a partition with the same ident, as (ident, rows), in chunks of a few thousand rows and so many letters; a chunk that goes on has the same ident."""
    held, who, size = [], None, 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if held and (row[0] != who or len(held) >= 4096 or size > letters):
                yield who, held
                held, size = [], 0
            who = row[0]
            held.append(row)
            size += len(row[2] or "")
    if held:
        yield who, held


def fit(rows: DataFrame, by_line: bool = False) -> Model:
    """From arranged rows whose fourth column is the role of the whole row, or an array with that of each line (null: not used)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        before, who = None, object()
        for ident, chunk in _runs(batches):
            for row in chunk:
                for kind, text, step, at in _cut(row[2], by_line):
                    role = row[3][at] if isinstance(row[3], list) else row[3]
                    if role not in ROLES:
                        before, who = None, ident
                        continue
                    r = ROLES.index(role)
                    if ident != who:
                        n["start", 0, r] += 1
                    elif before is not None:
                        n["within" if step else "after", before + len(ROLES) * max(step - 1, 0), r] += 1
                    for k, o in enumerate(observe(kind, text)):
                        n[f"seen{k}", r, o] += 1
                    before, who = r, ident
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in n]) for i in range(3)] + [pa.array(list(n.values()), pa.int64())], ["what", "a", "b", "n"])

    counts = rows.mapInArrow(run, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()  # roles x observations
    s = len(ROLES)
    tables = {"start": np.zeros((1, s)), "after": np.zeros((s, s)), "within": np.zeros((2 * s, s))} | {f"seen{k}": np.zeros((s, size)) for k, size in enumerate(OBSERVED.values())}
    for what, a, b, n in counts:
        tables[what][a, b] = n
    logs = {k: np.log((t + SMOOTH) / (t + SMOOTH).sum(axis=1, keepdims=True)) for k, t in tables.items()}
    # a marker that names a role stands for it even where no labelled row has that role
    for r, role in enumerate(ROLES):
        if not tables["seen0"][r].any():
            logs["seen0"][r] = np.log(np.where(np.array(CLASSES) == role, 0.9, 0.1 / (len(CLASSES) - 1)))
    # a name that no labelled row has tells nothing of the role
    name = CLASSES.index("name")
    if not tables["seen0"][:, name].any():
        logs["seen0"][:, name] = logs["seen0"][:, name].min()
    return Model(logs["start"][0], logs["after"], [logs[f"seen{k}"] for k in range(len(OBSERVED))], logs["within"].reshape(2, s, s))


def _through(model: Model, emissions: np.ndarray, before: np.ndarray, steps: list[int]) -> np.ndarray:
    """Best scores at the end of a run, for each row of scores before it."""
    for e, k in zip(emissions, steps):
        before = (before[:, :, None] + model.step(k)[None]).max(axis=1) + e
    return before


def viterbi(model: Model, emissions: np.ndarray, before: np.ndarray | None = None, end: np.ndarray | None = None, steps: list[int] | None = None) -> tuple[list[int], int | None]:
    """Roles of a run, given scores of the roles before (None: it starts here) and of what follows, and its steps (None: all 0); and the role before."""
    back = np.zeros(emissions.shape, np.int64)
    score = None
    for t, e in enumerate(emissions):
        if t == 0 and before is None:
            score = model.start + e
            continue
        each = (before if t == 0 else score)[:, None] + model.step(steps[t] if steps else 0)
        back[t] = each.argmax(axis=0)
        score = each.max(axis=0) + e
    path = [int((score + (0 if end is None else end)).argmax())]
    for t in range(len(emissions) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1], None if before is None else int(back[0, path[-1]])


def _observed(chunk: list, by_line: bool) -> list[tuple]:
    return [(row, *x) for row in chunk for x in _cut(row[2], by_line)]


def parse(rows: DataFrame, model: Model, by_line: bool = False, most: int = HELD) -> DataFrame:
    """Arranged rows as turns: their columns but text, and block (the turn's number in its row), role, continues, turn_text; by_line: and line, the number of its first line.

    Of a transcript with more than `most` letters, turns are written as soon as all best paths go through one role after them.
    """
    s = len(ROLES)
    names = [c for c in rows.columns if c != "text"]
    keep = [i for i, c in enumerate(rows.columns) if c != "text"]
    outputs = ["block", "role", "continues", "turn_text", *(["line"] if by_line else [])]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity = np.where(np.eye(s, dtype=bool), 0.0, -np.inf)
        first = last = None  # [ident as text, whether null, matrix, scores from the start]
        for ident, chunk in _runs(batches):
            parts = _observed(chunk, by_line)
            e, steps = model.emissions([observe(*x[1:3]) for x in parts]), [x[3] for x in parts]
            if last is None or ident != last[0]:
                last = [ident, identity, None]
                first = first or last
            last[1] = _through(model, e, last[1], steps)
            last[2] = _through(model, e[1:], (model.start + e[0])[None], steps[1:]) if last[2] is None else _through(model, e, last[2], steps)
        if first is not None:
            both = [first] if first is last else [first, last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * len(both)), pa.array([str(x[0]) if x[0] is not None else None for x in both], pa.string()), pa.array([x[1].ravel().tolist() for x in both], pa.list_(pa.float64())), pa.array([x[2].ravel().tolist() for x in both], pa.list_(pa.float64()))],
                ["pid", "ident", "matrix", "scores"],
            )

    at: dict[int, list] = {}
    for pid, ident, matrix, scores in rows.mapInArrow(ends, "pid long, ident string, matrix array<double>, scores array<double>").collect():  # at most two rows a partition
        at.setdefault(pid, []).append((ident, np.array(matrix).reshape(s, s), np.array(scores)))
    before, after = {}, {}
    carried = None
    for pid in sorted(at):
        ident, matrix, scores = at[pid][0]
        if carried is not None and carried[0] == ident:
            before[pid] = carried[1]
            scores = (carried[1][:, None] + matrix).max(axis=0)
        carried = (ident, scores) if len(at[pid]) == 1 else (at[pid][1][0], at[pid][1][2])
    following = None
    for pid in sorted(at, reverse=True):
        ident = at[pid][-1][0]
        if following is not None and following[0] == ident:
            after[pid] = following[1]
        first, matrix, _ = at[pid][0]
        end = after.get(pid, np.zeros(s)) if len(at[pid]) == 1 else np.zeros(s)
        following = (first, (matrix + end[None]).max(axis=1))
    shared = rows.sparkSession.sparkContext.broadcast((before, after))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        known_before, known_after = shared.value
        held: list = []  # chunks of the current transcript that aren't decided: their blocks and emissions
        who, entry, size, limit = None, known_before.get(pid), 0, most  # entry: scores before the first of them; None: the transcript starts there

        def before_each() -> list:
            """Scores before each held chunk."""
            starts, score = [], entry
            for parts, e in held:
                starts.append(score)
                steps = [x[3] for x in parts]
                score = (_through(model, e[1:], (model.start + e[0])[None], steps[1:]) if score is None else _through(model, e, score[None], steps))[0]
            return starts

        def settled(starts: list) -> tuple[int, int]:
            """How many of the held chunks nothing later can change, and the role at their end: all best paths go through it."""
            live = set(range(s))
            for k in range(len(held) - 1, 0, -1):
                parts, e = held[k]
                live = {viterbi(model, e, starts[k], np.where(np.arange(s) == r, 0.0, -np.inf), [x[3] for x in parts])[1] for r in live}
                if len(live) == 1:
                    return k, live.pop()
            return 0, 0

        def turns(held: list, starts: list, end: np.ndarray | None) -> Iterator[list]:
            # backwards: each chunk's ends follow from the next one
            role_after, out = None, []
            for (parts, e), b in zip(reversed(held), reversed(starts)):
                if role_after is not None:
                    end = np.where(np.arange(s) == role_after, 0.0, -np.inf)
                path, role_after = viterbi(model, e, b, end, [x[3] for x in parts])
                out.append((parts, path, role_after))
            for parts, path, role in reversed(out):
                found: list[list] = []  # row, number in it, role, continues, texts, first line
                for (row, kind, text, step, at), r in zip(parts, path):
                    same = kind == "none" and role == r
                    if same and step:
                        found[-1][4].append(text)
                    else:
                        found.append([row, found[-1][1] + 1 if found and found[-1][0] is row else 0, r, same, [text], at])
                    role = r
                rows_out = []
                for row, k, r, same, texts, at in found:
                    text = "\n".join(texts).strip("\n")
                    rows_out.append((*(row[i] for i in keep), k, ROLES[r], same, f"<|{ROLES[r]}|>\n{text}\n<|end|>\n", *([at] if by_line else [])))
                yield rows_out

        def written(chunks: list, starts: list, end: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for rows_out in turns(chunks, starts, end):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out), kinds)], [*names, *outputs])

        kinds = None
        source = iter(batches)
        first = next(source, None)
        if first is None:
            return
        kinds = [first.schema.field(i).type for i in keep] + [pa.int32(), pa.string(), pa.bool_(), pa.string(), *([pa.int32()] if by_line else [])]

        def again():
            yield first
            yield from source

        for ident, chunk in _runs(again(), most):
            if held and ident != who:
                yield from written(held, before_each(), None)
                held, entry, size, limit = [], None, 0, most
            who = ident
            parts = _observed(chunk, by_line)
            held.append((parts, model.emissions([observe(*x[1:3]) for x in parts])))
            size += sum(len(x[2]) for x in parts)
            if size > limit:  # a long transcript: what is decided goes
                starts = before_each()
                done, role = settled(starts)
                yield from written(held[:done], starts[:done], np.where(np.arange(s) == role, 0.0, -np.inf))
                held, entry = held[done:], starts[done]
                size = sum(len(x[2]) for parts, _ in held for x in parts)
                limit = max(most, 2 * size)
        if held:
            yield from written(held, before_each(), known_after.get(pid))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(decode, ", ".join([*fields, "block int", "role string", "continues boolean", "turn_text string", *(["line int"] if by_line else [])]))
