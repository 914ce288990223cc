"""Records that go on across lines and splits: CSV values with line ends in quotes, and JSON documents.

Spark's text source deals a file out in splits and cuts it into pieces: at line
ends for CSV, behind every closing brace for JSON. Whether a piece ends a record
depends on all text before it, but only through a small state: whether a quoted
value or string is open, and for JSON how many brackets are. So a split is a map
from the state at its start to that at its end, told by one pass over all splits
at once; the maps of a file are composed in order, a few numbers a split; and a
second pass, each split starting in its true state, puts whole records together.
Only records that reach over a split's border are shuffled, in their parts. No
task holds more of a file than one batch and one record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from millrace.runtime import cut, share_code
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the text source cuts each format.
ENDS = {"csv": "\n", "json": "}"}

#: A piece's end: whether it is inside quotes, and the depth of brackets against that at the start.
Scan = Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]]


def pieces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(value, file, block): the pieces of the files below a path without their ends, in order within each split."""
    raw = spark.read.option("lineSep", ENDS[kind]).text(path)
    return raw.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted CSV value is open after a line, if one is (not) before it.

    A quote opens a value at the start of a field only; a doubled one within the
    value is a sign of it; what follows a closing quote lasts to the next comma.
    """
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            while quote >= 0 and line[quote + 1 : quote + 2] == '"':
                quote = line.find('"', quote + 2)
            if quote < 0:
                return True
            inside, at = False, line.find(",", quote + 1) + 1
        else:
            quote = line.find('"', at)
            if quote < 0:
                return False
            if quote == at or line[quote - 1] == ",":
                inside, at = True, quote + 1
                continue
            at = line.find(",", quote) + 1
        if not at:
            return False


def csv_pieces(values: pa.Array) -> list[str]:
    """Lines with their ends; a bare carriage return ends a line as well."""
    lines = [v + "\n" for v in values.to_pylist()]
    if not pc.any(pc.match_substring(values, "\r")).as_py():
        return lines
    return [part for line in lines for part in (re.findall(r"[^\r]*\r(?!\n)|[^\r]*\r?\n|[^\r]+$", line) if "\r" in line else [line])]


def csv_scan(lines: list[str], inside: bool) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty(len(lines), bool)
    for k, line in enumerate(lines):
        if '"' in line:
            inside = inside_after(line.rstrip("\r\n"), inside)
        out[k] = inside
    return out, np.zeros(len(lines), np.int64)


def json_pieces(values: pa.Array) -> list[str]:
    return [v + "}" for v in values.to_pylist()]


def json_scan(parts: list[str], inside: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    ends = np.cumsum([len(p.encode()) for p in parts]) if parts else np.zeros(0, np.int64)
    kinds = np.zeros(256, np.int8)
    kinds[[ord("{"), ord("[")]], kinds[[ord("}"), ord("]")]], kinds[ord('"')] = 1, -1, 2
    at = np.flatnonzero(kinds[raw])
    kind = kinds[raw[at]]
    quote = np.flatnonzero(kind == 2)
    behind = quote[(at[quote] > 0) & (raw[at[quote] - 1] == 92)]  # quotes behind a backslash
    if len(behind):
        plain = np.flatnonzero(raw != 92)
        before = np.searchsorted(plain, at[behind]) - 1  # the last other sign before
        run = at[behind] - 1 - np.where(before >= 0, plain[before], -1)
        kind = kind.copy()
        kind[behind[run % 2 == 1]] = 0
    open_ = (np.cumsum(kind == 2) + inside) % 2 == 1
    depth = np.cumsum(np.where(open_ | (kind == 2), 0, kind))
    last = np.searchsorted(at, ends) - 1  # a piece's brace itself is the last sign before its end
    return open_[last] if len(last) else np.zeros(0, bool), depth[last].astype(np.int64) if len(last) else np.zeros(0, np.int64)


FORMATS: dict[str, tuple[Callable[[pa.Array], list[str]], Scan]] = {"csv": (csv_pieces, csv_scan), "json": (json_pieces, json_scan)}

_NEVER = 1 << 40
_SPLIT = "file long, block long, end0 int, end1 int, delta0 long, delta1 long, least0 long, least1 long, base long"


def runs(batches: Iterator[pa.RecordBatch], fixed: int) -> Iterator[tuple[tuple, pa.Array]]:
    """(key, values) for every stretch of rows of a split within a batch; key: the values of the next ``fixed`` columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            yield tuple(batch.column(j)[a].as_py() for j in range(1, 1 + fixed)), batch.column(0).slice(a, b - a)


def measure(cuts: DataFrame, kind: str) -> DataFrame:
    """Each split as a map: its end state and change of depth for either state at its start, the least depth at which a piece but the last ends outside quotes."""
    split, scan = FORMATS[kind]

    def row(key: tuple, state: list, delta: list, least: list, base: int) -> pa.RecordBatch:
        values = [*key, int(state[0]), int(state[1]), *delta, *least, base]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 5, strict=True)], names=[f.split()[0] for f in _SPLIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for key, values in runs(batches, 2):
            if key != now:
                if now is not None:
                    yield row(now, state, delta, least, base)
                now, state, delta, least, last = key, [False, True], [0, 0], [_NEVER, _NEVER], [_NEVER, _NEVER]
                base = int(kind == "json" and key[1] == 0 and (values[0].as_py() or "").lstrip("\ufeff \t\r\n").startswith("["))
            parts = split(values)
            for s in (0, 1):
                inside, depth = scan(parts, state[s])
                least[s] = min(least[s], last[s], int((depth[:-1][~inside[:-1]] + delta[s]).min(initial=_NEVER)))
                last[s] = _NEVER if inside[-1] else int(depth[-1]) + delta[s]
                state[s], delta[s] = bool(inside[-1]), delta[s] + int(depth[-1])
        if now is not None:
            yield row(now, state, delta, least, base)

    return cuts.mapInArrow(run, _SPLIT)


_START = "file long, block long, inside boolean, depth long, base long, owner long"


def starts(splits: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of one file, and the split (owner) in which the record that is open there began; -1: none is open."""
    out, inside, depth, begun = [], 0, 0, -1
    splits = splits.sort_values("block")
    base = int(splits["base"].iloc[0])
    for k, r in enumerate(splits.itertuples(index=False)):
        whole = k == 0 or not inside and depth == base
        out.append((r.file, r.block, bool(inside), depth, base, -1 if whole else begun))
        if whole or depth + (r.least1 if inside else r.least0) == base:
            begun = r.block
        inside, depth = (r.end1, depth + r.delta1) if inside else (r.end0, depth + r.delta0)
    return pd.DataFrame(out, columns=[f.split()[0] for f in _START.split(", ")])


_RECORD = "text string, first boolean, file long, owner long, place long"


def gather(cuts: DataFrame, kind: str, parts: bool) -> DataFrame:
    """Whole records of each split, or only the parts of those that reach over its borders.

    parts: (file, owner) name a record by where it began, and places order its parts.
    """
    split, scan = FORMATS[kind]

    def put(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[f.split()[0] for f in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, owner, base, first = None, [], -1, 0, False

        def rest() -> list[tuple]:
            file, block = now[:2]
            return [("".join(held), first, file, block if owner < 0 else owner, block)] if held and parts else []

        for key, values in runs(batches, 6):
            if key[:2] != (now or ())[:2]:
                if now is not None and (left := rest()):
                    yield put(left)
                now, held = key, []
                _, block, inside, depth, base, owner = key
                first = block == 0
            texts = split(values)
            open_, at = scan(texts, inside)
            ends = np.flatnonzero(~open_ & (at + depth == base)).tolist()
            rows, begin = [], 0
            for end in ends:
                text = "".join([*held, *texts[begin : end + 1]])
                held, begin = [], end + 1
                if owner >= 0:
                    if parts:
                        rows.append((text, first, key[0], owner, key[1]))
                    owner = -1
                elif text.strip():
                    if not parts:
                        rows.append((text, first, None, None, None))
                    first = False
            held += texts[begin:]
            inside, depth = bool(open_[-1]), depth + int(at[-1])
            if rows:
                yield put(rows)
        if now is not None and (left := rest()):
            yield put(left)

    return cuts.select("value", "file", "block", "inside", "depth", "base", "owner").mapInArrow(run, _RECORD)


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(text, first): every record of the files below a path; first: whether it is the first of its file. Those that reach over a split's border come last.

    Splits are known by broadcast: a row a split of spark.sql.files.maxPartitionBytes, so a hundred bytes for each such split of the input.
    """
    share_code(spark)
    cuts = pieces(spark, path, kind)
    known = cut(measure(cuts, kind).groupBy("file").applyInPandas(starts, _START))  # a row of numbers a split
    placed = cuts.join(F.broadcast(known), ["file", "block"])
    over = gather(placed, kind, True).groupBy("file", "owner").agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    joined = cut(over.select(F.array_join(F.col("parts.text"), "").alias("text"), "first"))
    return gather(placed, kind, False).select("text", "first").unionByName(joined.filter(F.trim("text") != ""))
