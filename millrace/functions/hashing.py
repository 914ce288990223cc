"""Row hashes, sampling priorities, shingles and MinHash signatures as SQL expressions, and the buckets of many sets in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE, HASHES, BANDS = 5, 64, 16
#: Shingles whose hashes a task keeps.
KEPT = 1 << 18


def row_hash(columns: list[Column]) -> Column:
    """md5 of the columns as text, each with its length, and of null as of no text: rows that differ in any cell have different texts."""
    cells = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*cells) if cells else F.lit(""))


def joined_hash(columns: list[Column]) -> Column:
    """md5 of the columns as text, joined by a bar, null as "nan": a form that other tools share, in which ("a|b", "c") and ("a", "b|c") are one row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns]))


def content_hash(df, exclude: tuple[str, ...] = ("id",)) -> Column:
    """md5 of a row as JSON with sorted keys, the named columns left out in any case."""
    names = sorted(c for c in df.columns if c.lower() not in exclude)
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}))


def priority(salt: Column, row_id: Column) -> Column:
    """A row's place in a deterministic sample: 16 hex digits, whose order is that of unsigned numbers."""
    return F.substring(F.sha2(F.concat(salt, F.lit("|"), row_id.cast("string")), 256), 1, 16)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """The distinct k-character windows of the lower-case text; none for shorter texts."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: i <= n - (k - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.lower(text), i, F.lit(k))))


def minhash(shingle_set: Column, hashes: int = HASHES, family: str = "sha256") -> Column:
    """For each seed the smallest hash of the set, as unsigned decimal text; zeros for an empty set.

    family: sha256 for signatures that other engines share, xxhash64 for others
    of the same worth at a fraction of the time.
    """
    if family not in ("sha256", "xxhash64"):
        raise ValueError(f"unknown hash family: {family}")

    def of(sh: Column) -> Column:
        def least(seed: Column) -> Column:
            if family == "xxhash64":
                return F.coalesce(F.conv(F.hex(F.array_min(F.transform(sh, lambda x: F.xxhash64(x, seed)))), 16, 10), F.lit("0"))
            hexes = F.transform(sh, lambda x: F.substring(F.sha2(F.concat(x, F.lit("|"), seed.cast("string")), 256), 1, 16))
            return F.coalesce(F.conv(F.array_min(hexes), 16, 10), F.lit("0"))

        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), least)

    return _bound(shingle_set, of)


def lsh_buckets(signature: Column, bands: int = BANDS, hashes: int = HASHES) -> Column:
    """A key for each band of the signature; one for the whole if there are fewer hashes than bands."""
    rows = hashes // bands
    if not rows:
        return F.array(F.md5(F.concat(F.lit("["), F.array_join(signature, ", "), F.lit("]"))))
    return _bound(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.md5(F.concat(F.lit("["), F.array_join(F.slice(s, b * rows + 1, F.lit(rows)), ", "), F.lit("]")))))


def bucket_key(signature: Column, n: int = 100) -> Column:
    """The coarse bucket of a signature's first hash."""
    return F.concat(F.lit("bucket_"), F.pmod(signature[0].cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int").cast("string"))


def sha256_buckets(shingle_set: Column, bands: int = BANDS, hashes: int = HASHES) -> Column:
    """lsh_buckets(minhash(shingle_set)) of sets that aren't empty; a task hashes a shingle that it keeps once, not once for each set."""
    rows = hashes // bands
    seeds = [f"|{k}".encode() for k in range(hashes)]

    def of(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        table = np.zeros((KEPT, hashes), np.uint64)

        def hashed(x: str) -> np.ndarray:
            own = x.encode()
            return np.frombuffer(b"".join(hashlib.sha256(own + seed).digest()[:8] for seed in seeds), ">u8")

        def keys(members) -> list | None:
            if members is None or not len(members):
                return None
            if len(known) + len(members) > KEPT:
                known.clear()
            least = np.full(hashes, ~np.uint64(0))
            at = []
            for x in members:
                if x not in known and len(known) < KEPT:
                    table[len(known)] = hashed(x)
                    known[x] = len(known)
                if x in known:
                    at.append(known[x])
                else:  # a set of more shingles than are kept
                    least = np.minimum(least, hashed(x))
            signature = np.minimum(least, table[at].min(0)).tolist()
            return [hashlib.md5(f"[{', '.join(map(str, signature[b * rows : b * rows + rows]))}]".encode()).hexdigest() for b in range(bands)]

        for batch in sets:
            yield pd.Series([keys(members) for members in batch], dtype=object)

    return F.pandas_udf(of, "array<string>")(shingle_set)
