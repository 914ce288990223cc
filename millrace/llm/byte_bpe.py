"""Byte-level BPE: ids by the tiktoken library from a local rank file, bytes back from ids.

Long texts are cut at safe boundaries before they are encoded: the pre-split
pattern matches either runs that end before white space or runs of white
space, so no match crosses a point between a non-space and a following space,
and the pieces give the ids of the whole text. A very long run of white space,
on which the library's regular expressions fail, is one match of the pattern
but for its last code point, which belongs to what follows, so its bytes are
merged without the pattern. Decoding joins the raw bytes of
the ids and never goes through text, so a token that ends inside a character is
no special case.

Defined cases: a null text counts as empty and has no tokens; special strings
are ordinary text; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.arrow import kept, map_batches, slices, texts_of
from pyspark.sql import DataFrame

#: Code points after which a long text is cut at the next safe boundary.
PIECE = 50_000

# Code points that are white space in Unicode; Python's own class holds four more.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    def encode(self, text: str) -> np.ndarray:
        parts = [self._match(p) if one else self._encoding.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p, one in pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _match(self, text: str) -> np.ndarray:
        """The ids of one match of the pattern."""
        return np.array(self._encoding._encode_single_piece(text), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


def pieces(text: str, size: int = PIECE) -> list[tuple[str, bool]]:
    """The text cut at the first safe boundary after each size code points, and whether a part is one match, a very long run of white space."""
    if len(text) <= size:
        return [(text, False)]
    out, start = [], 0
    for run in re.finditer(f"[{_SPACE}]{{{size},}}", text):
        end = run.end() - (run.end() < len(text))  # the last one goes with what follows
        out += [(p, False) for p in _cut(text, start, run.start(), size)]
        out.append((text[run.start() : end], True))
        start = end
    return out + [(p, False) for p in _cut(text, start, len(text), size)]


def _cut(text: str, start: int, stop: int, size: int) -> Iterator[str]:
    while start < stop:
        cut = _SAFE.search(text, min(start + size, stop), stop)
        end = cut.start() if cut else stop
        yield text[start:end]
        start = end


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    path, pattern = path or rank_file(), pattern or public_tokenizers.PATTERN
    return kept(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """digests, and the ids themselves as an array of int."""
    return _run(docs, id_col, text_col, path, True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each text, from the ids and the bytes decoded from them."""
    return _run(docs, id_col, text_col, path, False)


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, 1):
            n, ids_hex, text_hex, all_ids = [], [], [], [np.empty(0, np.uint32)]
            for text in texts_of(batch.column(1)):
                ids = own.encode(text)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = {"_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(all_ids).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = map_batches(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), run, schema)
    return out.withColumnRenamed("_id", id_col)


def op6_byte_bpe(spark, sf_dir):
    from millrace.runtime import table

    return digests(table(spark, sf_dir, "documents"))
