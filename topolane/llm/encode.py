"""Encoding a corpus with a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged, so a text may be cut between such two
bytes, its fragments encoded on their own and the ids put together again. The fragments are mostly single words, so each
worker keeps the ids of those it met (bounded by CACHE entries) and encodes a word once, not once an occurrence.

Cuts are taken only where the pre-tokenizer cannot notice them: at a character boundary, not after white space (a run of
blanks is divided by what follows it) and not before an apostrophe (it opens contractions only at the start of a match).

Cases: null and empty texts give an empty list (count 0); special-token strings are ordinary text; unpaired surrogates
cannot occur in Spark strings; texts of any length are encoded whole, in their row; extra columns are carried along.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 400_000


def default_vocab() -> str:
    """Path of the 50k vocabulary; TOPOLANE_VOCAB overrides the installed package's file."""
    if named := os.environ.get("TOPOLANE_VOCAB"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Vocabulary, table of byte pairs inside tokens, and cache of one worker process."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("topolane", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        inside = np.zeros(65536, dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[(b[:-1] << 8) | b[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        blank = ((left >= 9) & (left <= 13)) | ((left >= 28) & (left <= 32))
        allowed = ~inside & ~blank & (right != 0x27) & ((right < 0x80) | (right >= 0xC0))
        self.cut_ascii = allowed & (left < 0x80)
        # After a character of several bytes a cut is left out if it might be white space (see cuts).
        self.cut_wide = allowed & (left >= 0x80)
        self.seen: dict[bytes, list[int]] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def cuts(self, data: bytes) -> np.ndarray:
        """Ascending positions at which the bytes may be cut."""
        b = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        if len(b) < 2:
            return np.zeros(0, dtype=np.int64)
        pair = (b[:-1] << 8) | b[1:]
        ok = self.cut_ascii[pair]
        wide = np.flatnonzero(self.cut_wide[pair])
        if len(wide):
            # Leads of wide white space: C2 (85, A0), E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80.
            one, two, here = b[np.maximum(wide - 1, 0)], b[np.maximum(wide - 2, 0)], b[wide]
            white = ((one == 0xC2) & ((here == 0x85) | (here == 0xA0))) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE3) & (one == 0x80))
            ok[wide[~white]] = True
        return np.flatnonzero(ok) + 1

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        seen, out, a = self.seen, [], 0
        for z in [*self.cuts(data).tolist(), len(data)]:
            part = data[a:z]
            got = seen.get(part)
            if got is None:
                if len(seen) >= CACHE:
                    seen.clear()
                got = self.plain(part.decode("utf-8", "surrogatepass"))
                if len(part) <= 64:
                    seen[part] = got
            out += got
            a = z
        return out


def encode(text: Column, vocab: str | None = None) -> Column:
    """ids (array of int) of each text."""
    path = vocab or default_vocab()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        e = Encoder.get(path)
        values, ends, n = [], [0], 0
        for t in texts:
            got = e.ids(t.as_py())
            values.append(np.asarray(got, dtype=np.int32))
            n += len(got)
            ends.append(n)
        flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def count_tokens(text: Column, vocab: str | None = None) -> Column:
    """Number of ids of each text; 0 for null and empty."""
    path = vocab or default_vocab()

    @F.arrow_udf(T.LongType())
    def n(texts: pa.Array) -> pa.Array:
        e = Encoder.get(path)
        return pa.array([len(e.ids(t.as_py())) for t in texts], pa.int64())

    return n(text)


def decoder(path: str | None = None) -> Callable[[list[int]], str]:
    """ids to text, for round trips."""
    with open(path or default_vocab(), "rb") as f:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return lambda ids: b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
