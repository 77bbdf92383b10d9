"""Operator 7: byte-level BPE by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import map_rows

#: Longer texts are cut before they reach the library's pattern.
PIECE_CHARS = 65_536
#: A match of the pattern that holds white space holds it at its start only, or is white space alone; so where white
#: space follows something else, one match ends and the next begins, and neither looks beyond.
SAFE = re.compile(r"(?<=\S)\s")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, read once per Python worker. No special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` code points."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE_CHARS) -> np.ndarray:
    """Token ids of a whole text as little-endian unsigned 32-bit integers."""
    got = [enc.encode_to_numpy(piece) for piece in pieces(text, size)]
    return np.asarray(got[0] if len(got) == 1 else np.concatenate(got), dtype="<u4")


def decode(ids: np.ndarray, enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of token ids; they need not be valid UTF-8 when ids are cut anywhere."""
    return enc.decode_bytes(ids.tolist())


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids (binary, little-endian unsigned 32-bit) and whole (they decode to the text) of every row.

    Null or empty text: no tokens. Null id: stays null. Equal texts: equal results. Empty table: no rows. Other columns are
    not read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoding(path, pattern)
        texts = [text or "" for text in batch.column(1).to_pylist()]
        ids = [encode(text, enc) for text in texts]
        return {id_col: batch.column(0), "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids],
                "whole": [decode(x, enc) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]}

    return map_rows(docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col]), run, f"{id_col} long,n_tokens long,ids binary,whole boolean")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256, the last from the ids alone.

    Null or empty text: 0 tokens. Equal rows: equal results. Null id: stays null. The round trip is whole for any text,
    and a lone surrogate cannot occur in a Spark string. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoding(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(text or "", enc)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(decode(ids, enc)).hexdigest())
        return {id_col: batch.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

    return map_rows(docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col]), run, f"{id_col} long,n_tokens long,ids_sha256 string,decoded_sha256 string")
