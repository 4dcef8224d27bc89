"""Problem 6: ids of a public byte-level BPE vocabulary for whole corpora, by forced-boundary splitting.

A merge joins two neighbouring byte strings into a token of the vocabulary. Two neighbouring bytes that stand
side by side in no token can therefore never come to lie in one token: the boundary between them is certain.
Each pre-token is cut at these boundaries, the fragments are encoded on their own (and remembered: after the
cuts there are few different ones, above all in texts outside the Latin script), and the ids are concatenated.

Defined results: a null or empty text has the empty list; strings that look like special tokens are ordinary
text; blank texts are encoded as they are; equal rows have equal lists; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table, tokenizer_path

#: The vocabulary's rule for splitting text before merges.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers at most, and the longest pre-token that it remembers.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48

_encoders: dict[str, ForcedBoundaryEncoder] = {}


class ForcedBoundaryEncoder:
    """Encodes text with one vocabulary, given as the bytes of its rank file."""

    def __init__(self, rank_file: bytes) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.pretokens: Callable[[str], list[str]] = regex.compile(PRETOKEN_PATTERN).findall
        self.encode_fragment = tiktoken.Encoding("forced", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                codes = np.frombuffer(token, dtype=np.uint8)
                joined[codes[:-1], codes[1:]] = True
        self.joined = joined
        self.known: dict[str, list[int]] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[int]:
        """Positions in ``piece`` that no token can span."""
        codes = np.frombuffer(piece, dtype=np.uint8)
        return (np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist()

    def encode_pretoken(self, pretoken: str) -> list[int]:
        piece = pretoken.encode()
        ends = [*self.cuts(piece), len(piece)]
        ids: list[int] = []
        begin = 0
        for end in ends:
            fragment = piece[begin:end]
            begin = end
            known = self.fragments.get(fragment)
            if known is None:
                known = self.encode_fragment(fragment)
                if len(fragment) <= 4 * CACHE_CHARS:
                    if len(self.fragments) >= CACHE_ENTRIES:
                        self.fragments.clear()
                    self.fragments[fragment] = known
            ids += known
        return ids

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for pretoken in self.pretokens(text):
            found = known.get(pretoken)
            if found is None:
                found = self.encode_pretoken(pretoken)
                if len(pretoken) <= CACHE_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[pretoken] = found
            ids += found
        return ids


def _encoder(key: str, rank_file: Broadcast) -> ForcedBoundaryEncoder:
    """The worker's encoder of a rank file, kept between tasks."""
    if key not in _encoders:
        _encoders[key] = ForcedBoundaryEncoder(rank_file.value)
    return _encoders[key]


def encoder_udf(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str | None = None, *, lengths: bool = False) -> Callable[[Column], Column]:
    """A column function text -> ids (array<int>), or -> number of ids (int) with ``lengths``.

    The rank file (under 1 MB, a fixed size) reaches the workers as a broadcast variable.
    """
    with open(tokenizer_path(f"{vocabulary}.tiktoken", folder), "rb") as file:
        content = file.read()
    shared, key = spark.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    if lengths:

        @F.arrow_udf("int")
        def count_ids(texts: pa.Array) -> pa.Array:
            encode = _encoder(key, shared).encode
            return pa.array([len(encode(t.as_py() or "")) for t in texts], type=pa.int32())

        return count_ids

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        encode = _encoder(key, shared).encode
        parts, offsets, total = [], [0], 0
        for text in texts:
            ids = encode(text.as_py() or "")
            parts.append(np.array(ids, dtype=np.int32))
            total += len(ids)
            offsets.append(total)
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))

    return ids_of


def encode_texts(df: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``df`` with the ids of column ``text``, without special tokens, in a further column."""
    return df.withColumn(into, encoder_udf(df.sparkSession, vocabulary, folder)(F.col(text)))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(documents).select("doc_id", "ids")
