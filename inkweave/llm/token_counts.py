"""Operator 12, token counts: byte-pair merging with a heap over a linked list of symbols.

A text's symbols are its characters, with spaces written as U+2581 and one more in front. A heap holds the adjacent
pairs that are pieces of the vocabulary, by rank and then place. The lowest is popped and merged, its neighbours are
linked to the merged symbol and looked up in turn; a popped pair that no longer stands is passed over. The count is
symbols minus merges, where a symbol outside the vocabulary counts as its UTF-8 bytes. No identifiers are made.

Two symbols merge only into a piece, so a text falls apart, without any change of the count, wherever no piece could
span: before each U+2581 that follows another character, around ASCII characters that stand in no piece of several
characters, and between characters that no chain of pieces links (letters and ASCII punctuation, say). All three are
read off the vocabulary. Segments are counted by themselves, and counts of short ones are kept: at most `KEEP`
segments of at most 48 characters in a worker.

The vocabulary (the pieces and scores of a sentencepiece model of kind BPE with byte fallback) is read by the driver
and broadcast; a file of over `MOST_BYTES` is refused. Scan, count and write need no shuffle.

Cases: null and empty texts have no bytes and no tokens; repeated rows and doc_ids are counted each; null doc_ids stay;
an empty table gives an empty result; extra columns are ignored. A text's memory is a small multiple of its size.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import documents

SPACE = "▁"
MOST_BYTES = 16 << 20
KEEP, KEEP_CHARS = 1 << 19, 48
LIMIT = 4096
#: Kinds of pieces in the model file: text merges into normal, user-defined and unused ones.
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5


@dataclass(frozen=True)
class Vocabulary:
    """ranks: piece to rank (0 merges first, equal scores are equal ranks); pattern: finds the segments of a text."""

    digest: str
    ranks: dict[str, int]
    pattern: str


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece BPE model without normalisation rules, user-defined or unused pieces."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    scores, trainer, normaliser, kinds = {}, {}, {}, set()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            kinds.add(piece.get(3, NORMAL))
            if piece.get(3, NORMAL) == NORMAL:
                scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    plain = trainer.get(3) == 2 and trainer.get(35) and not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
    if not plain or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError(f"{path} isn't a plain BPE model with byte fallback")
    place = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    ranks = {p: place[s] for p, s in scores.items()}
    return Vocabulary(hashlib.sha256(data).hexdigest(), ranks, segment_pattern(ranks))


def segment_pattern(ranks: dict[str, int]) -> str:
    """A pattern whose matches cut each text into segments that no piece reaches across."""
    several = [p for p in ranks if len(p) > 1]
    lone = {chr(c) for c in range(128)}.difference(*several)
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in several):
        return "".join(["[", *map(re.escape, sorted(lone)), "]|[^", *map(re.escape, sorted(lone)), "]+"]) if lone else "(?s:.)+"
    # characters that stand side by side in pieces are linked; the largest linked set is a class of its own
    of: dict[str, set[str]] = {}
    for piece in several:
        chars = piece.lstrip(SPACE)
        joined = set(chars)
        for c in chars:
            joined |= of.get(c, set())
        if len(chars) > 1 and any(of.get(c) is not of.get(chars[0]) or c not in of for c in chars):
            of.update(dict.fromkeys(joined, joined))
    linked = max(of.values(), key=len, default=set()) - lone
    lone_, linked_ = "".join(map(re.escape, sorted(lone))), "".join(map(re.escape, sorted(linked)))
    rest = f"[^{SPACE}{lone_}{linked_}]"
    word = f"[{linked_}]+|" if linked else ""
    return f"{SPACE}+(?:{word}{rest}*)|{word}{rest}+" + (f"|[{lone_}]" if lone else "")


def count_segment(text: str, ranks: dict[str, int]) -> int:
    """Tokens of a sequence of symbols, by heap and linked list."""
    n = len(text)
    bits = n.bit_length()
    places = (1 << bits) - 1
    symbols: list[str] = list(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, tokens = ranks.get, n
    # a heap entry is the rank and then the place of the left symbol, so equal ranks merge from the left
    heap = [r << bits | i for i, r in enumerate(map(get, map(add, symbols, symbols[1:]))) if r is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & places
        j = after[i]
        left = symbols[i]
        # an entry stands if its left symbol isn't merged away and still makes a pair of this rank with the next
        if j == n or not left:
            continue
        piece = left + symbols[j]
        if get(piece) != top >> bits:
            continue
        symbols[i] = piece
        symbols[j] = ""
        tokens -= 1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            r = get(piece + symbols[j])
            if r is not None:
                heappush(heap, r << bits | i)
        h = before[i]
        if h >= 0:
            r = get(symbols[h] + piece)
            if r is not None:
                heappush(heap, r << bits | h)
    return tokens + sum(len(s.encode()) - 1 for s in symbols if s and s not in ranks)


#: Counts of short segments by vocabulary; a worker that runs several tasks goes on with them.
_KEPT: dict[str, dict[str, int]] = {}


class Counter:
    """Counts tokens of texts; keeps the counts of short segments."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.digest not in _KEPT:
            _KEPT.clear()
        self.ranks, self.find, self.kept = vocabulary.ranks, re.compile(vocabulary.pattern).findall, _KEPT.setdefault(vocabulary.digest, {})

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        kept, total = self.kept, 0
        segments = self.find(SPACE + text.replace(" ", SPACE))
        for s, n in zip(segments, map(kept.get, segments), strict=True):
            if n is None:
                n = kept.get(s) or count_segment(s, self.ranks)
                if len(s) <= KEEP_CHARS:
                    if len(kept) >= KEEP:
                        kept.clear()
                    kept[s] = n
            total += n
        return total


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary.value)
        for b in bk.slices(batches, "text", 4 << 20):
            texts = b.column(1)
            n_bytes = bk._lengths(texts).astype(np.int64)
            n_tokens = np.fromiter((count(x.as_py()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row; path: the model file, read by the driver."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
