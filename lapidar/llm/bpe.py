"""Token ids of a public byte-level BPE tokenizer for a whole corpus (problem 6).

Each block of texts is cut into pre-tokens by the tokenizer's pattern; the distinct ones not met
before are encoded together. A pair occurrence index maps each mergeable pair to all its positions
in the block; a heap gives the active ranks in ascending order, the pair of that rank is merged at
all its positions from left to right, and only the lists of the pairs beside a merge are updated.
Pre-tokens never touch in the index, so one order of ranks serves them all.

The work is narrow: no shuffle, one pass, memory bounded by the block size and the cache size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BLOCK_CHARS = 4_000_000
CACHE_WORDS = 300_000

# The tokenizer's published pattern, its white space spelt out as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class Vocabulary:
    """Ranks of a byte-level BPE, by the bytes of each token. A pair may be merged if its joined bytes are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def merged(self, a: int, b: int) -> int:
        """The id of the joined pair, or -1."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return got


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_block(words: list[bytes], voc: Vocabulary) -> list[list[int]]:
    """Ids of each word; all words of the block share one pair occurrence index."""
    if not words:
        return []
    sym: list[int] = []
    starts = []
    for w in words:
        starts.append(len(sym))
        sym.extend(map(voc.byte.__getitem__, w))
        sym.append(-1)  # a wall that no pair crosses
    n = len(sym)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merged = voc.merged
    index: dict[int, list[int]] = {}
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0 and (r := merged(sym[i], sym[i + 1])) >= 0:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        places = index.pop(r, None)
        if not places:
            continue
        places.sort()
        for i in places:
            a = sym[i]
            if a < 0:
                continue
            j = after[i]
            b = sym[j]
            if b < 0 or merged(a, b) != r:
                continue  # an earlier merge took one of the two
            sym[i], sym[j] = r, -2
            k = after[i] = after[j]
            before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and sym[left] >= 0 and sym[right] >= 0 and (q := merged(sym[left], sym[right])) >= 0:
                    if q in index:
                        index[q].append(left)
                    else:
                        index[q] = [left]
                        heapq.heappush(active, q)
    ends = [*starts[1:], n]
    return [[s for s in sym[a : b - 1] if s >= 0] for a, b in zip(starts, ends, strict=True)]


def encoder(path: str):
    """A function on lists of texts; words once encoded are remembered, up to CACHE_WORDS of them."""
    voc, cut, known = vocabulary(path), regex.compile(PATTERN).findall, {}

    def encode(texts: list[str | None]) -> list[list[int]]:
        pieces = [cut(t) if t else [] for t in texts]
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = list(set(chain.from_iterable(pieces)).difference(known))
        known.update(zip(fresh, encode_block([w.encode("utf-8", "surrogatepass") for w in fresh], voc), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]

    return encode


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    """Runs of whole texts of about so many characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t or "")
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>), one row per row of df; an empty list where the text is null or empty.

    The text is encoded as it stands, without special tokens; their strings in a text are ordinary
    text. Repeated rows give repeated rows; a null key stays null.
    """
    path = f"{folder}/{tokenizer}.tiktoken"
    chosen = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at = 0
            for part in blocks(batch.column(1).to_pylist()):
                ids = encode(part)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])
                at += len(part)

    return chosen.mapInArrow(run, f"{key} {dict(chosen.dtypes)[key]}, ids array<int>")
