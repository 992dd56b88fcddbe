"""Corpus documents that hold evaluation passages, whole or in part (problem 7).

Latent semantic retrieval: all texts become lists of hashed words under a normal form that undoes
typography (case, accents, ligatures, punctuation, soft and line-end hyphens, quotation prefixes).
TF-IDF passages of WINDOW words over all documents are factorised by a distributed randomised SVD
(Nyström form: one pass for the product of the passages' Gram matrix with a random block; the rest
is algebra on a FEATURES x RANK block). The latent axes are scaled to equal variance, or else a few
broad topics would make all passages alike. The items' passages are kept in lists around centroids;
passages of every document look into the lists nearest to them, and all passages there that are near
enough by cosine are candidates. Each is verified by word alignment: a continuous passage of the item
in the longest common subsequence sense, with few words changed, dropped or added. A looser paraphrase
must keep the words that answer for the item, the rarest of the passage.

Items are searched in blocks of ITEM_BLOCK; only a block and matrices of fixed size are broadcast.
Every document is searched, whole; there is no cap on candidates.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidar.runtime import Scratch

WINDOW = 20
PIECE = 4
DOC_STRIDE = 8
ITEM_STRIDE = 4
FEATURES = 1 << 15
RANK = 96
ITEM_BLOCK = 10_000
PROBE_SHARE = 8
"""A passage looks into one list of passages in so many, the nearest ones, and at least PROBES."""
PROBES = 4
COSINE = 0.8
"""Passages at least so similar in the latent space are candidates."""
SHARE = 0.45
"""Least part of an item's words that a passage must span; half of them by any other way of counting words."""
MATCH = 0.82
"""Least part of the spanned words that are the same."""
PARAPHRASE = 0.72
"""The same where all answer words are: the rarest ANSWERS of the spanned words."""
ANSWERS = 0.25
BLOCK_WORDS = 60_000

_HYPHEN = regex.compile(r"(?<=\p{L})[-­‐‑][ \t]*(?:\r\n|[\n\r ])[\s>|]*(?=\p{L})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]")


def words(text: str | None) -> list[str]:
    """The words of a text in normal form."""
    if not text:
        return []
    plain = _HYPHEN.sub("", unicodedata.normalize("NFKC", text)).casefold()
    if not plain.isascii():
        plain = _MARKS.sub("", unicodedata.normalize("NFD", plain))
    return _WORD.findall(plain)


def _hashed(texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    known: dict[str, int] = {}
    for t in texts:
        w = words(t)
        if len(known) > 500_000:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = zlib.crc32(x.encode("utf-8", "replace")) - (1 << 31)
        yield np.fromiter(map(known.__getitem__, w), np.int32, len(w))


def word_table(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, w array<int>): the hashed words of each row's text."""
    chosen = df.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = list(_hashed(x.as_py() for x in b.column(1)))
            ends = np.cumsum([0] + [len(x) for x in lists])
            i = 0
            while i < len(lists):
                j = min(max(int(np.searchsorted(ends, ends[i] + 8 * BLOCK_WORDS, "right")) - 1, i + 1), len(lists))
                flat, offsets = np.concatenate(lists[i:j]), (ends[i : j + 1] - ends[i]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "w"])
                i = j

    return chosen.mapInArrow(run, f"{key} {dict(chosen.dtypes)[key]}, w array<int>")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, flat words, offsets) of runs of rows of about BLOCK_WORDS words."""
    for b in batches:
        col = b.column(1)
        ends = col.offsets.to_numpy() - col.offsets[0].as_py()
        flat = col.flatten().to_numpy()
        i = 0
        while i < len(col):
            j = min(max(int(np.searchsorted(ends, ends[i] + BLOCK_WORDS, "right")) - 1, i + 1), len(col))
            yield b.column(0).slice(i, j - i), flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            i = j


def _windows(offsets: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of passages: every stride words one of WINDOW words, in whole pieces of PIECE words; the last one reaches the row's end."""
    length = np.diff(offsets)
    pieces = -(-length // PIECE)
    last = np.maximum(pieces - WINDOW // PIECE, 0)
    n = np.where(length == 0, 0, -(-last * PIECE // stride) + 1)
    row = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + np.minimum(k * stride, last[row] * PIECE)
    return row, start, np.minimum(start + WINDOW, offsets[row + 1])


def _sums(table: np.ndarray, f: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of table's rows f over passages [start, end), put together from sums over pieces. The table's last row is zero."""
    if not len(start):
        return np.zeros((0, table.shape[1]), np.float32)
    pieces = -(-np.diff(offsets) // PIECE)
    base = np.cumsum(pieces) - pieces
    row = np.repeat(np.arange(len(pieces)), pieces)
    first = offsets[row] + (np.arange(len(row)) - base[row]) * PIECE
    stop = np.minimum(first + PIECE, offsets[row + 1])
    sums = table[f[first]]
    for j in range(1, PIECE):
        sums += table[np.where(first + j < stop, f[np.minimum(first + j, len(f) - 1)], len(table) - 1)]
    at = np.searchsorted(first, start)
    out = sums[at]
    for w in range(1, WINDOW // PIECE):
        more = start + w * PIECE < end
        if more.all():
            out += sums[at + w]
        else:
            out[more] += sums[at[more] + w]
    return out


def _added(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all partitions of a float64 vector of fixed size, added up in blocks by the executors."""
    step = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = make(_lists(batches)).astype(np.float32)
        parts = [(i, v[i : i + step].tobytes()) for i in range(0, size, step)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["at", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in pdf.columns if c != "v"} | {"v": [np.sum([np.frombuffer(x, np.float32) for x in pdf["v"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})

    # partial sums for a thousand groups of partitions, then for a few, so that no task gets one block of every partition
    parts = df.mapInArrow(run, "at bigint, v binary").withColumn("g", F.spark_partition_id())
    for groups in (1024, 32) if df.sparkSession.sparkContext.defaultParallelism > 32 else (32,):
        parts = parts.withColumn("g", F.pmod("g", F.lit(groups))).groupBy("at", "g").applyInPandas(lambda p: add(p), "at bigint, g int, v binary")
    out = np.zeros(size)
    for row in parts.drop("g").groupBy("at").applyInPandas(add, "at bigint, v binary").collect():
        out[row.at : row.at + step] = np.frombuffer(row.v, np.float32)
    return out


def _with_zero(x: np.ndarray) -> np.ndarray:
    return np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)


def fit(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """IDF of the features, and FEATURES + 1 x RANK float32: IDF times right singular vectors of the TF-IDF passages of all rows of table (key, w), each over its singular value; the last row is zero."""

    def frequencies(lists) -> np.ndarray:
        v = np.zeros(FEATURES + 1)
        for _, flat, offsets in lists:
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            seen = np.unique(row.astype(np.int64) * FEATURES + (flat & (FEATURES - 1)))
            v[:FEATURES] += np.bincount(seen % FEATURES, minlength=FEATURES)
            v[FEATURES] += len(offsets) - 1
        return v

    df = _added(table, frequencies, FEATURES + 1)
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES]))
    omega = np.random.default_rng(7).standard_normal((FEATURES, RANK))
    seed = table.sparkSession.sparkContext.broadcast(_with_zero(idf[:, None] * omega))

    def product(lists) -> np.ndarray:
        out = np.zeros((FEATURES, RANK))
        for _, flat, offsets in lists:
            f = flat & (FEATURES - 1)
            row, start, end = _windows(offsets, WINDOW)
            y = _sums(seed.value, f, offsets, start, end)
            # passages here overlap only at a row's end; each word takes part in the last passage that holds it
            owner = np.zeros(len(f), np.int64)
            owner[start] = np.arange(len(start))
            owner = np.maximum.accumulate(owner)
            order = np.argsort(f, kind="stable")
            at, first = np.unique(f[order], return_index=True)
            if len(at):
                out[at] += np.add.reduceat(y[owner[order]], first, axis=0)
        return out.ravel()

    z = _added(table, product, FEATURES * RANK).reshape(FEATURES, RANK) * idf[:, None]
    # Nyström: Gram ~ z (omega' z)^-1 z'
    c = omega.T @ z
    c = (c + c.T) / 2
    w, u = np.linalg.eigh(c)
    keep = w > max(w.max(), 0) * 1e-9
    if not keep.any():
        return idf, _with_zero(np.zeros((FEATURES, RANK)))
    b = z @ u[:, keep] / np.sqrt(w[keep])
    v, s, _ = np.linalg.svd(b, full_matrices=False)
    some = s > s[0] * 1e-6
    return idf, _with_zero(idf[:, None] * v[:, some] / s[some])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def best_scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Local alignment score of each pair (1 for a match, -1 for a change, drop or addition), all pairs side by side."""
    m, n = max(map(len, a)), max(map(len, b))
    left = np.full((len(a), m), 1 << 40, np.int64)
    right = np.full((len(b), n), 1 << 41, np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    h = np.zeros((len(a), m + 1), np.int16)
    best = np.zeros(len(a), np.int16)
    ramp = np.arange(m + 1, dtype=np.int16)
    for j in range(n):
        t = np.maximum(h - 1, 0)
        np.maximum(t[:, 1:], h[:, :-1] + np.where(left == right[:, j : j + 1], 1, -1).astype(np.int16), out=t[:, 1:])
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        np.maximum(best, h.max(axis=1), out=best)
    return best


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(start, end, matches) of the span of a in its best local alignment with b; matches says for each word of the span whether it is matched."""
    m, n = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1)
    for j in range(1, n + 1):
        t = np.maximum(h[j - 1] - 1, 0)
        t[1:] = np.maximum(t[1:], h[j - 1, :-1] + np.where(a == b[j - 1], 1, -1))
        h[j] = np.maximum.accumulate(t + ramp) - ramp
    j, i = np.unravel_index(h.argmax(), h.shape)
    end, matches = i, np.zeros(m, bool)
    while i > 0 and j > 0 and h[j, i] > 0:
        if a[i - 1] == b[j - 1] and h[j, i] == h[j - 1, i - 1] + 1:
            i, j = i - 1, j - 1
            matches[i] = True
        elif h[j, i] == h[j - 1, i - 1] - 1:
            i, j = i - 1, j - 1
        elif h[j, i] == h[j - 1, i] - 1:
            j -= 1
        else:
            i -= 1
    return int(i), int(end), matches[i:end]


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k directions among the rows of x by a few rounds of spherical k-means; seeded, so that all runs agree."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(6):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = _unit(np.where(np.bincount(own, minlength=k)[:, None] > 0, total, c))
    return c


class Items:
    """The items' words, what each word weighs, and their passages in the latent space, in lists around centroids."""

    def __init__(self, ids: list[int], lists: list[np.ndarray], idf: np.ndarray, latent: np.ndarray):
        self.ids, self.words = ids, lists
        self.weights = [idf[x & (FEATURES - 1)] for x in lists]
        offsets = np.cumsum([0] + [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        row, start, end = _windows(offsets, ITEM_STRIDE)
        passages = _unit(_sums(latent, flat & (FEATURES - 1), offsets, start, end)) if len(flat) else np.zeros((0, latent.shape[1]), np.float32)
        k = max(1, int(np.sqrt(len(passages))))
        self.centroids = _centroids(passages, k) if len(passages) else passages
        self.probes = min(k, max(PROBES, k // PROBE_SHARE))
        own = (passages @ self.centroids.T).argmax(axis=1) if len(passages) else np.zeros(0, np.int64)
        order = np.argsort(own, kind="stable")
        self.passages, self.of = passages[order], row[order]
        self.ends = np.searchsorted(own[order], np.arange(k + 1))


def least_score(n: int) -> float:
    """What a passage must score in alignment with an item of n words."""
    return SHARE * (2 * PARAPHRASE - 1) * n - 2


def accepted(item: np.ndarray, weight: np.ndarray, part: np.ndarray) -> tuple[float, float, float] | None:
    """(share, matched, answers) of the best alignment of an item with a stretch of words, if it is a leak."""
    i, j, hit = aligned(item, part)
    if j - i < SHARE * len(item):
        return None
    same = float(hit.mean())
    rare = weight[i:j] >= np.sort(weight[i:j])[-max(1, int(ANSWERS * (j - i)))]
    answers = float(hit[rare].mean())
    return ((j - i) / len(item), same, answers) if same >= MATCH or (same >= PARAPHRASE and answers == 1.0) else None


def candidates(items: Items, latent: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item) → the stretch of words between the first and last candidate passage."""
    row, start, end = _windows(offsets, DOC_STRIDE)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(row) or not len(items.passages):
        return out
    docs = _unit(_sums(latent, flat & (FEATURES - 1), offsets, start, end))
    for at in range(0, len(docs), 4000):
        some = docs[at : at + 4000]
        near = some @ items.centroids.T
        k = near.shape[1] - items.probes
        probed = near >= np.partition(near, k, axis=1)[:, k : k + 1]
        hits = []
        for c in np.flatnonzero(probed.any(axis=0)):
            rows, (a, z) = np.flatnonzero(probed[:, c]), items.ends[c : c + 2]
            x, q = np.nonzero(some[rows] @ items.passages[a:z].T >= COSINE)
            hits.append((rows[x] + at, q + a))
        i, q = (np.concatenate([h[n] for h in hits]) for n in (0, 1))
        if not len(i):
            continue
        key = row[i].astype(np.int64) * len(items.ids) + items.of[q]
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        for k, a, z in zip(key[first].tolist(), np.minimum.reduceat(start[i], first).tolist(), np.maximum.reduceat(end[i], first).tolist(), strict=True):
            pair = divmod(k, len(items.ids))
            old = out.get(pair)
            out[pair] = (min(a, old[0]), max(z, old[1])) if old else (a, z)
    return out


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, matched, answers): each document with each item whose text it holds, or a continuous passage of SHARE of its words.

    docs has doc_id, text; items has item_id, text: a set of queries, searched in blocks of about ITEM_BLOCK.
    Null and blank texts are no case. Repeated rows give repeated rows of the result.
    """
    table = Scratch(docs.sparkSession).keep(word_table(docs), "words")
    model = fit(table)
    queries = items.select("item_id", "text").where("text is not null")
    blocks = -(-queries.count() // ITEM_BLOCK) or 1
    found = [_search(table, queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).collect(), *model) for n in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)


def _search(table: DataFrame, block: list, idf: np.ndarray, latent: np.ndarray) -> DataFrame:
    """The leaks of one block of items into all documents."""
    lists = list(_hashed(r.text for r in block))
    some = [i for i, x in enumerate(lists) if len(x)]
    queries = Items([block[i].item_id for i in some], [lists[i] for i in some], idf, latent)
    sent = table.sparkSession.sparkContext.broadcast((queries, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent = sent.value
        for keys, flat, offsets in _lists(batches):
            found = []
            for (row, item), (a, z) in candidates(items, latent, flat, offsets).items():
                reach = len(items.words[item])
                found.append((row, item, flat[max(a - reach, offsets[row]) : min(z + reach, offsets[row + 1])]))
            found.sort(key=lambda x: len(x[2]))
            out = []
            for at in range(0, len(found), 256):
                some = found[at : at + 256]
                score = best_scores([items.words[i] for _, i, _ in some], [p for _, _, p in some])
                for (row, item, part), s in zip(some, score.tolist(), strict=True):
                    if s >= least_score(len(items.words[item])) and (is_leak := accepted(items.words[item], items.weights[item], part)):
                        out.append((row, items.ids[item], *is_leak))
            if out:
                out.sort()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([o[0] for o in out])), pa.array([o[1] for o in out], pa.int64()), *(pa.array([o[n] for o in out], pa.float64()) for n in (2, 3, 4))], ["doc_id", "item_id", "share", "matched", "answers"])

    return table.mapInArrow(run, f"doc_id {dict(table.dtypes)['doc_id']}, item_id bigint, share double, matched double, answers double")
