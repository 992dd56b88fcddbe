"""Languages of documents and of their paragraphs (problem 4).

Prediction by partial matching over bytes: for each language a tree of contexts of up to ORDER
bytes, with escape probabilities of method C. Statistics are frozen after training, so the code
length of a byte after its context is a fixed number, and a paragraph's exact code length under a
language is the sum over its bytes. The trees of all languages are laid out together: one sorted
table for each order maps a context with its next byte to the vector of code lengths, one per
language, with the escapes to lower orders already added. Scoring is one lookup per byte.

Training takes a bounded sample: of each language at most SAMPLE_DOCS documents of at most
SAMPLE_CHARS characters whose label names that language alone, chosen by a hash of the id. Labels
are wrong in part, so models of one half of the sample judge the paragraphs of the other, and only
paragraphs that are judged to be in the labelled language train the final trees. The trees are
bounded by the sample and are the only thing broadcast; every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "it", "fr", "es", "nl", "pt", "el", "zh", "ja", "hi", "th")
ORDER = 4
SAMPLE_DOCS = 300
SAMPLE_CHARS = 8_000
BLOCK_BYTES = 1_000_000

# How label systems name these languages (two- and three-letter codes, names in
# English, German, French, Italian and Spanish, and the language's own).
NAMES = {
    "de": "de deu ger german deutsch allemand tedesco alemán",
    "en": "en eng english englisch anglais inglese inglés",
    "it": "it ita italian italienisch italien italiano",
    "fr": "fr fra fre french französisch français francese francés",
    "es": "es spa spanish spanisch espagnol spagnolo español castellano",
    "nl": "nl nld dut dutch niederländisch néerlandais olandese neerlandés nederlands",
    "pt": "pt por portuguese portugiesisch portugais portoghese portugués português",
    "el": "el ell gre greek griechisch grec greco griego ελληνικά",
    "zh": "zh zho chi cmn chinese chinesisch chinois cinese chino 中文 汉语 漢語",
    "ja": "ja jpn japanese japanisch japonais giapponese japonés 日本語",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "th": "th tha thai thailändisch thaï thailandese tailandés ไทย ภาษาไทย",
}
_LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_VISIBLE = regex.compile(r"[^\p{Z}\p{C}]")
_LETTER = regex.compile(r"\p{L}")
_JUNK = regex.compile(r"[\p{Z}\p{C}]+")


def named_languages(labels: Column) -> Column:
    """The codes that a label array names, in its order; region variants count for their language, meaningless entries for nothing."""
    table = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)))

    def code(label: Column) -> Column:
        name = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
        return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.regexp_extract(name, r"^([a-z]{2,3})[-_]", 1)))

    found = F.filter(F.transform(labels, code), lambda c: c.isNotNull())
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def paragraphs(text: str | None) -> list[str]:
    """The longest runs of lines with visible characters."""
    out, run = [], []
    for line in _LINE.split(text) if text else []:
        if _VISIBLE.search(line):
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    if run:
        out.append("\n".join(run))
    return out


def _bytes(paragraph: str) -> bytes:
    return _JUNK.sub(" ", paragraph).strip().lower().encode("utf-8", "replace")


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each after ORDER line ends as its first context, and where each text's own bytes start."""
    pad = b"\n" * ORDER
    starts = np.cumsum([ORDER] + [len(t) + ORDER for t in texts])[:-1]
    return np.frombuffer(b"".join(pad + t for t in texts), np.uint8), starts


def _grams(stream: np.ndarray, order: int) -> np.ndarray:
    """At each position from ORDER on, the order bytes before it and the byte itself as one number."""
    n = len(stream) - ORDER
    key = np.zeros(max(n, 0), np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | stream[ORDER - back : ORDER - back + n].astype(np.uint64)
    return key


def _own(stream: np.ndarray, texts: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Mask of the positions from ORDER on that belong to a text."""
    mask = np.zeros(len(stream) + 1, np.int32)
    np.add.at(mask, starts, 1)
    np.add.at(mask, starts + np.array([len(t) for t in texts], np.int64), -1)
    return np.cumsum(mask)[ORDER:-1] > 0


class ContextTrees:
    """Frozen trees of all languages."""

    def __init__(self, samples: list[list[bytes]]):
        """samples: the training texts of each language."""
        langs = len(samples)
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        seen = []
        for texts in samples:
            stream, starts = _stream(texts)
            seen.append((stream, _own(stream, texts, starts)) if texts else None)
        for k in range(ORDER + 1):
            stats = []
            for one in seen:
                g = _grams(one[0], k)[one[1]] if one else np.zeros(0, np.uint64)
                grams, count = np.unique(g, return_counts=True)
                ctx, first = np.unique(grams >> np.uint64(8), return_index=True)
                total = np.add.reduceat(count, first) if len(first) else count
                distinct = np.diff(np.append(first, len(grams)))
                stats.append((grams, count, ctx, total, distinct))
            keys = np.unique(np.concatenate([s[0] for s in stats]))
            contexts = np.unique(np.concatenate([s[2] for s in stats]))
            escape = np.zeros((len(contexts), langs), np.float32)
            cost = np.empty((len(keys), langs), np.float32)
            if k:
                shorter = keys & np.uint64((1 << 8 * k) - 1)
                cost[:] = self.cost[k - 1][np.searchsorted(self.keys[k - 1], shorter)]
            else:
                cost[:] = 8.0
            at = np.searchsorted(contexts, keys >> np.uint64(8))
            for lang, (grams, count, ctx, total, distinct) in enumerate(stats):
                if not len(grams):
                    continue
                escape[np.searchsorted(contexts, ctx), lang] = np.log2((total + distinct) / distinct)
                cost[:, lang] += escape[at, lang]
                mine = np.searchsorted(ctx, grams >> np.uint64(8))
                cost[np.searchsorted(keys, grams), lang] = np.log2((total[mine] + distinct[mine]) / count)
            self.keys.append(keys)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.escape.append(escape)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), self.cost[0].shape[1]))
        size, first = 0, 0
        for i, t in enumerate(texts):
            size += len(t) + ORDER
            if size > BLOCK_BYTES or i == len(texts) - 1:
                self._score(texts[first : i + 1], out[first : i + 1])
                size, first = 0, i + 1
        return out

    def _score(self, texts: list[bytes], out: np.ndarray) -> None:
        stream, starts = _stream(texts)
        own = np.flatnonzero(_own(stream, texts, starts))
        if not len(own):
            return
        bits = np.zeros((len(own), out.shape[1]), np.float32)
        left = np.arange(len(own))
        for k in range(ORDER, -1, -1):
            g = _grams(stream, k)[own[left]]
            at = np.minimum(np.searchsorted(self.keys[k], g), len(self.keys[k]) - 1) if len(self.keys[k]) else None
            hit = self.keys[k][at] == g if at is not None else np.zeros(len(g), bool)
            if at is not None:
                bits[left[hit]] += self.cost[k][at[hit]]
            left, g = left[~hit], g[~hit] >> np.uint64(8)
            if not len(left):
                break
            if len(self.contexts[k]):
                at = np.minimum(np.searchsorted(self.contexts[k], g), len(self.contexts[k]) - 1)
                known = self.contexts[k][at] == g
                bits[left[known]] += self.escape[k][at[known]]
        else:
            bits[left] += 8.0
        which = np.searchsorted(starts - ORDER, own, side="right") - 1
        bounds = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[bounds]] = np.add.reduceat(bits, bounds, axis=0, dtype=np.float64)


def judge(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of least code length, and its probability if all were equally likely before."""
    best = bits.argmin(axis=1)
    with np.errstate(under="ignore"):
        return best, 1.0 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)


def train(df: DataFrame) -> ContextTrees:
    """Trees from a bounded sample of df (doc_id, text, languages)."""
    named = named_languages(F.col("languages"))
    fit = df.select("doc_id", "text", named.alias("named")).where((F.size("named") == 1) & F.length("text").between(40, SAMPLE_CHARS))
    fit = fit.select("text", F.col("named")[0].alias("lang"), F.xxhash64("doc_id").alias("h"))
    chosen = fit.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= SAMPLE_DOCS)
    halves: list[list[list[bytes]]] = [[[] for _ in LANGUAGES] for _ in range(2)]
    for row in chosen.collect():  # at most SAMPLE_DOCS a language
        halves[row.n % 2][LANGUAGES.index(row.lang)] += [b for p in paragraphs(row.text) if _LETTER.search(p) and (b := _bytes(p))]
    clean: list[list[bytes]] = [[] for _ in LANGUAGES]
    for half in (0, 1):
        other = ContextTrees(halves[1 - half])
        for lang, texts in enumerate(halves[half]):
            if texts:
                verdict = other.code_lengths(texts).argmin(axis=1)
                # a language with all its documents in one half keeps them
                clean[lang] += [t for t, v in zip(texts, verdict, strict=True) if v == lang] if halves[1 - half][lang] else texts
    return ContextTrees(clean)


def paragraph_languages(df: DataFrame, trees: ContextTrees | None = None) -> DataFrame:
    """(doc_id, para_no, lang, confidence, bits, n_bytes, named), one row per paragraph of df (doc_id, text, languages).

    Paragraphs are counted from 0. A paragraph without letters gets lang null and confidence 0.
    Null and blank texts have no paragraph; repeated rows give repeated rows; ties go to the
    language that LANGUAGES has first. named: the codes that the document's labels name.
    """
    model = df.sparkSession.sparkContext.broadcast(trees or train(df))
    chosen = df.select("doc_id", "text", named_languages(F.col("languages")).alias("named"))
    key = dict(chosen.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            rows, number, texts = [], [], []
            size = 0
            column = batch.column(1)
            for i in range(len(column)):
                found = paragraphs(column[i].as_py())
                rows += [i] * len(found)
                number += range(len(found))
                texts += found
                size += sum(map(len, found))
                if texts and (size > BLOCK_BYTES or i == len(column) - 1):
                    yield emit(trees, batch, rows, number, texts)
                    rows, number, texts, size = [], [], [], 0

    def emit(trees: ContextTrees, batch: pa.RecordBatch, rows: list[int], number: list[int], texts: list[str]) -> pa.RecordBatch:
        coded = [_bytes(t) for t in texts]
        bits = trees.code_lengths(coded)
        best, sure = judge(bits)
        some = [bool(_LETTER.search(t)) for t in texts]
        take = pa.array(rows, pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(take),
                pa.array(number, pa.int64()),
                pa.array([LANGUAGES[b] if s else None for b, s in zip(best, some, strict=True)], pa.string()),
                pa.array([round(float(c), 6) if s else 0.0 for c, s in zip(sure, some, strict=True)]),
                pa.array(bits.min(axis=1)),
                pa.array([len(c) for c in coded], pa.int64()),
                batch.column(2).take(take),
            ],
            ["doc_id", "para_no", "lang", "confidence", "bits", "n_bytes", "named"],
        )

    return chosen.mapInArrow(run, f"doc_id {key}, para_no bigint, lang string, confidence double, bits double, n_bytes bigint, named array<string>")


def document_languages(parts: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, langs, mixed) from paragraph_languages: the language of most bytes, and all languages found.

    confidence: the language's share of the document's bytes, each paragraph weighted with its own confidence.
    """
    by_lang = parts.where("lang is not null").groupBy("doc_id", "lang").agg(F.sum("n_bytes").alias("n"), F.sum(F.col("n_bytes") * F.col("confidence")).alias("w"))
    return by_lang.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("lang"),
        F.round(F.max_by("w", F.struct("n", "lang")) / F.sum("n"), 6).alias("confidence"),
        F.array_sort(F.collect_set("lang")).alias("langs"),
        (F.count("*") > 1).alias("mixed"),
    )


def unlabelled_paragraphs(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """(doc_id, para_no, lang) of each paragraph whose language isn't named in the document's labels; documents of excluded (doc_id) are left out."""
    found = paragraph_languages(df).where(F.col("lang").isNotNull() & ~F.array_contains("named", F.col("lang")))
    return found.join(excluded.select("doc_id"), "doc_id", "left_anti").select("doc_id", "para_no", "lang")
