"""Continuous, rightly spelt paragraphs from text of scanned pages (problem 3).

1. Furniture. The outer lines of each page are reduced to keys under which misread variants fall
   together; a key on a good part of a document's pages is a running head or foot, lines with
   nothing but a number are page numbers. A document's keys are a bounded list, whatever its size.
2. Vocabulary. Words, pairs of neighbours and letter sequences are counted over all pages; skip-gram
   vectors are trained on the words.
3. Repair. A word is linked to words reachable by plausible glyph edits; how frequent they are, how
   often they stand between these neighbours and how near their vectors are to the neighbours'
   decides in context. Words too rare for that (names) are judged by their letter sequences. Words
   broken at a line's end, or at a page's, are joined and judged as wholes.
4. Reflow. What remains is put together into paragraphs across pages.

The text is shuffled once, by page. Pages of one document meet only through (doc, page_no) joins,
so a document of any size is no unit of work. The vocabulary sent to the tasks is bounded by the
parameters below.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidar.runtime import Scratch

WORDS = 200_000
PAIRS = 300_000
CONTEXTS = 1_000
REACH = 3
RUN_WORDS = 50_000
VECTOR_SIZE = 16
HEAD_SHARE = 0.25
"""A key on at least two pages and so great a part of a document's pages is a running head or foot."""
ERROR_RATE = 0.03
REMEMBERED = 200_000
"""Judgements kept in each task's memory, so that a word form is judged once and not at each place."""
SALTS = 16

# What scanning makes of letters, as misread → right.
GLYPHS = (
    "c e|e c|B ß|! i|! l|u n|n u|f t|8 s|8 S|8 B|0 o|0 O|0 ó|1 l|1 i|1 I|l I|I l|cl d|rn m|m rn|q g|b h|y v|6 b|6 ó|d cl|m in|ſ f|ſ s|n ri|vv w|VV W|5 S|5 s|ii ü|á ä|h li|ﬁ fi|ﬂ fl"
    "|e é|e è|é è|è é|a à|a á|o ó|i í|u ú|i ì|E É|A À"
)
EDITS: dict[str, list[str]] = {}
for _pair in GLYPHS.split("|"):
    EDITS.setdefault(_pair.split()[0], []).append(_pair.split()[1])
MISREADINGS: dict[str, list[str]] = {}
for _pair in GLYPHS.split("|"):
    MISREADINGS.setdefault(_pair.split()[1], []).append(_pair.split()[0])
PLAIN = {"!": "i", "8": "s", "0": "o", "1": "l", "6": "b", "5": "s", "ſ": "f", "ﬁ": "fi", "ﬂ": "fl"}
HYPHENS = "-‐­¬=–"
CONJUNCTIONS = {"und", "oder", "bis", "bzw", "sowie", "and", "or", "to", "et", "ou", "e", "ed", "o", "y", "u"}

_BREAK = regex.compile(rf"(?<=\p{{L}}\.?)[{HYPHENS}]\s*$")
_CORE = regex.compile(r"[\p{L}\p{N}!][\p{L}\p{M}\p{N}!'’.\-‐]*(?<![.\-‐'’])|[\p{L}\p{N}]")
_NUMBER = regex.compile(r"(?:(?:pages?|pag|pág|página|pagina|seite|p|s)\.? ?)?([0-9lIOoi]{1,4}|[ivxlcIVXLC1!]{1,8})$", regex.IGNORECASE)
_FRAME = " \t\xa0-–—[](){}·.|"
_DIGITAL = regex.compile(r"(?=.*[0-9])[0-9lIOo]{3,4}$")
_ROMAN = regex.compile(r"(?=.*[IVX])(?=.*l)[IVXLl]{2,7}$")
_NUMERAL = regex.compile(r"[IVXLC]{2,8}$")
_FOLDS = [("m", "rn"), ("w", "vv"), ("d", "cl"), ("ii", "u")]
_FOLD = str.maketrans(dict(zip("ceunftyvbh60o1l!ij85sqg", "eennttvvhhhooiiiiisssgg", strict=True)))


def key_of(line: str) -> str:
    """What misread, spaced out, capitalised and numbered forms of a head have in common."""
    t = "".join(c for c in unicodedata.normalize("NFKD", line.casefold()) if not unicodedata.combining(c))
    parts = t.split()
    if len(parts) > 3 and max((len(x) for x in parts if not any(map(str.isdigit, x))), default=9) <= 2:  # spaced out
        t = " ".join("".join(x.split()) for x in regex.split(r"\s{2,}", t))
    t = regex.sub(r"\b(?:[0-9lo]*[0-9][0-9lo]*|[ivxlc]+)\b|[^\p{L}0-9!]+", "", t)
    for a, b in _FOLDS:
        t = t.replace(a, b)
    return regex.sub(r"[0-9]", "", t.translate(_FOLD))


def number_of(line: str) -> bool:
    """Whether the line holds nothing but a page number."""
    t = line.strip(_FRAME)
    return bool(t and len(t) <= 14 and _NUMBER.match(t))


def edges(text: str) -> list[tuple[str, int, int, str]]:
    """(side, place, line_no, line): the outer lines of a page, place counted from the edge inward."""
    shown = [(i, l) for i, l in enumerate(text.split("\n")) if l.strip()]
    top = [("T", k, i, l) for k, (i, l) in enumerate(shown[:4])]
    return top + [("B", k, i, l) for k, (i, l) in enumerate(reversed(shown[-3:]))]


def _keys(side: str, place: int, line: str) -> list[str]:
    """A line's key and, of the outermost two, its beginning, as a head may be cut off."""
    k = key_of(line)
    return ([side + k] if len(k) > 3 else []) + ([f"{side}^{k[:6]}"] if place < 2 and len(k) >= 6 and len(line.strip()) < 60 else [])


def _near(a: str, b: str) -> bool:
    """Same but for a quarter of their letters, or one the cut-off beginning of the other."""
    if a == b:
        return True
    if not a or not b:
        return False
    if len(a) >= 4 and b.startswith(a) and len(a) * 2 >= len(b):
        return True
    if abs(len(a) - len(b)) > max(len(a), len(b)) // 4 or min(len(a), len(b)) < 4:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] * 4 <= max(len(a), len(b))


def furniture(text: str, heads: list[str]) -> dict[int, str]:
    """line_no → header or page_number, from the edges inward up to the first line of the text proper."""
    out: dict[int, str] = {}
    found = edges(text)
    widest = max((len(l.strip()) for l in text.split("\n")), default=0)
    for side in ("T", "B"):
        for s, place, no, line in found:
            if s != side or no in out:
                continue
            if place > 2:
                break
            if number_of(line):
                out[no] = "page_number"
            elif (k := key_of(line)) and (any(_is_head(k, h, len(line.strip()), widest) for h in heads) or (place < 2 and len(line) - len(line.lstrip()) >= 8 and len(line.strip()) < 60)):
                out[no] = "header"
            else:
                break
    return out


def _is_head(k: str, head: str, width: int, widest: int) -> bool:
    """A full key may be misread; where only its beginning is the same, the line must be shorter than the text's."""
    if head[0] != "^":
        return _near(k, head)
    return k.startswith(head[1:]) and width < 45 and width * 10 <= widest * 7


class Page:
    """A page's body: words by line."""

    def __init__(self, text: str, marks: dict[int, str]):
        self.marks = marks
        self.lines = [] if text is None else text.split("\n")
        self.body = [i for i, l in enumerate(self.lines) if i not in marks and l.strip()]

    def tokens(self, i: int) -> list[str]:
        return self.lines[i].split()

    def first(self) -> str:
        return self.tokens(self.body[0])[0] if self.body else ""

    def broken(self, k: int) -> bool:
        return bool(_BREAK.search(self.lines[self.body[k]].rstrip()))


_cores: dict[str, tuple[str, int]] = {}


def core(token: str, following: str = "") -> tuple[str, int]:
    """The word in a token without punctuation around it, and where it begins. A last ! is a letter if the text goes on in small letters."""
    if "!" in token:
        return _core(token, following)
    got = _cores.get(token)
    if got is None:
        if len(_cores) > REMEMBERED:
            _cores.clear()
        got = _cores[token] = _core(token, "")
    return got


def _core(token: str, following: str) -> tuple[str, int]:
    m = _CORE.search(token)
    if not m:
        return "", 0
    w = m.group()
    if w[0] == "!" and len(w) < 3:
        return "", 0
    bare = w.rstrip("!")
    if bare != w and not (len(bare) >= 2 and following[:1].islower()):
        w = bare
    return w.rstrip(".-‐'’"), m.start()


def glyph_class(w: str) -> str:
    """What all misreadings of a word have in common."""
    t = w.casefold()
    for a, b in _FOLDS:
        t = t.replace(a, b)
    return t.translate(_FOLD)


_ACCENTS = str.maketrans("éèáàäóíìúüß", "eeaaaoiiuub")
# what is left of each letter: small upright strokes are nothing, as any of them may be misread as others
_STROKES = str.maketrans({"w": "vv", "d": "e", "c": "e", "y": "v", "q": "g", "t": "f"} | dict.fromkeys("mnurilhb", ""))


def strokes(w: str) -> str:
    """What words have in common that letter edits lead from one to another."""
    return unicodedata.normalize("NFC", w).replace("ß", "b").casefold().translate(_ACCENTS).translate(_STROKES)


def _strange(w: str) -> bool:
    return any(not c.isalpha() or c in PLAIN for c in w)


CLASS_COUNT = 20
_PARTS = regex.compile(r"[^'’\-‐]+")


class Vocabulary:
    """Counts of words, neighbours and letter sequences, and word vectors; judges words."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], compounds: dict[str, int], contexts: dict[str, np.ndarray], places: dict[str, int], vectors: np.ndarray):
        self.words, self.pairs, self.compounds = words, pairs, compounds
        self.contexts, self.places, self.vectors = contexts, places, vectors
        # letter sequences of names, and of other words
        self.grams: tuple[Counter, Counter] = (Counter(), Counter())
        self.heads: tuple[Counter, Counter] = (Counter(), Counter())
        for w, n in words.items():
            if w.isalpha() and len(w) >= 3:
                name = w[0].isupper() and w.lower() not in words
                x = "^^" + w + "$"
                for i in range(3, len(x) + 1):
                    self.grams[name][x[max(0, i - 4) : i]] += min(n, 50) if name else n
                    self.heads[name][x[max(0, i - 4) : i - 1]] += min(n, 50) if name else n
        # frequent words by what misreading leaves of them
        self.classes: dict[str, list[str]] = {}
        for w, n in words.items():
            if n >= CLASS_COUNT and len(w) >= 5 and w.isalpha():
                self.classes.setdefault(glyph_class(w), []).append(w)
        # and all words that count as right by their strokes
        self.strokes: dict[str, list[str]] = {}
        for w, n in words.items():
            if len(w) >= 3 and w.isalpha() and n + self.count(w[0].upper() + w[1:]) >= 3:
                self.strokes.setdefault(strokes(w), []).append(w)
        self._sources: dict[str, frozenset[str]] = {}
        self._alone: dict[str, str | None] = {}
        self._known: dict[str, tuple[tuple[str, int], ...]] = {}

    def count(self, w: str) -> int:
        n = self.words.get(w, 0)
        if w[:1].isupper():
            n += self.words.get(w[0].lower() + w[1:], 0)
        return n

    def letters(self, w: str) -> float:
        """Log probability of a word's letters."""
        x, grams, heads = "^^" + w + "$", self.grams[w[0].isupper()], self.heads[w[0].isupper()]
        return sum(math.log((grams.get(x[max(0, i - 4) : i], 0) + 0.05) / (heads.get(x[max(0, i - 4) : i - 1], 0) + 2.0)) for i in range(3, len(x) + 1))

    def near(self, w: str) -> tuple[tuple[str, int], ...]:
        """Words linked to w; remembered."""
        got = self._known.get(w)
        if got is None:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            got = self._known[w] = self._links(w)
        return got

    def _links(self, w: str) -> tuple[tuple[str, int], ...]:
        """Words linked to w by one glyph edit, else by two, with their counts; only those more frequent than w."""
        have = self.count(w)
        one = set(edited(w))
        found = [(x, n) for x in one if x.isalpha() and (n := self.count(x)) >= 3]
        if not found and len(w) >= 4:
            if _strange(w):
                far = {x for y in one for x in edited(y)}
            else:
                # words of the same strokes are all that two edits can lead to
                mates = self.strokes.get(strokes(w), ())
                far = {x for m in mates if abs(len(m) - len(w)) <= 2 for x in (m, m[0].upper() + m[1:]) if x != w and not one.isdisjoint(self.sources(x))}
            found = [(x, n) for x in far if x != w and x.isalpha() and (n := self.count(x)) >= 3]
            # misread in more places: frequent words of the same class, if the context's vectors are near theirs
            found = found or [(x, self.count(x)) for x in self.classes.get(glyph_class(w), ()) if x[0].isupper() == w[0].isupper() and have * 5 <= self.count(x)]
        return tuple(sorted({f for f in found if f[1] > have}, key=lambda f: (-f[1], f[0])))

    def sources(self, x: str) -> frozenset[str]:
        """The forms that one edit makes x of; remembered."""
        got = self._sources.get(x)
        if got is None:
            if len(self._sources) > REMEMBERED // 10:
                self._sources.clear()
            got = self._sources[x] = frozenset(edited(x, MISREADINGS))
        return got

    def _context(self, w: str, n: int, before: str, after: str) -> float:
        return 0.05 * n + self.pairs.get((before, w), 0) + self.pairs.get((w, after), 0) + 0.1

    def surroundings(self, around: list[str]) -> np.ndarray | None:
        found = [x for a in around if (x := self.contexts.get(a.lower())) is not None]
        return np.sum(found, axis=0) if found else None

    def likeness(self, w: str, here: np.ndarray | None, own: bool = False) -> float:
        """How near a word's vector, the sum of its surroundings all over the texts, is to the surroundings here; own: without this very place."""
        at = self.places.get(w.lower())
        if at is None or here is None:
            return 0.0
        v = self.vectors[at] - here if own else self.vectors[at]
        size = float(np.linalg.norm(v))
        return float(v @ here) / (size * float(np.linalg.norm(here)) + 1e-9) if size > 1e-3 else 0.0

    def kinship(self, w: str, x: str) -> float:
        """How near two words' vectors are: a misread word stands where the right one does."""
        a, b = self.places.get(w.lower()), self.places.get(x.lower())
        if a is None or b is None or a == b:
            return 0.0
        v, u = self.vectors[a], self.vectors[b]
        return float(v @ u) / (float(np.linalg.norm(v)) * float(np.linalg.norm(u)) + 1e-9)

    def part(self, w: str, before: str, after: str, around: list[str]) -> str:
        """The right form of a word without hyphens and apostrophes."""
        alone = self.alone(w)
        if alone is not None:
            return alone
        strange = _strange(w)
        have = self.count(w)
        here = self.surroundings(around)
        mine = 0.0 if strange else self.likeness(w, here, own=True)
        own = self._context(w, have, before, after)
        best, score = w, 0.0
        for x, n in self.near(w):
            s = math.log(ERROR_RATE) + math.log(self._context(x, n, before, after) / own) + 2 * (self.likeness(x, here) - mine + self.kinship(w, x))
            if s > score or (strange and best == w):
                best, score = x, s
        return best if best != w else self._by_letters(w)

    def alone(self, w: str) -> str | None:
        """The right form where the context has no say; None where links are to be weighed. Remembered."""
        if w not in self._alone:
            if len(self._alone) > REMEMBERED:
                self._alone.clear()
            self._alone[w] = self._judged(w)
        return self._alone[w]

    def _judged(self, w: str) -> str | None:
        if _DIGITAL.match(w):
            return w.translate(str.maketrans("lIOo", "1100"))
        if _ROMAN.match(w) and w not in self.words:
            return w.replace("l", "I")
        if _ROMAN.match(w):
            fixed = w.replace("l", "I")
            return fixed if self.count(fixed) > self.count(w) else w
        if _NUMERAL.match(w) or w.isdigit() or not any(c.isalpha() for c in w) or (len(w) < 2):
            return w
        if _strange(w) and sum(c.isdigit() for c in w) > len(w) / 2:
            return w
        return None if self.near(w) else self._by_letters(w)

    def _by_letters(self, w: str) -> str:
        """The form of a word that no link explains, by its letter sequences."""
        strange = _strange(w)
        if self.count(w) >= 20 and not strange:
            return w
        if strange:
            forms = {"".join(PLAIN.get(c, c) for c in w)} | {x for x in edited(w) if x.isalpha()}
            forms |= {x for y in list(edited(w)) for x in edited(y) if x.isalpha()} if not any(f.isalpha() for f in forms) else set()
            forms = {f for f in forms if f.isalpha()}
            return max(sorted(forms), key=self.letters) if forms else w
        if len(w) >= 5:
            now = self.letters(w)
            best, gain = w, 5.0
            for x in set(edited(w)):
                if x.isalpha() and x.isascii() == w.isascii() and (g := self.letters(x) - now) > gain:
                    best, gain = x, g
            return best
        return w

    def word(self, w: str, before: str, after: str, around: list[str]) -> str:
        if self.compounds and self.compounds.get(w, 0) >= 20:
            return w
        if w.isalnum():
            return self.part(w, before, after, around)
        return _PARTS.sub(lambda m: self.part(m.group(), before, after, around), w)

    def join(self, a: str, b: str) -> str | None:
        """The word that a line end broke into a and b; None if its hyphen rightly ends the line."""
        whole, kept = a + b, f"{a}-{b}"
        inner = b.split("-")[0].split("’")[0].split("'")[0]
        n = self.count(_PARTS.findall(a)[-1] + inner) if _PARTS.findall(a) else 0
        if b.lower() in CONJUNCTIONS and n < 3:
            return None
        if b[:1].isupper():
            return kept
        h = self.compounds.get(kept, 0) + self.compounds.get(kept.lower(), 0)
        return kept if h > n else whole


def edited(w: str, edits: dict[str, list[str]] = EDITS) -> Iterator[str]:
    for i in range(len(w)):
        for size in (1, 2):
            for right in edits.get(w[i : i + size], ()):
                if i + size <= len(w):
                    yield w[:i] + right + w[i + size :]


def _words_of(page: Page) -> Iterator[list[str]]:
    """The body's words line by line, without those broken at line ends."""
    skip = False
    for k, i in enumerate(page.body):
        t = page.tokens(i)
        broken = page.broken(k)
        own = t[1 if skip else 0 : len(t) - 1 if broken else len(t)]
        skip = broken
        yield [w for j, x in enumerate(own) if (w := core(x, own[j + 1] if j + 1 < len(own) else "")[0])]


def _marks(row: dict) -> dict[int, str]:
    return {m["line_no"]: m["kind"] for m in row["marks"] or ()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Words of many texts in small letters, REACH empty ones after each text."""
    out: list[str] = []
    for b in batches:
        for w in b.column(0).to_pylist():
            out += [x.lower() for x in w]
            out += [""] * REACH
            if len(out) > RUN_WORDS:
                yield out
                out = []
    if out:
        yield out


def skip_grams(texts: DataFrame, words: dict[str, int]) -> tuple[dict[str, np.ndarray], dict[str, int], np.ndarray]:
    """Vectors of context words; and of all words, rare ones too: (place of each word, vectors).

    Skip-gram vectors as the factorisation that the method's objective comes to: the positive pointwise mutual information of
    the CONTEXTS most frequent words within REACH words of each other, counted over all texts, gives the context vectors;
    a word's vector is the sum of the context vectors around it, all over the texts. Sums are of whole numbers, so that
    the result doesn't hang on the order of rows.
    """
    lower: Counter = Counter()
    for w, n in words.items():
        if w.isalpha():
            lower[w.lower()] += n
    chosen = [w for w, _ in sorted(lower.items(), key=lambda x: (-x[1], x[0]))[:CONTEXTS]]
    number = {w: i for i, w in enumerate(chosen)}
    size = len(chosen)
    if not size:
        return {}, {}, np.zeros((0, VECTOR_SIZE), np.float32)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size * size, np.int64)
        for words in _runs(batches):
            at = np.array([number.get(x, -1) for x in words], np.int64)
            for step in range(1, REACH + 1):
                left, right = at[:-step], at[step:]
                known = (left >= 0) & (right >= 0)
                left, right = left[known], right[known]
                n += np.bincount(np.concatenate([left * size + right, right * size + left]), minlength=size * size)
        n = n.reshape(size, size)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j, pa.int64()), pa.array(n[i, j], pa.int64())], ["k", "n"])

    counted = texts.mapInArrow(together, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size * size)
    n[counted["k"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape(size, size)
    total = max(n.sum(), 1)
    share = n.sum(axis=1) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.nan_to_num(np.log(n / total / (share[:, None] * share[None, :])), nan=0.0, neginf=0.0, posinf=0.0)
    values, axes = np.linalg.eigh(np.maximum(pmi, 0))
    most = np.argsort(-values)[:VECTOR_SIZE]
    basis = axes[:, most] * np.sqrt(np.maximum(values[most], 0)) * (1e-3 / (1e-3 + share))[:, None]
    basis = np.pad(basis, ((0, 0), (0, VECTOR_SIZE - basis.shape[1])))
    whole = np.rint(basis / (np.abs(basis).max() + 1e-12) * 1e6).astype(np.int64)

    padded = np.vstack([whole, np.zeros((1, VECTOR_SIZE), np.int64)])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict[str, int] = {}
        sums = np.zeros((1024, VECTOR_SIZE), np.int64)
        seen = np.zeros(1024, np.int64)
        for words in _runs(batches):
            at = np.array([row.setdefault(x, len(row)) if x else -1 for x in words], np.int64)
            while len(row) > len(sums):
                sums, seen = np.vstack([sums, np.zeros_like(sums)]), np.concatenate([seen, np.zeros_like(seen)])
            own = padded[[number.get(x, -1) for x in words]]
            near = np.zeros_like(own)
            for step in range(1, REACH + 1):
                near[:-step] += own[step:]
                near[step:] += own[:-step]
            shown = np.flatnonzero(at >= 0)
            order = shown[np.argsort(at[shown], kind="stable")]
            which, first, times = np.unique(at[order], return_index=True, return_counts=True)
            if len(which):
                sums[which] += np.add.reduceat(near[order], first, axis=0)
                seen[which] += times
        k = len(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(row), pa.string()), pa.array(seen[:k], pa.int64()), *(pa.array(sums[:k, d], pa.int64()) for d in range(VECTOR_SIZE))], ["w", "n", *(f"v{d}" for d in range(VECTOR_SIZE))])

    dims = [f"v{d}" for d in range(VECTOR_SIZE)]
    sums = texts.mapInArrow(around, "w string, n bigint, " + ", ".join(f"{d} bigint" for d in dims)).groupBy("w").agg(F.sum("n").alias("n"), *(F.sum(d).alias(d) for d in dims))
    kept = sums.where("n >= 2").orderBy(F.desc("n"), "w").limit(WORDS).toArrow()
    vectors = np.stack([kept[d].to_numpy() for d in dims], axis=1).astype(np.float32) / 1e6
    return {w: (whole[i] / 1e6).astype(np.float32) for w, i in number.items()}, {w: i for i, w in enumerate(kept["w"].to_pylist())}, vectors


class ScannedPages:
    """The analysis of one table of pages (page_id, doc, page_no, text); frames are read back from the shared folder.

    Null and empty texts have no lines. Rows with a null doc or page_no count as pages of their own,
    with no neighbour. Other columns are ignored.
    """

    def __init__(self, df: DataFrame):
        self.s = Scratch(df.sparkSession)
        pages = df.select("page_id", "doc", "page_no", "text")
        self.pages = self.s.keep(self._with_neighbours(pages), "pages")
        self.vocabulary = self._vocabulary()

    def _with_neighbours(self, pages: DataFrame) -> DataFrame:
        """page_id, doc, page_no, text, marks array<struct<line_no, kind>>, after: the next page's first word, before: the last of the page before if a line end breaks it."""
        keep = self.s.keep

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, k) for i, t in enumerate(b.column(3).to_pylist()) for side, place, _, l in edges(t or "") if place < 3 for k in _keys(side, place, l)]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array([r[0] for r in rows], pa.int32())), b.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.string())], ["doc", "page_id", "k"])

        types = dict(pages.dtypes)
        found = pages.mapInArrow(outer, f"doc {types['doc']}, page_id {types['page_id']}, k string")
        sizes = pages.groupBy("doc").agg(F.count("*").alias("n"))
        often = found.groupBy("doc", "k").agg(F.count("*").alias("m")).where("m >= 2").join(sizes, "doc").where(F.col("m") >= HEAD_SHARE * F.col("n"))
        # at most 6 / HEAD_SHARE keys for a document
        heads = keep(often.groupBy("doc").agg(F.array_sort(F.collect_set(F.substr("k", F.lit(2)))).alias("heads")), "heads")
        salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(salted, ["doc", "salt"], "left").drop("salt")

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
            for b in batches:
                all_marks, first, last = [], [], []
                for t, h in zip(b.column("text").to_pylist(), b.column("heads").to_pylist(), strict=True):
                    m = furniture(t or "", h or [])
                    all_marks.append([{"line_no": i, "kind": k} for i, k in sorted(m.items())])
                    page = Page(t or "", m)
                    first.append(page.first())
                    last.append(page.tokens(page.body[-1])[-1] if page.body and page.broken(len(page.body) - 1) else "")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "doc", "page_no", "text")), pa.array(all_marks, kind), pa.array(first, pa.string()), pa.array(last, pa.string())], ["page_id", "doc", "page_no", "text", "marks", "first", "last"])

        schema = ", ".join(f"{c} {types[c]}" for c in ("page_id", "doc", "page_no", "text"))
        marked = keep(joined.select("page_id", "doc", "page_no", "text", "heads").mapInArrow(mark, f"{schema}, marks array<struct<line_no:bigint,kind:string>>, first string, last string"), "marked")
        placed = marked.where("doc is not null and page_no is not null")
        after = placed.where("first <> ''").select("doc", (F.col("page_no") - 1).alias("page_no"), "page_id", F.col("first").alias("w"), F.lit(True).alias("next"))
        before = placed.where("last <> ''").select("doc", (F.col("page_no") + 1).alias("page_no"), "page_id", F.col("last").alias("w"), F.lit(False).alias("next"))
        # pages delivered twice: the least page_id counts
        beside = after.unionByName(before).groupBy("doc", "page_no").agg(
            F.min_by(F.when(F.col("next"), F.col("w")), F.when(F.col("next"), F.col("page_id"))).alias("after"),
            F.min_by(F.when(~F.col("next"), F.col("w")), F.when(~F.col("next"), F.col("page_id"))).alias("before"),
        )
        return marked.drop("first", "last").join(beside, ["doc", "page_no"], "left").select("page_id", "doc", "page_no", "text", "marks", "after", "before")

    def _vocabulary(self) -> Vocabulary:
        spark = self.pages.sparkSession
        body = self.pages.select("text", "marks")

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [w for r in b.to_pylist() if r["text"] for w in ([x for l in _words_of(Page(r["text"], _marks(r))) for x in l],) if w]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["w"])

        texts = self.s.keep(body.mapInArrow(lines, "w array<string>"), "words")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for b in batches:
                for w in b.column(0).to_pylist():
                    for x in w:
                        parts = _PARTS.findall(x)
                        n.update(("w", p, "") for p in parts)
                        if len(parts) > 1:
                            n["c", x, ""] += 1
                    n.update(("p", x, y) for x, y in zip(w, w[1:], strict=False))
            keys = list(n)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(n.values()), pa.int64())], ["t", "a", "b", "n"])

        counts = texts.mapInArrow(count, "t string, a string, b string, n bigint").groupBy("t", "a", "b").agg(F.sum("n").alias("n")).where("n >= 2")
        counts = self.s.keep(counts, "counts")
        top = lambda t, least, most: counts.where((F.col("t") == t) & (F.col("n") >= least)).orderBy(F.desc("n"), "a", "b").limit(most).collect()
        words = {r.a: r.n for r in top("w", 2, WORDS)}
        contexts, places, vectors = skip_grams(texts, words)
        return Vocabulary(words, {(r.a, r.b): r.n for r in top("p", 5, PAIRS)}, {r.a: r.n for r in top("c", 2, WORDS)}, contexts, places, vectors)

    def defects(self) -> DataFrame:
        """(page_id, line_no, defect, repaired), equal rows once for each page."""
        sent = self.pages.sparkSession.sparkContext.broadcast(self.vocabulary)
        kind = dict(self.pages.dtypes)["page_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = [], []
                for i, r in enumerate(b.select(["text", "marks", "after", "before"]).to_pylist()):
                    page = Page(r["text"] or "", _marks(r))
                    found = {(no, k, "") for no, k in page.marks.items()}
                    for _, _, fixes in repair(page, r["after"] or "", sent.value, r["before"] or ""):
                        found |= set(fixes)
                    ids += [i] * len(found)
                    rows += sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids, pa.int32())), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.string())],
                    ["page_id", "line_no", "defect", "repaired"],
                )

        return self.pages.select("page_id", "text", "marks", "after", "before").mapInArrow(run, f"page_id {kind}, line_no bigint, defect string, repaired string")

    def paragraphs(self) -> DataFrame:
        """(doc, para_no, first_page, text): the repaired paragraphs of each document in order; one goes on over pages where no page begins a new one.

        para_no ascends by 1; it begins at 0 where the document's first line isn't marked as a paragraph's beginning, else at 1.
        """
        sent = self.pages.sparkSession.sparkContext.broadcast(self.vocabulary)
        # pages without a document are documents of their own
        source = self.pages.withColumn("key", F.coalesce(F.concat(F.lit("d"), F.col("doc").cast("string")), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit("")))
        types = dict(source.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = [], []
                for i, r in enumerate(b.select(["text", "marks", "after", "before"]).to_pylist()):
                    page = Page(r["text"] or "", _marks(r))
                    pieces: list[tuple[bool, list[str]]] = []
                    for starts, words, _ in repair(page, r["after"] or "", sent.value, r["before"] or ""):
                        if starts or not pieces:
                            pieces.append((starts, []))
                        pieces[-1][1].extend(words)
                    for n, (starts, words) in enumerate(pieces):
                        ids.append(i)
                        rows.append((n, starts, " ".join(words)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids, pa.int32())), b.column(1).take(pa.array(ids, pa.int32())), b.column(2).take(pa.array(ids, pa.int32())), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.bool_()), pa.array([x[2] for x in rows], pa.string())],
                    ["key", "doc", "page_no", "piece", "starts", "text"],
                )

        pieces = self.s.keep(source.select("key", "doc", "page_no", "text", "marks", "after", "before").mapInArrow(run, f"key string, doc {types['doc']}, page_no {types['page_no']}, piece bigint, starts boolean, text string"), "pieces")
        # running numbers in two steps, so that no document is numbered by one task alone
        block = F.floor(F.coalesce("page_no", F.lit(0)) / 64).alias("block")
        p = pieces.withColumn("block", block).withColumn("one", F.col("starts").cast("bigint"))
        inner = Window.partitionBy("key", "block").orderBy("page_no", "piece")
        sums = p.groupBy("key", "block").agg(F.sum("one").alias("total"))
        sums = sums.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
        numbered = p.withColumn("run", F.sum("one").over(inner.rowsBetween(Window.unboundedPreceding, 0))).join(sums, ["key", "block"])
        numbered = numbered.withColumn("para_no", (F.col("run") + F.col("base")).cast("bigint"))
        parts = F.array_sort(F.collect_list(F.struct("page_no", "piece", "text")))
        return numbered.groupBy("key", "doc", "para_no").agg(F.min("page_no").alias("first_page"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text")).drop("key")


def _whole(token: str, rest: str, voc: Vocabulary) -> str | None:
    """The word that token begins at a line's end and rest ends, if there is something to join."""
    head, tail = core(token.rstrip(HYPHENS))[0], core(rest)[0]
    return voc.join(head, tail) if head and tail and (tail[0].isalpha() or tail[0] in PLAIN) else None


def repair(page: Page, after: str, voc: Vocabulary, before: str = "") -> Iterator[tuple[bool, list[str], list[tuple[int, str, str]]]]:
    """For each body line: whether a paragraph starts there, its repaired words, and its defects (line_no, defect, repaired).

    after: the next page's first word. before: the last word of the page before, if broken there; its end is left out here.
    """
    skip = bool(before and page.body and _whole(before, page.first(), voc) is not None)
    last, recent = "", []
    for k, i in enumerate(page.body):
        line = page.lines[i]
        t = page.tokens(i)
        indent = len(line) - len(line.lstrip())
        starts = (k > 0 and page.body[k - 1] < i - 1 and all(not page.lines[j].strip() for j in range(page.body[k - 1] + 1, i))) or 2 <= indent < 8
        out, fixes = [], []
        broken = page.broken(k)
        at_end = k + 1 == len(page.body)
        rest = after if at_end else page.tokens(page.body[k + 1])[0] if page.body[k + 1] == i + 1 else ""
        for j, tok in enumerate(t):
            if skip and j == 0:
                skip = False
                continue
            following = t[j + 1] if j + 1 < len(t) else rest
            w, at = core(tok, following)
            if w[-1:] == "!" and voc.count(w[:-1]) >= 20 and voc.count(w[:-1] + "i") < 3:
                w = w[:-1]
            if broken and j == len(t) - 1:
                head, tail, whole = core(tok.rstrip(HYPHENS))[0], core(rest)[0], _whole(tok, rest, voc)
                if whole is not None:
                    right = voc.word(whole, last, "", recent[-3:])
                    fixes.append((i, "hyphen", right))
                    if right != whole:
                        fixes.append((i, "char", right))
                    end = rest.find(tail) + len(tail)
                    start = tok.find(head[0])
                    out.append(tok[: max(start, 0)] + right + rest[end:])
                    last = right
                    recent.append(right)
                    skip = True
                    continue
            if w:
                nxt = core(following)[0]
                right = voc.word(w, last, nxt, [*recent[-3:], nxt])
                if right != w:
                    fixes.append((i, "char", right))
                out.append(tok[:at] + right + tok[at + len(w) :])
                last = right
                recent.append(right)
            else:
                out.append(tok)
        yield starts, out, fixes
