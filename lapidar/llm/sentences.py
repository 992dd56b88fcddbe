"""Sentence units of texts in any language and script (problem 2).

A hidden-event n-gram language model: the stream of words has an event, boundary or none, between
any two words, and a trigram model over words and boundary tokens is learnt from the texts
themselves. At first only certain events count (ends of paragraphs; gaps where no sentence can
end); gaps that are open stay hidden. The model so learnt gives every open gap a posterior by the
forward-backward algorithm; with these decisions it is learnt again on all gaps, and decides
finally. Thai and other scripts without end marks take part in the same way: there each white space
is an open gap, and the words beside it are the beginnings and ends of runs.

What is certain: blank lines and line ends that aren't from hard wrapping end a unit; gaps inside a
closed quotation or bracket don't. A line end is from wrapping if the next line's first word
wouldn't have fitted in the widest line.

Texts are cut into words once, into a table that all passes read. Counting is one aggregation of n-grams
per pass, pre-added within each task; the model keeps about the VOCABULARY most frequent words, all
others by their shape, and about NGRAMS n-grams, in whole classes of equal counts, so that its size is
bounded and no script goes before another. Decisions are made document by document, without shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidar.runtime import Scratch

VOCABULARY = 20_000
LEAST_COUNT = 6
NGRAMS = 600_000
WIDEST = 110
"""Lines longer than this were never wrapped."""
ENOUGH = 4.0
"""A word that ends paragraphs so many times less often than others do, for its open gaps, still ends sentences."""
RUN_EDGE = 6
"""Letters that stand for the beginning and the end of a run without spaces."""

CUT_ROWS = 2_000
FLUSH = 300_000
"""Counts that a task keeps in memory before it hands them on."""

END = "<s>"
CERTAIN, GAP, AFTER = 0, 1, 2
_TOKEN = regex.compile(
    r"(?P<run>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)"
    r"|(?P<han>[\p{Han}\p{Hiragana}\p{Katakana}ー々]+)"
    r"|(?P<num>\p{N}+(?:[.,:]\p{N}+)*(?:\.(?!\.))?)"
    r"|(?P<abbr>(?:\p{L}\p{M}*){1,3}\.(?:-?(?:\p{L}\p{M}*){1,3}\.)+)"
    r"|(?P<word>[\p{L}\p{M}]+(?:['’ʼ\-‐‑][\p{L}\p{M}]+)*(?:\.(?![.\p{Ll}]))?)"
    r"|(?P<end>[.!?…。！？｡।॥؟۔]+)"
    r"|(?P<other>[^\s\p{L}\p{M}\p{N}\p{Cf}.!?…。！？｡।॥؟۔])"
)
_BREAK = regex.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_EDGE = regex.compile(r"[\s\p{Z}\p{Cf}\p{Cc}]+")
_HIDDEN = regex.compile(r"\p{Cf}+")
_CHUNK = regex.compile(r"[^ \t]+(?:[ \t]{2,}[^ \t]+)*")  # wrapping breaks at single spaces only
_OMISSION = regex.compile(r"\[(?:\.\.\.|…)\]\s*\p{Ll}")
_ENDS = regex.compile(r"[.!?…。！？｡।॥؟۔]$")
_GREEK = regex.compile(r"\p{Greek}")
# opening and closing marks; a mark that both opens and closes is told by what stands beside it
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“”", "“": "”", "‘": "’", "‚": "‘’", "»": "«"}
_CLOSERS = set(")]}）］】」』》〉»“”’\"'")


class Block:
    """A stretch between certain boundaries: its words, and for each gap before a word whether it is open."""

    __slots__ = ("starts", "ends", "words", "open")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.words: list[str] = []
        self.open: list[bool] = []


def _lines(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, joined): the text's lines; joined if a line goes on where the one before was wrapped."""
    spans, at = [], 0
    for m in _BREAK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    shown = [len(_HIDDEN.sub("", text[a:b]).strip()) for a, b in spans]
    widest = max(shown)
    out = []
    for i, (a, b) in enumerate(spans):
        joined = False
        if i and shown[i] and shown[i - 1]:
            first = _CHUNK.search(text, a, b).group()
            if widest <= WIDEST and len(spans) > 1:
                joined = shown[i - 1] + 1 + len(first) > widest
            # a line that stops without end mark before a small letter was broken in any case
            if not joined and text[a:b].lstrip()[0].islower() and not _ENDS.search(text[spans[i - 1][0] : spans[i - 1][1]].rstrip()):
                joined = True
        out.append((a, b, joined))
    return out


def _enclosed(tokens: list[tuple[str, int, int]], text: str) -> list[int]:
    """For each token the number of closed pairs around the gap before it."""
    depth = [0] * (len(tokens) + 1)
    stack: list[tuple[str, int]] = []
    for i, (tok, a, b) in enumerate(tokens):
        if len(tok) != 1 or tok.isalnum():
            continue
        before, after = text[a - 1 : a], text[b : b + 1]
        closes = None
        for k in range(len(stack) - 1, max(-1, len(stack) - 5), -1):
            if tok in stack[k][0]:
                # an apostrophe inside a word or before one closes nothing
                if tok in "’'" and after.isalpha():
                    break
                closes = k
                break
        if closes is not None:
            opened = stack[closes][1]
            del stack[closes:]
            depth[opened + 1] += 1
            depth[i + 1] -= 1
        elif tok in _PAIRS and (tok != "»" or not before.strip() or before in "([„（"):
            stack.append((_PAIRS[tok], i))
        elif tok in "\"" and (not before.strip() or before in "(["):
            stack.append(('"', i))
    total, out = 0, []
    for d in depth:
        total += d
        out.append(total)
    return out


def blocks(text: str) -> Iterator[Block]:
    """The stretches of a text between certain boundaries."""
    group: list[tuple[int, int]] = []
    for a, b, joined in _lines(text):
        if group and not joined:
            yield from _block(text, group)
            group = []
        if text[a:b].strip():
            group.append((a, b))
    if group:
        yield from _block(text, group)


def _block(text: str, lines: list[tuple[int, int]]) -> Iterator[Block]:
    a, b = lines[0][0], lines[-1][1]
    tokens: list[tuple[str, int, int]] = []
    kinds: list[str] = []
    for m in _TOKEN.finditer(text, a, b):
        tokens.append((m.group(), m.start(), m.end()))
        kinds.append(m.lastgroup)
    if not tokens:
        return
    depth = _enclosed(tokens, text)
    out = Block()
    for i, ((tok, s, e), kind) in enumerate(zip(tokens, kinds, strict=True)):
        gap = i > 0 and depth[i] == 0 and _may_end(text, tokens, kinds, i)
        if kind in ("run", "han") and len(tok) > RUN_EDGE:
            out.words += [tok[:RUN_EDGE] + "~", "~" + tok[-RUN_EDGE:]]
            out.starts += [s, e - 1]
            out.ends += [s + 1, e]
            out.open += [gap, False]
        else:
            out.words.append(tok)
            out.starts.append(s)
            out.ends.append(e)
            out.open.append(gap)
    yield out


def _may_end(text: str, tokens: list[tuple[str, int, int]], kinds: list[str], i: int) -> bool:
    """Whether a sentence can end in the gap before token i at all."""
    tok, s, _ = tokens[i]
    spaced = s > tokens[i - 1][2]
    # back over closing marks to what they close
    k = i - 1
    while k >= 0 and tokens[k][0] in _CLOSERS:
        k -= 1
    if k < 0:
        return False
    left, kind = tokens[k][0], kinds[k]
    if spaced and ((kind == "run" or kinds[i - 1] == "run" or kinds[i] == "run") and (k == i - 1 or kind == "run")):
        return True
    ended = bool(_ENDS.search(left)) or (left in ";;" and k > 0 and bool(_GREEK.search(tokens[k - 1][0])))
    if not ended:
        return False
    if tok in _CLOSERS and not (tok in "“‘»" and tok in _PAIRS and spaced and text[tokens[i][2] : tokens[i][2] + 1].strip()):
        return False
    if kinds[i] == "end" or tok in ",;:·،、，；：-–—/":
        return False
    first = tok[0]
    if first.islower() or _OMISSION.match(text, s):
        return False
    if not spaced and left[-1] not in "。！？｡।" and kinds[i] != "han":
        # no space: only after a whole word and before a capital or an opening mark
        word = left.rstrip(".!?…") or (tokens[k - 1][0] if k else "")
        return len(word) >= 3 and word[-1].isalpha() and not word.isupper() and (first.isupper() or first in "«„“(¿¡" or not first.isascii()) and (kinds[k] != "num")
    return True


_ROMAN = regex.compile(r"[IVXLC]+\.?$")
_INITIALS = regex.compile(r"(?:\p{Lu}\p{M}*\.-?)+$")


def shape(word: str) -> str:
    """What stands for a word that isn't in the vocabulary."""
    dot = "." if word[-1] == "." and len(word) > 1 else ""
    core = word[: len(word) - len(dot)]
    if core[0].isdigit():
        return ("N" + str(min(len(core), 5)) if core.isdigit() else "N,N") + dot
    if not core[0].isalpha():
        return core[0] if len(core) == 1 else core[:2]
    if _ROMAN.match(word):
        return "ROMAN" + dot
    if core[-1] == "~":
        return "~run"
    if core[0] == "~":
        return "run~"
    if core.isupper():
        return ("X" if len(core) == 1 else "XX") + dot
    return ("Xx" if core[0].isupper() else "xx" if core[0].islower() else "cc") + ("-" if "-" in core else "") + dot


def classify(word: str, known: frozenset[str]) -> str:
    if word[0].isdigit():
        return shape(word)
    if len(word) == 2 and word[1] == "." and word[0].isupper():
        return "X."
    if word in known:
        return word
    return "X.X." if _INITIALS.match(word) else shape(word)


class EventModel:
    """Trigram model over words and boundary tokens, with Witten-Bell smoothing."""

    def __init__(self, known: frozenset[str], counts: dict[tuple[str, str, str], float]):
        self.known = known
        self.tri = dict(counts)
        self.bi: dict[tuple[str, str], float] = defaultdict(float)
        self.uni: dict[str, float] = defaultdict(float)
        h2: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
        for (u, v, w), n in counts.items():
            self.bi[v, w] += n
            self.uni[w] += n
            if u:
                x = h2[u, v]
                x[0] += n
                x[1] += 1
        h1: dict[str, list[float]] = defaultdict(lambda: [0.0, 0])
        for (v, _), n in self.bi.items():
            x = h1[v]
            x[0] += n
            x[1] += 1
        self.h2, self.h1 = dict(h2), dict(h1)
        self.bi, self.uni = dict(self.bi), dict(self.uni)
        self.total = sum(self.uni.values()) + len(self.uni) + 1

    def p(self, u: str, v: str, w: str) -> float:
        low = (self.uni.get(w, 0) + 1) / self.total
        x = self.h1.get(v)
        if x:
            low = (self.bi.get((v, w), 0) + x[1] * low) / (x[0] + x[1])
        x = self.h2.get((u, v))
        return (self.tri.get((u, v, w), 0) + x[1] * low) / (x[0] + x[1]) if x else low

    def posteriors(self, words: list[str], open_: list[bool]) -> list[float]:
        """The probability of a boundary in the gap before each word, by forward and backward sums over the events."""
        n, p = len(words), self.p
        out = [0.0] * n
        i = 1
        while i < n:
            if not open_[i]:
                i += 1
                continue
            # a chain: open gaps so near each other that their events share a trigram
            j = i
            while j + 1 < n and (open_[j + 1] or open_[j] or (j + 2 < n and open_[j + 2])):
                j += 1
            self._chain(words, open_, i, min(j + 1, n), out, p)
            i = j + 1
        return out

    def _chain(self, words: list[str], open_: list[bool], a: int, b: int, out: list[float], p) -> None:
        """Gaps a..b-1; the gap before a - 1 holds no event, and so does every gap from b - 1 on that isn't open."""
        steps = []
        for k in range(a, b + 1):
            # k = b: the word after the chain, or the block's end, seen from both states of the last gap
            v = words[k - 1]
            rows = []
            for e in (0, 1):
                u = END if e else (words[k - 2] if k >= 2 else END)
                if k == len(words):
                    rows.append((p(u, v, END), 0.0))
                else:
                    stay = p(u, v, words[k])
                    rows.append((stay, p(u, v, END) * p(v, END, words[k]) if k < b and open_[k] else 0.0))
            steps.append(rows)
        fwd = [(1.0, 0.0)]
        for rows in steps:
            f0, f1 = fwd[-1]
            x, y = f0 * rows[0][0] + f1 * rows[1][0], f0 * rows[0][1] + f1 * rows[1][1]
            s = x + y or 1.0
            fwd.append((x / s, y / s))
        back = (1.0, 1.0)
        for k in range(b, a, -1):
            rows = steps[k - a]
            # back from the step into word k to the state of gap k - 1
            back = (rows[0][0] * back[0] + rows[0][1] * back[1], rows[1][0] * back[0] + rows[1][1] * back[1])
            s = back[0] + back[1] or 1.0
            back = (back[0] / s, back[1] / s)
            g = k - 1
            f0, f1 = fwd[g - a + 1]
            z = f0 * back[0] + f1 * back[1]
            out[g] = f1 * back[1] / z if z > 0 else 0.0


def _ngrams(words: list[str], open_: list[bool], events: list[bool] | None, into: Counter) -> None:
    """Counts a block's trigrams of word classes (u, v, w, kind). If the event of a gap is hidden, the three words that end after it are counted as GAP, those that begin before it as AFTER."""
    stream: list[str | None] = ["", END, words[0]]
    for i in range(1, len(words)):
        if open_[i]:
            if events is None:
                into[words[i - 2] if i > 1 else "", words[i - 1], words[i], GAP] += 1
                if i + 1 == len(words):
                    into[words[i - 1], words[i], END, AFTER] += 1
                elif not open_[i + 1]:
                    into[words[i - 1], words[i], words[i + 1], AFTER] += 1
                stream += [None, words[i]]
                continue
            if events[i]:
                stream.append(END)
        stream.append(words[i])
    stream.append(END)
    for j in range(2, len(stream)):
        if stream[j] is not None and stream[j - 1] is not None and stream[j - 2] is not None:
            into[stream[j - 2], stream[j - 1], stream[j], CERTAIN] += 1


def _settle(counts: dict[tuple[str, str, str, int], int]) -> dict[tuple[str, str, str], float]:
    """Shares the hidden gaps out between boundary and none, by how often a word ends a paragraph.

    A word that ends sentences ends paragraphs too, in the ratio of all words that do, or not far below;
    one that is often before an open gap and hardly ever at a paragraph's end is an abbreviation or the like.
    In the same way a word that begins sentences begins paragraphs.
    """
    out: dict[tuple[str, str, str], float] = defaultdict(float)
    # certain boundaries and open gaps: after v, after u v, and before w
    certain: dict[tuple[str, str, str], float] = defaultdict(float)
    hidden: dict[tuple[str, str, str], float] = defaultdict(float)
    for (u, v, w, h), n in counts.items():
        if h == GAP:
            for k in {("left", "", v), ("left", u, v), ("right", "", w)}:
                hidden[k] += n
        elif h == CERTAIN:
            out[u, v, w] += n
        if h != GAP:
            if w == END:
                for k in {("left", "", v), ("left", u, v)}:
                    certain[k] += n
            elif v == END:
                certain["right", "", w] += n
    ratio = {}
    for side in ("left", "right"):
        both = [k for k in certain if k[0] == side and not k[1] and k in hidden]
        ratio[side] = sum(hidden[k] for k in both) / max(1.0, sum(certain[k] for k in both))

    def share(k: tuple[str, str, str], seen: float = 0.2) -> float:
        return min(1.0, ENOUGH * ratio[k[0]] * (certain.get(k, 0.0) + seen) / hidden[k]) if hidden.get(k) else 0.0

    for (u, v, w, h), n in counts.items():
        if h == AFTER:
            x = share(("left", "", u)) * share(("right", "", v))
            out[u, v, w] += (1 - x) * n
            out[END, v, w] += x * n
        elif h == GAP:
            left = share(("left", "", v))
            if u and hidden["left", u, v] >= 10:
                left = max(left, share(("left", u, v), 0.0))
            x = left * share(("right", "", w))
            if x < 1:
                out[u, v, w] += (1 - x) * n
            if x > 0:
                out[u, v, END] += x * n
                out[v, END, w] += x * n
    return out


_CUT = ("words array<string>", "open array<boolean>", "starts array<int>", "ends array<int>", "sizes array<int>")


def cut(df: DataFrame, key: str) -> DataFrame:
    """(key, text, words, open, starts, ends, sizes): each text that isn't blank with its blocks one after another; sizes: the words of each block."""
    chosen = df.select(key, "text")
    kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CUT_ROWS):
                part = b.slice(at, CUT_ROWS)
                ids: list[int] = []
                cols: list[list[list]] = [[], [], [], [], []]
                for i, x in enumerate(part.column(1)):
                    text = x.as_py()
                    if not text or not text.strip():
                        continue
                    ids.append(i)
                    found = list(blocks(text))
                    for c, name in zip(cols, ("words", "open", "starts", "ends"), strict=False):
                        c.append([v for block in found for v in getattr(block, name)])
                    cols[4].append([len(block.words) for block in found])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(ids, pa.int32())) for c in (0, 1)), *(pa.array(c, pa.list_(t)) for c, t in zip(cols, kinds, strict=True))], [key, "text", *(c.split()[0] for c in _CUT)])

    return chosen.mapInArrow(run, f"{key} {dict(chosen.dtypes)[key]}, text string, {', '.join(_CUT)}")


def _blocks_of(words: list[str], open_: list[bool], sizes: list[int]) -> Iterator[tuple[list[str], list[bool]]]:
    at = 0
    for n in sizes:
        yield words[at : at + n], open_[at : at + n]
        at += n


class Classes(dict):
    """The class of each word, worked out once."""

    def __init__(self, known: frozenset[str]):
        self.known = known

    def __missing__(self, word: str) -> str:
        if len(self) > FLUSH:
            self.clear()
        got = self[word] = classify(word, self.known)
        return got


def _least(counts: DataFrame, most: int, least: int) -> int:
    """The least count for which at most so many rows of counts (n) have it or more: whole classes of equal counts stay or go."""
    sizes = sorted(((r.n, r.rows) for r in counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, bound = 0, sizes[0][0] + 1 if sizes else least
    for n, rows in sizes:
        total += rows
        if total > most:
            break
        bound = n
    return bound


def _vocabulary(table: DataFrame, keep) -> frozenset[str]:
    counts = keep(table.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    return frozenset(counts.where(F.col("n") >= _least(counts, VOCABULARY, LEAST_COUNT)).select("w").toArrow()["w"].to_pylist())


def _learn(table: DataFrame, known: frozenset[str], model: EventModel | None, keep) -> EventModel:
    """A model of all texts: open gaps hidden, or decided by the model given."""
    sent = table.sparkSession.sparkContext.broadcast((known, model))

    def rows(n: Counter) -> pa.RecordBatch:
        keys = list(n)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([k[3] for k in keys], pa.int32()), pa.array(list(n.values()), pa.int64())], ["u", "v", "w", "h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = sent.value
        classes = Classes(known)
        n: Counter = Counter()
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for words, open_ in _blocks_of(*row):
                    words = [classes[w] for w in words]
                    _ngrams(words, open_, None if model is None else [x > 0.5 for x in model.posteriors(words, open_)], n)
                if len(n) > FLUSH:
                    yield rows(n)
                    n.clear()
        yield rows(n)

    grams = table.select("words", "open", "sizes").mapInArrow(count, "u string, v string, w string, h int, n bigint").groupBy("u", "v", "w", "h").agg(F.sum("n").alias("n"))
    grams = keep(grams, "grams")
    kept = grams.where(F.col("n") >= _least(grams, NGRAMS, 1)).toArrow()
    return EventModel(known, _settle(dict(zip(zip(*(kept[c].to_pylist() for c in "uvwh"), strict=True), kept["n"].to_pylist(), strict=True))))


def _train(table: DataFrame, keep) -> EventModel:
    known = _vocabulary(table, keep)
    return _learn(table, known, _learn(table, known, None, keep), keep)


def train(df: DataFrame) -> EventModel:
    """The model of df's texts, learnt in two rounds."""
    keep = Scratch(df.sparkSession).keep
    return _train(keep(cut(df.select("text", F.lit(0).alias("key")), "key"), "blocks"), keep)


def split(text: str | None, model: EventModel) -> list[tuple[int, int, float]]:
    """(start, end, sure) of each unit; offsets in characters without white space and invisible marks at the ends; sure is its end's posterior."""
    if not text or not text.strip():
        return []
    found = list(blocks(text))
    flat = [[v for block in found for v in getattr(block, name)] for name in ("words", "open", "starts", "ends")]
    return _units(text, *flat, [len(block.words) for block in found], model, Classes(model.known))


def _units(text: str, words: list[str], open_: list[bool], starts: list[int], ends: list[int], sizes: list[int], model: EventModel, classes: Classes) -> list[tuple[int, int, float]]:
    out, at = [], 0
    for n, (own, gaps) in zip(sizes, _blocks_of(words, open_, sizes), strict=True):
        prob = model.posteriors([classes[w] for w in own], gaps)
        first = 0
        for i in range(1, n + 1):
            if i == n or prob[i] > 0.5:
                a, b = starts[at + first], starts[at + i] if i < n else ends[at + n - 1]
                part = text[a:b]
                lead, tail = _EDGE.match(part), len(part)
                while tail and _EDGE.fullmatch(part[tail - 1]):
                    tail -= 1
                out.append((a + (lead.end() if lead else 0), a + tail, prob[i] if i < n else 1.0))
                first = i
        at += n
    return [x for x in out if x[0] < x[1]]


def sentence_units(df: DataFrame, key: str = "tml_id", model: EventModel | None = None) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos, confidence, sentence) of each sentence of df (key, text).

    Null, empty and blank texts give no row, a text without letters one unit per line. Repeated rows
    give repeated rows; other columns are ignored, an earlier splitter's too.
    """
    keep = Scratch(df.sparkSession).keep
    table = keep(cut(df, key), "blocks")
    sent = df.sparkSession.sparkContext.broadcast(model or _train(table, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        classes = Classes(model.known)
        for b in batches:
            ids, cols = [], [[], [], [], [], []]
            for i, (text, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 7)), strict=True)):
                for n, (s, e, p) in enumerate(_units(text, *row, model, classes)):
                    ids.append(i)
                    for c, value in zip(cols, (n, s, e, round(p, 6), text[s:e]), strict=True):
                        c.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True))],
                [key, "sentence_no", "start_pos", "end_pos", "confidence", "sentence"],
            )

    return table.select(key, "text", *(c.split()[0] for c in _CUT)).mapInArrow(run, f"{key} {dict(table.dtypes)[key]}, sentence_no bigint, start_pos bigint, end_pos bigint, confidence double, sentence string")
