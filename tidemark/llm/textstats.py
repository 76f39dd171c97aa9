"""Statistics of a text's quality, and whether it is natural prose.

Texts are read by the batch, as arrays of characters.  Lines are told to belong
to a table or list by three things: delimiters that stand in the same column, or
in the same sequence, line after line; indentation that repeats with a period;
and line lengths that are alike or repeat with a period (autocorrelation at
every lag).  The share of characters in such lines decides, together with the
ratios of words, symbols and punctuation.  Text whose words or letters are in no
order that language has is told by a likelihood ratio: pairs of neighbours, as
counted over the whole corpus, against the same words or letters in any order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, spread
from .arrow import numbers


@dataclass(frozen=True)
class ProseParams:
    """Limits of the rules; lengths are in characters."""

    case_share: float = 0.5  # of characters outside prose from which a text is a case
    symbol_share: float = 0.25  # of characters that are neither letters, digits nor marks of a sentence
    plain_share: float = 0.55  # of tokens that are plain words, below which a text is no prose
    least_letters: float = 0.05
    short_words: float = 1.7  # mean length of words
    long_token: int = 40
    repeat_run: int = 8  # words
    repeat_share: float = 0.3  # of distinct runs of words, below which a text is merely repeated
    numeric_share: float = 0.6  # of a line's tokens
    cell_tokens: int = 3  # tokens a cell has on average, where a line has few delimiters
    item_words: float = 3.2  # words an item of a list inside a line has on average
    item_common: float = 0.12  # of common words among them
    line_words: float = 1.6  # words a line has at most on average, where sentences are broken apart by the word
    short_line: int = 64
    outline_line: int = 200  # length up to which an indented line can be an item
    outline_lines: int = 6  # lines that an outline has at least
    period: float = 0.3  # autocorrelation from which a sequence repeats; more for few lines
    order_margin: float = 6.0  # of the logarithm of the likelihood ratio: one text in some hundreds has no order
    some_common: float = 0.1  # of common words, from which a text is in a language, however rare that is in the corpus
    order_strength: float = 20.0  # pairs' worth of the assumption that there is no order
    max_common: int = 1000  # classes of common words whose pairs are counted
    most_words: int = 100_000  # common words, all languages together, that go to every task


#: What a character is.
OTHER, SPACE, LINE, LETTER, WIDE, DIGIT, MARK, JOINER, PICTURE = range(9)
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
MARKS = "'’‘`´-.,!?;:\"()“”„«»…–—¿¡、。，！？：（）「」『』・··"
TERMINAL = ".!?…。！？"
ENDINGS = TERMINAL + ";:·\"')”’»"
#: Letters that pairs are counted of; all others are one.
LETTERS = 1024


class Alphabet:
    """Tables by code point, filled as characters are met."""

    def __init__(self):
        size = 0x110000
        self.known, self.kind = np.zeros(size, bool), np.zeros(size, np.uint8)
        self.symbol, self.lower = np.zeros(size, bool), np.arange(size, dtype=np.int32)

    def meet(self, points: np.ndarray) -> None:
        here = np.zeros(len(self.known), bool)
        here[points] = True
        for o in np.flatnonzero(here & ~self.known).tolist():
            c = chr(o)
            self.known[o] = True
            self.kind[o] = self._kind(c, o)
            self.symbol[o] = self._symbol(c, o)
            low = c.lower()
            # The two small sigmas are one, as capitals don't tell them apart.
            self.lower[o] = 0x3C3 if low == "ς" else ord(low) if len(low) == 1 else o

    @staticmethod
    def _kind(c: str, o: int) -> int:
        if c in LINE_ENDS:
            return LINE
        if c.isspace():
            return SPACE
        if o in (0x200D, 0xFE0F, 0xFEFF, 0x200B) or unicodedata.category(c) in ("Mn", "Me", "Cf"):
            return JOINER
        if 0x3040 <= o <= 0x30FF and c.isalpha() or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF:
            return WIDE
        if c.isalpha():
            return LETTER
        if c.isalnum():
            return DIGIT
        if c in MARKS:
            return MARK
        return PICTURE if 0x2600 <= o <= 0x27BF or o >= 0x1F000 else OTHER

    @staticmethod
    def _symbol(c: str, o: int) -> bool:
        """Neither letter, digit nor mark of a sentence; pictographs and what joins them are words of their own."""
        if c.isalnum() or c.isspace() or c in "'’-.,!?" or 0x2600 <= o <= 0x27BF or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF1F or o >= 0x1F000:
            return False
        return o not in (0x200D, 0xFE0F, 0xFEFF) and not 0x300 <= o <= 0x36F


_ALPHABET: list[Alphabet] = []


def alphabet() -> Alphabet:
    """One for each Python process."""
    if not _ALPHABET:
        _ALPHABET.append(Alphabet())
    return _ALPHABET[0]


#: An odd multiplier, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of a number modulo 2**64, from the 0th to the n-th."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(max(n + 1, 1 << 12), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][: n + 1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, the same for equal spans wherever they stand."""
    with np.errstate(over="ignore"):
        upto = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(values))[:-1], out=upto[1:])
        h = (upto[end] - upto[start]) * _powers(UNBASE, len(values))[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def text_hash(word: str) -> int:
    """``span_hashes`` of one word in small letters."""
    points = np.array([0x3C3 if c == "ς" else ord(c) for c in word.lower()], np.int32)
    return int(span_hashes(points, np.zeros(1, np.int64), np.array([len(points)]))[0])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where unbroken stretches of a mask begin, and end."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return edge[0::2], edge[1::2]


@dataclass(frozen=True)
class Vocabulary:
    """Common words: their hashes in order, which of them each language has, and their classes (1 and up)."""

    hashes: np.ndarray
    langs: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(common: dict[str, frozenset[str]], most: int) -> Vocabulary:
        words = sorted({text_hash(w) for ws in common.values() for w in ws if w})
        place = {h: i for i, h in enumerate(words)}
        langs = np.zeros((len(common), len(words)), bool)
        for k, lang in enumerate(sorted(common)):
            langs[k, [place[text_hash(w)] for w in common[lang] if w]] = True
        return Vocabulary(np.array(words, np.uint64), langs, np.arange(len(words)) % most + 1)

    @property
    def size(self) -> int:
        return int(self.classes.max(initial=0)) + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


@dataclass(frozen=True)
class OrderModel:
    """How much likelier pairs of neighbours are than in no order: logarithms by pair, and by first part for pairs never met."""

    size: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    unmet: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @staticmethod
    def of(size: int, keys: np.ndarray, counts: np.ndarray, strength: float) -> OrderModel:
        """From the counts of pairs, key = first part * ``size`` + second part."""
        if not len(keys):
            return OrderModel(size)
        counts = counts.astype(float)
        first = np.bincount(keys // size, counts, size)
        second = np.bincount(keys % size, counts, size) / counts.sum()
        share = second[keys % size]
        gain = np.log((counts + strength * share) / (first[keys // size] + strength) / share)
        return OrderModel(size, keys, gain.astype(np.float32), np.log(strength / (first + strength)).astype(np.float32))

    def table(self) -> np.ndarray | None:
        if not len(self.keys):
            return None
        out = np.repeat(self.unmet, self.size)
        known = np.zeros(self.size, bool)
        known[self.keys % self.size] = True
        out.reshape(self.size, self.size)[:, ~known] = 0.0
        out[self.keys] = self.gain
        return out


class Words:
    """The characters of some texts, one behind the other, and their words.  Spans are [start, end)."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary):
        a = alphabet()
        texts = [t or "" for t in texts]
        self.n = len(texts)
        self.cp = cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.int32)
        a.meet(cp)
        self.kind, self.size = a.kind[cp], np.array([len(t) for t in texts], np.int64)
        self.stop = np.cumsum(self.size + 1) - 1  # where each text's own end stands
        kind, low = self.kind, a.lower[cp]
        self.letter = (kind == LETTER) | (kind == WIDE)
        inside = self.letter | (kind == DIGIT)
        join = (cp == 0x27) | (cp == 0x2019) | (cp == 0x2D)
        join[1:-1] &= inside[:-2] & inside[2:]
        join[[0, -1]] = False
        self.start, self.end = runs_of(inside | join)
        self.doc = np.searchsorted(self.stop, self.start)
        self.hash = span_hashes(low, self.start, self.end)
        self.place = vocabulary.find(self.hash)
        self.low = low

    def letter_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where two letters stand together, and their pair."""
        some = (self.kind == LETTER) & (self.low < LETTERS)
        at = np.flatnonzero(some[:-1] & some[1:])
        return at, self.low[at].astype(np.int64) * LETTERS + self.low[at + 1]

    def word_pairs(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Words that are common or followed by a common one, by the place of the first, and their pair of classes."""
        c = np.where(self.place >= 0, v.classes[self.place] if len(v.classes) else 0, 0)
        at = np.flatnonzero((self.doc[:-1] == self.doc[1:]) & ((c[:-1] > 0) | (c[1:] > 0)))
        return at, c[at] * v.size + c[at + 1]


def _autocorrelation(x: np.ndarray, p: ProseParams) -> float:
    """The largest autocorrelation of a sequence at any lag up to its half; 1 for a constant one, 0 where chance gives as much."""
    n = len(x)
    if n < 4:
        return 0.0
    y = x - x.mean()
    v = float((y * y).mean())
    if v < 1e-9:
        return 1.0
    f = np.fft.rfft(y, 2 * n)
    lag = np.arange(1, n // 2 + 1)
    r = np.fft.irfft(f * np.conj(f), 2 * n)[lag] / (n - lag) / v
    best = float(r.max())
    return best if best > 2 / np.sqrt(n) else 0.0


PROSE, LIST, TABLE, TAG = range(4)


class Lines:
    """The lines of some texts that aren't blank, and what each belongs to."""

    def __init__(self, w: Words, p: ProseParams):
        cp, kind = w.cp, w.kind
        space, ends = kind == SPACE, np.flatnonzero(kind == LINE)
        ink = ~space & (kind != LINE) & (kind != JOINER)
        at = np.flatnonzero(ink)
        begin = np.r_[0, ends[:-1] + 1]
        a, b = np.searchsorted(at, begin), np.searchsorted(at, ends)
        full = b > a
        self.place = np.cumsum(full) - 1  # of every line, among those that aren't blank
        self.of = np.cumsum(kind == LINE) - (kind == LINE)  # the line of every character
        self.first, self.last, self.begin = at[a[full]], at[b[full] - 1] + 1, begin[full]
        self.n = n = len(self.first)
        self.doc = np.searchsorted(w.stop, self.first)
        self.length = self.last - self.first
        self.indent = self.first - self.begin
        self.indent += 3 * self._count((cp == 9), self.begin, self.first)
        self.last_point = cp[self.last - 1]
        self.small = (w.low[self.first] == cp[self.first]) & (kind[self.first] == LETTER)  # begins with a small letter
        self.same = np.r_[False, self.doc[1:] == self.doc[:-1]] if n else np.zeros(0, bool)
        # Tokens: what stands between blanks.
        ts, te = runs_of(ink | (kind == JOINER))
        line = self.place[self.of[ts]]
        keep = full[self.of[ts]]
        self.ts, self.te, self.tl = ts[keep], te[keep], line[keep]
        letters, digits, marks, pictures = (self._count(m, self.ts, self.te) for m in (w.letter, kind == DIGIT, kind == MARK, kind == PICTURE))
        others = self._count(kind == OTHER, self.ts, self.te)
        # In scripts without blanks between words a token is a sentence, numbers included.
        self.plain = (letters > 0) & (others == 0) & ((digits == 0) | (self._count(kind == WIDE, self.ts, self.te) > 0))
        self.numeric = (digits > 0) & (letters == 0)
        self.pictured = (pictures > 0) & (letters == 0) & (digits == 0)
        self.tokens = np.bincount(self.tl, minlength=n)
        self.kinds = np.zeros(n, np.int8)
        if n:
            self._judge(w, p, space, ink, letters, digits, marks, pictures)

    @staticmethod
    def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(mask)]
        return upto[end] - upto[start]

    def _beside(self, x: np.ndarray) -> np.ndarray:
        """Lines whose ``x``, if it isn't 0, is that of a neighbouring line of the text."""
        same = np.r_[False, (x[1:] == x[:-1]) & (x[1:] != 0)] & self.same
        return same | np.r_[same[1:], False]

    def _judge(self, w: Words, p: ProseParams, space, ink, letters, digits, marks, pictures) -> None:
        n, cp, kind = self.n, w.cp, w.kind
        ratio = lambda mask: np.bincount(self.tl[mask], minlength=n) / self.tokens
        numeric, plain, picture = ratio(self.numeric), ratio(self.plain), ratio(self.pictured)
        words_line = self.place[self.of[w.start]]
        words = np.bincount(words_line, minlength=n)
        common = np.bincount(words_line[w.place >= 0], minlength=n)

        # Delimiters: what is no mark of a sentence where it stands, and wide gaps by where cells begin and end.
        after, before = np.r_[space[1:] | (kind[1:] == LINE), True], np.r_[True, space[:-1] | (kind[:-1] == LINE)]
        tab = cp == 9
        first, last = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
        first[self.first], last[self.last - 1] = True, True
        dash = (cp == 0x2D) | (cp == 0x2013) | (cp == 0x2014)
        sign = (kind == OTHER) | (cp == 0x3A) | (cp == 0x3B) & ~after | (cp == 0x2C) & ~after | dash & before & after
        cell = ink & ~first & np.r_[False, False, space[1:-1] & (space[:-2] | tab[1:-1])]
        cell_end = ink & ~last & np.r_[space[1:-1] & (space[2:] | tab[1:-1]), False, False]
        # The left edge is one for all lines, so where first cells end tells nothing.
        cell_end &= self._count(cell, self.begin[np.maximum(self.place[self.of], 0)], np.arange(1, len(cp) + 1)) > 0
        at = np.flatnonzero(sign | cell)
        code = np.where(sign[at], cp[at], 1 << 21)
        line = self.place[self.of[at]]
        delimiters = np.bincount(line, minlength=n)
        edge = np.searchsorted(line, np.arange(n + 1))
        skeleton = np.where(delimiters > 0, span_hashes(code, edge[:-1], edge[1:]), np.uint64(0))
        cells = np.where(delimiters > 1, 2, 1) * p.cell_tokens * (delimiters + 1)
        in_sequence = self._beside(skeleton) & (self.tokens <= cells)
        aligned = self._aligned(cp, np.r_[at, np.flatnonzero(cell_end)], np.r_[code, np.full(int(cell_end.sum()), (1 << 21) + 1)])

        # What stands at the left edge, line after line: a sign, a number, or one letter with a mark.
        ft = np.searchsorted(self.tl, np.arange(n))
        size = self.te[ft] - self.ts[ft]
        bare, numbered = (letters[ft] == 0) & (digits[ft] == 0) & (size <= 3) & (pictures[ft] == 0), (digits[ft] > 0) & (letters[ft] <= 2)
        lettered = (letters[ft] == 1) & (marks[ft] > 0) & (size <= 3)
        shape = np.select([bare, numbered, lettered], [1, 2, 3]) * (self.tokens > 1)
        marked = self._beside(shape)

        # Items behind one another in a line, with hardly a word that joins them.
        items = np.max([np.bincount(self.place[self.of[np.flatnonzero(m)]], minlength=n) for m in (cp == 0x2C, cp == 0x3B, (cp == 0x2F) & before & after, (cp == 0xB7) | (cp == 0x2022), cp == 0x7C)], axis=0)
        listed = (items >= 5) & (words > 0) & (words <= p.item_words * (items + 1)) & (common <= p.item_common * words)

        ruled = (self.tokens > 0) & (words == 0) & (self.length >= 4) & (picture == 0)
        numbers_only = (self.tokens > 1) & (numeric >= p.numeric_share)
        no_words = (self.tokens > 2) & (plain < 0.3) & (picture < 0.5) & (numeric < 0.3)
        rules = [
            (numbers_only | ruled, TABLE),
            (marked & (delimiters <= 1), LIST),
            (no_words & ~aligned, TAG),
            (aligned | in_sequence & (delimiters > 1), TABLE),
            (no_words, TAG),
            (marked | in_sequence | listed, LIST),
        ]
        self.kinds = np.select([r for r, _ in rules], [k for _, k in rules], PROSE).astype(np.int8)
        self.delimited = aligned | in_sequence
        self._stretches(words, p)

    def _aligned(self, cp: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lines that have a delimiter in the same column, counted from the left, as two neighbouring lines."""
        line = self.place[self.of[at]]
        column = at - self.begin[line]
        some = (at > self.first[line]) & (column < 1 << 20)
        keys = np.unique(line[some].astype(np.int64) << 42 | code[some].astype(np.int64) << 20 | column[some])
        out = np.zeros(self.n, bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, keys + (1 << 42)), len(keys) - 1)
            hit = keys[at] == keys + (1 << 42)
            top = np.unique((keys >> 42)[hit & hit[at]])
            top = top[self.doc[top] == self.doc[top + 2]]
            out[np.r_[top, top + 1, top + 2]] = True
        return out

    def _stretches(self, words: np.ndarray, p: ProseParams) -> None:
        """Lists told by the lengths of short lines, and outlines by their indentation."""
        final = np.isin(self.last_point, [ord(c) for c in TERMINAL])
        for a, b in self._runs((self.kinds == PROSE) & (self.length <= p.short_line) & ~final, 3):
            size = self.length[a:b].astype(float)
            if words[a:b].mean() <= 5 or size.std() < 0.5 * size.mean() or _autocorrelation(size, p) > p.period:
                self.kinds[a:b] = LIST
        if not self.indent.any():
            return
        ended = np.isin(self.last_point, [ord(c) for c in ENDINGS])
        for a, b in self._runs((self.kinds == PROSE) & (self.length <= p.outline_line), p.outline_lines):
            indent, n = self.indent[a:b].astype(float), b - a
            most = np.unique(indent, return_counts=True)[1].max() / n
            # Lines of wrapped prose go on from line to line, and some of them end with a mark; items begin anew, and end alike.
            if most <= 0.8 and self.small[a:b].mean() <= 0.1 and not 0.1 < ended[a:b].mean() < 0.9 and _autocorrelation(indent, p) > p.period:
                self.kinds[a:b] = LIST

    def _runs(self, mask: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Stretches of ``least`` lines or more of one text for which the mask holds."""
        start, end = runs_of(mask)
        cuts = np.flatnonzero(mask & ~self.same)
        start, end = np.unique(np.r_[start, cuts]), np.unique(np.r_[end, cuts[np.r_[False, mask[:-1]][cuts]]])
        long = end - start >= least
        return list(zip(start[long].tolist(), end[long].tolist()))


COLUMNS = {
    "n_chars": "bigint",
    "n_words": "bigint",
    "n_lines": "bigint",
    "mean_word_length": "double",
    "symbol_ratio": "double",
    "punctuated_lines": "double",
    "common_words": "double",
    "plain_tokens": "double",
    "distinct_runs": "double",
    "letter_order": "double",
    "word_order": "double",
    "indent_period": "double",
    "length_period": "double",
    "aligned_lines": "double",
    "outside_prose": "double",
    "kind": "string",
}


class Judge:
    """Statistics and kinds of texts; made once for each task."""

    def __init__(self, vocabulary: Vocabulary, letters: OrderModel | None = None, words: OrderModel | None = None, p: ProseParams = ProseParams()):
        self.v, self.p = vocabulary, p
        self.letters, self.words = (m.table() if m else None for m in (letters, words))

    def measure(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """One value of each column for each text."""
        v, p = self.v, self.p
        w = Words(texts, v)
        n = w.n
        lines = Lines(w, p)
        share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
        per = lambda docs, weights=None: np.bincount(docs, weights, n)
        solid = (w.kind != SPACE) & (w.kind != LINE)
        edge = np.r_[0, w.stop[:-1] + 1]
        count = lambda mask: Lines._count(mask, edge, w.stop)
        n_solid, n_words, n_lines, n_tokens = count(solid), per(w.doc), per(lines.doc), per(lines.doc[lines.tl])
        out: dict[str, np.ndarray] = {"n_chars": w.size, "n_words": n_words, "n_lines": n_lines}
        out["mean_word_length"] = share(per(w.doc, w.end - w.start), n_words)
        out["symbol_ratio"] = share(count(alphabet().symbol[w.cp]), n_solid)
        ended = np.isin(lines.last_point, [ord(c) for c in ENDINGS])
        out["punctuated_lines"] = share(per(lines.doc[ended]), n_lines)
        out["common_words"] = share(np.max([per(w.doc[(w.place >= 0) & langs[w.place]]) for langs in v.langs], axis=0) if len(v.hashes) else np.zeros(n), n_words)
        token_doc = lines.doc[lines.tl]
        judged = ~lines.numeric & ~lines.pictured
        n_judged = per(token_doc[judged])
        out["plain_tokens"] = share(per(token_doc[lines.plain]), n_judged)
        out["distinct_runs"] = self._distinct_runs(w)
        for name, table, (at, pair), docs in (
            ("letter_order", self.letters, w.letter_pairs(), lambda at: np.searchsorted(w.stop, at)),
            ("word_order", self.words, w.word_pairs(v), lambda at: w.doc[at]),
        ):
            out[name] = per(docs(at), table[pair]) if table is not None else np.zeros(n)
        out["indent_period"], out["length_period"] = self._periods(lines, n)
        weight = [per(lines.doc[lines.kinds == k], lines.length[lines.kinds == k]) for k in range(4)]
        total = np.sum(weight, axis=0)
        out["aligned_lines"] = share(per(lines.doc[lines.delimited]) if lines.n else np.zeros(n), n_lines)
        out["outside_prose"] = outside = share(total - weight[PROSE], total)
        letters, wide = count(w.letter), count(w.kind == WIDE)
        long = per(token_doc, np.where(lines.te - lines.ts > p.long_token, lines.te - lines.ts, 0))
        narrow = wide < 0.2 * np.maximum(n_solid, 1)
        apart = outside > p.case_share
        junk = (
            (letters < p.least_letters * n_solid) & (count(w.kind == DIGIT) == 0)
            | ~apart & (out["symbol_ratio"] > p.symbol_share)
            | narrow & ~apart & (n_tokens >= 4) & (n_judged >= 3) & (out["plain_tokens"] < p.plain_share)
            | narrow & (long > 0.5 * n_solid)
            | narrow & (n_words >= 8) & (out["mean_word_length"] < p.short_words) & (letters > 0.5 * n_solid)
            | narrow & (n_lines >= 8) & (n_words <= p.line_words * n_lines) & (out["common_words"] > p.item_common)
            | ~apart & (n_words >= 1.5 * p.repeat_run) & (out["distinct_runs"] < p.repeat_share)
            | narrow & ~apart & (out["letter_order"] < -p.order_margin) & (out["common_words"] < p.some_common)
            | ~apart & (n_words >= 12) & (out["word_order"] < -p.order_margin)
        )
        most = np.argmax([weight[LIST], weight[TABLE], weight[TAG]], axis=0)
        kind = np.where(apart | self._under_one_sentence(w, lines, n), np.array(["list", "table", "junk"])[most], "prose").astype(object)
        kind[junk] = "junk"
        kind[n_solid == 0] = "blank"
        out["kind"] = kind
        return out

    def _distinct_runs(self, w: Words) -> np.ndarray:
        """Of each text's runs of words, the share of distinct ones; 1 where there are none."""
        r = self.p.repeat_run
        at = np.flatnonzero(w.doc[: max(0, len(w.doc) - r + 1)] == w.doc[r - 1 :]) if len(w.doc) >= r else np.zeros(0, np.int64)
        doc = w.doc[at]
        with np.errstate(over="ignore"):
            keys = span_hashes(w.hash, at, at + r) ^ (doc.astype(np.uint64) * np.uint64(UNBASE))
        order = np.argsort(keys)
        new = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(at) else np.zeros(0, bool)
        there, distinct = np.bincount(doc, minlength=w.n), np.bincount(doc[order[new]], minlength=w.n)
        return np.divide(distinct, there, out=np.ones(w.n), where=there > 0)

    def _periods(self, lines: Lines, n: int) -> tuple[np.ndarray, np.ndarray]:
        indent, length = np.zeros(n), np.zeros(n)
        edge = np.searchsorted(lines.doc, np.arange(n + 1))
        for d in np.flatnonzero(np.diff(edge) >= 4).tolist():
            a, b = edge[d], edge[d + 1]
            length[d] = _autocorrelation(lines.length[a:b].astype(float), self.p)
            if lines.indent[a:b].any():
                indent[d] = _autocorrelation(lines.indent[a:b].astype(float), self.p)
        return indent, length

    @staticmethod
    def _under_one_sentence(w: Words, lines: Lines, n: int) -> np.ndarray:
        """A list or table of some length below a single sentence."""
        prose = lines.kinds == PROSE
        n_prose = np.bincount(lines.doc[prose], minlength=n)
        some = (n_prose == 1) & (np.bincount(lines.doc[~prose], minlength=n) >= 3)
        # Marks that end a sentence with something behind them in that line.
        end = np.isin(w.cp, [ord(c) for c in TERMINAL])
        end[:-1] &= (w.kind[1:] == SPACE) | np.isin(w.cp[:-1], [ord(c) for c in "。！？"])
        at = lines.first[prose], lines.last[prose] - 1
        inner = np.bincount(lines.doc[prose], Lines._count(end, *at), n)
        return some & (inner == 0)


def vocabulary_of(common: DataFrame, p: ProseParams = ProseParams()) -> Vocabulary:
    """The common words of a table (``lang``, ``word``), some dozens a language."""
    words: dict[str, set[str]] = {}
    for lang, word in common.select("lang", "word").filter("lang is not null and word is not null").distinct().limit(p.most_words + 1).collect():
        words.setdefault(lang, set()).add(word)
    if sum(map(len, words.values())) > p.most_words:
        raise ValueError(f"more than {p.most_words} common words")
    return Vocabulary.of({k: frozenset(x) for k, x in words.items()}, p.max_common)


def _pieces(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts of about a million bytes together, or one."""
    size = numbers(pc.fill_null(pc.binary_length(texts), 0))
    part = np.cumsum(size) // most
    for x in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        if len(x):
            yield texts.slice(int(x[0]), len(x)).to_pylist()


def count_pairs(texts: Iterator[list[str | None]], v: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of letters (0) and of words (1) that stand together in some texts, and how often."""
    size = (LETTERS * LETTERS, v.size * v.size)
    total = [np.zeros(x, np.int64) for x in size]
    for some in texts:
        w = Words(some, v)
        for k, (_, pair) in enumerate((w.letter_pairs(), w.word_pairs(v))):
            total[k] += np.bincount(pair, minlength=size[k])
    for k in (0, 1):
        keys = np.flatnonzero(total[k])
        yield k, keys, total[k][keys]


def order_models(df: DataFrame, v: Vocabulary, text: str = "text", p: ProseParams = ProseParams()) -> tuple[OrderModel, OrderModel]:
    """The pairs of letters and of words of all texts of a table: ``LETTERS`` and the number of common words bound their number."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, n in count_pairs((some for b in batches for some in _pieces(b.column(0))), v):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(n)], names=["k", "pair", "n"])

    pairs = spread(df.select(col(text).cast("string").alias("t"))).mapInArrow(kernel, "k int, pair bigint, n bigint")
    got = pairs.groupBy("k", "pair").agg(F.sum("n").alias("n")).orderBy("k", "pair").toPandas()
    size = (LETTERS, v.size)
    return tuple(OrderModel.of(size[k], g["pair"].to_numpy(np.int64), g["n"].to_numpy(np.int64), p.order_strength) for k in (0, 1) for g in [got[got["k"] == k]])


def text_statistics(df: DataFrame, common: DataFrame, ident: str = "doc_id", text: str = "text", p: ProseParams = ProseParams()) -> DataFrame:
    """One row per row of ``df``: ``ident``, the statistics (``COLUMNS``) and ``kind``: blank, prose, list, table or junk.

    Null, empty and blank texts have the kind ``blank``.  Words are runs of letters and digits, with hyphens and apostrophes
    inside; ``symbol_ratio`` is over characters that aren't white space; ``common_words`` is the largest share that the words
    of one language of ``common`` (``lang``, ``word``) have; whole texts are read.  ``letter_order`` and ``word_order`` are
    logarithms of likelihood ratios by the pairs of all texts, which a first pass counts; little text gives values near 0.
    Repeated rows come out each, an empty table gives none, and of further columns none is read.  Only counts are shuffled.
    """
    v = vocabulary_of(common, p)
    models = order_models(df, v, text, p)
    src = spread(df.select(col(ident), col(text).cast("string").alias("\0text")))
    schema = f"`{ident}` {df.schema[ident].dataType.simpleString()}, " + ", ".join(f"{k} {x}" for k, x in COLUMNS.items())
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(v, *models, p)
        for b in batches:
            done = 0
            for some in _pieces(b.column(1)):
                got = judge.measure(some)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)), *[pa.array(got[k], arrow[x]) for k, x in COLUMNS.items()]], names=[ident, *COLUMNS])
                done += len(some)

    return src.mapInArrow(kernel, schema)
