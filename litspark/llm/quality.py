"""Per-document text statistics, and whether a document is natural prose.

Every line is labelled prose, list, table or junk by a hidden Markov model over line statistics, and a
document's label shares are taken over its characters. The model is trained here, of all documents: lines that
plain rules are sure of start the emissions, and Viterbi training goes on from there with all lines free to
change their label, but for those of texts that were scrambled for it. Whether words stand in a usual order is
one of the statistics: class bigrams are weighed against those of the same lines shuffled, which tells scrambled
text from prose. The labels are the model's own: no rule overrules them.

Texts are read once, into a written table of line statistics and word classes; training and labelling go over
that table. What a round of training needs of it are sums of whole numbers, so the model is the same however the
documents are dealt to tasks; whatever is drawn at random for a text is drawn by the text's own checksum.
"""

from __future__ import annotations

import re
import unicodedata as U
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import kept, table

#: Texts are worked on in groups of about so many characters; each text is always whole.
GROUP = 1_000_000

#: States of the model. Those after the first four are learnt of lines made for it: prose whose words stand in any order, a sentence
#: over and over, text spelt out, backwards, or of content words only, lists on a line, and single sentences.
PROSE, LIST, TABLE, JUNK, SCRAMBLED, REPEATED, SPELT, BACKWARDS, BARE, INLINE, ALONE = range(11)
STATES = 11
#: The label of each state.
LABEL_OF = np.array((PROSE, LIST, TABLE, JUNK, JUNK, JUNK, JUNK, JUNK, JUNK, LIST, PROSE))
LABELS = ("prose", "list", "table", "junk")

#: No state is held to be less likely than this at the start of a text or after another one, however rare in the documents.
RARE = 0.01

# Classes of characters.
BLANK, LOWER, UPPER, LETTER, DIGIT, STOP, PAUSE, QUOTE, SYMBOL, BAD = range(10)
SUFFIXES = 128
#: Words of a sequence that counts as repeated when it stands in the text again.
RUN = 5
#: Formulas in a line are no signs of markup or tables.
FORMULA = re.compile(r"\$[^$\n]{1,120}\$")
_B = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point below 0x20000; others count as the last of them."""
    kinds, low = np.full(0x20000, SYMBOL, dtype=np.uint8), np.arange(0x20000, dtype=np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        cat = U.category(ch)
        if ch.isspace():
            kinds[cp] = BLANK
        elif cat == "Ll":
            kinds[cp] = LOWER
        elif cat in ("Lu", "Lt"):
            kinds[cp] = UPPER
            if len(ch.lower()) == 1:
                low[cp] = ord(ch.lower())
        elif cat[0] in "LM":
            kinds[cp] = LETTER
        elif cat[0] == "N":
            kinds[cp] = DIGIT
        elif cat in ("Cc", "Co", "Cn", "Cs") or cp == 0xFFFD:
            kinds[cp] = BAD
    for chars, kind in ((".!?…。！？", STOP), (",;:、，；：", PAUSE), ("'\"()[]“”‘’„«»‹›-–—¿¡/%", QUOTE)):
        for ch in chars:
            kinds[ord(ch)] = kind
    return kinds, low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grow = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
    return grow(np.uint64(_B)), grow(np.uint64(pow(_B, -1, 1 << 64)))


def word_hash(word: str) -> int:
    codes = np.frombuffer(word.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(_mix((_mix(codes + np.uint64(17)) * _powers(1 << 16)[0][: len(codes)]).sum(dtype=np.uint64)))


class Lines:
    """Statistics of the non-blank lines of a group of texts, as arrays with an entry per line."""

    def __init__(self, texts: list[str], common: np.ndarray) -> None:
        texts = [FORMULA.sub(" ", t) if "$" in t else t for t in texts]
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.joined, self.wide = joined, 8 + len(common) + SUFFIXES > 1 << 16
        text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        self._read(codes, text_ends, len(texts), common)
        if self.count and len(joins := self._wrapped()):
            self._reread(codes, text_ends, joins, common)

    def _reread(self, codes: np.ndarray, text_ends: np.ndarray, joins: np.ndarray, common: np.ndarray) -> None:
        """Read the texts with wrapped lines again, without those line breaks, and put them in the place of what was read of them."""
        codes = codes.copy()
        for at in range(len(joins)):
            codes[joins[at][0] : joins[at][1]] = 32
        of = np.unique(np.searchsorted(text_ends, joins[:, 0]))
        text_begins = np.concatenate(([0], text_ends[:-1] + 1))
        some = Lines.__new__(Lines)
        sizes = text_ends[of] + 1 - text_begins[of]
        some._read(np.concatenate([codes[text_begins[i] : text_ends[i] + 1] for i in of]), np.cumsum(sizes) - 1, len(of), common)
        shift = (text_begins[of] - np.cumsum(sizes) + sizes)[some.text]
        some.begins, some.ends, some.text = some.begins + shift, some.ends + shift, of[some.text]
        stay = ~np.isin(self.text, of)
        by = np.argsort(np.concatenate((self.text[stay], some.text)), kind="stable")
        tokens = stay[self.tok_line]
        lines = np.empty(len(by), dtype=np.int64)
        lines[by] = np.arange(len(by))
        tok_line = lines[np.concatenate(((np.cumsum(stay) - 1)[self.tok_line[tokens]], stay.sum() + some.tok_line))]
        tok_by = np.argsort(tok_line, kind="stable")
        self.tok_line, self.tok_class = tok_line[tok_by], np.concatenate((self.tok_class[tokens], some.tok_class))[tok_by]
        for name, value in list(vars(self).items()):
            if isinstance(value, np.ndarray) and name not in ("tok_line", "tok_class"):
                setattr(self, name, np.concatenate((value[stay], getattr(some, name)))[by])
        self.count = len(by)

    def _wrapped(self) -> np.ndarray:
        """Where, from and to, a line break only wraps a sentence: the line is full and its block holds sentences."""
        flows = (self.block_stops >= 0.012) & (self.cells <= 0.1 * np.maximum(1, self.words)) & (self.words >= 2)
        on = (self.block[1:] == self.block[:-1]) & (self.marker[1:] == 0) & (self.end[:-1] != STOP) & flows[1:] & flows[:-1]
        on &= (self.filled[:-1] >= 0.7) & (self.length[:-1] >= 30) & (self.length[1:] <= 1.35 * self.length[:-1])
        at = np.flatnonzero(on)
        return np.column_stack((self.ends[at], self.begins[at + 1]))

    def _read(self, codes: np.ndarray, text_ends: np.ndarray, texts: int, common: np.ndarray) -> None:
        kinds, low = tables()
        capped = np.minimum(codes, np.uint32(0x1FFFF))
        kind, low = kinds[capped], low[capped]
        n = len(codes)
        brk = (codes == 10) | (codes == 13) | (codes == 0x2028) | (codes == 0x85) | (codes == 12)
        ends = np.flatnonzero(brk)
        begins = np.concatenate(([0], ends[:-1] + 1))
        solid = np.concatenate(([0], np.cumsum(kind != BLANK)))
        used = solid[ends] > solid[begins]
        gap = np.concatenate(([0], np.cumsum(~used & (ends > begins) | ~used & (codes[np.maximum(begins - 1, 0)] == 10) & (codes[ends] == 10))))
        begins, ends = begins[used], ends[used]
        self.text = np.searchsorted(text_ends, begins)
        self.count = m = len(begins)
        self.texts, self.begins, self.ends = texts, begins, ends
        if not m:
            return
        seen_gap = gap[:-1][used]
        count = lambda mask: (c := np.concatenate(([0], np.cumsum(mask, dtype=np.int64))))[ends] - c[begins]
        self.chars = solid[ends] - solid[begins]
        wordy = (kind >= LOWER) & (kind <= DIGIT)
        self.letters = count((kind >= LOWER) & (kind <= LETTER))
        self.digits, self.symbols = count(kind == DIGIT), count((kind == SYMBOL) | (kind == BAD))
        after = np.concatenate((kind[1:], [BLANK]))
        before = np.concatenate(([BLANK], kind[:-1]))
        word_after, word_before = (after >= LOWER) & (after <= DIGIT), (before >= LOWER) & (before <= DIGIT)
        stop = (kind == STOP) & (after != STOP) & ~word_after & (word_before | (before == QUOTE))
        self.stops = count(stop)
        self.commas = count((kind == PAUSE) | (codes == 47) & (before == BLANK) & (after == BLANK))
        tight = (kind >= STOP) & word_after & word_before & ~((kind == QUOTE) | (before == DIGIT) & (after == DIGIT))
        loose = (kind == SYMBOL) & (word_after | word_before) & (codes != 36) & (codes != 0x23)
        self.inside = count((tight & (codes != 46) & (codes != 44)) | loose & ~np.isin(codes, (43, 42, 60, 61, 62, 95, 123, 125, 124, 38, 0x2022)))
        tab = (codes == 9) | (codes == 124) | (codes == 38) | (codes == 61)
        packed = (codes == 44) & (after != BLANK) | (codes == 59) & (after != BLANK)
        wide = (codes == 32) & (after == BLANK) & (before != BLANK)
        self.cells = count(tab | packed & (after != QUOTE) & ~((before == DIGIT) & (after == DIGIT) & (codes == 59)) | wide)
        self.markup = count((codes == 60) | (codes == 123) | (codes == 92))
        # Words: where they start and end, their hashes, classes.
        first = wordy & ~word_before
        at = np.flatnonzero(first)
        to = np.flatnonzero(wordy & ~word_after) + 1
        with np.errstate(over="ignore"):
            up, down = _powers(1 << max(16, int(n).bit_length()))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(low.astype(np.uint64) + np.uint64(17)) * up[:n], dtype=np.uint64)))
            h = _mix((sums[to] - sums[at]) * down[at])
        size = to - at
        line = np.searchsorted(ends, at)
        line = np.minimum(line, m - 1)
        self.words = np.bincount(line, minlength=m)
        self.longest = np.zeros(m, dtype=np.int64)
        np.maximum.at(self.longest, line, size)
        self.word_chars = np.bincount(line, size, minlength=m)
        where = np.minimum(np.searchsorted(common, h), len(common) - 1) if len(common) else np.zeros(len(h), dtype=np.int64)
        is_common = common[where] == h if len(common) else np.zeros(len(h), dtype=bool)
        self.common = np.bincount(line, is_common, minlength=m)
        self.capitals = np.bincount(line, kind[at] == UPPER, minlength=m)
        # Tokens: words and signs in order, by class.
        last, last2 = low[to - 1].astype(np.int64), low[np.maximum(to - 2, at)].astype(np.int64)
        numeric = (kind[at] == DIGIT) & (kind[to - 1] == DIGIT)
        base = 8 + len(common)
        cls = np.where(is_common, 8 + where, np.where(numeric, 4, base + (last * 31 + last2 * 17) % SUFFIXES))
        sign = np.zeros(n, dtype=np.int64)
        sign[stop] = 1
        sign[kind == PAUSE] = 2
        sign[(kind == SYMBOL) | (kind == BAD)] = 3
        sign[at] = cls
        tok = np.flatnonzero(sign)
        self.tok_class = sign[tok]
        self.tok_line = np.minimum(np.searchsorted(ends, tok), m - 1)
        self.classes = base + SUFFIXES
        # Words that only repeat what came before: sequences of words seen earlier in the text.
        word_text = self.text[line]
        if len(h) >= RUN:
            whole = word_text[RUN - 1 :] == word_text[: len(h) - RUN + 1]
            with np.errstate(over="ignore"):
                run = word_text[: len(h) - RUN + 1].astype(np.uint64) * np.uint64(_B)
                for k in range(RUN):
                    run += h[k : len(h) - RUN + 1 + k] * np.uint64(2 * k + 3)
                run = _mix(run)[whole]
            of = line[: len(h) - RUN + 1][whole]
            _, firsts = np.unique(run, return_index=True)
            old = np.ones(len(run), dtype=bool)
            old[firsts] = False
            self.repeated = np.bincount(of, old, minlength=m) / np.maximum(1, np.bincount(of, minlength=m))
            self.repeatable = np.bincount(of, minlength=m)
        else:
            self.repeated, self.repeatable = np.zeros(m), np.zeros(m)
        # The whole line as one key: lines that repeat earlier ones of their text.
        with np.errstate(over="ignore"):
            whole = _mix((sums[ends] - sums[begins]) * down[begins] + self.text.astype(np.uint64) * np.uint64(_B))
        _, firsts = np.unique(whole, return_index=True)
        self.old_line = np.ones(m, dtype=bool)
        self.old_line[firsts] = False
        # Ends and beginnings.
        lead = np.searchsorted(solid, solid[begins] + 1) - 1
        tail = np.searchsorted(solid, solid[ends]) - 1
        tail2 = np.maximum(tail - 1, lead)
        self.end = kind[tail].astype(np.int64)
        closed = (self.end == QUOTE) & (kind[tail2] == STOP)
        self.end[closed] = STOP
        self.start, self.start_code = kind[lead].astype(np.int64), codes[lead]
        nxt, nxt2 = codes[np.minimum(lead + 1, n - 1)], codes[np.minimum(lead + 2, n - 1)]
        bullet = np.isin(self.start_code, (0x2022, 0x25CF, 0x25E6, 0x2023, 0x25AA, 0x2043, 0xB7, 42, 45, 43, 0x2013, 0x2014, 0x203A, 0x2192, 35)) & (nxt == 32)
        box = (self.start_code == 91) & (((nxt == 32) | (nxt == 120) | (nxt == 88)) & (nxt2 == 93) | (kinds[np.minimum(nxt, 0x1FFFF)] == DIGIT))
        head = np.searchsorted(at, lead)
        head = np.minimum(head, max(len(at) - 1, 0))
        stops_at = to[head] if len(to) else lead
        short = (size[head] <= 3) & (at[head] <= lead + 1) if len(size) else np.zeros(m, dtype=bool)
        mark = codes[np.minimum(stops_at, n - 1)]
        then = codes[np.minimum(stops_at + 1, n - 1)]
        number = short & ((self.start == DIGIT) | (self.start_code == 40) | (size[head] == 1)) & ((mark == 46) | (mark == 41)) & (then == 32) if len(size) else short
        self.marker = np.where(bullet, 1, np.where(box, 2, np.where(number, 3, 0)))
        self.indent = lead - begins
        self.length = ends - begins
        # Blocks of lines without a blank line between them.
        new = np.ones(m, dtype=bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (seen_gap[1:] != seen_gap[:-1])
        self.block = block = np.cumsum(new) - 1
        self.block_lines = np.bincount(block)[block]
        self.block_stops = (np.bincount(block, self.stops) / np.maximum(1, np.bincount(block, self.words)))[block]
        widest = np.zeros(block[-1] + 1)
        np.maximum.at(widest, block, self.length)
        self.filled = self.length / widest[block]


def dealt(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """From and to of groups of texts of these sizes, of about GROUP together."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= GROUP):
            size += sizes[to] + 1
            to += 1
        yield at, to
        at = to


def bins(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


#: What is kept of a line: the bins of its statistics, its label by plain rules with words in usual order, unknown and scrambled, whether it
#: shows what usual order is, its tokens and characters, and the state that it was made to show, -1 for natural lines.
LINE = np.dtype([("bins", "u1", 18), ("sure", "i1", 3), ("fit", "?"), ("tokens", "<i4"), ("chars", "<i4"), ("state", "i1")])
#: The place of the words' order among the bins, and of the number of words.
ORDER, WORDS = 8, 0
#: Up to how many tokens lines are held against one another, and the scale of the scores of their order: 1,000 steps from LOWEST on.
UP_TO, LOWEST, STEPS = (12, 24, 48), -8, 32_000


class Kept:
    """What is kept of the lines of some texts, as arrays with an entry per line, or per token."""

    def __init__(self, b: pd.DataFrame, made: str = "") -> None:
        blobs = b[f"{made}lines"]
        lines = np.frombuffer(b"".join(blobs), dtype=LINE)
        self.text = np.repeat(np.arange(len(b)), [len(x) // LINE.itemsize for x in blobs])
        self.count = len(lines)
        self.bins, self.sure, self.fit, self.chars, self.state = (lines[k].astype(np.int64) for k in ("bins", "sure", "fit", "chars", "state"))
        self.tokens = lines["tokens"].astype(np.int64)
        self.cls = np.frombuffer(b"".join(b[f"{made}tokens"]), dtype="<u4" if b["wide"].iloc[0] else "<u2").astype(np.int64)
        self.line = np.repeat(np.arange(self.count), self.tokens)
        self.seed = b["seed"].to_numpy(dtype=np.uint64)
        self.half = (self.seed % 2).astype(np.int64)[self.text]

    def follow(self) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens another one of their line follows, and the lines of these."""
        same = np.flatnonzero(self.line[1:] == self.line[:-1])
        return same, self.line[same]


class Order:
    """How usual the order of the words of a line is: log odds that it wasn't shuffled.

    Texts fall into halves by their checksums. Each is weighed by the pairs of words of the other half, so none by its own.
    """

    def __init__(self, total: Callable, classes: int) -> None:
        joint = total(partial(count_pairs, classes), 2 * classes * classes).reshape(2, classes, classes)
        other = joint[::-1] if joint[0].any() and joint[1].any() else joint[[0, 0]] + joint[[1, 1]]
        self.weight = np.stack([self._weights(n.astype(np.float64)) for n in other])
        self._level(total(partial(count_scores, self), (len(UP_TO) + 1) * 2 * STEPS).reshape(-1, 2, STEPS))

    @staticmethod
    def _weights(joint: np.ndarray) -> np.ndarray:
        one, two = joint.sum(axis=1) + 1, joint.sum(axis=0) + 1
        expected = np.outer(one, two) / max(1.0, joint.sum() + len(joint))
        return np.log((joint + 2 * expected / (1 + expected)) / (expected * (1 + 2 / (1 + expected))) + 1e-3).astype(np.float32)

    def _level(self, n: np.ndarray) -> None:
        """Medians and deviations of the scores of lines as they are and shuffled, by their tokens."""
        self.levels = []
        for hi, own in zip((*UP_TO, 1 << 60), n):
            own = own if own[0].sum() >= 8 else n.sum(axis=0)
            if own[0].sum() < 4:
                self.levels.append((hi, 0.6, 0.2, -0.2, 0.2))
                continue
            (r, rs), (f, fs) = spread_of(own[0]), spread_of(own[1])
            self.levels.append((hi, r, max(0.05, rs), f, max(0.05, fs)))

    def mean(self, x: Kept, cls: np.ndarray) -> np.ndarray:
        at, of = x.follow()
        w = self.weight[x.half[of], cls[at], cls[at + 1]]
        return np.bincount(of, w, minlength=x.count) / np.maximum(1, np.bincount(of, minlength=x.count))

    def odds(self, x: Kept) -> np.ndarray:
        v, n = self.mean(x, x.cls), x.tokens
        out, lo = np.zeros(x.count), 0
        for hi, r, rs, f, fs in self.levels:
            pick = (n >= lo) & (n < hi)
            z = v[pick]
            out[pick] = np.log(fs / rs) + ((z - f) / fs) ** 2 / 2 - ((z - r) / rs) ** 2 / 2
            out[pick] = np.where(z >= r, np.maximum(out[pick], 4.0), np.where(z <= f, np.minimum(out[pick], -4.0), out[pick]))
            lo = hi
        return np.clip(out, -12, 12)

    def read(self, x: Kept) -> tuple[np.ndarray, np.ndarray]:
        """The bins of the lines with that of their order, and the labels that plain rules are sure of."""
        odds, f = self.odds(x), x.bins.copy()
        f[:, ORDER] = np.where(f[:, WORDS] >= 3, 1 + bins(odds, -4, -1.5, 0, 1.5, 4), 0)
        return f, np.where(odds > 1.0, x.sure[:, 0], np.where(odds < -2.5, x.sure[:, 2], x.sure[:, 1]))


def spread_of(n: np.ndarray) -> tuple[float, float]:
    """Median and standard deviation of scores of which n are on each step."""
    at, to = np.arange(STEPS) / 1000 + LOWEST, np.cumsum(n)
    middle = [at[np.searchsorted(to, k, side="right")] for k in ((to[-1] - 1) // 2, to[-1] // 2)]
    mean = float((at * n).sum() / to[-1])
    return float(sum(middle) / 2), float(np.sqrt(((at - mean) ** 2 * n).sum() / to[-1]))


def count_pairs(classes: int, b: pd.DataFrame, out: np.ndarray) -> None:
    x = Kept(b)
    at, of = x.follow()
    np.add.at(out, (x.half[of] * classes + x.cls[at]) * classes + x.cls[at + 1], 1)


def count_scores(order: Order, b: pd.DataFrame, out: np.ndarray) -> None:
    """Lines that show what usual order is, by their tokens and score, as they are and shuffled."""
    x = Kept(b)
    place = np.arange(len(x.line)) - (np.cumsum(x.tokens) - x.tokens)[np.searchsorted(x.text, x.text)][x.line] if x.count else x.line
    with np.errstate(over="ignore"):
        key = _mix(_mix(x.seed[x.text[x.line]] * np.uint64(_B) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    shuffled = x.cls[np.lexsort((key, x.line))]
    fit, level = x.fit > 0, np.searchsorted(UP_TO, x.tokens, side="right")
    for kind, cls in enumerate((x.cls, shuffled)):
        step = np.clip(np.rint((order.mean(x, cls) - LOWEST) * 1000).astype(np.int64), 0, STEPS - 1)
        np.add.at(out, ((level * 2 + kind) * STEPS + step)[fit], 1)


def features(x: Lines) -> np.ndarray:
    """The bin of each statistic of each line; that of the words' order is filled in by Order.read."""
    w = np.maximum(1, x.words)
    return np.column_stack([
        bins(x.words, 1, 3, 6, 11, 21, 41),
        np.where(x.words >= 4, 1 + bins(x.common / w, 1e-9, 0.06, 0.12, 0.2, 0.3, 0.45), 0),
        np.minimum(x.end, 9),
        np.minimum(x.start, 9),
        x.marker,
        bins(x.digits / np.maximum(1, x.chars), 1e-9, 0.05, 0.12, 0.25, 0.5),
        bins(x.symbols / np.maximum(1, x.chars), 1e-9, 0.02, 0.06, 0.15, 0.35),
        bins(x.cells / w, 1e-9, 0.05, 0.15, 0.35, 0.7),
        np.zeros(x.count, dtype=np.int64),
        bins(np.maximum(x.repeated * (x.repeatable >= 2), x.old_line * (x.words > 0)), 0.01, 0.2, 0.5, 0.75),
        bins(x.block_stops, 1e-9, 0.008, 0.02, 0.1, 0.3),
        np.where((x.words >= 12) & (x.word_chars < 1.6 * x.words), 7, bins(x.word_chars / w, 2, 3, 4.5, 6.5, 9, 14)),
        bins(x.longest, 16, 24, 40),
        np.where(x.words >= 3, 1 + bins(x.capitals / w, 1e-9, 0.15, 0.4, 0.75), 0),
        bins(x.inside / w, 1e-9, 0.04, 0.12, 0.3),
        bins(x.commas / w, 1e-9, 0.08, 0.16, 0.3) + 5 * (x.stops == 0),
        np.minimum(x.block_lines, 3) - 1 + 3 * (x.filled >= 0.75),
        bins(x.markup, 1, 3),
    ])


def sure(x: Lines, odds: float) -> np.ndarray:
    """Labels that plain rules are sure of where the order of the words has these odds, -1 for other lines."""
    w = np.maximum(1, x.words)
    common = x.common / w
    out = np.full(x.count, -1)
    clean = (x.symbols < 0.05 * x.chars + 1) & (x.inside < 0.06 * w) & (x.cells < 0.12 * w) & (x.longest < 40)
    out[(x.words >= 6) & (common >= 0.12) & (x.block_stops >= 0.012) & (x.block_stops < 0.25) & (odds > 1.0) & clean & (x.marker == 0) & (x.repeated < 0.3)] = PROSE
    no_stop = (x.block_stops < 0.008) | (x.marker > 0)
    out[(x.marker > 0) & (x.words >= 1) & (x.words <= 25) & clean & (x.repeated < 0.6)] = LIST
    out[(x.marker == 0) & no_stop & (x.block_lines >= 3) & (x.words <= 12) & (x.words >= 1) & (x.filled < 0.98) & clean & (x.end != STOP) & (common < 0.6) & (x.repeated < 0.5)] = LIST
    out[(x.marker == 0) & no_stop & (x.words >= 8) & (x.commas >= 0.16 * w) & clean & (x.repeated < 0.5)] = LIST
    out[((x.cells >= 2) & (x.cells >= 0.3 * w) | (x.cells >= 3) & (x.digits > 0.15 * x.chars)) & (x.markup <= 2)] = TABLE
    out[(x.words >= 12) & (odds < -2.5) & (x.cells < 0.1 * w) & (x.marker == 0)] = SCRAMBLED
    out[(x.words >= 12) & (common < 0.02) & (x.cells < 0.1 * w) & (x.commas < 0.08 * w) & (x.marker == 0)] = JUNK
    out[(x.repeated >= 0.75) & (x.repeatable >= 2) | x.old_line & (x.words > 0) & (x.cells < 0.3 * w)] = REPEATED
    out[(x.words == 0) | (x.symbols >= 0.3 * x.chars) & (x.cells < 0.3 * w) | (x.longest >= 45) | (x.inside >= 0.3 * w) & (x.words >= 4)] = JUNK
    out[(x.words >= 12) & (x.word_chars < 1.6 * x.words)] = SPELT
    out[(x.markup >= 3) & ((x.start_code == 60) | (x.start_code == 123))] = JUNK
    out[(x.digits > 0.25 * x.chars) & (x.cells < 0.3 * w) & (x.words >= 6)] = JUNK
    return out


#: Statistics of a line and their bins at most; how many counts of emissions there are, and of all that a model is made of.
FEATURES, WIDTH = LINE["bins"].shape[0], 12
EMIT = FEATURES * STATES * WIDTH
SLOTS = EMIT + STATES**2 + STATES


class Model:
    """Emissions of independent statistics, transitions between the labels of consecutive lines."""

    def __init__(self, total: Callable, order: Order, rounds: int = 3) -> None:
        self.order = order
        made = total(partial(count_made, order), SLOTS)
        self._fit(made + total(partial(count_lines, order, None), SLOTS))
        for _ in range(rounds):
            self._fit(made + total(partial(count_lines, order, self), SLOTS))

    def _fit(self, counts: np.ndarray) -> None:
        """Natural lines give the emissions of the first states, and all transitions; made lines give those of the other states."""
        n = 0.5 + counts[:EMIT].reshape(FEATURES, STATES, WIDTH)
        self.emit = list(np.log(n / n.sum(axis=2, keepdims=True)))
        move = 1.0 + 4 * np.eye(STATES) + counts[EMIT : EMIT + STATES**2].reshape(STATES, STATES)
        self.move = np.log(np.maximum(move / move.sum(axis=1, keepdims=True), RARE))
        start = 1.0 + counts[EMIT + STATES**2 :]
        self.start = np.log(np.maximum(start / start.sum(), RARE))

    def path(self, f: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines of all texts, a line of each text at a time."""
        m = len(f)
        if not m:
            return np.zeros(0, dtype=np.int64)
        e = sum(self.emit[k][:, f[:, k]].T for k in range(f.shape[1]))
        begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        n = np.diff(np.concatenate((begins, [m])))
        by = np.argsort(-n, kind="stable")
        begins, n = begins[by], n[by]
        score, back = np.empty((m, STATES)), np.zeros((m, STATES), dtype=np.int64)
        score[begins] = self.start + e[begins]
        for t in range(1, n[0]):
            at = begins[: np.searchsorted(-n, -t, side="left")] + t
            via = score[at - 1][:, :, None] + self.move
            back[at] = via.argmax(axis=1)
            score[at] = via.max(axis=1) + e[at]
        out = np.zeros(m, dtype=np.int64)
        out[begins + n - 1] = score[begins + n - 1].argmax(axis=1)
        for t in range(n[0] - 1, 0, -1):
            at = begins[: np.searchsorted(-n, -t, side="left")] + t
            out[at - 1] = back[at, out[at]]
        return out


def _emitted(f: np.ndarray, states: np.ndarray, out: np.ndarray) -> None:
    for k in range(FEATURES):
        out[k * STATES * WIDTH : (k + 1) * STATES * WIDTH] += np.bincount(states * WIDTH + f[:, k], minlength=STATES * WIDTH)


def count_lines(order: Order, model: Model | None, b: pd.DataFrame, out: np.ndarray) -> None:
    """Natural lines by state and statistics, states by those before them, and first states: labels of the model, without one of plain rules."""
    x = Kept(b)
    f, labels = order.read(x)
    if model is not None:
        labels = model.path(f, x.text)
    first = labels < SCRAMBLED
    _emitted(f[(labels >= 0) & first], labels[(labels >= 0) & first], out)
    both = (x.text[1:] == x.text[:-1]) & (labels[1:] >= 0) & (labels[:-1] >= 0)
    out[EMIT : EMIT + STATES**2] += np.bincount(labels[:-1][both] * STATES + labels[1:][both], minlength=STATES**2)
    begins = np.flatnonzero(np.concatenate(([True], x.text[1:] != x.text[:-1])) & (labels >= 0)) if x.count else []
    out[EMIT + STATES**2 :] += np.bincount(labels[begins], minlength=STATES)


def count_made(order: Order, b: pd.DataFrame, out: np.ndarray) -> None:
    """Lines made of lists and of texts that are plain prose, by state and statistics."""
    x = Kept(b)
    plain = np.bincount(x.text, order.read(x)[1] == PROSE, minlength=len(b)) > 0.7 * np.maximum(1, np.bincount(x.text, minlength=len(b)))
    y = Kept(b, "made_")
    use = plain[y.text] | (y.state == INLINE)
    _emitted(order.read(y)[0][use], y.state[use], out)


def learn(total: Callable, classes: int) -> Model | None:
    """The model of all texts; total(count, n) are the n sums that count gives over them. None without any line."""
    return Model(total, Order(total, classes)) if total(partial(count_any, None), 1)[0] else None


def count_any(_: None, b: pd.DataFrame, out: np.ndarray) -> None:
    out[0] += sum(map(len, b["lines"]))


def grouped(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of kept lines in groups of a size to be worked on at once."""
    blobs = [c for c in ("lines", "tokens", "made_lines", "made_tokens") if c in b]
    for at, to in dealt(sum(b[c].map(len).to_numpy() for c in blobs).tolist()):
        yield b.iloc[at:to].reset_index(drop=True)


def hashes(common_words: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in common_words], dtype=np.uint64))


def fit(texts: list[str], common_words: list[str]) -> tuple[np.ndarray, Model | None]:
    """The model of texts at hand."""
    common = hashes(common_words)
    parts = [part for part, _, _ in read(texts, common, frozenset(common_words))]

    def total(count: Callable, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        for part in parts:
            count(part, out)
        return out

    return common, learn(total, 8 + len(common) + SUFFIXES)


def _cut(x: Lines, of: np.ndarray, n: int, use: np.ndarray, states: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Lines and tokens of each of n texts, for the lines in use; of: the text of each line."""
    lines = np.zeros(x.count, dtype=LINE)
    if x.count:
        lines["bins"] = features(x)
        lines["sure"] = np.column_stack([sure(x, odds) for odds in (12.0, 0.0, -12.0)])
        lines["fit"] = (x.words >= 6) & (x.common >= 0.12 * x.words) & (x.stops > 0) & (x.repeated < 0.2)
        lines["tokens"], lines["chars"], lines["state"] = np.bincount(x.tok_line, minlength=x.count), x.chars, states
        tokens, of, lines = x.tok_class[use[x.tok_line]], of[use], lines[use]
    else:
        tokens = np.zeros(0, dtype=np.int64)
    ends = np.searchsorted(of, np.arange(n + 1))
    to = np.concatenate(([0], np.cumsum(lines["tokens"])))[ends]
    tokens = tokens.astype("<u4" if x.wide else "<u2").tobytes()
    lines, size, width = lines.tobytes(), LINE.itemsize, 4 if x.wide else 2
    return [lines[a * size : b * size] for a, b in zip(ends, ends[1:])], [tokens[a * width : b * width] for a, b in zip(to, to[1:])]


def read(texts: list[str], common: np.ndarray, common_words: frozenset[str] | None = None) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """Statistics and kept lines of each text, group by group; with common_words also of what is made of the texts for training."""
    for at, to in dealt([len(t) for t in texts]):
        few, n = texts[at:to], to - at
        x = Lines(few, common)
        seeds = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in few]
        out = totals(x, few)
        out["seed"], out["wide"] = np.array(seeds, dtype=np.int64), x.wide
        out["lines"], out["tokens"] = _cut(x, x.text if x.count else np.zeros(0, dtype=np.int64), n, np.ones(x.count, dtype=bool), np.full(x.count, -1))
        if common_words is not None:
            made, of, states = make(x, few, seeds, common_words)
            parts = [([], [])] * n
            for a, b in dealt([len(t) for t in made]):
                y = Lines(made[a:b], common)
                if y.count:
                    parts_of, state = of[a:b][y.text], states[a:b][y.text]
                    long = np.where(state == REPEATED, (y.repeated >= 0.5) & (y.repeatable >= 2) | y.old_line, y.words >= np.where(state == ALONE, 4, 6))
                    for i, (lines, tokens) in enumerate(zip(*_cut(y, parts_of, n, long, state))):
                        if lines:
                            parts[i] = parts[i][0] + [lines], parts[i][1] + [tokens]
            out["made_lines"], out["made_tokens"] = [b"".join(p[0]) for p in parts], [b"".join(p[1]) for p in parts]
        yield out, at, to


def make(x: Lines, texts: list[str], seeds: list[int], common_words: frozenset[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts made for training, the text that each is made of, and the state that it is to show."""
    out, of, states = [], [], []
    if x.count:
        prose, listed = sure(x, 12.0) == PROSE, sure(x, -12.0) == LIST
        maybe = np.bincount(x.text, prose, minlength=len(texts)) > 0.7 * np.maximum(1, np.bincount(x.text, minlength=len(texts)))
        items: dict[int, list[str]] = {}
        for i, a, b in zip(x.text[listed].tolist(), x.begins[listed].tolist(), x.ends[listed].tolist()):
            items.setdefault(i, []).append(x.joined[a:b])
        for i in sorted({*np.flatnonzero(maybe).tolist(), *items}):
            made = spoil(texts[i], seeds[i], common_words) if maybe[i] else []
            made += [(INLINE, t) for t in in_line(items.get(i, []), seeds[i])]
            out += [t for _, t in made]
            states += [s for s, _ in made]
            of += [i] * len(made)
    return out, np.array(of, dtype=np.int64), np.array(states, dtype=np.int64)


def in_line(items: list[str], seed: int) -> list[str]:
    """Lists on a line, of the items of a text's lists: as often of some of them as of all that are left."""
    items = [x for x in (re.sub(r"^\W*(?:\d+[.)])?\s*", "", t).strip() for t in items) if 0 < len(x) < 90]
    draw, out = np.random.default_rng(seed + 17), []
    while len(items) >= 4:
        n = int(draw.integers(4, 14)) if draw.random() < 0.5 else len(items)
        n = n if len(items) - n >= 4 else len(items)
        out.append((", ", "; ", " / ", " | ")[(seed // 2 + len(out)) % 4].join(items[:n]))
        items = items[n:]
    return out


def spoil(text: str, seed: int, common_words: frozenset[str]) -> list[tuple[int, str]]:
    """Texts made of prose, after the state that each is to show."""
    out: list[tuple[int, str]] = []
    words, sentences = text.split(), re.split(r"(?<=[.!?])\s+", text.strip())
    if len(words) < 8:
        return out
    draw, i = np.random.default_rng(seed + 13), seed // 2
    shuffled = lambda words: " ".join([words[j] for j in draw.permutation(len(words)).tolist()])
    one, turn = sentences[int(draw.integers(len(sentences)))], i // 6
    if i % 6 == 0:
        out.append((SCRAMBLED, shuffled(words)))
    elif i % 6 == 1:  # no sentence has thousands of characters: of such a text its beginning is repeated
        out.append((REPEATED, (" ", "\n", " ", "\n\n", " ")[turn % 5].join([sentences[0][:2000]] * int(draw.integers(3, 25)))))
    elif i % 6 == 2:
        out.append((SPELT, " ".join("".join(words)[:2000])))
    elif i % 6 == 3:
        out.append((BACKWARDS, (text, one)[turn % 2][::-1]))
    elif i % 6 == 4:
        bare = shuffled([w.strip(".,;:!?()") for w in words if w.lower() not in common_words and w.isalpha()])
        out.append((BARE, bare.upper() if turn % 2 else bare))
    else:
        out.append((SCRAMBLED, shuffled(one.split())))
    if i % 2:  # a sentence that stands alone stays prose in any case, and without its end or with a note after it
        end = one.rstrip(".!?")
        out.append((ALONE, (one, end, f"{end} [{i % 50}]", one.lower(), one.upper(), f"{end}...")[i // 2 % 6]))
    return out


COUNTED = (
    "chars long, words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, repeated double"
)
STATS = f"{COUNTED}, prose double, list double, table double, junk double, natural boolean"
#: The columns of kept lines, natural and made.
KEPT = f"{COUNTED}, seed long, wide boolean, lines binary, tokens binary, made_lines binary, made_tokens binary"


def totals(x: Lines, texts: list[str]) -> pd.DataFrame:
    """The statistics of each text that need no model."""
    n = len(texts)
    out = {"chars": np.fromiter(map(len, texts), dtype=np.int64, count=n)}
    if not x.count:
        return pd.DataFrame(out | {c.split()[0]: np.zeros(n, dtype=np.int64 if c.endswith("long") else float) for c in COUNTED.split(", ")[1:]})
    total = lambda v: np.bincount(x.text, v, minlength=n)
    chars, words, lines = total(x.chars), total(x.words), total(np.ones(x.count))
    return pd.DataFrame(out | {
        "words": words.astype(np.int64),
        "mean_word_length": total(x.word_chars) / np.maximum(1, words),
        "symbol_ratio": total(x.symbols) / np.maximum(1, chars),
        "punctuated_lines": total((x.end == STOP).astype(float)) / np.maximum(1, lines),
        "common_words": total(x.common) / np.maximum(1, words),
        "repeated": total(x.repeated * x.repeatable) / np.maximum(1, total(x.repeatable)),
    })


def labelled(b: pd.DataFrame, model: Model | None) -> pd.DataFrame:
    """The statistics of texts whose lines were kept, with the shares of their labels."""
    x, n = Kept(b), len(b)
    label = LABEL_OF[model.path(model.order.read(x)[0], x.text)] if model is not None else np.full(x.count, -1)
    chars = np.bincount(x.text, x.chars, minlength=n)
    share = [np.bincount(x.text, x.chars * (label == s), minlength=n) / np.maximum(1, chars) for s in range(4)]
    out = b[[c.split()[0] for c in COUNTED.split(", ")]].copy()
    for s, name in enumerate(LABELS):
        out[name] = share[s]
    out["natural"] = (share[PROSE] >= 0.5) & (chars > 0)
    return out


def describe(texts: list[str], common: np.ndarray, model: Model | None) -> pd.DataFrame:
    """A row of statistics per text."""
    parts = [labelled(part, model) for part, _, _ in read(texts, common)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[c.split()[0] for c in STATS.split(", ")])


def statistics(df: DataFrame, key: str, text: str, common: np.ndarray, model: Model | None) -> DataFrame:
    """(key, statistics) of each row. Null and blank texts have no lines: all shares are 0 and they aren't natural."""
    kind = dict(df.dtypes)[key]
    known = df.sparkSession.sparkContext.broadcast((common, model))  # sizes fixed by the number of classes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common, model = known.value
            for part, at, to in read([t or "" for t in b["text"]], common):
                yield pd.concat([b[["key"]].iloc[at:to].reset_index(drop=True), labelled(part, model)], axis=1)

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {STATS}")
    return out.withColumnRenamed("key", key)


def kept_lines(df: DataFrame, key: str, text: str, common_words: list[str]) -> DataFrame:
    """A written table of (key, statistics and kept lines) of each row's text and of what is made of it for training."""
    kind, common, words = dict(df.dtypes)[key], hashes(common_words), frozenset(common_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, at, to in read([t or "" for t in b["text"]], common, words):
                yield pd.concat([b[["key"]].iloc[at:to].reset_index(drop=True), part], axis=1)

    return kept(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {KEPT}"))


def summed(lines: DataFrame, count: Callable, n: int) -> np.ndarray:
    """The n sums that count gives over all kept lines, added up before they come here."""
    known = lines.sparkSession.sparkContext.broadcast(count)  # sizes fixed by the number of classes
    columns = ["seed", "wide", "lines", "tokens", *(["made_lines", "made_tokens"] if count.func is count_made else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n, dtype=np.int64)
        for b in batches:
            for few in grouped(b):
                known.value(few, out)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"slot": at, "n": out[at]})

    rows = lines.select(*columns).mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def learnt(lines: DataFrame, common_words: list[str]) -> Model | None:
    """The model of all kept lines."""
    return learn(partial(summed, lines), 8 + len(hashes(common_words)) + SUFFIXES)


def words_of(common_words: DataFrame) -> list[str]:
    return sorted({r["word"] for r in common_words.select("word").collect()})  # a table of fixed size


def fitted(documents: DataFrame, key: str, text: str, common_words: DataFrame) -> tuple[np.ndarray, Model | None]:
    """The model of all documents."""
    words = words_of(common_words)
    return hashes(words), learnt(kept_lines(documents, key, text, words), words)


def p9_stats(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """The statistics of every document, with the model fitted on all of them."""
    words = words_of(table(spark, sf_dir, "common_words"))
    lines = kept_lines(table(spark, sf_dir, "documents"), "doc_id", "text", words)
    known = spark.sparkContext.broadcast(learnt(lines, words))  # sizes fixed by the number of classes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for few in grouped(b):
                yield pd.concat([few[["key"]], labelled(few, known.value)], axis=1)

    counted = [c.split()[0] for c in COUNTED.split(", ")]
    out = lines.select("key", *counted, "seed", "wide", "lines", "tokens").mapInPandas(run, f"key {dict(lines.dtypes)['key']}, {STATS}")
    return out.withColumnRenamed("key", "doc_id")


def p9_found(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Documents that aren't natural prose."""
    return p9_stats(spark, sf_dir).where("NOT natural").select("doc_id").distinct()
