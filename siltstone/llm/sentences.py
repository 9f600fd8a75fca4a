"""Sentence boundaries in any script: a hidden-event n-gram model whose posteriors decide between the words."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import spread, stored

# The marks that may close a sentence, and the signs that may stand between them and the gap.
MARKS = ".!?…。！？｡।॥۔؟։።"
CLOSERS = "\"'”’»)]」』）】›"
PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "‹": "›", "„": "“", "‘": "’"}

#: Scores that a process remembers at once; the model itself has no bound by default, see ``fit``.
REMEMBERED = 300_000
#: Tokens seen less often than this in the contexts are known by their shape only.
KNOWN = 5
ROUNDS = 6
DISCOUNT = 0.75
EDGE = ""  # beyond the paragraph
SPACE = "␣"  # white space between two Thai letters, a closing mark like others
RARE = "<rare>"
#: Words since the last boundary that the lattice tells apart.
LENGTHS = 64
#: Tokens beyond this length are known by their shape.
LONG = 64


def _class(pattern: str) -> str:
    """The characters that a class of Unicode properties has, as ranges for the faster of the two regex engines."""
    points = [ord(c) for c in regex.findall(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x32400)])))]
    parts = []
    for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
        own = [p for _, p in run]
        parts.append(f"\\U{own[0]:08x}-\\U{own[-1]:08x}")
    return "".join(parts)


IDEOGRAPH = _class(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
LETTER = _class(r"[\p{L}\p{M}\p{Nl}\p{No}_]")
#: Scripts whose words aren't parted, besides the ideographs.
UNPARTED = _class(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
MARKED = _class(r"\p{M}")
GREEK = _class(r"[\p{Greek}]")

PARAGRAPH = re.compile(r"\r?\n[^\S\n]*\n\s*")
HEADING = re.compile(r"(?m)^(?:#{1,6}[ \t]+\S.*|={1,6}[^=\n].*={1,6}[ \t]*)$\n?")
TOKEN = re.compile(rf"[{IDEOGRAPH}]|[{LETTER}]+(?:[.’'\-:/,][{LETTER}]+)*|\d+|\S")
#: The same for text of ASCII alone, which is several times as fast.
ASCII_TOKEN = re.compile(r"[A-Za-z_]+(?:[.'\-:/,][A-Za-z_]+)*|[0-9]+|\S", re.A)
HAS_UNPARTED = re.compile(rf"[{UNPARTED}]")
CLUSTER = re.compile(rf"[{UNPARTED}][{MARKED}]*|[^{UNPARTED}]+")
TAIL = rf"(?:[{MARKS}{re.escape(CLOSERS)}]|“(?=\s|$)|[ \u00a0\u202f]»)*"
#: A closing mark, further marks and closing signs, the space that French puts before a closing guillemet included.
RUN = re.compile(rf"[{MARKS}]{TAIL}")
QUESTION = re.compile(rf"[{MARKS};;]{TAIL}")
AFTER_GREEK = re.compile(rf"[{GREEK}][{MARKED}]*\s?$")
#: Marks of scripts that need no space after them.
DENSE = re.compile(r"[。！？｡][”’」』）】]*$|…[”’」』）】]*$")
THAI = _class(r"\p{Thai}")
THAI_GAP = re.compile(rf"(?<=[{THAI}])\s+(?=[{THAI}])")
DENSE_NEXT = re.compile(rf"[{IDEOGRAPH}「『（“‘【]")
QUOTES = re.compile(r"""["'“”«»()\[\]「」『』（）【】‹›„‘’]""")
HAS_THAI, HAS_GREEK = re.compile(f"[{THAI}]"), re.compile(f"[{GREEK}]")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts that blank lines and heading lines separate."""
    at = 0
    for m in PARAGRAPH.finditer(text):
        yield from _headings(text, at, m.start())
        at = m.end()
    yield from _headings(text, at, len(text))


def _headings(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for m in HEADING.finditer(text, start, end):
        if m.start() > at:
            yield at, m.start()
        yield m.start(), m.end()
        at = m.end()
    if end > at:
        yield at, end


def enclosed(text: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that open and close within a paragraph."""
    spans, stack = [], []
    for m in QUOTES.finditer(text):
        c, i = m[0], m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == "'" or c == "’":
            opens = c == "'" and (not before or before.isspace() or before in "(\"“") and after.isalnum()
            if not opens and before.isalnum() and after.isalnum():
                continue
            own = "'" if c == "'" else "‘"
        elif c == '"':
            own = '"'
            opens = not any(s[0] == '"' for s in stack)
        elif c == "“" and any(s[0] == "„" for s in stack):
            own, opens = "„", False
        else:
            opens = c in PAIRS
            own = c if opens else next((k for k, v in PAIRS.items() if v == c), c)
        if opens:
            stack.append((own, i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == own:
                    spans.append((stack[k][1], i + 1))
                    del stack[k:]
                    break
    return spans


def _runs(text: str) -> Iterator[re.Match]:
    """Closing marks; a semicolon closes Greek questions only."""
    if (";" in text or "\u037e" in text) and HAS_GREEK.search(text):
        yield from (m for m in QUESTION.finditer(text) if m[0][0] not in ";\u037e" or AFTER_GREEK.search(text, max(0, m.start() - 8), m.start()))
    else:
        yield from RUN.finditer(text)


def gaps(text: str) -> list[tuple[int, bool]]:
    """(offset, sure) of the marked gaps of a paragraph, where a sentence may end; sure ones are Thai spaces."""
    found = {}
    for m in _runs(text):
        end = m.end()
        rest = text[end : end + 1]
        if rest and (rest.isspace() or (DENSE.search(m[0]) and (m[0][0] in "。！？｡" or DENSE_NEXT.match(rest)))):
            found[end] = False
    if found:
        outer: list[tuple[int, int]] = []
        for a, b in sorted(enclosed(text)):
            if not outer or b > outer[-1][1]:
                outer.append((a, b))
        for g in [*found]:
            k = bisect_left(outer, (g, 0)) - 1
            if k >= 0 and g < outer[k][1]:
                del found[g]
    if HAS_THAI.search(text):
        for m in THAI_GAP.finditer(text):
            found[m.start()] = True
    return sorted(found.items())


def shape(token: str) -> str:
    """What an unknown token looks like."""
    first = token[:1]
    if first.isdecimal():
        return "#"
    if first.isupper():
        return "<Upper>"
    if first.islower():
        return "<lower>"
    return "<letter>" if first.isalpha() else "<sign>"


def tokens(text: str, start: int, end: int) -> list[str]:
    """The tokens of a part of a paragraph; numbers are one name, and very long tokens their shape."""
    found = ["#" if t.isdecimal() else t for t in (ASCII_TOKEN if text.isascii() else TOKEN).findall(text, start, end)]
    if max(map(len, found), default=0) > LONG:
        found = [t if len(t) <= LONG else shape(t) for t in found]
    return found


def parts(text: str, own: list[tuple[int, bool]]) -> list[list[str]]:
    """The tokens of a paragraph between its gaps."""
    at = [0, *(g for g, _ in own), len(text)]
    return [tokens(text, a, b) for a, b in zip(at, at[1:])]


def _around(left: list[str], right: list[str], thai: bool) -> tuple[str, str, str, str, str]:
    """Three tokens before a gap and two after it, from all that stand there."""
    a, r = left[-2:] + [SPACE] if thai else left[-3:], right[:2]
    return (*([EDGE] * (3 - len(a)) + a), *(r + [EDGE] * (2 - len(r))))


def _histories(found: list[list[str]], own: list[tuple[int, bool]]) -> Iterator[tuple[str, str, str, str, str]]:
    """The surroundings of each gap; short parts are filled up from those before and behind them."""
    for k, (_, thai) in enumerate(own):
        left, right, i, j = found[k], found[k + 1], k - 1, k + 2
        while len(left) < 3 and i >= 0:
            left, i = found[i] + left, i - 1
        while len(right) < 2 and j < len(found):
            right, j = right + found[j], j + 1
        yield _around(left, right, thai)


def contexts(text: str, words: Counter | None = None) -> Iterator[tuple[str, str, str, str, str, bool]]:
    """What the model learns from: gaps whose event is hidden, and paragraph edges, where a boundary is sure.

    Where ``words`` is given, it gets what the words between the marks say (see ``_learn_words``).
    """
    for a, b in paragraphs(text):
        part = text[a:b].strip()
        if not part:
            continue
        own = gaps(part)
        marked = RUN.search(part) is not None or next(_runs(part), None) is not None
        if not own and not marked:
            continue
        found = parts(part, own)
        share = UNIT // (len(own) + 1)
        for t, (_, sure) in zip(_histories(found, own), own):
            if words is not None:
                words[EXPECTED, t[1], t[2]] += share
                words[EXPECTED_THREE, f"{t[0]}\t{t[1]}", t[2]] += share
            yield (*t, sure)
        if marked:  # not a heading
            whole = found[0] if len(found) == 1 else [x for f in found for x in f]
            yield (*_around([], whole, False), True)
            end = _around(whole, [], False)
            if words is not None:
                words[EXPECTED, end[1], end[2]] += share
                words[EXPECTED_THREE, f"{end[0]}\t{end[1]}", end[2]] += share
            yield (*end, True)
        if words is not None and own:
            _learn_words(found, words, not part.isascii() and HAS_UNPARTED.search(part) is not None)


# Kinds of counts: contexts of marked gaps, words, pairs of words, the last and the first word of a sentence and the
# last and first two, lengths in words, words by case at beginnings and elsewhere, and how often the two or three tokens
# before a gap would end a paragraph if each of its gaps were as likely to be the last (in parts of UNIT).
CONTEXT, ALL, PAIR, LAST, LAST_TWO, FIRST, FIRST_TWO, LENGTH, CASE, EXPECTED, EXPECTED_THREE = range(11)
UNIT = 5040


def _spoken(found: list[str], unparted: bool) -> list[str]:
    """The words among tokens, as they are without marks: characters where a script doesn't part them."""
    words = [t for t in found if t[0].isalnum()]
    if unparted:
        words = [x for t in words for x in (CLUSTER.findall(t) if HAS_UNPARTED.match(t) else (t,))]
    return words


def _learn_words(found: list[list[str]], counts: Counter, unparted: bool) -> None:
    """Counts of a paragraph as if it had no marks: where its marked gaps are, sentences end.

    A key of two words is a pair, of a word and None the word as the last or first of a sentence.
    """
    words: list[str | None] = [None]
    initials, firsts = [], 0
    for own in found:
        raw = _spoken(own, unparted)
        if not raw:
            continue
        low = [w.casefold() for w in raw]
        words += low
        words.append(None)
        n = len(low)
        if n > 1:
            counts[LAST_TWO, low[-2], low[-1]] += 1
            counts[FIRST_TWO, low[0], low[1]] += 1
        counts[LENGTH, str(min(LENGTHS, n)), EDGE] += 1
        initials += [w[0] for w in raw]
        first = raw[0][0].isupper()
        firsts += first
        counts[CASE, "first" if first else "First", EDGE] += 1
    counts.update(zip(words, words[1:]))
    upper = sum(map(str.isupper, initials)) - firsts
    counts[CASE, "upper", EDGE] += upper
    counts[CASE, "lower", EDGE] += len(initials) - words.count(None) + 1 - upper


def word_rows(counts: Counter) -> Iterator[tuple[int, str, str, int]]:
    """(kind, word, word, n) of the counts; a word occurs as often as pairs begin with it."""
    all_: Counter = Counter()
    for key, n in counts.items():
        if len(key) == 3:
            yield (*key, n)
        elif key[0] is None:
            yield FIRST, key[1], EDGE, n
        else:
            all_[key[0]] += n
            yield (LAST, key[0], EDGE, n) if key[1] is None else (PAIR, *key, n)
    for w, n in all_.items():
        yield ALL, w, EDGE, n


class Words:
    """The model for text without marks: P(word | word before or beginning), P(end | two words before), lengths.

    It has its counts from paragraphs with marks, read without them; what a mark says there of an abbreviation is
    taken from the model of marked gaps.
    """

    def __init__(self, rows: list[tuple], ending):
        of: dict[int, dict] = defaultdict(dict)
        for kind, x, y, n in rows:
            if kind not in (EXPECTED, EXPECTED_THREE):
                of[kind][(x, y) if kind in (PAIR, LAST_TWO, FIRST_TWO) else x] = float(n)
        self.all, self.pair, self.first, self.first_two = of[ALL], of[PAIR], of[FIRST], of[FIRST_TWO]
        self.total = sum(self.all.values())
        self.last = {w: n * ending(w) for w, n in of[LAST].items()}
        self.last_two = {(v, w): n * ending(w) for (v, w), n in of[LAST_TWO].items()}
        self.firsts, self.rate = sum(self.first.values()), sum(self.last.values()) / max(1.0, self.total)
        self.own_pairs, self.own_firsts = defaultdict(float), defaultdict(float)
        for (x, _), n in self.pair.items():
            self.own_pairs[x] += max(0.0, n - DISCOUNT)
        for (x, _), n in self.first_two.items():
            self.own_firsts[x] += max(0.0, n - DISCOUNT)
        lengths = np.array([of[LENGTH].get(str(k), 0.0) + 0.1 for k in range(1, LENGTHS + 1)])
        # the chance of ending at each length against that of ending at any word
        hazard = lengths / np.cumsum(lengths[::-1])[::-1]
        self.hazard = np.clip(hazard / (lengths.sum() / (lengths * np.arange(1, LENGTHS + 1)).sum()), 0.02, 5.0)
        self.hazard[-1] = max(1.0, float(np.median(self.hazard[LENGTHS // 2 : -1])))
        c = of[CASE]
        a, b = (c.get("first", 0) + 1) / (c.get("first", 0) + c.get("First", 0) + 2), (c.get("upper", 0) + 1) / (c.get("upper", 0) + c.get("lower", 0) + 2)
        self.upper, self.lower = math.log(a / b), math.log((1 - a) / (1 - b))

    def _plain(self, w: str) -> float:
        return (self.all.get(w, self.all.get(RARE, 0.0) * 0.01) + 0.5) / (self.total + 1.0)

    def _after(self, w: str, v: str) -> float:
        """P(w | v), by absolute discounting; what the pairs leave goes to the plain frequency."""
        n = self.all.get(v, 0.0)
        if n <= DISCOUNT:
            return self._plain(w)
        own = max(0.0, self.pair.get((v, w), 0.0) - DISCOUNT) / n
        return own + max(1e-3, 1 - self.own_pairs.get(v, 0.0) / n) * self._plain(w)

    def _at_first(self, w: str) -> float:
        return (self.first.get(w, 0.0) + 5.0 * self._plain(w)) / (self.firsts + 5.0)

    def _second(self, x: str, w: str) -> float:
        n = self.first.get(w, 0.0)
        if n <= DISCOUNT:
            return self._after(x, w)
        own = max(0.0, self.first_two.get((w, x), 0.0) - DISCOUNT) / n
        return own + max(1e-3, 1 - self.own_firsts.get(w, 0.0) / n) * self._after(x, w)

    def _ends(self, v: str, w: str) -> float:
        p = (self.last.get(w, 0.0) + 2 * self.rate) / (self.all.get(w, 0.0) + 2)
        n = self.pair.get((v, w), 0.0)
        return min(0.999, max(1e-5, (self.last_two.get((v, w), 0.0) + 2 * p) / (n + 2)))

    def boundaries(self, part: str) -> list[int]:
        """Offsets of a paragraph without marks where a sentence ends with a posterior of more than one half.

        A lattice over all gaps between words, its states the words since the last boundary, summed forwards and
        backwards.
        """
        if not self.firsts:
            return []
        found = []
        for m in (ASCII_TOKEN if part.isascii() else TOKEN).finditer(part):
            if m[0][0].isalnum():
                own = [(c.start(), c.end()) for c in CLUSTER.finditer(part, m.start(), m.end())] if HAS_UNPARTED.match(m[0]) else [m.span()]
                found += [(x, y, part[x:y]) for x, y in own]
        n = len(found)
        if n < 3:
            return []
        words = ["#" if w.isdecimal() else w.casefold() if len(w) <= LONG else shape(w).casefold() for _, _, w in found]
        cased = any(w[0].isupper() for _, _, w in found[1:])
        odds = np.empty(n - 1)
        for i in range(n - 1):
            v, w, x, y = words[i - 1] if i else EDGE, words[i], words[i + 1], words[i + 2] if i + 2 < n else None
            e = self._ends(v, w)
            s = math.log(e / (1 - e)) + math.log(self._at_first(x) / self._after(x, w))
            if y is not None:
                s += math.log(self._second(y, x) / self._after(y, x))
            first = found[i + 1][2][0]
            if cased and (first.isupper() or first.islower()):
                s += self.upper if first.isupper() else self.lower
            odds[i] = s
        odds = np.exp(np.minimum(odds, 50))
        if np.log1p(odds * self.hazard.max()).sum() < math.log(2):
            return []  # all ways with a boundary weigh less than the one without
        forward = np.zeros((n, LENGTHS + 1))
        forward[0, 0] = 1.0
        for i in range(1, n):
            row = forward[i - 1]
            forward[i, 1:] = row[:-1]
            forward[i, -1] += row[-1]
            forward[i, 0] = odds[i - 1] * (forward[i, 1:] @ self.hazard)
            forward[i] /= forward[i].sum()
        backward = np.append(self.hazard, self.hazard[-1])
        out = []
        for i in range(n - 1, 0, -1):
            weight = forward[i] * backward
            if weight[0] > weight[1:].sum():
                out.append(found[i - 1][1])
            stay = backward[1:]
            before = np.append(stay + odds[i - 1] * self.hazard * backward[0], 0.0)
            before[-1] = before[-2]
            backward = before / before.max()
        return out[::-1]


class HiddenEvents:
    """P(event | three tokens before), P(two tokens after | event or what stands before), by EM over contexts."""

    def __init__(self, rows: list[tuple], words: list[tuple] = ()):
        seen: Counter = Counter()
        for *t, _, n in rows:
            for x in t:
                seen[x] += n
        self.known = {x for x, n in seen.items() if n >= KNOWN} | {EDGE, SPACE}
        data: Counter = Counter()
        for *t, sure, n in rows:
            data[(*map(self.name, t), sure)] += n
        self.total = max(1, sum(seen.values()))
        self.plain: Counter = Counter()
        for x, n in seen.items():
            self.plain[self.name(x)] += n
        expected: Counter = Counter()
        for kind, x, y, n in words:
            if kind == EXPECTED:
                expected[self.name(x), self.name(y)] += n / UNIT
                expected[self.name(y),] += n / UNIT
            elif kind == EXPECTED_THREE and x != RARE:
                expected[(*map(self.name, x.split("\t")), self.name(y))] += n / UNIT
        self._fit(data, expected)
        self.words = Words(list(words), lambda w: max(self._p_event(EDGE, w, "."), self._p_event(EDGE, w[:1].upper() + w[1:], ".")) if (w, ".") in self.events or (w[:1].upper() + w[1:], ".") in self.events else 1.0)

    def name(self, token: str) -> str:
        return token if token in self.known else shape(token)

    def _fit(self, data: Counter, expected: Counter) -> None:
        """EM from events that follow from paragraph ends: a word and mark that end paragraphs as often as their share of
        the gaps there says ends sentences as well, one that never does is an abbreviation. The share of a
        paragraph's gaps takes out how long the paragraphs of a language are."""
        ends: Counter = Counter()
        total: Counter = Counter()
        for (a, b, c, r1, _, _), n in data.items():
            if c:
                for h in ((c,), (b, c), (a, b, c)):
                    total[h] += n
                    ends[h] += n * (r1 == EDGE)
        marks = [h for h in total if len(h) == 1]
        closing = sum(ends[h] for h in marks) / max(1, sum(total[h] for h in marks))
        post = {}
        for key in data:
            a, b, c, _, _, sure = key
            rate = 1.0
            for h in ((c,), (b, c), (a, b, c)):
                rate = (ends[h] + 2 * rate) / (expected.get(h, total[h] * closing) + 2)
            post[key] = 1.0 if sure else min(0.95, max(0.05, 0.8 * rate))
        for _ in range(ROUNDS):
            self._count(data, post)
            post = {k: 1.0 if k[5] else self.posterior(*k[:5]) for k in data}
        self._count(data, post)

    def _count(self, data: Counter, post: dict) -> None:
        self.memo: dict = {}
        self.event, self.events = defaultdict(float), defaultdict(float)
        self.next, self.nexts, self.kinds = defaultdict(float), defaultdict(float), defaultdict(float)
        for key, n in data.items():
            a, b, c, r1, r2, _ = key
            q = post[key]
            if c:
                for h in ((c,), (b, c), (a, b, c)):
                    self.event[h] += q * n
                    self.events[h] += n
            if r1:
                for w, event in ((q, "<s>"), (1 - q, "<n>")):
                    self._add((event,), r1, w * n)
                    if r2:
                        self._add((event, r1), r2, w * n)

    def _add(self, history: tuple, word: str, n: float) -> None:
        if n > 0:
            self.next[history, word] += n
            self.nexts[history] += n
            self.kinds[history] = self.kinds[history] + 1

    def _p_event(self, a: str, b: str, c: str) -> float:
        p = 0.5
        for h in ((c,), (b, c), (a, b, c)):
            n = self.events.get(h, 0.0)
            p = (self.event.get(h, 0.0) + 2.0 * p) / (n + 2.0)
        return min(1 - 1e-4, max(1e-4, p))

    def _p_next(self, word: str, history: tuple) -> float:
        """Absolute discounting, backing off to the plain frequency.

        History ends at the event token, and a gap without a boundary has one as well: both sides then know equally
        much, whereas longer history on one side would favour it in every language that is rare in the corpus.
        """
        p = (self.plain.get(word, 0) + 0.5) / (self.total + 0.5)
        n = self.nexts.get(history, 0.0)
        if n <= DISCOUNT:
            return p
        own = max(0.0, self.next.get((history, word), 0.0) - DISCOUNT) / n
        return min(1.0, own + min(1.0, max(1e-3, DISCOUNT * self.kinds[history] / n)) * p)

    def scores(self, a: str, b: str, c: str, r1: str, r2: str) -> tuple[float, float]:
        """Log probabilities of the gap's surroundings without and with a boundary."""
        key = (a, b, c, r1, r2)
        if key not in self.memo:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            self.memo[key] = self._scores(*key)
        return self.memo[key]

    def _scores(self, a: str, b: str, c: str, r1: str, r2: str) -> tuple[float, float]:
        e = self._p_event(a, b, c)
        with_, without = math.log(e), math.log(1 - e)
        if r1:
            with_ += math.log(self._p_next(r1, ("<s>",)))
            without += math.log(self._p_next(r1, ("<n>",)))
        if r1 and r2:
            with_ += math.log(self._p_next(r2, ("<s>", r1)))
            without += math.log(self._p_next(r2, ("<n>", r1)))
        return without, with_

    def posterior(self, *t: str) -> float:
        without, with_ = self.scores(*t)
        return 1 / (1 + math.exp(min(700, max(-700, without - with_))))

    def boundaries(self, text: str) -> list[int]:
        """Gaps of a paragraph with a posterior of more than one half, by forward and backward sums.

        Where a paragraph has marks, the gaps behind them count; their histories are linked where fewer than three
        tokens part them, since a boundary just before hides what stands before it from the next gap. Where it has
        none, any gap between words may be one.
        """
        own = gaps(text)
        if not own:
            return [] if next(_runs(text), None) else self.words.boundaries(text)
        n = len(own)
        found = parts(text, own)
        local = np.zeros((n, 2, 2))  # gap, event before, event here
        for k, t in enumerate(_histories(found, own)):
            t = [self.name(x) for x in t]
            local[k] = self.scores(*t)
            if k:
                between = len(found[k]) + own[k][1]
                if between < 3:
                    cut = [EDGE] * (3 - between) + t[3 - between : 3]
                    local[k, 1] = self.scores(*cut, *t[3:])
        if n == 1:
            return [own[0][0]] if local[0, 0, 1] > local[0, 0, 0] else []
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = local[0, 0]
        for k in range(1, n):
            forward[k] = np.logaddexp(forward[k - 1, 0] + local[k, 0], forward[k - 1, 1] + local[k, 1])
        for k in range(n - 2, -1, -1):
            backward[k] = [np.logaddexp(*(local[k + 1, s] + backward[k + 1])) for s in (0, 1)]
        belief = forward + backward
        return [own[k][0] for k in range(n) if belief[k, 1] > belief[k, 0]]

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a text, without outer white space."""
        out = []
        for a, b in paragraphs(text):
            part = text[a:b]
            at = 0
            for g in [*(() if HEADING.fullmatch(part) else self.boundaries(part)), len(part)]:
                piece = part[at:g]
                inner = piece.strip()
                if inner:
                    start = a + at + len(piece) - len(piece.lstrip())
                    out.append((start, start + len(inner)))
                at = g
        return out


FIELDS = ("a", "b", "c", "r1", "r2")
COUNT = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(x, T.StringType()) for x in FIELDS], T.StructField("sure", T.BooleanType()), T.StructField("n", T.LongType())])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    words: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(CONTEXT, *k, n) for k, n in counts.items()] + [(kind, EDGE, x, y, EDGE, EDGE, False, n) for kind, x, y, n in word_rows(words)]
        counts.clear()
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.string()] * 5, pa.bool_(), pa.int64()])], names=COUNT.names)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(contexts(text, words))
            if len(counts) + len(words) > 400_000:
                yield flush()
    if counts or words:
        yield flush()


def _shape(token: Column) -> Column:
    return F.when(token.isin(EDGE, SPACE, "#") | token.startswith("<"), token).when(token.rlike(r"^\p{Lu}"), "<Upper>").when(token.rlike(r"^\p{Ll}"), "<lower>").when(token.rlike(r"^\p{L}"), "<letter>").otherwise("<sign>")


def _coarser(counted: DataFrame, columns: tuple[str, ...], least: float) -> DataFrame:
    """Contexts below the least count with the shapes of some of their words, added up again."""
    named = counted.select(*[F.when(F.col("n") < least, _shape(F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else c for c in FIELDS], "sure", "n")
    return named.groupBy(*FIELDS, "sure").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, text: str = "text", size: float = math.inf) -> HiddenEvents:
    """The model of a corpus, from counts over all its texts.

    Every context counts with its own words, and what a word is known by depends on its own count alone, never on how
    large the corpus is; the driver and each worker hold one entry per distinct context and pair of words. Where
    ``size`` is given, the model is an approximate one of at most a few times ``size`` counts: what is rarer than one
    in ``size`` counts with the shape of its words instead (pairs of words by their single words, words as one rare
    word).
    """
    found = spread(texts.select(F.col(text).alias("text")).where("text is not null")).mapInArrow(_count_task, COUNT)
    counted = stored(found.groupBy("kind", *FIELDS, "sure").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()} if size < math.inf else {}
    own = counted.where(F.col("kind") == CONTEXT)
    for columns in (("a", "r2"), ("b", "r1")):
        if totals.get(CONTEXT, 0) > size:
            own = _coarser(own, columns, totals[CONTEXT] / size)
    rows = own.select(*FIELDS, "sure", "n").orderBy(*FIELDS, "sure").toArrow()
    least = F.lit(1.0)
    for kind in (ALL, PAIR, LAST, LAST_TWO, FIRST, FIRST_TWO, EXPECTED, EXPECTED_THREE):
        lowest = KNOWN if kind == ALL else 2 if kind == PAIR else 1
        least = F.when(F.col("kind") == kind, float(max(lowest, totals.get(kind, 0) / size))).otherwise(least)
    often = F.col("n") >= least
    words = counted.where(F.col("kind") != CONTEXT).where(often | F.col("kind").isin(ALL, LAST, FIRST, EXPECTED, EXPECTED_THREE)).select("kind", F.when(often, F.col("b")).otherwise(RARE).alias("x"), F.col("c").alias("y"), "n").groupBy("kind", "x", "y").agg(F.sum("n").alias("n")).orderBy("kind", "x", "y").toArrow()
    return HiddenEvents(list(zip(*(rows[c].to_pylist() for c in rows.column_names))), list(zip(*(words[c].to_pylist() for c in words.column_names))))


def sentences(documents: DataFrame, doc: str = "doc_id", text: str = "text", model: HiddenEvents | None = None) -> DataFrame:
    """The sentences of every document: (doc, sentence, sent_start, sent_end, sentence_text), offsets in characters.

    Blank lines and heading lines always separate. Elsewhere a sentence may end after a closing mark with its closing
    quotes or brackets where white space follows (or none, after ideographic marks), and at white space between two
    Thai letters. A semicolon counts after Greek letters only; gaps within a quotation or bracket that closes later in
    the paragraph are none. In a paragraph without any such mark, sentences may end between any two words, a
    character being a word in scripts that don't part them. At each of these gaps a hidden-event n-gram model
    decides by its posterior. The model is fitted on the documents themselves unless given. Null and blank texts
    give no rows, repeated rows theirs again; an empty table gives none.

    Two passes without a shuffle of texts: counts are added up in each task before they are added up over all.
    """
    kind = documents.schema[doc].dataType
    model = model or fit(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # grows with the distinct contexts
    out = T.StructType([T.StructField("doc", kind), T.StructField("sentence", T.LongType()), T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType()), T.StructField("sentence_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [(k, n, a, b, whole[a:b]) for k, whole in enumerate(batch.column("text").to_pylist()) for n, (a, b) in enumerate(own.split(whole))]
            if rows:
                index, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(index)), *(pa.array(x, pa.int64()) for x in rest[:3]), pa.array(rest[3], pa.string())], names=out.names)

    narrow = spread(documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null"))
    return narrow.mapInArrow(run, out).withColumnRenamed("doc", doc)
