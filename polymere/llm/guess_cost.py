"""Secret scans: what it would cost to guess the values that stand where credentials stand.

Values are found by their context: a credential word, also at a capital within a
name, then `=`, `:` or `is`, or white space after `bearer`. The JVM keeps the
texts that hold such a word. For each value, dynamic programming over its
characters finds the cheapest way to cut it into spans; the cost of a way is the
sum of the decimal logarithms of its spans' guesses, plus log10(2) for each span
after the first. A value of `strong` (10^10 guesses) or more is reported as a
secret, a cheaper one as guessable. Spans are:

word      of ranked lists, in any case and with digits and signs for letters: its
          least rank, by the ways of its capitals. The lists are common passwords
          (WORDS), and the letter-only entries of a public tokenizer's vocabulary,
          which stand in the order of how often they were merged; its path is a
          parameter, and without that file WORDS are all there is
date      year of four digits, or day, month and year of two or four digits in
          the usual orders, with or without separators
repeat    whole repetitions, two or more, from the start of a maximal run of any
          period: the cost of the unit's own cheapest cut, by their number
walk      three characters or more on adjacent keys, to any end: the first key,
          its direction, and for each further step whether it turns
sequence  three or more letters or digits in alphabetical order or against it
brute     any span, each character by the size of its class

The program takes time in proportion to the value's length, but for units of
repeats, whose own programs add a logarithm: words and sequences have a longest
length, a walk and a brute-force span grow by one character at a time, in states
of their own, and there are no more runs than characters.

A value without quotes goes to the next white space, or to a separator before
another credential word; closing punctuation at its end isn't of it. After `is`
and after `bearer` and white space, which prose uses too, a value of letters only
and without quotes is a row only if its cost makes it a secret.

Defined results: null and empty texts have no value; a null doc_id, or one that
is no whole number, is null; each occurrence in each row is a row of its own,
numbered from 0 in order of place. Of ways of equal cost that of fewer spans
wins, then that whose spans come first by kind. Other columns aren't touched.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, powers

STRONG = 10.0
#: Lines of a token in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|client[_-]?secret|api[_-]?key|access[_-]?key(?:[_-]?id)?"
    r"|private[_-]?key|auth(?:orization|[_-]?token)?|access[_-]?token|token|credentials?|bearer)"
)
#: Of every text with a value, in the JVM's expressions and in Python's.
MAY_HOLD = rf"(?i){_NAME}[\"']?\s*(?:=|:|is\b)|bearer\s"
_START = r"(?-i:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_BARE = rf"(?![\"'])((?:[^\s,;&]|[,;&](?![\"']?[\w.-]*?{_START}{_NAME}[\"']?\s*[=:]))+)"
CONTEXT = re.compile(
    rf"(?i){_START}(?:(authorization)[\"']?\s*[:=]\s*[\"']?(?:basic|digest|token|apikey)\s+{_BARE}|(bearer)\s+{_BARE}"
    rf"|({_NAME})[\"']?\s*(=+>?|:=?|\bis\b:?)\s*(?![\"']?bearer\s)(?:\"([^\"\n]+)\"|'([^'\n]+)'|{_BARE}))",
    re.ASCII,
)
_OPENING = {")": "(", "]": "[", "}": "{", ">": "<"}
WORDS = """123456 password 123456789 12345678 12345 qwerty abc123 football monkey letmein dragon baseball iloveyou master
sunshine ashley bailey shadow superman qazwsx michael welcome login admin princess solo starwars passw0rd hello freedom
whatever trustno1 jordan harley ranger hunter buster soccer hockey killer george sexy andrew charlie thomas robert daniel
jessica pepper access joshua maggie secret pass test guest root user changeme default token example sample demo temp
server system manager network private public summer winter spring autumn monday friday january october november december
love angel flower cookie orange banana purple yellow silver golden cheese coffee chicken butter computer internet google
family mother father brother sister friend happy lucky magic power phoenix tiger eagle lion wolf bear horse rabbit
house garden river ocean mountain forest island storm thunder light dark night star moon sun sky fire water earth wind
blue green black white red pink gray brown king queen prince knight wizard ninja samurai pirate warrior soldier
apple cherry peach grape lemon melon correct battery staple key code word the and for you with that this from have not
are was but all can had her one our out day get has him his how man new now old see two way who boy did its let put say
she too use time year people good work first life world still great place right small large next early young important
public bad same able database oracle mysql postgres docker cloud github service account connect office company business""".split()
_LEET = [str.maketrans("4@836!1|0$572", f"aabeg{x}{x}{x}osstz") for x in "il"]
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
_SEPARATORS = "-/. _\\"
_KINDS = ("word", "date", "repeat", "walk", "sequence", "brute")
_EACH = math.log10(2)
#: Years are counted from here, and the nearest YEARS cost the same.
_NOW, _YEARS = 2020, 20
_LINES = {c: line for line in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for c in line}


def _neighbours() -> dict[str, set[str]]:
    at = {c: (i, j) for i, row in enumerate(_ROWS) for j, c in enumerate(row) if c != " "}
    return {c: {d for d, (k, m) in at.items() if d != c and abs(i - k) <= 1 and (m - j in (-1, 0, 1) if i == k else m - j in ((0, -1) if k > i else (0, 1)))} for c, (i, j) in at.items()}


_NEAR = _neighbours()
_DEGREE = sum(map(len, _NEAR.values())) / len(_NEAR)
#: Of nine steps in ten a walk goes straight on.
_KEY, _FIRST, _STRAIGHT, _TURN = math.log10(len(_NEAR)), math.log10(_DEGREE), -math.log10(0.9), math.log10(_DEGREE / 0.1)


def _pool(c: str) -> float:
    """Decimal logarithm of the size of the class that c is of."""
    if c.isascii():
        n = 10 if c.isdigit() else 26 if c.isalpha() else 33
    else:
        n = 100
    return math.log10(n)


def brute_cost(s: str) -> float:
    return sum(map(_pool, s))


def _variants(s: str) -> int:
    """Ways of capitals: one for all small, two for a first, last or all capitals, else one for each choice."""
    upper = sum(c.isupper() for c in s)
    if not upper:
        return 1
    if upper == len(s) or upper == 1 and (s[0].isupper() or s[-1].isupper()):
        return 2
    lower = sum(c.islower() for c in s)
    return max(2, sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))


class Ranks:
    """Words by rank, from 1, the least of all lists."""

    def __init__(self, *lists: list[str]) -> None:
        self.rank: dict[str, int] = {}
        for words in lists:
            for i, w in enumerate(dict.fromkeys(w.lower() for w in words), 1):
                self.rank[w] = min(i, self.rank.get(w, i))
        #: what a word may begin with
        self.begins = {w[:k] for w in self.rank for k in range(1, len(w) + 1)}

    @staticmethod
    def forms(s: str) -> list[str]:
        """s in small letters, then with letters for what stands for them; as long as s."""
        low = "".join(x if len(x := c.lower()) == 1 else c for c in s)
        return list(dict.fromkeys([low, *(low.translate(t) for t in _LEET)]))

    def words_from(self, s: str, forms: list[str], i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of each word of s from i."""
        for form in forms:
            for end in range(i + 1, len(s) + 1):
                word = form[i:end]
                if word not in self.begins:
                    break
                if end > i + 1 and word in self.rank and (form is forms[0] or word != forms[0][i:end]):
                    yield end, math.log10((1 if form is forms[0] else 2) * self.rank[word] * _variants(s[i:end]))


def vocabulary_words(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's entries of three letters or more, in its order; none if there is no such file."""
    if not os.path.exists(path):
        return []
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in sorted(f, key=lambda x: int(x.split()[1]))]
    words = [t.decode("utf-8", "ignore").strip().lower() for t in tokens]
    return [w for w in words if len(w) > 2 and w.isalpha()]


def _date(parts: tuple[str, str, str]) -> int | None:
    """Years from now of the nearest reading of three numbers as a date, if there is one."""
    best = None
    for y, a, b in ((0, 1, 2), (2, 0, 1)):
        year, m, d = parts[y], int(parts[a]), int(parts[b])
        if len(year) not in (2, 4) or len(parts[a]) > 2 or len(parts[b]) > 2 or not (1 <= m <= 12 and 1 <= d <= 31 or 1 <= d <= 12 and 1 <= m <= 31):
            continue
        n = int(year) if len(year) == 4 else int(year) + (1900 if int(year) > 50 else 2000)
        if 1900 <= n <= 2099:
            best = min(abs(n - _NOW), best) if best is not None else abs(n - _NOW)
    return best


def dates_from(s: str, i: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of each date from i."""
    digits = i
    while digits < len(s) and digits < i + 8 and "0" <= s[digits] <= "9":
        digits += 1
    if digits >= i + 4 and s[i : i + 2] in ("19", "20"):
        yield i + 4, math.log10(max(_YEARS, abs(int(s[i : i + 4]) - _NOW)))
    for width, cuts in ((6, ((2, 4),)), (8, ((4, 6), (2, 4)))):
        if digits >= i + width:
            far = [x for x in (_date((s[i : i + a], s[i + a : i + b], s[i + b : i + width])) for a, b in cuts) if x is not None]
            if far:
                yield i + width, math.log10(365 * max(_YEARS, min(far)))
    first = digits - i
    if first in (1, 2, 4) and s[digits : digits + 1] and s[digits] in _SEPARATORS:
        for middle in (1, 2):
            at = digits + 1 + middle
            if s[at : at + 1] != s[digits] or not (s[digits + 1 : at].isascii() and s[digits + 1 : at].isdigit()):
                continue
            for last in (1, 2, 4):
                end = at + 1 + last
                if end <= len(s) and s[at + 1 : end].isascii() and s[at + 1 : end].isdigit():
                    far = _date((s[i:digits], s[digits + 1 : at], s[at + 1 : end]))
                    if far is not None:
                        yield end, math.log10(365 * 4 * max(_YEARS, far))


def runs(s: str, direct: int = 2048) -> list[tuple[int, int, int]]:
    """(start, end, period) of each maximal run: of its least period, which it holds twice at least."""
    n = len(s)
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    found: list[np.ndarray] = []
    if n <= direct:
        for p in range(1, n // 2 + 1):
            same = np.zeros(n - p + 2, np.int8)
            same[1:-1] = code[:-p] == code[p:]
            turn = np.diff(same)
            start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            some = end - start >= p
            if some.any():
                found.append(np.stack([start[some], end[some] + p, np.full(some.sum(), p)], axis=1))
    else:
        # a run holds two neighbouring multiples of its period: from each such pair, as far as the text agrees to both sides
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        at = powers(_BASE, n + 1)

        def agree(a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
            low, high = np.zeros_like(most), most
            while (low < high).any():
                mid = (low + high + 1) // 2
                x, y = (a, b) if way > 0 else (a - mid, b - mid)
                same = (sums[x + mid] - sums[x]) * at[b - a] == sums[y + mid] - sums[y]
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        p = 1
        while p <= n // 2:
            last, pairs = p, 0
            while last <= n // 2 and (pairs < 1 << 20 or last == p):
                pairs += (n - 1) // last
                last += 1
            period = np.repeat(np.arange(p, last), (n - 1) // np.arange(p, last))
            k = np.arange(len(period)) - np.searchsorted(period, period)
            a = k * period
            b = a + period
            end, start = b + agree(a, b, n - b, 1), a - agree(a, b, a, -1)
            some = end - start >= 2 * period
            found.append(np.stack([start[some], end[some], period[some]], axis=1))
            p = last
    least: dict[tuple[int, int], int] = {}
    for start, end, p in (np.concatenate(found).tolist() if found else ()):
        least[start, end] = min(p, least.get((start, end), p))
    return [(start, end, p) for (start, end), p in least.items()]


_BASE = 0x9E3779B97F4A7C15


def _direction(a: str, b: str) -> tuple[int, int] | None:
    a, b = _SHIFTED.get(a, a.lower()), _SHIFTED.get(b, b.lower())
    if b not in _NEAR.get(a, ()):
        return None
    (i, j), (k, m) = ((r, row.index(c)) for c in (a, b) for r, row in enumerate(_ROWS) if c in row)
    return k - i, m - j


def spans_from(s: str, forms: list[str], i: int, ranks: Ranks, repeats: dict[int, list[tuple[int, float]]]) -> Iterator[tuple[int, str, float]]:
    """(end, kind, cost) of each span from i, but for walks and brute-force ones; repeats has those of each place."""
    for end, cost in ranks.words_from(s, forms, i):
        yield end, "word", cost
    if "0" <= s[i] <= "9":
        for end, cost in dates_from(s, i):
            yield end, "date", cost
    for end, cost in repeats.get(i, ()):
        yield end, "repeat", cost
    line = _LINES.get(s[i], "")
    for way in (1, -1):
        j, at = i, line.find(s[i]) if line else 0
        while line and j < len(s) and 0 <= at < len(line) and s[j] == line[at]:
            j, at = j + 1, at + way
            if j - i > 2:
                base = 4 if s[i] in "aAzZ019" else 10 if len(line) == 10 else 26
                yield j, "sequence", math.log10(base * (j - i) * (2 if way < 0 else 1))


def cheapest(s: str, ranks: Ranks, units: dict[str, float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """Cost and spans (kind, text) of the cheapest way to cut s; units: what units of repeats were found to cost."""
    n, forms, units = len(s), ranks.forms(s), {} if units is None else units
    repeats: dict[int, list[tuple[int, float]]] = {}
    for start, end, p in runs(s):
        unit = s[start : start + p]
        if unit not in units:
            units[unit] = cheapest(unit, ranks, units)[0]
        repeats.setdefault(start, []).extend((start + k * p, units[unit] + math.log10(k)) for k in range(2, (end - start) // p + 1) if k * p > 2)
    none = (math.inf, 0, 0)
    #: best way to reach i by any span; and by one that may grow, with its start: a brute-force span,
    #: and walks of one, two, and more characters, without and with a shifted one
    best: list[tuple[float, int]] = [(math.inf, 0)] * (n + 1)
    back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    brute, one, two, more = none, none, none, [none, none]
    best[0] = (0.0, 0)
    way_before, was_shifted = None, False
    for i, c in enumerate(s):
        cost, count = best[i]
        each = _EACH if i else 0.0
        brute = min((cost + each + _pool(c), count + 1, i), (brute[0] + _pool(c), *brute[1:]))
        shifted = c.isupper() or c in _SHIFTED
        way = _direction(s[i - 1], c) if i else None
        if way is None:
            two, grown = none, [none, none]
        else:
            step = _STRAIGHT if way == way_before else _TURN
            pair_shifted = was_shifted or (i > 1 and (s[i - 2].isupper() or s[i - 2] in _SHIFTED))
            ways = [[], []]
            for flag, state in ((pair_shifted, two), (False, more[0]), (True, more[1])):
                ways[flag or shifted].append((state[0] + step + (_EACH if shifted and not flag else 0.0), *state[1:]))
            grown = [min(w, default=none) for w in ways]
            two = (one[0] + _FIRST + (_EACH if shifted and not was_shifted else 0.0), *one[1:])
        more = grown
        one = (cost + each + _KEY + (_EACH if shifted else 0.0), count + 1, i)
        way_before, was_shifted = way, shifted
        for end, kind, span in spans_from(s, forms, i, ranks, repeats):
            _offer(best, back, end, (cost + each + span, count + 1), i, _KINDS.index(kind))
        for state, k in ((more[0], 3), (more[1], 3), (brute, 5)):
            _offer(best, back, i + 1, state[:2], state[2], k)
    spans, at = [], n
    while at:
        i, k = back[at]
        spans.append((_KINDS[k], s[i:at]))
        at = i
    return best[n][0], spans[::-1]


def _offer(best: list, back: list, end: int, way: tuple[float, int], start: int, kind: int) -> None:
    if way < best[end] or way == best[end] and kind < back[end][1]:
        best[end], back[end] = way, (start, kind)


def _trimmed(s: str) -> str:
    """s without closing punctuation at its end; a bracket that closes one of s stays."""
    while s and (s[-1] in "\"',;.:" or s[-1] in _OPENING and s.count(s[-1]) > s.count(_OPENING[s[-1]])):
        s = s[:-1]
    return s


def values(text: str) -> Iterator[tuple[str, str, bool]]:
    """(context, value, whether prose is as likely) of every value in a credential's place."""
    for m in CONTEXT.finditer(text):
        scheme, given, bearer, carried, name, by, double, single, bare = m.groups()
        quoted = double or single
        value = quoted or _trimmed(given or carried or bare)
        if value:
            loose = not quoted and (bearer or by and by[0] in "iI") and value.rstrip("!?").replace("'", "").isalpha()
            yield (scheme or bearer or name).lower(), value, bool(loose)


def scan(docs: DataFrame, words: list[str] | None = None, vocabulary: str = VOCABULARY, strong: float = STRONG) -> DataFrame:
    """(doc_id, match, context, value, guesses_log10, spans, secret) of every value in a credential's place."""
    ranks = Ranks(WORDS if words is None else words, vocabulary_words(vocabulary))
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, units = held.value, {}
        for b in batches:
            known: dict[str, tuple] = {}
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                match = 0
                for context, value, loose in values(text):
                    if value not in known:
                        known[value] = cheapest(value, ranks, units if len(units) < 100_000 else {})
                    cost, spans = known[value]
                    if loose and cost < strong:
                        continue
                    rows.append((None if doc_id is None else int(doc_id), match, context, value, cost, [f"{k}:{t}" for k, t in spans], cost >= strong))
                    match += 1
            out = pd.DataFrame(rows, columns=["doc_id", "match", "context", "value", "guesses_log10", "spans", "secret"], dtype=object)
            yield out.astype({"doc_id": "Int64", "match": "int32", "guesses_log10": float, "secret": bool})

    found = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(MAY_HOLD))
    # ids travel as text: a batch with a null id would make the others floats
    return found.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id bigint, match int, context string, value string, guesses_log10 double, spans array<string>, secret boolean")
