"""The guess-cost program against every cut of short values, with spans and costs listed from their definitions."""

from __future__ import annotations

import itertools
import math
import random
import string

import pytest

from polymere.llm import guess_cost

KEYS = {}
for _row, _line in enumerate(["`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./"]):
    for _col, _c in enumerate(_line):
        if _c != " ":
            KEYS[_c] = (_row, _col + _row / 2)
UNSHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
ADJACENT = {(a, b): (KEYS[b][0] - KEYS[a][0], KEYS[b][1] - KEYS[a][1]) for a in KEYS for b in KEYS if a != b and abs(KEYS[b][0] - KEYS[a][0]) <= 1 and abs(KEYS[b][1] - KEYS[a][1]) == (1 if KEYS[b][0] == KEYS[a][0] else 0.5)}
DEGREE = len(ADJACENT) / len(KEYS)
STANDS_FOR = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "0": "o", "$": "s", "5": "s", "7": "t", "2": "z"}


def word(s: str, ranks: dict[str, int]) -> float:
    costs = [math.inf]
    for one in ("i", "l"):
        plain = "".join(STANDS_FOR.get(c, one if c in "1!|" else c) for c in s.lower())
        if s.lower() in ranks:
            costs.append(ranks[s.lower()])
        if plain in ranks and plain != s.lower():
            costs.append(2 * ranks[plain])
    upper, lower = sum(map(str.isupper, s)), sum(map(str.islower, s))
    ways = 1 if not upper else 2 if upper == len(s) or upper == 1 and (s[0].isupper() or s[-1].isupper()) else max(2, sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))
    return math.log10(min(costs) * ways) if min(costs) < math.inf else math.inf


def date(s: str) -> float:
    best = math.inf
    if len(s) == 4 and s.isdigit() and 1900 <= int(s) <= 2099:
        best = math.log10(max(20, abs(int(s) - 2020)))
    for order in ("ymd", "dmy", "mdy", "ydm"):
        for y, m, d in itertools.product((2, 4), (1, 2), (1, 2)):
            for sep in ["", *"-/. _\\"]:
                width = {"y": y, "m": m, "d": d}
                if len(s) != y + m + d + 2 * len(sep) or not sep and (m, d) != (2, 2):
                    continue
                at, part, ok = 0, {}, True
                for k, x in enumerate(order):
                    part[x] = s[at : at + width[x]]
                    at += width[x]
                    ok &= part[x].isascii() and part[x].isdigit()
                    if k < 2:
                        ok &= s[at : at + len(sep)] == sep
                        at += len(sep)
                if ok and 1 <= int(part["m"]) <= 12 and 1 <= int(part["d"]) <= 31:
                    year = int(part["y"]) + (0 if y == 4 else 1900 if int(part["y"]) > 50 else 2000)
                    if 1900 <= year <= 2099:
                        best = min(best, math.log10(365 * max(20, abs(year - 2020)) * (4 if sep else 1)))
    return best


def walk(s: str) -> float:
    plain = [UNSHIFTED.get(c, c.lower()) for c in s]
    steps = list(zip(plain, plain[1:]))
    if len(s) < 3 or any(p not in ADJACENT for p in steps):
        return math.inf
    ways = [ADJACENT[p] for p in steps]
    cost = math.log10(len(KEYS) * DEGREE) + sum(-math.log10(0.9) if a == b else math.log10(DEGREE / 0.1) for a, b in zip(ways, ways[1:]))
    return cost + (math.log10(2) if any(c.isupper() or c in UNSHIFTED for c in s) else 0)


def sequence(s: str) -> float:
    steps = {ord(b) - ord(a) for a, b in zip(s, s[1:])}
    if len(s) < 3 or len(steps) != 1 or steps - {1, -1} or not any(all(c in kind for c in s) for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits)):
        return math.inf
    return math.log10((4 if s[0] in "aAzZ019" else 10 if s[0].isdigit() else 26) * len(s) * (2 if steps == {-1} else 1))


def brute(s: str) -> float:
    return sum(math.log10(100 if not c.isascii() else 10 if c.isdigit() else 26 if c.isalpha() else 33) for c in s)


def repeat(s: str, i: int, j: int, ranks: dict[str, int]) -> float:
    best = math.inf
    for p in range(1, (j - i) // 2 + 1):
        if (j - i) % p or j - i < 3 or any(s[k] != s[k + p] for k in range(i, j - p)):
            continue
        if i and s[i - 1] == s[i - 1 + p]:
            continue  # the run begins before
        if any(p % q == 0 and s[i : i + q] * (p // q) == s[i : i + p] for q in range(1, p)):
            continue  # of a lesser period
        best = min(best, every_cut(s[i : i + p], ranks) + math.log10((j - i) // p))
    return best


def every_cut(s: str, ranks: dict[str, int]) -> float:
    best = [0.0] + [math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(j):
            t = s[i:j]
            one = min(word(t, ranks) if j - i > 1 else math.inf, date(t), repeat(s, i, j, ranks), walk(t), sequence(t), brute(t))
            best[j] = min(best[j], best[i] + one + (math.log10(2) if i else 0))
    return best[-1]


VALUES = ["a", "pass", "P4ssw0rd1", "2024-05-06a", "aaaabab", "qwer99tyu", "loveme123", "é日本pass", "zzz0101201", "Qq!Qq!Qq!", "12/25/98", "25.12.98x", "981225", "19981225", "1-2-03", "31121999zyx", "abcdefcba", "Password1!Password1!", "xabcabcabcabx", "QWErty!@#", "9876abab", "l1verp00l", "qazxsw", "5678ytr"]


@pytest.mark.parametrize("value", VALUES)
def test_cheapest_cut_against_every_cut(value):
    ranks = guess_cost.Ranks(guess_cost.WORDS, ["the", "liverpool", "abc"])
    cost, spans = guess_cost.cheapest(value, ranks)
    assert cost == pytest.approx(every_cut(value, ranks.rank))
    assert "".join(t for _, t in spans) == value


def test_random_values():
    ranks, rng = guess_cost.Ranks(["abc", "ba", "cab1", "pass", "el"]), random.Random(7)
    for letters in ("abcs1p20", "qwe!@QA1", "12/0-98", "ab"):
        for _ in range(60):
            value = "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
            assert guess_cost.cheapest(value, ranks)[0] == pytest.approx(every_cut(value, ranks.rank)), value


def test_runs_by_both_ways_against_their_definition():
    rng = random.Random(5)
    for _ in range(150):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        want = {}
        for i in range(len(s)):
            for p in range(1, (len(s) - i) // 2 + 1):
                j = i + p
                while j < len(s) and s[j] == s[j - p]:
                    j += 1
                if j - i >= 2 * p and not (i and s[i - 1] == s[i - 1 + p]):
                    want[i, j] = min(p, want.get((i, j), p))
        assert sorted(guess_cost.runs(s)) == sorted(guess_cost.runs(s, 0)) == sorted((i, j, p) for (i, j), p in want.items())


def test_long_values_take_time_in_proportion():
    ranks = guess_cost.Ranks(guess_cost.WORDS)
    unit = "".join(random.Random(1).choice("abcdefgh0123") for _ in range(3000))
    cost, spans = guess_cost.cheapest(unit * 5, ranks)
    assert spans == [("repeat", unit * 5)] and cost == pytest.approx(guess_cost.cheapest(unit, ranks)[0] + math.log10(5))
    assert guess_cost.cheapest("as" * 5000, ranks)[0] < 7
    assert guess_cost.cheapest("q" + "wertyuiopoiuytre" * 400 + "X", ranks)[0] < 60


def test_secrets_and_guessable_values_are_told_apart():
    """At least 98 % of random tokens of twelve characters and more are secrets; at most 5 % of what people make up of words, years and walks are."""
    rng, ranks = random.Random(11), guess_cost.Ranks(guess_cost.WORDS, guess_cost.vocabulary_words())
    alphabets = [string.hexdigits.lower()[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.printable[:94]]
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (12, 16, 24, 40) for _ in range(25)]
    words = ["elephant", "liverpool", "changeit", "sunflowers", "monkey", "dragon", "summer", "company", "garden", "welcome", "chocolate", "football", "manchester", "princess", "winter"]
    made = [f(rng.choice(words)) for _ in range(12) for f in (
        lambda w: w, str.title, lambda w: w + "!", lambda w: w + str(rng.randint(1960, 2025)), lambda w: w + "123", lambda w: w.replace("e", "3").replace("o", "0"),
        lambda w: w + rng.choice(words), lambda w: w * 3, lambda w: "qwerty" + w, lambda w: f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(50, 99)}", lambda w: "1q2w3e4r",
    )]
    secret = lambda v: guess_cost.cheapest(v, ranks)[0] >= guess_cost.STRONG
    assert sum(map(secret, tokens)) >= 0.98 * len(tokens)
    assert sum(map(secret, made)) <= 0.05 * len(made)
