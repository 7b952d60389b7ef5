"""English words: stop words, Porter's stemmer (1980), and snippets."""

from __future__ import annotations

import re

STOPWORDS = frozenset(
    """between through before during should about above after being below could every might other these those where which
    would been both does each from have into just more most must only same some such than that they this very were what when
    will with all and are but can did don few for had has how may nor not now own she the too was who why an at be by do he in
    is it no of on or so to up we you a i s t""".split()
)
_WORD = re.compile(r"[^\W_]+")
_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _kinds(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _short_end(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            return w[: -len(end)] + table[end] if _measure(w[: -len(end)]) > 0 else w
    return w


def stem(w: str) -> str:
    """The stem of a word in small letters; words of up to two letters stay."""
    if len(w.encode()) <= 2 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _kinds(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-1:] == w[-2:-1] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _SECOND), _THIRD)
    for end in _FOURTH:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_text(text: str) -> str:
    """Each run of letters and digits stemmed, all else as it is."""
    return _WORD.sub(lambda m: stem(m[0].lower()), text)


def tokens(text: str, stemmed: bool = True) -> list[str]:
    """Search terms of a query in order, stop words left out."""
    words = [w for w in (m[0].lower() for m in _WORD.finditer(text)) if w not in STOPWORDS]
    return [stem(w) for w in words] if stemmed else words


def snippet(text: str | None, terms: list[str], longest: int = 160) -> str | None:
    """The stretch of at most `longest` characters from a match that holds the most matches, marked; None without one.

    Terms match whole words in any case. Of stretches with equally many the first wins.
    """
    if text is None or not terms:
        return None
    wanted = {t.lower() for t in terms}
    hits = [m.span() for m in _WORD.finditer(text) if m[0].lower() in wanted]
    if not hits:
        return None
    start = max(hits, key=lambda h: (sum(h[0] <= s and e <= h[0] + longest for s, e in hits), -h[0]))[0]
    end = min(len(text), start + longest)
    out, at = ["..." if start else ""], start
    for s, e in hits:
        if s >= start and e <= end:
            out += [text[at:s], "<mark>", text[s:e], "</mark>"]
            at = e
    return "".join([*out, text[at:end], "..." if end < len(text) else ""])
