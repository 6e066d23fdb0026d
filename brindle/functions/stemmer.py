"""English stemming by the published suffix-stripping rules, in the variant that the search index uses.

Differences from the textbook: y always is a consonant, words in -us keep their s, and in steps 2 to 4
the first suffix of the list that matches decides, even if its condition then fails.
"""

from __future__ import annotations

# The published suffix lists, in the order in which they are tried.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]

VOWELS = frozenset("aeiou")


def shape(word: str) -> str:
    """v for each vowel, c for each other character."""
    return "".join("v" if c in VOWELS else "c" for c in word)


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def ends_cvc(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us")) else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            return _mended(stem) if "v" in shape(stem) else w
    return w


def _mended(s: str) -> str:
    if s.endswith(("at", "bl", "iz")):
        return s + "e"
    if len(s) > 1 and s[-1] == s[-2] and s[-1] not in VOWELS and s[-1] not in "lsz":
        return s[:-1]
    return s + "e" if measure(s) == 1 and ends_cvc(s) else s


_RULES_2, _RULES_3, _RULES_4 = ((tuple(end for end, _ in rules), rules) for rules in (STEP_2, STEP_3, [(end, "") for end in STEP_4]))


def _replaced(w: str, ends: tuple[str, ...], rules: list[tuple[str, str]], least: int) -> str | None:
    if not w.endswith(ends):
        return None
    for end, new in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if measure(stem) > least else w
    return None


def stem(word: str) -> str:
    w = word.lower()
    if len(word.encode()) <= 2:
        return w
    w = _past(_plural(w))
    if len(w) > 1 and w[-1] == "y" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for rules in (_RULES_2, _RULES_3):
        got = _replaced(w, *rules, 0)
        w = w if got is None else got
    got = _replaced(w, *_RULES_4, 1)
    if got is None and w.endswith(("sion", "tion")) and measure(w[:-3]) > 1:
        got = w[:-3]
    w = w if got is None else got
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not ends_cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w
