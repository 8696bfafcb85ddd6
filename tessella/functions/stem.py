"""English stems by the published Porter2 (Snowball English) rules, word by word.

``stemmed`` applies them to a column of token arrays: each distinct token of an Arrow batch is
stemmed once, and stems stay known to the worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
#: Words with stems of their own, and words that stay.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
#: Words that stay once a plural ending is gone.
AFTER_PLURAL = set("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings behind which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
#: Endings of the second step and what takes their place, in the first region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
#: Endings of the third step.
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings of the fourth step, dropped in the second region.
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
LONGEST = {id(x): sorted(x, key=len, reverse=True) for x in (SECOND, THIRD)}
FOURTH_LONGEST = sorted(FOURTH, key=len, reverse=True)


def region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
    return start + m.end() if m else len(word)


def short_end(word: str) -> bool:
    """Does the word end in a short syllable?"""
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def longest(word: str, endings: list[str]) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub(f"(?:^|(?<=[{VOWELS}]))y", "Y", w)
    head = next((b for b in BEGINNINGS if w.startswith(b)), None)
    r1 = len(head) if head else region(w, 0)
    r2 = region(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    w = plural(w)
    if w in AFTER_PLURAL:
        return w
    w = past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = replaced(w, SECOND, r1, r2)
    w = replaced(w, THIRD, r1, r2)
    e = longest(w, FOURTH_LONGEST)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not short_end(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if any(c in VOWELS for c in w[:-2]) else w


def past(w: str, r1: int) -> str:
    e = longest(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"])
    if e in ("eed", "eedly"):
        return w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    if e is None or not any(c in VOWELS for c in w[: -len(e)]):
        return w
    w = w[: -len(e)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
        return w[:-1]
    return w + "e" if r1 >= len(w) and short_end(w) else w


def replaced(w: str, endings: dict[str, str], r1: int, r2: int) -> str:
    e = longest(w, LONGEST[id(endings)])
    if e is None or len(w) - len(e) < r1:
        return w
    before = w[: -len(e)]
    if e == "ogi" and not before.endswith("l") or e == "li" and before[-1:] not in "cdeghkmnrt" or e == "ative" and len(before) < r2:
        return w
    return before + endings[e]


def stemmed(tokens: Column) -> Column:
    """Stems of a column of token arrays, in their order."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        sizes = [0 if n is None else n for n in lists.value_lengths().to_pylist()]
        offsets = [0]
        for n in sizes:
            offsets.append(offsets[-1] + n)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems)

    return run(tokens)
