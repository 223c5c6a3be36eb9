"""The published Flesch-Kincaid grade, which the library doesn't use, to compare with."""

import re

_VOWELS = re.compile(r"[aeiouyàâäéèêëíîïóôöúùûü]+")


def syllables(word):
    n = len(_VOWELS.findall(word))
    return max(1, n - (n > 1 and word[-1] == "e" and not word.endswith("le")))


def grade(sents):
    words = sum(map(len, sents))
    return 0.39 * words / len(sents) + 11.8 * sum(syllables(w) for s in sents for w in s) / words - 15.59
