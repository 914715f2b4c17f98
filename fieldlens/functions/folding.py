"""Which letters fold to which: rules and fixed values for text that recognition may have read oddly."""

from __future__ import annotations

import unicodedata
from functools import cache

# Characters that fold to a letter, digit or mark because of how they look, by target.
LOOKS_LIKE = {
    '-': "‐‑‒–—―−─",
    '0': "ø",
    '1': "¹",
    '2': "²ƨ",
    '3': "³Ǝȝʒ϶зэҙӡ",
    '4': "цчҷӌ",
    '5': "ƽ",
    '7': "ɂ",
    'a': "ȺΔΛαад",
    'b': "ßþƀƁƃƅƥβбвъьѣҍ",
    'c': "¢ƈςϛϹсҁҫ",
    'd': "ÐÞđƉƊƌƏǝәₔ",
    'e': "£æŧƐƩƹȼɇΣεξеєҽҿӕ",
    'f': "Ŧƒƭɍϝғẛ",
    'g': "ƍƓǥ",
    'h': "ħʰʱΗЋнңҥһӈӊ",
    'i': "¡ıιіӏ",
    'j': "ĳɉʲϳј",
    'k': "ĸƙκϏкқҝҟҡӄ",
    'l': "|łƪ",
    'm': "Μϻмӎ",
    'n': "ŉŋƝƞΝηπ",
    'o': "¤ðœƆƟ˚˳δθοσФоѳө",
    'p': "Ƥƿρϼрҏὺύ",
    'q': "ǪǫǬǭɋϙ",
    'r': "ƦɌʳ",
    's': "ȿˢѕ",
    't': "ƫƬƮȽτтҭ",
    'u': "µĲμυ",
    'v': "νѵ",
    'w': "Ɯʷωϣшщѡѿ",
    'x': "×ˣχϗхҳӽ",
    'y': "¥ƔƴɏʸΥγуү",
    'z': "ƶȥɀΖ",
    'º': "°⁰",
}
# Ranges and single code points in which a letter with marks folds to its bare letter, and what stays there.
RANGES = (192, 591), (902, 1019), (1024, 1277), (7936, 8188), (8305, 8348)
SINGLE = 7682, 7683, 7690, 7691, 7710, 7711, 7744, 7745, 7766, 7767, 7776, 7777, 7786, 7787, 7808, 7809, 7810, 7811, 7812, 7813, 7868, 7869, 7922, 7923
STAY = 383, *range(452, 461), *range(497, 500), *range(911, 913), 915, 926, 928, 937, 982, *range(1008, 1010), 1012, *range(8040, 8048), *range(8104, 8112), 8126, *range(8186, 8189)


@cache
def fold_table() -> dict[str, str]:
    """Character to character: looks first, then the bare letter of what carries marks, then the looks of the small letter."""
    looks = {ch: target for target, chars in LOOKS_LIKE.items() for ch in chars}

    def folded(ch: str) -> str | None:
        if ch in looks:
            return looks[ch]
        bare = unicodedata.normalize("NFKD", ch)[:1]
        for other in (bare, bare.lower(), ch.lower()):
            if other != ch and other.isascii() and other.isalnum():
                return other.lower()
            if other in looks:
                return looks[other]
        return None

    points = {p for a, b in RANGES for p in range(a, b + 1)}.union(SINGLE).difference(STAY).union(map(ord, looks))
    return {chr(p): target for p in sorted(points) if (target := folded(chr(p))) is not None}
