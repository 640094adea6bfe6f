"""Unicode at two fixed versions whatever the runtime has: character classes of 16.0, NFC of 9.0.

The constants are the differences between those versions and the tables of Java 17 and of Python's unicodedata 15.1; they
are checked against an independent tokenizer library in the tests.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

L, N, S, NL = 1, 2, 4, 8


def _ranges(text: str) -> list[tuple[int, int]]:
    out = []
    for part in text.split():
        a, _, b = part.partition("-")
        out.append((int(a, 16), int(b or a, 16)))
    return out


#: Letters of Unicode 16.0 that Java 17 doesn't know.
JAVA_LETTERS = _ranges(
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA "
    "10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
JAVA_NUMBERS = _ranges("10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA")
#: The same for Python's tables.
PYTHON_LETTERS = _ranges(
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
PYTHON_NUMBERS = _ranges("10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA")
WHITE_SPACE = _ranges("9-D 20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000")
#: Characters that take part in NFC today, and didn't in Unicode 9.0: they stand as they are, and nothing goes across them.
BARRIERS = _ranges(
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E "
    "11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF"
)

#: Characters from U+0300 on that NFC text of Unicode 9.0 can't hold, or only after some others, and those that may be put in another order.
UNSTABLE = _ranges(
    "300-34E 350-36F 374 37E 387 483-487 591-5BD 5BF 5C1-5C2 5C4-5C5 5C7 610-61A 64B-65F 670 6D6-6DC 6DF-6E4 6E7-6E8 6EA-6ED 711 730-74A 7EB-7F3 816-819 "
    "81B-823 825-827 829-82D 859-85B 8D4-8E1 8E3-8FF 93C 94D 951-954 958-95F 9BC 9BE 9CD 9D7 9DC-9DD 9DF A33 A36 A3C A4D A59-A5B A5E ABC ACD B3C B3E B4D "
    "B56-B57 B5C-B5D BBE BCD BD7 C4D C55-C56 CBC CC2 CCD CD5-CD6 D3E D4D D57 DCA DCF DDF E38-E3A E48-E4B EB8-EB9 EC8-ECB F18-F19 F35 F37 F39 F43 F4D F52 "
    "F57 F5C F69 F71-F76 F78 F7A-F7D F80-F84 F86-F87 F93 F9D FA2 FA7 FAC FB9 FC6 102E 1037 1039-103A 108D 1161-1175 11A8-11C2 135D-135F 1714 1734 17D2 17DD "
    "18A9 1939-193B 1A17-1A18 1A60 1A75-1A7C 1A7F 1AB0-1ABD 1B34-1B35 1B44 1B6B-1B73 1BAA-1BAB 1BE6 1BF2-1BF3 1C37 1CD0-1CD2 1CD4-1CE0 1CE2-1CE8 1CED 1CF4 "
    "1CF8-1CF9 1DC0-1DF5 1DFB-1DFF 1F71 1F73 1F75 1F77 1F79 1F7B 1F7D 1FBB 1FBE 1FC9 1FCB 1FD3 1FDB 1FE3 1FEB 1FEE-1FEF 1FF9 1FFB 1FFD 2000-2001 20D0-20DC "
    "20E1 20E5-20F0 2126 212A-212B 2329-232A 2ADC 2CEF-2CF1 2D7F 2DE0-2DFF 302A-302F 3099-309A A66F A674-A67D A69E-A69F A6F0-A6F1 A806 A8C4 A8E0-A8F1 "
    "A92B-A92D A953 A9B3 A9C0 AAB0 AAB2-AAB4 AAB7-AAB8 AABE-AABF AAC1 AAF6 ABED F900-FA0D FA10 FA12 FA15-FA1E FA20 FA22 FA25-FA26 FA2A-FA6D FA70-FAD9 "
    "FB1D-FB1F FB2A-FB36 FB38-FB3C FB3E FB40-FB41 FB43-FB44 FB46-FB4E FE20-FE2F 101FD 102E0 10376-1037A 10A0D 10A0F 10A38-10A3A 10A3F 10AE5-10AE6 11046 "
    "1107F 110B9-110BA 11100-11102 11127 11133-11134 11173 111C0 111CA 11235-11236 112E9-112EA 1133C 1133E 1134D 11357 11366-1136C 11370-11374 11442 11446 "
    "114B0 114BA 114BD 114C2-114C3 115AF 115BF-115C0 1163F 116B6-116B7 1172B 11C3F 16AF0-16AF4 16B30-16B36 1BC9E 1D15E-1D169 1D16D-1D172 1D17B-1D182 "
    "1D185-1D18B 1D1AA-1D1AD 1D1BB-1D1C0 1D242-1D244 1E000-1E006 1E008-1E018 1E01B-1E021 1E023-1E024 1E026-1E02A 1E8D0-1E8D6 1E944-1E94A 2F800-2FA1D"
)


def java_class(ranges: list[tuple[int, int]]) -> str:
    """The inside of a Java character class."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def nested_class(ranges: list[tuple[int, int]]) -> str:
    """A class that compares a character with few of its ranges: halves nested in their bounds, so that a character is left out by the first bounds it is outside of. Java tries the ranges of a flat class one by one."""
    bounds = java_class([(ranges[0][0], ranges[-1][1])])
    if len(ranges) <= 4:
        return f"[{bounds}&&[{java_class(ranges)}]]"
    half = len(ranges) // 2
    return f"[{bounds}&&[{nested_class(ranges[:half])}{nested_class(ranges[half:])}]]"


_PL, _PN = "\\p{L}" + nested_class(JAVA_LETTERS), "\\p{N}" + nested_class(JAVA_NUMBERS)
#: The split pattern as tokenizer files have it: the only profile there is.
PROFILE_1 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: The same for Java's engine, at Unicode 16.0; (?U) gives \s and case folding their Unicode meaning.
SPLIT_JAVA = "(?U)" + (
    "(?i:'s|'t|'re|'ve|'m|'ll|'d)"
    f"|[^\\r\\n{_PL}{_PN}]?[{_PL}]+"
    f"|[{_PN}]"
    f"| ?[^\\s{_PL}{_PN}]+[\\r\\n]*"
    "|\\s*[\\r\\n]+"
    "|\\s+(?!\\S)"
    "|\\s+"
)


@cache
def _extra() -> tuple[frozenset[int], frozenset[int], frozenset[int]]:
    spread = lambda rs: frozenset(c for a, b in rs for c in range(a, b + 1))
    return spread(PYTHON_LETTERS), spread(PYTHON_NUMBERS), spread(WHITE_SPACE)


def char_class(cp: int) -> int:
    """L, N, S, or S | NL; 0 for all else, surrogates and what is no codepoint included."""
    letters, numbers, white = _extra()
    if cp in white:
        return S | NL if cp in (10, 13) else S
    if not 0 <= cp < 0x110000:
        return 0
    kind = unicodedata.category(chr(cp))[0]
    if kind == "L" or cp in letters:
        return L
    return N if kind == "N" or cp in numbers else 0


_BARRIER = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in BARRIERS) + "])")


def nfc(text: str) -> str:
    """Canonical composition as of Unicode 9.0."""
    if text.isascii():
        return text
    if not _BARRIER.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_BARRIER.split(text)))


#: A Java pattern that finds something in every text that NFC may change: a text without any such character is NFC as it is.
MAY_CHANGE = nested_class(UNSTABLE)


def _in(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def combining_class(cp: int) -> int:
    """The canonical combining class as of Unicode 9.0: 0 for marks that came later."""
    return 0 if _in(cp, BARRIERS) or not 0 <= cp < 0x110000 else unicodedata.combining(chr(cp))


@cache
def _seconds() -> frozenset[int]:
    """Characters that compose with one before them: the second halves of compositions, and Hangul vowels and finals."""
    out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for cp in range(0xC0, 0x30000):
        d = unicodedata.decomposition(chr(cp)) if not 0xAC00 <= cp < 0xE000 and not _in(cp, BARRIERS) else ""
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out.add(int(d.split()[1], 16))
    return frozenset(x for x in out if not _in(x, BARRIERS))


def nfc_quick_check(cp: int) -> int:
    """Whether NFC text as of Unicode 9.0 can hold a character: 0 no, 1 yes, 2 maybe, by what is before it."""
    if not 0 <= cp < 0x110000 or 0xD800 <= cp < 0xE000 or _in(cp, BARRIERS):
        return 1
    if unicodedata.normalize("NFC", chr(cp)) != chr(cp):
        return 0
    return 2 if cp in _seconds() else 1


def decompose(cp: int) -> list[int]:
    """The full canonical decomposition as of Unicode 9.0."""
    return [cp] if _in(cp, BARRIERS) or 0xD800 <= cp < 0xE000 else [ord(c) for c in unicodedata.normalize("NFD", chr(cp))]


def compose(a: int, b: int) -> int | None:
    """What two characters compose to as of Unicode 9.0; None if they don't."""
    if _in(a, BARRIERS) or _in(b, BARRIERS):
        return None
    text = unicodedata.normalize("NFC", chr(a) + chr(b))
    return ord(text) if len(text) == 1 and text != chr(a) else None
