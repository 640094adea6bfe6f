"""Texts that tokenizers get wrong, and random ones, by seed."""

import random

HAND = [
    "", " ", "a", "it's", "IT'S", "I'LL we've don't", "'ſx", "it’s", "a<think>b", "<|imposter|>", "<|im_start|>user\nhi<|im_end|>\n", "<|im_end|><|im_end|>", "<|im_start", "café", "café", "각", "q̣̇",
    "q̣̇", "Å豈ﬁ", "q̣̇", "café", "각", "Å豈ﬁ", "!!!\n\n", " ...\r\n", "\r\r", "1a2b3", "١٢٣", "Ⅻ½", "日本語 한국어", "👩‍🚀🇩🇪", "שלום עולם", "हिन्दी", "ภาษาไทย", "x" * 300, "ab" * 200, " " * 50 + "x", "a​b᠎c", "  \n  \n x", "\t5", " 5", "̴࢘", "\U0001d15e",
]
SPACES = [c * n for c in (" ", "\t", " ", "　", " \t") for n in (1, 2, 3, 5, 17)]
WHITE = [t for s in SPACES for t in (s, s + "x", "x" + s, "x" + s + "y", s + "1", "!" + s + "!\n")]
ALPHABETS = ["abcXYZ 'stmdlrve", "  \t\n\r 　 a1!", "éè́̀ñ가ᅡᆨ中文1Ⅻ½ſ'", "😀‍🎉 !?.,;:#$\n", "<|im_start|>think>\n user 's <think>"]


def random_texts(n: int, seed: int = 20260805) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(a) for _ in range(draw.choice([1, 2, 3, 7, 20, 80, 400]))) for a in (draw.choice(ALPHABETS) for _ in range(n))]


def sweep(step: int, size: int = 500) -> list[str]:
    cps = [c for c in range(1, 0x110000, step) if not 0xD800 <= c < 0xE000]
    return ["".join(map(chr, cps[k : k + size])) for k in range(0, len(cps), size)]
