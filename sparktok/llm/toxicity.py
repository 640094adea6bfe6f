"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length.

Folding: letters lose case and accents, look-alikes of other scripts and compatibility forms become Latin letters, digits
and the signs @ $ ! | + become the letters that they stand for (a sign only between letters or digits, but $ before one as well), what is invisible
goes, all else between words is one blank. ``1 ! |`` may be i or l: both are folded to one code for the search, and what is
found is compared with the letters where the text has letters. A term counts where it is whole words, and not inside an
exception phrase. The score is the weight of all terms per 1,000 words, of ``least_words`` words at least. Where labelled
documents are given, terms and stems learned from them (toxic_terms.py) join the lexicon; of terms that begin at the same
place the heaviest counts.

Nulls and odd cases: a null or empty text, or one without words, has the score 0; a row without an id is reported without
one; rows that repeat an id are scored each. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .common import texts, tidy

#: Insults by severity; ordinary words that are insults in some uses weigh least.
LEXICON: dict[str, float] = {
    **dict.fromkeys("asshole assholes bastard bastards bitch bitches cunt cunts dickhead fuck fucked fucker fuckers fucking motherfucker motherfuckers piss whore whores slut sluts retard retards retarded arschloch wichser hurensohn fotze connard connasse encule salope pendejo cabron puta puto gilipollas".split(), 2.0),
    **dict.fromkeys("idiot idiots idiotic moron morons moronic imbecile imbeciles scum scumbag scumbags dumbass halfwit nitwit dimwit degenerate degenerates subhuman vermin crap bullshit shit shitty schlampe vollidiot trottel abschaum imbecil estupido".split(), 1.5),
    **dict.fromkeys("stupid loser losers pathetic worthless disgusting despicable contemptible filthy lowlife trash clown clowns dumb fool fools jerk jerks creep creeps parasite parasites pig swine hateful".split(), 1.0),
    "kill yourself": 4.0,
    "go to hell": 2.0,
    "shut up": 1.0,
    "piece of garbage": 1.5,
    "waste of space": 1.5,
}
#: Phrases in which a term is no insult.
EXCEPTIONS = [
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "clown fish", "guinea pig", "guinea pigs", "pig iron", "pig farm", "sore loser rule", "graceful loser",
    "april fool", "april fools", "fool s gold", "jerk chicken", "dumb waiter", "dumb bell", "feature creep", "mission creep", "fire retardant", "flame retardant",
]

_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_EITHER = "1!|"
_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһкмтвнԛԝցսոαορικντυεχηβƒıłøđħŧɑɡᴀʙᴄᴅᴇɢʜᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ",
        "aeopcyxijsdhkmtbhqwguoaopikvtuexnbfilodhtagabcdeghjklmnoprtuvwyz",
        strict=True,
    )
)
GONE, OTHER, GAP = 255, 1, 32


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each codepoint up to U+1FFFF: its code for the search, its letter where that is certain, and whether it is a sign for a letter."""
    n = 0x20000
    code, letter, sign = np.full(n, OTHER, np.uint8), np.zeros(n, np.uint8), np.zeros(n, bool)
    for cp in range(n):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            code[cp] = GONE
            continue
        base = unicodedata.normalize("NFKD", c.lower())[:1].lower() if kind[0] in "LNS" else c
        base = _ALIKE.get(base, base)
        if base in _SIGNS and c in _SIGNS:
            code[cp], sign[cp] = ord(_SIGNS[base]), True
            letter[cp] = 0 if base in _EITHER else code[cp]
        elif base in _DIGITS:
            code[cp] = ord(_DIGITS[base])
            letter[cp] = 0 if base in _EITHER else code[cp]
        elif "a" <= base <= "z":
            letter[cp], code[cp] = ord(base), ord("i" if base == "l" else base)
        elif kind[0] not in "LN":
            code[cp] = GAP
    return code, letter, sign


def fold(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and letters of texts, their offsets, and each text's number of words. Each text begins and ends with a gap."""
    code, letter, sign = tables()
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(lead, off) if len(lead) == len(cps) else None
    if doc is None:  # malformed bytes: text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        cps, doc = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    small = np.minimum(cps, 0x1FFFF)
    c, s = code[small], letter[small]
    c = np.where(cps < 0x20000, c, np.uint8(OTHER))
    doc_of = np.repeat(np.arange(len(off) - 1), np.diff(doc))
    keep = c != GONE
    c, s, small, doc_of = c[keep], s[keep], small[keep], doc_of[keep]
    marks = np.flatnonzero(sign[small])
    if len(marks):
        inside = (c != GAP) & ~sign[small]
        before = (marks > 0) & inside[marks - 1] & (doc_of[marks - 1] == doc_of[marks])
        after = np.minimum(marks + 1, len(c) - 1)
        ok = (before | (small[marks] == ord("$"))) & (after > marks) & inside[after] & (doc_of[after] == doc_of[marks])
        c[marks[~ok]], s[marks[~ok]] = GAP, 0
    # one gap between words, and one around each text
    word = c != GAP
    start = word.copy()
    start[1:] &= ~word[:-1] | (doc_of[1:] != doc_of[:-1])
    words = np.bincount(doc_of[start], minlength=len(off) - 1)
    c, s, doc_of, start = c[word], s[word], doc_of[word], start[word]
    at = np.arange(len(c)) + np.cumsum(start) + doc_of
    out, strict = np.full(len(c) + int(words.sum()) + len(off) - 1, GAP, np.uint8), np.zeros(len(c) + int(words.sum()) + len(off) - 1, np.uint8)
    out[at], strict[at] = c, s
    length = np.bincount(doc_of, minlength=len(off) - 1) + words + 1
    return out, strict, np.concatenate([[0], np.cumsum(length)]), words


def fold_text(text: str) -> str:
    """The search form of one text, without its outer gaps."""
    data = np.frombuffer(text.encode(), np.uint8)
    return fold(data, np.array([0, len(data)]))[0].tobytes().decode("latin-1").strip()


@dataclass(frozen=True)
class Toxicity:
    threshold: float = 2.5
    least_words: int = 20


class Matcher:
    """learned: weights of terms in the search form; one that ends with $ is a whole word, another what words begin with."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], learned: dict[str, float] | None = None):
        import ahocorasick

        #: letters, weight or None for an exception, the letters to compare, whether it is a stem
        self.terms: list[tuple[int, float | None, bytes, bool]] = [(len(t), w, t.encode("ascii"), False) for t, w in [*lexicon.items(), *((t, None) for t in exceptions)]]
        by: dict[str, list[int]] = {}
        for k, (_, _, raw, _) in enumerate(self.terms):
            by.setdefault(" " + raw.decode().lower().replace("l", "i") + " ", []).append(k)
        for t, w in (learned or {}).items():
            by.setdefault(" " + (t[:-1] + " " if t[-1] == "$" else t), []).append(len(self.terms))
            # the letters of a search form are all that is known of it: there is nothing more to compare
            self.terms.append((len(t.removesuffix("$")), w, b"", t[-1] != "$"))
        self.automaton = ahocorasick.Automaton()
        for key, own in by.items():
            self.automaton.add_word(key, own)
        if by:
            self.automaton.make_automaton()

    def weigh(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, number of terms and words of each text."""
        n = len(col)
        weight, count, words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        data, boff = T.buffers(col)
        for r0, r1 in T.rows(boff):
            code, strict, off, words[r0:r1] = fold(data[boff[r0] : boff[r1]], boff[r0 : r1 + 1] - boff[r0])
            if not len(self.automaton):
                continue
            hits: dict[int, tuple[float, int]] = {}
            covers: list[tuple[int, int]] = []
            for end, own in self.automaton.iter(code.tobytes().decode("latin-1")):
                for k in own:
                    n, w, raw, stem = self.terms[k]
                    e = end + stem
                    s = e - n
                    if raw and not all(x == y or x == 0 for x, y in zip(strict[s:e].tobytes(), raw, strict=True)):
                        continue
                    if w is None:
                        covers.append((s, e))
                    else:
                        hits[s] = max(hits.get(s, (0.0, 0)), (w, e))
            covers.sort()
            start = [x for x, _ in covers]
            reach = np.maximum.accumulate([y for _, y in covers]) if covers else []
            for s, (w, e) in hits.items():
                k = bisect.bisect_right(start, s)
                if not k or reach[k - 1] < e:
                    d = r0 + int(np.searchsorted(off, s, "right")) - 1
                    weight[d] += w
                    count[d] += 1
        return weight, count, words


@cache
def _matcher(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...], learned: tuple[tuple[str, float], ...]) -> Matcher:
    return Matcher(dict(lexicon), list(exceptions), dict(learned))


def toxicity(df: DataFrame, lexicon: dict[str, float] | None = None, exceptions: list[str] | None = None, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text", learned: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_terms, weight, score of every text. learned: further terms, as toxic_terms.learn() gives them."""
    terms, spared, more = tuple((LEXICON if lexicon is None else lexicon).items()), tuple(EXCEPTIONS if exceptions is None else exceptions), tuple((learned or {}).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(terms, spared, more)
        for b in batches:
            weight, count, words = m.weigh(b.column("text"))
            score = 1000 * weight / np.maximum(words, p.least_words)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (words, count, weight, score))], ["doc_id", "n_words", "n_terms", "weight", "score"])

    return texts(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_words long, n_terms long, weight double, score double")


def toxic_documents(df: DataFrame, p: Toxicity = Toxicity(), **more) -> DataFrame:
    """The rows of toxicity() whose score is over the threshold."""
    return toxicity(df, p=p, **more).where(f"score > {p.threshold}")
