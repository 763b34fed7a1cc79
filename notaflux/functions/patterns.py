"""The grammar of measurements, dosages, laboratory values and tokens, as regular expressions of the JVM.

The alternatives (units, words of frequency and route) are fixed values; the shape of each pattern is described by its name.
Nested repetitions are possessive, so a long run of words costs linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Iterable

from notaflux.functions.spans import DIGIT as D
from notaflux.functions.spans import EDGE as E
from notaflux.functions.spans import SPACE as S
from notaflux.functions.spans import WORD as W

NUM = rf"{D}+[.,]?{D}*"
_I = "(?iu)"
#: The word boundary before a word character and after one: one look instead of two.
START, END = rf"(?<!{W})", rf"(?!{W})"

# Units of measurements kept as written, of doses, of laboratory values.
MEASURE_UNITS = r"mg|ml|mcg|g|kg|mm|cm|mmHg|bpm|UI|mEq|mmol|L|dL|mL|ug|ng|pg|U|%|x10[³3]|/mm[³3]"
DOSE_UNITS = "mg|ml|mcg|g|kg|ui|meq|gotas?|gt|cp|cpr|amp|comp"
LAB_UNITS = r"mg/dL|g/dL|mmol/L|mEq/L|U/L|ng/mL|pg/mL|mcg/dL|mm[³3]|/mm[³3]|%|mil/mm[³3]|x10[³3]/uL"
BARE_LAB_UNITS = r"mg/dL|g/dL|mmol/L|mEq/L|U/L|ng/mL|pg/mL|mcg/dL|/mm[³3]|mil/mm[³3]|x10[³3]/uL"
ROUTES = rf"via{S}+oral|vo|ev|im|sc|sl|intramuscular|endovenoso|subcutaneo|sublingual|topico"

MEASUREMENT = rf"{_I}{START}{NUM}{S}*(?:{MEASURE_UNITS}){E}"
PER_UNIT = rf"{_I}{START}{NUM}{S}*/{S}*(?:mm[³3]|dL|L|mL){END}"
DATE = rf"{START}{D}{{1,2}}/{D}{{1,2}}/{D}{{2,4}}{END}"
TIME = rf"{START}{D}{{1,2}}:{D}{{2}}(?::{D}{{2}})?{END}"
PROTECTED = (MEASUREMENT, PER_UNIT, DATE, TIME)

_DOSES = (
    rf"{NUM}{S}*(?:{DOSE_UNITS})",
    rf"{D}+{S}*(?:x|vez(?:es)?){S}*/?{S}*(?:ao{S}+)?(?:dia|d)",
    rf"de{S}+{D}+{S}*/{S}*{D}+{S}*h(?:oras?)?",
    rf"a{S}+cada{S}+{D}+{S}*h(?:oras?)?",
    rf"(?:{ROUTES})",
)
#: The five forms of a dosage, and what stands before and after each.
DOSE_FORMS, DOSE_EDGES = _DOSES, (_I + START, END)
DOSE_AMOUNT, DOSE_FREQUENCY, DOSE_INTERVAL, DOSE_EVERY, DOSE_ROUTE = DOSAGES = tuple(f"{DOSE_EDGES[0]}{p}{DOSE_EDGES[1]}" for p in _DOSES)

_NAME = r"a-zà-ü"
LAB_NAMED = rf"{_I}{START}[A-ZÀ-Ü][{_NAME}]++(?:{S}++[{_NAME}]++)*+{S}*+[:=]{S}*{NUM}{S}*(?:{LAB_UNITS}){E}"
LAB_BARE = rf"{_I}{START}{NUM}{S}*(?:{BARE_LAB_UNITS}){END}"
LABS = (LAB_NAMED, LAB_BARE)

# Tokens: the first alternative that fits wins, and anything else that is no white space is a token of one character.
_LETTER = r"A-Za-zÀ-ɏ"
TOKEN_CLASSES = (
    ("measurement", rf"{_I[:-1]}:{START}{NUM}{S}*(?:{MEASURE_UNITS}){E})"),
    ("measurement", rf"{_I[:-1]}:{START}{NUM}{S}*/{S}*(?:mm[³3]|dL|L|mL){END})"),
    ("measurement", rf"{_I[:-1]}:{START}{D}+x{D}+{S}*mmHg{END})"),
    ("number", rf"{START}{D}+[.,]{D}+{END}"),
    ("number", rf"{START}{D}+{END}"),
    ("word", rf"{START}[{_LETTER}][{_LETTER}'-]*{E}"),
    ("punctuation", rf"(?!{S})(?!{W})[\s\S]"),
    ("unknown", rf"(?!{S})[\s\S]"),
)

#: Where a sentence ends: white space after a full stop before a capital, a line break, a colon before a line break.
SENTENCE_BREAK = rf"(?<=[.!?]){S}+(?=[A-ZÀ-Ü])|(?<=\n){S}*(?=[^\t-\r\u001c- \u0085\p{{Z}}])|(?<=:){S}*\n"


def either(words: Iterable[str]) -> str:
    """A pattern of whole words in any case that branches letter by letter, so a place where no word starts costs one
    look at each first letter. The longest word that fits the boundary behind the pattern is taken."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w.lower():
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [_one(c) + written(rest) for c, rest in node.items() if c]
        if not ways:
            return ""
        if "" in node:
            return f"(?:{'|'.join(ways)})?"
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return written(tree)


def edges(words: Iterable[str]) -> tuple[str, str]:
    """What stands before and after whole words of any case."""
    words = list(words)
    plain = lambda c: c.isalnum() or c == "_"
    return _I + (START if all(plain(w[0]) for w in words if w) else E), END if all(plain(w[-1]) for w in words if w) else E


def _one(c: str) -> str:
    return c if c.isalnum() or c in "_ " else "\\" + c
