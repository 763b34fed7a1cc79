"""Sentence boundaries across languages and scripts.

Boundaries come from the Sentence_Break character property of Unicode Standard Annex 29 (terminators, closers,
case), so every script's own terminators work without a table of ours. On top of the standard rules lie
suppression of abbreviations of the text's own language, quotation and bracket regions inside which nothing ends, list
markers, line breaks and the Thai space. The scan is row-local: one pass over each text, no shuffle.

The language is the one that the text is marked with; where that is null, unknown or contradicted by the words or the
script of the text, the one whose function words or script it shows. Without any, what is an abbreviation in one of the
languages of Latin script counts, but no single letter.

Defined results: null, empty and blank texts give no sentence; spans exclude the white space around them; every
character other than white space lies in exactly one span; an opener without closer opens nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.sources.tables import once

SPANS = "array<struct<start_pos:bigint,end_pos:bigint>>"

# Abbreviations that never end a sentence, whatever follows on the line, by language.
ALWAYS = {
    "pt": "dr dra drs sr sra srta sres prof profa exmo exma hosp sta sto prot inst vol fam obs av tv r rod pça art "
    "depto enf eng ilmo cap cel gen núm cl temp p",
    "es": "dr dra sr sra srta prof profa ud uds hosp sta sto núm cl temp p",
    "en": "dr drs mr mrs ms prof st fig figs pt temp approx rev gen capt lt sgt",
    "de": "dr prof hr fr frl ca z d b u o med pat temp bzw evtl ggf inkl vgl nr st std",
    "ar": "د م أ",
    "hi": "डॉ श्री प्रो मि ली",
    "th": "นพ พญ ดร",
}
# Abbreviations that end nothing before a lower-case letter or a digit, but may end a sentence.
BEFORE_LOWER = {
    "pt": "abd aprox ex máx max mín min resp dir esq etc tel cel cont obs pág pag vs ref méd med mg ml comp amp cx",
    "es": "aprox ej máx max mín min etc tel pág vs ref izq der",
    "en": "no nos vs etc max min ref est a.m p.m e.g i.e cf al hr hrs wk",
    "de": "etc max min tel abs uhr std",
    "hi": "मि.ली",
    "th": "น",
}
# German words before an ordinal number ("am 12. Tag", "seit dem 3. Dezember").
ORDINAL_BEFORE = frozenset("am dem den der vom zum im des beim".split())

# Function words that tell the languages of one script apart.
FUNCTION_WORDS = {
    "pt": "da do das dos em com não sem para pela pelo ao à na no uma foi está paciente e o os um que por",
    "es": "el la los las del con sin una fue está por y al se un que lo su",
    "en": "the and of with was is to no on for patient has at by in her his she he were had as after new",
    "de": "der die das und mit ist wurde den dem kein keine nicht im bei eine ein er sie auf nach von",
}
# Words that stand before the initials of a name.
BEFORE_NAME = {
    "pt": "de da do das dos por pelo pela com a o e para ao à segundo", "es": "de del por con a el la y para al", "en": "by with to and from of for the", "de": "von und mit für bei der die den dem herr frau",
}

_ALWAYS = {lang: frozenset(words.split()) for lang, words in ALWAYS.items()}
_LOWER = {lang: frozenset(words.split()) for lang, words in BEFORE_LOWER.items()}
_NAMED = {lang: frozenset(words.split()) for lang, words in BEFORE_NAME.items()}
_FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
# abbreviations that one language alone writes speak for it
_OWN = {lang: frozenset(w for w in _ALWAYS[lang] | _LOWER[lang] if len(w) > 1 and not any(w in _ALWAYS[o] | _LOWER[o] | _FUNCTION[o] for o in _FUNCTION if o != lang)) for lang in _FUNCTION}
_ANYWHERE = frozenset().union(*_ALWAYS.values(), *_LOWER.values())
_SPEAKS = {w: tuple(lang for lang in _FUNCTION if w in _FUNCTION[lang]) for words in _FUNCTION.values() for w in words}
_SPEAKS_ALONE = {w: lang for lang, words in _OWN.items() for w in words}
# where nothing tells the language of a text in Latin letters: what is an abbreviation in any of them, but for single letters
for _table in (_ALWAYS, _LOWER, _NAMED):
    _table[None] = frozenset(w for lang in _NAMED for w in _table[lang] if len(w) > 1)
_NONE: frozenset[str] = frozenset()

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》",
          "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘", "‘": "’"}
_ALSO = {"„": "”“", "‚": "’‘", "“": "”"}
# closing marks of every script: Sentence_Break=Close among the closing and final punctuation
_CLOSERS = frozenset(regex.findall(r"(?V1)[\p{SB=Close}&&[\p{Pe}\p{Pf}]]", "".join(map(chr, range(0x20, 0xD800))) + "".join(map(chr, range(0xE000, 0x20000))))) | set(_PAIRS.values())
_CLOSES_ONLY = _CLOSERS - set(_PAIRS)

_EVENT = regex.compile(
    r"(?P<term>[\p{SB=STerm}\p{SB=ATerm}…]+)"
    r"|(?P<line>[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*)"
    r"|(?P<gap>(?<=\p{Thai})[^\S\n\r]+(?=\S)|(?<=[\p{N}\p{P}])[^\S\n\r]+(?=\p{Thai}))"
)
_PUNCT_PAIR = regex.compile(r"[\"()\[\]{}（）［］【】〔〕「」『』《》〈〉«»‹›“”„‚‘’]|\n[^\S\n]*\n")
_NEW_LINE = regex.compile(r"\n\s*")
_BLANK_LINE = regex.compile(r"\n[^\S\n]*\n")
# what ends at a position, read backwards
_WORD = regex.compile(r"(?r)[\p{L}\p{M}\p{N}º°ª.]+")
_WORD_AND_STOP = regex.compile(r"(\p{L}+)(\.?)")
_HYPHENED = regex.compile(r"(?r)[\p{L}\p{M}\p{N}-]+")
_TOKEN_AND_SPACE = regex.compile(r"(?r)(\S*)\s*")
_DOTTED = regex.compile(r"\p{L}{1,2}(?:\.\p{L}{1,3})+$")
_OTHER_SCRIPT = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Thai}]")
_LINE_END = regex.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]")
_LINE_ENDS = frozenset("\n\r\x0b\x0c\x85\u2028\u2029")
_CAPITAL = regex.compile(r"[\p{Lu}\p{Lt}]")
_SMALL = regex.compile(r"\p{Ll}")
_DIGIT = regex.compile(r"\p{Nd}")
_LETTER = regex.compile(r"\p{L}")
# what goes on with a sentence: Sentence_Break=SContinue, and signs behind a number
_GOES_ON = frozenset(regex.findall(r"\p{SB=SContinue}", "".join(map(chr, range(0x20, 0xD800))) + "".join(map(chr, range(0xE000, 0x10000))))) | set(";；%/")
_LATIN, _ARABIC, _DEVANAGARI, _THAI = (regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Arabic", "Devanagari", "Thai"))
# What can stand right before a boundary inside a line.
BEFORE_END = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…\"" + regex.escape("".join(sorted(_CLOSERS))) + "]")


def _regions(text: str) -> list[tuple[int, int]]:
    """(opener, closer) positions of the outermost quotations and brackets; what has no partner is ordinary text."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    n = len(text)
    for m in _PUNCT_PAIR.finditer(text):
        c, at = m[0], m.start()
        if c[0] == "\n":  # a blank line: what is still open stays without partner
            stack.clear()
            continue
        top = next((i for i in range(len(stack) - 1, -1, -1) if _closes(stack[i][0], c)), None)
        if c == '"':
            before = text[at - 1] if at else " "
            opening = before.isspace() or before in "([{（「“«:：—-"
            if top is not None and not (opening and at + 1 < n and not text[at + 1].isspace() and before.isspace()):
                found.append((stack[top][1], at))
                del stack[top:]
            elif opening and at + 1 < n and not text[at + 1].isspace():
                stack.append((c, at))
            elif top is not None:
                found.append((stack[top][1], at))
                del stack[top:]
            continue
        if c == "’" and 0 < at < n - 1 and text[at - 1].isalpha() and text[at + 1].isalpha():
            continue  # an apostrophe
        if top is not None:
            found.append((stack[top][1], at))
            del stack[top:]
        elif c in _PAIRS:
            stack.append((c, at))
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _closes(opener: str, c: str) -> bool:
    return c == '"' if opener == '"' else c in _ALSO.get(opener, _PAIRS.get(opener, ""))


def _evidence(text: str) -> str | dict[str, int] | None:
    """The language that the script of a text shows, else how much its words speak for each of Latin script; None for a
    text without letters."""
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        counts = {name: len(of.findall(text)) for name, of in (("ar", _ARABIC), ("hi", _DEVANAGARI), ("th", _THAI), ("", _LATIN))}
        main = max(counts, key=lambda name: counts[name])
        if main:
            return main
    hits = dict.fromkeys(_FUNCTION, 0)
    words = _WORD_AND_STOP.findall(text.lower())
    for w, stop in words:
        for name in _SPEAKS.get(w, ()):
            hits[name] += 1
        if stop and w in _SPEAKS_ALONE:
            hits[_SPEAKS_ALONE[w]] += 2
    return hits if words else None


def _settled(evidence: str | dict[str, int] | None, marked: str | None) -> str | None:
    if isinstance(evidence, str):
        return evidence
    if evidence is None:
        return marked if marked in _ALWAYS else None
    best = max(evidence, key=lambda name: (evidence[name], name == marked))
    if marked in evidence and evidence[best] <= evidence[marked]:
        return marked
    return best if evidence[best] else marked if marked in evidence else None


def language_of(text: str, lang: str | None) -> str | None:
    """The language whose abbreviations count: the marked one, unless the script or the words of the text speak against it."""
    return _settled(_evidence(text), lang)


def by_line(text: str, lang: str | None) -> Callable[[int], str | None]:
    """The language at a position: that of its line, as a note may hold lines in several, and where a line does not tell,
    that of the text; each is asked only where it matters."""
    whole: list[str | None] = []
    known: dict[int, str | None] = {}
    starts = [0, *(m.end() for m in _LINE_END.finditer(text))]

    def of_line(line: int) -> str | None:
        evidence = _evidence(text[starts[line] : starts[line + 1] if line + 1 < len(starts) else len(text)])
        if isinstance(evidence, dict):
            first, second, *_ = sorted(evidence.values(), reverse=True)
            if first > second:
                return max(evidence, key=lambda name: evidence[name])
        if not whole:
            whole.append(language_of(text, lang))
        return _settled(evidence, whole[0])

    def at(position: int) -> str | None:
        line = bisect_right(starts, position) - 1
        if line not in known:
            known[line] = of_line(line)
        return known[line]

    return at


def sentence_spans(text: str | None, lang: str | None = None, truncations: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Half-open code point spans of the sentences of ``text``.

    ``truncations``: lower-case beginnings of shortened domain words ("torac." for a longer word), which end nothing
    before lower case. ``lang``: what the text is marked with.
    """
    if not text or text.isspace():
        return []
    spans = []
    start = 0
    for cut in (*_cuts(text, _regions(text), 0, len(text), by_line(text, lang), truncations), len(text)):
        s, e = start, cut
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            spans.append((s, e))
        start = cut
    return spans


class SentenceEnds:
    """Whether a sentence ends at a position of ``text``, read only in the paragraph around it.

    Quotations and brackets never reach over a blank line, so the answers are the boundaries of ``sentence_spans``.
    ``also``: further abbreviations that end nothing, whatever follows.
    """

    def __init__(self, text: str, lang: str | None = None, also: frozenset[str] = frozenset()) -> None:
        self.text, self.lang, self.also = text, lang, also
        blanks = [m.span() for m in _BLANK_LINE.finditer(text)]
        self.begins, self.stops = [0, *(e for _, e in blanks)], [*(s for s, _ in blanks), len(text)]
        self.regions: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
        self.known: dict[int, frozenset[int]] = {}

    def _paragraph(self, k: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Its regions, and the starts of its lines that surely begin a sentence."""
        begin, stop = self.begins[k], self.stops[k]
        regions = [(begin + o, begin + c) for o, c in _regions(self.text[begin:stop])]
        starts, r = [begin], 0
        for m in _NEW_LINE.finditer(self.text, begin, stop):
            while r < len(regions) and regions[r][1] < m.start():
                r += 1
            if not (r < len(regions) and regions[r][0] < m.start()) and m.end() < stop and not _SMALL.match(self.text, m.end()):
                starts.append(m.end())
        return regions, starts

    def __call__(self, at: int) -> bool:
        k = bisect_left(self.begins, at) - 1
        if k not in self.regions:
            self.regions[k] = self._paragraph(k)
        regions, starts = self.regions[k]
        i = bisect_left(starts, at) - 1
        begin = starts[i]
        if begin not in self.known:
            stop = starts[i + 1] if i + 1 < len(starts) else self.stops[k]
            self.known[begin] = frozenset(_cuts(self.text, regions[bisect_left(regions, (begin, 0)) :], begin, stop, lambda _: self.lang, also=self.also))
        return at in self.known[begin]


def _cuts(
    text: str, regions: list[tuple[int, int]], since: int, stop: int, lang_at: Callable[[int], str | None],
    truncations: frozenset[str] = frozenset(), also: frozenset[str] = frozenset(),
) -> list[int]:
    """Positions in [since, stop] at which sentences end."""
    n = len(text)
    cuts: list[int] = []
    r = 0
    for m in _EVENT.finditer(text, since):
        at = m.start()
        if at >= stop:
            break
        while r < len(regions) and regions[r][1] < at:
            r += 1
        if m["term"] is None:
            if r < len(regions) and regions[r][0] < at:
                continue
            end = m.end()
            if m["line"] is not None:
                if end < n and _SMALL.match(text, end):
                    continue
            cuts.append(at)
            since = end
            continue
        end = m.end()
        quoted = False
        k = r
        while end < n:  # closing marks belong to the sentence they close
            c = text[end]
            if k < len(regions) and regions[k][1] == end:
                quoted = quoted or regions[k][0] < at
                k += 1
            elif not (c in _CLOSES_ONLY):
                break
            elif k < len(regions) and regions[k][0] < end < regions[k][1]:
                pass  # the closer of an inner pair
            end += 1
        if k < len(regions) and regions[k][0] < end <= regions[k][1]:
            continue
        if _ends(text, m["term"], at, end, since, quoted, lang_at, truncations, also):
            cuts.append(end)
            since = end
    return cuts


def _back(text: str, since: int, at: int, of: regex.Pattern) -> int:
    """Where the run of characters of ``of`` begins that ends at ``at``."""
    m = of.match(text, since, at)
    return m.start() if m else at


def _token_before(text: str, since: int, at: int) -> str:
    """The token between white space before ``at``, without the space in between."""
    return _TOKEN_AND_SPACE.match(text, since, at)[1]


def _ends(text: str, term: str, at: int, end: int, since: int, quoted: bool, lang_at: Callable[[int], str | None], truncations: frozenset[str], also: frozenset[str]) -> bool:
    n = len(text)
    nxt = end
    while nxt < n and text[nxt].isspace():
        nxt += 1
    if nxt >= n:
        return True
    c = text[nxt]
    gap = nxt > end
    if c in _GOES_ON and not (c in "-–—" and "\n" in text[end:nxt]):
        return False
    capital, small, digit = bool(_CAPITAL.match(c)), bool(_SMALL.match(c)), bool(_DIGIT.match(c))
    if quoted:
        return capital or c in "¿¡"
    dots = term.strip(".．…﹒") == ""
    if not dots:
        return c not in _CLOSES_ONLY
    if len(term) > 1 or "…" in term:
        return gap and not small or capital
    begin = _back(text, since, at, _WORD)
    word = text[begin:at]
    low = word.lower()
    # most words are an abbreviation in no language, so the language is not asked for
    lang = lang_at(at) if low in _ANYWHERE or len(word) < 3 else None
    always, lower = _ALWAYS.get(lang, _NONE), _LOWER.get(lang, _NONE)
    if not gap:
        return (
            capital and nxt + 1 < n and bool(_SMALL.match(text, nxt + 1)) and len(word) > 1 and "." not in word
            and low not in always and low not in also and low not in lower and "@" not in _token_before(text, since, at)
        )
    if low in always or low in also:
        return False
    if small and begin and text[begin - 1] == "-" and text[_back(text, since, at, _HYPHENED) : at].lower() in truncations:
        return False
    if low == "h" and small and lang == "de" and text[begin - 3 : begin] in ("d. ", " d.", "\nd."):  # "d. h."
        return False
    if small or digit:
        if low in lower or low in truncations and small or _DOTTED.match(word):
            return False
    if word.isupper() and low in truncations and _LETTER.match(c):
        return False
    if word.isdigit():
        line = begin
        while line > 0 and text[line - 1].isspace() and text[line - 1] not in _LINE_ENDS:
            line -= 1
        if len(word) <= 3 and (line == 0 or text[line - 1] in _LINE_ENDS):  # the number of a list line
            return False
        return not (lang == "de" and len(word) <= 2 and _token_before(text, since, begin).lower() in ORDINAL_BEFORE and _LETTER.match(c))
    if len(word) == 1 and capital and _CAPITAL.match(word):
        return not _initial(text, since, begin, lang)
    if len(word) > 1 and "." in word and word[-2] == "." and _CAPITAL.match(word[-1]) and capital:
        return word[0].islower()  # "M.D. Silva"
    if len(word) == 1 and _CAPITAL.match(word) and small:
        return False
    if low in lower and not (capital or small or digit) and _LETTER.match(c):
        return False
    return True


def _initial(text: str, since: int, begin: int, lang: str | None) -> bool:
    """Whether a capital with a full stop is the initial of a name: nothing, a name, another initial, a title or a word
    that names are introduced by stands before it. Behind another word ("vitamina D.") or a number it ends a sentence."""
    before = _token_before(text, since, begin)
    bare = before.strip("\"'“”«»([")
    if not bare:
        return True
    if before.endswith("."):
        return True
    if bare[-1] == "°" or _DIGIT.match(bare[-1]):
        return False
    return bool(_CAPITAL.match(bare)) or bare.lower() in _NAMED.get(lang, _NONE)


def sentences(notes: DataFrame, key: str = "note_id", text: str = "text", lang: str | None = None, truncations: Iterable[str] = ()) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos, sentence) of every sentence; other columns of ``notes`` are not read."""
    known = frozenset(truncations)

    @F.pandas_udf(SPANS)
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in batches:
            yield pd.Series([[{"start_pos": s, "end_pos": e} for s, e in sentence_spans(t, g, known)] for t, g in zip(texts, langs, strict=True)])

    of: Column = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    full = notes.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"), of.alias("__lang"))
    spans = full.withColumn("__spans", split("__text", "__lang"))
    # the outer form: from the plain one the optimizer infers a filter on the array, for which it runs the scan twice
    return spans.select(key, "__text", F.posexplode_outer("__spans").alias("sentence_no", "__s")).where("sentence_no is not null").select(
        key, F.col("sentence_no").cast("bigint").alias("sentence_no"), F.col("__s.start_pos").alias("start_pos"), F.col("__s.end_pos").alias("end_pos"),
        F.substring(F.col("__text"), (F.col("__s.start_pos") + 1).cast("int"), (F.col("__s.end_pos") - F.col("__s.start_pos")).cast("int")).alias("sentence"),
    )


def word_stems(terms: Iterable[str], least: int = 5) -> frozenset[str]:
    """What the words of ``terms`` can be shortened to: their beginnings of ``least`` letters or more that are no word of the
    terms themselves."""
    words = {w for t in terms for w in t.lower().split()}
    return frozenset(w[:k] for w in words for k in range(least, len(w))) - words


def notes_of(texts: DataFrame, note_name: str) -> DataFrame:
    """(note_id, text, lang) of the notes of one kind, each once; the filter reaches the scan."""
    kind = texts.where((F.col("note_name") == note_name) & F.col("text").isNotNull())
    return once(kind, "note_id", "received_at", "text", "lang")
