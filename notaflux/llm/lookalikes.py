"""One consistent form for texts that look the same.

Two steps. ``plain_form`` is row-local: invisible characters go, every kind of space becomes U+0020, full-width and
ligature forms become the ordinary letters, accents are composed, hyphens become one. Look-alike letters follow by
script-aware repair, token by token: in a token of mixed scripts the letters of each script are counted, and the token is
read in the dominant one (Latin, Cyrillic, Greek or Armenian alike) by putting twins in the place of the others. The
reading counts only if it is in the vocabulary of the corpus; if it is not, the next script of the token is tried.

Letters of one foreign script only make no mixed token. Such a token is read in the dominant script of its text if every
letter has a twin there, the reading is in the vocabulary, and no text that its own script dominates writes the token:
a short word may be made of look-alikes alone, while a word of that language stays.

The vocabulary is the words of the notes and of any further texts that are given. Accents, case,
punctuation, digits and raised signs stay.

Defined results: a null text stays null, a blank one becomes empty; repeated rows of one id count once; a token
that no vocabulary word explains stays as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.cluster import cut
from notaflux.llm.pairs import halves

# Letters of other scripts, or rare Latin ones, and the Latin letters that they cannot be told from.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ӏ": "I",
    # Greek, small
    "ϲ": "c", "ο": "o", "ν": "v", "ϳ": "j", "ρ": "p", "υ": "u", "ι": "i",
    # Greek, capital
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin letters of phonetic writing
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "Y", "ꜱ": "s", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
# Hyphens of one look.
HYPHENS = "‐‑﹣˗"

_JOINED = r"\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}"
# what nobody sees, but for the joiners that shape the letters of some scripts
_INVISIBLE = regex.compile(rf"((?<=[{_JOINED}])[\u200c\u200d](?=[{_JOINED}]))|[\p{{Default_Ignorable_Code_Point}}\p{{Cf}}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
_SPACE = regex.compile(r"\p{Zs}|\t")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_FORMS = regex.compile(r"[！-￮ﬀ-ﬆĲĳǄ-ǌǱ-ǳ]")
_FOREIGN = regex.compile("[" + "".join(LOOK_ALIKES) + "]")
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
_OF_SCRIPT = {name: regex.compile(rf"\p{{Script={name}}}") for name in _SCRIPTS}
_OTHER_LETTER = regex.compile("(?V1)[\\p{L}--[" + "".join(rf"\p{{Script={name}}}" for name in _SCRIPTS) + "]]")


def _script(c: str) -> str:
    return next(name for name in _SCRIPTS if _OF_SCRIPT[name].match(c))


def _twins() -> dict[str, dict[int, str]]:
    """For each script, what its letters are written for: the twins in every other script, through the Latin one."""
    looks: dict[str, set[str]] = {}
    for other, latin in LOOK_ALIKES.items():
        looks.setdefault(latin, {latin}).add(other)
    out: dict[str, dict[int, str]] = {name: {} for name in _SCRIPTS}
    for group in looks.values():
        for name in _SCRIPTS:
            own = sorted((c for c in group if _script(c) == name), key=lambda c: (c in LOOK_ALIKES, c))
            # of two twins in one script the commoner letter stands first in its block
            for c in group - set(own[:1]) if own else ():
                if name == "Latin" or _script(c) != name:
                    out[name][ord(c)] = own[0]
    return out


_TWINS = _twins()
_NOT_LATIN = regex.compile(r"(?V1)[\p{L}--\p{Script=Latin}]")
_ANY_LETTER = regex.compile(r"\p{L}")
_TWINNED = regex.compile("[" + "".join(chr(c) for of in _TWINS.values() for c in of) + "]")
_MAP = str.maketrans({**dict.fromkeys(HYPHENS, "-"), "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å"})


def plain_form(text: str | None) -> str | None:
    """Everything that can be decided without the corpus."""
    if text is None:
        return None
    if not text.isascii():
        text = _INVISIBLE.sub(lambda m: m[1] or "", text)
        text = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        text = unicodedata.normalize("NFC", text.translate(_MAP))
    else:
        text = _INVISIBLE.sub("", text)
    return _SPACE.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def readings(token: str, within: str | None = None) -> list[str]:
    """Readings of a token in one script, the dominant script first, the script ``within`` of its text last; only those
    that hold no other script. A token of one script has no reading but the one in the script of its text."""
    apart = unicodedata.normalize("NFD", token)
    odd = _NOT_LATIN.search(apart) is not None
    if odd and _OTHER_LETTER.search(apart) or not odd and not _FOREIGN.search(apart):
        return []
    counts = {name: len(_OF_SCRIPT[name].findall(apart)) for name in _SCRIPTS}
    present = sorted((name for name in _SCRIPTS if counts[name]), key=lambda name: (-counts[name], _SCRIPTS.index(name)))
    odd_latin = present == ["Latin"] and any(c in LOOK_ALIKES for c in apart)  # rare letters of the script itself
    if len(present) < 2 and not odd_latin:
        present = []
    if within and within not in present and any(counts.values()):
        present.append(within)
    out = []
    for name in present:
        read = apart.translate(_TWINS[name])
        if read != apart and all(_OF_SCRIPT[name].match(c) for c in read if c.isalpha()):
            out.append(unicodedata.normalize("NFC", read))
    return out


def dominant(text: str) -> str | None:
    """The script of most letters of a text, counted among letters without a twin in another script if there are any, as a
    text may hold more look-alikes than letters of its own; None if most letters have no twins at all."""
    if text.isascii() or not _NOT_LATIN.search(text):
        return "Latin" if _ANY_LETTER.search(text) else None
    sure = _TWINNED.sub("", text)
    counts = {name: len(of.findall(sure)) for name, of in _OF_SCRIPT.items()}
    if not any(counts.values()):
        counts = {name: len(of.findall(text)) for name, of in _OF_SCRIPT.items()}
    most = max(counts, key=lambda name: counts[name])
    return most if counts[most] and counts[most] >= len(_OTHER_LETTER.findall(text)) else None


def suspects(text: str | None, main: str | None = None) -> list[tuple[str, list[str], bool]]:
    """(token, readings, mixed) of the tokens of a text that can be read in another way, each once; tokens of rare letters
    of the text's own script count as mixed. ``main``: the dominant script of the text, if it is known."""
    if not text or text.isascii() or not _FOREIGN.search(text) and not _FOREIGN.search(unicodedata.normalize("NFD", text)):
        return []
    main = main or dominant(text)
    found = {}
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in found or token.isascii():
            continue
        read = readings(token, main)
        if read:
            scripts = {name for name in _SCRIPTS if _OF_SCRIPT[name].search(token)}
            found[token] = (read, len(scripts) > 1 or scripts == {main})
    return [(token, *of) for token, of in found.items()]


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        plain = [plain_form(t) for t in texts]
        main = [dominant(p) if p else None for p in plain]
        yield pd.DataFrame({"plain": plain, "main": main, "suspects": [[{"raw": a, "mixed": mixed, "readings": read} for a, read, mixed in suspects(p, m)] for p, m in zip(plain, main, strict=True)]})


def _mend(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, repairs in batches:
        out = []
        for text, known in zip(texts, repairs, strict=True):
            if text is not None and known is not None and len(known):
                swap = {k["raw"]: k["fixed"] for k in known}
                text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: swap.get(m[0], m[0]), text))
            out.append(text)
        yield pd.Series(out, dtype=object)


def _script_of(word: Column) -> Column:
    """The script of a word of one script."""
    names = [F.when(word.rlike(rf"\p{{Is{name}}}"), name) for name in _SCRIPTS]
    return F.coalesce(*names)


_SPLIT = r"[^\p{L}\p{M}]+"


def canonical(notes: DataFrame, key: str = "note_id", text: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(key, canonical, raw_md5, repairs) of every note, one row per row of ``notes`` (ids must be distinct).

    ``corpus``: further texts (``text``) whose words are vocabulary. Only tokens that can be read in another way meet the
    vocabulary, so the join is of the rare with the distinct words; the words are combined before they are shuffled.
    Texts move once, and only those of notes with repairs are joined.
    """
    reading = F.pandas_udf(_read, "struct<plain:string,main:string,suspects:array<struct<raw:string,mixed:boolean,readings:array<string>>>>")
    mending = F.pandas_udf(_mend, "string")
    read = cut(notes.select(F.col(f"`{key}`").alias("__key"), F.md5(F.col(f"`{text}`")).alias("raw_md5"), reading(F.col(f"`{text}`")).alias("__r"))
               .select("__key", "raw_md5", F.col("__r.plain").alias("plain"), F.col("__r.main").alias("main"), F.col("__r.suspects").alias("suspects")))
    odd = read.where(F.size("suspects") > 0).select("__key", "main", F.explode("suspects").alias("s")).select("__key", "main", "s.raw", "s.mixed", F.posexplode("s.readings").alias("rank", "fixed"))
    # a text vouches for words of the script that dominates it; the further texts for words of the Latin one
    words = read.where(F.col("main").isNotNull()).select(F.col("main").alias("script"), F.explode(F.split("plain", _SPLIT)).alias("word"))
    if corpus is not None:
        words = words.unionByName(corpus.where(F.col("text").isNotNull()).select(F.lit("Latin").alias("script"), F.explode(F.split("text", _SPLIT)).alias("word")))
    wanted = odd.select(F.col("fixed").alias("word")).unionByName(odd.where("not mixed").select(F.col("raw").alias("word"))).distinct().withColumn("script", _script_of(F.col("word")))
    vocabulary = wanted.join(words.distinct(), ["script", "word"], "left_semi").select("word")
    # words of one foreign script that a text of that script writes are words of its language
    native = vocabulary.select(F.col("word").alias("raw"), F.lit(True).alias("native"))
    chosen = odd.join(vocabulary.withColumnRenamed("word", "fixed"), "fixed").join(native, "raw", "left").where(F.col("mixed") | F.col("native").isNull())
    best = chosen.groupBy("__key", "raw").agg(F.min(F.struct("rank", "fixed")).alias("b")).select("__key", "raw", F.col("b.fixed").alias("fixed"))
    repairs = best.groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("raw", "fixed"))).alias("repairs"))
    clean = read.where(F.size("suspects") == 0).select("__key", "plain", "raw_md5", F.lit(0).alias("repairs"))
    mended = read.where(F.size("suspects") > 0).join(repairs, "__key", "left").select(
        "__key", mending("plain", "repairs").alias("plain"), "raw_md5", F.coalesce(F.size("repairs"), F.lit(0)).alias("repairs"))
    return clean.unionByName(mended).select(F.col("__key").alias(key), F.col("plain").alias("canonical"), "raw_md5", "repairs")


def _members(forms: DataFrame, key: str) -> DataFrame:
    """(id, form, raw_md5) of the notes whose form is written in several ways: ids and digests, written once."""
    thin = cut(forms.where(F.length("canonical") > 0).select(F.col(f"`{key}`").alias("id"), F.md5("canonical").alias("form"), "raw_md5"))
    several = thin.groupBy("form").agg(F.min("raw_md5").alias("low"), F.max("raw_md5").alias("high")).where("low <> high").select("form")
    return thin.join(several, "form", "left_semi")


def look_same(forms: DataFrame, key: str = "note_id", block: int = 512) -> DataFrame:
    """(key_a, key_b; a < b) of notes with one canonical form and different characters.

    A form with one variant has no pair and is left before any join, so copies of one text never meet. A form of more than
    ``block`` notes is dealt out in blocks. ``classes`` says the same in one row a note.
    """
    a, b = (side.select("form", "low", "high", F.col("id").alias(n), F.col("raw_md5").alias(f"m{n}")) for n, side in zip("ab", halves(_members(forms, key), ["form"], "id", block), strict=True))
    met = a.join(b, ["form", "low", "high"]).where((F.col("ma") != F.col("mb")) & ((F.col("a") < F.col("b")) | (F.col("low") < F.col("high"))))
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))


def classes(forms: DataFrame, key: str = "note_id") -> DataFrame:
    """(key, class_id, variant, notes, variants, links) of every note that looks like another of different characters.

    ``class_id``: the least id of the class; ``variant``: the least id with the same characters; ``links``: how many
    notes of the class are written differently. A row a note, so large classes cost no pairs.
    """
    members = _members(forms, key)
    variants = members.groupBy("form", "raw_md5").agg(F.min("id").alias("variant"), F.count(F.lit(1)).alias("alike"))
    whole = variants.groupBy("form").agg(F.min("variant").alias("class_id"), F.sum("alike").alias("notes"), F.count(F.lit(1)).alias("variants"))
    return members.join(variants, ["form", "raw_md5"]).join(whole, "form").select(
        F.col("id").alias(key), "class_id", "variant", "notes", "variants", (F.col("notes") - F.col("alike")).alias("links"))
