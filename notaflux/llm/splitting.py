"""Items over a size limit, cut at natural boundaries into pieces that overlap.

Lexical cohesion decides where: at every natural boundary (the end of a sentence by the rules of ``sentences``, with the
abbreviations of court decisions by language, or of a line) the words of the block before
and of the block after are compared. The depth of a boundary is how far the similarity climbs from it to the next peak on
its left plus to the next on its right, and the deepest valley within the window that the limit leaves is the cut. Without a natural boundary in the window the last gap between words is taken, without any gap the last character.
Each piece but the first then repeats up to ``overlap`` tokens of the one before, from a gap between words.

Block similarities are exact cosines of token counts. Equal tokens near each other are paired once over a batch of
documents; the boundaries between or after the two form an interval, so running sums of interval ends give every block's
product and norms. Cuts lie between pre-tokens (or, as a last resort, between whole characters), so the
tokens of a piece are those of the text and no piece has to be encoded again.

Defined results: null, empty and short texts (at most ``limit`` tokens) give no row; pieces without their overlaps
concatenate to the text; repeated rows are cut as often as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.llm.encoding import DEFAULT_TOKENIZER, TOKENIZER_DIR, encode_arrays, few_rows, token_bytes
from notaflux.llm.sentences import BEFORE_END, SentenceEnds

_CUT = "key bigint, piece_no int, pieces int, start_pos bigint, own_pos bigint, end_pos bigint, n_tokens int, n_overlap int, tokens int, cut_at string"

# Abbreviations of court decisions that never end a sentence, by language.
COURT = {
    "pt": "fls fl des rel n art arts inc j p pp proc min cf par ex",
    "es": "núm núms art arts rec doc docs s ss sr p pp fol fs cf inc",
    "en": "para paras no nos v p pp cf ex art arts mr mrs ms",
    "de": "az abs art bl rn nr verb vgl m w z b d i v u s ff gem",
}
_COURT = {lang: frozenset(words.split()) for lang, words in COURT.items()}
_COURT_ALL = frozenset().union(*_COURT.values())


@cache
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """By code point: can stand before the end of a sentence, is Thai (where a space ends one)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    before, thai = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    before[[ord(c) for c in BEFORE_END.findall(every)]] = True
    thai[0x0E00:0x0E80] = True
    return before, thai


@cache
def _traits(directory: str, name: str) -> tuple[np.ndarray, ...]:
    """By token id: bytes, characters begun, starts with space, can start a character, holds a line break, counts in blocks."""
    raw = token_bytes(directory, name)
    size = np.array([len(t) for t in raw], np.int32)
    begun = np.array([sum((b & 0xC0) != 0x80 for b in t) for t in raw], np.int32)
    spaced = np.array([t[:1] in (b" ", b"\n", b"\t", b"\r") for t in raw])
    whole = np.array([bool(t) and (t[0] & 0xC0) != 0x80 for t in raw])
    line = np.array([b"\n" in t for t in raw])
    # signs, digits and the shortest words say nothing about the topic
    wordy = np.array([len(t.strip()) > 3 and t.strip().isalpha() or any(b > 127 for b in t) for t in raw])
    return size, begun, spaced, whole, line, wordy


def valleys(ids: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, counted: np.ndarray, block: int) -> np.ndarray:
    """Cosine of the token counts of the blocks before and after each position ``at``, within the text [first, last).

    ``counted``: by token id, nonzero (in a matrix: anywhere in the row) where the token counts.
    """
    reach = 2 * block
    starts = np.unique(np.concatenate([first, last, [0]]))
    # texts are set apart by ``reach`` empty places, so no block and no pair holds tokens of two
    apart = np.cumsum(np.bincount(starts, minlength=len(ids) + 1)) * reach
    size = int(len(ids) + apart[-1] + reach)
    counts = np.nonzero(counted.reshape(len(counted), -1).any(1)[ids])[0]
    order = np.sort(ids[counts].astype(np.int64) << 40 | counts + apart[counts])
    place = order & (1 << 40) - 1
    # +1 where the interval of boundaries begins for which a pair counts, -1 after its end
    product, norm = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    norm += np.bincount(place + 1, minlength=size + 1) - np.bincount(place + block + 1, minlength=size + 1)
    near, lag = np.arange(len(order)), 1
    while len(near := near[near < len(order) - lag]) and len(near := near[order[near + lag] - order[near] < reach]):
        i, j = place[near], place[near + lag]
        np.add.at(product, np.maximum(i + 1, j - block + 1), 1)
        np.add.at(product, np.minimum(j, i + block) + 1, -1)
        within = j - i < block
        i, j = i[within], j[within]
        np.add.at(norm, j + 1, 2)
        np.add.at(norm, i + block + 1, -2)
        lag += 1
    product, norm = np.cumsum(product), np.cumsum(norm)
    # a boundary at the end of a text belongs to that text, not to the next
    here = at + apart[np.maximum(at - 1, first)]
    scale = np.sqrt(norm[here].astype(float) * norm[here + block])
    return np.where(scale > 0, product[here] / np.maximum(scale, 1e-9), 0.0)


def depths(similarity: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Depth of each boundary: the climb to the peak on its left plus the climb to the peak on its right.

    ``first``: where the boundaries of each text begin; a climb ends at the ends of its text. Boundaries of equal
    similarity are one slope.
    """
    if not len(similarity):
        return similarity.astype(float)
    place = np.arange(len(similarity))

    def peak(s: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The value at the top of the slope that comes down to each place from the left."""
        top = begins | np.concatenate([[True], s[:-1] < s[1:]])
        return s[np.maximum.accumulate(np.where(top, place, 0))]

    begins, ends = np.zeros(len(similarity), bool), np.zeros(len(similarity), bool)
    begins[first[first < len(similarity)]] = True
    ends[:-1], ends[-1] = begins[1:], True
    return peak(similarity, begins) + peak(similarity[::-1], ends[::-1])[::-1] - 2 * similarity


def cuts_of(
    n: int, natural: np.ndarray, similarity: np.ndarray, depth: np.ndarray, gaps: np.ndarray, whole: np.ndarray, limit: int, overlap: int, slack: float,
    ends: Callable[[int], bool] = lambda _: True,
) -> list[tuple[int, int, str]]:
    """(overlap start, own start, kind of cut before) of each piece of a text of ``n`` tokens; positions are tokens of it.

    ``natural``, ``gaps``: sorted positions of natural boundaries and of gaps between words; ``whole``: mask of positions
    at which a character begins. ``ends``: whether a natural boundary is one, asked from the deepest valley on; of equal
    depths the lower similarity, then the first.
    """

    def deepest(i: int, j: int) -> int | None:
        return next((int(natural[i + k]) for k in np.lexsort((similarity[i:j], -depth[i:j])) if ends(int(natural[i + k]))), None)

    pieces = [(0, 0, "start")]
    own = begin = 0
    while n - begin > limit:
        far = begin + limit
        near = own + max(1, int((far - own) * slack))
        i, j = np.searchsorted(natural, near), np.searchsorted(natural, far, "right")
        found = deepest(i, j)
        if found is None:
            found = deepest(np.searchsorted(natural, own, "right"), i)
        if found is not None:
            to, kind = found, "natural"
        else:
            g = int(np.searchsorted(gaps, far, "right")) - 1
            if g >= 0 and gaps[g] > own:
                to, kind = int(gaps[g]), "gap"
            else:
                to, kind = far, "hard"
                while to > own + 1 and not whole[to]:
                    to -= 1
        g = int(np.searchsorted(gaps, to - overlap))
        begin = int(gaps[g]) if g < len(gaps) and gaps[g] < to else to
        if begin == to and kind == "hard":
            begin = max(own + 1, to - overlap)
            while begin < to and not whole[begin]:
                begin += 1
        begin = max(begin, own + 1) if begin <= own else begin
        own = to
        pieces.append((begin, to, kind))
    return pieces


def _shape(with_piece: bool) -> str:
    return _CUT + ", piece string" * with_piece


def cutter(limit: int, overlap: int, block: int, slack: float, with_piece: bool, directory: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What cuts batches of (key, text, language); the parameters are those of ``split_texts``."""
    shape = _shape(with_piece)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, begun, spaced, whole, line, wordy = _traits(directory, name)
        may_end, thai = _signs()
        for b in few_rows(batches):
            keys, whole_texts, langs = (b.column(c).to_pylist() for c in range(3))
            found = encode_arrays(whole_texts, directory, name)
            long = [i for i, ids in enumerate(found) if len(ids) > limit]
            rows: list[tuple] = []
            if long:
                lengths = np.array([len(found[i]) for i in long])
                ids = np.concatenate([found[i] for i in long])
                starts = np.concatenate([[0], np.cumsum(lengths)])
                chars = np.concatenate([[0], np.cumsum(begun[ids])])
                is_gap = spaced[ids]
                before = np.concatenate([[0], ids[:-1]])
                # a line break inside the token before, or a place where a sentence can end
                points = np.frombuffer(("".join(whole_texts[i] for i in long) + "  ").encode("utf-32-le"), np.uint32)
                last, after = points[chars[:-1] - 1], points[chars[:-1] + 1]
                is_line = line[before] & whole[ids] & ~line[ids]
                is_natural = is_line | whole[ids] & may_end[last] | is_gap & (thai[last] | thai[after])
                is_natural[starts[:-1]] = is_gap[starts[:-1]] = False
                natural, gaps = np.nonzero(is_natural)[0], np.nonzero(is_gap)[0]
                doc = np.searchsorted(starts, natural, "right") - 1
                similarity = valleys(ids, natural, starts[doc], starts[doc + 1], wordy, block)
                a, g = np.searchsorted(natural, starts), np.searchsorted(gaps, starts)
                depth = depths(similarity, a[:-1])
                can = whole[ids]
                for d, i in enumerate(long):
                    s, e = int(starts[d]), int(starts[d + 1])
                    ends = SentenceEnds(whole_texts[i], langs[i], _COURT.get(langs[i], _COURT_ALL))
                    at = chars[s:e] - chars[s]
                    of_line = is_line[s:e]
                    pieces = cuts_of(e - s, natural[a[d] : a[d + 1]] - s, similarity[a[d] : a[d + 1]], depth[a[d] : a[d + 1]], gaps[g[d] : g[d + 1]] - s, can[s:e], limit, overlap, slack, lambda k, at=at, of_line=of_line, ends=ends: bool(of_line[k]) or ends(int(at[k])))
                    for p, (begin, own, kind) in enumerate(pieces):
                        end = pieces[p + 1][1] if p + 1 < len(pieces) else e - s
                        pos = [int(chars[s + x] - chars[s]) for x in (begin, own, end)]
                        rows.append((keys[i], p, len(pieces), *pos, end - begin, own - begin, e - s, kind, *[whole_texts[i][pos[0] : pos[2]]] * with_piece))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (10 + with_piece)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()] + [pa.string()] * with_piece
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in shape.split(", ")])

    return work


def split_texts(
    texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, block: int = 96, slack: float = 0.5,
    with_piece: bool = False, lang: str | None = None, directory: str = TOKENIZER_DIR, name: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """One row per piece of the texts of more than ``limit`` tokens: (key, piece_no, pieces, start_pos, own_pos, end_pos,
    n_tokens, n_overlap, tokens, cut_at). Positions are code points; [start_pos, own_pos) repeats the piece before.

    ``block``: tokens of a block that is compared; ``slack``: share of the room that a piece must fill before a natural
    boundary is taken, if one lies beyond. ``with_piece`` adds ``piece``, the text of each piece including its overlap.
    ``lang``: the column with the language of each text; without it, or where it is null or not known, the abbreviations
    of all languages count.
    """
    return texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l")).mapInArrow(cutter(limit, overlap, block, slack, with_piece, directory, name), _shape(with_piece)).withColumnRenamed("key", key)
