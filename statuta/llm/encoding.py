"""Text read in a wrong character encoding: finding it and restoring it.

1. Adjacent character pairs of all records are counted (``pair_counts``). Characters only
   damage leaves (replacement and control characters, question marks inside words, the
   no-break space that was half a letter) are a class of their own. Records that hold it,
   or symbols between letters, don't vote; otherwise frequent kinds of damage would look
   normal.
2. A pair's score is its mutual information, log2 of its count over the count
   expected from its characters, with a floor that keeps rare characters from
   scoring high (``Model``).
3. In each record the maximum-scoring segments of negated scores are isolated
   (Ruzzo and Tompa): the improbable runs.
4. Inverse mappings, from the encoding a text was read in to the one it was written
   in, are tested only inside those runs, up to three deep. A mapping counts if the
   result is much more probable than what stood there.
5. What was lost can't be mapped back: a run that still holds the class of damage is
   found but left as it is. Every record that is found has an improbable run.

The pair table has at most CLASSES squared cells whatever the size of the corpus, so
it may be sent to every executor. Null, empty and blank texts are never found.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.texts import points, slices

CLASSES = 2048
#: The class of what only damage leaves.
MARK = CLASSES - 1
#: Pairs expected less often than this share of all pairs are treated as expected so often.
FLOOR = 1e-6
#: Bits a run must be improbable by, and bits a mapping must gain.
RUN_BITS, GAIN_BITS = 7.0, 8.0
#: Bits of a pair that no sound record holds, or less if it were expected.
UNSEEN = -4
#: Mean bits a pair of restored text must reach.
MEAN_BITS = -0.3
#: Bits and inner symbols from which a run is called garbled although no mapping restores it.
LOST_BITS, LOST_SYMBOLS = 40.0, 3

# The bytes of the Vietnamese standard TCVN 5712 (ABC fonts), from 0xA1 on.
TCVN3 = dict(
    zip(
        [*range(0xA1, 0xAF), *range(0xB5, 0xBA), 0xBB, 0xBC, 0xBD, 0xBE, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xCB, 0xCC, 0xCE, 0xCF, *range(0xD0, 0xD9), *range(0xDC, 0xE0), *range(0xE1, 0xF0), *range(0xF1, 0xFF)],
        "ĂÂÊÔƠƯĐăâêôơưđ" "àảãáạ" "ằẳẵắ" "ặầẩẫấậ" "èẻẽ" "éẹềểễếệìỉ" "ĩíịò" "ỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ",
    )
)

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("АВЕКМНОРСТХЅІЈУасеорхуѕіјһΑΒΕΗΙΚΜΝΟΡΤΧΖΥον", "ABEKMHOPCTXSIJYaceopxysijhABEHIKMNOPTXZYov")

# Encodings texts are read in by mistake, with those they were written in.
WRONG = {
    "utf-8": ("cp1252", "latin-1", "cp1250", "cp1258", "cp437", "cp850", "mac-roman", "cp1251", "koi8-r", "cp866", "cp1254", "cp1257", "cp874", "gb18030", "cp932", "big5", "cp949", "cp1253", "iso8859-2", "iso8859-15"),
    "cp932": ("cp1252", "latin-1", "cp437", "gb18030"),
    "gb18030": ("cp1252", "latin-1", "cp437", "cp932", "cp949", "big5", "cp1251"),
    "big5": ("cp1252", "latin-1", "gb18030"),
    "cp949": ("cp1252", "latin-1", "gb18030"),
    "euc-jp": ("cp1252", "latin-1", "gb18030"),
    "cp874": ("cp1252", "latin-1", "mac-roman"),
    "koi8-r": ("cp1251", "cp866", "cp1252", "latin-1"),
    "cp1251": ("cp1252", "latin-1", "koi8-r", "cp866", "mac-cyrillic", "cp1250"),
    "cp866": ("cp1251", "cp1252", "latin-1", "koi8-r"),
    "cp1252": ("cp1250", "mac-roman", "cp437", "cp850", "cp1251", "cp1253", "iso8859-2", "cp1257", "cp1254", "cp866", "cp1258"),
    "mac-roman": ("cp1252", "latin-1"),
    "cp437": ("cp1252", "latin-1"),
    "tcvn3": ("latin-1", "cp1252"),
}


#: Readings that turn letters into letters, so that nothing but frequency tells.
ALIASES = (("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1251", "cp866"), ("cp1257", "cp1252"))
#: How much more frequent the mapped pair must be.
ALIAS = 6


def _byte_of_control(error: UnicodeError):
    """Bytes that an encoding leaves undefined are often read as the control of that number."""
    part = error.object[error.start : error.end]
    if isinstance(error, UnicodeEncodeError) and all(0x80 <= ord(c) < 0xA0 for c in part):
        return bytes(map(ord, part)), error.end
    raise error


codecs.register_error("statuta-controls", _byte_of_control)


def _class_table() -> np.ndarray:
    """Code points by class: common letters by themselves, large scripts hashed."""
    table = np.zeros(0x10000, np.int64)
    used = 1  # 0: white space and line breaks

    def place(low: int, high: int, size: int | None = None) -> None:
        nonlocal used
        cps = np.arange(low, high)
        size = size or cps.size
        table[low:high] = used + (cps * 7919 % size if size < cps.size else cps - low)
        used += size

    place(0x10000 - 0x2000, 0x10000, 16)  # what no line below places
    for low, high, size in (
        (0x21, 0x180, None), (0x180, 0x250, 13), (0x250, 0x300, 16), (0x300, 0x370, 8), (0x370, 0x400, 32), (0x400, 0x460, None), (0x460, 0x530, 8),
        (0x530, 0x900, 16), (0x900, 0x980, None), (0x980, 0xE00, 16), (0xE00, 0xE80, None), (0xE80, 0x1100, 8), (0x1100, 0x1200, 8), (0x1200, 0x1EA0, 8), (0x1EA0, 0x1F00, None),
        (0x1F00, 0x2010, 8), (0x2010, 0x2040, None), (0x2040, 0x2160, 16), (0x2160, 0x2190, 8), (0x2190, 0x3000, 64), (0x3000, 0x3040, 32), (0x3040, 0x3100, None),
        (0x3100, 0x3400, 8), (0x3400, 0xAC00, 448), (0xAC00, 0xD7B0, 64), (0xD7B0, 0xF900, 4), (0xF900, 0xFF00, 8), (0xFF00, 0xFFF0, 96), (0xFFF0, 0x10000, 1),
    ):
        place(low, high, size)
    for letter in "ƠơƯưƒ":
        table[ord(letter)] = used
        used += 1
    table[ord("1") : ord("9") + 1] = table[ord("0")]
    for cp in (*range(0x21), 0xA0, 0x3000, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F):
        table[cp] = 0
    table[0xA0] = used  # a no-break space is a byte of many garbled letters
    table[0x80:0xA0] = MARK
    table[0xFFFD] = MARK
    assert used < MARK
    return table


def _is_symbol(cp: int) -> bool:
    return unicodedata.category(chr(cp)) in ("So", "Sm", "Sk", "Sc", "Cc", "No", "Cf") and cp not in (9, 10, 13) and not 0x200B <= cp <= 0x206F and cp != 0xFEFF or cp in (0xA1, 0xA7, 0xAA, 0xAB, 0xB5, 0xB6, 0xB7, 0xBA, 0xBB, 0xBF, 0xFFFD, 0x2030, 0x2020, 0x2021)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, letter, symbol and certain-damage flags of the basic plane."""
    letter = np.fromiter((unicodedata.category(chr(cp))[0] in "LM" for cp in range(0x10000)), bool, 0x10000)
    symbol = np.fromiter((_is_symbol(cp) for cp in range(0x10000)), bool, 0x10000)
    letter &= ~symbol
    damage = np.zeros(0x10000, bool)
    damage[0x80:0xA0] = True
    damage[0xFFFD] = True
    return _class_table(), letter, symbol, damage


#: Signs of Latin-1 that sound text has after a letter (quotation marks, powers, degrees,
#: fractions, mu, ordinals).
_TRAILING = np.isin(np.arange(256), [0xAA, 0xAB, 0xB0, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBB, 0xBC, 0xBD, 0xBE])


def _doubtful(small: np.ndarray, letter: np.ndarray, symbol: np.ndarray, damage: np.ndarray) -> np.ndarray:
    """Positions that only damaged text has: a symbol between letters, two symbols in a
    row or with a quotation mark next to a letter, a sign after a letter, a control or replacement character, a question mark in a word."""
    is_letter, is_symbol = letter[small], symbol[small] | (small == 0x3F)
    left = np.concatenate([[False], is_letter[:-1]])
    right = np.concatenate([is_letter[1:], [False]])
    after_letter = is_symbol & left & ~right & ~_TRAILING[np.minimum(small, 0xFF)] & (small > 0x7F)
    quoted = np.concatenate([(small[1:] >= 0x2018) & (small[1:] < 0x203B), [False]]) & is_symbol & left & (small > 0x7F)
    doubled = np.concatenate([[False], is_symbol[:-1]]) & is_symbol & (left | right | np.concatenate([[False, False], is_letter[:-2]])) if small.size > 2 else np.zeros(small.size, bool)
    return is_symbol & left & right | doubled & (small > 0x7F) | after_letter | quoted | damage[small]


_OPENERS = frozenset(map(ord, " \t\n\r\x0b\x0c(“\"|")) | {0x85, 0xA0, 0x2028, 0x2029, 0x3000}
_HIDDEN_CPS = frozenset([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def _mark(small: np.ndarray, offsets: np.ndarray, cls: np.ndarray, skip: list[tuple[int, int]] = ()) -> np.ndarray:
    """``cls`` with MARK for question marks inside or before words (a letter on the right,
    and several of them, a letter that isn't followed by a capital, or an opener on the
    left) and for the no-break space after a capital A with tilde beside a small letter.
    Characters that aren't seen don't separate; places in ``skip`` are left alone."""
    letter = tables()[1]
    asked = np.flatnonzero(small == 0x3F)
    half = np.flatnonzero((small[1:] == 0xA0) & (small[:-1] == 0xC3)) + 1
    if not asked.size and not half.size:
        return cls
    cls = cls.copy()
    done = -1
    for p in asked.tolist():
        if p <= done:
            continue
        i = int(np.searchsorted(offsets, p, side="right")) - 1
        low, high = int(offsets[i]), int(offsets[i + 1])
        left, right, run = p - 1, p + 1, [p]
        while left >= low and int(small[left]) in _HIDDEN_CPS:
            left -= 1
        while right < high and (small[right] == 0x3F or int(small[right]) in _HIDDEN_CPS):
            if small[right] == 0x3F:
                run.append(right)
            right += 1
        done = run[-1]
        if right >= high or not letter[small[right]] or any(a <= p < b for a, b in skip):
            continue
        before = int(small[left]) if left >= low else 0x20
        capital = 0x41 <= small[right] <= 0x5A or small[right] == 0x110
        if len(run) > 1 or before in _OPENERS or (letter[before] and not capital):
            cls[run] = MARK
    for p in half.tolist():
        i = int(np.searchsorted(offsets, p, side="right")) - 1
        low, high = int(offsets[i]), int(offsets[i + 1])
        small_left = p - 2 >= low and chr(small[p - 2]).islower()
        if p - 1 >= low and (small_left or (p + 1 < high and 0x61 <= small[p + 1] <= 0x7A)):
            cls[p] = MARK
    return cls


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, n``: pairs of character classes in the records that may vote; ``texts``
    has one string column. Counted per task in a dense array, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, letter, symbol, damage = tables()
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for low, high in slices(values):
                cps, offsets = points([v or "" for v in values[low:high]])
                if cps.size < 2:
                    continue
                small = np.where(cps < 0x10000, cps, 0xFFF0)
                cls = _mark(small, offsets, classes[small])
                bad = np.concatenate([[0], np.cumsum(_doubtful(small, letter, symbol, damage) | (cls == MARK))])
                votes = np.repeat(bad[offsets[1:]] == bad[offsets[:-1]], np.diff(offsets))
                owner_end = np.zeros(cps.size, bool)
                owner_end[offsets[1:][np.diff(offsets) > 0] - 1] = True
                use = votes[:-1] & ~owner_end[:-1]
                total += np.bincount((cls[:-1] * CLASSES + cls[1:])[use], minlength=total.size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], names=["pair", "n"])

    return texts.mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Scores of character pairs, in quarter bits."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        self._scores: np.ndarray | None = None

    @classmethod
    def of(cls, counted: DataFrame) -> "Model":
        """At most CLASSES squared cells are collected."""
        rows = counted.toPandas()
        return cls(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))

    def __getstate__(self):
        return {"pairs": self.pairs.astype(np.int32), "counts": self.counts, "_scores": None}

    @property
    def scores(self) -> np.ndarray:
        if self._scores is None:
            pairs = self.pairs.astype(np.int64)
            total = max(self.counts.sum(), 1.0)
            first = np.bincount(pairs // CLASSES, self.counts, CLASSES)
            second = np.bincount(pairs % CLASSES, self.counts, CLASSES)
            expected = (first[:, None] * (second[None, :] / total)).astype(np.float32).ravel()
            score = UNSEEN - np.log2(1 + expected / (total * FLOOR))
            score[pairs] = np.log2(self.counts / (expected[pairs] + total * FLOOR))
            self._doubt(score, pairs, total)
            self._scores = np.clip(np.round(score * 4), -32, 16).astype(np.int8)
        return self._scores

    def _doubt(self, score: np.ndarray, pairs: np.ndarray, total: float) -> None:
        """Letters read as other letters look normal where whole texts are damaged. A pair
        that an inverse mapping turns into a pair ALIAS times as frequent is improbable."""
        classes = tables()[0]
        count = np.zeros(CLASSES * CLASSES)
        count[pairs] = self.counts
        for wrong, right in ALIASES:
            other = np.arange(CLASSES)
            for cp in (*range(0xA0, 0x180), *range(0x400, 0x460)):
                out = _inverse(chr(cp), wrong, right)
                if out and len(out) == 1 and out.isalpha() and chr(cp).isalpha():
                    other[classes[cp]] = classes[ord(out)]
            mapped = other[pairs // CLASSES] * CLASSES + other[pairs % CLASSES]
            worse = (mapped != pairs) & (count[mapped] >= np.maximum(ALIAS * self.counts, total * FLOOR))
            score[pairs[worse]] = np.minimum(score[pairs[worse]], -4)

    def text_scores(self, text: str) -> np.ndarray:
        """Quarter bits of each pair of a text, its edges counting as white space."""
        cls = text_classes(f" {text} ")
        return self.scores[cls[:-1] * CLASSES + cls[1:]].astype(np.int64)


def text_classes(text: str) -> np.ndarray:
    """Classes of a text's characters; question marks of links are usual ones."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.where(cps < 0x10000, cps, 0xFFF0).astype(np.int64)
    links = [m.span() for m in _LINK.finditer(text)] if "?" in text else []
    return _mark(small, np.array([0, small.size]), tables()[0][small], links)


def segments(weights: list[int], least: float) -> list[tuple[int, int, int]]:
    """All maximal scoring segments (start, end, sum) with at least ``least``, by the
    linear-time method of Ruzzo and Tompa."""
    total, stack = 0, []  # (start, end, sum before, sum after)
    for i, w in enumerate(weights):
        if w > 0:
            item = [i, i + 1, total, total + w]
            total += w
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= item[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= item[3]:
                    stack.append(item)
                    break
                item = [stack[j][0], item[1], stack[j][2], item[3]]
                del stack[j:]
        else:
            total += w
    return [(a, b, after - before) for a, b, before, after in stack if after - before >= least]


def _inverse(piece: str, wrong: str, right: str) -> str | None:
    try:
        raw = piece.encode(wrong, "statuta-controls")
        if right == "tcvn3":
            # signs below 0xA1 aren't part of the standard and stay what they are
            out = "".join(TCVN3.get(b, c) for c, b in zip(piece, raw))
            capitals = sum(c.isupper() for c in piece if c.isascii())
            small = sum(c.islower() for c in piece if c.isascii())
            return out.upper() if capitals > small else out  # the capital fonts share the codes
        out = raw.decode(right)
    except (UnicodeError, LookupError):
        return None
    if right == "cp1258":
        out = unicodedata.normalize("NFC", out)
    return out


_UTF8_READ_AS = WRONG["utf-8"]
_OTHERS = [(w, r) for r, ws in WRONG.items() if r != "utf-8" for w in ws]
_LINK = re.compile(r"\S*(?:://|www\.|@|\?[^\W\d_]+=)\S*")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SPACES = re.compile(r"([ \n\r\t]+)")
_EDGE = " \n\r\t"


@lru_cache(maxsize=1)
def _sequences() -> list[tuple[str, re.Pattern]]:
    """Per encoding, how a UTF-8 lead byte and its first continuation look when read in it."""
    out = []
    for name in _UTF8_READ_AS:
        try:
            chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
            single = all(len(c) == 1 for c in chars) and len({*chars}) > 200
        except UnicodeDecodeError:
            single = False
        if single:
            leads, rest = ("".join(re.escape(chars[b]) for b in span) for span in (range(0xC2, 0xF5), range(0x80, 0xC0)))
            out.append((name, re.compile(f"[{leads}][{rest}]")))
        else:
            out.append((name, re.compile("[⺀-鿿가-힣＀-￯]")))  # two-byte encodings look East Asian
    return out


def _bits(model: Model, text: str) -> tuple[float, float]:
    scores = model.text_scores(text)
    return scores.sum() / 4, scores.mean() / 4


def _undo_utf8(piece: str, model: Model, depth: int = 3) -> tuple[str, float]:
    """Valid UTF-8 behind a wrong reading is strong evidence by itself; what comes out
    must only be less improbable than what stood there."""
    here, best, gained = None, piece, 0.0
    for wrong, looks in _sequences():
        out = _inverse(piece, wrong, "utf-8") if looks.search(piece) else None
        if out is None or out == piece:
            continue
        if depth > 1 and not out.isascii():
            out = _undo_utf8(out, model, depth - 1)[0]
        here = _bits(model, piece)[0] if here is None else here
        gain = _bits(model, out)[0] - here
        if gain > max(gained, GAIN_BITS / 4):
            best, gained = out, gain
            if wrong != "latin-1" and gain > GAIN_BITS:
                break
    return best, gained


def _undo_words(piece: str, model: Model) -> tuple[str, float]:
    """The run as a whole, else its words, as sound or lossy ones may stand between garbled ones."""
    if not any(looks.search(piece) for _, looks in _sequences()):
        return piece, 0.0
    best, gained = _undo_utf8(piece, model)
    words = _SPACES.split(piece)
    if gained or len(words) == 1:
        return best, gained
    fixed = [(w, 0.0) if w.isascii() else _undo_utf8(w, model) for w in words]
    return "".join(w for w, _ in fixed), sum(g for _, g in fixed)


def _enough(piece: str, out: str) -> bool:
    """One changed letter proves nothing, unless it was a symbol inside a word or stands in
    a word of small letters."""
    if piece.islower() or len(out) != len(piece) or sum(a != b for a, b in zip(piece, out)) > 1:
        return True
    _, letter, symbol, damage = tables()
    cps = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(_doubtful(np.where(cps < 0x10000, cps, 0xFFF0).astype(np.int64), letter, symbol, damage).any())


def restore_piece(piece: str, model: Model, undone: float = 0.0, used: set | None = None) -> tuple[str, float]:
    """The most probable inverse mapping of an improbable run, and the bits gained. A
    mapping between single-byte encodings must gain more than ``undone``, the bits gained
    by undoing disguises. ``used`` collects the mappings between other encodings."""
    if piece.isascii():
        return piece, 0.0
    best, gained = _undo_words(piece, model)
    if gained:
        return best, gained
    words = _SPACES.split(piece)
    here, tried, way = _bits(model, piece)[0], {piece}, None
    for wrong, right in _OTHERS:
        out = _inverse(piece, wrong, right)
        if out is None or out in tried or "�" in out:
            continue
        tried.add(out)
        bits, mean = _bits(model, out)
        if bits - here > max(gained, GAIN_BITS + max(undone, 0.0)) and mean >= MEAN_BITS and _enough(piece, out):
            best, gained, way = out, bits - here, (wrong, right)
    if way and used is not None:
        used.add(way)
    if not gained and undone <= 0 and len(words) > 1:  # words damaged in several ways
        fixed = [(w, 0.0) if w.isascii() else _undo_letters(w, model) for w in words]
        if sum(g for _, g in fixed) > GAIN_BITS and _enough(piece, "".join(w for w, _ in fixed)):
            return "".join(w for w, _ in fixed), sum(g for _, g in fixed)
    return best, gained


def _follow(word: str, model: Model, used: set[tuple[str, str]]) -> str:
    """A word too short for a run of its own, by the mappings that restored its record."""
    if word.isascii() or model.text_scores(word).min() > -12:
        return word
    here, best = _bits(model, word)[0] + GAIN_BITS / 4, word
    for wrong, right in used:
        out = _inverse(word, wrong, right)
        if out and out != word and _bits(model, out)[0] > here:
            here, best = _bits(model, out)[0], out
    return best


def _undo_letters(word: str, model: Model) -> tuple[str, float]:
    """The best letter-for-letter mapping of one word."""
    here, best, gained = _bits(model, word)[0], word, 0.0
    for wrong, right in ALIASES:
        out = _inverse(word, wrong, right)
        if out and out != word and len(out) == len(word):
            gain = _bits(model, out)[0] - here
            if gain > max(gained, GAIN_BITS / 2):
                best, gained = out, gain
    return best, gained


def _disguised(text: str) -> str:
    """The text without disguises that the script consistency operator deals with."""
    return unicodedata.normalize("NFKC", text.translate(_HIDDEN)).translate(_LOOKALIKES)


def _pieces(text: str, model: Model) -> list[list[int]]:
    """Improbable runs, widened to whole words and merged where they touch."""
    weights = (-model.text_scores(text)).tolist()
    pieces: list[list[int]] = []
    for a, b, _ in sorted(segments(weights, RUN_BITS * 4)):  # pair i joins characters i-1 and i
        low, high = max(a - 1, 0), min(b, len(text))
        while low > 0 and text[low - 1] not in _EDGE:
            low -= 1
        while high < len(text) and text[high] not in _EDGE:
            high += 1
        if pieces and low <= pieces[-1][1] + 1:
            pieces[-1][1] = max(high, pieces[-1][1])
        else:
            pieces.append([low, high])
    return pieces


def _marked(text: str) -> bool:
    return bool((text_classes(f" {text} ") == MARK).any())


def repair(text: str, model: Model, find_only: bool = False) -> tuple[bool, bool, str]:
    """Whether the text is garbled, whether all of it could be restored, and the text with
    what could be restored. With ``find_only`` the search ends at the first proof."""
    out, at, mapped, left_over = [], 0, False, False
    used: set[tuple[str, str]] = set()
    _, letter, symbol, damage = tables()
    for low, high in _pieces(text, model):
        piece = text[low:high]
        marked = _marked(piece)
        if marked and find_only:
            return True, False, text
        plain = _disguised(piece)
        undone = _bits(model, plain)[0] - _bits(model, piece)[0] if plain != piece else 0.0
        if undone > 0 and not _undo_words(piece, model)[1] and not _pieces(plain, model):
            continue
        better, gain = restore_piece(piece, model, undone, used)
        if gain > 0:
            mapped = True
        elif marked:
            left_over = True
        elif -_bits(model, plain)[0] >= LOST_BITS:
            cps = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
            if _doubtful(np.where(cps < 0x10000, cps, 0xFFF0).astype(np.int64), letter, symbol, damage).sum() >= LOST_SYMBOLS:
                left_over = True
        if find_only and (mapped or left_over):
            return True, False, text
        out += [text[at:low], better]
        at = high
    fixed = "".join(out) + text[at:]
    if used:
        fixed = "".join(_follow(w, model, used) for w in _SPACES.split(fixed))
    return mapped or left_over, mapped and not left_over and not _marked(fixed), fixed


def suspects(values: list[str], model: Model) -> np.ndarray:
    """Which texts have an improbable run."""
    cps, offsets = points(values)
    flagged = np.zeros(len(values), bool)
    if not cps.size:
        return flagged
    small = np.where(cps < 0x10000, cps, 0xFFF0)
    cls = _mark(small, offsets, tables()[0][small])
    filled = np.flatnonzero(np.diff(offsets))
    weight = np.zeros(cps.size, np.int64)  # of the pair that ends at the position
    weight[1:] = -model.scores[cls[:-1] * CLASSES + cls[1:]].astype(np.int64)
    heads = offsets[:-1][filled]
    weight[heads] = -model.scores[cls[heads]].astype(np.int64)
    reset = np.zeros(cps.size, np.int64)
    reset[heads] = -(1 << 24)  # no run crosses from one text to the next
    climb = np.cumsum(weight + reset)
    base = np.minimum.accumulate(np.concatenate([[0], climb[:-1]]) + reset)
    run = climb - base
    flagged[filled] = np.maximum.reduceat(run, heads) >= RUN_BITS * 4
    return flagged


def examine(df: DataFrame, src: str, record: str, text: str, model: Model, find_only: bool = False) -> DataFrame:
    """``src, record_id, garbled, restored, content``: one row per garbled row of ``df``;
    ``restored`` tells whether nothing was lost, ``content`` is the text as far as it
    could be restored."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("src", pa.string()), ("record_id", pa.string()), ("restored", pa.bool_()), ("content", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), [v or "" for v in batch.column(1).to_pylist()]
            rows = []
            for low, high in slices(values):
                for i in np.flatnonzero(suspects(values[low:high], known)) + low:
                    bad, whole, fixed = repair(values[i], known, find_only)
                    if bad:
                        rows.append((ids[i], whole, fixed))
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([src] * len(a)), pa.array(a), pa.array(b), pa.array(c, pa.string())], schema=out)

    rows = df.select(F.col(record).alias("record_id"), F.col(text).alias("value")).where(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    return rows.mapInArrow(look, "src string, record_id string, restored boolean, content string")


def once(found: DataFrame) -> DataFrame:
    """Copies of a record carry one text; they come out once."""
    return found.dropDuplicates(["src", "record_id"])
