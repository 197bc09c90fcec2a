"""Sentence boundaries across languages and scripts.

The boundary rules are compiled into finite automata (see ``transducer``): one reads from
the right what a text continues with, one reads from the left the
token that a mark closes, one follows quotation marks and brackets, and one tells
from the right which closing marks still come in the line. A position's output
depends only on its symbol and on the automata's states there, so the whole is a
rational transduction. Long texts are handled in chunks whose transition functions
are composed by prefix scan; no text is cut to a prefix.

Results: null, empty and blank texts have no sentence; repeated rows of a record
come out once; offsets are code points of the stored value.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.texts import points, slices
from statuta.llm.transducer import Automaton, compile_automaton, run

# Abbreviations that a capital letter or another word follows without
# a new sentence (titles, places, parts of works), in several languages.
ABBREVIATIONS = """
TP Tp GS PGS TS ThS Ths KS BS CN LS NCS TSKH NSND NSƯT TX TT BCH
Dr Mr Mrs Ms Prof St Sr Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep Pres Mt
No Nos Nr Fig Figs Sec Secs Art Arts Vol Vols Ch Chap Pt Eq Ref Reg Par Para Ave Blvd vs cf approx
e.g i.e viz
Hr Fr Abs Str Bd Abb Kap Ziff Rn vgl bzw ca
Mme Mlle MM Me Pr Ste art fig vol chap al
им проф акад доц тов см ст рис табл стр гл разд ул пер пл обл гор
डॉ श्री प्रो कु
""".split()

# Months that follow an ordinal number with a full stop.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split()

# Words that may stand between the first word of a heading and its number.
HEADING_WORDS = "lục số mục phụ".split()

# Look-alike letters, read as Latin ones when abbreviations are sought.
LOOKALIKES = dict(zip("АВЕКМНОРСТХЅІЈасеорхуѕіјΑΒΕΗΙΚΜΝΟΡΤΧΖΥο", "ABEKMHOPCTXSIJaceopxysijABEHIKMNOPTXZYo"))

PAIRS = ["“”", "„“", "«»", "「」", "『』", "()", "[]", '""', "《》"]
FINAL = ".!?…"
FINAL_WIDE = "。！？｡．।॥؟۔።།។၊။։‼⁇⁈⁉"
BREAKS = "\n\r\v\f  "
INVISIBLE = {0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, 0x180E}

# Character types.
(NL, WS, ZERO, DIGIT, UPPER, LOWER, OTHER, THAI, HAN, KANA, DEVA, DOT, MARK, WIDE, COMMA, SYM, OPENQ, CLOSE, OPENB, QUOTE, COLON) = range(21)

_PAIR_OPEN = {"“": 0, "„": 1, "«": 2, "「": 3, "『": 4, "(": 5, "（": 5, "[": 6, "［": 6, "【": 6, '"': 7, "《": 8, "〈": 8}
_PAIR_CLOSE = {"”": (0, 1), "“": (1,), "»": (2,), "」": (3,), "』": (4,), ")": (5,), "）": (5,), "]": (6,), "］": (6,), "】": (6,), '"': (7,), "》": (8,), "〉": (8,)}
_QUOTES = "“”„«»「」『』\"《》〈〉"
_BRACKETS = "()（）[]［］【】"
_SIGNS = list(_QUOTES + _BRACKETS)
_BRACKET_POINTS = [ord(c) for c in _BRACKETS]


def _kind(cp: int) -> int:
    ch = chr(cp)
    if ch in BREAKS:
        return NL
    if cp in INVISIBLE or unicodedata.category(ch) in ("Mn", "Me", "Cf") and not (0x900 <= cp < 0xE80):
        return ZERO
    if ch.isspace() and cp not in (0x85, 0x1C, 0x1D, 0x1E, 0x1F):
        return WS
    if ch == ".":
        return DOT
    if ch in "!?…":
        return MARK
    if ch in FINAL_WIDE:
        return WIDE
    if ch == '"':
        return QUOTE
    if ch in _PAIR_OPEN:
        return OPENB if ch in _BRACKETS else OPENQ
    if ch in _PAIR_CLOSE or ch in "’›":
        return CLOSE
    if ch == ":" or ch == "：":
        return COLON
    if 0xE00 <= cp < 0xE80:
        return DIGIT if ch.isdigit() else THAI
    if 0x900 <= cp < 0x980:
        return DIGIT if ch.isdigit() else DEVA
    if ch.isdigit() and unicodedata.category(ch) == "Nd":
        return DIGIT
    category = unicodedata.category(ch)
    if category[0] == "L" or 0x2160 <= cp < 0x2180:
        if 0x3040 <= cp < 0x30A0:
            return KANA
        if 0x30A0 <= cp < 0x3100 or 0x2E80 <= cp < 0x3040 or 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00:
            return HAN
        if ch.isupper() or 0x2160 <= cp < 0x2180 or category == "Lt":
            return UPPER
        if ch.islower() and cp not in (0xAA, 0xBA):
            return LOWER
        return SYM if cp in (0xAA, 0xBA) else OTHER
    if category[0] == "M":
        return OTHER
    if category[0] in "SCN" or cp in (0xA1, 0xA7, 0xB6, 0xBF):
        return SYM
    return COMMA


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code points with full-width forms, Roman numeral signs and look-alikes read as plain letters."""
    fold = np.arange(0x10000)
    for cp in range(0xFF01, 0xFF5F):
        fold[cp] = cp - 0xFEE0
    for cp in range(0x2160, 0x2180):
        fold[cp] = ord(unicodedata.normalize("NFKC", chr(cp))[0])
    for look, plain in LOOKALIKES.items():
        fold[ord(look)] = ord(plain)
    return fold


def _fold_word(word: str) -> str:
    return "".join(chr(_folded()[ord(c)]) for c in word)


class _Trie:
    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final: set[int] = set()
        for word in words:
            node = 0
            for ch in word:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                node = self.next[node][ch]
            self.final.add(node)

    def step(self, node: int, ch: str) -> int:
        return self.next[node].get(ch, -1) if node >= 0 else -1


# Kinds of the token before a mark.
(GAP, NUM, SINGLE, ROMAN1, ROMAN, LOW1, WORD, DOTTED, LINK, BULLET, ENDED, DOTS, MIXED) = range(13)
# Places of the token in its line.
(START, FIRST, AFTER1, SECOND, LATER) = range(5)


class Rules:
    """The compiled automata and the tables from code points to their symbols."""

    def __init__(self) -> None:
        abbreviations = sorted({_fold_word(w) for w in ABBREVIATIONS})
        headings = [_fold_word(w) for w in HEADING_WORDS]
        self.words = _Trie(abbreviations + headings)
        self.heading_nodes = {self._node(w) for w in headings}
        self.abbreviation_nodes = {self._node(w) for w in abbreviations}
        letters = sorted({ch for w in abbreviations + headings for ch in w if ch != "."} | set("IVXLCDM"))
        months = [m[::-1] for m in MONTHS]
        self.months = _Trie(months)
        month_letters = sorted({ch for m in months for ch in m})
        named = sorted(set(letters) | set(month_letters))
        # symbols: the types, then "-", "/", "@", then letters of their own
        self.special = {"-": 21, "/": 22, "@": 23}
        self.letter = {ch: 24 + i for i, ch in enumerate(named)}
        self.symbols = 24 + len(named)
        self.of_symbol = {v: k for k, v in self.letter.items()}
        types = np.array([_kind(cp) for cp in range(0x10000)], np.int16)
        self.types = types
        symbols = types.copy()
        for cp in range(0x10000):
            ch = chr(int(_folded()[cp]))
            if types[cp] in (UPPER, LOWER, DEVA) and ch in self.letter:
                symbols[cp] = self.letter[ch]
            elif ch in self.special:
                symbols[cp] = self.special[ch]
            elif types[cp] in (THAI, HAN, KANA) and cp > 0xFF00:
                symbols[cp] = OTHER
        self.symbol_of = symbols
        self.left = compile_automaton(self._left, (START, GAP, 0, 0), self.symbols)
        self.right = compile_automaton(self._right, (False, NL, -1), self.symbols)
        self.signs = np.zeros(0x10000, np.int16)
        for i, ch in enumerate(_SIGNS):
            self.signs[ord(ch)] = i + 2
        for ch in BREAKS:
            self.signs[ord(ch)] = 1
        self.quotes = compile_automaton(self._quote, (-1, 0), len(_SIGNS) + 2)
        self.ahead = compile_automaton(self._ahead, 0, len(_SIGNS) + 2)
        self.coming = self.ahead.attribute(lambda s: s, np.int32)
        self.opens = np.array([-1, -1] + [_PAIR_OPEN.get(ch, -1) for ch in _SIGNS], np.int8)
        self.left_kind = self.left.attribute(lambda s: s[1])
        self.left_place = self.left.attribute(lambda s: s[0])
        self.left_dot = self.left.attribute(lambda s: s[3] == 1, bool)
        self.left_number = self.left.attribute(lambda s: s[3] == 2, bool)
        self.left_abbreviation = self.left.attribute(lambda s: s[1] != GAP and s[2] in self.abbreviation_nodes, bool)
        self.right_gap = self.right.attribute(lambda s: s[0], bool)
        self.right_first = self.right.attribute(lambda s: s[1])
        self.inside = self.quotes.attribute(lambda s: s[0] >= 0, bool)
        self.outermost = self.quotes.attribute(lambda s: s[1] == 1, bool)
        self.quote_type = self.quotes.attribute(lambda s: s[0])
        self.misread = _misread_signs()
        self.misread_sizes = sorted({len(m) for m in self.misread}, reverse=True)
        self.misread_pairs = np.array(sorted({ord(m[0]) << 16 | ord(m[1]) for m in self.misread}), np.int64)
        self.misread_first = np.zeros(0x10000, bool)
        for garbled in self.misread:
            self.misread_first[ord(garbled[0])] = True
        self.closes = np.zeros((len(_SIGNS) + 2, len(PAIRS)), bool)
        for i, ch in enumerate(_SIGNS):
            for pair in _PAIR_CLOSE.get(ch, ()):
                self.closes[i + 2, pair] = True

    def _node(self, word: str) -> int:
        node = 0
        for ch in word:
            node = self.words.next[node][ch]
        return node

    def _type(self, symbol: int) -> int:
        if symbol < 21:
            return symbol
        if symbol < 24:
            return COMMA
        ch = self.of_symbol[symbol]
        return DEVA if 0x900 <= ord(ch) < 0x980 else UPPER if ch.isupper() else LOWER

    def _left(self, state, symbol):
        """(place, kind, dictionary node, the token before: 1 it ended with a stop, 2 it was a number)"""
        place, kind, node, stop = state
        type_ = self._type(symbol)
        ch = self.of_symbol.get(symbol, "")
        if type_ == NL:
            return (START, GAP, 0, 0)
        if type_ == ZERO:
            return state
        if type_ == WS:
            if kind == GAP:
                return state
            ended = 1 if kind in (ENDED, DOTS) else 2 if kind == NUM else 0
            if place == FIRST:
                if kind in (BULLET, NUM) or kind == ENDED and stop == 3:  # a bullet or list number
                    return (START, GAP, 0, 0)
                return (AFTER1, GAP, 0, ended)
            if place == SECOND:
                return (AFTER1 if node in self.heading_nodes and kind == WORD else LATER, GAP, 0, ended)
            return (place, GAP, 0, ended)
        if kind == GAP:
            place = {START: FIRST, AFTER1: SECOND}.get(place, place)
            if type_ in (OPENQ, OPENB, QUOTE, CLOSE) and place == FIRST:
                return (START, GAP, 0, 0)
            if type_ == DIGIT:
                return (place, NUM, -1, stop)
            if type_ in (UPPER, LOWER, DEVA):
                node = self.words.step(0, ch) if ch else -1
                one = ROMAN1 if ch and ch in "IVX" else SINGLE if type_ == UPPER else LOW1
                return (place, one if type_ != DEVA else LOW1, node, stop)
            if type_ in (OTHER, THAI, HAN, KANA, SYM):
                return (place, WORD, -1, stop)
            if type_ == DOT:
                return (place, DOTS, -1, 0)
            if type_ in (MARK, WIDE):
                return (place, ENDED, -1, 0)
            return (place, BULLET, -1, stop)
        if kind == LINK:
            return (place, LINK, -1, 0)
        if type_ == DOT:
            if kind in (ENDED, DOTS):
                return (place, DOTS, -1, 0)
            if node >= 0 and "." in self.words.next[node]:
                return (place, DOTTED, self.words.next[node]["."], stop)
            # in a line's first token a stop after a number or letter makes a list number
            listed = 3 if place == FIRST and kind in (NUM, SINGLE, ROMAN1, ROMAN, LOW1) else 0
            return (place, ENDED, (-2 if kind == NUM else -3 if kind in (LOW1, SINGLE, ROMAN1, DOTTED) else -1), listed)
        if kind in (ENDED, DOTS):
            if type_ == DIGIT:
                return (place, NUM if node == -2 else DOTTED, -1, 0)
            if type_ in (UPPER, LOWER, DEVA, OTHER, SYM):
                if node == -3 and type_ in (UPPER, LOWER):
                    return (place, DOTTED, -1, 0)
                return (place, WORD, self.words.step(0, ch) if ch else -1, 0)
            if type_ in (MARK, WIDE):
                return (place, ENDED, -1, 0)
            return (place, WORD if node != -2 else NUM, -1, 0)
        if type_ in (MARK, WIDE):
            return (place, ENDED, -1, 0)
        if symbol == 23 or (symbol == 22 and kind == BULLET):
            return (place, LINK, -1, 0)
        if type_ == COLON:
            return (place, BULLET, -1, 0)
        if kind == MIXED:
            return (place, WORD if type_ in (DIGIT, UPPER, LOWER, DEVA, OTHER, THAI, HAN, KANA, SYM) else MIXED, -1, 0)
        if kind == BULLET:
            if type_ == DIGIT:
                return (place, NUM, -1, 0)
            if type_ in (UPPER, LOWER, DEVA):
                one = ROMAN1 if ch and ch in "IVX" else SINGLE if type_ == UPPER else LOW1
                return (place, one, self.words.step(0, ch) if ch else -1, 0)
            if type_ in (OTHER, THAI, HAN, KANA, SYM):
                return (place, WORD, -1, 0)
            return (place, BULLET, -1, 0)
        if kind == NUM:
            if type_ == DIGIT or type_ == COMMA:
                return (place, NUM, -1, stop)
            if type_ in (CLOSE, OPENB, OPENQ, QUOTE):
                return (place, BULLET, -1, 0)
            return (place, WORD, -1, 0)
        if type_ in (CLOSE, OPENB, OPENQ, QUOTE):
            return (place, MIXED, -1, 0)
        if type_ == DIGIT:
            return (place, WORD if kind != DOTTED else DOTTED, -1, 0)
        if type_ == COMMA:
            return (place, WORD if symbol in (21, 22) else MIXED, -1, 0)
        node = self.words.step(node, ch) if ch else -1
        if kind in (ROMAN1, ROMAN) and ch and ch in "IVXLCDM":
            return (place, ROMAN, node, stop)
        if kind == DOTTED:
            return (place, DOTTED, node, stop)
        if kind == LOW1 and type_ == DEVA and node < 0:
            return (place, WORD, -1, 0)
        return (place, WORD, node, stop if node >= 0 else 0)

    def _right(self, state, symbol):
        """(whether space comes first, the type of the first other character, month node)"""
        gap, first, node = state
        type_ = self._type(symbol)
        if type_ == NL:
            return (False, NL, -1)
        if type_ == ZERO:
            return state
        if type_ == WS:
            return (False, NL, -1) if first == NL else (True, first, -1)
        ch = self.of_symbol.get(symbol, "")
        if type_ in (UPPER, LOWER):
            inside = not gap and first in (UPPER, LOWER)
            node = self.months.step(node if inside else 0, ch) if ch and (node >= 0 or not inside) else -1
            if type_ == UPPER and node in self.months.final:
                return (False, UPPER + 100, node)
            return (False, type_, node)
        return (False, type_, -1)

    @staticmethod
    def _quote(state, symbol):
        pair, depth = state
        if symbol == 1:
            return (-1, 0)
        if symbol == 0:
            return state
        ch = _SIGNS[symbol - 2]
        if pair < 0:
            return (_PAIR_OPEN[ch], 1) if ch in _PAIR_OPEN else state
        if pair in _PAIR_CLOSE.get(ch, ()):
            return (pair, depth - 1) if depth > 1 else (-1, 0)
        if _PAIR_OPEN.get(ch) == pair:
            return (pair, min(depth + 1, 3))
        return state

    @staticmethod
    def _ahead(state, symbol):
        if symbol == 1:
            return 0
        if symbol == 0:
            return state
        for pair in _PAIR_CLOSE.get(_SIGNS[symbol - 2], ()):
            state |= 1 << pair
        return state


@lru_cache(maxsize=1)
def rules() -> Rules:
    return Rules()


#: Encodings that UTF-8 is often read in; quotation marks garbled that way still pair.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp437", "mac-roman", "cp1251", "cp1258")


def _misread_signs() -> dict[str, str]:
    """Quotation marks as they look when their UTF-8 bytes are read in another encoding."""
    out: dict[str, str] = {}
    for sign in "“”„«»「」":
        raw = sign.encode()
        for name in MISREAD:
            once = "".join(_byte_char(b, name) for b in raw)
            out[once] = sign
            if name in ("cp1252", "latin-1"):
                for again in ("cp1252", "latin-1"):
                    out["".join(_byte_char(b, again) for b in once.encode())] = sign
    return out


def _byte_char(byte: int, name: str) -> str:
    try:
        return bytes([byte]).decode(name)
    except UnicodeDecodeError:
        return chr(byte)


def _mask(values: np.ndarray, kinds: tuple[int, ...], size: int = 128) -> np.ndarray:
    table = np.zeros(size, bool)
    table[list(kinds)] = True
    return table[values]


def _neighbours(types: np.ndarray, at: np.ndarray, offsets: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The types before and after the positions, past what can't be seen; the edges of a text count as line breaks."""
    n = types.size
    if (types == ZERO).any():
        seen = np.flatnonzero(types != ZERO)
        place = np.searchsorted(seen, at)
        low = np.where(place > 0, seen[np.maximum(place - 1, 0)], -1) if seen.size else np.full(at.size, -1)
        place = np.searchsorted(seen, at, side="right")
        high = np.where(place < seen.size, seen[np.minimum(place, max(seen.size - 1, 0))], n) if seen.size else np.full(at.size, n)
    else:
        low, high = at - 1, at + 1
    before = np.where(low >= offsets[text_of], types[np.maximum(low, 0)], NL)
    after = np.where(high < offsets[text_of + 1], types[np.minimum(high, n - 1)], NL)
    return before, after


def _garbled_symbols(small: np.ndarray, types: np.ndarray, symbols: np.ndarray) -> None:
    """Garbled text keeps its marks, but a capital may have become a small letter before a
    sign, a lone ë, or a small letter before capitals; and a no-break space may be half of
    a letter. Such places begin words, or belong to them, like other symbols."""
    if small.size < 2:
        return
    following, leading = small[1:], np.concatenate([[10], small[:-2]])
    begins = (types[np.maximum(np.arange(small.size - 1) - 1, 0)] == WS) | (leading == 10)
    sign = _mask(types[1:], (SYM, CLOSE))
    odd = begins & ((types[:-1] == LOWER) & sign & (small[:-1] > 0x7F) | (small[:-1] == 0xB7) & (following == 0xAA) | (small[:-1] == 0xEB) & (types[1:] == WS))
    odd |= begins & (small[:-1] == 0x192) & (following == 0xEA)
    odd |= (small[:-1] >= 0x430) & (small[:-1] < 0x450) & (following >= 0x410) & (following < 0x430)
    symbols[:-1][odd] = SYM
    half = np.flatnonzero((small[1:-1] == 0xA0) & np.isin(small[:-2], (0xC2, 0xC3, 0x102)) & (types[2:] != UPPER)) + 1
    symbols[half] = SYM


def boundaries(texts: list[str], chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the text's number, start and end of each sentence, in order."""
    r = rules()
    cps, offsets = points(texts)
    n = cps.size
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    small = np.where(cps < 0x10000, cps, 0xFFFD)
    types = r.types[small]
    symbols = r.symbol_of[small]
    signs = r.signs[small]
    if (cps > 0xFFFF).any():
        wide = (cps >= 0x20000) & (cps < 0x32000)
        types[wide], symbols[wide] = HAN, HAN
    lead = np.flatnonzero(r.misread_first[small[:-1]])
    lead = lead[np.isin(small[lead] << 16 | small[lead + 1], r.misread_pairs)]
    for i in lead:  # garbled quotation marks
        for size in r.misread_sizes:
            sign = r.misread.get("".join(map(chr, cps[i : i + size])))
            if sign:
                types[i], signs[i], small[i] = r.types[ord(sign)], r.signs[ord(sign)], ord(sign)
                types[i + 1 : i + size], signs[i + 1 : i + size] = ZERO, 0
                symbols[i], symbols[i + 1 : i + size] = types[i], ZERO
                break

    _garbled_symbols(small, types, symbols)

    # quotation marks and brackets that stand where they can open or close
    at = np.flatnonzero(signs)
    sub = np.searchsorted(at, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(sub))
    sign = signs[at].astype(np.int64)
    before, after = _neighbours(types, at, offsets, owner)
    bracket = np.isin(small[at], _BRACKET_POINTS)
    solid_before = _mask(before, (UPPER, LOWER, DIGIT, SYM, CLOSE))
    can_open = bracket | ~solid_before & (~_mask(after, (WS, NL)) | (small[at] == 0xAB))
    can_close = bracket | ~_mask(after, (UPPER, LOWER, DIGIT, SYM)) & (before != NL)
    ahead = r.coming[run(r.ahead, np.where((sign > 1) & ~can_close, 0, sign), sub, reverse=True, chunk=chunk)]
    pair = r.opens[sign]
    opened = (pair >= 0) & can_open & (((ahead >> np.maximum(pair, 0)) & 1) > 0)
    sign = np.where((sign == 1) | opened | can_close & r.closes[sign].any(1), sign, 0)
    quote = run(r.quotes, sign, sub, chunk=chunk)
    wrong = (sign > 1) & ~r.inside[quote] & ~opened  # may only close here, must not open
    if wrong.any():
        sign = np.where(wrong, 0, sign)
        quote = run(r.quotes, sign, sub, chunk=chunk)
    then = r.quotes.table[quote, sign] if at.size else quote
    leaves_at = r.inside[quote] & ~r.inside[then] & (sign > 1)

    left = run(r.left, symbols, offsets, chunk=chunk)
    right = run(r.right, symbols, offsets, reverse=True, chunk=chunk)

    # the places where a sentence may end, and what stands around them
    spot_kinds = _mask(types, (DOT, MARK, WIDE, CLOSE, QUOTE, OPENQ, OPENB, NL))
    c = np.flatnonzero(spot_kinds | (types == WS) & (r.right_first[right] == THAI))
    text = np.searchsorted(offsets, c, side="right") - 1
    kinds, point = types[c], small[c]
    before, _ = _neighbours(types, c, offsets, text)
    last = np.searchsorted(at, c) - 1
    known = (last >= 0) & (last >= sub[text])
    inside = known & r.inside[then[np.maximum(last, 0)]] if at.size else np.zeros(c.size, bool)
    own = np.minimum(last + 1, max(at.size - 1, 0))
    leaves = (at[own] == c) & leaves_at[own] if at.size else np.zeros(c.size, bool)
    idle = ~((at[own] == c) & (sign[own] > 0)) if at.size else np.ones(c.size, bool)
    state = left[c]
    kind, spot = r.left_kind[state], r.left_place[state]
    gap, first = r.right_gap[right[c]], r.right_first[right[c]]
    capital = _mask(first, (UPPER, UPPER + 100))
    uncased = _mask(first, (OTHER, THAI, HAN, KANA, DEVA))
    fresh = gap & (capital | uncased | _mask(first, (SYM, OPENQ, QUOTE)))

    # a full stop
    listed = (spot == FIRST) & _mask(kind, (NUM, SINGLE, ROMAN1, ROMAN, LOW1)) | (spot == SECOND) & _mask(kind, (NUM, ROMAN, ROMAN1))
    initial = (kind == SINGLE) | (kind == LOW1) & ~r.left_number[state] | (kind == ROMAN1) & r.left_dot[state]
    held = listed | initial | (kind == NUM) & (first == UPPER + 100) | r.left_abbreviation[state]
    close_up = ~gap & (first == UPPER) & _mask(kind, (WORD, ROMAN, NUM, BULLET, DOTTED, MIXED)) & (before != UPPER)
    close_up |= ~gap & _mask(first, (OTHER, HAN, SYM)) & (kind == WORD) & ~_mask(before, (UPPER, DIGIT))
    ends = (kinds == DOT) & ~_mask(kind, (ENDED, DOTS)) & (before != DEVA) & (fresh | close_up | gap & (first == OPENB) & (kind == WORD)) & ~held
    ends |= ((kinds == DOT) & (kind == DOTS) | (point == 0x2026)) & (fresh | ~gap & capital)
    # exclamation and question marks
    asked = gap & ~_mask(first, (LOWER, MARK, DOT, NL)) | ~gap & (first == UPPER) & (before != UPPER)
    asked |= ~gap & (_mask(first, (HAN, OTHER, THAI, DEVA)) | (first == SYM) & _mask(before, (LOWER, SYM)))
    ends |= (kinds == MARK) & (point != 0x2026) & (kind != LINK) & asked
    # marks of scripts without capitals
    ends |= (kinds == WIDE) & ~_mask(first, (WIDE, MARK, CLOSE))
    ends &= ~inside
    # a closing mark after a final one
    final = _mask(before, (DOT, MARK, WIDE))
    for i in np.flatnonzero(leaves & (before == WS)):
        j = int(c[i]) - 1
        while j > 0 and types[j] in (WS, ZERO):
            j -= 1
        final[i] = types[j] in (DOT, MARK, WIDE)
    stray = ~inside & (kinds == CLOSE) & idle
    ends |= (leaves | stray) & final & (fresh | ~gap & (_mask(first, (HAN, OPENQ)) | (first == UPPER) & _mask(before, (DOT, MARK))))
    # a space between Thai words, and line breaks
    ends |= ~inside & (kinds == WS) & (before == THAI) & (first == THAI)
    ends |= kinds == NL

    stop = np.unique(np.concatenate([c[ends] + 1, offsets[1:][np.diff(offsets) > 0]]))
    start = np.concatenate([[0], stop[:-1]])
    solid = np.flatnonzero(~_mask(types, (WS, NL)))
    low = np.searchsorted(solid, start)
    high = np.searchsorted(solid, stop) - 1
    full = low <= high
    begin, end = solid[low[full]], solid[high[full]] + 1
    number = np.searchsorted(offsets, begin, side="right") - 1
    return number, begin - offsets[number], end - offsets[number]


def split_table(df: DataFrame, src: str, record: str, text: str) -> DataFrame:
    """``src, record_id, starts, ends``: one row per row of ``df`` with a sentence."""
    out = pa.schema([("src", pa.string()), ("record_id", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in slices(texts):
                number, begin, end = boundaries([t or "" for t in texts[low:high]])
                counts = np.bincount(number, minlength=high - low)
                cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                some = pa.array(counts > 0)
                columns = [pa.array([src] * (high - low)), ids.slice(low, high - low), pa.ListArray.from_arrays(cuts, pa.array(begin)), pa.ListArray.from_arrays(cuts, pa.array(end))]
                yield pa.RecordBatch.from_arrays(columns, schema=out).filter(some)

    rows = df.select(F.col(record).alias("record_id"), F.col(text).alias("value")).where(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    return rows.mapInArrow(split, "src string, record_id string, starts array<bigint>, ends array<bigint>")


def sentences(split: DataFrame) -> DataFrame:
    """One row per sentence; the copies of a record, which carry one text, count once."""
    once = split.groupBy("src", "record_id").agg(F.first(F.struct("starts", "ends")).alias("s"))
    return once.select("src", "record_id", F.posexplode(F.arrays_zip("s.starts", "s.ends"))).select(
        "src", "record_id", (F.col("pos") + 1).cast("bigint").alias("sent_no"), F.col("col.starts").alias("sent_start"), F.col("col.ends").alias("sent_end")
    )
