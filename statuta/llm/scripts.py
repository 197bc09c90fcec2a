"""Visually identical text with different characters: one form for all.

The scripts of a token's letters are intersected, with a look-alike counting for the
scripts of both its forms (resolved script sets). A token whose set is empty mixes
scripts and is a case even if nothing can be respelled; a token of one script that consists of look-alikes only, in a text of the
other script, is a whole-script confusable. Either is spelled in the script that all
its letters can be written in or that its neighbours use. Then the remaining forms
are normalised: full-width and presentation forms, decomposed accents and syllables,
ligatures, Roman numeral signs, spaces and hyphens that look like the plain ones, and
characters that aren't seen at all.

Not touched: what differs to the eye (superscripts, fractions, symbols), typographic
quotation marks and dashes, full-width punctuation beside East Asian text, joiners
inside Indic or Arabic words, and letters and marks in their own script. Null, empty
and blank texts are in the one form already (a blank text of odd spaces is a case).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.encoding import Model, repair, suspects
from statuta.llm.texts import points, slices

# Letters of other scripts and the Latin letters they look like. Letters with
# marks follow from their bases.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝҮүѵԌԚԜӀӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwYyvGQWIl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"))
ARMENIAN = dict(zip("օոսհՏՕցզռյԼՍ", "onuhSOgqnjLU"))
CHEROKEE = dict(zip("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃᎠᏀᎩᏂᏏᏧᎥ", "ABCEHJKLMPRSTVWZDGYhbdi"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ", "HIKMNOPCTYXocp"))
# Letters that pass for Latin ones only among Latin letters.
WEAK = dict(zip("αικρυτωγ", "aikputwy"))
#: Letters a word needs for a weak look-alike to count: shorter ones are formulas.
WEAK_LENGTH = 4
# Letters that look alike within the Latin script, and the letters meant.
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ſ": "s", "ǀ": "l", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴜ": "u", "ꜱ": "s", "ԁ": "d"}
# Letters of the languages, or of phonetic spelling, that use some of those as their own.
OWN_LETTERS = {"Ð": "ðþÞ", "Ɖ": "ɖɛɔŋ", "ı": "şŞğĞİə", "ɑ": "ʃʒəθðŋɔːˈ", "ɡ": "ʃʒəθðŋɔːˈ", "ɩ": "ɖɛɔŋ"}

INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x2800, 0x3000]
HYPHENS = {0x2010: "-", 0x2011: "-", 0x2212: "-", 0xFE63: "-", 0x2043: "-", 0x2215: "/", 0x2044: "/", 0x2024: ".", 0x2236: ":", 0xA789: ":", 0x37E: ";", 0x387: "·", 0x2CB: "`", 0x2BC: "’", 0x1FBF: "’", 0x2219: "·", 0x22C5: "·"}
HYPHENS = {k: v for k, v in HYPHENS.items() if k not in (0x2212, 0x2044, 0x2219, 0x22C5)}

_KEEP_COMPATIBILITY = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<noBreak>")
_EAST = re.compile("[぀-ヿ㐀-鿿가-힣]")
_WORD = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile(r"[IVXLCDM]+\Z")
_BRAILLE = re.compile("[\u2801-\u28ff]")


@lru_cache(maxsize=1)
def compatibility() -> dict[int, str]:
    """Forms that look like plain characters: full and half width, ligatures, presentation
    and mathematical letters, Roman numeral signs, radicals. From the character database."""
    out = {}
    for cp in (*range(0xA0, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)):
        ch = chr(cp)
        form = unicodedata.decomposition(ch)
        if cp in SPACES or 0xAC00 <= cp < 0xD7A4 or not form:
            continue
        if form[0] == "<":
            kind = form.split(" ", 1)[0]
            if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or 0xFB00 <= cp < 0xFB50 or 0x2160 <= cp < 0x2180 or 0x2F00 <= cp < 0x2FE0 or 0x1C4 <= cp < 0x1CD:
                out[cp] = unicodedata.normalize("NFKC", ch)
        elif 0xF900 <= cp < 0xFB00 or 0x2F800 <= cp or cp in (0x212A, 0x212B, 0x2126, 0x340, 0x341, 0x343, 0x344, 0x374):
            out[cp] = unicodedata.normalize("NFC", ch)
    for cp in (0xB5, 0x2B0):
        out.pop(cp, None)
    return out


@lru_cache(maxsize=1)
def _flags() -> np.ndarray:
    """Code points of the basic plane that may be a case."""
    flag = np.zeros(0x10000, bool)
    for cp in (*INVISIBLE, *SPACES, *HYPHENS, *range(0x300, 0x370), *range(0x1100, 0x1200), 0x3099, 0x309A, *range(0x400, 0x530), *range(0x370, 0x400), *range(0x530, 0x590), *range(0x13A0, 0x1400), *range(0x1C80, 0x1C90), *range(0x1F00, 0x2000), *range(0x2C80, 0x2D00), *range(0x2DE0, 0x2E00), *range(0xA4D0, 0xA500), *range(0xA640, 0xA6A0), *range(0xAB70, 0xABC0), *(ord(c) for c in LATIN), *(cp for cp in compatibility() if cp < 0x10000)):
        if cp < 0x10000:
            flag[cp] = True
    return flag


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    """The script of a letter, from its name in the character database; signs and letters
    used with every script are common."""
    name = unicodedata.name(ch, "COMMON").split(" ", 1)[0].split("-", 1)[0]
    return name.capitalize() if name in _NAMED else "other"


_TO_LATIN = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Lisu": LISU, "Coptic": COPTIC}
# Fixed value: letters so rare that nothing is spelled with them.
_RARE = frozenset("һԁԛԝҮүѵԌԚԜӀӏ")
_FROM_LATIN = {name: {v: k for k, v in reversed(list(pairs.items())) if k not in _RARE} for name, pairs in _TO_LATIN.items()}
#: Scripts whose letters are told apart within a word. East Asian ones stand beside Latin.
_NAMED = {"LATIN", *(name.upper() for name in _TO_LATIN), "GEORGIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "LAO", "KHMER", "MYANMAR", "ETHIOPIC", "MONGOLIAN", "TIBETAN", "GOTHIC", "RUNIC", "OGHAM", "TIFINAGH", "VAI", "DESERET", "OSAGE"}


@lru_cache(maxsize=None)
def _as_latin(ch: str) -> str | None:
    """The Latin letter a letter of another script looks like; marks are kept."""
    pairs = _TO_LATIN.get(script(ch))
    if pairs is None:
        return None
    base, *marks = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", pairs[base] + "".join(marks)) if base in pairs else None


@lru_cache(maxsize=None)
def _from_latin(ch: str, target: str) -> str | None:
    base, *marks = unicodedata.normalize("NFD", ch)
    there = _FROM_LATIN.get(target, {}).get(base)
    out = there and unicodedata.normalize("NFC", there + "".join(marks))
    return out if out and len(out) == 1 else None


@lru_cache(maxsize=None)
def resolved(ch: str) -> frozenset[str]:
    """The scripts a letter, or a letter that looks just like it, belongs to."""
    own = script(ch)
    latin = ch if own == "Latin" else _as_latin(ch)
    if latin is None:
        return frozenset((own,))
    return frozenset({own, "Latin", *(name for name in _FROM_LATIN if _from_latin(latin, name))})


def _spell(word: str, target: str) -> str:
    """The word with every look-alike written in the target script."""
    out = []
    for ch in word:
        own = script(ch)
        if own != target and own != "other":
            latin = ch if own == "Latin" else _as_latin(ch)
            if latin is not None:
                ch = latin if target == "Latin" else _from_latin(latin, target) or ch
            elif target == "Latin" and len(word) >= WEAK_LENGTH:
                ch = WEAK.get(ch, ch)
        out.append(ch)
    return "".join(out)


def consistent(text: str) -> tuple[str, bool]:
    """Mixed and whole-script confusables in their consistent spelling, and whether a word
    mixes scripts that no spelling makes one. Greek letters among Latin ones are symbols
    unless they look alike."""
    words = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    certain_of: Counter = Counter()
    own_of: Counter = Counter()
    mixed = False
    sets = []
    present = {script(ch) for _, word in words for ch in word} - {"other"}
    for _, word in words:
        scripts = {script(ch) for ch in word} - {"other"}
        whole = frozenset.intersection(*[resolved(ch) for ch in word if script(ch) != "other"]) if scripts else frozenset()
        sets.append((scripts, whole))
        for ch in word:
            if _certain(ch, present) and not (len(scripts) > 1 and ch in WEAK):
                certain_of[script(ch)] += 1
            own_of[script(ch)] += 1
        mixed |= len(scripts) > 1 or bool(scripts & set(_TO_LATIN))
    if not mixed:
        return text, False
    del own_of["other"]
    used = certain_of or own_of  # without a certain letter the script most are written in
    main = max(used, key=lambda k: (used[k], k)) if used else "Latin"
    spelled = {word.lower() for _, word in words}
    out, at, stuck = [], 0, False
    for (start, word), (scripts, whole) in zip(words, sets):
        target = None
        if len(scripts) > 1:
            if whole:
                target = main if main in whole else "Latin" if "Latin" in whole else sorted(whole)[0]
            else:  # letters of several scripts that can't all be one: each look-alike follows the certain letters
                certain = [script(ch) for ch in word if _certain(ch, scripts) and ch not in WEAK]
                own = Counter(script(ch) for ch in word)
                target = max(set(certain), key=lambda k: (certain.count(k), k)) if certain else main
                if target == "Greek" and own["Latin"] > own["Greek"]:
                    target = "Latin"
                left = {script(ch) for ch in _spell(word, target)} - {"other"}
                stuck |= len(left) > 1 and "Greek" not in left
        elif scripts and main not in scripts and main in whole and (scripts != {"Latin"} or _meant(word, main, spelled)):
            target = main
        if target:
            out += [text[at:start], _spell(word, target)]
            at = start + len(word)
    return "".join(out) + text[at:], stuck


def _certain(ch: str, scripts: set[str]) -> bool:
    """Whether a letter can be written in one of the scripts only, its own."""
    return script(ch) != "other" and resolved(ch) & scripts == {script(ch)}


def _meant(word: str, main: str, spelled: set[str]) -> bool:
    """Whether a Latin word of look-alikes in a text of another script stands for a word of
    that script: Roman numerals don't, small and single letters do, words with capitals
    (mostly names and codes) if the text has the word in its own script too."""
    if _ROMAN.match(word):
        return False
    return word.islower() or len(word) == 1 or _spell(word, main).lower() in spelled


def _spaced(ch: str) -> bool:
    return bool(ch) and unicodedata.category(ch) in ("So", "Sk", "Sm")


def normalize(text: str) -> str:
    """The one form in which equal-looking texts are equal."""
    return _one_form(text)[0]


def _one_form(text: str) -> tuple[str, bool]:
    if text.isascii():
        return text, False
    east = bool(_EAST.search(text))
    plain, before = [], ""
    table = compatibility()
    for i, ch in enumerate(text):
        cp = ord(ch)
        if cp in _INVISIBLE:
            after = text[i + 1] if i + 1 < len(text) else ""
            joins = cp in (0x200C, 0x200D) and before and _joins(before) and after and _joins(after)
            pictures = _spaced(before) and (0xFE00 <= cp < 0xFE10 or cp == 0x200D and _spaced(after)) or before == "\U0001f3f4" and 0xE0000 < cp < 0xE0080
            if joins or pictures:
                plain.append(ch)
            continue
        if cp == 0x2800 and _BRAILLE.search(text):
            pass
        elif cp in _SPACES and not (cp == 0x3000 and east):
            ch = " "
        elif cp in table and not (0xFF00 <= cp < 0xFFE0 and east and not (0xFF10 <= cp < 0xFF1A or 0xFF21 <= cp < 0xFF3B or 0xFF41 <= cp < 0xFF5B or 0xFF66 <= cp < 0xFFA0)):
            ch = table[cp]
        elif cp in HYPHENS:
            ch = HYPHENS[cp]
        elif ch in LATIN and not any(c in text for c in OWN_LETTERS.get(ch, "")):
            ch = LATIN[ch]
        plain.append(ch)
        before = ch
    out, stuck = consistent(unicodedata.normalize("NFC", "".join(plain)))
    return unicodedata.normalize("NFC", out), stuck


_INVISIBLE, _SPACES = frozenset(INVISIBLE), frozenset(SPACES)


def _joins(ch: str) -> bool:
    return 0x600 <= ord(ch) < 0x780 or 0x900 <= ord(ch) < 0xE00


def disguised(text: str) -> bool:
    """Whether a text holds a character that stands for an equal-looking one or isn't
    seen, or a word of scripts that don't go together. Canonical order within Indic
    syllables and the like is no disguise."""
    form, stuck = _one_form(text)
    return stuck or form != text and form != unicodedata.normalize("NFC", text) or _decomposed(text)


def _decomposed(text: str) -> bool:
    return any(0x300 <= ord(c) < 0x370 or 0x1100 <= ord(c) < 0x1200 or c in "゙゚" for c in text) and unicodedata.normalize("NFC", text) != text


def candidates(values: list[str]) -> np.ndarray:
    """Which texts hold any character that may be a case."""
    flag = _flags()
    cps, offsets = points(values)
    out = np.zeros(len(values), bool)
    hit = np.flatnonzero(np.where(cps < 0x10000, flag[np.minimum(cps, 0xFFFF)], (cps >= 0x1D400) & (cps < 0x1D800) | (cps >= 0x2F800) & (cps < 0x2FA20) | (cps >= 0xE0000) & (cps < 0xE0200)))
    out[np.unique(np.searchsorted(offsets, hit, side="right") - 1)] = True
    return out


def examine(df: DataFrame, src: str, record: str, text: str, model: Model, everything: bool = False) -> DataFrame:
    """``src, record_id, disguised, content``: the disguised rows of ``df`` (all rows with
    ``everything``) in the one form. Garbled records (see ``encoding``) are no case; with
    ``everything`` they come with their text restored first."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("src", pa.string()), ("record_id", pa.string()), ("disguised", pa.bool_()), ("content", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), [v or "" for v in batch.column(1).to_pylist()]
            rows = []
            for low, high in slices(values):
                part = values[low:high]
                maybe = candidates(part)
                doubt = suspects(part, known)
                for i in range(len(part)) if everything else np.flatnonzero(maybe):
                    value = part[i]
                    case = bool(maybe[i]) and disguised(value)
                    if (case or everything) and doubt[i]:
                        garbled, _, fixed = repair(value, known, find_only=not everything)
                        case &= not garbled
                        value = fixed if garbled else value
                    if case or everything:
                        rows.append((ids[low + i], case, normalize(value) if maybe[i] or value is not part[i] else value))
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([src] * len(a)), pa.array(a), pa.array(b), pa.array(c, pa.string())], schema=out)

    rows = df.select(F.col(record).alias("record_id"), F.col(text).alias("value")).where(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    return rows.mapInArrow(look, "src string, record_id string, disguised boolean, content string")
