"""Look-alike folding of one text: the mapping used by the look-alike operator and by every comparison of texts.

``fold(text)`` undoes width, style and ligature variants of letters, composes split accents, drops invisible
characters inside words, turns every Unicode space into the ordinary one, and replaces letters of other scripts that
stand in for Latin ones. Accents, quotes, dashes, words really written in another script, and the joiners a script or an
emoji needs stay as they are.

Variants come from the Unicode database (decompositions and names), look-alikes from the public Unicode confusables as
they lie in Spark's own ICU library. Letters that are nearly always used that way (``LOOKALIKE``) are replaced in words
of such letters alone too; any other confusable one only in a word part that is Latin for the greater part.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata as ud
import zipfile
from pathlib import Path

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԚԜҮаеорсухѕіјԛԝһԁѵ", "ABEKMHOPCTYXSIJQWYaeopcyxsijqwhdv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
LOOKALIKE = CYRILLIC | GREEK
#: Blocks of other scripts with letters like Latin ones: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
SCRIPTS = ((0x0370, 0x0400), (0x0400, 0x0530), (0x0531, 0x0590), (0x13A0, 0x1400), (0x2C80, 0x2D00), (0xA4D0, 0xA500), (0xAB70, 0xABC0))


def _prototypes() -> dict[str, str]:
    """Character -> prototype of the Unicode confusables in Spark's ICU library; empty where it isn't installed.

    The file has a header of its own length, then offset and length of three tables in 32-bit numbers: keys (code point
    and length of the value), values (one UTF-16 unit or an offset) and the UTF-16 string that longer values point into.
    """
    import pyspark

    homes = [Path(pyspark.__file__).parent, *(Path(h) for h in [os.environ.get("SPARK_HOME")] if h)]
    for jar in (j for h in homes for j in sorted(h.glob("jars/icu4j-*.jar"))):
        with zipfile.ZipFile(jar) as z:
            data = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
        data = data[struct.unpack_from(">H", data)[0] :]
        keys, n_keys, values, n_values, strings, n_strings = struct.unpack_from(">6i", data, 12)
        text = data[strings : strings + 2 * n_strings]
        out = {}
        for k, v in zip(struct.unpack_from(f">{n_keys}I", data, keys), struct.unpack_from(f">{n_values}H", data, values)):
            length = (k >> 24) + 1
            out[chr(k & 0xFFFFFF)] = chr(v) if length == 1 else text[2 * v : 2 * (v + length)].decode("utf-16-be", "surrogatepass")
        return out
    return {}


def _confusable() -> dict[str, str]:
    """Letters of ``SCRIPTS`` with the prototype of a basic Latin letter, of the same case where there is a choice."""
    proto = _prototypes()
    latin: dict[str, list[str]] = {}
    for c in map(chr, [*range(65, 91), *range(97, 123)]):
        latin.setdefault(proto.get(c, c), []).append(c)
    out = {}
    for c in (chr(o) for lo, hi in SCRIPTS for o in range(lo, hi)):
        twins = latin.get(proto.get(c, ""), [])
        if twins and c.isalpha():
            out[c] = next((t for t in twins if t.isupper() == c.isupper()), twins[0])
    return out | LOOKALIKE


CONFUSABLE = _confusable()

INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

_DROP = {ord(c): None for c in INVISIBLE if c not in "\u200c\u200d"}
_SPACE = {ord(c): " " for c in SPACES}
_BLANKS = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a-\u202f\u2060-\u2069\ufeff\u00a0\u1680\u2000-\u200a\u205f\u3000]")


def _variants() -> dict[int, str]:
    """Letters and digits whose compatibility form is a plain letter or digit: wide, narrow, font, ligature and enclosed forms, and small capitals.

    Derived from the Unicode database; numbers in circles, superscript and fraction signs are signs of their own and stay.
    """
    table = {}
    for lo, hi in ((0x2100, 0x2150), (0x2160, 0x2180), (0xFB00, 0xFB07), (0xFF00, 0xFFF0), (0x1D400, 0x1D800), (0x0132, 0x0134), (0x013F, 0x0141), (0x01C4, 0x01CD), (0x01F1, 0x01F4)):
        for o in range(lo, hi):
            c = chr(o)
            kind = ud.decomposition(c).split(" ")[0]
            plain = ud.normalize("NFKC", c)
            if kind in ("<wide>", "<narrow>", "<font>", "<compat>") and plain != c and all(x.isalnum() for x in plain):
                table[o] = plain
            elif kind in ("<wide>",) and plain != c and plain.isascii():
                table[o] = plain
    for lo, hi in ((0x24B6, 0x24EA), (0x1F130, 0x1F14A)):  # letters in circles and squares
        table |= {o: ud.normalize("NFKC", chr(o)) for o in range(lo, hi)}
    for o in (*range(0x0250, 0x02B0), *range(0x1D00, 0x1D26)):
        name = ud.name(chr(o), "").removeprefix("LATIN LETTER SMALL CAPITAL ")
        if len(name) == 1:
            table[o] = name.lower()
    return table


VARIANT = _variants()
_VARIANT_WORD = re.compile("[\u0132\u0133\u013f\u0140\u01c4-\u01cc\u01f1-\u01f3\u0250-\u02af\u1d00-\u1d25\u2100-\u217f\u24b6-\u24e9\ufb00-\ufb06\uff00-\uffef\U0001d400-\U0001d7ff\U0001f130-\U0001f149]")
_JOINER = re.compile("[\u200c\u200d]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_FOREIGN = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi - 1)}" for lo, hi in SCRIPTS) + "]")
_PART = re.compile("(['’-])")
_SPLIT = re.compile("[̀-ͯ]")
# Scripts whose writing needs joiners: Arabic, Syriac, Indic blocks, Mongolian.
_NEEDS = re.compile("[؀-ࣿऀ-෿က-႟ក-᢯ﭐ-﷿ﹰ-﻿]")
#: One character class for the JVM: only texts that match it can change under ``fold``.
SUSPECT = (
    "[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180e\\u200b-\\u200f\\u202a-\\u202f\\u2060-\\u2069\\ufeff"
    "\\u00a0\\u1680\\u2000-\\u200a\\u205f\\u3000\\u0300-\\u036f\\u0370-\\u03ff\\u0400-\\u052f"
    "\\u0132\\u0133\\u013f\\u0140\\u01c4-\\u01cc\\u01f1-\\u01f3\\u0250-\\u02af\\u0531-\\u058f\\u13a0-\\u13ff\\u1d00-\\u1d25\\u2100-\\u217f\\u24b6-\\u24e9\\u2c80-\\u2cff"
    "\\ua4d0-\\ua4ff\\uab70-\\uabbf\\ufb00-\\ufb06\\uff01-\\uffef\\x{1d400}-\\x{1d7ff}\U0001f130-\U0001f149]"
)


def _emoji(c: str) -> bool:
    o = ord(c)
    return o >= 0x1F000 or 0x2190 <= o <= 0x2BFF or o in (0xFE0F, 0x20E3) or 0x1F3FB <= o <= 0x1F3FF


def _joiners(text: str) -> str:
    """Drop ZWJ and ZWNJ unless the script on both sides needs them or they tie an emoji together."""
    out, last = [], len(text) - 1
    for i, c in enumerate(text):
        if c in "\u200c\u200d":
            before, after = (text[i - 1] if i else " "), (text[i + 1] if i < last else " ")
            if not (_NEEDS.match(before) and _NEEDS.match(after) or c == "\u200d" and _emoji(before) and _emoji(after)):
                continue
        out.append(c)
    return "".join(out)


def _script(word: str) -> str:
    """'twin': nothing but letters of ``LOOKALIKE``; 'latin': with Latin letters, and a Latin word for the greater part; else 'other'."""
    latin = usual = unusual = foreign = 0
    for c in word:
        if c in LOOKALIKE:
            usual += 1
        elif c in CONFUSABLE:
            unusual += 1
        elif _FOREIGN.match(c):
            foreign += 1
        elif c.isalpha():
            latin += 1
    if latin and (latin > unusual + foreign or not foreign and latin + usual > unusual):
        return "latin"
    return "other" if unusual or foreign or latin else "twin"


_MAP = {ord(k): v for k, v in LOOKALIKE.items()}
_MAP_ALL = {ord(k): v for k, v in CONFUSABLE.items()}


def _latin(word: str) -> str:
    """A Latin word with its look-alikes replaced, the less usual ones only in parts with twice as many other letters."""
    if not any(c in CONFUSABLE and c not in LOOKALIKE for c in word):
        return word.translate(_MAP)
    out = []
    for part in _PART.split(word):
        unusual = sum(c in CONFUSABLE and c not in LOOKALIKE for c in part)
        others = sum(map(str.isalpha, part)) - unusual
        out.append(part.translate(_MAP_ALL if others >= max(2, 2 * unusual) else _MAP))
    return "".join(out)


def _twins(text: str) -> str:
    """Map look-alike letters: in words that hold Latin letters too, and in words of look-alikes only unless a neighbour is really written in that script."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    if not words:
        return text
    kinds = ["latin" if w.isascii() else _script(w) for _, _, w in words]
    out, at = [], 0
    for i, (a, b, w) in enumerate(words):
        if w.isascii() or kinds[i] == "other" or kinds[i] == "twin" and "other" in kinds[max(0, i - 1) : i + 2]:
            continue
        new = _latin(w) if kinds[i] == "latin" else w.translate(_MAP)
        if new != w:
            out.append(text[at:a])
            out.append(new)
            at = b
    out.append(text[at:])
    return "".join(out)


def fold(text: str | None) -> str | None:
    """The consistent form of ``text``; ``None`` stays ``None``, ASCII text is returned as it is."""
    if text is None or text.isascii():
        return text
    if _JOINER.search(text):
        text = _joiners(text)
    if _BLANKS.search(text):
        text = text.translate(_DROP).translate(_SPACE)
    if _SPLIT.search(text):
        text = ud.normalize("NFC", text)
    if _VARIANT_WORD.search(text):
        text = text.translate(VARIANT)
    if _FOREIGN.search(text):
        text = _twins(text)
    if _SPLIT.search(text):
        text = ud.normalize("NFC", text)
    return text


_UNLETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Letters only, folded and without case: the key under which two lines count as the same line."""
    if not text:
        return ""
    if text.isascii():
        return _UNLETTER.sub("", text.lower())
    text = ud.normalize("NFC", fold(text))
    return "".join(c for c in ud.normalize("NFC", text.casefold()) if c.isalpha())
