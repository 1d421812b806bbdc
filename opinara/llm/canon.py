"""One consistent form of text: confusables skeletons, and the words of a text as they look."""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

from pyspark.sql import SparkSession

#: Prototypes that differ from the ones the table gives, as these letters stand for l in Latin words.
OWN_PROTOTYPES = {"ӏ": "l", "Ӏ": "I", "І": "I", "Ι": "I", "κ": "k", "к": "k"}
#: Compatible variants that are ordinary in print (ordinals, squares, fractions).
ORDINARY_VARIANTS = "ªº¹²³¼½¾"
#: Latin blocks whose look-alikes of plain letters are never ordinary spelling (phonetic letters).
PHONETIC = ("ɐ", "ʯ"), ("ᴀ", "ᶿ")
TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
EMOJI = "‍︎️⃣"


@lru_cache(maxsize=1)
def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter -> Latin letters or digits that it looks like, for letters beyond ASCII, of other scripts or phonetic, whose look is plain ASCII.

    The table comes from the Unicode confusables data in the ICU library that Spark itself ships; it is read on the
    driver, by one call, and goes to the tasks within their closure (some hundred entries, fixed by Unicode).
    """
    letters = [c for c in map(chr, range(0x80, 0x20000)) if U.category(c)[0] == "L" and U.category(c) != "Lo" or c in OWN_PROTOTYPES]
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = icu.getSkeleton("\n".join(letters)).split("\n")
    table = {}
    for c, look in zip(letters, looks, strict=True):
        ordinary = U.name(c, "").startswith("LATIN") and not any(a <= c <= b for a, b in PHONETIC)
        if look.isascii() and look.isalnum() and not ordinary and U.normalize("NFKC", c) == c:
            look = {"rn": "m", "vv": "w"}.get(look, look)
            table[c] = "I" if look == "l" and c.isupper() else look
    return table | OWN_PROTOTYPES


@lru_cache(maxsize=1)
def prototypes(spark: SparkSession) -> dict[str, str]:
    """Character -> what it looks like: letters, digits, punctuation and symbols of every script, plain ASCII ones too.

    The whole table of the confusables data in the ICU library that Spark ships (some thousand entries, fixed by
    Unicode): a prototype may be several characters (m looks like rn), and 1, l, I and | have one in common.
    """
    chars = [c for c in map(chr, [*range(0x21, 0xD800), *range(0xF900, 0x20000)]) if U.category(c)[0] in "LNPS"]
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = icu.getSkeleton("\n".join(chars)).split("\n")
    return {c: look for c, look in zip(chars, looks, strict=True) if look != U.normalize("NFD", c)}


def is_variant(c: str) -> bool:
    """A compatible variant of letters or digits: wide, mathematical, circled, ligatures."""
    if c in ORDINARY_VARIANTS or not U.decomposition(c).startswith("<"):
        return False
    plain = U.normalize("NFKC", c)
    return plain.isalnum() and any(x.isascii() or U.category(x)[0] in "LN" for x in plain)


def is_invisible(c: str) -> bool:
    return U.category(c) == "Cf" or c in "ᅟᅠ឴឵ㅤﾠ͏᠋᠌᠍"


def is_odd_space(c: str) -> bool:
    return c not in " \t\n\r\x0b\x0c\x85" and U.category(c) in ("Zs", "Zl", "Zp")


def is_accent(c: str) -> bool:
    return U.category(c) in ("Mn", "Me") and c not in EMOJI and not "︀" <= c <= "️" and not "\U000e0100" <= c <= "\U000e01ef"


_EMOJI_PARTS = dict.fromkeys(map(ord, EMOJI[:3]), "")


class Skeleton:
    """Skeletons of texts under a look-alike table.

    ``of`` decomposes, replaces every character by its prototype (variants by what they are compatible with, odd
    spaces by a space, invisible characters by nothing, look-alike letters by the Latin ones) and decomposes again.
    A look-alike letter is replaced inside words that have Latin letters; a word wholly in another script stays.
    ``odd`` tells whether a text has a character that looks like ordinary text without being its ordinary form: it isn't
    its own skeleton composed again (joined emoji and words wholly in another script are), or has an accent by itself
    that composes with nothing.
    """

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        blocks = (0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0xE0000, 0xE01F0)
        self.single: dict[str, str] = {}
        sure, maybe = [], []
        for c in (chr(x) for a, b in blocks for x in range(a, b)):
            if is_invisible(c):
                (maybe if c in EMOJI else sure).append(c)
                self.single[c] = ""
            elif is_odd_space(c):
                sure.append(c)
                self.single[c] = " "
            elif is_variant(c):
                sure.append(c)
                self.single[c] = U.normalize("NFKC", c)
            elif is_accent(c):
                sure.append(c)
            elif c in table:
                if any(a <= c <= b for a, b in PHONETIC):
                    sure.append(c)
                    self.single[c] = table[c]
                else:
                    maybe.append(c)
        self.sure, self.maybe, self.accents = frozenset(sure), frozenset(maybe), frozenset(filter(is_accent, sure))
        self.replace = {ord(c): self.single[c] for c in sure if c in self.single}
        # letters of other scripts that Unicode never composes are ordinary; characters with one equal aren't
        self.whole = {x: U.normalize("NFC", chr(x)) for a, b in blocks for x in range(a, b) if re.match("[^<]+ ", U.decomposition(chr(x))) and U.normalize("NFC", chr(x)) != chr(x)}
        self.word = re.compile(r"[^\W\d_]+(?:[​-‏⁠-⁤­﻿᠎̀-ͯ]+[^\W\d_]+)*")
        self.latin = re.compile(r"[A-Za-zÀ-ɏḀ-ỿＡ-Ｚａ-ｚ\U0001d400-\U0001d7ff]")

    def _emoji_join(self, text: str, at: int) -> bool:
        """The joiner at this place holds an emoji together."""
        left = text[:at].rstrip("︎️\U0001f3fb\U0001f3fc\U0001f3fd\U0001f3fe\U0001f3ff")[-1:]
        right = text[at + 1 : at + 2]
        return bool(left and right) and U.category(left) in ("So", "Sk") and U.category(right) in ("So", "Sk")

    def odd(self, text: str | None, skeleton: str | None = None) -> bool:
        """skeleton: that of the text, where it is known."""
        if not text or text.isascii():
            return False
        form = U.normalize("NFC", self.of(text) if skeleton is None else skeleton)
        return form != text and form != text.translate(self.whole) or not self.accents.isdisjoint(text)

    def _word(self, m: re.Match) -> str:
        w = m[0]
        return "".join(self.table.get(c, c) for c in w) if self.latin.search(w) else w

    def looks(self, text: str | None, prototypes: dict[int, str]) -> str | None:
        """The skeleton under a whole table of prototypes, by which all texts that look alike are equal, also in words wholly of look-alikes.

        Decomposed, invisible characters gone, odd spaces and variants replaced, every character by its prototype,
        decomposed again. It is for comparison only: a plain text needn't be its own skeleton.
        """
        if text is None:
            return None
        out = U.normalize("NFD", text)
        if not out.isascii():
            out = out.translate(self.replace).translate(_EMOJI_PARTS)
        return U.normalize("NFD", out.translate(prototypes))

    def of(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return text
        out = U.normalize("NFC", text)
        chars = set(out)
        if not (self.sure.isdisjoint(chars) and self.maybe.isdisjoint(chars)):
            if "‍" in out:
                out = "".join(c for i, c in enumerate(out) if c != "‍" or self._emoji_join(out, i))
            out = out.translate(self.replace)
            out = self.word.sub(self._word, out)
        return U.normalize("NFD", out)


class Folder(dict):
    """Translation table that takes text to what matters when it is compared as it looks.

    Letter case, accents, invisible characters and variants vanish, look-alike letters become Latin, everything
    but letters and digits becomes a space.  Filled as characters are met.
    """

    def __init__(self, table: dict[str, str]) -> None:
        super().__init__()
        self.table = table
        folds = [self[i] for i in range(256)]
        # texts of the first 256 characters fold byte by byte, but for those whose fold isn't one byte
        self.bytes = bytes(ord(f) if len(f) == 1 and f.isascii() else 32 for f in folds)
        self.gone = bytes(i for i, f in enumerate(folds) if not f)
        self.slow = re.compile(b"[" + b"".join(re.escape(bytes([i])) for i, f in enumerate(folds) if f and not (len(f) == 1 and f.isascii())) + b"]")

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if is_invisible(c) or U.category(c)[0] == "M" or c == "·":
            out = ""
        else:
            plain = "".join(x for x in U.normalize("NFKD", self.table.get(c, c)) if U.category(x)[0] != "M")
            plain = "".join(self.table.get(x, x) for x in plain).casefold()
            out = "".join(x if x.isalnum() else " " for x in plain)
        self[point] = out
        return out

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<" in text:
            text = TAG.sub(" ", text)
        try:
            raw = text.replace("€", " ").encode("latin-1")
        except UnicodeEncodeError:
            return text.translate(self).split()
        if self.slow.search(raw):
            return text.translate(self).split()
        return raw.translate(self.bytes, self.gone).decode("ascii").split()


_made: dict[tuple[type, frozenset], object] = {}


def _worker(kind: type, table: dict[str, str]):
    """The worker's one object of this kind for this table."""
    key = kind, frozenset(table.items())
    if key not in _made:
        _made[key] = kind(table)
    return _made[key]


def folder(table: dict[str, str]) -> Folder:
    return _worker(Folder, table)


def skeleton(table: dict[str, str]) -> Skeleton:
    return _worker(Skeleton, table)
