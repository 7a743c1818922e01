"""Normalised words of damaged and reformatted texts."""

from __future__ import annotations

import html
import re
import unicodedata

#: UTF-8 bytes read as Latin-1 or Windows-1252: a lead byte's character and the characters of one to three more bytes.
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_MARKUP = re.compile(r"<[^<>\n]{0,80}>")
_COMBINING = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")


def _repair(m: re.Match[str]) -> str:
    s = m.group(0)
    for n in range(len(s), 1, -1):
        for encoding in ("latin-1", "cp1252"):
            try:
                return s[:n].encode(encoding).decode("utf-8") + s[n:]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return s


def repair(text: str) -> str:
    """The text with entities and markup resolved and wrongly decoded characters restored."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        for _ in range(2):  # some texts were damaged twice
            again = _MOJIBAKE.sub(_repair, text)
            if again == text:
                break
            text = again
    return text


def words(text: str) -> list[str]:
    """Words of letters and digits without case, accents, markup, hyphenation at line ends and encoding damage."""
    text = repair(text)
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return _WORDS.findall(text.lower())


_PIECE = re.compile(r"[^ \t\r\n]+")


def located(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, and where each begins and ends in it.

    Words are those of ``words`` but for entities and damaged characters that
    hold blanks; several words of one blank-separated piece have the piece's
    place.
    """
    bare = _MARKUP.sub(lambda m: " " * len(m.group(0)), text) if "<" in text else text
    out: list[str] = []
    where: list[tuple[int, int]] = []
    begin, held = -1, ""
    for m in _PIECE.finditer(bare):
        piece = held + m.group(0)
        start = begin if held else m.start()
        tail = bare[m.end() : m.end() + 64]
        blank = tail[: len(tail) - len(tail.lstrip(" \t\r\n"))]
        if piece.endswith("-") and len(piece) > 1 and piece[-2].isalpha() and "\n" in blank and tail[len(blank) : len(blank) + 1].isalpha():
            held, begin = piece[:-1], start
            continue
        held = ""
        for w in words(piece):
            out.append(w)
            where.append((start, m.end()))
    return out, where
