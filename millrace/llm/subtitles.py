"""What subtitle files say: encodings repaired, cues told apart, sounds and adverts left out."""

from __future__ import annotations

import re

# Letters beyond ASCII that common languages write, and marks that subtitles use. The texts at hand add theirs.
_LETTERS = "àâäáãåçèéêëíîïñóôöõòùúûüßœæąćęłńśźżабвгдежзийклмнопрстуфхцчшщъыьэюяё"
_MARKS = "﻿♪♫¿¡«»“”„‘’–—…№€°·"
_BEYOND = re.compile(r"[\w\u0080-\U0010ffff]*[^\x00-\x7f][\w\u0080-\U0010ffff]*")
_MISPLACED_CAPITAL = re.compile(r"[À-ÝŁŚŻĄĘĆŃŹ](?<=[a-z].)")
#: A capital with an accent after a small letter: usual letters in an unusual place.
_MISPLACED = re.compile("[a-z][À-ÝŁŚŻĄĘĆŃŹА-ЯЁ]|[а-яё][a-z]|[a-z][а-яё]")
# Fixed values: (encoding a file was read in, encoding it was written in).
_MISREADINGS = (("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1251", "utf-8"), ("cp1252", "koi8-r"))


def _to_bytes(codec: str) -> dict[int, str]:
    """Each character that ``codec`` reads from a byte -> that byte; bytes without a character stand for themselves."""
    table = {}
    for b in range(128, 256):
        table[b] = chr(b)
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    return table


_BACK = {wrong: _to_bytes(wrong) for wrong, _ in _MISREADINGS}


class Alphabet:
    """What letters are usual, so that a text read in a wrong encoding can be told: those of common languages and ``letters``, as sample texts hold them."""

    def __init__(self, letters: str = ""):
        own = _LETTERS + "".join(sorted({x for c in letters if c.isalpha() and not c.isascii() for x in c.lower() + c.upper()}))
        self.usual = frozenset(own + own.upper() + "ẞ" + _MARKS + "".join(map(chr, range(128))))
        self.unusual = re.compile("[^" + re.escape("".join(sorted(self.usual))) + "]")

    def __reduce__(self):
        return Alphabet, ("".join(sorted(c for c in self.usual if c.isalpha() and not c.isascii())),)

    def oddness(self, text: str) -> int:
        """The number of characters that aren't usual, or not in such places."""
        return sum(map(text.count, set(text) - self.usual)) + 4 * text.count("�") + len(_MISPLACED.findall(text))

    def repair(self, text: str) -> str:
        """``text`` as it was written, if it was read in a wrong encoding; the reading with the fewest odd characters wins, none if no reading is much better."""
        if text.isascii() or not (self.unusual.search(text) or _MISPLACED_CAPITAL.search(text)):
            return text
        body = text.lstrip("﻿")
        # a reading is judged by the words that aren't plain ASCII: the others are the same in every reading
        sample = " ".join(_BEYOND.findall(body))
        best, least = None, self.oddness(sample)
        for wrong, right in _MISREADINGS:
            read = _read_again(sample, wrong, right)
            if read is None:
                continue
            odd = self.oddness(read) + read.count("?")
            if odd < least * 0.7:
                best, least = (wrong, right), odd
                if odd * 20 < len(read):
                    break
        return (best and _read_again(body, *best)) or text


def _read_again(text: str, wrong: str, right: str) -> str | None:
    try:
        return text.translate(_BACK[wrong]).encode("latin-1", "replace").decode(right, "replace" if right == "utf-8" else "strict")
    except UnicodeDecodeError:
        return None


_FRAMES = re.compile(r"^﻿?\{\d*\}\{\d*\}", re.M)
_TAGS = re.compile(r"</?\w[^<>\n]{0,60}>|\{\\[^{}\n]{0,40}\}")
_BROKEN = re.compile(r"(?<=\w)-\n[ \t]*(?=\w)")
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|♪[^♪]*(?:♪|\Z)|(?<!\w)\*[^*]+\*")
# How credits begin, and top-level names of web addresses.
_CREDITS = ("subtitles by", "sync and corrections", "synced by", "translated by")
_TOP = "com|net|org|info|biz|tv|io|example|invalid|test"
#: A known top-level name, or a dot inside a word, where prose would have a space or a capital; or letters set apart after one.
_HOST = re.compile(rf"\.(?:(?<=\w\w\.)[a-z]{{2}}|\s?(?i:{_TOP})\b)")
_MAYBE_HOST = re.compile(rf"{_HOST.pattern}|\.\s\w\s\w\b")
_SPACED = re.compile(r"(?<!\S)(\S)\s(?=\S)")
_FRAMED = re.compile(r"\s*(?:~.*\bteam\b|-=.*=-)", re.S)
_LETTER = re.compile(r"[^\W\d_]")


def _signs(low: str) -> bool:
    return "://" in low or "www" in low or "@" in low


def is_advert(cue: str) -> bool:
    """A cue that names a web address, also with its letters set apart, or is a credit."""
    low = cue.lower()
    if low.startswith(_CREDITS) or (low[:1] in "~-" and _FRAMED.match(low)) or _signs(low):
        return True
    return bool(_MAYBE_HOST.search(cue)) and bool(_HOST.search(cue) or _HOST.search(_SPACED.sub(r"\1", cue)))


def _timed(lines: list[str]) -> list[str]:
    """What stands after each ``-->`` line, without the number above the next one."""
    parts: list[str] = []
    now: list[str] | None = None
    for line in lines:
        if "-->" in line:
            if now:
                if now[-1].strip().isdigit():
                    now.pop()
                parts.append("\n".join(now))
            now = []
        elif now is not None and line:
            now.append(line)
    if now:
        parts.append("\n".join(now))
    return parts


def cues(text: str) -> list[str]:
    """The spoken cues of a subtitle file in text order; sounds, adverts, numbers and times are left out.

    Times may stand as ``-->`` lines or as ``{from}{to}`` frames; a text with neither has a cue on each line.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text or "{\\" in text:
        text = _TAGS.sub("", text)
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    if "-->" in text:
        parts = _timed(text.split("\n"))
    elif _FRAMES.search(text):
        parts = _FRAMES.split(text)[1:]
        if "|" in text:
            parts = [_BROKEN.sub("", p.replace("|", "\n")) for p in parts]
    else:
        parts = text.split("\n")
    low = text.lower()
    adverts = "~" in low or "-=" in low or any(x in low for x in _CREDITS) or _signs(low) or bool(_MAYBE_HOST.search(text))
    sounds = "[" in text or "(" in text or "♪" in text or "*" in text
    out = []
    for p in parts:
        p = p.strip()
        if sounds and ("[" in p or "(" in p or "♪" in p or "*" in p):
            p = _SOUND.sub(" ", p)
        if (p[:1].isalpha() or _LETTER.search(p)) and not (adverts and is_advert(p)):
            out.append(p)
    return out
