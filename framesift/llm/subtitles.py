"""Reading of subtitle files: cues, dialogue words, repair of wrongly decoded text."""

from __future__ import annotations

import re
import unicodedata

# Characters that code page 1252 has for the bytes 80 to 9F.
CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_BYTES = str.maketrans(CP1252)
_WRONG = re.compile("[Â-ô](?:[\u0080-¿" + "".join(CP1252) + "]|$)")
_RUN = re.compile("[Â-ô][\u0080-ÿ" + "".join(CP1252) + "]+")


def _decoded(run: re.Match) -> str:
    try:
        return run[0].translate(_TO_BYTES).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return run[0]


def repair(text: str) -> str:
    """UTF-8 that was read as code page 1252, once or twice over, as it was meant; other text as it is."""
    for _ in range(2):
        if text.isascii() or not _WRONG.search(text):
            return text
        try:
            text = text.translate(_TO_BYTES).encode("latin-1").decode("utf-8")
        except UnicodeError:
            fixed = _RUN.sub(_decoded, text)
            if fixed == text:
                return text
            text = fixed
    return text


_CUE = re.compile(r"\n(?:[^\n\d]{0,8}\d+[^\S\n]*\n)?[^\n]*-->[^\n]*")


def cues(text: str) -> list[str] | None:
    """The texts of the cues, lines kept; None if the text has no time line."""
    if "-->" not in text:
        return None
    return [x.strip() for x in _CUE.split("\n" + text.replace("\r\n", "\n").replace("\r", "\n"))[1:]]


_STYLE = re.compile(r"</?[a-zA-Z][^<>\n]*>|\{\\[^{}\n]*\}|\\[Nnh]")
# within a cue, or, where there are no cues, within a line: an opening bracket doesn't swallow what is said after it
_SOUND = re.compile(r"\[[^\[\]\x00]*\]|\([^()\x00]*\)|\*[^*\x00]+\*")


def dialogue(text: str) -> str:
    """What is said: without numbers and times of cues, styling and sound descriptions; cues are joined."""
    text = repair(text)
    parts = cues(text)
    whole = "\x00".join(re.split(r"[\r\n]+", text) if parts is None else parts)
    if "<" in whole or "{" in whole or "\\" in whole:
        whole = _STYLE.sub("", whole)
    if "[" in whole or "(" in whole or "*" in whole:
        whole = _SOUND.sub(" ", whole)
    return whole.replace("\x00", " ")


_MARKS = re.compile(r"[̀-ͯ]+")
# What recognition confuses.
_CONFUSED = str.maketrans({"l": "i", "1": "i", "|": "i", "!": "i", "0": "o", "5": "s", "8": "b", "đ": "d", "ı": "i", "ł": "i"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\w�]|_")


def fold(word: str) -> str:
    """A key that spellings of a word share whatever their case, accents and frequent recognition errors; '' for punctuation.
    U+FFFD stands for lost characters."""
    lost = "�" in word or "?" in word[1:-1]
    if lost:
        word = word.replace("?", "�")
        word = re.sub(r"[^\w�]", "", word)
    else:
        word = _INNER.sub("", word.replace("|", "l").replace("!", "l") if len(word) > 2 and word[1:-1].strip("|!") != word[1:-1] else word)
    word = word.lower()
    if word.isdigit():
        return word
    if not word.isascii():
        word = _MARKS.sub("", unicodedata.normalize("NFKD", word)).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
    return word.translate(_CONFUSED).replace("rn", "m").replace("vv", "w")


def lossy(word: str) -> list[str]:
    """The keys of a word whose characters beyond ASCII were lost: replaced one by one, or dropped."""
    word = unicodedata.normalize("NFC", word)
    if word.isascii():
        return []
    return [fold("".join(c if ord(c) < 128 else "�" for c in word)), fold("".join(c for c in word if ord(c) < 128))]
