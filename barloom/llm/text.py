"""Text repair shared by the operators on documents."""

from __future__ import annotations

import re
import unicodedata

# Characters that end a line on which a word goes on.
HYPHENS = "-‐‑¬"

_SPLIT = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*(?:\r\n|\r|\n)[ \t]*(?=[^\W\d_])")
_MAYBE = re.compile(rf"[{HYPHENS}][ \t]*[\r\n]")
# What cp1252 makes of the bytes 0x80 to 0xBF.
_TAIL = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\x81\x8d\x8f\x90\x9d\xa0-¿\x80-\x9f"
_GARBLED = re.compile(rf"(?:[Â-ß][{_TAIL}]|[à-ï][{_TAIL}]{{2}}|[ð-ô][{_TAIL}]{{3}})+")


def _decode(m: re.Match[str]) -> str:
    raw = bytearray()
    for ch in m.group():
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return m.group()
            raw.append(ord(ch))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair(text: str) -> str:
    """UTF-8 once read as cp1252 is put right, soft hyphens go, words split at a line end join."""
    if "Ã" in text or "â€" in text or "Â" in text:
        text = _GARBLED.sub(_decode, text)
    return text.replace("­", "")


def unwrap(text: str) -> str:
    """One line, single spaces, words split by a hyphen at a line end joined, composed accents."""
    text = repair(text)
    if _MAYBE.search(text):
        text = _SPLIT.sub("", text)
    return " ".join(unicodedata.normalize("NFC", text).split())


def fold(text: str) -> str:
    """Lower case without accents; other signs stay as they are."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(ch for ch in text if not unicodedata.combining(ch)) if not text.isascii() else text
