"""Plain words of a text: lower-cased runs of letters and digits, as UTF-8 bytes."""

from __future__ import annotations

import re

MARKS = "“”«»„’‘…—–¿¡·"
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts that are written without spaces: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def plain_words(text: str | None) -> list[bytes]:
    """ASCII punctuation and the typographic ``MARKS`` separate words; null has none."""
    text = (text or "").lower()
    if not text.isascii():
        for m in MARKS:
            if m in text:
                text = text.replace(m, " ")
    return text.encode("utf-8", "replace").translate(PLAIN).split()


def spaced_words(text: str | None) -> list[bytes]:
    """``plain_words``, with each character of an unspaced script a word of its own."""
    if text and not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return plain_words(text)
