"""Words of very long texts, a part at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Words of a text that are objects at a time.
MOST = 60_000


def word_chunks(text: bytes, keep: int = 0, most: int = MOST) -> Iterator[list[bytes]]:
    """The words of ``text``, at most ``most`` new ones at a time, each part led by the last ``keep`` of the one before.

    A text of at most ``most`` words comes as one part, one without words as one empty part.
    """
    part: list[bytes] = []
    while True:
        words = text.split(None, most)
        text = words.pop() if len(words) > most else b""
        part = part + words
        yield part
        if not text:
            return
        part = part[len(part) - keep :] if keep else []
