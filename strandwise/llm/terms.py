"""Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased, from texts of any length."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are held as Python objects at once.
PIECE_BYTES = 1 << 20


def _table() -> bytes:
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(b" " * 256)
    for byte in kept:
        table[byte] = byte
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 32
    return bytes(table)


#: Separators become blanks, A-Z lower case; bytes of multi-byte characters stay as they are.
TABLE = _table()


def word_lists(text: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each stretch of about `limit` bytes.

    Stretches end at a separator, so every word is whole, whatever its length.
    """
    plain = text.translate(TABLE)
    begin = 0
    while len(plain) - begin > limit:
        end = plain.find(b" ", begin + limit)
        if end < 0:
            break
        yield plain[begin:end].split()
        begin = end
    yield (plain[begin:] if begin else plain).split()
