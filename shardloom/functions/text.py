"""Column expressions on document text and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the whitespace and the byte-level pre-tokenizers, with Unicode classes.
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"
BYTE_LEVEL_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The special tokens.
UNK, BOS, EOS = "<unk>", "<bos>", "<eos>"
SPECIALS = (UNK, BOS, EOS)


def words(text: Column | str) -> Column:
    """Whitespace pre-tokens: runs of word characters or of other visible characters."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def byte_level_words(text: Column | str) -> Column:
    """Byte-level pre-tokens: each UTF-8 byte of a piece is shown as one printable character."""
    pieces = F.regexp_extract_all(text, F.lit(BYTE_LEVEL_PATTERN), F.lit(0))
    hidden, shown = _byte_alphabet()
    return F.transform(
        pieces,
        lambda p: F.translate(F.decode(F.encode(p, "UTF-8"), "ISO-8859-1"), hidden, shown),
    )


def _byte_alphabet() -> tuple[str, str]:
    """Bytes without a printable Latin-1 character take code points from 256 up, in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return "".join(map(chr, hidden)), "".join(chr(256 + i) for i in range(len(hidden)))


def bytes_to_text(shown_text: Column | str) -> Column:
    """Inverse of the byte-level display: back to UTF-8 text."""
    hidden, shown = _byte_alphabet()
    return F.decode(F.encode(F.translate(shown_text, shown, hidden), "ISO-8859-1"), "UTF-8")


def wrap(tokens: Column | str, mark) -> Column:
    """The end-of-text mark before and after the tokens (n + 2 items)."""
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    return F.concat(F.array(mark), tokens if isinstance(tokens, Column) else F.col(tokens), F.array(mark))


def digest(items: Column | str) -> Column:
    """A short fingerprint of an array, for comparing results across engines."""
    return F.md5(F.array_join(items, " "))


def seeded_key(seed: Column, *parts: Column | str) -> Column:
    """The order key of a seeded shuffle: the same seed and row always give the same key."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", seed.cast("string"), *[c.cast("string") for c in cols]))
