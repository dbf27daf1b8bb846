"""Column functions for cleaning, normalising and splitting text. All run inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The special tokens, in id order.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "<S>", "<T>"]

# Of these, the ones that a stored vocabulary treats as special when it is loaded again.
RELOADED_SPECIALS = SPECIAL_TOKENS[:5]

# Block ranges whose characters are words of their own.
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
# Unicode punctuation plus the ASCII symbols treated as punctuation.
PUNCTUATION = r"\p{P}$+<=>^`|~"
# Letters and digits that no normalising changes and no splitting separates.
PLAIN = r"a-zA-Z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}"
# Of all other characters normalising changes the case and the accents, one character for one, and drops none.
NOT_PLAIN = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xA0\xAD\x{250}-\x{10FFFF}"
# Format characters too new for the published normaliser, which keeps them.
NEWER_FORMAT = r"\x{890}\x{891}\x{8E2}\x{110CD}\x{13430}-\x{1343F}"

# A special token written out in a text stands as one character while the text is split. WordPiece normalising drops
# private-use characters, so there they are free; byte-level splitting drops nothing and takes noncharacters.
WORDPIECE_MARKS = [chr(0xE000 + i) for i in range(len(SPECIAL_TOKENS))]
BYTE_LEVEL_MARKS = [chr(0xFDD0 + i) for i in range(len(SPECIAL_TOKENS))]


@cache
def whitespace() -> str:
    """Every character that Python's ``str.strip`` removes."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


# Hangul syllables are numbered by their first, middle and last letters.
SYLLABLES, LAST_SYLLABLE = 0xAC00, 0xD7A3
FIRST_LETTERS, MIDDLE_LETTERS, LAST_LETTERS = (0x1100, 19), (0x1161, 21), (0x11A7, 28)


@cache
def _without_marks() -> dict[str, str]:
    """Code points that decompose, and what is left of each without marks. Hangul syllables are left out."""
    found = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base not in ("", char) and not SYLLABLES <= code <= LAST_SYLLABLE:
            found[char] = base
    return found


@cache
def _accent_map() -> tuple[str, str]:
    """Code points that become one other character, and that character."""
    single = {char: base for char, base in _without_marks().items() if len(base) == 1}
    return "".join(single), "".join(single.values())


@cache
def plain_accents() -> tuple[str, str]:
    """Those of them that are not in ``NOT_PLAIN``."""
    pairs = [(a, b) for a, b in zip(*_accent_map()) if a <= "\u024f"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _several() -> dict[str, str]:
    """Code points that become more than one character."""
    return {char: base for char, base in _without_marks().items() if len(base) > 1}


def _several_ranges() -> str:
    """Character ranges that hold every code point to take apart. A few wide ranges are quick to search."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, _several())):
        if not ranges or code - ranges[-1][1] > 0x300:
            ranges.append([code, code])
        ranges[-1][1] = code
    ranges.append([SYLLABLES, LAST_SYLLABLE])
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges)


def _take_apart(text: Column) -> Column:
    """Decompose the characters that become several."""
    table = F.create_map(*[F.lit(x) for pair in _several().items() for x in pair])

    def letter(block: tuple[int, int], index: Column) -> Column:
        start, n = block
        return F.get(F.array(*[F.lit(chr(start + i)) for i in range(n)]), index.cast("int"))

    def one(char: Column) -> Column:
        number = F.ascii(char) - SYLLABLES
        last = number % LAST_LETTERS[1]
        rest = F.floor(number / LAST_LETTERS[1])
        syllable = F.concat(
            letter(FIRST_LETTERS, F.floor(rest / MIDDLE_LETTERS[1])),
            letter(MIDDLE_LETTERS, rest % MIDDLE_LETTERS[1]),
            F.when(last > 0, letter(LAST_LETTERS, last)).otherwise(""),
        )
        is_syllable = (number >= 0) & (number <= LAST_SYLLABLE - SYLLABLES)
        return F.when(is_syllable, syllable).otherwise(F.coalesce(F.try_element_at(table, char), char))

    return F.array_join(F.transform(F.split(text, ""), one), "")


@cache
def byte_symbols() -> str:
    """The printable character that stands for each byte 0..255 in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 in byte order.
    """
    keep = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in keep else chr(next(rest)) for b in range(256))


def text_length(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def strip(text: Column) -> Column:
    """Remove whitespace from both ends; null stays null."""
    return F.btrim(text, F.lit(whitespace()))


def remove_tags(html: Column) -> Column:
    """Delete ``<...>``, shortest match, within one line."""
    # (?d): only a newline ends a line, so a tag may span other Unicode line separators
    return F.regexp_replace(html, r"(?d)<.*?>", "")


def remove_links(html: Column) -> Column:
    """Delete from ``<a`` to the last double quote of the line."""
    return F.regexp_replace(html, r'(?d)<a.*"', "")


def quality_at_least(quality: Column, threshold: float) -> Column:
    """True where the quality is a number of at least ``threshold``."""
    # Spark orders NaN above every number, so it needs a test of its own
    return (quality >= F.lit(threshold)) & ~F.isnan(quality)


def mark_specials(text: Column, special_tokens: Sequence[str], marks: Sequence[str]) -> Column:
    """Put a mark in the place of each special token that is written out in the text."""
    for token in special_tokens:
        text = F.replace(text, F.lit(token), F.lit(marks[SPECIAL_TOKENS.index(token)]))
    return text


def holds_any(text: Column, tokens: Sequence[str]) -> Column:
    """Whether one of the tokens is written out in the text; the tokens' first characters are looked for first."""
    found = F.lit(False)
    for first in dict.fromkeys(token[0] for token in tokens):
        some = F.lit(False)
        for token in (t for t in tokens if t[0] == first):
            some |= F.contains(text, F.lit(token))
        found |= F.contains(text, F.lit(first)) & some
    return found


def is_plain(text: Column) -> Column:
    """Whether a text has no character of ``NOT_PLAIN``."""
    # the complement as a class would be ten times as slow
    return ~text.rlike(f"[{NOT_PLAIN}]")


def _marked_plain(text: Column, special_tokens: Sequence[str]) -> Column:
    """A plain text, which has no marks yet, with marks for the tokens that are written out in it."""
    if not special_tokens:
        return text
    marked = mark_specials(text, special_tokens, WORDPIECE_MARKS)
    return F.when(holds_any(text, special_tokens), marked).otherwise(text)


def normalise(
    text: Column, lowercase: bool = True, strip_accents: bool = True, special_tokens: Sequence[str] = ()
) -> Column:
    """Drop control and format characters, then strip accents and lower the case.

    ``special_tokens`` written out in the text become marks. A quick search finds the texts of plain Latin characters,
    which need no cleaning. Characters that become several are rare too, and only texts with one are taken apart.
    """
    marks = "".join(WORDPIECE_MARKS) if special_tokens else ""
    accents = r"\p{Mn}" if strip_accents else ""
    dropped = rf"[\p{{Cc}}\p{{Cf}}\p{{Co}}{accents}\x{{FFFD}}&&[^\t\n\r{NEWER_FORMAT}{marks}]]"
    source = text
    if marks:
        # marks that come with the text go first, as normalising drops them anyway
        marked = mark_specials(F.translate(text, marks, ""), special_tokens, WORDPIECE_MARKS)
        source = F.when(holds_any(text, special_tokens) | text.rlike(f"[{marks}]"), marked).otherwise(text)
    out = F.regexp_replace(source, dropped, "")
    if strip_accents:
        out = F.when(text.rlike(f"[{_several_ranges()}]"), _take_apart(out)).otherwise(out)
        out = F.translate(out, *_accent_map())
    if lowercase:
        # lower() would turn a word-final capital sigma into the final form
        out = F.lower(F.replace(out, F.lit("Σ"), F.lit("σ")))
    plain = _marked_plain(text, special_tokens)
    if strip_accents:
        plain = F.when(F.length(text) == F.octet_length(text), plain).otherwise(F.translate(plain, *plain_accents()))
    if lowercase:
        plain = F.lower(plain)
    return F.when(is_plain(text), plain).otherwise(out)


def split_words(text: Column) -> Column:
    """Words, single punctuation characters, CJK characters and marks, in order."""
    alone = f"{PUNCTUATION}{CJK}{''.join(WORDPIECE_MARKS)}"
    # most words are plain letters, which a small class finds faster than the complement of all the others
    pattern = rf"[{PLAIN}]++[^\s\p{{Z}}{alone}]*+|[^\s\p{{Z}}{alone}]++|[{alone}]"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bert_words(
    text: Column, lowercase: bool = True, strip_accents: bool = True, special_tokens: Sequence[str] = ()
) -> Column:
    """Array of the words that a WordPiece vocabulary is trained on and applied to.

    ``special_tokens`` written out in the text become marks, as when encoding; training knows none yet.
    """
    return split_words(normalise(text, lowercase, strip_accents, special_tokens))


def bert_pieces(
    text: Column, lowercase: bool = True, strip_accents: bool = True, special_tokens: Sequence[str] = ()
) -> Column:
    """Array of pieces whose words, by ``words_of_piece`` and in order, are the words of the text.

    Plain texts are only cut at blanks, which no word crosses; the others are split into words.
    """
    words = bert_words(text, lowercase, strip_accents, special_tokens)
    return F.when(is_plain(text), F.split(_marked_plain(text, special_tokens), " ")).otherwise(words)


@cache
def _plain_splitter(lowercase: bool, strip_accents: bool) -> Callable[[str], list[str]]:
    letters = [chr(c) for c in range(0x21, 0x250)]
    alone = [c for c in letters if unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~"]
    signs = re.escape("".join([*alone, *WORDPIECE_MARKS]))
    find = re.compile(rf"[^\t\n\r {signs}]+|[{signs}]").findall
    bare = str.maketrans(*plain_accents())

    def split(piece: str) -> list[str]:
        piece = piece.translate(bare) if strip_accents and not piece.isascii() else piece
        return find(piece.lower() if lowercase else piece)

    return split


def words_of_piece(lowercase: bool = True, strip_accents: bool = True) -> Callable[[str], list[str]]:
    """A function from a piece of ``bert_pieces`` to its words. A word of other characters, save marks, is one already."""
    besides = f"\u0250-{chr(ord(WORDPIECE_MARKS[0]) - 1)}{chr(ord(WORDPIECE_MARKS[-1]) + 1)}-\U0010FFFF"
    other = re.compile("[" + NOT_PLAIN.replace(r"\x{250}-\x{10FFFF}", besides) + "]").search
    split = _plain_splitter(lowercase, strip_accents)
    return lambda piece: [piece] if other(piece) else split(piece)


def _byte_level_pattern(marks: str = "") -> str:
    """The published split pattern of byte-level BPE, with each mark as a word of its own."""
    space = r"\s\x{85}\p{Z}"
    alone = f"[{marks}]|" if marks else ""
    return (
        rf"{alone}'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}{marks}]+"
        rf"|[{space}]+(?![^{space}{marks}])|[{space}]+"
    )


def _byte_level_symbols(word: Column) -> Column:
    latin = "".join(chr(b) for b in range(256))
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), latin, byte_symbols())


def byte_level_words(text: Column, special_tokens: Sequence[str] = ()) -> Column:
    """Array of byte-level pre-tokens, each byte written as its printable symbol.

    In a text that holds a mark character itself, special tokens are taken as plain text.
    """

    def split(source: Column, marks: str) -> Column:
        return F.regexp_extract_all(source, F.lit(_byte_level_pattern(marks)), F.lit(0))

    plain = F.transform(split(text, ""), _byte_level_symbols)
    if not special_tokens:
        return plain
    marks = "".join(BYTE_LEVEL_MARKS)
    marked = F.transform(
        split(mark_specials(text, special_tokens, BYTE_LEVEL_MARKS), marks),
        lambda w: F.when(w.isin(BYTE_LEVEL_MARKS), w).otherwise(_byte_level_symbols(w)),
    )
    return F.when(text.rlike(f"[{marks}]"), plain).otherwise(marked)
