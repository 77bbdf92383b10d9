"""Character classes of Persian text. Written so that Java, RE2 and Python can each have their own form."""

from __future__ import annotations

# Code points of the classes.
LETTERS = [(0x0621, 0x063A), (0x0641, 0x064A), (0x066E, 0x066F), (0x0671, 0x06D3), (0x06D5, 0x06D5), (0x06EE, 0x06EF), (0x06FA, 0x06FC), (0x06FF, 0x06FF)]
MARKS = [(0x064B, 0x065F), (0x0670, 0x0670)]
PRESENTATION = [(0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]
SPACES = [(0x0020, 0x0020), (0x00A0, 0x00A0)]
#: What counts as white space when blocks are collapsed.
WHITE = [(0x0009, 0x000D), (0x001C, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
HALF_SPACE = "‌"
STRETCH = "ـ"
TEH_MARBUTA = "ة"
#: A letter's other code points, and the one that Persian uses.
TO_PERSIAN = {"ي": "ی", "ى": "ی", "ك": "ک", "ھ": "ه", "ە": "ه"}
TO_PERSIAN_QUOTED = {"ي": "ی", "ى": "ی", "ك": "ک"}
#: Letters that inflection adds or changes at a word's end and start.
ENDING_LETTERS = "مشتینهاد"
LEADING_LETTERS = "بنمی"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def members(*ranges: list[tuple[int, int]]) -> str:
    """The inside of a bracket expression, in the \\x{...} notation that Java and RE2 share."""
    return "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for part in ranges for a, b in part)


def plain(*ranges: list[tuple[int, int]]) -> str:
    """The inside of a bracket expression for Python."""
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for part in ranges for a, b in part)


L = members(LETTERS)
LETTER = f"[{L}]"
#: Not inside a word: neither a letter nor a half-space beside.
EDGE_BEFORE = f"(?<![{L}\\x{{200C}}])"
EDGE_AFTER = f"(?![{L}\\x{{200C}}])"
SPACE = f"[{members(SPACES)}]"
WORD_RUN = f"[{members(LETTERS, MARKS, PRESENTATION)}\\x{{200C}}\\x{{0640}}]+"
WHITE_RUN = f"[{members(WHITE)}]+"
