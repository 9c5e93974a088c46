"""Regular expressions over content streams (Java syntax).

A content stream is bytes read one-to-one as Latin-1, so the private-use character ``MARK`` can never
occur in it and is safe as a split mark. Quantifiers are possessive wherever the neighbouring classes
are disjoint: the match is the same, the time stays linear and the regex stack stays flat on long streams.
"""

from __future__ import annotations

# White space and number forms as the audit and the rewriter read them. Classes list their
# characters one by one, which the regex engine turns into a table lookup.
WS = r"[ \t\n\x0B\f\r\xA0]"
#: What stands between white space.
WORD = r"[^ \t\n\x0B\f\r\xA0]++"
_DIGIT = "[0123456789]"
AUDIT_NUMBER = r"-?[0123456789.]++"
REWRITE_NUMBER = rf"-?(?:{_DIGIT}++(?:\.{_DIGIT}++)?+|\.{_DIGIT}++)"
# Colour operators by number of operands.
RGB_OPS = ("rg", "RG")
CMYK_OPS = ("k", "K")
GENERIC_OPS = ("scn", "SCN", "sc", "SC")
SPACE_OPS = ("cs", "CS")
PATTERN_OPS = ("scn", "SCN")

MARK = "\ue000"
#: Nesting that one regular expression can follow. Deeper literals are cut out by ``functions.regions``.
LITERAL_DEPTH = 32


def _alt(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def follow(at_end: str) -> str:
    """What may follow an operator: white space only ('audit'), or also the end ('rewrite')."""
    return rf"(?={WS})" if at_end == "audit" else rf"(?={WS}|\z)"


def run(number: str, low: int, high: int) -> str:
    return rf"(?:{number}{WS}++){{{low},{high}}}+"


def color_call(at_end: str, numeric: tuple[str, ...] = RGB_OPS + CMYK_OPS + GENERIC_OPS,
               named: tuple[str, ...] = SPACE_OPS + PATTERN_OPS) -> str:
    """Any colour call: up to five numbers, or one name, and the operator.

    Five are enough: an RGB call reads the last three, a CMYK call the last four, and a generic call counts
    only with exactly three or four, so a longer run never matters.
    """
    choices = []
    if numeric:
        choices.append(run(AUDIT_NUMBER, 1, 5) + _alt(numeric))
    if named:
        choices.append(rf"/\w++{WS}++" + _alt(named))
    return "(?:" + "|".join(choices) + ")" + follow(at_end)


def space_call(at_end: str, ops: tuple[str, ...] = SPACE_OPS) -> str:
    return rf"/(\w++){WS}++{_alt(ops)}" + follow(at_end)


INLINE_IMAGE_TOKEN = rf"(?:^|{WS})BI{WS}"
SHADING_TOKEN = rf"{WS}sh{WS}"

# Literals as the audit masks them: no nested parentheses, hexadecimal digits only.
FLAT_LITERAL = r"\((?:[^()\\]++|\\[^\n\r])*+\)"
HEX_LITERAL = rf"<(?:[0-9A-Fa-f]|{WS})*+>"


def _balanced(depth: int) -> str:
    inner = r"[^()\\]++|\\(?s:.)"
    body = f"(?:{inner})*+"
    for _ in range(depth - 1):
        body = rf"(?:{inner}|\({body}\))*+"
    return rf"\({body}\)"


# Literals the rewriter never touches: balanced ones (an unclosed one runs to the end) and hexadecimal strings
# up to the next '>'. Inline images are the third kind of region; their length stands in their header.
BALANCED = _balanced(LITERAL_DEPTH)
PROTECTED_LITERAL = BALANCED + r"|\((?s:.)*+" + r"|<(?!<)[^>]*+>"
IMAGE_START = r"(?<![^\n\r])BI[\n\r]"
IMAGE_HEAD = r"\ABI[\n\r][\s\S]*?\nID(?=\n)"
# Data of an image whose length is not known, from the end of ID to its end mark.
SCANNED_IMAGE = r"\A\n[\s\S]*?\nEI(?=[\x00- Qq]|\z)"
BOUNDARY_BEFORE_SPACE = rf"(?=/\w++{WS}++{_alt(SPACE_OPS)}(?:{WS}|[(<]|\z))"

# Colour calls the rewriter replaces, tried with four, three and one operand from each start.
LAST_SPACE = r"(?s)^.*"
REWRITE_CALL = ("(?:"
                + run(REWRITE_NUMBER, 4, 4) + _alt(CMYK_OPS + GENERIC_OPS) + "|"
                + run(REWRITE_NUMBER, 3, 3) + _alt(RGB_OPS + GENERIC_OPS) + "|"
                + run(REWRITE_NUMBER, 1, 1) + _alt(GENERIC_OPS) + ")" + follow("rewrite"))

# One token of open text: white space, a name, a run of regular characters, or a single delimiter.
TOKEN = rf"{WS}++" + r"|/?[^\s\u00A0()<>\[\]/]++|[\s\S]"
NUMBER_TOKEN = rf"^{REWRITE_NUMBER}$"

# An operator with the run of numbers, or the name, just before it. The run starts only where no other
# number precedes it, so long number lists are read once.
OPERANDS = rf"(?<![\d.-])(?<![\d.]{WS})(?:{REWRITE_NUMBER}{WS}++)++"
OPERATOR = (rf"(?:{OPERANDS}|/\w++{WS}++)?+" + r"(?<![^\s\u00A0)>\]])[A-Za-z'\"][A-Za-z0-9*]*+"
            + follow("rewrite"))
