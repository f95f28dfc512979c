"""Java-regex spellings shared by the text functions.

Whitespace and word characters follow Unicode rules: ``\\s`` and ``\\w`` of Java
are ASCII-only (and ``(?U)\\w`` also takes combining marks), so both are spelled out.
"""

from __future__ import annotations

# The Unicode whitespace characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

WS_RUN = f"[{WS}]+"
# ASCII whitespace that differs from one plain space: normal text has few matches.
UNEVEN_WS = r"[\s\x1c-\x1f]{2,}|[\t-\r\x1c-\x1f]"
EXOTIC_WS = WHITESPACE[10:]
EXOTIC_WS_CLASS = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PLAIN_ASCII = r"[ -%'-~\t\n\r]+"
WORD_RUN = f"[{WORD}]+"
URL = rf"(?i)https?://[^{WS}]+|(?<![{WORD}])www\.[^{WS}]+"
TAG = "<[^>]+>"
REPEATED_PUNCTUATION = r"([!?.;,])\1+"
# (?d): only \n ends a line, so '.' matches what it does elsewhere in this package.
# Applied to lower-cased text: case-insensitive back-references of the JDK fail on
# characters beyond U+FFFF.
REPEATED_CHARACTER = r"(?d)(.)\1{5,}"
HTTP_URL = "(?i)^https?://"

# Control, format, private-use and surrogate characters plus U+FFFD, except whitespace.
# Unassigned code points go as well, but not in the pictograph and newest ideograph
# blocks: the JVM's Unicode tables are older than the emoji people type.
UNREADABLE = (
    r"[\x{FFFD}]|[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^" + WS + r"]]"
    r"|[\p{Cn}&&[^\x{1F000}-\x{1FAFF}\x{2EBF0}-\x{2EE5D}\x{31350}-\x{323AF}]]"
)
LETTER_OR_NUMBER = r"[\p{L}\p{N}]"
SYMBOL_MARK_PUNCTUATION = r"[\p{S}\p{M}\p{P}\x{1F000}-\x{1FAFF}]"

# Characters that neither NFKC nor entity decoding nor encoding repair can change:
# ASCII without '&', precomposed Latin and Cyrillic letters, common punctuation and emoji.
# Text made only of these skips the Python worker.
_STABLE = (
    r"\x00-\x25\x27-\x7F"
    r"\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}"
    r"\x{C0}\x{C1}\x{C4}-\x{E1}\x{E4}-\x{FF}\x{100}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{400}-\x{482}\x{48A}-\x{52F}"
    r"\x{2013}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}"
)
NEEDS_UNICODE_WORK = rf"[^{_STABLE}]|\x{{F0}}\x{{178}}|\x{{EF}}\x{{B8}}"
