"""Walks over single characters that no Column expression can express: cutting texts by token budget.

Costs are those of ``functions.text.token_estimate``: a CJK character is one token, a word one, and a
word beyond ``LONG_RUN`` letters one more for every four begun.
"""

from __future__ import annotations

import re

from .text import CJK_RANGES, LONG_RUN, WORD

_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]")
_WORD = re.compile(WORD)
#: A CJK character, a word, or anything else that stands between words.
_PIECE = re.compile(f"(?P<cjk>{_CJK.pattern})|(?P<word>{WORD})|(?P<other>.)", re.DOTALL)


def word_cost(n: int) -> int:
    return 1 if n <= LONG_RUN else 1 + (n - LONG_RUN + 3) // 4


def estimate(text: str) -> int:
    return len(_CJK.findall(text)) + sum(word_cost(len(w)) for w in _WORD.findall(text))


def _letters_within(budget: int) -> int:
    """Letters of one word that cost ``budget`` tokens at most."""
    return 0 if budget < 1 else LONG_RUN + 4 * (budget - 1)


def truncate(text: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` tokens."""
    left = limit
    if limit <= 0:
        return ""
    for piece in _PIECE.finditer(text):
        if piece.lastgroup == "other":
            continue
        size = len(piece.group())
        cost = 1 if piece.lastgroup == "cjk" else word_cost(size)
        if cost > left:
            return text[: piece.start() + (_letters_within(left) if piece.lastgroup == "word" else 0)]
        left -= cost
    return text


def tail(text: str, tokens: int) -> str:
    """A suffix of about ``tokens`` tokens, without leading white space; words of usual length stay whole.

    A usual word counts when the character before it is reached, and the suffix then starts behind that
    character. A long word counts from the right as soon as it proves long, so it may be cut.
    """
    if tokens <= 0:
        return ""
    need = tokens
    for piece in reversed(list(_PIECE.finditer(text))):
        if piece.lastgroup == "word":
            size = len(piece.group())
            if size > LONG_RUN:
                # its 41st letter from the right costs two, and every fourth one after that one more
                letters = LONG_RUN + 1 + 4 * max(0, need - 2)
                if letters <= size:
                    return text[piece.end() - letters :].lstrip()
                need -= word_cost(size)
            elif piece.start() > 0:
                need -= 1
                if need <= 0:
                    return text[piece.start() :].lstrip()
        elif piece.lastgroup == "cjk":
            need -= 1
            if need <= 0:
                return text[piece.start() :].lstrip()
    return text
