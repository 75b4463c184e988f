"""What a text must hold for a built-in rule, a run of digit words, a cue of birth or a kinship word with a name to be found in it.

A bit each, found by automata that read a text once without going back. Every pattern here matches wherever its rule does, and at
few other places; the rule itself is then run on what is left. Bounds of words are left out, letters beyond ASCII are any
character, and a text with a letter that Java alone takes for one of ASCII when it ignores case has all bits."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..rules import LISTS
from .text import fold_word

_S = r"[\s\x0b]"  # white space as Java reads it
_FAR = r"[^\x00-\x7f]"
_ODD_CASE = r"(?-i:[\x{130}\x{131}\x{17f}\x{212a}])"


def _any(name: str) -> str:
    one = lambda w: "".join(_S + "{1,4}" if c.isspace() else "." if ord(c) > 127 else re.escape(c) for c in w)
    return "(?:" + "|".join(sorted({one(w) for w in LISTS[name]})) + ")"


@cache
def patterns() -> dict[str, tuple[str, bool]]:
    """What is to be found, with its pattern and whether it holds a digit."""
    state, code, month, mes, digit = _any("us-state"), _any("us-state-code"), _any("month-en"), _any("month-es"), _any("digit-word")
    there = rf"{state}|(?-i:,{_S}?{code}|{code}{_S}+[0-9]{{5}})"
    # A folded letter may have been any letter beyond ASCII, and marks beside it are gone.
    kin = "|".join(sorted({f"{_FAR}*".join(f"(?:{c}|{_FAR})" for c in fold_word(w)) + f"{_FAR}*" for w in LISTS["kinship"]}))
    return {
        "email": ("@", False),
        "email-spoken": (rf"{_S}(?:at|arroba){_S}+[^\s\x0b.]+(?:\.|{_S}+(?:dot|punto){_S}+)[^\s\x0b.]", False),
        "url": ("https?://", False),
        "ipv4": (r"[0-9]\.[0-9]{1,3}\.[0-9]", True),
        "phone-us": (r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", True),
        "ssn-us": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", True),
        "record-number": (rf"(?:mrn|medical record|number|expediente){_S}*[:#]?{_S}*[0-9]{{4}}", True),
        "zip-us": ("[0-9]{5}", True),
        "state-us": (there, False),
        "city-us": (there, False),
        "street-us": (rf"(?-i:[0-9][A-Z]?{_S}+[^a-z\s\x0b])", True),
        "street-name-us": (rf"(?-i:{_S}{_any('thoroughfare-us')})", False),
        "street-mx": (rf"{_any('vialidad-mx')}\.?{_S}+(?-i:(?:(?:de|del|la|las|los|el){_S}+)*[^a-z\s\x0b])", False),
        "po-box": (rf"p\.?{_S}?o\.?{_S}*box|apartado{_S}+postal", True),
        "date-numeric": ("[0-9][/-][0-9]{1,2}[/-][0-9]{2}", True),
        "date-month-en": (rf"{month}{_S}+[0-9]", True),
        "date-month-es": (rf"[0-9]{_S}+de{_S}+{mes}", True),
        "date-words-en": (rf"{month}{_S}+(?:the{_S}+)?(?:(?:twenty|thirty)[\s\x0b-])?{_any('ordinal-en')}|{_any('ordinal-en')}{_S}+of{_S}+{month}", False),
        "date-words-es": (rf"{_S}de{_S}+{mes}", False),
        "age-over-89": (r"[0-9][ -]?(?:years?[ -]old|a.os)", True),
        "age-over-89-words": ("ninety|hundred|noventa|cien", False),
        "age-over-89-said": (rf"(?:age|edad){_S}*:?{_S}*[0-9]", True),
        "spoken-digits": (rf"{digit}(?:[ \t]*[,\-–][ \t]*|[ \t]+){digit}", False),
        "birth-year": (r"born|birth|d\.?o\.?b|naci", True),
        "relatives": (rf"(?:^|[^A-Za-z0-9])(?:{kin})[\s\x0b,]+(?-i:[A-Z]|{_FAR})", False),
    }


@cache
def bits() -> dict[str, int]:
    return {name: 1 << i for i, name in enumerate(patterns())}


def found(texts: pa.Array) -> pa.Array:
    """The bits of each text."""
    out = np.zeros(len(texts), np.int64)
    holds = lambda some, p: pc.match_substring_regex(some, f"(?i){p}").fill_null(False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(holds(texts, "[0-9]"))
    written = texts.take(pa.array(rows))
    for name, (pattern, digits) in patterns().items():
        if digits:
            out[rows[holds(written, pattern)]] |= bits()[name]
        else:
            out[holds(texts, pattern)] |= bits()[name]
    out[holds(texts, _ODD_CASE)] = -1
    return pa.array(out)
