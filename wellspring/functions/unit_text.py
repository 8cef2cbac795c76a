"""Units stated in free text: a multi-pattern automaton over unit aliases.

One pass of the automaton finds every alias; of overlapping finds the longest
wins; short aliases must stand alone; the words before a find tell whether it
names the unit the value came from ("converted from stb/d") or the one it is
in now ("... converted to MPa").
"""

from __future__ import annotations

import functools
import re
import unicodedata

import ahocorasick

# fixed values: unit aliases by unit code of the factor table, lower case, NFKC
ALIASES = {
    "MPa": "mpa|megapascal|megapascals|兆帕|мпа",
    "kPa": "kpa|kilopascal|kilopascals|千帕|кпа",
    "bar": "bar|bara|barg|bars|巴|бар",
    "psi": "psi|psia|psig|lb/in2|lbf/in2|lb/sq in|pounds per square inch",
    "kgf/cm2": "kgf/cm2|kg/cm2|kgf/sq cm|кгс/см2|公斤力/平方厘米",
    "atm": "atm|atmosphere|atmospheres|атм|大气压",
    "m3/d": "m3/d|sm3/d|m3/day|sm3/day|cubic metres per day|cubic meters per day|方/日|方/天|立方米/日|м3/сут",
    "bbl/d": "bbl/d|bbl/day|bbls/d|bpd|bopd|stb/d|stb/day|barrels per day|barrels a day|桶/日|桶/天|барр/сут",
    "Mbbl/d": "mbbl/d|mstb/d|mbopd|mbpd|thousand barrels per day|thousand barrels a day|千桶/日|тыс. барр/сут",
    "t/d": "t/d|t/day|tonnes per day|tons per day|tonnes/d|tonne/d|吨/日|吨/天|т/сут",
    "m": "m|metre|metres|meter|meters|米|м",
    "ft": "ft|feet|foot|英尺|'|фут|футов",
    "cm": "cm|centimetre|centimetres|centimeter|centimeters|厘米|см",
}
QUANTITY = {u: q for q, us in {"pressure": "MPa kPa bar psi kgf/cm2 atm", "oil rate": "m3/d bbl/d Mbbl/d t/d", "length": "m ft cm"}.items() for u in us.split()}
COMMON = {"pressure": "MPa", "oil rate": "m3/d", "length": "m"}

_FROM = re.compile(r"\b(from|was|were|formerly|originally)\b|原为|由|из")
_TO = re.compile(r"\b(to|into|now)\b|改为|换算为|现为")
_ELSEWHERE = re.compile(r"plugged|below surface|below ground|depth|\btd\b|perforat|casing")
_NUMBER = re.compile(r"(\d+(?:\.\d+)?)\s*$")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for name in names.split("|"):
            a.add_word(name, (unit, len(name)))
    a.make_automaton()
    return a


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Latin and Cyrillic aliases may not be part of a longer word."""
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    first, last = text[start], text[end - 1]
    wordy = lambda a, b: a.isalnum() and b.isalnum() and ord(a) < 0x2E80 and ord(b) < 0x2E80
    if last == "'":
        return left.isdigit() and not right.isalnum()
    number_before = left.isdigit() and not first.isdigit()
    return (number_before or not wordy(left, first)) and not wordy(last, right)


def mentions(text: str) -> list[tuple[int, int, str]]:
    """Unit mentions (start, end, unit code): longest, not overlapping."""
    found = []
    for last, (unit, n) in _automaton().iter(text):
        if _stands_alone(text, last - n + 1, last + 1):
            found.append((last - n + 1, last + 1, unit))
    found.sort(key=lambda f: (f[0] - f[1], f[0]))
    kept: list[tuple[int, int, str]] = []
    for f in found:
        if all(f[1] <= k[0] or f[0] >= k[1] for k in kept):
            kept.append(f)
    return sorted(kept)


@functools.lru_cache(maxsize=65536)
def stated_unit(text: str | None, quantity: str, value: float | None = None) -> str | None:
    """Unit code that a text states for a value of the quantity, or None.

    A unit named as the present one wins; one named only as a former unit
    means that the value is in the common unit now. A length beside a number
    that is not the value itself, in words about something else, is no
    statement about the value.
    """
    if not text:
        return None
    low = unicodedata.normalize("NFKC", text).lower()
    now, plain, former = [], [], []
    end_before = 0
    for start, end, unit in mentions(low):
        before = low[end_before:start]
        end_before = end
        if QUANTITY[unit] != quantity:
            continue
        number = _NUMBER.search(before)
        if quantity == "length" and number and _ELSEWHERE.search(low):
            if value is None or abs(float(number[1]) - value) > 1e-6 * max(1, abs(value)):
                continue
        (now if _TO.search(before) else former if _FROM.search(before) else plain).append(unit)
    if now:
        return now[-1]
    if former:
        return COMMON[quantity]
    return plain[0] if plain else None
