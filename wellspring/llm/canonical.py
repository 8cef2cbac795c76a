"""Free-entered values mapped to a canonical list.

Names and aliases of the list go into a multi-pattern automaton. It finds the
mentions embedded in a value; the longest mentions that do not overlap win. A
value without a mention is compared with every entry by token-set similarity,
in which tokens match up to a slip (one edit, a swap of neighbours included).
What stays below the threshold or is equally near two entries is unmatched, unless
the tables themselves spell it: a name that others have mapped, always to one entry.

Aliases are a table (alias, entry) and a parameter; CURVES below is the one for log
curves, of public mnemonics. An entry without aliases is found by its key and name.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNMATCHED = "UNMATCHED"
SIMILAR = 0.75  # least token-set similarity; calibrated on the aliases with a known entry

# fixed values: the alias table of log curves by reference key (public mnemonics of logging companies, and names)
CURVES = {
    "GR": "grgc|grc|gamma|gam|natural gamma ray|gamma ray|自然伽马",
    "SP": "ssp|spont|spbr|self potential|spontaneous potential|自然电位",
    "CALI": "calx|clpr|hcal|cal|caliper|hole caliper|井径",
    "RHOB": "rhoz|zden|denb|bden|bulk density|formation bulk density|体积密度",
    "DRHO": "zcor|hdra|dcor|density correction|bulk density correction",
    "NPHI": "cnc|tnph|neut|npor|neutron porosity|compensated neutron porosity|中子孔隙度",
    "DT": "dtc|dtco|sonic|ac|compressional slowness|sonic transit time|声波时差",
    "DTS": "dtsm|dtsh|shsl|shear slowness|shear transit time|横波时差",
    "RT": "rdeep|resd|ild|lld|deep resistivity|true formation resistivity|深电阻率",
    "RM": "rmed|ilm|resm|medium resistivity|medium depth resistivity",
    "RXO": "mll|msfl|rmicro|flushed zone resistivity|micro resistivity|微电阻率",
    "PEF": "pefz|phef|pe|photoelectric factor|photo electric absorption",
    "PHIE": "poreff|pige|epor|effective porosity|有效孔隙度",
    "PHIT": "port|tpor|phitot|total porosity|总孔隙度",
    "VSH": "shvol|vshale|vcl|shale volume|volume of shale|泥质含量",
    "SW": "wsat|swt|swe|water saturation|含水饱和度",
    "PERM": "klogh|permx|kint|permeability|intrinsic permeability|渗透率",
    "BS": "bit|bitsz|bsz|bit size|nominal bit diameter",
    "TENS": "ten|tensn|cten|cable tension|wireline tension",
    "URAN": "hura|urppm|sgur|uranium content|uranium concentration",
    "THOR": "htho|thppm|sgth|thorium content|thorium concentration",
    "POTA": "hfk|sgpk|potpc|potassium content|potassium concentration",
    "ROP": "ropa|drate|penr|rate of penetration|drilling rate average|钻时",
    "WOB": "bitwt|wtbit|woba|weight on bit|average bit weight",
    "TGAS": "totgas|gastot|tg|total gas|total mud gas|全烃",
    "TEMP": "wtmp|btemp|bhtc|borehole temperature|wellbore temperature|井温",
    "TVD": "truevd|vdep|tvdm|true vertical depth|垂深",
}
# fixed values: words of horizon names
POSITIONS = {"UPPER": "upper|up|upr|u|上", "LOWER": "lower|low|lwr|l|下"}
LITHOLOGIES = {
    "SANDSTONE": "sandstone|sand|sst|ss|砂岩",
    "SHALE": "shale|shl|sh|页岩|泥岩",
    "LIMESTONE": "limestone|lmst|lst|ls|灰岩",
    "SILTSTONE": "siltstone|silt|slst|sltst|粉砂岩",
    "ANHYDRITE": "anhydrite|anhyd|anh|硬石膏",
}
# endings that tell copies and stages apart, not curves
_STAGE = re.compile(r"([._:\- ](final|lwd|edit|raw|run ?\d+|r\d+|a|\d+)|\([^)]*\)| run \d+)$")
_AFFIX = {"top", "t", "of", "fm", "formation", "mbr", "member", "final", "depth", "顶面", "the"}


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().strip()


def tokens(text: str) -> list[str]:
    """Latin words with their digits, and runs of CJK characters."""
    return re.findall(r"[a-z0-9]+|[^\W\d_a-z]+", folded(text))


def slip(a: str, b: str) -> bool:
    """At most one edit (insertion, deletion, replacement or swap) apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@dataclass
class CanonicalList:
    """Spellings by entry, compiled for matching."""

    spellings: dict[str, list[str]]

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.exact: dict[str, str] = {}
        self.token_sets: list[tuple[frozenset, str, str]] = []
        for entry, names in self.spellings.items():
            for name in names:
                words = tokens(name)
                if not words:
                    continue
                padded = " " + " ".join(words) + " "
                owner = self.automaton.get(padded, None)
                if owner is None:
                    self.automaton.add_word(padded, (entry, len(padded)))
                self.exact.setdefault("".join(words), entry)
                self.token_sets.append((frozenset(words), "".join(words), entry))
        self.automaton.make_automaton()

    def mentioned(self, words: list[str]) -> str | None:
        """Entry of the longest mention; None where equally long ones disagree."""
        padded = " " + " ".join(words) + " "
        found = [(end - n + 1, end, entry) for end, (entry, n) in self.automaton.iter(padded)]
        kept: list = []
        for start, end, entry in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(end <= s + 1 or start + 1 >= e for s, e, _ in kept):
                kept.append((start, end, entry))
        longest = {entry for s, e, entry in kept if e - s == kept[0][1] - kept[0][0]}
        return longest.pop() if len(longest) == 1 else None

    def entry_of(self, words: list[str]) -> str | None:
        """Entry spelled by all words, else the one that all words spell up to
        slips, else that of the longest mention."""
        whole = self.exact.get("".join(words))
        mention = whole or self.mentioned(words)
        if mention and not whole:
            return self.similar(words, least=1.0) or mention
        return mention

    def similar(self, words: list[str], least: float = SIMILAR) -> str | None:
        """Entry of the greatest token-set similarity of at least `least`."""
        best: dict[str, float] = {}
        whole = "".join(words)
        for names, squeezed, entry in self.token_sets:
            left = set(words)
            hits = 0
            for name in names:
                hit = name if name in left else next((w for w in left if len(name) > 3 and slip(w, name)), None)
                if hit is not None:
                    left.discard(hit)
                    hits += 1
            score = hits / (len(names) + len(left)) if hits else 0.0
            if len(squeezed) > 4 and slip(whole, squeezed):
                score = 1.0  # a slip across words: a moved or lost space
            if score > best.get(entry, 0.0):
                best[entry] = score
        top = sorted(best.items(), key=lambda b: -b[1])[:2]
        if not top or top[0][1] < least or len(top) > 1 and top[1][1] == top[0][1]:
            return None
        return top[0][0]


def curve_aliases() -> list[tuple[str, str]]:
    """The alias table of log curves: (alias, entry)."""
    return [(alias, key) for key, line in CURVES.items() for alias in line.split("|")]


def curve_list(reference: list[tuple[str, str]], aliases: list[tuple[str, str]] | None = None) -> CanonicalList:
    """Reference curves (key, name) with their aliases."""
    spellings = {k: [k, n or k] for k, n in reference}
    for alias, key in curve_aliases() if aliases is None else aliases:
        if key in spellings:
            spellings[key].append(alias)
    return CanonicalList(spellings)


def horizon_list(groups: list[tuple[str, str]]) -> CanonicalList:
    """Horizons (key, name); spellings come from the rule: position and
    lithology words in any of their forms, the position before or after."""
    spellings: dict[str, list[str]] = {}
    for key, name in groups:
        parts = tokens(name)
        position = next((p for p in POSITIONS if parts and parts[0] == p.lower()), None)
        lithology = next((p for p in LITHOLOGIES if parts and parts[-1] == p.lower()), None)
        core = " ".join(parts[bool(position) : len(parts) - bool(lithology)])
        ends = [f"{core} {x}" for x in LITHOLOGIES[lithology].split("|")] if lithology else [core]
        if position:
            ends = [s for p in POSITIONS[position].split("|") for e in ends for s in (f"{p} {e}", f"{e} {p}")]
        spellings[key] = [name, *ends]
    return CanonicalList(spellings)


def resolve_curve(listed: CanonicalList, mnemonic: str | None, description: str | None) -> str:
    """Entry meant by a mnemonic or, where that says nothing, the description."""
    for text in (mnemonic, description):
        text = folded(text or "")
        while text:
            words = tokens(text)
            entry = listed.entry_of(words)
            if entry:
                return entry
            shorter = _STAGE.sub("", text)
            if shorter == text and len(words) == 1 and re.fullmatch(r"[a-z]{2,}\d", words[0]):
                shorter = words[0][:-1]
            if shorter == text:
                break
            text = shorter
        words = tokens(text)
        if len(words) > 1 or len("".join(words)) > 5:
            entry = listed.similar(words)
            if entry:
                return entry
    return UNMATCHED


def resolve_horizon(listed: CanonicalList, name: str | None) -> str:
    """Entry meant by a horizon name, affixes and versions aside."""
    words = [w for w in tokens(name or "") if w not in _AFFIX and not re.fullmatch(r"(v|ver|rev)?\d+", w)]
    if not words:
        return UNMATCHED
    return listed.entry_of(words) or listed.similar(words) or UNMATCHED


@functools.lru_cache(maxsize=8)
def _compiled(kind: str, keys: tuple, aliases: tuple | None = None):
    """One compiled list and its remembered answers per worker process."""
    if kind == "curve":
        return functools.lru_cache(maxsize=200_000)(functools.partial(resolve_curve, curve_list(list(keys), None if aliases is None else list(aliases))))
    return functools.lru_cache(maxsize=200_000)(functools.partial(resolve_horizon, horizon_list(list(keys))))


def _resolve_udf(kind: str, keys: list, aliases: list | None = None):
    """Every distinct value of a batch is resolved once."""
    keys, aliases = tuple(keys), None if aliases is None else tuple(aliases)

    def answers(values: pd.Series, resolve) -> pd.Series:
        codes, distinct = pd.factorize(values)
        said = [resolve(*v) for v in distinct]
        return pd.Series([said[c] for c in codes], dtype=object)

    def plain(names: pd.Series) -> pd.Series:
        return names.astype(object).where(names.notna(), None)

    def one(names: pd.Series) -> pd.Series:
        return answers(pd.Series([(n,) for n in plain(names)], dtype=object), _compiled(kind, keys))

    def two(names: pd.Series, texts: pd.Series) -> pd.Series:
        return answers(pd.Series(list(zip(plain(names), plain(texts))), dtype=object), _compiled(kind, keys, aliases))

    return F.pandas_udf(two if kind == "curve" else one, T.StringType())


def squeezed(c: str) -> Column:
    """Letters and digits of a name, small; null where there are none."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def _also_known(resolved: DataFrame, spelled: DataFrame) -> DataFrame:
    """record_id, canonical_key of rows (record_id, spelling, canonical_key): unmatched
    ones take the entry that all rows spelled (spelling, entry) alike have. Spellings join
    by equality; rows without one are spread by their id."""
    learned = spelled.where("spelling is not null and entry is not null").groupBy("spelling").agg(F.min("entry").alias("entry"), F.max("entry").alias("other")).where("entry = other").select("spelling", "entry")
    rows = resolved.withColumn("spelling", F.coalesce("spelling", F.concat(F.lit("\u0000"), F.col("record_id").cast("string"))))
    key = F.when(F.col("canonical_key") == UNMATCHED, F.coalesce("entry", F.lit(UNMATCHED))).otherwise(F.col("canonical_key"))
    return rows.join(learned, "spelling", "left").select("record_id", key.alias("canonical_key"))


def curve_entries(curves: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """record_id, canonical_key of the curves whose mnemonic is not letter for
    letter a reference key. Null and empty mnemonics are judged by their description,
    for which the descriptions of curves under a reference key are spellings too. The
    reference and the aliases (alias, entry) are fixed lists and collected; repeated rows
    are resolved alike; an empty table gives no rows."""
    keys = [(r["curve_key"], r["curve_name"]) for r in reference.select("curve_key", "curve_name").where("curve_key is not null").collect()]
    known = None if aliases is None else [(r["alias"], r["entry"]) for r in aliases.select("alias", "entry").where("alias is not null").collect()]
    udf = _resolve_udf("curve", keys, known)
    listed = F.col("mnemonic").isin([k for k, _ in keys])
    rows = curves.select("id", "mnemonic", "description", squeezed("description").alias("spelling")).where(F.col("mnemonic").isNull() | ~listed)
    resolved = rows.select(F.col("id").alias("record_id"), "spelling", udf("mnemonic", "description").alias("canonical_key"))
    return _also_known(resolved, curves.where(listed).select(squeezed("description").alias("spelling"), F.col("mnemonic").alias("entry")))


def horizon_entries(aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id, canonical_key of the aliases without a canonical_key; the names of
    those with one are spellings of it. See curve_entries for the rest."""
    keys = [(r["canonical_key"], r["canonical_name"]) for r in groups.select("canonical_key", "canonical_name").where("canonical_key is not null").collect()]
    udf = _resolve_udf("horizon", keys)
    rows = aliases.where("canonical_key is null").select("alias_id", "alias_name", squeezed("alias_name").alias("spelling"))
    resolved = rows.select(F.col("alias_id").alias("record_id"), "spelling", udf("alias_name").alias("canonical_key"))
    return _also_known(resolved, aliases.where("canonical_key is not null").select(squeezed("alias_name").alias("spelling"), F.col("canonical_key").alias("entry")))
