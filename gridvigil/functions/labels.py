"""Label columns: clean-up, mapping, collapsing, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = "Normal"
ATTACK = "Attack"

# --- fixed values: label spellings of the public data sets ---
SWAT_LABELS = {"Normal": "Normal", "Attack": "Attack", "A ttack": "Attack"}
WUSTL_LABELS = {
    "normal": "Normal",
    "dos": "DoS",
    "reconnaissance": "Reconnaissance",
    "mitm": "MitM",
    "injection": "Injection",
    "backdoor": "Backdoor",
}
FIVE_CLASSES = {
    "normal": "Normal",
    "dos": "DoS",
    "denialofservice": "DoS",
    "recon": "Reconn",
    "reconnaissance": "Reconn",
    "scan": "Reconn",
    "command": "CommInj",
    "commandinjection": "CommInj",
    "comminj": "CommInj",
    "injection": "CommInj",
    "backdoor": "Backdoor",
}
NORMAL_TEXTS = ["0", "normal", "false", "nan", ""]
# --- end of fixed values ---


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value for ``key`` in a literal map, else null."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def mapped_or_same(raw: Column, table: dict[str, str]) -> Column:
    """Trimmed text replaced through ``table``; other texts pass."""
    return F.coalesce(lookup(F.trim(raw), table), F.trim(raw))


def mapped_or_title(raw: Column, table: dict[str, str]) -> Column:
    """Lower-case trimmed text replaced through ``table``; other texts in title case."""
    key = F.lower(F.trim(raw))
    return F.coalesce(lookup(key, table), F.initcap(key))


def letters_only(raw: Column, binary: bool = False) -> Column:
    """Keep letters, title case; with ``binary`` all but Normal is Attack."""
    clean = F.initcap(F.regexp_replace(raw, "[^A-Za-z]", ""))
    return collapsed(clean) if binary else clean


def truthy_label(raw: Column) -> Column:
    """Zero, false, normal, NaN, empty and missing are Normal; all else is Attack."""
    text = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    zero = F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when(text.isin(NORMAL_TEXTS) | zero, NORMAL).otherwise(ATTACK)


def any_indicator(columns: Sequence[str]) -> Column:
    """Attack when any indicator is positive or true."""

    def raised(name: str) -> Column:
        text = F.lower(F.trim(F.col(name).cast("string")))
        number = F.when(text == "true", F.lit(1.0)).otherwise(text.try_cast("double"))
        return F.coalesce(number > 0, F.lit(False))

    hit = raised(columns[0])
    for name in columns[1:]:
        hit = hit | raised(name)
    return F.when(hit, ATTACK).otherwise(NORMAL)


def five_class(raw: Column) -> Column:
    """Name in the five-class taxonomy by its letters; unknown names pass."""
    text = F.trim(raw)
    return F.coalesce(lookup(F.regexp_replace(F.lower(text), "[^a-z]", ""), FIVE_CLASSES), text)


def collapsed(label: Column, normal_label: str = NORMAL) -> Column:
    return F.when(label == normal_label, normal_label).otherwise(ATTACK)


def encoded(label: Column, classes: Sequence[str]) -> Column:
    """0-based index of a label in the sorted class list; null for an unknown label."""
    position = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), label)
    return F.when(position > 0, (position - 1).cast("int"))


def decoded(code: Column, classes: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in sorted(classes)]), code.cast("int") + 1)
