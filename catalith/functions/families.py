"""Keys of model families: what products of one line have in common, for gaps and requests."""

from __future__ import annotations

from catalith.functions import attributes as a
from catalith.functions import tables as t
from catalith.functions.dialect import Dialect
from catalith.functions.text import normalize_brand, normalize_text

Layer = dict[str, str]


def galaxy_number(d: Dialect, model: str) -> str:
    return d.ext(f"lower({model})", r"\b([sazm]\d{1,3})\b")


def galaxy_variant(d: Dialect, model: str, text: str) -> str:
    """The first variant word of the model or its text, else ``base``."""
    padded = f"concat(' ', lower({model}), ' ', lower({text}), ' ')"
    return d.case(*((d.contains(padded, f" {w} "), f"'{w}'") for w in t.GALAXY_VARIANTS), other="'base'")


def _named(d: Dialect, *parts: str) -> str:
    """Parts with one blank between them, as they are, trimmed."""
    inner = ", ' ', ".join(parts)
    return f"trim(concat({inner}))"


def _phone(d: Dialect, x: str, brand: str) -> list[tuple[str, str]]:
    """Rules of phones: when they hold, and the key that they give."""
    def found(pattern: str, group: int = 1) -> str:
        return d.ext(x, pattern, group)

    def first(*words: str) -> str:
        return d.first_of(x, words)

    number, galaxy = found(r"iphone\s*(\d+)"), r"galaxy\s+(s|a|z\s*(?:fold|flip)|note|m|f)\s*(\d+)"
    pixel = found(r"pixel\s*(\d+[a-z]?)")
    pixel_kind = d.case(*((f"(contains({x}, concat('pixel ', {pixel}, ' {v}')) OR contains({x}, concat('pixel', {pixel}, '{v}')))", f"'{v}'") for v in ("pro", "xl", "a")))
    oneplus, huawei = found(r"oneplus\s+(\S+(?:\s+\S+)?)"), found(r"(p\d+|mate\s*\d+|nova\s*\d+)")
    code = found(r"\b([a-z]{3})\s*[a-z]?\d{2,3}\b")
    xiaomi = found(r"xiaomi\s+(\d+[a-z]?(?:\s+(?:pro|plus|ultra|lite|t))*)")
    moto, moto_n = found(r"moto\s*(g|e|x|z)"), found(r"moto\s*(?:g|e|x|z)\s*(\d+)")
    edge_n = found(r"^.*?edge\s*(\d+)?")
    lumia, nokia = found(r"lumia\s*(\d+)"), found(r"nokia\s+(\d[\d.]*)")
    sm, letter = d.rep(found(r"((?:gt|sm)[\s-]?[a-z]\d{3,5})"), r"\s+", "-"), found(r"(?:gt|sm)[\s-]?([a-z])\d{3,5}")
    line = d.lookup(letter, t.SAMSUNG_LETTERS, "''")
    rules = [
        (f"{d.contains(x, 'iphone')} AND {d.contains(x, 'se')} AND {number} = ''", _named(d, "'iphone se'", found(r"(20\d{2})"))),
        (f"{number} <> ''", _named(d, "'iphone'", number, first("pro max", "pro", "plus", "mini"))),
        (f"{found(galaxy, 2)} <> ''", _named(d, "'galaxy'", f"concat({d.rep(found(galaxy, 1), ' ', '')}, {found(galaxy, 2)})", first("ultra", "plus", "fe", "lite", "power"))),
        (f"{pixel} <> ''", _named(d, "'pixel'", pixel, pixel_kind)),
        (f"{oneplus} <> ''", _named(d, "'oneplus'", f"substr({oneplus}, 1, 20)")),
        (f"{huawei} <> ''", _named(d, "'huawei'", d.squeeze(huawei), first("pro", "lite", "plus", "max", "ultra"))),
        (f"({d.contains(x, 'huawei')} OR {brand} = 'huawei') AND {code} <> ''", _named(d, "'huawei'", code)),
        (f"{xiaomi} <> ''", _named(d, "'xiaomi'", xiaomi)),
    ]
    for name in ("redmi note", "redmi", "poco"):
        own = found(rf"{name}\s+(\w+\d+\w*)")
        rules.append((f"{own} <> ''", _named(d, f"'{name}'", own)))
    return [
        *rules,
        (f"{moto} <> ''", _named(d, f"concat('moto ', {moto}, {moto_n})", first("plus", "power", "play", "stylus"))),
        (f"{d.contains(x, 'edge')} AND {d.contains(x, 'moto')}", _named(d, "'moto edge'", edge_n, first("pro", "plus", "ultra", "neo", "lite"))),
        (f"{lumia} <> ''", _named(d, "'lumia'", lumia)),
        (f"{nokia} <> ''", _named(d, "'nokia'", nokia)),
        (f"{letter} <> '' AND {line} <> ''", f"concat({line}, ' (', {sm}, ')')"),
        (f"{letter} <> ''", _named(d, "'samsung'", sm)),
    ]


def _tablet(d: Dialect, x: str) -> list[tuple[str, str]]:
    kind = d.either(d.ext(x, r"^.*?ipad\s*(pro|air|mini)?"), "'base'")
    size, gen = d.rep(d.ext(x, r"(\d{1,2}[\.\s]\d)\s*(?:inch|\")?"), " ", "."), d.ext(x, r"(\d+)(?:th|st|nd|rd)\s*gen")
    made = f"CASE WHEN {gen} <> '' THEN concat('gen', {gen}) ELSE {d.ext(x, r'(20\d{2})')} END"
    tab = d.ext(x, r"galaxy\s*tab\s*(\w+\+?)")
    variant = d.case(*((f"{d.contains(x, v)} AND {tab} <> '{v}'", f"'{v}'") for v in ("fe", "ultra", "plus", "lite")))
    pad = r"(mediapad|matepad)\s*(pro|air|se)?\s*(\d[\d.]*)?"
    surface = r"surface\s*(pro|go)\s*(\d+)?"
    return [
        (d.contains(x, "ipad"), _named(d, "'ipad'", kind, size, made)),
        (f"{tab} <> ''", _named(d, "'galaxy tab'", tab, variant)),
        (f"{d.ext(x, surface)} <> ''", _named(d, "'surface'", d.ext(x, surface), d.ext(x, surface, 2))),
        (f"{d.ext(x, pad)} <> ''", _named(d, "'huawei'", d.ext(x, pad), d.ext(x, pad, 2), d.ext(x, pad, 3))),
    ]


def _watch(d: Dialect, x: str) -> list[tuple[str, str]]:
    apple, galaxy = d.squeeze(d.ext(x, r"apple\s*watch\s*(ultra\s*\d*|series\s*\d+|se)\b")), r"^.*?galaxy\s*watch\s*(\d+)?\s*(classic|active\s*\d*|ultra|fe)?"
    size = d.rep(d.ext(x, r"(\d{2}\s*mm)"), r"\s", "")
    other = d.ext(x, r"(watch\s*gt\s*\d*|watch\s*fit\s*\d*|watch\s*\d+)")
    return [
        (f"{apple} <> ''", _named(d, "'apple watch'", apple, size)),
        (d.has(x, r"galaxy\s*watch"), d.joined(" ", "'galaxy watch'", d.ext(x, galaxy), f"trim({d.ext(x, galaxy, 2)})", size)),
        (f"{other} <> ''", _named(d, "'huawei'", other)),
    ]


def family_layers(d: Dialect, text: str, category: str, brand: str) -> list[Layer]:
    """Columns ``family_category`` and ``family_key``; laptops and what no rule knows have the empty key."""
    def key(rules: list[tuple[str, str]]) -> str:
        return d.case(*rules)

    phone, tablet, watch = _phone(d, "fk_text", "fk_brand"), _tablet(d, "fk_text"), _watch(d, "fk_text")
    return [
        {"fk_text": normalize_text(d, text), "fk_brand": f"lower(coalesce({brand}, ''))", "family_category": a.infer_category(d, text, brand, category)},
        {"family_key": d.case(("fk_text = ''", "''"), ("lower(family_category) IN ('mobile', 'mobile phone', 'phone', '')", key(phone)), ("lower(family_category) IN ('tablet', 'tab')", key(tablet)), ("lower(family_category) IN ('watch', 'smartwatch')", key(watch)))},
    ]


def group_layer(d: Dialect, brand: str, words: int = 3) -> Layer:
    """The family key, else the brand with the first words of the text."""
    own = d.either(normalize_brand(d, brand), "fk_brand")
    head = d.join(d.slice(d.split("fk_text"), words), " ")
    return {"group_key": f"CASE WHEN family_key <> '' THEN family_key WHEN fk_text <> '' THEN concat({own}, ':', {head}) ELSE {own} END"}
