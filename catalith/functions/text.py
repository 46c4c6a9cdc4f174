"""Normalization of brands, product texts and links."""

from __future__ import annotations

from catalith.functions import tables as t
from catalith.functions.dialect import Dialect

_FIRST_WORD = {b: b for b in t.KNOWN_BRANDS}
for _alias, _brand in t.BRAND_ALIASES.items():
    _FIRST_WORD.setdefault(_alias.split()[0], _brand)
_FIRST_WORD |= t.LINE_BRANDS


def normalize_brand(d: Dialect, brand: str) -> str:
    """Alias, else the brand without one legal suffix, or that one's alias."""
    low = f"lower(trim(coalesce({brand}, '')))"
    short = f"trim({d.rep(low, t.BRAND_SUFFIX, '')})"
    return d.lookup(low, t.BRAND_ALIASES, d.lookup(short, t.BRAND_ALIASES, d.either(short, low)))


def infer_brand(d: Dialect, name: str) -> str:
    """The brand that the first word tells, without trailing digits if need be."""
    first = d.ext(f"lower(coalesce({name}, ''))", r"^\s*(\S+)")
    bare = d.rep(first, r"\d+$", "")
    return d.lookup(first, _FIRST_WORD, f"CASE WHEN {bare} <> {first} THEN {d.lookup(bare, t.LINE_BRANDS, d.q(''))} ELSE '' END")


def is_url(d: Dialect, x: str) -> str:
    low = f"lower(trim(coalesce({x}, '')))"
    return f"({d.has(low, r'^(?:https?://|www\.|//)')} OR {d.has(low, 'https?://')} OR {d.has(low, r'[a-z0-9][-a-z0-9]*\.[a-z]{2,}/')})"


def _slug_name(d: Dialect, slug: str) -> str:
    steps = [(r"(?i)\.(?:html?|php|aspx?|jsp)$", ""), (r"[?#].*", ""), ("[-_]", " "), (r"\b[0-9a-f]{8,}\b", "")]
    return d.squeeze(d.steps(slug, steps))


def _good_slug(d: Dialect, name: str) -> str:
    return f"(length({name}) >= 4 AND {d.has(name, '[a-zA-Z]')} AND NOT {d.has(name, '^[0-9a-f-]{20,}$')})"


def url_path(d: Dialect, url: str) -> str:
    """The path of a link whose scheme may be missing or that stands in a sentence."""
    raw = f"trim(coalesce({url}, ''))"
    whole = d.case((d.has(raw, r"https?://\S"), d.ext(raw, r"(https?://\S+)")), (d.starts(raw, "'//'"), f"concat('https:', {raw})"), (d.has(raw, r"(?i)^[a-z0-9][-a-z0-9]*\.[a-z]{2,}/"), f"concat('https://', {raw})"), other=raw)
    return d.rep(d.ext(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"), "^/+|/+$", "")


def url_name(d: Dialect, path: str) -> str:
    """The last segment of a path that reads like a name, else the last one if it has 4 letters."""
    segments = d.split_on(f"url_decode({d.rep(path, '[+]', '%2B')})", "/")
    names = d.each(segments, lambda e: _slug_name(d, e))
    last, best = d.at(d.reverse(names), 0), d.at(d.reverse(d.keep(names, lambda e: _good_slug(d, e))), 0)
    return f"CASE WHEN {path} = '' THEN '' ELSE coalesce({best}, CASE WHEN length({last}) >= 4 THEN {last} ELSE '' END) END"


def _words(d: Dialect, x: str) -> str:
    return d.split(d.squeeze(f"coalesce({x}, '')"))


def strip_colours(d: Dialect, x: str) -> str:
    return d.join(d.keep(_words(d, x), lambda e: f"NOT {d.isin(f'lower({e})', t.COLOURS)}"), " ")


def clean_url_name(d: Dialect, x: str) -> str:
    """Without grades, colours, words on SIM and region, and trailing short numbers."""
    noise = [*t.COLOURS, *t.LINK_NOISE]
    plain = d.rep(f"coalesce({x}, '')", r"(?i)\b[abc]\s+grade\b", "")
    kept = d.keep(_words(d, plain), lambda e: f"NOT {d.isin(f'lower({e})', noise)} AND NOT {d.isin(d.rep(f'lower({e})', '[0-9]+$', ''), noise)}")
    return f"trim({d.rep(d.join(kept, ' '), '((^| )[0-9]{1,2})+$', '')})"


def normalize_text(d: Dialect, x: str) -> str:
    """The canonical form of a product text; the order of the rewrites is part of it."""
    low = f"lower(trim(coalesce({x}, '')))"
    return d.squeeze(d.steps(low, [*t.NORMALIZE_BEFORE, *t.NORMALIZE_GENERATION, *t.NORMALIZE_AFTER]))


def match_text(d: Dialect, brand: str, name: str) -> str:
    """Brand and name, before normalization; the brand once."""
    own, said = d.either(normalize_brand(d, brand), f"trim(coalesce({brand}, ''))"), f"trim(coalesce({name}, ''))"
    return f"CASE WHEN {said} = '' THEN {own} WHEN {own} <> '' AND {d.starts(f'lower({said})', f'lower({own})')} THEN {said} ELSE trim(concat({own}, ' ', {said})) END"


def laptop_text(d: Dialect, x: str) -> str:
    """Screen sizes in inches, of parentheses only what tells a product, no words of retail."""
    sized = d.steps(f"coalesce({x}, '')", [("([0-9]+\\.?[0-9]*)\\s*[\"″“”]", "$1 inch"), (r"(?i)(\d+\.?\d*)\s*inch(?:es)?\b", "$1 inch")])

    def telling(said: str) -> str:
        return d.join(d.keep(d.split_on(said, " *, *"), lambda p: d.has(f"lower({p})", t.LAPTOP_IDENTITY), "p"), " ")

    inner = d.each(d.ext_all(sized, r"\(([^)]*)\)"), telling)
    return d.squeeze(d.rep(d.woven(d.split_on(sized, r"\([^)]*\)"), inner), t.LAPTOP_NOISE, " "))


def device_type(d: Dialect, x: str) -> str:
    low = f"lower(trim({x}))"
    return d.lookup(low, t.DEVICE_TYPES, low)


def duplicate_key(d: Dialect, x: str) -> str:
    return d.rep(f"lower(coalesce({x}, ''))", "[^a-z0-9]", "")
