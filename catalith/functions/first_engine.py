"""The first engine's text functions where they differ from today's."""

from __future__ import annotations

from catalith.functions import tables as t
from catalith.functions.dialect import Dialect
from catalith.functions.text import _slug_name, _words


def is_url(d: Dialect, x: str) -> str:
    return f"({d.has(f'lower(trim(coalesce({x}, {chr(39) * 2})))', r'^(?:https?://|www\.)')})"


def url_path(d: Dialect, url: str) -> str:
    """The path of a link as it is; a link without a scheme is all path."""
    raw = f"trim(coalesce({url}, ''))"
    whole = d.case((d.has(raw, r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), d.ext(raw, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)")), (d.starts(raw, "'//'"), d.ext(raw, r"^//[^/?#]*([^?#]*)")), other=d.ext(raw, r"^([^?#]*)"))
    return d.rep(whole, "^/+|/+$", "")


def _good_slug(d: Dialect, name: str) -> str:
    return f"(length({name}) >= 4 AND {d.has(name, '[a-zA-Z]')} AND {d.has(name, '[0-9]')} AND NOT {d.has(name, '^[0-9a-f-]{20,}$')} AND NOT {d.isin(f'lower({name})', t.FIRST_PATH_WORDS)})"


def url_name(d: Dialect, path: str) -> str:
    """The last segment with letters and digits, else the last one if it has 4 letters."""
    names = d.each(d.split_on(f"url_decode({d.rep(path, '[+]', '%2B')})", "/"), lambda e: _slug_name(d, e))
    last, best = d.at(d.reverse(names), 0), d.at(d.reverse(d.keep(names, lambda e: _good_slug(d, e))), 0)
    return f"CASE WHEN {path} = '' THEN '' ELSE coalesce({best}, CASE WHEN length({last}) >= 4 THEN {last} ELSE '' END) END"


def strip_colours(d: Dialect, x: str) -> str:
    """Without colours and words of links, nor single letters and small numbers at the end."""
    kept = d.join(d.keep(_words(d, x), lambda e: f"NOT {d.isin(f'lower({e})', t.FIRST_COLOURS)}"), " ")
    return f"trim({d.rep(kept, '((^| )([^ ]|0*[0-9]))+$', '')})"


def normalize_text(d: Dialect, x: str) -> str:
    """Without the rewrites of split brand names and of plus signs."""
    low = f"lower(trim(coalesce({x}, '')))"
    return d.squeeze(d.steps(low, [*t.NORMALIZE_BEFORE, *t.NORMALIZE_GENERATION, *t.NORMALIZE_AFTER[2:]]))
