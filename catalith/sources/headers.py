"""What the columns of a list are for, told by their names; only names are looked at, so all of this is on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from catalith.functions import tables as t

#: Rows at the top of a sheet among which the column names are looked for.
HEADER_ROWS = 5
_EMPTY = ("", "nan", "None", "Unnamed: 0")


@dataclass(frozen=True)
class Roles:
    brand: str | None
    category: str | None
    name: str | None
    storage: str | None


def _first(columns: Sequence[str], test: Callable[[str], bool]) -> str | None:
    return next((c for c in columns if test(c.lower().strip())), None)


def _holds(column: str, words: Sequence[str]) -> bool:
    return any(w in column for w in words)


def _of_category(column: str) -> bool:
    return _holds(column.replace(" ", "_"), [w.replace(" ", "_") for w in t.CATEGORY_COLUMNS])


def brand_column(columns: Sequence[str]) -> str | None:
    return _first(columns, lambda c: _holds(c, t.BRAND_COLUMNS))


def category_column(columns: Sequence[str]) -> str | None:
    return _first(columns, _of_category)


def storage_column(columns: Sequence[str]) -> str | None:
    return _first(columns, lambda c: _holds(c, t.STORAGE_COLUMNS))


def name_column(columns: Sequence[str]) -> str | None:
    """A known name of such columns, in the order of the list; else a model that is
    no id; else any word for a product that is neither a category nor an id."""
    known = {c.lower().strip(): c for c in reversed(columns)}
    exact = next((known[n] for n in t.EXACT_NAME_COLUMNS if n in known), None)
    named = lambda c: not _holds(c, t.NOT_NAME_COLUMNS)
    return exact or _first(columns, lambda c: "model" in c and "type" not in c and named(c)) or _first(columns, lambda c: _holds(c, t.NAME_COLUMNS) and not _of_category(c) and named(c))


def roles(columns: Sequence[str]) -> Roles:
    """All roles; without a column of names the last one that is no category takes the role."""
    category, name = category_column(columns), name_column(columns)
    if name is None and columns:
        name = next((c for c in reversed(columns) if c != category), columns[-1])
    return Roles(brand_column(columns), category, name, storage_column(columns))


def url_column(columns: Sequence[str]) -> str | None:
    return _first(columns, lambda c: c in t.URL_COLUMNS)


def is_catalog_sheet(name: str, words: Sequence[str] = t.CATALOG_SHEETS) -> bool:
    return _holds(name.lower().strip(), words)


def header_row(rows: Sequence[Sequence[object]]) -> int:
    """The first of the top rows with two texts and more, else the second."""
    filled = [sum(isinstance(v, str) and bool(v.strip()) for v in row) for row in rows[:HEADER_ROWS]]
    return next((i for i, n in enumerate(filled) if n >= 2), 1)


def headers(cells: Sequence[object], width: int) -> tuple[list[str], int]:
    """Column names of a sheet of ``width`` columns, and how many empty ones lead and go."""
    said = ["" if c is None else str(c).strip() for c in cells]
    skip = next((i for i, c in enumerate(said) if c not in _EMPTY), len(said))
    kept = said[skip:][: max(0, width - skip)]
    return kept + [f"col_{i}" for i in range(len(kept), width - skip)], skip


def first_existing(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The first of the wanted columns that is there."""
    return next((c for c in wanted if c in columns), None)


def named_columns(columns: Sequence[str]) -> list[str]:
    """Columns that have a name of their own."""
    return [c for c in columns if c.strip() and not c.startswith("Unnamed")]
