"""A catalog and an input list composed from the keys of the test tables.

The test tables hold no electronics, so product texts follow from integer keys,
by expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re


def _pick(key: str, n: int, *values: str) -> str:
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


def _text(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _number(key: str, low: int, span: int) -> str:
    return f"CAST({low} + {key} % {span} AS STRING)"


def _storage(k: str) -> str:
    return _pick(k, 3, "64GB", "128GB", "256GB")


def _phone(k: str) -> str:
    line = _pick(k, 7, "iPhone ", "Galaxy S", "Pixel ", "Redmi Note ", "Reno", "P", "Moto G")
    return _text(line, _number(k, 8, 11), _pick(k, 4, "", " Pro", " Plus", " Ultra"), "' '", _storage(k))


def _tablet(k: str) -> str:
    ipad = _text("'iPad '", _pick(k, 4, "Pro 11 inch ", "Air ", "Mini ", ""), _number(k, 4, 5), "'th Gen WiFi '", _storage(k))
    tab = _text("'Galaxy Tab S'", _number(k, 5, 5), _pick(k, 3, "", " Plus", " Ultra"), "' '", _storage(k))
    pad = _text("'MatePad '", _pick(k, 2, "Pro 10.8 ", "SE "), _storage(k))
    return f"CASE {k} % 3 WHEN 0 THEN {ipad} WHEN 1 THEN {tab} ELSE {pad} END"


def _watch(k: str) -> str:
    return _text("'Watch '", _pick(k, 3, "Series ", "Ultra ", "Series "), _number(k, 1, 9), "' '", _pick(k, 4, "40", "44", "45", "49"), "'mm '", _pick(k, 2, "GPS", "GPS + Cellular"), _pick(k, 5, " Aluminium", " Stainless Steel", " Titanium", "", ""))


def _laptop(k: str) -> str:
    cpu = _pick(k, 4, "Core i5-1145G7", "Core i7 11th Gen", "Ryzen 5 5500U", "Core i5-8250U")
    size = _text("' '", _pick(k, 3, "8GB", "16GB", "32GB"), "' '", _pick(k, 2, "256GB", "512GB"))
    dell = _text("'Latitude 5'", "CAST(320 + " + k + " % 9 AS STRING)", "' '", cpu, size)
    hp = _text("'EliteBook 840 G'", _number(k, 5, 5), "' '", cpu, size)
    lenovo = _text("'ThinkPad T1'", _number(k, 4, 2), "' Gen '", _number(k, 1, 4), "' '", cpu, size)
    mac = _text("'MacBook '", _pick(k, 2, "Pro", "Air"), "' 13 inch M'", _number(k, 1, 3), "' 8GB '", _pick(k, 2, "256GB", "512GB"), "' 20'", _number(k, 20, 4))
    asus = _text("'ROG Zephyrus GA401 '", cpu, size)
    acer = _text("'Swift 3 SF314-5'", _number(k, 5, 5), "' '", cpu, size)
    return f"CASE {k} % 6 WHEN 0 THEN {dell} WHEN 1 THEN {hp} WHEN 2 THEN {lenovo} WHEN 3 THEN {mac} WHEN 4 THEN {asus} ELSE {acer} END"


def _brand(k: str) -> str:
    phone = _pick(k, 7, "Apple Inc.", "Samsung Electronics", "Google LLC", "Xiaomi", "OPPO", "Huawei Technologies", "Motorola")
    tablet = _pick(k, 3, "Apple", "Samsung", "Huawei")
    laptop = _pick(k, 6, "Dell Inc", "HP OLD", "Lenovo New", "Apple", "Asus", "Acer")
    return f"CASE {k} % 5 WHEN 0 THEN {phone} WHEN 1 THEN {tablet} WHEN 2 THEN 'Apple' WHEN 3 THEN {laptop} ELSE {phone} END"


def _name(k: str) -> str:
    return f"CASE {k} % 5 WHEN 0 THEN {_phone(k)} WHEN 1 THEN {_tablet(k)} WHEN 2 THEN {_watch(k)} WHEN 3 THEN {_laptop(k)} ELSE {_phone('(' + k + ' * 3 + 1)')} END"


def _category(k: str) -> str:
    return f"CASE {k} % 5 WHEN 1 THEN 'Tablets' WHEN 2 THEN 'Smart Watch' WHEN 3 THEN 'Laptops' ELSE 'Mobile Phone' END"


_K = "p_partkey"
#: The raw catalog; some keys give names that cleaning drops.
CATALOG = {
    "nl_pos": _K,
    "uae_assetid": f"concat('A', CAST({_K} AS STRING))",
    "nl_category": _category(_K),
    "nl_brand": f"CASE WHEN {_K} % 89 = 0 THEN 'Promo' WHEN {_K} % 83 = 0 THEN NULL ELSE CASE {_K} % 5 WHEN 4 THEN {_brand('(' + _K + ' * 3 + 1) * 5')} ELSE {_brand(_K)} END END",
    "nl_name": f"CASE WHEN {_K} % 101 = 0 THEN NULL WHEN {_K} % 97 = 0 THEN 'Test device' WHEN {_K} % 79 = 0 THEN 'All models' WHEN {_K} % 73 = 0 THEN '11' ELSE {_name(_K)} END",
}
_R = "o_orderkey"
_I = "(o_orderkey % 997)"
#: The input list: the same products, said less neatly.
INPUT = {
    "row_id": _R,
    "source_sheet": f"CASE {_R} % 3 WHEN 0 THEN 'List 1' WHEN 1 THEN 'List 2' ELSE 'List 3' END",
    "base_brand": _brand(_I),
    "base_name": _name(_I),
    "in_category": f"CASE WHEN {_R} % 5 = 0 THEN 'other' ELSE {_category(_I)} END",
}
INPUT_LAYER = {
    "in_brand": "CASE WHEN row_id % 6 = 0 THEN NULL WHEN row_id % 7 = 0 THEN lower(base_brand) ELSE base_brand END",
    "in_name": f"CASE WHEN row_id % 113 = 0 THEN '' WHEN row_id % 4 = 0 THEN concat(lower(base_name), {_pick('row_id', 3, ' bleu', ' Black', ' Space Grey')}) WHEN row_id % 4 = 1 THEN replace(base_name, 'GB', ' GB') WHEN row_id % 4 = 2 THEN concat(base_name, ' (20', CAST(18 + row_id % 5 AS STRING), ') 5G') ELSE base_name END",
    "in_url": f"concat({_pick('row_id', 4, 'https://www.shop.example/fr/', 'see https://shop.example/p/', '//shop.example/', 'shop.example/products/')}, lower(replace(replace(base_name, ' ', '-'), '+', '')), {_pick('row_id', 5, '', '.html', '-bleu-1', '/12345', '?ref=a')})",
}


def inlined(x: str) -> str:
    """An expression of ``INPUT_LAYER`` over the table itself."""
    for name in ("base_brand", "base_name", "row_id"):
        x = re.sub(rf"\b{name}\b", lambda _, n=name: f"({INPUT[n]})", x)
    return x
