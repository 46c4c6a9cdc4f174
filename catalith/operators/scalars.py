"""The scalar operators as registered plans: one narrow pass each."""

from __future__ import annotations

from catalith.functions import attributes as a
from catalith.functions import families
from catalith.functions import text as x
from catalith.functions.dialect import Dialect
from catalith.plans.layers import Layer, Plan
from catalith.sources.fixtures import CATALOG, INPUT, INPUT_LAYER, inlined


#: The input list with its composed texts.
_LISTED = INPUT | {n: inlined(x) for n, x in INPUT_LAYER.items()}


def _listing(layers, columns: list[str], keys: tuple[str, ...] = ("in_name",)) -> Plan:
    """A plan over the input list; each text is worked on once."""
    return Plan("orders", {n: _LISTED[n] for n in {"row_id": 0, **dict.fromkeys(c for c in columns if c in _LISTED), **dict.fromkeys(keys)}}, layers, columns, keys=list(keys))


def _one(name: str, fn, source: str = "orders", columns: tuple[str, ...] = (), arg: str = "in_name") -> Plan:
    """An operator over the normalized or raw input name."""
    if source == "orders":
        return _listing(lambda d: [{name: fn(d, arg)}], ["row_id", *columns, name], (arg,))
    return Plan(source, CATALOG, lambda d: [{name: fn(d, arg)}], ["nl_pos", *columns, name])


def _normalized(name: str, fn, columns: tuple[str, ...] = ()) -> Plan:
    return _listing(lambda d: [{"norm": x.normalize_text(d, "in_name")}, {name: fn(d, "norm")}], ["row_id", "norm", *columns, name])


def _laptop(d: Dialect) -> list[Layer]:
    return a.laptop_layers(d, "in_name", "in_brand")


def _attributes(d: Dialect) -> list[Layer]:
    return a.extract(d, "in_name", "in_brand")


def _texts(name: str, fn) -> Plan:
    """The same operator over free text: whole documents of every language."""
    return Plan("documents", {"doc_id": "doc_id", "body": "text"}, lambda d: [{name: fn(d, "body")}], ["doc_id", name])


PLANS: dict[str, Plan] = {
    "n1_brand": Plan("part", CATALOG, lambda d: [{"brand_norm": x.normalize_brand(d, "nl_brand")}], ["nl_pos", "nl_brand", "brand_norm"]),
    "n4_infer_brand": _one("inferred", x.infer_brand),
    "n6_is_url": _one("is_url", x.is_url, arg="in_url"),
    "n7_url_name": _listing(lambda d: [{"path": x.url_path(d, "in_url")}, {"url_name": x.url_name(d, "path")}], ["row_id", "in_url", "url_name"], ("in_url",)),
    "n7_page_url_name": Plan("pages", {"page_id": "page_id", "url": "url"}, lambda d: [{"path": x.url_path(d, "url")}, {"url_name": x.url_name(d, "path")}], ["page_id", "url_name"]),
    "n10_colors": _one("plain", x.strip_colours),
    "n12_url_clean": _listing(lambda d: [{"path": x.url_path(d, "in_url")}, {"url_name": x.url_name(d, "path")}, {"clean": x.clean_url_name(d, "url_name")}], ["row_id", "clean"], ("in_url",)),
    "n13_normalize": _one("norm", x.normalize_text),
    "n13_normalize_text": _texts("norm", x.normalize_text),
    "n14_match_string": Plan("part", CATALOG, lambda d: [{"said": x.match_text(d, "nl_brand", "nl_name")}, {"match_string": x.normalize_text(d, "said")}], ["nl_pos", "match_string"]),
    "n15_laptop_text": _listing(lambda d: [{"said": "concat(in_name, ' (13\" 2020, 4 TBT3) Wi-Fi 6E')"}, {"laptop_text": x.laptop_text(d, "said")}], ["row_id", "laptop_text"]),
    "n17_storage_canon": Plan("orders", {"row_id": "o_orderkey", "size": "CASE o_orderkey % 5 WHEN 0 THEN '1024gb' WHEN 1 THEN '2048gb' WHEN 2 THEN '512gb' WHEN 3 THEN '' ELSE '1tb' END"}, lambda d: [{"canonical": a.canonical_storage(d, "size")}], ["row_id", "canonical"]),
    "n18_device_type": _one("device_type", x.device_type, columns=("in_category",), arg="in_category"),
    "n19_duplicate_key": _one("dup_key", x.duplicate_key),
    "a1_category": _normalized("category", a.category),
    "a1_category_text": _texts("category", a.category),
    "a2_is_laptop": _one("is_laptop", a.is_laptop),
    "a3_storage": _normalized("storage", a.storage),
    "a4_ram": _normalized("ram", a.ram),
    "a5_mm": _normalized("watch_mm", a.watch_mm),
    "a6_model_nums": _normalized("model_nums", a.model_numbers),
    "a7_tokens": _normalized("tokens", a.model_tokens),
    "a8_variants": _one("variants", a.variant_tokens),
    "a10_code": _normalized("code", a.model_code),
    "a11_identity": _normalized("identity", a.model_identity),
    "a13_keywords": _listing(lambda d: [a.variant_keywords(d, "in_name")], ["row_id", "fold_gen", "flip_gen", "has_fold", "has_flip", "has_pro_max", "has_pro", "has_plus", "has_ultra", "has_lite", "has_mini"]),
    "a14_cpu_gen": _one("cpu_gen", a.cpu_generation),
    "a15_tier": _one("tier", a.processor_tier),
    "a16_laptop": _listing(_laptop, ["row_id", "l_brand", "l_ram", "l_line", "l_processor", "l_generation2", "l_inches", "l_chip", "l_year", "l_code", "l_storage", "l_storages", "l_family", "l_platform"], ("in_name", "in_brand")),
    "a17_policy": _listing(lambda d: [*_laptop(d), {"policy": a.policy_class(d, "in_name", "in_brand", "l_line")}], ["row_id", "policy"], ("in_name", "in_brand")),
    "a19_material": _normalized("material", a.watch_material),
    "a20_edition": _normalized("edition", a.watch_edition),
    "a21_tab_gen": _normalized("tab_gen", a.tablet_generation),
    "a22_inches": _normalized("inches", a.screen_inches),
    "a23_attrs": _listing(_attributes, ["row_id", *a.FIELDS], ("in_name", "in_brand")),
    "a26_category2": Plan("orders", {n: _LISTED[n] for n in ("row_id", "in_name", "in_brand", "in_category")}, lambda d: [{"category": a.infer_category(d, "in_name", "in_brand", "CASE WHEN row_id % 2 = 0 THEN in_category ELSE '' END")}], ["row_id", "category"]),
    "a28_signature": _listing(lambda d: [*_attributes(d), {"signature": a.signature(d)}], ["row_id", "signature"], ("in_name", "in_brand")),
    "a29_storage_key": _listing(lambda d: [*_attributes(d), {"storage_key": a.storage_key(d)}], ["row_id", "storage_key"], ("in_name", "in_brand")),
    "a24_galaxy_number": _listing(lambda d: [*_attributes(d), {"galaxy_number": families.galaxy_number(d, "model")}], ["row_id", "galaxy_number"], ("in_name", "in_brand")),
    "a25_galaxy_variant": _listing(lambda d: [*_attributes(d), {"galaxy_variant": families.galaxy_variant(d, "model", "concat(product_line, ' ', model)")}], ["row_id", "galaxy_variant"], ("in_name", "in_brand")),
    "a27_family_key": _listing(lambda d: [*families.family_layers(d, "in_name", "''", "in_brand"), families.group_layer(d, "in_brand")], ["row_id", "family_category", "family_key", "group_key"], ("in_name", "in_brand")),
}
