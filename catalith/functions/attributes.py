"""Attributes of product texts.

``extract`` builds them in layers: each layer is a set of named expressions over
the columns of the layers below, so nothing is computed twice.  A missing
attribute is the empty text.
"""

from __future__ import annotations

from catalith.functions import tables as t
from catalith.functions.dialect import Dialect
from catalith.functions.text import normalize_brand, normalize_text

Layer = dict[str, str]
_SUFFIX = r"(?:\s+(?:{}))*"


def is_laptop(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    return f"({d.any_of(low, t.LAPTOP_WORDS)} AND NOT ({d.contains(low, 'rog')} AND {d.contains(low, 'phone')}))"


def category(d: Dialect, x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    tablet = f"({d.has(low, r'\b(?:tab(?:let)?|pad)\b')} OR {d.any_of(low, ('ipad', 'matepad', 'mediapad'))})"
    watch = f"({d.contains(low, 'watch')} OR {d.has(low, r'\bgear\b')})"
    mobile = f"({d.any_of(low, t.MOBILE_PARTS)} OR {d.has(low, r'\b(?:' + '|'.join(t.MOBILE_WORDS + t.PHONE_BRANDS) + r')\b')} OR {d.has(low, r'\blg\s+[vg]\d')})"
    return d.case((tablet, "'tablet'"), (watch, "'watch'"), (is_laptop(d, low), "'laptop'"), (mobile, "'mobile'"), other="'other'")


def infer_category(d: Dialect, x: str, brand: str, current: str) -> str:
    """The named category; where none is named, what the words of the text tell."""
    low, own, now = f"lower(coalesce({x}, ''))", f"lower(coalesce({brand}, ''))", f"coalesce({current}, '')"
    surface = f"({d.has(low, r'\bsurface\s+(?:pro|go)\b')} AND NOT {d.any_of(low, ('keyboard', 'type cover', 'laptop'))})"
    huawei = f"(({d.contains(low, 'huawei')} OR {own} = 'huawei') AND {d.has(low, r'\b(?:mate\s*\d|p\d{2}|p\s+\d{2}|nova\s*\d|pura\s*\d)')})"
    xiaomi = f"(({d.contains(low, 'xiaomi')} OR {own} = 'xiaomi') AND {d.has(low, r'\bxiaomi\s+\d+|mi\s+\d+')})"
    return d.case(
        (f"lower({now}) NOT IN ('', 'other', 'nan', 'none')", now),
        (f"{own} = 'apple' AND {d.contains(low, 'watch')}", "'watch'"),
        (f"({d.any_of(low, t.INFER_TABLET)} OR {surface})", "'tablet'"),
        (d.any_of(low, t.INFER_WATCH), "'watch'"),
        (d.any_of(low, t.INFER_LAPTOP), "'laptop'"),
        (f"({d.any_of(low, t.INFER_MOBILE)} OR {huawei} OR {xiaomi} OR {d.has(low, r'\b(?:gt|sm)[\s-]?[a-z]\d{3}')})", "'mobile'"),
        (f"{own} = 'lenovo' AND {d.has(low, r'\bv\d{2}\b')}", "'laptop'"),
        (d.any_of(low, ("miix", "galaxy view")), "'tablet'"),
        other=d.either(now, "'other'"),
    )


def canonical_storage(d: Dialect, x: str) -> str:
    return f"CASE WHEN {d.has(x, '(?i)^1024gb$')} THEN '1tb' WHEN {d.has(x, '(?i)^2048gb$')} THEN '2tb' ELSE {x} END"


def storage(d: Dialect, x: str) -> str:
    """The only size; else the first in TB; else the largest of 16 GB and more; else the first."""
    every = d.ext_all(x, r"(\d+(?:gb|tb|mb))")
    tera = d.at(d.keep(every, lambda e: d.contains(e, "tb")), 0)
    large = d.keep(d.each(d.keep(every, lambda e: d.contains(e, "gb")), lambda e: d.integer(d.rep(e, "[^0-9]", ""))), lambda e: f"{e} >= 16")
    most = f"(CAST({d.top(large)} AS STRING) || 'gb')"
    found = f"coalesce(CASE WHEN {d.size(every)} = 1 THEN {d.at(every, 0)} END, {tera}, {most}, {d.at(every, 0)}, '')"
    return canonical_storage(d, found)


def ram(d: Dialect, x: str) -> str:
    sizes = d.keep(d.ext_all(f"lower({x})", r"(\d+)\s*gb"), lambda e: f"{d.integer(e)} BETWEEN 4 AND 64")
    return f"coalesce({d.at(sizes, 0)} || 'gb', '')"


def watch_mm(d: Dialect, x: str) -> str:
    found = d.ext(x, r"(?i)\b(3[89]|4[0-9]|5[0-5])\s*mm\b")
    return f"CASE WHEN {found} <> '' THEN concat({found}, 'mm') ELSE '' END"


def model_numbers(d: Dialect, x: str) -> str:
    """Numbers of one or two digits that are not sizes."""
    clean = d.rep(x, r"\b[345]g\b", "")
    return d.keep(d.ext_all(d.rep(clean, r"\d+(?:gb|tb|mb)", ""), r"(\d+)"), lambda e: f"length({e}) <= 2")


def model_tokens(d: Dialect, x: str) -> str:
    clean = d.rep(d.rep(f"coalesce({x}, '')", r"\b\d+(?:gb|tb|mb)\b", ""), r"\b[345]g\b", "")
    found = d.keep(d.split(d.squeeze(clean)), lambda e: f"({d.has(e, '[0-9]')} OR {d.isin(e, t.MODEL_WORDS)})")
    letter = d.ext(f"lower({clean})", r"\breno\s*\d*\s+(z|f)\b")
    return f"CASE WHEN {letter} <> '' THEN {d.append(found, letter)} ELSE {found} END"


def variant_tokens(d: Dialect, x: str) -> str:
    return d.sort(d.distinct(d.keep(d.split(normalize_text(d, x)), lambda e: d.isin(e, t.VARIANT_TOKENS))))


def model_code(d: Dialect, x: str) -> str:
    return f"lower({d.ext(x, '(?i)' + t.MODEL_CODE)})"


def model_identity(d: Dialect, x: str) -> str:
    """The longest family with its number and suffix, for brands that differ by these alone."""
    low = f"lower(trim(coalesce({x}, '')))"
    found = []
    for family, pattern in t.IDENTITY_PATTERNS:
        names = d.each(d.ext_all(low, pattern), lambda e, f=family: f"concat('{f}', {d.rep(d.rep(e, '[+]', 'plus'), ' +', '')})")
        found.append(names)
    best = "''"
    for names in found:
        longest = d.at(d.keep(names, lambda e, n=names: f"length({e}) = {d.top(d.each(n, lambda y: f'length({y})', 'y'))}"), 0)
        best = f"CASE WHEN coalesce(length({longest}), 0) > length({best}) THEN {longest} ELSE {best} END"
    return f"CASE WHEN {d.any_of(low, (*t.IDENTITY_BRANDS, 'reno', 'note'))} THEN {best} ELSE '' END"


def variant_keywords(d: Dialect, x: str) -> Layer:
    low = f"lower(coalesce({x}, ''))"
    gen = {k: d.case((f"NOT {d.contains(low, k)}", "''"), other=f"concat('{k}', {d.ext(low, k + r'\s*(\d+)')})") for k in ("fold", "flip")}
    flags = {f"has_{k}": d.contains(low, k) for k in ("fold", "flip", "plus", "ultra", "lite")}
    return {"fold_gen": gen["fold"], "flip_gen": gen["flip"], **flags, "has_pro_max": d.contains(low, "pro max"), "has_pro": f"({d.contains(low, 'pro')} AND NOT {d.contains(low, 'pro max')})", "has_mini": d.has(low, r"\bmini\b")}


def cpu_generation(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    apple, intel = d.ext(low, r"\bm([123])\b"), d.ext(low, r"(?:core\s+)?i[3579][\s\-]?(\d{4,5})[a-z]{0,2}")
    ryzen, nth, gen = d.ext(low, r"ryzen\s+[357]\s+(\d)\d{3}"), d.ext(low, r"(\d{1,2})(?:st|nd|rd|th)\s*gen"), d.ext(low, r"\bgen(\d{1,2})\b")
    digits = f"CASE WHEN length({intel}) = 5 OR substr({intel}, 1, 1) = '1' THEN substr({intel}, 1, 2) ELSE substr({intel}, 1, 1) END"
    return d.case((f"{apple} <> ''", f"concat('m', {apple})"), (f"{intel} <> ''", f"concat({digits}, 'th gen')"), (f"{ryzen} <> ''", f"concat('ryzen ', {ryzen})"), (f"{nth} <> ''", f"concat({nth}, 'th gen')"), (f"{gen} <> ''", f"concat({gen}, 'th gen')"), (d.has(low, r"\bn\d{3}\b|celeron|pentium"), "'core'"))


def processor_tier(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    pairs = [(d.has(low, rf"\bm{i}\b"), f"'m{i}'") for i in "1234"] + [(d.has(low, rf"\bcore\s*i{i}\b|i{i}[-\s]"), f"'i{i}'") for i in "3579"] + [(d.has(low, rf"ryzen\s*{i}\b"), f"'ryzen{i}'") for i in "3579"]
    return d.case(*pairs)


def watch_material(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    kinds = (("aluminum", r"\b(?:alumin(?:um|ium)?|alu|alum)\b"), ("stainless", r"\b(?:stainless(?:\s*steel)?|st\s*steel|steel|ss)\b"), ("titanium", r"\b(?:titanium|titan|ti)\b"), ("ceramic", r"\bceramic\b"))
    return d.case(*((d.has(low, p), f"'{k}'") for k, p in kinds))


def watch_edition(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    kinds = (("black_unity", r"\b(?:black\s*unity|unity)\b"), ("hermes", r"\bherm[eè]s\b"), ("nike", r"\bnike\b"), ("edition", r"\bedition\b"))
    return d.case(*((d.has(low, p), f"'{k}'") for k, p in kinds))


def tablet_generation(d: Dialect, x: str) -> str:
    low = f"lower({x})"
    return d.either(d.ext(low, r"(\d+)(?:st|nd|rd|th)\s*gen"), d.ext(low, r"\bgen(\d+)\b"))


def screen_inches(d: Dialect, x: str) -> str:
    """The first of four notations that gives a size from 7 to 15."""
    low = f"lower({x})"
    spaced = r"\b(\d{1,2}\s\d)\s*(?:\"|inch)", r"\b(\d{1,2}\s\d)\b"
    tries = [d.rep(d.ext(low, spaced[0]), r"\s", "."), d.ext(low, r"(\d+(?:\.\d+)?)\s*(?:\"|inch)"), d.ext(low, r"\b(\d{1,2}\.\d{1,2})\b"), d.rep(d.ext(low, spaced[1]), r"\s", ".")]
    return d.case(*((f"{d.number(x)} BETWEEN 7 AND 15", x) for x in tries))


def year(d: Dialect, x: str) -> str:
    return d.ext(x, r"\b(20[12]\d)\b")


def policy_class(d: Dialect, x: str, brand: str, line: str) -> str:
    low, own = f"lower({x})", normalize_brand(d, brand)
    mac = f"(({own} = 'apple' OR {d.contains(low, 'macbook')}) AND ({d.any_of(low, ('macbook air', 'macbook pro'))} OR {d.isin(line, t.LAPTOP_LINES['apple'])}))"
    game = f"({d.any_of(low, t.GAMING_WORDS)} OR {d.has(low, r'\b(?:gtx|rtx|geforce|radeon|rx\s*\d)\b')})"
    return d.case((mac, "'APPLE_MACBOOK'"), (game, "'WINDOWS_GAMING'"), (d.isin(line, t.BUSINESS_LINES), "'WINDOWS_BUSINESS'"), other="'WINDOWS_OTHER'")


def _after_line(d: Dialect, lines: tuple[str, ...], pattern: str, text: str, line: str, group: int = 1) -> str:
    """A pattern right after the product line; one expression for each line, as patterns are literals."""
    return "CASE " + line + " " + " ".join(f"WHEN '{x}' THEN {d.ext(text, pattern.format(line=x), group)}" for x in lines) + " ELSE '' END"


def _laptop_line(d: Dialect, low: str, brand: str) -> str:
    pairs = [(d.contains(brand, b), d.first_of(low, lines)) for b, lines in t.LAPTOP_LINES.items() if b not in ("microsoft", "huawei")]
    surface = f"({d.contains(brand, 'microsoft')} OR {d.contains(low, 'surface')})"
    return d.case(*pairs, (surface, d.first_of(low, t.LAPTOP_LINES["microsoft"])), (d.contains(brand, "huawei"), d.first_of(low, t.LAPTOP_LINES["huawei"])))


def _laptop_family(d: Dialect, norm: str, brand: str, line: str) -> str:
    lines = t.LAPTOP_LINES
    acer_n = _after_line(d, lines["acer"], r"\b{line}\s+([a-zv\d])\b", norm, line)
    acer = d.either(d.first_of(norm, t.ACER_FAMILIES), f"CASE WHEN {acer_n} <> '' THEN concat({line}, ' ', {acer_n}) ELSE '' END")
    tuf = d.ext(norm, r"\btuf\s+(?:gaming\s+)?([af]\d{2})\b")
    asus = d.either(d.first_of(norm, t.ASUS_FAMILIES), f"CASE WHEN NOT {d.contains(norm, 'tuf')} THEN '' WHEN {tuf} <> '' THEN concat('tuf ', {tuf}) WHEN {d.contains(norm, 'fx')} THEN 'tuf fx' ELSE '' END")
    hp_word = d.case(*((f"contains({norm}, concat({line}, ' {w}'))", f"concat({line}, ' {w}')") for w in t.HP_FAMILIES))
    hp_n = _after_line(d, lines["hp"], r"\b{line}\s+(\d{{2,3}})\b", norm, line)
    hp = d.either(hp_word, f"CASE WHEN {hp_n} <> '' THEN concat({line}, ' ', {hp_n}) ELSE '' END")
    book = d.ext(norm, r"\bmatebook\s+([a-z])\b")
    huawei = d.case((d.contains(norm, "matebook x pro"), "'matebook x pro'"), (f"{book} <> ''", f"concat('matebook ', {book})"))
    return d.case((f"{line} = ''", "''"), (f"{brand} = 'acer'", acer), (f"{brand} = 'asus'", asus), (f"{brand} = 'hp'", hp), (f"{brand} IN ('apple', 'microsoft')", line), (f"{brand} = 'huawei'", huawei))


def _laptop_code(d: Dialect, low: str, brand: str) -> str:
    base, revision = d.ext(low, r"\b([a-z]{2}\d{3})[-\s]\d{1,3}[a-z]*\b"), d.ext(low, r"\b[a-z]{2}\d{3}[-\s](\d{1,3}[a-z]*)\b")
    acer = f"CASE WHEN {base} <> '' THEN concat({base}, '-', {revision}) ELSE {d.ext(low, r'\b([a-z]{2}\d{3})\b')} END"
    asus = d.either(d.ext(low, r"\b([a-z]{2}\d{3,4})[a-z]*\b"), d.ext(low, r"\b([a-z]\d{3})[a-z]*\b"))
    return d.case((f"{brand} = 'acer'", acer), (f"{brand} = 'asus'", asus))


def _platform_code(d: Dialect, low: str, norm: str, brand: str, line: str) -> str:
    lines = t.LAPTOP_LINES
    start = r"^.*?{line}\s*"
    near = _after_line(d, lines["dell"], start + r"(?:\d{{1,2}}\s+)?([a-z]?\d{{4}}[a-z]?)\b", low, line)
    # elsewhere: a code of four digits that follows no CPU family and is no generation
    marked = d.rep(d.rep(norm, r"i[3579][ -]*[a-z]?\d{4}\b", " "), r"gen\s*[a-z]?\d{4}", " ")
    dell = d.either(near, d.ext(marked, r"\b([a-z]?\d{4})\b"))
    number, rev = _after_line(d, lines["hp"], start + r"(\d{{2,4}})", low, line), _after_line(d, lines["hp"], start + r"\d{{2,4}}\s*(g\d+)", low, line)
    hp = f"CASE WHEN {number} = '' THEN '' WHEN {rev} <> '' THEN concat({number}, ' ', {rev}) ELSE {number} END"
    lenovo = d.either(_after_line(d, lines["lenovo"], start + r"(x\d+\s+(?:carbon|yoga|nano|titanium))\b", low, line), _after_line(d, lines["lenovo"], start + r"([a-z]\d{{1,2}}[a-z]?)\b", low, line))
    return d.case((f"{line} = ''", "''"), (f"{brand} = 'dell'", dell), (f"{brand} = 'hp'", hp), (f"{brand} = 'lenovo'", lenovo))


def laptop_layers(d: Dialect, text: str, brand: str, norm: str = "", own: str = "") -> list[Layer]:
    """Columns ``l_*`` of laptop attributes; ``norm`` and ``own`` name the canonical
    text and brand where they are known already."""
    gb = d.each(d.ext_all("l_low", r"(\d+)\s*gb"), d.integer)
    tb = d.each(d.ext_all("l_low", r"(\d+)\s*tb\b"), lambda e: f"{d.integer(e)} * 1024")
    own_ram = f"coalesce({d.integer(d.rep('l_ram', 'gb', ''))}, 0)"
    large = d.top(d.keep("l_gb", lambda e: f"{e} > {own_ram} AND {e} >= 128"))
    size = f"CASE WHEN {d.size('l_tb')} > 0 THEN concat({d.ext('l_low', r'(\d+)\s*tb\b')}, 'tb') WHEN {large} IS NOT NULL THEN concat(CAST({large} AS STRING), 'gb') WHEN {d.top('l_gb')} <> {own_ram} THEN concat(CAST({d.top('l_gb')} AS STRING), 'gb') ELSE '' END"
    generation = d.either(cpu_generation(d, text), d.ext(text, r"\b(20\d{2})\b"))
    chip = d.rep(f"trim({d.ext('l_low', r'\b(m[1234]\s*(?:pro|max|ultra)?)\b')})", r"^(m[1234])\s*(pro|max|ultra)$", "$1 $2")
    intel = d.ext("l_low", r"(?:core\s+)?i[3579][\s\-]?(\d{4,5})[a-z]{0,2}")
    from_cpu = f"CASE WHEN {intel} = '' THEN '' WHEN length({intel}) = 5 OR substr({intel}, 1, 1) = '1' THEN concat(substr({intel}, 1, 2), 'th gen') ELSE concat(substr({intel}, 1, 1), 'th gen') END"
    revised = f"l_platform <> '' AND contains(concat(' ', l_norm, ' '), concat(' ', l_platform, ' gen', {d.rep('l_generation', 'th gen', '')}, ' ')) AND {d.contains('l_generation', 'th gen')}"
    both = d.sort(d.distinct(d.chain(d.keep("l_gb", lambda e: f"{e} >= 128 AND {e} <> {own_ram}"), "l_tb")))
    return [
        {"l_low": f"lower({text})", "l_norm": norm or normalize_text(d, text), "l_brand": own or d.either(normalize_brand(d, brand), normalize_text(d, brand)), "l_ram": ram(d, text)},
        {"l_gb": gb, "l_tb": tb, "l_line": _laptop_line(d, "l_low", "l_brand"), "l_processor": processor_tier(d, text), "l_generation": generation, "l_inches": d.either(d.ext("l_low", r"\b(\d{2}(?:\.\d)?)\s*(?:inch)\b"), d.ext("l_norm", r"\b(\d{2}(?:\.\d)?)\s+inch\b")), "l_chip": f"CASE WHEN l_brand = 'apple' OR {d.contains('l_low', 'macbook')} THEN {chip} ELSE '' END", "l_year": year(d, text), "l_code": _laptop_code(d, "l_low", "l_brand")},
        {"l_storage": size, "l_storages": both, "l_family": _laptop_family(d, "l_norm", "l_brand", "l_line"), "l_platform": _platform_code(d, "l_low", "l_norm", "l_brand", "l_line")},
        {"l_generation2": f"CASE WHEN {revised} THEN {from_cpu} ELSE l_generation END"},
    ]


def tablet_layers(d: Dialect, norm: str, raw: str) -> list[Layer]:
    """Columns ``t_*`` of tablet attributes, over the normalized and the lower-case text."""
    marked = d.ext(norm, r"\b(\d{1,2}(?:\.\d{1,2})?)\s*(?:inch|in|\"|'')")
    both = f"concat({norm}, ' ', {raw})"
    connection = d.case((d.has(both, r"\b(?:cellular|lte|5g|4g)\b"), "'cellular'"), (d.has(both, r"\bwifi\b"), "'wifi'"))
    chip, code = d.ext(norm, r"\bm([1-9])\b"), d.ext(norm, r"\b([a-z]{1,3}\d{3,5}[a-z]{0,2})\b")
    spaced = d.rep(d.ext(norm, r"\b(\d{1,2}\s+\d)\b"), r"\s+", ".")
    kind = d.ext(norm, r"ipad\s+(?:ipad\s+)?(pro|air|mini)")
    made = d.ext(norm, r"ipad\s+(?:ipad\s+)?(?:pro|air|mini)\s+(?:ipad\s+(?:pro|air|mini)\s+)?(gen\d+)")
    ipad = f"CASE WHEN {made} <> '' THEN trim(concat({kind}, ' ', {made})) WHEN {kind} <> '' THEN {kind} ELSE {d.ext(norm, r'ipad\s+(?:ipad\s+)?(gen\d+)')} END"
    line = d.case(*((d.contains(norm, w), f"'{w}'") for w in ("ipad", "tab", "mediapad", "matepad")))
    own = d.ext(norm, r"\b(pro|se|lite|air)\b")
    tab_family = d.ext(norm, r"tab\s+([a-z]\d+)")
    model = d.case(("t_line = 'ipad'", ipad), ("t_line = 'tab'", f"trim({d.ext(norm, r'tab\s+([a-z]\d+[a-z]*(?:\s+(?:plus|ultra|lite|fe))*)')})"), ("t_line = 'mediapad'", f"trim({d.ext(norm, r'mediapad\s+((?:t\d+|m\d+|lite)\s*(?:lite)?)')})"), ("t_line = 'matepad'", d.ext(norm, r"matepad\s+(pro|air|t\d+|se)")))
    family = d.case(("t_line = 'ipad'", f"trim(concat('ipad ', {kind}))"), ("t_line = 'tab'", f"trim(concat('tab ', {tab_family}))"), ("t_line IN ('mediapad', 'matepad')", "trim(concat(t_line, ' ', t_own))"))
    words = ("air", "fe", "kids", "lite", "mini", "paper", "plus", "pro", "se", "ultra")
    variants = d.keep(d.words(words), lambda e: f"contains(concat(' ', {norm}, ' '), concat(' ', {e}, ' '))")
    return [
        {"t_line": line, "t_own": own, "t_inches": screen_inches(d, norm), "t_generation": tablet_generation(d, norm), "t_year": year(d, norm), "t_connection": connection, "t_chip": f"CASE WHEN {chip} <> '' THEN concat('m', {chip}) ELSE '' END", "t_code": f"CASE WHEN {d.starts(code, chr(39) + 'gen' + chr(39))} THEN '' ELSE {code} END", "t_variants": variants},
        {"t_size": d.case((f"{marked} <> ''", marked), (f"t_line = 'ipad' AND {d.number(spaced)} BETWEEN 7 AND 13", spaced)), "t_model": model, "t_family": family},
    ]


def phone_layers(d: Dialect, norm: str, brand: str) -> list[Layer]:
    """Columns ``m_*`` of phone and other attributes."""
    clean = d.squeeze(d.rep(norm, r"\b(?:sm-)?[a-z]\d{3,5}[a-z]?\b", ""))
    text = f"CASE WHEN {d.contains(brand, 'samsung')} OR {d.contains(norm, 'samsung')} THEN {clean} ELSE {norm} END"
    x = "m_text"

    def suffix(words: str) -> str:
        return _SUFFIX.format(words)

    def named(name: str) -> str:
        return f"({d.contains(brand, name)} OR {d.contains(x, name)})"

    fold = d.squeeze(d.ext(x, r"galaxy\s+(z\s+(?:fold|flip)\s*\d*" + suffix("pro|plus|max|ultra|lite|5g") + ")"))
    plain = suffix("pro|plus|max|ultra|lite")
    reno, find = d.rep(x, r"reno\s+\d+\s+series\s+", ""), d.rep(x, r"find\s+[a-z]?\d+\s+series\s+", "")
    families = [
        ("iphone", d.contains(x, "iphone"), d.ext(x, r"iphone\s+(\d+[a-z]*" + suffix("pro|plus|max|mini|ultra|lite") + ")")),
        ("galaxy", d.contains(x, "galaxy"), d.either(fold, d.ext(x, r"galaxy\s+([a-z]+\d+[a-z]*" + suffix("pro|plus|max|ultra|lite|fe|note|fold|flip|edge|active") + ")"))),
        ("pixel", d.contains(x, "pixel"), d.ext(x, r"pixel\s+(\d+[a-z]*" + suffix(r"pro\s+fold|pro\s+xl|fold|pro|xl|max|ultra|lite|a") + ")")),
        ("redmi", d.contains(x, "redmi"), d.ext(x, r"redmi\s+(note\s+\d+[a-z]*" + plain + r"|\d+[a-z]*" + plain + ")")),
        ("mi", f"NOT {d.contains(x, 'redmi')} AND {named('xiaomi')}", d.ext(x, r"\bmi\s+(\d+[a-z]*" + plain + ")")),
        ("xiaomi", f"NOT {d.contains(x, 'redmi')} AND {named('xiaomi')}", d.ext(x, r"xiaomi\s+(\d+[a-z]*" + suffix("pro|plus|max|ultra|lite|t") + ")")),
        ("mate", f"{d.contains(x, 'mate')} AND {named('huawei')}", d.ext(x, r"mate\s+(\d+[a-z]*" + plain + ")")),
        ("p", f"NOT {d.contains(x, 'mate')} AND {named('huawei')} AND {d.has(x, r'\bp\d+')}", d.ext(x, r"p(\d+[a-z]*" + plain + ")")),
        ("reno", d.contains(x, "reno"), d.ext(reno, r"reno\s+(\d+[a-z]*" + suffix("pro|plus|ultra|lite|max|neo|z|f") + ")")),
        ("find", f"{d.contains(x, 'find')} AND {named('oppo')}", d.ext(find, r"find\s+([a-z]?\d+[a-z]*" + suffix("pro|plus|ultra|lite|max|neo") + ")")),
    ]
    general = r"\b([a-z]+)\s+([a-z]?\d+[a-z]*" + suffix("pro|plus|ultra|lite|max|mini|note|xl|edge|active") + ")"
    word, number = d.ext(x, general, 1), d.ext(x, general, 2)
    real = f"{word} <> '' AND NOT {d.isin(word, ('the', 'and', 'or', 'with', 'dual', 'sim', 'unlocked', 'new', 'used', 'refurbished'))}"
    bare = d.ext(x, r"\b([a-z]?\d+[a-z]*" + suffix("pro|plus|ultra|lite|max|mini|xl") + ")")
    first = f"coalesce({d.at(d.keep(d.split(x), lambda e: f'length({e}) > 2 AND NOT ' + d.isin(e, ('the', 'and', 'with', 'sim', 'new', 'used'))), 0)}, '')"
    line = d.case(*((f"{when} AND {model} <> ''", f"'{name}'") for name, when, model in families), (real, word), (f"{bare} <> ''", first))
    model = d.case(*((f"m_line = '{name}' AND {when} AND {model} <> ''", f"trim({model})") for name, when, model in families), (real, f"trim({number})"), (f"{bare} <> '' AND m_line <> ''", f"trim({bare})"))
    variant = d.join(d.sort(d.distinct(d.keep(d.split("lower(m_model)"), lambda e: d.isin(e, t.VARIANT_TOKENS)))), " ")
    return [{"m_text": text, "m_code": model_code(d, norm), "m_size": d.ext(norm, r"\b(\d{1,2}(?:\.\d{1,2})?)\s*(?:inch|in|\"|'')"), "m_year": year(d, norm)}, {"m_line": line}, {"m_model": model}, {"m_variant": variant, "m_generation": d.ext("m_model", r"(\d+)")}]


def watch_layers(d: Dialect, norm: str) -> list[Layer]:
    series = f"trim({d.ext(norm, r'\b(series\s*\d+(?:\s*(?:pro|ultra|se))?|ultra\s*\d+|se)\b')})"
    connection = d.case((f"({d.any_of(norm, ('cellular', 'lte', '4g'))})", "'cellular'"), (d.contains(norm, "gps"), "'gps'"))
    return [{"w_model": d.either(series, "'watch'"), "w_mm": watch_mm(d, norm), "w_connection": connection, "w_material": watch_material(d, norm), "w_edition": watch_edition(d, norm)}]


#: The attributes that ``extract`` gives.
FIELDS = "category brand product_line model storage ram processor generation screen_size screen_inches year watch_mm connectivity material edition tablet_line tablet_family chip model_number variant laptop_family model_code platform_code apple_chip variant_tokens storage_list".split()


def extract(d: Dialect, text: str, brand: str) -> list[Layer]:
    """All attributes: a watch, a laptop, a tablet, or a phone and anything else."""
    named = "(kind = 'tablet' AND t_line <> '')"

    def pick(watch: str = "''", laptop: str = "''", tablet: str = "''", phone: str = "''") -> str:
        return d.case(("kind = 'watch'", watch), ("kind = 'laptop'", laptop), (named, tablet), other=phone)

    strings, longs = d.no_strings, d.no_numbers
    fields = {
        "category": "of_norm",
        "brand": "own",
        "product_line": pick("'watch'", "l_line", "t_line", "m_line"),
        "model": pick("w_model", "l_generation2", "t_model", "m_model"),
        "storage": pick("''", "l_storage", "sizes", "sizes"),
        "ram": pick(laptop="l_ram"),
        "processor": pick(laptop="l_processor"),
        "generation": pick("''", "l_generation2", "t_generation", "m_generation"),
        "screen_size": pick(tablet="t_size", phone="m_size"),
        "screen_inches": pick("''", "l_inches", "t_inches"),
        "year": pick("''", "l_year", "t_year", "m_year"),
        "watch_mm": pick("w_mm"),
        "connectivity": pick("w_connection", "''", "t_connection"),
        "material": pick("w_material"),
        "edition": pick("w_edition"),
        "tablet_line": pick(tablet="t_own"),
        "tablet_family": pick(tablet="t_family"),
        "chip": pick(tablet="t_chip"),
        "model_number": pick(tablet="t_code", phone="m_code"),
        "variant": pick(phone="m_variant"),
        "laptop_family": pick(laptop="l_family"),
        "model_code": pick(laptop="l_code"),
        "platform_code": pick(laptop="l_platform"),
        "apple_chip": pick(laptop="l_chip"),
        "variant_tokens": pick(strings, strings, "t_variants", strings),
        "storage_list": f"CASE WHEN kind = 'laptop' AND {d.size('l_storages')} >= 2 THEN l_storages ELSE {longs} END",
    }
    return [
        {"said": f"coalesce({text}, '')", "own": d.either(normalize_brand(d, brand), normalize_text(d, brand))},
        {"norm": normalize_text(d, "said"), "raw": "lower(said)"},
        {"of_norm": category(d, "norm"), "sizes": storage(d, "norm")},
        {"kind": d.case(("of_norm = 'watch'", "'watch'"), (is_laptop(d, "said"), "'laptop'"), ("of_norm = 'tablet'", "'tablet'"), other="'phone'")},
        *watch_layers(d, "norm"),
        *laptop_layers(d, "said", brand, "norm", "own"),
        *tablet_layers(d, "norm", "raw"),
        *phone_layers(d, "norm", "own"),
        fields,
    ]


def storage_key(d: Dialect) -> str:
    """What tells apart products of one model, over the columns of ``extract``."""
    watch = d.rep("concat(watch_mm, '_', connectivity, '_', material)", "^_+|_+$", "")
    tablet = d.joined("_", d.either("screen_inches", "screen_size"), "CASE WHEN generation <> '' THEN concat('gen', generation) ELSE '' END", "storage")
    return d.case(("product_line = 'watch'", watch), ("ram <> ''", "concat(ram, '_', storage)"), ("category = 'tablet'", tablet), other="storage")


def signature(d: Dialect) -> str:
    """The product as one word, over the columns of ``extract``; empty if fewer than three parts are known."""
    model = "CASE WHEN model <> product_line THEN model ELSE '' END"
    laptop_model = "CASE WHEN model <> product_line AND model <> processor THEN model ELSE '' END"
    family = d.either(d.rep("tablet_family", " ", "_"), "tablet_line")
    tablet_model = "CASE WHEN model <> product_line AND model <> tablet_line AND (tablet_family = '' OR NOT contains(tablet_family, model)) THEN model ELSE '' END"
    gen = "CASE WHEN generation <> '' AND NOT contains(model, concat('gen', generation)) THEN concat(generation, 'thgen') ELSE '' END"
    tail = {
        "watch": (model, "watch_mm", "connectivity", "material", "edition"),
        "laptop": (laptop_model, "processor", "ram", "storage"),
        "tablet": (family, tablet_model, gen, d.either("screen_inches", "screen_size"), "year", "connectivity", "chip", "storage"),
        "phone": (model, "storage"),
    }
    kinds = [("product_line = 'watch'", "watch"), ("processor <> '' OR ram <> ''", "laptop"), ("screen_size <> '' OR tablet_line <> '' OR generation <> '' OR tablet_family <> ''", "tablet"), ("true", "phone")]

    def word(kind: str) -> str:
        return d.rep(d.rep(d.rep(f"lower({d.joined('_', 'brand', 'product_line', *tail[kind])})", " ", "_"), "_+", "_"), "^_+|_+$", "")

    def parts(kind: str) -> str:
        return " + ".join(f"CASE WHEN {p} <> '' THEN 1 ELSE 0 END" for p in ("brand", "product_line", *tail[kind]))

    return d.case(("product_line = ''", "''"), *((f"({when})", f"CASE WHEN {parts(k)} >= 3 THEN {word(k)} ELSE '' END") for when, k in kinds))
