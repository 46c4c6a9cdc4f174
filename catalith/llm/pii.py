"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four fixed patterns: mail addresses, IP addresses, card
numbers (by Luhn) and phone numbers; and, as a kind of its own, tokens that read
like lower-case digests of 32 signs and more (``secret``).  Every token with a
digit or an at sign is an instance.  Its lexical patterns are the word before it,
the two words before it, and the words on both sides, where a word is a run of
letters or one of ``= : #``, and another instance, the text's start and its end
count as words too; at most 80 characters on either side are looked at.

Patterns and instances form a graph.  In each round a pattern scores for a kind
by the share of its distinct instances that are known to be of that kind, if it
has enough of them; an unknown instance gets the kind of its best pattern, if
that scores high enough, and counts as known in the next round, so other patterns
rise.  Spans of all instances in a pattern that scores high enough in the end
are added, unless they touch a seed of the four patterns; those seeds stay.

Patterns are anchored and possessive, so that they are linear in the text's
length and need no stack; they match what the plain patterns match.  Joins on a
pattern are salted on the larger side, as one word may precede a third of all
numbers.

Edge cases: null and empty texts have no spans; null ids stay null; repeated
rows each give a row, but count once in the graph; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut, id_and_text

KINDS = ("email", "ip", "card", "phone")
#: Distinct known instances that a pattern needs, the share of them, and rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The kind that only the method finds.
SECRET = "secret"
#: A token with a digit or an at sign.
_INSTANCE = r"(?<![^\s\"'=<>,;])[^\s\"'=<>,;0-9@]*+[0-9@][^\s\"'=<>,;]*+"
#: A word of a context, and how many characters on a side are looked at.
_WORD, _REACH = r"\p{L}++|[=:#]", 80
#: Parts that the rows of one pattern are dealt over in joins.
_SALTS = 16
#: What makes a text worth matching.
_HINT = {"email": "@", "phone": "+"}


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _places(matches: Column, between: Column) -> Column:
    """Starts of matches, from their lengths and those of the text between them."""
    none = F.array().cast("array<bigint>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts"))
    steps = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))

    def step(s: Column, i: Column) -> Column:
        start = s["at"] + F.length(F.get(between, i))
        return F.struct((start + F.length(F.get(matches, i))).alias("at"), F.concat(s["starts"], F.array(start)).alias("starts"))

    return F.aggregate(steps, state, step)["starts"]


def _text_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, mark``, the seeds of each kind (start, end, value) and the instances (start, value, patterns)."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    found = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", F.xxhash64("text"))
    has = {k: text.contains(h) for k, h in _HINT.items()}
    patterns = _PATTERNS | {"instance": _INSTANCE}
    columns = []
    for k, p in patterns.items():
        worth = has.get(k, text.rlike("[0-9@]" if k == "instance" else "[0-9]"))
        columns += [F.when(worth, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}"), F.when(worth, F.split(text, p, -1)).otherwise(none).alias(f"s_{k}")]
    found = found.select("doc_id", "mark", *columns)
    found = found.select("doc_id", "mark", "s_instance", *(f"m_{k}" for k in patterns), *(_places(F.col(f"m_{k}"), F.col(f"s_{k}")).alias(f"p_{k}") for k in patterns))

    def spans(k: str) -> Column:
        all_ = F.zip_with(f"m_{k}", f"p_{k}", lambda m, p: F.struct(p.alias("start"), (p + F.length(m)).alias("end"), m.alias("value")))
        return F.filter(all_, lambda s: _valid(k, s["value"]))

    def words(near: Column) -> Column:
        return F.regexp_extract_all(F.lower(near), F.lit(_WORD), F.lit(0))

    def instance(m: Column, i: Column) -> Column:
        inner = F.regexp_replace(m, r"^[^A-Za-z0-9+]++", "")
        start = F.get("p_instance", i) + F.length(m) - F.length(inner)
        last = i == F.size("m_instance") - 1
        before, after = F.get("s_instance", i), F.get("s_instance", i + 1)
        left = F.concat(F.array(F.when(i == 0, "<start>").otherwise("<id>")), words(F.substring(before, -_REACH, _REACH)))
        one, two = F.element_at(left, -1), F.try_element_at(left, F.lit(-2))
        right = F.coalesce(F.get(words(F.substring(after, 1, _REACH)), 0), F.when(last, "<end>").otherwise("<id>"))
        patterns = F.array(F.concat(one, F.lit(" _")), F.concat_ws(" ", two, one, F.lit("_")), F.concat_ws(" ", one, F.lit("_"), right))
        return F.struct(start.alias("start"), F.regexp_replace(inner, r"[^A-Za-z0-9)]++$", "").alias("value"), F.array_distinct(patterns).alias("patterns"))

    return found.select("doc_id", "mark", *(spans(k).alias(k) for k in KINDS), F.transform("m_instance", instance).alias("instances"))


def _known(value: Column) -> Column:
    """The kind that a token's own shape tells."""
    ip = value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$")
    card = value.rlike("^[0-9](?:-?[0-9])*+$") & _valid("card", value)
    secret = value.rlike("^[0-9a-f]{32,}+$") & value.rlike("[a-f]")
    return F.when(value.rlike(rf"^{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++$"), "email").when(ip & _valid("ip", value), "ip").when(card, "card").when(value.rlike(r"^\+[0-9]"), "phone").when(secret, SECRET)


def _salted(many: DataFrame, few: DataFrame, key: str, spread: list[str], how: str) -> DataFrame:
    """A join in which the rows of one key on the left are dealt over several tasks;
    ``few``, with at most one row a key, is repeated."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return left.join(right, [key, "salt"], how).drop("salt")


def _good(known: DataFrame, support: int, confidence: float) -> DataFrame:
    """``pattern, told, score`` of patterns with enough instances of one kind; counts are summed map-side."""
    total = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    told = F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))
    by_pattern = total.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(told).alias("best"))
    good = by_pattern.filter((F.col("best.n") >= support) & (F.col("best.n") >= F.lit(confidence) * F.col("all")))
    return good.select("pattern", F.col("best.kind").alias("told"), (F.col("best.n") / F.col("all")).alias("score"))


def learned_patterns(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, told, score`` of the patterns that find instances in the end."""
    each = found.select(F.explode("instances").alias("i")).select("i.value", F.explode("i.patterns").alias("pattern")).filter("value <> ''").distinct()
    known = cut(each.withColumn("kind", _known(F.col("value"))))
    for _ in range(rounds - 1):
        met = _salted(known.filter("kind is null"), _good(known, support, confidence), "pattern", ["value"], "inner")
        voted = met.groupBy("value").agg(F.max(F.struct("score", "told"))["told"].alias("told"))
        known = cut(_salted(known, voted, "value", ["pattern"], "left").select("value", "pattern", F.coalesce("kind", "told").alias("kind")))
    return _good(known, support, confidence)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``seeds`` and ``spans`` (seeds and what
    the method adds): arrays of (rank of the kind, start, end, value, kind), sorted."""
    found = cut(_text_spans(id_and_text(docs, id_col, text_col)))
    good = learned_patterns(found, support, confidence, rounds)
    own = found.select("doc_id", "mark", F.explode("instances").alias("i")).select("doc_id", "mark", F.col("i.start").alias("start"), F.col("i.value").alias("value"), F.explode("i.patterns").alias("pattern")).filter("value <> ''")
    met = _salted(own, good, "pattern", ["doc_id", "mark", "start"], "inner")
    best = met.groupBy("doc_id", "mark", "start", "value").agg(F.max(F.struct("score", "told"))["told"].alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind")).cast("int")
    added = best.select("doc_id", "mark", F.struct(rank.alias("rank"), "start", (F.col("start") + F.length("value")).alias("end"), "value", "kind").alias("span"))
    added = added.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("added"))

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind")))

    def secret(i: Column) -> Column:
        return F.struct(F.lit(len(KINDS) + 1).alias("rank"), i["start"].alias("start"), (i["start"] + F.length(i["value"])).alias("end"), i["value"].alias("value"), F.lit(SECRET).alias("kind"))

    seeds = F.concat(*(ranked(r, k) for r, k in enumerate(KINDS, 1)))
    secrets = F.transform(F.filter("instances", lambda i: _known(i["value"]) == SECRET), secret)
    base = found.select("doc_id", "mark", seeds.alias("seeds"), secrets.alias("secrets"))
    added = added.withColumnsRenamed({"doc_id": "to", "mark": "to_mark"})
    met = base.join(added, base["doc_id"].eqNullSafe(added["to"]) & (base["mark"] == added["to_mark"]), "left")
    more = F.array_union("secrets", F.coalesce("added", F.array().cast("array<struct<rank:int,start:bigint,end:bigint,value:string,kind:string>>")))
    free = F.filter("more", lambda a: ~F.exists("seeds", lambda s: (s["start"] < a["end"]) & (s["end"] > a["start"])))
    met = met.select("doc_id", "mark", "seeds", more.alias("more"))
    return met.select("doc_id", "mark", "seeds", F.when(F.size("more") == 0, F.col("seeds")).otherwise(F.array_sort(F.concat("seeds", free))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("seeds", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("seeds"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns stay."""
    found = find_personal_data(docs, id_col, text_col, **options).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("__spans"))
    met = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == found["__mark"]), "left")
    text = F.col(text_col)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        start = F.greatest(span["start"], s["at"])
        said = F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (start - s["at"]).cast("int")), F.when(span["start"] >= s["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(span["end"], s["at"]).alias("at"), said.alias("out"))

    masked = F.aggregate("__spans", state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    return met.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(masked)).select(*docs.columns)
