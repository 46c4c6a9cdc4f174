"""The cascade: exact attributes, signature, laptops by parts, similarity, then gates and reasons.

Everything is decided once for each distinct text (``query``, ``own_brand`` and
the text as it was said); rows get the decision of their text.  Each stage works
on what the stages before it left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import attributes as a
from catalith.functions import families
from catalith.functions import tables as t
from catalith.functions.dialect import SPARK
from catalith.functions.similarity import ratio_udf, token_sort_ratio_udf
from catalith.operators import laptops, matching, selection
from catalith.plans.layers import apply_layers
from catalith.plans.materialize import cut
from catalith.plans.query import Query

SIMILAR, NEAR, HIGH, SOFT, WIDE, WEAK = 85.0, 80.0, 90.0, 88.0, 70.0, 60.0
#: Stands for every brand or every category.
ANY = "*"


def _shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Query(lambda d, table: f"SELECT * FROM {table(name)}").spark(spark, sf_dir)


def _names(catalog: DataFrame) -> DataFrame:
    """All ids of each name, in catalog order, within its brand and category, its brand, its category and the whole catalog."""
    scopes = F.explode(F.array(*(F.struct(b.alias("in_brand"), c.alias("in_category")) for b in (F.col("brand"), F.lit(ANY)) for c in (F.col("category"), F.lit(ANY)))))
    each = catalog.select("normalized_name", "nl_pos", "uae_assetid", scopes.alias("scope")).select("scope.*", "normalized_name", "nl_pos", "uae_assetid")
    ids = F.array_sort(F.collect_list(F.struct("nl_pos", "uae_assetid")))["uae_assetid"]
    named = each.groupBy("in_brand", "in_category", "normalized_name").agg(F.min("nl_pos").alias("pos"), ids.alias("ids"))
    return named.select("in_brand", "in_category", "normalized_name", "pos", F.array_join("ids", ", ").alias("asset_id"), F.col("ids")[0].alias("first_id"), F.size("ids").cast("long").alias("n_ids"))


def _compared(asked: DataFrame, names: DataFrame, cutoff: float, top: int) -> DataFrame:
    """The most similar names of each row's scope.  Pairs whose lengths rule out the
    cutoff are not compared, nor names without the storage that a row needs (``need``)."""
    least = F.greatest(F.lit(cutoff), "least")
    bound = 200.0 * F.least(F.length("query"), F.length("normalized_name")) / (F.length("query") + F.length("normalized_name"))
    held = F.col("need").isNull() | F.col("normalized_name").contains(F.col("need"))
    plain = names.select("in_brand", "in_category", "normalized_name", "pos", "n_ids")  # lists of ids come after the choice
    scored = asked.join(plain, ["in_brand", "in_category"]).filter((bound >= least) & held).withColumn("score", F.bround(token_sort_ratio_udf("query", "normalized_name"), 2)).filter(F.col("score") >= least)
    best = Window.partitionBy("query", "brand", "category").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query", "brand", "category", "in_brand", "in_category", "normalized_name", "n_ids", "score", F.col("rank").cast("long").alias("rank"))


def _with_ids(found: DataFrame, names: DataFrame, *ids: str) -> DataFrame:
    return found.join(names.select("in_brand", "in_category", "normalized_name", *ids), ["in_brand", "in_category", "normalized_name"]).drop("in_brand", "in_category")


def _scoped(rows: DataFrame, catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Each distinct text with what it is compared with.  In a scope of more than 20
    names, only those that hold the text's storage are, unless none does (F3)."""
    other = F.col("category") == "other"
    asked = rows.select("query", "brand", "category").distinct().join(catalog.select("brand", F.lit(True).alias("known")).distinct(), "brand", "left")
    everywhere = (F.col("brand") == "") | other & F.col("known").isNull()
    least = F.when((F.col("brand") == "") & other, HIGH).otherwise(0.0)
    scopes = ["in_brand", "in_category"]
    asked = asked.select("query", "brand", "category", F.when(everywhere, ANY).otherwise(F.col("brand")).alias("in_brand"), F.when(other, ANY).otherwise(F.col("category")).alias("in_category"), least.alias("least"), F.expr(a.storage(SPARK, "query")).alias("size"))
    large = names.groupBy(*scopes).agg(F.count("*").alias("n")).filter("n > 20").select(*scopes)
    sizes = asked.filter("size <> ''").select(*scopes, "size").distinct().join(large, scopes)
    held = sizes.join(names.select(*scopes, "normalized_name"), scopes).filter(F.col("normalized_name").contains(F.col("size"))).select(*scopes, "size").distinct().withColumn("need", F.col("size"))
    return asked.join(held, [*scopes, "size"], "left").drop("size")


def similar(spark: SparkSession, sf_dir: str, rows: DataFrame, cutoff: float = NEAR, top: int = 3, fallback: bool = True) -> DataFrame:
    """``nearest`` with the lists of ids."""
    names = cut(_names(_shared(spark, sf_dir, "catalog_features").select("brand", "category", "normalized_name", "nl_pos", "uae_assetid")))
    found = _with_ids(nearest(spark, sf_dir, rows, names, cutoff, top, fallback), names, "asset_id")
    return found.select("query", "brand", "category", "normalized_name", "asset_id", "n_ids", "score", "rank")


def nearest(spark: SparkSession, sf_dir: str, rows: DataFrame, names: DataFrame, cutoff: float = NEAR, top: int = 3, fallback: bool = True) -> DataFrame:
    """The most similar catalog names of each row.  Each distinct text is
    compared once.

    A row meets the names of its brand and category; in category 'other' all
    names of its brand, or the whole catalog if that has no such brand; without
    a brand all names of its category.  A row without both needs a score of
    ``HIGH``.  With ``fallback``, a row that finds nothing at ``SIMILAR`` among
    its brand's names meets those of all brands, in its category unless that is
    'other'.  Laptops have no such fallback, and neither do rows whose brand has
    no name in their category (J4 looks elsewhere for these)."""
    catalog = _shared(spark, sf_dir, "catalog_features").select("brand")
    asked = _scoped(rows, catalog, names)
    scoped = _compared(asked, names, cutoff, top)
    if not fallback:
        return scoped
    scoped = cut(scoped)
    keys = ["query", "brand", "category"]
    scopes = names.select("in_brand", "in_category").distinct()
    laptop = (F.col("category") == "laptop") & F.expr(a.is_laptop(SPARK, "query"))
    rest = asked.filter((F.col("in_brand") != ANY) & ~laptop).join(scopes, ["in_brand", "in_category"], "left_semi").join(scoped.filter(F.col("score") >= SIMILAR).select(*keys), keys, "left_anti")
    wide = _compared(rest.withColumns({"in_brand": F.lit(ANY), "need": F.lit(None).cast("string")}), names, SIMILAR, top)
    both = scoped.withColumn("wider", F.lit(0)).unionByName(wide.withColumn("wider", F.lit(1)))
    return both.withColumn("widest", F.max("wider").over(Window.partitionBy(*keys))).filter("wider = widest").drop("wider", "widest")


def top_names(asked: DataFrame, names: DataFrame, top: int, cutoff: float = 0.0, lists: bool = False) -> DataFrame:
    """The ``top`` names of given scopes at any score, as a list of (rank, id, name,
    score) for each text, with all ids of a name (``asset_id``) where ``lists`` asks for them."""
    plain = asked.withColumns({"least": F.lit(0.0), "need": F.lit(None).cast("string")})
    each = _with_ids(_compared(plain, names, cutoff, top), names, "first_id", *["asset_id"] * lists).withColumnRenamed("first_id", "id")
    each = each if lists else each.withColumn("asset_id", F.lit(None).cast("string"))
    return each.groupBy("query", "brand", "category").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("normalized_name").alias("name"), "score", "asset_id"))).alias("near"))


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir, "input_features").select("query", "brand", "category")
    return similar(spark, sf_dir, rows, SIMILAR, 1)


def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir, "input_features").select("query", "brand", "category")
    return similar(spark, sf_dir, rows, NEAR, 3, fallback=False)


KEYS = ["query", "own_brand", "plain"]
_ALT = "array<struct<uae_assetid:string,uae_assetname:string,score:double,reason:string>>"


def _sql(spark: SparkSession, write: Callable[..., str], **frames: DataFrame) -> DataFrame:
    """A query over given frames; their names are put in as views of this call only."""
    views = {n: f"{n}_{uuid.uuid4().hex}" for n in frames}
    for n, frame in frames.items():
        frame.createOrReplaceTempView(views[n])
    out = spark.sql(write(**{n: f"SELECT * FROM {v}" for n, v in views.items()}))
    for v in views.values():
        spark.catalog.dropTempView(v)
    return out


def similar_storage(spark: SparkSession, sf_dir: str, rest: DataFrame) -> DataFrame:
    """Texts whose brand, line and model are known under other storage keys only:
    the most similar key at ``NEAR``, with the same memory (J1f)."""
    index = _shared(spark, sf_dir, "known_entries").filter(F.col("entry").startswith("a")).select("entry", "brand", "product_line", "model", "storage_key", "nl_name", "nl_category", "first_pos")
    asked = rest.filter("model <> '' AND storage <> '' AND product_line <> 'watch'").select("query", "own_brand", "brand", "product_line", "model", "storage_key", "ram", "category").distinct()
    met = asked.join(index.withColumnRenamed("storage_key", "k").filter("k <> ''"), ["brand", "product_line", "model"])
    met = met.filter("ram = '' OR instr(k, '_') = 0 OR split_part(k, '_', 1) = ram").withColumn("alike", ratio_udf("storage_key", "k"))
    best = met.groupBy("query", "own_brand", "category").agg(F.max_by(F.struct("alike", "entry", "nl_name", "nl_category"), F.struct("alike", -F.col("first_pos"))).alias("b")).filter("b.alike >= 80 AND (category = 'other' OR category = b.nl_category)")
    return best.select("query", "own_brand", F.col("b.entry").alias("mapped_ids"), F.col("b.nl_name").alias("matched_on"), F.lit("attribute_tier3_fuzzy_storage").alias("method"), F.lit(90.0).alias("match_score"))


def _gated(found: DataFrame) -> DataFrame:
    """With the gate's reasons for text and name, the critical check and the guard on scores."""
    pairs = cut(found.select(F.col("query").alias("q_norm"), F.col("matched_on").alias("c_norm")).distinct())
    names = matching.text_attributes(SPARK)
    texts = cut(pairs.select(F.col("q_norm").alias("norm")).union(pairs.select("c_norm")).distinct())
    known = cut(apply_layers(texts, [{name: fn("norm") for name, fn in names.items()}]))  # once for each text, which many pairs share
    for s in "qc":
        pairs = pairs.join(known.select(*(F.col(n).alias(f"{s}_{n}") for n in ("norm", *names))), f"{s}_norm")
    layers = [matching.told_layer(SPARK), {"gate": matching.gate_reasons(SPARK), "verified": matching.critical_ok(SPARK), "most": matching.token_guard(SPARK)}]
    told = cut(apply_layers(cut(pairs), layers).select(F.col("q_norm").alias("query"), F.col("c_norm").alias("matched_on"), "gate", "verified", "most"))
    return found.join(told, ["query", "matched_on"])


def _chosen(spark: SparkSession, sf_dir: str, found: DataFrame, held: DataFrame) -> DataFrame:
    """With the id that is selected where there are several."""
    names = _shared(spark, sf_dir, "catalog_clean").select("uae_assetid", "nl_pos", "nl_name")
    several = cut(found.filter("n_ids > 1").select(*KEYS, "list"))
    return found.join(cut(selection.choose_named(several, held, names).drop("list", "n_ids")), KEYS, "left")


def exact_results(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """What attributes and signatures find: matched, with one id."""
    known = _shared(spark, sf_dir, "known_matches").select("query", "own_brand", "mapped_ids", "matched_on", "method", "match_score")
    by_attributes = known.filter(F.col("method").startswith("attribute"))
    alike = similar_storage(spark, sf_dir, asked.join(by_attributes.select("query", "own_brand"), ["query", "own_brand"], "left_anti"))
    rest = known.filter("method = 'signature'").join(alike.select("query", "own_brand"), ["query", "own_brand"], "left_anti")
    every = cut(by_attributes.unionByName(alike).unionByName(rest))
    known, held = matching.known_ids(every.withColumn("n_ids", F.lit(0)), _shared(spark, sf_dir, "known_entries"))
    found = _chosen(spark, sf_dir, cut(asked.select(*KEYS).join(known, ["query", "own_brand"])), held)
    several = F.col("n_ids") > 1
    medium = (F.col("match_score") == 90.0) & F.col("method").isin("attribute_tier3_fuzzy_storage", "attribute_tier2_multi_variant") & ~(several & (F.col("method") == "attribute_tier2_multi_variant"))
    return found.select(*KEYS, F.coalesce("selected_id", "first_id").alias("mapped"), "match_score", F.lit("MATCHED").alias("match_status"), F.when(medium, "MEDIUM").otherwise("HIGH").alias("confidence"), "matched_on", "method", several.alias("auto_selected"), F.coalesce("selection_reason", F.lit("")).alias("selection_reason"), F.coalesce("other_ids", F.array().cast("array<string>")).alias("other_ids"), F.lit(None).cast(_NEAR).alias("near"))


_NEAR = "array<struct<rank:bigint,id:string,name:string,score:double,asset_id:string>>"


def laptop_results(spark: SparkSession, sf_dir: str, rest: DataFrame, names: DataFrame) -> DataFrame:
    """Laptops by their parts (J9); what that leaves, by similarity, for review only."""
    texts = _shared(spark, sf_dir, "laptop_texts").select(*KEYS, "brand", "laptop_query").join(rest.select(*KEYS), KEYS, "left_semi")
    by_parts = cut(Query(laptops.matches).spark(spark, sf_dir)).join(rest.select(*KEYS), KEYS, "left_semi")
    by_parts = by_parts.select(*KEYS, F.col("mapped_ids").alias("mapped"), "match_score", "match_status", "confidence", "matched_on", "method", F.lit(False).alias("auto_selected"), "selection_reason", "other_ids", F.lit(None).cast(_NEAR).alias("near"))
    left = texts.join(by_parts.select(*KEYS), KEYS, "left_anti")
    asked = left.select(F.col("laptop_query").alias("query"), "brand", F.lit("laptop").alias("category"), F.col("brand").alias("in_brand"), F.lit("laptop").alias("in_category")).distinct()
    near = top_names(asked, names, 3, WEAK).select(F.col("query").alias("laptop_query"), "brand", "near")
    weak = left.join(near, ["laptop_query", "brand"]).withColumn("score", F.col("near")[0]["score"])
    strong = F.col("score") >= SIMILAR
    weak = weak.select(*KEYS, F.col("near")[0]["id"].alias("mapped"), F.col("score").alias("match_score"), F.lit("REVIEW_REQUIRED").alias("match_status"), F.when(strong, "MEDIUM").otherwise("LOW").alias("confidence"), F.col("near")[0]["name"].alias("matched_on"), F.when(strong, "laptop_fuzzy_fallback").otherwise("laptop_retrieval_weak").alias("method"), F.lit(False).alias("auto_selected"), F.when(strong, "").otherwise("weak retrieval — top candidates below threshold").alias("selection_reason"), F.array().cast("array<string>").alias("other_ids"), F.slice("near", 2, 2).alias("near"))
    return by_parts.unionByName(weak)


def widened_results(rest: DataFrame, names: DataFrame, widen: str) -> DataFrame:
    """Texts whose brand has no name of their category: the brand's names, else the
    whole catalog, for review only (J4).  ``conservative`` asks for a family key."""
    scopes = names.select("in_brand", "in_category").distinct()
    lost = rest.filter("category <> 'other'").join(scopes, (F.col("brand") == F.col("in_brand")) & (F.col("category") == F.col("in_category")), "left_anti")
    if widen == "conservative":
        lost = apply_layers(lost, families.family_layers(SPARK, "query", "category", "brand")).filter("family_key <> ''")
    brands = scopes.filter(F.col("in_category") == ANY).select(F.col("in_brand").alias("brand"), F.lit(True).alias("known"))
    lost = lost.join(brands, "brand", "left").withColumns({"in_brand": F.when(F.col("known"), F.col("brand")).otherwise(ANY), "in_category": F.lit(ANY), "source": F.when(F.col("known"), "brand_only").otherwise("global_pool")})
    near = top_names(lost.select("query", "brand", "category", "in_brand", "in_category").distinct(), names, 3, 0.0)
    found = lost.join(near, ["query", "brand", "category"]).filter(F.col("near")[0]["score"] >= WIDE)
    return found.select(*KEYS, F.col("near")[0]["id"].alias("mapped"), F.col("near")[0]["score"].alias("match_score"), F.lit("REVIEW_REQUIRED").alias("match_status"), F.lit("LOW").alias("confidence"), F.col("near")[0]["name"].alias("matched_on"), F.concat(F.lit("fuzzy_widened_"), "source").alias("method"), F.lit(False).alias("auto_selected"), F.concat(F.lit("widened_search("), "source", F.lit(")")).alias("selection_reason"), F.array().cast("array<string>").alias("other_ids"), "near")


def fuzzy_results(spark: SparkSession, sf_dir: str, rest: DataFrame, names: DataFrame, widen: str) -> DataFrame:
    """The most similar name, guarded by model words; what may count and what goes to review."""
    keys = ["query", "brand", "category"]
    scope = ["in_brand", "in_category", "matched_on"]
    named = cut(names.select("in_brand", "in_category", F.col("normalized_name").alias("matched_on"), "asset_id", "first_id").withColumn("list", F.monotonically_increasing_id()))
    best = nearest(spark, sf_dir, rest, names).filter("rank = 1").select(*keys, "in_brand", "in_category", F.col("normalized_name").alias("matched_on"), "n_ids", F.col("score").alias("plain_score"))
    best = cut(best.join(named.select(*scope, "list", "first_id"), scope).drop("in_brand", "in_category"))
    held = named.join(best.filter("n_ids > 1").select("list").distinct(), "list").select("list", F.posexplode(F.split("asset_id", ", ")).alias("place", "asset_id"))
    found = _chosen(spark, sf_dir, cut(_gated(cut(rest.select(*KEYS, "brand", "category").join(best, keys)))), cut(held))
    found = found.join(named.select("list", "asset_id"), "list")
    passes, near = F.size("gate") == 0, F.col("plain_score") < SIMILAR
    found = found.withColumn("score", F.when(near, F.col("plain_score")).otherwise(F.least("plain_score", F.col("most").cast("double")))).filter(~near | passes & F.lit(widen != "conservative"))
    score, several = F.col("score"), F.col("n_ids") > 1
    said = F.when(score == F.floor("score"), score.cast("long").cast("string")).otherwise(score.cast("string"))
    low, high, soft = score < SIMILAR, score >= HIGH, (score >= SOFT) & passes
    auto = lambda name: F.concat(F.lit(name), F.when(several, "_auto_selected").otherwise(""))
    kind = F.when(near, "fuzzy_near_miss_recovery").when(low, "fuzzy_below_threshold").when(high & ~passes, "fuzzy_gate_blocked").when(high, auto("fuzzy")).when(soft, auto("fuzzy_soft_upgrade")).when(F.col("verified") & ~passes, "fuzzy_verified_gate_blocked").when(F.col("verified"), auto("fuzzy_verified")).otherwise("fuzzy")
    found = cut(found.withColumn("method", kind))
    counts = ~near & ~low & passes & (high | soft | F.col("verified"))
    dropped = low & ~near & F.lit(widen == "conservative")
    blocked = F.col("method").endswith("gate_blocked")
    reason = F.when(near, F.concat(F.lit("near_miss_recovery(score="), score.cast("string"), F.lit(")"))).when(low, F.concat(F.lit("below_threshold(score="), said, F.lit(")"))).when(blocked, F.concat(F.lit("gate_fail: "), F.array_join("gate", "; "))).when(counts & several, F.col("selection_reason")).when(F.col("method") == "fuzzy_soft_upgrade", F.concat(F.lit("soft_upgrade(score="), said, F.lit(">=88,gate=pass)"))).otherwise("")
    sure = F.when(near | low, "LOW").when(high & passes, "HIGH").otherwise("MEDIUM")
    shown = found.filter(near | low).select(*keys).distinct()
    catalog = _shared(spark, sf_dir, "catalog_features").select("brand", "category", "normalized_name", "nl_pos", "uae_assetid")
    top = top_names(_scoped(shown, catalog, names).drop("least", "need"), names, 3)
    none = F.array().cast("array<string>")
    return found.join(top, keys, "left").select(*KEYS, F.when(dropped, "").when(counts & several, F.col("selected_id")).otherwise(F.col("asset_id")).alias("mapped"), score.alias("match_score"), F.when(dropped, "NO_MATCH").when(counts, "MATCHED").otherwise("REVIEW_REQUIRED").alias("match_status"), sure.alias("confidence"), "matched_on", F.when(dropped, "fuzzy").otherwise(F.col("method")).alias("method"), (counts & several).alias("auto_selected"), F.when(dropped, "").otherwise(reason).alias("selection_reason"), F.when(counts & several, F.col("other_ids")).otherwise(none).alias("other_ids"), F.when(near | low & ~dropped, F.col("near")).alias("near"))


def _differences(spark: SparkSession, sf_dir: str, found: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of text and name with the attributes ``q_*`` and ``c_*`` and the reasons
    of the strict checks, ``r_any`` and one for each kind."""
    own = asked.select(*KEYS, *(F.col(n).alias(f"q_{n}") for n in a.FIELDS))
    first = Window.partitionBy("brand", "normalized_name").orderBy("nl_pos")
    of_name = _shared(spark, sf_dir, "catalog_features").withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col("normalized_name").alias("matched_on"), *(F.col(n).alias(f"c_{n}") for n in a.FIELDS))
    pair = found.join(own, KEYS).join(of_name.withColumn("q_brand", F.col("c_brand")), ["matched_on", "q_brand"], "left").na.fill("", [f"c_{n}" for n in a.FIELDS if n not in ("variant_tokens", "storage_list")])
    return apply_layers(cut(pair), [*matching.variant_layers(SPARK), {f"r_{k}": matching.variant_reasons(SPARK, k) for k in ("any", "mobile", "tablet", "laptop")}])


def audited(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """Matched rows of a result that the strict check of their category would not let
    pass; of phones, differences in what is only a way of writing are told apart (G10)."""
    texts = _shared(spark, sf_dir, "input_list").select("row_id", *KEYS)
    asked = cut(texts.select(*KEYS).distinct().join(_shared(spark, sf_dir, "input_texts").drop("whole6"), ["query", "own_brand"]))
    matched = results.filter("match_status IN ('MATCHED', 'MULTIPLE_MATCHES')").select("row_id", "matched_on", F.lower("category").alias("of"))
    pairs = matched.join(texts, "row_id").groupBy(*KEYS, "matched_on", "of").agg(F.count("*").alias("rows"))
    told = cut(_differences(spark, sf_dir, pairs, asked).select("of", "rows", "r_any", "r_mobile", "r_tablet", "r_laptop"))
    hard = "^(?:mobile_model:|mobile_storage:|mobile_variant:|mobile_model_number:|samsung_s_number:|samsung_variant:)"
    kinds = (("laptop_model_platform_mismatch_in_MATCHED", "laptop", "r_laptop"), ("mobile_variant_mismatch_in_MATCHED", "mobile", "r_mobile"), ("watch_mm_connectivity_mismatch_in_MATCHED", "watch", "r_any"), ("tablet_size_connectivity_mismatch_in_MATCHED", "tablet", "r_tablet"))
    out = None
    for name, kind, reasons in kinds:
        wrong = (F.col("of") == kind) & (F.size(reasons) > 0)
        n = F.coalesce(F.sum(F.when(wrong, F.col("rows"))), F.lit(0))
        sure = F.coalesce(F.sum(F.when(wrong & F.exists(reasons, lambda r: r.rlike(hard)), F.col("rows"))), F.lit(0))
        row = told.agg(n.alias("n"), sure.alias("confirmed"), F.coalesce(F.max(F.when(wrong, F.array_join(reasons, "; "))), F.lit("")).alias("example"))
        row = row.select(F.lit(name).alias("audit"), "n", F.when(F.lit(kind == "mobile"), F.col("confirmed")).otherwise(F.col("n")).alias("confirmed"), F.when(F.col("n") == 0, "PASS").otherwise("WARN" if kind == "mobile" else "FAIL").alias("status"), "example")
        out = row if out is None else out.unionByName(row)
    return out


def enforced(spark: SparkSession, sf_dir: str, found: DataFrame, asked: DataFrame) -> DataFrame:
    """Matched texts through the gates (D7): similarity never counts as matched; a
    wrong identity is no match; other contradictions go to review."""
    matched = found.filter("match_status = 'MATCHED'")
    exact = _gated(matched.filter(~F.col("method").contains("fuzzy_") & (F.col("method") != "fuzzy") | F.col("method").startswith("attribute")).select(*KEYS, "matched_on").distinct())
    pair = _differences(spark, sf_dir, exact, asked)
    cat = F.col("q_category")
    none = F.array().cast("array<string>")
    own_kind = F.when(cat == "mobile", F.col("r_mobile")).when(cat == "tablet", F.col("r_tablet")).when(cat == "laptop", F.col("r_laptop")).otherwise(none)
    reasons = F.concat("gate", F.transform("r_any", lambda r: F.concat(F.lit("vem_"), r)), own_kind)
    kept = F.filter(reasons, lambda r: r.rlike("^(?:category_cross:|storage_mismatch:|variant_mismatch:|vem_storage|laptop_)"))
    pair = cut(pair.select(*KEYS, F.when(cat == "laptop", kept).otherwise(reasons).alias("reasons")))
    both = found.join(pair, KEYS, "left")
    similar_only = (F.col("match_status") == "MATCHED") & F.col("reasons").isNull()
    failed = (F.col("match_status") == "MATCHED") & (F.size("reasons") > 0)
    wrong = failed & F.exists("reasons", lambda r: r.startswith("model_identity_mismatch:")) & F.col("method").startswith("attribute")
    out = {
        "verification_pass": F.when(F.col("match_status") != "MATCHED", F.lit(None).cast("boolean")).otherwise(~similar_only & ~failed),
        "verification_reasons": F.when(similar_only, "fuzzy_downgrade: fuzzy matches require human review").when(failed, F.array_join("reasons", "; ")).otherwise(""),
        "final_method": F.concat("method", F.when(similar_only, "_fuzzy_downgrade").when(wrong, "_identity_rejected").when(failed, "_gate_blocked").otherwise("")),
        "confidence": F.when(wrong, "LOW").when(similar_only | failed, "MEDIUM").otherwise(F.col("confidence")),
        "final_status": F.when(wrong, "NO_MATCH").when(similar_only | failed, "REVIEW_REQUIRED").otherwise(F.col("match_status")),
    }
    return both.withColumns(out).drop("reasons", "method", "match_status").withColumnsRenamed({"final_method": "method", "final_status": "match_status"})


def _alternatives(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """At most three other candidates of each text, with names."""
    clean = _shared(spark, sf_dir, "catalog_clean")
    by_id = clean.groupBy("uae_assetid").agg(F.min_by("nl_name", "nl_pos").alias("raw"))
    ids = found.filter(F.size("other_ids") > 0).select(*KEYS, "method", F.posexplode(F.slice("other_ids", 1, 3)).alias("place", "uae_assetid"))
    ids = ids.join(by_id, "uae_assetid", "left").select(*KEYS, "place", F.struct("uae_assetid", F.coalesce("raw", F.lit("")).alias("uae_assetname"), F.lit(0.0).alias("score"), F.col("method").alias("reason")).alias("alt"))
    near = found.filter(F.size("near") > 0).select(*KEYS, "method", F.posexplode("near").alias("place", "n"))
    near = near.join(by_id, F.col("n.id") == F.col("uae_assetid"), "left").select(*KEYS, "place", F.struct(F.col("n.id").alias("uae_assetid"), F.when(F.col("method").startswith("laptop"), F.coalesce("raw", "n.name")).otherwise(F.col("n.name")).alias("uae_assetname"), F.col("n.score").alias("score"), F.col("method").alias("reason")).alias("alt"))
    listed = ids.unionByName(near).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "alt"))).alias("z"))
    return found.join(listed.select(*KEYS, F.slice(F.col("z.alt"), 1, 3).alias("alts")), KEYS, "left").withColumn("alts", F.coalesce("alts", F.array().cast(_ALT)))


def _blocked(found: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """For blocked texts the candidate that was blocked and two near ones of its brand."""
    stopped = found.filter(F.col("method").contains("gate_blocked")).select(*KEYS, "matched_on", "mapped", "match_score", "verification_reasons")
    stopped = stopped.join(asked.select(*KEYS, "brand", "category"), KEYS)
    brands = names.filter(F.col("in_category") == ANY).select(F.col("in_brand").alias("brand"), F.lit(True).alias("known")).distinct()
    scoped = stopped.join(brands, "brand", "left").withColumns({"in_brand": F.when(F.col("known"), F.col("brand")).otherwise(ANY), "in_category": F.lit(ANY)})
    near = top_names(scoped.select("query", "brand", "category", "in_brand", "in_category").distinct(), names, 5, lists=True)
    met = stopped.join(near, ["query", "brand", "category"], "left")
    others = F.slice(F.filter(F.coalesce("near", F.array().cast(_NEAR)), lambda n: n["name"] != F.col("matched_on")), 1, 2)
    listed = F.transform(others, lambda n: F.struct(n["asset_id"].alias("uae_assetid"), n["name"].alias("uae_assetname"), n["score"].alias("score"), F.lit("nearby_candidate").alias("reason")))
    first = F.struct(F.col("mapped").alias("uae_assetid"), F.col("matched_on").alias("uae_assetname"), F.col("match_score").alias("score"), F.concat(F.lit("gate_blocked: "), F.substring("verification_reasons", 1, 80)).alias("reason"))
    return found.join(met.select(*KEYS, F.concat(F.array(first), listed).alias("blk")), KEYS, "left").withColumn("blk", F.coalesce("blk", F.array().cast(_ALT)))


def _explained(found: DataFrame) -> DataFrame:
    """Reasons, one-line summaries and priorities (D19d to D19h)."""
    method, status, score = F.col("method"), F.col("match_status"), F.col("match_score")
    laptop = F.col("category") == "laptop"
    signal = F.coalesce("laptop_signal", F.lit(False))
    missing = F.when(method == "skipped", "EMPTY_PRODUCT_NAME").when(method.isin("empty_input", "missing_brand"), "LOW_SIGNAL_INPUT").when(method.contains("identity_rejected") | method.contains("gate_blocked"), "BLOCKED_BY_GATE").when(F.col("verification_reasons").contains("category_cross"), "TAXONOMY_MISMATCH").when(laptop & ~((F.col("own_brand") != "") & (score < 75) & ~signal), "RETRIEVAL_WEAK").otherwise("CATALOG_MISSING_LIKELY")
    review = F.when(method.contains("retrieval_weak"), "RETRIEVAL_WEAK").when(method.contains("fuzzy"), "FUZZY_ONLY").when(method.contains("gate_blocked"), "GATE_BLOCKED_SUSPICIOUS").when(F.col("selection_reason").contains("multiple NL IDs"), "MULTI_ID_AMBIGUOUS").otherwise("NEAR_MATCH_NEEDS_HUMAN")
    bare = (status == "REVIEW_REQUIRED") & (F.size("alts") == 0) & (F.size("blk") == 0)
    found = found.withColumns({
        "no_match_reason": F.when(bare, "NO_ACTIONABLE_CANDIDATES").when(status == "NO_MATCH", missing).when(status.isin("MATCHED", "MULTIPLE_MATCHES"), "SUCCESS").otherwise(""),
        "review_reason": F.when((status == "REVIEW_REQUIRED") & ~bare, review).otherwise(""),
        "confidence": F.when(bare, "LOW").otherwise(F.col("confidence")),
        "final": F.when(bare, "NO_MATCH").otherwise(status),
    })
    why, rr = F.col("no_match_reason"), F.col("review_reason")
    said = score.cast("string")
    first = F.substring(F.trim(F.split("verification_reasons", ";")[0]), 1, 60)
    told = F.when(rr == "GATE_BLOCKED_SUSPICIOUS", F.concat(F.lit("Gate blocked ("), F.when(first == "", "attribute mismatch").otherwise(first), F.lit("). Verify candidate."))).when(rr == "FUZZY_ONLY", F.concat(F.lit("Low-confidence fuzzy ("), said, F.lit("%). Verify identity."))).when(rr == "MULTI_ID_AMBIGUOUS", "Multiple catalog IDs. Select correct variant.").otherwise(F.concat(F.lit("Near match ("), said, F.lit("%). Needs human verification.")))
    lost = F.lit("")
    for code, text in t.NO_MATCH_SUMMARIES.items():
        lost = F.when(why == code, text).otherwise(lost)
    lost = F.when(why.isin(*t.NO_MATCH_SUMMARIES), lost).when(why != "", F.concat(F.lit("No match: "), why, F.lit("."))).otherwise("")
    best = F.coalesce(F.array_max(F.transform(F.concat("alts", "blk"), lambda c: c["score"])), F.lit(0.0))
    priority = F.round(score + F.when(best >= 90, 20).when(best >= 80, 10).otherwise(0) + F.when(rr == "GATE_BLOCKED_SUSPICIOUS", 15).when(rr == "MULTI_ID_AMBIGUOUS", 10).otherwise(0), 2)
    return found.drop("match_status").withColumnRenamed("final", "match_status").withColumns({"review_summary": F.when(F.col("match_status") == "REVIEW_REQUIRED", told).when(F.col("match_status") == "NO_MATCH", lost).otherwise(""), "review_priority": F.when(F.col("match_status") == "REVIEW_REQUIRED", priority).otherwise(0.0)})


def decisions(spark: SparkSession, sf_dir: str, widen: str = "aggressive") -> DataFrame:
    """The decision on each distinct text."""
    said = _shared(spark, sf_dir, "input_list").select(*KEYS).distinct()
    asked = said.join(_shared(spark, sf_dir, "input_texts").drop("whole6"), ["query", "own_brand"])
    asked = cut(asked)
    low = F.lower(F.trim("plain"))
    early = F.when(low.isin("", "nan", "none"), "skipped").when((F.length("query") < 3) | F.col("query").isin("nan", "none", "na", "n/a"), "empty_input").when(F.col("own_brand") == "", "missing_brand")
    refused = asked.withColumn("method", early).filter("method IS NOT NULL")
    refused = refused.select(*KEYS, F.lit("").alias("mapped"), F.lit(0.0).alias("match_score"), F.when(F.col("method") == "missing_brand", "REVIEW_REQUIRED").otherwise("NO_MATCH").alias("match_status"), F.lit("LOW").alias("confidence"), F.lit("").alias("matched_on"), "method", F.lit(False).alias("auto_selected"), F.lit("").alias("selection_reason"), F.array().cast("array<string>").alias("other_ids"), F.lit(None).cast(_NEAR).alias("near"))
    names = _names(_shared(spark, sf_dir, "catalog_features").select("brand", "category", "normalized_name", "nl_pos", "uae_assetid"))
    names = cut(names)
    rest = asked.join(refused.select(*KEYS), KEYS, "left_anti")
    exact = cut(exact_results(spark, sf_dir, rest))
    rest = cut(rest.join(exact.select(*KEYS), KEYS, "left_anti"))
    wide = widened_results(rest, names, widen)
    scopes = names.select(F.col("in_brand").alias("brand"), F.col("in_category").alias("category")).distinct()
    placed = rest.filter("category = 'other'").unionByName(rest.filter("category <> 'other'").join(scopes, ["brand", "category"], "left_semi"))
    laptop = (F.col("category") == "laptop") & F.col("asks_laptop")
    of_laptops = laptop_results(spark, sf_dir, placed.filter(laptop), names)
    fuzzy = fuzzy_results(spark, sf_dir, placed.filter(~laptop), names, widen)
    found = cut(exact.unionByName(of_laptops).unionByName(wide).unionByName(fuzzy).unionByName(refused))
    nothing = asked.select(*KEYS).join(found.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("").alias("mapped"), F.lit(0.0).alias("match_score"), F.lit("NO_MATCH").alias("match_status"), F.lit("LOW").alias("confidence"), F.lit("").alias("matched_on"), F.lit("none").alias("method"), F.lit(False).alias("auto_selected"), F.lit("").alias("selection_reason"), F.array().cast("array<string>").alias("other_ids"), F.lit(None).cast(_NEAR).alias("near"))
    found = cut(enforced(spark, sf_dir, found.unionByName(nothing), asked))
    loose = _gated(found.filter("verification_pass IS NULL AND matched_on <> ''").select("query", "matched_on").distinct()).select("query", "matched_on", "gate")
    found = found.join(loose, ["query", "matched_on"], "left").withColumns({"verification_reasons": F.when(F.col("verification_pass").isNull(), F.coalesce(F.array_join("gate", "; "), F.lit(""))).otherwise(F.col("verification_reasons")), "verification_pass": F.coalesce("verification_pass", F.coalesce(F.size("gate"), F.lit(0)) <= 0)}).drop("gate")
    parts = _shared(spark, sf_dir, "laptop_texts").select(*KEYS, ((F.col("q_fam") != "") | (F.col("q_pc") != "") | (F.col("q_mc") != "")).alias("laptop_signal"))
    found = _blocked(cut(_alternatives(spark, sf_dir, cut(found))), asked, names).join(asked.select(*KEYS, "category"), KEYS).join(parts, KEYS, "left")
    return _explained(cut(found)).drop("laptop_signal", "near", "other_ids")


def pipeline_v2(spark: SparkSession, sf_dir: str, widen: str = "aggressive") -> DataFrame:
    """One row for each input row: ids, score, status, confidence, method, candidates and reasons."""
    rows = _shared(spark, sf_dir, "input_list").select("row_id", "source_sheet", *KEYS)
    names = ["match_score", "match_status", "confidence", "matched_on", "method", "auto_selected", "selection_reason", F.to_json("alts").alias("alternatives"), F.to_json("blk").alias("blocked_candidates"), "category", "verification_pass", "verification_reasons", "no_match_reason", "review_reason", "review_summary", "review_priority"]
    return rows.join(decisions(spark, sf_dir, widen), KEYS, "left").select("row_id", "source_sheet", F.col("own_brand").alias("brand"), F.col("plain").alias("original_input"), F.col("mapped").alias("mapped_uae_assetid"), *names)


def metrics_of_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_v2(spark, sf_dir).groupBy("match_status", "method").agg(F.count("*").alias("n"), F.round(F.avg("match_score"), 2).alias("mean_score"))


QUERIES = {"j6_fuzzy_best": fuzzy_best, "j8_near_miss": near_miss, "pipeline_v2": pipeline_v2, "g6_pipeline_metrics": metrics_of_pipeline}
