"""Decontamination, chat, pages, media, packing, toxicity and personal data against plain Python."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import chat, decontaminate, html_extract, media, packing, pii, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)


def odd_rows():
    """Nulls, empties, a repeated row, a long text, ties."""
    return [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (4, "word " * 30_000), (5, "   \n\t ")]


# decontamination


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = low(text), set(), set()
    for name, item in items:
        item_words = low(item)
        n = min(window, len(item_words))
        for at in range(len(item_words) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == item_words[at : at + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [10**6, 200])
def test_contamination_equals_brute_force(spark, block_chars):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((1, 2, 5, 13, 14, 30, 40))] + [(90, None), (91, "..!"), (92, "Ünïcode É x")]
    docs = [(i, " ".join(rng.choices([*words, "Other,", "W3."], k=rng.randrange(0, 80)))) for i in range(40)]
    docs += [(100 + i, f"x {t} y {t}".upper()) for i, (_, t) in enumerate(items) if t] + [(None if i is None else 500 + i, t) for i, t in odd_rows()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(documents(spark, docs), bench, block_chars=block_chars).collect()
    assert len(got) == len(docs)
    want = {i: brute_hits(t, items) for i, t in docs if i != 504}
    for row in got:
        if row.doc_id != 504:
            n, hit, found = want[row.doc_id]
            assert (row.n_words, row.n_hit, row["items"]) == (n, hit, found)
            assert row.contaminated == (hit > 0 and 20 * hit >= n)


def test_contaminated_rows_go_and_columns_stay(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = documents(spark, [(1, "say one two three four now"), (2, "clean"), (None, None)])
    kept = decontaminate.remove_contaminated(docs.selectExpr("*", "7 AS item_id", "'x' AS n_words"), bench)
    assert kept.columns == [*docs.columns, "item_id", "n_words"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == 3
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


# chat


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", r"[\INST] [\\INST] <\s>", "[ROLE] [/ROLE] < s > [", "a\\", "[INST" * 3 + "]"])
def test_turns_are_read_back(text):
    whole = chat.BEGIN + "".join(chat.format_turn(r, text)[0] for r in ("system", "user", "assistant", None, "tool ]["))
    assert chat.parse(whole) == [("system", text), ("user", text), ("assistant", text), (None, text), ("tool ][", text)]
    assert not chat._CONTROL.search(chat.escape(text)) or "\\" in chat.escape(text)


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "[INST] a"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, "user", "alone"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example", "'c' AS loss_start")
    got = sorted(chat.expand_targets(turns).collect(), key=lambda r: r.example)
    assert [(r.conv_id, r.example) for r in got] == [(1, 0), (1, 1)]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in got] == ["[INST] a", "b"]
    assert got[1].text.startswith(got[0].text) and len(chat.parse(got[1].text)) == 4
    read = {(r.conv_id, r.n_turns) for r in chat.read_examples(chat.expand_targets(turns, keep_rest=True)).collect()}
    assert read == {(1, 2), (1, 4), (1, 5), (2, 1), (None, 1)}
    assert chat.expand_targets(turns.limit(0)).count() == 0


# pages


def test_article_is_kept_and_the_rest_goes():
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy<article><h1>Head</h1><p>One <b>bo</b>ld&amp;\n two<br>three<script>var a='</p>';</script><aside>side</aside><form><p>mail</p></form><p>x</p><div class='comments'><p>nice</p></div></article><footer>&copy;</footer>"
    assert html_extract.main_text(page) == "Head One bold& two three x"


def test_text_surges_and_dives_without_an_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    page = f"<div id=menu><a href=a>A</a></div><div><a href=b>link link link</a></div><h1>Head</h1>{body}<div class=sidebar>side {'s ' * 99}</div><div>© 2020</div>"
    want = "Head " + " ".join(f"{'word ' * 30}{i}" for i in range(5))
    assert html_extract.main_text(page) == " ".join(want.split())


def test_broken_pages_have_a_result(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>a<div"), (3, "u", "<p>a<div"), (None, None, "plain"), (5, "u", "<" * 50_000), (6, "u", "<a href='" + "x" * 100_000)]
    got = html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)


def test_pages_equal_their_articles(spark):
    for row in html_extract.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        inner = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))
        assert row.text == " ".join(html.unescape(plain).split())


def plain_kept(lengths, surge, window):
    """Runs of lines whose windows hold text, that have a window with enough of it."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    least = max(1, min(surge, max(sums, default=0)))
    keep, i = [False] * len(lengths), 0
    while i < len(lengths):
        end = i
        while end < len(lengths) and sums[end] > 0:
            end += 1
        strong = [j for j in range(i, end) if sums[j] >= least]
        for j in range(strong[0] if strong else end, end):
            keep[j] = any(lengths[strong[0] : j + 1])
        i = max(end, i + 1)
    return keep


def test_surges_and_dives_equal_brute_force():
    rng = random.Random(12)
    for _ in range(3000):
        lengths = [rng.choice((0, 0, 0, 5, 30, 90)) for _ in range(rng.randrange(0, 25))]
        window, surge = rng.randrange(1, 5), rng.choice((1, 20, 80, 200))
        assert html_extract._kept(lengths, surge, window) == plain_kept(lengths, surge, window), (lengths, surge, window)


def test_pages_without_article_tags_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = sum(html_extract.main_text(re.sub(r"</?article>", "", p.html)) == html_extract.main_text(p.html) for p in pages)
    bare = sum(html_extract.main_text(re.sub(r"</?(?:article|nav)>", "", p.html)) == html_extract.main_text(p.html) for p in pages)
    assert same >= 0.95 * len(pages) and bare >= 0.95 * len(pages)


def test_all_articles_stay_and_teasers_go():
    page = "<main><article><p>First.</article><article class=comment><p>Nice.</article><article><a href=x>More news</a></article></main><p>out</p><article><h2>Second</h2><div class=ad>Buy</div><p><a href=y>Fin.</a></p></article>"
    assert html_extract.main_text(page) == "First. More news Second Fin."
    page = "<article><p>First.</article><article><a href=x>More news</a></article><article><p>Second.</article><p>out"
    assert html_extract.main_text(page) == "First. Second."


def test_a_block_ends_a_paragraph_and_quotations_hold_signs():
    assert html_extract.main_text('<p class="ad">Buy<p title="a > b">Text <b>bold<p>more') == "Text bold more"
    assert html_extract.main_text('<p title="never closed>Text</p><p>more</p>') == "Text more"
    assert html_extract.main_text("1 < 2 &amp; 3<br>x") == "1 < 2 & 3 x"


@pytest.mark.parametrize("page", ["<a" * 500_000, "<" * 1_000_000, "<p>" * 100_000 + "</b>" * 100_000, '<a "' * 200_000, '<a ">" ' * 150_000, "<!-- " * 200_000, "<p " + "a" * 500_000 + "=>x", "<b>" * 100_000 + "<div></div>" * 50_000, "<p><button>" + "<b>" * 100_000 + "<i></i>" * 50_000, "&" * 500_000, "<script>" * 100_000, "<div class=ad>" * 50_000 + "<article></article>" * 20_000])
def test_pathological_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 5


# media


def test_images_are_read_back():
    rng = np.random.default_rng(3)
    for shape in ((1, 64), (7, 5), (300, 64), (4, 3, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode_image(media.encode_pnm(pixels)) == pixels).all()
        assert (media.decode_image(media.encode_bmp(pixels)) == pixels).all()
    grey = rng.integers(0, 256, (300, 64), dtype=np.uint8)
    assert (media.untile(media.npy_tiles(grey, 48), 64) == grey).all()


def test_area_resize_is_the_mean_below_each_pixel():
    pixels = np.random.default_rng(4).integers(0, 256, (12, 20)).astype(float)
    fine = np.kron(pixels, np.ones((8, 9)))  # each target pixel is whole in this grid
    want = fine.reshape(8, 12, 9, 20).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(pixels, 8, 9), want)


def test_media_hold_the_bytes(spark):
    rows = odd_rows() + [(9, "é" * 33)]
    got = media.media_digests(media.as_media(documents(spark, rows))).collect()
    want = []
    for i, t in rows:
        data = (t or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        want.append((i or 0, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)


# packing


def test_tokens_and_places(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = odd_rows() + [(20 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").collect())]
    rows += [(900, "I don't 's ²³ “q”… a.b, c.,\n<|endoftext|>x"), (901, "a\x1cb ΑΣ é́ İ")]
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    got = packing.pack(documents(spark, rows), path).collect()
    want = sorted((i or 0, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes()), len(x)) for (i, _), x in zip(rows, ids, strict=True) for at in range(0, len(x), 2048))
    assert sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(n for _, _, n, _, _ in want) / 2048 / len(places) > 0.9


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(6)
    counts = np.bincount(np.minimum(rng.zipf(1.3, 20_000) + 50, 512), minlength=513)
    counts[0] = 0
    used = np.zeros_like(counts)
    room = 0
    for pattern, times in packing.plan(counts, 512):
        assert sum(pattern) <= 512 and times > 0
        np.add.at(used, list(pattern), times)
        room += 512 * times
    assert (used == counts).all()
    assert (counts * np.arange(513)).sum() / room > 0.98


# toxicity


def test_levenshtein_automaton_equals_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(8)
    words = {"stupid": 1.0, "moron": 1.0, "scum": 1.0, "worthless": 1.0}
    lexicon = toxicity.Lexicon(words, {})
    tries = [*words, "stupd", "stupiid", "sztupid", "moronn", "mroon", "scun", "scums", "wrthless", "worth", ""]
    tries += ["".join(rng.choices("stupidmoronwe", k=rng.randrange(3, 10))) for _ in range(3000)]
    for w in tries:
        exact, near = w in words, any(distance(w, x) <= 1 for x in words if len(x) >= toxicity.FUZZY_FROM)
        assert lexicon.find(w)[0] == (1 if exact else 3 if near else 0), w
    assert toxicity.Lexicon({}, {"loweix": 1.0}).find("loweixchen")[0] == 2
    assert toxicity.Lexicon({}, {"loweix": 1.0}).find("lowexchen")[0] == 4


def test_quotation_and_address_are_seen():
    lexicon = toxicity.Lexicon({"moron": 1.0}, {})
    assert [h[4:] for h in toxicity.hits('He said "moron" once', lexicon).found] == [(True, False)]
    assert [h[4:] for h in toxicity.hits("you are a moron", lexicon).found] == [(False, True)]


def plain_features(text, words, stems):
    """The ten features by brute force: every term against every word."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row

    low = text.lower()
    found = list(re.finditer(r"[^\W_]+(?:[@$*'’!][^\W_]+)*", low))
    quoted = [m.span() for line in re.finditer(r"[^\n]+", low) for p in (r'"[^"]+"', "“[^”]+”", "«[^»]+»") for m in re.compile(p).finditer(low, line.start(), line.end())]
    weight, seen, addressed = Counter(), set(), 0
    for n, m in enumerate(found):
        hits = []
        for t in words:
            d = distance(t, m[0])[-1]
            if d == 0 or d == 1 and len(t) >= 5:
                hits.append((1 if d == 0 else 3, t))
        for t in stems:
            d = min(distance(t, m[0]))
            if d == 0 or d == 1 and len(t) >= 5:
                hits.append((2 if d == 0 else 4, t))
        if hits:
            kind, term = min(hits)
            near = {x[0] for x in found[max(0, n - 8) : n + 9]}
            told = any(a < m.start() and m.end() < b for a, b in quoted) or near & toxicity._REPORTING
            weight["quoted" if told else kind] += words[term] if kind in (1, 3) else stems[term]
            seen.add(term)
            addressed += bool(near & toxicity._ADDRESS)
    total = sum(weight.values())
    return [1.0, *(np.log1p(weight[k]) for k in (1, 2, 3, 4, "quoted")), np.log1p(addressed), float(weight[1] + weight[2] > 0), np.log1p(len(seen)), np.log1p(20 * total / (len(found) + 20))]


def test_features_and_scores_equal_brute_force():
    rng = random.Random(21)
    words, stems = {"stupid": 1.5, "scum": 2.0, "moron": 0.5, "worthless": 3.0}, {"idio": 1.0, "looser": 2.5}
    lexicon = toxicity.Lexicon(words, stems)
    model = toxicity.ToxicityModel(words, stems, [rng.uniform(-1, 1) for _ in range(10)])
    pool = [*words, "stupd", "moronn", "idiot", "loosers", "losers", "scums", "worthles", "calm", "day", "you", "said", "and", "table", "Morons", '"', '"', "“", "”", "\n", "«", "»"]
    for n in range(300):
        text = " ".join(rng.choices(pool, k=rng.randrange(0, 40))) + (' "' + "x " * 600 + 'moron" ' if n % 10 == 0 else "")
        got, want = toxicity._features(toxicity.hits(text, lexicon), lexicon), plain_features(text, words, stems)
        assert np.allclose(got, want), text
        assert np.isclose(model.score(np.array([got]))[0], 1 / (1 + np.exp(-np.dot(want, model.weights))))


def test_quotations_take_linear_time():
    began = time.perf_counter()
    assert toxicity.quotations("“" * 300_000) == [] and len(toxicity.quotations('"a' * 200_000)) == 100_000
    assert time.perf_counter() - began < 5


def test_held_out_labels_are_predicted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    known = docs.join(labels.filter("crc32(cast(doc_id as string)) % 5 = 0").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"))
    got = toxicity.score(known, model).join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    found = sum(r.predicted for r in got if r.toxic == 1) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if r.toxic == 0)
    assert right > 0.97 and found > 0.85 and false <= 3


def test_toxicity_edge_cases(spark):
    docs = documents(spark, odd_rows())
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0 for r in got)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    some = documents(spark, [(i, "a pathetic moron clown" if i % 2 else "a calm day out") for i in range(60)] + odd_rows())
    model = toxicity.learn(some, labels)
    assert {"moron", "clown"} <= set(model.words)
    kept = toxicity.remove_toxic(some, model)
    assert kept.columns == some.columns and not any("moron" in (r.text or "") for r in kept.collect())


# personal data

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


def test_seeds_equal_plain_patterns(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ab1.@+-_ 0925()é\n", k=rng.randrange(0, 120)))) for i in range(300)]
    rows += [(1000, "a@b.c_d@e.f, x@y@z.com 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111; +44 20 7946 0958"), (1001, "x" * 50_000 + "@"), (1002, "a@b" + ".c" * 20_000), (1003, "1" * 60_000)] + odd_rows()
    docs = documents(spark, rows).selectExpr("*", "1 AS spans", "2 AS seeds")
    got = pii.digest(pii.find_personal_data(docs)).collect()
    want = {i: plain_spans(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest(), r.doc_id
        assert set(want[r.doc_id]) <= set(r.spans.split(",")) | {""}


def plain_instances(text):
    """Start, value and contexts of every token with a digit or an at sign."""
    found = [m for m in re.finditer(r"[^\s\"'=<>,;]+", text or "") if re.search("[0-9@]", m[0])]
    out, ends = [], [0, *(m.end() for m in found)]
    for n, m in enumerate(found):
        inner = re.sub(r"^[^A-Za-z0-9+]+", "", m[0])
        value = re.sub(r"[^A-Za-z0-9)]+$", "", inner)
        word = r"[^\W\d_]+|[=:#]"
        left = ["<id>" if n else "<start>", *re.findall(word, text[ends[n] : m.start()][-80:].lower())]
        after = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)]
        right = re.findall(word, after[:80].lower())[:1] or ["<id>" if n + 1 < len(found) else "<end>"]
        two = [left[-2]] if len(left) > 1 else []
        out.append((m.start() + len(m[0]) - len(inner), value, {f"{left[-1]} _", " ".join([*two, left[-1], "_"]), f"{left[-1]} _ {right[0]}"}))
    return out


def plain_kind(value):
    kinds = [k for k, p in PLAIN if re.fullmatch(p.replace(r"\x20-", "-"), value)]
    digits = re.sub("[^0-9]", "", value)
    if "email" in kinds:
        return "email"
    if "ip" in kinds and all(int(x) <= 255 for x in value.split(".")):
        return "ip"
    if "card" in kinds and 13 <= len(digits) <= 19 and luhn(digits):
        return "card"
    if re.match(r"\+[0-9]", value):
        return "phone"
    return "secret" if re.fullmatch("[0-9a-f]{32,}", value) and re.search("[a-f]", value) else None


def plain_discovery(rows, support=5, confidence=0.8, rounds=3):
    """All spans of each row, by the same loop over plain sets."""
    edges = {(p, v) for _, t in rows for _, v, ps in plain_instances(t) if v for p in ps}
    known = {v: plain_kind(v) for _, v in edges}
    for n in range(rounds):
        good = {}
        for p in {p for p, _ in edges}:
            kinds = Counter(known[v] for q, v in edges if q == p)
            size = sum(kinds.values())
            best = max(((c, k) for k, c in kinds.items() if k), default=(0, ""))
            if best[0] >= support and best[0] >= confidence * size:
                good[p] = (best[0] / size, best[1])
        if n == rounds - 1:
            break
        told = {}
        for p, v in edges:
            if known[v] is None and p in good:
                told[v] = max(told.get(v, (0, "")), good[p])
        known |= {v: k for v, (_, k) in told.items()}
    out = []
    order = [k for k, _ in PLAIN] + ["secret"]
    for _, t in rows:
        seeds = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(t))]
        more = set()
        for start, value, ps in plain_instances(t):
            if plain_kind(value) == "secret":
                more.add(("secret", start, start + len(value)))
            if value and (some := [good[p] for p in ps if p in good]):
                more.add((max(some)[1], start, start + len(value)))
        more = {x for x in more if not any(a < x[2] and b > x[1] for _, a, b in seeds)}
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in sorted({*seeds, *more}, key=lambda x: (order.index(x[0]), x[1]))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_equals_the_loop_over_sets(spark, seed):
    rng = random.Random(seed)
    words = ["call", "mail:", "id", "the", "from", "key =", "#", "é,"]
    tokens = [lambda: f"u{rng.randrange(99)}@mail.example", lambda: f"{rng.randrange(256)}.1.2.{rng.randrange(256)}", lambda: f"({rng.randrange(30)})", lambda: f"x{rng.randrange(50)}!", lambda: f'"{rng.randrange(16**32):032x}"', lambda: f"{rng.randrange(16**20):020X}"]
    fixed = {"mail:": [0, 0, 0, 0, 3], "key =": [4, 4, 4, 4, 5], "from": [1, 1, 1, 1, 1, 2], "#": [3, 5]}
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 8)):
            w = rng.choice(words)
            parts += [w, tokens[rng.choice(fixed.get(w, range(6)))]()]
        rows.append((i, " ".join(parts)))
    rows += [(i, t) for i, t in odd_rows() if i not in (3, None)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(documents(spark, rows))).collect()}
    want = plain_discovery(rows)
    assert [got[i] for i, _ in rows] == want
    assert sum(x.count(":") for x in want) > sum(len(plain_spans(t)) * 2 for _, t in rows)


def test_secrets_of_the_table_are_all_found(spark):
    """Precision and recall beyond the four patterns: what follows ``token =`` and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = [(r.doc_id, int(a), int(b)) for r in pii.digest(pii.find_personal_data(docs)).collect() for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"]
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]+)"', t or "")}
    assert set(added) == want and any(texts[i][a:b].isupper() for i, a, b in added)


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please write to mailto: u{i}@mail.example today") for i in range(20)] + [(99, "please write to mailto: hidden(at)mail9 today"), (98, "it is 2020 and rule 9 holds")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(documents(spark, rows))).collect()}
    assert got[99].startswith("email:24:") and got[98] == ""
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(documents(spark, rows)).collect()}
    assert masked[3] == "please write to mailto: [email] today" and masked[98] == rows[-1][1]
