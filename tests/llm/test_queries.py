"""The operators on small rows with edge cases, and against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rowscribe.llm import draws, pii_crf, rank_queue_bpe, registry
from rowscribe.llm.chain import posteriors
from rowscribe.llm.components import connected_components
from rowscribe.llm.cross_polytope import near_vectors
from rowscribe.llm.html_text import extract, main_text
from rowscribe.llm.language_crf import fit, label_documents
from rowscribe.llm.license_scan import TEMPLATES, Scanner, patience, words_of
from rowscribe.llm.mixing import mix_documents
from rowscribe.llm.order_minhash import (
    SIMILAR, _Words, alignment, crossing_shingles, near_texts, pairs_apart, rare_shingles, shingles, similarity, word_numbers,
)
from rowscribe.llm.pii_crf import CARD, IP, KINDS, PHONE, Finder, _replace, base_spans, find_spans, luhn, redact
from rowscribe.llm.rank_queue_bpe import Encoder, decode, encode, load_ranks, pair_table, round_trip
from rowscribe.llm.rendezvous import place
from rowscribe.llm.va_file import top_k
from tests.oracle import connect, differences

registry.load_all()
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, size string"
EDGES = [
    (1, None, None, None, None, "x", "x", "x"),
    (2, "", "en", "src1", 0, None, "x", "x"),
    (3, "the cat sat on the mat " * 30, "en", "src0", 9, "x", None, "x"),
    (4, "the cat sat on the mat " * 30, "en", "src0", 9, "x", "x", None),
    (5, "le chat est sur la table et il dort " * 30, "fr", "src7", 9, "x", "x", "x"),
    (6, "12 34 !?    \U0001f600", None, "src5", 9, "x", "x", "x"),
    (6, "12 34 !?    \U0001f600", None, "src5", 9, "x", "x", "x"),
    (7, "z" * 60_000 + " mail a.b@c.de now", "en", "src9", 9, "x", "x", "x"),
    (None, "one two", "en", "src3", 7, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name]) is None


def test_shards(spark, edges, nothing):
    rows = place(edges, "doc_id", "text", [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == len(EDGES)
    for row in rows:
        assert row["grown_shard"] in (row["shard"], 4)
    slots = Counter()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 1 and not slots
    by_id = {r["doc_id"]: r["text_crc32"] for r in rows}
    assert by_id[1] is None and by_id[3] == zlib.crc32(EDGES[2][1].encode())
    assert place(nothing, "doc_id", "text", [1.0], [1.0, 1.0]).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("k"), F.lit("t").alias("t"))
    heavy = place(many, "k", "t", [3.0, 1.0], [3.0, 1.0, 4.0])
    share = heavy.where("shard = 0").count() / 20_000
    moved = heavy.where("grown_shard = 2").count() / 20_000
    assert abs(share - 0.75) < 0.02 and abs(moved - 0.5) < 0.02


def test_mixing_edges(edges, nothing):
    assert mix_documents(nothing).count() == 0
    rows = mix_documents(edges).collect()
    assert rows and all(r["_n_tokens"] > 0 and r["_epochs"] > 0 for r in rows)


def test_bpe_equals_tiktoken(spark, edges, nothing):
    ranks = load_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = Encoder(ranks, pair_table(ranks), public_tokenizers.PATTERN)
    random = np.random.default_rng(1)
    pool = [chr(c) for c in range(0x250)] + list("  \n\t'stvrell") * 20 + ["　", "́", "\U0001f600", "Ⅷ"]
    texts = ["".join(random.choice(pool, random.integers(0, 60))) for _ in range(400)] + ["ab" * 3000, "a" * 5000]
    for text, packed in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
    for row in round_trip(edges, PATH, public_tokenizers.PATTERN).collect():
        text = next(e[1] for e in EDGES if e[0] == row["doc_id"]) or ""
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert row["n_tokens"] == len(ids) // 4 and row["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    both = decode(encode(edges, "text", ranks, public_tokenizers.PATTERN), "ids_le", ranks)
    assert {r["decoded"].decode() for r in both.collect()} == {e[1] or "" for e in EDGES}
    assert round_trip(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_encoder_memory_is_bounded(monkeypatch):
    ranks = load_ranks(PATH)
    pairs = pair_table(ranks)
    random = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(w) for w in letters[random.integers(0, 26, (60_000, 8))]]
    whole = Encoder(ranks, pairs, public_tokenizers.PATTERN)
    tracemalloc.start()
    found = whole.encode_all([" ".join(words)] * 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 65e6 and len(set(found)) == 1  # 0.5 MB of different words
    monkeypatch.setattr(rank_queue_bpe, "MERGE_BYTES", 50)
    monkeypatch.setattr(rank_queue_bpe, "MEMORY", 30)
    parts = Encoder(ranks, pairs, public_tokenizers.PATTERN)
    texts = [" ".join(words[i : i + 100]) for i in range(0, 1000, 100)] + ["", None, "word " * 50]
    assert [parts.encode_all([t])[0] for t in texts] == whole.encode_all(texts)


def test_forward_backward_is_exact():
    random = np.random.default_rng(2)
    lengths = [1, 200, 3, 64, 65]
    n, k = sum(lengths), 3
    emission, move = random.random((n, k)) + 0.1, random.random((k, k)) + 0.1
    index = np.ones(n, int)
    index[np.cumsum([0] + lengths[:-1])] = 0
    found, _, _ = posteriors(emission, index, np.stack([np.full((k, k), 1 / k), move]))
    at = 0
    for length in lengths:
        e = emission[at : at + length]
        a, b = np.zeros((length, k)), np.ones((length, k))
        a[0] = e[0] / e[0].sum()
        for t in range(1, length):
            a[t] = a[t - 1] @ move * e[t]
            a[t] /= a[t].sum()
        for t in range(length - 2, -1, -1):
            b[t] = move @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(1, keepdims=True)
        assert np.allclose(found[at : at + length], want)
        at += length


def test_language(spark, edges, nothing, sf_dir):
    rows = {r["doc_id"]: r for r in label_documents(edges, "text", fit(edges, "text", "lang")).collect()}
    assert rows[3]["lang_pred"] == "en" and rows[5]["lang_pred"] == "fr"
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[6]["lang_pred"] == "und" and rows[6]["score"] == 0
    assert fit(nothing, "text", "lang") is None
    assert label_documents(nothing, "text", None).count() == 0
    found = registry.QUERIES["op5_language_crf"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    held = found.where("held_out and n_chars > 50")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_personal_data(spark, edges, nothing, sf_dir):
    random = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(random.choice(list("aB0129..@@+-- ()%\n5é"), random.integers(0, 60)))
        assert base_spans(text) == brute_spans(text)
    rows = {r["doc_id"]: r["spans"] for r in find_spans(edges, "text", None).collect()}
    assert rows[1] == [] and [(s["kind"], s["base"]) for s in rows[7]] == [("email", True)]
    assert find_spans(nothing, "text", None).count() == 0
    clean = {r["doc_id"]: r["text"] for r in redact(edges, "text", None).collect()}
    assert clean[7].endswith(" mail <EMAIL> now") and clean[3] == EDGES[2][1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in registry.QUERIES["op8_skip_chain_pii"](spark, sf_dir).collect():
        base = brute_spans(texts[row["doc_id"]] or "")
        assert [row[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_skip_edges_carry_a_label():
    """A weak mark far from a clear equal one takes its label over the skip edge."""
    model = {
        "features": ["*", "at True"],
        "weights": np.array([[1.0, 0, 0, 0, 0], [-3.0, 3.0, 0, 0, 0]]),
        "stack": np.stack([np.full((5, 5), 0.2)] + [np.ones((5, 5))] * 3),
        "agree": 40.0,
    }
    text = "write to hsr.29@mail.example.org today " + "word " * 50 + "as hsr.29 said, not 77"
    found = Finder(model).find([text])[0]
    assert [(text[a:b], base) for _, a, b, base in found] == [("hsr.29@mail.example.org", True), ("hsr.29", False)]


def test_repeats_without_a_digit_are_found(spark, sf_dir):
    """A handle without a digit is found in its other places, with a learned field too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    finder = Finder(pii_crf.fit(docs, "text"))
    text = "(Jane.Doe) asked; write to jane.doe@mail.example.org today " + "word " * 50 + "as jane.doe, said. No janedoe, no doe"
    spans = finder.find([text])[0]
    assert [(text[a:b], base) for _, a, b, base in spans] == [("Jane.Doe", False), ("jane.doe@mail.example.org", True), ("jane.doe", False)]
    assert _replace(text, spans).startswith("(<EMAIL>) asked; write to <EMAIL> today") and "as <EMAIL>, said. No janedoe" in _replace(text, spans)
    many = "ab.cd@x.org " + "ab.cd word " * 3000 + "EFG@x.org efg! ghi@y.org efg"
    assert len(finder.find([many])[0]) == 3005


def test_samples_count_copies_once(spark, monkeypatch):
    texts = [f"call +{i} 555 {i * 7919} or write to user.{i}@mail{i % 3}.org from 10.0.{i}.1" for i in range(10)]
    once = spark.createDataFrame([(t,) for t in texts], "text string")
    copies = once.crossJoin(spark.range(2000)).drop("id").repartition(4)
    ours, theirs = pii_crf.fit(copies, "text"), pii_crf.fit(once, "text")
    assert ours["features"] == theirs["features"] and np.array_equal(ours["weights"], theirs["weights"])
    assert pii_crf.fit(once.limit(1), "text") is not None and pii_crf.fit(once.limit(0), "text") is None
    rows = spark.range(3000).selectExpr("concat('t ', id % 700) AS _text", "IF(id % 700 < 9, 'a', 'b') AS _lang").withColumn("_place", F.xxhash64("_text"))
    wanted = {(r["_lang"], r["_place"]) for r in rows.collect()}
    for spare in (2.0, 0.01):
        monkeypatch.setattr(draws, "SPARE", spare)
        for size in (5, 50, 10_000):
            got = [(r["_lang"], r["_place"]) for r in draws.smallest_places(rows, size, "_lang").collect()]
            best = [p for lang in "ab" for p in sorted((p for p in wanted if p[0] == lang), key=lambda p: draws.by_place(p[1]))[:size]]
            assert sorted(got) == sorted(best)


def test_language_of_copied_texts(spark):
    words = {"en": "the cat sat on a mat and", "fr": "le chat est assis sur la table et"}
    texts = [(f"{w} {' '.join(w.split()[i % 5:])}" + " x" * i, lang) for lang, w in words.items() for i in range(5)] + [("12 34", "xx")]
    once = spark.createDataFrame(texts, "text string, lang string")
    copies = once.crossJoin(spark.range(1000)).drop("id").repartition(4)
    ours, theirs = fit(copies, "text", "lang"), fit(once, "text", "lang")
    assert ours["langs"] == ["en", "fr"] and ours["features"] == theirs["features"] and np.array_equal(ours["weights"], theirs["weights"])


PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="ad">Buy</div><article><h1>A &amp; b</h1><p><b>one \n two<br>three<p>Four.</p><form><input>no</form></article>'
    '<section id="comments"><p>First!</p></section><footer>&copy; x</footer>'
)


def test_pages(spark):
    assert main_text(PAGE) == "A & b\none two three\nFour."
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""
    plain = "<div><p>" + "a long passage of content here " * 9 + "</p><p>short</p></div><table><tr><td><a>x</a><a>y</a></td></tr></table>"
    assert main_text(plain).split("\n")[1] == "short"
    assert len(main_text("<p>" + "w " * 50_000)) == 99_999
    rows = extract(spark.createDataFrame([(1, None, "t"), (2, PAGE, "t")], "id int, html string, text string"), "html")
    assert rows.columns == ["id", "text"] and sorted(map(tuple, rows.collect()))[0] == (1, "")
    assert extract(spark.createDataFrame([], "id int, html string"), "html").count() == 0


def test_pages_in_wrappers():
    article = "<nav>Home</nav><article><h1>Title</h1><p>" + "a long passage of content here " * 9 + "</p></article>"
    text = main_text(f"<body>{article}</body>")
    assert text.startswith("Title\na long passage")
    for name in ("layout has-sidebar", "no-sidebar", "share-enabled", "search-results"):
        assert main_text(f"<body><div class='{name}'>{article}<div class=sidebar>Other</div></div></body>") == text
    form = "<form action=x><input type=hidden><select><option>no</select><button>Go</button>{}</form>"
    assert main_text("<body>" + form.format(article) + "<footer>f</footer></body>") == text
    assert main_text("<body>" + form.format(f"<div id='no-comments' class='has-nav'>{article}</div>") + "</body>") == text
    plain = article.replace("article>", "div>")
    assert main_text("<body>" + form.format(plain) + "<p>x</p></body>").startswith(text)
    teaser = "<article><p>" + "other " * 20 + "</p></article>"
    for other in (f"<div class='related-posts'>{teaser}</div>", f"<aside>{teaser * 9}</aside>", f"<div class=sidebar>{teaser * 9}</div>"):
        assert main_text(f"<body>{article}{other}</body>") == text
        assert main_text(f"<body><div class='has-sidebar'>{article}{other}</div></body>") == text
    assert main_text(f"<body><div class='post-page'><p>{'mine ' * 9}</p><section id=comments>{teaser * 9}</section></div></body>") == ("mine " * 9).strip()


def longest_match(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(best[j] + (x == y), best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_licenses(spark, sf_dir):
    scan = Scanner(TEMPLATES).scan
    assert scan(None) == scan("") == scan("nothing of the kind") == []
    text = "Ab cd.\nLicensed under CC BY-NC 4.0.\nEf. " + "word " * 20_000 + "Released under the MIT License. All rights reserved."
    found = scan(text)
    assert [h[0] for h in found] == ["CC-BY-NC-4.0-notice", "MIT-notice", "all-rights-reserved"]
    assert text[found[0][2] : found[0][3]] == "Licensed under CC BY-NC 4.0"
    assert [h[0] for h in scan(TEMPLATES["Apache-2.0-header"].replace("obtain", "get"))] == ["Apache-2.0-header"]
    assert len(scan("All rights reserved.\n" * 5)) == 5
    random = np.random.default_rng(4)
    for _ in range(300):
        b = list(dict.fromkeys(random.choice(list("abcdefghijkl"), 12).tolist()))
        a = random.choice(list("abcdefghijkl"), 10).tolist()
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert len({j for _, j in pairs}) == len(pairs) <= longest_match(a, b)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in registry.QUERIES["op10_license_scan"](spark, sf_dir).collect():
        words = words_of(docs[row["doc_id"]] or "")
        brute = any(
            longest_match(words[i : i + len(t)], t) >= 0.8 * len(t)
            for t in map(words_of, TEMPLATES.values())
            for i, w in enumerate(words)
            if w == t[0]
        )
        assert brute <= (row["n_notices"] > 0)


def test_licenses_by_name_and_with_words_between():
    names = lambda text: [h[0] for h in Scanner(TEMPLATES).scan(text)]
    assert [names(text) for text in TEMPLATES.values()] == [[name] for name in TEMPLATES]
    assert names("It was released under the old license of the town") == []
    assert names("Released under the BSD License") == ["BSD-notice"]
    assert names("This work is licensed under the GNU General Public License, version 2") == ["GPL-2.0-notice"]
    assert names("This work is licensed under a Creative Commons Attribution 3.0 International License") == ["CC-BY-3.0-work"]
    assert names("Licensed under CC BY-SA 4.0") == ["CC-BY-SA-4.0-notice"]
    assert names("So: All rights are hereby reserved.") == ["all-rights-reserved"]
    assert names("Released under the terms of the MIT License.") == ["MIT-notice"]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (None, 3)]
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(rows) == 41 + 100
    assert {r["id"]: r["component"] for r in rows} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 200), 100)}


def test_alignment_is_the_longest_match_in_the_band():
    random = np.random.default_rng(6)
    for _ in range(500):
        a = random.integers(0, 30, random.integers(1, 40)).tolist()
        b = [x for x in a if random.random() > 0.1]
        b.insert(random.integers(0, len(b) + 1), 99)
        want = longest_match(a, b)
        got = alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        if 2 * want >= 0.8 * (len(a) + len(b)):
            assert got == want
        else:
            assert 2 * got < 0.8 * (len(a) + len(b))


def test_near_texts_against_all_pairs(spark, edges, nothing, sf_dir):
    found = {r["doc_id"]: r["class_id"] for r in near_texts(edges, "doc_id", "text").collect()}
    assert found[3] == found[4] == 3 and found[1] == 1 and found[2] == 2 and found[6] == 6 and found[None] is None
    assert near_texts(nothing, "doc_id", "text").count() == 0
    random = np.random.default_rng(8)
    word = lambda: "".join(random.choice(list("abcdefgh"), 5))
    base = [word() for _ in range(150)]
    texts = [" ".join(word() for _ in range(150)) for _ in range(30)]
    for _ in range(60):  # one large group of near copies
        copy = list(base)
        copy[random.integers(0, 150)] = word()
        texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(20))  # common to unlike texts
    texts += [passage + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    classes = {r["doc_id"]: r["class_id"] for r in near_texts(docs, "doc_id", "text").collect()}
    numbers = _Words()
    kmers = [shingles(word_numbers(t, numbers)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 2 * longest_match(kmers[i].tolist(), kmers[j].tolist()) >= 0.8 * (len(kmers[i]) + len(kmers[j])) if len(set(kmers[i]) & set(kmers[j])) > 20 else False:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert classes == {i: root(i) for i in range(len(texts))}


def test_repeated_ids_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (3, b)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, mark string, rep string")
    found = {(r["doc_id"], r["class_id"], r["kept"]) for r in near_texts(docs, "doc_id", "text").collect()}
    assert found == {(1, 1, True), (2, 1, False), (3, 1, False)}  # two groups, both named by document 1
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, a), (1, b), (4, b + " x y z"), (None, a), (None, None), (None, None), (9, ""), (9, ""), (1, a), (None, "c d"), (None, "C d!")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], schema)
    kept = sorted(((r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert [k for k in kept if k[1].lower() != "c d" and k[1] != "C d!"] == [(0, ""), (0, ""), (1, a), (1, b), (9, ""), (9, "")]
    assert len(kept) == 7


def test_rest_of_large_buckets_is_searched_exactly(spark):
    random = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(40):  # a third to nearly all of a text is the passage; some are near to others, some repeat words
        own = [f"w{random.integers(0, 400)}" for _ in range(random.integers(4, 90))]
        texts += [passage + own, passage + own[:-2] + ["x", "x", "x"], own + own[: random.integers(0, 9)] + passage]
    texts += [["a"], ["a", "b"], ["a"] * 90, ["a"] * 100]
    numbers = _Words()
    words = [word_numbers(" ".join(t), numbers) for t in texts]
    groups = {i: i - i % 3 for i in range(0, 120, 3) for i in (i, i + 1)}  # the third of each is in no group yet
    group = lambda i: groups.get(i, i)
    crowded = spark.createDataFrame([(i, 7) for i in range(len(texts))] + [(0, 9), (1, 9)], "rep bigint, bucket bigint")
    known = spark.createDataFrame(list(groups.items()), "id bigint, component bigint")
    numbered = spark.createDataFrame([(i, bytes(w.tobytes())) for i, w in enumerate(words)], "id bigint, words binary")
    early = rare_shingles(crossing_shingles(crowded, known, numbered), known)
    found = {(r["a"], r["b"]) for r in pairs_apart(early).collect()}
    near = {(i, j) for j in range(len(texts)) for i in range(j) if similarity(words[i], words[j]) >= SIMILAR - 1e-9}
    apart = {(i, j) for i, j in near if group(i) != group(j)}
    assert apart and apart < near and apart <= found
    assert all(group(i) != group(j) and i < j for i, j in found) and len(found) < len(texts) ** 2 / 4


def test_near_vectors_against_all_pairs(spark):
    random = np.random.default_rng(9)
    vectors = random.normal(size=(120, 24))
    near = vectors[0] + 0.02 * random.normal(size=(80, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([vectors, near, near[:5], 2 * near[:1]]).astype(np.float32))]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None]), (904, []), (905, [1.0, 2.0])]
    found = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, v array<float>"), "vec_id", "v").collect()}
    assert len(found) == len(rows)
    good = np.array([v for i, v in rows if i < 900])
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    hits = unit @ unit.T >= 0.9
    for i in range(len(good)):
        assert found[i]["n_links"] == hits[i].sum() - 1
        assert found[i]["component_id"] == (120 if i >= 120 and not hits[i, 0] else found[i]["component_id"])
        assert found[i]["kept"] == (found[i]["component_id"] == i)
    for i in range(900, 906):
        assert tuple(found[i]) == (i, 0, i, True)
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, v array<float>"), "vec_id", "v").count() == 0


def test_top_k_against_all_rows(spark):
    random = np.random.default_rng(10)
    vectors = np.concatenate([random.normal(size=(300, 16)), np.ones((40, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (950, [float("inf")] * 16), (1000, [1.0, None])]
    found = top_k(spark.createDataFrame(rows, "vec_id bigint, v array<float>"), "vec_id", "v", F.col("id") % 20 == 0).collect()
    whole = np.floor(256 * vectors.astype(float)).astype(int)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {}
    for q in range(0, len(vectors), 20):
        scores = whole @ whole[q]
        order = [int(i) for i in np.lexsort((np.arange(len(scores)), -scores)) if i != q][:5]
        want[q] = [(i, int(scores[i])) for i in order]
    assert got == want
    empty = spark.createDataFrame([], "vec_id bigint, v array<float>")
    assert top_k(empty, "vec_id", "v", F.col("id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, edges, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    assert corpus_pipeline.language(spark, edges, sf_dir).where("doc_id in (1, 2, 6)").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, edges, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    clean = corpus_pipeline.personal_data(spark, edges, sf_dir)
    assert {r["doc_id"]: r["n_chars"] for r in clean.collect()}[7] == 60_000 + len(" mail <EMAIL> now")
    assert before == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_rows(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= ids and all(r["n_tokens"] > 0 for r in rows)
