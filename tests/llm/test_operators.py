"""Each operator against brute force, a round trip, held-out accuracy or SQL, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from answerloom.llm import (
    chat_format, decontaminate, exact_dedup, html_extract, language_id, lm_score, near_dedup, packing, toxicity, url_filter,
)
from answerloom.llm.catalogue import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, None), (4, "word " * 30_000, "en", "a", 1), (5, "same text here", "en", "a", 1),
    (5, "same text here", "en", "a", 1), (6, "same  text here ", "fr", "b", 2), (None, "no id at all", None, "b", 3), (7, "1 2 3 !!", "de", "b", 3),
    (8, "<|endoftext|> \x1c Σ İ ́ 🙂   a", None, "c", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ODD], DOCS + ", tokens int, id int, score int, seed int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(CHECKS[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_url_filter", "op6_exact_dedup"])
def test_queries_match_sql(spark, name):
    same_as_sql(spark, name)


# chat formatting


def test_chat_fold_and_round_trip(spark):
    tricky = r"a <s> \<s> <\s> [INST] [\\/INST] <<SYS>> << <</ROLE>> \ end <"
    events = [
        (1, 1, 0, "message", "user", tricky), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 2, "message", "user", "x"),
        (1, 5, 1, "regenerate", "assistant", "Bye"), (1, 6, 1, "delta", "assistant", "!"), (1, 7, 0, "edit", "user", tricky + "2"),
        (2, 1, 0, None, "critic>>", None), (2, 2, 1, "message", None, "t"), (3, 1, 0, "message", "assistant", ""),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    done = chat_format.format_conversations(log)
    rows = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat_format.read_back(done["formatted"]).alias("t"), chat_format.loss_text(done["pieces"]).alias("l")).collect()}
    assert [tuple(t) for t in rows[1]["t"]] == [("user", tricky + "2"), ("assistant", "Bye!")]
    assert rows[1]["l"] == "Bye!"
    assert [tuple(t) for t in rows[2]["t"]] == [("critic>>", ""), ("", "t")]
    assert [tuple(t) for t in rows[3]["t"]] == [("assistant", "")] and rows[3]["l"] == ""
    assert chat_format.format_conversations(log.limit(0)).count() == 0


# HTML extraction

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">Cookies, really.</div>
<main><article><h1>Title &amp; more</h1><p>First <a href=y>link</a> para.<p>Second&nbsp;para &#x41;<br>line two.</p><ul><li>one<li>two</ul>
<form><p>Subscribe now, please.</p></form><div class="ad">Buy, buy!</div></article><aside><p>Side text, long enough to be considered.</p></aside>
<section class="comments"><article class="comment"><p>Great post, thanks.</p></article></section></main><footer>&copy; foot</footer><script>if (a<b) {"</p>"}</script></body></html>"""


def test_html_cases():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst link para.\nSecond para A line two.\none\ntwo"
    for page, text in (("", ""), ("plain", "plain"), ("<p>a<!-- x", "a"), ("<script>x", ""), ("<p hidden>x</p><p>y, z.</p>", "y, z."), ("<b" * 3000, "")):
        assert html_extract.main_text(page) == text
    plain = '<body><div id="menu"><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></div><div id="text"><p>Long text, with signs; it goes on and on.</p><p>More of it, too.</p></div></body>'
    assert html_extract.main_text(plain) == "Long text, with signs; it goes on and on.\nMore of it, too."


def test_html_ratios_decide():
    body = [f"Sentence number {k}, with a clause; it goes on for a while, and then it ends." for k in range(6)]
    inside = "".join(f"<p>{b}</p>" for b in body)
    links = "".join(f"<li><a href={k}>Another story {k}</a></li>" for k in range(8))
    # a list of links below the article landmark has no class that tells
    assert html_extract.main_text(f"<main><article><h1>Title</h1>{inside}<section><ul>{links}</ul></section></article></main>") == "\n".join(["Title", *body])
    # the body is in plain divs, the articles are a few words each
    cards = "".join(f"<article><h3><a href={k}>Story {k}</a></h3><p>In short.</p></article>" for k in range(3))
    assert html_extract.main_text(f"<body><div><div>{inside}</div></div><div>{cards}</div></body>") == "\n".join(body)
    # text outside an article that holds the page's text stays out
    assert html_extract.main_text(f"<body><div><p>{body[0]}</p></div><article>{inside}</article></body>") == "\n".join(body)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (2, None, PAGE, 6), (None, "v", "", 7)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(html_extract.main_text(PAGE)))]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_articles_of_the_tables(spark):
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)


# URL filters


def test_url_filter_cases(spark):
    day = __import__("datetime").date
    marks = [
        ("l", "block", "b.org", "add", day(2024, 1, 10), 1), ("l", "block", "b.org", "remove", day(2024, 2, 10), 2), ("l", "block", "b.org", "add", day(2024, 2, 10), 3),
        ("l", "block", "b.org", "remove", day(2024, 3, 1), 4), ("t", "allow", "a.b.org/x", "add", day(2024, 1, 1), 1), ("l", None, None, "add", None, 1),
    ]
    entries = spark.createDataFrame(marks, "list_name string, verdict string, key string, action string, effective date, seq int")
    asked = [
        (1, "http://a.b.org/y", day(2024, 1, 9)), (2, "http://a.b.org/y", day(2024, 1, 10)), (3, "https://u@A.B.org.:80/x/z?q", day(2024, 2, 20)),
        (4, "http://a.b.org", day(2024, 2, 29)), (5, "http://a.b.org", day(2024, 3, 1)), (6, None, day(2024, 2, 1)), (7, "http://b.org", None), (2, "http://a.b.org/y", day(2024, 1, 10)),
    ]
    captures = spark.createDataFrame([(*a, 9) for a in asked], "id long, url string, fetched date, cell int")
    got = sorted((r["id"], r["verdict"], r["matched_key"]) for r in url_filter.evaluate(captures.drop("cell"), entries).collect())
    assert got == [(1, "none", None), (2, "block", "b.org"), (2, "block", "b.org"), (3, "allow", "a.b.org/x"), (4, "block", "b.org"), (5, "none", None), (6, "none", None), (7, "none", None)]
    assert url_filter.evaluate(captures.drop("cell").limit(0), entries).count() == 0
    assert url_filter.evaluate(captures.drop("cell"), entries.limit(0)).filter("verdict <> 'none'").count() == 0


# language-model scores


def test_lm_gradients_and_total():
    rng = np.random.default_rng(0)
    n, classes = rng.integers(1, 100, lm_score.IDS), rng.integers(0, lm_score.CLASSES, lm_score.IDS)
    w = {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in lm_score.initial_weights(n, classes).items()}
    sizes = np.array([5, 0, 40, 19])
    ids = rng.integers(0, lm_score.CLASSES, sizes.sum())
    b = lm_score.lay_out(ids, sizes, 3)
    loss, slope = lm_score.gradients(w, b)
    assert math.isclose(loss, -lm_score.log_probabilities(w, b).mean(), rel_tol=1e-9)
    for k, i in (("key", (ids[5], 2)), ("query", (ids[12], 2)), ("value", (ids[6], 1)), ("place", (30,)), ("sink_value", (3,)), ("out", (2, ids[9])), ("after", (ids[6], ids[7]))):
        was, step = w[k][i], 1e-5
        w[k][i] = was + step
        high = lm_score.gradients(w, b)[0]
        w[k][i] = was - step
        low = lm_score.gradients(w, b)[0]
        w[k][i] = was
        assert math.isclose((high - low) / 2 / step, slope[k][i], rel_tol=1e-3, abs_tol=1e-8)
    total = 0.0
    for c in range(lm_score.CLASSES):
        ids[20] = c
        total += np.exp(lm_score.log_probabilities(w, lm_score.lay_out(ids, sizes, 3))[20])
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_lm_query_base_and_held_out(spark):
    big = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    counts = collections.Counter(w for d, t in texts.items() if not held[d] for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op4_lm_score"](spark, big).collect()
    assert len(got) == len(texts)
    for r in got:
        own = [*split(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0


def test_lm_windows_score_each_id_once(monkeypatch):
    rng = np.random.default_rng(1)
    classes = rng.integers(0, lm_score.CLASSES, lm_score.IDS)
    w = lm_score.initial_weights(np.ones(lm_score.IDS), classes)
    w["out"] = rng.standard_normal(w["out"].shape).astype(np.float32)
    model = lm_score.LanguageModel(classes, np.zeros(lm_score.IDS), np.zeros(lm_score.CLASSES), w, 1, 1)
    sizes = np.array([3, 700, 1, 90])
    ids = rng.integers(0, lm_score.IDS, sizes.sum())
    whole = lm_score._class_scores(model, ids, sizes)
    monkeypatch.setattr(lm_score, "SLICE", 8)
    # a piece that begins inside a text sees its context, though no id before that
    assert np.allclose(lm_score._class_scores(model, ids, sizes), whole, atol=1e-4)


def test_lm_trains_on_every_id(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([5, 0, 5000, 2048, 1, 700])
    ids = rng.integers(0, lm_score.CLASSES, sizes.sum())
    whole = lm_score.lay_out(ids, sizes, 3)
    parts = list(lm_score._steps(ids, sizes, 3))
    assert max(len(p.now) for p in parts) <= lm_score.STEP_IDS
    for name in ("now", "before", "last"):
        assert (np.concatenate([getattr(p, name) for p in parts]) == getattr(whole, name)).all()
    seen = np.concatenate([np.where(p.outside, -1, p.window)[p.block] for p in parts])
    assert (seen == np.where(whole.outside, -1, whole.window)[whole.block]).all()
    # the weight of each task's model in the average is the number of ids it was trained on
    trained = []
    monkeypatch.setattr(lm_score, "_average", lambda rows, like: trained.append(sum(r["n"] for r in rows.collect())) or like)
    texts = ["a few words", None, "word and word " * 900]
    model = lm_score.LanguageModel(np.zeros(lm_score.IDS, np.int64), np.zeros(lm_score.IDS), np.zeros(lm_score.CLASSES), lm_score.initial_weights(np.ones(lm_score.IDS), np.zeros(lm_score.IDS, np.int64)), 1, 1)
    lm_score.train(spark.createDataFrame([(t,) for t in texts], "text string"), model, rounds=1)
    assert trained == [sum(len(i) for t in texts for i in lm_score.subwords([*(t or "").encode().split(), b""]))]


def test_lm_odd(spark, odd, none):
    counts = lm_score.stored(lm_score.word_counts(none))
    model = lm_score.learn(none, counts)
    got = lm_score.score(odd, counts, model).collect()
    assert len(got) == len(ODD) and all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score(none, counts, model).count() == 0


# decontamination


def test_decontamination_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: split(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = " ".join(split(r["text"]))
        want |= {(r["doc_id"], i) for i, t in items.items() if f" {' '.join(t)} " in f" {own} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert want and got == want


def test_decontamination_substitutions_and_odd(spark, odd, none):
    item = [f"w{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (1, " ".join(item))], "item_id long, text string")
    changed = [w if k % 7 else "other" for k, w in enumerate(item)]
    broken = [w if k % 3 else "other" for k, w in enumerate(item)]
    rows = [(10, "before " + " ".join(changed)), (11, " ".join(broken)), (12, None), (13, " ".join(item[:9])), (14, " ".join(item).upper()), (14, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.overlaps(docs, bench).collect()} == {10, 14}
    assert decontaminate.overlaps(odd, bench).count() == 0 and decontaminate.overlaps(none, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [11, 12, 13]


def test_decontamination_masks_are_complete():
    for length in range(1, decontaminate.WINDOW + 1):
        masks = decontaminate.MASKS if length >= decontaminate.LONG else decontaminate.short_masks(length)
        for changed in itertools.combinations(range(length), length - decontaminate.needed(length)):
            assert any(not {i + o for o in m} & set(changed) for m in masks for i in range(length - m[-1])), (length, changed)


def test_decontamination_finds_every_accepted_overlap(spark):
    items, rows = [], []
    for n in (1, 3, 6, 7, 8, 9, 10, 12, 13, 14):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        may = min(n, 13) - decontaminate.needed(min(n, 13))
        for changed in itertools.combinations(range(n), may):
            rows.append((len(rows), n, True, " ".join(["before", *("x" if k in changed else w for k, w in enumerate(words)), "after"])))
        if may:
            rows += [(len(rows), n, True, " ".join(words[may:])), (len(rows) + 1, n, True, " ".join(words[:-may]))]
        if n < 13:
            for changed in itertools.combinations(range(n), may + 1):
                rows.append((len(rows), n, False, " ".join("x" if k in changed else w for k, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, n long, hit boolean, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {r[:2] for r in rows if r[2]}


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 600)
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect())) == one


# exact duplicates


@pytest.mark.parametrize("heavy", [1, 1000])
def test_exact_dedup(spark, odd, none, heavy):
    got = [tuple(r) for r in exact_dedup.decide(odd, heavy=heavy).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert len(got) == len(ODD)
    assert {g[1:3] for g in got if g[0] in (1, 2, 3)} == {(3, 3)}
    assert {g[1:3] for g in got if g[0] in (5, 6)} == {(6, 3)}
    assert sum(g[3] for g in got) == len({re.sub(r"[\x20\x09-\x0D]", "", t[1] or "") for t in ODD})
    kept = exact_dedup.keep_one(odd, heavy=heavy)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 6, 7, 8]
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


# toxicity


def test_deobfuscation(docs):
    restorer = toxicity.Deobfuscator.learn(docs)
    for disguised, word in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("tr@sh!!!", "trash"), ("s.c.u.m", "scum")):
        assert word in restorer.restore(disguised), disguised
    assert restorer.restore("ordinary,") == ["ordinary"] and restorer.restore("2024-01-01") == [] and restorer.restore("") == []
    assert toxicity.spaced_out("you s t u p i d man".split()) == ["stupid"]


def test_spaced_runs_hold_several_words(spark, docs):
    restorer = toxicity.Deobfuscator.learn(docs)
    for run, words in (("astupid", ["a", "stupid"]), ("youidiot", ["you", "idiot"]), ("y0u1d10t", ["you", "idiot"]), ("stupid", ["stupid"]), ("stupidmoron", ["stupid", "moron"])):
        assert words in restorer.restore_run(run), run
    train = spark.createDataFrame([(k, "you are a moron and stupid" if k % 2 else "you are a kind and gentle person here") for k in range(60)], "doc_id long, text string")
    model = toxicity.learn(train, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    texts = ["what a s t u p i d man", "y o u m o r o n", "s t u p i d m o r o n", "you k i n d", "a g e n t l e person"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r["doc_id"]: r["_toxic_score"] for r in toxicity.score(asked, model).collect()}
    assert [score[k] > 0.7 for k in range(5)] == [True, True, True, False, False]


def test_toxicity_held_out(spark, odd, none):
    big = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, big).filter("held_out").collect()
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert sum(p for p, t in known if t) >= 0.7 * sum(t for _, t in known) and not sum(p for p, t in known if not t)
    empty = toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    done = toxicity.score(odd, empty)
    assert done.columns == [*odd.columns, "_toxic_score"] and {r["_toxic_score"] for r in done.collect()} == {0.0}
    words = "you are a moron and worthless"
    train = spark.createDataFrame([(k, words if k % 2 else "a kind and gentle person here") for k in range(60)], "doc_id long, text string")
    model = toxicity.learn(train, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    asked = spark.createDataFrame([(1, "M0R0N indeed"), (2, "w o r t h l e s s"), (3, None), (4, "gentle")], "doc_id long, text string")
    score = {r["doc_id"]: r["_toxic_score"] for r in toxicity.score(asked, model).collect()}
    assert score[1] > 0.7 and score[2] > 0.7 and score[3] < 0.5 and score[4] < 0.5


# language identification


def test_language_held_out_and_odd(spark, odd, none):
    big = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, big).filter("held_out").collect()
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    model = language_id.learn(spark.createDataFrame([(1, "the house and the garden", "en"), (2, "la casa y el jardín", "es"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["en", "es"]
    asked = spark.createDataFrame([(1, "the gardens"), (2, "jardines y casas"), (3, None), (4, "12 !!"), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(asked, model).collect()} == {1: "en", 2: "es", 3: "und", 4: "und", 5: "und"}
    assert len(language_id.predict(odd, model).collect()) == len(ODD)
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.learn(none)).collect()} == {"und"}


# near duplicates


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    shingle = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    text = np.repeat([0, 1], 60)
    s = near_dedup.signatures(2, text, np.tile(shingle, 2), np.concatenate([a, b]), 4096)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 0.04


def _classes(texts):
    split = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in texts.items()}
    bags = {d: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for d, w in split.items() if w}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = sum((bags[a] & bags[b]).values())
            if common >= 0.8 * (bags[a].total() + bags[b].total() - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_near_dedup_brute_force(spark, docs):
    want = _classes({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == want


def test_near_dedup_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_PAIRS", 4)
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for d in range(120):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            words[at] = f"x{d}_{at}"
        texts[d] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()} == _classes(texts)


def test_near_dedup_odd(spark, odd, none):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, None: None}
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(odd).columns == odd.columns


# packing


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.VOCABULARY)
    texts = collections.defaultdict(list)
    for r in ODD:
        texts[r[0]].append(r[1] or "")
    got = packing.pack(odd).collect()
    per_doc = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        ids = np.array([*whole.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids, packing.END], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        per_doc[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(per_doc[d] == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in own) for d, own in texts.items())
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack(none).count() == 0


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    histogram = collections.Counter(rng.integers(1, 257, 4000).tolist())
    held, used = collections.Counter(), 0
    for uses, bins, each in packing.plan_patterns(dict(histogram)):
        assert (bins * each).sum() <= 256
        used += uses
        for b, n in zip(bins.tolist(), each.tolist()):
            held[b] += uses * n
    assert held == histogram
    size = np.array(sorted(histogram))
    greedy = packing.first_fit(size, np.array([histogram[s] for s in size.tolist()]), 256)
    assert used <= sum(uses for uses, _ in greedy)


# pipeline


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    now, kept = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, SF))
        assert now.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "exact_dedup":
            digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
            assert len(left) == len({digest(t) for t in kept.values()}) == len({digest(t) for t in left.values()})
        if name == "near_dedup":
            assert set(left) == {d for d, c in _classes(kept).items() if d == c}
        kept = left
    got = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got)
