"""Decontamination, language model, main text, toxicity, tokens and packing."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenhand.llm import gru
from evenhand.llm.common import crc_remainder, lower_words
from evenhand.llm.decontam import contamination
from evenhand.llm.html import main_text, trained
from evenhand.llm.lm import END, frequent_words, likelihoods
from evenhand.llm.packing import CAPACITY, first_fit_decreasing, pack
from evenhand.llm.queries import QUERIES, vocabulary
from evenhand.llm.tokens import PieceCache, count_tokens
from evenhand.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def whole(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def test_decontamination_by_brute_force(spark, documents, whole):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(900, "of the"), (901, " ".join(whole[0].split()[3:12]))], "item_id bigint, text string")
    items = items.select("item_id", "text").union(short)
    windows: dict[tuple, set] = {}
    for item in items.collect():
        words = lower_words(item.text.encode())
        for at in range(max(1, len(words) - 12)):
            windows.setdefault(tuple(words[at : at + 13]), set()).add(str(item.item_id))
    sizes = {len(window) for window in windows}
    expected = {}
    for key, text in whole.items():
        words, hit, found = lower_words(text.encode()), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if items_there := windows.get(tuple(words[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= items_there
        expected[key] = (len(words), len(hit), sorted(found))
    got = contamination(documents, items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in got} == expected
    assert any(n for _, n, _ in expected.values())


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma of the")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "gamma x beta y alpha"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "the of the the of of")],
        "doc_id bigint, text string",
    )
    found = {r.doc_id: [tuple(x) for x in r.near] for r in contamination(docs, items).collect()}
    assert found == {1: [("1", 0, 5)], 2: [], 3: []}


def test_edited_copies_of_benchmark_items_are_near(spark):
    """With every 13th word changed no window is whole, but most items are found, and where they stand."""
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, lower_words((r.text or "").encode())) for r in benchmark.collect()]
    edited = [
        (10**6 + at, "start " + " ".join("changed" if i % 13 == at % 13 else w.decode() for i, w in enumerate(words)))
        for at, (_, words) in enumerate(items)
    ]
    copies = [(2 * 10**6 + at, b" ".join(words).decode()) for at, (_, words) in enumerate(items)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(edited + copies, docs.schema))
    rows = {r.doc_id: r for r in contamination(docs, benchmark).collect()}
    for first, least in ((10**6, 0.9), (2 * 10**6, 1.0)):
        hits = 0
        for at, (item, words) in enumerate(items):
            places = [x for x in rows[first + at].near if x.item == str(item)]
            hits += bool(places)
            assert all(0 <= x.start < x.end <= len(words) + 1 for x in places)
        assert hits >= least * len(items)


def test_gradients():
    layout = gru.Layout.of(100, 3)
    rng = np.random.default_rng(0)
    w = {name: value + 0.3 * rng.standard_normal(value.shape) for name, value in gru.initial(layout).items()}
    laid = gru.laid_out([rng.integers(0, 103, n).astype(np.int32) for n in (7, 12, 3, 9)], 2, 0)

    def likelihood() -> float:
        _, run = gru.forward(w, np.zeros((gru.STATE, 2)), laid.inputs, laid.starts)
        found = gru.log_probabilities(w, gru.in_line(run.states), laid.targets.ravel(), layout)
        return (found * laid.used.ravel()).sum() / laid.used.sum()

    _, run = gru.forward(w, np.zeros((gru.STATE, 2)), laid.inputs, laid.starts)
    found = gru.gradients(w, run, laid.inputs, laid.targets, laid.starts, laid.used, layout)
    for name, value in w.items():
        largest = np.unravel_index(np.abs(found[name]).argmax(), value.shape)
        kept = value[largest]
        sides = []
        for step in (1e-4, -1e-4):
            value[largest] = kept + step
            sides.append(likelihood())
        value[largest] = kept
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(found[name][largest], rel=1e-4), name


def test_state_does_not_depend_on_lanes():
    layout = gru.Layout.of(50, 2)
    w = gru.initial(layout)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 52, n).astype(np.int32) for n in rng.integers(1, 300, 40)]
    together = gru.score(w, texts, layout)
    assert np.allclose(together, [gru.score(w, [text], layout)[0] for text in texts], rtol=1e-4)


def test_language_model(documents, whole):
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    found = {r.doc_id: r for r in likelihoods(documents, ~held_out).collect()}
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = {k: [*text.encode().translate(fold).split(), None] for k, text in whole.items()}
    counts: Counter = Counter()
    for key, words in tokens.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(words)
    total = counts.total()
    for key, words in tokens.items():
        base = sum(math.log10((counts[word] + 1) / (total + len(counts) + 1)) for word in words)
        row = found[key]
        assert (row.n_tokens, row.train_tokens) == (len(words), total)
        assert row.n_known == sum(counts[word] > 0 for word in words)
        assert row.base_score == pytest.approx(base, rel=1e-9)
    scores = np.array([[r.base_score, r.score] for r in found.values()])
    assert np.isfinite(scores).all() and scores[:, 1].sum() > scores[:, 0].sum()


def test_head_follows_the_vocabulary(spark):
    assert gru.STATE >= 16 and gru.HEAD >= 2048
    for n_words, count, head in ((3000, gru.LEARNT, 3001), (3000, 2, gru.HEAD), (500, 2, 501), (9000, 90, gru.MOST_HEAD)):
        rows = [(f"w{k}".encode(), count) for k in range(n_words)]
        counts = spark.createDataFrame([(END, 7), *rows, (b"once", 1)], "word binary, c bigint")
        table = frequent_words(counts)
        assert (table.head, len(table.counts), table.counts[0]) == (head, n_words + 1, 7)
        assert (table.targets() < table.head).sum() == head


PAGE = """<html><body><header><a href=/>Home</a><h2>My site</h2></header>
<div class="cookie-notice">We use cookies to give you a good time on this site and others, do you accept it?</div>
<!-- <p>no</p> --><div id=main-content><h1>Title here</h1><p>First &eacute;&nbsp; x <a href="a>b">link</a> more
 words.<p>Short.</p><script>var t="</p>";</script><div class="ad-slot"><p>Buy now this great thing.</p></div>
<form><p>Your name</p></form><ul><li><a>One</a></li><li><a>Two</a></li></ul><p>Last words of it</p>
<section class="comments"><p>I like this article a lot, and I have much to say about all of it.</p></section></div>
<aside><p>Side note of some words that are long enough to be a paragraph in itself.</p></aside><footer>&copy; me"""


def test_main_text():
    assert main_text(PAGE, trained())[0] == ["Title here", "First é x link more words.", "Short.", "Last words of it"]
    assert main_text("<p", trained())[0] == main_text("", trained())[0] == []
    assert len(main_text("<div>" * 50_000 + '<a "' * 2000, trained())[0]) <= 1


REST = "<p>The rest of the article has some more words to read.</p>"
BEFORE = "<p>Many words stand at the start of it, and here is an element: %s after.</p>"
ELEMENTS = {
    '<svg class="i"/>': "after.",
    "<svg><title>x</title><text>no</text></svg>": "after.",
    "<math/>": "after.",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>": "x=2 after.",
    "<button>no": "",
    "<button>no<button>no</button>": "after.",
    "<select><option>no": "",
    "<select><option>no</option></select>": "after.",
    "<object>no": "",
    "<object><object>no</object>no</object>": "after.",
    "<video src=x>no": "",
    "<audio/>": "after.",
    "<canvas>no</canvas>": "after.",
    "<script>var t = '</p><p>no</p>'</script>": "after.",
}


def test_text_after_elements_without_text():
    for element, after in ELEMENTS.items():
        page = f"<article>{BEFORE % element}{REST}<div>{REST}</div>"
        first = f"Many words stand at the start of it, and here is an element: {after}".strip()
        assert main_text(page, trained())[0] == [first, REST[3:-4], REST[3:-4]], element
    no = "<p>Your browser does not show this, which is no text of the page.</p>"
    for name in ("video", "object", "template"):
        assert main_text(f"<article>{REST}<{name}><div>{no}</{name}>{REST}", trained())[0] == [REST[3:-4]] * 2
        # Never closed in its parent: another one's end takes nothing away.
        page = f"<article><div><{name}>{REST}</div>{REST}<{name}>{no}</{name}></{name}>{REST}"
        assert main_text(page, trained())[0] == [REST[3:-4]] * 3


PARAGRAPH = "The article says in many words what happened on that day in town and why it did."
WRAPPERS = ['div class="layout has-sidebar"', 'div class="post no-comments"', 'div id="page" class="with-banner"',
            'section class="related-work"', 'div class="single search-disabled"', 'main class="content nav-open"']


def test_names_that_only_mention_furniture_lose_no_article():
    for wrapper in WRAPPERS:
        page = f"<body><{wrapper}><article><h1>A fine headline</h1><p>{PARAGRAPH}</p>{REST}</article></{wrapper.split()[0]}>"
        assert main_text(page, trained())[0] == ["A fine headline", PARAGRAPH, REST[3:-4]], wrapper
    page = f"<article><div class='entry-header'><h1>A fine headline</h1></div><p>{PARAGRAPH}</p>{REST}</article>"
    assert main_text(page, trained())[0] == ["A fine headline", PARAGRAPH, REST[3:-4]]


def test_furniture_by_name_stays_out():
    for name in ("sidebar", "right-sidebar", "ad", "ad1", "ad-slot", "top_nav", "cookie-consent", "post-comments", "site-footer",
                 "newsletter", "related", "share-bar", "site-header", "comment-list"):
        page = f"<article><p>{PARAGRAPH}</p>{REST}<div class='{name}'><p>{PARAGRAPH} Not this.</p></div></article>"
        assert main_text(page, trained())[0] == [PARAGRAPH, REST[3:-4]], name


def test_main_text_of_pages(spark):
    for row in QUERIES["op6_main_text"](spark, SF).limit(20).collect():
        assert row.n_chars == len(row.text) > 0
        assert "track(" not in row.text and "©" not in row.text


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    rng = np.random.default_rng(3)
    for key in range(600):
        words = [f"w{i}" for i in rng.integers(0, 300, 60)]
        toxic = key % 5 == 0
        if toxic:
            words[int(rng.integers(0, 60))] = ["vile", "nasty", "rotten"][key % 3]
        rows.append((key, " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))))
        labels.append((key, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:400], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity(docs, known).collect()}
    right = [(found[key].score >= 0.7) == bool(toxic) for key, toxic in labels[400:]]
    assert np.mean(right) > 0.97
    for key, text in rows:
        for place in found[key].offending:
            assert any(word in text[place.start : place.end] for word in ("vile", "nasty", "rotten"))


def test_tokens_of_pieces():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = PieceCache(vocabulary(), as_bytes=True)
    for text in (
        "Don't 's ''s o'clock A1b2 é! ß÷ İx Ünï á b \x1c x\x1cy 'RE 'Tis <|endoftext|>foo bar<|startoftext|>",
        "word, Word. WORD%%% x-y_z 12.5% naïve-café 漢字 😀😀 a b   <| |> ½²",
        "",
    ):
        ids = np.frombuffer(b"".join(map(cache.__getitem__, text.encode().split())), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_and_packing(documents, whole):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for k, text in whole.items()}
    counts = count_tokens(documents, vocabulary()).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens + 1) for r in counts} == {
        k: (len(whole[k].encode()), len(x)) for k, x in ids.items()
    }
    pieces = pack(documents, vocabulary(), group_pieces=50).collect()
    covered: Counter = Counter()
    bins: dict[int, list] = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        covered.update((p.doc_id, at) for at in range(p.start, p.start + p.length))
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))
    for parts in bins.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= CAPACITY


def test_first_fit_decreasing():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 200):
        lengths = rng.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(lengths, 100)
        free: list[int] = []
        for at in np.argsort(-lengths, kind="stable"):
            fit = next((i for i, space in enumerate(free) if space >= lengths[at]), len(free))
            free += [100] * (fit == len(free))
            assert (bins[at], offsets[at]) == (fit, 100 - free[fit])
            free[fit] -= lengths[at]


def test_digest_of_no_items(spark):
    row = QUERIES["op3_decontamination"](spark, SF).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
