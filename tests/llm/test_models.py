"""Set join, pages, pieces, scores and the pipeline on small rows."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import jaccard_join
from trackweave.llm.attention import Attention
from trackweave.llm.html_extract import Page, main_text
from trackweave.llm.jaccard_join import jaccard_components, keep_one_of_each
from trackweave.llm.lm_scores import lm_scores
from trackweave.llm.quality_classifier import quality_scores
from trackweave.llm.queries import PIECE_MODEL, TOKENIZERS
from trackweave.llm.sentence_pieces import encode, encoded_documents
from trackweave.llm.toxicity import Evidence, toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(texts, size=3, percent=90):
    """Brute force: set sizes and the smallest reachable id of every row."""
    sets = []
    for _, text in texts:
        w = WORD.findall((text or "").lower())
        runs = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets.append(runs)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, left in enumerate(sets):
        for b in range(a):
            if left and sets[b] and 100 * len(left & sets[b]) >= percent * len(left | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 80)])
def test_jaccard_components(spark, seed, percent):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(8):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 9, 15, 40, 80]))]
        for _ in range(draw.choice([1, 4, 25])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 20))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append((len(texts), " ".join(copy)))
    texts += [(None, "w1 w2 w3 w4"), (900, "w1 w2 w3 w4"), (900, "w1 w2 w3 w4"), (901, None), (902, " \n"), (903, "Only Two"), (904, "only two")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_components(table, 3, percent).collect()), key=str)
    assert got == components(texts, 3, percent)


def test_keep_one_of_each(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same, 1), (2, same, 2), (3, "other", 3), (4, None, 4), (2, same, 5), (None, same, 6), (7, "x", 7), (7, "x", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = keep_one_of_each(table)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, None, 7])
    assert jaccard_components(table.limit(0)).count() == 0


def test_keep_one_of_each_judges_rows_not_ids(spark):
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(59)), "z"])
    lone = " ".join(f"v{i}" for i in range(60))
    rows = [(3, same), (5, near), (5, "quite another text"), (5, "one more of the same id"), (None, lone), (None, lone + " end"), (3, near)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, keep_one_of_each(table).collect()))
    assert kept == Counter([(3, same), (5, "quite another text"), (5, "one more of the same id"), (None, lone)])


@pytest.mark.parametrize("few", [True, False])
def test_blocks_of_checked_pairs_move_their_own_sets(spark, monkeypatch, few):
    sets = {n: list(range(n % 4, n % 4 + 10)) for n in range(40)}
    pairs = {(a, b) for a in (0, 1, 2, 39) for b in range(20, 40) if a != b}
    moved, checked = [], jaccard_join.confirmed

    def confirmed(part, left, right, percent):
        asked = {n for row in part.select("a", "b").collect() for n in row}
        moved.append(({r.node for r in left.collect()} | {r.node for r in right.collect()}, asked | {r.node for r in right.collect()}))
        return checked(part, left, right, percent)

    monkeypatch.setattr(jaccard_join, "confirmed", confirmed)
    if not few:
        monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = spark.createDataFrame([(a, b, True) for a, b in pairs], "a long, b long, several boolean")
    shingles = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    got = jaccard_join.checked_pairs(rows, shingles, 80, 3).collect()
    assert {(r.a, r.b) for r in got} == pairs and len(got) == len(pairs)
    for r in got:
        left, right = set(sets[r.a]), set(sets[r.b])
        assert r.linked == (100 * len(left & right) >= 80 * len(left | right)) and r.apart == len(left ^ right)
    assert len(moved) == 3 and all(found <= wanted for found, wanted in moved)
    assert jaccard_join.checked_pairs(rows.limit(0), shingles, 80, 3).count() == 0


def test_pages(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav>"
        "<div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p><b>One<br><p>Two\n  words<ul><li>a<li>b</ul>"
        "<div class='comments'><p>Nice!</div></article><footer>&copy; x</footer>"
    )
    rows = [(1, "http://a.b/c", page), (2, None, None), (3, "no url", "<p>x<div>y"), (3, "no url", "<p>x<div>y"), (4, "http://a.b/", "a<b")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: (r.text, r.n_chars) for r in main_text(table).collect()}
    text = "Head & line\nOne\nTwo words\na\nb"
    assert out == {1: (text, len(text)), 2: ("", 0), 3: ("x\ny", 3), 4: ("a", 1)}


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [
        (i, "http://host/x", f"<body><div class='box'>Same on all pages</div><div class='story'><p>Text {i} of its own</div></body>")
        for i in range(8)
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in main_text(table).collect()} == {f"Text {i} of its own" for i in range(8)}
    copies = table.withColumn("html", F.lit("<body><article><p>One article</article></body>"))
    assert {r.text for r in main_text(copies).collect()} == {"One article"}
    assert Page("<p a=\"x>y\">z</p").text(frozenset()) == "z"


def test_style_tree_decides_inside_articles(spark):
    def page(i, own):
        return f"<body><article><h1>Head {i}</h1><div class='box'>Same on all pages</div><p>{own}</p></article></body>"

    rows = [(i, "http://host/x", page(i, f"Text {i} of its own")) for i in range(8)]
    rows += [(100 + i, "http://copies/x", page(1, "One article")) for i in range(8)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(table).collect()}
    assert all(got[i] == f"Head {i}\nText {i} of its own" for i in range(8))
    assert all(got[100 + i] == "Head 1\nSame on all pages\nOne article" for i in range(8))


TEXTS = [(1, "Hello  world\n\n tab\there ▁x é😀ü"), (2, ""), (3, None), (4, "a" * 300 + " " * 200 + "b"), (5, "the the and")]


def test_pieces_round_trip_and_best_path(spark):
    import sentencepiece

    table = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = encode(table, PIECE_MODEL).filter("word is not null")
    words = {r.word: r.ids for r in rows.collect()}
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "decoded"))).alias("parts"))
    assert {r.doc_id: "".join(p.decoded for p in r.parts)[1:] for r in whole.collect()} == {i: t for i, t in TEXTS if t}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    score = {sp.id_to_piece(i): (max(sp.get_score(i), -32_000) * 4 - 1, i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for word in (" Hello", " the", " and", " world"):
        text = word.replace(" ", "▁")
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            ways = [(best[s][0] + score[text[s:end]][0], best[s][1] + [score[text[s:end]][1]]) for s in range(end) if text[s:end] in score]
            best.append(max(ways, key=lambda w: w[0]))
        if word in words:
            assert words[word] == best[-1][1]
    summary = {r.doc_id: r for r in encoded_documents(table.union(table), PIECE_MODEL).dropDuplicates().collect()}
    assert len(summary) == 5 and all(r.round_trip for r in summary.values())
    assert summary[2].n_tokens == summary[3].n_words == 0


def corpus(n=240):
    draw = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "to", "si", "de", "fu")]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(60)]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            words[draw.randrange(60)] = draw.choice(["stupidity", "idiotic", "trashy"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "x " * 2000), (5, rows[5][1])]
    table = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for scores, place in ((quality_scores(table, marks), 1), (toxicity_scores(table, marks), 2)):
        out = scores.collect()
        assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
        truth = {x[0]: x[place] for x in labels}
        held = [r for r in out if r.held_out and r.doc_id in truth]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert {r.score for r in toxicity_scores(table, marks.limit(0)).collect()} == {0.5}
    assert quality_scores(table.limit(0), marks).count() == 0


def test_spaced_letters_end_with_their_text():
    texts = [b"you s t u p i d", b"A fine day", b"I s t u p i d"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owners, _ = Evidence([b"stupid"]).sentences(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert owners.tolist() == [0, 2]


def test_base_score_of_the_language_model(spark):
    rows, _ = corpus(60)
    rows = [*rows, (100, None), (101, ""), (5, rows[5][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, WORD.findall((t or "").lower()) + [None]) for i, t in rows]
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    total, kinds = sum(counts.values()), len(counts)
    out = lm_scores(table, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").collect()
    want = {i: words for i, words in tokens}
    assert len(out) == len(rows)
    for r in out:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in want[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(want[r.doc_id])
        assert r.n_known == sum(counts[w] > 0 for w in want[r.doc_id])
        assert r.train_tokens == total and r.score < 0


def test_language_model_learns_from_all_training_rows(spark):
    """Words that only one document has are known, whatever its id."""
    often, own = "alpha beta gamma delta " * 40, "zebra quartz violin " * 400
    for place in (3, None):
        rows = [(i, often) for i in range(100, 110)] + [(place, own)]
        table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        scored = lm_scores(table, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
        assert scored.filter(F.col("doc_id").eqNullSafe(F.lit(place))).first().score / 1200 > -3


def test_language_model_tells_all_ids_apart(spark):
    ranks = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    known = (base64.b64decode(line.split()[0]) for line in open(ranks, "rb"))
    words = [w[1:].decode() for w in known if re.fullmatch(rb" [a-z]{3,}", w)][:2202]
    held, (rare, rarer) = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], words[-2:]
    rows = [(i, " ".join([*words[:-2], rare])) for i in range(200, 210) if zlib.crc32(str(i).encode()) % 10]
    rows += [(1, rarer), (held[0], rare), (held[1], rarer)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    scores = {r.doc_id: r.score for r in lm_scores(table, ranks).collect()}
    assert scores[held[0]] > scores[held[1]] + 0.3
    model = Attention(np.log(np.arange(50, 0, -1) / np.arange(51).sum()))
    ids = np.array([[50, 3, 7, 49]] * 50)
    for _ in range(20):
        model.learn(ids, np.array([[3, 7, 49, 1]] * 50), 0.01)
    targets = np.arange(50)[:, None].repeat(4, axis=1)
    found = model.log_probabilities(ids, targets, np.ones((50, 4), bool)).reshape(50, 4)
    assert np.exp(found).sum(axis=0) == pytest.approx(np.ones(4), abs=1e-5) and np.exp(found)[49, 2] > 0.01


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("text_key", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "/root/testdata/sf0.001")
        assert out.columns == table.columns and out.count() <= table.count()
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < result.count() < 200 and result.filter("not round_trip").count() == 0
