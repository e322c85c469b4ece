"""Classifier, page extraction and language-model scoring."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cytoframe.llm import html_text, masked_lm, quality_model, wordscan
from cytoframe.llm.html_dom import Node, parse


def test_words_match_a_regular_expression():
    r = random.Random(1)
    texts = ["".join(r.choice([*"abAB é", " ", "\t", "\n", "\x0b", "\xa0", "漢"]) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "q" * 9000 + " q"]
    known = {}
    at = 0
    for i, w in wordscan.runs(pa.array(texts), lower=True):
        for t in range(len(w.first) - 1):
            want = [x.translate(str.maketrans("AB", "ab")) for x in re.findall(r"[^\x20\x09-\x0D]+", texts[i + t] or "")]
            got = w.hashes[w.first[t] : w.first[t + 1]].tolist()
            assert len(want) == len(got)
            for a, b in zip(want, got):
                assert known.setdefault(a, b) == b
            at += 1
    assert at == len(texts) and len(set(known.values())) == len(known)


def test_runs_may_be_cut_anywhere(monkeypatch):
    texts = pa.array(["a b", "", "c", None, "d e f"] * 20)
    whole = np.concatenate([w.hashes for _, w in wordscan.runs(texts)])
    monkeypatch.setattr(wordscan, "CHUNK", 3)
    assert (np.concatenate([w.hashes for _, w in wordscan.runs(texts)]) == whole).all()


def documents(r, n):
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        kind = r.choice([lambda w: w + "***", lambda w: w.upper() + "!!", lambda w: (w + " ") * 6])
        rows.append((i, " ".join(kind(word()) if bad else word() for _ in range(60)), "x"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_classifier(spark):
    rows, labels = documents(random.Random(2), 400)
    rows += [(None, None, "x"), (1000, "", "x"), (1001, "w " * 30000, "x"), (5, rows[5][1], "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, quality int")
    got = quality_model.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    truth = dict(labels)
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([g.predicted == truth[g.doc_id] for g in held if g.doc_id in truth]) > 0.95
    kept = quality_model.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted for g in got)
    assert len({round(g.score, 12) for g in got if g.doc_id == 5}) == 1


def test_held_out_labels_are_not_read(spark):
    rows, labels = documents(random.Random(3), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    one, two = (sorted(quality_model.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, turned))
    assert one == two


def test_fit_meets_every_sampled_document_once(spark, monkeypatch):
    rows, labels = documents(random.Random(6), 100)
    known = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(known[0], f"{i} " * 30, "x") for i in range(1000)] + rows + [(i, t + " again", "x") for i, t, _ in rows] * 2, "doc_id long, text string, source string").coalesce(1)
    got, fit = [], quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda x, y: got.append((x.tolist(), y.tolist())) or fit(x, y))
    for order in (docs, docs.orderBy(docs.text.desc())):
        quality_model.train(order, spark.createDataFrame(labels + labels[:1], "doc_id long, quality int"), 2 * len(labels))
    assert len(got[0][1]) == len(known) + (labels[0][0] in known) and sum(got[0][1]) == sum(q for i, q in labels + labels[:1] if i in known)
    assert got[0] == got[1]


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(g.score, 6) for g in quality_model.classify(docs, none).collect()] == [0.5, 0.5]
    assert quality_model.classify(docs.limit(0), none).collect() == []


def test_pages_made_anew():
    trees = html_text.fitted()
    wrong = 0
    for page, mark in html_text.examples(77, 200):
        nodes = parse(page)
        want = " ".join(s for _, s in sorted(s for n in nodes for s in n.texts if mark in s[1]))
        wrong += html_text.extract([page], trees)[0] != want
    assert wrong <= 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>A&nbsp;title &amp; more</h1><p>First   <b>pa</b>ragraph of the text, with words.</p><p>Second one&#33;<br>goes on.
<div class="ad">Buy now</div><p>Third paragraph, and some more words in it.</p></article><section id="comments"><p>I liked this very much, thank you for writing it.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_a_page_by_hand():
    got = html_text.extract([PAGE], html_text.fitted())[0]
    assert got == "A title & more First paragraph of the text, with words. Second one! goes on. Third paragraph, and some more words in it."


def test_decoding_never_contradicts():
    r = np.random.default_rng(5)
    for page, _ in html_text.examples(3, 20):
        nodes = parse(page)
        logit = r.normal(0, 3, len(nodes))
        main = html_text.decode(nodes, logit)
        at = {id(n): i for i, n in enumerate(nodes)}
        assert all(main[at[id(n.parent)]] for i, n in enumerate(nodes) if main[i] and n.parent)


def test_decoding_is_the_likeliest():
    """Against every labelling of small trees in which the parent of a main node is main."""
    r = np.random.default_rng(11)
    for n in [1, 2, 3, 5, 8, 11] * 5:
        parents = [None] + [int(r.integers(0, i)) for i in range(1, n)]
        nodes = []
        for p in parents:
            nodes.append(Node("div", frozenset(), None if p is None else nodes[p]))
        logit = r.normal(0, 2, n)
        yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
        best = -np.inf
        for bits in range(1 << n):
            on = [bool(bits >> i & 1) for i in range(n)]
            if all(p is None or not on[i] or on[p] for i, p in enumerate(parents)):
                best = max(best, sum(yes[i] if on[i] else no[i] for i in range(n)))
        got = html_text.decode(nodes, logit)
        assert abs(sum(yes[i] if got[i] else no[i] for i in range(n)) - best) < 1e-9


PROSE = "The old bridge was rebuilt in stone after the flood, and the market moved to its northern end. Few of the houses from that time are left."
BY_HAND = [
    # (page, main text)
    (f"<html><body><div id=top><ul><li><a href=/>Start</a><li><a href=/n>News</a></ul></div><main><h1>The bridge</h1><p>{PROSE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be its width.</p><p>{PROSE}</p></main><footer>Imprint</footer></body></html>",
     f"The bridge {PROSE} Let x=2 be its width. {PROSE}"),
    (f"<body><nav><a href=/a>Home</a> <a href=/b>Shop</a></nav><article><h2>Stone</h2><p>{PROSE}</p><p>Then <s hidden>it <span>was</span> left</s> and gone, as <svg><text>Fig. 1</text></svg> shows.</p><p style='display:none'>{PROSE}</p></article><aside><a href=/x>More</a></aside></body>",
     f"Stone {PROSE} Then it was left and gone, as Fig. 1 shows. {PROSE}"),
    (f"<html><head><title>Not me</title><style>b{{}}</style></head><body><article><p>{PROSE}</p><object data=x>{PROSE}</object><script>no()</script><p>{PROSE}</p></article><form><label>Mail</label><input><textarea>no</textarea><button>Send</button></form></body></html>",
     f"{PROSE} {PROSE} {PROSE}"),
]


@pytest.mark.parametrize("page, want", BY_HAND)
def test_pages_by_hand(page, want):
    assert html_text.extract([page], html_text.fitted())[0] == want


def test_other_columns_of_pages(spark):
    rows = [(1, "u", PAGE, "mine", 7), (1, "u", PAGE, None, None), (None, None, "<p>" + "word, " * 200_000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.main_texts(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert [g.text for g in got if g.page_id == 1] == [html_text.extract([PAGE], html_text.fitted())[0]] * 2
    assert [g.n_chars in (0, 6 * 200_000 - 1) for g in got if g.page_id is None] == [True]


def test_tokens_have_features():
    nodes = parse("<div class='Alpha-beta'><p id=gamma>x</p></div><p>y</p>")
    assert html_text.token_features(nodes, {"beta": 0, "gamma": 1}).tolist() == [[0, 0], [2, 0], [1, 2], [0, 0]]
    assert html_text.frequent_tokens([nodes], 2) == ("alpha", "beta") and len(html_text.fitted().tokens) == html_text.TOKENS


def test_odd_pages(spark):
    odd = [None, "", "plain text only", "<", "<p", "<p>unclosed <b>tags", "<script>never closed", "</div></p>", "<!-- open", "<div " + "x" * 5000, "<div>" * 3000 + "deep", "<p a='>'>x</p>"]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(odd)] + [(0, "u0", None)], "page_id long, url string, html string")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(odd) + 1 and all(g.n_chars == len(g.text) for g in got) and all(g.text == "" for g in got if g.page_id in (0, 1))
    assert html_text.main_texts(df.limit(0)).collect() == []


def test_language_model_prefers_the_language(spark):
    r = random.Random(6)
    nxt = {w: [f"w{(i * 7 + k) % 60}" for k in range(3)] for i, w in enumerate(f"w{j}" for j in range(60))}

    def text(n):
        out = ["w1"]
        for _ in range(n):
            out.append(r.choice(nxt[out[-1]]))
        return out

    train = [text(300) for _ in range(2000)]
    probe = [text(200) for _ in range(10)]
    mixed = [r.sample(p, len(p)) for p in probe]
    rows = [(i, " ".join(t)) for i, t in enumerate(train + probe + mixed)] + [(9000, None), (9001, ""), (9002, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {g.doc_id: g for g in masked_lm.score_documents(docs).collect()}
    good, bad = (np.mean([got[a + i].mean_log_likelihood for i in range(10)]) for a in (2000, 2010))
    assert good > bad + 0.2
    assert [(got[i].n_tokens, got[i].log_likelihood, got[i].mean_log_likelihood) for i in (9000, 9001, 9002)] == [(0, 0.0, None)] * 3
    again = {g.doc_id: g.log_likelihood for g in masked_lm.score_documents(docs).collect()}
    assert again == {i: g.log_likelihood for i, g in got.items()}


@pytest.mark.parametrize("bucket", [500, 2_000_000])
def test_rare_words_are_scored_by_their_share(spark, monkeypatch, bucket):
    monkeypatch.setattr(masked_lm, "BUCKET", bucket)
    r = random.Random(12)
    word = lambda n: "".join(r.choice("etaoinsh") for _ in range(n))
    common, known = [word(4) for _ in range(1500)], [word(7) for _ in range(300)]
    rows = [(i, " ".join(r.choices(common, k=200))) for i in range(60)] + [(100 + i, " ".join(known)) for i in range(3)]
    rows += [(200, " ".join(known[:50])), (201, " ".join(word(7) for _ in range(50))), (201, " ".join(known[:50]))]
    got = masked_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    known_ll, *_ = [g.log_likelihood for g in got if g.doc_id == 200]
    strange_ll, repeat_ll = sorted(g.log_likelihood for g in got if g.doc_id == 201)
    n = {}
    for _, t in rows:
        for w in t.split():
            n[w] = n.get(w, 0) + 1
    want = sum(np.log(n[a]) - np.log(n[b]) for a, b in zip(rows[-3][1].split(), rows[-2][1].split()))
    assert repeat_ll == known_ll and abs(known_ll - strange_ll - want) < 1e-4 and want > 50


def test_masked_scores_by_hand():
    r = np.random.default_rng(4)
    net = masked_lm.Network.start(np.ones(masked_lm.TOKENS))
    net.flat += r.normal(0, 0.3, net.flat.shape).astype(np.float32)
    context, target = r.integers(0, masked_lm.TOKENS + 1, (4, 50)), r.integers(0, masked_lm.TOKENS, 50)
    got = net.log_p(context, target)
    for i in range(50):
        h = np.tanh(net.hidden + sum(net.window[j][context[j, i]] for j in range(4)))
        every = []
        g = net.group @ h + net.group_bias
        for k in range(masked_lm.GROUPS):
            p = net.place[k] @ h + net.place_bias[k]
            every.append(g[k] - np.log(np.exp(g).sum()) + p - np.log(np.exp(p).sum()))
        every = np.concatenate(every)
        assert abs(np.exp(every).sum() - 1) < 1e-4 and abs(every[target[i]] - got[i]) < 1e-3


def test_one_step_lowers_the_loss():
    r = np.random.default_rng(8)
    net = masked_lm.Network.start(np.ones(masked_lm.TOKENS))
    context = r.integers(0, 20, (4, 4000))
    target = (context[1] * 3 + context[2]) % 50
    before = net.log_p(context, target).mean()
    for _ in range(60):
        net.step(context, target, 1.0)
    assert net.log_p(context, target).mean() > before + 1


def test_empty_table_is_scored(spark):
    assert masked_lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["", " ", "a", "a b"])
def test_windows_stay_inside_a_text(text):
    for _, w in wordscan.runs(pa.array([text, text])):
        context, token = masked_lm.windows(w, masked_lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(masked_lm.TOKENS)))
        n = len(text.split())
        assert context.shape == (4, 2 * n) and len(token) == 2 * n
        if n == 1:
            assert (context == masked_lm.PAD).all()
