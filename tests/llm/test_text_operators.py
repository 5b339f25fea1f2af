"""Operators whose result depends on one document: against brute force and the libraries."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from candlewick.llm import bpe, counts, html_text, pii, queries, token_store, toxicity, words

ODD = [None, "", " ", "a", "  a  b\n c ", "x<|endoftext|>y <|startoftext|>Z", "don't 's we'll", "a\x1cb #\x1c#", "naïve ÄÖ ÅÅ", "日本語　テキスト", "é ×", "🙂🙂 ok", "\ttab\r\n\r\nx", "\xa0a \x85b", "12 ½ 3.5", "ſK Ω", "x" * 3000, "ab1" * 30000, "İstanbul ΣΑΣ"]
ALPHABET = "ab 'st\n\t 1.,<|éß日 \xa0@+-()05"


def texts(n=2000, seed=4):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def frame(spark, rows, more=False):
    """(doc_id, text) with repeated rows and columns that an operator might use itself."""
    if more:
        return spark.createDataFrame([(i, t, i, "s", "c", 1, "n", "x") for i, t in rows], "doc_id long, text string, n_tokens long, spans string, kind string, score int, id string, part string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def numbered(values):
    return [*enumerate(values), (0, values[0]), (None, "null id")]


def test_byte_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = numbered(texts())
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(frame(spark, rows, True), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == want


def test_compatible_pairs_by_plain_merging():
    own = bpe.TrieBPE(words.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(8)
    for top in (400, 3000, 50256):
        for _ in range(3000):
            a, b = rng.randrange(top), rng.randrange(top)
            if own.own(a) and own.own(b):
                assert own.compatible(a, b) == (own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = numbered(texts())
    got = sorted(map(tuple, counts.token_counts(frame(spark, rows, True), path, limit=20).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert got == sorted(want, key=str)
    assert counts.token_counts(frame(spark, []), path).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i * 7 % 2019, t) for i, t in enumerate(texts(2000))]
    folder = f"file://{tmp_path}/tokens"
    token_store.write_tokens(frame(spark, rows, True), folder, path, files=5)
    start, want = 0, []
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.digests(spark, folder).collect())) == want
    one = token_store.read_tokens(spark, folder, ids=[14])
    assert [r.tokens for r in one.collect()] == [[*lib.encode(dict(rows)[14] or "", add_special_tokens=False).ids, 2]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    from pyarrow import orc

    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == len(rows)
    empty = f"file://{tmp_path}/empty"
    token_store.write_tokens(frame(spark, []), empty, path)
    assert token_store.digests(spark, empty).count() == 0


def rows_read(frame):
    """Rows that the scan gave, after stripes and row groups were skipped."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_stripes_are_several_and_skipped(spark, tmp_path):
    """A file of many stripes: one id reads one row group; an id between stored ones reads none, by the Bloom filter."""
    from pyarrow import orc

    folder = f"file://{tmp_path}/tokens"
    token_store.write_tokens(frame(spark, [(i * 7, f"text {i}") for i in range(12_000)]), folder, public_tokenizers.path("word_bpe_49k.json"), files=1, stripe_rows=2_000)
    (file,) = tmp_path.glob("tokens/*.orc")
    assert orc.ORCFile(str(file)).nstripes == 6
    for wanted in (0, 7 * 2500, 7 * 11_999):
        one = token_store.read_tokens(spark, folder, ids=[wanted])
        assert [r.doc_id for r in one.collect()] == [wanted] and rows_read(one) <= 1000
    gone = [token_store.read_tokens(spark, folder, ids=[7 * k + 3]) for k in range(500, 540)]
    assert sum(map(rows_read, gone)) <= 0.1 * 1000 * len(gone)
    assert rows_read(token_store.read_tokens(spark, folder)) == 12_000


def base_spans(text):
    """The base kinds by regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    kinds = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def test_base_spans_by_regular_expressions(spark):
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "12", "255.1.2.3", "999.1.1.1.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (377) 555-0271", "+", "(", ")", "é", "日", "0000000000000", "%", "_", "..", "--", "1.2.3", "٣"]
    rows = numbered(["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(6000)] + ODD)
    found = {}
    for r in pii.span_digests(pii.find_pii(frame(spark, rows, True))).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        spans = base_spans(t or "")
        for r in found[i]:
            assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest(), (t, r.spans, spans)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in spans) for k in ("email", "ip", "card", "phone")]


def test_more_spans_and_redaction(spark):
    text = "see https://me:pw@host.example.com/x and IBAN DE89370400440532013000, account no. 12345678; mail a.b@c.de now"
    spans = pii.finder().spans(text)
    assert [(k, text[s:e]) for k, s, e in spans if k in ("iban", "account")] == [("iban", "DE89370400440532013000"), ("account", "12345678")]
    assert any(k == "url" for k, _, _ in spans)
    assert pii.redacted("mail a.b@c.de now", pii.finder().spans("mail a.b@c.de now")) == "mail <EMAIL> now"
    docs = spark.createDataFrame([(1, "to a.b@c.de.", 12), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, "to <EMAIL>.", 11), (2, None, None), (3, "clean", 5)]


HOSTILE = {"zeros": ("", "0"), "zero parts": ("", "0000."), "blanks after a cue": ("account", " "), "cues": ("", "account "), "addresses in an address": ("", "http://a@b/"), "ats": ("", "a@"), "pluses": ("", "+1 "), "digits": ("", "1 ")}


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


@pytest.mark.parametrize("name", HOSTILE)
def test_personal_data_in_hostile_texts_takes_linear_time(name):
    a, b = HOSTILE[name]
    small, large = (seconds(pii.finder().spans, a + b * (n // len(b))) for n in (500_000, 2_000_000))
    assert large < max(1.0, 8 * small)


def test_addresses_of_many_zeros(spark):
    docs = spark.createDataFrame([(1, "0" * 5000 + ".1.1.1"), (2, "1" * 5000 + ".1.1.1")], "doc_id long, text string")
    got = {r.doc_id: r.n_ip for r in pii.span_digests(pii.find_pii(docs)).collect()}
    assert got == {1: 1, 2: 0}
    assert pii.redact(docs.limit(0)).count() == 0 and pii.find_pii(docs.limit(0)).count() == 0


TEST_PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="content c12"><h1>Title &amp; more</h1><p>First   paragraph of the article,<br>with a break and <a href="x">a link</a>.<p><b>Second one
goes on &lt;here&gt; and on.</div><div class="comments"><p>I liked it</p></div>
<aside><p>Elsewhere there is more to read about this and that.</p></aside><form><p>Sign up</p></form><footer>Copyright</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "http://a.example/1", TEST_PAGE), (2, "http://a.example/2", TEST_PAGE.replace("c12", "c7")), (3, None, None), (4, "http://[broken", ""), (5, "http://b.example", "just text &eacute; "), (1, "http://a.example/1", TEST_PAGE), (None, "http://a.example/3", "<p>")]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")
    got = html_text.extract_pages(pages).collect()
    by = {r.page_id: r for r in got}
    want = "Title & more First paragraph of the article, with a break and a link . Second one goes on <here> and on."
    assert by[1].text.replace(" .", ".") == want.replace(" .", ".") and by[2].text == by[1].text and by[1].n_chars == len(by[1].text)
    assert by[3].text == by[4].text == "" and len(got) == 7
    assert html_text.extract_pages(pages.limit(0)).count() == 0


HOSTILE_PAGES = {
    "open tags": ("", "<a "), "elements": ("", "<div class=a1>x"), "inline": ("", "<b>x"), "ends of nothing": ("<div>" * 20000, "</foo>"), "ends of paragraphs": ("<div>" * 20000, "</p>"),
    "quotes": ("", "<a '> '"), "drawings": ("", "<svg>"), "ends of drawings": ("<svg>", "</svg"), "blocks in inline": ("<b>" * 20000, "<div></div>"), "links": ("<b>" * 20000, "<a>"),
    "items": ("<span>" * 20000, "<li>x"), "rows": ("<table>", "<tr><td>x"), "signs": ("", "<"), "comments": ("", "<!--"), "declarations": ("", "<!x"), "attributes": ("", "<p a = "),
}


@pytest.mark.parametrize("name", HOSTILE_PAGES)
def test_hostile_pages_take_linear_time(name):
    a, b = HOSTILE_PAGES[name]
    for end in ("", ">"):
        small, large = (seconds(html_text.extract, a + b * (n // len(b)) + end, []) for n in (200_000, 800_000))
        assert large < max(2.0, 8 * small)


def made_page(rng, body="content"):
    """A page of nested blocks and its main text by construction."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    text, parts = [], []
    for k in range(rng.randint(3, 8)):
        t = words(rng.randint(15, 60))
        text.append(t)
        t = t.replace(" ", rng.choice([" ", "  ", "\n", " <b>", "&#32;"]), 1).replace(" <b>", " <b>") + rng.choice(["", "</b>"])
        parts.append({0: f"<p>{t}", 1: f"<p>{t}</p>", 2: f"<div class='part{k}'><p>{t}</p></div>", 3: f"<ul><li>{t}</ul>", 4: f"<blockquote>{t}</blockquote>"}[rng.randrange(5)])
    title = words(4)
    around = [f"<nav><a href='/'>{words(3)}</a></nav>", f"<div class='ad banner'>{words(9)}</div>", f"<aside><p>{words(30)}</p></aside>", f"<form><p>{words(5)}</form>", f"<script>var a = '<p>{words(3)}';</script>", f"<!-- {words(5)} -->"]
    rng.shuffle(around)
    html = f"<html><head><title>{words(3)}</title></head><body><header>{words(3)}</header>{''.join(around[:3])}<{body}><h1>{title}</h1>{''.join(parts)}</{body.split()[0]}><div id='comments'><p>{words(12)}</p></div>{''.join(around[3:])}<footer>{words(6)}</footer></body></html>"
    return html, " ".join([title, *text])


def test_pages_by_construction(spark):
    rng = random.Random(21)
    made = [made_page(rng, "article") for _ in range(150)]
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.example/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    for r in html_text.extract_pages(pages).collect():
        assert r.text == made[r.page_id][1] and r.n_chars == len(r.text)


def test_the_host_decides(spark):
    """A page by itself would give its longest block; the host's other pages show where articles stand."""
    page = lambda body, more: f"<html><body><div class='story'><p>{body}</p></div><div class='extra x1'><p>{more}</p></div></body></html>"
    rows = [(i, page(f"article {i} " + "text " * 60, "more")) for i in range(8)] + [(8, page("short article " + "text " * 40, "something else " * 25))]
    alone = html_text.extract(rows[8][1], [])
    assert alone.startswith("something else")
    pages = spark.createDataFrame([(i, "http://h.example/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got[8].startswith("short article") and "something" not in got[8] and got[0].startswith("article 0")
    (paths,) = [r.paths for r in html_text.host_paths(pages).collect()]
    assert paths[0].endswith("/div.story")


def test_blocks_beside_the_longest_stay():
    html = "<html><body><article><div class='lead'><p>" + "lead " * 10 + "</p></div><div class='body'><p>" + "body " * 90 + "</p></div><div class='share'>share</div></article></body></html>"
    assert html_text.extract(html, []) == " ".join(["lead"] * 10 + ["body"] * 90)


def test_pages_by_shuffled_hosts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", TEST_PAGE) for i in range(12)], "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.extract_pages(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_text.extract_pages(pages).collect())) == want


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(["ba", "re", "ti", "on", "er", "lu"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        w = [make() for _ in range(rng.randint(5, 120))]
        if y:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["vilegu", "grubbo"]) + rng.choice(["", "ta", "ren", "so", "."]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxic_documents_held_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "en", "s", 0.0, 1) for i, t, _ in rows] + [(9000, None, "en", "s", 0.0, 1), (9001, "", "en", "s", 0.0, 1)], "doc_id long, text string, lang string, source string, score double, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    kept = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(y) for i, _, y in kept)
    assert len(kept) > 60 and right / len(kept) > 0.97
    for i, t, y in kept:
        for s in got[i].spans:
            assert any(t[s.start : s.end].startswith(x) for x in ("vilegu", "grubbo")) or not y
    assert got[9000].spans == [] and got[9000].score == got[9001].score < 0.3
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.score < 0.3}
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity.Field({}, turn=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    sizes = [0, 1, 5, 3, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    u = rng.normal(size=bounds[-1])
    got = toxicity.marginals(field, u, bounds)
    from itertools import product

    for s, e in zip(bounds[:-1], bounds[1:]):
        if e == s:
            continue
        mass = np.zeros((e - s, 2))
        for tags in product((0, 1), repeat=int(e - s)):
            x = field.start[tags[0]] + sum(u[s + k] for k, t in enumerate(tags) if t) + sum(field.turn[a, b] for a, b in zip(tags, tags[1:]))
            for k, t in enumerate(tags):
                mass[k, t] += np.exp(x)
        assert np.allclose(got[s:e], np.log(mass[:, 1] / mass[:, 0]))


def test_scores_by_enumeration():
    """The score and spans of short texts, from all taggings of their words."""
    from itertools import product

    rng = random.Random(6)
    weights = {f: rng.uniform(-2, 2) for w in ("bad", "good", "some", "thing") for f in toxicity.features(w)}
    model = toxicity.Field(weights, bias=-0.5, turn=np.array([[0.3, -0.4], [-0.2, 0.6]]), start=np.array([0.1, -0.3]), scale=0.8, shift=0.2)
    texts = ["", "bad", "good some bad thing", "  thing\tbad  bad, some-good ", "bad bad bad bad bad bad"]
    scorer = toxicity.Scorer(model)
    for text, (score, spans) in zip(texts, scorer.scores(texts, spans=True)):
        words_ = text.split()
        u = [model.potential(w) for w in words_]
        mass = np.zeros((len(u), 2))
        for tags in product((0, 1), repeat=len(u)):
            x = sum(u[k] for k, t in enumerate(tags) if t) + sum(model.turn[a, b] for a, b in zip(tags, tags[1:])) + (model.start[tags[0]] if u else 0)
            for k, t in enumerate(tags):
                mass[k, t] += np.exp(x)
        odds = np.log(mass[:, 1] / mass[:, 0]) if u else np.zeros(0)
        z = np.log(np.sum(np.exp(4 * odds))) / 4 if u else -30.0
        assert score == pytest.approx(1 / (1 + np.exp(-(0.8 * z + 0.2))))
        want, at, held = [], 0, False
        for w, o in zip(words_, odds):
            begin = text.index(w, at)
            at = begin + len(w)
            if o >= 0:
                want = [*want[:-1], (want[-1][0], at)] if held else [*want, (begin, at)]
            held = o >= 0
        assert [(s, e) for s, e, _ in spans] == want


def test_toxicity_of_very_long_and_repeated_rows(spark):
    rows = labelled(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:20]] + [(7000, "ba re " * 400_000), (7001, "x" * 2_000_000), (7002, "ba " * 300_000 + "vilegu" + " ba" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, y) for i, _, y in rows[:30]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {}
    for r in toxicity.score(docs, model).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert len(got) == 303 and got[7000].score < 0.3 and got[7001].score < 0.3
    assert [(s.start, s.end) for s in got[7002].spans] == [(900_000, 900_006)] and got[7002].score >= 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.keep_clean(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_token_store", "op4_pii", "op7_bpe", "op8_token_counts", "op10_html_text"])
def test_registered_queries_cover_whole_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, folder).collect()
    source, key = ("pages", "page_id") if name.startswith("op10") else ("documents", "doc_id")
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{folder}/{source}.parquet").select(key).collect())
