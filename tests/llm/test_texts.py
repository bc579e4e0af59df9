import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import bpe, html_text, quality, vocabularies
from stallwise.llm.queries import QUERIES
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def words():
    return vocabularies.word_pieces()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def same(words, library, text):
    parts = list(words.encode(text))
    decoder = words.decoder()
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids, repr(text[:60])
    assert "".join(map(decoder.feed, parts)) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(words, library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    rng = random.Random(1)
    texts = ["", " ", "Hello, world!! it's I'LL 1234 ½", "<|endoftext|>Hi<|startoftext|>x", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "é àb"]
    texts += ["\x1cfoo\x1dbar", "a b　c", "日本語テキスト", "a" * 500, "!" * 300 + "'s", "don't''s '''re", "́x", "ǅ ﬁ ß", "\x85a\x0bb"]
    texts += ["".join(rng.choice("abctheing") for _ in range(rng.randint(65, 700))) for _ in range(50)]
    texts += ["".join(rng.choice("ab the'S1é!\n ") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    for text in texts:
        same(words, library, text)


def test_all_ids_come_from_the_stream(words, monkeypatch):
    streamed = []
    stream = bpe.Merges.stream

    def counted(self, symbols):
        for token in stream(self, symbols):
            streamed.append(token)
            yield token

    monkeypatch.setattr(bpe.Merges, "stream", counted)
    monkeypatch.setattr(words, "known", {})
    text = "A river of stones, 12 winters old; isn't it " + "x" * 300
    assert np.frombuffer(b"".join(words.encode(text)), "<u4").tolist() == streamed


def test_digests_are_those_of_ids_and_text(odd_docs):
    rows = bpe.round_trip(odd_docs, vocabularies.word_pieces).collect()
    want = sorted((str(r[0]), len(r[1]) // 4, hashlib.sha256(r[1]).hexdigest(), hashlib.sha256(r[2].encode()).hexdigest()) for r in rows)
    found = bpe.round_trip_digests(odd_docs, vocabularies.word_pieces).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == want


def test_stream_equals_whole_for_any_merge_list():
    rng = random.Random(2)
    for _ in range(300):
        symbols, lengths, rules, seen = [0, 1, 2], {0: 1, 1: 1, 2: 1}, [], set()
        for _ in range(rng.randint(1, 14)):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in seen:
                seen.add(pair)
                made = len(symbols)
                symbols.append(made)
                lengths[made] = lengths[pair[0]] + lengths[pair[1]]
                rules.append((*pair, made))
        merges = bpe.Merges(rules, lengths)
        merges.step = max(lengths.values())
        for _ in range(10):
            text = [rng.randint(0, 2) for _ in range(rng.randint(0, 120))]
            assert list(merges.stream(text)) == merges.merged(text)


def test_stream_holds_a_bounded_number_of_symbols(words):
    merges, most = words.merges, 0

    def watched(n):
        nonlocal most
        rng = random.Random(3)
        for i in range(n):
            yield words.inside[ord(rng.choice("aeioutn"))]
            most = max(most, i - seen[0])

    seen = [0]
    for token in merges.stream(watched(20_000)):
        seen[0] += merges.lengths[token]
    assert most <= merges.lookahead + 2 * merges.step


def test_bytewise_decoding_is_incremental():
    signs = bpe.byte_symbols()
    text = "né 日本 \U0001f600"
    names = {i: signs[b] for i, b in enumerate(text.encode())}
    decoder = bpe.Decoder(names, True)
    parts = [decoder.feed(np.array([i], "<u4").tobytes()) for i in range(len(names))]
    assert "".join(parts) + decoder.finish() == text


def test_round_trip_of_odd_and_no_rows(odd_docs, no_docs, odd_rows, library):
    found = bpe.round_trip(odd_docs, vocabularies.word_pieces).collect()
    want = sorted(library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in odd_rows)
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in found) == want
    assert bpe.round_trip(no_docs, vocabularies.word_pieces).count() == 0


PAGE = """<html><head><title>T</title><script>var a="</p><article>";</script></head><body><header>Site name</header>
<nav>menu <ul><li>a<li>b</ul></nav><div id="main"><div class="cookie-notice">We use cookies</div>
<article><header><h1>My   title</h1></header><p>First &eacute;l&#233;ment  with
 spaces<p>Second <a href=x>link</a> text is here, long enough to count<ul><li>one<li>two</ul><aside>side</aside>
<form>f<input></form><div class="comments"><p>nice one</p></div><p>Short.</article>
<div class="sidebar"><p>bla bla bla bla bla</p></div></div><footer>foot</footer></body>"""


def test_article_without_furniture():
    want = ["My title", "First élément with spaces", "Second link text is here, long enough to count", "one", "two", "Short."]
    assert html_text.main_text(PAGE).split("\n\n") == want


def test_core_without_an_article_element():
    page = (
        '<body><div><a href=1>x</a> <a href=2>y</a></div><div id="content"><h2>Head</h2><p>This is a long paragraph with a lot of text in it.</p>'
        "<p>Another long paragraph with text that goes on.</p></div><div><a href=2>imprint</a> <a href=3>contact</a></div>"
    )
    want = ["Head", "This is a long paragraph with a lot of text in it.", "Another long paragraph with text that goes on."]
    assert html_text.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain < text &amp; more", "plain < text & more"), ("<div>" * 30_000 + "deep", "deep"), ("<!-- open", ""), ("<nav>only a menu</nav>", "")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8><body><p>real text</body></html>",
        "<html><head><title>T</title><p>real text</html>",
        "<head><script>x</script>real text",
        "<head><noscript><link href=x><body>real text",
        "<p class=notice>cookies<p>real text",
        "<p class=notice><b>cookies</b> here<div>real text</div>",
        "<ul><li class=share>share<li>real text</ul>",
        "<div><ul><li class=share>share</ul>real text</div>",
        "<table><tr><td class=sidebar>side<td>real text</table>",
        "<table><tr class=ad><td>buy<tr><td>real text</table>",
        "<div><table><tr><td class=sidebar>side</table>real text</div>",
        "<dl><dt class=ad>buy<dd>real text</dl>",
        "<div><p class=notice>cookies</div>real text",
        "<p>real <span class=ad>buy</p>text",
        "<div><nav>menu<ul><li>a</div>real text",
    ],
)
def test_unclosed_furniture_ends_where_html_ends_it(page):
    assert html_text.main_text(page).split() == ["real", "text"]


@pytest.mark.parametrize(
    "page",
    [
        "<section><div class=ad><table><tr><td>buy</section>this</table>now</div>real text</section>",
        "<p>real <span class=ad><div>buy</div> this</span> text</p>",
        "<nav><p>one<p>two<ul><li>a<li>b</ul>three</nav>real text",
        "<a href=x>real <div class=ad>buy</a> this</div>text",
        "<head><template><p>x</template></head>real text",
    ],
)
def test_closed_furniture_ends_only_there(page):
    assert html_text.main_text(page).split() == ["real", "text"]


def neutral_page(seed):
    """A page whose names say nothing, and its paragraphs: only the densities can tell them from the boxes of links."""
    rng = random.Random(seed)

    def some(n):
        return " ".join(rng.choice("river stone market winter garden letter morning window".split()) for _ in range(n))

    def links(n):
        return "".join(f'<li><a href="/{i}">{some(2)}</a></li>' for i in range(n))

    body = [some(rng.randint(30, 70)).capitalize() + "." for _ in range(3 + seed % 8)]
    text = "".join(f"<p>{x}</p>" for x in body)
    return (
        f'<body><div class="k1"><ul>{links(12)}</ul></div><div class="k2"><div class="k3">{text}</div>'
        f'<div class="k4"><ul>{links(8)}</ul></div></div><div class="k5"><a href="/a">{some(2)}</a> <a href="/b">{some(1)}</a></div></body>',
        body,
    )


def test_densities_choose_where_names_say_nothing(monkeypatch):
    pages = [neutral_page(seed) for seed in range(40)]
    assert all(html_text.main_text(page) == "\n\n".join(body) for page, body in pages)
    monkeypatch.setattr(html_text, "marked", lambda nodes: [nodes[0]])
    assert not any(html_text.main_text(page) == "\n\n".join(body) for page, body in pages)


def test_densities_against_recursion():
    """Characters, tags and sums of every element, counted by hand from its own subtree."""

    def size(node):
        return sum(len("".join(x.split())) if isinstance(x, str) else size(x) for x in node.parts)

    def tags(node):
        return sum(1 + tags(x) for x in node.parts if not isinstance(x, str))

    def links(node):
        inner = [links(x) for x in node.parts if not isinstance(x, str)]
        return (size(node), 1 + tags(node)) if node.tag == "a" else tuple(map(sum, zip(*inner, strict=True))) if inner else (0, 0)

    for seed in range(10):
        nodes = html_text.ordered(html_text.parsed(neutral_page(seed)[0]))
        html_text.measure(nodes)
        body = nodes[0]
        for node in nodes:
            assert (node.chars, node.tags) == (size(node), tags(node))
            assert (node.link_chars, node.link_tags) == links(node)
            c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
            if c:
                base = math.log(c / max(1, c - lc) * lc + body.link_chars / body.chars * c + math.e) + math.e - 1
                assert node.density == pytest.approx(c / t * math.log(c / max(1, lc) * t / lt + math.e, base))
            assert node.total == pytest.approx(sum(x.density for x in node.parts if not isinstance(x, str)))


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, '<a "' * 250_000 + "'>", "<a '\"" * 150_000 + "'>" * 9, "<" * 10**6, "<!" * 500_000, "<div>" * 90_000 + "</span>" * 60_000, "<b>" * 60_000 + "<p></p>x" * 60_000],
)
def test_hostile_pages_take_seconds(page):
    began = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - began < 20


def ends_by_hand(page, at):
    """Where a tag ends whose name ends at ``at``: the first ``>`` outside of quotes."""
    quote = None
    for i in range(at, len(page)):
        if quote is None and page[i] == ">":
            return i + 1
        if page[i] in "\"'" and quote in (None, page[i]):
            quote = None if quote else page[i]
    return -1


def test_ends_of_tags_against_a_scan():
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choices("<a b>\"'", k=40))
        markup = html_text.Markup(page)
        assert [markup.end_of(i) for i in range(40)] == [ends_by_hand(page, i) for i in range(40)]


def test_pages_of_the_table(spark):
    found = QUERIES["op7_html_text"](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows and all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("track(" in r["text"] or "&amp;" in r["text"] and "&amp;amp;" not in r["html"] for r in rows)


def test_pages_with_nulls_and_none(spark):
    schema = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], schema)
    assert sorted(len(r["text"]) for r in html_text.main_texts(pages).collect())[0] == 0
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_held_out_quality(spark):
    rows = QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [r for r in rows.collect() if r["held_out"]]
    assert len(rows) > 30
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_fit_sees_all_passages_of_a_long_text():
    text = "calm words of a long text " * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array([1.0]), pa.array([text])], ["label", "text"])
    bag = np.frombuffer(next(quality.encoding([batch])).column("bag")[0].as_py()).reshape(-1, quality.FEATURES)
    assert len(bag) == 120_000 // quality.PASSAGE


def test_null_id_is_held_out(spark):
    row = spark.createDataFrame([(None,)], "doc_id long").select(quality.held_out(F.col("doc_id"))).first()
    assert row[0] is True


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    w = {k: v + rng.normal(0, 0.3, v.shape) for k, v in quality.fit([], np.array([])).weights.items()}
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality.sigmoid(quality.forward(x, starts, w)["logit"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradients(x, starts, y, w)
    for k, v in w.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-5 - found[k][at]) < 1e-6


def test_quality_of_odd_and_no_rows(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (8, 0), (9, 1), (77, 1)], "doc_id long, quality int")
    model = quality.learned(odd_docs, labels)
    found = quality.scored(odd_docs, model)
    assert found.select("doc.*").columns == odd_docs.columns
    scores = [r["score"] for r in found.collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)
    assert quality.scored(no_docs, quality.learned(no_docs, labels)).count() == 0


def test_quality_learns_from_one_row_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(20)] + [(3, f"again {i}") for i in range(500)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((bags, y)))
    for one in (docs, docs.repartition(7, "text")):
        quality.learned(one, labels)
    used = labels.filter(~quality.held_out(F.col("doc_id"))).count()
    assert 3 in [r[0] for r in labels.filter(~quality.held_out(F.col("doc_id"))).collect()]
    assert [len(b) for b, _ in seen] == [used, used]
    assert all((a == b).all() for a, b in zip(seen[0][0], seen[1][0], strict=True))
