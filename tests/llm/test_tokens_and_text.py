"""Packing, BPE, page text and conversations against tokenizers, brute force and exact expectations."""

import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aisle.llm import bpe, conversations, packing, pages

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdefghij'stlmrveSTAΣİéÉß0123456789 .,!?<|>́日本語😀-_=+*&^%$#@\t\n \x1c"


def awkward():
    rng = random.Random(0)
    fixed = ["it's we'LL ''s !!'s", "<|startoftext|>a<|endoftext|> b <|endoftext|>", "ΑΣ ΟΔΟΣ Σ", "", "   ", "x" * 300, "ab" * 400, "a   b", "a  \n b ", None]
    return fixed + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 90))) for _ in range(400)]


def test_bpe_matches_the_library(spark):
    texts = awkward()
    library = Tokenizer.from_file(WORDS)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe.encode(frame, WORDS).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), text


def test_every_token_encodes_to_itself():
    with open(WORDS, encoding="utf-8") as file:
        encoder = bpe.Encoder(file.read())
    for name, i in random.Random(3).sample(sorted(encoder.vocab.items()), 3000):
        if name.endswith("</w>"):
            assert encoder.piece(name[:-4]) == [i]


def test_packing_matches_the_library(spark):
    texts = [t.replace("<|startoftext|>", "") if t else t for t in awkward()] + ["der hund " * n for n in (200, 700, 1500)]
    library = Tokenizer.from_file(BYTES)
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, with_ids=True).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = found[found.doc_id == i].sort_values("piece")
        assert [*mine.length[1:]] == [1024] * (len(mine) - 1) and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            part = ids[r.start : r.start + r.length]
            assert [*r.ids] == part.tolist() and r.ids_crc32 == zlib.crc32(part.tobytes())
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert [*rows.offset] == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 1024
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 1024) + 2


def test_plans_cover_any_histogram():
    rng = np.random.default_rng(0)
    for _ in range(6):
        histogram = np.append(0, rng.integers(0, 30, 64)) * (rng.random(65) < rng.random())
        plan = packing.solve(histogram, 64, 50)
        covered = np.zeros(65, np.int64)
        for config, count in plan:
            assert sum(config) <= 64 and count > 0
            np.add.at(covered, list(config), count)
        assert (covered == histogram).all()
    assert packing.solve(np.zeros(65, np.int64), 64) == []
    assert sum(packing.knapsack(np.arange(1.0, 11.0), 10)) == 10


def test_tokens_of_hard_rows(hard, nothing):
    assert bpe.encode(hard, WORDS).count() == 12 and bpe.encode(nothing, WORDS).count() == 0
    packed = packing.pack(hard, BYTES).collect()
    assert sum(r.piece == 0 for r in packed) == 12 and packing.pack(nothing, BYTES).count() == 0
    assert {r.length for r in packed if r.doc_id in (3, 4)} == {1}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p><b>One<br>two<p>Three  &eacute;
four<script>var t="</p>";</script><!-- no --><div class="ad">Buy</div><form>Name<input></form><blockquote>Said</blockquote>
<section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; 1</footer></body></html>"""


def text_of(page, template=frozenset()):
    root = pages.parse(page)
    pages.hash_subtrees(root)
    return pages.main_text(root, set(template))


def test_article_of_a_page():
    assert text_of(PAGE) == "Head & tail\nOne two\nThree é four\nSaid"
    assert text_of("") == "" and text_of("plain &lt;text&gt;") == "plain <text>"
    assert text_of("<p>a<p>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table>") == "a\nb\nc\nd\ne\nf"
    assert text_of("<article>" + "<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("wrapper", [
    "div class='layout has-sidebar'", "body class='menu-open'><div class='no-sidebar'", "form id=aspnetForm", "div class=sidebar", "header", "aside"])
def test_wrappers_of_the_article_stay(wrapper):
    teaser = "<div class='related'><article>Teaser</article></div>"
    page = f"<{wrapper}><nav>Menu</nav><article><h1>A</h1><section class='related-work'>B</section><div id='social-history'>C</div>" \
           f"<div class='share-buttons'>D</div></article>{teaser}"
    assert text_of(page) == "A\nB\nC"


def test_forms_around_a_whole_page_stay():
    assert text_of("<body><form id=f><nav>Menu</nav><div>Text</div></form></body>") == "Text"
    assert text_of("<p>Note</p><form><h1>A</h1><p>Text</p></form>") == "Note\nA\nText"
    assert text_of("<p>Text</p><form>Name<input></form>") == "Text" and text_of("<div hidden><article>x</article></div>") == ""


def test_subtrees_on_many_pages_of_a_host_are_deleted(spark):
    body = "<body><div><p>Our shop since 1990</p></div><div><p>Story {0}</p><p>Text {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", body.format(i)) for i in range(8)] + [(100 + i, f"http://b.example/{i}", body.format(0)) for i in range(8)]
    rows += [(200, None, None), (201, "http://a.example/", ""), (202, "http://c.example/x", body.format(9))]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story 3\nText 3" and found[200] == found[201] == ""
    assert found[100] == "Our shop since 1990\nStory 0\nText 0"  # copies of one page are no template
    assert found[202] == "Our shop since 1990\nStory 9\nText 9"
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string, text string, host string")).count() == 0


def test_boxes_in_many_articles_and_templates_of_a_section_are_deleted(spark):
    article = "<article><h1>Story {0}</h1><div class=bio><p>By our staff</p></div><p>Quoted</p><div>Body {0}</div></article>"
    rows = [(i, "http://a.example/", article.format(i)) for i in range(25)]
    rows += [(100 + i, "http://b.example/", f"<p>{i}</p><article><div>Same</div></article>") for i in range(25)]  # one article on many pages
    rows += [(200 + i, "http://c.example/", f"<div>Page {i}</div>" + "<div>Section</div>" * (i < 60)) for i in range(400)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story 3\nQuoted\nBody 3" and found[103] == "Same" and found[203] == "Page 3"


@pytest.mark.parametrize("pages_of_host", [19, 25, 10_000])
def test_content_that_recurs_elsewhere_stays(spark, pages_of_host):
    table = "<table><tr><td>Yes</td><td>No</td></tr></table>"
    rows = [(i, "http://a.example/", f"<article><h1>Story {i}</h1>{table}<div>Body {i}</div></article>") for i in range(pages_of_host)]
    rows += [(20_000 + i, "http://b.example/", f"<h2>{'Introduction' if i < 10 else i}</h2><p>Yes.</p><div>Body {i}</div>") for i in range(40)]
    rows += [(30_000 + i, "http://d.example/", f"<div>{'Same' if i < 60 else i}</div><div>Body {i}</div>") for i in range(pages_of_host * 2)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(found[i] == f"Story {i}\nYes\nNo\nBody {i}" for i in range(pages_of_host))
    assert found[20_003] == "Introduction\nYes.\nBody 3"
    if pages_of_host > 100:  # one filling of a place among many
        assert found[30_003] == "Same\nBody 3"


def test_templates_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        parts = [f"<div class=c{rng.randint(0, 2)}><p>{rng.choice(['x', 'y', i])}</p></div>" for _ in range(rng.randint(0, 4))]
        body = "".join(parts)
        rows.append((i, f"http://{rng.choice('ab')}.example/", f"<article>{body}</article>" if rng.random() < 0.4 else body))
    rows += rows[:50] + [(None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    on: dict = {}
    for _, url, page in rows:
        root = pages.parse(page or "")
        pages.hash_subtrees(root)
        for part, place, article in pages._candidates(root):
            own = article.hash if article else page
            on.setdefault((url[7:16], place), {}).setdefault(part.hash, set()).add(own)
    wanted = {(host, place, part) for (host, place), parts in on.items() for part, marks in parts.items()
              if len(marks) >= (20 if place & 1 else 5) and len(marks) >= 0.5 * len(set().union(*parts.values()))}
    found = {tuple(r) for r in pages.templates(pages.listed(frame)).collect()}
    assert found == wanted and len(found) > 1
    sent, joined = ([tuple(r) for r in pages.extract(frame, broadcast=n).collect()] for n in (10_000, 0))
    assert sorted(sent, key=str) == sorted(joined, key=str) and len(sent) == 351


def test_headers_and_quotes_of_an_article_stay():
    page = "<header>Site</header><article><header><h1>Title</h1></header><p>a</p><aside><blockquote>Said</blockquote></aside>" \
           "<aside class=pullquote>Short</aside><aside>More links</aside><header class=banner>Buy</header><footer>By</footer></article>"
    assert text_of(page) == "Title\na\nSaid\nShort"


def test_parsing_is_linear():
    began = time.perf_counter()
    assert text_of("<div>" * 16_000 + "x" + "</b></p></article>" * 16_000) == "x"
    assert text_of("<p><td><li><ul>" + "<b>" * 16_000 + "<li>x</li></em>" * 16_000) == "\n".join("x" * 16_000)
    assert time.perf_counter() - began < 4


def test_two_tokenizers_in_one_session(spark, tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        other = json.load(file)
    vocab = other["model"]["vocab"]
    vocab["the</w>"], vocab["house</w>"] = vocab["house</w>"], vocab["the</w>"]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(other, file)
    frame = spark.createDataFrame([(1, "the old house")], "doc_id long, text string").coalesce(1)
    for file in (WORDS, path, WORDS):
        ids = Tokenizer.from_file(file).encode("the old house", add_special_tokens=False).ids
        assert bpe.encode(frame, file, with_text=True).first().ids == " ".join(map(str, ids))


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(4)
    full = [[(t, rng.choice(["user", "assistant"]), f"{c}-{t}" if t else rng.choice(["hi", "hello"])) for t in range(rng.randint(1, 9))] for c in range(30)]
    chats = full + [c[: rng.randint(1, len(c))] for c in full for _ in range(2)] + [[(t, "user", f"long {t}") for t in range(700)], [(t, "user", f"long {t}") for t in range(300)]]
    rng.shuffle(chats)
    return dict(enumerate(chats))


def test_snapshots_collapse_into_the_longest(spark, chats):
    rows = [(i, *turn) for i, turns in chats.items() for turn in turns]
    extra = [(None, 0, "user", "x"), (5000, None, "user", "y"), rows[0], (6000, 0, None, None)]
    frame = spark.createDataFrame(rows + extra, "conv_id long, turn int, role string, text string")
    everything = {i: tuple(t) for i, t in chats.items()} | {6000: ((0, "", ""),)}
    proper = {t[:k] for t in everything.values() for k in range(1, len(t))}
    wanted = {}
    for i, turns in sorted(everything.items()):
        if turns not in proper:
            wanted.setdefault(turns, i)
    found = conversations.render(frame).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in found} == set(wanted.values())
    for turns, i in wanted.items():
        text = "".join(r.text for r in found if r.conv_id == i)
        assert text == "".join(f"<|{role}|>\n{said}<|end|>\n" for _, role, said in turns)
        assert sum(r.n_turns for r in found if r.conv_id == i) == len(turns)
    assert conversations.render(spark.createDataFrame([], "conv_id long, turn int, role string, text string, part int")).count() == 0
