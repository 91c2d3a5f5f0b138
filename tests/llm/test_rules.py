import math
import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from waymill.llm import html_text, oracles, quality, secrets

from .conftest import sentence, texts_of


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered)


def test_measures_equal_plain_ones(docs):
    rows = texts_of(docs)
    for r in quality.judged(docs).collect():
        want = plain_measures(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("few", [0, 48])
def test_repeats_by_list_and_by_sort(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)] + ["a b c", "a b c a b c", "x " * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source")
    got = {r.doc_id: r.n_repeat_words for r in quality.measured(frame).collect()}
    assert got == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def boilerplate(spark):
    rng = random.Random(9)
    shared = [f"Subscribe to our newsletter part {c} " + sentence(rng, 60) for c in "abc"]
    own = lambda: [sentence(rng, 3) for _ in range(9)]  # noqa: E731  many lines of their own, but short ones
    rows = [(i, "\n".join([*shared, *own()]), "hot") for i in range(80)]
    rows += [(100 + i, "\n".join([shared[0], sentence(rng, 200), sentence(rng, 200)]), "hot") for i in range(30)]
    copied = sentence(rng, 90) + "\n" + sentence(rng, 90)
    rows += [(200 + i, copied, "hot") for i in range(60)]  # copies aren't common lines
    rows += [(300 + i, "\n".join([*shared, *own()]), "cold") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_depleted_documents_go(spark):
    got = {r.doc_id: r.kept for r in quality.judged(boilerplate(spark)).collect()}
    assert not any(got[i] for i in range(80))
    assert all(v for k, v in got.items() if k >= 100)


def test_verdicts_equal_sql(spark, tmp_path):
    frame = boilerplate(spark)
    frame.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d.parquet'")
    want = {r[0]: r[-1] for r in con.execute(oracles.QUALITY).fetchall()}
    assert {r.doc_id: r.kept for r in quality.judged(frame).collect()} == want


def test_documents_that_share_most_lines_count_apart(spark):
    rng = random.Random(11)
    shared = [sentence(rng, 4) for _ in range(60)]
    rows = [(i, "\n".join([*shared, sentence(rng, 12)]), "hot") for i in range(400)]
    copied = "\n".join(sentence(rng, 20) for _ in range(10))
    rows += [(1000 + i, copied, "hot") for i in range(400)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(400))
    assert all(got[1000 + i].kept for i in range(400))


def test_documents_with_one_line_of_their_own_are_depleted(spark):
    rows = []
    for seed in range(20):  # whichever of the lines has the least hash
        rng = random.Random(seed)
        shared = [f"Long line {c} of all pages of host {seed}: " + sentence(rng, 30) for c in "abc"]
        rows += [(1000 * seed + i, "\n".join([*shared, sentence(rng, 5)]), f"host{seed}") for i in range(200)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["source"]).collect()
    assert len(got) == 4000 and not any(r.kept or r.base_failed for r in got)
    assert {r.source for r in got} == {f"host{i}" for i in range(20)}


def test_few_words_left_are_depletion(spark):
    rng = random.Random(3)
    shared = "All of this is said on every page, " + sentence(rng, 12)
    rows = [(i, shared + "\n" + sentence(rng, 40 if i % 2 else 55), "h") for i in range(40)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.kept == (r.doc_id % 2 == 0) and not r.base_failed and r.removed_words == 20 for r in got.values())


def test_quality_of_odd_rows(odd, none):
    assert quality.judged(odd).count() == 6
    assert quality.judged(none).count() == 0


def base(text):
    out = []
    for k, (pattern, flags, group, least) in enumerate((
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), (r"AKIA[A-Z0-9]+", 0, 0, 16), (r"[0-9a-f]+", 0, 0, 32),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [(s, secrets.KINDS[k], e) for s, k, e in sorted(out)]


def test_patterns_equal_plain_ones(docs):
    extra = ["PassWord:'abcdefgh' api_key=12345678 apikey = xx", "toKen=abcdefgh", "secret=short token=longenough1", "f" * 31, "0" * 32 + "g" + "a" * 40, "AKIA" + "B" * 11, "éé AKIA" + "C" * 12]
    for text in [*texts_of(docs).values(), *extra]:
        assert [(s, k, e) for s, k, e, _ in secrets.matches(text)] == base(text)


def learnt():
    rng = random.Random(4)
    texts = []
    for i in range(150):
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        name = rng.choice(["token", "password", "secret"])
        texts.append(f"{sentence(rng, 20)} {name} = \"{hexes}\" {sentence(rng, 10)} call 4155550{i:03d} or id order-2024{i:04d}")
    return secrets.fitted([x for t in texts for x in secrets.labelled(t)]), rng


def test_field_finds_what_patterns_miss_and_spares_numbers():
    field, rng = learnt()
    key = "".join(rng.choice("0123456789abcdef") for _ in range(30))
    text = f"{sentence(rng, 10)} pwd is \"{key}\" and call 4155550199 about order-20240001"
    got = secrets.found(text, field)
    assert [(k, text[s:e]) for s, k, e, _ in got] == [("crf", key)]


def planted(rng, n):
    """(text, secret or None): secrets that no pattern finds, and numbers, addresses and long words that are none."""
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k))
    out = []
    for i in range(n):
        key = [hexes(28), mixed(32), mixed(24), hexes(30)][i % 4]
        lead = ['pwd is "{}"', "credentials: {}", "Authorization: Bearer {}", "private key {}"][i // 4 % 4].format(key)
        out.append((f"{sentence(rng, 25)} {lead} {sentence(rng, 25)}", key))
        other = ["call +1 (017) 555-7713 now", "mail jo.27@mail7.example.com", "host 97.51.17.173 port 8080", "card 9807915762804490", "Verwaltungsgerichtsbarkeitsgesetz", "order-20240117-001", "version 3.0.1", "at 10:45 = noon"][i % 8]
        out.append((f"{sentence(rng, 25)} {other} {sentence(rng, 25)}", None))
    return out


def learnt_mixed(rng):
    """A field learnt from secrets that the patterns find, among plain text."""
    texts = []
    for i in range(240):
        key = "".join(rng.choice("0123456789abcdef" if i % 2 else "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.choice([24, 32, 40])))
        lead = [f'token = "{key}"', f"password: {key}", f"api_key={key}", f"secret = '{key}'"][i % 4]
        texts.append(f"{sentence(rng, 40)} {lead} {sentence(rng, 20)}")
        texts.append(planted(rng, 1)[1][0])
    texts += [t for t, key in planted(rng, 40) if key is None]
    return secrets.fitted([x for t in texts for x in secrets.labelled(t)])


def test_recall_and_precision_on_secrets_that_patterns_miss():
    rng = random.Random(21)
    field = learnt_mixed(rng)
    hits = wrong = wanted = 0
    for text, key in planted(rng, 200):
        assert not secrets.matches(text)
        got = [text[s:e] for s, k, e, _ in secrets.found(text, field) if k == "crf"]
        wanted += key is not None
        hits += key in got
        wrong += sum(x != key for x in got)
    print("recall", hits / wanted, "precision", hits / max(1, hits + wrong))
    assert hits >= 0.9 * wanted
    assert hits >= 0.95 * (hits + wrong)


def test_plain_words_are_passed_over_without_loss(docs):
    """What the bound skips is outside of secrets by full decoding too, for learnt weights and for weights at random."""
    rng = random.Random(8)
    fields = [learnt_mixed(rng)]
    for seed in range(6):
        draw = np.random.default_rng(seed)
        weights = draw.normal(0, 1, (secrets.FEATURES, 3))
        weights[:, 0] += 1.0 + seed
        fields.append(secrets.Field(weights, draw.normal(0, 1, (3, 3))))
    assert fields[0].longest > 7 and {f.longest > 0 for f in fields} == {True, False}
    texts = [t for t, _ in planted(rng, 30)] + list(texts_of(docs).values())[:40] + ["key\u017f - x", "pa\u017fs word", "\u0130key = \" abc", "sig , ! hello", "x= \" ' word", "\u01c5abc \xb2\xb3 \u212aey abc"]
    for field in fields:
        full = secrets.Field(field.weights, field.steps)
        full.plain = None
        for text in texts:
            assert field.spans(text) == full.spans(text), text


def test_tokens_without_digits_can_be_secrets():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ") for _ in range(n))
    texts = [f"{sentence(rng, 30)} password = {word(24)} {sentence(rng, 10)}" for _ in range(150)]
    field = secrets.fitted([x for t in texts for x in secrets.labelled(t)])
    key = word(24)
    text = f"{sentence(rng, 10)} pwd = {key} {sentence(rng, 10)}"
    assert [(k, text[s:e]) for s, k, e, _ in secrets.found(text, field)] == [("crf", key)]


def test_remembered_parts_equal_single_ones(docs):
    field, rng = learnt()
    odd = ["pwd = \"ab12cd34ef56ab99\" - ab12cd34ef56ab99 = - ab12cd34ef56ab99", "key:\nab12cd34ef56ab99 key: ab12cd34ef56ab99", "-- = ab12cd34ef56ab99", " ab12cd34ef56ab99"]
    for text in [*texts_of(docs).values(), *odd, *odd]:
        own, want = [36 + k for k in secrets.file_features(text)], []
        for m in re.finditer(r"\S+", text):
            want += [(m.start() + s, m.start() + e) for s, e in field.part(text, m.start(), m.end(), own)]
        assert field.spans(text) == want


def test_viterbi_equals_all_paths():
    from itertools import product

    field, _ = learnt()
    for text in ["x=ab12cd34ef56.ab99 token=0123456789abcdef0123", "a 12345678:90ab12cd/ef56gh78 b"]:
        for _, columns, allowed in secrets.chains(text):
            scores = field.scores(columns, allowed)

            def value(path, scores=scores):
                return sum(field.steps[a, b] + scores[i, b] for i, (a, b) in enumerate(zip([0, *path], path, strict=False)))

            best = max(product(range(3), repeat=len(columns)), key=value)
            assert value(best) == pytest.approx(value(tuple(field.decode(columns, allowed))))


def test_scans_and_redaction(docs, odd, none):
    rows = texts_of(docs)
    for r in secrets.scanned(docs).collect():
        assert [(x.start, x.kind, x.end) for x in r.spans if x.kind != "crf"] == base(rows[r.doc_id])
    done = secrets.redacted(docs)
    assert done.columns == docs.columns
    for r in done.collect():
        assert "AKIAS" not in r.text and "24be6443" not in r.text and "hunter2" not in r.text
        assert r.lang == "en"
    assert secrets.scanned(odd).count() == secrets.redacted(odd).count() == 6
    assert secrets.scanned(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a></li></ul></nav><div class="cookie-notice">we use cookies</div>
<div id="page">{article}</div><aside>side <a href="x">links</a></aside><form><input><button>send</button></form>
<div class="comments"><p>I liked this a lot, thank you for the article, it is long.</p></div><footer>&copy; us</footer></body></html>"""
TEXT = ["A heading", "First paragraph with many words & a < b, it goes on for a while.", "Second one has a link and text enough to count for the density.", "item one of two", "item two of two", "Last paragraph, again with enough words to be part of it."]
INNER = "<h1>A heading</h1><p>First paragraph <b>with many</b>\n  words &amp; a < b, it goes on for a while.<p>Second one has <a href='y'>a link</a> and text enough to count for the density.</p><ul><li>item one of two<li>item two of two</ul><div class='ad'>buy this</div><p>Last paragraph, again with enough words<br>to be part of it."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='content'>{}</div>", "<main><section>{}</section></main>"])
def test_article_of_a_page(wrap):
    assert html_text.main_text(PAGE.format(article=wrap.format(INNER))) == "\n\n".join(TEXT)


def test_pages_without_an_article():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body><nav>x</nav></body></html>") == ""
    assert html_text.main_text("just &eacute; text") == "just é text"
    assert html_text.main_text("<p>open <b>tags <i>everywhere") == "open tags everywhere"
    assert html_text.main_text("<!-- never closed <p>x") == ""
    assert len(html_text.main_text("<div>" * 3000 + "deep words " * 50)) > 500


@pytest.mark.parametrize("n", [2, 3])
def test_pages_split_over_sibling_containers(n):
    texts = [f"Paragraph {i:02d} of the story, " + "with words enough to count for much, " * 7 for i in range(9 * n)]
    parts = ["<div>" + "".join(f"<p>{t}</p>" for t in texts[9 * i : 9 * i + 9]) + "</div>" for i in range(n)]
    want = "\n\n".join(" ".join(t.split()) for t in texts)
    assert html_text.main_text(f"<body><div>{''.join(parts)}</div></body>") == want
    deep = "<div class='advert'><a href='x'>buy this</a></div>".join(f"<div>{x}</div>" for x in parts)
    assert html_text.main_text(f"<body><div><div>{deep}</div></div></body>") == want


def test_densities_equal_plain_ones():
    page = "<div><h1>Head line</h1><p>Some <b>text</b> with <a href='x'>two links</a> and <a>another</a><p>More text here</div><div><a>menu entry</a></div>"
    root = html_text.parse(page)
    order = html_text.measure(root)
    chars = lambda x: sum(chars(y) if isinstance(y, html_text.Node) else len("".join(y.split())) for y in x.parts)
    below = lambda x: [y for y in x.parts if isinstance(y, html_text.Node)] + [z for y in x.parts if isinstance(y, html_text.Node) for z in below(y)]
    assert [x.tag for x in order if x.tag == "b"] == []
    body_links = sum(chars(y) for y in below(root) if y.tag == "a")
    for x in order:
        c, t = chars(x), max(1, len(below(x)))
        links = [y for y in [x, *below(x)] if y.tag == "a"]
        lc, lt = sum(map(chars, links)), max(1, len([y for y in below(x) if y.tag == "a"]))
        base = math.log(c / max(1, c - lc) * lc + body_links / chars(root) * c + math.e)
        want = c / t * max(0, math.log(max(1, c / max(1, lc) * t / lt)) / math.log(base + math.e - 1))
        assert x.density == pytest.approx(want)
        assert x.total == pytest.approx(sum(y.density for y in x.parts if isinstance(y, html_text.Node)))


LONG = "This paragraph has words enough to be a part of any article, and it goes on for quite a while longer."


@pytest.mark.parametrize("mark", ["share-price", "social", "related", "side", "notice"])
def test_classes_decide_nothing_alone_in_an_article(mark):
    page = f"<body><nav><a>x</a></nav><article><p>{LONG}</p><div class='{mark}'><p>{LONG} Second.</p></div><div class='{mark}'><a href=a>tell</a> <a href=b>others</a></div><p>{LONG} Third.</p></article></body>"
    assert html_text.main_text(page) == "\n\n".join([LONG, LONG + " Second.", LONG + " Third."])


def test_headings_go_with_their_text():
    page = f"<body><div class=x><h1>Short</h1><p>{LONG}</p></div><div><a>menu</a> <a>menu</a> <a>menu</a></div></body>"
    assert html_text.main_text(page) == f"Short\n\n{LONG}"


@pytest.mark.parametrize("tail", ['<a href="' + '"' * 10_001, "<a " + "'" * 10_001, "<div " + "a='x\" " * 5000, "<" * 10_000, "<!--" * 5000, "<a href=" * 5000])
def test_pages_cut_off_in_a_tag_take_no_longer(tail):
    began = time.perf_counter()
    assert html_text.main_text(f"<article><p>{LONG}</p></article>" + tail).startswith(LONG)
    assert time.perf_counter() - began < 1


def test_very_long_pages():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(page)) == 20_000 * (len(LONG) + 2) - 2


def test_pages_table(spark):
    frame = spark.createDataFrame([(1, "u", PAGE.format(article=f"<article>{INNER}</article>"), 5), (1, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text long")
    rows = html_text.extracted(frame).collect()
    assert [r.text for r in rows] == ["\n\n".join(TEXT), "", ""]
    assert html_text.extracted(frame.limit(0)).count() == 0


def test_texts_are_made_piece_by_piece():
    """A batch of many long texts is not held as strings in whole: only a piece of it is."""
    texts = [f"{i} " + "plain words " * 400 for i in range(4000)] + [None, "x" * (3 << 20), ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["_0", "_text"])
    tracemalloc.start()
    rows = 0
    for out in secrets.made(iter([batch]), 1, [("text", "string", pa.string())], lambda t: (t[::-1],)):
        want = [(i, (texts[i] or "")[::-1]) for i in out.column(0).to_pylist()]
        assert list(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == want
        assert out.column(0)[0].as_py() == rows
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 24 << 20  # all texts have 19 MB once, and would be held three times
