import random

import pandas as pd
import pytest

import sitesignal.llm.quotes as quotes
from sitesignal.llm import html_extract, langid, quality
from sitesignal.llm.html_extract import extract_text, main_text
from sitesignal.llm.queries import ORACLES, QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head><body class="has-sidebar"><header><p>Site name, a slogan, more.</p></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, for you.</p></div>
<%s><h1>Head&amp;line &lt;1&gt;</h1><p>First   paragraph, with
 <b>bold</b> text, and more of it.<p>Second one; it is open, too.<ul><li>An item<li>Another, item</ul><p>Short.</p><form><p>Your name, please:</p></form>
<div class="ad">Buy, now!</div><blockquote>A quote, said someone.</blockquote></%s><aside><p>Related, stories, here.</p></aside>
<section id="comments"><p>Nice article, I think, thanks.</p></section><footer>&copy; Me, 2024.</footer></body></html>"""
TEXT = "Head&line <1>\nFirst paragraph, with bold text, and more of it.\nSecond one; it is open, too.\nAn item\nAnother, item\nShort.\nA quote, said someone."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_the_article_and_nothing_else(tag):
    assert main_text(PAGE % (tag, tag)) == TEXT


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><nav>x, y.</nav></html>") == ""
    assert main_text("Just, text.") == "Just, text."
    assert main_text("<p>One &eacute;&#233; &nbsp; two</p><p>3 < 4 & 5</p>") == "One éé two\n3 < 4 & 5"
    assert main_text("<div><p>a, <!-- no --> b.</p><script>x<y</script></div><textarea>no</textarea>") == "a, b."
    assert main_text("<article><h1>T</h1><p>" + "Long, text. " * 2000 + "</p></article>").endswith("text.")
    assert main_text("<p " + "\"" * 3 + ">x, y.</p>") in ("x, y.", "")


@pytest.mark.parametrize("name, stays", [("sidebar-content", False), ("content has-sidebar", True), ("article-header", True), ("page-header", False), ("sponsored-content", False), ("post-navigation", False), ("cookieBanner", False), ("ad-slot", False), ("readable", True), ("commentList", False)])
def test_names_that_say_what_an_element_is(name, stays):
    page = f'<div id="x"><p>A paragraph, of some length, that is the article.</p><div class="{name}"><p>Something else, of some length.</p></div></div>'
    assert ("Something else" in main_text(page)) is stays


def test_op7_gives_the_articles(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op7_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (2, "u", "<p>a, b.</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in extract_text(df).where("page_id = 2").collect()) == [(2, "u", "a, b.", 5)]
    assert extract_text(df).count() == 3 and extract_text(df.where("page_id > 2")).count() == 0
    assert html_extract.LAMBDA > 0


def test_op8_matches_sql(same):
    same(QUERIES["op8_quotations"], ORACLES["op8_quotations"])


def test_quotes_against_sql(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(quotes, "STRETCH", 4)
    rng, rows = random.Random(3), []
    for c in range(25):
        said = []
        for t in range(rng.randrange(1, 14)):
            own = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(6)) for _ in range(rng.randrange(0, 4))]
            if rng.random() < 0.2:
                own = [rng.choice(["yes", "No", "friday 3pm"])]
            quoted = []
            if said and rng.random() < 0.6:
                o = rng.choice(said)
                quoted = ["On Monday X wrote:"] * rng.randrange(2) + ["> " + rng.choice([x, x.upper()]) for x in o[: rng.randrange(1, len(o) + 2)]]
                quoted += [">> " + said[0][0]] if said[0] else []
            said.append(own)
            rows.append((c, t, rng.choice(["user", "assistant", None]), "\n".join(quoted + own) if rng.random() < 0.95 else None))
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.register("conversations", frame)
    want = con.sql(ORACLES["op8_quotations"]).df()
    plain = lambda df: sorted(tuple("-" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(want.columns)].astype(object).to_numpy())
    assert plain(got) == plain(want) and got.linked.sum() > 20 and (got.branch != 0).sum() > 20


def test_short_quotes(spark):
    """A short quote links to a message that says just that, not to one of whose lines it is."""
    rows = [(1, 0, "user", "Friday 3pm"), (1, 1, "user", "no\nand some more words"), (1, 2, "user", "that is a long enough line"), (1, 3, "user", "> friday  3pm\nfine"), (1, 4, "user", "> no\nwhy?"), (2, 0, "user", "a"), (2, 1, "user", "a"), (2, 2, "user", None), (2, 3, "user", ">\n> a\nb")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.linked) for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == (0, True) and got[1, 4] == (3, False) and got[2, 3] == (1, True)


def test_repeated_turns_and_long_texts(spark):
    long = "word " * 200_000 + "end of it all"
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "an answer of some length"), (1, 1, "assistant", "another answer, to the same"), (1, 2, "user", "> another answer, to the same\nthanks"), (1, 3, "user", "> " + long + "\nagain")]
    out = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.turn, r.text[:20]): (r.parent_turn, r.linked, r.branch, r.position) for r in out}
    assert len(out) == 6 and got[2, "thanks"][:2] == (1, True) and got[3, "again"][:2] == (0, True)
    assert got[1, "an answer of some le"] == got[1, "another answer, to t"]


def test_conversation_with_a_fork(spark):
    first, second = "the first message of all, rather long", "a second message, that is long as well"
    rows = [(1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", f"On Mon Ann wrote:\n> {first}\nI answer the first"), (1, 3, "user", f"> {second.upper()}\n>> {first}\nand I the second"), (1, 4, "user", "> yes\nno quote of worth"), (None, 4, "user", "x"), (2, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, own string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(df).collect()}
    assert [(got[1, t].parent_turn, got[1, t].linked, got[1, t].branch, got[1, t].position) for t in range(5)] == [(None, False, 0, 1), (0, False, 0, 2), (0, True, 2, 1), (1, True, 0, 3), (3, False, 0, 4)]
    assert got[1, 2].text == "I answer the first" and got[1, 3].text == "and I the second" and got[1, 3].chat == "<|user|>\nand I the second"
    assert got[None, 4].position == 1 and got[2, None].text == "" and got[2, None].role == "user"
    assert quotes.link_quotations(df.where("turn > 9")).count() == 0


def test_op9_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, folder).collect()]
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_against_a_plain_version(spark):
    """Vectors built n-gram by n-gram from the letters' vectors, for texts of one batch and of texts longer than one."""
    import numpy as np

    rng = random.Random(4)
    words = {"aa": ["der", "die", "und", "straße"], "bb": ["the", "of", "and", "thing"], "cc": ["日本", "語の", "文章"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 40))) + rng.choice(["", "!!", " 12 "]), lang) for k in range(60) for lang in [rng.choice(sorted(words))]]
    rows += [(60, "der the und " * 3, None), (61, "Ω", None), (62, "The OF", None)]
    made = langid.Profiles()

    def vector(text):
        total = np.zeros(langid.DIMS)
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" ")) + " "
        while "  " in clean:
            clean = clean.replace("  ", " ")
        for i in range(len(clean) - 2):
            v = np.ones(langid.DIMS)
            for place, c in enumerate(clean[i : i + 3]):
                v *= np.roll(made.letter(ord(c)), 2 - place)
            total += v
        return total / np.linalg.norm(total)

    learned = {}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in df.where(langid.held_out()).collect()}
    for k, text, lang in rows:
        if lang and k not in held:
            learned[lang] = learned.get(lang, 0) + vector(text)
    learned = {lang: v / np.linalg.norm(v) for lang, v in sorted(learned.items())}
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    for k, text, _ in rows:
        cosine = {lang: float(p @ vector(text)) for lang, p in learned.items()}
        best = max(cosine, key=cosine.get)
        assert got[k].lang_pred == best and abs(got[k].score - max(0.0, cosine[best])) < 1e-4


def test_scores_against_a_plain_version(spark):
    """Table look-ups one by one, for the model that the operator has fitted."""
    import math

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    place = lambda cut, v: sum(1 for c in cut if c <= v)
    for r in quality.score(docs, model).collect():
        x = quality.features(texts[r.doc_id])
        total = model.base + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True))
        total += sum(t[place(ci, x[i]), place(cj, x[j])] for i, j, ci, cj, t in model.pairs)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


def test_languages_of_odd_rows(spark):
    rows = [(i, "der und die das " * 3, "de") for i in range(8)] + [(i, "the and of that " * 3, "en") for i in range(8, 16)] + [(20, None, "de"), (21, "123 !!", "en"), (22, "", None), (23, "Die und", None), (None, "the of", None), (24, "ß" * 200_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(df).collect()}
    assert got[20] == got[21] == got[22] == ("und", 0.0) and got[23][0] == "de" and got[None][0] == "en"
    nothing = {r.lang_pred for r in langid.language_id(df.where("lang IS NULL")).collect()}
    assert nothing == {"und"} and langid.language_id(df.where("doc_id > 99")).count() == 0


def test_op10_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    again = {r.doc_id: r.score for r in QUERIES["op10_quality"](spark, folder).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_quality_of_odd_rows(spark):
    good, bad = "Some words make a sentence. Others follow it.", "BUY!! NOW!! BUY!! NOW!!"
    rows = [(i, good + f" And {i}." if i % 2 else bad + f" {i}!!") for i in range(200)] + [(300, None), (301, ""), (302, " "), (303, "x" * 300_000), (None, good), (1, good)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, predicted int, x double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(5, None, None), (None, 1, 0), (5, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 1)
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.schema == docs.schema and kept.count() < len(rows)
    none = quality.train(docs, labels.where("doc_id > 9999"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.train(docs, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality.score(docs, one).collect())
    assert quality.score(docs.where("doc_id > 9999"), model).count() == 0


def test_title_byline_and_short_sections_beside_the_container_stay():
    from sitesignal.llm.html_extract import main_text

    long = "".join(f"<p>A sentence, number {k}, that is part of a long body of text. It goes on, and on.</p>" for k in range(20))
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Part number {k} of the site</a></li>" for k in range(12)) + "</ul>"
    page = lambda body: main_text(f"<html><body><div>{menu}</div>{body}</body></html>").split("\n")
    post = page(f"<div class=post><h1>The title</h1><p>By Ann</p><div class=body>{long}</div><p><a href=/t>tag</a></p></div>")
    assert post[:2] == ["The title", "By Ann"] and len(post) == 22
    for tag in ("section", "blockquote", "div"):
        parts = page(f"<div><{tag}><h2>One</h2>{long}</{tag}><{tag}><h2>Two</h2><p>A short one.</p></{tag}></div>")
        assert parts[0] == "One" and parts[-2:] == ["Two", "A short one."] and len(parts) == 23
    table = page(f"<div><p>Before it.</p><table><tr><td>{long}</td></tr></table><p>After it.</p></div>")
    assert table[0] == "Before it." and table[-1] == "After it." and len(table) == 22


PLAIN = """<html><body><div><div><div><a href=/1>Start</a></div><div><a href=/2>Places and people</a></div><div><a href=/3>About it</a></div></div>
<div><div><div>Some words of the site that stand above everything</div><div>Tuesday the fourth</div><div>Edition number seven</div></div>
<div><div><h2>A title of the text</h2><div>By Ann Other</div>%s</div></div>
<div>%s</div></div><div><div>All kinds of rights</div><div>Made by some people</div><div>Written in the hills</div></div></div></body></html>"""


def test_ratios_select_where_names_say_nothing(monkeypatch):
    said = [f"A sentence, number {k}, that is part of a long text. It goes on, and on; then it ends, with a full stop." for k in range(12)]
    beside = [f"<div><div>Short words of place {k} that nobody reads</div></div>" for k in range(30)]
    page = PLAIN % ("".join(f"<p>{x}</p>" for x in said), "".join(beside))
    want = "\n".join(["A title of the text", "By Ann Other", *said])
    assert main_text(page) == want
    # it is the ratios that do it: without them the page's other text comes along
    monkeypatch.setattr(html_extract, "content_paths", lambda blocks: ({b.path: 1.0 for b in blocks}, 0.0))
    assert main_text(page) != want and "nobody reads" in main_text(page)


def test_very_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>Some text, that is deep, and goes on.</p>" + "</div>" * 3000
    assert main_text(deep) == "Some text, that is deep, and goes on."
    long = "<div>" + "".join(f"<p>Paragraph {k}, with a comma, and a stop.</p>" for k in range(5000)) + "</div>"
    assert main_text(long).count("\n") == 4999
