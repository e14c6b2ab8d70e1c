"""HTML extraction, chat formatting, the pipeline."""

import collections
import html
import re

import pyarrow.parquet as pq

import corpus_pipeline
from supplyrisk.llm import chat, extract_html, queries
from supplyrisk.llm.extract_html import main_text

from ..conftest import SF_SMALL
from . import brute

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>My Site</h1><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></header>
<div class="cookie-notice"><p>We use cookies, is that fine with you, dear reader?</p></div>{body}
<aside><p>Side text that is long, and has punctuation.</p></aside><form><label>Name</label><input></form>
<section id="comments"><article class=comment><p>I, as a reader, disagree with all of this.</p></article></section>
<!-- <p>hidden, text.</p> --><footer>&copy; c. All, of, it.</footer></body></html>"""
TEXT = ("<h2>Real\n title</h2><p>First &amp; best <b>para</b>graph, with some text; and more.<p>Second para&nbsp;graph "
        "here.<br>It is long enough, really!<ul><li>Item one<li>Item two</ul>")
WANT = ("Real title First & best paragraph, with some text; and more. Second para graph here. It is long enough, "
        "really! Item one Item two")


def test_main_text_of_layouts():
    for body in (f"<article>{TEXT}</article>", f"<main><div id=content>{TEXT}</div></main>", f"<div id=content>{TEXT}</div>",
                 f"<article><header><h2>Real title</h2></header>{TEXT.split('</h2>')[1]}</article>"):
        assert main_text(PAGE.replace("{body}", body)) == WANT, body


LONG = "A long paragraph of the story, with commas, stops and more. It goes on; it has an end. " * 4


def test_the_ratios_decide(monkeypatch):
    """Without smoothing a short part between rich ones is lost; without the threshold a poor part comes in."""
    page = (f"<body><div id=story><p>{LONG}</p><div class=k>Short part</div><p>{LONG}</p>"
            "<div class=z>poor</div><p>Last, a line.</p></div></body>")
    plain = page.replace("<div class=k>Short part</div>", "")
    assert "Short part" in main_text(page)
    far = page.replace("<div class=z>", "<span>x</span><section class=y>mid</section><div class=z>")
    assert "poor" not in main_text(far) and "Last, a line." in main_text(far)
    assert "poor" in " ".join(b.text for b in extract_html.content(extract_html.parse(far), share=0.0))
    monkeypatch.setattr(extract_html, "smoothed", lambda paths: {p: r.fused for p, r in paths.items()})
    assert "Short part" not in main_text(page) and main_text(plain).count(LONG.strip()) == 2


def test_pages_without_the_usual_marks():
    story = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Title {LONG}{LONG}".strip()
    teasers = "<article><h3>Teaser</h3><p>Read on.</p></article><article><p>More, here.</p></article>"
    assert main_text(f"<body>{teasers}<div id=content>{story}</div>{teasers}</body>") == want
    assert main_text(f"<body><div><a href=x>Home</a> <a href=y>News</a></div><table><tr><td>{story}</td><td><ul><li><a>l</a></ul></td></tr></table>"
                     "<div>Small print</div></body>") == want
    assert main_text(f"<body><div class='sidebar-left'><p>{LONG}</p></div><section class=x1>{story}</section></body>") == want


def test_labels_name_furniture_only_as_whole_words():
    kept = ["share-price", "related-work", "comments-on-law", "has-sidebar", "shareholders", "promoters", "alert-level-study"]
    lost = ["share", "related-posts", "comment-list", "ad-slot-12", "reader-comments", "newsletter_box", "social share-buttons"]
    for label in kept:
        assert "marked words, here" in main_text(f"<article><p>{LONG}</p><div class='{label}'><p>marked words, here</p></div></article>"), label
    for label in lost:
        assert main_text(f"<article><p>{LONG}</p><div class='{label}'><p>{LONG} marked words, here</p></div></article>") == LONG.strip(), label
    inner = "<p>Let <math><mi>x</mi> = 1</math> be, <noscript>and</noscript> <object>so</object> on.</p>"
    assert main_text(f"<article><p>{LONG}</p>{inner}</article>").endswith("Let x = 1 be, and so on.")


def test_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<p>cut off in a tag, here <a href='x") == "cut off in a tag, here"
    assert main_text("<article><p>an &lt;escaped&gt; tag &#233; &am</article>") == "an <escaped> tag é &am"
    assert len(main_text("<article>" + "<div>" * 3000 + "<p>deep text, here." + "<b>" * 20000)) == len("deep text, here.")
    assert main_text("<article><p>" + "word, " * 200_000).count("word") == 200_000


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é text</p></article>", "x"), (2, None, None, "x"), (2, "v", "", "x"), (None, "w", "<p>y", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_html.extract(table).collect()), key=str)
    assert got == sorted([(1, "u", "é text", 6), (2, None, "", 0), (2, "v", "", 0), (None, "w", "y", 1)], key=str)
    assert extract_html.extract(table.limit(0)).count() == 0


def test_page_query_returns_the_articles(spark):
    pages = {r["page_id"]: r["html"] or "" for r in pq.read_table(f"{SF_SMALL}/pages.parquet").to_pylist()}
    for r in queries.op1_html(spark, SF_SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)
        plain = re.sub(r"<[^>]*(>|\Z)", " ", re.sub(r"</?b>", "", article[1])) if article else ""
        assert (r.text, r.n_chars) == (" ".join(html.unescape(plain).split()), len(r.text))


def _expected(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), brute.sha(loss))
    return out


def test_chat_round_trip(spark):
    nasty = ["", "\\", "<", "\\l<\\b\\\\n", "<|end|>\n<|start|>assistant\nx<|next|>", "é\n\n<|end|>", "\\### Assistant: </turn> ok"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in nasty for r in ("assistant", "user", "assistant"))]
    rows += [(2, 5, "a\nb<", "x"), (2, 5, "a\nb<", "x"), (2, None, None, None), (None, 1, "assistant", "null id"), (3, 1, "user", "")]
    rows += [(4, i, "assistant" if i % 3 else "user", f"turn é {i} <") for i in range(700)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int").repartition(3)
    out = chat.format_conversations(table)
    got = {}
    for r in out.select("conv_id", "formatted", "loss_mask", chat.read_back(out["formatted"]).alias("turns"),
                        chat.loss_text(out["formatted"], out["loss_mask"]).alias("loss")).collect():
        got[r.conv_id] = (len(r.turns), brute.sha("".join(f"{t.role}\n{t['text']}\n" for t in r.turns)), len(r.loss), brute.sha(r.loss))
        assert r.formatted.count("<|start|>") == r.formatted.count("<|end|>\n")
    assert got == _expected(rows)
    merged = out.filter("conv_id = 4").first()["formatted"]
    assert merged.count("<|start|>") == 467 and merged.count("<|next|>") == 233
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/conversations.parquet").to_pylist()]
    probe = "\\### Assistant: </turn> ok"
    want = _expected([*rows, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, SF_SMALL).collect()}
    assert got == want


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [r["text"] for r in pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pylist()]
    columns, before = docs.columns, {r.doc_id: r["text"] or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), name=name)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before) and all(r.n_chars == len(r["text"]) for r in rows)
        if name == "quality_rules":
            assert not any(brute.quality(before[d])[-1] for d in after)
            assert len(after) > 0.6 * len(before)
        elif name == "near_duplicates":
            comps = brute.components({d: brute.shingle_set(t) for d, t in before.items()})
            assert after == {d: before[d] for d, c in comps.items() if d == c}
        elif name == "benchmark_decontamination":
            assert not any(q in t for t in after.values() for q in bench)
            assert all(any(q[:60] in before[d] or q[-60:] in before[d] for q in bench) for d in set(before) - set(after))
        else:
            assert set(after) == set(before)
            assert all(brute.secrets(after[d])[0] == [0, 0, 0] for d in after)
            assert all(after[d] == before[d] for d in after if brute.secrets(before[d])[0] == [0, 0, 0])
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 2048)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).columns[:3] == ["doc_id", "piece", "start"]
