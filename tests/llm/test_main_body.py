import pytest
from pyspark.sql import functions as F

from textloom.llm import main_body as rules
from textloom.llm.main_body import BAD, GOOD, OPEN, block_labels, html_blocks, key_of, line_labels, main_body, mark_furniture, nearest, text_label

PAGE = """<!DOCTYPE html><html lang="en"><head><title>x</title><script>var t='<p>no</p>';</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/f">Forum</a></li></ul></nav>
<article><h1>How the planner works</h1><div class="meta"><p>By Ann Example</p><span>Views: 3</span></div>
<p>The planner reads all of the open requests and it stores them for the next run of the queue.</p>
<h2>In short</h2><p>This site uses cookies, says the text, and the planner merges <a href="/x">the results</a> for each of the users.</p>
<pre><code>run(limit=3)</code></pre><blockquote>Short words.</blockquote>
<div class="q7"><p>The information on this page is provided without any warranty and may change at any time.</p></div>
<div class="share"><button>Share this article</button></div></article>
<div class="box"><h3>2 comments</h3><p>I do not agree with the planner, as it is far too slow for the most of us.</p></div>
<footer><p>© 2025 Example</p><a href="/t">Terms of use</a></footer></body></html>"""
LINES = [
    ("Home", BAD), ("Forum", BAD), ("How the planner works", GOOD), ("By Ann Example", BAD), ("Views: 3", BAD),
    ("The planner reads all of the open requests and it stores them for the next run of the queue.", GOOD), ("In short", GOOD),
    ("This site uses cookies, says the text, and the planner merges the results for each of the users.", GOOD), ("", 0), ("run(limit=3)", GOOD), ("Short words.", GOOD),
    ("The information on this page is provided without any warranty and may change at any time.", BAD), ("Share this article", BAD), ("2 comments", BAD),
    ("I do not agree with the planner, as it is far too slow for the most of us.", BAD), ("© 2025 Example", BAD), ("Terms of use", BAD),
]
CONTENT = "\n".join(line for line, _ in LINES)


PROSE = "The planner reads all of the open requests and it stores them for the next run of the queue. "
NAMES = "Alpha42 Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliett Kilo Lima Mike November Oscar Papa Quebec "


def test_a_long_block_is_judged_as_a_whole():
    assert text_label(NAMES * 3 + PROSE * 20) == GOOD  # opens with over 300 characters of names
    assert text_label(PROSE * 4 + NAMES * 40) == 0


def test_blocks_with_a_common_opening_have_labels_of_their_own():
    same = PROSE * 3
    assert key_of(same + "One.") != key_of(same + "Two.")
    page = f"<body><article><h1>How the planner works</h1><p>{same}One.</p></article><footer><p>{same}Two.</p></footer></body>"
    lines = ["How the planner works", f"{same}Two.", f"{same}One."]
    assert line_labels("\n".join(lines), page, None) == [GOOD, BAD, GOOD]


def test_a_block_that_the_html_cuts_off_still_has_its_line():
    page = f"<body><article><h1>How the planner works</h1><p>{PROSE}</p></article><footer><p>{PROSE * 2}The plan"
    assert line_labels(f"How the planner works\n{PROSE}\n{PROSE * 2}The planner ends.", page, None) == [GOOD, GOOD, BAD]


def test_page_with_html():
    assert line_labels(CONTENT, PAGE, None) == [label for _, label in LINES]


def test_page_without_html_but_title():
    """By text alone a short sentence about cookies counts as a notice, and short lines go with their neighbours."""
    labels = dict(zip((line for line, _ in LINES), line_labels(CONTENT, None, "How the planner works")))
    unsure = {LINES[7][0], "run(limit=3)", "Short words."}
    assert {line for line, want in LINES if want and labels[line] != want} <= unsure


@pytest.mark.parametrize("cut", [200, 700, 1100, 1500])
def test_cut_html_still_labels_every_line(cut):
    labels = line_labels(CONTENT, PAGE[:cut], "How the planner works")
    assert len(labels) == len(LINES) and labels[8] == 0 and set(labels) <= {GOOD, BAD, 0}
    assert labels[0] == BAD and labels[5] == GOOD


def test_unclosed_tags():
    html = "<body><div id=menu><p>A / B / C</div><div class='post'><h1>Head of it</h1><p class=author><p>By Ann Example<div><span>Views: 3</span></div></p>" + "<p>The planner reads all of the open requests and it stores them for the next run." * 2 + "<h2>More</h2></div>"
    text = "A / B / C\nHead of it\nBy Ann Example\nViews: 3\nThe planner reads all of the open requests and it stores them for the next run.\nThe planner reads all of the open requests and it stores them for the next run.\nMore"
    assert line_labels(text, html, None) == [BAD, GOOD, BAD, BAD, GOOD, GOOD, GOOD]


def test_lists_of_links_in_the_body_stay():
    html = "<body><ul class=menu><li><a href=/>Home</a></li></ul><main><h1>Reading list</h1><p>The list below holds all of the pages that were read for the last of the runs.</p>"
    html += "<li><a href=/1>First – The planner reads all of the requests before the next batch and logs the time.</a></li><li><a href=/2>Second – short.</a></li></main>"
    text = "Home\nReading list\nThe list below holds all of the pages that were read for the last of the runs.\nFirst – The planner reads all of the requests before the next batch and logs the time.\nSecond – short."
    assert line_labels(text, html, None) == [BAD, GOOD, GOOD, GOOD, GOOD]


def test_blocks_of_nonsense_do_not_fail():
    for html in ("", "<", "<<<>>>", "plain", "<p", "</p></p></div>", "<a><b><i>", "<!-- never closed", "<script>x", "a < b > c", "<p>" * 3000):
        html_blocks(html)
        line_labels("one\ntwo", html, None)


def test_operator_edges(spark):
    schema = "web_id long, content string, raw_html string, title string, furniture_lines string, body string"
    rows = [(1, None, PAGE, None, "x", "y"), (2, "", None, None, "x", "y"), (3, CONTENT, PAGE, None, "x", "y"), (3, CONTENT, PAGE, None, "x", "y"), (4, "\r\n\n", "", "t", "x", "y"), (5, CONTENT + "\n" + "word " * 100_000, PAGE, None, "x", "y")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.web_id, None if r.furniture_lines is None else tuple(r.furniture_lines[:2])) for r in mark_furniture(df).collect()}
    assert (1, None) in got and (3, (1, 2)) in got and (2, ()) in got
    bodies = {r.web_id: r.body for r in main_body(df).collect()}
    assert bodies[1] is None and bodies[3].startswith("How the planner works") and "Terms" not in bodies[3]
    assert mark_furniture(df.limit(0)).count() == 0 and main_body(df).where(F.col("web_id") == 3).count() == 2


SHORT_BODY = "The planner reads all of the open requests before the next batch of the queue."
TAGS = " ".join(f"Tag{i}" for i in range(200))
TEASERS = "".join(f"<p><a href=/{i}>Why the planner keeps all of the requests for the next run {i}</a></p>" for i in range(20))


def _labels(inside):
    blocks = html_blocks(f"<body>{inside}</body>")
    return {text[:20]: label for (text, *_), label in zip(blocks, block_labels(blocks))}


def test_stop_word_density_decides(monkeypatch):
    page = f"<div class=a><p>{SHORT_BODY}</p><p>Short</p></div><div class=b><p>{TAGS}</p></div>"
    assert _labels(page) == {SHORT_BODY[:20]: GOOD, "Short": GOOD, TAGS[:20]: BAD}
    monkeypatch.setattr(rules, "density", lambda text: 1.0)
    assert _labels(page) == {SHORT_BODY[:20]: BAD, "Short": BAD, TAGS[:20]: GOOD}


def test_link_density_decides(monkeypatch):
    page = f"<div class=a><p>{SHORT_BODY}</p><p><a href=/>More</a></p></div><div class=b>{TEASERS}</div>"
    assert _labels(page) == {SHORT_BODY[:20]: GOOD, "More": BAD, "Why the planner keep": BAD}
    unlinked = page.replace("<a href=/>", "").replace("</a>", "")
    for i in range(20):
        unlinked = unlinked.replace(f"<a href=/{i}>", "")
    assert _labels(unlinked) == {SHORT_BODY[:20]: BAD, "More": BAD, "Why the planner keep": GOOD}


def test_length_decides():
    page = f"<div class=a><p>{SHORT_BODY * 3}</p><p>{SHORT_BODY * 3}</p></div><div class=b><p>{SHORT_BODY}</p></div>"
    assert _labels(page) == {SHORT_BODY[:20]: BAD} and block_labels(html_blocks(page)) == [GOOD, GOOD, BAD]


def test_open_blocks_take_the_nearest_decided_label():
    assert nearest([GOOD, OPEN, OPEN, OPEN, BAD]) == [GOOD, GOOD, GOOD, BAD, BAD]
    assert nearest([OPEN, BAD, OPEN]) == [BAD, BAD, BAD] and nearest([OPEN, OPEN]) == [GOOD, GOOD] and nearest([]) == []


def test_a_page_without_a_headline_still_has_a_body():
    page = PAGE.replace("<h1>How the planner works</h1>", "<p>How the planner works</p>")
    assert line_labels(CONTENT, page, None) == [label for _, label in LINES]
