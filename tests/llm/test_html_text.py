import random
import time

import pytest

from pathsieve.llm.html_text import Block, blocks_of, extract, first_pass, main_text, score, second_pass

PROSE = "The council said on Monday that it would open the bridge to all of the traffic before the end of the year, and that it is safe."


def test_article_without_its_surroundings():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><p>{PROSE}</p></header>
    <nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">{PROSE}</div>
    <article><h1>A bridge &amp; a road</h1><p>{PROSE}<p>It is&nbsp;open.<br>Now<script>var a="</p>"</script></article>
    <aside><p>{PROSE}</p></aside><div id="comments"><p>{PROSE}</p></div><form><p>{PROSE}</p></form><footer>&copy; x</footer>"""
    assert main_text(page) == f"A bridge & a road {PROSE} It is open. Now"


def test_blocks_without_containers_follow_density_and_neighbours():
    links = " ".join(f"<a href=/{i}>topic number {i}</a>" for i in range(9))
    page = f"<div>{links}</div><h2>Short head</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><div>{links}</div><div>Imprint</div>"
    assert main_text(page) == f"Short head {PROSE} Yes. {PROSE}"


def test_short_blocks_follow_the_nearest_decided_block():
    links = "".join(f"<li><a href=/{i}>topic number {i}</a></li>" for i in range(4))
    page = f"<ul>{links}</ul><p>Far</p><p>Near</p><p>Title</p><p>{PROSE}</p><p>After</p><p>Later</p><p>Menu</p><ul>{links}</ul>"
    labels = [(b.text, keep) for b, keep in zip(blocks_of(page), second_pass(blocks_of(page), first_pass(blocks_of(page))), strict=True) if len(b.text) < 8]
    assert labels == [("Far", False), ("Near", False), ("Title", True), ("After", True), ("Later", False), ("Menu", False)]


def test_names_are_evidence_but_links_and_words_decide():
    links = "".join(f"<li><a href=/{i}>topic number {i}</a></li>" for i in range(4))
    # links in an article go, although their container speaks for them; a comment goes for its name
    page = f'<article><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><ul>{links}</ul><div class="comments"><p>{PROSE} {PROSE}</p></div><p>{PROSE}</p></article>'
    assert main_text(page) == f"{PROSE} Yes. {PROSE} {PROSE}"
    # without their names, the same blocks are judged by what they hold
    assert main_text(page.replace(' class="comments"', "").replace("article", "section")) == f"{PROSE} Yes. {PROSE} {PROSE} {PROSE} {PROSE}"
    assert main_text(f"<p>{PROSE}</p><span class=ad>buy it</span> <p>{PROSE}</p>") == f"{PROSE} {PROSE}"


def slow_labels(blocks):
    """Both passes, block by block, as the module states them."""
    first = [True if score(b) >= 1 else False if score(b) <= 0 else None for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        section = [k for k, x in enumerate(blocks) if x.content == b.content]
        at = section.index(i)
        decided = [(abs(j - at), j > at, first[k]) for j, k in enumerate(section) if first[k] is not None and not blocks[k].named]
        near = [d for d in decided if d[0] == min(decided)[0]]
        if not near:
            out.append(True)
        elif len(near) == 1:
            out.append(near[0][2])
        elif b.heading:
            out.append([x for _, later, x in near if later][0])
        else:
            out.append((any if b.content else all)(x for *_, x in near))
    return out


def test_passes_against_brute_force():
    pick, words = random.Random(8), PROSE.lower().split() + ["xyz", "quux", "blat", "zorp"] * 4
    for _ in range(300):
        blocks = []
        for _ in range(pick.randint(0, 25)):
            text = " ".join(pick.choices(words, k=pick.choice([1, 2, 4, 9, 30, 80])))
            blocks.append(Block(text, pick.choice([0, 0, 0, len(text) // 5, len(text)]), pick.random() < 0.2, pick.random() < 0.5, pick.random() < 0.2))
        assert second_pass(blocks, first_pass(blocks)) == slow_labels(blocks)


@pytest.mark.parametrize("name", ["content with-sidebar", "has-sidebar", "page no-sidebar", "entry-content widget", "single-post comments-open", "post tags", "has-header"])
@pytest.mark.parametrize("title", ["<h1>Title</h1>", "<h2>Title</h2>", ""])
def test_names_of_wrappers_say_nothing(name, title):
    body = f'{title}<p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>'
    page = f'<body><nav><ul><li><a href="/">Home</a></ul></nav><div class="{name}">{body}</div><div class="comments"><p>{PROSE}</p></div></body>'
    if title == "<h1>Title</h1>":
        page = page.replace("</div></body>", f"<p>{PROSE} {PROSE} {PROSE}</p><p>{PROSE}</p></div></body>")
    assert main_text(page) == " ".join(["Title"] * bool(title) + [PROSE] * 3)


def test_names_inside_an_article():
    page = f'<article><div class="article-header"><h1>Title</h1><p>{PROSE}</p></div><header><p>{PROSE}</p></header><p>{PROSE}</p><div class="share"><p>{PROSE}</p></div></article>'
    assert main_text(page) == f"Title {PROSE} {PROSE}"
    # an advert that is longer than the article is no wrapper
    assert main_text(f'<div class="ad">{PROSE} {PROSE}</div><article><p>Yes. It is so.</p></article>') == "Yes. It is so."


def test_end_tags_take_linear_time():
    began = time.process_time()
    assert main_text("<p>" + "<b>" * 50_000 + "</i>" * 50_000 + "end") == "end"
    assert main_text("<b>" * 50_000 + "<p>x" * 5000) == " ".join(["x"] * 5000)
    assert time.process_time() - began < 20


def test_edges(spark):
    assert main_text(None) == main_text("") == ""
    assert main_text("a < b & c") == "a < b & c"
    assert main_text("<p>" + "x " * 200000).count("x") == 200000
    assert main_text("<article><p>cut off <b>he") == "cut off he"
    df = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in extract(df).collect()) == ["", "a", "a"]
    assert extract(df.limit(0)).count() == 0
