import time

import numpy as np
import pytest

from lumiform.llm import html

TREE = html.grow(*html.labelled_table())


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body><header class="site">Top</header><main><h1>Title</h1><p>a b c</p><div class="ad-box">Buy now great stuff</div><p>x &amp; y&nbsp;z</p></main><section id="comments"><p>I like this article very much</p></section><footer>f</footer>', "Title\na b c\nx & y z"),
        ('<script>var a="<p>no</p>"</script><style>p{}</style><!-- <p>no</p> --><p>unclosed <b>bold<p>second<br>line', "unclosed bold\nsecond line"),
        ("<article><p>Hello   world</p><form><label>Name</label></form><div class=comment>nope</div><p>&lt;b&gt;</p></article>", "Hello world\n<b>"),
        ("<article><p>One two three four</p><ul><li>x<li>y</ul></article>", "One two three four\nx\ny"),
        ("<div>a < b and c > d</div>", "a < b and c > d"),
        ('<article><p title="a>b">q <a href="/x">w</a></p></article><nav><a href="/">Home</a></nav>', "q w"),
        ("<article><p>area <math><mi>r</mi></math> and <svg><text>label</text></svg> <object>old</object></p><select><option>no</option></select></article>", "area r and label old"),
        ("<article><p>R&eacute;sum&#233; &#x263a; &zzz;</p></article>", "Résumé ☺ &zzz;"),
        ("<article><p class=\"it's\">one</p><p title='say \"x>'>two</p></article>", "one\ntwo"),
        ("", ""),
        ("<p", "<p"),
        ("<nav><a href=/>Home</a></nav>", ""),
    ],
)
def test_pages(page, text):
    assert html.main_text(page, TREE) == text


def test_the_tree_learns_its_table():
    x, y = html.labelled_table()
    assert len(y) > 1000 and (html.classify(TREE, x) == y).mean() > 0.99


def test_held_out_draws():
    x, y = html.labelled_table(seed=99, pages=600)
    assert (html.classify(TREE, x) == y).mean() > 0.98


# Pages labelled by hand, with no element or name that tells: + is the article, - isn't, [x] is a link. Each is a list of one-letter elements and texts.
BY_HAND = [
    """
    -d [Home] [World] [Sport] [Weather] [Contact us]
    +h The harbour that learned to wait
    +p For three winters nobody in the town believed that the ferry would come back, and yet every morning somebody swept the quay as if it might be needed before noon.
    +p The harbour master keeps two ledgers. One holds the arrivals that were announced, the other those that happened, and he says that only fools read them side by side.
    +p When the new boat finally turned the headland in [late April] the whole school had been let out, and the smallest children sat on the wall with their feet above the water.
    +p It carried eleven passengers, a crate of seed potatoes and a letter that had been written to a man who no longer lived there, which the postmistress opened after some thought.
    +p Since then it has come twice a week, sometimes early, mostly late, and the sweeping has not stopped because by now it has become a thing that people like to see done.
    -l [More from the coast]
    -l [Ferry times]
    -l [The letter in full]
    -l [Send us a photo]
    -d [Terms] [Privacy] [Jobs]
    """,
    """
    -l [News]
    -l [Recipes]
    -l [Gardens]
    -l [Shop]
    -l [Log in]
    +h Bread without an oven
    +p All you need is a heavy pan with a lid, a flame that can be turned very low, and the patience to leave the dough alone for most of a day while it does its work.
    +p Mix the flour with three quarters of its weight in water and a spoon of salt, cover it and go away. In a warm kitchen it will have doubled after six hours, in a cold one after ten.
    +p Fold it four times with wet hands, from the edge towards the middle, then let it rest for as long as it takes to heat the pan until a drop of water dances on the bottom.
    +p Bake it covered for half an hour on one side and ten minutes on the other, and do not lift the lid to look, because the steam that escapes is what makes the crust soft.
    +p It keeps for four days in a cloth. On the fifth it is better toasted, and what is left after a week makes crumbs that are worth having for their own sake.
    -l [Flat breads]
    -l [Sourdough for beginners]
    -l [Ask the baker]
    -l [Print this page]
    -d [Facebook] [Mail] [Copy link]
    """,
    """
    -d [Start] [Index] [Archive] [Login]
    +h On counting birds
    +p A flock that lifts from a field cannot be counted by looking at its members, so observers learn to see ten birds as a shape and then to lay that shape over the sky.
    +p The error of this method was measured in the sixties with photographs, and it turned out to depend less on the size of the flock than on how recently the observer had slept.
    +p Today cameras do most of the work, but the cameras are calibrated against people, and so the old mistakes survive in a form that nobody can ask about any more.
    +p On the island we still count by eye in the last week of [October], and the two totals are printed next to each other without comment in the yearly report of the station.
    +p Visitors are welcome to take part. They are given the western field, where the flocks are small, and their numbers have for some years been closer to the cameras than ours.
    -d [Older posts] [Newer posts]
    -l [Birds of the island]
    -l [Reports since 1961]
    -l [How to get here]
    """,
    """
    -l [Top stories]
    -l [Business]
    -l [Markets]
    -l [Opinion]
    +h Small mill reopens after flood
    +p The mill at the lower weir ground its first sack of flour yesterday, fourteen months after the river had carried away the wheel, the sluice and most of the northern wall.
    +p Insurance covered less than a third of the damage. The rest came from a loan, a raffle and the sale of some nine hundred bags of flour that had been paid for in advance.
    +p The miller, who had worked as a bus driver in the meantime, said that she had missed the noise and that the passengers had been a poor replacement for it on most days.
    +p A gauge upstream now sends a message when the water rises faster than ten centimetres an hour, and the sluice can be opened from a telephone, which has been tried [once already].
    +p Tours are offered on the first Sunday of the month and end in the room above the stones, where there is coffee and a view of the river that looks harmless again.
    -l [Floods in the valley]
    -l [Local business]
    -l [Subscribe]
    -d [About] [Contact] [Advertise] [Cookies]
    """,
    """
    -d [Docs] [Blog] [Forum] [Download]
    +h Moving a database without stopping it
    +p We run a table of four billion rows that is written to at all hours, and for years we had put off moving it because every plan began with a weekend of silence that we did not have.
    +p The plan that worked writes every change twice. For a month the old and the new store received the same rows, and a job compared them in small ranges and wrote down where they differed.
    +p Most differences came from clocks. Two machines that disagree by a few milliseconds order two updates of one row differently, and the fix was to let the old store decide and tell the new one.
    +p When a full pass had found nothing for [seven days] we let one reader in a hundred use the new store, then ten, then all, and kept writing to the old one for another month out of fear.
    +p Nothing happened. We then removed the old store on an ordinary Tuesday, and the graph of the load is so smooth at that point that we had to mark it with an arrow.
    -d [Previous] [Next] [All posts]
    -l [Hiring engineers]
    -l [Status page]
    -l [Security]
    -l [Feed]
    """,
]
TAGS = {"d": "div", "p": "p", "h": "h1", "l": "li"}
NAMES = ["sidebar", "content-header", "nav-inner", "promo-main", "x1", "footer-wide"]


def by_hand(text):
    lines = [x.strip() for x in text.strip().splitlines()]
    parts = []
    for i, x in enumerate(lines):
        body = x[3:].replace("[", '<a href="/x">').replace("]", "</a>")
        parts.append(f'<{TAGS[x[1]]} class="{NAMES[i % len(NAMES)]}">{body}</{TAGS[x[1]]}>')
    return "<body>" + "".join(parts) + "</body>", [x[3:].replace("[", "").replace("]", "") for x in lines if x[0] == "+"], [x[3:].replace("[", "").replace("]", "") for x in lines]


def test_pages_labelled_by_hand_are_decided_by_counts_and_links():
    right = wrong = 0
    for text in BY_HAND:
        page, want, every = by_hand(text)
        blocks = html.blocks_of(page)
        assert [b.text for b in blocks] == every and not any(b.barred or b.article for b in blocks)
        got = html.main_text(page, TREE).split("\n")
        wrong += len(set(got) ^ set(want))
        right += len(every) - len(set(got) ^ set(want))
    assert right + wrong >= 60 and wrong <= 2


def test_every_layout_without_container_cues():
    """At least 200 blocks of div-only pages of other draws, which parsing can't settle, and the tree drops and keeps rightly."""
    import random

    draw, dropped, kept, wrong = random.Random(4321), 0, 0, 0
    for layout in html.LAYOUTS * 6:
        if "<article" in layout or "<main" in layout:
            continue
        blocks, labels = html.labelled_page(layout, draw)
        got = html.classify(TREE, html.describe(blocks))
        wrong += int((got != np.array(labels)).sum())
        dropped += int((~got & (np.array(labels) == 0)).sum())
        kept += int((got & (np.array(labels) == 1)).sum())
    assert dropped >= 200 and kept >= 200 and wrong < 0.03 * (dropped + kept)


def article_of(page):
    """The driver's pages by plain string operations: the text of each p and heading between the article's tags, decoded."""
    import html as entities
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    out = []
    for part in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")):
        text = " ".join(entities.unescape(re.sub(r"</?b>|</?a[^>]*>", "", part)).split())
        if text:
            out.append(text)
    return "\n".join(out)


def test_query_against_plain_strings(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.op6_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_other_things_inside_articles_go(spark, sf):
    """The driver's pages, with related links, notices, adverts and comments planted between the blocks of their articles: the text is as without them."""
    import random

    draw, planted = random.Random(11), 0
    story = lambda n: " ".join(draw.choice("river stone quay winter letter field miller ferry garden window".split()) for _ in range(n))
    link = lambda n: f'<a href="/x">{story(n)}</a>'
    junk = [
        lambda: f"<ul><li>{link(6)}</li><li>{link(4)}</li><li>{link(9)}</li></ul>",
        lambda: f"<div>{link(7)}</div>",
        lambda: "<p>This site uses cookies to improve your experience. Please accept all cookies.</p>",
        lambda: f'<div class="ad">{story(11)}</div>',
        lambda: f'<div id="comments"><p>{story(18)}</p><p>{story(40)}</p></div>',
        lambda: f'<div class="related"><p>{link(5)}</p><p>{link(8)}</p></div>',
    ]
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        head, inner = r.html[: r.html.index("</h1>") + 5], r.html[r.html.index("</h1>") + 5 :]
        inner, tail = inner[: inner.index("</article>")], inner[inner.index("</article>") :]
        parts = inner.split("<p>")
        for _ in range(4):
            at = draw.randrange(1, len(parts) + 1)
            made = draw.choice(junk)()
            parts[at - 1] += made
            planted += sum(b.article for b in html.blocks_of(f"<article>{made}</article>"))
        page = head + "<p>".join(parts) + tail
        assert html.main_text(page, TREE) == article_of(r.html)
    assert planted >= 200


IN_ARTICLES = [
    """
    +h The harbour that learned to wait
    -p This site uses cookies to improve your experience. Accept all [Read more]
    +p For three winters nobody in the town believed that the ferry would come back, and yet every morning somebody swept the quay.
    -l [More from the coast this week]
    -l [Ferry times for the summer season]
    -l [The letter in full, with photographs]
    +p The harbour master keeps two ledgers. One holds the arrivals that were announced, the other those that happened, and he says that only fools read [them side by side].
    +p It came late.
    -d [Ten harbours you should have seen before you are forty]
    +p Since then it has come twice a week, sometimes early, mostly late, and the sweeping has not stopped.
    """,
    """
    +h Bread without an oven
    +p All you need is a heavy pan with a lid, a flame that can be turned very low, and patience.
    +l flour from the mill
    +l salt
    +l three quarters of its weight in water
    +p Mix the flour with the water and a spoon of salt, cover it and go away for as long as [the dough] needs in a cold kitchen.
    -p Subscribe to our newsletter and accept our privacy settings
    +p Bake it covered for half an hour on one side and ten minutes on the other, and do not lift the lid to look.
    -l [Flat breads from five countries]
    -l [Sourdough for beginners and doubters]
    -l [Ask the baker a question]
    """,
]


def test_articles_labelled_by_hand_hold_other_things():
    for text in IN_ARTICLES:
        page, want, every = by_hand(text)
        page = page.replace("<body>", "<article>").replace("</body>", "</article>").replace("x1", "x2").replace("promo-main", "c5").replace("sidebar", "c7")
        assert [b.text for b in html.blocks_of(page)] == every and all(b.article and not b.barred for b in html.blocks_of(page))
        assert html.main_text(page, TREE).split("\n") == want


LONG = "alpha beta gamma delta " * 8


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><h1>T</h1><p>{LONG}</p><section id="discussion"><p>short text</p><p>{LONG}</p></section></article>', f"T\n{LONG.strip()}\nshort text\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><div class="related work"><p>{LONG}</p><p>{LONG}</p></div></article>', "\n".join([LONG.strip()] * 3)),
        ('<div id="discussion"><p>Hello there you</p></div>', "Hello there you"),
        (f'<div id="comments"><h1>On comments</h1><p>{LONG}</p></div>', f"On comments\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p>This site uses cookies to improve your experience.</p><p>{LONG}</p></article>", "\n".join([LONG.strip()] * 2)),
        (f'<article><p>{LONG}</p><a href="/x"><div>Click here for the great offer</div></a><p>{LONG}</p></article>', "\n".join([LONG.strip()] * 2)),
        (f'<article><p>{LONG}</p><p>see <a href="/x">the map<p>{LONG}</p><p>{LONG}</p></article>', f"{LONG.strip()}\nsee the map\n{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_names_alone_drop_nothing(page, text):
    assert html.main_text(page, TREE) == text


def test_links_hold_over_blocks():
    counts = lambda page: [(b.text, b.linked) for b in html.blocks_of(page)]
    assert counts("<a href=x><div>one two</div><p>three</p></a><p>four</p>") == [("one two", 2), ("three", 1), ("four", 0)]
    assert counts("<p><a>one<p>two <a>three</a></p>") == [("one", 1), ("two three", 1)]


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>hello there you</p>", 3), (1, "u", "<p>hello there you</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html.extract_pages(df).collect()) == ["", "", "hello there you", "hello there you"]
    assert html.extract_pages(df.limit(0)).count() == 0


def test_very_long_page():
    page = "<article>" + "<p>some words here</p>" * 20000 + "</article>"
    assert html.main_text(page, TREE).count("\n") == 19999


@pytest.mark.parametrize("piece", ["<a", "<a>", "<a><p>", "<a \"'>", "<div>", "<p>x", "</span>", "<!--", "<ul><li>", "<h1>"])
def test_time_is_linear_in_a_page(piece):
    def seconds(n):
        began = time.process_time()
        html.blocks_of(piece * (n // len(piece)))
        return time.process_time() - began

    assert seconds(400_000) < 16 * max(seconds(50_000), 0.02)
