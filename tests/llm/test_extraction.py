import random
import xml.etree.ElementTree as X

from chronocohort.llm import extraction
from chronocohort.llm.extraction import extract, main_text

LONG = "This is a paragraph of the article, which is long enough to make the text surge well above the threshold of the method."

PAGE = f"""<!DOCTYPE html><html><head><title>T | Site</title><style>p{{margin:0}}</style><script>var t="</p>";track("<p>x</p>");</script></head><body>
<header><a href="/">Site</a><p>The header of the page with a slogan that is quite long, long enough to pass any threshold of characters.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies, lots of them, and this text about them is long enough to be taken for a paragraph of an article.<div>Really</div></div>
<div class="ad">Buy now!</div>
<article><h1>Title &amp;amp; more</h1><p><b>{LONG}<br><p>Short.</p><p>Two  words\n\n here&nbsp;now 3 &lt; 4</p>
<aside class="sidebar"><p>{LONG}</p></aside><form><p>{LONG}</p><input name=q></form><p>Last {LONG}</p>
<section id="comments"><h2>Comments</h2><p>{LONG}</p></section></article>
<footer>&copy; {LONG}</footer></body></html>"""

WANT = "\n".join(["Title &amp; more", LONG, "Short.", "Two words here now 3 < 4", "Last " + LONG])


def test_article_without_its_surroundings():
    assert extract(PAGE) == WANT


def test_page_that_marks_nothing():
    links = "".join(f"<li><a href='/{i}'>Link number {i} of the long menu</a></li>" for i in range(20))
    page = f"<body><ul>{links}</ul><hr><div></div>{'<br>' * 5}<p>{LONG}</p><p>tiny</p><p>{LONG}</p></body>"
    assert extract(page).endswith(f"{LONG}\ntiny\n{LONG}")


def test_short_and_broken_pages():
    assert extract("") == "" and extract("<nav>only a menu</nav>") == "" and extract("<p></p>") == ""
    assert extract("just text & no markup") == "just text & no markup"
    assert extract("<article><p>Ab</p></article>") == "Ab"
    assert extract("a < b and c > d <p>x") == "a < b and c > d\nx"
    assert extract('<p title="a > b">x</p><!-- open <p>y</p>') == "x"
    assert extract('<article><p class="ad">no<p>yes</p></article>') == "yes"
    assert extract("<script>never closed <p>x</p>") == ""
    assert extract("<div class='menu'>m<article>kept</article>") == "kept"
    assert extract("<p>" + "word " * 200000 + "</p>") == ("word " * 200000).strip()
    assert extract("<a '" * 3000 + ">x") in ("x", extract("<a '" * 3000 + ">x"))


def test_tags_of_any_length():
    data = "data:image/png;base64," + "A" * 20000
    assert extract(f'<article><p>One</p><img src="{data}"><p class=x title=it\'s>two <img alt=\'{data}>\' src={data}>three</p></article>') == "One\ntwo three"
    assert extract(f"<p>{LONG}</p><div class='ad' data-x='{data}>'>{LONG}</div>") == LONG
    assert extract(f"<article><p title='hidden class=ad' data-json='{{\"hidden\": 1}}'>{LONG}</p></article>") == LONG
    assert extract(f'<p title="never closed>{LONG}') == LONG
    assert extract('<i b="\'>' * 50000 + '<i b=\'">' * 50000 + 'end') == 'end'
    assert extract("x <a b=' " * 50000).startswith("x <a b='")


def test_short_blocks_between_gaps_in_an_article_stay():
    page = f"<main><h1>Title</h1><article><p>By A.</p><div class=ad>{LONG}</div><p>{LONG}</p><button>Share</button><p>The end.</p></article></main><p>Out</p>"
    assert extract(page) == f"Title\nBy A.\n{LONG}\nThe end."
    assert extract(f"<article><p>{LONG}</p><figure><img src=x><svg><p>no</p></svg><figcaption>Figure 1</figcaption></figure></article>") == f"{LONG}\nFigure 1"
    assert extract(f"<p>{LONG}</p><form>x</form><p>Tiny</p>") == f"{LONG}\nTiny"  # nothing is marked, but they are children of one element


def test_end_tags_that_may_be_left_out():
    assert extract(f'<ul><li class="share">x<li>y</ul><p>{LONG}</p>') .endswith(LONG)
    for skipped in ('<ul><li class="share">x<li>y</ul>', '<table><tr><td class="menu">m<td>y</table>', '<table><tr><td class="menu">m</table><p>y</p>', '<dl><dt class="ad">x<dd>y</dl>',
                    '<div><p class="ad">x<div>y</div></div>', '<div><span class="ad">x</div><p>y</p>', '<div><div class="ad">x<p>z</div></div><p>y</p>'):
        assert extract(f"<article><p>{LONG}</p>{skipped}<p>{LONG} End</p></article>") == f"{LONG}\ny\n{LONG} End", skipped
    assert extract(f"<article><p>{LONG}<p>{LONG}</article><p>out") == f"{LONG}\n{LONG}"
    assert extract(f"<article><p>{LONG}</p><select><option>a<option>b</select></div></nav><p>{LONG} End</p></article>") == f"{LONG}\n{LONG} End"


def test_words_in_class_and_id_must_name_boilerplate():
    for kept in ('id="discussion"', 'class="side-effects"', 'class="legal-analysis"', 'class="social-science"', 'id="notice"', 'class="menu-of-the-day-review"', 'class="commentary"'):
        assert extract(f"<article><p>{LONG}</p><section {kept}><p>Two.</p></section></article>") == f"{LONG}\nTwo.", kept
    for gone in ('id="comments"', 'class="cookie-notice"', 'class="x social-share-buttons"', 'class="ad-slot-2"', 'class="related_posts"', 'role="navigation"', "hidden"):
        assert extract(f"<article><p>{LONG}</p><section {gone}><p>Two.</p></section></article>") == LONG, gone
    assert extract(f'<div><p>{LONG}</p><div class="legal">Two</div><div class="legal-analysis"><p>{LONG}</p></div></div>') == f"{LONG}\n{LONG}"


def test_line_blocks_decide_which_article_it_is():
    assert extract(f"<article><p>Teaser</p></article><article><h1>T</h1><p>{LONG}</p></article><article>More</article>") == f"T\n{LONG}"
    links = "<li><a href=/>A link with a long text that would make any window of lines surge</a></li>" * 9
    assert extract(f"<article><ul>{links}</ul></article><article><h1>T</h1><p>{LONG}</p></article>") == f"T\n{LONG}"
    assert extract("<main><article>Only a teaser</article></main>") == "Only a teaser"


def test_blocks_around_gaps_of_a_page_that_marks_nothing():
    page = f'<body><ul>{"<li><a href=/>Home</a></li>" * 9}</ul><div id=x><h1>Title</h1><div class="ad">Buy</div><p>{LONG}</p><form><input></form><p>tiny</p><form>f</form><p>{LONG}</p><div class=ad>Buy</div><p>The end.</p></div><div>Elsewhere</div></body>'
    assert extract(page) == f"Title\n{LONG}\ntiny\n{LONG}\nThe end."


def plain(page: str) -> str:
    """The method once more for pages that are well-formed XML, by walking their tree."""
    rows = []  # (text, characters in links, element, id of its parent, article)

    def walk(node, up, article, block):
        """Texts of one block, as (text, in a link); blocks within it are added to rows."""
        pieces = [(node.text or "", node.tag == "a")]
        for child in node:
            inside = child if article is None and child.tag in ("article", "main") else article
            off = child.tag in ("nav", "aside", "form", "footer") or child.tag == "header" and article is None or child.get("class") == "ad"
            if off or child.tag in extraction.BLOCKS:
                flush(pieces, node if block else up, article)
                pieces = []
                gap = off or child.tag in ("article", "main") and article is None
                rows.extend([("", 0, "", None, article)] * (4 * gap))
                if not off:
                    flush(walk(child, child, inside, True), child, inside)
                    rows.extend([("", 0, "", None, article)] * (4 * gap))
            else:
                pieces += walk(child, up, article, False)
            pieces.append((child.tail or "", node.tag == "a"))
        return pieces

    def flush(pieces, node, article):
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            rows.append((text, min(len(text), sum(len(t.strip()) for t, link in pieces if link)), node.tag, parents.get(node), article))

    root = X.fromstring(page)
    parents = {c: p for p in root.iter() for c in p}
    flush(walk(root, root, None, True), root, None)
    marked = any(r[0] and r[4] is not None for r in rows)
    size = [0 if 2 * r[1] > len(r[0]) or marked and r[4] is None else len(r[0]) for r in rows]
    window = [sum(size[i : i + 3]) for i in range(len(size))]
    bar = min(86, max(window, default=0))
    surging = set()
    for i, w in enumerate(window):
        if w >= bar > 0:
            for step in (-1, 1):
                j = i
                while 0 <= j < len(size) and window[j]:
                    surging.add(j)
                    j += step
    surging = {i for i in surging if any(size[i : i + 3])}
    if marked:
        kept = [r[4] for i, r in enumerate(rows) if i in surging and r[4] is not None] or [r[4] for r in rows if r[0] and r[4] is not None]
        return "\n".join(r[0] for r in rows if r[0] and any(r[4] is k for k in kept))
    if not surging:
        return ""
    with_text = [rows[i][3] for i in surging if size[i]]
    return "\n".join(r[0] for i, r in enumerate(rows) if size[i] and (min(surging) <= i <= max(surging) or r[2] in extraction.PROSE and any(r[3] is p for p in with_text)))


def random_page(rng, marked):
    def piece(depth):
        kind = rng.random()
        words = " ".join(rng.choice(["alpha", "be", "gamma", "word"]) for _ in range(rng.choice([1, 3, 25])))
        if kind < 0.4:
            return f"<p>{words}</p>"
        if kind < 0.5:
            return f"<h2>{words}</h2>"
        if kind < 0.6:
            return f"<ul><li><a>{words}</a></li><li>x <b>{words}</b></li></ul>"
        if kind < 0.7:
            return rng.choice([f'<div class="ad">{words}</div>', f"<form>{words}</form>", f"<nav><a>{words}</a></nav>", f"<header><p>{words}</p></header>"])
        if kind < 0.75 and marked:
            return f"<article>{''.join(piece(depth + 1) for _ in range(rng.randint(1, 4)))}</article>"
        return f"<div>{''.join(piece(depth + 1) for _ in range(rng.randint(1, 3)))}</div>" if depth < 4 else f"<p>{words}</p>"

    return f"<html><body>{''.join(piece(0) for _ in range(rng.randint(0, 9)))}</body></html>"


def test_against_a_plain_version():
    rng = random.Random(21)
    for n in range(3000):
        page = random_page(rng, n % 2)
        assert extract(page) == plain(page), page


def test_column(spark):
    pages = spark.createDataFrame([(1, PAGE, "clash"), (1, PAGE, None), (2, None, None), (None, "", None)], "page_id long, html string, text string")
    got = pages.select("page_id", main_text(spark).alias("main")).collect()
    assert sorted(r.main for r in got) == ["", "", WANT, WANT]
    assert pages.where("false").select(main_text(spark)).count() == 0
