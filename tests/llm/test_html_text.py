import math
import random
import time

import pytest

from topspin.llm.html_text import extract, main_text

SENTENCE = "Rain fell on the hills for most of the day, and the river rose until it reached the old mill. "


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var a = "</p><p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home<li><a href=/x>News</ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id="content"><article><h1>The  mill</h1><p>{SENTENCE}&amp; more<br>on&nbsp;it
    <p><b>{SENTENCE}<i>Then</i> it<!-- no --> stopped.<div class="ad">Buy!</div><p>{SENTENCE}</p><span class="ad">Buy</span> it all
    <section class="comments"><p>{SENTENCE}</p></section></article></div>
    <div class="left"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><form><input>Find</form><footer>&copy; us</footer></body></html>"""
    one = SENTENCE.strip()
    assert main_text(page) == f"The mill {one} & more on it {one} Then it stopped. {one} it all"


def test_unmarked_surroundings_are_less_dense():
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Mill</h2><p>{SENTENCE * 4}</p><p>{SENTENCE * 3}</p><p>{SENTENCE * 5}</p></div><div>Imprint <a href=i>legal</a></div></body>"
    assert main_text(page) == " ".join(f"Mill {SENTENCE * 12}".split())


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>never ended") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("a < b and <p title='>'>c <unknown>d") == "a < b and c d"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 200_000).count("word") == 200_000
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<div class=x>", "</div>", "<a href='", "text ", "&amp;", "<", ">", '"', "<!--", "-->", "<li>", "</ul>", "<table><tr><td>", "<br/>"]
    for _ in range(300):
        main_text("".join(rng.choices(parts, k=60)))


def test_rows_stay_as_they_are(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b", "t"), (1, "u", "<p>a b", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert got == [(1, "u", "a b"), (1, "u", "a b"), (None, None, "")]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "wrapper",
    ["<div title='the hidden gem of'>", "<div class='layout has-sidebar'>", "<div data-id='related-1'>", "<svg class=i />", "<div class=notice>", "<article><div class='search results'>", "<svg><path d=''>", "<script src=x />"],
)
def test_wrappers_dont_swallow_the_article(wrapper):
    page = f"<body><nav>Home</nav>{wrapper}<p>{SENTENCE * 4}</p></div></body>"
    assert main_text(page) == (SENTENCE * 4).strip()


def test_hidden_parts_drawings_and_formulas():
    page = f"<article><p>{SENTENCE}<svg><title>icon</title><path d=x /></svg> Then <math><mi>x</mi><annotation>tex</annotation></math> fell.<p hidden>no<p style='display: none'>no<p>{SENTENCE}<span class=ad>Buy <span>now</span> or never</span></article>"
    assert main_text(page) == f"{SENTENCE}Then x fell. {SENTENCE}".strip()


@pytest.mark.parametrize(
    "page",
    ["<a " + '"' * 60, "<a " * 50_000, "<a " * 50_000 + ">", "</p>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<li><ul>" + "<div>" * 25_000 + "<li></li>" * 25_000, "<article>" * 30_000, '<a x=">" ' * 30_000, "<script/>" * 30_000 + "</script>", "<a x=1 " * 20_000 + '<a x=">"', "<span class=ad>" * 30_000],
)
def test_malformed_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


class Node:
    def __init__(self, tag, children):
        self.tag, self.children = tag, children

    def html(self):
        return f"<{self.tag}>" + "".join(c if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag}>"

    def walk(self):
        yield self
        for c in self.children:
            if not isinstance(c, str):
                yield from c.walk()

    def count(self, linked=False):
        """Characters, linked ones, elements and links of the subtree."""
        linked = linked or self.tag == "a"
        total = [0, 0, 1, int(self.tag == "a")]
        for c in self.children:
            part = [len(c.strip()), len(c.strip()) if linked else 0, 0, 0] if isinstance(c, str) else c.count(linked)
            total = [a + b for a, b in zip(total, part, strict=True)]
        return total

    def text(self):
        return " ".join(c if isinstance(c, str) else c.text() for c in self.children)


def by_tree_walk(body):
    """The method in plain words, over a tree of nodes without an article in which only links are inline."""
    c, lc, _, _ = body.count()
    share = lc / (c or 1)

    def density(node):
        c, lc, t, lt = node.count()
        if not c:
            return 0.0
        return max(0.0, c / t * math.log(max(1.0, c / (lc or 1) * t / (lt or 1))) / math.log(c / ((c - lc) or 1) * lc + share * c + math.e))

    nodes = lambda node: [x for x in node.children if not isinstance(x, str)]
    full = lambda node: [x for x in nodes(node) if x.count()[0]]
    # from the last child to the first, as sums of floating point numbers depend on their order
    total = lambda node: sum(density(x) for x in reversed(nodes(node)))
    core = max(body.walk(), key=total)
    if not total(core):
        return body.text()

    def find(node, above):
        if node is core:
            return [*above, node]
        return next((p for x in nodes(node) if (p := find(x, [*above, node]))), None)

    way = find(body, [])
    threshold, usual = min(map(density, way)), total(core) / (len(full(core)) or 1) / 2
    linked = lambda node: 2 * node.count()[1] > node.count()[0]
    quotes = lambda node: any(x.tag == "blockquote" and x.count()[0] for x in node.walk())
    dense = lambda node: density(node) >= (threshold if quotes(node) else max(threshold, usual)) and not linked(node)
    beside = lambda node: [x for x in full(node) if not any(x is w for w in way)]
    top = next((w for w in way if w is not core and any(map(dense, beside(w)))), core)

    def text(node):
        if not any(node is w for w in way) or node is core:
            return node.text()
        belongs = lambda x: any(x is w for w in way) or dense(x) or x.tag in ("blockquote", "a") and not linked(x)
        return " ".join(c if isinstance(c, str) else text(c) for c in node.children if isinstance(c, str) or belongs(c))

    return text(top)


def test_density_against_a_walk_over_the_tree():
    rng = random.Random(4)

    def tree(depth):
        children = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth == 0 or kind < 0.3:
                children.append(" ".join(rng.choices(["rain", "fell", "on", "the", "hills", "river"], k=rng.choice([1, 3, 30]))))
            elif kind < 0.5:
                children.append(Node("a", ["link " * rng.randint(1, 5)]))
            else:
                children.append(tree(depth - 1))
        return Node(rng.choice(["div", "section", "blockquote"]), children)

    for _ in range(300):
        body = Node("body", [tree(3) for _ in range(rng.randint(1, 4))])
        assert main_text(body.html()).replace(" ", "") == by_tree_walk(body).replace(" ", "")


def sentences(name, n):
    return [f"{name}{i} {SENTENCE.strip()}" for i in range(n)]


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_nothing_of_an_article_is_lost():
    parts = {x: sentences(x, n) for x, n in zip("abcd", (4, 6, 4, 4), strict=True)}
    sections = "".join(f"<section><h2>Part {x}</h2>{paragraphs(p)}</section>" for x, p in parts.items())
    assert main_text(f"<body><article>{sections}</article></body>") == " ".join(f"Part {x} {' '.join(p)}" for x, p in parts.items())
    quote = SENTENCE * 30
    assert main_text(f"<body><article>{paragraphs(parts['a'])}<blockquote>{quote}</blockquote></article></body>") == " ".join([*parts["a"], quote.strip()])
    page = f"<body><h1>Head</h1><p>{parts['a'][0]}</p><div class=body>{paragraphs(parts['b'])}</div><p>{parts['c'][0]}</p><div>Imprint <a href=x>legal</a></div></body>"
    assert main_text(page) == " ".join(["Head", parts["a"][0], *parts["b"], parts["c"][0]])


def test_marks_lower_but_dont_remove_what_is_dense():
    story, plain = sentences("s", 9), sentences("p", 6)
    assert main_text(f"<body><div class=social-story>{paragraphs(story)}</div><div>{paragraphs(plain)}</div></body>") == " ".join(story + plain)
    assert main_text(f"<body><div class=promo><p>{story[0]}</p></div><div>{paragraphs(plain)}</div></body>") == " ".join(plain)


@pytest.mark.parametrize(
    "page",
    [
        "<main><article>{own}</article><section id=comments>{comments}</section></main>",
        "<article>{own}<section id=comments>{comments}</section></article>",
        "<aside>{comments}</aside><article>{own}</article><footer>{comments}</footer>",
        "<div id=page class=comments-open><h1></h1><div>{own}</div><ol class=commentlist>{comments}</ol></div>",
        "<div class='comments open'><article>{own}</article></div>",
    ],
)
def test_readers_comments_go_whatever_their_number(page):
    own = sentences("own", 1)
    comments = "".join(f"<article class=comment-body>{paragraphs(sentences('their', 3))}</article>" for _ in range(20))
    assert main_text("<body>" + page.format(own=paragraphs(own), comments=comments) + "</body>") == own[0]
    assert main_text("<body>" + page.format(own=paragraphs(own), comments=comments.replace(" class=comment-body", "")) + "</body>") == own[0]


def test_random_articles_among_surroundings():
    rng = random.Random(6)
    for _ in range(200):
        lines, count = [], 0

        def grow(depth):
            nonlocal count
            out = ""
            for _ in range(rng.randint(1, 4)):
                if depth and rng.random() < 0.5:
                    out += f"<{(t := rng.choice(['section', 'div', 'blockquote']))}>{grow(depth - 1)}</{t}>"  # noqa: B023
                else:
                    tag = rng.choice(["p", "p", "p", "h2", "li", "pre"])
                    count += 1  # noqa: B023
                    lines.append(f"n{count} " + " ".join(rng.choices(["rain", "fell", "hills"], k=3 if tag == "h2" else rng.randint(5, 80))))  # noqa: B023
                    out += f"<{tag}>{lines[-1]}</{tag}>"  # noqa: B023
            return out

        article = grow(3)
        junk = ["<nav><a href=/>Home</a></nav>", "<div class=ad>Buy now, buy cheap!</div>", f"<section class=comments>{paragraphs(sentences('x', 8))}</section>", "<aside><p>Most read today</p></aside>", f"<div class='cookie-notice'><p>{SENTENCE}</p></div>"]
        before, after = (" ".join(rng.sample(junk, rng.randint(0, 4))) for _ in range(2))
        page = f"<body>{before}<div class=wrap><article>{rng.choice(['', junk[1]])}{article}</article>{after}</div></body>"
        assert main_text(page) == " ".join(lines)
