"""Line-block distribution against expected texts written by hand, and against its definition with lines of another parser."""

import random
from html.parser import HTMLParser

import pytest

from navengine.llm import html_text

LONG = "This paragraph has enough words in it that any window over its line is far above the threshold of a surge."
LINKS = ["Home", "About", "Login", "Copyright", "Terms"]


def page(*lines, around="p"):
    return "".join(f"<{around}>{x}</{around}>" for x in lines)


@pytest.mark.parametrize(
    "html, want",
    [
        (page(*["Link"] * 30, LONG, *["Link"] * 30), [LONG]),
        (page(*LINKS, LONG), [LONG]),
        (page(LONG, *LINKS), [LONG]),
        (page(LONG, *LINKS, LONG, around="div"), [LONG, LONG]),
        (f"<article>{page(LONG, *LINKS)}</article>", [LONG]),
        (f"<ul>{page(*LINKS, around='li')}</ul><h1>Title</h1>{page(LONG)}", ["Title", LONG]),
        (page(LONG, "A short end."), [LONG, "A short end."]),
        (page("Yes.", "No.", "Oh.", LONG, "So.", "It.", "Is."), ["Yes.", "No.", "Oh.", LONG, "So.", "It.", "Is."]),
        ('<p>He said <span class="share">forty per cent</span> of <em class="notice">all voters</em> agreed.</p>', ["He said forty per cent of all voters agreed."]),
        (f'<div class="ad">{LONG}</div><p>Short text.</p>', ["Short text."]),
        (f'<article><p>{LONG}</p><div class="ad">buy</div><p>End</p></article><footer>{LONG}</footer>', [LONG, "End"]),
        (f'<main><h1>Title</h1><article><p>{LONG}</p><section class="comments"><p>{LONG}</p></section></article><article><p>Teaser</p></article></main>', ["Title", LONG]),
        ("<nav>menu</nav><p>A short article.</p><p>Whole.</p><footer>f</footer><p>g</p>", ["A short article.", "Whole."]),
        (f"<article><p>Card</p></article><div>{LONG}</div>", [LONG]),
        (f"<p>a &amp; b &#8364;\n\t c<br>d{LONG}<script>x</script>", [f"a & b € c d{LONG}"]),
        ("", []), (None, []), ("no markup at all", ["no markup at all"]), ("<p>  </p>", []), ("<nav>only</nav>", []),
    ],
)
def test_expected_texts(html, want):
    assert html_text.main_blocks(html) == want


class Lines(HTMLParser):
    """(text, heading) of each block of simple pages; empty windows for what is left out."""

    def __init__(self):
        super().__init__()
        self.out, self.text, self.heading, self.hidden = [], "", False, 0

    def cut(self):
        text = " ".join(self.text.split())
        self.text = ""
        if text and not self.hidden:
            self.out.append((text, self.heading))

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.heading = tag in ("h1", "h2")
        if tag in ("nav", "footer"):
            self.out += [("", False)] * 3
            self.hidden += 1

    def handle_endtag(self, tag):
        self.cut()
        self.heading = False
        self.hidden -= tag in ("nav", "footer")

    def handle_data(self, data):
        self.text += data


def by_definition(lines):
    n = len(lines)
    size = [len(t) for t, _ in lines]
    low = set()
    for i in range(n - 2):
        w = lines[i : i + 3]
        if all(t and t[-1] not in html_text.ENDS for t, _ in w) and not any(h for _, h in w[1:]) and sum(size[i : i + 3]) < 24:
            low |= {i, i + 1, i + 2}
    cuts = [i for i in range(n) if i in low or sum(size[i : i + 3]) == 0]
    regions, last = [], -1
    for c in [*cuts, n]:
        regions.append([i for i in range(last + 1, c) if size[i] and i not in low])
        last = c
    kept = [r for r in regions if any(sum(size[j] for j in r if i <= j < i + 3) > 86 for i in r)]
    if not kept:
        kept = [max(regions, key=lambda r: sum(size[i] for i in r))]
    return [lines[i][0] for r in kept for i in r]


def test_random_pages_by_definition():
    draw = random.Random(6)
    dropped = 0
    for _ in range(1500):
        parts = []
        for _ in range(draw.randrange(25)):
            kind = draw.choice(["link", "link", "text", "short", "nav", "head", "footer"])
            words = " ".join("w" * draw.randrange(1, 9) for _ in range(draw.randrange(1, 30 if kind == "text" else 4)))
            tag = {"nav": "nav", "head": draw.choice(["h1", "h2"]), "footer": "footer"}.get(kind, draw.choice(["p", "div", "li"]))
            parts.append(f"<{tag}>{words}{'.' if kind in ('text', 'short') else ''}</{tag}>" * draw.choice([1, 1, 4]))
        html = "".join(parts)
        p = Lines()
        p.feed(html)
        p.close()
        p.cut()
        got = html_text.main_blocks(html)
        assert got == by_definition(p.out)
        dropped += len(got) < sum(bool(t) for t, _ in p.out)
    assert dropped > 500


def test_pages_of_any_shape(spark):
    rows = [(1, None, 5), (1, "", 5), (2, page(LONG), 5), (2, page(LONG), 5), (3, page(*[LONG] * 20_000), 5)]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int").selectExpr("*", "'mine' as text", "'u' as url")
    got = html_text.extract_text(df).collect()
    assert sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in got) == [(1, 0, 0), (1, 0, 0), (2, len(LONG), len(LONG)), (2, len(LONG), len(LONG)), (3, 20_000 * (len(LONG) + 2) - 2, 20_000 * (len(LONG) + 2) - 2)]
    assert html_text.extract_text(df.where("false")).collect() == []
