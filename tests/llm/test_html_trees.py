"""No visible character is lost, whatever the markup."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quern.llm.html_text import extract_text, to_text

TAGS = "div p span b ul ol li table tr td th tbody thead form section h2 blockquote a center dl dt dd pre".split()


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words = []

    def handle_data(self, data):
        self.words += data.split()


def _random_page(rng: random.Random) -> str:
    out, n = [], 0
    for _ in range(rng.randrange(3, 60)):
        kind = rng.random()
        if kind < 0.45:
            out.append(f"<{rng.choice(TAGS)}>")
        elif kind < 0.65:
            out.append(f"</{rng.choice(TAGS)}>")
        else:
            n += 1
            out.append(f" w{n}x ")
    return "".join(out)


def test_every_word_of_random_trees_appears():
    rng = random.Random(5)
    for _ in range(1500):
        page = _random_page(rng)
        plain = _Text()
        plain.feed(page)
        plain.close()
        got = to_text(page).replace("|", " ").split()
        assert sorted(x for x in got if x.startswith("w")) == sorted(plain.words), page


def test_nested_tables_of_any_depth():
    for n in (600, 3000):
        page = "<table><tr><td>" * n + "deep" + "</td></tr></table>" * n
        assert to_text(page).strip() == "deep"
        assert to_text("<table><tr><td>" * n + "open").strip() == "open"


def test_rowspan_keeps_columns():
    page = "<table><tr><td rowspan=2>aaa<td>b<td>c<tr><td>d<td>e<tr><td>f<td colspan=2>g</table>"
    assert to_text(page).split("\n") == ["aaa | b | c", "    | d | e", "f   | g"]


def test_visibility_and_style_sheets():
    page = "<style>/* .c{display:none} */ .ad, #x { display: none } @media print { p { display:none } } p.ghost{visibility:hidden}</style><p>one<p class='big ad'>two<p id=x>three<p class=ghost>four <b style='visibility:visible'>five</b><p class=ad style='display:block'>six<p class=c>seven"
    assert to_text(page).split() == ["one", "five", "six", "seven"]
    assert to_text("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>").split() == ["-", "b"]


def test_repeated_rows_and_clashing_columns(spark):
    page = "<p>x<table><tr><td>1<td>2</table>"
    df = spark.createDataFrame([(1, page, "old"), (1, page, "old"), (2, None, None), (3, "", "")], "page_id long, html string, text string").withColumn("lines", F.lit(1))
    rows = sorted(((r["page_id"], r["text"]) for r in extract_text(df).collect()), key=str)
    assert rows == [(1, "x\n\n1 | 2"), (1, "x\n\n1 | 2"), (2, None), (3, "")] and extract_text(df.limit(0)).count() == 0
