import re

import pytest

from quern.llm.html_text import to_text

CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>x<li>y <b>z</b></ul>after": "- x\n- y z\n\nafter",
    "<ol start=3><li>x</li><li>y<ul><li>in</ul></ol>": "3. x\n4. y\n  - in",
    "<table><tr><th>Name<th>N<tr><td>a<td>10<tr><td>long name<td>2</table>": "Name      | N\na         | 10\nlong name | 2",
    "<div>a <script>x</script><style>y</style>b</div><!-- c -->d": "a b\nd",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p>yes</p>": "yes",
    "<head><title>t</title></head><body>x &amp; y &lt;z&gt; &nbsp;w": "x & y <z> \xa0w",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "a < b and <b c": "a < b and",
    "<p>a</div>b</p>": "ab",
    "": "", "   ": "", "<": "<", "</": "</", "<p": "", "<!doctype html>": "", "text only": "text only",
    "<dl><dt>k<dd>v</dl>": "k\n    v",
    "<td>loose</td>": "loose",
    "<img alt='a cat'> and": "a cat and",
    "<h1>T</h1><div>x</div><div>y</div>": "T\n\nx\ny",
    "<table><tr><td>a<table><tr><td>i<td>j</table></td><td>b</table>": "a     | b\n      |\ni | j |",
}


@pytest.mark.parametrize("source", CASES)
def test_case(source):
    assert to_text(source) == CASES[source]


def test_null_and_hard_input():
    assert to_text(None) is None
    assert to_text("<div>" * 20_000 + "deep") == "deep"
    assert to_text("<b>x</b>" * 50_000) == "x" * 50_000
    assert to_text("<a href='" + "y" * 100_000) == ""


HEADLESS = {
    "<head><title>T</title><body>x": "x",
    "<html><head><meta charset=utf-8><p>a<p>b": "a\n\nb",
    "<head><title>T</title>\n words <b>y</b>": "words y",
    "<head><script>s</script><style>c</style><noscript>n</noscript><link rel=x><h1>H</h1>": "H",
    "<head><template><p>no</p></template><title>T</title></head>z": "z",
    "<head><title>T</title></head><body>z": "z",
}


@pytest.mark.parametrize("source", HEADLESS)
def test_open_head_ends(source):
    assert to_text(source) == HEADLESS[source]


BROKEN = (
    "<table><tr><form><td>w1</td><td>w2</td></form></tr></table>w3",
    "<table><tr>w1<td>w2</table>",
    "<table><tbody>w1 <b>w2</b><tr><td>w3</tbody></table>",
    "<table><tr><td>w1</td><p>w2<div>w3 <i>w4</i></div>w5",
    "<table><tr><div><td>w1</td></div><td>w2</table>",
    "<table><tr><td>w1</td><table><tr>w2<td>w3</table>w4",
)


@pytest.mark.parametrize("source", BROKEN)
def test_broken_tables_keep_their_words(source):
    assert sorted(re.findall(r"w\d", to_text(source))) == sorted(re.findall(r"w\d", source))
