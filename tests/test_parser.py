"""Tokens, tree repair and serialization, by hand-written cases."""

import random
import time

import pytest

from loomdoc.sources.builder import build
from loomdoc.sources.dom import KNOWN, ParseOptions, number, parse_one
from loomdoc.sources.tokenizer import tokenize

#: Markup to what it is written as again, a few rules of repair each, worked out by hand from the rules.
CASES = {
    # paragraphs, items and headings close what is open
    "<section><p>one<aside>two<p>three</aside>four</section>": "<section><p>one</p><aside>two<p>three</p></aside>four</section>",
    "<nav><ol><li>red<ul><li>dark<li>light</ul><li>blue</ol>": "<nav><ol><li>red<ul><li>dark</li><li>light</li></ul></li><li>blue</li></ol></nav>",
    "<li>x<address>y<li>z": "<li>x<address>y</address></li><li>z</li>",
    "<li>x<blockquote>y<li>z": "<li>x<blockquote>y<li>z</li></blockquote></li>",
    "<dl><dt>sea<p>salt<dd>water<dd>waves<dt>sky</dl>end": "<dl><dt>sea<p>salt</p></dt><dd>water</dd><dd>waves</dd><dt>sky</dt></dl>end",
    "<h2>top<h3>next<em>deep<h4>in</em>side": "<h2>top</h2><h3>next<em>deep</em><h4><em>in</em>side</h4></h3>",
    "<h3>mixed</h5>after": "<h3>mixed</h3>after",
    "<main></p>lost</li>and</dd>found</main>": "<main><p></p>lostandfound</main>",
    "<p>out<marquee><p>in</marquee>still</p>gone": "<p>out<marquee><p>in</p></marquee>still</p>gone",
    "<button><p>a<div>b</button>c": "<button><p>a</p><div>b</div></button>c",
    "<article/>kept<hr/>line": "<article>kept<hr>line</article>",
    "one</br >two</wbr>three</nope>": "one<br>twothree",
    # tables
    "<table><th>head<tr><td>cell<td>more</table>rest": "<table><tbody><tr><th>head</th></tr><tr><td>cell</td><td>more</td></tr></tbody></table>rest",
    "<table><caption>of<b>fruit</b><col><col></caption><tbody><td>fig</table>": "<table><caption>of<b>fruit</b></caption><colgroup><col><col></colgroup><tbody><tr><td>fig</td></tr></tbody></table>",
    "<table><colgroup> <col span=2>word<tr><td>x</table>": 'word<table><colgroup> <col span="2"></colgroup><tbody><tr><td>x</td></tr></tbody></table>',
    "<main><table>loose<tr>text<td>cell</td>again<tfoot>tail</table></main>": "<main>loosetextagaintail<table><tbody><tr><td>cell</td></tr></tbody><tfoot></tfoot></table></main>",
    "<table><tr><p>moved<td>stay</table>": "<p>moved</p><table><tbody><tr><td>stay</td></tr></tbody></table>",
    "<table> <tr>\n<td>a</td> </tr> </table>": "<table> <tbody><tr>\n<td>a</td> </tr> </tbody></table>",
    "<table><tr><td><table><td>deep</table>out</td><td>last</table>": "<table><tbody><tr><td><table><tbody><tr><td>deep</td></tr></tbody></table>out</td><td>last</td></tr></tbody></table>",
    "<table><tr><td>a<table><tr><th>b": "<table><tbody><tr><td>a<table><tbody><tr><th>b</th></tr></tbody></table></td></tr></tbody></table>",
    "<table><tr><table><td>second</table>": "<table><tbody><tr></tr></tbody></table><table><tbody><tr><td>second</td></tr></tbody></table>",
    "<table><script>1<2</script><style>p{}</style><form id=f><input type=Hidden><input><td>x</table>": '<input><table><script>1<2</script><style>p{}</style><form id="f"></form><input type="Hidden"><tbody><tr><td>x</td></tr></tbody></table>',
    "<tr>no<th>table</tbody>here<caption>!": "notablehere!",
    "<table><tbody><tr><td>x</section>y</thead>z</tbody>after": "after<table><tbody><tr><td>xyz</td></tr></tbody></table>",
    # select
    "<select><b>bold</b><option>one<i>i</i><option>two<hr></select><u>end": "<select>bold<option>onei</option><option>two</option></select><u>end</u>",
    "<select><optgroup label=a><option>1<optgroup label=b><option>2</optgroup><option>3</select>": '<select><optgroup label="a"><option>1</option></optgroup><optgroup label="b"><option>2</option></optgroup><option>3</option></select>',
    "<label><select><option>y<textarea>\nz</textarea>": "<label><select><option>y</option></select><textarea>z</textarea></label>",
    "<select>a<select>b<keygen>c": "<select>a</select>b<keygen>c</keygen>",
    "<table><td><select><option>in<tr><td>row</table>": "<table><tbody><tr><td><select><option>in</option></select></td></tr><tr><td>row</td></tr></tbody></table>",
    "<option>alone<option>again<optgroup>group": "<option>alone</option><option>again</option><optgroup>group</optgroup>",
    # formatting
    "<em>a<strong>b</em>c</strong>d": "<em>a<strong>b</strong></em><strong>c</strong>d",
    "<u>a<center>b<s>c</u>d</s>e</center>": "<u>a</u><center><u>b<s>c</s></u><s>d</s>e</center>",
    "<code>x<pre>y</code>z": "<code>x</code><pre><code>y</code>z</pre>",
    "<a name=1>first<a name=2>second<em>third<a name=3>fourth": '<a name="1">first</a><a name="2">second<em>third</em></a><em><a name="3">fourth</a></em>',
    "<p><tt>left<p>open": "<p><tt>left</tt></p><p>open</p>",
    "<i><i><i><i><u>z</u></i></i></i></i>w": "<i><i><i><i><u>z</u></i></i></i></i>w",
    "<big><small>x</big></small>y": "<big><small>x</small></big><small></small>y",
    "<table><tr><em>a<td>b</em></table>": "<em>a</em><table><tbody><tr><td>b</td></tr></tbody></table>",
    # after the body, comments and declarations
    "<html><head></head><body><p>x</body> <!--1--></html> <!--2--><p>y": "<html><head></head><body><p>x  </p><p>y</p></body><!--1--></html><!--2-->",
    "<!DOCTYPE  html SYSTEM 'a>b'><b>x": "<!DOCTYPE html SYSTEM 'a>b'&gt;<b>x</b>",
    "a<!--->b<!-->c<!-- d --!>e<!----->f": "a<!---->b<!---->c<!-- d -->e<!----->f",
    "x<!-- open --": "x<!-- open -->",
    "</3></ gap></>t<!bang><?php echo 1 ?>": "<!--3--><!-- gap-->t<!--bang--><!--?php echo 1 ?-->",
    "2 << 3 <= 4 <5 <- 6 <": "2 &lt;&lt; 3 &lt;= 4 &lt;5 &lt;- 6 &lt;",
    "<![CDATA[ ]] > & <i> ]]]>z<![cdata[q]]>": " ]] &gt; &amp; &lt;i&gt; ]z<!--[cdata[q]]-->",
    "kept<em class='cut": "kept",
    # text elements
    "<SCRIPT>a='</scrip'+'t>'</sCript\n>b": "<script>a='</scrip'+'t>'</script>b",
    "<script><!-- <script >1</script > 2 --> </script>3": "<script><!-- <script >1</script > 2 --> </script>3",
    "<script><!--> </script>x": "<script><!--> </script>x",
    "<style><p>&lt;</style><title>&lt;<b></title><noembed>&amp;</noembed>": "<style><p>&lt;</style><title>&lt;&lt;b&gt;</title><noembed>&amp;</noembed>",
    "<iframe><p></iframe><textarea>&copy;</textarea>": "<iframe><p></iframe><textarea>©</textarea>",
    "<listing>\r\n\r\nx</listing><textarea>\n\ny</textarea>": "<listing>\n\r\nx</listing><textarea>\n\ny</textarea>",
    "<h1>t<plaintext></h1>&lt;<p>": "<h1>t<plaintext></h1>&lt;<p></plaintext></h1>",
    # names and attributes
    "<Big-Box WIDE Deep = 'a b' deep=2 tall=&quot;>x</BIG-BOX>": '<Big-Box WIDE Deep="a b" tall="&quot;">x</Big-Box>',
    "<em a=1b=2 c/d e='f'g h= i>x": '<em a="1b=2" c d e="f" g h="i">x</em>',
    "<q =a b==c \"d\">x": '<q =a b="=c" "d">x</q>',
    "<img src=a/><img src=a /><img alt='<&>'>": '<img src="a/"><img src="a"><img alt="&lt;&amp;&gt;">',
    "<a t=&copy t2=&copy; t3=&copyx t4=&copy=>": '<a t="©" t2="©" t3="&amp;copyx" t4="&amp;copy="></a>',
    "<1a><-b><_c>": "&lt;1a&gt;&lt;-b&gt;&lt;_c&gt;",
    "</div/ x='>'>a</DIV>b": "ab",
    "\x00 &nbsp &#0; &#x80; &#xD800; &bogus; &amp;amp;": "\x00 \xa0 \ufffd € \ufffd &amp;bogus; &amp;amp;",
    "": "",
}


def html_of(html):
    return number(build(html))[2]


@pytest.mark.parametrize("html", CASES)
def test_repair(html):
    assert html_of(html) == CASES[html]


@pytest.mark.parametrize("html", [h for h in CASES if "plaintext" not in h and not h.startswith(("<listing>", "<html>", "<a name", "<h2>", "a<!--->", "\x00"))])
def test_repaired_markup_is_stable(html):
    once = html_of(html)
    assert html_of(once) == once


def test_depth_limit():
    rows, _, _ = number(build("<div>" * 600 + "x"))
    depths = [r["depth"] for r in rows if r["kind"] == "element"]
    assert max(depths) == 513 and depths.count(513) == 88
    assert [r["depth"] for r in rows if r["kind"] == "text"] == [513]


def test_rows_and_slices():
    rows, text, html = number(build('<div id=x class="a b a">t<p>u<!--c--><b>v</b></p><p></p></div>'))
    div = rows[1]
    assert (div["id"], div["classes"], div["elem_index"], div["elem_from_end"]) == ("x", ["a", "b", "a"], 1, 1)
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    for r in rows:
        inside = [x for x in rows if r["pre"] <= x["pre"] <= r["subtree_end"]]
        want = "".join(x["text"] for x in inside if x["kind"] == "text")
        assert text[r["text_start"] : r["text_start"] + r["text_len"]] == (want if r["kind"] != "comment" else "")
    p = [r for r in rows if r["tag"] == "p"]
    assert [(r["type_index"], r["elem_index"], r["prev_elem"]) for r in p] == [(1, 1, None), (2, 2, p[0]["pre"])]
    assert html[p[0]["html_start"] :][: p[0]["html_len"]] == "<p>u<!--c--><b>v</b></p>"
    assert html[p[0]["inner_start"] :][: p[0]["inner_len"]] == "u<!--c--><b>v</b>"


def test_inner_html_starts_after_added_newline():
    rows, _, html = number(build("<pre>\n\nx</pre>"))
    assert html == "<pre>\n\nx</pre>"
    assert html[rows[1]["inner_start"] :][: rows[1]["inner_len"]] == "\nx"


def test_tokens():
    got = [(t["kind"], t["tag"], t["content"], [(a["name"], a["value"]) for a in t["attrs"]], t["self_closing"]) for t in tokenize("<!DOCTYPE html><A b C='&amp;x' c=2 />t&lt;<!--c--></a x='>'><br/><x y=z/>")]
    assert got == [
        ("doctype", None, "html", [], False),
        ("open", "a", None, [("b", None), ("C", "&x")], True),
        ("text", None, "t<", [], False),
        ("comment", None, "c", [], False),
        ("close", "a", None, [], False),
        ("open", "br", None, [], True),
        ("open", "x", None, [("y", "z/")], False),
    ]


def test_size_limit_counts_bytes():
    assert parse_one("é" * 10, ParseOptions(19))["error"] == "InputTooLarge: 20 bytes, limit 19"
    assert parse_one("é" * 10, ParseOptions(20))["error"] is None
    assert parse_one(b"\xff" * 10, ParseOptions(20))["error"].startswith("InputTooLarge")  # 30 bytes once decoded
    assert parse_one(None, ParseOptions())["nodes"] == []
    assert len(KNOWN) == len(set(KNOWN))


def test_random_input_never_fails_and_has_sound_labels():
    words = "<p> </p> <b> </b> <a> </a> <table> <tr> <td> </table> <div> </div> <select> <option> </select> <i> </i> <li> <ul> </ul> x <script> </script> <!-- --> <col> <caption> <form> </tr> <h1> </h2> <br> & <".split()
    rng = random.Random(7)
    for _ in range(400):
        html = " ".join(rng.choices(words, k=40))
        rows, text, markup = number(build(html))
        for r in rows[1:]:
            up = rows[r["parent"]]
            assert up["depth"] + 1 == r["depth"] and up["pre"] < r["pre"] <= r["subtree_end"] <= up["subtree_end"]
        assert rows[0]["text_len"] == len(text) and rows[0]["html_len"] == len(markup)


@pytest.mark.parametrize("unit", ["<a b=c ", "<!--", "<p>", "</p>", "&amp", "<script>", "<b><div>", "<table>x", "<", "<x y='", "<b>", "<select><b>"])
def test_time_grows_about_linearly(unit):
    def seconds(n):
        html = unit * (n // len(unit))
        began = time.perf_counter()
        build(html)
        return time.perf_counter() - began

    seconds(1 << 12)
    small, large = min(seconds(1 << 14) for _ in range(3)), seconds(1 << 17)
    assert large < max(small, 0.02) * 40
