import pytest

from sheaf.functions.markdown import to_markdown

CASES = [
    ("<h1>A  b</h1><h3>c</h3>", "# A b\n\n### c"),
    ("<p>x <b>bold</b> and <em>it</em></p><p>y</p>", "x **bold** and *it*\n\ny"),
    ("<p>a<del>b</del><s>c</s></p>", "a~~b~~~~c~~"),
    ("<a href='/x' title='t'>l <i>k</i></a>", '[l *k*](/x "t")'),
    ("<img src=a.png alt='x'>", "![x](a.png)"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<ul><li><input type=checkbox checked>d</li><li><input type=checkbox>e</li></ul>", "- [x] d\n- [ ] e"),
    ("<pre><code class='language-py'>a\n  b</code></pre>", "```py\na\n  b\n```"),
    ("<p>use <code>a_b</code></p>", "use `a_b`"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<table><tr><th>a<th>b<tr><td>1|2<td>3</table>", "| a | b |\n| --- | --- |\n| 1\\|2 | 3 |"),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("a<br>b", "a  \nb"),
    ("<script>x</script><style>y</style><iframe>z</iframe><noscript>w</noscript>ok", "ok"),
    ("<math><mi>x</mi></math>", "<math><mi>x</mi></math>"),
    ("2 * 3 _a_", "2 \\* 3 \\_a\\_"),
    ("<p># no</p>", "\\# no"),
    ("&eacute; &lt;b&gt;", "é <b>"),
    ("<p><b>open<p>next", "**open**\n\n**next**"),
    ("", ""),
]


@pytest.mark.parametrize("html,markdown", CASES)
def test_cases(html, markdown):
    assert to_markdown(html) == markdown


def test_deep_nesting_is_bounded_and_whole():
    text = to_markdown("<div><b>" * 5000 + "word" + "</b></div>" * 5000)
    assert "word" in text
    assert "end" in to_markdown("<b>" * 3000 + "end")
