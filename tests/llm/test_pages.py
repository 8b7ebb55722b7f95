import base64
import gzip
import hashlib
from pathlib import Path

import pytest
import xxhash

from incidentry.llm import warc
from incidentry.llm import wrapper_induction as wi

LONG = "<p>" + "payload é " * 200 + "</p>"


def page_rows():
    rows = [(k, f"http://a.example/{k}", LONG) for k in (5, 9, 7, 9)]
    rows += [(20, "http://b.example/\r\nX: y", "short"), (21, None, "short"), (22, "u", None), (23, "u", ""), (24, "u", "a\r\n\r\nb\n"),
             (None, "u", LONG + "2"), (30, "u", LONG + "2"), (31, "u", "x" * 1000), (32, "u", "x" * 1000), (33, "u", "x" * 999), (34, "u", "x" * 999)]
    return rows


def test_archive_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path, part_bytes=3000)
    got = [tuple(r) for r in warc.resolved(warc.read_records(spark, path)).collect()]
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        again = len(raw) >= 1000 and ids and i != max(ids)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    parts = [gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*")]
    assert len(parts) > 1
    records = [r for p in parts for r in warc.parse(p)]
    assert len(records) == len(rows) and all(b"\r\n\r\n" in block for _, block in records)
    assert sum(LONG.encode() in block for _, block in records) == 3  # both rows of the largest id, and that of the longer payload
    assert all(base64.b16encode(b"") == b"" and f["warc-record-id"].startswith("<urn:uuid:") for f, _ in records)


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read_records(spark, path)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B&nbsp;title</h1></header><p><b>First  para
graph.<br><p>Second &#233;&eacute; one<div class="ad">Buy</div><ul><li>x<li>y</ul><form>f<input></form>
<section class="comments"><p>nice!</p></section><p>Last.</p></article><aside>side</aside><footer>&copy; z</footer></body></html>"""


@pytest.mark.parametrize("html,want", [
    (PAGE, "A & B title\nFirst para graph.\nSecond éé one\nx\ny\nLast."),
    (None, ""), ("", ""), ("plain text &lt;b&gt;", "plain text <b>"), ("<p>a<p>b", "a\nb"), ("<div>a<span>b</span> c</div>d", "ab c\nd"),
    ("<body><main><p>m</p></main><p>no</p>", "m"), ("<p>unclosed <b", "unclosed"), ("<script>x", ""), ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n3"), ("a</p></div>b", "ab"), ("<p hidden='<p>'>q</p>", "q"), ("<" * 50, "<" * 50),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_main_text(html, want):
    assert wi.main_text(html) == want
    assert wi.main_text(html, "#/none", frozenset([1])) == want


def slow_match(a, b):
    """Size of the largest match; trees are (label, children)."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow_match(x[i], y[j]))
    return best[-1][-1] + 1


def flat(tree, parent=-1, out=None):
    out = [] if out is None else out
    me = len(out)
    out.append((parent, tree[0]))
    for kid in tree[1]:
        flat(kid, me, out)
    return out


def test_simple_tree_matching():
    import random

    r = random.Random(4)

    def tree(depth):
        return r.choice("ab") if depth == 3 else r.choice("aab"), [tree(depth + 1) for _ in range(r.randrange(4))] if depth < 3 else []

    for _ in range(200):
        a, b = tree(0), tree(0)
        x, y = flat(a), flat(b)
        got = wi.matched([p for p, _ in x], [n for _, n in x], [p for p, _ in y], [n for _, n in y])
        assert len(got) == slow_match(a, b)
        to = dict(got)
        assert len(to) == len(got) == len(set(to.values()))
        assert all(x[i][1] == y[j][1] and (x[i][0] < 0 or to[x[i][0]] == y[j][0]) for i, j in got)


def test_hosts_learn_their_template(spark):
    rows = [(k, f"https://User@News.example:80/{k}", f"<body><div class=top>Same words on all pages here</div><div class=x1><p>{'story ' * 30}{k}</p>"
             f"<p>and more {k}</p></div><div class=end>Ends the same</div></body>") for k in range(6)]
    rows += [(10, "http://one.example/", "<body><div>alone</div></body>"), (11, None, None), (12, "no url", "<p>x"), (12, "no url", "<p>x")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = {}
    for r in wi.extract(pages).collect():
        got.setdefault(r.page_id, []).append((r.url, r.text, r.n_chars))
    for k in range(6):
        text = f"{'story ' * 30}{k}\nand more {k}"
        assert got[k] == [(rows[k][1], text, len(text))]
    assert got[10] == [("http://one.example/", "alone", 5)] and got[11] == [(None, "", 0)] and got[12] == [("no url", "x", 1)] * 2
    found = {r.host: r for r in wi.wrappers(pages).collect()}
    assert found["news.example"].content.endswith("div.x1") and len(found["news.example"].template) == 2
    assert wi.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def hosts_texts(spark, sources):
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", x) for k, x in enumerate(sources)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wi.extract(pages).collect()}


def test_every_element_of_the_slot_is_read(spark):
    got = hosts_texts(spark, [f"<body><div class=top>Same words</div><div class=c><div>one {k} {'story ' * 9}</div><div>two {k}</div></div></body>"
                              for k in range(4)])
    assert got == {k: f"one {k} {'story ' * 9}".strip() + f"\ntwo {k}" for k in range(4)}
    assert wi.main_text("<main><article>a</article><article>long one<article>in it</article></article></main><aside><article>x</article></aside>"
                        ) == "a\nlong one\nin it"


def test_copies_are_one_witness(spark):
    # Copied is what the host is held against: the page of the least hash.
    texts = sorted(["text 0", "text 1", "text 2"], key=lambda t: xxhash.xxh3_64_intdigest(f"<body><article><div>{t}</div></article></body>"))
    texts = texts[:1] * 7 + texts[1:]
    assert hosts_texts(spark, [f"<body><article><div>{t}</div></article></body>" for t in texts]) == dict(enumerate(texts))


@pytest.mark.parametrize("tag", ["article", "div"])
def test_recurring_inline_words_stay(spark, tag):
    got = hosts_texts(spark, [f"<body><ul><li><a>Home</a></li></ul><{tag}><p><b>Summary:</b> {'story ' * 9}{k}</p></{tag}></body>" for k in range(4)])
    assert got == {k: f"Summary: {'story ' * 9}{k}" for k in range(4)}


def test_deep_hosts_are_learned_to_the_end(spark):
    got = hosts_texts(spark, ["<body><div class=s>" + f"{k} seen</div>" + "<font>" * 2000 + f"<div class=t>Same words</div><div class=c><div>story {k} {'on ' * 30}</div></div>"
                              for k in range(4)])
    assert got == {k: f"story {k} {'on ' * 30}".strip() for k in range(4)}
