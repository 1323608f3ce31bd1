import html as entities
import random

from siltstone.llm import wrapper as X

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("etaoinshr", k=RNG.randint(2, 8))) for _ in range(300)] + ["R&D", "a<b", "“q”", "é"]


def sentence(n):
    return " ".join(RNG.choices(WORDS, k=n))


def page(i, kind):
    title, paras = sentence(6), [sentence(RNG.randint(5, 60)) for _ in range(RNG.randint(1, 8))]
    e = entities.escape
    body = "".join(f"<p>{e(p).replace(' ', RNG.choice([' ', chr(10), ' <i> ']), 1)}" + RNG.choice(["</p>", ""]) for p in paras)
    extra = {
        0: f'<div class="share">Share {e(sentence(2))}</div>',
        1: '<aside>See also <a href="/x">this</a></aside><div class="notice cookie">We use cookies.</div>',
        2: f'<section id="comments"><article class="comment"><p>{e(sentence(30))}</p></article><form><p>Say something</p><input></form></section>',
        3: "",
    }[kind]
    text = (
        f"<!DOCTYPE html><html><head><title>{e(title)}</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>"
        f"<header><p>Site of {e(sentence(3))}</p></header><nav><ul><li><a href='/a'>{e(sentence(1))}</a><li><a href='/b'>B</a></ul></nav>"
        f'<!-- <p>gone</p> --><div class="ad">{e(sentence(9))}</div>'
        f"<article><h1>{e(title)}</h1>{body}<p>Printed on recycled bits only.</p>{extra}</article>{extra if kind == 2 else ''}"
        f"<footer>&copy; {e(sentence(4))}</footer>" + RNG.choice(["</body></html>", ""])
    )
    return text, "\n".join([title, *[" ".join(p.split()) for p in paras]])


def rows_of(n, kind, host, start):
    out = []
    for i in range(n):
        source, want = page(i, kind)
        out.append((start + i, f"http://{host}/p{i}", source, want))
    return out


def test_induced_wrappers(spark):
    rows = [r for k in range(4) for r in rows_of(14, k, f"h{k}.example", 100 * k)]
    df = spark.createDataFrame([(a, b, c, 3) for a, b, c, _ in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in X.main_texts(df).collect()}
    want = {a: w for a, _, _, w in rows}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), got[wrong[0]], want[wrong[0]])


def test_hosts_without_evidence_keep_what_the_markup_says(spark):
    rows = rows_of(2, 3, "two.example", 0)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for r in X.main_texts(df).collect():
        assert r.text == rows[r.page_id][3] + "\nPrinted on recycled bits only."


def test_joined_frames_agree(spark, monkeypatch):
    rows = rows_of(9, 0, "j.example", 0)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    first = sorted((r.page_id, r.text) for r in X.main_texts(df).collect())
    monkeypatch.setattr(X, "BROADCAST_BYTES", -1)
    assert sorted((r.page_id, r.text) for r in X.main_texts(df).collect()) == first


def test_no_article_takes_the_varying_slots(spark):
    rows = []
    for i in range(6):
        rows.append((i, f"http://plain.example/{i}", f"<div>Plain site</div><ul><li><a href=/>Home {i}</a></ul><div><h2>T{i}</h2>{sentence(20)} x{i}<br>more{i}</div><div>All rights reserved</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in X.main_texts(df).collect():
        lines = r.text.split("\n")
        assert lines[0] == f"T{r.page_id}" and lines[1].endswith(f"x{r.page_id} more{r.page_id}") and len(lines) == 2


def test_odd_pages(spark):
    odd = [None, "", "   ", "text only &amp; &#233; &am", "<p>a<p>b", "<b>x", "<" * 500, "<div>" * 5000 + "deep", "<p " + "a" * 1000, "<table><tr><td>1<td>2</table>", "<script>never closed", "<p>" + "long " * 200000, "<p title=\"a>b\">c"]
    df = spark.createDataFrame([(i, None if i % 2 else "notaurl", t) for i, t in enumerate(odd)] + [(1, "x", "<p>twice")] * 2, "page_id long, url string, html string")
    got = {}
    for r in X.main_texts(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[0] == got[2] == [""] and got[3] == ["text only & é &am"] and got[4] == ["a\nb"] and got[5] == ["x"]
    assert got[7] == ["deep"] and got[9] == ["1\n2"] and got[10] == [""] and len(got[11][0]) == 999999 and got[12] == ["c"]
    assert sorted(got[1]) == ["", "twice", "twice"]
    assert X.main_texts(df.limit(0)).count() == 0


def test_matching_is_optimal():
    def brute(a, b):
        if a.tag != b.tag:
            return 0
        if a.text is not None and b.text is not None:
            return 2 if a.hash == b.hash else 1
        best = {}

        def go(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0
            if (i, j) not in best:
                best[i, j] = max(go(i + 1, j), go(i, j + 1), go(i + 1, j + 1) + brute(a.kids[i], b.kids[j]))
            return best[i, j]

        return 1 + go(0, 0)

    for _ in range(100):
        make = lambda: X.parse("".join(RNG.choice(["<p>a", "<p>b", "<div>", "</div>", "<ul><li>a<li>b</ul>", "<h2>t</h2>"]) for _ in range(RNG.randint(1, 25))))
        a, b = make(), make()
        assert X.match(a, b)[0] == brute(a, b)


def test_names_of_what_is_no_content():
    def text(source):
        return X.content(X.parse(source), None)

    body = "<article><header><h1>T</h1></header><p>One <span class='ad'>buy</span>two<p hidden>no<p style='display: none'>no<p>three</article>"
    assert text(f"<div class='page-header'>S</div>{body}<div class='reader-comments'><p>c</div>") == "T\nOne two\nthree"
    assert text("<div class='site-header'>Site</div><div class='sidebar'>s</div><div class='content'><h2>A</h2><p>b c</div><form>f</form>") == "A\nb c"
    assert text("<div class='with-sidebar'><article><p>long enough to hold most</article></div><div class='notice'>n</div>") == "long enough to hold most"
    assert text("<main><p>m</p><aside>a</aside></main><article class='comment'><p>longer than the rest</article>") == "m"
    assert text("<p>a&nbsp;b&amp;c&#x41;</p><pre>x\n  y</pre><ul><li>i<li>j</ul>") == "a b&cA\nx y\ni\nj"


def test_a_block_that_differs_from_the_template_stays(spark):
    """Every third page has another text where the others have the constant line."""
    rows, want = [], {}
    for i in range(12):
        line = f"Own words of page {i} {sentence(4)}" if i % 3 == 0 else "All of this is printed on recycled bits."
        text = sentence(40)
        rows.append((i, f"http://c.example/{i}", f"<div class=top>Menu</div><article><h1>Title {i}</h1><p>{entities.escape(text)}</p><p>{line}</p></article><footer>f{i}</footer>"))
        want[i] = "\n".join([f"Title {i}", " ".join(text.split()), *([line] if i % 3 == 0 else [])])
    got = {r.page_id: r.text for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_induction_decides_without_names_and_articles(spark, monkeypatch):
    """Neither tags nor class names say here what is content."""
    rows, want = [], {}
    for i in range(10):
        paras = [sentence(30) for _ in range(3 + i % 3)]
        menu = "".join(f"<li><a href=/{k}>{sentence(1)}</a>" for k in range(5))
        body = "".join(f"<p>{entities.escape(p)}</p>" for p in paras)
        rows.append((i, f"http://d.example/{i}", f"<div class=a><ul>{menu}</ul></div><div class=b>{sentence(5)}</div><div class=c><h1>T {i}</h1>{body}</div><div class=d>{sentence(6)}</div>"))
        want[i] = "\n".join([f"T {i}", *[" ".join(p.split()) for p in paras]])
    got = {r.page_id: r.text for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    # the generator's pages too
    for name in ("_STRONG", "_WEAK", "_DROP_TAGS"):
        monkeypatch.setattr(X, name, frozenset())
    made = [r for r in rows_of(20, 3, "off.example", 0)]
    refs = [X.skeleton(X.parse(made[0][2]))]
    told = {}
    for r in made[1:]:
        for node, same, free in X.evidence(X.parse(r[2]), X.Reference(refs[0])):
            seen = told.setdefault(node, [0, 0, 0])
            told[node] = [seen[0] + 1, seen[1] + same, seen[2] + free]
    reference = X.Reference(refs[0], [{"node": n, "seen": a, "same": b, "free": c} for n, (a, b, c) in told.items()])
    assert sum(X.content(X.parse(r[2]), reference) == r[3] for r in made) >= 18


def test_a_hosts_first_page_may_be_empty_and_boilerplate_may_outweigh_the_text(spark):
    legal = " ".join(f"Clause {k} binds the reader in every way there is." for k in range(60))
    rows = [(0, "http://e.example/0", ""), (1, "http://e.example/1", "<html><body></body></html>")]
    rows += [(i, f"http://e.example/{i}", f"<div><p>{legal}</p></div><div><h2>N {i}</h2><p>{entities.escape(sentence(12))} n{i}</p></div>") for i in range(2, 14)]
    for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "" if r.page_id < 2 else (r.text.startswith(f"N {r.page_id}\n") and "Clause" not in r.text)


def test_near_copies_do_not_become_template(spark):
    text = [sentence(30) for _ in range(4)]
    body = "".join(f"<p>{entities.escape(p)}</p>" for p in text)
    rows = [(i, f"http://n.example/{i}", f"<nav>n{i}</nav><article><h1>Same</h1>{body}<p>Number {i}</p></article>") for i in range(9)]
    for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "\n".join(["Same", *[" ".join(p.split()) for p in text], f"Number {r.page_id}"])


def test_names_inside_an_article_count_only_where_they_are_plain():
    def text(source):
        return X.content(X.parse(source), None)

    assert text("<article><p>a</p><section id='discussion'><p>b</p></section><div class='alert'>c</div><p>x <math><mi>y</mi></math> z</p></article>") == "a\nb\nc\nx y z"
    assert text("<article class='search'><p>found here</p></article>") == "found here"
    assert text("<div class='post share'><p>all of the words</p></div>") == "all of the words"
    assert text("<div><p>one</p><p><a href=/x>a paragraph of links alone</a></p></div>") == "one\na paragraph of links alone"


def test_long_lists_and_deep_trees_are_matched_exactly(monkeypatch):
    def tree(n):
        return X.parse("".join(RNG.choice([f"<p>{RNG.randint(0, 9)}", f"<h2>{RNG.randint(0, 3)}</h2>", "<div><p>a<p>b</div>", "<ul><li>a<li>b</ul>"]) for _ in range(n)))

    def worth(pairs):
        return sum(1 + (p.length > 0 and not p.kids and not q.kids and p.hash == q.hash) for p, q in pairs)

    for _ in range(20):
        a, b = tree(RNG.randint(1, 60)), tree(RNG.randint(1, 60))
        score, pairs = X.match(a, b)
        monkeypatch.setattr(X, "CELLS", 8)
        other, split = X.match(a, b)
        monkeypatch.undo()
        assert score == other == worth(pairs) == worth(split)
    # one more block in front of 3000: everything behind it is still met
    rest = "".join(f"<p>{k}" for k in range(3000))
    assert X.match(X.parse("<h1>t</h1><p>new" + rest), X.parse("<h1>t</h1>" + rest))[0] == 1 + 2 * 3001
    deep = X.parse("<div>" * 3000 + "<p>x<p>y")
    assert X.match(deep, X.parse("<div>" * 3000 + "<p>x<p>z"))[0] == 3001 + 3
    assert X.skeleton(X.unpack(X.skeleton(deep))) == X.skeleton(deep)
