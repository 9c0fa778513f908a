"""Main text: the tree by hand-made pages, the site's noise and the entropies on made-up hosts."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from tallyforge.llm import sitetree as S


def text(page):
    return S.main_text(S.parse(page), {}, {})


def test_pages():
    assert text("") == "" and text("plain &lt;b&gt;\n text") == "plain <b> text"
    assert text("<p>one<p>two <b>bold<br>x<ul><li>a<li>b</ul>tail") == "one\n\ntwo bold x\n\na\n\nb\n\ntail"
    assert text("<nav>n</nav><article><h1>T&amp;amp;</h1><p>a\n\tb&nbsp;c</p><aside>s</aside><footer>f</footer></article><p>out</p>") == "T&amp;\n\na b c"
    assert text("<body><header>h</header><main><header>Title</header>x<div class='comments'><p>c</p></div></main>") == "Title\n\nx"
    assert text('<article>a<div class="ad box">ad</div><div id="cookie-notice">c</div><form>f<input></form>b</article>') == "a\n\nb"
    assert text("<script>if (a < b) '</p>'</script><style>p{}</style><p>x<!-- <p>no --></p><textarea><p>t</textarea>y") == "x\n\ny"
    assert text("1 < 2 and 3 > 2 <notatag") == "1 < 2 and 3 > 2 <notatag"
    assert text('<p title="a > b">q</p><P CLASS=Menu>m</P><div hidden>h</div>') == "q"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert text("<article>one</article><article class='comment'>no</article><article>two</article>") == "one\n\ntwo"
    assert text("x" * 3_000_000) == "x" * 3_000_000
    assert text("<article><section id='discussion'><p>Talk</p></section>the <b class='promo'>bold</b> word</article>") == "Talk\n\nthe bold word"


def test_depth():
    assert text("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x\n\ny"
    assert text("<b>" * 5000 + "x" + "<p>y" * 5000) == "\n\n".join(["x", *["y"] * 5000])


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://site.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in S.extract_text(df).collect()}


def test_noise_without_marks(spark):
    """A notice longer than the story, and a paragraph like the story's own, that the whole site has."""
    notice = "This site's terms apply to all who read it. " * 20
    got = extracted(spark, [f"<div><p>Story {i}.</p><p>Same on all.</p><p>More of {i * 3}.</p></div><div><span>{notice}</span></div>" for i in range(30)])
    assert all(got[i] == f"Story {i}.\n\nMore of {i * 3}." for i in range(30))


def test_vague_words(spark):
    """What a vague class says counts only where the site's pages say it too."""
    got = extracted(spark, [f"<p>Story {i}.</p><div class='related'><p>{'See also' if i < 6 else i}</p></div>" for i in range(30)])
    assert got[3] == "Story 3." and got[20] == "Story 20.\n\n20"


def test_few_pages(spark):
    """Two or three pages of a site that share a sentence keep it."""
    got = extracted(spark, [f"<p>Story {i}.</p><p>A proverb.</p>" for i in range(3)])
    assert all(got[i] == f"Story {i}.\n\nA proverb." for i in range(3))


def test_entropies(spark):
    """Importances against entropies taken from the pages one by one."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    page = lambda: "<div class='c1'>" + "".join(f"<{t}>{r.choice(words)}</{t}>" for t in r.choices(["p", "h2", "ul"], k=r.randint(1, 4))) + "</div>"
    sites = {h: [page() for _ in range(n)] for h, n in (("a.example", 1), ("b.example", 5), ("c.example", 40))}
    rows = [(i, h, f) for h, ps in sites.items() for i, p in enumerate(ps) for f in S.features(S.parse(p))]
    nodes = spark.createDataFrame([(i % 3, h, *f, 1) for i, h, f in rows], "batch int, host string, path long, kind int, value long, n long")
    nodes = nodes.groupBy("batch", "host", "path", "kind", "value").sum("n").withColumnRenamed("sum(n)", "n")
    want = {}
    for h, ps in sites.items():
        found = defaultdict(list)
        for p in ps:
            for path, kind, value in S.features(S.parse(p)):
                found[path].append((kind, value))
        for path, seen in found.items():
            m = sum(k == 0 for k, _ in seen)
            if m > 1:
                n = Counter(v for k, v in seen if k == 1)
                want[h, path, 0, 0] = m, -sum(x / n.total() * math.log(x / n.total()) for x in n.values()) / math.log(m + S.UNSEEN)
                for v, x in Counter(v for k, v in seen if k == 2).items():
                    if x > 1:
                        want[h, path, 2, v] = x, None
    got = S.importances(nodes).collect()
    assert {(x.host, x.path, x.kind, x.value) for x in got} == set(want) and len(want) > 20
    for x in got:
        m, style = want[x.host, x.path, x.kind, x.value]
        assert x.m == m and (style is None and x.style is None or abs(x.style - style) < 1e-9)
    assert S.content_importance(40, 40) < S.LEAST < S.content_importance(3, 3) and S.content_importance(1, 9) == 1
    assert {(x.batch, x.host, x.path) for x in got} == {(i % 3, h, f[0]) for i, h, f in rows if (h, f[0], 0, 0) in want}


def test_story_beside_a_teaser(spark):
    """An article element decides nothing alone: on some pages of the host the story is in a plain div, the teaser in an article."""
    story = lambda i: "".join(f"<p>Part {k} of the story {i} that is told here at some length.</p>" for k in range(5))
    told = lambda i: "\n\n".join(f"Part {k} of the story {i} that is told here at some length." for k in range(5))
    teaser = "<article class='teaser'><p>Read this too</p></article>"
    got = extracted(spark, [f"<div>{story(i)}</div>{teaser}" if i % 2 else f"<article>{story(i)}</article><p>Written by {i}</p>" for i in range(30)])
    assert all(got[i] == told(i) for i in range(30))
    assert text(f"<div>{story(1)}</div>{teaser}") == told(1) + "\n\nRead this too"


def test_repeated_rows(spark):
    """Copies of a row count once, whether or not they share an id."""
    page = "<article><p>The only story</p><p>in two parts</p></article>"
    for ids in ([7] * 12, range(12)):
        df = spark.createDataFrame([(i, "http://one.example/a", page) for i in ids], "page_id long, url string, html string").repartition(3)
        assert [r.text for r in S.extract_text(df).collect()] == ["The only story\n\nin two parts"] * 12


def test_names_inside_an_article(spark):
    """A notice that only its own page has stays in an article, one that the whole site has goes."""
    page = lambda i: f"<article><p>Story {i}</p><section class='notice'><p>A correction of {i}</p></section><figure class='banner'>Figure {i}</figure><div class='comments-policy-essay'><p>Essay {i}</p></div><div class='notice'><p>Terms apply</p></div><div class='reader-comments'><p>Nice {i}</p></div><div class='ad-slot'>Buy {i}</div></article>"
    got = extracted(spark, [page(i) for i in range(20)])
    assert all(got[i] == f"Story {i}\n\nA correction of {i}\n\nFigure {i}\n\nEssay {i}" for i in range(20))


def test_splits_change(spark, tmp_path):
    """Rows keep their numbers when the files are split in another way at the second read."""
    at = str(tmp_path / "pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(5).write.option("parquet.block.size", 1 << 14).parquet(at)
    df = spark.read.parquet(at)
    want = sorted((r.page_id, r.text) for r in S.extract_text(df).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    made = S.extract_text(df)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert sorted((r.page_id, r.text) for r in made.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_site(spark):
    page = lambda i: f"<body><div><p>a longer story {i} with words {i * 7} to tell</p></div><div class='x{i}'><p class='t'>All rights reserved</p></div></body>"
    rows = [(i, f"https://user@Site.example:80/{i}", page(i), "u") for i in range(40)]
    rows += [(100 + i, f"http://copies.example/{i}", "<p>the same</p><p>on all</p>", "u") for i in range(20)]
    rows += [(200, None, page(1), "u"), (201, "http://one.example", None, "u"), (202, "no host", "<p>a</p>", "u"), (3, rows[3][1], rows[3][2], "u"), (None, "http://x.example", "<p>null id</p>", "u")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in S.extract_text(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    by_id = {i: t for i, _, t, _ in got}
    assert all(by_id[i] == f"a longer story {i} with words {i * 7} to tell" for i in range(40))
    assert by_id[105] == "the same\n\non all" and by_id[200].endswith("All rights reserved") and by_id[201] == "" and by_id[202] == "a"
    assert S.extract_text(df.limit(0)).collect() == []


def test_articles_of_the_table(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    want = {}
    for i, h in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        body = re.search("<article>(.*)</article>", h, re.S)[1]
        parts = [S.tidy(re.sub("<[^>]*>", " ", x)) if "<b>" not in x else S.tidy(re.sub("<[^>]*>", "", x.replace("<br>", " "))) for x in re.split("</?(?:p|h1)>", body)]
        want[i] = "\n\n".join(x for x in parts if x)
    assert {r.page_id: r.text for r in S.extract_text(spark.read.parquet(path)).collect()} == want
