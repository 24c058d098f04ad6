"""Alignment of pages with their host's reference, and what the marks may drop."""

import random

from corpusloom.llm import html_extract


def most(x, y):
    if x.mark != y.mark:
        return 0
    best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, c in enumerate(x.children):
        for j, d in enumerate(y.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + most(c, d))
    return 1 + best[-1][-1]


def tree(rng, depth):
    return "".join(f"<{t}>{tree(rng, depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "b"], k=rng.randrange(4)))


def test_align_matches_as_many_nodes_as_possible():
    rng = random.Random(1)
    for _ in range(300):
        x, y = (html_extract.parse(f"<body>{tree(rng, 3)}</body>") for _ in range(2))
        pairs = html_extract.align(x, y)
        assert len(pairs) == most(x, y)
        assert all(a.mark == b.mark for a, b in pairs)
        assert len({id(a) for a, _ in pairs}) == len({id(b) for _, b in pairs}) == len(pairs)


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def test_blocks_beyond_the_reference_stay(spark):
    article = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    plain = [f"<body><div>nav</div>{'<div>promo</div>' if i % 3 == 2 else ''}<div>{article(i)}</div></body>" for i in range(12)]
    got = extracted(spark, plain)
    assert all(article(i) in got[i] for i in range(12))
    several = [f"<body><p>top</p>{''.join(f'<div class=c>{article(i * 10 + k)}</div>' for k in range(1 + i % 3))}</body>" for i in range(12)]
    got = extracted(spark, several)
    assert all(article(i * 10 + k) in got[i] for i in range(12) for k in range(1 + i % 3))


def test_words_do_not_drop_the_article(spark):
    article = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    for opening in ("<div class='content with-sidebar'>", "<div id='social-science'>", "<div class='search'>", "<div class=x>"):
        pages = [f"<body><div class=menu>Menu {i}</div>{opening}<div class='entry-header'>Title {i}</div><p>{article(i)}</p><p>more {i}</p></div><div class='cookie-notice'>Cookies {i}</div></body>" for i in range(12)]
        got = extracted(spark, pages)
        assert [got[i] for i in range(12)] == [f"Title {i}\n\n{article(i)}\n\nmore {i}" for i in range(12)]


def by_host(spark, pages):
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(df.repartition(3)).collect()}


def test_neutral_marks(spark):
    """No tag or class tells what is content; menus and adverts vary as well."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    pages, want = [], []
    for i in range(40):
        parts = [" ".join(word() for _ in range(40)) for _ in range(rng.randrange(1, 6))]
        title, menu = f"Title {word()}", "".join(f"<div>{word()}</div>" for _ in range(6))
        body = "".join(f"<p>{p}</p>" for p in parts)
        pages.append(("h.example", f"<html><body><div><div>{menu}</div></div><div>{word()} {word()}</div><div><h1>{title}</h1>{body}</div><div>&copy; h.example {word()}</div></body></html>"))
        want.append("\n\n".join([title, *parts]))
    got = by_host(spark, pages)
    assert [got[i] for i in range(40)] == want


def test_first_page_of_a_host_may_be_broken(spark):
    article = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    good = [f"<body><div>Menu</div><div><h1>T{i}</h1><p>{article(i)}</p></div><div>Foot</div></body>" for i in range(60)]
    bad = ["<h1>404", "<body><table><tr><td>Index<td>of</table></body>", "<div><div><div>error</div></div></div>"]
    got = by_host(spark, [*(("x.example", p) for p in bad), *(("x.example", p) for p in good), *(("y.example", p) for p in good[:3]), ("z.example", good[0]), ("z.example", None), ("", "")])
    assert all(got[3 + i] == f"T{i}\n\n{article(i)}" for i in range(60))
    assert all(article(i) in got[63 + i] for i in range(3)) and article(0) in got[66] and got[67] == got[68] == ""
