"""Main text of page layouts that are written apart from the training pages: templates with parts drawn at random."""

import random
import time

import pytest

from ordovar.llm import html_main

NOUNS = "river council station museum harvest engine bridge library storm market garden railway theatre harbour valley".split()
VERBS = "opened closed reported measured rebuilt welcomed surveyed painted crossed repaired described praised".split()
REST = "the a near old with after before under new large quiet early this during northern its between".split()


def sentence(r, lo=7, hi=18):
    words = [r.choice(REST), r.choice(NOUNS), r.choice(VERBS), *(r.choice(r.choice((NOUNS, REST, REST))) for _ in range(r.randrange(lo, hi)))]
    if r.random() < 0.3:
        words[3] += ","
    return " ".join(words).capitalize() + "."


def text(r, n):
    return " ".join(sentence(r) for _ in range(n))


def nav(r):
    return "<nav class='site-nav'><ul>" + "".join(f"<li><a href='/{w}'>{w.title()}</a></li>" for w in r.sample(NOUNS, 5)) + "</ul></nav>"


def header(r):
    return f"<header class='site-header'><a href='/'>{r.choice(NOUNS).title()} Times</a>{nav(r)}</header>"


def footer(r):
    return f"<footer><p>&copy; 2024 {r.choice(NOUNS).title()} Times. All rights reserved.</p><ul><li><a href='/privacy'>Privacy</a></li><li><a href='/terms'>Terms</a></li></ul></footer>"


def sidebar(r):
    return "<aside class='sidebar'><h3>Most read</h3><ul>" + "".join(f"<li><a href='/x{i}'>{sentence(r, 3, 6)}</a></li>" for i in range(4)) + "</ul></aside>"


def comments(r):
    return "<section id='comments'><h2>Comments</h2>" + "".join(f"<div class='comment'><b>{r.choice(NOUNS)}</b><p>{text(r, 2)}</p></div>" for _ in range(3)) + "</section>"


def short_article(r):
    p = text(r, r.randrange(2, 5))
    return f"{header(r)}<article><p>{p}</p></article>{footer(r)}", p


def quote(r):
    a, q, b = text(r, 3), text(r, 2), text(r, 3)
    return f"{header(r)}<main><article><p>{a}</p><blockquote><p>{q}</p></blockquote><p>{b}</p></article></main>{footer(r)}", " ".join((a, q, b))


def bare_quote(r):
    a, q = text(r, 3), text(r, 2)
    return f"{header(r)}<article><p>{a}</p><blockquote>{q}</blockquote></article>{footer(r)}", f"{a} {q}"


def figure(r):
    h, a, c, b = sentence(r, 2, 5), text(r, 4), sentence(r), text(r, 4)
    return f"{header(r)}<article><h1>{h}</h1><p>{a}</p><figure><img src='a.jpg' alt='none'><figcaption>{c}</figcaption></figure><p>{b}</p></article>{sidebar(r)}{footer(r)}", " ".join((h, a, c, b))


def data_table(r):
    a, b = text(r, 4), text(r, 3)
    rows = [(r.choice(NOUNS).title(), str(r.randrange(1800, 2020)), f"{r.randrange(10, 900)} m") for _ in range(5)]
    table = "<table><thead><tr><th>Name</th><th>Built</th><th>Length</th></tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</tbody></table>"
    return f"{header(r)}<article><p>{a}</p>{table}<p>{b}</p></article>{footer(r)}", " ".join([a, "Name Built Length", *(c for row in rows for c in row), b])


def glossary(r):
    a = text(r, 3)
    terms = [(r.choice(NOUNS).title(), sentence(r)) for _ in range(4)]
    return f"{header(r)}<article><p>{a}</p><dl>{''.join(f'<dt>{t}</dt><dd>{d}</dd>' for t, d in terms)}</dl></article>{footer(r)}", " ".join([a, *(x for t in terms for x in t)])


def recipe(r):
    h, a = sentence(r, 2, 4), text(r, 2)
    need, do = [f"{r.randrange(2, 400)} g {r.choice(NOUNS)}" for _ in range(5)], [sentence(r) for _ in range(4)]
    lists = f"<h2>Ingredients</h2><ul>{''.join(f'<li>{x}</li>' for x in need)}</ul><h2>Method</h2><ol>{''.join(f'<li>{x}</li>' for x in do)}</ol>"
    return f"<div id='wrap'>{header(r)}<div class='post-content'><h1>{h}</h1><p>{a}</p>{lists}</div>{footer(r)}</div>", " ".join([h, a, "Ingredients", *need, "Method", *do])


def blog(r):
    h, ps = sentence(r, 2, 5), [text(r, r.randrange(2, 5)) for _ in range(5)]
    return f"<div class='cookie-notice'><p>We use cookies to improve this site.</p><button>OK</button></div>{header(r)}<div class='entry-content'><h1>{h}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</div>{comments(r)}{sidebar(r)}{footer(r)}", " ".join([h, *ps])


def news(r):
    h, ps = sentence(r, 3, 6), [text(r, r.randrange(1, 4)) for _ in range(6)]
    ad = "<div class='advert'><p>Advertisement: buy two, get one free today only.</p></div>"
    body = "".join(f"<p>{p}</p>" for p in ps[:3]) + ad + "".join(f"<p>{p}</p>" for p in ps[3:])
    return f"{header(r)}<div class='ad'>Sponsored offer of the week</div><main><article><h1>{h}</h1>{body}</article></main>{sidebar(r)}{footer(r)}", " ".join([h, *ps])


def manual(r):
    out, want = [], []
    for _ in range(3):
        h, a, code = sentence(r, 1, 3), text(r, 2), f"{r.choice(NOUNS)} --{r.choice(VERBS)} {r.randrange(99)}"
        out.append(f"<h2>{h}</h2><p>{a}</p><pre>{code}</pre>")
        want += [h, a, code]
    return f"{header(r)}<div class='toc'><ul><li><a href='#a'>Start</a></li><li><a href='#b'>End</a></li></ul></div><main>{''.join(out)}</main>{footer(r)}", " ".join(want)


def unclosed(r):
    ps = [text(r, 3) for _ in range(4)]
    return f"{header(r)}<article><p>" + "<p>".join(ps) + f"</article>{footer(r)}", " ".join(ps)


def inline(r):
    a, b = text(r, 4), text(r, 3)
    i = a.index(" ", 20)
    return f"{header(r)}<article><p>{a[:i]} <a href='/x'>{a[i + 1 : i + 30]}</a>{a[i + 30 :]}</p><svg width=1 /><p>{b}</p><script>x('<p>no</p>')</script></article><form><input><button>Go</button></form>{footer(r)}", f"{a} {b}"


LAYOUTS = [short_article, quote, bare_quote, figure, data_table, glossary, recipe, blog, news, manual, unclosed, inline]


@pytest.fixture(scope="module")
def trees():
    return html_main.trained()


def test_held_out_layouts(trees):
    r, wrong, total = random.Random(11), {}, 0
    for layout in LAYOUTS:
        made = [layout(r) for _ in range(20)]
        pages = [f"<!DOCTYPE html><html><head><title>{sentence(r, 2, 3)}</title></head><body>{body}</body></html>" for body, _ in made]
        for got, (_, want) in zip(html_main.main_texts(pages, trees), made, strict=True):
            total += 1
            if got != " ".join(want.split()):
                wrong[layout.__name__] = wrong.get(layout.__name__, 0) + 1
    assert sum(wrong.values()) <= 0.05 * total, wrong


@pytest.mark.parametrize("piece", ["<a ", "<b></i>", '<a ">" ', "<svg/>", "<!", "</", "<li>", "<div>", "&amp;", "<p>x", "<td x='>"])
def test_a_megabyte_of_anything_is_parsed_at_once(trees, piece):
    page = piece * (1_000_000 // len(piece) // (10 if piece in ("<li>", "<div>", "<p>x") else 1))
    began = time.process_time()
    html_main.main_texts([page], trees)
    assert time.process_time() - began < 4


def test_unclosed_and_self_closed_elements_do_not_swallow_the_page(trees):
    body = "".join(f"<p>{text(random.Random(i), 3)}</p>" for i in range(4))
    want = " ".join(text(random.Random(i), 3) for i in range(4))
    for odd in ("<svg viewBox='0 0 1 1'/>", "<math/>", "<select><option>a", "<div><noscript>on</div>", "<object data=x></object>", "<svg><title>x</title><path/></svg>"):
        assert html_main.main_texts([f"<body><article>{odd}{body}</article></body>"], trees) == [want], odd


def test_rows(spark):
    page = f"<article><p>{text(random.Random(1), 6)}</p></article>"
    long = "<article>" + f"<p>{text(random.Random(2), 5)}</p>" * 3000 + "</article>"
    rows = [(1, page, "keep", 7), (1, page, "keep", 7), (None, page, None, None), (2, None, "x", 1), (3, "", "x", 1), (4, long, "x", 1)]
    got = sorted((r["page_id"] or 0, r["text"], r["html_text"], r["n"]) for r in html_main.extract(spark.createDataFrame(rows, "page_id long, html string, html_text string, n int").withColumn("text", html_main.F.lit("old"))).collect() if r["html_text"] or not r["page_id"])
    assert [g[0] for g in got] == [0, 1, 1, 2, 3, 4] and got[1] == got[2] and got[0][1] == got[1][1] == text(random.Random(1), 6)
    assert got[3][1] == got[4][1] == "" and got[5][1] == " ".join([text(random.Random(2), 5)] * 3000)
    assert html_main.extract(spark.createDataFrame([], "page_id long, html string")).isEmpty()
