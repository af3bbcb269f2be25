import random
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from recallgrid.llm import html_extract as he
from recallgrid.llm.html_extract import Page, main_texts


def page(body, n=0):
    return f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/x{n}>Menu {n}</a></ul></nav>{body}<footer>Foot {n} &copy;</footer></body></html>"


def texts(spark, pages, url="http://h.example/{}"):
    rows = [(i, url.format(i) if url else None, h, 1) for i, h in enumerate(pages)]
    out = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {r["page_id"]: r for r in out.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    return [found[i]["text"] for i in range(len(pages))]


def by_hand(rows):
    """The texts of (url, html) rows by plain occurrence vectors, host by host."""
    hosts = defaultdict(list)
    for i, (url, source) in enumerate(rows):
        hosts[(urlsplit(url).hostname or "") if url else ""].append((i, Page(source)))
    out = [""] * len(rows)
    for pages in hosts.values():
        vectors, name, chars, said = defaultdict(dict), {}, {}, {}
        for i, p in pages:
            tags = Counter(e[1] for e in p.elements[1:])
            own = Counter(p.text_token(e, t) for e, _, t, aside, _ in p.texts if not aside and t.strip())
            said[i] = sum(len(t.strip()) for _, _, t, aside, _ in p.texts if not aside)
            name |= {e[1]: e[0] for e in p.elements[1:]} | dict.fromkeys(own, "")
            chars |= {p.text_token(e, t): len(t.strip()) for e, _, t, _, _ in p.texts}
            for token, n in (tags + own).items():
                vectors[token][i] = n
        same = defaultdict(list)
        for token, v in vectors.items():
            if len(v) >= he.PAGES and len(v) >= he.SHARE * len(pages):
                same[frozenset(v.items())].append(token)
        classes = []
        for v, tokens in same.items():
            if len(tokens) >= he.CLASS and any(name[t] for t in tokens):
                fixed = sum(n * chars[t] for _, n in v for t in tokens if not name[t])
                if fixed > he.SAID * sum(said[i] for i, _ in v):
                    tokens = [t for t in tokens if name[t]]
                classes.append((len(v), len(tokens), v, set(tokens)))
        order, nests = defaultdict(Counter), defaultdict(list)
        every = set().union(*(c[3] for c in classes)) if classes else set()
        rest, slots, held = defaultdict(int), defaultdict(int), defaultdict(set)
        for i, p in pages:
            events = sorted([(s, e[1], "start") for e, (s, _) in zip(p.elements, p.spans) if e[1] in every] + [(t, e[1], "end") for e, (_, t) in zip(p.elements, p.spans) if e[1] in every]
                            + [(place, p.text_token(n, t), "text") for n, _, t, aside, place in p.texts if not aside and t.strip() and p.text_token(n, t) in every])
            left = [(n, t.strip(), p.text_token(n, t)) for n, _, t, aside, _ in p.texts if not aside and t.strip() and p.text_token(n, t) not in every]
            for k, c in enumerate(classes):
                mine = [x for x, (_, t, _) in enumerate(events) if t in c[3]]
                if not mine:
                    continue
                seq = [events[x][1:] for x in mine]
                unit = len(set(seq))
                whole = seq == seq[:unit] * (len(seq) // unit)
                larger = set().union(*(d[3] for d in classes if d[0] > c[0]))
                gaps = [events[x][1] for a in range(0, len(mine), unit) for x in range(mine[a], mine[a + unit - 1])] if whole else []
                order[k][tuple(seq[:unit]) if whole else None] += 1
                nests[k].append(whole and not any(t in larger for t in gaps))
                rest[k] += sum(len(t) for _, t, _ in left)
            for number, (kind, token, _, _, aside) in enumerate(p.elements):
                def under(e):
                    while e > number:
                        e = p.elements[e][2]
                    return e == number
                inner = [t for n, t, _ in left if under(n)]
                if number and not aside and token in every and kind in he.CONTAINERS and inner:
                    slots[token] += sum(map(len, inner))
                    held[token].add(tuple(inner))
        mains, gone = set(), set()
        for k, (_, _, v, tokens) in enumerate(classes):
            n = sum(order[k].values())
            best = max((m for o, m in order[k].items() if o is not None), default=0)
            if best < he.ORDERED * n or sum(nests[k]) < he.ORDERED * n:
                continue
            gone |= {t for t in tokens if not name[t]}
            if all(m == 1 for _, m in v):
                mains |= {t for t in tokens if len(held[t]) > 1 and slots[t] >= he.MAIN_SHARE * rest[k]}
        for i, p in pages:
            out[i] = " ".join(p.blocks(p.main(mains), gone))
    return out


def random_host(rng, host):
    """Pages of a host with two layouts, notices, copies and broken markup."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(n))
    odds, shared, out = rng.random(), words(30), []
    for i in range(rng.choice((1, 2, 3, 5, 9, 14))):
        body = shared if rng.random() < 0.2 else words(rng.randrange(5, 40))
        notice = "<div class=n><p>Fixed notice of the house</p></div>" if rng.random() < odds else ""
        items = "".join(f"<li><b>{words(1)}</b></li>" for _ in range(rng.randrange(4)))
        if rng.random() < odds:
            body += f"<div class='ad'><p>{words(3)}</p></div><section id=comments>{items}</section>"
        kind = f"<div class=x1>Menu of all</div><div class=x2><h1>{words(2)}</h1>{notice}<p>{body}<p>{words(9)}</div><div class=x3>Legal line</div>"
        if rng.random() < 0.4:
            kind = f"<div class=w><ul>{items}</ul><section class=s><p>{body}</section></div>{notice}"
        source = f"<html><body><div class=top>Top of {host}</div>{kind}<footer>f</footer></body></html>"
        out.append((f"https://{host}/{i}", source[: rng.randrange(len(source))] if rng.random() < 0.05 else source))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_hosts_against_plain_vectors(spark, seed):
    rng = random.Random(seed)
    rows = [r for h in range(25) for r in random_host(rng, f"h{h}.example")]
    out = main_texts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string"))
    assert [r["text"] for r in out.orderBy("page_id").collect()] == by_hand(rows)


def test_classes_decide(spark):
    """A text with elements of its own on half the pages is a class; the same text without them, or twice, is none."""
    own = [page(f"<article>{'<div class=n><p>Read our notice</p></div>' if n % 2 else ''}<p>Own words of page {n}, and more of them</p></article>", n) for n in range(8)]
    bare = [page(f"<article>{'<p>Read our notice</p>' if n % 2 else ''}<p>Own words of page {n}, and more of them</p></article>", n) for n in range(8)]
    want = [f"Own words of page {n}, and more of them" for n in range(8)]
    assert texts(spark, own) == want
    assert texts(spark, bare) == [("Read our notice " if n % 2 else "") + w for n, w in enumerate(want)]
    crossing = [page(f"<article>{'<div class=n>A</div>' if n % 2 else ''}<p>Own words of page {n}</p></article>{'<div class=m><p>B</p></div>' if n % 2 else ''}", n) for n in range(8)]
    assert texts(spark, crossing) == [("A " if n % 2 else "") + f"Own words of page {n}" for n in range(8)]


def test_each_kind_of_page_has_its_slot(spark):
    pages = [page(f"<div class={'a' if n % 2 else 'b'}1><div class=c2><p>Text of page {n} in full</p></div><div class=c3><p>x{n}</p></div></div>", n) for n in range(12)]
    assert texts(spark, pages) == [f"Text of page {n} in full" for n in range(12)]


def test_class_names_with_numbers_and_words_inside_an_article(spark):
    assert texts(spark, ["<article>Main<div class='share-price'>Price 5</div><p>more</p><section class='related-work'>Work</section><h2 class='social'>Social science</h2></article>"]) == ["Main Price 5 more Work Social science"]
    pages = [f"<div class=x1>Menu {n}</div><div class=x2>The article {n} has most of the text of its page</div><div class=x3>Legal {n}</div>" for n in range(5)]
    assert texts(spark, pages) == [f"The article {n} has most of the text of its page" for n in range(5)]
    posts = [page(f"<div id=post-{1000 + n} class='post-{1000 + n} post'><p>Post {n} has words</p></div>", n) for n in range(5)]
    assert texts(spark, posts) == [f"Post {n} has words" for n in range(5)]


def test_article_of_one_page_and_of_many(spark):
    article = "<article><header><h1>Head</h1></header><p>One  <b>two</b>three<br>four &amp;amp; &#233;<p>Five<script>x='</p>'</script></article>"
    assert texts(spark, [page(article)]) == ["Head One twothree four &amp; é Five"]
    many = [page(f"<div class=ad>Buy {n}</div><div id=content><h1>H{n}</h1><p>Body of page {n} with words</p></div><div class='comments'><p>Nice {n}</p></div>", n) for n in range(12)]
    assert texts(spark, many) == [f"H{n} Body of page {n} with words" for n in range(12)]


@pytest.mark.parametrize("n", (3, 12))
def test_template_texts_inside_the_main_slot_go(spark, n):
    pages = [page(f"<article><p>Share this story</p><p>Own words {n}</p></article>", n) for n in range(n)]
    assert texts(spark, pages) == [f"Own words {n}" for n in range(n)]


def test_copies_on_a_host_keep_their_text(spark):
    pages = [page("<article><p>The same article everywhere</p></article>", n) for n in range(6)]
    assert texts(spark, pages) == ["The same article everywhere"] * 6


def test_nulls_odd_markup_and_empty_tables(spark):
    odd = [None, "", "plain text", "<p>a<p>b", "<div><article>x <!-- <p>no</p> --> y", "<p>1 < 2</p>", "<a href='x>broken", "<form><p>f</p></form><p>t</p>", "<![CDATA[a<b]]>"]
    assert texts(spark, odd, None) == ["", "", "plain text", "a b", "x y", "1 < 2", "", "t", "a<b"]
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_long_pages_stay_linear():
    assert Page("<div>" * 20_000 + "x" + "</div></p>" * 20_000).blocks(None, set()) == ["x"]
    assert len(Page("<p>word " * 50_000).blocks(None, set())) == 50_000
    assert Page("<div>" * 20_000 + "x").sizes()[0] == 1


def test_comments_and_adverts_inside_articles_go(spark):
    """Containers whose whole class, id or role says so; other words of a class, and headings, stay."""
    words = lambda n: " ".join(f"w{n}_{k}" for k in range(40))
    boxes = ["<section class='comments'><p>reader 0 says hi{n}</p></section>", "<div class='ad'>Buy thing {n} now</div>", "<ul id=comment-list><li>hi {n}</ul>", "<div class='box reader-comments'><div><p>deep {n}</p></div></div>"]
    for box in boxes:
        for around in ("article", "main"):
            got = texts(spark, [page(f"<{around}><h1>Title {n}</h1><p>{words(n)}</p>{box.format(n=n)}</{around}>", n) for n in range(8)])
            assert got == [f"Title {n} {words(n)}" for n in range(8)]
    stay = "<div class='share-price'><p>Price {n}</p></div><h2 class=comments>On comments {n}</h2><p class=ad>An ad of old {n}</p>"
    got = texts(spark, [page(f"<article><p>{words(n)}</p>{stay.format(n=n)}</article>", n) for n in range(8)])
    assert got == [f"{words(n)} Price {n} On comments {n} An ad of old {n}" for n in range(8)]
