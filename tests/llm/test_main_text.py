"""Main text on hand-made layouts, pages made to be slow, and the decoder against all labellings."""

import itertools
import random
import time

import numpy as np
import pytest

from folioscope.llm import main_text

P=["The river rose slowly during the night, and by morning the lower fields were under water.","Nobody in the village remembered a flood like it, though the church records mention one in 1784.","Volunteers carried sandbags until noon, when the rain finally stopped and the wind turned."]
T="Flood in the valley"
nav='<div class="navbar"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></div>'
foot='<footer><p>&copy; 2024 Valley Times. <a href="/p">Privacy</a></p></footer>'
def ps(t="p"): return "".join(f"<{t}>{x}</{t}>" for x in P)
A=[T,*P]
LAYOUTS = {
"unnamed divs":(f'<html><body>{nav}<div class="c3"><h1>{T}</h1>'+ps("div")+f'</div>{foot}</body></html>',A),
"unnamed divs, p":(f'<html><body><div class="x1"><div class="x2"><h1>{T}</h1>'+ps()+f'</div></div>{foot}</body></html>',A),
"only unnamed":(f'<div class="c3"><h1>{T}</h1>'+ps("div")+'</div>',A),
"bare text":(" ".join(P),[" ".join(P)]),
"bare body":(f"<html><body>{P[0]}<br>{P[1]}<br>{P[2]}</body></html>",[" ".join(P)]),
"comments in main":(f'<html><body>{nav}<main><h1>{T}</h1>'+ps()+'<div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Great piece, thank you for writing about this so well.</p></li><li class="comment"><p>My grandfather told me of another flood, long before.</p></li></ol></div></main>'+foot+'</body></html>',A),
"newsletter":(f'<html><body>{nav}<article><h1>{T}</h1><p>{P[0]}</p><div class="newsletter-signup">Subscribe to our newsletter</div><p>{P[1]}</p><p>{P[2]}</p></article>{foot}</body></html>',A),
"body direct":(f'<html><body>{nav}<h1>{T}</h1>'+ps()+f'{foot}</body></html>',A),
"table layout":(f'<html><body><table><tr><td class="menu"><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Links</a></td><td><h1>{T}</h1>'+ps()+f'</td></tr></table><div id="footer">&copy; 2001</div></body></html>',A),
"post":(f'<div id="page"><header class="site-header"><h2>My Blog</h2><p>Notes from a valley</p></header><div id="primary"><div class="post hentry"><h1 class="entry-title">{T}</h1><div class="entry-content">'+ps()+'</div><div class="sharedaddy social"><a href=f>Facebook</a><a href=t>Twitter</a></div></div></div><div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href=1>One day</a></li><li><a href=2>Two days</a></li></ul></div></div>',A),
"camel":(f'<body><div class="cookieBanner"><p>We use cookies to improve your visit. By going on you accept them.</p></div><div class="articleBody"><h1>{T}</h1>'+ps()+'<blockquote><p>It was quite a night.</p></blockquote></div><section class="commentList"><div><p>I was there and it was not so bad, really.</p></div></section></body>',[*A,"It was quite a night."]),
"lists":(f'<body>{nav}<article><h1>{T}</h1><p>{P[0]}</p><ul><li>Bring boots.</li><li>Bring a lamp, and spare batteries.</li></ul><h2>After the rain</h2><p>{P[1]}</p></article><aside class="related"><ul><li><a href=q>More floods</a></li></ul></aside></body>',[T,P[0],"Bring boots.","Bring a lamp, and spare batteries.","After the rain",P[1]]),
"long modern":(f'<body><div id="root"><div class="sc-a1"><div class="sc-b2"><a href=/>Home</a><a href=/x>World</a><a href=/y>Local</a></div><div class="sc-c3"><h1>{T}</h1><div class="sc-d4">By A. Writer</div>'+"".join(f'<div class="sc-e5"><p>{x}</p></div>' for x in P*3)+'</div></div></div></body>',[T,"By A. Writer",*P*3]),
"only menu":(f'<html><body>{nav}{foot}</body></html>',[]),
"login":('<html><body><div class="login-form"><form><label>Name</label><input><label>Password</label><input><p>Forgot it?</p></form></div></body></html>',[]),
"replies in article":(f'<article class="story"><h1>{T}</h1>'+ps()+'<section class="discussion"><div class="reply"><p>First!</p></div><div class="reply"><p>This is a very good account of that night, thanks.</p></div></section></article>',A),
}
LAYOUTS |= {
"docs":(f'<body><div class="topbar"><a href=/>Docs</a> <a href=/api>API</a></div><div class="layout"><nav class="toc"><ol><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ol></nav><div class="md-body"><h1>Install</h1><p>{P[0]}</p><pre>make install</pre><h2>Use</h2><p>{P[1]}</p></div></div></body>',["Install",P[0],"make install","Use",P[1]]),
"popup at end":(f'<body><div id="k1"><h1>{T}</h1>'+ps()+'</div><div class="modal popup"><p>Wait! Before you go, get ten percent off your first order.</p></div></body>',A),
"ad between":(f'<body><main class="story">{"".join(f"<p>{x}</p><div class=ad-slot>Advertisement. Buy a boat now.</div>" for x in P)}</main></body>',P),
"comments by id only":(f'<body><div id="content"><h1>{T}</h1>'+ps()+'</div><div id="disqus_thread"><div><p>What a story, I could not stop reading it last night.</p></div></div></body>',A),
"sections":(f'<body><header><a href=/>Home</a></header><section><h2>One</h2><p>{P[0]}</p></section><section><h2>Two</h2><p>{P[1]}</p></section><footer>All the best. &copy; 2020</footer></body>',["One",P[0],"Two",P[1]]),
"center font":(f'<body bgcolor=white><center><h1>{T}</h1></center><font size=2>{P[0]}<p>{P[1]}<p>{P[2]}</font><hr><a href=index>Back</a></body>',A),
"breadcrumbs":(f'<body><ul class="breadcrumb"><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><div class="article-wrapper"><h1>{T}</h1>'+ps()+'<ul class="tags"><li><a href=t>flood</a></li><li><a href=u>rain</a></li></ul></div></body>',A),
"share and related inside":(f'<article><h1>{T}</h1><div class="share-buttons"><a href=f>Share</a><a href=g>Tweet</a></div><p>{P[0]}</p><aside class="related-stories"><h3>Related</h3><ul><li><a href=x>Drought of 1921</a></li></ul></aside><p>{P[1]}</p><p>{P[2]}</p></article>',A),
"rail":(f'<body><div class="page-wrap"><div class="col-8"><h2>{T}</h2>'+ps()+'</div><div class="col-4 rail"><div class="widget"><h4>Trending</h4><ul><li><a href=1>Cats</a></li><li><a href=2>Dogs</a></li></ul></div></div></div></body>',A),
}


@pytest.fixture(scope="module")
def model():
    return main_text.Model()


def test_hand_made_layouts(model):
    """Recall and precision in characters; no page of the training set comes from these."""
    hit = got = want = whole = 0
    for (html, blocks), found in zip(LAYOUTS.values(), model.extract([h for h, _ in LAYOUTS.values()]), strict=True):
        hit += sum(len(b) for b in found if b in blocks)
        got += sum(map(len, found))
        want += sum(map(len, blocks))
        whole += found == blocks
    assert hit / want > 0.95 and hit / got > 0.95 and whole >= 0.9 * len(LAYOUTS)


@pytest.mark.parametrize("name", ["unnamed divs", "bare text", "comments in main", "newsletter"])
def test_layouts_that_were_lost_or_kept_too_much(model, name):
    html, blocks = LAYOUTS[name]
    assert model.extract([html])[0] == blocks


UNITS = ["<a \"", "<a ", "<div>", "<a \">\"", "<svg><p>", "<button><button>", "<select>", "<!", "<script ", "<svg><foreignobject>", "</p", "<li>", "<td><div>", "&#1111"]


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("tail", ["", ">\"", "</svg></button></select>"])
def test_time_grows_with_the_page(unit, tail):
    """Four times the page may take some four times as long, not sixteen."""

    def seconds(size):
        page, best = unit * (size // len(unit)) + tail, 1e9
        for _ in range(2):
            begin = time.process_time()
            main_text.Page(page)
            best = min(best, time.process_time() - begin)
        return best

    assert seconds(1 << 18) < 9 * seconds(1 << 16) + 0.05


def test_items_below_many_open_elements():
    begin = time.process_time()
    page = main_text.Page("<ul>" + "<div>" * 20000 + "<li>x</li>" * 20000)
    assert len(page.blocks) == 20000 and time.process_time() - begin < 10


def test_numbers_of_references():
    assert main_text.Page("&#" + "1" * 100000 + ";&#0000000000000065;&#x41;").blocks == [(0, "\ufffdAA")]


def test_decoding_against_all_labellings():
    rng = random.Random(5)
    for _ in range(150):
        page = main_text.Page("".join(rng.choices(["<div>", "</div>", "<p>x", "<ul>", "</ul>"], k=rng.randrange(1, 9))))
        n = len(page.tag)
        if n > 7:
            continue
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        best = {}
        for states in itertools.product((0, 1, 2), repeat=n):
            if states[0] == 2:
                continue
            score = odds[0] - main_text.SWITCH if states[0] == 1 else -odds[0]
            for i in range(1, n):
                step = (states[page.parent[i]], states[i])
                if step in ((0, 2), (1, 0), (2, 0), (2, 1)):
                    break
                score += (odds[i] if states[i] == 1 else -odds[i]) - main_text.SWITCH * (step in ((0, 1), (1, 2)))
            else:
                best[states] = score
        keep = main_text.decode(page, odds)
        assert keep == [s == 1 for s in max(best, key=best.get)]
