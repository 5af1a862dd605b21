"""Pages of other layouts than the training generator makes, written out by templates; (page, main blocks)."""

import random

WORDS = "river stone winter garden letter morning window bridge summer teacher village music paper island doctor evening forest history captain silver market kitchen shadow library ocean valley journey harbour engine mountain".split()


def sentence(r, low=6, high=16):
    text = " ".join(r.choice(WORDS) for _ in range(r.randint(low, high)))
    return text.capitalize() + "."


def prose(r, n=3):
    return " ".join(sentence(r) for _ in range(n))


def news(r):
    title, body = sentence(r, 4, 8), [prose(r) for _ in range(r.randint(3, 8))]
    page = f"""<!doctype html><html><head><title>{title}</title><link rel=x></head><body class="page home">
<div id="top-bar"><a href="/">Daily Harbour</a> <a href="/sub">Subscribe</a></div>
<ul class="main-menu">{''.join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(WORDS, 6))}</ul>
<main id="content" role="main"><article class="story"><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in body)}</article></main>
<div class="related"><h4>More stories</h4><ul>{''.join(f'<li><a href="#">{sentence(r, 4, 7)}</a></li>' for _ in range(4))}</ul></div>
<div id="comments" class="comments-area"><h3>3 comments</h3><ol class="comment-list"><li><p>{sentence(r)}</p></li><li><p>{sentence(r)}</p></li></ol></div>
<footer><p>Copyright 2020 Daily Harbour. All rights reserved.</p></footer></body></html>"""
    return page, [title, *body]


def blog(r):
    title, body = sentence(r, 3, 6), [prose(r, r.randint(1, 4)) for _ in range(r.randint(2, 6))]
    items = [sentence(r, 3, 7) for _ in range(3)]
    page = f"""<html><body><div class="wrapper"><div class="header"><p>My notes</p></div>
<div class="cookie-consent"><p>We use cookies. <button>OK</button></p></div>
<div class="post-body"><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in body)}<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul></div>
<div class="sidebar"><h3>About me</h3><p>{sentence(r)}</p><form><label>Email</label><input><button>Join</button></form></div>
<div class="footer">Powered by words</div></div></body></html>"""
    return page, [title, *body, *items]


def bare(r):
    title, body = sentence(r, 3, 6), [prose(r, r.randint(2, 4)) for _ in range(r.randint(3, 9))]
    return f"<html><head><title>x</title></head><body><h1>{title}</h1>{''.join(f'<p>{p}' for p in body)}</body></html>", [title, *body]


def lines(r):
    title, body = sentence(r, 3, 6), [prose(r, r.randint(2, 4)) for _ in range(r.randint(3, 6))]
    nav = "<nav>" + " ".join(f'<a href="/{w}">{w}</a>' for w in r.sample(WORDS, 5)) + "</nav>"
    return f"<html><body>{nav}<h1>{title}</h1><hr>{'<hr>'.join(body)}<footer>&copy; 2021</footer></body></html>", [title, *body]


def pages(n, seed):
    r = random.Random(seed)
    return [r.choice((news, blog, bare, lines))(r) for _ in range(n)]
