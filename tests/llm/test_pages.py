"""Pages that the generator of labelled pages didn't write: short and long ones in five wrappers, with noise in and behind them."""

import itertools

import numpy as np
import pytest

from siftline.llm import pages

SAID = [
    "The harbour was quiet when the first boats came in, and nobody spoke.", "Later in the morning the market opened; fish, bread and cheese were sold.", "It rained after that.",
    "By noon the streets were empty again, but for two dogs and a cart.", "Nobody could say why the bell rang, though many had heard it.", "The council met in the evening. It decided nothing.",
    "A week went by.", "Then the letter came, as all had expected, and was read aloud.", "So it ended.",
]
AD = '<div class="ad">Buy the best boots of the town today, cheap and good.</div>'
SHARE = '<div class="share"><a href="/t">Tweet</a> <a href="/f">Like it</a></div>'
TALK = '<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, sorry.</p></div></section>'
WRAPPERS = ["article", "main", 'div class="post-content"', 'div class="story"', "div"]


def page(wrapper: str, k: int, noise: tuple, inside: bool) -> tuple[str, str]:
    parts = [f"<p>{x}</p>" for x in SAID[:k]]
    lead, tail = "".join(x for x in noise if x == AD), "".join(x for x in noise if x != AD)
    body = "<h1>A day at sea</h1>" + parts[0] + (lead if inside else "") + "".join(parts[1:]) + (tail if inside else "")
    rest = "" if inside else lead + tail
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
    html = f"<html><head><title>x</title></head><body>{menu}<{wrapper}>{body}</{wrapper.split()[0]}>{rest}<footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer></body></html>"
    return html, "\n".join(["A day at sea", *SAID[:k]])


def right(model: pages.Model, wrapper: str) -> float:
    made = [page(wrapper, k, noise, inside) for k, noise, inside in itertools.product((2, 3, 6, 9), ((), (AD,), (SHARE,), (TALK,), (AD, SHARE, TALK)), (True, False))]
    f = pages.Forest([h for h, _ in made])
    return np.mean([got == want for got, (_, want) in zip(pages.texts(f, model.messages(f)[0][:, 1] > 0.5), made)])


@pytest.fixture(scope="module")
def model(spark):
    """Trained as the query trains it, on a table all of whose pages have an article element."""
    own = [f"<html><body><nav><a href='/{i}'>Home</a></nav><article class='x'>{''.join(f'<p>{s} Part {i}.</p>' for s in SAID[i % 9 :] * (1 + i % 5))}</article><footer><p>Legal words.</p></footer></body></html>" for i in range(250)]
    return pages.train(spark.createDataFrame(list(enumerate(own)), "page_id long, html string"))


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_and_noise(model, wrapper):
    assert right(model, wrapper) >= 0.95


def test_own_pages_are_labelled_without_their_noise():
    plain, labels = pages.seed_labels([pages.marked(f"<body><ARTICLE id=a><p>Text.</p>{AD}{TALK}</ARTICLE><p>Out.</p></body>", i) for i in range(6)])
    assert "<ARTICLE id=a>" in plain[0] and "article" not in plain[1].lower() and "x-main" not in "".join(plain)
    for text, label in zip(plain, labels):
        f = pages.Forest([text])
        assert [t for t, keep in zip(f.texts, label) if keep and t] == ["Text."]


def test_features_as_pairs_equal_features_as_a_table():
    f = pages.Forest([page("div class='story ad-body'", 3, (AD, TALK), True)[0]])
    table = np.zeros((len(f.kind), pages.N_FEATURES))
    table[np.arange(len(f.kind)), f.kind] = 1
    table[f.hinted[:, 0], pages.N_TAGS + f.hinted[:, 1]] = 1
    table[:, pages.N_TAGS + len(pages.HINTS) :] = f.wide
    weights, values = np.random.default_rng(1).normal(size=pages.N_FEATURES), np.random.default_rng(2).normal(size=len(f.kind))
    assert np.allclose(f.evidence(weights), table @ weights) and np.allclose(f.sums(values), values @ table)
