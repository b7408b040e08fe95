"""Pages that the generator of training pages does not make: foreign and meaningless names, links in articles, kept weights."""

import random

import pytest

from tidemark.llm import html_text

FIRST = "The first paragraph tells what happened in the town on that long day. It goes on for a while."
SECOND = "A second one follows with more of the story, and it ends well for all of them."
SAID = "Bafor lanis e noti mera. Conis dan ferila goti bane."


def read(page):
    return html_text.extract_pages([page], html_text.trained(), html_text.WordCells())[0]


@pytest.mark.parametrize("content,advert,comments", [("content", "ad", "comments"), ("content", "werbung", "kommentare"), ("inhalt", "werbung", "kommentare"), ("inhalt", "ad", "comments"), ("contenu", "pub", "commentaires"), ("contenido", "publicidad", "comentarios"), ("xq", "zt", "wv"), ("foo", "bar", "baz")])
def test_names_of_containers_do_not_decide(content, advert, comments):
    page = f"<html><head><title>Title of it</title></head><body><div id={content}><h1>Title of it</h1><p>{FIRST}</p><p>{SECOND}</p></div><div class={advert}>Buy our new shoes now, half the price!</div><div class={comments}><p>Nice article, thank you for writing it.</p></div></body></html>"
    assert read(page) == f"Title of it\n{FIRST}\n{SECOND}"


def test_short_linked_paragraphs_stay():
    for inner in ("See <a href=/x>a short link</a> now.", "<a href=/x>Read this</a>", "<a href=/x>All of it is a link</a>"):
        page = f"<body><nav><a href=/>Home</a></nav><article><h1>T here</h1><p>{SAID}</p><p>{inner}</p><p>{SAID} more</p></article><div class=foot>Copyright</div></body>"
        plain = inner.replace("<a href=/x>", "").replace("</a>", "")
        assert read(page) == f"T here\n{SAID}\n{plain}\n{SAID} more"


def test_odd_pages_that_were_not_learned_from():
    right = 0
    for page, main in html_text.training_pages(200, seed=99, odd=1.0):
        right += read(page) == "\n".join(b.text for b in html_text.cut(page) if b.text in main and b.path[-1] != "title")
    assert right >= 0.85 * 200


def test_boxes_say_what_lies_together():
    blocks = html_text.cut("<head><title>One two</title></head><div><div><h1>One two</h1><p>aaaa bbbb</p></div><div><p>c</p></div></div>")
    x = html_text.placing(blocks)
    assert [b.text for b in blocks] == ["One two", "One two", "aaaa bbbb", "c"]
    assert x[1, 1] == x[2, 1] == 1 and x[3, 1] == 0 and x[2, 4] == 1 and x[3, 4] == 0
    assert x[1, 6] == 1 and x[3, 6] == 0 and abs(x[1, 0] - 16 / 17) < 1e-6


def test_weights_are_kept(spark):
    first, again = html_text.kept(spark), html_text.kept(spark)
    assert all((a == b).all() for a, b in zip(first, again, strict=True)) and all((a == b).all() for a, b in zip(first, html_text.trained(), strict=True))


def test_pages_of_a_batch_do_not_meet():
    pages = [page for page, _ in html_text.training_pages(30, seed=5, odd=0.5)]
    model, cells = html_text.trained(), html_text.WordCells()
    assert html_text.extract_pages(pages, model, cells) == [html_text.extract_pages([p], model, cells)[0] for p in pages]


def test_random_names_of_containers():
    r, right = random.Random(1), 0
    for _ in range(60):
        a, b, c = ("".join(r.choice("bcdfghjklmnpqrstvwxyzaeiou") for _ in range(r.randint(1, 6))) for _ in range(3))
        page = f"<html><head><title>Title of it</title></head><body><div id={a}><h1>Title of it</h1><p>{FIRST}</p><p>{SECOND}</p></div><div class={b}>Buy our new shoes now, half the price!</div><div class={c}><p>Nice article, thank you for writing it.</p></div></body></html>"
        right += read(page) == f"Title of it\n{FIRST}\n{SECOND}"
    assert right >= 57
