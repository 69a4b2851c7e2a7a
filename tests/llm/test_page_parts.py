"""Main text of pages with menus, headers, notices and comments within the article; secrets and words of letters alone."""

import random

import numpy as np
import pytest

from orograph.llm import html_extract, secret_scan

PROSE = ["One, two, three words stand here, and more of them, in a row.", "A second paragraph, with commas, says what the first one left out.", "The third, and last, closes the article."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
TEXT = "\n".join(PROSE)
PARTS = {
    "main-menu": "<div class='main-menu'><a href=/>Home</a> <a href=/a>About us</a></div>", "menu": "<div class=menu><a href=/>Home</a></div>", "footer": "<div class='footer'>All rights reserved</div>", "notice": "<div id=notice>We moved, please note.</div>",
    "banner": "<section class=banner>Sale, today, only</section>", "cookie-content": "<div class='cookie-content'>We use cookies, as all do.</div>", "newsletter-body": "<div class='newsletter-body'>Mail, weekly, for free.</div>", "aside": "<aside>More, elsewhere.</aside>",
    "nav": "<nav><a href=/>Up</a></nav>", "ad": "<div class='ad text'>Buy, now.</div>", "comments": "<div id='comments'><p>A reader, says, this.</p></div>", "toolbar": "<div class='post-toolbar'>Print, mail</div>", "modal": "<div class='modal'>Sign up, here</div>",
}


@pytest.mark.parametrize("around", ["article", "main"])
@pytest.mark.parametrize("part", PARTS)
def test_parts_within_the_article_go(around, part):
    for order in (PARTS[part] + BODY, BODY + PARTS[part]):
        page = f"<html><body><header>Site</header><{around}>{order}</{around}><footer>End</footer></body></html>"
        assert html_extract.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["side-effects", "legal-history", "popular-culture", "searchlight", "no-sidebar", "has-menu", "alert-levels"])
def test_names_of_prose_stay(name):
    for page in (f"<body><article><div class='{name}'>{BODY}</div></article></body>", f"<body><div id=c><section class='{name}'>{BODY}</section></div></body>"):
        assert html_extract.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["side-bar", "site-header", "page-footer", "search-box", "legal", "social-links", "top-nav", "cookieNotice"])
def test_names_of_layout_go(name):
    assert html_extract.main_text(f"<body><div class='{name}'><p>Not this, nor that, nor these words at all.</p></div><div>{BODY}</div></body>") == TEXT


def test_headings_beside_the_best_container_and_forms_around_the_page():
    assert html_extract.main_text(f"<body><div><div class=title><h1>Title</h1></div><div>{BODY}</div></div></body>") == "Title\n" + TEXT
    assert html_extract.main_text(f"<body><form action=/><input name=x><select><option>a</select><div>{BODY}</div></form></body>") == TEXT
    assert html_extract.main_text("<body><form><input></form></body>") == ""


def test_pages_of_many_makes():
    """Thirty pages: parts at random places, around and within the article."""
    rnd = random.Random(3)
    for _ in range(30):
        inside = [f"<p>{p}</p>" for p in PROSE]
        for part in rnd.sample(sorted(PARTS), 4):
            inside.insert(rnd.randrange(len(inside) + 1), PARTS[part])
        before, after = ("".join(PARTS[p] for p in rnd.sample(sorted(PARTS), 3)) for _ in range(2))
        tag = rnd.choice(["article", "main", "article class='post content'"])
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}<{tag}>{''.join(inside)}</{tag.split()[0]}>{after}</body></html>"
        assert html_extract.main_text(page) == TEXT


def test_runs_of_letters():
    llr = secret_scan.model()
    for word in ("theswhwherreedin", "whtionedreeaouwh", "Onorwhorhendhaan", "tfjsbackendwebglkernels", "numpyrandommtrandpyx", "Donaudampfschifffahrtsgesellschaft", "internationalization"):
        assert not secret_scan.is_random(word, llr), word
    rng = np.random.default_rng(12)
    for pool, least in (("abcdefghijklmnopqrstuvwxyz", 0.95), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.95), (secret_scan.ALPHABET[:62], 0.99), (secret_scan.ALPHABET[:64], 0.99)):
        keys = ["".join(rng.choice(list(pool), int(rng.integers(20, 44)))) for _ in range(1000)]
        assert sum(secret_scan.is_random(k, llr) for k in keys) >= least * len(keys)
