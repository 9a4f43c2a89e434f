"""Wrappers whose name or tag must not take the article with them."""

import pytest

from brindle.llm.html_main import main_text

BODY = "<p>" + "body text " * 20 + "<p>Short.<p>" + "more text " * 20
TEXT = ("body text " * 20).strip() + "\nShort.\n" + ("more text " * 20).strip()
MENU = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
PAGES = [
    ("<div class='content with-sidebar'>" + BODY + "</div>", TEXT),
    (MENU + "<div id='content-sidebar-wrap'>" + BODY + "</div><footer>foot</footer>", TEXT),
    ("<article class='post comments-open'>" + BODY + "</article>", TEXT),
    ("<div class='page has-menu'><article>" + BODY + "</article></div>", TEXT),
    ("<div class='page fixed-header'>" + BODY + "</div>", TEXT),
    ("<form id='aspnetForm'>" + MENU + "<div>" + BODY + "</div><footer>foot</footer></form>", TEXT),
    ("<form id='aspnetForm'>" + MENU + "<div>" + BODY + "</div></form><p>Copyright 2020</p>", TEXT),
    ("<form><p>one line here</form><form><p>two lines here</form>", "one line here\ntwo lines here"),
    # what is still set aside
    ("<article>" + BODY + "</article><ol class='comment-list'><li><p>" + "I disagree. " * 90 + "</ol>", TEXT),
    ("<article>" + BODY + "<div class='share-buttons'>Share this text</div></article>", TEXT),
    ("<div class=post>" + BODY + "</div><div class='sidebar left'><p>" + "other words " * 9 + "</div>", TEXT),
    ("<nav class=x>only</nav>", ""), ("<div class='menu'>only</div>", ""),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_wrappers(html, want):
    assert main_text(f"<html><body>{html}</body></html>") == want
