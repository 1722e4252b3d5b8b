import pytest

from antecede.llm import html_wrappers


@pytest.mark.parametrize(
    "page",
    [
        "<html><body class='has-sidebar'><article>text</article><div class=sidebar>no</div></body></html>",
        "<html><body class='search'><main>text<div class='left-sidebar'>no</div></main></body></html>",
        "<html class='no-cookie-banner'><body><p>text</p><div id=cookie-banner>no</div></body></html>",
        "<html><body><article class='post comment-open'>text<div class='post-comments'>no</div></article></body></html>",
        "<html><body><div id=content class='sidebar with-menu'>text</div><div class='post-footer'>no</div></body></html>",
        "<html><body><div class='page--with-sidebar'>text</div><ul class=menu><li>no</ul></body></html>",
    ],
)
def test_names_of_what_an_element_has(page):
    wrapper = html_wrappers.expression(html_wrappers.parse(page))
    assert html_wrappers.main_text(page, html_wrappers.Wrapper(wrapper)) == "text"
