"""Pages with broken markup, sentences around what goes, boilerplate by name, and several articles."""

import time

import pytest

from tmweave.llm import html_extract

TEXT = "A sentence of the article that is long enough to be told from the rest of the page. " * 6


@pytest.mark.parametrize("unit", ["<a href='", "<!--", "</", "<?", "<![CDATA[", "<![if ", '<a x=">" ', '<a x=" y="', "<a x=it's ", "<!", "<script>", "<p", "<p>", "<svg>", "a<b ", "&lt", "<!-- > "])
def test_linear(unit):
    """180,000 characters in about a second, whatever is left open."""
    start = time.process_time()
    html_extract.main_text(unit * (180_000 // len(unit)))
    assert time.process_time() - start < 3


@pytest.mark.parametrize("page,want", [("text <a href='x", "text <a href='x"), ("a < b and c > d", "a < b and c > d"), ("<p>x</p><!-- open", "x\n\n<!-- open"), ("<p title=don't>z</p>", "z"), ("<p title='a>b'>z</p>", "z"), ("x <![CDATA[ y", "x <![CDATA[ y"), ("<p>a</p", "a")])
def test_left_open(page, want):
    assert html_extract.main_text(page).startswith(want.split("\n")[0])


@pytest.mark.parametrize("gone", ["<script>no</script>", "<style>no</style>", "<svg><g><path/></g></svg>", "<button>no</button>", "<span hidden>no</span>", "<picture><source><img></picture>", "<noscript>no</noscript>", "<select><option>no</select>", "<canvas>no</canvas>"])
def test_sentences_stay_whole(gone):
    assert html_extract.main_text(f"<article><p>A sentence {gone}goes on.</p><p>{TEXT}</p></article>") == f"A sentence goes on.\n\n{TEXT.strip()}"


NAMES = "user-comments reader-comments reader_comments site-sidebar right-rail top-nav google-ads ad-wrapper cookiebar site-notice mobile-menu footer-links legal-notice article-comments-no comments-section global-nav bottom-banner".split()


@pytest.mark.parametrize("name", [n for n in NAMES if n != "article-comments-no"])
@pytest.mark.parametrize("inside", [True, False])
def test_boilerplate_by_name(name, inside):
    rest = f'<div class="{name}"><p>Something else that is not the article at all, but has words too.</p></div>'
    page = f"<body><article><h1>Title</h1><p>{TEXT}</p>{rest if inside else ''}<p>{TEXT}</p></article>{'' if inside else rest}</body>"
    assert html_extract.main_text(page) == f"Title\n\n{TEXT.strip()}\n\n{TEXT.strip()}"


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "with-comments", "entry-header", "post-footer", "content-sidebar-layout", "story-body", "article-notice-text"])
def test_names_that_say_nothing(name):
    page = f'<body><div class="{name}"><p>{TEXT}</p></div><div><p>{TEXT}</p></div></body>'
    assert html_extract.main_text(page) == f"{TEXT.strip()}\n\n{TEXT.strip()}"


def test_several_articles():
    two = f"<main><article><h1>One</h1><p>{TEXT * 3}</p></article><article><h1>Two</h1><p>{TEXT}</p></article></main><footer>f</footer>"
    assert html_extract.main_text(two) == f"One\n\n{(TEXT * 3).strip()}\n\nTwo\n\n{TEXT.strip()}"
    nested = f"<body><div>menu</div><article><h1>One</h1><p>{TEXT}</p><article><p>Inner {TEXT}</p></article></article></body>"
    assert html_extract.main_text(nested).startswith("One\n\n") and "Inner" in html_extract.main_text(nested)
