import pytest

from ledgerloom.llm.html_text import candidates, lines_of

KEPT = ['style="overflow:hidden"', "style='visibility:hidden'", 'title="a hidden gem"', 'data-id="comment"', 'data-class="ad"', 'data-x="p" title="role=navigation"', "data-hidden", "data-x=hidden", 'title="id=\'share\'"', 'x-role="navigation"']
LOST = ["hidden", "HIDDEN", 'hidden=""', "title='x'hidden", 'class="ad"', "CLASS = 'x share'", "id=comments", 'role="navigation"', 'aria-hidden="true"', 'title="ok" hidden', "data-x=1 class=ad"]


def kept(page):
    lines = lines_of(page)
    return "\n".join(lines[i].text for i in candidates([x.stands for x in lines]))


@pytest.mark.parametrize("attributes", KEPT)
def test_names_inside_values_and_longer_names_do_not_count(attributes):
    assert kept(f"<article><p>a</p><div {attributes}>b</div></article>") == "a\nb"


@pytest.mark.parametrize("attributes", LOST)
def test_attributes_that_mark_furniture(attributes):
    assert kept(f"<article><p>a</p><div {attributes}>b</div></article>") == "a"


def test_words_of_a_link_stay():
    page = '<article><p>see <a href="/hidden-valley/story">the valley</a> and <a href=/id/comment>that</a></p></article>'
    assert kept(page) == "see the valley and that"
