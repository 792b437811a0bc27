"""What is told of pages whose names mislead, and of what stands beside the article; long cues of personal data."""

import time

from strandline.llm import html, pii

A = "A sentence of an article that goes on for a while and says something. " * 40


def told(body):
    return html.text_at(html.parse(f"<html><body><nav><a href=x>Menu</a></nav><h1>Title</h1>{body}<footer>Foot</footer></body></html>"), None)


def test_articles_in_misnamed_elements_are_kept():
    for open_, close in (("<form>", "</form>"), ('<div class="comment">', "</div>"), ('<div class="search">', "</div>"), ('<div id="login"><div>', "</div></div>")):
        text = told(f"{open_}<p>{A}</p><p>Second.</p>{close}")
        assert text == f"Title\n\n{A.strip()}\n\nSecond."
    # comments are a list of such elements, a menu is linked, a short notice is no article
    short = "An article that is short but the only one."
    many = "".join(f'<div class="comment"><p>{A[:700]}</p></div>' for _ in range(5))
    assert told(f"<article><p>{short}</p></article><div id='comments'>{many}</div>") == f"Title\n\n{short}"
    assert told(f"<p>{short}</p><form><p>Sign in here to read on.</p></form>") == f"Title\n\n{short}"
    linked = "".join(f'<a href="/{i}">{A[:90]}</a>' for i in range(30))
    assert told(f"<p>{short}</p><div class='related'>{linked}</div>") == f"Title\n\n{short}"
    assert told(f"<p>{short}</p><script>{A}</script><div hidden>{A}</div>") == f"Title\n\n{short}"


def test_a_last_section_of_its_own_is_kept():
    body = f"<div class='text'><p>{A}</p><p>{A}</p></div><div class='end'><p>The last paragraph.</p></div><div><a href=x>More of this</a></div>"
    assert told(body).endswith(f"{A.strip()}\n\nThe last paragraph.")


def test_blocks_that_recur_on_a_host_are_not_the_pages(spark):
    def page(i, notice):
        return f"<html><body><div class='text'><p>{A} {i}</p></div><div><p>{notice}</p></div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i, "We use biscuits on this site.")) for i in range(4)]
    rows += [(10 + i, f"http://b.example/{i}", page(i, f"The end of page {i}.")) for i in range(4)]
    rows += [(20, "http://c.example/1", page(1, "We use biscuits on this site.")), (20, "http://c.example/1", page(1, "We use biscuits on this site.")), (21, None, None), (None, "http://a.example/9", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in html.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert [got[i] for i in range(4)] == [[f"{A}{'' if A.endswith(' ') else ' '} {i}".replace("  ", " ")] for i in range(4)]
    assert all(got[10 + i][0].endswith(f"\n\nThe end of page {i}.") for i in range(4))
    assert len(got[20]) == 2 and all(t.endswith("biscuits on this site.") for t in got[20])  # one page, however often it comes
    assert got[21] == [""] == got[None]


def test_a_million_characters_of_cues():
    began = time.process_time()
    for text in ("token=" * 170_000, 'password: "' * 90_000, "secret = x " * 90_000, "token='" * 140_000, "a@" * 500_000, "+1 (" * 250_000, "1-" * 500_000, "http://" * 140_000):
        pii.find(text)
    assert time.process_time() - began < 20
    assert pii.find("token=token=abc123def456ghi") == [(6, 27, "secret")] and pii.find("token=" * 100) == []
