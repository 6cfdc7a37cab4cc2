"""What main text keeps and drops, and packing of short documents."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lodestone.llm import packing, site_template

ARTICLE = "<html><body>{}</body></html>"
CASES = [
    # reader comments, sidebars and footers that hold articles of their own
    ('<article><p>Main</p></article><section class="comments"><h2>Comments</h2><article><p>reader says</p></article></section>', "Main"),
    ('<article><p>Main</p></article><aside><article class="card"><p>Card</p></article></aside>', "Main"),
    ('<article><p>Main</p></article><footer><article><p>Foot</p></article></footer>', "Main"),
    ('<header><article><p>Teaser</p></article></header><article><p>Main</p></article>', "Main"),
    ('<article><p>Main</p><section class="comments"><article><p>reader says</p></article></section></article>', "Main"),
    ('<article><p>Main</p></article><ul><li><article><p>Card 1</p></article></li><li><article><p>Card 2</p></article></li></ul>', "Main"),
    ('<ul><li><article><p>One</p></article></li><li><article><p>Two</p></article></li></ul>', "One\nTwo"),
    ('<form><article><p>Main</p></article><input></form>', "Main"),
    ('<article><p>Main</p><nav>menu</nav><form>form</form><aside>aside</aside><div class="ad">buy</div></article>', "Main"),
    # single words of names inside articles
    ('<article><p class="share-price">Price</p></article>', "Price"),
    ('<article><div class="related-work">Work</div></article>', "Work"),
    ('<article><section class="notice">Notice</section></article>', "Notice"),
    ('<article><table class="ad-hoc"><tr><td>Ad hoc</td></tr></table></article>', "Ad hoc"),
    ('<article><ul class="share-of-votes"><li>Votes</li></ul></article>', "Votes"),
    ('<article><table id="reply-times"><tr><td>Times</td></tr></table></article>', "Times"),
    # no marks of articles
    ('<div class="menu">m</div><div class="text">Body &amp; soul</div><div class="sidebar">s</div><div class="share-price">9</div>', "Body & soul\n9"),
    ('<main><p>Main</p><div class="cookie">c</div></main><div>else</div>', "Main\nc"),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_main_text(html, want):
    page = site_template.Page(ARTICLE.format(html))
    articles = page.articles()
    assert page.text(page.furniture(articles), articles) == want


@pytest.mark.parametrize(("low", "high"), [(3, 3), (10, 10), (20, 20), (1, 40), (1, 5_000)])
def test_packing_pads_nothing(low, high):
    """Every sequence is of 2048 ids or a power of two, of 64 pieces at most, and each id lies in one piece."""
    dice = random.Random(low)
    packer = packing.DocumentPacker()
    docs = {i: dice.randint(low, high) for i in range(20_000 if high < 100 else 500)}
    for i, n in docs.items():
        packer.add(i, b"\1\0\0\0" * n)
    packer.finish()
    sequences, parts = defaultdict(list), defaultdict(list)
    for doc, start, length, _, total, sequence, offset in packer.rows:
        assert total == docs[doc]
        sequences[sequence].append((offset, length))
        parts[doc].append((start, length))
    for pieces in (*sequences.values(), *parts.values()):
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
    sizes = {s: sum(n for _, n in p) for s, p in sequences.items()}
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    assert all(len(p) <= packing.LIMITS[1] for p in sequences.values())
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == docs


def test_numbers_of_a_million_files():
    for last in (0, 524_287, 524_288, 999_999):
        counter, high = packing.number_bits([f"file:/x/part-{last:05d}-a.parquet", "file:/x/part-00000-a.parquet"])
        assert (last << high) + (((1 << 24) - 1) << counter) + (1 << counter) <= 1 << 63 and counter >= 19
