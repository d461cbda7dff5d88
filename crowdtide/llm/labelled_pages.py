"""Labelled pages from which the extractor learns what an article looks like.

Each layout is markup in which ``{{...}}`` stands for a block of main text and ``((...))`` for any
other; the number gives its words.  Filling a layout with words of several alphabets and lengths
gives pages whose blocks have known labels.  The set is small and of fixed size; it does not grow
with the corpus.
"""

from __future__ import annotations

import random
import re

LAYOUTS = (
    "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>((1))</a></li><li><a href='/b'>((1))</a></li><li><a href='/c'>((2))</a></li></ul></nav>"
    "<div class='ad'>((9))</div><article><h1>{{7}}</h1><p>{{40}}</p><p>{{25}}</p><p>{{3}}</p></article><footer>((8))</footer></body></html>",
    "<body><nav><ul><li><a href='/a'>((1))</a></li><li><a href='/b'>((1))</a></li></ul></nav><div class='ad'>((14))</div>"
    "<article><h1>{{3}}</h1><p>{{2}}</p></article><footer>((20))</footer></body>",
    "<body><div class='ad'>((6))</div><article><h1>{{8}}</h1><p><b>{{30}}<br><p>{{60}}<p>{{12}}</article><div class='ad banner'>((5))</div><footer>((4))<p>((9))</footer></body>",
    "<body><header class='site-header'><h1>((3))</h1><p>((6))</p></header><ul class='menu'><li><a href='#'>((1))</a></li><li><a href='#'>((1))</a></li></ul>"
    "<main><h2>{{6}}</h2><p>{{35}}</p><blockquote>{{18}}</blockquote><ul><li>{{7}}</li><li>{{9}}</li></ul><p>{{50}}</p></main>"
    "<aside class='sidebar'><h3>((2))</h3><ul><li><a href='#'>((4))</a></li><li><a href='#'>((5))</a></li></ul></aside><footer><p>((7))</p></footer></body>",
    "<body><div id='header'><a href='/'>((2))</a></div><div id='nav'><a href='#'>((1))</a><a href='#'>more</a></div><div id='content' class='post'><h1>{{5}}</h1>"
    "<div class='entry-content'><p>{{45}}</p><p>{{30}}</p><pre>{{15}}</pre><table><tr><td>{{2}}</td><td>{{3}}</td></tr></table></div></div>"
    "<div id='comments'><h3>((2))</h3><div class='comment'><p>((20))</p></div><div class='comment'><p>((12))</p></div></div><div id='footer'>((8))</div></body>",
    "<body><div class='cookie-notice'><p>((16))</p><button>((1))</button></div><nav><a href='#'>((1))</a><a href='#'>more</a></nav>"
    "<article><header><h1>{{6}}</h1></header><section><p>{{33}}</p><figure><figcaption>{{8}}</figcaption></figure><p>{{28}}</p></section>"
    "<section class='comments'><h2>((1))</h2><article class='comment'><p>((22))</p></article><form><label>((2))</label><button>((1))</button></form></section></article><footer>((6))</footer></body>",
    "<body><div role='navigation'><a href='#'>((1))</a><a href='#'>more</a></div><div role='main'><h1>{{7}}</h1><p>{{50}}</p><div class='ad'>((8))</div><p>{{44}}</p>"
    "<div class='share'><a href='#'>((1))</a><a href='#'>more</a></div><p>{{25}}</p></div><div role='contentinfo'>((9))</div></body>",
    "<body><header><nav><ul><li><a href='#'>((1))</a></li></ul></nav></header><div class='notice'><p>((18))</p></div><article><h1>{{5}}</h1><p>{{5}}</p><p>{{70}}</p></article>"
    "<aside><p>((25))</p></aside><div class='newsletter'><form><p>((9))</p><input><button>((1))</button></form></div><footer><ul><li><a href='#'>((2))</a></li></ul><p>((6))</p></footer></body>",
    "<body><table class='layout'><tr><td class='menu'><a href='#'>((1))</a><br><a href='#'>more</a></td><td class='main-text'><h1>{{4}}</h1><p>{{40}}</p><p>{{38}}</p></td>"
    "<td class='sidebar'><p>((12))</p></td></tr></table><div class='footer'>((6))</div></body>",
    "<body><article><h1>{{6}}</h1><p>{{30}}</p><aside class='related'><h4>((2))</h4><a href='#'>((6))</a></aside><p>{{26}}</p><div class='advert promo'><p>((11))</p></div><p>{{31}}</p></article>"
    "<section id='discussion'><div class='reply'><p>((15))</p></div><div class='reply'><p>((4))</p></div></section><footer>((5))</footer></body>",
    "<body><nav class='breadcrumb'><a href='#'>((1))</a><a href='#'>more</a></nav><main><article><h1>{{4}}</h1><p>{{9}}</p><ol><li>{{12}}</li><li>{{14}}</li></ol><h2>{{3}}</h2><p>{{55}}</p></article>"
    "<form class='search'><label>((2))</label></form></main><footer><p>((10))</p></footer><div class='popup'><p>((10))</p></div></body>",
    "<body><nav><ul><li><a href='#'>((1))</a></li></ul></nav><div class='banner'>((7))</div><div class='alert'>((9))</div><form><p>((6))</p></form></body>",
    "<body><h1>{{5}}</h1><p>{{60}}</p><p>{{40}}</p><p>{{22}}</p></body>",
    "<body><div><div><p>{{48}}</p><p>{{36}}</p></div></div></body>",
)
_WORDS = {
    "latin": "the of and over quietly river stone lantern märchen für été señor garden walk slowly number seven light between",
    "odd": "THE!! AND!! RIVER!! lorem*** ipsum%%% dolor&&& sit### amet$$$ | alpha | beta",
    "cyrillic": "река камень свет между тихо семь сад идти над домом",
}
_SLOT = re.compile(r"\{\{(\d+)\}\}|\(\((\d+)\)\)")


def labelled_pages(rounds: int = 6, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """(html, is the block main text, block by block) for every layout and round."""
    draw = random.Random(seed)
    pages = []
    for k in range(rounds):
        words = _WORDS[("latin", "odd", "latin", "cyrillic", "latin", "odd")[k % 6]].split()
        for layout in LAYOUTS:
            labels: list[bool] = []

            def fill(slot, words=words, labels=labels, k=k):
                labels.append(slot[1] is not None)
                # the number of words varies widely, so that length alone does not tell
                n = max(1, round(int(slot[1] or slot[2]) * draw.choice((0.3, 0.7, 1, 1.5, 4))))
                text = " ".join(draw.choice(words) for _ in range(n))
                return text + ("." if slot[1] and draw.random() < 0.7 or draw.random() < 0.2 else "")

            pages.append((_SLOT.sub(fill, layout), labels))
    return pages
