"""The labelled table of the main-text tree: pages in pieces of html, each with 1 if its blocks are main text, else 0."""

_LONG = "The harbour was still grey when the first boats came back, and nobody on the quay spoke before the crates had been counted and the prices written on the board."
_LONGER = "By noon the wind had turned, the market was empty, and the older men sat on the wall by the chapel, where they talked about the nets, the new tax and the young people who had left for the city and would not come back, whatever the minister said on the radio."
_MIDDLE = "She closed the ledger and went home by the lower road."
_NAV = "<li><a href='/home'>Home</a></li>", "<li><a href='/news'>News</a></li>", "<li><a href='/about'>About us</a></li>"

PAGES: list[list[tuple[int, str]]] = [
    # a page with article and footer, an advert as bare text between menu and article
    [
        (0, "<html><head><title>Harbour</title></head><body><nav><ul>"), *((0, x) for x in _NAV), (0, "</ul></nav><div>Fresh fish delivered to your door every day.</div>"),
        (1, "<article><h1>The harbour at dawn</h1>"), (1, f"<p>{_LONG}</p>"), (1, "<p>Nobody spoke.</p>"), (1, f"<p>{_LONGER}<br>{_MIDDLE}</p>"), (1, "<p>It rained.</p></article>"),
        (0, "<footer>&copy; harbour.example &middot; All rights reserved.</footer></body></html>"),
    ],
    # the same without a heading, with an advert of several lines, unclosed paragraphs
    [
        (0, "<nav>"), *((0, x) for x in _NAV), (0, f"</nav><div>{_MIDDLE} Order now and pay later.</div>"), (1, f"<article><p>{_LONG}"), (1, f"<p>{_LONGER}"), (1, f"<p>{_MIDDLE}"), (1, "<p>So it goes.</article>"),
        (0, "<footer>harbour.example, 12 Quay Street, written by the sea and printed on land.</footer>"),
    ],
    # main with a sidebar, a notice and reader comments outside
    [
        (0, f"<div>We use cookies. {_MIDDLE}</div><header><h2>Daily Tide</h2><p>News from the coast since 1911</p></header>"), (0, "<nav><a href='/a'>Coast</a> <a href='/b'>Sea</a></nav>"),
        (1, "<main><h1>Prices</h1>"), (1, f"<p>{_LONGER}</p>"), (1, "<h2>Why</h2>"), (1, f"<p>{_LONG} <a href='/tax'>The tax</a> {_MIDDLE}</p>"), (1, "<ul><li>Cod, nine</li><li>Hake, seven</li></ul>"), (1, f"<blockquote>{_MIDDLE}</blockquote></main>"),
        (0, f"<aside><h3>Most read</h3><p>{_LONG}</p><ul><li><a href='/1'>A storm in May</a></li><li><a href='/2'>The last ferry</a></li></ul></aside>"),
        (0, f"<div><h3>Comments</h3><p>{_LONG} I read this twice.</p><p>Thanks, a fine piece.</p><p>{_LONGER}</p></div>"), (0, "<form><label>Your name</label><p>Write to us</p></form><footer><p>Contact, imprint, terms</p></footer>"),
    ],
    # an article with its own header, a link list and a byline inside
    [
        (0, "<div>Menu</div><nav><a href='/'>Start</a></nav>"), (1, "<article><header><h1>A small port in winter</h1>"), (1, "<p>By the harbour desk</p></header>"), (1, f"<p>{_LONG}</p>"),
        (0, "<ul><li><a href='/x'>More about the port</a></li><li><a href='/y'>More about the winter</a></li></ul>"), (1, f"<p>{_LONGER}</p>"), (1, "<h2>After the storm</h2>"), (1, f"<p>{_MIDDLE}</p>"),
        (0, "<p><a href='/next'>Next page of this story</a></p></article>"), (0, "<div><p>Subscribe to our letter and never miss a tide again.</p></div><footer>Imprint</footer>"),
    ],
    # no sections: paragraphs among link lists
    [
        (0, "<body><div><a href='/1'>One</a> | <a href='/2'>Two</a> | <a href='/3'>Three</a></div>"), (1, "<div><h1>Notes on nets</h1>"), (1, f"<p>{_LONG}</p>"), (1, f"<p>{_LONGER}</p>"), (1, f"<p>{_MIDDLE} {_MIDDLE}</p>"), (1, f"<p>{_LONG} <a href='/n'>Nets</a></p></div>"),
        (0, "<div><a href='/a'>Archive of all notes</a></div><div><a href='/b'>Back to the top of the page</a></div>"), (0, "<div>Printed in May</div>"),
    ],
    # no markup but paragraphs and line breaks
    [(1, f"<p>{_LONGER} {_LONG}"), (1, f"<p>{_LONG} {_MIDDLE}"), (1, f"<p>{_MIDDLE} {_LONG}")],
    [(1, f"{_LONGER} {_LONG}<br><br>"), (1, f"{_LONG} {_LONGER}<br>"), (1, f"{_LONGER}")],
    # only menus
    [(0, "<ul>"), *((0, x) for x in _NAV), (0, "</ul><div><a href='/c'>Contact the harbour office</a></div><div>Open from nine to five</div>")],
    # divs in place of paragraphs
    [(0, "<div><a href='/'>Home</a></div><div>Menu</div>"), (1, f"<div>{_LONGER}</div>"), (1, f"<div>{_LONG} {_LONG}</div>"), (1, f"<div>{_LONGER} {_MIDDLE}</div>"), (0, "<div><a href='/t'>Terms of use</a></div><div>Site by sea.example</div>")],
    # one word and list pages inside an article
    [(0, "<nav><a href='/'>Home</a></nav><div>Boats for hire, all sizes.</div>"), (1, "<article><h1>Fog</h1>"), (1, "<p>Fog.</p>"), (1, "<p>No boats.</p>"), (1, "<ol><li>Wait.</li><li>Listen.</li></ol>"), (1, "<p>A bell rang twice.</p></article>"), (0, "<footer>Fog &copy; harbour.example.</footer>")],
    [(0, "<nav><a href='/'>Home</a></nav><div>Hire a boat.</div>"), (1, f"<article><table><tr><td>Cod</td><td>Nine crates</td></tr><tr><td>{_MIDDLE}</td></tr></table>"), (1, "Plain words after a table.</article>"), (0, "<div>Hire another boat.</div>")],
]
