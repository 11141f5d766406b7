"""Labelled pages that train the main-text model: a block of text that begins with ``MARK`` is main text.

Some are written out; others are made from layouts, parts of frames and sentences by a seeded generator, so that what a
part is called, where it stands and whether it is called anything varies.
"""

import random

MARK = "✓"

LABELLED = [
    """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Harbour reopens after storm</title><style>p{margin:0}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>
<div class="ad">Try our new engine oil. It keeps every boat running through the winter.</div>
<article><h1>✓Harbour reopens after storm</h1><p>✓The harbour opened again on Monday.<p>✓Boats had been kept ashore for nine days while the crews cleared the entrance of sand and broken timber, the port office said in a notice to owners.</p><p>✓Fees stay.</p></article>
<footer>&copy; harbour.example &middot; All rights reserved and so on.</footer></body></html>""",
    """<html><head><title>Bread</title></head><body><header class="site-header"><div id="logo">Kitchen Notes</div><nav class="menu"><a href="a">Soups</a> <a href="b">Bread</a></nav></header>
<main><article class="post"><h1>✓A plain loaf</h1><div class="byline">By the kitchen desk</div><p>✓Mix flour, water, salt and yeast, and leave the dough under a cloth until it has doubled.</p><ul><li>✓500 g flour</li><li>✓320 g water</li></ul><h2>✓Baking</h2><p>✓Bake hot.</p>
<div class="share"><a href="x">Share</a> <a href="y">Save</a></div><div class="ad banner">Buy the best pans today, with free delivery to your door.</div><p>✓Let it cool before you cut it, or the crumb will tear and the crust will go soft in a few minutes.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="1">Rye for beginners</a></li><li><a href="2">Ten soups</a></li></ul></aside></main>
<section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I tried this loaf yesterday and my family loved it, thank you so much for the recipe.</p></div><div class="comment"><p>Too salty for me.</p></div></section>
<footer><p>Kitchen Notes 2021</p></footer></body></html>""",
    """<html><body><div id="cookie" class="cookie-notice"><p>We use cookies to make this site better. By reading on you accept them.</p><button>Accept</button></div>
<div id="wrapper"><div class="top-menu"><ul><li><a href="#">Start</a><li><a href="#">About</a><li><a href="#">Contact</a></ul></div>
<div id="content" class="content"><h1>✓Notes on bridges</h1><div class="entry"><p>✓A bridge carries its load in three ways, and most bridges mix them.</p><p>✓Beams bend.</p><blockquote>✓Every arch pushes outward, said the old builder, and someone has to push back.</blockquote><table><tr><th>✓Kind<th>✓Span<tr><td>✓Beam<td>✓30 m</table></div></div>
<div id="sidebar"><h4>Tags</h4><a href="t">stone</a> <a href="s">steel</a><form action="/search"><label>Search this site</label><input name="q"><button>Go</button></form></div></div>
<div class="footer">Printed from bridges.example. Write to the editor with corrections.</div></body></html>""",
    """<html><body><nav role="navigation"><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/b">Birds</a></li></ol></nav>
<article><header><h1>✓Swifts return</h1><p class="meta">12 May, five minutes to read</p></header><section><h2>✓Arrival</h2><p>✓The first swifts were seen over the mill on Thursday evening, two days later than in the year before.</p></section><section><h2>✓Nests</h2><p>✓They use old walls.</p><pre>✓north wall 4 south wall 2</pre></section>
<aside class="related"><h3>Related stories</h3><p>How to build a nest box for the garden, step by step with drawings.</p></aside>
<form class="newsletter"><p>Get our letter each week. Enter your address below and press the button.</p><input><button>Sign up</button></form><footer class="article-footer"><p>Filed under birds</p></footer></article>
<div class="comments"><article class="comment"><p>We saw them on Wednesday already, near the church, about six of them circling.</p></article></div>
<footer>Copyright. Terms and privacy.</footer></body></html>""",
    """<html><body><div class="page"><div class="header"><a href="/">Town Courier</a></div><div class="nav"><a href="1">Local</a><a href="2">World</a></div>
<div class="main"><div class="article-body"><h1>✓Council votes on park</h1><p>✓The council voted seven to four for the new park.</p><div class="advert">Advertisement. Holiday homes from little money a week, call now.</div><p>✓Work starts in spring and should take a year, and the old trees on the east side will stay where they are.</p><h3>✓Costs</h3><p>✓No figure was given.</p></div>
<div class="social">Follow us</div><div class="promo">Subscribe now and read the first month free of charge on all your devices.</div></div>
<div class="related-posts"><h3>More</h3><p><a href="z">Park plans shown at school</a></p></div><div id="disqus_thread" class="reader-comments"><p>About time.</p><p>Who will pay for it in the end, I ask, and who will sweep the paths?</p></div></div>
<div class="legal notice">Imprint and legal notice of this paper.</div></body></html>""",
    """<html><head><title>Tide tables explained</title></head><body><nav><ul><li><a href="/x">Tides</a></li><li><a href="/y">Winds</a></li><li><a href="/z">Charts</a></li><li><a href="/w">Log in</a></li></ul></nav><!-- ad 4 --><div class="ad">Sail in the sun.</div>
<article><h1>✓Tide tables explained</h1><p><b>✓Two highs and two lows come each day.<br><p>✓The moon pulls the water toward it, and the far side bulges as well, which is why the second high comes about twelve hours and twenty-five minutes after the first.</p><p>✓Spring.</p><p>✓Read the table from the left.</p></article><footer>&copy; tides.example &middot; Made by the sea.</footer></body></html>""",
    """<html><body><header><h1>The Gardener</h1><p>A journal of small gardens and the people who keep them.</p></header><nav><a href="1">Spring</a><a href="2">Summer</a></nav>
<main id="main"><h2>✓Pruning roses</h2><p>✓Cut above an outward bud.</p><p>✓Take out dead wood first, then whatever crosses, and open up the middle so that air gets in and leaves dry after rain.</p><figure><img src="r.jpg"><figcaption>✓A bush before the cut</figcaption></figure><p>✓Clean your shears.</p></main>
<aside><p>Visit our shop for gloves, twine and shears at fair prices all through the season.</p></aside><section class="comments-area"><ol><li><p>Very helpful, I had always cut too late in the year.</p></li></ol><form><p>Leave a reply</p><textarea></textarea></form></section><footer><ul><li><a href="p">Privacy</a></li><li><a href="t">Terms</a></li></ul></footer></body></html>""",
    """<html><body><div class="alert notice" role="alert"><p>This site will be down for an hour on Sunday night while we move it.</p></div><div class="container"><div class="row"><div class="sidebar menu"><ul><li><a href="1">Install</a></li><li><a href="2">Usage</a></li></ul></div>
<div class="post-content"><h1>✓Installing the pump</h1><ol><li>✓Close the valve.</li><li>✓Loosen both nuts and lift the old pump out, keeping the seal.</li></ol><p>✓Check for drips.</p></div></div></div><div class="popup modal">Win a prize in our great summer draw, just tell us your name.</div><div class="copyright">© pumps.example</div></body></html>""",
    """<html><body><nav><a href="/">Home</a></nav><article><h1>✓Short note</h1><p>✓Done.</p></article><div class="ad">One long advert that goes on about nothing at all in order to fill the space that was paid for, with many words and few facts.</div><footer>© note.example · The end.</footer></body></html>""",
    """<html><body><div class="banner">Sale ends today.</div><section class="story"><h1>✓The night train</h1><h2>✓From coast to hills</h2><p>✓It leaves at ten.</p><p>✓Berths are narrow but clean, and a guard brings tea at six with the blinds still down and the hills going by.</p></section><section class="comment-list"><h2>Reader comments</h2><p>I took this train as a child and remember the tea.</p></section><section class="subscribe"><p>Join many readers.</p></section></body></html>""",
    """<html><body><header><a href="/">Lamp Review</a></header><main><h1>✓Lamps for reading</h1><p>✓Warm light tires the eye less.</p><form><p>Sign up for our letter</p><input><button>Send</button></form><p>✓Set the lamp to the side, so that your hand throws no shadow on the page.</p><form action="/poll"><fieldset><legend>Which lamp do you own?</legend><label>Desk</label><label>Floor</label></fieldset></form><aside><p>Other stories of the day.</p></aside><p>✓Mind the cable.</p></main><footer><p>Lamp Review since 1990</p></footer></body></html>""",
    """<html><body><div id="header"><h1>City Library</h1><form><input><button>Search</button></form></div><div id="main"><div class="text"><h2>✓Opening of the new hall</h2><p>✓The hall has seats for ninety readers and is open until ten.</p><dl><dt>✓Monday</dt><dd>✓Nine to ten</dd></dl><div class="notice">Note that this page will move soon.</div><p>✓Come and see.</p></div><div class="login"><form><p>Members log in here with their card number</p><label>Card</label><input></form></div><div class="pagination"><a href="2">Next page</a></div></div><div id="footer"><p>City Library, Main Street</p></div></body></html>""",
    """<html><body><article><header><p class="category">Travel</p><h1>✓Across the pass</h1></header><p>✓We left at dawn.</p><figure><figcaption>✓The road below the hut</figcaption></figure><aside class="advert"><p>Boots that last, now at half the price in all our shops.</p></aside><p>✓By noon the snow was soft, and we sank to the knee with every step until the ridge.</p><section class="comments"><h3>What readers say</h3><article><p>We did this last year in fog and saw nothing at all.</p></article><form><p>Write a comment</p><textarea></textarea></form></section><footer><p>Posted in Travel</p></footer></article></body></html>""",
    """<html><body><nav><ul><li><a href="a">All</a></li></ul></nav><section id="content"><article><h1>✓Salt</h1><p>✓Salt keeps.</p><ul><li>✓Coarse salt for curing</li><li>✓Fine salt for the table</li></ul><form><p>Rate this page</p></form></article></section><section id="reviews"><h2>Reviews</h2><p>I learned a lot from this page and shared it with my class at school.</p></section></body></html>""",
    """<html><head><title>Ferry times</title></head><body><nav><ul><li><a href="/q">Boats</a></li><li><a href="/r">Isles</a></li></ul></nav><!-- ad 7 --><div class="ad">Stay by the sea.</div><article><h1>✓Ferry times</h1><p>✓The ferry leaves at seven and at noon from the east pier, and comes back at dusk.</p></article><footer>&copy; ferry.example &middot; Pier office.</footer></body></html>""",
    """<html><body><nav><a href="/">Start</a></nav><div class="ad">Pens.</div><article><h1>✓Ink</h1><p>✓Ink dries slowly on smooth paper.</p><p>✓Wait.</p></article><footer>© ink.example</footer></body></html>""",
    """<html><body><header><p>The Weather Page</p></header><article><h1>✓Rain</h1><p>✓Rain is due by night.</p></article><aside><p>Winds of the week at a glance.</p></aside><footer><p>Made by the weather desk</p></footer></body></html>""",
    """<html><body><div class="header"><h1>Stone and Wood</h1></div><main><article><h2>✓Oak</h2><p>✓Oak is hard to work but lasts.</p></article></main><div class="comments"><p>Mine has lasted since my grandfather built it, and that was long ago.</p></div><div class="footer"><p>Write to us</p></div></body></html>""",
    """<html><body><header class="masthead"><h1>Valley News</h1><nav><a href="1">Top</a></nav></header><article class="story"><header><h1>✓Mill sold</h1></header><p>✓The old mill has a new owner.</p><div class="newsletter"><p>Have the news sent to you.</p></div></article><section class="comments"><article class="comment"><p>High time.</p></article><article class="comment"><p>I hope they keep the wheel turning, it is the pride of the valley.</p></article></section></body></html>""",
    """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Salt on the pier.</title></head><body><nav><ul><li><a href="/a">Piers</a></li><li><a href="/b">of</a></li></ul></nav><!-- ad 3 --><div class="ad">Rope by the yard from old stock.</div><article><h1>✓Salt on the pier.</h1><p><b>✓Salt on the pier.<br></article><footer>&copy; m.pier.example &middot; Down by the lower quay, where else.</footer></body></html>""",
    """<html><head><title>For the high water.</title></head><body><nav><ul><li><a href="/w">Water</a></li></ul></nav><div class="ad">Ein Seil und zwei Haken.</div><article><h1>✓For the high water or the low.</h1><p>✓For the high water or the low.</article><footer>&copy; water.example &middot; Une barque et deux rames.</footer></body></html>""",
]

SENTENCES = (
    "The mill at the lower lock was built in three years and has ground flour for the valley ever since.|Nobody had expected so much snow before the end of the month.|Water is let in slowly until the gates are level.|She kept the letters in a tin box under the stairs.|"
    "Most of the boats are made of oak, though the newer ones have a steel keel.|Cut the stems at an angle and put them in cold water at once.|It was late.|The engine runs at half its speed when the valves are worn, and the noise can be heard from the far bank.|"
    "A second team measured the same field in spring and found the opposite.|Prices rose by a tenth.|The old road turns left behind the church, crosses the brook on a wooden bridge and climbs through the wood to the pass.|Let the dough rest for an hour, then fold it twice.|"
    "Der Fluss tritt im Frühjahr über die Ufer und die Wiesen stehen wochenlang unter Wasser.|Niemand hat den Brief geöffnet.|La ville a été reconstruite après la guerre, pierre par pierre, selon les plans anciens.|Personne ne savait pourquoi.|"
    "El puente se abrió al tráfico en otoño y desde entonces pasan por él miles de personas cada día.|Nadie respondió.|Each sample was weighed twice, dried for a day at sixty degrees and weighed again.|The result was clear|north | south | tide | pier|keel*** mast$$$ and rope###|https://mill.example/lock?x=1|It was late|Water, flour, salt|bank### lee.***|Reed%%% rush.$$$|lock lock lock lock lock lock lock lock lock lock lock lock lock lock|from the lock to the pier and from the pier to the lock and back again the same way"
).split("|")
TITLES = "The lower lock|Winter in the valley|Keeping cut flowers|Am Fluss|La ville ancienne|El puente nuevo|A second look at the field|Folded bread|Why valves wear".split("|")
FRAMES = (
    "Contact us at our office.|Latest posts and archives.|Follow us for more stories.|Subscribe to our newsletter.|All rights reserved.|We use cookies to make this site better.|Sign up and get the news each week.|"
    "Read more|Share this|Log in|Search the site|Popular this week|Related posts|Leave a reply|Terms and privacy|Buy two and get one free in our shop.|Advertisement|Kontakt und Impressum|Suche|Mentions légales et contact|Aviso legal|"
    "Made by the desk|Home|About|Printed from the web|Published by the town press|Next page|Download our app today.|Join many thousands of readers.|Write to the editor."
).split("|")
REMARKS = "I read this twice and still can't see why it took them three years.|Great, thanks.|My aunt lived there, and she told it otherwise.|First!|Could you say more on the second point, please?".split("|")
FRAME_NAMES = "sidebar|widget-area|side-widget|footer|site-footer|header|topbar|nav-menu|related-posts|share-buttons|social|newsletter-box|promo|ad-slot|cookie-bar|breadcrumbs|author-byline|popup|pager|notice".split("|")
MAIN_NAMES = "content|main-content|post-body|article-body|entry-content|story|page-text|prose".split("|")


def made_page(seed: int) -> str:
    """A page from the generator: the same for the same seed."""
    rng = random.Random(seed)
    pick = rng.choice

    def named(names: list[str], chance: float) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(names)}"' if rng.random() < chance else ""

    def frame() -> str:
        style = rng.randrange(7)
        link = lambda: f'<a href="/{rng.randrange(99)}">{pick(FRAMES)}</a>'
        if style == 0:
            return f"<{(t := pick(['nav', 'div', 'nav']))}{named(FRAME_NAMES, 0.5)}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(1, 6))) + f"</ul></{t}>"
        if style == 1:
            return f"<div{named(FRAME_NAMES, 0.5)}>{pick(FRAMES)}</div>"
        if style == 2:
            return f"<{(t := pick(['aside', 'div', 'section']))}{named(FRAME_NAMES, 0.8)}><h3>{pick(FRAMES)}</h3><p>{pick(FRAMES)} {pick([link(), pick(FRAMES)])}</p></{t}>"
        if style == 3:
            return f"<form{named(FRAME_NAMES, 0.3)}><p>{pick(FRAMES)}</p><label>{pick(FRAMES)}</label><input><button>{pick(FRAMES)}</button></form>"
        if style == 4:
            return f"<div{named(FRAME_NAMES, 0.6)}>" + " | ".join(link() for _ in range(rng.randint(2, 4))) + "</div>"
        if style == 5:
            return f'<div class="{pick(["ad", "advert box", "sponsored", "banner"])}"><p>{pick(SENTENCES)} {pick(FRAMES)}</p></div>'
        return f"<p>{link()}</p>" if rng.random() < 0.3 else f"<div>{pick(FRAMES)} {link()}</div>"

    def paragraph() -> str:
        words = pick(TITLES) + "." if rng.random() < 0.15 else " ".join(pick(SENTENCES) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            words = words.replace(" the ", f' <a href="/{rng.randrange(9)}">the</a> ', 1)
        tag = pick(["p"] * 8 + ["blockquote", "pre"])
        return f"<p>{MARK}{words}" if tag == "p" and rng.random() < 0.2 else f"<{tag}>{MARK}{words}</{tag}>"

    def article() -> str:
        parts = [f"<h1>{MARK}{pick(TITLES)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(pick([1, 1, 1, 2, 3, 4, 5, 7])):
            parts.append(paragraph())
            other = rng.random()
            if other < 0.12:
                parts.append(f"<h{(k := rng.randint(2, 3))}>{MARK}{pick(TITLES)}</h{k}>" + paragraph())
            elif other < 0.2:
                parts.append("<ul>" + "".join(f"<li>{MARK}{pick(SENTENCES)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif other < 0.26:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{pick(TITLES)}</td><td>{MARK}{rng.randrange(99)} m</td></tr>" for _ in range(2)) + "</table>")
            elif other < 0.38:
                parts.append(frame())
        return "".join(parts)

    def remarks() -> str:
        tag = pick(["div", "section"])
        first, last, opens = pick([("<div>", "</div>", [""]), ("<li><article>", "</article></li>", ["<ol>", "<ul>"]), ("<article>", "</article>", [""]), ('<li><div class="comment">', "</div></li>", ["<ol>", "<ul>"])])
        return f'<{tag} {pick(["class", "id"])}="{pick(["comments", "comment-list", "reader-comments", "discussion", "responses"])}"><h3>Comments</h3>{pick(opens)}' + "".join(f"{first}<p>{pick(REMARKS)}</p>{last}" for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    tag = pick(["article", "main", "div", "div", "section", "td"])
    body = article()
    if rng.random() < 0.4:
        body = f"<div{named(MAIN_NAMES, 0.7)}>{body}</div>"
    core = f"<{tag}{named(MAIN_NAMES, 0.6)}>{body}</{tag}>"
    before, after = "".join(frame() for _ in range(rng.randint(0, 3))), "".join(frame() for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.35:
        after = remarks() + after
    head = f"<header{named(FRAME_NAMES, 0.4)}><{(t := pick(['p', 'h1', 'div']))}>{pick(['The Gazette', 'Valley Notes', 'Blog', 'Tageblatt'])}</{t}></header>" if rng.random() < 0.5 else ""
    foot = f"<footer>{pick(['©', 'Copyright', '&copy;'])} {pick(FRAMES)}</footer>" if rng.random() < 0.6 else f"<div{named(['footer', 'bottom', 'foot'], 0.7)}>{pick(FRAMES)}</div>"
    if tag == "td":
        return f"<html><body>{head}<table><tr><td>{before}</td>{core}<td>{after}</td></tr></table>{foot}</body></html>"
    if rng.random() < 0.3:
        core = f"<div>{core}</div>"
    return f"<html><body>{head}{before}{core}{after}{foot}</body></html>"


def plain_page(seed: int) -> str:
    """A page without a frame: text alone, or a few paragraphs."""
    rng = random.Random(-1 - seed)
    blocks = [MARK + " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(1, 3))) for _ in range(1 + seed % 3)]
    if seed % 2 == 0:
        blocks = [MARK + rng.choice(["It was ", "Let us see ", "Here is ", "One "]) + " ".join(rng.choice(TITLES).lower().split()[: rng.randint(1, 4)]) + "."]
    if seed % 3 == 0:
        return blocks[0]
    title = f"<h1>{MARK}{rng.choice(TITLES)}</h1>" if seed % 3 == 1 else ""
    inner = title + "".join(f"<p>{b}</p>" for b in blocks)
    if seed % 5 < 2:
        inner = f"<{(t := rng.choice(['article', 'main', 'div']))}>{inner}</{t}>"
    return inner if seed % 4 < 2 else f"<html><body>{inner}</body></html>"


def training_pages(made: int = 70) -> list[str]:
    return LABELLED * 2 + [made_page(seed) for seed in range(made)] + [plain_page(seed) for seed in range(made // 2)]
