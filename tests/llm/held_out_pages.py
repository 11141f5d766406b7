"""Hand-labelled pages of layouts that the main-text model is not trained on; main blocks begin with the mark."""

PAGES = {
    "blog with widgets": """<html><head><title>My bees | Hill Blog</title><script>var a="<p>x</p>";</script></head><body class="home blog"><div id="page" class="hfeed"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Hill Blog</a></p><p>Notes from a small farm</p></div><nav id="site-navigation"><div class="menu-main-container"><ul id="primary-menu"><li class="menu-item"><a href="/">Start</a></li><li class="menu-item"><a href="/about">About me</a></li></ul></div></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main"><article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">✓My bees came through the winter</h1><div class="entry-meta">Posted on <a href="d">3 March</a> by <a href="u">Ida</a></div></header><div class="entry-content"><p>✓Eleven of twelve hives were alive when I opened them on the first warm day.</p><p>✓The one that died had been weak since autumn, and I should have joined it with its neighbour then.</p><p>✓Feeding starts next week.</p></div><footer class="entry-footer">Posted in <a href="c">Bees</a></footer></article>
<div id="comments" class="comments-area"><h2>2 thoughts on “My bees”</h2><ol><li><article><p>Congratulations, mine did not do half as well this year.</p></article></li><li><article><p>What do you feed them?</p></article></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href="1">Planting hazel</a></li></ul></section><section class="widget"><p>Latest posts and archives.</p></section></aside></div><footer id="colophon"><div class="site-info">Proudly powered by a hen</div></footer></div></body></html>""",
    "no classes at all": """<html><body><div><a href="/">Regional Observer</a> <a href="/b">Sport</a> <a href="/c">Culture</a></div><div><div><h1>✓Bridge closed for two weeks</h1><p>✓The bridge at Nordtal will be closed to all traffic from Monday while its bearings are replaced.</p><p>✓Buses will go round by the mill, which adds about ten minutes to the ride.</p></div><div><h3>More from the region</h3><ul><li><a href="1">School roof repaired</a></li><li><a href="2">New doctor for Nordtal</a></li></ul></div></div><div>Contact us at our office.</div></body></html>""",
    "encyclopedia": """<html><body><div id="mw-page-base"></div><div id="content" role="main"><h1 id="firstHeading">✓Limestone pavement</h1><div id="bodyContent"><div class="toc" role="navigation"><h2>Contents</h2><ul><li><a href="#f">1 Formation</a></li><li><a href="#p">2 Plants</a></li></ul></div><p>✓A limestone pavement is a flat expanse of exposed <a href="l">limestone</a> formed by a combination of erosion by ice and solution by water.</p><h2>✓Formation</h2><p>✓Glaciers scrape away the soil and leave bare rock.</p><ul><li>✓Blocks between the joints are called clints</li><li>✓The joints themselves are called grikes</li></ul><table><tr><td>✓Depth of grikes</td><td>✓0.5 to 2 m</td></tr></table></div></div><div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href="m">Main page</a></li><li><a href="r">Random article</a></li></ul></div><div id="footer"><ul><li>This page was last edited on 3 May.</li><li><a href="p">Privacy policy</a></li></ul></div></body></html>""",
    "table layout of old": """<html><body bgcolor=white><table width=100%><tr><td colspan=3><font size=6>The Clock Page</font></td></tr><tr><td width=150><a href=a.htm>Home</a><br><a href=b.htm>Clocks</a><br><a href=c.htm>Links</a></td><td><h2>✓Cleaning a pendulum clock</h2><p>✓Take the movement out of the case and let down the springs before you do anything else.<p>✓Wash the plates in warm water with a little ammonia, brush out every hole with pegwood and dry them well.<p>✓Oil sparingly.</td><td width=120>Sponsors<br><a href=x>Old Tools</a></td></tr></table><center>Best viewed on paper</center></body></html>""",
    "newspaper in german": """<html><body><div class="cmp-layer"><p>Wir verwenden Cookies, um Inhalte zu personalisieren.</p><button>Alle akzeptieren</button></div><div class="kopf"><a href="/">Tagblatt</a></div><ul class="ressorts"><li><a href="1">Politik</a></li><li><a href="2">Sport</a></li></ul><article class="artikel"><span class="kicker">✓Verkehr</span><h1>✓Neue Brücke über die Aller</h1><p class="vorspann">✓Nach drei Jahren Bauzeit rollt der Verkehr wieder über den Fluss.</p><p>✓Die Arbeiten dauerten länger als geplant, weil im Flussbett alte Pfähle gefunden wurden.</p><div class="werbung">Anzeige: Jetzt Probe lesen und sparen.</div><p>✓Die Kosten stiegen auf neun Millionen Euro.</p></article><div class="mehr"><h4>Lesen Sie auch</h4><a href="9">Fähre bleibt in Betrieb</a></div><div class="leserbriefe comments"><p>Endlich, das wurde aber auch Zeit nach all den Jahren.</p></div><div class="fuss"><a href="i">Impressum</a> <a href="d">Datenschutz</a></div></body></html>""",
    "documentation": """<html><body><div class="wy-nav-side"><div class="search"><form><input><button>Search docs</button></form></div><ul class="toctree"><li><a href="i">Install</a></li><li><a href="u">Usage</a></li><li><a href="a">Reference</a></li></ul></div><section class="wy-content-wrap"><ul class="breadcrumbs"><li><a href="/">Docs</a></li><li>Install</li></ul><div class="document" itemprop="articleBody"><h1>✓Install</h1><p>✓Fetch the archive and unpack it where you want the program to live.</p><pre>✓tar xf prog.tar &amp;&amp; cd prog</pre><p>✓Then run the tests once before you change anything, so that you know they pass.</p><div class="admonition"><p>✓The tests need a network only if you ask for it.</p></div></div><footer><div><a href="n">Next</a> <a href="p">Previous</a></div><p>© Prog authors</p></footer></section></body></html>""",
    "recipe": """<html><body><header class="top"><a href="/">Pot and Pan</a></header><div class="newsletter-pop"><h2>Get 10 recipes free</h2><p>Leave your address and we send them at once.</p></div><div class="recipe"><h1>✓Leek soup</h1><p>✓A soup for the first cold evening, ready in forty minutes.</p><h2>✓Ingredients</h2><ul><li>✓3 leeks</li><li>✓2 potatoes</li><li>✓1 l stock</li></ul><h2>✓Method</h2><ol><li>✓Cut the leeks into rings and soften them in butter without letting them brown.</li><li>✓Add potatoes and stock and simmer until soft.</li></ol><div class="share-bar"><a href="1">Pin it</a> <a href="2">Mail it</a></div></div><div id="reviews"><h3>Reviews</h3><p>Made it with cream and it was even better, my children asked for more.</p></div><div class="bottom-links"><a href="p">Privacy</a></div></body></html>""",
    "essay with footnote links": """<html><body><nav><a href="/">Essays</a></nav><main><article><h1>✓On walking slowly</h1><p>✓Whoever walks slowly sees <a href="#1">more</a>, and <a href="#2">hears</a> more too.</p><blockquote><p>✓The road is long for him who counts the stones.</p></blockquote><p>✓I have tried both.</p><p>✓On the way to the station one must hurry, of course, but who goes to the station every day?</p><section class="related"><h2>Related essays</h2><ul><li><a href="3">On sitting still</a></li></ul></section></article></main><footer><small>All rights reserved.</small></footer></body></html>""",
    "shop blog": """<html><body><div class="announcement-bar">Free delivery from 40 euros this week only</div><div class="header-wrap"><a href="/">Wool and Needle</a><a href="/cart">Cart (0)</a></div><div class="blog-post"><h1>✓How to wash wool</h1><div class="rte"><p>✓Wool felts when it is rubbed while warm and wet, so do neither.</p><p>✓Press the water out in a towel and dry the piece flat, away from the sun.</p></div></div><div class="product-recommendations"><h2>You may also like</h2><div><a href="s">Wool soap</a><span>9.90</span></div></div><div class="signup-block"><form><p>Join our list</p><input><button>Join</button></form></div><div class="site-foot"><p>Wool and Needle, Market Square 3</p></div></body></html>""",
    "ministry notice": """<html><body><div id="skip"><a href="#m">Skip to content</a></div><div id="banner"><p>Ministry of Waters</p></div><div id="m"><h1>✓Rules for small boats</h1><p>✓Boats below five metres need no licence on lakes.</p><p>✓On rivers a licence is needed as soon as an engine is on board, whether it runs or not.</p><h2>✓Fees</h2><table><tr><th>✓Boat</th><th>✓Fee</th></tr><tr><td>✓Rowing boat</td><td>✓none</td></tr></table></div><div id="feedback"><form><p>Was this page helpful?</p><button>Yes</button><button>No</button></form></div><div id="foot"><ul><li><a href="a">Accessibility</a></li><li><a href="s">Sitemap</a></li></ul></div></body></html>""",
    "magazine in french": """<html><body><div class="bandeau-cookies"><p>Nous utilisons des cookies pour améliorer le site.</p></div><header><a href="/">La Gazette</a></header><div class="colonne-gauche"><a href="1">Voyages</a><a href="2">Cuisine</a></div><div class="corps"><h1>✓Trois jours dans les Alpes</h1><p>✓Le premier jour, nous sommes montés jusqu'au refuge par le sentier du nord.</p><p>✓La neige était encore haute au col et il a fallu attendre midi pour passer.</p><p>✓Quel silence !</p></div><div class="commentaires comments"><p>Merci pour ce beau récit, on partira aussi cet été.</p></div><div class="pied-de-page"><p>Mentions légales et contact</p></div></body></html>""",
    "video page": """<html><body><div class="nav-bar"><a href="/">Lectures</a><a href="/l">Live</a></div><div class="player"><iframe src="v"><p>No frames</p></iframe></div><div class="description"><h1>✓Lecture 4: tides</h1><p>✓In this lecture we derive the height of the tide from the pull of the moon and compare it with what harbours measure.</p><p>✓Bring the tables from last week.</p></div><div class="up-next"><h3>Up next</h3><ul><li><a href="5">Lecture 5: winds</a></li><li><a href="6">Lecture 6: waves</a></li></ul></div><div class="responses"><p>The part on resonance was the best so far, thank you.</p></div></body></html>""",
}
