"""Pages written by hand, of layouts that the generator of training pages doesn't make, with their main text."""

BLOG = (
    """<html><head><title>Winter bread</title><meta charset=utf-8></head><body class="home page-template">
<div id="page"><div id="masthead" class="site-header"><p class="site-title"><a href="/">The Slow Kitchen</a></p><p class="site-description">Notes on dough and time</p></div>
<div id="primary-menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/archive">Archive</a></div>
<div id="content"><div class="post hentry"><h1 class="entry-title">Winter bread</h1>
<div class="entry-content"><p>In the cold months a dough needs patience more than it needs yeast, and my kitchen at fifteen degrees is a good teacher of that.</p>
<p>I mix flour &amp; water in the evening, leave it on the sill, and look at it again before work. Nothing has happened, and that is as it should be.</p>
<blockquote>Give it a day. If it looks ready, give it an hour more.</blockquote>
<p>By the second evening it has doubled, and it goes into a hot pot for three quarters of an hour.</p></div></div>
<div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely, I tried it with rye and it worked on the first attempt, thank you.</p></li><li class="comment"><p>How hot is the pot?</p></li></ol></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/1">Plum jam</a></li><li><a href="/2">Autumn soup</a></li></ul></div></div>
<div id="colophon" class="site-footer">Proudly baked since 2009. All rights reserved.</div></div></body></html>""",
    """Winter bread
In the cold months a dough needs patience more than it needs yeast, and my kitchen at fifteen degrees is a good teacher of that.
I mix flour & water in the evening, leave it on the sill, and look at it again before work. Nothing has happened, and that is as it should be.
Give it a day. If it looks ready, give it an hour more.
By the second evening it has doubled, and it goes into a hot pot for three quarters of an hour.""",
)
NEWS = (
    """<!doctype html><html lang=en><body><div role="banner" class="top-bar"><a href="/">Daily Ledger</a></div><nav aria-label="sections"><ul><li><a href=/w>World</a><li><a href=/s>Sport</a><li><a href=/m>Money</a></ul></nav>
<main><article itemprop="articleBody"><h1>Bridge reopens after four years</h1><p>The old bridge over the Varn was opened again on Monday, four years after a flood had carried two of its arches away.</p>
<div class="advert"><p>Sponsored: the best umbrellas for every kind of weather, now at half the price.</p></div>
<p>Engineers had planned for two years, but the river, they said, did not read plans. The cost rose from 3 to 7 million.</p><p>&quot;We walk to school again&quot;, said a girl from the northern bank, and she did.</p>
<aside class="related"><h4>Read also</h4><ul><li><a href=/x>Flood of the century</a></li><li><a href=/y>Who pays for bridges?</a></li></ul></aside>
<p>The ferry that served in the meantime will be sold in spring.</p></article></main>
<section class="newsletter-signup"><form action=/n><p>Get the morning letter, free, every day.</p><input name=e><button>Subscribe</button></form></section>
<footer role="contentinfo"><p>&copy; Daily Ledger &middot; <a href=/i>Imprint</a> &middot; <a href=/p>Privacy</a></p></footer></body></html>""",
    """Bridge reopens after four years
The old bridge over the Varn was opened again on Monday, four years after a flood had carried two of its arches away.
Engineers had planned for two years, but the river, they said, did not read plans. The cost rose from 3 to 7 million.
"We walk to school again", said a girl from the northern bank, and she did.
The ferry that served in the meantime will be sold in spring.""",
)
PLAIN = (
    """<html><body><h1>On knots</h1><p>A knot is a promise that a rope makes to itself, and like other promises it holds best while it is under some strain.<p>The bowline is the first one that anybody should learn, since it neither slips nor jams and can be undone by a child.<p>The second is the clove hitch, which is quick.</body></html>""",
    """On knots
A knot is a promise that a rope makes to itself, and like other promises it holds best while it is under some strain.
The bowline is the first one that anybody should learn, since it neither slips nor jams and can be undone by a child.
The second is the clove hitch, which is quick.""",
)
MATH = (
    """<html><body><header><a href="/">Notes</a></header><article class="post"><h2>Right triangles</h2><p>In every right triangle the sides satisfy <math><msup><mi>a</mi><mn>2</mn></msup><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></math>, as was known long before Pythagoras.</p>
<p>The figure <svg viewBox="0 0 9 9"><text x="1">shows a triangle</text></svg> and <object data="x.svg">a square beside it</object>, drawn to scale by the author.</p><p>AT&<b>amp;</b>T is a company, and AT&amp;T is its name.</p></article><footer>&copy; Notes 2020</footer></body></html>""",
    """Right triangles
In every right triangle the sides satisfy a2+b2=c2, as was known long before Pythagoras.
The figure shows a triangle and a square beside it, drawn to scale by the author.
AT&amp;T is a company, and AT&T is its name.""",
)
ALL = [BLOG, NEWS, PLAIN, MATH]
