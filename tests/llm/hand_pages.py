"""Pages written by hand, in styles of several decades, and their main texts; none of them was made by the generator of training pages."""

# fmt: off
PAGES = {
"table layout": ("""<html><head><title>Harbour news</title><style>td {color: red}</style></head><body bgcolor=white><table width=100%><tr><td colspan=2><img src=logo.gif> <a href=/>Home</a> | <a href=/a>Archive</a> | <a href=/c>Contact</a></td></tr><tr><td width=150><a href=/1>Local</a><br><a href=/2>Sport</a><br><a href=/3>Weather</a></td><td><h2>Bridge reopens after repairs</h2><p>The old bridge over the river was opened again on Monday, eleven months after engineers had found cracks in two of its pillars.</p><p>Traffic is limited to one lane until spring, and lorries have to take the motorway.</p></td></tr><tr><td colspan=2><font size=1>Copyright 2003 Harbour News. All rights reserved.</font></td></tr></table></body></html>""",
 "Bridge reopens after repairs\n\nThe old bridge over the river was opened again on Monday, eleven months after engineers had found cracks in two of its pillars.\n\nTraffic is limited to one lane until spring, and lorries have to take the motorway."),
"html5": ("""<!doctype html><html lang=en><head><meta charset=utf-8><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Kitchen</a><nav><ul><li><a href=/r>Recipes</a></li><li><a href=/b>Books</a></li></ul></nav></header><main><article><h1>Bread without kneading</h1><p>Mix flour, water, salt &amp; yeast in the evening. Cover the bowl and leave it on the table overnight.</p><h2>Baking</h2><p>Heat the oven with the pot inside.</p><ul><li>Bake 30 minutes with the lid on.</li><li>Bake 15 minutes without it.</li></ul><blockquote>Good bread takes time, not work.</blockquote></article><section class="comments"><h3>2 comments</h3><p>Anna: I tried this and it was great!</p></section></main><aside><h3>Popular</h3><a href=/1>Soup</a></aside><footer><p>&copy; Kitchen. <a href=/privacy>Privacy</a></p></footer></body></html>""",
 "Bread without kneading\n\nMix flour, water, salt & yeast in the evening. Cover the bowl and leave it on the table overnight.\n\nBaking\n\nHeat the oven with the pot inside.\n\nBake 30 minutes with the lid on.\n\nBake 15 minutes without it.\n\nGood bread takes time, not work."),
"divs without names": ("""<html><body><div><a href=/>Start</a> <a href=/x>Blog</a> <a href=/y>About</a> <a href=/z>Login</a></div><div><div><h1>Why moss grows on the north side</h1></div><div>Moss has no roots, so it takes up water through its leaves. On the shady side of a tree the bark stays wet for longer, and that is where it grows best.</div><div>In dense forests the light comes from above only, and moss grows all around the trunk; so it isn't a good compass there.</div></div><div><form action=/s><input name=mail><button>Subscribe</button></form></div></body></html>""",
 "Why moss grows on the north side\n\nMoss has no roots, so it takes up water through its leaves. On the shady side of a tree the bark stays wet for longer, and that is where it grows best.\n\nIn dense forests the light comes from above only, and moss grows all around the trunk; so it isn't a good compass there."),
"weblog": ("""<html><body class="home blog"><div id="wrapper"><div id="masthead"><h1><a href="/">A walk a day</a></h1></div><div id="access"><ul><li><a href="/about">About</a></li><li><a href="/photos">Photos</a></li></ul></div><div id="primary"><div class="hentry"><h2 class="entry-title">Along the canal</h2><div class="entry-content"><p>We started at the lock before sunrise, when the herons were still asleep, and followed the towpath for nine miles.</p><p>There is a <a href="/pub">pub</a> at the third bridge with a garden by the water.</p><pre>lock  3.1 mi\npub   5.4 mi</pre></div><div class="sharedaddy"><a href=#>Share on a network</a></div></div></div><div id="secondary"><ul><li><a href=/1>January</a></li><li><a href=/2>February</a></li></ul></div><div id="colophon">Proudly powered by software.</div></div></body></html>""",
 "Along the canal\n\nWe started at the lock before sunrise, when the herons were still asleep, and followed the towpath for nine miles.\n\nThere is a pub at the third bridge with a garden by the water.\n\nlock 3.1 mi pub 5.4 mi"),
"notice and advert": ("""<html><body><div class="cookie-consent">We use cookies to improve your experience. <button>Accept</button></div><div role=banner>Daily Ledger</div><div role=main><h1>Bank keeps its rate</h1><p class=lead>The central bank left its rate unchanged on Thursday, as most analysts had expected.</p><div class="advert"><a href=//x>Buy gold now</a></div><p>The governor said that inflation was falling more slowly than in the winter, and that the board would look at new figures in June.</p><p>Shares rose a little after the announcement.</p></div><div role=contentinfo>Terms of use | Imprint</div></body></html>""",
 "Bank keeps its rate\n\nThe central bank left its rate unchanged on Thursday, as most analysts had expected.\n\nThe governor said that inflation was falling more slowly than in the winter, and that the board would look at new figures in June.\n\nShares rose a little after the announcement."),
"plain paragraphs": ("""<h1>Notes on tides</h1><p>Tides follow the moon more than the sun, since the moon is so much nearer to us than the sun is.</p><p>Twice a month both pull along the same line, and the range is largest.</p><noscript><p>Figures can be seen with scripts only.</p></noscript>""",
 "Notes on tides\n\nTides follow the moon more than the sun, since the moon is so much nearer to us than the sun is.\n\nTwice a month both pull along the same line, and the range is largest.\n\nFigures can be seen with scripts only."),

"documentation": ("""<html><body><nav class="toc"><a href=#a>Install</a><a href=#b>Use</a><a href=#c>Questions</a></nav><section id=doc><h1>Installing the pump</h1><p>Close the main valve before you open the housing, and let the water in the pipe run off.</p><h3>Tools</h3><ul><li>A wrench of 17 mm.</li><li>Two seals, which come with the pump.</li></ul><table><tr><td>Weight</td><td>4 kg</td></tr></table></section><div class="newsletter"><p>Get our offers by mail every week.</p><input></div></body></html>""",
 "Installing the pump\n\nClose the main valve before you open the housing, and let the water in the pipe run off.\n\nTools\n\nA wrench of 17 mm.\n\nTwo seals, which come with the pump.\n\nWeight\n\n4 kg"),
"centred": ("""<html><body><center><a href=/>Index</a> - <a href=/n>Next</a></center><h2>Letter from the coast</h2><p>It has rained since Tuesday, and the road to the village is closed, so the mail comes by boat.</p><p>My neighbour lends me books, of which I have read eleven.</p><hr><center>Last change: 3 May 1999</center></body></html>""",
 "Letter from the coast\n\nIt has rained since Tuesday, and the road to the village is closed, so the mail comes by boat.\n\nMy neighbour lends me books, of which I have read eleven."),
"utility classes": ("""<html><body><div class="flex p-4 bg-white"><span class="font-bold">Signal</span><a class="ml-2" href=/p>Pricing</a><a class="ml-2" href=/d>Docs</a></div><div class="max-w-xl mx-auto"><h1 class="text-3xl">How we cut our build time in half</h1><p class="mt-4">Our builds took forty minutes last year, and most of that time went into compiling code that had not changed at all.</p><p class="mt-4">We now cache each module by a hash of its inputs, and skip what is known.</p></div><div class="flex text-xs"><a href=/t>Terms</a><a href=/p>Privacy</a><span>2024 Signal Inc.</span></div></body></html>""",
 "How we cut our build time in half\n\nOur builds took forty minutes last year, and most of that time went into compiling code that had not changed at all.\n\nWe now cache each module by a hash of its inputs, and skip what is known."),
}
