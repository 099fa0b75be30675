"""Pages written by hand after common site makers, independent of the training templates; § marks main text."""

PAGES = {
    "blog": """<!doctype html><html lang=en><head><title>Growing tomatoes on a balcony | Green Corner</title><link rel=stylesheet href=x.css></head>
<body class="post-template-default single single-post postid-123 wp-embed-responsive"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Green Corner</a></p><p class="site-description">Notes from a small garden</p></div>
<nav id="site-navigation" class="main-navigation"><button class="menu-toggle">Menu</button><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About me</a></li><li class="menu-item"><a href="/seeds">Seed list</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-123" class="post-123 post type-post hentry"><header class="entry-header"><h1 class="entry-title">§Growing tomatoes on a balcony</h1></header>
<div class="entry-content"><p>§Last spring I bought three young plants at the market and put them into old buckets.</p><p>§They need at least <strong>six hours</strong> of sun, and <a href="/water">regular water</a> in the evening.</p><h2>§What went wrong</h2><p>§Two of them caught blight in July, after a week of rain.</p><ul><li>§Remove the lower leaves.</li><li>§Keep the plants under a roof.</li></ul><blockquote><p>§A dry leaf is a healthy leaf, my neighbour says.</p></blockquote></div></article>
<nav class="navigation post-navigation"><div class="nav-previous"><a href="/p">Previous: Beans</a></div><div class="nav-next"><a href="/n">Next: Peppers</a></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><div class="comment-content"><p>I had the same trouble last year and lost all my plants.</p></div></article></li><li class="comment"><div class="comment-content"><p>Thanks for the advice!</p></div></li></ol><div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form class="comment-form"><p>Your email address will not be published.</p><label>Comment</label><textarea></textarea><button>Post Comment</button></form></div></div></main>
<aside id="secondary" class="widget-area"><section class="widget widget_search"><form><label>Search</label></form></section><section class="widget widget_recent_entries"><h2>Recent Posts</h2><ul><li><a href="/1">Beans in May</a></li><li><a href="/2">Compost for beginners</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a free blog engine</div></footer></body></html>""",
    "encyclopedia": """<html class="client-nojs"><head><title>Bridge of stones - Open Encyclopedia</title></head><body class="mediawiki ltr ns-0 page-Bridge"><div id="mw-page-base" class="noprint"></div>
<div id="mw-navigation"><h2>Navigation menu</h2><div id="mw-head"><nav class="mw-portlet"><ul><li><a href="/t">Article</a></li><li><a href="/d">Talk</a></li></ul></nav></div><div id="mw-panel"><nav id="p-navigation"><h3>Navigation</h3><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></nav></div></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">§Bridge of stones</h1><div id="bodyContent" class="mw-body-content"><div id="mw-content-text"><div class="mw-parser-output">
<p>§The <b>Bridge of stones</b> is an arch bridge over the river Alm, built between 1412 and 1419.</p><div id="toc" class="toc" role="navigation"><h2>Contents</h2><ul><li><a href="#h">1 History</a></li><li><a href="#c">2 Construction</a></li></ul></div>
<h2>§History</h2><p>§A wooden bridge stood at this place before the flood of 1408 destroyed it, as the town's chronicle reports.</p><p>§The council raised a toll on salt to pay for the new one.</p><h2>§Construction</h2><p>§It has five arches, the widest of which spans fourteen metres.</p></div></div></div></div>
<div id="footer" role="contentinfo"><ul id="footer-info"><li>This page was last edited on 3 May.</li><li>Text is available under a free licence.</li></ul><ul id="footer-places"><li><a href="/p">Privacy policy</a></li><li><a href="/i">Disclaimers</a></li></ul></div></body></html>""",
    "news": """<html><head><title>Port to reopen on Monday - The Harbour Post</title></head><body><div class="top-banner ad-container">Advertisement</div><div class="header-wrap"><div class="logo"><a href="/">The Harbour Post</a></div><ul class="nav-list"><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/m">Money</a></li></ul></div>
<div class="page"><div class="col-main"><div class="story"><h1 class="headline">§Port to reopen on Monday after strike</h1><div class="article-body"><p>§The port will take in ships again on Monday, the operator said after talks that went on through the night.</p><p>§Some four hundred workers had laid down their tools eleven days ago.</p><div class="ad-slot">Advertisement</div><p>§Both sides called the agreement a fair one, but didn't give any details of the pay rise.</p><p>§A vote by the members is due next week.</p></div><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div></div><div class="related"><h3>Related stories</h3><ul><li><a href="/1">Ferry prices to rise</a></li><li><a href="/2">New crane arrives</a></li></ul></div></div>
<div class="sidebar"><h3>Most read</h3><ol><li><a href="/3">Ten walks along the coast</a></li><li><a href="/4">What the storm left behind</a></li></ol><div class="newsletter-signup"><p>Get the day's headlines in your inbox every morning.</p><form><button>Sign up</button></form></div></div></div>
<div class="cookie-banner"><p>We use cookies to make this site work and to measure how it is used.</p><button>Accept</button><button>Settings</button></div><div class="footer"><p>© 2023 The Harbour Post. All rights reserved.</p><a href="/c">Contact</a></div></body></html>""",
    "manual": """<html><head><title>Configuration — Kettle 2.1 documentation</title></head><body><div class="related" role="navigation"><h3>Navigation</h3><ul><li><a href="/g">index</a></li><li><a href="/n">next</a></li><li><a href="/">Kettle 2.1 documentation</a></li></ul></div>
<div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="configuration"><h1>§Configuration</h1><p>§Kettle reads its settings from a file named kettle.ini in the current folder.</p><section id="options"><h2>§Options</h2><dl><dt>§timeout</dt><dd><p>§Seconds to wait for an answer; the default is ten.</p></dd><dt>§retries</dt><dd><p>§How often a failed request is sent again.</p></dd></dl></section><section><h2>§Example</h2><p>§A file that sets both options looks as follows.</p><pre>§[kettle] timeout = 5 retries = 2</pre></section></section></div></div></div>
<div class="sphinxsidebar" role="navigation"><div class="sphinxsidebarwrapper"><h3><a href="/">Table of Contents</a></h3><ul><li><a href="#c">Configuration</a></li><li><a href="#o">Options</a></li></ul><div role="search"><h3>Quick search</h3><form><input><button>Go</button></form></div></div></div></div>
<div class="footer" role="contentinfo">© Copyright 2022, the Kettle team. Created using a documentation generator.</div></body></html>""",
    "plain": """<html><head><title>Letters from the island</title></head><body><table width="100%"><tr><td class="menu"><a href="a.html">Home</a><br><a href="b.html">Letters</a><br><a href="c.html">Guestbook</a></td></tr></table><h1>§Letters from the island</h1><p>§My dear brother, we came here in the first days of April, when the snow had only just gone.<p>§The house stands above the bay, and from my window I can see the boats go out in the morning.<p>§Write to me soon, and tell mother that we are all well.<hr><address class="footer">Last changed 2 June 1999. Mail to the webmaster.</address></body></html>""",
    "magazine": """<html><head><title>Why old clocks tick | Daily Wonder</title></head><body><div id="root"><header class="Header_wrap__1xY"><a href="/">Daily Wonder</a><nav><a href="/sci">Science</a><a href="/hist">History</a><button>Subscribe</button></nav></header><main><article class="Article_root__9aB"><h1>§Why old clocks tick</h1><p class="byline">By Ann Other, 4 minutes</p><div class="Article_body__2Qe"><p>§Every second a small anchor lets go of a wheel and catches it again, and that is what we hear.</p><figure><img src=x><figcaption>§An anchor escapement of 1780</figcaption></figure><p>§The pendulum below decides how long the wheel may turn.</p><aside class="newsletter-box"><p>Enjoying this story? Sign up for our weekly letter.</p></aside><p>§Clockmakers knew how to slow it down in summer, when the rod grows longer in the heat.</p></div><div class="tags"><a href="/t1">clocks</a> <a href="/t2">physics</a></div></article><section class="Recommended_list__k"><h2>You may also like</h2><a href="/r1"><h3>The tallest tower of its time</h3></a><a href="/r2"><h3>How glass was blown</h3></a></section></main><footer class="Footer_root__z"><p>Daily Wonder is published by a small team.</p><ul><li><a href="/terms">Terms</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></div></body></html>""",
}
