"""Small pages of many makes, each with the text that a reader would call its content: (html, text)."""

LONG = "The river had risen all night, and by the morning the lower fields were under water, so that nobody could cross to the mill before noon."
MORE = "When the baker came down he found the doors open and the flour gone, and he sat on the step, thinking of what he would tell his brother."
THIRD = "In the end the council decided that a new bridge was to be built of stone, a little further up, where the banks were high and firm."
SHORT = "So it was."
MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sports", "Contact"))


def _joined(*texts):
    return "\n".join(texts)


PAGES = [
    # elements that tell their part
    (f"<body><nav><ul>{MENU}</ul></nav><article><h1>The flood</h1><p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p></article><footer>&copy; 2020 Us</footer></body>", _joined("The flood", LONG, SHORT, MORE)),
    (f"<header><h1>Daily Post</h1><nav>{MENU}</nav></header><main><h2>The flood</h2><p>{LONG}</p><p>{MORE}</p></main><aside><p>{THIRD}</p></aside>", _joined("The flood", LONG, MORE)),
    (f"<main><article><header><h1>The flood</h1></header><p>{LONG}</p><p>{THIRD}</p><footer>Filed under water</footer></article></main>", _joined("The flood", LONG, THIRD)),
    (f"<article><p>{LONG}</p><form><p>Write to us, we read all of your letters and answer most of them.</p><input></form><p>{MORE}</p></article>", _joined(LONG, MORE)),
    (f"<article><p>{LONG}</p><aside>Read also: the mill and the man who owned it for many years</aside><p>{MORE}</p></article>", _joined(LONG, MORE)),
    # names that tell it
    (f'<div id="header"><a href="/">Daily Post</a></div><div class="menu"><ul>{MENU}</ul></div><div id="content"><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></div><div id="footer">All rights reserved.</div>', _joined("The flood", LONG, MORE)),
    (f'<div class="site-header">Daily Post</div><div class="post-body"><p>{LONG}</p><p>{SHORT}</p><p>{THIRD}</p></div><div class="sidebar-left"><p>{MORE}</p></div>', _joined(LONG, SHORT, THIRD)),
    (f'<div class="entry-content"><p>{LONG}</p><div class="ad-slot">Buy two bicycles and get a third one for nothing at all, only today.</div><p>{MORE}</p></div>', _joined(LONG, MORE)),
    (f'<div class="story"><p>{LONG}</p><p>{MORE}</p></div><div class="comments"><div class="comment"><p>{THIRD}</p></div><div class="comment"><p>I was there and it was not like that at all, believe me.</p></div></div>', _joined(LONG, MORE)),
    (f'<article class="post tag-news"><p>{LONG}</p><p>{MORE}</p></article>', _joined(LONG, MORE)),
    (f'<div class="article comments-enabled has-sidebar"><p>{LONG}</p><p>{MORE}</p></div>', _joined(LONG, MORE)),
    (f'<article><p>{LONG}</p><p>{MORE}</p></article><section id="comments"><article class="comment"><p>{THIRD}</p></article></section>', _joined(LONG, MORE)),
    (f'<div class="cookie-notice"><p>We use cookies so that this site works as it should, and you agree by reading on.</p></div><div role="main"><p>{LONG}</p><p>{MORE}</p></div>', _joined(LONG, MORE)),
    (f'<div class="newsletter"><p>Sign up for our letter and get the best of the week each Sunday morning.</p></div><article><p>{LONG}</p></article>', LONG),
    (f'<article><h1>The flood</h1><div class="share">Share this</div><p>{LONG}</p><p>{MORE}</p><div class="related"><p>{THIRD}</p></div></article>', _joined("The flood", LONG, MORE)),
    # nothing but the text to go by
    (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sports</a></div><div><p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p><p>{THIRD}</p></div></body>", _joined(LONG, SHORT, MORE, THIRD)),
    (f"<body><table><tr><td><a href=1>Home</a><td><a href=2>News</a></table><p>{LONG}<p>{MORE}<p>{SHORT}<p>{THIRD}</body>", _joined(LONG, MORE, SHORT, THIRD)),
    (f"<div><div><h2>The flood</h2><p>{LONG}</p><ul><li>one mill</li><li>two bridges</li></ul><p>{MORE}</p></div></div>", _joined("The flood", LONG, "one mill", "two bridges", MORE)),
    (f"{LONG}<br>{MORE}", f"{LONG} {MORE}"),
    (f"<p>{LONG}</p>{MORE}", _joined(LONG, MORE)),
    # markup that is broken or left out
    (f"<html><head><title>t</title><div><p>{LONG}</p></div>", LONG),
    (f"<html><head><title>t</title><style>p{{}}</style></head><p>{LONG}</p><script>var a='<p>no</p>';</script><p>{MORE}</p>", _joined(LONG, MORE)),
    (f"<body><p>{LONG}</p><video src=x><p>{MORE}</p>", _joined(LONG, MORE)),
    (f"<body><article><p>{LONG}</p><p><b>{MORE}<br><p>{THIRD}</article>", _joined(LONG, MORE, THIRD)),
    (f"<body><article><p title=\"a > b\">{LONG}</p><!-- <p>no</p> --><p>{MORE}</p></article>", _joined(LONG, MORE)),
    (f"<article><p>{LONG}</p><noscript><p>Turn on scripts.</p></noscript><iframe src=x>no frames</iframe><p>Fish &amp; chips &lt;here&gt;, caf&eacute; &#8212; at the old mill by the river.</p></article>", _joined(LONG, "Fish & chips <here>, café — at the old mill by the river.")),
    (f"<form action=x><div class=content><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p><p>{THIRD}</p></div></form>", _joined("The flood", LONG, MORE, THIRD)),
    (f"<ARTICLE CLASS=Post><P>{LONG}</P>\n<P>  {MORE.replace(' ', '   ')} </P></ARTICLE><FOOTER>us</FOOTER>", _joined(LONG, MORE)),
    (f'<dialog open><p>Subscribe now to read on, it costs less than a cup of coffee.</p></dialog><main><p>{LONG}</p></main>', LONG),
    ("<nav><a href=1>Home</a></nav><footer>us</footer>", ""),
]
