"""Pages whose attributes are long and whose scripts hold '<'."""

from kinfold.llm import html_extract


def test_text_after_a_script_with_a_less_than_sign():
    for tag in ("script", "style", "SCRIPT"):
        page = f"<head><{tag}>for(i=0;i<n;i++){{f(i);}}</{tag}></head><body><p>One.</p><{tag}>a<b&&c</{tag} ><p>Two.</p><{tag}>x<y"
        assert [b.text for b in html_extract.blocks(page)] == ["One.", "Two."]


def test_names_after_a_long_attribute():
    long = "x" * 3000
    (block,) = html_extract.blocks(f"<div data-config='{long}' class='advert topBox'>Buy</div>")
    assert {"in name:advert", "in name:top", "at name:box"} <= set(block.features)


# Pages made by hand, each of another layout, with their main text.
PAGES = [
    (
        "<body><div id=top class=masthead><a href=/>Site</a></div><div class=story-wrap><h1>Rain over the coast</h1><p title=it's>The storm reached the coast on Monday.</p><p title=it's>Nobody was hurt, officials said.</p></div><div class='cmt'><p>Great article, thanks!</p></div><div class=cookie-notice>We use cookies.</div></body>",
        "Rain over the coast The storm reached the coast on Monday. Nobody was hurt, officials said.",
    ),
    (
        "<body><table><tr><td class=sidebar><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></td><td class=content><h2>How to bake bread</h2><p>Mix flour, water and salt, and let the dough rest for an hour.</p><ol><li>Heat the oven.</li><li>Bake for forty minutes.</li></ol></td></tr></table><div id=ft>Copyright 2020</div></body>",
        "How to bake bread Mix flour, water and salt, and let the dough rest for an hour. Heat the oven. Bake for forty minutes.",
    ),
    (
        "<body><main><article><header><h1>Minutes</h1></header><p>The council met at noon and agreed on the budget for next year.</p><aside class=ad>Buy a car!</aside><p>It will meet again in May.</p></article></main><section id=replies><div class=reply>First!</div><div class=reply>I disagree with all of this, and here is why I do.</div></section><form><label>Mail</label><input><button>Send</button></form><footer>Imprint</footer></body>",
        "Minutes The council met at noon and agreed on the budget for next year. It will meet again in May.",
    ),
]


def test_pages_made_by_hand():
    model = html_extract.train(html_extract.training_pages())
    for page, text in PAGES:
        assert html_extract.main_text(page, model) == text


def test_quotes_and_attributes():
    page = """<p title=it's>One.</p><p data-x = "a>b" class='c"d' hidden>Two.</p><p alt="open>Three.</p><a b=c"d>Four.</a>"""
    assert [b.text for b in html_extract.blocks(page)][:2] == ["One.", "Two."]
    (block,) = html_extract.blocks("<div data-class=menu id = side class=it's>x</div>")
    assert {"at name:side", "at name:it"} <= set(block.features) and "at name:menu" not in block.features
