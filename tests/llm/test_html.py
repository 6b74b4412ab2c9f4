"""Page extraction on the given pages' shape and on pages without an article element."""

from html.parser import HTMLParser

import pytest

from facsimile.llm import html as X
from tests.conftest import SF

PROSE = "This is the kind of text that has a lot of the words which are in most of the sentences, and it goes on for long enough to be sure that it is not a menu or a notice of any kind. It has one more sentence as well."


def test_article_pages_keep_all_blocks_of_the_article():
    page = (
        '<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
        '<!-- ad <p>no</p> --><div class="ad">Buy the thing that is in the shop and of the best.</div><article><h1>Head&nbsp;line</h1>'
        "<p><b>Bold\n start.<br><p>a &lt;b&gt; &amp;&amp;&#233;</p><p>  </p><p>One.</p><aside>side</aside><div class='comments'><p>" + PROSE + "</p></div>"
        f"<p>{PROSE}</p></article><footer>&copy; x</footer><script>never ends"
    )
    assert X.main_text(page) == "\n\n".join(["Head line", "Bold start.", "a <b> &&é", "One.", PROSE])


def test_pages_without_article_use_density_and_neighbours():
    page = f"""<body><div id=menu><a href=a>Home</a> <a href=b>News</a></div><h2>A heading</h2><div>{PROSE}</div><p>Short one.</p><div>{PROSE}<br><br>After a break {PROSE}</div>
    <p><a href=c>{PROSE}</a></p><form>{PROSE}</form><div role="contentinfo">{PROSE}</div><div class="cookie-notice">{PROSE}</div><p>Tail</p><p>{"xqz " * 80}</p>"""
    assert X.main_text(page) == "\n\n".join(["A heading", PROSE, "Short one.", PROSE, "After a break " + PROSE])


def test_broken_pages():
    for page in ("", None, "plain", "<", "<p", "</p></div>", "<!--", "<a href='", "<script>", "&#xZZ; &bogus;", "<p>" * 3000, "<div><b>" * 500):
        assert isinstance(X.main_text(page), str)
    assert X.main_text("<article>x") == "x" and X.main_text("<article><p>a<p>b</article>z") == "a\n\nb"
    assert X.main_text("<article><svg>unclosed<p>" + PROSE + "</article>").endswith(PROSE)


def test_rows(rows):
    data = [(1, "u", "<article><p>one</p></article>", "t"), (1, "u", "<article><p>one</p></article>", "t"), (2, None, None, None), (None, "v", "<p></p>", "t"), (3, "w", f"<article><p>{'long ' * 50_000}</p></article>", "t")]
    pages = rows(data, "page_id bigint, url string, html string, text string")
    got = sorted((r.id or 0, r.url, len(r.text)) for r in X.extract(pages).collect())
    assert [(i, n) for i, _, n in got] == [(0, 0), (1, 3), (1, 3), (2, 0), (3, 249_999)]
    assert X.extract(pages.limit(0)).count() == 0


def test_linked_items_of_an_article_stay():
    items = "".join(f"<li><a href=/s{i}>Source number {i} of the article</a></li>" for i in range(3))
    page = f"<ul><li><a href=/>Home</a></ul><article><p>{PROSE}</p><ul>{items}</ul><ul class=related><li><a href=/r>Other</a></ul><p>{PROSE}</p></article>"
    assert X.main_text(page) == "\n\n".join([PROSE, *(f"Source number {i} of the article" for i in range(3)), PROSE])


def test_blocks_without_stop_words_go_with_their_neighbours():
    code = "for (int i = 0; i < n; ++i) { total += values[i] * weights[i]; counts[keys[i]] += 1; emit(total, counts); }"
    names = "Ada Lovelace, Alan Turing, Grace Hopper, Edsger Dijkstra, Barbara Liskov, Donald Knuth, Tony Hoare, Niklaus Wirth"
    shown = code.replace("<", "&lt;")
    page = f"<nav>x</nav><div>{PROSE}</div><pre>{shown}</pre><div>{PROSE}</div><p>{names}</p><div>{PROSE}</div><footer>{PROSE}</footer><p>{names}</p>"
    assert X.main_text(page) == "\n\n".join([PROSE, code, PROSE, names, PROSE])


def test_other_languages_are_judged_by_length_and_links():
    czech = "Včera večer přišlo město k řece, kde lidé stavěli nový most, protože starý most odnesla voda před mnoha lety a nikdo jej neopravil. Dnes tam stojí věž, kterou postavili kameníci z hor."
    greek = "Χθες το βράδυ οι άνθρωποι πήγαν στο ποτάμι, όπου έχτιζαν μια νέα γέφυρα, επειδή την παλιά την πήρε το νερό πριν από πολλά χρόνια και κανείς δεν την επισκεύασε ποτέ ξανά."
    for text in (czech, greek):
        long = f"{text} {text}"
        menu = "".join(f"<div><a href=/{i}>{text}</a></div>" for i in range(3))
        assert X.main_text(f"<div class=menu>{long}</div>{menu}<h2>Most</h2><p>{long}</p><p>{text}</p><p>{long}</p><footer>{long}</footer>") == "\n\n".join(["Most", long, text, long])


WRAPPERS = ["has-sidebar", "content-sidebar-wrap", "layout with-sidebar", "page no-comments", "comment-free", "social-science", "sidebar", "menu footer", "related"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("kind", ["class", "id"])
def test_wrappers_do_not_outrank_the_article(name, kind):
    article = f"<h1>Head</h1><p>{PROSE}</p><p>One.</p>"
    for tag in ("article", "main"):
        page = f'<body><nav>x</nav><div {kind}="{name}"><{tag}>{article}</{tag}><div class="sidebar-left">{PROSE}</div></div><footer>y</footer>'
        assert X.main_text(page) == "\n\n".join(["Head", PROSE, "One."])


@pytest.mark.parametrize("name", WRAPPERS[:6])
def test_wrappers_of_pages_without_article(name):
    assert X.main_text(f'<div class="{name}"><p>{PROSE}</p></div><div class=ad>{PROSE}</div>') == PROSE


@pytest.mark.parametrize("name", ["related", "comments-list", "sidebar", "post-footer widget", "c-ad__box", "cookie-notice", "newsletter-signup"])
def test_marked_parts_stay_out(name):
    other = f"<article><p>{PROSE}</p></article>"
    page = f'<div class="{name}">{other}</div><article><p>Own text.</p><div class="{name}"><p>{PROSE}</p></div></article><div class="{name}">{other}</div>'
    assert X.main_text(page) == "Own text."


def test_articles_in_boilerplate_elements_stay_out():
    assert X.main_text(f"<aside><article>{PROSE}</article></aside><article>Own.</article><footer><main>{PROSE}</main></footer>") == "Own."


def test_formulas_drawings_and_replaced_parts_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p><svg><text>Label</text><style>a{}</style></svg></p><noscript><p>Shown <img src=a> without scripts.</p></noscript><iframe>inside</iframe></article>"
    assert X.main_text(page) == "\n\n".join(["Let x=2 be.", "Label", "Shown without scripts.", "inside"])


class Tree(HTMLParser):
    """Blocks of the article of a well-formed page, kept by a stack of element names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.open = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return self.handle_data(" ")
        if tag in ("p", "li") and tag in self.stack:
            self.handle_endtag(tag)
        if tag in ("p", "li", "h1", "h2", "div", "article", "ul"):
            self.open = False
        self.stack.append("ad" if ("class", "ad") in attrs else tag)

    def handle_endtag(self, tag):
        name = tag if tag in self.stack else "ad" if tag == "div" and "ad" in self.stack else None
        if name:
            while self.stack.pop() != name:
                pass
        if tag in ("p", "li", "h1", "h2", "div", "article", "ul"):
            self.open = False

    def handle_data(self, data):
        if "article" in self.stack and not {"ad", "script", "style", "nav", "footer"} & set(self.stack):
            if not self.open:
                self.blocks.append("")
                self.open = True
            self.blocks[-1] += data


def test_all_given_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.id: r.text for r in X.extract(pages).collect()}
    for r in pages.collect():
        tree = Tree()
        tree.feed(r.html)
        tree.close()
        assert got[r.page_id] == "\n\n".join(t for t in (" ".join(b.split()) for b in tree.blocks) if t), r.page_id
