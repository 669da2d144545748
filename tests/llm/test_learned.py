"""Language, toxicity, extraction, search: held-out accuracy, brute force, and every awkward row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import dom, extraction, language, multi_index, toxicity
from riskloom.llm.folds import bounded_sample, remainder

from .conftest import LONG

WORDS = {
    "en": "the of and house with tree is that for green thing walking with nothing".split(),
    "de": "der die und nicht haus mit baum ist das für grün schön gehen wenig straße".split(),
    "ru": "и в не на дом дерево это что зелёный ходить много улица".split(),
}


def sentence(lang, n, draw):
    return " ".join(draw.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def model(make_docs):
    draw = random.Random(1)
    rows = [(i, sentence(lang, draw.randint(1, 30), draw), lang) for i, lang in enumerate(random.Random(2).choices([*WORDS], k=150))]
    rows += [(900, None, "en"), (901, "the house", None), (902, "", "de")]
    return language.fit(make_docs(rows), F.lit(True))


def test_languages(make_docs, model):
    draw = random.Random(3)
    rows = [(i, sentence(lang, draw.randint(3, 40), draw)) for i, lang in enumerate([*WORDS] * 20)]
    found = {r["doc_id"]: r for r in language.identify(make_docs(rows), model).collect()}
    assert sum(found[i]["lang_pred"] == lang for i, lang in enumerate([*WORDS] * 20)) >= 58
    assert model.languages == ["de", "en", "ru"]


def test_language_spans(make_docs, model):
    german, russian = "der baum ist nicht schön und das haus ist grün", "дерево и дом это много"
    text = f"  {german}. {russian}! 12"
    (row,) = language.identify(make_docs([(1, text)]), model).collect()
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in row["spans"]] == [(german, "de"), (russian, "ru")]
    assert row["lang_pred"] == "de" and 0.5 < row["score"] < 1


def test_language_of_awkward_rows(make_docs, model):
    rows = [(1, None), (2, ""), (3, "123 !? ²_"), (4, "漢字"), (None, "der baum"), (5, "und und"), (5, "und und"), (6, LONG)]
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(make_docs(rows), model).collect()]
    assert len(found) == len(rows)
    assert {f for f in found if f[0] in (1, 2, 3)} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert all(lang in model.languages and 0 <= s <= 1 for i, lang, s in found if i not in (1, 2, 3))
    kept = language.identified(make_docs(rows), model)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 5, 6]
    assert kept.columns == make_docs(rows).columns
    assert language.identify(make_docs([]), model).count() == 0


def test_no_language_learned(make_docs):
    empty = language.fit(make_docs([(1, "a", None)]), F.lit(True))
    (row,) = language.identify(make_docs([(1, "a")]), empty).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(5)
    for lengths in ([3, 0, 5, 1], [1], [6, 6]):
        scores = draw.normal(size=(sum(lengths), 3)).astype(np.float32) * 3
        labels = language.viterbi(scores, np.array(lengths), 2.0)
        at = 0
        for n in lengths:
            part, own = scores[at : at + n], labels[at : at + n]
            worth = lambda p: sum(part[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
            best = max((worth(p) for p in np.ndindex(*(3,) * n)), default=0)
            assert worth(own) == pytest.approx(best, abs=1e-4)
            at += n


def toxic_rows(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        parts = [" ".join(draw.choices("sun sea boat calm wind sail".split(), k=6)) for _ in range(6)]
        for _ in range(2 * y):
            parts[draw.randrange(6)] += draw.choice([" Vilestuff", " VILEthing", " rotten"])
        rows.append((i, ". ".join(parts), y))
    return rows


def test_toxicity(spark, make_docs):
    rows = toxic_rows(240, 1)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(7, None, "x"), (None, 1, "x")], "doc_id long, toxic int, id string")
    held = remainder("doc_id", 3) == 1
    model = toxicity.fit(make_docs([r[:2] for r in rows]), labels, ~held)
    scored = toxicity.score(make_docs([r[:2] for r in rows]), model).withColumn("held", held)
    wrong = [r["doc_id"] for r in scored.collect() if r["held"] and r["predicted"] != rows[r["doc_id"]][2]]
    assert not wrong
    text = "Calm sea and wind. Then a vilestuff came!\nA rotten boat"
    found = toxicity.score(make_docs([(1, text), (2, None), (3, ""), (4, "!?"), (5, LONG), (None, text), (5, LONG)]), model).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 7
    assert [text[s["start"] : s["end"]] for s in by[1]["offending"]] == ["Then a vilestuff came", "A rotten boat"]
    assert by[1]["predicted"] == by[None]["predicted"] == 1
    assert [(by[i]["score"], by[i]["predicted"], by[i]["offending"]) for i in (2, 3, 4)] == [(0.0, 0, [])] * 3
    assert by[5]["predicted"] == 0
    assert toxicity.score(make_docs([]), model).count() == 0


def test_noisy_or(make_docs):
    model = toxicity.ToxicityModel({"=bad": 3.0}, -2.0)
    (row,) = toxicity.score(make_docs([(1, "bad day. fine day. bad bad")]), model).collect()
    s = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0, 4.0)]
    assert row["score"] == pytest.approx(1 - np.prod([1 - x for x in s]))


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_label_only(spark, make_docs, toxic):
    labels = spark.createDataFrame([(1, toxic)], "doc_id long, toxic int")
    model = toxicity.fit(make_docs([(1, "a")]), labels, F.lit(True))
    (row,) = toxicity.score(make_docs([(1, "a")]), model).collect()
    assert row["predicted"] == toxic


def test_bounded_sample(spark):
    frame = spark.range(5_000)
    assert bounded_sample(frame, "id", 100).count() == 100
    assert bounded_sample(frame, "id", 9_000).count() == 5_000
    assert bounded_sample(frame, "id", 100).collect() == bounded_sample(frame.repartition(7), "id", 100).collect()


PAGES = "page_id long, url string, html string, host string, text string, skeleton int"


def plain(page):
    """The text that elements alone leave, without a wrapper."""
    root = dom.parse(page)
    dom.finish(root, {})
    return " ".join(dom.blocks(dom.main_parts(root), set()))


def test_articles_inside_comments_and_teasers_are_no_main_text():
    main = "<article>Main <p>text</p>{}</article>"
    comments = '<section class="comments"><article>Reader says hi</article><article>Another</article></section>'
    assert plain(main.format("") + comments) == "Main text"
    assert plain("<aside><article>Teaser</article></aside>" + main.format("")) == "Main text"
    assert plain(main.format('<div class="related"><div><article>More</article></div></div>')) == "Main text"
    # a menu or notice that is never closed does not hold the article
    assert plain("<nav><ul><li>Home" + main.format("")) == "Main text"
    assert plain('<div><div class="notice">Cookies<article>Main text</article></div>') == "Main text"


@pytest.mark.parametrize("deep", [10, 140, 160, 400])
def test_deep_elements_keep_their_place(deep):
    nested = "<div>" * deep + "deep" + "</div>" * deep
    assert plain(f"<div><article>Head {nested} Tail</article></div>Foot") == "Head deep Tail"
    hidden = "<span>" * deep + "<aside>advert <b>more</b></aside><form><form>field</form></form> text" + "</span>" * deep
    assert plain(f"<article>Head {hidden} Tail</article>") == "Head text Tail"
    assert plain(f"<article>{'<div>' * deep}open</article>") == "open"


def extracted(spark, pages):
    frame = spark.createDataFrame([(*p, "h", "t", 1) for p in pages], PAGES)
    return {r["page_id"]: r["text"] for r in extraction.extract(frame.repartition(3) if pages else frame).collect()}


def test_wrapper_induction_without_telling_names(spark):
    page = lambda i: (
        i, f"http://a.example/{i}",
        f"<body><div><p>Daily paper</p><p>All rights kept</p></div><div><h1>Title {i}</h1><p>Body {i} &amp; more.<p>Second {i}</div>"
        "<div><p>Call us</p></div></body>",
    )
    found = extracted(spark, [page(i) for i in range(1, 8)])
    assert found[3] == "Title 3 Body 3 & more. Second 3"
    # the only page of its host: nothing tells the template
    assert extracted(spark, [page(1)])[1].startswith("Daily paper")


def test_copies_on_a_host_are_no_template(spark):
    page = "<body><article><h1>One</h1><p>Two</p><p>Three</p></article></body>"
    assert extracted(spark, [(i, "http://b.example/", page) for i in range(6)]) == {i: "One Two Three" for i in range(6)}


def test_large_template_still_counts(spark):
    menu = "".join(f"<div><p>Menu {j}</p></div>\n  " for j in range(40))
    page = lambda i: (
        i, f"http://a.example/{i}",
        f"<body>\n  {menu}<div>\n" + "".join(f"    <p>Body {i} {j}</p>\n" for j in range(6)) + "  </div>\n  <div><p>Call us</p></div>\n</body>",
    )
    found = extracted(spark, [page(i) for i in range(1, 8)])
    assert found == {i: " ".join(f"Body {i} {j}" for j in range(6)) for i in range(1, 8)}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_every_layout_has_a_wrapper(spark, monkeypatch, limit):
    monkeypatch.setattr(extraction, "BROADCAST_LAYOUTS", limit, raising=False)
    url = "http://a.example/"
    pages = [(1, url, None), (2, url, ""), (3, url, "<html><body><h1>500 Server Error</h1></body></html>")]
    for i in range(10, 16):
        pages.append((i, url, f"<body><div><p>Daily paper</p></div><div><p>One {i}</p></div><div><p>Call us</p></div></body>"))
        pages.append((i + 10, url, f"<body><table><tr><td>Shop<td>Basket</table><section><p>Two {i}</p></section><p>Paid by card</p></body>"))
    pages += [(i, "http://two.example/", f"<body><div><p>Menu</p></div><div><p>Text {i}</p></div></body>") for i in (30, 31)]
    # a page with a layout of its own takes the wrapper of its host's largest
    page = "<body><div><p>Daily paper</p></div>{}<div><p>Text {}</p></div><div><p>Call us</p></div></body>"
    pages += [(i, "http://three.example/", page.format("<ul><li>Extra</ul>" if i == 40 else "", i)) for i in (40, 41, 42, 43)]
    found = extracted(spark, pages)
    assert {i: found[i] for i in (1, 2, 3)} == {1: "", 2: "", 3: "500 Server Error"}
    assert {i: found[i] for i in range(10, 16)} == {i: f"One {i}" for i in range(10, 16)}
    assert {i: found[i + 10] for i in range(10, 16)} == {i: f"Two {i}" for i in range(10, 16)}
    assert (found[30], found[31], found[40]) == ("Text 30", "Text 31", "Extra Text 40")


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
    ("<nav>m</nav><article><h1>T</h1><p>x &lt;y&gt; &#233; &amp</p><div class='comments'>no</div></article><footer>f</footer>", "T x <y> é &"),
    ("<script>var t='</p>';</script><!-- c --><style>p{}</style><main><ul><li>1<li>2</ul></main>", "1 2"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"), ("<div id='cookie-notice'>x</div><p>y</p>", "y"),
    ("<nav><ul><li>menu<article><p>body</p></article>", "body"), ("<p title=\"a>b\">q</p></div></p>", "q"),
    ("<form><p>f</p></form><p>  a \t\n b </p>", "a b"), ("a < b << c <3", "a < b << c <3"), ("<div>" * 400 + "deep", "deep"),
    ("<article><p>" + LONG + "</p></article>", LONG.strip()), ("<article class='comment'>no</article><p>yes</p>", "yes"),
])
def test_one_page(page, text):
    root = dom.parse(page or "")
    assert " ".join(dom.blocks(dom.main_parts(root), set())) == text


def test_pages_in_spark(spark):
    body = "<article><p>x</p></article>"
    pages = [(1, None, body), (2, "no host", body), (3, "HTTP://U@C.example:80/?q", body), (None, "http://c.example/", body), (4, "http://c.example", None)]
    assert extracted(spark, pages) == {1: "x", 2: "x", 3: "x", None: "x", 4: ""}
    assert extracted(spark, []) == {}


def test_tree_matching_is_the_largest():
    def tree(laid):
        node = dom.Node(laid[0])
        node.kids = [tree(k) for k in laid[1:]]
        return node

    def largest(a, b):
        if a.tag != b.tag:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest(x, y))
        return 1 + best[-1][-1]

    draw = random.Random(6)
    build = lambda depth: [draw.choice("ab"), *(build(depth - 1) for _ in range(draw.randint(0, 3) if depth else 0))]
    matcher, shapes = dom.TreeMatcher(), {}
    for _ in range(60):
        a, b = tree(build(3)), tree(build(3))
        dom.finish(a, shapes)
        dom.finish(b, shapes)
        assert matcher.score(a, b) == largest(a, b)


def by_force(vectors, k, step):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    return {
        q: sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % step == 0
    }


def searched(spark, vectors, **options):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, id int, c1 string")
    found = multi_index.search(frame.repartition(3) if vectors else frame, "vec_id % 10 = 0", **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_of_all_cells_is_exact(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(300)]
    vectors += [(400 + i, vectors[20][1]) for i in range(30)] + [(500, None), (510, []), (520, [0.0] * 8), (530, [1.0, None] * 4)]
    vectors += [(540, [float("nan")] * 8), (550, [float("inf")] + [1.0] * 7), (560, [1.0] * 5), (None, [1.0] * 8)]
    assert searched(spark, vectors, least=10**6) == by_force(vectors, 10, 10)
    assert searched(spark, vectors[:4], least=1) == by_force(vectors[:4], 10, 10)
    assert searched(spark, []) == {} and searched(spark, [(10, None)]) == {}


@pytest.mark.parametrize("times", [3, 20])
def test_repeated_rows_take_no_places(spark, monkeypatch, times):
    monkeypatch.setattr(multi_index, "CENTROIDS", 2)  # many rows in a block
    draw = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(60)]
    vectors[7] = (7, [0.0, *vectors[7][1][1:]])
    exact = by_force(vectors, 10, 10)
    repeated = vectors * times + [(7, [-0.0, *vectors[7][1][1:]])] * times
    assert searched(spark, repeated, least=10**6) == exact
    assert searched(spark, vectors[:6] * times, least=10**6) == by_force(vectors[:6], 10, 10)


def test_codebooks_are_fitted_by_a_task(spark, monkeypatch):
    """The vectors of the fit reached the driver as Python numbers."""
    on_driver, real = [], multi_index._k_means
    monkeypatch.setattr(multi_index, "_k_means", lambda x, k: on_driver.append(len(x)) or real(x, k))
    draw = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(200)]
    assert searched(spark, vectors, least=10**6) == by_force(vectors, 10, 10) and not on_driver


def test_probes_are_not_broadcast(spark):
    """The probes' file is far smaller than their rows, which went through the driver."""
    draw = np.random.default_rng(7)
    frame = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=8)]) for i in range(200)], "vec_id long, embedding array<float>")
    found = multi_index.search(frame, "vec_id % 10 = 0")
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_recall_of_a_part(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 8)) * 4
    vectors = [(i, (centres[i % 20] + draw.normal(size=8)).tolist()) for i in range(1_500)]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    exact, found = by_force(vectors, 10, 10), searched(spark, vectors, part=0.3, least=100)
    hits = [len({i for _, i in exact[q]} & {i for _, i in found[q]}) / 10 for q in exact]
    assert np.mean(hits) >= 0.9


def test_cells_are_visited_by_summed_distance():
    draw = np.random.default_rng(3)
    first, second = draw.normal(size=(6, 2)), draw.normal(size=(5, 3))
    counts = draw.integers(0, 4, (6, 5))
    index = multi_index.MultiIndex(first, second, counts)
    query = draw.normal(size=5)
    sums = ((first - query[:2]) ** 2).sum(1)[:, None] + ((second - query[2:]) ** 2).sum(1)
    for wanted in (1, 7, 20, 10**6):
        seen = index.visited(query, 0.0, wanted)
        assert counts[seen].sum() >= min(wanted, counts.sum())
        if not seen.all():
            assert sums[seen].max() <= sums[~seen].min()
