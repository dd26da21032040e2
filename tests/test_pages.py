import duckdb
import pytest
from pyspark.sql import functions as F

from pagelode.config import configure
from pagelode.functions import literal
from pagelode.functions import text as T
from pagelode.operators import address as A
from pagelode.operators import delta as D
from pagelode.operators import find as FIND
from pagelode.operators.budget import StaleCursor, paginate, shrink_to
from pagelode.operators.page_index import PageIndex
from pagelode.operators.segment import segment, segment_nodes, segment_stats, split_windows
from pagelode.plans import queries as Q
from pagelode.plans.queries import FIXTURE
from pagelode.plans.tools import Engine, InvalidInput, verified_answer
from pagelode.sources import html
from pagelode.sources import manifest as M
from pagelode.sources.html import project_page
from pagelode.sources.tree import Selector, parse
from tests.oracle import same_rows

RANK_PAGE = """<html lang="en"><body><nav><ul><li><a href="/1">refund policy shipping</a></li><li><a href="/2">shipping refund</a></li></ul></nav>
<main><h1>Help</h1><h2>Refund policy</h2><p>A refund takes ten days. Shipping costs are not paid back.</p>
<h2>References</h2><p>Refund policy, refund policy, refund policy shipping.</p></main><footer>refund policy shipping refund policy</footer></body></html>"""


def index_of(spark, *pages):
    rows = [(n, f"https://e.example/{n}", html) for n, html in enumerate(pages)]
    return PageIndex(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_unclosed_bold_is_opened_again_in_later_paragraphs():
    nodes = project_page("<body><article><h1>T</h1><p><b>Short lead<br><p>Next para</p><p>Last</article>").nodes
    assert [n["heading_path"] for n in nodes if n["tag"] == "p"] == [["T"], ["T", "Short lead"], ["T", "Next para"]]


def test_headings_can_be_kept_to_the_marked_ones():
    cfg = configure({"project": {"infer_headings": False}})
    nodes = project_page("<body><h1>T</h1><p><b>Bold</b></p><p>Text</p>", None, cfg).nodes
    assert all(n["heading_path"] == ["T"] for n in nodes)


def test_no_headings_are_inferred_in_page_chrome():
    p = project_page("<body><header><div><b>Menu</b></div></header><nav><b>Items</b></nav><main><h1>M</h1></main>")
    assert p.coverage["inferred_headings"] == 0


def test_links_in_prose_are_nodes_and_part_of_the_sentence():
    nodes = project_page("<body><p>See <a href='/x'>the list</a> now").nodes
    assert [(n["role"], n["text"]) for n in nodes] == [("paragraph", "See the list now"), ("link", "the list")]


def test_password_values_and_private_parts_never_show():
    p = project_page("<body><input type=password value=hunter2 aria-label=Key><div data-pagelode-ignore>private</div><p aria-hidden=true>gone")
    assert "hunter2" not in str(p) and "private" not in str(p) and "gone" not in str(p)
    assert p.nodes[0]["states"]["valuePresent"] == "true" and p.coverage["excluded"] == 2


def test_excluded_selectors_prune_and_bad_ones_abort_first():
    cfg = configure({"project": {"exclude": [".ad > p"]}})
    assert [n["text"] for n in project_page("<body><div class=ad><p>Buy</p></div><p>Read", None, cfg).nodes] == ["Read"]
    with pytest.raises(ValueError):
        project_page("<body>", None, configure({"project": {"exclude": ["p:nth-child(2)"]}}))


def test_redaction_is_applied_to_all_texts():
    cfg = configure({"redact": lambda s: s.replace("secret", "***")})
    p = project_page("<body><h1>secret</h1><a href=/>secret link</a>", None, cfg)
    assert "secret" not in "".join(n["text"] + (n["name"] or "") + "".join(n["heading_path"]) for n in p.nodes)


@pytest.mark.parametrize(("html", "role"), [("<header>", "banner"), ("<article><header>", "generic"), ("<a>", "generic"), ("<a href=x>", "link"), ("<input list=l>", "combobox"), ("<input type=range>", "slider"), ("<select multiple>", "listbox"), ("<button role=presentation>", "button"), ("<div role='buton tab'>", "tab"), ("<img alt=''>", "presentation"), ("<section aria-label=x>", "region"), ("<section>", "generic")])
def test_roles(html, role):
    from pagelode.sources.aria import role_of

    assert role_of(list(parse(f"<body>{html}").walk())[-1]) == role


def test_names_come_from_references_labels_and_contents():
    nodes = project_page("<body><span id=a>From ref</span><input aria-labelledby=a><label>Wrap <input></label><button title=T></button><button>Go</button>").nodes
    assert [n["name"] for n in nodes if n["interactive"]] == ["From ref", "Wrap", "T", "Go"]


def test_image_texts_pass_a_quality_gate():
    p = project_page("<body><img src=IMG_1.png alt='IMG_1.png'><img alt=photo><img alt='123'><img alt='A red boat'><a href=/>Home<img alt=home></a>")
    assert [n["text"] for n in p.nodes if n["non_text"]] == ["A red boat"]
    assert [o["rejected"][0]["reason"] for o in p.opaque] == ["FILENAME", "PLACEHOLDER", "NUMERIC_ONLY", "REDUNDANT_WITH_LINK_TEXT"]


def test_structured_data_gives_prose_pairs_and_counts_what_is_broken():
    p = project_page('<body><script type="application/ld+json">{"@type":"HowTo","step":[{"name":"One","text":"Do it"}]}</script><script type="application/ld+json">{bad')
    assert p.qa == [{"question": "One", "answer": "Do it", "source": "HowTo"}] and p.coverage["malformed_structured_data"] == 1


def test_empty_and_null_pages_project_to_nothing(spark):
    index = index_of(spark, None, "", "<html>")
    assert index.nodes.count() == 0 and index.targets.count() == 0 and index.projected.count() == 3


def test_segmentation_splits_only_full_passages():
    def node(n, words, **more):
        return {"seq": n, "el": n, "text": " ".join(["w"] * words), "heading_path": ["H"], "landmark": None, "landmark_name": None, "is_primary": True, "is_heading": False, "visible": True, "collapsed": False, "non_text": None, "parent": 0, "ancestors": [0]} | more

    assert [c["words"] for c in segment_nodes([node(0, 89), node(1, 500), node(2, 10)])] == [589, 10]
    assert [c["strategy"] for c in segment_nodes([node(0, 5), node(1, 5, heading_path=["H", "I"]), node(2, 5, heading_path=[], landmark="main"), node(3, 5, heading_path=[], parent=9)])] == ["containment", "containment", "landmark", "window"]
    assert split_windows("aa bb cc dd", 6) == [(0, 6), (6, 11)]


def test_prior_mends_the_inversion(spark):
    index = index_of(spark, RANK_PAGE)
    plain = FIND.rank_targets(index, "refund policy shipping", prior=False).orderBy("rank").first()
    better = FIND.coalesce_regions(FIND.rank_targets(index, "refund policy shipping")).orderBy("rank").first()
    assert plain.landmark in ("navigation", "contentinfo") or "References" in plain.heading_path
    assert better.landmark == "main" and better.heading_path == ["Help", "Refund policy"]


def test_find_answers_and_pages_without_gaps(spark):
    engine = Engine(index_of(spark, FIXTURE, RANK_PAGE).pages)
    rows = engine.find("permit cost", limit=50).collect()
    assert {r.answer for r in rows if r.page_id == 0} == {"40 euro."}
    one = [r.target_id for r in engine.find("permit cost refund", limit=1, offset=0).collect()]
    two = [r.target_id for r in engine.find("permit cost refund", limit=1, offset=1).collect()]
    both = [r.target_id for r in engine.find("permit cost refund", limit=2).collect()]
    assert sorted(one + two) == sorted(both)
    with pytest.raises(InvalidInput):
        engine.find("  ")


def test_locate_prefers_names_and_falls_back_to_likeness(spark):
    engine = Engine(index_of(spark, FIXTURE).pages)
    top = engine.locate("send request").orderBy("rank").first()
    assert top["name"] == "Send request" and top.confidence == "high" and top.recommended
    assert engine.locate("send request", role="link").count() == 0 or engine.locate("send request", role="link").first().match == "fuzzy"
    assert engine.locate("sendrequst").orderBy("rank").first().match == "fuzzy"


def test_addresses_resolve_to_their_nodes_and_tell_when_they_cannot(spark):
    index = index_of(spark, FIXTURE, RANK_PAGE)
    minted = A.mint(index.nodes.where("interactive"))
    assert A.resolve(minted, index.nodes).where("status <> 'RESOLVED' or seq <> address_id").count() == 0
    gone = minted.withColumn("name", F.concat("name", F.lit("?")))
    assert {r.status for r in A.resolve(gone, index.nodes).collect()} == {"NOT_FOUND"}
    moved = minted.withColumn("heading_path", F.when(F.size("heading_path") > 0, F.concat(F.slice("heading_path", 1, 1), F.array(F.lit("new")))).otherwise(F.col("heading_path")))
    assert {(r.status, r.relaxed) for r in A.resolve(moved.where("name = 'Send request'"), index.nodes).collect()} == {("RESOLVED", True)}
    crowd = minted.withColumn("peer_count", F.lit(7))
    assert {r.status for r in A.resolve(crowd, index.nodes).collect()} == {"AMBIGUOUS"}


def test_changes_between_snapshots(spark):
    a, b = index_of(spark, FIXTURE), index_of(spark, FIXTURE.replace("Send request", "Submit").replace("40 euro a year", "50 euro a year"))
    kinds = {r.kind for r in D.semantic_changes((a.nodes, a.chunks), (b.nodes, b.chunks)).collect()}
    assert {"control-added", "control-removed", "region-content"} <= kinds
    assert D.semantic_changes((a.nodes, a.chunks), (a.nodes, a.chunks)).count() == 0


def test_region_text_by_scope(spark):
    engine = Engine(index_of(spark, RANK_PAGE).pages)
    whole, exact = engine.section(["Help"]).first(), engine.section(["Help"], "exact").first()
    outline = engine.section(["Help", "Refund policy"], "outline").first()
    assert "References" in whole.text and exact.text == "Help" and outline.text.startswith("Refund policy A refund") and "References" not in outline.text


def test_selectors_and_views(spark):
    engine = Engine(index_of(spark, FIXTURE).pages)
    assert [r.href for r in engine.select_css("nav > a[rel]").collect()] == ["https://e.example/a"]
    assert engine.inventory("forms").first().required == 2 and engine.inventory("scopes").count() == 1
    for bad in ("a:hover", ""):
        with pytest.raises(InvalidInput):
            engine.select_css(bad)
    assert Selector("div .x, p").matches(list(parse("<body><p>").walk())[-1])


def test_text_columns_equal_the_literal_functions(spark):
    texts = ["registerTool für certificates ﬁn", "", "The cost of nationalization, running quickly", "log in to my account"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for column, function in ((T.tokens(F.col("t")), literal.tokens), (T.with_stems(T.tokens(F.col("t"))), lambda s: literal.with_stems(literal.tokens(s))), (T.expand_tokens(T.tokens(F.col("t"))), lambda s: literal.expand(literal.tokens(s)))):
        assert [r[0] for r in df.select(column).collect()] == [function(t) for t in texts]
    assert [r[0] for r in df.select(T.etag_fnv(F.col("t"))).collect()][1] == "ztntfp"


def test_answers_take_in_fragments_and_cut_on_words():
    assert literal.best_sentence("Yes. The permit costs forty euro a year.", {"yes"})[3] == "Yes. The permit costs forty euro a year."
    assert literal.best_sentence("word " * 200, {"word"})[3].endswith("word")
    assert literal.best_sentence("Nothing here.", {"permit", "cost"}) is None


def test_pages_of_results_are_bound_to_a_revision(spark):
    df = spark.range(10).selectExpr("id as doc", "cast(id + 1 as int) as rank")
    page = paginate(df, "rank", ("doc",), 4)
    assert page.matched == 10 and page.next_offset == 4
    assert paginate(df, "rank", ("doc",), 4, 8, page.revision).next_offset is None
    with pytest.raises(StaleCursor):
        paginate(df.where("doc > 0"), "rank", ("doc",), 4, 4, page.revision)
    assert shrink_to(lambda n: n * 100, 40, 600) == (5, False)


def test_config_merges_and_refuses_odd_values():
    cfg = configure({"segment": {"max_words": float("nan")}, "retrieval": {"nav_landmarks": lambda base: [*base, "search"], "citation_headings": lambda base: 1 / 0}})
    assert cfg.segment.max_words == 200 and cfg.retrieval.nav_landmarks[-1] == "search" and "references" in cfg.retrieval.citation_headings


def test_manifest_reads_only_what_is_listed(spark):
    bodies = spark.createDataFrame([("https://a.example", "/llms.txt", "# A\n- [G](/g.md)\n"), ("https://a.example", "/llms-full.txt", "- [H](/h.md)")], "origin string, path string, body string")
    fetched = spark.createDataFrame([("https://a.example", "https://a.example/g.md", "text"), ("https://a.example", "https://a.example/h.md", "no"), ("https://a.example", "https://a.example/i", "<html>")], "origin string, url string, body string")
    assert {(r.url[-4:], r.action) for r in M.manifest_read(bodies, fetched).collect()} == {("g.md", "read"), ("h.md", "refused"), ("le/i", "refused")}


def test_quoted_answers_must_be_in_the_region():
    assert verified_answer("The fee is 40 euro.", "40  EURO") == "40  EURO" and verified_answer("The fee", "50") is None and verified_answer("x", None) is None


def test_orientation_and_summaries_keep_their_bounds(spark):
    from pagelode.operators.orientation import orientation, orientation_rows, summarised

    told = orientation({"purpose": "p" * 400, "tasks": [{"locate": "a", "selector": "a:hover"}, {"locate": "Apply", "selector": "#f"}, *[{"locate": "x" * 90, "constraint": "y" * 200}] * 9]})
    assert len(told["purpose"]) == 280 and told["tasks"][0]["locate"] == "Apply" and len(repr(told)) <= 4 * 180
    assert orientation_rows(spark, {1: {"purpose": "Permits"}}).first().purpose == "Permits"
    assert summarised("short", lambda s: "x") == ("short", False)
    assert summarised("long text " * 100, lambda s: "brief") == ("brief", True) and summarised("long text " * 100, lambda s: None)[1] is False


def test_inline_frames_are_read_only_when_asked_for():
    page = "<body><p>Shell</p><iframe srcdoc='<p>Inside the frame</p>'></iframe>"
    assert "Inside" not in str(project_page(page).nodes)
    found = project_page(page, None, configure({"project": {"frames": True}})).nodes
    assert [n["frame"] for n in found if "Inside" in n["text"]] == ["0"]


def afforded(spark, body: str, cfg=None, lang: str = "en", url: str = "https://here.example/a/b") -> dict:
    from pagelode.operators.page_index import PageIndex

    pages = spark.createDataFrame([(1, url, f"<html lang={lang}><body>{body}</body></html>")], "page_id long, url string, html string")
    nodes = (PageIndex(pages) if cfg is None else PageIndex(pages, cfg)).nodes.where("interactive")
    return {r["attrs"].get("data-k", r["name"]): dict(r["affordance_via"]) for r in nodes.collect()}


def test_what_controls_afford(spark):
    body = """
    <a data-k=1 rel=next href=/2>x</a><a data-k=2 rel="previous nofollow" href=/0>y</a><a data-k=3 href=/3>Next page</a><a data-k=4 href=/3>What is next</a>
    <a data-k=5 hreflang=de href=/de>DE</a><a data-k=6 lang=fr href=/fr>Accueil</a><a data-k=7 href=/vi>Tiếng Việt</a><a data-k=8 href=/id>Indonesian</a>
    <a data-k=9 href=/e>English muffins</a><a data-k=10 target=_blank href=/x>Docs</a><a data-k=11 href="https://other.example/">Out</a><a data-k=12 href="//here.example/c">In</a>
    <main><form><input data-k=13 type=search><input data-k=14 name=q></form></main><form><button data-k=15 type=submit>Go</button></form>
    <button data-k=16 type=button>Place order</button><button data-k=17 type=button>Delete all</button><button data-k=18 type=button>Add to bag</button>
    <input data-k=19 type=checkbox aria-label=Terms><button data-k=20 type=button aria-controls=p>More info</button><div id=p>Panel</div>
    <button data-k=21 type=button command=--spin>Spin</button><button data-k=22 type=button popovertarget=p>Menu</button><a data-k=23 href=/l>3 languages</a>"""
    found = afforded(spark, body)
    want = {
        "1": {"pagination-next": "rel=next"}, "2": {"pagination-prev": "rel=prev"}, "3": {"pagination-next": "name-pattern"}, "4": {},
        "5": {"language-switcher": "hreflang"}, "6": {"language-switcher": "lang"}, "7": {"language-switcher": "language-name"},
        "8": {"language-switcher": "language-name"}, "9": {}, "10": {"external": "target=_blank"}, "11": {"external": "cross-origin"}, "12": {},
        "13": {"search": "role", "primary-input": "sole-field"}, "14": {"search": "name-pattern"}, "15": {"submit": "type=submit"},
        "16": {"submit": "name-pattern"}, "17": {"destructive": "name-pattern"}, "18": {"add-to-cart": "name-pattern"}, "19": {"toggle": "role"},
        "20": {"discloses": "aria-controls"}, "21": {"spin": "command"}, "22": {"discloses": "popovertarget"}, "23": {"language-switcher": "name-pattern"},
    }
    assert {k: v for k, v in found.items() if k in want} == want


def test_the_first_field_and_patterns_of_ones_own(spark):
    two = "<form><input data-k=a><input data-k=b></form><form><input data-k=c></form>"
    assert [k for k, v in afforded(spark, two).items() if "primary-input" in v] == ["c"]
    assert [k for k, v in afforded(spark, f"{two}<main><form><input data-k=d><input data-k=e></form></main>").items() if "primary-input" in v] == ["d"]
    assert afforded(spark, f"{two}<input data-k=f autofocus>")["f"]["primary-input"] == "autofocus"
    cfg = configure({"patterns": {"bid": r"\bbid\b", "search": "(", "submit": "x" * 300}})
    assert afforded(spark, "<button data-k=a type=button>Search</button><button data-k=b type=button>Bid now</button>", cfg) == {"a": {}, "b": {"bid": "name-pattern"}}
    assert afforded(spark, "<a data-k=a href=/>Deutsch</a><a data-k=b href=/>allemand</a>", lang="fr") == {k: {"language-switcher": "language-name"} for k in "ab"}


def test_references_without_a_semicolon_are_text_where_they_should_not_count():
    page = "<body><h1>Fish &amp chips &amp; peas &ampx; &lt;b&gt; &#38; &nosuch; &amp</h1><a href='/?a=1&copy=2&amp;b=3' title='&lt'>R&amp;D &amp</a><script type='application/ld+json'>{\"@type\":\"HowTo\",\"name\":\"A &amp B & C\"}</script>"
    kept = {n["tag"]: n for n in project_page(page, "https://e.example/", configure({"project": {"bare_references": False}})).nodes}
    assert kept["h1"]["text"] == "Fish &amp chips & peas &ampx; <b> & &nosuch; &amp"
    assert (kept["a"]["name"], kept["a"]["href"], kept["a"]["attrs"]["title"]) == ("R&D &amp", "https://e.example/?a=1&copy=2&b=3", "&lt")
    assert "A &amp B & C" in "".join(parse(page, False).texts())  # scripts stand as they are
    assert project_page(page).nodes[0]["text"] == "Fish & chips & peas &x; <b> & &nosuch; &"


def test_outline_reads_references_as_its_sql_does(spark, tmp_path):
    rows = [(n, "https://e.example/", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>Text</p></body></html>") for n, t in enumerate(["Cut off&amp;&amp", "Fish &lt chips", "R&amp;D &amp;lt;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(Q.page_outline(spark, str(tmp_path)), con, Q.oracle_sql()["page_outline"])


def test_a_pass_over_pages_gives_only_what_is_asked_and_its_passages(spark):
    pages = spark.createDataFrame([(n, "https://e.example/", f"<html lang=en><body><nav><a href='/{n}' class=x>Go {n}</a></nav><main><h1>T{n}</h1><p>Words of {n}.</p></main></body></html>") for n in range(100)] + [(100, None, None)], "page_id long, url string, html string").coalesce(1)
    whole, lean = html.project(pages), html.project(pages, parts=("nodes", "chunks"), fields=("seq", "role", "heading_path", "attrs"))
    rows = [(r["page_id"], [(n["seq"], n["role"], n["heading_path"], n["attrs"]) for n in r["nodes"]], r["chunks"]) for r in lean.collect()]
    assert rows == [(r["page_id"], [(n["seq"], n["role"], n["heading_path"], n["attrs"]) for n in r["nodes"]], r["chunks"]) for r in whole.collect()]
    first = lean.first()
    link = next(n for n in first["nodes"] if n["role"] == "link")
    assert first["opaque"] is None and link["name"] is None and link["attrs"] == {"href": "/0", "class": "x"}
    assert first["chunks"][-1]["text"] == "Words of 0."
    assert str(segment_stats(segment(lean))._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_page_queries_run_python_once_and_keep_nothing(spark, sf):
    for name in ("nav_controls", "address_ordinals", "segment_strategies", "page_outline"):
        plan = str(Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan())
        assert plan.count("MapInArrow") == 1 and "InMemoryTableScan" not in plan and "MapInPandas" not in plan, name
