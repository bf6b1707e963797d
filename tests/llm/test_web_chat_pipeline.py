"""HTML extraction, chat formatting and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapsekit.llm import op5_html as H
from lapsekit.llm.op6_chat import format_conversations, read_back
from lapsekit.llm.templates import Escaper, TemplateError, compile_template, fold_body, parse


def test_blocks_and_known_noise():
    page = ('<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header>H</header><div class="sidebar-left">S</div>'
            '<script>var t="</p>";</script><!-- c > --><div id="content"><p>Hi &amp; <b>bo</b>ld &#233;<p>two<br>lines\n\t x <ul><li>a<li>b</ul>'
            '<form>f<input></form><div class="comment-list"><p>c</div><aside>z</aside><div class="cookieNotice">q</div>1 < 2 end</div><footer>f</footer>')
    assert H.main_text(page) == "Hi & bold é two lines x a b 1 < 2 end"
    assert H.main_text("<body>out<article><header><h1>T</h1></header><p>in</p></article><p>out") == "T in"
    for odd in ("", "plain", "<", "<p", "<!--", "<script>", "</p></b>", "<a href='x>y", "<p title=\"a>b\">t"):
        assert isinstance(H.main_text(odd), str)
    assert H.main_text("a &lt;b&gt;  c") == "a <b> c"


@pytest.fixture(scope="module")
def site(prose):
    """A host without telling names: the boilerplate is only known by its repetition."""
    rows = []
    for i in range(30):
        body = "".join(f'<div class="k2"><p>{prose(20, i * 10 + j)}</p></div>' for j in range(3))
        rows.append((i, f"https://host.example/{i}", f'<html><body><div class="k1">Welcome to our site and buy</div>{body}<div class="k3">Call us now</div></body></html>'))
    rows += [(100, None, "<p>alone</p>"), (101, "https://other.example/x", None), (102, "https://other.example/y", ""),
             (103, "https://solo.example/", "<div class='k1'>Welcome to our site and buy</div><p>t</p>"), rows[0]]
    return rows


def test_style_tree(spark, site):
    df = spark.createDataFrame(site, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    got = H.extract(df).collect()
    assert len(got) == len(site)
    by = {r.page_id: r.text for r in got}
    for i in range(30):
        assert "Welcome" not in by[i] and "Call us" not in by[i] and by[i].count(" ") >= 50
    assert by[100] == "alone" and by[101] == "" and by[102] == "" and by[103] == "Welcome to our site and buy t"
    nodes = {(r.host, round(r.importance, 6)) for r in H.low_nodes(df).collect()}
    assert {h for h, _ in nodes} == {"host.example"}
    assert H.extract(df.limit(0)).collect() == []


def test_template_language():
    r = compile_template("{% set a = 1 + 2 %}{{ 'x' ~ a }}{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}"
                         "{% if m.k == 'a' and true %}A{% elif 'b' in m['k'] %}B{% else %}C{% endif %}{% endfor %}{{ none | default('d') | upper }}")
    assert "".join(x for x, _ in r(ms=iter([{"k": "a"}, {"k": "xb"}, {"k": "q"}]))) == "x31,A2,B3CD"
    assert fold_body(parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}dead{% else %}c{% endif %}")) == [("text", "ab1c")]
    g = compile_template("u{% generation %}{{ t }}{% endgeneration %}v")
    assert list(g(t="x")) == [("u", False), ("x", True), ("v", False)]
    for bad in ("{{ x.y() }}", "{% while x %}", "{{ x | foo }}", "{% for x in y %}", "{{ ( 1 }}", "{{ x; y }}", "{% if %}{% endif %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    assert "".join(x for x, _ in compile_template("{{ x.__class__ }}")(x="s")) == ""


def test_escaping_is_reversible():
    rng, marks = random.Random(0), ["<s>", "</s>", "[INST]", "[/INST]", "[[x"]
    e = Escaper(marks)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "s", ">", "/", "[", "INST", "]", "\\", *marks]) for _ in range(rng.randint(0, 12)))
        x = e.escape(s)
        assert e.unescape(x) == s and not any(m in x for m in marks)


def test_conversations_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b\\"), (1, 0, "system", None), (1, 1, "user", ""),
            (2, 0, "assistant", "[TURN:x\n[/TURN]"), (2, 0, "assistant", "[TURN:x\n[/TURN]"), (2, None, "tool[TURN:", "<s>"), (3, 0, None, None),
            (None, 0, "user", "n"), *[(9, i, ("user", "assistant")[i % 2], "long \\[INST] " * 300) for i in range(60)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = format_conversations(df).filter("conv_id = 9").count()
    assert parts > 1
    assert read_back(format_conversations(df.limit(0))).collect() == []


def test_pipeline_stages(spark, tmp_path, documents, nothing, prose):
    items = [(i, prose(40, 90_000 + i)) for i in range(5)]
    extra = [(1000 + i, prose(60, 91_000 + i) + " " + items[i][1], "en", "src0", 0) for i in range(5)]
    extra += [(1100, prose(60, 92_000) + " token = abcdef123456 " + prose(5, 92_001), "en", "src0", 7)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents.unionByName(more, allowMissingColumns=True)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names, now = docs.columns, spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == names
        seen[name] = now = spark.createDataFrame(now.collect(), now.schema)
    ids = {k: {r.doc_id for r in v.collect()} for k, v in seen.items()}
    assert ids["near_dedup"] < ids["quality_rules"] and ids["near_dedup"] - ids["decontamination"] == {1000 + i for i in range(5)}
    assert ids["secret_scan"] == ids["decontamination"] == ids["packing"]
    masked = seen["secret_scan"].filter("doc_id = 1100").first()
    assert "[SECRET]" in masked.text and "abcdef123456" not in masked.text and masked.n_chars == len(masked.text)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(tuple(r)[:5] for r in seen["packing"].collect())


def test_pipeline_on_nothing(spark, tmp_path, nothing):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_style_tree_inside_main(spark, site):
    """The tree also judges what is inside main; an article that a site repeats stays."""
    inside = [(i, u, h and h.replace("<body>", "<body><main>").replace("</body>", "</main></body>")) for i, u, h in site[:30]]
    story = "<html><body><article><h1>Part {}</h1><p>One story that is on all pages of this site, word for word.</p></article></body></html>"
    same = [(200 + i, f"https://again.example/{i}", story.format(chr(65 + i))) for i in range(12)]
    by = {r.page_id: r.text for r in H.extract(spark.createDataFrame(inside + same, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert "Welcome" not in by[i] and "Call us" not in by[i] and by[i].count(" ") >= 50
    for i in range(12):
        assert by[200 + i] == f"Part {chr(65 + i)} One story that is on all pages of this site, word for word."


def test_noise_names_do_not_cover_the_article():
    body = "<article><h1>T</h1><p>in</p><div class='share'>s</div></article>"
    for around in ("<div class='layout has-sidebar'>{}</div>", "<div id='no-sidebar'><div class='with-header menu-open'>{}</div></div>",
                   "<form action='/'>{}</form>", "<div class='menu-open'><main>{}</main></div>", "<fieldset><div role='form'>{}</div></fieldset>"):
        assert H.main_text("<nav>n</nav>" + around.format("<div class='sidebar'>side</div>" + body)) == "T in"
    # what names tell still counts beside the article, also where it holds articles or is long
    late = "<div class='comments'><article>" + "c " * 50 + "</article></div><form>search</form>"
    assert H.main_text(body + late) == "T in" and H.main_text(f"<main>{body}{late}</main>") == "T in"
    assert H.main_text(f"<div class='has-sidebar'>{body}{late}</div>") == "T in"
    assert H.main_text("<div class='has-sidebar'><p>most of the text</p><div class='sidebar'>less</div></div><div>x</div>") == "most of the text x"
    assert H.main_text("<div>the text of the page</div><div class='promo'>buy</div>") == "the text of the page"


def test_words_in_quoted_attributes_are_not_attributes(spark):
    from lapsekit.llm.op5_html import extract
    html = ("<html><body><article><div title=\"a hidden gem\">First.</div><p data-x='my hidden'>Second.</p>"
            "<div title=\"see class=sidebar here\">Third.</div><p data-role=navigation>Fourth.</p><div hidden>Gone.</div>"
            "<div class = \"sidebar\">Gone too.</div></article></body></html>")
    rows = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")
    assert extract(rows).first()["text"] == "First. Second. Third. Fourth."


def test_names_with_other_words_are_left_to_the_tree(spark, prose):
    """A name that only holds a noise word keeps its text where pages differ, and loses it where the site repeats it."""
    names = ['class="side-effects"', 'class="related-work"', 'id="share-price"', 'class="ad-hoc"', 'id="comments-on-method"']
    rows = []
    for i in range(8):
        body = "".join(f"<div {n}>{prose(12, 100 * i + j)}</div>" for j, n in enumerate(names))
        rows.append((i, f"https://host.example/{i}", f"<body><div class='ad-hoc-panel-x'>Always the same here</div>{body}<div class='site-footer'>f{i}</div></body>"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i].split() == " ".join(prose(12, 100 * i + j) for j in range(5)).split()
    assert all(map(H.noise_name, ["ad", "adSlot", "site-footer", "comment-list", "related-posts", "cookieNotice", "sidebar2"]))
    assert not any(map(H.noise_name, ["side-effects", "related-work", "share-price", "ad-hoc", "comments-on-method", "has-sidebar", "content", ""]))


def _tree(pages):
    """Low nodes by the definition alone: paths, texts and child sequences counted in plain dictionaries, entropies summed term by term."""
    import math
    from collections import Counter, defaultdict
    texts, layouts, n_pages = defaultdict(Counter), defaultdict(Counter), Counter()
    for page in pages:
        blocks, elements = H.blocks_of(page)
        for path, text in {(b[0], b[1]) for b in blocks}:
            texts[path][text] += 1
        n_pages.update({b[0] for b in blocks})
        for path, children in {(e.path, tuple(e.children)) for e in elements}:
            layouts[path][children] += 1
    low = set()
    for path, m in n_pages.items():
        if m < H.MIN_PAGES:
            continue
        every = [c for c in texts[path].values() for _ in range(c)]
        content = 1 - sum(math.log(c) for c in every) / len(every) / math.log(m)
        shapes = layouts[path.rpartition(">")[0]]
        k = sum(shapes.values())
        shape = -sum(c / k * math.log(c / k) for c in shapes.values()) / math.log(k) if k > 1 else 0.0
        if H.CONTENT * content + (1 - H.CONTENT) * shape < H.LOW:
            low.add(H._key(path))
    return low


def test_tree_of_the_given_pages_by_its_definition(spark, site):
    """Low nodes and texts of all pages of sf0.01 and of a site with repeated blocks against the plain form."""
    import os
    from collections import Counter, defaultdict

    from paths import SF_CHECK
    given = spark.read.parquet(os.path.join(SF_CHECK, "pages.parquet")).select("page_id", "url", "html")
    more = [(10 ** 6 + i, u, h) for i, (_, u, h) in enumerate(site)]
    pages = given.unionByName(spark.createDataFrame(more, given.schema))
    hosts = defaultdict(list)
    for r in H.with_host(pages, "url", "html", F.col("page_id")).collect():
        hosts[r.host].append(r)
    want = {h: _tree([r.html for r in rows]) for h, rows in hosts.items()}
    got = defaultdict(set)
    for r in H.low_nodes(pages).collect():
        got[r.host].add(r.node)
    assert {h: x for h, x in want.items() if x} == dict(got)
    texts = {r.page_id: r.text for r in H.extract(pages).collect()}
    why = Counter()
    for h, rows in hosts.items():
        for r in rows:
            judged = H.judged_blocks(r.html, want[h])
            why.update(w for _, w in judged)
            assert texts[r.page_id] == " ".join(t for t, w in judged if not w)
    assert why["tree"] > 0 and why[""] > 0


@pytest.mark.parametrize("role", ["a\nb", "x]", "]\n", "[TURN:", "\\", "system"])
def test_roles_are_read_back(role):
    """A role with line breaks or marks comes back as it was."""
    from lapsekit.llm.op6_chat import CONTROLS, TEMPLATE, Reader
    said = [(role, "one\n]\n[/TURN]"), ("user", "]\n"), (role, ""), ("assistant", "\\]\n</s>")]
    render = compile_template(TEMPLATE, Escaper(CONTROLS).escape)
    out = "".join(s for s, _ in render(messages=iter([{"role": r, "text": t} for r, t in said])))
    for cut in (1, 7, len(out)):
        reader = Reader()
        assert [x for i in range(0, len(out), cut) for x in reader.turns(out[i:i + cut])] == said and not reader.buffer
