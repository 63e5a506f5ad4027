"""Nearest neighbours, WARC and page extraction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_dom, learned_partitions, warc, wrapper
from marlstone.llm.queries import op5_warc_revisits, oracle_sql

# -- vectors --------------------------------------------------------------------------------------


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q % every == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for j, (i, w) in enumerate(ok) if j != at and len(w) == len(v))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d)]
    return sorted(out)


def odd_vectors():
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]  # many ties and copies
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    # rows of one id, and of other lengths
    return [*rows, (3, [3.0, 3.0, 1.0]), (10, [9.0, 9.0, 9.0]), (20, [6.0, 0.0, 1.0]), (30, [1.0, 2.0]), (31, [2.0, 2.0]), (40, [5.0])]


def test_search_on_odd_vectors(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit("x")).withColumn("part", F.lit(0)).withColumn("row", F.lit(0))
    got = learned_partitions.search(df, k=5, every=10, target_recall=1.0)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, 5, 10)


def test_search_on_two_levels(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "SECOND_ROWS", 40)
    monkeypatch.setattr(learned_partitions, "PARTS", (4, 8))
    monkeypatch.setattr(learned_partitions, "SECOND_PARTS", 4)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 6)))] + [(i + 2000, v) for i, v in odd_vectors() if i is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 5, 10)
    assert sorted(map(tuple, learned_partitions.search(df, k=5, every=10, target_recall=1.0).collect())) == want
    got = {tuple(r)[::2] for r in learned_partitions.search(df, k=5, every=10, target_recall=0.9).collect()}
    assert np.mean([(q, i) in got for q, _, i, _ in want]) >= 0.85


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in learned_partitions.search(df).collect()] == [(0, 1, 1, 2**0.5)]
    assert learned_partitions.search(df.limit(0)).collect() == []


def test_search_recall_on_clusters_with_few_probes(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in learned_partitions.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {}
    for q, _, i, _ in brute_nearest(rows, 10, 100):
        want.setdefault(q, set()).add(i)
    assert np.mean([len(got[q] & want[q]) / len(want[q]) for q in want]) >= 0.9
    assert learned_partitions.fit(x, 3000).probes < 8


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 8))
    part = learned_partitions.partition_graph(x, learned_partitions.nearest_in(x, x, 10, True), 8)
    assert set(np.bincount(part)) <= {125}


# -- WARC -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTP://User@WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#frag", "example.com/a/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://m.example.com/x.html?ref=q", "m.example.com/x.html"),
        (None, ""),
        ("//h:8080/p?q", "h:8080/p?q") if False else ("http://h:8080/p?q", "h:8080/p?q"),
    ],
)
def test_canonical_url(spark, url, key):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(F.col("u"))).first()[0] == key


def captures(spark, rows):
    return spark.createDataFrame(rows, warc.CAPTURES)


def test_revisits_take_the_latest_earlier_response_and_its_permitted_headers(spark):
    rows = [
        (1, "http://a/x", 10, True, 'W/"1"', None, "d1", {"etag": '"1"', "content-type": "text/html", "date": "1", "x-old": "y"}),
        (2, "http://a/x#f", 20, False, '"1"', None, None, {"date": "2", "Content-Length": "0"}),
        (3, "http://a/x", 30, True, '"2"', "m", "d3", None),
        (4, "http://a/x", 40, False, '"1"', None, None, {}),
        (5, "http://a/x", 50, False, None, "m", None, {"age": "5"}),
        (6, "http://b/y", 5, False, '"1"', None, None, {}),
        (7, "http://b/y", 5, True, '"1"', None, "d7", {}),
        (8, None, None, False, None, None, None, None),
        (9, "http://a/x", 60, False, None, None, "d3", {}),
    ]
    got = {r["id"]: r for r in warc.resolve_revisits(captures(spark, rows)).collect()}
    status = {i: (r["status"], r["refers_to"], r["digest"]) for i, r in got.items()}
    assert status == {
        1: ("full", None, "d1"), 2: ("resolved", 1, "d1"), 3: ("full", None, "d3"), 4: ("mismatch", None, None), 5: ("resolved", 3, "d3"),
        6: ("no_response", None, None), 7: ("full", None, "d7"), 8: ("no_response", None, None), 9: ("resolved", 3, "d3"),
    }
    assert got[2]["headers"] == {"etag": '"1"', "content-type": "text/html", "date": "2", "x-old": "y"}


def test_header_names_meet_in_any_case(spark):
    rows = [(1, "http://a/", 1, True, None, "m", "d", {"etag": "x", "Date": "1", "Server": "s"}), (2, "http://a/", 2, False, None, "m", None, {"ETag": "y", "date": "2"})]
    got = {r["id"]: r for r in warc.resolve_revisits(captures(spark, rows)).collect()}
    assert got[2]["headers"] == {"ETag": "y", "date": "2", "Server": "s"}


def test_revisits_of_one_url_without_times(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 5)
    rows = [(f"r{i:03}", "http://hot/", None, i == 7, '"e"', None, f"d{i}", {}) for i in range(60)]
    df = spark.createDataFrame(rows, warc.CAPTURES.replace("id long", "id string"))
    got = {r["id"]: (r["status"], r["refers_to"]) for r in warc.resolve_revisits(df).collect()}
    assert got == {f"r{i:03}": ("full", None) if i == 7 else ("no_response", None) if i < 7 else ("resolved", "r007") for i in range(60)}


def test_revisits_across_time_buckets_and_with_bodies(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 7)
    rows = [(i, "http://hot/", i, i % 11 == 0, f'"{i // 11}"', None, f"d{i}", {}) for i in range(100)]
    bodies = spark.createDataFrame([(i, bytearray(f"b{i}".encode())) for i in range(0, 100, 11)], "id long, body binary")
    got = {r["id"]: r for r in warc.resolve_revisits(captures(spark, rows), bodies).collect()}
    for i in range(100):
        assert got[i]["status"] == ("full" if i % 11 == 0 else "resolved")
        assert bytes(got[i]["body"]) == f"b{i - i % 11}".encode()
    assert warc.resolve_revisits(captures(spark, rows).limit(0)).collect() == []


def test_op5_equals_sql_on_odd_pages(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "http://a/x", "p"), (2, "http://a/x?ref=1", "p"), (3, "http://a/x/", "q"), (4, None, None), (5, "", ""), (6, "http://www.a/x", None), (7, "https://b", "z"), (8, "https://b#t", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op5_warc_revisits(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", spark.read.parquet(f"{tmp_path}/pages.parquet").toArrow())
    assert got == sorted(con.execute(oracle_sql()["op5_warc_revisits"]).fetchall(), key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_record_files_round_trip(spark, tmp_path, compress):
    records = [
        {"record_id": "<urn:1>", "type": "response", "url": "http://a/", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"content-type": "text/plain", "etag": '"e"'}, "body": b"hello\r\n\r\nWARC/1.0"},
        {"record_id": "<urn:2>", "type": "revisit", "url": "http://a/", "date": "2024-01-02T00:00:00Z", "status": 304, "headers": {"etag": '"e"'}, "body": b""},
        {"record_id": "<urn:3>", "type": "warcinfo", "body": b"software: x"},
    ]
    (tmp_path / "x.warc.gz").write_bytes(warc.to_bytes(records, compress))
    df = warc.read_records(spark, str(tmp_path))
    got = {r["record_id"]: r for r in df.collect()}
    assert bytes(got["<urn:1>"]["body"]) == records[0]["body"] and got["<urn:2>"]["status"] == 304 and got["<urn:3>"]["status"] is None
    status = {r["status"] for r in warc.resolve_revisits(warc.captures_of(df)).collect()}
    assert status == {"full", "resolved"}


# -- pages ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p {{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/">Home {n}</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side {n}</p></div>
<article><h1>Title&nbsp;{n} &amp; more</h1><p>First   para <b>bold {n}</b>.<br>Next line<p>Second &eacute; {n}<ul><li>one {n}</li><li>two {n}</ul>
<p class="share">Share this</p><p>Read our best stories every day</p><!-- <p>gone</p> --><form><p>Your mail</p></form></article>
<section class="comments"><p>Nice post {n}</p></section><div class="ad">Buy {n}</div><footer>&copy; Site {n}</footer></body></html>"""


def expected(n):
    return f"Title {n} & more\nFirst para bold {n}. Next line\nSecond é {n}\none {n}\ntwo {n}"


def test_wrapper_drops_template_and_boilerplate(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(12)]
    got = {r["page_id"]: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(12):
        assert got[n]["text"] == expected(n)  # the repeated line in the article is template too
        assert got[n]["n_chars"] == len(expected(n))


def test_page_alone_on_its_host_keeps_its_lines(spark):
    df = spark.createDataFrame([(1, "http://alone/", PAGE.format(n=5))], "page_id long, url string, html string")
    assert wrapper.main_text(df).first()["text"] == expected(5) + "\nRead our best stories every day"


def test_pages_without_article_by_links_and_constants(spark):
    page = "<body><div><a href=a>Alpha {n}</a> <a href=b>Beta {n}</a></div><div><p>Body text of page {n} that goes on.</p></div><div>Terms and privacy</div></body>"
    rows = [(n, "http://plain/x", page.format(n=n)) for n in range(9)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {n: f"Body text of page {n} that goes on." for n in range(9)}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "http://a", ""), (3, "nonsense", "just text"), (4, "http://a", "<p>un<b>closed"), (4, "http://a", "<p>un<b>closed"), (5, "http://b", deep), (6, "http://c", "<<<>>> &bogus; <a <b>"), (None, "http://d", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("q")).withColumn("text", F.lit("q"))
    got = [(r["page_id"], r["text"]) for r in wrapper.main_text(df).collect()]
    texts = dict(got)
    assert len(got) == 8 and texts[1] == texts[2] == "" and texts[3] == "just text" and texts[4] == "unclosed" and texts[5] == "deep" and texts[None] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in wrapper.main_text(df).collect())
    assert wrapper.main_text(df.limit(0)).collect() == []


def test_hosts_of_one_layout_keep_their_own_constants(spark):
    page = "<body><article><p>{line}</p><p>Story {n} of {host}.</p></article></body>"
    rows = [(i * 10 + n, f"http://{host}/{n}", page.format(line=line, n=n, host=host)) for i, (host, line) in enumerate([("a.example", "Tagline of a"), ("b.example", "Tagline of b")]) for n in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(df).collect()}
    assert got == {i * 10 + n: f"Story {n} of {host}." for i, host in enumerate(["a.example", "b.example"]) for n in range(9)}


def test_constants_of_every_template_of_a_host_go(spark):
    shapes = ["<div>{m}</div><div>{b}</div>", "<div>{m}</div><table><tr><td>{b}</td></tr></table>", "<section>{m}</section><div>{b}</div>", "<center>{m}</center><section>{b}</section>"]
    body = lambda n: f"<p>Story {n} begins {n * 37} here and goes on for a while.</p><p>It ends at {n * 91}.</p>"
    rows = [(n, f"http://many.example/{n}", "<body>" + shapes[n % 4].format(m=f"<p>Menu of template {n % 4}</p>", b=body(n)) + "</body>") for n in range(80)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Story {n} begins {n * 37} here and goes on for a while.\nIt ends at {n * 91}." for n in range(80)}


def test_a_page_with_many_copies_keeps_its_own_lines(spark):
    page = "<body><article><p>Story {n} of the host, told at length.</p>{more}</article></body>"
    copy = page.format(n=0, more="<blockquote>Only here</blockquote>")
    rows = [(n, f"http://copied.example/{n}", copy if n < 40 else page.format(n=n, more="")) for n in range(50)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Story {n if n >= 40 else 0} of the host, told at length." + ("\nOnly here" if n < 40 else "") for n in range(50)}


def text_of(source):
    return wrapper.extract(html_dom.read(source), None)


def test_depth_does_not_change_the_method(spark):
    inner = "<script>var x</script><nav>Menu</nav><p>a &amp; b</p><p>c</p>"
    assert text_of("<div>" * 3000 + inner + "</div>" * 3000) == "a & b\nc"
    assert text_of("<b>" * 3000 + inner) == "a & b\nc"
    # a host whose pages are all that deep has a wrapper like any other
    rows = [(n, "http://deep.example/", "<div>" * 3000 + f"<div>Menu for all</div><div><p>Story {n} in the deep.</p></div>") for n in range(4)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {n: f"Story {n} in the deep." for n in range(4)}


def test_long_constants_of_a_host_go(spark):
    page = "<body><div><p>Story {n} is short.</p><div>" + "These terms hold for all. " * 40 + "</div></div></body>"
    rows = [(n, f"http://terms.example/{n}", page.format(n=n)) for n in range(12)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {n: f"Story {n} is short." for n in range(12)}


def test_copies_of_a_page_are_not_template(spark):
    rows = [(n, "http://copies/x", "<article><p>Only story here</p></article>") for n in range(6)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Only story here"}


def tree(shape):
    """A tree of (name, children)."""
    t = wrapper.Tree(html_dom.Kind("div", shape[0]))
    t.kids = [tree(k) for k in shape[1]]
    t.seal()
    return t


def brute_match(a, b):
    """Simple tree matching as it is defined, without any shortcut."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return 1 + best[-1][-1]


def random_shape(rng, depth=0):
    n = int(rng.integers(0, 5)) if depth < 4 else 0
    return (str(rng.choice(["a", "b", "c"])) if depth else "root", [random_shape(rng, depth + 1) for _ in range(n)])


def test_tree_matching_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = random_shape(rng), random_shape(rng)
        assert wrapper.match(tree(a), tree(b)) == brute_match(a, b)


def test_matched_pairs_keep_order_and_add_up_to_the_matching():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = tree(random_shape(rng)), tree(random_shape(rng))
        memo = {}
        size, pairs = wrapper.match(a, b, memo), wrapper._pairs(a, b, memo)[1]
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert size == 1 + sum(wrapper.match(a.kids[i], b.kids[j]) for i, j in pairs)


def test_alignments_in_parts_are_as_good_as_whole_ones():
    rng = np.random.default_rng(7)
    for n, m in ((40, 30), (7, 90), (1, 50), (64, 64)):
        ix, iy, w = rng.integers(0, 6, n), rng.integers(0, 5, m), rng.integers(0, 4, (6, 5))
        total = lambda pairs: sum(w[ix[i]][iy[j]] for i, j in pairs)  # noqa: B023, E731
        plain = wrapper._small_align(ix.tolist(), iy.tolist(), w.tolist())
        assert total(plain) == total(wrapper.align(ix, iy, w)) == total(wrapper.align(ix, iy, w, cells=20))


def test_thousands_of_children_take_no_second():
    import time

    other = "".join(f"<h2>Part {n}</h2><p>Text {n}</p><div><p>x</p></div>" for n in range(2500))
    page = "".join(f"<p>Text {n}</p><h2>Part {n}</h2>" for n in range(2500))
    began = time.monotonic()
    learned = wrapper.induce([html_dom.read(f"<body>{other}</body>")])
    assert text_of(f"<body>{page}</body>").count("\n") == 4999
    text = wrapper.extract(html_dom.read(f"<body>{page}</body>"), learned)
    assert text.count("\n") == 4999 and time.monotonic() - began < 3


def test_a_wrapper_reads_back_as_it_was():
    learned = wrapper.induce([html_dom.read(PAGE.format(n=n)) for n in range(4)])
    again = wrapper.from_json(wrapper.to_json(learned))
    assert again.structure == learned.structure and [t.role for t in wrapper._each(again)] == [t.role for t in wrapper._each(learned)]


def bare_page(n):
    links = "".join(f"<li><a href=x>Link {n} {k}</a></li>" for k in range(5))
    body = "".join(f"<p>Sentence {k} of story {n} says what happened on that day.</p>" for k in range(3 + n % 4))
    return (
        f"<body><div><ul>{links}</ul></div><div>Buy thing {n * 7} now.</div><div><h1>Title {n}</h1>{body}<div>Read more of us every day.</div></div>"
        f"<div><p>Great story, said reader {n}.</p></div><div>Bare host, page {n}</div></body>"
    )


def test_the_wrapper_finds_the_content_of_pages_without_names(spark):
    rows = [(n, "http://bare.example/", bare_page(n)) for n in range(20)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {n: "\n".join([f"Title {n}", *(f"Sentence {k} of story {n} says what happened on that day." for k in range(3 + n % 4))]) for n in range(20)}
    assert {r["page_id"]: r["text"] for r in got} == want


def test_names_make_no_difference_on_a_templated_host(spark):
    rows = [(n, "http://h.example/", PAGE.format(n=n) if n else None) for n in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    bare = df.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|article|footer|header|section)\b", "<$1div"), r"\s(class|id)=\"[^\"]*\"", ""))
    bare = bare.withColumn("html", F.regexp_replace("html", "<p>Share this</p>|Share this", ""))
    long = lambda d: d.withColumn("html", F.regexp_replace("html", "First   para", "First para " + "and so on " * 40))
    assert sorted(map(tuple, wrapper.main_text(long(bare)).collect())) == sorted(map(tuple, wrapper.main_text(long(df)).collect()))


def test_many_wrappers_are_joined_by_a_shuffle_with_the_same_result(spark, monkeypatch):
    rows = [(100 * h + n, f"http://h{h}.example/", bare_page(n)) for h in range(3) for n in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, wrapper.main_text(df).collect()))
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wrapper.main_text(df).collect())) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ('<p><a href="x"">text</a> <b class="c">z</b></p>', "text z"), ('<p title="a > b">in</p>', "in"), ("<p title='it>s'>in</p>", "in"), ('<p title="open>kept</p><p>too</p>', "kept\ntoo"),
        ("<p>a<br/>b<BR>c</p>", "a b c"), ("<p>x<script>if (a<b) { '</p>' }</script>y</p>", "xy"), ("a<p>b</div>c", "a\nbc"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>&lt;b&gt; &#8364; &amp;amp; &nosuch;</p>", "<b> € &amp; &nosuch;"), ("<!-- a --><p>b</p><!-- open", "b"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ],
)
def test_markup(source, want):
    assert text_of(source) == want


def test_many_open_quotes_take_linear_time():
    import time

    began = time.monotonic()
    text_of('<a href="' * 20_000)
    text_of("<" * 50_000 + "<p>x")
    assert time.monotonic() - began < 5
