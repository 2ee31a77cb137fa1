import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packwright.llm import decontam, htmltext, langid, linededup, mixing, urlfilter
from packwright.llm.queries import URL_RULES

# ---- URL filter -----------------------------------------------------------------------


def judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([len(tail), *(tail.index(c) for c in "?#" if c in tail)])]
    fit = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit) if fit else (0, None, "allow")
    return host, path, best[1], best[2]


URLS = [
    None, "", "nothing", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "https://example.net/en", "https://m.example.net/en/1", "https://example.net?/en/", "ftp://example.com/de/x",
    "http://badexample.com/de/x", "http://x.org/fr/", "http://org/fr/a#b", "http://a..net/", "http://é.net/en/", "http://u:p@example.net:80/en/", "a://b://c.net/", "http://example.net#/en/", "http://net./",
]


@pytest.mark.parametrize("share_rows", [1 << 18, 20])
def test_url_rules(spark, share_rows):
    rng = random.Random(0)
    labels = ["a", "b", "example", "net", "com", "org"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    urls = [*URLS, "http://net\x01evil/x", "http://evil\x01net/", "http://a\x02.net/", "http://\U0010ffff.net/", "http://x\x01.example.net/en/"] + [f"http://{host(rng.randint(1, 5))}/{rng.choice(['', 'en/', 'de/', 'en/a', 'e'])}" for _ in range(300)]
    rules = URL_RULES + [(host(rng.randint(1, 4)), rng.choice(["/", "/en/", "/e", ""]), rng.choice(["block", "allow"])) for _ in range(40)]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    for some in (URL_RULES, rules, []):
        got = urlfilter.filter_urls(df, some, share_rows=share_rows).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judge(u, some) for i, u in enumerate(urls)}
        assert len(got) == len(urls)
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0
    twice = spark.createDataFrame([(None, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.filter_urls(twice, URL_RULES).collect()] == ["block"] * 2


def test_url_filter_is_native(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urlfilter.filter_urls(df, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1] and "Arrow" not in plan.split("== Physical Plan ==")[1]


# ---- line dedup -----------------------------------------------------------------------

STRIP = " \t\n\x0b\x0c\r"


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(key(x), ())) >= min_docs and i != max(held[key(x)]))]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def line_docs():
    rng = random.Random(1)
    common = ["x" * 39, "y" * 40, "É" * 40, "z " * 25, "\tMixed Case " + "q" * 40 + "\r", "mixed case " + "Q" * 40, "\xa0" + "n" * 40]
    docs = []
    for i in range(40):
        lines = [rng.choice([*common, f"own {i} " + "o" * 50, "", " "]) for _ in range(rng.randint(0, 9))]
        docs.append((i, "\n".join(lines)))
    return [*docs, (50, None), (51, ""), (52, "\n\n"), (None, "y" * 40), (3, "y" * 40 + "\nagain"), (3, "y" * 40 + "\nagain"), (60, "w" * 200_000)]


def test_lines_equal_brute_force(spark):
    docs = line_docs()
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id long, text string, drops string").repartition(3)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(df).collect())
    assert got == brute_lines(docs)
    replaced = Counter((r.doc_id, r.text, r.drops) for r in linededup.replace_texts(df).collect())
    want = Counter()
    texts = Counter(docs)
    for (i, _, _, kept), n in brute_lines([d for d in docs if d[1] is not None]).items():
        want[i, kept, "a"] += n
    want[50, None, "a"] += texts[50, None]
    assert replaced == want
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# ---- decontamination ------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"u{rng.getrandbits(30)}" for _ in range(n)]
    items = [fresh(15), fresh(40), fresh(60), fresh(5), fresh(200)]
    far = list(items[1])
    for k in range(0, 40, 2):
        far[k] = "different"
    near = list(items[2])
    for k in range(4, 60, 9):
        near[k] = "other"
    docs = [
        (1, fresh(30) + items[0] + fresh(5)), (2, [w.upper() for w in items[1]]), (3, fresh(9) + near), (4, far + fresh(10)), (5, fresh(400)), (6, items[3]), (7, items[1][:12] + fresh(50)), (8, items[1][5:30]),
        (9, fresh(20000) + items[4] + fresh(100)), (10, items[0] + items[2]),
    ]
    df = spark.createDataFrame([(i, "\n ".join(t), 3) for i, t in docs] + [(11, None, 3), (12, "", 3), (None, "a", 3)], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 2), (6, 3), (8, 1), (9, 4), (10, 0), (10, 2)}
    for chars in (4 << 20, 300):
        got = decontam.contaminated(df, bench, max_block_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    place = next(r for r in got if r.doc_id == 1)
    assert (place.doc_start, place.item_start, place.n_words, place.n_same, place.item_words) == (30, 0, 15, 15, 15)
    kept = decontam.decontaminate(df, bench)
    assert {r.doc_id for r in kept.collect()} == {4, 5, 7, 11, 12, None} and kept.columns == df.columns
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_masks_survive_a_substitution():
    import numpy as np

    words = np.random.default_rng(0).integers(0, 2**64, 30, dtype=np.uint64)
    table = decontam.SeedTable([], [])
    assert not list(table.hits(words))
    for bad in range(15):
        a = words[:15].copy()
        a[bad] += np.uint64(1)
        found = False
        for salt, m in enumerate(decontam.MASKS):
            shape = decontam.mask_offsets(m)
            if shape[-1] < 15:
                found |= bool(np.isin(decontam.seed_hashes(a, shape, salt), decontam.seed_hashes(words[:15], shape, salt)).any())
        assert found, bad


def test_no_contaminated_window_is_missed():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(23)
    names, items = "abcdefghijklmnopqrstuvwxyz", []
    docs = []
    for n in [*range(1, 27), 40, 60]:
        for _ in range(12):
            item = [f"{rng.choice(names)}{rng.getrandbits(40)}" for _ in range(n)]
            size = rng.randint(min(13, -(-n * 8 // 10)), n)
            cut = rng.randint(0, n - size)
            part = item[cut : cut + size]
            bad = set(range(4, size, 5)) if rng.random() < 0.4 else set(rng.sample(range(size), size // 5))
            items.append(item)
            docs.append([f"x{rng.getrandbits(40)}" for _ in range(rng.randint(0, 9))] + ["bad" if k in bad else w for k, w in enumerate(part)] + ["end"])
    want = set()
    for k, doc in enumerate(docs):
        item = items[k]
        for diag in range(-len(item), len(doc)):
            lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
            if hi > lo:
                start, end = decontam.best_window(np.array([doc[q + diag] == item[q] for q in range(lo, hi)]), 0.8)
                if end > start and end - start >= min(13, -(-len(item) * 8 // 10)):
                    want.add((k, k))
    table = decontam.SeedTable(list(range(len(items))), [" ".join(x) for x in items])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array([" ".join(d) for d in docs])], ["doc_id", "text"])
    got = {(r["doc_id"], r["item_id"]) for out in decontam._verified(table, 13, 0.8)(iter([batch])) for r in out.to_pylist()}
    assert len(want) > 200 and got == want


def test_items_that_share_a_window_are_one_row():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    head, tail = fresh(14), fresh(16)
    items = [fresh(k % 3) + head + fresh(6) + (tail if k % 4 == 0 else fresh(9)) for k in range(60)] + [head, head, fresh(30)]
    ids = [500 - k for k in range(62)] + [None]
    near = list(head)
    near[5] = "other"
    docs = [fresh(9) + head + fresh(9), head, near + fresh(3), fresh(2) + items[8] + fresh(30) + tail, items[62] + head, fresh(40), head + fresh(1) + head]
    want = defaultdict(set)
    for d, doc in enumerate(docs):
        for item, name in zip(items, ids, strict=True):
            for diag in range(-len(item), len(doc)):
                lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
                if hi > lo:
                    same = np.array([doc[q + diag] == item[q] for q in range(lo, hi)])
                    start, end = decontam.best_window(same, 0.8)
                    if end > start and end - start >= min(13, -(-len(item) * 8 // 10)):
                        want[d, lo + start + diag, end - start].add((-int(same[start:end].sum()), name is None, name or 0, name))
    table = decontam.SeedTable(ids, [" ".join(x) for x in items])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array([" ".join(d) for d in docs])], ["doc_id", "text"])
    got = [r for out in decontam._verified(table, 13, 0.8)(iter([batch])) for r in out.to_pylist()]
    assert {(r["doc_id"], r["doc_start"], r["n_words"]): (r["item_id"], -r["n_same"], r["n_items"]) for r in got} == {k: (min(v)[3], min(v)[0], len({x[3] for x in v})) for k, v in want.items()}
    assert len(got) == len(want) > 8 and max(r["n_items"] for r in got) > 60


def test_best_window_is_the_longest():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        same = rng.random(rng.integers(0, 25)) < 0.7
        start, end = decontam.best_window(same, 0.8)
        widths = [j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8]
        assert end - start == max(widths, default=0)


# ---- language ID ----------------------------------------------------------------------


def test_every_label_value_is_learned(spark):
    rng = random.Random(31)
    rows = []
    for k in range(80):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(len(rows) + n, " ".join(rng.choice(words) for _ in range(30)), f"l{k:02d}") for n in range(6 if k % 2 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == [f"l{k:02d}" for k in range(80)]
    got = langid.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_id(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(sf).select("doc_id", "text", "lang")
    held = langid.remainder(F.col("doc_id")) == 2
    model = langid.train(docs.where(~held))
    assert model.langs == ["de", "en", "es", "fr"]
    judged = langid.identify(docs.where(held).withColumn("score", F.lit("old")), model).collect()
    right = sum(r.lang_pred == r.lang for r in judged)
    assert right >= 0.97 * len(judged) and all(0 <= r.score <= 1 for r in judged)
    assert {langid.crc_remainder(i) for i in (0, 5)} == {zlib.crc32(b"0") % 4, zlib.crc32(b"5") % 4}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?! 5\n"), (4, "ÀÉ"), (5, "a" * 300_000), (6, "日本")], "i int, text string")
    got = {r.i: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and all(got[k][0] != "und" for k in (4, 5, 6))
    assert langid.train(docs.where("false")) is None and langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    only = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(odd, only).collect()} == {"und", "en"}


# ---- HTML -----------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z&nbsp;w<br>v</article><footer>f", "T x yz w v"),
    ("<body><div class='sidebar'>s</div><div id=main><p>one &lt;two&gt;</p><p>three</p></div><div class='comments'>bad</div>", "one <two> three"),
    ("<article><p>kept</p><section class=comments><p>gone</p></section><form>f</form><script>if (a<b) x()</script><style>p{}</style><!-- no --></article>", "kept"),
    ("<div hidden>h</div><div style='display: none'>d</div><p>seen</p>", "seen"), ("<article><p>cut <a href='x", "cut"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<title>t</title><p>body\n\n  text</p>", "body text"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"), ("<body class='has-sidebar'><main><p>m</p></main></body>", "m"), ("<article><header><h1>Head</h1></header><p>p</p></article>", "Head p"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert htmltext.extract_text(page) == text


FIRST, SECOND = "A long paragraph tells of many things, one after the other. " * 5, "A second one goes on with further words, and some more. " * 5
STORY, TOLD = f"<p>{FIRST}</p><p>{SECOND}</p>", f"{FIRST.strip()} {SECOND.strip()}"
NAV, FOOT = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></nav>", "<footer>&copy; 2020 a company</footer>"
REPLIES = "".join(f'<article class="comment"><p>Reader {i} says that this is great and goes on a little.</p></article>' for i in range(40))


@pytest.mark.parametrize(
    "body",
    [
        f'<div class="content no-sidebar">{STORY}</div>',
        f'<div class="has-sidebar"><div>{STORY}</div><div class="sidebar">side <a href=x>link</a></div></div>',
        f'<div class="recipe cookie">{STORY}</div>',
        f'<div class="cookie"><div id="footer"><form>{STORY}</form></div></div>',
        f"<article><div>{STORY}</div><section class=comments>{REPLIES}</section></article>",
        f'<div>{STORY}</div><div id="comments">{REPLIES}</div>',
        f"<article>{STORY}<article><p>A reader says much about this.</p></article></article>",
        f"<div class=cookie-banner><p>{'We use cookies for everything. ' * 4}</p></div><article>{STORY}</article>",
        f"<aside><p>{'Something else entirely. ' * 8}</p></aside><div>{STORY}</div>",
    ],
)
def test_density_decides_and_names_are_a_prior(body):
    assert htmltext.extract_text(f"<html><body>{NAV}{body}{FOOT}</body></html>") == TOLD
    assert htmltext.extract_text(f'<html><body><form id="aspnetForm">{NAV}{body}{FOOT}</form></body></html>') == TOLD


def test_a_page_of_menus_is_empty_and_deep_pages_are_linear():
    assert htmltext.extract_text(NAV + FOOT) == ""
    began = time.perf_counter()
    assert htmltext.extract_text("<div>" * 50_000 + STORY + "</div>" * 50_000) == TOLD
    assert htmltext.extract_text("<b>" * 30_000 + "<h2>x</h2></ul>" * 30_000).startswith("x x")
    assert htmltext.extract_text("<form>" * 20_000 + STORY) == TOLD
    assert time.perf_counter() - began < 10


def slow_density(n, share):
    """A node's density by recursion over its text, tags and links."""
    text, tags, link, links = _slow_counts(n)
    if not text:
        return 0.0
    base = math.log(text / max(1, text - link) * link + share * text + math.e)
    return text / max(1, tags) * math.log(max(text / max(1, link) * max(1, tags) / max(1, links), 1.0)) / max(math.log(base), 1e-9) if base > 1 + 1e-9 else text / max(1, tags)


def _slow_counts(n, linked=False):
    text = tags = link = links = 0
    for k in n.kids:
        if isinstance(k, str):
            text += len("".join(k.split()))
        else:
            t, g, c, m = _slow_counts(k)
            text, tags, link, links = text + t, tags + g + 1, link + c, links + m + (k.tag == "a")
    return text, tags, text if n.tag == "a" else link, links


def test_densities_and_cores_equal_a_slow_version():
    rng = random.Random(12)

    def grow(depth):
        inner = "".join(grow(depth + 1) if depth < 5 and rng.random() < 0.7 else "words " * rng.randint(0, 9) for _ in range(rng.randint(0, 4)))
        tag = rng.choice(["div", "p", "a", "span", "section", "ul", "li", "b"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(150):
        root = htmltext.parse(f"<body>{grow(0)}{grow(0)}{grow(0)}</body>")
        htmltext.measure(root)
        order = list(htmltext._below(root))
        htmltext._tops(order)
        text, _, link, _ = _slow_counts(root)
        for n in order:
            want = slow_density(n, link / max(1, text))
            assert abs(n.density - want) < 1e-9 * max(1.0, want)
            below = [x for x in htmltext._below(n) if x.tag in htmltext.CONTAINERS and x.chars]
            assert n.top is (max(below, key=lambda x: x.total) if below else None) or (n.top.total == max(x.total for x in below))


def test_page_columns_and_length(spark):
    long = "<article>" + "".join(f"<p>word{i} &amp; more</p>" for i in range(20000)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    df = spark.createDataFrame([(1, "u", long, "x"), (2, None, deep, "x"), (None, "v", None, "x"), (None, "v", None, "x")], "page_id long, url string, html string, text string")
    got = htmltext.extract_pages(df).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text.count(" & more") == 20000 and by[1].n_chars == len(by[1].text) and by[2].text == "deep" and len(got) == 4
    assert htmltext.extract_pages(df.limit(0)).count() == 0


# ---- mixing ---------------------------------------------------------------------------


def fill(budget, kids):
    """Shares by repeated redistribution: [(weight, room)] to amounts."""
    got, open_ = [0.0] * len(kids), [k for k, (w, _) in enumerate(kids) if w > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(kids[k][0] for k in open_)
        full = [k for k in open_ if got[k] + left * kids[k][0] / total >= kids[k][1]]
        if not full:
            for k in open_:
                got[k] += left * kids[k][0] / total
            break
        for k in full:
            left -= kids[k][1] - got[k]
            got[k] = kids[k][1]
        open_ = [k for k in open_ if k not in full]
    return got


def test_water_level_is_the_repeated_redistribution(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for p in range(40):
        kids = [(rng.choice([0.0, 1.0, 2.0, 5.0]), float(rng.choice([0, 3, 10, 50, 400]))) for _ in range(rng.randint(1, 6))]
        budget = float(rng.choice([0, 7, 60, 200, 5000]))
        rows += [(p, k, budget, w, r) for k, (w, r) in enumerate(kids)]
        want.update({(p, k): v for k, v in enumerate(fill(budget, kids))})
    df = spark.createDataFrame(rows, "p int, k int, b double, w double, r double")
    got = {(r.p, r.k): r.s for r in mixing.water_level(df, ["p"], "b", "w", "r", "s").collect()}
    assert all(abs(got[x] - want[x]) < 0.01 for x in want)


def mixed_by_hand(rows, fraction, weights, epochs):
    """Copies by id, for (id, domain, language, source, tokens) rows with ids of their own."""
    share = {(): float(int(sum(r[4] for r in rows) * fraction))}
    for depth, level in enumerate(("domain", "language", "source")):
        room = defaultdict(int)
        for r in rows:
            room[r[1 : depth + 2]] += r[4]
        for path in [p for p in share if len(p) == depth]:
            kids = sorted((p for p in room if p[:-1] == path), key=str)
            amounts = fill(share[path], [(weights.get(level, {}).get(p[-1], 1.0), epochs * float(room[p])) for p in kids])
            share.update({p: round(x, 4) for p, x in zip(kids, amounts, strict=True)})
    out = {}
    for leaf in {r[1:4] for r in rows}:
        own = [r for r in rows if r[1:4] == leaf]
        tokens, budget = sum(r[4] for r in own), int(share[leaf])
        whole = budget // tokens if tokens else 0
        used, order = 0, lambda r, w=whole: hashlib.md5(f"0:{w}:{r[0]}".encode()).hexdigest()
        for r in sorted(own, key=order):
            used += r[4]
            out[r[0]] = whole + (used <= budget - whole * tokens)
    return out


def test_mixing_equals_the_tree_filled_by_hand(spark):
    rng = random.Random(8)
    domains = {"s1": "a", "s2": "b", "s3": "b", None: "b"}
    rows = []
    for i in range(500):
        source = rng.choice(["s1", "s1", "s2", "s3", None])
        rows.append((i, domains[source], rng.choice(["en", "de", None]), source, rng.choice([0, 1, 7, 60, 900])))
    weights = {"domain": {"a": 3.0, "b": 1.0}, "language": {"de": 0.0}}
    df = spark.createDataFrame([(i, s, d, l, n, "x") for i, d, l, s, n in rows], "doc_id long, source string, d string, lang string, n int, copies string").repartition(3)
    for fraction, epochs in ((0.5, 2), (0.1, 1), (5.0, 3)):
        got = mixing.mix_rows(df, F.col("d"), F.col("lang"), F.col("source"), F.col("n"), fraction=fraction, weights=weights, max_epochs=epochs).collect()
        assert {r.doc_id: r.copies for r in got} == mixed_by_hand(rows, fraction, weights, epochs)


def test_mixing_edge_rows(spark):
    rows = [(i, "en", "s1", "w w") for i in range(9)] + [(None, "en", "s1", None), (7, "en", "s1", "w w")] * 2
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    args = (F.lit("a"), F.col("lang"), F.col("source"), mixing.word_count(F.col("text")))
    got = mixing.mix_rows(df, *args).collect()
    assert len(got) == 13 and len({r.copies for r in got if r.doc_id == 7}) == 1
    assert 11 - 2 * 3 <= sum(r.copies * r.n_tokens for r in got) <= 11
    assert mixing.mix_rows(df.limit(0), *args).count() == 0
    wide = df.withColumn("domain", F.lit(5)).withColumn("a.b", F.lit(6))
    out = mixing.mix(wide, *args)
    assert out.columns == ["doc_id", "lang", "text", "a.b", "domain", "language", "source", "n_tokens", "copies"]
    assert {(r.domain, r.source, r["a.b"]) for r in out.collect()} == {("a", "s1", 6)}
