"""Packing, decontamination, revisits, near duplicates, pages and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from kgspark.llm import decontaminate, html_text, jaccard, packing, revisit

DOCS = "doc_id long, text string"
EDGE = [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 30_000), (904, "same"), (904, "same")]


def test_encoding_matches_the_tokenizer():
    tok = packing._tokenizer(packing.TOKENIZER)[0]
    rng = random.Random(1)
    alphabet = "..,,_aÀB ΣσςÉİ​ 　\x85\x1c's\t\n12!?…中国文̀"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "<|endoftext|>", " a<|startoftext|>b", "<|start"])
        assert packing.encode(s) == tok.encode(s, add_special_tokens=False).ids, s


def test_packing(spark):
    rows = [*EDGE, *[(i, "lorem ipsum dolor " * (i * 7 % 400)) for i in range(300)]]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), emit_ids=True).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    s = got.sort_values(["sequence_id", "offset"])
    assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all()
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got["ids"], got["ids_crc32"]))
    hist = got["length"].value_counts().to_dict()
    assert got["sequence_id"].nunique() <= packing.lower_bound(hist, 2048) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_bin_completion_beats_or_meets_best_fit():
    rng = random.Random(3)
    for k in range(8):
        hist = collections.Counter(rng.randint(300, 900) if k % 2 else rng.randint(1, 2047) for _ in range(rng.choice([20, 200, 2000])))
        best = packing.bin_completion(dict(hist), 2048)
        used = collections.Counter()
        for pattern, n in best:
            assert sum(s * c for s, c in pattern) <= 2048
            for s, c in pattern:
                used[s] += c * n
        assert used == hist
        assert packing.lower_bound(dict(hist), 2048) <= sum(n for _, n in best) <= sum(n for _, n in packing.best_fit_decreasing(dict(hist), 2048))


def test_wand_against_scores_of_all_items(spark):
    """Every pair above the threshold is found, whatever the shards; scores are BM25's over the whole benchmark."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90])))) for i in range(120)]
    texts = [" ".join([*(rng.choice(vocabulary) for _ in range(80)), *(x for x in items[k][1].split() if rng.random() > 0.1), *(rng.choice(vocabulary) for _ in range(60))]) for k in range(0, 120, 4)]
    df = collections.Counter(x for _, t in items for x in set(t.split()))
    mean = sum(len(t.split()) for _, t in items) / len(items)

    def weights(t):
        tf = collections.Counter(t.split())
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * sum(tf.values()) / mean)
        return {x: np.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * f * (decontaminate.K1 + 1) / (f + norm) for x, f in tf.items()}

    for ix in decontaminate.build(items, df, len(items), mean):
        for t in texts:
            w = t.split()
            ids = ix.local[np.array([ix.terms.get(x, -1) for x in w])]
            got = {(ix.items[i], p): s / ix.scale[i] for i, p, s in decontaminate.wand(ids, ix)}
            exp = {}
            for n, i in enumerate(ix.items):
                own = weights(items[i][1])
                for p, at in enumerate(decontaminate.passages(len(w), ix.span)):
                    score = sum(s for x, s in own.items() if x in set(w[at : at + ix.span])) / sum(own.values())
                    if score * ix.scale[n] >= decontaminate.RETRIEVE:
                        exp[i, p] = score
            assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(tuple, decontaminate.leaks(docs, bench, chars_of_shard=c).collect())) for c in (4_000_000, 20_000)]
    assert rows[0] and rows[0] == rows[1]


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, kg_leaks int, `odd name` string")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, "q w e r t y u i o p")], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_links_of_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, lone = " ".join(base), " ".join([*base[:59], "x"]), " ".join(f"z{i}" for i in range(30))
    rows = [(None, near), (7, near), (5, near), (9, other), (None, lone), (None, lone), (None, "third " + lone), (None, ""), (None, None), (12, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.link(docs, k=3, percent=80).collect())
    assert got == collections.Counter([(None, 5), (7, 5), (5, 5), (9, 5), *[(None, None)] * 5, (12, 12)])
    # a text held under null ids only joins the others' groups
    bridge = spark.createDataFrame([(3, " ".join(base[:50])), (None, " ".join(base[:45])), (4, " ".join(base[:40]))], DOCS)
    assert {(r.doc_id, r.component_id) for r in jaccard.link(bridge, k=3, percent=87).collect()} == {(3, 3), (None, 3), (4, 3)}
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs, k=3, percent=80).collect()]
    assert sorted(x for x in kept if x[0]) == [(5, near), (12, "")]
    bare = [t for i, t in kept if i is None]
    assert len(bare) == 3 and "" in bare and None in bare and any(t and lone in t for t in bare)


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(12)) + ".") for i in range(40)] + [(98, None), (99, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, filler(rng.randint(0, 400)) + " " + (items[i % 40][1].upper().replace(" ", "\n") if i % 3 == 0 else "") + " " + filler(80)) for i in range(90)] + EDGE
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i % 40) for i in range(90) if i % 3 == 0}
    kept = decontaminate.keep_clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == 60 + len(EDGE)
    assert decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_items_in_other_scripts(spark):
    items = [(1, "Сколько спутников обращается вокруг планеты Марс сегодня? Вокруг Марса обращаются два спутника."), (2, "法国的首都，是，哪一座，城市，呢？答案，是，巴黎，这座，城市。"), (3, "² ½ ³ ¼ ¹ ¾. ² ² ³ ³ ½ ½."), (4, "…")]
    docs = [(i, f"Some words before. {t} Some words after.") for i, t in items] + [(9, "Some words before. Some words after.")]
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 3)}


def test_revisits_against_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        url = rng.choice(["http://a.com/x", "https://www.A.com/x/?utm_source=f", "http://b.com/", "http://b.com#t", None])
        kind = rng.choice(["response", "revisit", "request"])
        rows.append((i, url, rng.randint(0, 300) if rng.random() < 0.95 else None, kind, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([{"ETag": rng.choice('ab')}, {"Last-Modified": "d", "X": "1"}, None]), rng.choice(["p", "q", None])))
    got = {r.record_id: (r.source_id, r.check) for r in revisit.resolve(spark.createDataFrame(rows, revisit.RECORD)).collect()}
    key = lambda u: {"http://a.com/x": "a.com/x", "https://www.A.com/x/?utm_source=f": "a.com/x"}.get(u, "" if u is None else "b.com")
    order = sorted(rows, key=lambda r: (r[2] if r[2] is not None else -(2**63), r[0], r[3]))
    last, exp = {}, {}
    for r in order:
        k = key(r[1])
        if r[3] == "revisit":
            s = last.get(k)
            a, b = {x.lower(): y for x, y in ((s or r)[5] or {}).items()}, {x.lower(): y for x, y in (r[5] or {}).items()}
            if s is None:
                exp[r[0]] = (None, "no-source")
            elif "etag" in a and "etag" in b:
                exp[r[0]] = (s[0], "etag" if a["etag"] == b["etag"] else "mismatch")
            elif "last-modified" in a and "last-modified" in b:
                exp[r[0]] = (s[0], "last-modified")
            elif s[6] and r[6]:
                exp[r[0]] = (s[0], "digest" if s[6] == r[6] else "mismatch")
            else:
                exp[r[0]] = (s[0], "unchecked")
        elif r[3] == "response" and r[4] == 200:
            last[k] = r
    assert got == exp


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for (i, _), s in zip(rows, sets)}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") * rng.randint(0, 2) for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        if rng.random() < 0.2:
            w = w[: rng.randint(0, 8)]
        rows.append((i, " ".join(w) if rng.random() < 0.7 else "\n".join(w).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (5, rows[9][1])]
    got = {tuple(r) for r in jaccard.link(spark.createDataFrame(rows, DOCS), 3, 90).collect()}
    assert got == brute_groups(rows, 3, 90)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bounds = jaccard.levels(percent)
        for _ in range(400):
            n = int(rng.integers(1, 120))
            x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            stay = x[rng.random(len(x)) > rng.random() * 0.25]
            y = np.unique(np.r_[stay, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if not both or 100 * both < percent * (len(x) + len(y) - both):
                continue
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            cut = [jaccard.parts_of(s, percent, jaccard.prefix(s, percent, none), bounds) for s in (x, y)]
            assert np.isin(*cut).any()
            level = max(jaccard.level_of(len(s), bounds) for s in (x, y))
            assert np.isin(*[jaccard.parts_in(level, s, percent, jaccard.prefix(s, percent, none), bounds) for s in (x, y)]).any()
            assert jaccard.difference(*[jaccard.parity(s).tobytes() for s in (x, y)]) <= len(x) + len(y) - 2 * both


def test_jaccard_join_of_long_lists_against_brute_force(spark):
    """A line that all texts hold, one group of near copies and pairs outside it: lists are long, and their members lie in many components."""
    rng = random.Random(9)
    line = [f"l{i}" for i in range(12)]
    word = lambda: f"w{rng.randrange(3000)}"
    large = [word() for _ in range(30)]
    rows = []
    for i in range(90):
        w = line + (large if i < 40 else [word() for _ in range(rng.randint(1, 30))])
        for _ in range(rng.randint(0, 3)):
            w = [*w[: (at := rng.randrange(len(w)))], word(), *w[at + 1 :]]
        rows.append((i, " ".join(w)))
        if i >= 40 and rng.random() < 0.5:
            rows.append((i + 500, " ".join([*w[:-1], word()])))
    for percent in (80, 90):
        assert {tuple(r) for r in jaccard.link(spark.createDataFrame(rows, DOCS), 3, percent, small=2).collect()} == brute_groups(rows, 3, percent)


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (3, "other words stand in this text", "z"), (4, None, "n")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((r.doc_id, r.component_id) for r in kept.collect()) == [(1, "x"), (3, "z"), (4, "n")]


def test_repeated_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        streams = [[rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        for s, cover in zip(streams, html_text.repeated(streams, 3, 2)):
            exp = [False] * len(s)
            for a in range(len(s) - 2):
                if sum(any(x[b : b + 3] == s[a : a + 3] for b in range(len(x) - 2)) for x in streams) >= 2:
                    exp[a : a + 3] = [True] * 3
            assert cover.tolist() == exp


def test_pages(spark):
    page = '<body><header>Top</header><div class="cookie-notice">We use</div><article><h1>T &amp; U</h1><p>One <b>two</b><br><p>three<section id="comments"><p>nice!</p></section></article><aside>x</aside><script>if(a<b){}</script></body>'
    rows = [(i, f"http://h.com/{i}", f"<div><p>Welcome to our great site please read the following terms now</p></div><p>unique body {i} of words {i * 7}</p>") for i in range(9)]
    rows += [(20, "http://h.com/a", page), (21, None, None), (21, "u", ""), (22, "v", "<div>" * 30_000 + "deep")]
    for shard in (200, 4):
        got = sorted((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard).collect())
        assert got == [*[(i, f"unique body {i} of words {i * 7}") for i in range(9)], (20, "T & U\nOne two\nthree"), (21, ""), (21, ""), (22, "deep")]


def test_page_layouts_keep_their_text(spark):
    body = "The body of this page has some words that stand nowhere else"
    cases = {
        f'<div class="layout has-sidebar"><article><p>{body}</p></article></div>': body,
        f'<article><div class="overflow-hidden"><p>{body}</p></div></article>': body,
        f'<div class="page-header-fixed content"><p>{body}</p></div>': body,
        f'<article><div class="entry-content share"><p>{body}</p></div></article>': body,
        f"<article><p>Teaser</p></article><div><p>{body}</p></div>": f"Teaser\n{body}",
        f'<div class="sidebar"><p>{body}</p></div>': body,
        f'<article><p>{body}</p><div class="comment-list"><p>nice</p></div></article><div class="site-footer">(c)</div>': body,
        "<nav>Home</nav>": "",
    }
    rows = [(i, f"http://h{i}.com/", h) for i, h in enumerate(cases)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_pages_do_not_depend_on_their_layout(spark):
    """Runs go on pages of any number of partitions and shards; copies of one page count once; unique words beside a run stay."""
    run = "please accept all of our terms before you read on"
    rng = random.Random(2)
    words = lambda i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    rows = [(i, "http://a.org/", f"<body><p>{words(i)} {run if i % 10 == 0 else ''} {words(i)}</p></body>") for i in range(120)]
    rows += [(200 + i, "http://a.org/", f"<body><p>{'copied page with words of its own ' + 'z' * 5}</p></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted((r.page_id, r.text) for r in html_text.extract(df.repartition(n), shard_pages=m).collect()) for n, m in ((1, 1000), (7, 1000), (3, 16))]
    assert got[0] == got[1] == got[2]
    texts = dict(got[0])
    assert not any(run in t for t in texts.values()) and all(len(texts[i].split()) == 24 for i in range(120))
    assert all(texts[200 + i].startswith("copied page") for i in range(6))


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = docs.select("doc_id").count()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, d)
    ids = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= first and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    got = sorted(r.doc_id for r in stage(spark, docs, d).select("doc_id").collect())
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted({root for _, _, root in brute_groups(rows, 5, 80)})


def test_repeats_count_over_the_whole_host(spark):
    notice = "please accept all of our many cookies before you go on reading"
    page = lambda i: f"<body><p>{notice if i % 40 == 0 else ''}</p><p>" + " ".join(f"u{i}x{j}" for j in range(30)) + "</p></body>"
    df = spark.createDataFrame([(i, "http://a.org/", page(i)) for i in range(400)], "page_id long, url string, html string")
    got = {n: {r.page_id: r.text for r in html_text.extract(df, shard_pages=n).collect()} for n in (1000, 20)}
    assert got[1000] == got[20] and len(got[20]) == 400
    assert not any(notice in t for t in got[20].values()) and all(f"u{i}x29" in got[20][i] for i in range(400))
    rng = random.Random(4)
    for _ in range(200):
        streams = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(6)]
        held = collections.Counter(h for s in streams for h in set(html_text.run_hashes(s).tolist()))
        hot = np.array([h for h, c in held.items() if c >= html_text.MIN_PAGES], np.uint64)
        assert all((a == html_text.covered(s, hot)).all() for s, a in zip(streams, html_text.repeated(streams)))


def test_counts_of_shingles_are_bounded_and_change_no_link(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    monkeypatch.setattr(jaccard, "COUNTED", 2000)
    monkeypatch.setattr(jaccard, "GOES_ON", 500)
    got = {r.doc_id: r.component_id for r in jaccard.link(docs).collect()}
    assert got == {i: root for i, _, root in brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80)}


def test_text_beside_an_article_is_decided_by_repeats(spark):
    notice = "please accept all of our many cookies before you go on reading"
    intro = lambda i: " ".join(f"i{i}x{j}" for j in range(9))
    page = lambda i: f"<body><p>{notice}</p><p>{intro(i)}</p><article><p>{' '.join(f'w{i}x{j}' for j in range(60))}</p><p>{notice}</p></article></body>"
    df = spark.createDataFrame([(i, "http://a.org/", page(i)) for i in range(12)], "page_id long, url string, html string")
    for shard in (200, 4):
        got = {r.page_id: r.text.split("\n") for r in html_text.extract(df, shard).collect()}
        assert got == {i: [intro(i), " ".join(f"w{i}x{j}" for j in range(60)), notice] for i in range(12)}


def test_repeats_count_in_articles_and_boilerplate_of_the_whole_host(spark):
    """Open text goes where other pages have it in their article, or in named boilerplate, also where nothing on these pages is open; differing boilerplate makes no page of its copies."""
    notice, menu = "please accept all of our many cookies before you go on reading", "home news sport weather travel money culture and more"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [f"<p>{notice}</p><p>{menu}</p><p>intro of this page alone</p><article><p>{own(0)}</p></article>"]
    rows += [f"<article><p>{own(i)}</p><p>{notice}</p></article>" for i in range(1, 8)]
    rows += [f"<nav>{menu}</nav><article><p>{own(i)}</p></article><p>outro {i}</p>" for i in range(8, 16)]
    rows += [f"<nav>{i} {i} {i}</nav><p>{own(99)}</p>" for i in range(16, 20)]
    df = spark.createDataFrame([(i, "http://a.org/", f"<body>{r}</body>") for i, r in enumerate(rows)], "page_id long, url string, html string")
    want = {0: f"intro of this page alone\n{own(0)}"} | {i: f"{own(i)}\n{notice}" for i in range(1, 8)} | {i: f"{own(i)}\noutro {i}" for i in range(8, 16)} | {i: own(99) for i in range(16, 20)}
    for shard in (200, 4):
        assert {r.page_id: r.text for r in html_text.extract(df, shard).collect()} == want
