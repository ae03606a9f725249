"""Methods against plain versions: text density, boosted trees, hot anchors, large groups, documents per line; and columns with clashing names."""

import collections
import math
import random
import re

import pytest

from relaycore.llm import decontamination, html_text, line_quality, ngram_join, suffix_dedup, tables, toxicity, url_filter

rng = random.Random(9)
VOCAB = [f"w{k}" for k in range(50)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


CLASHES = ["n_words", "hits", "items", "uid", "cuts", "v_host", "v_key", "toxicity", "gone_id", "twice_id", "rank", "length", "suffix", "segment", "own", "__x", "doc", "key", "body", "node"]


def with_clashes(df):
    for name in CLASHES:
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(130)
    rows = [(1, base, "a"), (2, base, "a"), (None, base, None), (3, None, "a"), (4, "", "b"), (5, prose(200), "b"), (5, prose(200), "b"), (6, prose(20_000), "b"), (6, None, "b")]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_cleaners_keep_columns_with_any_name(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(12)), (2, None)], "item_id long, text string")
    cleaners = {
        "toxicity": lambda d: toxicity.clean(d, labels),
        "lines": line_quality.clean,
        "join": ngram_join.clean,
        "suffix": suffix_dedup.clean,
        "items": lambda d: decontamination.clean(d, items),
    }
    for name, clean in cleaners.items():
        out = clean(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.uid == (None if r.doc_id is None else str(r.doc_id)) for r in rows), name
        assert clean(docs.filter("false")).count() == 0, name
        if name == "lines":
            assert sum(r.doc_id is None for r in rows) == 1
        if name == "join":
            assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "6", "None"]


def test_url_filter_keeps_columns_with_any_name(spark):
    pages = with_clashes(spark.createDataFrame([(k, f"http://a.com/en/{k}") for k in range(30)] + [(99, "http://b.net/de/1")], "doc_id long, url string"))
    out = url_filter.classify(pages)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"] and out.count() == 31


def test_lines_count_documents_and_not_texts(spark):
    line = "the same line in every document of one host " * 6
    same = [(i, line + "\n" + prose(60), "h") for i in range(1)] * 1
    rows = [(i, same[0][1], "h") for i in range(200)] + [(900, prose(90), "h"), (901, prose(90), None)]
    got = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_limit=3, line_share=0.1).collect()}
    assert all(got[i].n_removed == 114 and not got[i].kept for i in range(200)) and got[900].kept and got[901].kept


def test_very_frequent_anchors_are_split_without_a_change(spark):
    hot = "the very common passage that everybody writes, again and again, and which goes on for"
    few = [prose(8) for _ in range(4)]
    rows = [(i, rng.choice(few) + hot + rng.choice(few) + str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, split = ({r.doc_id: tuple(r) for r in suffix_dedup.report(df, split_from=at).collect()} for at in (40, 0))
    assert whole == split and sum(r[2] for r in whole.values()) > 0


def _tree(depth):
    """A random page and its nodes as (tag, children), text leaves as strings."""
    if depth == 0 or rng.random() < 0.2:
        return " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))
    return rng.choice(["div", "div", "section", "ul", "a"]), [_tree(depth - 1) for _ in range(rng.randint(1, 4))]


def _written(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(_written, node[1]))}</{node[0]}>"


def _numbers(node, linked=False):
    """characters, tags, link characters, link tags below a node."""
    if isinstance(node, str):
        n = len(node.replace(" ", ""))
        return n, 0, n if linked else 0, 0
    below = [_numbers(c, linked or node[0] == "a") for c in node[1]]
    inner = [c for c in node[1] if not isinstance(c, str)]
    return sum(b[0] for b in below), sum(b[1] for b in below) + len(inner), sum(b[2] for b in below), sum(b[3] for b in below) + sum(c[0] == "a" for c in inner)


def _dense(numbers, share):
    chars, tags, link_chars, link_tags = numbers
    if not chars:
        return 0.0
    ratio = max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / max(1, tags) * math.log(ratio) / max(1.0, math.log(base) if base > 1 else 1.0)


def test_densities_follow_their_definition():
    for _ in range(60):
        body = ("body", [_tree(4) for _ in range(3)])
        root = html_text.parse(_written(body))
        found = html_text.measure(root)
        share = _numbers(body)[2] / max(1, _numbers(body)[0])

        def check(node, made):
            if isinstance(node, str) or node[0] == "a":
                return
            assert made.density == pytest.approx(_dense(_numbers(node), share)) and made.best.total >= made.total
            inner = [p for p in made.parts if type(p) is html_text._Node]
            for child, part in zip([c for c in node[1] if not isinstance(c, str)], inner):
                check(child, part)

        if not re.search("<a>(?:(?!</a>).)*<a>", _written(body)):
            check(body, found)


def test_blocks_below_the_threshold_go():
    words = "Plain words of an article that goes on for a good while, as articles do. " * 4
    links = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(30))
    page = f"<body><div><div><p>{words}</p><p>{words}</p><p>{words}</p></div><ul>{links}</ul></div><div><p>{words}</p><p>{words}</p></div></body>"
    assert html_text.main_text(page) == "\n\n".join([words.strip()] * 5)


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>" * 20_000 + "</p>" * 20_000, "<u><div>" + "<b>" * 20_000 + "</u>" * 20_000, "<div>" * 20_000 + "<td></td>" * 10_000, "<script>" + "</script " * 50_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10


def test_boosted_trees_equal_plain_boosting(spark):
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 3)), int(rng.random() < 0.5)) for _ in range(300)]
    rows = [(a, b, int(a > 4) if rng.random() < 0.9 else y) for a, b, y in rows]
    frame = spark.createDataFrame([(a, b, *[0.0] * 7, y) for a, b, y in rows], ", ".join(f"{n} double" for n in url_filter.FEATURES) + ", y int")
    model = url_filter.fit(frame, rounds=2, depth=2)
    edges = [model.edges[n] for n in url_filter.FEATURES[:2]]
    points = [([sum(v > e for e in es) for v, es in zip(r[:2], edges)], r[2]) for r in rows]
    n, bad = len(rows), sum(r[2] for r in rows)
    margins = [math.log((bad + 0.5) / (n - bad + 0.5))] * n

    def best(members, g, h):
        found = None
        total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
        for f in range(2):
            for edge in sorted({points[i][0][f] for i in members})[:-1]:
                left = [i for i in members if points[i][0][f] <= edge]
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                if min(lh, total_h - lh) < 1:
                    continue
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                if found is None or gain > found[0] + 1e-9:
                    found = gain, f, edge, lg / (lh + 1) / 2, (total_g - lg) / (total_h - lh + 1) / 2
        return found if found and found[0] > 1 else None

    def grow(members, depth, value, g, h, out):
        split = best(members, g, h) if depth else None
        if split is None:
            out.update(dict.fromkeys(members, value))
            return value
        _, f, edge, a, b = split
        sides = [i for i in members if points[i][0][f] <= edge], [i for i in members if points[i][0][f] > edge]
        return url_filter.FEATURES[f], edge, grow(sides[0], depth - 1, a, g, h, out), grow(sides[1], depth - 1, b, g, h, out)

    def flat(tree):
        return [tree] if not isinstance(tree, tuple) else [tree[0], tree[1], *flat(tree[2]), *flat(tree[3])]

    for tree in model.trees:
        p = [1 / (1 + math.exp(-m)) for m in margins]
        leaf = {}
        plain = grow(list(range(n)), 2, 0.0, [y - q for (_, y), q in zip(points, p)], [q * (1 - q) for q in p], leaf)
        assert [x if isinstance(x, str) else pytest.approx(x) for x in flat(plain)] == flat(tree)
        margins = [m + leaf[i] for i, m in enumerate(margins)]
    assert model.trees


def test_kneser_ney_equals_its_definition():
    texts = [[rng.choice("abcdef") for _ in range(30)] for _ in range(40)]
    toxic = [k % 2 for k in range(40)]
    import numpy as np

    code = {w: np.uint64(7 + ord(w)) for w in "abcdef"}
    model = toxicity.KneserNeyPair([np.array([code[w] for w in t], np.uint64) for t in texts], toxic, least=1, share=0)
    before = [collections.defaultdict(set), collections.defaultdict(set)]
    for t, c in zip(texts, toxic):
        for a, b in zip(["^", *t], t):
            before[c][b].add(a)
    both = {w: len(before[0][w] | before[1][w]) for w in code}
    shared = {w: (n + 0.5) / (sum(both.values()) + 0.5 * len(both) + 0.5) for w, n in both.items()}
    for w, at in ((w, list(model.keys).index(code[w])) for w in code):
        p = []
        for c in (0, 1):
            total = sum(len(s) for s in before[c].values())
            seen = {x: max(len(before[c][x]) - 0.75, 0) / total for x in code}
            p.append(seen[w] + (1 - sum(seen.values())) * shared[w])
        assert model.word[at] == pytest.approx(math.log(p[1] / p[0]))


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        tables.shared_folder(Session)
