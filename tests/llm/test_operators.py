"""Each operator against a brute-force version on small tables with nulls, empty texts, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from relaycore.llm import decontamination, exchange, html_text, license_scan, line_quality, ngram_join, packing, suffix_dedup, suffix_tree_lm, tables, textbytes, toxicity, url_filter

rng = random.Random(5)
VOCAB = [f"w{k}" for k in range(60)]
PASSAGE = " ".join(rng.choice(VOCAB) for _ in range(40))


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def fixture():
    base = prose(120)
    near = base.split()
    near[60] = "edited"
    texts = [base, base, " ".join(near), prose(80) + "\n" + PASSAGE, PASSAGE + " " + prose(50), "Éa " * 60, None, "", " \n\t", "one two", "ONE TWO", "x" * 300, "%" * 500, prose(3000)]
    return list(enumerate(texts))


ROWS = fixture()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, hits string, rank int, component int, verdict string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "h", 1, 1, "v") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))


def test_decontamination(spark, docs, empty):
    items = [("a", PASSAGE), ("b", "one two"), ("c", None), ("d", ""), ("e", PASSAGE)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1, 100_000):
        got = {r.doc_id: r for r in decontamination.report(docs, bench, block_words=block).collect()}
        for i, t in ROWS:
            words, hit, found = alnum(t), set(), set()
            for name, text in items:
                item = alnum(text)
                n = min(10, len(item))
                for k in range(len(item) - n + 1) if item else []:
                    for at in range(len(words) - n + 1):
                        if words[at : at + n] == item[k : k + n]:
                            hit |= set(range(at, at + n))
                            found.add(name)
            assert tuple(got[i])[1:] == (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert decontamination.report(empty, bench).count() == 0
    kept = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    assert 9 not in kept and PASSAGE not in kept[3] and kept[0] == ROWS[0][1]


def test_ngram_join(docs, empty):
    sets = {}
    for i, t in ROWS:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for block in (1, 2000):
        got = {r.doc_id: tuple(r)[1:] for r in ngram_join.near_duplicates(docs, block_docs=block).collect()}
        assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_with_an_overfull_sketch(spark, monkeypatch):
    # A sketch far too small for its corpus, as the largest is for a large one, and copies in many partitions.
    monkeypatch.setattr(exchange, "FILTER_BITS", 1 << 8)
    carried, links = [], ngram_join.links
    monkeypatch.setattr(ngram_join, "links", lambda candidates, *a: carried.extend(r.node for r in candidates.collect()) or links(candidates, *a))
    own = random.Random(8)
    passages = [" ".join(f"p{own.randrange(9999)}" for _ in range(30)) for _ in range(20)]
    texts = [passages[k % 20] + " " + " ".join(f"v{own.randrange(9999)}" for _ in range(60)) for k in range(100)]
    texts += [texts[0] + " end", *[texts[1] + " of copies"] * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(rows).collect()}
    assert got == {**{k: k for k in range(100)}, 100: 0, **{k: 1 for k in range(101, 131)}}
    assert {0, 1, 100, 101} <= set(carried) and len(carried) < 20


def test_suffix_tree_lm_sends_buffers_in_parts():
    class Captured:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        groupBy = applyInArrow = lambda self, *_: self

    found = suffix_tree_lm._counted(Captured(), lambda: lambda bodies: suffix_tree_lm.tokens(bodies)[0][None], 1, 4, 1)
    text = " ".join(map(str, range(600_000)))
    sent = list(found.run([pa.RecordBatch.from_pydict({"body": [text]})]))
    assert sum(len(k) for b in sent for k in b.column("keys").to_pylist()) == 8 * 600_001
    assert max(b.nbytes for b in sent) < 5 << 20


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.report(docs).collect()}
    seen = set()
    for i, t in ROWS:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert got[i] == (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    assert suffix_dedup.report(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_two_stage_suffix_array(data):
    order = suffix_dedup.two_stage_suffix_array(np.frombuffer(data, np.uint8), 400)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_packing(docs, empty):
    path = tables.vocabulary("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["plain text", "<|endoftext|> in it", "naïve café", "漢字 and more", "a b  c\n\n"])
def test_both_tokenizers_agree(text):
    encode = packing.Encoder(tables.vocabulary("byte_bpe_50k.json"))
    assert list(encode(text)) == encode.slow.encode(text, add_special_tokens=False).ids


def test_line_quality(docs, empty):
    got = {r.doc_id: r for r in line_quality.judge(docs).collect()}
    for i, t in ROWS:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert tuple(got[i])[1:7] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), got[i].n_dup_lines, len(repeated), failed)
        assert got[i].kept == (not failed)
    assert line_quality.judge(empty).count() == 0


def test_frequent_lines_deplete_documents(spark):
    line = "the same line in every document of one host " * 6
    rows = [(i, line + "\n" + f"own{i}", "h") for i in range(8)] + [(9, prose(90), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_quality.judge(df, line_limit=3, line_share=0.1).collect()}
    assert kept == {i: i == 9 for i, _, _ in rows}


def test_toxicity(spark, empty):
    rows = [(i, prose(60) + (" awful nasty vile" if i % 3 == 0 else "") + " " + prose(20)) for i in range(400)]
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(df, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.95
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    nothing = toxicity.report(df, labels.filter("false")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert toxicity.report(empty, labels).count() == 0


def test_suffix_tree_lm(docs, empty):
    got = {r.doc_id: r for r in suffix_tree_lm.report(docs).collect()}
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", low(t)), ""] for i, t in ROWS}
    train = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in words.items():
        base = sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score <= 0
    assert suffix_tree_lm.report(empty).count() == 0


def test_license_scan(spark, empty):
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved, ALL RIGHTS RESERVED", "x\nReleased under the MIT License.\ny", None, "", "the license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[0].base_labels, got[0].labels, got[0].first_word) == ("cc-by", "cc-by,cc-by-nc-4.0", 2)
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 3)
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "mit", 1.0)
    assert all((got[k].labels, got[k].score) == ("", 0.0) for k in (3, 4, 5))
    assert license_scan.scan(empty).count() == 0


def test_url_filter(spark):
    urls = [f"http://spam{k}.com/en/{k}" for k in range(40)] + [f"https://blog{k}.net/de/{k}" for k in range(40)]
    urls += ["http://example.com/en/7x", "http://www.example.net/de/8", "http://xnet/de/", "http://other.com/fr/1", "nothing", None, "HTTP://A.COM?q/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.report(df).collect()}
    assert (got["http://example.com/en/7x"].rule, got["http://example.com/en/7x"].verdict) == ("example.com/en/7", "allow")
    assert (got["http://www.example.net/de/8"].rule, got["http://www.example.net/de/8"].verdict) == ("example.net/de/8", "block")
    assert got["http://xnet/de/"].rule is None
    assert got["http://other.com/fr/1"].verdict == "block"  # the suffix statistics
    assert (got["nothing"].host, got["nothing"].path, got[None].host) == ("", "", "")
    assert (got["HTTP://A.COM?q/en/"].host, got["HTTP://A.COM?q/en/"].path) == ("a.com", "")
    assert url_filter.report(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T&amp;t</h1><p>One  two<br>three<p>Four<aside>no</aside></article><footer>f</footer>", "T&t\n\nOne two three\n\nFour"),
        ("<body><div class='side-bar sidebar'>s</div><div><p>Long enough text of the article.</p><p>More of it.</p></div><section id=comments>c</section><form>f</form></body>", "Long enough text of the article.\n\nMore of it."),
        ("<p>cut off <b", "cut off"),
        ("a < b", "a < b"),
        ("<script>var x = '<p>no</p>'</script>", ""),
    ],
)
def test_html_text(page, text):
    assert html_text.main_text(page) == text


def test_span_hashes_are_position_free():
    arr = np.frombuffer(b"ab cd ab", np.uint8)
    h = textbytes.span_hashes(arr, *textbytes.word_spans(arr, textbytes.SPACE_WORD))
    assert h[0] == h[2] != h[1]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert {0, 5, 13} <= ids and 1 not in ids and 2 not in ids


def test_suffix_tree_keeps_pairs_of_a_fixed_count_in_a_large_corpus(spark):
    """8 million training tokens raise no count: a pair that occurs three times is still learnt."""
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "filler " * 1_000_000) for i in train[:8]] + [(i, "alpha beta") for i in train[8:11]] + [(held[0], "alpha beta"), (held[1], "beta alpha")]
    got = {r.doc_id: r.score for r in suffix_tree_lm.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 5


def test_suffix_tree_learns_contexts_of_any_word(spark):
    """320,000 words of three occurrences each can all be contexts and symbols, wherever their weights are found."""
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    text = " ".join(f"a{k} b{k}" for k in range(160_000))
    rows = [(i, text) for i in train[:3]] + [(held[0], "a7 b7"), (held[1], "b7 a7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree_lm.report(df).collect()}
    assert got[held[0]] > got[held[1]] + 3
    joined = {r.doc_id: r.score for r in suffix_tree_lm.report(df, cache_rows=0).collect()}
    assert joined == pytest.approx(got)


def test_suffix_tree_scores_alike_in_any_number_of_passes(spark):
    """Every row is in one pass, null and repeated ones too."""
    rows = [(i % 30, prose(60) + f" w{i % 4}") for i in range(40)] + [(None, "alpha beta"), (None, None), (3, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once, split = (sorted(suffix_tree_lm.report(df, passes=k).collect(), key=repr) for k in (1, 3))
    assert len(once) == len(rows)
    assert [r[:-2] for r in split] == [r[:-2] for r in once]
    for name in ("base_score", "score"):
        assert [r[name] for r in split] == pytest.approx([r[name] for r in once])


def test_toxicity_trains_on_whole_texts(spark):
    """The toxic words of all training texts stand behind 5,000 ordinary ones."""
    rows = [(i, prose(5000) + (" awful nasty vile" if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels).model
    words = toxicity._word_hashes(b"awful")
    assert words[0] in model.keys and model.differences(words)[0] > 1
