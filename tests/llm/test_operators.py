"""The training-data operators against plain Python on small tables, and on odd input."""

import html as entities
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarn.llm import decontamination, html, links, lm, neardup, packing, paragraphs, quality, queries, sharding, urls, warc
from tarn.llm.common import Words, components

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, ties, a long text, columns whose names clash with outputs."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (None, base), (6, "x " * 30_000), (7, "#$% one"), (8, "é" * 300)]
    return spark.createDataFrame([(a, b, 1, "x", 2.0, 3, "r", 4) for a, b in rows], "doc_id long, text string, piece int, shard string, score double, length int, rule string, class_id long")


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


# ------------------------------------------------------------------ helpers


def test_words_are_found_and_hashed_alike():
    t = ["one two", None, "", "  two\tone\n", "é x", "one"]
    w = Words(t)
    h = w.hashes()
    found = [h[i:j].tolist() for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert [len(x) for x in found] == [2, 0, 0, 2, 2, 1]
    assert found[0] == found[3][::-1] and found[5][0] == found[0][0] and len(set(h.tolist())) == 4


def test_components_equal_plain_search(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(int(x) for x in rng.integers(0, 60, 2)) for _ in range(45)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 packing


def packed_ok(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_bins_without_gaps(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(1 / (20 + 60 * seed), 500), 100).tolist()
    runs, total = packing.plan_packing(dict(Counter(lengths)), 100)
    rows = []
    for n, c in Counter(lengths).items():
        for rank in range(c):
            low, first, per, begin = [x for x in runs[n] if x[0] <= rank][-1]
            rows.append({"sequence_id": first + (rank - low) // per, "offset": begin + (rank - low) % per * n, "length": n})
    assert packed_ok(rows, 100) == total
    # first-fit decreasing over the same lengths
    free = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), None)
        if at is None:
            free.append(100 - n)
        else:
            free[at] -= n
    assert total <= len(free) + 1


def test_large_pieces_are_paired():
    runs, total = packing.plan_packing({60: 3, 40: 3, 50: 3}, 100)
    assert total == 5 and runs[60][0][2] == 1


def test_pieces_hold_the_ids_of_the_tokenizers_library(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack_documents(docs, queries.tokenizer_path(), 256).collect()
    packed_ok(rows, 256)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == texts.keys()
    for k, v in texts.items():
        ids = np.array([*t.encode(v, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, r in enumerate(sorted(by[k], key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"]) == (i, at) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert len(part) == 256 or i == 0
            at += r["length"]
        assert at == len(ids)


def test_encoder_on_odd_white_space():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    cases = ["", " ", "\n", "a", " a", "\na", "a\n", "a\n\nb", "a  b", "a \n b", "a\u00a0b c", "a\tb", "it's we'll\nI'm", "x\x1cy z", "\u3000a b", "<|endoftext|> b", "a\x85b c", "né 12,3 !!\n?? a"]
    got = packing.ByteBpe(queries.tokenizer_path()).encode(cases)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in cases]


def test_sequences_are_the_pieces_in_place(docs):
    few = docs.limit(30)
    rows = packing.pack_documents(few, queries.tokenizer_path(), 256).groupBy("sequence_id").agg({"length": "sum"}).collect()
    got = {r["sequence_id"]: len(r["input_ids"]) for r in packing.sequences(few, queries.tokenizer_path(), 256).collect()}
    assert got == {r[0]: r[1] for r in rows}


def test_packing_odd_input(odd):
    rows = packing.pack_documents(odd, queries.tokenizer_path(), 64).collect()
    packed_ok(rows, 64)
    assert sum(r["doc_id"] == 3 for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) % 2 == 0
    assert packing.pack_documents(odd.limit(0), queries.tokenizer_path()).count() == 0


# ------------------------------------------------------------------ 2 pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>";</script></head><body><header><p>Site</p></header>
<nav><ul><li>Home</li></ul></nav><div class="ad">Buy &amp; buy</div>{}<div id="comments"><p>First!</p></div><form><p>Name</p></form><footer>&copy; me</footer>"""


def test_article_is_extracted():
    body = "<article><h1>A &amp;amp; B</h1><p>One\n <b>two</b>&#8217;s<br>three<p>Four<!-- x --><aside>No</aside><style>p{}</style><p></p></article>"
    lines, regions = html.lines_of(PAGE.format(body))
    assert [x for x, r in zip(lines, regions, strict=True) if r == 2] == ["A &amp; B", "One two\u2019s three", "Four"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        p = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                p[i + 1][j + 1] = p[i][j] + 1 if x == y else max(p[i][j + 1], p[i + 1][j])
        got = html.shared_lines(a, b)
        assert len(got) == p[-1][-1] and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_template_lines_go_where_no_article_is_marked(spark):
    page = "<body><div><p>Welcome to us</p></div><div><p>{}</p><p>{}</p></div><div><p>All rights</p></div></body>"
    rows = [(i, f"http://h.org/a/{i}", page.format(f"own {i}", f"text {i}")) for i in range(6)]
    rows += [(10, "http://other.org/a/1", page.format("own 1", "alone")), (11, None, None), (12, "nothing", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as shared")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[3] == "own 3\ntext 3" and got[0] == "own 0\ntext 0"
    assert got[10] == "Welcome to us\nown 1\nalone\nAll rights" and got[11] == got[12] == ""
    assert html.extract(df.limit(0)).count() == 0 and html.extract(df).count() == 10


def test_html_with_left_out_ends_and_broken_tags():
    import time

    text = lambda page: html.lines_of(page)[0]
    assert text('<article><p class="advert">Buy<p>Real text one<p>Real two</article>') == ["Real text one", "Real two"]
    assert text('<article><ul><li class="share">Share<li>Kept</ul><p>After</article>') == ["Kept", "After"]
    assert text('<article><p class="advert">Buy<div>Kept</div></article>') == ["Kept"]
    assert text("<article><p>Let <math><mi>x</mi></math> be</article>") == ["Let x be"]
    began = time.perf_counter()
    assert text("<article>" + "<a " * 20_000) and text("<article>" + "<div class=x>" * 20_000 + "deep") == ["deep"]
    assert time.perf_counter() - began < 3


def test_pages_equal_a_plain_reading(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\x01", body.replace("<br>", " "))).split("\x01")
        assert r["text"] == "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)
        assert r["n_chars"] == len(r["text"])


# ------------------------------------------------------------------ 3 quality, 4 shards, 5 URLs


def test_quality_odd_input(odd):
    rows = quality.judge(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[3]["_q_n_words"] == by[5]["_q_n_words"] == 0 and by[3]["base_failed"]
    assert by[6]["_q_n_repeat_words"] == 30_000 and by[7]["_q_n_symbols"] == 3 and by[2]["rejected_by"] is None
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_stage_keeps_columns_of_any_name(spark, odd):
    df = odd.selectExpr("*", "1 as rejected_by", "2 as _w", "3 as base_failed", "4 as _q_w", "5 as row")
    out = quality.filter_stage(spark, df, SF)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 2, None}
    assert quality.filter_stage(spark, df.limit(0), SF).count() == 0


def test_cascade_orders_by_rejection_per_cost(docs):
    order = quality.ordered_rules(docs, quality.default_rules())
    gain = [-hit / cost for _, cost, hit in order]
    assert sum(hit > 0 for _, _, hit in order) >= 2
    few = [r["text"] for r in quality.rule_sample(docs, rows=40).collect()]
    assert 10 < len(few) < 90 and few == [r["text"] for r in quality.rule_sample(docs, rows=40).collect()]
    assert gain == sorted(gain) and {n for n, _, _ in order} == set(quality.default_rules())


def test_shards_are_stable_gapless_and_whole(spark, docs, texts):
    rows = queries.op4_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = {r["doc_id"]: r["grown_shard"] for r in rows}
    again = {r["doc_id"]: r["s"] for r in docs.select("doc_id", sharding.shard_of(docs["doc_id"], 41, 4).alias("s")).collect()}
    assert grown == again


def test_sharding_odd_input(spark, odd):
    from pyspark.sql import functions as F

    out = sharding.two_pass_shuffle(odd, "doc_id", F.lit(20), 3, bucket_bytes=40)
    rows = out.select("record.*", F.col("shard").alias("s"), F.col("slot").alias("at")).collect()
    assert len(rows) == 10 and {x for x in rows[0].asDict()} >= {"shard", "piece"}
    for s in {r["s"] for r in rows}:
        assert sorted(r["at"] for r in rows if r["s"] == s) == list(range(sum(r["s"] == s for r in rows)))
    assert sharding.two_pass_shuffle(odd.limit(0), "doc_id", F.lit(20), 3).count() == 0


def test_automaton_equals_fnmatch():
    import fnmatch

    rng = np.random.default_rng(2)
    globs = ["a*b", "*ab*", "?a", "b**", "*", "a?b*a", "", "abababababababababababababababababababababababababababababababababab*"]
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(300)] + ["ab" * 40]
    got = urls.ShiftAnd(globs).match([x.encode() for x in texts])
    for i, x in enumerate(texts):
        assert got[i].tolist() == [fnmatch.fnmatchcase(x, g.replace("**", "*")) for g in globs], x


def test_urls_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "example.org/es/"), (4, "http://A.EXAMPLE.ORG/es/x?y"), (5, "x://notexample.org/es/"), (6, "http://org/a"), (7, "http://com"), (8, "http://h.com/de/" + "z" * 5000), (9, "a://b.net/://org/"), (10, "http://spam.net/#"), (4, "http://A.EXAMPLE.ORG/es/x?y")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'r' as rule", "1 as verdict")
    got = {r["page_id"]: (r["_host"], r["_rule"], r["_verdict"]) for r in urls.judge_urls(df).collect()}
    assert got[1] == got[2] == got[3] == ("", None, "allow")
    assert got[4] == ("a.example.org", "example.org/es/", "block") and got[5][1:] == ("org/", "allow")
    assert got[6][1:] == ("org/", "allow") and got[7][1:] == (None, "allow") and got[8][1:] == ("com/de/", "block")
    assert got[9] == ("b.net", None, "allow") and got[10] == ("spam.net", None, "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 6 paragraphs


def shingles(text):
    w = SPACE.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_similar_lines_equal_brute_force(docs, texts):
    lines = {}
    for k, v in texts.items():
        at = 0
        for x in v.split("\n"):
            if len(SPACE.findall(x)) >= 50:
                lines[k, at] = x
            at += len(SPACE.findall(x))
    first_of = {}
    for k in sorted(texts):
        first_of.setdefault(texts[k], k)
    lines = {k: v for k, v in lines.items() if first_of[texts[k[0]]] == k[0]}  # equal texts are one
    sets = {k: shingles(v) for k, v in lines.items()}
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups: dict = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    want = {(*k, *r, k != r) for r, g in groups.items() if len({tuple(SPACE.findall(lines[k])) for k in g}) > 1 or len(g) > 1 and len({k[0] for k in g}) == 1 for k in g}
    rows = paragraphs.repeated_paragraphs(docs).where("kind = 'line'").collect()
    assert {(r["doc_id"], r["start"], r["first_doc_id"], r["first_start"], r["removed"]) for r in rows} == want and want


def fifties(text):
    w = SPACE.findall(text)
    return {tuple(w[i : i + 50]) for i in range(len(w) - 49)}


def test_passages_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = {k: SPACE.findall(v) for k, v in texts.items()}
    holders: dict = {}
    for k, v in texts.items():
        for run in fifties(v):
            holders.setdefault(run, set()).add(v)
    shared = {run for run, v in holders.items() if len(v) > 1}
    rows = paragraphs.repeated_paragraphs(docs).collect()
    first_of = {}
    for k in sorted(texts):
        first_of.setdefault(texts[k], k)
    # every word of every run that stands in two texts is in a passage, no other word is
    got: dict = {}
    for r in rows:
        if r["kind"] == "passage":
            got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
            a, b = r["start"], r["first_start"]
            assert words[r["doc_id"]][a : a + r["n_words"]] == words[r["first_doc_id"]][b : b + r["n_words"]]
    for k, w in words.items():
        want = {j for i in range(len(w) - 49) if tuple(w[i : i + 50]) in shared for j in range(i, i + 50)} if first_of[texts[k]] == k else set()
        assert got.get(k, set()) == want, k
    assert {r["doc_id"] for r in rows if r["kind"] == "text"} == {k for k, v in texts.items() if len(words[k]) >= 50 and Counter(texts.values())[v] > 1}


def test_windows_lie_in_every_run():
    rng = np.random.default_rng(4)
    for draw in (lambda n: rng.integers(0, 2**63, n), lambda n: rng.integers(0, 3, n), lambda n: np.zeros(n, np.int64)):
        h = draw(900).astype(np.uint64)
        first = np.array([0, 0, 30, 30, 400, 450, 900])
        got = paragraphs.window_places(h, first, 50)
        for a, b in zip(first[:-1], first[1:], strict=True):
            for p in range(a, b - 49):
                inside = got[(got >= p) & (got <= p + 25)]
                # in a streak of one word its windows are all alike, one of them a window's length away at most
                assert len(inside) or len(set(h[p : p + 50].tolist())) == 1
            assert all(x + 25 <= b for x in got[(got >= a) & (got < b)])
    assert len(paragraphs.window_places(np.zeros(900, np.uint64), np.array([0, 900]), 50)) < 45


def test_a_passage_is_found_inside_lines_and_over_them(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(51)]
    around = lambda n: [word() for _ in range(n)]
    one = " ".join([*around(70), *passage, *around(70)])
    two = "\n".join(" ".join(x) for x in (around(9), passage[:20], passage[20:33], [*passage[33:], *around(30)]))
    lone = " ".join(around(200))
    df = spark.createDataFrame([(1, one), (2, two), (3, lone)], "doc_id long, text string")
    rows = [(r["doc_id"], r["kind"], r["start"], r["n_words"], r["removed"]) for r in paragraphs.repeated_paragraphs(df).collect()]
    assert sorted(rows) == [(1, "passage", 70, 51, False), (2, "passage", 9, 51, True)]
    cut = {r["doc_id"]: r["text"] for r in paragraphs.cut_paragraphs(df).collect()}
    assert cut[1] == one and cut[3] == lone
    assert SPACE.findall(cut[2]) == SPACE.findall(two)[:9] + SPACE.findall(two)[60:] and cut[2].count("\n") == 1


def test_paragraphs_odd_input(spark, odd):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"intro\n{long}\nend"), (2, long), (2, long), (3, f"other\n{long} "), (4, None), (5, ""), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "1 as paragraph", "2 as id")
    kept = [(r["doc_id"], r["text"]) for r in paragraphs.cut_paragraphs(df).collect()]
    # the first by doc_id keeps it; a null doc_id comes last; rows equal in doc_id and text fare alike
    assert sorted(kept, key=str) == sorted([(1, f"intro\n{long}\nend"), (3, "other"), (4, None), (5, "")], key=str)
    assert paragraphs.repeated_paragraphs(odd).where("doc_id = 6").count() == 0  # one word said 30,000 times in one text
    assert paragraphs.cut_paragraphs(df.limit(0)).columns == df.columns and paragraphs.repeated_paragraphs(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 as _doc", "2 as _tid", "3 as _gone", "4 as _mine", "5 as kind")
    assert sorted((tuple(r) for r in paragraphs.cut_paragraphs(clash).select("doc_id", "text").collect()), key=str) == sorted(kept, key=str)


def test_bands_are_tuned():
    bands, rows = paragraphs.tuned_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 16


# ------------------------------------------------------------------ 7 archives


def test_archives_round_trip():
    records = [("http://a b/é", "1", b"HTTP/1.1 200 OK\r\n\r\nx\n\ny"), (None, "2", b""), ("http://c/", "3", b"\n" * 5)]
    for version in (1, 2):
        got = list(warc.arc_records(warc.arc_file(records, version)))
        assert [r["content"] for r in got] == [c for _, _, c in records] and got[0]["URL"] == "http://a%20b/é"
    with pytest.raises(ValueError):
        list(warc.arc_records(warc.arc_file(records, 1)[:-3]))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://a 1 2 3 4\n0000"))


def test_warc_odd_input(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "", ""), (5, "http://c/", "line\r\n\r\nWARC/1.0\r\n\r\n" * 3), (6, "u v", "é" * 100_000), (7, "http://a/", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as content")
    got = {r["key"]: r for r in warc.archive_round_trip(df, "page_id", "url", "html").collect()}
    for k, _, body in rows:
        data = (body or "").encode()
        assert got[str(k)]["payload_bytes"] == len(data) and got[str(k)]["payload_digest"] == warc.sha1_of(data)
    assert {k: r["refers_to"] for k, r in got.items()} == {"1": "7", "2": "7", "3": "4", "4": None, "5": None, "6": None, "7": None}
    assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {"1", "2", "3"}
    assert warc.archive_round_trip(df.limit(0), "page_id", "url", "html").count() == 0


# ------------------------------------------------------------------ 8 language model


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def test_counts_and_base_score(spark, texts):
    train = Counter()
    words = {k: [*SPACE.findall(lower(v)), "\0"] for k, v in texts.items()}
    for k, w in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    rows = queries.op8_lm_scoring(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(0)
    n = 4000
    c, total = np.full(n, 30), np.full(n, 50)
    got = lm.seat(c, np.full(n, 0.1), total, np.full(n, 0), 0.5, rng)
    want = []
    for _ in range(n):
        t = 1
        for at in range(1, 30):
            a = (lm.THETA + 0.5 * (50 + t)) * 0.1
            t += rng.random() < a / (a + at - 0.5 * t)
        want.append(t)
    assert got.min() >= 1 and abs(got.mean() - np.mean(want)) < 0.25
    assert lm.seat(np.array([0, 1, 10**6]), np.full(3, 0.01), np.full(3, 100), np.zeros(3), 0.5, rng)[:2].tolist() == [0, 1]


def test_predictions_sum_to_one():
    keys, _ = lm.tokens_of(["a b a c b", "b c c a"])
    distinct, c = np.unique(keys, return_counts=True)
    every = np.unique(np.concatenate([(distinct & ~np.uint64(lm.LEAVES - 1)) | np.uint64(x) for x in range(lm.LEAVES)]))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, distinct)] = c
    r = lm.Range(every, counts, 0)
    for s in range(3):
        r.sweep(lm._globals(r.numbers().tolist()), s)
    g = lm._globals(r.numbers().tolist())
    p = r.probabilities(g)[2]
    known = np.bincount(r.leaf, p, lm.LEAVES)
    assert (known < 1).all() and (known > 0.5).all()


def test_lm_odd_input(odd, spark):
    from pyspark.sql import functions as F

    rows = lm.train_and_score(odd, F.lit(False)).collect()
    assert len(rows) == 10 and all(r["score"] <= 0 for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert lm.train_and_score(odd.limit(0), F.lit(False)).count() == 0
    assert lm.train_and_score(odd, F.lit(True)).where("n_known > 0").count() == 0


# ------------------------------------------------------------------ 9 decontamination


def test_leaks_equal_substring_search(spark, texts):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(k, i) for k, v in texts.items() for i, x in bench.items() if x in v}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_benchmark_decontamination(spark, SF).collect()}
    assert got == want


def test_reparameterised_questions_are_caught(spark, odd):
    item = "A train leaves the old station of Lenford with 45 passengers and after 3 hours meets Anna near the river bridge."
    rows = [
        (1, "So: " + item + " Then more words follow here."),
        (2, item.replace("45", "91").replace("Lenford", "Markham").replace("3 hours", "7 days").replace("Anna", "Bert")),
        (3, "A train leaves the old mill, and 45 passengers wait for quite other things to happen near some river in May."),
        (4, None),
        (5, ""),
        (2, item.replace("45", "91").replace("Lenford", "Markham").replace("3 hours", "7 days").replace("Anna", "Bert")),
    ]
    twice = "Every day Anna meets Bert and then Anna calls Bert while the others keep on waiting for the bus."
    rows += [(6, twice.replace("Anna", "Carl").replace("Bert", "Dora")), (7, "Every day Anna meets Bert and then Carl calls Dora while the others keep on waiting for the bus.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "'h' as hash")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, twice), (6, "red tiny words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontamination.contaminated(df, bench).collect()}
    assert {(a, b) for a, b, _ in got} >= {(1, 1), (2, 1), (6, 5)} and (1, 1, True) in got and (2, 1, False) in got
    assert not {a for a, _, _ in got} & {3, 4, 5}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.contaminated(odd, bench).count() == 0


def test_units_follow_numbers_and_twin_items_have_rows(spark):
    t = decontamination.Template(["sold a box in May for 3 a and 5 in more"])
    assert [bool(x) for x in t.template == decontamination.UNIT] == [i in (7, 10) for i in range(12)]
    text = "every morning the old man walks along the quiet river with his small brown dog and waits"
    bench = spark.createDataFrame([(1, text), (2, text), (3, text + " there")], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame([(9, "so " + text)], "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(9, 1), (9, 2), (9, 3)}


def test_leaks_with_words_put_in_are_caught(spark):
    item = "A train leaves the old station of Lenford with many tired passengers and their heavy bags, and after a long ride through green hills it meets Anna near the wide river bridge where she waits for her brother."
    rows = [
        (1, "So: " + item.replace("through green", "through very green")),
        (2, item.replace("after a long ride", "after a ride")),
        (3, item.replace("it meets Anna", "it meets Mary Jane")),
        (4, "A train leaves the old station of Lenford with many other people, and nothing else of that story is told again in this text."),
    ]
    got = {r["doc_id"]: r["verbatim"] for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got.keys() == {1, 2, 3} and got[1] and got[2]
    torn = [(i, i + 3, [1, 2], [1, 3] if i < 4 else [4, 3], 0) for i in range(9)]
    assert decontamination.chain(torn, 2)[0] == 0 and decontamination.chain(torn[4:], 2) == (5, 5, False)


def test_leaks_of_numbers_and_sentence_opening_names_are_caught(spark):
    numbers = "Total 12 kg 15 cm 19 mm 3 h 44 min 7 days 18 km 5 g 100 l 2 weeks 9 usd 16 eur"
    story = "Tom has 5 red apples in one bag. Tom buys 3 more at the shop. Tom eats 2 of them now. Tom then gives half of all away."
    rows = [(1, "see " + numbers + " there"), (2, numbers.replace("1", "8")), (3, story.replace("Tom", "Anna").replace("5", "9")), (4, story.replace("Tom", "Anna", 2))]
    bench = spark.createDataFrame([(1, numbers), (2, story)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got >= {(1, 1), (3, 2)} and not {(2, 1), (1, 2), (3, 1)} & got


# ------------------------------------------------------------------ 10 near-duplicates


def test_band_alignment_equals_edit_distance():
    rng = np.random.default_rng(4)
    for _ in range(800):
        a = rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint32)
        b = a[rng.random(len(a)) < 0.8] if rng.random() < 0.5 else rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint32)
        d = edit_distance(a.tolist(), b.tolist())
        for most in range(14):
            assert neardup.within(a, b, most) == (d <= most)


def test_similarity_equals_edit_distance():
    rng = np.random.default_rng(9)
    for _ in range(400):
        a = rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(0, len(b) + 1)
            b = [np.delete(b, min(at, len(b) - 1)) if len(b) > 1 else b, np.insert(b, at, 7), np.concatenate((b[:at], [99], b[at + 1 :]))][rng.integers(3)].astype(np.uint32)
        n = max(len(a), len(b))
        far = edit_distance(a.tolist(), np.asarray(b).tolist())
        assert neardup.similar(a.tobytes(), b.tobytes()) == (far <= int(0.2 * n + 1e-9))
        assert [neardup._columns(a.tolist(), np.asarray(b).tolist(), m) for m in (far - 1, far, far + 1)] == [False, True, True]


def test_near_duplicates_against_brute_force(spark, docs, texts):
    words = {k: SPACE.findall(v) for k, v in texts.items()}
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert rows.keys() == texts.keys()
    for a in texts:
        for b in texts:
            if a < b and min(len(words[a]), len(words[b])) >= 5:
                x, y = shingles(texts[a]), shingles(texts[b])
                if len(x & y) >= 0.75 * len(x | y):
                    assert rows[a]["class_id"] == rows[b]["class_id"], (a, b)
    for a, r in rows.items():
        assert r["class_id"] <= a and r["n_class"] == sum(x["class_id"] == r["class_id"] for x in rows.values())


def test_near_duplicates_odd_input(spark, odd):
    got = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x[0] in (1, 2)) == [(1, 1), (1, 1), (2, 1)] and (None, 1) in got
    assert (3, 3) in got and (4, 3) in got and (5, 5) in got and len(got) == 10
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    kept = neardup.dedup_stage(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8]


def partition(classes, nodes):
    """Classes (node, root) as sets of nodes, lone ones too."""
    out: dict = {}
    for r in classes.collect():
        out.setdefault(r["root"], set()).add(r["node"])
    alone = set(nodes) - set().union(*out.values(), set())
    return sorted([sorted(x) for x in out.values()] + [[x] for x in alone])


def classes_of(spark, keys, sets, similar=None):
    keys = spark.createDataFrame(keys, "id long, band int, key long")
    items = spark.createDataFrame([(i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in sets.items()], "id long, blob binary")
    alike = similar or (lambda x, y: paragraphs.jaccard(x, y) >= 0.8)
    found = links.bucket_classes(links.shared_buckets(keys), items, alike, lambda x: np.frombuffer(x, np.uint64), lambda c, a, b: c >= 0.8 * (a + b - c) - 1e-3)
    return partition(found, sets)


def test_leaders_find_links_in_crowded_buckets(spark):
    sets = {i: range(100 * (i % 7), 100 * (i % 7) + 9) for i in range(140)}
    assert classes_of(spark, [(i, 0, 5) for i in sets], sets) == sorted(list(range(g, 140, 7)) for g in range(7))


def test_items_that_no_leader_matches_meet_each_other(spark):
    """Pairs of similar items in one crowded bucket, of which no leader knows."""
    sets = {i: [1, 2, *range(100 + 30 * (i // 2), 120 + 30 * (i // 2)), 9000 + i] for i in range(120)}
    assert classes_of(spark, [(i, 0, 5) for i in sets], sets) == [[i, i + 1] for i in range(0, 120, 2)]
    # the most central item, 1, is like neither of two that are alike and share all its buckets
    sets = {1: range(20), 2: range(100, 120), 3: range(100, 120)}
    keys = [(i, b, 7) for i in sets for b in range(16)] + [(1, 20, 1), (4, 20, 1)]
    assert classes_of(spark, keys, sets | {4: range(300, 320)}) == [[1], [2, 3], [4]]


def test_similar_texts_share_word_tokens():
    rng = np.random.default_rng(12)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(0, len(b) + 1)
            b = [np.delete(b, min(at, len(b) - 1)) if len(b) > 1 else b, np.insert(b, at, 7), np.concatenate((b[:at], [99], b[at + 1 :]))][rng.integers(3)].astype(np.uint32)
        if neardup.similar(a.tobytes(), b.tobytes()):
            both = len(np.intersect1d(neardup.word_tokens(a.tobytes()), neardup.word_tokens(b.tobytes())))
            assert both >= neardup.SHARE * max(len(a), len(b)) - 1e-6


def test_items_that_a_leader_matches_still_meet_the_others(spark):
    """Copies of copies: 1 ~ 2 ~ 3 in one bucket, where 1, the leader, does not match 3; and a crowded bucket of chains."""
    keys = [(i, b, 5) for i in (1, 2, 3) for b in range(16)] + [(1, b, 6) for b in (20, 21)] + [(4, b, 6) for b in (20, 21)] + [(i, 0, 7) for i in range(10, 70)]
    # sets that shift by two tokens of 20 from one item to the next, chains of six
    sets = {i: range(2 * i + 1000 * (i // 6 if i >= 10 else 0), 2 * i + 20 + 1000 * (i // 6 if i >= 10 else 0)) for i in (1, 2, 3, *range(10, 70))}
    sets[4] = range(90_000, 90_020)
    chains: dict = {}
    for i in range(10, 70):
        chains.setdefault(i // 6, []).append(i)
    assert classes_of(spark, keys, sets) == sorted([[1, 2, 3], [4], *chains.values()])


def test_classes_of_buckets_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**40, (9, 30))
    sets = {}
    for i in range(400):
        x = centres[i % 9].copy()
        change = rng.random(30) < rng.choice([0.02, 0.1, 0.3])
        x[change] = rng.integers(0, 2**40, change.sum())
        sets[i] = set(x.tolist())
    keys = [(i, b, int(k)) for i in sets for b, k in enumerate((i % 2, i % 9 // 3, rng.integers(0, 3)))]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    buckets: dict = {}
    for i, b, k in keys:
        buckets.setdefault((b, k), []).append(i)
    for group in buckets.values():
        for n, a in enumerate(group):
            for b in group[:n]:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    want: dict = {}
    for i in sets:
        want.setdefault(root(i), []).append(i)
    assert classes_of(spark, keys, sets) == sorted(want.values())
