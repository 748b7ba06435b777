"""Operators 11 to 13 against plain Python, on small tables and on odd input."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import alignment, chat, queries, spelling

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ------------------------------------------------------------------ chat formatting


def test_formatting_equals_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = defaultdict(list)
    for r in rows:
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op11_chat_formatting(spark, SF).collect()}
    assert got.keys() == said.keys()
    for k, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == want


def test_neighbours_of_one_role_become_one_block(spark):
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("user", "[SEP]"), ("assistant", "b"), ("assistant", ""), ("tool", "c"), ("user", None)])], "conv_id int, turn int, role string, text string")
    r = chat.format_conversations(turns).collect()[0]
    assert r["formatted"] == r"<s>[INST]a[SEP][\SEP]</s><s>[/INST]b[SEP]</s><s>[ROLE]tool[/ROLE]c</s><s>[INST]</s>"
    assert r["n_blocks"] == 4 and [x["text"] for x in r["segments"] if x["loss"]] == ["b", ""]
    assert "".join(x["text"] for x in r["segments"]) == r["formatted"]


PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "\\\\", "/", "s>", "INST]", "é", "🙂", "\n", " ", "$1", "x"]), max_size=8).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system"]), PARTS)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(ROLES, PARTS), min_size=1, max_size=8), min_size=20, max_size=60))
def test_any_text_comes_back(spark, conversations):
    rows = [(k, i, r, t) for k, c in enumerate(conversations) for i, (r, t) in enumerate(c)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    read = out.select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"))
    for r in read.collect():
        said = conversations[r["conv_id"]]
        assert [tuple(x) for x in r["turns"]] == said
        assert r["loss"] == "".join(t for role, t in said if role == "assistant")
        assert r["formatted"].count("</s>") == sum(1 for _ in itertools.groupby(said, lambda x: x[0]))


def test_formatting_of_odd_tables(spark):
    schema = "conv_id long, turn int, role string, text string, formatted string, segments int, t int, turns string, begins int, blocks int"
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "first"), (2, 0, None, None), (2, 0, None, None), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "assistant", "z"), (4, 0, "assistant", "é" * 400_000)]
    odd = spark.createDataFrame([(*r, "f", 1, 2, "x", 3, 4) for r in rows], schema)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(odd)).collect()}
    assert got[None]["turns_sha256"] == sha("assistant\nfirst\nuser\nx\n") and got[None]["loss_chars"] == 5
    assert got[2]["turns_sha256"] == sha("\n\n\n\n") and got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == sha("")
    assert got[3]["turns_sha256"] == sha("assistant\nz\nuser\na\nuser\nb\n")
    assert got[4]["loss_chars"] == 400_000 and got[4]["formatted_chars"] == 400_000 + len("<s>[/INST]</s>")
    assert chat.digests(chat.format_conversations(odd.limit(0))).collect() == []


def test_a_long_conversation_takes_no_square_time(spark):
    turns = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat.digests(chat.format_conversations(turns)).collect()[0]
    assert r["n_turns"] == 60_000
    assert r["turns_sha256"] == sha("".join(f"{'assistant' if i % 3 else 'user'}\nt{i}\n" for i in range(60_000)))


# ------------------------------------------------------------------ spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    shorter = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shorter[v].add(w)
    near = {w: {v for i in range(len(w)) for v in shorter[w[:i] + w[i + 1 :]] | shorter[w] if one_edit(w, v)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def test_variants_equal_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, "/root/testdata/sf0.01").collect()]
    want = plain_variants(docs)
    assert set(got) == want and len(got) == len(want) and sum(r[1] is not None for r in got) > 50


@settings(max_examples=6, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=9), min_size=30, max_size=400))
def test_near_pairs_of_words_of_few_letters(spark, words):
    words = sorted(words)
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = {(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_pivots_are_the_cheapest_disjoint_pair(spark):
    words = ["abcdef", "aaaaaa", "banana", "mississippi", "abababab", "zzzzzy", "aaaa", "éàéàéà", "a" * 3000]
    for r in spelling.pivots_and_prefixes(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        cost = {x["pos"]: x["n"] for x in r["prefix"]}
        best = min(cost[p] + cost[q] for p in cost for q in cost if q - p >= 2) if len(cost) < 100 else 2 * min(cost.values())
        p, q = r["pivots"]
        assert q - p >= 2 and cost[p] + cost[q] == best
        ordered = sorted((x["n"], x["gram"]) for x in r["prefix"])
        assert len(ordered) >= 3


def test_variants_of_odd_tables(spark):
    rows = [(1, "colour " * 40), (2, "color " * 8), (2, "color " * 8), (None, "colors " * 5), (3, None), (4, ""), (5, "12 34"), (6, "é" * 9), (7, "×÷×÷×÷ " * 6), (8, ("a" * 2000 + " ") * 6)]
    odd = spark.createDataFrame([(*r, "w", 1, "f", 2) for r in rows], "doc_id long, text string, word string, n int, form string, root int")
    got = [tuple(r) for r in spelling.spelling_variants(odd).collect()]
    want = plain_variants(rows)
    assert set(got) == want and len(got) == len(want)
    assert any(r[0] == "a" * 2000 for r in got) and any(r[0] == "×÷×÷×÷" for r in got)
    assert spelling.spelling_variants(odd.limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(50)] + [("x", "w010")], "word string, form string")
    assert {r["root"] for r in spelling.last_forms(forms).collect()} == {"w050"}


# ------------------------------------------------------------------ cross-tokenizer alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(docs, paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in keep} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)}
    size_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    count, per = Counter(), []
    for doc, text in docs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx, by = [size_a(i) for i in x], [size_b(i) for i in y]
        if text and not b"".join(bx) == b"".join(by) == (" " + text).encode():
            x, y, bx, by = [], [], [], []
        links, groups, p, q, at, bt = [], [[[], []]], 0, 0, 0, 0
        while p < len(x) and q < len(y):
            links.append((x[p], y[q]))
            end_a, end_b = at + len(bx[p]), bt + len(by[q])
            if end_a <= end_b:
                groups[-1][0].append(x[p])
                p, at = p + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(y[q])
                q, bt = q + 1, end_b
            if end_a == end_b:
                groups.append([[], []])
        count.update(set(links))
        per.append((doc, len(x), len(y), links, groups[:-1]))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    say = lambda g: ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
    return [(d, i, j, len(g), len(k), sum(count[z] == top[z[0]] for z in k), sum(count[z] for z in k), sha(say(g)) if g else "") for d, i, j, k, g in per]


def test_alignment_equals_plain_python(spark, paths, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_cross_tokenizer_alignment(spark, SF).collect())
    assert got == sorted(plain_alignment(docs, paths)) and len(got) == len(docs)


def test_alignment_of_odd_texts(spark, paths):
    rows = [(1, None), (2, ""), (3, " a  b \n\n x"), (4, "a▁b"), (5, "<|endoftext|> </s> <s>é①x <unk>"), (6, "\n"), (7, "   "), (None, "dup dup dup"), (8, "tab\there\r\nyes\n"), (9, "\nstart"), (9, "a b c"), (9, "a b c"), (10, "日本語 text 🙂 ok"), (11, "don't 12345 x" * 20_000), (12, "\x00  é"), (13, "y" * 5_000)]
    odd = spark.createDataFrame([(*r, 1, "b", 3, 4) for r in rows], "doc_id long, text string, n_a int, block string, pair int, n int")
    got = sorted((tuple(r) for r in alignment.align(odd, *paths).collect()), key=repr)
    want = sorted(plain_alignment(rows, paths), key=repr)
    assert got == want and next(r for r in got if r[0] == 4)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(odd.limit(0), *paths).collect() == []


def test_counts_go_over_all_blocks(spark, paths, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["naïve", "tokenizer", "alignment", "byte", "ends", "überall", "123456", "don't"]
    rows = [(i, " ".join(rng.choice(words, 12))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = alignment.link_blocks(docs, *paths)
    assert parts.count() == 5
    got = sorted(tuple(r) for r in alignment.align(docs, *paths).collect())
    assert got == sorted(plain_alignment(rows, paths))
    with_text = alignment.align(docs, *paths, with_groups=True).collect()
    assert all(sha(r["groups"]) == r["groups_sha256"] for r in with_text)


def test_blocks_are_cut_by_bytes(paths):
    a, b = alignment._Vocabulary(alignment.ByteSide(paths[0])), alignment._Vocabulary(alignment.PieceSide(paths[1]))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["x" * (alignment.STEP // 2)] * 9})
    assert [len(d) for d, _ in alignment._steps([batch])] == [2, 2, 2, 2, 1]
    assert a.sizes[a.side.bytes.index(b" the")].as_py() == 4 and b.sizes[b.side.bytes.index(b" the")].as_py() == 4
