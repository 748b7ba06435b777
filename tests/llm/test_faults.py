"""Cases that once came out wrong."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontamination, html, quality

P = "<p>one two</p><p>three</p>"


def main_part(page):
    lines, regions = html.lines_of(page)
    return [x for x, r in zip(lines, regions, strict=True) if r == 2]


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="home no-sidebar"><nav>m</nav><article>{P}</article></body>',
        f'<div class="page has-sidebar"><article>{P}</article></div>',
        f'<form id="aspnetForm"><div>menu</div><main>{P}<nav>n</nav><form>f</form></main><p>z</p></form>',
        f'<article><svg width="1"/>{P}<iframe src=x></article><p>after</p>',
        f'<article>{P}</article><ul class="cmt-list"><li>c</li></ul>',
        f"<article>{P}</article><aside><article>teaser</article></aside>",
        f'<svg><text>x</text></svg><article>{P}<div class="related-posts">gone</div><div class="share-buttons">s</div></article>',
    ],
)
def test_main_part_is_found(page):
    assert main_part(page) == ["one two", "three"]


def test_sections_named_after_a_topic_stay():
    assert main_part(f'<article>{P}<section id="related-work"><p>kept</p></section></article>') == ["one two", "three", "kept"]


@pytest.mark.parametrize("piece", ["<![", "<? ", "<iframe>", "<a ", "<!--", "<svg", '<p class="'])
def test_broken_markup_is_read_in_linear_time(piece):
    began = time.perf_counter()
    html.lines_of(piece * 50_000)
    assert time.perf_counter() - began < 2


def test_the_sample_holds_at_any_size():
    share = lambda n: (quality.sample_bound(2000, n) + 2**63) / 2**64
    for n in (2001, 10**6, 10**9, 10**11, 10**14):
        assert share(n) == pytest.approx(2000 / n, rel=1e-2)


def test_any_number_of_marks_at_a_words_ends(spark):
    item = "What is love ______________"
    items = spark.createDataFrame([(1, item), (2, "(((((((Who))))))) are \"\"\"\"\"\"\"\"you\"\"\"\"\"\"\"\" then?")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"Some words before. {item} Some words after."), (8, "Ask: who are you then? Nobody.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(7, 1), (8, 2)}


def test_equal_words_make_no_product(spark):
    items = spark.createDataFrame([(1, "la " * 400), (2, "a b " * 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "la " * 100_000), (2, "b a " * 20_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0} and time.perf_counter() - began < 60


def test_questions_asked_again_with_other_values_are_found(spark):
    rng = np.random.default_rng(4)
    words = [a + b + c for a in ["ka", "lo", "mi", "ru", "te", "so", "pa"] for b in ["n", "rd", "st", "l"] for c in ["a", "em", "io", "u", "ing"]]
    names, units = ["Anna", "Bob", "Carla", "Dilip", "Emeka"], ["kg", "km", "litres"]
    items, docs = [], []
    for i in range(60):
        body = list(rng.choice(words, 40))
        for at in range(3, 40, 9):
            body[at] = "{}"
        kinds = [str(rng.integers(2, 900)) if k % 2 else names[(i + k) % 5] for k in range(5)]
        other = [str(rng.integers(2, 900)) if k % 2 else names[(i + k + 1) % 5] for k in range(5)]
        text = " ".join(body)
        items.append((i, text.format(*kinds)))
        docs.append((i, " ".join(rng.choice(words, 30)) + ". So " + text.format(*other) + ". " + " ".join(rng.choice(words, 30))))
    docs += [(100 + i, " ".join(rng.choice(words, 120))) for i in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d == i for d, i in got) and len(got) >= 54


def test_leftovers_of_a_stage_go_when_the_next_begins(spark):
    import os

    from tarn.llm import common

    made = []

    def stage(spark, docs, sf_dir):
        out = common.saved(docs.withColumn("text", F.upper("text")), "stage-test")
        made.append(common._MADE[-1])
        return out

    rest = common.Leftovers()
    first, second, last = rest.collected(stage), rest.collected(stage), rest.collected(stage, remember=False)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    one = first(spark, docs, "")
    two = second(spark, one, "")  # reads what the first left, which was not written elsewhere
    exists = lambda p: os.path.exists(p.removeprefix("file:"))
    assert exists(made[0]) and exists(made[1]) and two.count() == 2
    written = common.saved(two, "elsewhere")
    three = last(spark, written, "")
    assert not exists(made[0]) and not exists(made[1]) and exists(made[2])
    first(spark, docs, "")
    assert exists(made[2]) and sorted((r["doc_id"], r["text"]) for r in three.collect()) == [(1, "A"), (2, None)]
