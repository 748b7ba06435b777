"""One run of the pipeline, its tables between the stages against plain Python; the entry's list of queries."""

import re

import corpus_pipeline
from tarn.llm import common, neardup, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def test_each_stage_works_on_what_its_predecessor_kept(spark, monkeypatch):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept, saved = {}, corpus_pipeline.saved

    def watched(df, name):
        out = saved(df, name)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = out.collect()
        kept[name] = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(kept[name])
        return out

    monkeypatch.setattr(corpus_pipeline, "saved", watched)
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quality, near, cut, clean = kept.values()

    # rules: texts that go have few words, repeat themselves or are full of symbols, bars, capitals
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k, v in labels.items() if v == 1 and len(WORD.findall(docs[k])) >= 40]
    assert all(quality[k] == docs[k] for k in quality) and sum(k in quality for k in good) >= 0.97 * len(good)

    # near copies: of those that are very alike one stays; a text that is like no other stays
    sets = {k: shingles(v) for k, v in quality.items()}
    for k in near:
        assert near[k] == quality[k]
        assert not any(j < k and alike(sets[j], sets[k]) for j in near if len(sets[j]) > 4 and len(sets[k]) > 4)
    for k in quality.keys() - near.keys():
        assert any(j != k and len(sets[j] & sets[k]) >= 0.2 * len(sets[j] | sets[k]) for j in quality)

    # passages: no line of fifty words is left twice; other lines are untouched
    seen = set()
    for k in sorted(near):
        lines = near[k].split("\n")
        left = [x for x in lines if len(WORD.findall(x)) < 50]
        assert [x for x in cut.get(k, "").split("\n") if len(WORD.findall(x)) < 50] == left or not "".join(left).strip()
        for x in cut.get(k, "").split("\n"):
            if len(WORD.findall(x)) >= 50:
                assert x.strip() not in seen
                seen.add(x.strip())

    # leaks: documents that hold an item go, no others
    assert clean == {k: v for k, v in cut.items() if not any(b in v for b in bench)}

    # packing: all that is left, whole
    bpe = packing.ByteBpe(queries.tokenizer_path())
    want = {k: len(x) // 4 + 1 for k, x in zip(clean, bpe.encode(list(clean.values())), strict=True)}
    got: dict = {}
    for r in pieces:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_near_dedup_leaves_only_the_keys_it_keeps(spark):
    before = common.scratch_count()
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l m"), (4, None)], "doc_id long, text string")
    kept = neardup.dedup_stage(spark, docs, SF)
    assert common.scratch_count() == before + 1 and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_sketches_go_before_the_words_are_read(spark):
    """Pipeline, near_dedup's disk: no table of sketches is left when links are looked for."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, "alone here"), (5, None)], "doc_id long, text string")
    for df, n in ((docs, 3), (docs.limit(0), 0)):
        at = common.scratch_count()
        roots, texts, rows = neardup.near_classes(df)
        assert not [x for x in common._MADE[at:] if "sketches" in x]
        assert (rows.count(), texts.count(), roots.count()) == ((5, 4, 2) if n else (0, 0, 0))
        assert len({r["class_id"] for r in neardup.near_duplicates(df).collect()}) == n
