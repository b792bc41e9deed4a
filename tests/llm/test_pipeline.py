"""The pipeline against plain Python; the trained scorer's own decisions are taken as they are."""

import random

import corpus_pipeline
import pyarrow as pa
from dispatchlake.llm import quality

from tests.llm.test_neardups import plain_firsts

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ne", "ru", "sa") for c in ("t", "n", "x", "l")]


def cut_earlier(rows, w=50):
    first = {}
    for d, t in rows:
        words = t.split()
        for i in range(len(words) - w + 1):
            first.setdefault(tuple(words[i : i + w]), d)
    out = []
    for d, t in rows:
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        kept = " ".join(x for x, g in zip(words, gone, strict=True) if not g)
        if kept or not words:
            out.append((d, kept if any(gone) else t))
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    items = [(i, " ".join(rng.choices([f"q{x}" for x in range(40)], k=20))) for i in range(3)]
    passage = say(70)
    rows, labels = [], []
    for i in range(240):
        text, bad = say(rng.randrange(60, 200)), rng.random() < 0.25
        if bad:
            text = " ".join(w + "###" for w in text.split())
        elif i % 9 == 0 and rows:  # a copy, with the label of what it copies
            of = rng.randrange(len(rows))
            text, bad = rows[of][1], not labels[of][1]
        elif i % 9 == 1:
            text = f"{say(20)} {passage} {say(20)}"
        elif i % 9 == 2:
            text = f"{say(30)} {rng.choice(items)[1]} {say(30)}"
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    sources = {i: f"src{i % 3}" for i in range(240)}
    full = [(i, t, "en", sources[i], len(t)) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {r.doc_id for r in quality.score(docs, labelled).collect() if r.predicted}
    assert {i for i, q, _ in labels if q} == good
    kept = [(d, t) for d, t in rows if d in good]
    firsts = plain_firsts(kept)[0]
    kept = [(d, t) for d, t in kept if d in firsts]
    kept = cut_earlier(kept)
    kept = [(d, t) for d, t in kept if not any(s in t for _, s in items)]

    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in at.collect()) == [(d, t, len(t)) for d, t in kept]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source, r["size"]) for r in got) == [(d, sources[d], len(t.split())) for d, t in kept]
    assert abs(sum(r.taken for r in got) - sum(r["size"] for r in got)) < 0.1 * sum(r["size"] for r in got)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Each stage on nulls, empties, repeats, a very long text, an empty table and columns named as in its inside."""
    rng = random.Random(4)
    passage, item = " ".join(rng.choices(WORDS, k=80)), "how many apples do seven farmers pick in nineteen days of harvest if each one picks forty"
    rows = [(1, None), (2, ""), (3, " \n"), (4, f"start {passage} end"), (4, f"start {passage} end"), (5, f"other {passage} words"), (None, "no id at all"), (None, None), (6, f"it says {item} here"), (7, " ".join(rng.choices(WORDS, k=30_000))), (8, passage)]
    names = ["did", "tk", "row", "held", "root", "first", "score", "contaminated", "items", "kept", "n", "spans", "size", "a b"]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame([(d, t, None if d == 7 else "s", len(t or ""), *names) for d, t in rows], schema)
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        corpus_pipeline.keep_quality: rows,
        corpus_pipeline.keep_first_copies: [(None, None), (None, "no id at all"), rows[3], rows[8], rows[9]],
        corpus_pipeline.cut_passages: [*rows[:5], (5, "other words"), *rows[6:10]],
        corpus_pipeline.drop_benchmark: [r for r in rows if r[0] != 6],
    }
    for stage, expected in want.items():
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.schema["a b"] == docs.schema["a b"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(expected, key=str), stage.__name__
        assert all(list(r)[4:] == names for r in got.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_on_an_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    rows = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 2000) as text")
    corpus_pipeline.drop_benchmark(spark, rows, "/root/testdata/sf0.001")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= 8 << 20
