"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dapple.llm import caps, chat, decontaminate, licences, line_templates, minmax_dedup, mixing, quality, secret_scan, warc

LONG = "alpha beta gamma delta " * 60_000
ROWS = [
    (1, "one short text"), (1, "one short text"), (2, None), (3, ""), (None, "a text without an id but with words"), (None, None), (4, LONG), (5, LONG), (6, " \t\n "), (7, "x" * 300_000), (1, "the same id with other words entirely"),
    (8, "one short text", None), (9, "line one is here\n" * 20),
]
CLASH = "score copies text_key node bucket hub rate kept gone label fold template owner"


def _benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "ten words of a benchmark item that nobody has copied"), (None, None)], "item_id long, text string")


def _labels(docs):
    return docs.sparkSession.createDataFrame([(1, 1), (3, 0), (4, 1), (5, None), (None, 1), (9, 0), (9, 7)], "doc_id long, quality int")


OPERATORS = {
    "quality": lambda d: quality.score(d, quality.train(d, _labels(d))),
    "licences": lambda d: licences.scan(d),
    "near_duplicates": lambda d: minmax_dedup.near_duplicates(d),
    "secrets": lambda d: secret_scan.scan(d),
    "lines": lambda d: line_templates.drop_recurring(d),
    "contaminated": lambda d: decontaminate.contaminated(d, _benchmark(d)),
    "mix": lambda d: mixing.mix(d),
}
#: Those that return a row for each row.
WHOLE = {"quality", "licences", "near_duplicates", "lines", "mix"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("extra", ["", CLASH])
def test_awkward_rows(make, name, extra):
    docs = make(ROWS, extra)
    out = OPERATORS[name](docs)
    n = out.count()
    if name in WHOLE:
        assert n == len(ROWS)
    assert OPERATORS[name](docs).count() == n


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(make, name):
    assert OPERATORS[name](make([(1, "x")]).limit(0)).count() == 0


def test_near_duplicate_edges(make):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(make(ROWS)).collect()]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert {r[2] for r in by[1]} == {1} and {r[2] for r in by[8]} == {1} and not by[8][0][3]
    assert by[2] == [(2, 0, 2, True)] and by[3] == [(3, 0, 3, True)] and by[6] == [(6, 0, 6, True)]
    assert by[4][0][2:] == (4, True) and by[5][0][2:] == (4, False)
    assert {(r[2], r[3]) for r in by[None]} == {(None, True)}


def test_one_id_with_several_texts(make):
    """Each of thirty ids has two unlike texts and an empty one; each text has a near copy under an id of its own."""
    own = lambda f, c: " ".join(f"w{f}x{c}y{k}" for k in range(60))
    rows = []
    for f in range(30):
        rows += [(1000 + f, own(f, 0)), (1000 + f, own(f, 1)), (1000 + f, ""), (2 * f, own(f, 0) + " end"), (2 * f + 1, own(f, 1) + " end")]
    for doubt in (5.0, None):
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minmax_dedup.near_duplicates(make(rows), doubt=doubt).collect()}
        assert got == {x for f in range(30) for x in ((1000 + f, 2 * f, False), (2 * f, 2 * f, True), (2 * f + 1, 2 * f, False))}


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (8, [0.01, 1.0, 0.0]), (9, [0.01, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (None, [0.0, 0.02, 1.0])]
    got = sorted(caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r["vec_id"] or 0, r["n_links"]))
    assert [tuple(r) for r in got] == [(None, 1, 5, False), (1, 1, 1, True), (1, 2, 1, True), (5, 1, 5, True), (7, 1, 1, False), (8, 2, 1, False), (9, 2, 1, False)]


def test_line_edges(make):
    out = {(r["__row"]["doc_id"], r["__row"]["text"]): r["text"] for r in line_templates.drop_recurring(make(ROWS)).collect()}
    assert out[2, None] is None and out[3, ""] == "" and out[6, " \t\n "] == " \t\n "
    assert out[4, LONG] == LONG and out[5, LONG] == ""


def test_empty_and_null_tables_of_other_kinds(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert caps.near_vectors(vectors).count() == 0
    doubles = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in caps.near_vectors(doubles).collect())
    assert got == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    events = spark.createDataFrame([], "conv_id long, seq long, kind string, target long, role string, text string")
    assert chat.read_back(chat.format_events(events)).count() == 0
    tied = spark.createDataFrame([(None, None, None, None, None, None), (1, 0, "message", None, "user", "b"), (1, 0, "message", None, "user", "a"), (1, 0, "message", None, "user", "a")], "conv_id long, seq long, kind string, target long, role string, text string").withColumn("rendered", F.lit("own"))
    assert sorted(r["n_turns"] for r in chat.read_back(chat.format_events(tied)).collect()) == [1, 3]
    pages = spark.createDataFrame([(1, None, "h"), (2, "http://a", None), (3, "http://a", ""), (None, "x", "y"), (4, "http://a/", "z")], "page_id long, url string, html string").withColumn("canonical", F.lit("own"))
    got = {r["record_id"]: r["outcome"] for r in warc.resolve_revisits(warc.crawl_log(pages)).collect()}
    assert got == {5: "no_response", 8: "validator_mismatch", 11: "validator_mismatch", 14: "resolved"}
    assert warc.resolve_revisits(warc.crawl_log(pages.limit(0))).count() == 0
    none = decontaminate.contaminated(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


# --- the pipeline ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, make, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    _benchmark(make(ROWS)).write.parquet(f"{folder}/benchmark.parquet")
    _labels(make(ROWS)).write.parquet(f"{folder}/labels.parquet")
    make(ROWS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, make, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = make(ROWS, "score node __extra __id __key __row r i t k own first d x s n doc lines __scored").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = stage(spark, docs, tables)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), tables).count() == 0


def test_stages_keep_clean_documents(spark, make, tables):
    item = "ten words of a benchmark item that nobody has copied"
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = lambda i: f"document {'abcdefghij'[i]} talks of {' '.join(c * 3 for c in 'abcdefghij'[i:])} and nothing else at all"
    long = "behind it " + " ".join(f"other{chr(97 + i)}" for i in range(26))
    docs = make([(i, own(i)) for i in range(6)] + [(10, own(0)), (11, "ahead\n" + passage), (12, long + "\n" + passage), (13, "x " + item), (14, "behind\n" + passage)])
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stage["benchmark decontamination"](spark, docs, tables)) == [0, 1, 2, 3, 4, 5, 10, 11, 12, 14]
    # 12 has words of its own, 14 shares more than 0.8 of its shingles with 11
    assert ids(stage["near dedup"](spark, docs, tables)) == [0, 1, 2, 3, 4, 5, 11, 12, 13]
    cut = {r["doc_id"]: r for r in stage["line dedup"](spark, docs, tables).collect()}
    assert cut[12]["text"] == long and cut[12]["n_chars"] == len(long) and passage in cut[11]["text"]
    assert not {10, 14} & set(cut)  # nothing, or one word of sixty, would be left of them
    assert all(cut[i]["text"] == own(i) for i in range(6))


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "copies"]
    rows = out.collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= 3 for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(r["doc_id"]) == 0 for r in rows) <= 2
