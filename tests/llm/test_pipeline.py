"""The pipeline's stages against plain versions of them, each on the input that the stage before gave it."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dapple.llm import line_templates, mixing, quality
from dapple.llm.kernel import as_bytes

from .test_brute_force import SPACE, all_leaks, roots, shingles


def tables(spark, sf, folder):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs, before = spark.read.parquet(f"{folder}/{k}"), docs
        out.append((before, docs))
    return out


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    return tables(spark, sf, tmp_path_factory.mktemp("steps"))


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality_stage(spark, sf, steps):
    before, after = steps[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.train(before, labels.where(~quality.held_out(F.col("doc_id"))))
    want = []
    for r in before.collect():
        f = next(quality.features(as_bytes([r["text"]])))
        z = m["a"] * quality.margin(f, m["ratio"].astype(float), m["w"].astype(float), m["bias"]) + m["b"]
        if 1 / (1 + np.exp(-z)) >= corpus_pipeline.GOOD:
            want.append(r["doc_id"])
    assert ids(after) == sorted(want)


def masked(line):
    line = re.sub(r"[ \t\x0b\f\r]+", " ", line).strip(" ")
    return re.sub("[^ ]*[0-9][^ ]*", "<*>", line)


def plain_cut(docs):
    """Lines and long sentences in a template tree, in loops: doc_id -> text left."""
    sentences = lambda line: re.split(line_templates.SENTENCE_END, line)
    long = lambda x: len(masked(x).split(" ")) >= line_templates.LONG_WORDS
    holders = defaultdict(set)
    for d, text in docs.items():
        lines = (text or "").split("\n") if text is not None else []
        for unit in lines + [x for line in lines for x in sentences(line) if long(x)]:
            holders[masked(unit)].add(d)
    n_of = lambda m: len(m.split(" ")) if len(m.split(" ")) >= 3 else max(len(m.split(" ")), len(m) // line_templates.WORD_CHARS)
    holders = {m: v for m, v in holders.items() if n_of(m) >= line_templates.SHORT_WORDS}
    leaves = defaultdict(list)
    for m in holders:
        leaves[len(m.split(" ")), tuple(m.split(" ")[:3])].append(m)
    template = {m: m for m in holders}
    for left in leaves.values():
        left = sorted(left, key=lambda m: (-len(holders[m]), min(holders[m]), m.encode()))
        while left:
            top, rest = left[0], []
            for m in left[1:]:
                same = sum(a == b for a, b in zip(m.split(" "), top.split(" "), strict=True))
                (template.__setitem__(m, top) if same >= -(-8 * n_of(m) // 10) else rest.append(m))
            left = rest
    docs_of = defaultdict(set)
    for m, v in holders.items():
        docs_of[template[m], n_of(m)] |= v
    gone = defaultdict(set)
    for m, v in holders.items():
        found = docs_of[template[m], n_of(m)]
        if (n_of(m) >= line_templates.LONG_WORDS and len(found) >= 2) or len(found) >= line_templates.SHORT_DOCS:
            for d in v:
                if d != min(found):
                    gone[d].add(m)
    out = {}
    for d, text in docs.items():
        if not gone[d]:
            out[d] = text
            continue
        kept = []
        for line in text.split("\n"):
            if masked(line) in gone[d]:
                continue
            parts = sentences(line)
            left = [x for x in parts if not long(x) or masked(x) not in gone[d]]
            if left:
                kept.append(line if len(left) == len(parts) else "".join(left).strip(" "))
        out[d] = "\n".join(kept)
    return out


def test_line_stage(steps):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in steps[1])
    want = {}
    for d, text in plain_cut(before).items():
        was = before[d]
        if text != was and (not text.strip(" ") or (len(text) < 0.05 * len(was) and len(re.findall(SPACE, text)) < 20)):
            continue
        want[d] = text
    assert after == want and len(want) < len(before) and sum(want[d] != before[d] for d in want) > 5
    assert all(r["n_chars"] == len(r["text"]) for r in steps[1][1].collect() if r["text"] != before[r["doc_id"]])


def links(sets):
    """Pairs of five-word shingle sets of 0.8 and more."""
    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    both = Counter(p for v in by.values() for p in itertools.combinations(sorted(set(v)), 2))
    return [p for p, n in both.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def test_near_stage(spark, sf, steps):
    before, after = steps[2]
    now = {r["doc_id"]: r["text"] for r in before.collect()}
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {(d, w): shingles(t, 5) for w, source in enumerate((now, whole)) for d, t in source.items() if d in now}
    pairs = links(sets)
    root = roots(now, [(a[0], b[0]) for a, b in pairs if a[0] != b[0]])
    assert ids(after) == sorted(d for d in now if root[d] == d)


def test_decontamination_stage(spark, sf, steps):
    before, after = steps[3]
    texts = [(r["doc_id"], r["text"]) for r in before.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for (d, _, _), v in all_leaks(texts, items).items() if v}
    assert bad and ids(after) == sorted(d for d, _ in texts if d not in bad)


def test_mixing_stage(steps):
    before, after = steps[4]
    size = {r["doc_id"]: (r["source"], len(re.findall(SPACE, r["text"] or ""))) for r in before.collect()}
    of_source = Counter()
    for s, n in size.values():
        of_source[s] += n
    order = sorted(of_source)
    want = mixing.share_targets(dict(of_source), {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, sum(of_source.values()), 3.0)
    taken, most = Counter(), Counter()
    for r in after.collect():
        s, n = size[r["doc_id"]]
        assert 1 <= r["copies"] <= 3
        taken[s] += n * r["copies"]
    for s, n in size.values():
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - want[s]) <= max(most[s], 0.01 * want[s]) for s in order)


def test_no_near_copy_survives_the_first_three_stages(spark, sf, tmp_path):
    """Of every group of near copies in the quality stage's output one document at most is left, scraps included."""
    d = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append({r["doc_id"]: r["text"] for r in docs.collect()})
    root = roots(outs[0], links({i: shingles(t, 5) for i, t in outs[0].items()}))
    groups = defaultdict(list)
    for i, r in root.items():
        groups[r].append(i)
    copies = [g for g in groups.values() if len(g) > 1]
    assert len(copies) > 20 and all(sum(i in outs[2] for i in g) <= 1 for g in copies)
    alone = [g[0] for g in groups.values() if len(g) == 1]
    assert sum(i in outs[2] for i in alone) > 0.97 * len(alone)
