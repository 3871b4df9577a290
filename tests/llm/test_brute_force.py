"""Operators against plain versions that compare everything with everything."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dapple.llm import caps, chat, decontaminate, licences, line_templates, minmax_dedup, mixing, quality, secret_scan, warc
from dapple.llm.kernel import ALNUM, SPACED, as_bytes, shingle_sets, words
from dapple.llm.queries import ORACLES, QUERIES

from ..compare import check, connect

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, n):
    w = re.findall(SPACE, lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


# --- kernels ----------------------------------------------------------------


def test_words_are_those_of_the_patterns():
    rng = random.Random(1)
    alphabet = "aB0 \t\n\r\x0b\x0c.-_é  日\x1c\x85{~"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    for inside, pattern in ((SPACED, SPACE), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen: dict = {}
        for w in words(as_bytes(texts), inside):
            for i in range(w.hi - w.lo):
                want = re.findall(pattern, lower(texts[w.lo + i]))
                got = w.hashes[w.of(i)].tolist()
                assert len(want) == len(got)
                for a, b in zip(want, got, strict=True):
                    assert seen.setdefault(a, b) == b
        assert len(set(seen.values())) == len(seen)


def test_shingle_sets_have_the_right_sizes():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab cd ef".split(), k=rng.randint(0, 12))) for _ in range(200)] + [None, " "]
    for n in (1, 3, 5):
        assert [len(s) for s in shingle_sets(as_bytes(texts), n)] == [len(shingles(t, n)) for t in texts]


# --- 3: near duplicates --------------------------------------------------------


def families(seed, n_families=12, copies=14, length=60):
    """Families of edited copies around the threshold, exact copies, and texts that share half of their words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    common = rng.choices(vocab, k=length // 2)
    for f in range(n_families):
        base = rng.choices(vocab, k=length)
        for c in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 6) if c % 3 else 0):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
        rows.append((k, " ".join(common + rng.choices(vocab, k=length // 2))))
        k += 1
    return rows


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates(make, monkeypatch, n, percent, block):
    monkeypatch.setattr(minmax_dedup, "BLOCK_ROWS", block)
    rows = families(n + percent)
    got = {r["doc_id"]: r for r in minmax_dedup.near_duplicates(make(rows), shingle_words=n, percent=percent).collect()}
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_confirming_is_exact(make):
    base = [f"w{i}" for i in range(102)]  # 100 shingles of three words
    at = lambda k: " ".join(base[: 102 - k] + [f"x{i}" for i in range(k)])
    for k in (7, 8, 9):  # 100 - k shared of 100 + k
        got = minmax_dedup.near_duplicates(make([(1, at(0)), (2, at(k))]), shingle_words=3, percent=85).where("doc_id = 2").first()
        assert got["kept"] == (100 * (100 - k) < 85 * (100 + k))


# --- 5: vectors -----------------------------------------------------------------


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 32))
    rows = []
    for i in range(300):
        v = base[i % 25] + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, [2 * x for x in rows[0][1]]), (500, None), (501, [0.0] * 32), (502, [float("nan")] * 32), (503, [None] * 32), (504, []), (505, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i < 500]
    unit = np.stack([v / np.linalg.norm(v) for _, v in ok])
    near = unit @ unit.T >= 0.95
    links = [(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(r["n_links"] for r in got.values())
    assert found <= 2 * len(links) and found >= 0.995 * 2 * len(links)
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    want = roots([r[0] for r in rows], links)
    assert sum(got[i]["component_id"] != want[i] for i in got) <= 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(500, 506))


def test_filter_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    code = caps.ProductCode(64, 114)  # 50,000 vectors
    a = rng.standard_normal((800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((800, 64))
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * r
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    assert np.mean(shared) > 0.99


# --- 1: quality -------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = QUERIES["op1_nbsvm_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.95
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_are_not_learnt(spark, sf):
    import zlib

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels.collect())


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    y = np.array([1, 1, -1, -1] * 5)
    ratio = quality.class_ratio(rows, y)
    assert ratio[0] > 1 and ratio[1] < -1 and abs(ratio[2]) < 1e-9
    w, b = quality.descend(rows, y, ratio)
    assert all((quality.margin(r, ratio, w, b) > 0) == (t > 0) for r, t in zip(rows, y, strict=True))


def test_descent_solves_the_hinge_dual():
    """Against projected gradient on the dual with the full matrix: the box, the optimum and the gap."""
    rng = np.random.default_rng(21)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    y = np.where([r.min() + rng.integers(0, 6) < 6 for r in rows], 1, -1)
    ratio = quality.class_ratio(rows, y)
    x = np.zeros((60, 41))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 40] = 1
    q = (x * y[:, None]) @ (x * y[:, None]).T
    for cost in (0.3, 1.0):
        alpha = np.zeros(60)
        for _ in range(60_000):
            alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
        best = alpha.sum() - alpha @ q @ alpha / 2
        w, b = quality.descend(rows, y, ratio, cost=cost, epochs=3000)
        v = np.append(w[:40], b)
        primal = v @ v / 2 + cost * np.maximum(0, 1 - y * (x @ v)).sum()
        assert (alpha == cost).any() and abs(primal - best) < 1e-2 * best


def test_features_are_the_distinct_ngrams():
    texts = ["One two two,  three", "", "x", "é 日本 one"]
    found = list(quality.features(as_bytes(texts)))
    again = [next(quality.features(as_bytes([t]))) for t in texts]
    for t, f, g in zip(texts, found, again, strict=True):
        assert set(f.tolist()) == set(g.tolist()) and len(f) == len(set(f.tolist()))  # neighbours in a batch do not matter
        w = t.split()
        raw = t.encode()
        most = len({x.lower() for x in w}) + len(set(zip(map(str.lower, w), map(str.lower, w[1:])))) + len({raw[i : i + 3] for i in range(len(raw) - 2)}) + max(0, len(w) - 1)
        assert len(f) <= most and (len(f) >= len({x.lower() for x in w}) if w else len(f) == 0)


def test_the_bound_counts_documents(spark, make):
    docs = make([(1, "good words here")] * 5 + [(2, "BAD!!! 123")] * 5 + [(3, "good words there"), (4, "bad 456")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), *((100 + i, i % 2) for i in range(50))], "doc_id long, quality int")
    once, twice = quality.train(docs, labels, max_train=4), quality.train(docs.distinct(), labels, max_train=4)
    assert np.array_equal(once["w"], twice["w"]) and once["bias"] == twice["bias"] and np.abs(once["w"]).sum() > 0


def test_one_class_of_labels_scores_alike(spark, make):
    docs = make([(i, f"text {i}") for i in range(8)])
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).count() == 8


# --- 2: licences -------------------------------------------------------------------


def test_licence_blocks_are_all_found():
    rng = random.Random(5)
    book = licences.Catalogue(licences.TEMPLATES, licences.PHRASES, {b"the": 900, b"license": 40, b"of": 800}, 0.8)
    names = list(book.rank)
    for _ in range(150):
        text = [rng.choice(names) if rng.random() < 0.1 else b"zz%d" % rng.randrange(50) for _ in range(rng.randint(0, 700))]
        for _ in range(rng.randint(0, 3)):
            label, t = rng.choice(licences.TEMPLATES)
            cutting = licences.cut(t)
            kept = [w for w in cutting if rng.random() < rng.choice([0.7, 0.85, 1.0])]
            at = rng.randint(0, len(text))
            text[at:at] = kept
        ranks = np.array([book.rank.get(t, -1) for t in text], dtype=np.int32)
        got = {(a, label) for a, _, label, _ in book.blocks(ranks)}
        want = set()
        for label, ordered, need, step in book.templates:
            for k in range(max(1, -(-len(text) // step))):
                lo = k * step
                if lo and len(text) <= lo + step:
                    continue
                if len(set(ranks[lo : lo + 2 * step].tolist()) & set(ordered.tolist())) >= need:
                    want.add((lo, label))
        assert got == want


def test_scattered_words_are_no_licence(spark, make):
    far = " some other words" * 13
    texts = [f"all{far} rights{far} reserved", "All rights reserved", "all the rights are reserved"]
    got = {r["doc_id"]: [b["label"] for b in r["blocks"]] for r in licences.scan(make(list(enumerate(texts)))).collect()}
    assert got == {0: [], 1: ["rights-reserved"], 2: ["rights-reserved"]}


def test_licence_query(spark, make):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "gnu general, PUBLIC license! gnu general public license", "mit licence mit license apache\nlicense cc-by", None, "", "nothing here", "x " * 5000 + dict(licences.TEMPLATES)["mit-notice"]]
    found = {r["doc_id"]: r for r in licences.scan(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        want = sorted((k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert [tuple(x) for x in found[i]["phrases"]] == want and found[i]["n_words"] == len(w)
    assert {b["label"] for b in found[6]["blocks"]} == {"mit-notice"}
    assert "gpl-3-statement" in {b["label"] for b in found[0]["blocks"]}


# --- 4: chat --------------------------------------------------------------------------


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "a"), (1, 2, "delta", 1, None, "b"), (1, 3, "delta", 1, None, "c"),
        (1, 4, "message", None, "user", "mor"), (1, 6, "edit", 4, None, "more?"), (1, 5, "message", None, "assistant", "old"), (1, 7, "regenerate", 5, None, None), (1, 8, "delta", 5, None, "new"),
        (2, 0, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, target long, role string, text string")
    turns = chat.format_events(events).collect()
    text = "".join(r["rendered"] for r in sorted(turns, key=lambda r: r["position"]) if r["conv_id"] == 1)
    assert text == "### user: hi</turn>\n### assistant: abc</turn>\n### user: more?</turn>\n### assistant: new</turn>\n"
    masked = [text[r["loss_start"] : r["loss_end"]] for r in sorted(turns, key=lambda r: r["position"]) if r["conv_id"] == 1 and r["loss_start"] is not None]
    assert masked == ["abc", "new"]
    assert [r["rendered"] for r in turns if r["conv_id"] == 2] == ["### : </turn>\n"]


def test_streamed_turns_fold_back(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"text {c} of {t} 日é" * (t % 3)) for c in range(20) for t in range(9)] + [(99, 0, "user", "b"), (99, 0, "assistant", "a"), (99, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.streamed(turns).cache()
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert events.where("kind = 'message' AND text LIKE 'draft %'").count() > 20
    plain = turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), "role", "text")
    read = lambda e: sorted(map(tuple, chat.read_back(chat.format_events(e)).collect()))
    assert read(events) == read(plain) and read(events.orderBy(F.desc("seq"))) == read(plain)


def test_very_long_and_repeated_events(spark):
    long = "word # <tag> " * 100_000
    rows = [(1, 0, "message", None, "user", long), (1, 1, "message", None, "assistant", "a"), (1, 2, "delta", 1, None, "b"), (1, 2, "delta", 1, None, "b"), (1, 3, "delta", 7, None, "alone")]
    turns = chat.format_events(spark.createDataFrame(rows, "conv_id long, seq long, kind string, target long, role string, text string"))
    got = chat.read_back(turns).first()
    assert got["n_turns"] == 3 and got["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\nabb\n\nalone\n".encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(6)
    pieces = ["### ", "</turn>", "\\", "#", "<", "\n", ": ", "user", "é", "日", "a", "\\\\#", "### Assistant: "]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b", None]), "".join(rng.choices(pieces, k=rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 6))]
    events = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumns({"kind": F.lit("message"), "target": F.lit(None).cast("long")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_events(events)).collect()}
    for c in range(40):
        own = [r for r in rows if r[0] == c]
        want = "".join(f"{r[2] or ''}\n{r[3]}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- 6: secrets ------------------------------------------------------------------------


def test_secrets_and_false_positives(make):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" tail', f"id {key} end", "password=e3b3ed3cc8548923d6 das", "sha256: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
        "password: your_password_here", "api_key = xxxxxxxxxxxxxxxx", "see 123e4567-e89b-12d3-a456-426614174000", None, "", "plain prose " * 1000,
    ]
    rows = secret_scan.scan(make(list(enumerate(texts)))).collect()
    secret = {r["doc_id"] for r in rows if r["score"] >= 0.5}
    assert secret == {0, 1, 2}
    assert {r["doc_id"] for r in rows} >= {3, 4, 5}  # seen, and refused
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["value"]


def test_forest_on_findings_it_has_not_seen():
    """Trained on one half of the words, names and contrary words, measured on findings of the other half."""
    model = secret_scan.fit(*secret_scan.labelled_findings(3000, seed=4, part=0))
    x, y = secret_scan.labelled_findings(3000, seed=77, part=1)
    hit = model.scores(x) >= 0.5
    assert (hit == y).mean() > 0.95 and hit[y == 1].mean() > 0.95 and (~hit[y == 0]).mean() > 0.93


def test_transitions_are_log_ratios_of_shares():
    table = secret_scan.transitions(["ab", "ab", "ac"], np.array([1, 1, 0]), smooth=1.0)
    a, b, c = (ord(k) - 32 for k in "abc")
    assert np.isclose(table[a, b], np.log((3 / 98) / (1 / 97))) and np.isclose(table[a, c], np.log((1 / 98) / (2 / 97))) and table[b, c] == 0


def test_a_private_key_is_found_whole(make):
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "abcDEF0123/+\n" * 20 + "-----END RSA PRIVATE KEY-----"
    got = secret_scan.scan(make([(1, f"x {key} y"), (2, "-----BEGIN PRIVATE KEY----- cut off")])).collect()
    assert {(r["doc_id"], r["value"]) for r in got if r["kind"] == "private_key"} == {(1, key), (2, "-----BEGIN PRIVATE KEY-----")}
    assert all(r["score"] >= 0.5 for r in got if r["kind"] == "private_key")


# --- 7: revisits --------------------------------------------------------------------------


def test_canonical_urls(spark):
    groups = [
        ["HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com:443/a?a=1&b=2", "example.com/a/?ref=q&b=2&a=1&", "http://example.com/./b/../%61?%61=1&b=2"],
        ["https://h.org:80/a", "https://h.org:80/x/../../a/."], ["http://h.org:443/a"], ["http://h.org/%2fa%7e", "http://h.org/%2Fa~"], ["http://h.org/100%", "http://h.org/100%/"], ["http://h.org/.a/..b"],
    ]
    rows = [(u, k) for k, g in enumerate(groups) for u in g]
    got = defaultdict(set)
    for r in spark.createDataFrame(rows, "u string, k int").select("k", warc.canonical_url(F.col("u")).alias("c")).collect():
        got[r["k"]].add(r["c"])
    assert [got[k] for k in range(6)] == [{"example.com/a?a=1&b=2"}, {"h.org:80/a"}, {"h.org:443/a"}, {"h.org/%2Fa~"}, {"h.org/100%"}, {"h.org/.a/..b"}]


def test_the_log_holds_all_outcomes(spark, sf):
    rows = QUERIES["op7_revisit_resolution"](spark, sf).collect()
    assert {r["outcome"] for r in rows} == {"resolved", "validator_mismatch", "no_response"}
    assert len({r["source_id"] % 3 for r in rows if r["source_id"] is not None}) == 2  # the first version and the second


def test_a_log_given_twice(spark):
    rows = [(1, "http://h/a", 5, "response", 200, {"etag": "x"}, True), (2, "http://h/a#f", 9, "revisit", 304, {"etag": "x"}, False), (3, None, 9, "revisit", 304, None, False), (4, "http://h/a", None, "revisit", 304, {"etag": "x"}, False)]
    spec = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, has_payload boolean"
    got = [(r["record_id"], r["source_id"], r["outcome"]) for r in warc.resolve_revisits(spark.createDataFrame(rows * 2, spec).withColumn("h", F.lit("own"))).collect()]
    assert sorted(got, key=str) == sorted([(2, 1, "resolved"), (3, None, "no_response"), (4, None, "no_response")] * 2, key=str)


@pytest.mark.parametrize("bucket", [1, 10, 10_000])
def test_revisits_against_a_scan_of_everything(spark, bucket):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        url = f"http://h.org/{rng.choice('aaaaaab')}"
        if rng.random() < 0.4:
            rows.append((i, url, rng.randint(0, 60), "response", rng.choice([200, 200, 404]), {"etag": f'"{rng.choice("xy")}"', "date": f"d{i}", "content-type": "t"}, rng.random() < 0.9))
        else:
            rows.append((i, url + "#f", rng.randint(0, 60), "revisit", 304, {"etag": rng.choice(['W/"x"', '"y"']), "date": f"d{i}", "server": "s"} if rng.random() < 0.9 else {}, False))
    spec = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, has_payload boolean"
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, spec), bucket=bucket).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and x[4] == 200 and x[6] and x[1] == r[1][:-2] and x[2] < r[2]]
        if not before:
            assert (got[r[0]]["outcome"], got[r[0]]["source_id"]) == ("no_response", None)
            continue
        source = max(before, key=lambda x: (x[2], x[0]))
        same = r[5].get("etag", "").replace("W/", "") == source[5]["etag"]
        assert got[r[0]]["source_id"] == source[0]
        assert got[r[0]]["outcome"] == ("resolved" if same else "validator_mismatch")
        assert got[r[0]]["headers"] == ({"content-type": "t", "etag": r[5]["etag"], "date": r[5]["date"]} if same else r[5])


# --- 8: lines --------------------------------------------------------------------------------


def test_variable_fields_generalise(make):
    a = "the job {} finished after a long while with code {} on node {} today"
    rows = [(1, a.format(1, 2, "alpha") + "\nown line of the first document"), (2, "another line\n" + a.format(7, 9, "beta")), (3, a.format(5, 5, "gamma") + "\nsomething else here"), (4, "quite different words\nin this text")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(make(rows)).select("__row.doc_id", "text", "n_dropped").collect()}
    assert got[1]["n_dropped"] == 0 and got[4]["text"] == rows[3][1]
    assert got[2]["text"] == "another line" and got[3]["text"] == "something else here"


def test_short_lines_need_more_documents(make):
    got = line_templates.drop_recurring(make([(i, f"all rights reserved\nunique text {'abcdefg'[i]}") for i in range(6)])).select("__row.doc_id", "n_dropped").collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {0: 0, **{i: 1 for i in range(1, 6)}}
    assert line_templates.drop_recurring(make([(i, "all rights reserved") for i in range(4)])).where("n_dropped > 0").count() == 0


def test_rows_without_id_lose_recurring_lines_too(make):
    line = "a line of more than ten words that stands in many of the documents here"
    rows = [(1, line), (2, "first\n" + line), (None, line + "\nkept one"), (None, "kept two\n" + line), (None, "kept three")]
    got = sorted(r["text"] for r in line_templates.drop_recurring(make(rows)).collect())
    assert got == sorted([line, "first", "kept one", "kept two", "kept three"])


def test_a_leaf_holds_any_number_of_templates(make):
    """Six families in one leaf, each a line in three documents with another name: more than there are passes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("bcdfghjklm", k=6))
    families = ["at 1 2 " + " ".join(word() for _ in range(10)) for _ in range(6)]
    rows = [(3 * f + c, families[f].rsplit(" ", 1)[0] + f" {word()}\nown {word()}") for f in range(6) for c in range(3)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring(make(rows)).select("__row.doc_id", "n_dropped").collect()}
    assert got == {i: int(i % 3 > 0) for i in range(18)}


@pytest.mark.parametrize("hubs", [1, 8])
def test_last_turns_leave_no_two_templates_that_agree(spark, monkeypatch, tmp_path, hubs):
    monkeypatch.setattr(line_templates, "HUBS", hubs)
    rng = random.Random(13)
    stems = [[rng.choice("abcdef") * 3 for _ in range(12)] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(stems[i % 8])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(3, 12)] = rng.choice("abcdefgh") * 2
        rows.append((i, i % 2, rng.randint(1, 4), i, 12, " ".join(w)))
    left = spark.createDataFrame(rows, "line long, leaf long, docs long, doc long, n int, m string")
    scratch = line_templates.Scratch(spark, "test")
    got = {r["line"]: r["template"] for r in line_templates.last_turns(scratch, left, 3, 0.8).collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(rows[a][5].split(), rows[b][5].split(), strict=True)) >= 10
    templates = [r[0] for r in rows if r[0] not in got]
    assert len(got) > 20 and all(agree(a, b) and b in templates and rows[a][1] == rows[b][1] for a, b in got.items())
    assert not any(agree(a, b) for a, b in itertools.combinations(templates, 2) if rows[a][1] == rows[b][1])
    wider = lambda a: (-rows[a][2], rows[a][3], a)
    assert all(wider(b) < wider(a) for a, b in got.items())


def test_short_lines_white_space_and_scripts_without_blanks(make):
    names = "Ann Bea Cyd Dee Eve Fay".split()
    wide = "日本語の長い行はここに空白なしで続きそして何度も繰り返される文であり二つの文書に現れる" * 2
    rows = [(i, f"new message posted by {n}\nown{n}") for i, n in enumerate(names)]
    rows += [(10, "a\tlog\tline\twith\ttabs\tin\tplace\tof\tall\tblanks\nx"), (11, "y\na log  line with tabs in place of all blanks"), (12, wide), (13, "z\n" + wide), *((20 + i, f"Les.\nq{n}") for i, n in enumerate(names))]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(make(rows)).select("__row.doc_id", "text").collect()}
    assert got[0] == rows[0][1] and [got[i] for i in range(1, 6)] == [f"own{n}" for n in names[1:]]
    assert (got[11], got[13]) == ("y", "z") and got[12] == wide
    assert all(got[20 + i] == f"Les.\nq{n}" for i, n in enumerate(names))  # a few characters prove nothing


def test_passages_inside_lines_are_cut(spark, make, sf):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(" ".join(word() for _ in range(14)) + "." for _ in range(5))
    rows = [(1, f"Own start. {passage} Own end."), (2, f"first line\nother start. {passage} other end, and more\nlast  line"), (3, passage), (4, "Nothing here.  Twice kept! And so")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, make(rows), sf).collect()}
    assert got == {1: rows[0][1], 2: "first line\nother start. other end, and more\nlast  line", 4: rows[3][1]}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


# --- 9: decontamination -------------------------------------------------------------------------


def test_leaks(spark, make):
    item = "Once Alice travels 60 miles in 3 hours and then Alice rests for 20 minutes before going home again tonight"
    other = item.replace("Alice", "Zed").replace("60", "75").replace("20", "15")
    rows = [
        (1, "before. " + item + " after"), (2, "so " + other), (3, "so " + other.replace("then Zed", "then Tom")), (4, " ".join(item.split()[4:17])), (5, "nothing of it " * 30), (6, None), (7, ""), (8, item.upper().replace(" ", "  ")),
        (9, " ".join(item.split()[:7])),
    ]
    bench = spark.createDataFrame([(1, item), (2, "short item of six words only"), (3, None), (None, "no id")], "item_id long, text string")
    rows.append((10, "Here it is. Short item, of six words only. yes"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(rows), bench).where("consistent").collect()}
    assert got >= {(1, 1), (2, 1), (4, 1), (10, 2)} and not {d for d, _ in got} & {3, 5, 6, 7, 9}


def test_copies_in_other_case_are_found(spark, make):
    item = "Once Alice travels 60 miles in 3 hours and then Alice rests for 20 minutes before going home again tonight"
    ten = "Maria bakes 12 round loaves for Peter on the 1st"
    names = "Every day Alice helps Bob or Carl and then Dora helps Emil or Fred and then Gina helps Hugo"
    bench = spark.createDataFrame([(1, item), (2, ten), (3, names)], "item_id long, text string")
    rows = [(8, item.upper().replace(" ", "  ")), (9, item.lower()), (10, "and so Maria bakes 15 round loaves for Oskar on the 2nd"), (11, ten.upper()), (12, names.lower()), (13, "x " + names.upper()), (14, names.replace("Alice", "Zoe"))]
    rows += [(15, item.replace("then Alice", "then Tom")), (16, item)]
    got = decontaminate.contaminated(make(rows), bench).where("consistent").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(8, 1), (9, 1), (10, 2), (11, 2), (12, 3), (13, 3), (14, 3), (16, 1)}
    assert {r["windows"] for r in got if r["doc_id"] == 16} == {len(item.split()) - 9}


def test_items_of_values_match_with_their_own_values(spark, make):
    bench = spark.createDataFrame([(1, "What is 48 * 17?"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "48 17")], "item_id long, text string")
    rows = [(1, "Tell me, what is 48 * 17? Now"), (2, "what is 49 * 17?"), (3, "so 1 2 3 4 5 6 7 8 9 10 11 12 end"), (4, "2 2 3 4 5 6 7 8 9 9 11 12"), (5, "48 17")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(rows), bench).where("consistent").collect()}
    assert got == {(1, 1), (3, 2), (5, 3)}  # an item of two words is found as a whole text only


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def slotted(text):
    """(own word, slot type) of each word of a text, by the rules in words."""
    out, before = [], None
    for m in re.finditer(SPACE, text or ""):
        opens = before is None or before[-1] in ".!?:" or text[m.start() - 1] == "\n"
        before, word = m[0], m[0].strip(MARKS)
        if not word:
            continue
        kind = 0
        if re.search("[0-9]", word) and re.fullmatch(r"[-+]?[$€]{0,3}\d[\d.,:/]*(st|nd|rd|th)?%?", word, re.IGNORECASE | re.ASCII):
            kind = 1
        elif out and out[-1][1] == 1 and lower(word) in decontaminate.UNITS.split():
            kind = 2
        elif re.match("[A-Z]", word) and not opens and len(word.encode()) > 1 and len(re.findall("[A-Z]", word)) == 1:
            kind = 3
        out.append((lower(word), kind, bool(re.match("[A-Z]", word))))
    return out


def window_forms(part):
    """form, key, slots (offset, type, value) of a window."""
    literals, plain = sum(k == 0 for _, k, _ in part), sum(k in (0, 3) for _, k, _ in part)
    seen = lambda kinds: tuple(k if k in kinds else w for w, k, _ in part)
    slots = lambda kinds: [(o, k, w) for o, (w, k, _) in enumerate(part) if k in kinds]
    if literals >= 4:
        yield 0, seen((1, 2, 3)), slots((1, 2, 3))
    if plain > literals and plain >= 4:
        yield 1, seen((1, 2)), slots((1, 2))
    if plain < 4:
        yield 2, seen(()), []


def all_leaks(texts, items, window=10):
    """(doc, item, diagonal) -> consistent, every window of every text against every window of every item."""
    cut = []
    for i, text in items:
        s = slotted(text)
        if 0 < len(s) < 4:
            cut.append((i, 0, len(s), 2, tuple(w for w, *_ in s), [], True))
            continue
        size = min(window, len(s))
        for at in range(len(s) - size + 1 if s else 0):
            cut += [(i, at, size, f, k, v, False) for f, k, v in window_forms(s[at : at + size])]
        if s and len(s) == size and s[0][1] == 0 and s[0][2] and sum(k == 0 for _, k, _ in s) >= 4:
            named = [(s[0][0], 3, True), *s[1:]]
            cut.append((i, 0, size, 0, tuple(k if k else w for w, k, _ in named), [(o, k, w) for o, (w, k, _) in enumerate(named) if k], False))
    found, by_key = defaultdict(set), defaultdict(list)
    for c in cut:
        by_key[c[2], c[4]].append(c)
    for d, text in texts:
        s = slotted(text)
        for size in {c[2] for c in cut}:
            for at in range(len(s) - size + 1):
                forms = list(window_forms(s[at : at + size])) if size >= 4 else [(2, tuple(w for w, *_ in s[at : at + size]), [])]
                for f, k, v in forms:
                    for i, item_at, _, g, _, slots, whole_only in by_key[size, k]:
                        if not whole_only or len(s) == size:
                            found[d, i, at - item_at].add((at, size, int(max(f, g) > 0), tuple((at + o, kind, a, b) for (o, kind, a), (_, _, b) in zip(slots, v, strict=False)), any(kind == 3 for _, kind, _ in slots)))
    out = {}
    for where, matches in found.items():
        sets, any_of = ({}, {}), [False, False]
        for at, size, form, slots, names in matches:
            if form and any(m[:3] == (at, size, 0) for m in matches):
                continue
            any_of[form] = True
            for k in (1,) if form else (0,) if names else (0, 1):
                sets[k].update({p: (kind, a, b) for p, kind, a, b in slots})
        one_to_one = lambda v: len({(k, a) for k, a, _ in v}) == len({(k, b) for k, _, b in v}) == len(set(v))
        out[where] = any(any_of[k] and one_to_one(list(sets[k].values())) for k in (0, 1))
    return out


def test_leaks_against_all_pairs_of_windows(spark, make):
    """Both ways: verbatim and re-parameterised copies, broken slots, parts, other case, values only, noise."""
    rng = random.Random(31)
    names, nouns = "Alice Bob Carla Dmitri Elena Farid".split(), "apples books cards drums eggs flags".split()
    filler = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]

    def question(k):
        r = random.Random(k)
        who, other = "{A}", "{B}"
        stem = [f"On day {{n}}, {who} gave {{m}} {r.choice(nouns)} and {{p}} km of {r.choice(filler)} to {other} who", f"then {who} and {other} took {{m}} {r.choice(nouns)} back in {{p}} hours.", f"How many {r.choice(nouns)} does {who} hold after {{n}} {r.choice(filler)} turns?"]
        return " ".join(stem[: r.randint(1, 3)] + r.choices(filler, k=r.randint(0, 6)))

    def filled(q, r):
        a, b = r.sample(names, 2)
        n, m, p = r.sample(range(2, 99), 3)
        return q.replace("{A}", a).replace("{B}", b).replace("{n}", str(n)).replace("{m}", str(m)).replace("{p}", str(p))

    items = [(k, filled(question(k), random.Random(1000 + k))) for k in range(12)] + [(50, "Add 4 and 5"), (51, "7 8"), (52, "1 2 3 4 5 6 7 8 9 10 11"), (53, None), (54, "")]
    texts = []
    for d in range(150):
        k = rng.randrange(12)
        body = rng.choice([items[k][1], filled(question(k), rng), filled(question(k), rng)])
        change = rng.randrange(7)
        if change == 0:  # one value no longer the same everywhere
            body = re.sub(r"[0-9]+", lambda m: str(rng.randrange(2, 9)), body)
        elif change == 1:
            body = rng.choice([body.lower(), body.upper()])
        elif change == 2:
            w = body.split()
            body = " ".join(w[rng.randrange(len(w) // 2) :])
        elif change == 3:
            body = body.replace(rng.choice(names), rng.choice(names))
        texts.append((d, " ".join(rng.choices(filler, k=rng.randint(0, 9))) + rng.choice([". ", "\n", " "]) + body + " " + " ".join(rng.choices(filler, k=rng.randint(0, 9)))))
    texts += [(900, "add 4 and 5"), (901, "so Add 4 and 5 now"), (902, "7 8"), (903, "7 8 9"), (904, "0 1 2 3 4 5 6 7 8 9 10 11 12"), (905, None), (906, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(make(texts), bench).collect()
    got = {(r["doc_id"], r["item_id"], r["diagonal"]): r["consistent"] for r in rows}
    want = all_leaks(texts, items)
    assert got == want and len(rows) == len(got)
    assert sum(want.values()) > 60 and sum(not v for v in want.values()) > 10
    again = {d for d, text in texts for i, t in items if t and t not in (text or "")} & {d for (d, _, _), v in want.items() if v}
    assert len(again) > 30  # found though no verbatim copy


def test_every_planted_passage_is_found(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    norm = lambda t: " ".join(x for x in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for w in t.split()) if x)
    want = {(r["doc_id"], i["item_id"]) for r in docs for i in items if norm(i["text"]) in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_template_decontamination"](spark, d).collect()}
    assert want and want <= got


def test_bit_table_gives_the_same_pairs(spark, make, monkeypatch):
    item = " ".join(f"word{chr(97 + i)}" for i in range(20))
    docs, bench = make([(1, "x " + item), (2, "y " * 40)]), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", 0)
    assert want and sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want


# --- 10: mixing ------------------------------------------------------------------------------------


def test_targets_refill():
    sizes = {"a": 10, "b": 1000, "c": 1000}
    t = mixing.share_targets(sizes, {"a": 5, "b": 2, "c": 1}, 2010.0, 3.0)
    assert t == {"a": 30.0, "b": 1320.0, "c": 660.0}
    assert mixing.share_targets({"a": 0}, {"a": 5}, 0.0, 3.0) == {"a": 0.0}


def test_mix_meets_targets(make):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 400])), rng.choice(["é", "b", "a", None, "B"])) for i in range(1500)]
    got = mixing.mix(make(rows)).collect()
    again = mixing.mix(make(rows).repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    order = ["B", "a", "b", "é", None]
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in order}
    want = mixing.share_targets(sizes, dict(zip(order, (5, 2, 1, 5, 2), strict=True)), sum(sizes.values()), 3.0)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["target"] for r in own} == {want[s]} and {r["source_size"] for r in own} == {sizes[s]}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 5


def test_newton_reaches_the_tilt(spark):
    cells = spark.createDataFrame([("a", 100), ("a", 50), ("b", 1000), (None, 10), ("c", 7), ("d", 9)], "source string, tokens long")
    (lam,) = mixing.balance(cells, ["source"], [{"a": 450.0, "b": 5.0, None: 10.0, "z": 3.0, "d": 0.0}])
    assert np.isclose(np.exp(lam["a"]), 3.0) and np.isclose(np.exp(lam["b"]), 0.005) and np.isclose(np.exp(lam[None]), 1.0) and lam["z"] == lam["d"] == -np.inf and "c" not in lam


def test_overlapping_constraints_against_iterative_fitting(spark):
    """Source, language and length class at once: the raked table of iterative proportional fitting is the same."""
    rng = np.random.default_rng(17)
    table = rng.integers(1, 500, (4, 3, 3)).astype(float)
    goals = [rng.dirichlet(np.ones(n) * 5) * table.sum() for n in table.shape]
    raked = table.copy()
    for _ in range(2000):
        for axis, goal in enumerate(goals):
            now = raked.sum(axis=tuple(k for k in range(3) if k != axis))
            raked *= (goal / now).reshape([-1 if k == axis else 1 for k in range(3)])
    rows = [(f"s{i}", f"l{j}", f"c{k}", int(table[i, j, k])) for i in range(4) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, size string, tokens long")
    lam = mixing.balance(cells, ["source", "lang", "size"], [{f"{p}{n}": float(x) for n, x in enumerate(goal)} for p, goal in zip("slc", goals, strict=True)])
    got = np.array([[[table[i, j, k] * np.exp(lam[0][f"s{i}"] + lam[1][f"l{j}"] + lam[2][f"c{k}"]) for k in range(3)] for j in range(3)] for i in range(4)])
    assert np.allclose(got, raked, rtol=1e-6)


def test_mix_under_further_constraints(spark, make):
    rng = random.Random(10)
    docs = make([(i, " ".join(["w"] * rng.choice([1, 5, 30, 80])), rng.choice("ab")) for i in range(3000)]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    got = mixing.mix(docs, also={"lang": {"de": 0.5, "en": 0.5}}, cap=5.0).join(docs.select("doc_id", "lang"), "doc_id").collect()
    total = sum(r["size"] for r in got)
    for of, want in ((lambda r: r["lang"], {"de": total / 2, "en": total / 2}), (lambda r: r["source"], {"a": total * 5 / 7, "b": total * 2 / 7})):
        for v, goal in want.items():
            assert abs(sum(r["taken"] for r in got if of(r) == v) - goal) < 0.02 * total
