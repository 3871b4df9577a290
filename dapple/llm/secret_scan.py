"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are known key formats (a private key with its whole body), values
assigned to a telling name, and long tokens of mixed characters.  Each is
described by its length, its character transitions (how much likelier they are
in secrets than in other findings, by transition counts of labelled findings),
how much of it dictionary words cover, its path and its neighbouring words (both
hashed into a few counts).  Transitions and forest are trained from labelled
findings.  The findings that ship with it are made by rule from a seed
(``labelled_findings``): keys, tokens and passwords as secrets; digests in
checksum context, UUIDs, placeholders, identifiers, versions and prose as false
positives.  A caller's own labelled findings can replace or extend them.
"""

from __future__ import annotations

import bisect
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Names whose assigned values may be secrets; words that speak against a secret.
NAMES = "token secret password passwd pwd apikey api_key api-key access_key secret_key private_key client_secret auth credential bearer"
CONTRARY = "sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid version example sample dummy placeholder test fixture your changeme"
#: Frequent words and name parts that a real key rarely spells.
DICTIONARY = "the and for with this that from your have not are was will example sample test demo dummy placeholder change changeme insert here value key name user admin default secret password token string none null true false http https www com org net file path home config setting data base table index version release build page image class function return import public private static client server service account access login letter word hello world welcome please enter type text number"
#: Formats of known keys, each with strings of which its keys hold one.
PATTERNS = (
    ("private_key", ("PRIVATE KEY-----",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]{1,20000}-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    ("cloud_key", ("AKIA", "ASIA"), r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-"), r"\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bglpat-[A-Za-z0-9_-]{20,}"),
    ("chat_token", ("xox",), r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("web_token", ("eyJ",), r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
_FINDERS = [(k, marks, re.compile(p)) for k, marks, p in PATTERNS]
#: What stands around the sign of an assignment: a telling name before it, a value after it.
_SIGN = re.compile(r"[=:]+>?")
_TELLING = re.compile(r"(?i)(?:" + "|".join(re.escape(n) for n in NAMES.split()) + r")[\"']?\s{0,3}$")
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"'<>,;]{6,})")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NAME = re.compile("(?i)" + "|".join(re.escape(n) for n in NAMES.split()))
_CONTRARY = re.compile("(?i)\\b(?:" + "|".join(CONTRARY.split()) + ")\\b")
_SAMPLE_PATH = re.compile(r"(?i)(test|example|sample|fixture|mock|doc)")
_WORDS = tuple(sorted((w for w in DICTIONARY.split() if len(w) > 3), key=len, reverse=True))
_COVER = re.compile("|".join(_WORDS))
FEATURES = ("length", "entropy", "letters", "digits", "marks", "upper", "class changes", "digit letter changes", "hex", "distinct", "longest run", "vowels", "dictionary", "repeats", "name before", "contrary near", "sample path", "assigned", "known format", "uuid", "words around", "transitions")
#: Counts of hashed words before and after a candidate, and of hashed parts of its path.
NEAR, PARTS = 16, 8
_WORD = re.compile(r"[^\W\d_]{2,}")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")


def _hashed(words: list[str], size: int) -> list[float]:
    out = [0.0] * size
    for w in words:
        out[zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % size] += 1
    return out


def _codes(value: str) -> np.ndarray:
    return np.clip(np.frombuffer(value.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64) - 32, 0, 95)


def transitions(values: list[str], y: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log ratio of each character transition's shares among the values labelled 1 and the others."""
    counts = np.full((2, 96, 96), smooth)
    for value, label in zip(values, y, strict=True):
        c = _codes(value)
        np.add.at(counts[int(label)], (c[:-1], c[1:]), 1)
    share = np.log(counts / counts.sum(axis=2, keepdims=True))
    return share[1] - share[0]


def describe(kind: str, value: str, before: str, after: str, path: str, table: np.ndarray) -> list[float]:
    """Numbers that describe a candidate: what ``FEATURES`` names, then hashed words around it and hashed parts of the path."""
    c = _codes(value)
    n = max(1, len(value))
    codes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    counts = np.unique(list(value), return_counts=True)[1] if value else np.array([1])
    p = counts / counts.sum()
    changes = sum(a != b for a, b in zip(codes, codes[1:], strict=False))
    mixed = sum((a == 2) != (b == 2) for a, b in zip(codes, codes[1:], strict=False))
    runs = re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", value)
    low = value.lower()
    return [
        float(len(value)),
        float(-(p * np.log2(p)).sum()),
        sum(c < 2 for c in codes) / n,
        codes.count(2) / n,
        codes.count(3) / n,
        codes.count(1) / n,
        changes / n,
        mixed / n,
        sum(c in "0123456789abcdef" for c in low) / n,
        len(set(value)) / n,
        max((len(r) for r in runs), default=0) / n,
        sum(c in "aeiou" for c in low) / n,
        sum(len(m) for m in _COVER.findall(low)) / n,
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        float(bool(_NAME.search(before[-24:]))),
        float(bool(_CONTRARY.search(before[-40:] + " " + after[:20]))),
        float(bool(_SAMPLE_PATH.search(path))),
        float(kind == "assigned"),
        float(kind not in ("assigned", "mixed")),
        float(bool(_UUID.match(value))),
        float(len(re.findall(r"[A-Za-z]{3,}", before[-60:]))),
        float(table[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0,
        *_hashed(_WORD.findall(before[-60:])[-3:] + _WORD.findall(after[:40])[:2], NEAR),
        *_hashed(_WORD.findall(path), PARTS),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of each candidate of a whole text; of two that overlap, known formats win, then assigned values."""
    found: list[tuple[str, int, int]] = []
    for kind, marks, finder in _FINDERS:
        if any(m in text for m in marks):
            found += [(kind, *m.span()) for m in finder.finditer(text)]
    for m in _SIGN.finditer(text):
        value = _VALUE.match(text, m.end())
        if value and _TELLING.search(text[max(0, m.start() - 24) : m.start()]):
            a, b = value.span(1)
            while b > a and text[b - 1] in ").]}":
                b -= 1
            found.append(("assigned", a, b))
    for m in _LONG.finditer(text):
        value = m[0].rstrip("=").lstrip("=")
        if len(value) >= 20 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            a = m.start() + len(m[0]) - len(m[0].lstrip("="))
            found.append(("mixed", a, a + len(value)))
    out = []
    order = {k: i for i, k in enumerate([*(k for k, _, _ in PATTERNS), "assigned", "mixed"])}
    taken: list[tuple[int, int]] = []
    for kind, a, b in sorted(found, key=lambda c: (order[c[0]], c[1])):
        at = bisect.bisect(taken, (a, b))
        if b - a >= 6 and (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda c: c[1])


def labelled_findings(n: int = 6000, seed: int = 4, part: int | None = None) -> tuple[list[tuple[str, str, str, str, str]], np.ndarray]:
    """Findings (kind, value, text before, text after, path) made by rule and their labels (1: a secret); the same for one seed.

    ``part`` 0 or 1 takes every other dictionary word, name and contrary word only, so that findings of
    both parts share none.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    one = lambda s: s[rng.integers(0, len(s))]
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    words, names, contrary = (text.split() if part is None else text.split()[part::2] for text in (DICTIONARY, NAMES, CONTRARY))
    prose = lambda k: " ".join(pick(string.ascii_lowercase, int(rng.integers(2, 9))) for _ in range(k))
    x, y = [], []
    for _ in range(n):
        secret = bool(rng.random() < 0.5)
        lead, tail, path = prose(int(rng.integers(0, 6))), " " + prose(int(rng.integers(0, 4))), one(["src/app", "web", "conf", "notes", "data/part", "", "lib/test", "docs/example"][: None if not secret or rng.random() < 0.1 else 6])
        kind, before = "assigned", f"{lead} {one(names)}{one([' = ', '=', ': '])}" + one(['"', "'", ""])
        if secret:
            form = rng.integers(0, 8)
            if form == 0:
                value = pick(hexes, int(one([18, 24, 32, 40, 64])))
            elif form == 1:
                value = pick(alnum, int(rng.integers(16, 65)))
            elif form == 2:
                value = pick(alnum + "!@#$%^&*", int(rng.integers(10, 20)))
            elif form == 3:
                kind, value, before = "cloud_key", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lead + " "
            elif form == 4:
                kind, value, before = "forge_token", "ghp_" + pick(alnum, 36), lead + " "
            elif form == 5:
                kind, value, before = "web_token", "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum, 43), lead + " "
            elif form == 6:
                kind, value, before = "mixed", pick(alnum + "+/", int(rng.integers(32, 89))), f"{lead} {one(['key', 'credential', 'auth', 'bearer'])} "
            else:
                value = pick(hexes, int(rng.integers(12, 25)))
        else:
            form = rng.integers(0, 8)
            if form == 0:
                kind, value, before = "mixed", pick(hexes, int(one([32, 40, 64]))), f"{lead} {one(contrary)}{one([': ', ' ', '='])}"
            elif form == 1:
                h = pick(hexes, 32)
                kind, value, before = "mixed", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", lead + " "
            elif form == 2:
                value = one(["", "your-", "my_", "<", "$"]) + one(["_", "-"]).join(one(words) for _ in range(int(rng.integers(2, 5))))
            elif form == 3:
                value = one("xX*.0") * int(rng.integers(6, 30))
            elif form == 4:
                kind, value, before = "mixed", "/".join(one(words) for _ in range(int(rng.integers(3, 6)))) + str(rng.integers(0, 99)), lead + " "
            elif form == 5:
                value = one(words) + one(words).title() + one(["", "1", "123", "()"])
            elif form == 6:
                kind, value, before = "mixed", f"{one(words)}_{one(words)}_{one(words)}_{rng.integers(0, 9999)}", lead + " "
            else:
                value = pick(string.ascii_lowercase, int(rng.integers(6, 14)))
        x.append((kind, value, before, tail, path))
        y.append(int(secret))
    return x, np.array(y)


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                here = at[inner]
                at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])
            total += share[at]
        return total / max(1, len(self.trees))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 9) -> Forest:
    """Bagged trees; each split looks at a random third of the features, at up to 32 cut points, for the least Gini impurity."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        nodes: list[list] = []
        stack = [(rng.integers(0, len(x), len(x)), 0, -1, 0)]
        while stack:
            rows, level, parent, side = stack.pop()
            k = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = k
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if level >= depth or len(rows) < 2 * least or share in (0.0, 1.0):
                continue
            best = (1e18, -1, 0.0)
            for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 3)]:
                v = x[rows, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.03, 0.97, 32)))
                low = v[:, None] <= cuts[None, :]
                n_low, p_low = low.sum(0), (low & (y[rows] == 1)[:, None]).sum(0)
                n_high, p_high = len(rows) - n_low, y[rows].sum() - p_low
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = np.where((n_low >= least) & (n_high >= least), p_low * (1 - p_low / n_low) + p_high * (1 - p_high / n_high), 1e18)
                j = int(np.argmin(gini))
                if gini[j] < best[0]:
                    best = (float(gini[j]), int(f), float(cuts[j]))
            if best[1] < 0:
                continue
            nodes[k][:2] = [best[1], best[2]]
            low = x[rows, best[1]] <= best[2]
            stack += [(rows[~low], level + 1, k, 1), (rows[low], level + 1, k, 0)]
        cols = list(zip(*nodes, strict=True))
        grown.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
    return Forest(grown)


@dataclass
class Model:
    """The transition table and the forest of labelled findings."""

    table: np.ndarray
    forest: Forest

    def scores(self, findings: list[tuple[str, str, str, str, str]]) -> np.ndarray:
        return self.forest.scores(np.array([describe(*f, self.table) for f in findings]))


def fit(findings: list[tuple[str, str, str, str, str]], y: np.ndarray) -> Model:
    """Transitions that the forest sees of a finding are counted on the other half, so that it does not trust them too much."""
    half = np.arange(len(y)) % 2
    tables = [transitions([f[1] for f, h in zip(findings, half, strict=True) if h != k], y[half != k]) for k in (0, 1)]
    x = np.array([describe(*f, tables[h]) for f, h in zip(findings, half, strict=True)])
    return Model(transitions([f[1] for f in findings], y), train_forest(x, y))


@lru_cache(maxsize=1)
def own_model() -> Model:
    """The model of the findings that ship with the operator, fitted once a driver."""
    return fit(*labelled_findings())


_SCHEMA = "kind string, start long, end long, value string, score double"


def _scan(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, index = [], [], []
        texts, paths = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        for i, text in enumerate(texts):
            for kind, a, b in candidates(text or ""):
                rows.append((kind, a, b, text[a:b]))
                found.append((kind, text[a:b], text[max(0, a - 80) : a], text[b : b + 40], paths[i] or ""))
                index.append(i)
        if not rows:
            continue
        kept = [c.take(pa.array(index)) for c in batch.columns[:-2]]
        cols = [pa.array(c) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array(model.value.scores(found))], names=[*batch.schema.names[:-2], "kind", "start", "end", "value", "score"])


def scan(docs: DataFrame, *, text_col: str = "text", path_col: str | None = None, keep: tuple[str, ...] = ("doc_id",), findings: tuple[list, np.ndarray] | None = None) -> DataFrame:
    """One row a candidate of every whole text: columns ``keep``, kind, start, end (code points), value and score.

    The score is the forest's share of votes that the candidate is a secret; 0.5
    and more count as secrets.  Candidates are values of at least 6 characters
    whose name ends within 24 characters before the sign, tokens of at least 20
    characters, and the known formats.  Null and empty texts give none; a null
    path is an empty one.  Repeated rows give repeated findings, an empty table
    none; columns that ``keep`` does not name are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(own_model() if findings is None else fit(*findings))
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(*keep, F.col(text_col).alias("__text"), path.alias("__path"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(partial(_scan, model=model), f"{schema}, {_SCHEMA}")
