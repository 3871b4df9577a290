"""Line dedup by a log-template tree, in DataFrame functions only.

Each line is masked: words (between white space, which becomes one blank) that
hold a digit become ``<*>``.
The tree has a fixed depth: a line goes to the leaf of its word count and its
first ``lead`` masked words.  In a leaf, masked lines that agree with the leaf's
most widespread line in a share ``alike`` of their places generalise to one
template, differing places being variable fields; the rest join the widespread one among
themselves, and so on until none is left.  The first ``PASSES`` turns are joins,
in which every line meets one line.  What is left then goes on in finer buckets:
the places are dealt into pieces, one more than may differ, so lines that agree
share a piece.  Each turn takes the ``HUBS`` widest lines of every bucket; those
that agree with no wider line are templates, and take the lines that agree with
them.  Turns go on until no bucket holds two lines.  No group is ever gathered
but for the hubs of a bucket.

With ``inline`` the sentences of ``LONG_WORDS`` words and more inside the lines go
into the tree beside the lines, so that a passage that starts and ends inside
lines is cut too, but for the parts of sentences at its ends.

A template that recurs across documents is kept in the document with the
smallest id and dropped elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, join_counted

LEAD, ALIKE, PASSES = 3, 0.8, 2
#: Lines of a bucket that a later turn compares the others with.
HUBS = 8
#: Characters of a hot leaf's top line up to which it is broadcast (a thousand of them at most).
HOT_CHARS = 5_000
#: Long lines recur from two documents on; short ones, which may agree by chance, from more. Shorter ones are left alone.
LONG_WORDS, LONG_DOCS, SHORT_WORDS, SHORT_DOCS = 10, 2, 3, 5
#: Lines of fewer words than short ones (scripts without blanks, paths) have a word for so many characters.
WORD_CHARS = 6
#: Where a line is cut into sentences; nothing is lost at a cut.
SENTENCE_END = r"(?<=[.!?])(?=[\x20\t\x0B\f\r])|(?<=[\u3002\uFF01\uFF1F])"


def uneven(text: Column) -> Column:
    """Whether a text has white space other than single blanks and line ends; plain searches, as nearly all texts have none."""
    found = F.lit(False)
    for mark in ("  ", "\t", "\x0b", "\f", "\r"):
        found = found | F.contains(text, F.lit(mark))
    return found


def masked(line: Column, odd: Column | None = None) -> Column:
    """The masked line; ``odd``: whether its text is ``uneven`` (null: the line says so itself)."""
    # any white space counts as one blank
    even = F.trim(F.when(uneven(line) if odd is None else odd, F.regexp_replace(line, r"[\x20\t\x0B\f\r]+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(even, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(even)


def key(text: Column) -> Column:
    return F.xxhash64(text)


def leaf(words: Column, lead: int) -> Column:
    return F.xxhash64(F.size(words), F.slice(words, 1, lead))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later filters use by name: pushed below a plain projection, they would compute it again and again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def last_turns(scratch: Scratch, left: DataFrame, lead: int, alike: float) -> DataFrame | None:
    """line, leaf, template of the lines of ``left`` that join another one of their leaf; None if none does."""
    need = F.ceil(F.lit(alike) * F.col("n")).cast("int")
    # wider lines have smaller ranks
    rank = F.struct((-F.col("docs")).alias("k"), "doc", "line")
    live = left.select("leaf", "line", "n", need.alias("need"), rank.alias("rank"), F.transform(F.split("m", " ", -1), lambda w: F.xxhash64(w)).alias("w"))
    # the first places are the leaf's; of one piece more than places that may differ, one is the same in both lines
    pieces = F.col("n") - F.col("need") + 1
    dealt = lambda p: F.xxhash64(p, F.filter(F.slice("w", lead + 1, F.greatest(F.col("n") - lead, F.lit(0))), lambda _, i: i % pieces == p))
    merged = None
    while True:
        parts = live.select("leaf", "rank", "need", "w", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("need")), dealt)).alias("piece"))
        shared = parts.groupBy("leaf", "piece").agg(F.min("rank").alias("x"), F.max("rank").alias("y")).where("x <> y").select("leaf", "piece")
        parts = scratch.save(parts.join(shared, ["leaf", "piece"], "left_semi"), "parts")
        if parts.isEmpty():
            return merged
        place = F.row_number().over(Window.partitionBy("leaf", "piece").orderBy("rank"))
        first = parts.select("leaf", "piece", "rank", "w").withColumn("place", place).where(F.col("place") <= HUBS)
        hubs = first.groupBy("leaf", "piece").agg(F.collect_list(F.struct("rank", "w")).alias("hubs"))
        same = lambda h: F.size(F.filter(F.zip_with("w", h["w"], lambda a, b: a == b), lambda e: e)) >= F.col("need")
        wider = F.transform(F.filter("hubs", lambda h: (h["rank"] < F.col("rank")) & same(h)), lambda h: h["rank"])
        met = parts.join(hubs, ["leaf", "piece"]).select("leaf", "rank", F.exists("hubs", lambda h: h["rank"] == F.col("rank")).alias("is_hub"), wider.alias("wider"))
        # a template is a hub of all its buckets that agrees with no wider line
        seen = scratch.save(met.groupBy("leaf", "rank").agg(F.bool_and(F.col("is_hub") & (F.size("wider") == 0)).alias("free"), F.array_distinct(F.flatten(F.collect_list("wider"))).alias("wider")), "seen")
        free = seen.where("free").select("leaf", F.col("rank").alias("hub"))
        found = seen.where("NOT free").select("leaf", "rank", F.explode("wider").alias("hub")).join(free, ["leaf", "hub"]).groupBy("leaf", "rank").agg(F.min("hub").alias("hub"))
        found = scratch.save(found.select("leaf", "rank", "hub"), "found")
        joined = found.select(F.col("rank.line").alias("line"), "leaf", F.col("hub.line").alias("template"))
        merged = joined if merged is None else merged.union(joined)
        going = seen.where("NOT free").select("leaf", "rank").join(found.select("leaf", "rank"), ["leaf", "rank"], "left_anti")
        old, live = live, scratch.save(live.join(going, ["leaf", "rank"], "left_semi").select("leaf", "line", "n", "need", "rank", "w"), "live")
        scratch.drop(old, parts, seen)


def drop_recurring(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lead: int = LEAD,
    alike: float = ALIKE,
    passes: int = PASSES,
    long_words: int = LONG_WORDS,
    long_docs: int = LONG_DOCS,
    short_words: int = SHORT_WORDS,
    short_docs: int = SHORT_DOCS,
    inline: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with recurring lines cut out of the text.

    Returns __row (a struct of the row's own columns), text and n_dropped.  A
    line of at least ``long_words`` words (of ``WORD_CHARS`` characters each, if
    it has fewer than ``short_words``) recurs if its template stands in
    ``long_docs`` documents, one of at least ``short_words`` words if in
    ``short_docs``; other lines stay.  The document with the smallest id keeps
    the template's lines.  With ``inline`` the same holds for sentences of
    ``long_words`` words inside the lines that stay, and n_dropped counts them
    too.  Rows of one id are one document; rows without an id
    count for no template, and lose the lines of recurring ones.  Null texts stay null and
    empty ones empty.  No limit on the length of texts or lines.  Repeated rows
    are cut alike, columns of any name pass in __row, an empty table gives no
    rows.  Ids are integers; a text id that is no number stops the run.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    sentences = lambda x: F.split(x, SENTENCE_END, -1)
    odd = F.col("odd")
    long = lambda x: F.size(F.split(masked(x, odd), " ", -1)) >= long_words

    def cut_up(rows: DataFrame) -> DataFrame:
        """doc, own, m and w of every line and, inline, of every long sentence of lines that have several; computed once each."""
        lines = F.split("text", "\n", -1)
        units = lines
        if inline:
            several = F.flatten(F.filter(F.transform(lines, sentences), lambda x: F.size(x) > 1))
            part = lambda x, inner: F.struct(x.alias("line"), F.lit(inner).alias("inner"))
            units = F.concat(F.transform(lines, lambda x: part(x, False)), F.transform(several, lambda x: part(x, True)))
        found = rows.select("doc", "own", "odd", F.explode(units).alias("unit"))
        line = F.col("unit.line") if inline else F.col("unit")
        found = once(found, "m", masked(line, odd))
        found = once(found.select("doc", "own", "m", *([F.col("unit.inner").alias("inner")] if inline else [])), "w", F.split("m", " ", -1))
        return found.where(~F.col("inner") | (F.size("w") >= long_words)).drop("inner") if inline else found

    base = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # rows without an id are told apart by their text, so that they are no group of their own
    base = base.withColumn("own", F.when(F.col("doc").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).withColumn("odd", uneven(F.col("text")))
    cut = cut_up(base)
    # lines of few words count by characters
    by_chars = F.floor(F.length("m") / WORD_CHARS).cast("int")
    cut = cut.withColumn("n", F.when(F.size("w") < short_words, F.greatest(F.size("w"), by_chars)).otherwise(F.size("w"))).where(F.col("n") >= short_words)
    lines = scratch.save(cut.select("doc", "own", key(F.col("m")).alias("line"), leaf(F.col("w"), lead).alias("leaf"), "n", F.size("w").alias("places")).distinct(), "lines")
    known = lines.where("doc IS NOT NULL")
    of_line = scratch.save(known.groupBy("line", "leaf", "n", "places").agg(F.count("*").alias("docs"), F.min("doc").alias("owner")), "of_line")

    # variable fields beyond digits: lines of one leaf that agree in most places
    many = of_line.where(F.col("places") > F.ceil(F.lit(alike) * F.col("places"))).groupBy("leaf").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("leaf")
    near = of_line.join(many, "leaf", "left_semi")
    owners = near.select(F.col("owner").alias("doc")).distinct()
    texts = cut_up(base.join(owners, "doc", "left_semi")).select("doc", "m")
    texts = texts.withColumn("line", key(F.col("m"))).join(near.select("line", F.col("owner").alias("doc"), "leaf", "docs", "n"), ["line", "doc"])
    left = scratch.save(texts.groupBy("line", "leaf", "docs", "doc", "n").agg(F.min("m").alias("m")), "near")
    merged = None
    for _ in range(passes):
        top = left.groupBy("leaf").agg(F.min(F.struct((-F.col("docs")).alias("k"), "doc", "m", "line")).alias("t"), F.count("*").alias("rows_of_key"))
        top = top.select("leaf", F.col("t.line").alias("template"), F.col("t.m").alias("tm"), "rows_of_key")
        same = F.size(F.filter(F.zip_with(F.split("m", " ", -1), F.split("tm", " ", -1), lambda a, b: a == b), lambda x: x))
        met = join_counted(left, top, ["leaf"], left.count(), "inner", F.length("tm") <= HOT_CHARS)
        tried = scratch.save(met.withColumn("same", same >= F.ceil(F.lit(alike) * F.col("n"))), "tried")
        found = tried.where("same AND line <> template").select("line", "leaf", "template")
        merged = found if merged is None else merged.union(found)
        left = tried.where("NOT same").select("line", "leaf", "docs", "doc", "n", "m")
    rest = last_turns(scratch, left, lead, alike)
    merged = rest if merged is None else merged if rest is None else merged.union(rest)

    # a line is told by its leaf and its key, 128 bits together
    placed = lines if merged is None else lines.join(merged, ["line", "leaf"], "left")
    placed = placed.select("doc", "own", "line", "leaf", "n", (F.col("line") if merged is None else F.coalesce("template", "line")).alias("template"))
    counts = placed.where("doc IS NOT NULL").select("doc", "leaf", "template", "n").distinct().groupBy("leaf", "template", "n").agg(F.count("*").alias("docs"), F.min("doc").alias("owner"))
    recurring = counts.where(((F.col("n") >= long_words) & (F.col("docs") >= long_docs)) | (F.col("docs") >= short_docs)).select("leaf", "template", "owner")
    drops = placed.join(recurring, ["leaf", "template"]).where(F.col("doc").isNull() | (F.col("doc") != F.col("owner")))
    drops = drops.groupBy(F.col("doc").alias("d"), F.col("own").alias("o")).agg(F.collect_set("line").alias("gone"))
    joined = base.join(drops, F.col("doc").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o")), "left")
    all_lines = F.split("text", "\n", -1)
    stays = lambda x: ~F.array_contains(F.col("gone"), key(masked(x, odd)))
    kept = F.filter(all_lines, stays)
    out = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).withColumn("n_dropped", F.size(all_lines) - F.size("kept"))
    if inline:
        parts = F.transform("kept", lambda x: F.struct(x.alias("line"), F.size(sentences(x)).alias("n"), F.filter(sentences(x), lambda y: ~long(y) | stays(y)).alias("left")))
        out = out.withColumn("parts", F.filter(parts, lambda x: x["n"] > 0))
        out = out.withColumn("n_dropped", F.col("n_dropped") + F.aggregate("parts", F.lit(0), lambda k, x: k + x["n"] - F.size(x["left"])))
        out = out.withColumn("kept", F.transform(F.filter("parts", lambda x: F.size(x["left"]) > 0), lambda x: F.when(x["n"] == F.size(x["left"]), x["line"]).otherwise(F.trim(F.array_join(x["left"], "")))))
    text = F.when(F.col("gone").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return out.select("__row", text.alias("text"), F.when(F.col("gone").isNotNull(), F.col("n_dropped")).otherwise(0).cast("long").alias("n_dropped"))


def sql(table: str = "documents") -> str:
    """DuckDB SQL of ``drop_recurring`` with default parameters: doc_id, n_dropped, text."""
    mask = r"regexp_replace(trim({0}), '[^ ]*[0-9][^ ]*', '<*>', 'g')".format
    passes = []
    for k in range(PASSES):
        source = "near" if k == 0 else f"rest{k - 1}"
        passes.append(f"""
top{k} AS (SELECT leaf, line AS template FROM {source} QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY docs DESC, doc, line) = 1),
tried{k} AS (SELECT s.*, t.template, len(list_filter(list_zip(string_split(s.line, ' '), string_split(t.template, ' ')), lambda x: x[1] = x[2])) >= ceil({ALIKE} * s.n) AS same FROM {source} s JOIN top{k} t USING (leaf)),
rest{k} AS (SELECT line, leaf, docs, doc, n FROM tried{k} WHERE NOT same)""")
    merged = " UNION ALL ".join(f"SELECT line, template FROM tried{k} WHERE same AND line <> template" for k in range(PASSES))
    return f"""
WITH cut AS (SELECT doc_id AS doc, {mask('line')} AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {table})),
lines AS (SELECT DISTINCT doc, m AS line, CAST(n AS VARCHAR) || '|' || array_to_string(w[1:{LEAD}], ' ') AS leaf, n
  FROM (SELECT doc, m, string_split(m, ' ') AS w, len(string_split(m, ' ')) AS n FROM cut) WHERE n >= {SHORT_WORDS}),
of_line AS (SELECT line, leaf, n, count(DISTINCT doc) AS docs, min(doc) AS doc FROM lines GROUP BY ALL),
near AS (SELECT * FROM of_line WHERE leaf IN (SELECT leaf FROM of_line WHERE n >= {LONG_WORDS} GROUP BY leaf HAVING min(line) <> max(line))),
{','.join(passes)},
merged AS ({merged}),
placed AS (SELECT doc, l.line, n, coalesce(template, l.line) AS template FROM lines l LEFT JOIN merged g ON l.line = g.line),
recurring AS (SELECT template, min(doc) AS owner FROM placed GROUP BY template, n
  HAVING (n >= {LONG_WORDS} AND count(DISTINCT doc) >= {LONG_DOCS}) OR count(DISTINCT doc) >= {SHORT_DOCS}),
drops AS (SELECT doc, list(DISTINCT line) AS gone FROM placed JOIN recurring USING (template) WHERE doc <> owner GROUP BY doc),
done AS (SELECT d.doc_id, d.text, gone, CASE WHEN gone IS NOT NULL THEN list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(gone, {mask('x')})) END AS kept
  FROM {table} d LEFT JOIN drops ON d.doc_id = drops.doc)
SELECT doc_id, CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - len(kept) END AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text FROM done"""
