"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text. The method looks across documents: the lines of each text are normalised and hashed, each host (the
column `source`) counts the distinct documents that a line occurs in, lines in more than LINE_DOCS of them are taken out, and a document
that is left with too little is rejected. Documents of equal text are one document here, so a document isn't rejected for having copies
(near-duplicate removal is another operator's job).

The lines of all texts are written once, without the texts: their counts and their verdicts both come from there. Counts are combined before the
shuffle. Verdicts reach the lines in a join whose small side, the frequent lines, is repeated for each of SALTS parts of a line's documents; as
a frequent line has more than LINE_DOCS documents, that never outgrows the other side, and a line that a third of all documents bear is no one
task's. Texts are shuffled only where lines are taken out of them.

Null or empty texts have no words and fail the base rules; a null source is a host of its own; repeated rows are judged alike; a line in exactly
LINE_DOCS documents stays, as does a document left with exactly MIN_WORDS words or KEEP_SHARE of its own; texts are read whole at any length; null
doc_ids are kept; other columns, of whatever name, are ignored by `judge` and kept by `keep_good`; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import bucket, checkpointed, text_key

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line is frequent in more documents of its host than this; a document must keep this share of its words.
LINE_DOCS, KEEP_SHARE = 10, 0.3
#: Parts of a line's documents.
SALTS = 16

_SPACE = r"[\x20\x09-\x0D]+"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _once(value: Column) -> Column:
    """value, in a form that the optimizer doesn't copy into filters above, where each copy would be computed again."""
    return F.when(F.rand(0) + 1 >= 1, value)


def base_rules(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, host) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    out = rows.withColumn("_w", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "_l": lines,
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
    })
    h = F.col("_h")
    window = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))
    out = out.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    out = out.withColumn("_win", F.when(F.size(h) >= WINDOW, F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), window)))
    # most texts repeat no window, which a hash set tells cheaply; only the others are sorted
    out = out.withColumn("_s", _once(F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))))
    s = F.col("_s")
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
    twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    out = out.withColumn("base_failed", _once((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))
    return out.drop("_w", "_l", "_h", "_win", "_s", "_p")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]{2,}|[\x09\x0B-\x0D]", " "))


def _lines(rows: DataFrame) -> DataFrame:
    """k0, k1, host, n_words, and for each distinct line of a text: line (hash) and words (in all its occurrences)."""
    out = rows.select(*text_key(), "host", F.filter(F.transform(F.split("text", "\n", -1), _normal), lambda x: x != "").alias("_l"))
    out = out.withColumn("_a", F.transform("_l", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("long").alias("w"))))
    out = out.withColumn("n_words", F.aggregate("_a", F.lit(0).cast("long"), lambda n, x: n + x["w"])).withColumn("_s", F.sort_array("_a"))
    s = F.col("_s")
    at = F.transform(s, lambda x, i: F.struct(i.alias("i"), x["h"].alias("h"), x["w"].alias("w")))
    out = out.withColumn("_f", F.filter(at, lambda x: (x["i"] == 0) | (x["h"] != F.coalesce(F.get(s, x["i"] - 1)["h"], F.lit(0)))))
    first = F.col("_f")
    until = lambda j: F.coalesce(F.get(first, j + 1)["i"], F.size(s))
    entries = F.transform(first, lambda x, j: F.struct(x["h"].alias("line"), ((until(j) - x["i"]) * x["w"]).alias("words")))
    out = out.select("k0", "k1", "host", "n_words", _once(entries).alias("_e"))
    return out.select("k0", "k1", "host", "n_words", F.explode("_e").alias("x")).select("k0", "k1", "host", "n_words", "x.*")


def frequent_lines(lines: DataFrame) -> DataFrame:
    """host, line: what is in more than LINE_DOCS documents of its host, those of equal text being one."""
    by_text = lines.select("host", "line", "k1").distinct()
    return by_text.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > LINE_DOCS).select("host", "line")


def depletion(rows: DataFrame) -> DataFrame:
    """For each document with frequent lines: k0, k1, host, gone (those lines), n_frequent (its words in them), depleted (whether too little is left)."""
    lines = checkpointed(_lines(rows))
    often = frequent_lines(lines).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = lines.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(often, ["host", "line", "salt"])
    # rows that are the same document twice have each line twice
    each = hits.groupBy("k0", "k1", "host").agg(F.sum("words").alias("s"), F.count("*").alias("rows"), F.collect_set("line").alias("gone"), F.max("n_words").alias("n"))
    each = each.withColumn("n_frequent", (F.col("s") * F.size("gone") / F.col("rows")).cast("long"))
    left = F.col("n") - F.col("n_frequent")
    return each.select("k0", "k1", "host", "gone", "n_frequent", ((left < MIN_WORDS) | (left < KEEP_SHARE * F.col("n"))).alias("depleted"))


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, n_frequent, kept."""
    rows = _rows(docs)
    base = base_rules(rows).select(*text_key(), "host", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = base.join(depletion(rows).drop("gone"), ["k0", "k1", "host"], "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.coalesce("n_frequent", F.lit(0).cast("long")).alias("n_frequent"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns and without the frequent lines of their texts; n_chars, if there, counts the new text.
    Texts without a frequent line stay as they are, and are not shuffled."""
    marks = checkpointed(depletion(_rows(docs)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), *text_key(), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    good = base_rules(rows).where("not base_failed").select("row", "k0", "k1", "host", "text")
    buckets = F.broadcast(marks.select(bucket("k0", "k1").alias("_b")).distinct())
    own = bucket(good["k0"], good["k1"]) == F.col("_b")
    whole = good.join(buckets, own, "left_anti").select("row.*")
    asked = good.join(buckets, own, "left_semi").join(marks, ["k0", "k1", "host"], "left").where("not coalesce(depleted, false)")
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("gone", F.xxhash64(_normal(x))))
    cut = asked.withColumn("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return whole.unionAll(cut.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
