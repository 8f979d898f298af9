"""Quality rules: per-document counts and the frequency of lines across the documents of a host.

A line is hashed after normalising (lower case, white space squeezed). For every host the distinct documents with
that line are counted; exact copies of a text are one document, since copies are the work of deduplication. A line
above the limit is removed from every document but the first that has it (the smallest id), and a document that loses too many of its
words that way is rejected.

The text is read twice: counts and line hashes go to a table in the shared folder, on which the frequent lines are
found; then the lines to remove are joined to the texts and cut out (``remove_lines``). The verdict is made from the
texts that are left. Columns beginning with ``_ql_`` are reserved.

Null, empty and wordless texts have zero words, so they fail the base rule (fewer than 10 words). Null hosts form one
host. Repeated rows are judged each, as copies of one document. Other columns pass through ``remove_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import SPACE, whole, words
from hopframe.session import materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def document_counts(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One row per document: doc_id, host, text_hash, the counts, and lines (hash and words of each distinct line)."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), whole(text_col).alias("text")) \
        .withColumn("words", words(F.col("text")))
    n = F.size("words")
    windows = F.expr(f"""CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}),
        i -> xxhash64({', '.join(f'words[i + {k}]' for k in range(WINDOW))})) ELSE array() END""")
    counted = split.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("text_lines"),
        windows.alias("windows"))
    # Positions of windows are sorted by hash only where some window occurs twice.
    sorted_windows = counted.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "text_lines",
        (F.size("text_lines") - F.size(F.array_distinct("text_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
                  THEN array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))
                  ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END""").alias("by_hash"))
    repeated = sorted_windows.withColumn("repeated", F.expr("""array_sort(transform(
        filter(by_hash, (s, k) -> (k > 0 AND by_hash[greatest(k - 1, 0)].h = s.h)
            OR (k + 1 < size(by_hash) AND by_hash[least(k + 1, size(by_hash) - 1)].h = s.h)), s -> s.i))"""))
    line_words = F.expr(rf"transform(text_lines, l -> array_remove(split(l, '{SPACE}'), ''))".replace("\\", "\\\\"))
    return repeated.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"""aggregate(repeated, struct(0L AS covered, {-WINDOW} AS last),
            (a, p) -> struct(a.covered + least({WINDOW}, p - a.last) AS covered, p AS last),
            a -> a.covered)""").alias("n_repeat_words"),
        line_words.alias("line_words")) \
        .withColumn("lines", F.expr(
            "transform(line_words, w -> struct(xxhash64(lower(array_join(w, ' '))) AS h, size(w) AS n))")) \
        .drop("line_words")


def _key(doc_id, host, text_hash):
    """Equal for rows that are equal in id, host and text."""
    return F.xxhash64(F.isnull(doc_id), doc_id, F.isnull(host), host, text_hash)


def _cut(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_min_documents: int,
         line_share: float) -> DataFrame:
    """All columns of ``docs`` with the frequent lines cut from the text, and the struct _ql_counts of the counts before."""
    counted = materialize(document_counts(docs, id_col, text_col, host_col)
                          .withColumn("key", _key(F.col("doc_id"), F.col("host"), F.col("text_hash"))), "quality")
    # Rows with one key are equal, so lines are looked at once for all of them.
    lines = counted.select("key", "doc_id", "host", "text_hash", F.explode("lines.h").alias("h")).distinct()
    per_line = lines.groupBy("host", "h", "text_hash").agg(F.min(F.struct("doc_id", "key")).alias("first")) \
        .groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("first").alias("first")) \
        .where(F.col("documents") > line_min_documents)
    hosts = counted.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_documents"))
    frequent = materialize(
        per_line.alias("l").join(hosts.alias("t"), F.expr("l.host <=> t.host"))
        .where(F.col("documents") > line_share * F.col("host_documents"))
        .select("l.host", "h", F.col("first.key").alias("first_key")), "quality-lines")
    # The first of the rows with one key keeps the lines whose first place it is; its copies lose them.
    removed = lines.alias("l").join(frequent.alias("f"), F.expr("l.host <=> f.host AND l.h = f.h")).groupBy("key").agg(
        F.collect_set("l.h").alias("_ql_all"), F.collect_set(F.expr("CASE WHEN key != first_key THEN l.h END")).alias("_ql_others"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    per_key = counted.groupBy("key").agg(F.first(F.struct(*counts)).alias("_ql_counts")).join(removed, "key", "left") \
        .withColumnRenamed("key", "_ql_key")
    joined = docs.withColumn("_ql_key", _key(F.col(id_col), F.col(host_col), F.xxhash64(whole(text_col)))) \
        .join(per_key, "_ql_key") \
        .withColumn("_ql_copy", F.row_number().over(Window.partitionBy("_ql_key").orderBy("_ql_key"))) \
        .withColumn("_ql_cut", F.expr("CASE WHEN _ql_copy = 1 THEN _ql_others ELSE _ql_all END"))
    line_hash = f"xxhash64(lower(array_join(array_remove(split(l, '{SPACE}'), ''), ' ')))".replace("\\", "\\\\")
    left = F.expr(rf"""CASE WHEN size(_ql_cut) > 0 THEN array_join(filter(split(`{text_col}`, '\n'),
        l -> NOT (l rlike '[^\\x20\\x09-\\x0D]' AND array_contains(_ql_cut, {line_hash}))), '\n')
        ELSE `{text_col}` END""")
    return joined.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                         "_ql_counts", F.coalesce(F.size("_ql_cut") > 0, F.lit(False)).alias("_ql_changed"))


def remove_lines(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", min_words=10,
                 max_repeat_percent=20, line_min_documents=20, line_share=0.005, min_left_share=0.2) -> DataFrame:
    """All columns of ``docs`` with the frequent lines cut from the text, one row per document, plus _ql_counts (counts of
    the text before), _ql_removed_words, _ql_failed (verdict of the base rules) and _ql_kept.

    A line is removed if more than ``max(line_min_documents, line_share * documents of the host)`` distinct documents
    of the host have it; a document with less than ``min_left_share`` of its words left is rejected.
    """
    cut = _cut(docs, id_col, text_col, host_col, line_min_documents, line_share)
    n, text = F.col("_ql_counts.n_words"), whole(text_col)
    left = F.when(F.col("_ql_changed"), F.size(words(text)).cast("long")).otherwise(n)
    failed = (n < min_words) | (100 * F.col("_ql_counts.n_repeat_words") > max_repeat_percent * n)
    return cut.withColumn("_ql_removed_words", n - left).withColumn("_ql_failed", failed) \
        .withColumn("_ql_kept", ~failed & (n - F.col("_ql_removed_words") >= min_left_share * n)).drop("_ql_changed")


def apply_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", **rules) -> DataFrame:
    """Counts, verdict of the base rules and verdict after line removal, one row per document; see ``remove_lines``."""
    needed = docs.select(*dict.fromkeys((id_col, text_col, host_col)))
    return remove_lines(needed, id_col, text_col, host_col, **rules).select(
        F.col(id_col).alias("doc_id"), "_ql_counts.*", F.col("_ql_failed").alias("base_failed"),
        F.col("_ql_kept").alias("kept"), F.col("_ql_removed_words").alias("n_removed_words"))
