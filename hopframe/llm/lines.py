"""Removal of repeated multi-line chunks.

Lines (and, within long lines, sentences) are the units. A rolling hash over the hashes of two neighbouring units chooses
the boundaries: a place is one if its rolling hash is the smallest among ``reach`` places to each side. That depends on
the units nearby alone, so boundaries resist shifts, and chunks have at least ``reach + 1`` units. One row per chunk is
grouped over the whole corpus; a chunk that occurs more than once, inside one text included, is repeated.

Repeats that hold no whole chunk, and the rest of a passage beyond its chunks, are found by runs: the shortest runs of
units that count from and up to every unit. Chunks and runs are grouped by their hash in one pass, and a passage is so
extended over its chunk edges unit by unit.

Documents are numbered in the order of their ids, so a place is one number, and so is the distance of a place from the
first one with its hash. Places of a document at one distance make one range, which is compared with the range that far
before it, unit by unit in bytes; the longest equal runs that count are removed. A unit is therefore removed if and only
if it is part of a run that counts and has occurred at an earlier place.

Only hashes and places are grouped over the whole corpus; texts travel once per range, and once to be cut. Rows of a key
that holds many are spread over several tasks (``look_up``).

Null and empty texts have no chunks and stay as they are. A very long text is one row, cut in time that grows with its
units. A row that equals another in id and text is the same document and gets the same result. Columns beginning with
``_ld_`` are reserved; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm.common import SPACE, whole
from hopframe.session import materialize

# A unit ends with a line break, or with the end of a sentence and a space. The empty rest after the last is none.
UNIT_END = r"(?<=\n)|(?<=[.!?] )"
ENDS = (r"\n", ". ", "! ", "? ")
# Keys with more than one in HOT of all rows are spread over SALTS tasks.
HOT = 1000
SALTS = 64
# Units of a document in which places at the same distance from their first ones are compared together.
WINDOW = 64
# Stands for the length of a unit that counts by itself; more than all that is asked of a run.
ALONE = 1 << 20


def _units() -> str:
    """SQL: the units of _ld_text. Marks after every end are split faster than a pattern looks behind; a text that
    holds the mark itself is split by the pattern."""
    marked = "_ld_text"
    for end in ENDS:
        marked = f"replace({marked}, '{end}', '{end}\\u0001')"
    by_pattern = f"split(_ld_text, '{UNIT_END}', -1)".replace("\\", "\\\\")
    return f"filter(IF(instr(_ld_text, '\\u0001') = 0, split({marked}, '\\u0001', -1), {by_pattern}), u -> u != '')"


UNITS = _units()


def _long_unit(unit: str, min_words: int, min_chars: int, long_chars: int) -> str:
    """SQL: whether a unit counts as a chunk by itself."""
    word, space = SPACE[:-1].replace("[", "[^") + "++", SPACE + "+"
    many = rf"^{SPACE[:-1]}*+(?:{word}{space}){{{min_words - 1}}}{word}".replace("\\", "\\\\")
    return f"(length({unit}) >= {long_chars} OR (length({unit}) >= {min_chars} AND {unit} rlike '{many}'))"


def inlined(array: Column) -> Column:
    """Rows of an array of structs, and a row of nulls for an empty one, to be filtered by the caller.

    The plain generator makes Spark infer a filter on the array's size, which computes the array three times.
    """
    return F.inline_outer(array)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select("*", F.col(id_col).alias("_ld_id"), whole(text_col).alias("_ld_text")) \
        .withColumn("_ld_th", F.xxhash64("_ld_text"))


def unit_table(docs: DataFrame, id_col="doc_id", text_col="text", min_words=20, min_chars=60,
               long_chars=300) -> DataFrame:
    """Per document _ld_id, _ld_th and the arrays ``hashes`` and ``lengths`` of its units, the latter ALONE where a unit
    counts by itself."""
    units = _keyed(docs, id_col, text_col).where(F.length("_ld_text") >= min_chars) \
        .select("_ld_id", "_ld_th", F.expr(UNITS).alias("units"))
    alone = _long_unit("u", min_words, min_chars, long_chars)
    return units.select(
        "_ld_id", "_ld_th", F.expr("transform(units, u -> xxhash64(u))").alias("hashes"),
        F.expr(f"transform(units, u -> IF({alone}, {ALONE}, length(u)))").alias("lengths"))


def numbered(units: DataFrame) -> tuple[DataFrame, int]:
    """_ld_id, _ld_th and ``base`` of every document, and the step between bases.

    Bases ascend by id, then by the text's hash; no document has as many units as a step. So base + unit is the place of
    a unit, and places are in order.
    """
    rows = materialize(units.groupBy("_ld_id", "_ld_th").agg(F.max(F.size("hashes")).alias("n_units"))
                       .orderBy("_ld_id", "_ld_th").withColumn("number", F.monotonically_increasing_id()), "documents")
    # The number of a partition is above these bits, that of its row below; all parts are packed as tightly as they can be.
    part, row = F.shiftright("number", 33), F.col("number").bitwiseAND((1 << 33) - 1)
    most = rows.agg(F.max(part), F.max(row), F.max("n_units")).first()
    part_bits, row_bits, unit_bits = (int(x or 0).bit_length() for x in most)
    if part_bits + row_bits + unit_bits > 62:
        raise ValueError("documents and units are too many to be numbered in 62 bits")
    base = F.shiftleft(F.shiftleft(part, row_bits).bitwiseOR(row), unit_bits)
    return rows.select("_ld_id", "_ld_th", base.alias("base")), 1 << unit_bits


def chunk_table(units: DataFrame, min_chars=60, reach=2) -> DataFrame:
    """One row per content-defined chunk of at least ``min_chars`` characters: the key of its document, s, e, h."""
    keys = [c for c in units.columns if c not in ("hashes", "lengths")]
    # The rolling hash before unit i. A cut has ``reach + 1`` units to each side; of equal hashes the first is the smallest.
    rolling = "transform(hashes, (h, i) -> xxhash64(get(hashes, i - 1), h))"
    least = " AND ".join(f"get(rolling, i) < get(rolling, i - {k}) AND get(rolling, i) <= get(rolling, i + {k})"
                         for k in range(1, reach + 1))
    cuts = f"""concat(array(0), IF(size(hashes) <= {2 * reach + 1}, array(), filter(
        sequence({reach + 1}, greatest(size(hashes) - {reach + 1}, {reach + 1})), i -> {least})), array(size(hashes)))"""
    # Parts of arrays are taken in rows; functions on arrays would copy the whole array for every part.
    chunks = units.withColumn("rolling", F.expr(rolling)).withColumn("cuts", F.expr(cuts)) \
        .select(*keys, "hashes", "lengths", "cuts", F.posexplode_outer("cuts").alias("k", "s")) \
        .withColumn("e", F.expr("get(cuts, k + 1)")).where("e - s >= 2") \
        .select(*keys, "s", "e", F.expr("slice(lengths, s + 1, e - s)").alias("own"),
                F.expr("xxhash64(slice(hashes, s + 1, e - s))").alias("h"))
    enough = f"aggregate(own, 0, (a, x) -> IF(a < {min_chars}, a + x, a)) >= {min_chars}"
    return chunks.select(*keys, inlined(F.expr(f"filter(array(named_struct('s', s, 'e', e, 'h', h)), c -> {enough})"))) \
        .where("h IS NOT NULL")


def run_table(units: DataFrame, min_units=2, min_chars=60) -> DataFrame:
    """One row per shortest run that counts, from and up to every unit: the key of its document, s, e, h.

    A run counts if it has ``min_units`` units and ``min_chars`` characters; a unit may count by itself. The most units
    from or up to ``i`` that have fewer characters are found in halving steps, by the sums of 1, 2, 4... units.
    """
    keys = [c for c in units.columns if c not in ("hashes", "lengths")]
    steps = [1 << k for k in range((min_chars - 1).bit_length())]
    runs, sums = units.withColumnRenamed("lengths", "sum1"), [f"sum{n}" for n in steps]
    for n in steps[:-1]:
        runs = runs.withColumn(f"sum{2 * n}", F.expr(f"transform(sum{n}, (x, i) -> x + get(sum{n}, i + {n}))"))
    runs = runs.select(*keys, "hashes", *sums, F.posexplode("sum1").alias("i", "own"), F.lit(0).alias("after"),
                       F.lit(0).alias("a"), F.lit(0).alias("before"), F.lit(0).alias("b"))
    for n in reversed(steps):
        runs = runs.withColumn("x", F.expr(f"get(sum{n}, i + after)")) \
            .withColumn("y", F.expr(f"get(sum{n}, i - before - {n - 1})")) \
            .withColumn("x", F.expr(f"IF(a + x < {min_chars}, x, NULL)")) \
            .withColumn("y", F.expr(f"IF(b + y < {min_chars}, y, NULL)")) \
            .select(*keys, "hashes", *sums, "i", "own", F.expr(f"after + IF(x IS NULL, 0, {n})").alias("after"),
                    F.expr("a + coalesce(x, 0)").alias("a"), F.expr(f"before + IF(y IS NULL, 0, {n})").alias("before"),
                    F.expr("b + coalesce(y, 0)").alias("b"))
    runs = runs.select(
        *keys, "hashes", "i", F.expr(f"IF(own >= {ALONE}, 1, greatest(after + 1, {min_units}))").alias("n"),
        F.expr(f"greatest(before + 1, {min_units})").alias("m"), "own", "b", "sum1") \
        .withColumn("first", F.expr("get(sum1, i + 1 - m)"))
    # A run up to a unit is its first unit's own, unless that counts sooner.
    sooner = f"own < {ALONE} AND (first >= {ALONE} OR (m > {min_units} AND b - own + first >= {min_chars}))"
    runs = runs.select(*keys, "hashes", inlined(F.expr(f"""array(
        IF(i + n <= size(hashes), named_struct('s', i, 'n', n), NULL),
        IF({sooner}, named_struct('s', i + 1 - m, 'n', m), NULL))"""))).where("n IS NOT NULL")
    return runs.select(*keys, "s", F.expr("s + n").alias("e"), F.expr("xxhash64(slice(hashes, s + 1, n))").alias("h"))


def look_up(rows: DataFrame, keys: DataFrame, key: list[str], spread_by: list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, which have one row per key and the number ``n`` of rows that it has in ``rows``.

    Rows of a key with more than one in ``HOT`` of all rows are spread over ``SALTS`` tasks by a hash of ``spread_by``
    and the key is copied as often. Fewer than ``HOT`` keys are like that, so their list is broadcast.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") * HOT > total
    hot = F.broadcast(keys.where(many).select(*key, F.lit(True).alias("_ld_hot")))
    salted = rows.join(hot, key, "left").withColumn("_ld_salt", F.when(
        F.col("_ld_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_ld_hot")
    copies = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keys.withColumn("_ld_salt", F.explode(copies)).drop("n"), [*key, "_ld_salt"]).drop("_ld_salt")


def later_ranges(places: DataFrame, step: int) -> DataFrame:
    """Ranges of units whose text has an earlier place: base, s, e, first (the earlier place of s).

    ``places`` (base, s, e, h) that follow their first one at the same distance make one range, per document and
    ``WINDOW`` units. Units between them may differ, which is left to the comparison.
    """
    known = materialize(places.groupBy("h").agg(F.count("*").alias("n"), F.min(F.expr("base + s")).alias("first"))
                        .where("n > 1"), "places-repeated")
    # Repeated keys are few and narrow beside the places, which so need no sorting.
    later = look_up(places, known.hint("shuffle_hash"), ["h"], ["base", "s"]).where("base + s > first")
    return later.groupBy("base", F.expr("base + s - first").alias("distance"), F.expr(f"s div {WINDOW}").alias("w")) \
        .agg(F.min("s").alias("s"), F.max("e").alias("e")) \
        .select("base", "s", "e", F.expr("base + s - distance").alias("first"))


def _equal_runs(min_units: int, min_words: int, min_chars: int, long_chars: int) -> str:
    """SQL: array of (s, e), the longest runs that are equal in the arrays ``units`` and ``first`` and count."""
    differ = "filter(sequence(0, size(units) - 1), i -> NOT coalesce(get(units, i) = get(first, i), false))"
    between = f"""zip_with(concat(array(-1), {differ}), concat({differ}, array(size(units))),
        (x, y) -> named_struct('s', x + 1, 'e', y))"""
    counts = f"""r.e - r.s >= {min_units}
        AND length(array_join(slice(units, r.s + 1, r.e - r.s), '')) >= {min_chars}"""
    alone = f"""transform(filter(sequence(0, size(units) - 1), i -> get(units, i) = get(first, i)
        AND {_long_unit("get(units, i)", min_words, min_chars, long_chars)}), i -> named_struct('s', i, 'e', i + 1))"""
    return f"concat(filter({between}, r -> {counts}), {alone})"


def repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text", min_units=2, min_words=20, min_chars=60,
                    long_chars=300, reach=2) -> DataFrame:
    """Ranges of units to remove: _ld_id, _ld_th, s, e; equal in bytes to an earlier place."""
    units = materialize(unit_table(docs, id_col, text_col, min_words, min_chars, long_chars), "units",
                        compression="zstd")
    numbers, step = numbered(units)
    own = "u._ld_id <=> d._ld_id AND u._ld_th = d._ld_th"
    placed = units.alias("u").join(numbers.alias("d"), F.expr(own)).select("base", "hashes", "lengths")
    places = materialize(chunk_table(placed, min_chars, reach).unionByName(run_table(placed, min_units, min_chars)),
                         "places")
    later = materialize(later_ranges(places, step), "ranges")
    first = materialize(later.groupBy("first", F.expr("e - s").alias("size")).agg(F.count("*").alias("n")), "ranges-first")
    asked = later.select("base", "s", "e", "first", F.lit(True).alias("later")).unionByName(
        first.select(F.expr(f"first - first % {step}").alias("base"), F.expr(f"CAST(first % {step} AS int)").alias("s"),
                     F.expr(f"CAST(first % {step} AS int) + size").alias("e"), "first", F.lit(False).alias("later")))
    per_doc = asked.groupBy("base").agg(F.collect_list(F.struct("s", "e", "first", "later")).alias("asked"))
    per_doc = materialize(per_doc.join(numbers, "base").drop("base"), "ranges-asked")
    texts = _keyed(docs, id_col, text_col).select("_ld_id", "_ld_th", "_ld_text").alias("u") \
        .join(per_doc.alias("d"), F.expr(own)) \
        .select("u._ld_id", "u._ld_th", F.expr(UNITS).alias("units"), "asked") \
        .select("_ld_id", "_ld_th", "units", F.inline("asked")) \
        .select("_ld_id", "_ld_th", "s", F.expr("e - s").alias("size"), "first", "later",
                F.expr("slice(units, s + 1, e - s)").alias("units"))
    texts = materialize(texts, "texts", compression="zstd")
    # Repeated rows of one document give the same text more than once.
    key = ["first", "size"]
    earlier = texts.where("NOT later").groupBy(*key).agg(F.first("units").alias("units")).join(first, key)
    earlier = materialize(earlier.withColumnRenamed("units", "earlier"), "texts-first", compression="zstd")
    pairs = look_up(texts.where("later"), earlier, key, ["_ld_id", "s"]) \
        .select("_ld_id", "_ld_th", F.col("s").alias("at"), "units", F.col("earlier").alias("first"))
    # A range whose units are all equal holds a run that counts.
    equal = f"""IF(units = first, array(named_struct('s', 0, 'e', size(units))),
        {_equal_runs(min_units, min_words, min_chars, long_chars)})"""
    return pairs.select("_ld_id", "_ld_th", "at", inlined(F.expr(equal))).where("s IS NOT NULL") \
        .select("_ld_id", "_ld_th", F.expr("at + s").alias("s"), F.expr("at + e").alias("e"))


def _joined_ranges(ranges: DataFrame, touching=True) -> DataFrame:
    """Ranges of a document that overlap, or touch, as one."""
    key = Window.partitionBy("_ld_id", "_ld_th").orderBy("s", "e")
    before = F.max("e").over(key.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("s") > before) if touching else (F.col("s") >= before), F.lit(True))
    return ranges.distinct().withColumn("_ld_fresh", fresh.cast("int")) \
        .withColumn("_ld_range", F.sum("_ld_fresh").over(key.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("_ld_id", "_ld_th", "_ld_range").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", **rules) -> DataFrame:
    """All columns of ``docs`` with repeated chunks cut from the text, plus _ld_removed, the characters removed."""
    removed = _joined_ranges(repeated_chunks(docs, id_col, text_col, **rules)).groupBy("_ld_id", "_ld_th") \
        .agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_ld_cut"))
    removed = materialize(removed, "chunks-removed")
    joined = _keyed(docs, id_col, text_col).alias("d").join(
        removed.alias("r"), F.expr("d._ld_id <=> r._ld_id AND d._ld_th = r._ld_th"), "left") \
        .withColumn("_ld_units", F.expr(f"CASE WHEN _ld_cut IS NOT NULL THEN {UNITS} END"))
    # What lies between two ranges stays.
    left = F.expr(f"""CASE WHEN _ld_cut IS NULL THEN d.`{text_col}` ELSE array_join(flatten(transform(
        sequence(0, size(_ld_cut)), k -> slice(_ld_units, coalesce(get(_ld_cut, k - 1).e, 0) + 1,
            coalesce(get(_ld_cut, k).s, size(_ld_units)) - coalesce(get(_ld_cut, k - 1).e, 0)))), '') END""")
    out = [left.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*out, (F.length("_ld_text") - F.length(left)).alias("_ld_loss")) \
        .withColumn("_ld_removed", F.coalesce("_ld_loss", F.lit(0)).cast("long")).drop("_ld_loss")
