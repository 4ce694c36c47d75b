"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of the hashes of all k-word grams, the least of every ``w`` in a row is kept, with
its place. A shared run of ``k + w - 1`` words has a whole window of grams in
common, so the same gram is kept on both sides. Kept grams of documents and
benchmark meet in a join, and each meeting is extended word by word to both
sides; only runs that hold a whole benchmark window count. Items shorter than a
window are looked for with smaller grams, by classes of length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.staging import staged

WINDOW = 13
#: (shortest item, longest item, gram, grams to choose the least from); gram + grams - 1 is the shortest item.
CLASSES = ((13, 1 << 30, 5, 9), (7, 12, 4, 4), (4, 6, 2, 3), (2, 3, 2, 1), (1, 1, 1, 1))
_PLACE_BITS = 28
_MARKS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of digits, letters and everything beyond ASCII, with A-Z as a-z; null gives none."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)),
                      F.array().cast("array<string>"))


def winnowed(words: Column, gram: int, least_of: int) -> Column:
    """Kept grams as ``hash * 2**28 + place`` (from 1): the least of every ``least_of`` grams in a row, leftmost on ties."""
    grams = F.size(words) - (gram - 1)
    one = F.xxhash64 if gram == 1 else None
    valued = F.transform(F.sequence(F.lit(1), grams), lambda i: F.shiftleft(F.shiftright(
        (one(F.element_at(words, i)) if one else F.xxhash64(F.slice(words, i, gram))), _PLACE_BITS), _PLACE_BITS)
        + i.cast("long"))
    none = F.array().cast("array<bigint>")
    if least_of == 1:
        return F.when(grams >= 1, valued).otherwise(none)
    holder = F.array(valued)
    return F.when(grams >= least_of, F.element_at(F.transform(holder, lambda v: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(v) - (least_of - 1)), lambda j: F.array_min(F.slice(v, j, least_of))))), 1)
    ).otherwise(none)


def _mark(kept: Column) -> Column:
    return F.pmod(F.shiftright(kept, _PLACE_BITS), F.lit(_MARKS)).cast("int")


def _run(flags: Column, longest: Column) -> Column:
    """How many flags are true from the first on."""
    miss = F.array_position(flags, False)
    return F.when(longest <= 0, F.lit(0)).when(miss == 0, longest).otherwise(miss.cast("int") - 1)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window (13 words
    in a row, or a shorter item as a whole), ``items`` lists the ids of the items
    with such a window, as sorted strings. Null and empty texts have no words; an
    item without words has no window; an item with a null id counts for the words
    but is not listed. Rows of one id and one text get one result each, the
    same. Without rows in ``benchmark`` nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), plain_words(F.col(item_text)).alias("w")).filter(
        F.size("w") > 0)
    items = staged(items.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("ids")).select(
        F.xxhash64("w").alias("class"), "w", F.size("w").alias("m"), "ids"), "items")
    found = items.agg(*[F.count_if(F.col("m").between(lo, hi)) for lo, hi, _, _ in CLASSES]).first()
    used = [c for c, n in zip(CLASSES, found) if n]
    grams = None
    for n, (lo, hi, gram, least_of) in enumerate(used):
        part = items.filter(F.col("m").between(lo, hi)).select(
            "class", F.lit(n).alias("n"), F.explode(winnowed(F.col("w"), gram, least_of)).alias("kept"))
        grams = part if grams is None else grams.unionByName(part)

    # One byte per value of a small hash says whether the benchmark keeps such a gram: a table of fixed size.
    fields = [F.col("doc_id"), F.col("text_hash"), F.size("w").alias("n_words")]
    near = F.array().cast("array<struct<n:int,hash:bigint,place:int,from:int,words:array<string>>>")
    if used:
        grams = staged(grams, "grams")
        seen = grams.select("n", _mark(F.col("kept")).alias("mark")).distinct().collect()
        parts = []
        for n, (_, _, gram, least_of) in enumerate(used):
            table = bytearray(_MARKS)
            for r in seen:
                if r["n"] == n:
                    table[r["mark"]] = 1
            marks = F.lit(bytes(table))
            place = lambda v: v.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")
            start = lambda v: F.greatest(F.lit(1), place(v) - (WINDOW - 1))
            hits = F.filter(winnowed(F.col("w"), gram, least_of),
                            lambda v: F.substring(marks, _mark(v) + 1, F.lit(1)) == F.lit(b"\x01"))
            parts.append(F.transform(hits, lambda v: F.struct(
                F.lit(n).alias("n"), F.shiftright(v, _PLACE_BITS).alias("hash"), place(v).alias("place"),
                start(v).alias("from"),
                F.slice(F.col("w"), start(v), place(v) - start(v) + gram + WINDOW - 1).alias("words"))))
        near = F.concat(*parts)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), plain_words(F.col(text)).alias("w"))
    rows = staged(rows.select(*fields, near.alias("near")), "winnowed")
    base = rows.select("doc_id", "text_hash", "n_words")
    if not used:
        return base.withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})

    size = F.element_at(F.array(*[F.lit(c[2]) for c in used]), F.col("n") + 1)
    kept = grams.select("class", "n", F.shiftright("kept", _PLACE_BITS).alias("hash"),
                        F.col("kept").bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("at"))
    met = rows.filter(F.size("near") > 0).select("doc_id", "text_hash", F.inline("near")).distinct().join(
        kept, ["n", "hash"]).join(items.select("class", "w", "m"), "class").withColumn("gram", size)
    spot = F.col("place") - F.col("from") + 1  # of the gram, in the words around it
    left = F.least(F.col("at") - 1, spot - 1, WINDOW - F.col("gram"))
    right = F.least(F.col("m") - F.col("at") - F.col("gram") + 1,
                    F.size("words") - spot - F.col("gram") + 1, WINDOW - F.col("gram"))
    same = lambda i, j: F.element_at("words", i) == F.element_at("w", j)
    flags = lambda most, step: F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), step)
    met = met.filter(F.slice("words", spot, F.col("gram")) == F.slice("w", F.col("at"), F.col("gram"))).withColumns({
        "l": F.when(left > 0, _run(flags(left, lambda d: same(spot - d, F.col("at") - d)), left)).otherwise(0),
        "r": F.when(right > 0, _run(flags(right, lambda d: same(
            spot + F.col("gram") - 1 + d, F.col("at") + F.col("gram") - 1 + d)), right)).otherwise(0),
    }).filter(F.col("l") + F.col("gram") + F.col("r") >= F.least(F.lit(WINDOW), F.col("m")))
    runs = met.select("doc_id", "text_hash", "class", (F.col("place") - F.col("l")).alias("a"),
                      (F.col("place") + F.col("gram") - 1 + F.col("r")).alias("b")).distinct()
    words = runs.select("doc_id", "text_hash", F.explode(F.sequence("a", "b")).alias("word")).distinct().groupBy(
        "doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    names = runs.select("doc_id", "text_hash", "class").distinct().join(items.select("class", "ids"), "class").select(
        "doc_id", "text_hash", F.explode_outer("ids").alias("item")).groupBy("doc_id", "text_hash").agg(
            F.array_sort(F.collect_set("item")).alias("items"))
    hits = words.join(names, [words.doc_id.eqNullSafe(names.doc_id), words.text_hash == names.text_hash]).select(
        words.doc_id.alias("d"), words.text_hash.alias("t"), "n_hit", "items")
    return base.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """The rule: some word is hit, and a twentieth of all words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
