"""Document fingerprints by closed syncmers, in DataFrame expressions only.

A run of ``k`` units is an anchor when the least hash of its ``k - s + 1`` inner runs of
``s`` units is that of the first or of the last. Whether a run is an anchor depends
on nothing outside it, so edits move or remove only the anchors that they touch. Units
are words, in short texts characters; the characters of a very long word are units of
their own, so texts without spaces have runs too. A fingerprint lists the anchors with
their place; two fingerprints are as alike as the share of anchors that
they have in common at nearby places. Two texts are compared in one kind of unit:
where their own kinds differ, one gets the anchors of the other's kind as well.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of at most so many characters have characters as units: (most, k, s).
CHARACTERS = ((40, 3, 1), (400, 8, 3))
#: Longer ones have words: (k, s).
WORDS = (10, 2)
#: A word of more characters is no unit; its characters are.
LONG_WORD = 32
_PLACE_BITS = 24


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inner_runs(units: Column, s: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(units) - (s - 1)), lambda i: F.xxhash64(F.slice(units, i, s)))


def _whole(text: Column) -> Column:
    return F.array(F.shiftleft(F.xxhash64(text), _PLACE_BITS) + F.lit(1).cast("long"))


def _runs(units: Column, k: int, s: int, every: bool) -> Column:
    """Anchors among the runs of ``k`` units; with ``every``, all runs where none is an anchor."""
    inner = k - s + 1
    marks = lambda at, u: F.transform(at, lambda i: F.shiftleft(F.xxhash64(F.slice(u, i, k)), _PLACE_BITS)
                                      + F.least(i, F.lit((1 << _PLACE_BITS) - 1)).cast("long"))
    ends = lambda h, i: F.least(F.element_at(h, i), F.element_at(h, i + inner - 1))
    found = lambda u: _let(_inner_runs(u, s), lambda h: marks(F.filter(
        F.sequence(F.lit(1), F.size(h) - (inner - 1)), lambda i: F.array_min(F.slice(h, i, inner)) == ends(h, i)), u))
    some = lambda u: _let(found(u), lambda x: F.when(F.size(x) > 0, x).otherwise(
        marks(F.sequence(F.lit(1), F.size(u) - (k - 1)), u))) if every else found(u)
    return _let(units, lambda u: F.when(F.size(u) < k, F.array().cast("array<bigint>")).otherwise(some(u)))


def _units(text: Column) -> Column:
    """Words between white space, and the characters of those that are too long for a word."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]{%d}" % (LONG_WORD + 1)), F.flatten(F.transform(words, lambda w: F.when(
        F.char_length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))).otherwise(words)


def anchors_of_kind(text: Column, kind: Column, words: tuple[int, int] = WORDS, characters=CHARACTERS) -> Column:
    """Anchors of a text in order, as ``hash * 2**24 + place``, in the units of one kind.

    ``kind`` is a place in ``characters``, or after its end for words. A text with
    fewer units than a run has none.
    """
    out = _runs(_units(text), *words, every=False)
    for i, (_, k, s) in enumerate(characters):
        out = F.when(kind == i, _runs(F.split(text, ""), k, s, every=True)).otherwise(out)
    return out


def kind_and_anchors(text: Column, words: tuple[int, int] = WORDS, characters=CHARACTERS) -> Column:
    """``(kind, found)``: the kind of unit that a text has for its length, and its anchors; equal texts have equal ones.

    A text without anchors over words has those over characters, and is one anchor as a whole
    when it is shorter than a run of them too.
    """
    last = len(characters)
    kind = F.lit(last)
    for i, (most, _, _) in reversed(list(enumerate(characters))):
        kind = F.when(F.char_length(text) <= most, F.lit(i)).otherwise(kind)

    def named(n: Column, found: Column) -> Column:
        return F.struct(n.alias("kind"), found.alias("found"))

    own = _let(named(kind, anchors_of_kind(text, kind, words, characters)), lambda x: F.when(
        (F.size(x["found"]) > 0) | (x["kind"] < last), x).otherwise(
            named(F.lit(last - 1), anchors_of_kind(text, F.lit(last - 1), words, characters)) if last else x))
    return _let(own, lambda x: F.when(F.size(x["found"]) > 0, x).otherwise(named(x["kind"], _whole(text))))


def anchors(text: Column, words: tuple[int, int] = WORDS, characters=CHARACTERS) -> Column:
    """The anchors of ``kind_and_anchors``."""
    return kind_and_anchors(text, words, characters)["found"]


def likeness_of_texts(a: Column, a_own: Column, b: Column, b_own: Column,
                      words: tuple[int, int] = WORDS, characters=CHARACTERS) -> Column:
    """``likeness`` of two texts, given each one's ``kind_and_anchors``.

    Where the kinds differ, the text of the coarser kind is taken in the finer one's units if it is at
    most twice that kind's limit long, or if the other is above the limit itself (a
    text without words); else the other is taken in the coarser units, which is cheap, as it is short.
    """
    def one_kind(p: Column, coarse: str, fine: str) -> Column:
        kind, limit = p[fine]["kind"], F.lit(0)
        for i, (most, _, _) in enumerate(characters):
            limit = F.when(kind == i, F.lit(most)).otherwise(limit)
        texts = {"a": a, "b": b}
        finer = (F.char_length(texts[coarse]) <= 2 * limit) | (F.char_length(texts[fine]) > limit)
        return F.when(finer, likeness(anchors_of_kind(texts[coarse], kind, words, characters), p[fine]["found"])).otherwise(
            likeness(p[coarse]["found"], anchors_of_kind(texts[fine], p[coarse]["kind"], words, characters)))

    return _let(F.struct(a_own.alias("a"), b_own.alias("b")), lambda p: F.when(
        p["a"]["kind"] == p["b"]["kind"], likeness(p["a"]["found"], p["b"]["found"])).when(
            p["a"]["kind"] > p["b"]["kind"], one_kind(p, "a", "b")).otherwise(one_kind(p, "b", "a")))


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all anchors (0 to 1).

    Anchors are the same when their hash is, and their places lie in the same or
    neighbouring stretches of 4096 units.
    """
    far = lambda x: F.shiftright(x, _PLACE_BITS) * 4096 + F.shiftright(
        x.bitwiseAND((1 << _PLACE_BITS) - 1), 12)
    near = lambda x: F.array(x - 1, x, x + 1)
    return _let(F.struct(F.array_distinct(F.transform(a, far)).alias("a"), F.array_distinct(F.transform(b, far)).alias("b")),
                lambda p: _let(F.size(F.array_intersect(p["a"], F.flatten(F.transform(p["b"], near)))), lambda both: F.least(
                    both / F.greatest(F.size(p["a"]) + F.size(p["b"]) - both, F.lit(1)), F.lit(1.0))))


def fingerprint_text(found: Column) -> Column:
    """The anchors' hashes in order: 8 hex digits each."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.right(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0"), F.lit(8)))), "")


def with_next(docs: DataFrame, doc_id: str, value: Column, first: Column, ranges: int) -> DataFrame:
    """``docs`` with ``_next``, the ``value`` of the next row by id, and ``_after``.

    Ids are dealt in ranges. The last row of a range has no ``_next``; ``_after`` is
    ``first`` of the first row of the next range (after the last: of the first).
    """
    bounds = sorted(set(docs.approxQuantile(doc_id, [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(doc_id))) if bounds else F.lit(0)
    ranged = docs.withColumn("_range", F.coalesce(place, F.lit(0)).cast("int"))
    tie = F.xxhash64(first)
    inside = ranged.withColumn("_next", F.lead(value).over(
        Window.partitionBy("_range").orderBy(F.asc_nulls_first(doc_id), tie)))
    firsts = ranged.groupBy("_range").agg(F.min_by(first, F.struct(
        F.col(doc_id).isNotNull(), F.coalesce(F.col(doc_id), F.lit(0)), tie)).alias("_first"))
    # As many rows as ranges: the first text of the next range, around the end.
    ring = Window.orderBy("_range")
    ends = firsts.select("_range", F.coalesce(F.lead("_first").over(ring), F.first("_first").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return inside.join(ends, "_range")


def fingerprints_of_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          words: tuple[int, int] = WORDS, characters=CHARACTERS, range_rows: int = 5000) -> DataFrame:
    """Per row the fingerprint of its text and of its edited text, and how alike they and the next row's are.

    The edited text has its last quarter (``floor(n_chars / 4)`` characters) replaced by
    the first as many of the next text, by ascending id, null ids first; the last
    row's next is the first. A null text is empty. Rows that repeat an id stand in the order of
    a hash of their texts. A single row is its own next; no rows give none.
    """
    cuts = {"words": words, "characters": characters}
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = max(1, -(-plain.count() // range_rows))
    mine = plain.withColumn("_mine", kind_and_anchors(F.col("text"), **cuts))
    rows = with_next(mine, "doc_id", F.struct(F.col("text").alias("t"), F.col("_mine").alias("m")), F.col("text"), ranges)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    following = F.coalesce(F.col("_next")["t"], F.col("_after"))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "_mine", following.alias("_following"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(following, F.lit(1), cut)).alias("_edited"),
        F.coalesce(F.col("_next")["m"], kind_and_anchors(F.col("_after"), **cuts)).alias("_theirs"))
    rows = rows.withColumn("_changed", kind_and_anchors(F.col("_edited"), **cuts))
    text, edited, after = F.col("text"), F.col("_edited"), F.col("_following")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("_mine")["found"]).alias("fingerprint"),
        fingerprint_text(F.col("_changed")["found"]).alias("edited_fingerprint"),
        likeness_of_texts(text, F.col("_mine"), edited, F.col("_changed"), **cuts).alias("near_edited"),
        likeness_of_texts(text, F.col("_mine"), after, F.col("_theirs"), **cuts).alias("near_next"))
