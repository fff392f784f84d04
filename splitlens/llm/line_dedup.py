"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words. Two lines are near if one edit of a word (another word, one more, one less) turns
one into the other; lines of fewer than ``LEAST_WORDS`` words must be equal. A line goes if a line that
is equal or near stands earlier, in order of document id and line number; what was decided for that one does
not matter. Lines without words stay.

Equal lines meet by a 128-bit key of their words and are combined before they are shuffled. For the others:

1. One edit leaves the first or the second half of the shorter line as it is, so near lines share a half,
   named by the shorter length. Lines none of whose halves occur in a different line are done.
2. Each different line left is cut into ``PARTS`` parts, at places that follow from the shorter length: one edit
   falls into one part and leaves all before and after it. Lines that share this with no other are done too. Parts of
   more than ``WIDE`` words are cut again in the same way, so a line of n words emits some log n keys of its length, not n.
3. For the part that is left, a line emits its deletion neighbourhood as hashed keys: (length, place i, words
   without word i) and, for the line that may be the shorter, (length, i, all words). Two lines share a key if
   and only if one edit at that place does it.
4. The least position of a key decides for all its lines; no pair of lines is made but each line with that one, and
   the distance of these two is verified word by word.

``least_words`` may be lowered to 1; what is left to do below it is exact then, too.

Defined results: a null text has no lines and stays null; an empty text is one blank line; a row without id
stays as it is and is no source; rows with the same id and text are judged alike; ties in id and line number
go by a fingerprint of the text; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, flat, place, release, saved

LEAST_WORDS, PARTS, WIDE = 8, 8, 24  # WIDE: words of a part that is cut again
BLANK = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    """The words with a space between. Most lines have single spaces only, which is quicker."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.when(odd, F.regexp_replace(F.btrim(line, F.lit(BLANK)), r"[\x20\x09-\x0D]+", " ")).otherwise(F.btrim(line))


def _half_keys(line: Column, n: Column) -> Column:
    """Both halves of a line, as the shorter (length n) and as the longer line (length n - 1) of a pair."""
    out = []
    for c in (n, n - 1):
        p = F.floor(c / 2).cast("int")
        first, last = (F.call_function("substring_index", line, F.lit(" "), k) for k in (p, p - c))
        out += [F.xxhash64(F.lit(1), c, first), F.xxhash64(F.lit(2), c, last)]
    return F.array(*out)


def _parts(places: DataFrame) -> DataFrame:
    """For each part of the words ``begin`` to ``end`` of a line (``pos``, ``w``, ``n``), as the one of a pair whose shorter line has
    ``shorter`` words: the key of all that stands before and after it, ``part``. A row for each, so that the code of one
    key is all that is generated."""
    each = places.select("pos", "w", "n", "shorter", "begin", (F.col("end") - F.col("begin")).alias("room"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("j"))
    begin, end = ((F.col("begin") + F.floor(F.col("room") * i / PARTS)).cast("int") for i in (F.col("j"), F.col("j") + 1))
    each = each.select("pos", "w", "n", "shorter", begin.alias("begin"), end.alias("end"))
    after = F.col("shorter") - F.col("end")
    key = F.xxhash64(F.lit(7), "shorter", "begin", "end", F.slice("w", F.lit(1), F.col("begin")), F.lit(8), F.slice("w", F.col("n") - after + 1, after))
    return each.select("pos", F.xxhash64(F.lit(3), "w").alias("k1"), key.alias("part"), "shorter", "begin", "end")


def _shared_parts(places: DataFrame) -> DataFrame:
    """The parts of ``places`` whose surroundings another line has, too: ``pos``, ``shorter``, ``begin``, ``end``."""
    parts = saved(_parts(places), "parts")
    shared = saved(parts.groupBy("part").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("part"), "shared-parts")
    return parts.join(shared, "part").select("pos", "shorter", "begin", "end").distinct()


def _neighbourhood(spread: DataFrame) -> DataFrame:
    """Keys of a line (``pos``, ``w``, ``n``) for edits between ``begin`` and ``end``, a row for each: as the longer line
    without word i; as the shorter one (``shorter`` = n) without word i, for another word, and whole, for one more."""
    room, own = F.col("end") - F.col("begin"), F.col("shorter") == F.col("n")
    each = spread.withColumn("v", F.explode(F.sequence(F.lit(0), F.when(own, 2 * room).otherwise(room))))
    each = each.withColumn("whole", own & (F.col("v") >= room)).withColumn("i", F.col("begin") + F.when(F.col("whole"), F.col("v") - room).otherwise(F.col("v")))
    rest = F.when(F.col("whole"), F.col("w")).otherwise(F.concat(F.slice("w", F.lit(1), F.col("i")), F.slice("w", F.col("i") + 2, F.col("n"))))
    each = each.select("pos", F.when(F.col("whole"), F.col("n")).otherwise(F.col("n") - 1).alias("length"), "i", rest.alias("rest"))
    return each.select("pos", F.xxhash64(F.lit(5), "length", "i", "rest").alias("k1"), F.xxhash64(F.lit(6), "length", "i", "rest").alias("k2"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one edit at most makes one array of the other: what stands before the first difference and after it."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.array_position(F.zip_with(short, F.slice(long_, F.lit(1), F.size(short)), lambda x, y: x == y), F.lit(False)).cast("int")
    before = F.when(same == 0, F.size(short)).otherwise(same - 1)
    rest = lambda x, skipped: F.slice(x, before + skipped + 1, F.size(x))
    changed = (F.size(a) == F.size(b)) & (rest(short, 1) == rest(long_, 1))
    return (a == b) | changed | ((F.size(short) + 1 == F.size(long_)) & (rest(short, 0) == rest(long_, 1)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = chosen(docs, doc_id=id_col, text=text_col)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``rk`` (fingerprint of the text) and ``line_no`` of each line that goes."""
    spark = docs.sparkSession
    own = _keyed(docs, id_col, text_col).where("doc_id is not null")
    line = own.select("doc_id", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "rk", "line_no", normal(F.col("line")).alias("line"))
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).alias("n")
    line = line.where("line <> ''").select("doc_id", "rk", "line_no", n, "line")
    keyed = line.select(
        F.struct("doc_id", "line_no", "rk").alias("pos"),
        F.xxhash64(F.lit(3), "line").alias("k1"),
        F.xxhash64(F.lit(4), "line").alias("k2"),
        F.when(F.col("n") >= least_words, _half_keys(F.col("line"), F.col("n"))).alias("halves"),
    )
    lines = saved(keyed, "lines")
    contents = saved(lines.groupBy("k1", "k2").agg(F.min("pos").alias("first"), F.max("pos").alias("last")), "contents")
    twice = saved(contents.where("first < last").select("k1", "k2", "first"), "twice")
    equal = lines.select("pos", "k1", "k2").join(twice, ["k1", "k2"]).where("pos > first").select("pos.*")

    half = lines.select("k1", F.explode("halves").alias("half"))
    met = saved(half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("half"), "halves")
    near = half.join(met, "half").select("k1").distinct()
    near = saved(contents.join(near, "k1").select("first.*"), "near")
    release(spark)

    asked = near.groupBy("doc_id", "rk").agg(F.collect_set("line_no").alias("asked"))
    # merge: the same at every size, whether or not the list would fit a broadcast
    texts = own.join(asked.hint("merge"), ["doc_id", "rk"]).select("doc_id", "rk", F.split("text", "\n").alias("all"), F.explode("asked").alias("line_no"))
    # words as fingerprints; rows with the same id and text come out more than once, with the same positions
    left = saved(texts.select(F.struct("doc_id", "line_no", "rk").alias("pos"), F.transform(F.split(normal(F.get("all", F.col("line_no"))), " "), lambda x: F.xxhash64(x)).alias("w")), "near-lines")
    release(spark)
    left = left.withColumn("n", F.size("w"))
    whole = left.withColumn("shorter", F.explode(F.array(F.col("n"), F.col("n") - 1))).withColumn("begin", F.lit(0)).withColumn("end", F.col("shorter"))
    open_ = _shared_parts(whole)
    room = -(-(left.agg(F.max("n")).first()[0] or 0) // PARTS)
    while room > WIDE:  # long lines: the part that is left is cut again, so that a line emits few keys, whatever its length
        open_ = saved(open_, "open-parts")
        wide = F.col("end") - F.col("begin") > WIDE
        open_ = open_.where(~wide).unionByName(_shared_parts(left.join(open_.where(wide), "pos"))).distinct()
        room = -(-room // PARTS)
    places = open_.groupBy("pos").agg(F.collect_set(F.struct("shorter", "begin", "end")).alias("places"))
    spread = left.join(places, "pos").select("pos", "w", "n", F.explode("places").alias("p")).select("pos", "w", "n", "p.*")
    variants = saved(_neighbourhood(spread), "variants")
    shared = saved(variants.groupBy("k1", "k2").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").select("k1", "k2", "first"), "shared")
    release(spark)
    met = saved(variants.join(shared, ["k1", "k2"]).where("pos > first").select("pos", "first").distinct(), "met-lines")
    one, other = left.select("pos", F.col("w").alias("a")), left.select(F.col("pos").alias("first"), F.col("w").alias("b"))
    close = met.join(one, "pos").join(other, "first").where(_one_edit(F.col("a"), F.col("b"))).select("pos.*")
    return equal.unionByName(close).select("doc_id", "rk", "line_no").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and then ``__n_lines`` and ``__n_removed``. With
    ``drop_emptied``, rows go whose lines with words are all gone."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, least_words=least_words)
    gone = gone.groupBy("doc_id", "rk").agg(F.sort_array(F.collect_list("line_no")).alias("numbers"))
    # a byte for each line up to the last that goes: 1 for those that go
    gaps = F.transform(F.sequence(F.lit(0), F.size("numbers") - 1), lambda k: F.concat(F.repeat(F.lit("0"), F.get("numbers", k) - F.when(k > 0, F.get("numbers", k - 1)).otherwise(-1) - 1), F.lit("1")))
    gone = gone.select("doc_id", "rk", F.size("numbers").alias("gone"), F.array_join(gaps, "").cast("binary").alias("flags"))
    rows, name = flat(docs), place(docs, text_col)
    text, id_ = F.col(name), F.col(place(docs, id_col))
    both = rows.withColumn("mark", F.xxhash64(text)).join(gone, (id_.cast("long") == F.col("doc_id")) & (F.col("mark") == F.col("rk")), "left")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: F.substring("flags", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    out = both.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long")).withColumn("n_removed", F.coalesce("gone", F.lit(0)).cast("long"))
    out = out.withColumn(name, F.when(F.col("gone").isNull(), text).otherwise(kept))
    if drop_emptied:
        out = out.where((F.col("n_removed") == 0) | (F.btrim(text, F.lit(BLANK)) != ""))
    return out.select(*rows.columns, "n_lines", "n_removed").toDF(*docs.columns, "__n_lines", "__n_removed")
