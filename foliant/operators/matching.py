"""Finding texts in texts: exact, by phrase windows, by fuzzy windows, by item ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.measure import round_half_up, utf16_length
from foliant.functions.text import dice, meaningful_words, words
from foliant.operators.pages import span_index

#: Sizes of phrase windows, longest first, and the number of matches after which shorter ones are not tried.
WINDOW_SIZES, ENOUGH = (24, 20, 16, 12), 4

_MATCH = "array<struct<start:int,end:int,words:int>>"


def _exact(page: Column, part: Column) -> Column:
    at = F.instr(page, part) - 1
    return F.struct(at.cast("int").alias("start"), (at + F.char_length(part)).cast("int").alias("end"), F.size(meaningful_words(part)).alias("words"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once; a lambda that mentions an expression computes it at each call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(page: Column, spoken: Column) -> Column:
    """Every window of the spoken words, long sizes first, with its first place in the page; windows not found left out."""

    def of_size(size: int) -> Column:
        last = F.size(spoken) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(size // 2))).otherwise(F.array().cast("array<int>"))
        phrases = F.transform(starts, lambda at: F.array_join(F.slice(spoken, at + 1, size), " "))
        return F.transform(phrases, lambda p: F.struct((F.instr(page, p) - 1).cast("int").alias("start"), F.char_length(p).alias("length"), F.lit(size).alias("words")))

    return F.filter(F.concat(*[of_size(n) for n in WINDOW_SIZES]), lambda w: w["start"] >= 0)


def _chosen(windows: Column) -> Column:
    """Windows in order without overlaps; after a size with enough of them, shorter ones are not taken."""
    seed = F.struct(F.array().cast(_MATCH).alias("found"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def add(acc: Column, w: Column) -> Column:
        end = w["start"] + w["length"]
        full = acc["full"] | ((acc["size"] != w["words"]) & (F.size(acc["found"]) >= ENOUGH))
        clash = F.exists(acc["found"], lambda m: (w["start"] < m["end"]) & (end > m["start"]))
        new = F.array(F.struct(w["start"].alias("start"), end.alias("end"), w["words"].alias("words")))
        return F.struct(F.when(full | clash, acc["found"]).otherwise(F.concat(acc["found"], new)).alias("found"), w["words"].alias("size"), full.alias("full"))

    return F.aggregate(windows, seed, add, lambda acc: F.array_sort(acc["found"]))


def phrase_matches(page_form: Column, part_form: Column) -> Column:
    """Where a text stands in a page, both in match form: once if exactly, else by windows of its longer words.

    array<struct<start, end, words>>, by start; empty if nothing is found.
    """
    none = F.array().cast(_MATCH)
    searched = _bound(meaningful_words(part_form), lambda spoken: _chosen(_windows(page_form, spoken)))
    return F.when(part_form == "", none).when(F.contains(page_form, part_form), F.array(_exact(page_form, part_form)).cast(_MATCH)).otherwise(searched)


def words_needed(confidence: Column, style: Column, focus: bool = False) -> Column:
    """How many words a phrase match needs to be shown, by style and confidence; in focus more, whatever the confidence."""
    if focus:
        return F.when(style == "delta", 20).otherwise(24)
    return F.when(style == "delta", F.greatest(F.lit(12), round_half_up(20 - 8 * confidence))).otherwise(F.lit(18)).cast("int")


def best_window(page_form: Column, part_form: Column) -> Column:
    """The window of the page most alike a text by Dice of its words: struct<score, text>; the first of equals."""
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("text"))

    def search(both: Column) -> Column:
        p, a = both["p"], both["a"]
        size = F.least(F.size(p), F.size(a))
        scored = F.transform(F.sequence(F.lit(0), F.size(p) - size), lambda s: F.struct(dice(a, F.slice(p, s + 1, size)).alias("score"), (-s).alias("back")))
        found = _bound(F.array_max(scored), lambda b: F.struct(b["score"].alias("score"), F.array_join(F.slice(p, 1 - b["back"], size), " ").alias("text")))
        return F.when(size > 0, _bound(found, lambda f: F.when(f["score"] > 0, f).otherwise(nothing))).otherwise(nothing)

    return _bound(F.struct(words(page_form).alias("p"), words(part_form).alias("a")), search)


def resolve_ranges(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """Item ranges checked against the items: ranges (document_id, page, range_no, item_id, start, end).

    status is fragment, missing_span (an empty item) or invalid_item (malformed id, other page, no such
    item, or a stretch outside it).
    """
    number = lambda g: F.when(F.col("item_id").rlike(r"^p[0-9]+i[0-9]+$"), F.regexp_extract("item_id", r"^p([0-9]+)i([0-9]+)$", g)).cast("int")
    spans = span_index(items).join(
        items.select("document_id", "page", "item_no", utf16_length(F.coalesce("normalized_str", F.lit(""))).alias("length")), ["document_id", "page", "item_no"]
    )
    asked = ranges.withColumns({"range_page": number(1), "item_no": number(2)})
    joined = asked.join(spans, ["document_id", "page", "item_no"], "left")
    wrong = F.col("item_no").isNull() | (F.col("range_page") != F.col("page")) | F.col("length").isNull()
    outside = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("length"))
    status = F.when(wrong, "invalid_item").when(F.col("span").isNull(), "missing_span").when(F.coalesce(outside, F.lit(True)), "invalid_item").otherwise("fragment")
    whole = (F.col("start") == 0) & (F.col("end") == F.col("length"))
    return joined.withColumn("status", status).select(
        "document_id", "page", "range_no", "item_id", "status", F.when(F.col("status") == "fragment", F.col("span")).alias("span"), F.when(F.col("status") == "fragment", whole).alias("full_item")
    )


def _inner_pairs(spoken: Column) -> Column:
    """Each two neighbouring words."""
    at = F.when(F.size(spoken) > 1, F.sequence(F.lit(1), F.size(spoken) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.element_at(spoken, i), F.element_at(spoken, i + 1))))


def pages_holding(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """parts (document_id, part, ...) with the pages (document_id, other, whole; one row each) of their document that contain them.

    A part of four words or more has two inner words that stand whole in any page holding it, so those
    two are the join key; only shorter parts meet every page of their document. Pages are met by their
    keys alone and their texts fetched for the pages met.
    """
    spoken = words(F.col("part"))
    marked = parts.withColumn("key", F.when(F.size(spoken) >= 4, F.xxhash64(F.element_at(spoken, 2), F.element_at(spoken, 3))))
    keyed = pages.select("document_id", "other", F.explode(_bound(words(F.col("whole")), _inner_pairs)).alias("key"))
    long = marked.filter("key is not null").join(keyed, ["document_id", "key"]).join(pages, ["document_id", "other"])
    short = marked.filter("key is null").join(pages, "document_id")
    return long.drop("key").unionByName(short.drop("key")).filter(F.contains("whole", "part"))


def like_lines(units: DataFrame, items: DataFrame, least: float = 0.38, most: int = 6) -> DataFrame:
    """For each text the lines of its page that share most of its longer words: units (document_id, page, unit, form), items with form.

    A line counts with at least three longer words of which ``least`` are in the text; the best ``most``, earlier lines first.
    """
    from foliant.operators.segments import first_per

    u = units.select("document_id", "page", "unit", F.array_distinct(meaningful_words(F.col("form"))).alias("want"))
    i = items.select("document_id", "page", "item_no", meaningful_words(F.col("form")).alias("have")).filter(F.size("have") >= 3)
    hits = F.size(F.filter("have", lambda w: F.array_contains(F.col("want"), w)))
    scored = u.join(i, ["document_id", "page"]).select("document_id", "page", "unit", "item_no", (hits / F.size("have").cast("double")).alias("score")).filter(F.col("score") >= least)
    return first_per(scored, most, ["document_id", "page", "unit"], F.col("score").desc(), "item_no")


def raw_place(raw: Column, normalized_at: Column, form) -> Column:
    """The shortest prefix of ``raw`` whose normal form is at least ``normalized_at`` long: the raw offset of a normalized one."""
    sizes = F.sequence(F.lit(0), F.char_length(raw))
    return F.coalesce(F.element_at(F.filter(sizes, lambda n: F.char_length(form(F.left(raw, n))) >= normalized_at), 1), F.char_length(raw))
