"""Benchmark decontamination by template windows, with DataFrame operations alone.

A text becomes words, numbers and names (capitalised words inside a sentence, runs as one); numbers, names and units
after numbers become typed placeholders and words lower case.  Windows of ``WINDOW`` template tokens, half of
them words at least, are hashed.  A capitalised word at the start of a text, sentence, line, quotation or bracket may be a
name or not: windows with one are hashed both ways, and an item is sought with such words as words, then with names there
too (a name of several words at such a start is matched by one of as many).  Documents' windows are hash-joined with those of the benchmark, once for
each distinct template.  An item is found in a document when ``RUN`` of its windows match, or half of them if that
is fewer: different windows of the item, at alignments (document's position less the item's) in one run, whose steps are
``NEAR`` at most.  Then the slots must agree: along one alignment that has so many windows itself, or along a best one of its
run, equal values of the item must stand where equal values of the document stand.  So a copy is found ("exact"), and a
question with other numbers, names or units too ("reparameterised"), but not a text that shares a template by chance.

Items of fewer tokens than a window are one window of their own length; items without words match nothing.  Null
and empty texts match nothing; very long texts are read whole; an empty table gives no rows.  Rows with equal doc_id and text give one result.
Other columns are not read, or are kept by ``keep_clean`` whatever their names.  The benchmark's windows are broadcast while there are ``SMALL`` of them at most,
as are keys of documents that may hold an item; beyond, the joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import stored, unused

WINDOW, RUN, SHARE = 8, 6, 0.5
NEAR = 2 * WINDOW
SMALL = 500_000
#: Units that become a placeholder after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "gram", "grams", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs", "ton", "tons", "tonne", "tonnes",
    "ml", "l", "liter", "liters", "litre", "litres", "cup", "cups", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "usd", "euro", "euros", "eur", "percent", "degree", "degrees", "mph", "kmh", "hz", "khz", "w", "kw", "v", "kb", "mb", "gb",
)
#: A name keeps the space before it, which tells it from a word at the start of a sentence.
TOKEN = r"(?<=[\p{L}\p{N},;:]) \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*|[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
NAME, NUMBER, UNIT = 1, 2, 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def template(words: Column) -> Column:
    """A number for each token: its placeholder's, or a hash of the word."""

    def one(t: Column, i: Column) -> Column:
        low = F.lower(t)
        unit = low.isin(*UNITS) & (i > 0) & _is_number(F.get(words, i - 1))
        return F.when(t.startswith(" "), F.lit(NAME).cast("long")).when(_is_number(t), F.lit(NUMBER).cast("long")).when(unit, F.lit(UNIT).cast("long")).otherwise(F.xxhash64(low))

    return F.transform(words, one)


def named(words: Column, codes: Column) -> Column:
    """codes with names for capitalised words that ``template`` takes for words: names perhaps, with nothing before them that tells."""

    def one(t: Column, c: Column) -> Column:
        low = F.lower(t)
        return F.when((t != low) & (F.length(t) > 1) & (F.substr(t, F.lit(2)) == F.substr(low, F.lit(2))), F.lit(NAME).cast("long")).otherwise(c)

    return F.zip_with(words, codes, one)


def begins(codes: Column, names: Column) -> Column:
    """Places where names differ from codes."""
    return F.filter(F.transform(codes, lambda c, i: F.when(c != F.get(names, i), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def _is_slot(code: Column) -> Column:
    return code.between(NAME, UNIT)


def windows(codes: Column, sizes: list[int], begin: Column | None = None) -> Column:
    """All windows (pos from 0, h, named) of the given sizes; with ``begin``, only those that hold one of its places, as named."""

    def of(size: int) -> Column:
        last = F.size(codes) - size
        if begin is None:
            at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        else:
            at = F.array_distinct(F.flatten(F.transform(begin, lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, last)))))
        at = F.when(last >= 0, at).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), F.slice(codes, i + 1, size)).alias("h"), F.lit(begin is not None).alias("named")))

    got = [of(s) for s in sizes]
    return got[0] if len(got) == 1 else F.concat(*got)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, codes, begin, names (codes with names there), size (of its windows), n_windows and class_id (a hash of the template: item_ids may be null or shared)."""
    rows = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    rows = rows.withColumn("codes", template(F.col("words"))).withColumn("names", named(F.col("words"), F.col("codes")))
    rows = rows.withColumn("begin", begins(F.col("codes"), F.col("names"))).withColumn("class_id", F.xxhash64("codes", "begin"))
    size = F.least(F.size("codes"), F.lit(WINDOW))
    return rows.withColumn("size", size).withColumn("n_windows", F.size("codes") - size + 1)


def _item_windows(made: DataFrame, sizes: list[int]) -> DataFrame:
    """class_id, n_windows, cpos, h and named of each template's windows with enough words."""
    one = made.groupBy("class_id").agg(*(F.first(c).alias(c) for c in ("codes", "names", "begin", "size", "n_windows")))
    parts = None
    for s in sizes:
        for column, begin in (("codes", None), ("names", F.col("begin"))):
            part = one.where(F.col("size") == s).select("class_id", "n_windows", column, F.explode(windows(F.col(column), [s], begin)).alias("w"))
            words = F.size(F.filter(F.slice(column, F.col("w.pos") + 1, s), lambda c: ~_is_slot(c)))
            part = part.where(words * 2 >= s).select("class_id", "n_windows", F.col("w.pos").alias("cpos"), "w.h", "w.named")
            parts = part if parts is None else parts.unionByName(part)
    return parts


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2, 128 bits that stand for doc_id and text."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", F.lit(7), "doc_id"))


def _joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts ``small`` only after its rows were counted."""
    return rows.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """k1, k2, doc_id, item_id, n_windows, matched, n_slots, n_changed and kind for each item found in a document."""
    made = stored(items(benchmark), "items")
    sizes = sorted(r[0] for r in made.select("size").distinct().collect()) or [WINDOW]
    known = stored(_item_windows(made, sizes), "windows")
    rows = _keyed(docs.select("doc_id", "text"))
    # each column is used twice by the next step, so it is computed once for a row and not again within it
    each = rows.select("k1", "k2", tokens(F.col("text")).alias("words")).withColumn("codes", template(F.col("words")))
    each = each.withColumn("names", named(F.col("words"), F.col("codes"))).withColumn("begin", begins(F.col("codes"), F.col("names")))
    each = each.select("k1", "k2", F.explode(F.concat(windows(F.col("codes"), sizes), windows(F.col("names"), sizes, F.col("begin")))).alias("w"))
    each = each.select("k1", "k2", "w.pos", "w.h", F.col("w.named").alias("__named"))
    # windows without names at starts count in both readings, the others in the second
    reading = F.explode(F.when(F.col("named") | F.col("__named"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("reading")
    hits = _joined(each, known, ["h"]).select("k1", "k2", "class_id", "n_windows", "cpos", (F.col("pos") - F.col("cpos")).alias("shift"), reading)
    hits = hits.groupBy("k1", "k2", "class_id", "n_windows", "reading", "shift")
    hits = hits.agg(F.collect_set("cpos").alias("places"))
    # alignments of a document and a template, at most as many as the document has tokens, fall into runs
    order = Window.partitionBy("k1", "k2", "class_id", "reading").orderBy("shift")
    hits = hits.withColumn("step", (F.col("shift") - F.lag("shift").over(order) > NEAR).cast("int")).withColumn("run", F.sum(F.coalesce("step", F.lit(0))).over(order))
    one = F.struct(F.size("places").alias("n"), "shift", F.array_min("places").alias("a"), F.array_max("places").alias("b"))
    runs = hits.groupBy("k1", "k2", "class_id", "n_windows", "reading", "run").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.collect_list(one).alias("ways"))
    least = F.least(F.lit(RUN), F.ceil(F.col("n_windows") * SHARE))
    runs = runs.withColumn("matched", F.size("places").cast("long")).where(F.col("matched") >= least)
    runs = runs.withColumn("enough", F.least(least, F.array_max(F.transform("ways", lambda x: x["n"]))))
    found = runs.select("k1", "k2", "class_id", "reading", "matched", F.explode(F.filter("ways", lambda x: x["n"] >= F.col("enough"))).alias("at"))
    found = stored(found.select("k1", "k2", "class_id", "reading", "matched", "at.n", "at.shift", "at.a", "at.b"), "found")
    texts = _joined(rows, found.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").distinct()
    pairs = _joined(texts.select("k1", "k2", "doc_id", tokens(F.col("text")).alias("theirs")).join(found, ["k1", "k2"]), made, ["class_id"])
    ours = F.sequence(F.col("a"), F.col("b") + F.col("size") - 1)
    read = F.when(F.col("reading") == 1, F.col("names")).otherwise(F.col("codes"))
    slots = F.transform(F.filter(ours, lambda i: _is_slot(F.get(read, i))), lambda i: F.struct(F.lower(F.trim(F.get("words", i))).alias("item"), F.lower(F.trim(F.get("theirs", i + F.col("shift")))).alias("doc")))
    pairs = pairs.withColumn("slots", F.array_distinct(slots))
    agree = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"]))) == F.size("slots")
    changed = F.size(F.filter("slots", lambda s: ~s["item"].eqNullSafe(s["doc"])))
    pairs = pairs.where(agree).withColumn("way", F.struct("matched", "n", -F.col("reading"), -F.col("shift"), F.size("slots").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed")))
    pairs = pairs.groupBy("k1", "k2", "doc_id", "item_id", F.xxhash64("words"), "n_windows").agg(F.max("way").alias("way"))
    return pairs.select(
        "k1", "k2", "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "way.matched",
        "way.n_slots", "way.n_changed", F.when(F.col("way.n_changed") > 0, "reparameterised").otherwise("exact").alias("kind"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found."""
    bad = stored(contaminated(docs, benchmark).select("k1", "k2").distinct(), "leaks")
    names = {k: unused(docs, k) for k in ("k1", "k2")}
    rows = docs.withColumn(names["k1"], F.xxhash64("doc_id", "text")).withColumn(names["k2"], F.xxhash64("text", F.lit(7), "doc_id"))
    return _joined(rows, bad.withColumnsRenamed(names), list(names.values()), "left_anti").drop(*names.values())


def op5_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it; documents without an item are not listed."""
    return contaminated(docs, benchmark).drop("k1", "k2")
