"""Line deduplication by winnowing over line hashes.

Lines that aren't blank are hashed. In every window of RUN consecutive lines the line with the smallest hash is selected,
and so is every long line, which is a window of its own. A selected line is filed once, as a fingerprint with its
position and the windows that it was selected in. Whatever two texts share for RUN lines, or for one long line, they have
a fingerprint of in common. Fingerprints that lie in one place only are dropped with their windows where they lie, by a
bitmap of the others, so that only windows that may repeat are moved; the few it lets through are in one place and drop
out with the join. The positions of the
others are joined with the first position of the same window, and a match is extended both ways, window by window, while
the neighbour's first position is in the same document. Such runs are deleted but for their first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.columns import unused
from rillflow.llm.idfilter import may_be_among
from rillflow.plans.frames import by_shuffle
from rillflow.plans.workspace import discard, materialize

#: A run of so many lines is found wherever it occurs again.
RUN = 2
#: Words that make a line a run by itself.
WORDS = 13


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(text: Column, words: int) -> Column:
    """(at, one, two, long) of the lines that aren't blank.

    That is the line's number, two hashes of it without outer white space, and whether it has ``words`` words.
    """
    lines = F.transform(_lines(text), lambda s, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(s, r"[\x09-\x0D]", " ")).alias("line")))

    def hashed(s: Column) -> Column:
        long = F.size(F.split(s["line"], r"\x20+")) >= words
        return F.struct(s["at"].alias("at"), F.xxhash64(s["line"]).alias("one"), F.xxhash64(F.lit(1), s["line"]).alias("two"), long.alias("long"))

    return F.transform(F.filter(lines, lambda s: s["line"] != ""), hashed)


def fingerprints(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, version, print, windows): the selected lines, each once, and the windows (one, two, at) they stand for.

    ``version`` tells texts with the same id apart, ``one`` and ``two`` are hashes of a window's lines and ``at`` their
    numbers. A text of fewer than ``run`` lines is one window. Windows of long lines alone are left out, as each of
    these lines is found by itself.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), _filled(F.col("text"), words).alias("lines"))
    texts = texts.where(F.size("lines") > 0).withColumn("width", F.least(F.lit(run), F.size("lines")))

    def of(lines: Column, field: str) -> Column:
        return F.transform(lines, lambda s: s[field])

    def window(lines: Column) -> Column:
        return F.struct(F.xxhash64(of(lines, "one")).alias("one"), F.xxhash64(of(lines, "two")).alias("two"), of(lines, "at").alias("at"))

    def at_start(start: Column) -> Column:
        return F.slice("lines", start + 1, F.col("width"))

    def selects(start: Column, place: Column) -> Column:
        """Whether the window from ``start`` has its first smallest hash at ``place``."""
        ones = of(at_start(start), "one")
        return start + F.array_position(ones, F.array_min(ones)) - 1 == place

    def filed(line: Column, place: Column) -> Column:
        starts = F.sequence(F.greatest(place - F.col("width") + 1, F.lit(0)), F.least(place, F.size("lines") - F.col("width")))
        starts = F.filter(starts, lambda s: F.exists(at_start(s), lambda x: ~x["long"]) & selects(s, place))
        alone = F.when(line["long"], F.array(window(F.array(line)))).otherwise(F.array().cast("array<struct<one:bigint,two:bigint,at:array<int>>>"))
        return F.struct(line["one"].alias("print"), F.concat(alone, F.transform(starts, lambda s: window(at_start(s)))).alias("windows"))

    rows = texts.select("doc_id", "version", F.explode(F.filter(F.transform("lines", filed), lambda f: F.size(f["windows"]) > 0)).alias("f"))
    return rows.select("doc_id", "version", "f.print", "f.windows")


def repeated_windows(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, version, at, source_id): the line numbers of every window that occurs earlier, and where it first does.

    Earlier is a smaller doc_id, or the same text further up.
    """
    prints = materialize(fingerprints(docs, run, words), "fingerprints")
    place = F.struct("doc_id", "version", F.col("windows")[0]["at"][0].alias("at"))
    several = prints.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("print")
    several = materialize(several.select(F.col("print").alias("id")), "repeated-prints")
    shared = prints.where(may_be_among(several)(F.col("print"))).select("doc_id", "version", F.explode("windows").alias("w"))
    shared = materialize(shared.select("doc_id", "version", "w.*"), "shared-windows")
    place = F.struct("doc_id", "version", F.col("at")[0].alias("at"))
    firsts = shared.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    firsts = materialize(firsts, "first-places")
    again = shared.join(firsts, ["one", "two"]).where(place > F.col("first"))
    again = materialize(again.select("doc_id", "version", "at", F.col("first.doc_id").alias("source_id")), "repeated-windows")
    discard(prints, several, shared, firsts)
    return again


def repeated_runs(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, version, runs): for each text that repeats lines, the runs (first, last, lines, source_id) in order.

    A run starts as one window and is extended by the next one while that overlaps it and first occurs in the same
    document, so it goes as far as the match with ``source_id`` does both ways. ``lines`` are the numbers to delete.
    """
    windows = repeated_windows(docs, run, words)
    found = windows.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("at", "source_id"))).alias("found"))

    def begins(i: Column) -> Column:
        here, before = F.get("found", i), F.get("found", i - 1)
        apart = (here["source_id"] != before["source_id"]) | (F.element_at(before["at"], -1) < here["at"][0])
        return (i == 0) | apart

    starts = F.filter(F.sequence(F.lit(0), F.size("found") - 1), begins)
    cut = found.withColumn("starts", F.concat(starts, F.array(F.size("found"))))

    def whole(i: Column) -> Column:
        windows_ = F.slice("found", F.get("starts", i) + 1, F.get("starts", i + 1) - F.get("starts", i))
        lines = F.array_distinct(F.flatten(F.transform(windows_, lambda w: w["at"])))
        return F.struct(F.array_min(lines).alias("first"), F.array_max(lines).alias("last"), lines.alias("lines"), windows_[0]["source_id"].alias("source_id"))

    return cut.select("doc_id", "version", F.transform(F.sequence(F.lit(0), F.size("starts") - 2), whole).alias("runs"))


def remove_repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, count: str = "n_removed_lines") -> DataFrame:
    """``docs`` without the lines of runs that occur earlier; text and n_chars are what is left, all other columns kept.

    A run is ``run`` or more consecutive lines, blank ones between them not counted, that are equal but for outer white
    space, or a line of ``words`` or more words, or the whole of a text of fewer than ``run`` lines. It stays where it
    first occurs, by doc_id and place, and goes everywhere else, also further down in the same document; shorter lines
    go in such runs only. A document that loses all its lines stays with an empty text; one without repeated runs is
    unchanged, a null text too. Rows with a null id are unchanged and count as no place. Rows that repeat id and text
    are treated alike and don't count as earlier than each other. Column ``count`` is added, in place of one of that
    name. Only texts that may lose lines are moved, the others pass through where they lie.
    """
    texts = docs.drop(count)
    id_, version, gone, lines = (unused(c, texts) for c in ("run_id", "run_version", "run_gone", "run_lines"))
    runs = repeated_runs(texts, run, words)
    removed = F.array_distinct(F.flatten(F.transform("runs", lambda r: r["lines"])))
    runs = materialize(runs.select(F.col("doc_id").alias(id_), F.col("version").alias(version), removed.alias(gone)), "repeated-lines")
    among = may_be_among(runs.select(F.col(id_).alias("id")))(F.col("doc_id"))
    untouched = texts.where(~among).withColumn(count, F.lit(0))
    joined = texts.where(among).join(by_shuffle(runs), (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(version)), "left")
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), _lines(F.col("text"))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    n = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long")) if "n_chars" in docs.columns else None
    out = joined.withColumns({"text": text, count: F.coalesce(F.size(gone), F.lit(0))} | ({"n_chars": n} if n is not None else {}))
    return untouched.unionAll(out.select(*(F.col(f"`{c}`") for c in texts.columns), count))
