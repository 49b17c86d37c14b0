"""Operator 5, line dedup: a suffix array over line-ID sequences by distributed prefix doubling;
longest-common-prefix intervals reveal repeated line runs, whose later copies are deleted.

Lines are numbered by two 64-bit hashes. Only lines that occur twice or more can lie in a repeated
run, so the sequences are the rows' maximal stretches of such lines with enough words. A suffix's
rank is the number of suffixes that are smaller by their first h lines, FIRST of them to begin with;
each round doubles h: the pairs (rank, rank of the suffix h lines on) of the suffixes that aren't told apart yet are counted
and sorted by range, and running sums of the counts are the new ranks. The rounds end when nothing
is left but suffixes that are the same to their ends.

The lines that a suffix shares with the one before it in the array are counted by comparing blocks
of doubling length, where the lines before both differ; all others share one line less than the
suffix a line above (their sum over the array is what makes this short).

A run qualifies if it has at least min_words words. For every line the shortest qualifying run that
begins there and the shortest that ends there are looked up. Sorted by length and place in the
array, the suffixes that share a run are an interval: a new one begins where fewer lines than the
run's are shared with the suffix before. Runs of all lines of a maximal repeated run cover it
whole, so the later copies of these are the later copies of all maximal repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.plans.ordering import number_rows, running_sum

from ._base import apart, table, text_chunks
from ._words import Texts, covered

#: Words that a repeated run has at least for its later copies to go.
MIN_WORDS = 50
#: Rows with deletions up to which they are broadcast to the documents; above, both are shuffled.
BROADCAST_DOCS = 100_000
#: Lines by which the first round ranks suffixes, before doubling.
FIRST = 8
#: Lines of the first block that two suffixes are compared by.
BLOCK = 64


def _lines(rows: DataFrame) -> DataFrame:
    """row, doc, pos, h1, h2 and words of every line of the rows that have a text."""
    source = rows.select("row", "doc", "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            t = Texts(texts, lower=False)
            first, last, per = t.lines()
            starts = t.words("space")[0]
            owner = pa.array(np.repeat(np.arange(len(texts)), per))
            pos = np.arange(len(first)) - np.repeat(np.cumsum(per) - per, per)
            words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(pos, pa.int32()), *(pa.array(t.hashes(first, last, seed).view(np.int64)) for seed in (0, 1)), pa.array(words, pa.int32())], ["row", "doc", "pos", "h1", "h2", "words"])

    return source.mapInArrow(run, f"row bigint, doc {dict(source.dtypes)['doc']}, pos int, h1 bigint, h2 bigint, words int")


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """seg, row, begin and the ids and words of each stretch of repeated lines that has min_words
    words; seg numbers the stretches in the order of doc (null last), row, begin."""
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.monotonically_increasing_id().alias("id"))
    often = table(often, "lines")
    kept = lines.join(apart(often, "h1", "h2"), ["h1", "h2"])
    rows = kept.groupBy("row", "doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("l"))
    rows = rows.where(F.aggregate("l", F.lit(0), lambda a, x: a + x["words"]) >= min_words)
    each = rows.select("row", "doc", F.col("l.pos").alias("pos"), F.col("l.id").alias("id"), F.col("l.words").alias("words"))
    kind = dict(each.dtypes)["doc"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, begin, ids, words = [], [], [], []
            for k in range(batch.num_rows):
                pos, i, w = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                edges = np.flatnonzero(np.diff(pos, prepend=pos[0] - 2, append=pos[-1] + 2) != 1)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if w[a:b].sum() >= min_words:
                        owner.append(k)
                        begin.append(pos[a])
                        ids.append(i[a:b])
                        words.append(w[a:b])
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(begin, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], ["row", "doc", "begin", "ids", "words"])

    out = each.mapInArrow(cut, f"row bigint, doc {kind}, begin int, ids array<bigint>, words array<int>")
    order = [F.col("doc").asc_nulls_last(), "row", "begin"]
    ordered = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return table(ordered.select(F.monotonically_increasing_id().alias("seg"), "row", "begin", "ids", "words"), "segments")


def _refined(suffixes: DataFrame, more: Column) -> tuple[DataFrame, int]:
    """The suffixes (seg, i, before, rank, next) with new ranks, by (rank, next), and `open`: not told
    apart, with lines left, as `more` says of next; and how many are open."""
    pairs = suffixes.groupBy("rank", "next").agg(F.count("*").alias("n"))
    placed = pairs.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").select(F.spark_partition_id().alias("part"), "rank", "next", "n")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, base = 0, None, 0  # of the rows so far; the last rank and the sum at its first row
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            before = total + np.cumsum(n) - n
            first = np.append(rank[0] != last, rank[1:] != rank[:-1])
            at = np.maximum.accumulate(np.where(first, np.arange(len(rank)), -1))
            bases = np.where(at >= 0, before[at], base)
            total, last, base = int(before[-1] + n[-1]), rank[-1], int(bases[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(bases)], ["part", "rank", "next", "n", "before", "base"])

    summed = table(placed.mapInArrow(sums, f"part int, rank bigint, next {dict(placed.dtypes)['next']}, n bigint, before bigint, base bigint"), "sums")
    # One row a partition: where it begins in the order, and where its first rank does, which may be
    # in partitions before it.
    ends = summed.groupBy("part").agg(F.sum("n").alias("n"), F.min("rank").alias("first"), F.max(F.struct("rank", "base")).alias("last")).orderBy("part").collect()
    offset, rank, base, begins = 0, None, 0, []
    for e in ends:
        first = base if e["first"] == rank else offset
        begins.append((e["part"], offset, e["first"], first))
        base = first if e["last"]["rank"] == e["first"] else offset + e["last"]["base"]
        rank, offset = e["last"]["rank"], offset + e["n"]
    parts = suffixes.sparkSession.createDataFrame(begins, "part int, offset bigint, first bigint, begin bigint")
    sum_ = F.col("offset") + F.col("before")
    new = summed.join(F.broadcast(parts), "part").select("rank", "next", (F.col("rank") + sum_ - F.when(F.col("rank") == F.col("first"), F.col("begin")).otherwise(F.col("offset") + F.col("base"))).alias("new"), "n")
    out = suffixes.join(apart(new, "rank", "next"), ["rank", "next"])
    out = out.select("seg", "i", "before", F.col("new").alias("rank"), ((F.col("n") > 1) & more).alias("open"))
    seen = Observation()
    held = table(out.observe(seen, F.count_if("open").alias("open")), "ranks")
    return held, seen.get["open"]


def suffix_array(segments: DataFrame) -> DataFrame:
    """seg, i, before (the id of the line above, -1 at the top) and at: the suffixes' places, from 1,
    in the order of their lines' ids, then of seg and i."""
    each = segments.select("seg", "ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("i"))
    before = F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.get("ids", F.col("i") - 1))
    each = each.select("seg", "i", before.cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("rank"), F.slice("ids", F.col("i") + 1, FIRST).alias("next"))
    now, n = _refined(each, F.size("next") == FIRST)
    closed, h = None, FIRST
    while n:
        ranked = now if closed is None else closed.unionByName(now)
        ahead = ranked.select("seg", (F.col("i") - h).alias("i"), F.col("rank").alias("next"))
        done = now.where("NOT open")
        closed = done if closed is None else closed.unionByName(done)
        pairs = now.where("open").drop("open").join(ahead, ["seg", "i"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("bigint")))
        now, n = _refined(pairs, F.col("next") >= 0)
        h *= 2
    every = now if closed is None else closed.unionByName(now)
    return number_rows(every.select("seg", "i", "before", "rank"), ["rank", "seg", "i"], "at").select("seg", "i", "before", "at")


def _shared(suffixes: DataFrame, segments: DataFrame) -> DataFrame:
    """seg, i, at and lcp: the lines shared with the suffix before in the array; null where that
    is one less than the lcp of the suffix a line above."""
    above = suffixes.select((F.col("at") + 1).alias("at"), F.col("seg").alias("pseg"), F.col("i").alias("pi"), F.col("before").alias("pbefore"))
    pairs = table(suffixes.join(above, "at", "left"), "neighbours")
    alike = (F.col("before") == F.col("pbefore")) & (F.col("before") >= 0)
    todo = pairs.where(~F.coalesce(alike, F.lit(False)) & F.col("pseg").isNotNull()).select("seg", "i", "pseg", "pi", F.lit(0).alias("lcp"))
    mine, other = segments.select("seg", F.col("ids").alias("a")), segments.select(F.col("seg").alias("pseg"), F.col("ids").alias("b"))
    found, block = None, BLOCK
    while True:
        both = todo.join(mine, "seg").withColumn("a", F.slice("a", F.col("i") + F.col("lcp") + 1, block)).join(other, "pseg").withColumn("b", F.slice("b", F.col("pi") + F.col("lcp") + 1, block))
        differs = F.array_position(F.zip_with("a", "b", lambda a, b: ~a.eqNullSafe(b)), F.lit(True)).cast("int")
        same = F.when(differs > 0, differs - 1).otherwise(F.size("a"))
        seen = Observation()
        both = both.select("seg", "i", "pseg", "pi", (F.col("lcp") + same).alias("lcp"), ((differs == 0) & (F.size("a") == block)).alias("more"))
        both = table(both.observe(seen, F.count_if("more").alias("more")), "shared")
        ended = both.where("NOT more").select("seg", "i", "lcp")
        found = ended if found is None else found.unionByName(ended)
        if not seen.get["more"]:
            break
        todo, block = both.where("more").drop("more"), 2 * block
    rows = pairs.select("seg", "i", "at", F.when(F.col("pseg").isNull(), F.lit(0)).alias("none")).join(found, ["seg", "i"], "left")
    return rows.select("seg", "i", "at", F.coalesce("lcp", "none").alias("lcp"))


def lcp_array(segments: DataFrame) -> DataFrame:
    """seg and, by line, at (places in the suffix array) and lcp (lines shared with the suffix before
    in it): the array by segments."""
    rows = _shared(suffix_array(segments), segments)
    rows = rows.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("i", "at", "lcp"))).alias("l")).select("seg", F.col("l.at").alias("at"), F.col("l.lcp").alias("lcp"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                lcp = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                known, k = ~np.isnan(lcp), np.arange(len(lcp))
                last = np.maximum.accumulate(np.where(known, k, 0))
                out.append(np.maximum(lcp[last] - (k - last), 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["seg", "at", "lcp"])

    return rows.mapInArrow(fill, "seg bigint, at array<bigint>, lcp array<bigint>")


def _windows(segments: DataFrame, min_words: int) -> DataFrame:
    """seg, i, n, at, fresh: of every line the shortest run that begins there and has min_words
    words, and the shortest that ends there; fresh where the suffix before in the array hasn't the
    run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(5)]
            for s, words, at, lcp in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in (1, 2, 3)), strict=True):
                w, at, lcp = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, at, lcp))
                sums = np.append(0, np.cumsum(w))
                end = np.searchsorted(sums, sums[:-1] + min_words)  # the runs [k, end)
                begin = np.searchsorted(sums, sums[1:] - min_words, "right") - 1  # the runs [begin, k]
                k = np.arange(len(w))
                runs = np.concatenate([np.stack([k, end - k])[:, end <= len(w)], np.stack([begin, k + 1 - begin])[:, begin >= 0]], 1)
                i, n = np.unique(runs[:, runs[1] > 0], axis=1)
                for column, x in zip(out, (np.full(len(i), s), i, n, at[i], lcp[i] < n), strict=True):
                    column.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["seg", "i", "n", "at", "fresh"])

    rows = segments.select("seg", "words").join(lcp_array(segments), "seg").select("seg", "words", "at", "lcp")
    return rows.mapInArrow(run, "seg bigint, i bigint, n bigint, at bigint, fresh bigint")


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row and runs (array of first and last line, from 0): the lines of each row (row, doc, text)
    that lie in later copies of repeated line runs of min_words words or more.

    The first copy is the one in the row with the smallest doc (null last; then by row), and in it
    the one furthest up. Copies may overlap. Only rows with such lines are returned.
    """
    segments = _segments(table(_lines(rows), "lines"), min_words)
    placed = number_rows(_windows(segments, min_words), ["n", "at"])
    named = table(running_sum(placed, F.col("fresh"), "interval").select("interval", "seg", "i", "n"), "intervals")
    shared = named.groupBy("interval").agg(F.count("*").alias("size"), F.min(F.struct("seg", "i")).alias("first")).where("size > 1").drop("size")
    later = named.join(apart(shared, "interval"), "interval").where(F.struct("seg", "i") > F.col("first"))
    marked = later.groupBy("seg").agg(F.collect_list(F.struct("i", "n")).alias("w"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for w in batch.column(1):
                i, n = (w.values.field(k).to_numpy() for k in (0, 1))
                hit = np.zeros(int((i + n).max()) + 1, bool)
                for size in np.unique(n).tolist():
                    hit[:-1] |= covered(i[n == size], size, len(hit) - 1)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                runs.append([{"a": x, "b": y - 1} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["seg", "runs"])

    runs = marked.mapInArrow(union, "seg bigint, runs array<struct<a:bigint,b:bigint>>").join(segments.select("seg", "row", "begin"), "seg")
    lines = runs.select("row", F.expr("transform(runs, r -> struct(r.a + begin AS a, r.b + begin AS b))").alias("runs"))
    return table(lines.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs")), "runs")


def _joined(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """docs with the column __runs (null: none). The rows are written with numbers first, so that
    equal rows are rows of their own wherever they are read again."""
    rows = table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    runs = repeated_runs(rows.select(F.col("__row").alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")), min_words).select(F.col("row").alias("__row"), F.col("runs").alias("__runs"))
    size = runs.agg(F.count("*").alias("n"), F.sum(F.size("__runs")).alias("runs")).first()
    if size.n <= BROADCAST_DOCS and (size.runs or 0) <= 4 * BROADCAST_DOCS:
        runs = F.broadcast(runs)
    return rows.join(runs, "__row", "left").drop("__row")


_LEFT = "filter(split(`{0}`, '\n', -1), (l, i) -> NOT exists(__runs, r -> i BETWEEN r.a AND r.b))"


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, without the lines that repeated_runs() finds; documents of which
    no line is left are removed. Null and empty texts, and documents without such lines, stay
    as they are. Of repeated rows one is the first copy. An empty table gives an empty table.
    Columns may have any names but __row and __runs."""
    rows = _joined(docs, min_words, id_col, text_col)
    left = F.expr(_LEFT.format(text_col))
    rows = rows.where(F.col("__runs").isNull() | (F.size(left) > 0))
    return rows.withColumn(text_col, F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(docs.columns)


def line_dedup_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_lines (null text: 0), n_deleted, deleted (runs of deleted
    lines as first-last, from 0, comma-joined), left_sha256 (of the lines left, joined)."""
    rows = _joined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_words, "doc_id", "text")
    n = F.coalesce(F.size(F.split("text", "\n", -1)).cast("bigint"), F.lit(0).cast("bigint"))
    gone = F.coalesce(F.expr("aggregate(__runs, 0L, (s, r) -> s + r.b - r.a + 1)"), F.lit(0).cast("bigint"))
    said = F.coalesce(F.expr("array_join(transform(__runs, r -> concat(r.a, '-', r.b)), ',')"), F.lit(""))
    left = F.when(F.col("__runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.expr(_LEFT.format("text")), "\n"))
    return rows.select("doc_id", F.when(F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(n).alias("n_lines"), gone.alias("n_deleted"), said.alias("deleted"), F.sha2(left.cast("binary"), 256).alias("left_sha256"))
