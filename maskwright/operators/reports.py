"""Reports over findings and timings: JSON and text, statistics of runs, agreement of two engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_line(place: Column, entity: Column, masked: Column, score: Column) -> Column:
    """A finding as a line of a report; null parts print as null."""
    return F.format_string("%s  %s  %s  %.2f", place, entity, masked, score)


def json_report(found: DataFrame, *columns: str) -> DataFrame:
    """(place, line): the lines of one JSON value {findings, total}, findings in the order of the columns. Sorted by place and joined by line feeds they are the value, so a report of any size can be written as text; no task holds it whole, and a finding that is repeated however often stays so many rows. Null columns are left out of a finding.

    The least finding is looked up and counted first: it is the one without a comma before it.
    """
    columns = columns or ("line", "entity_type", "value_masked", "score")
    kinds = {c: found.schema[c].dataType for c in columns}
    typed = lambda row: F.struct(*(F.lit(row and row[c]).cast(t).alias(c) for c, t in kinds.items()))
    place = lambda part, at: F.struct(F.lit(part).alias("part"), *(at[c].alias(c) for c in columns)).alias("place")
    entry, spark = F.struct(*columns), found.sparkSession
    least = found.agg(F.min(entry).alias("m")).first()["m"]
    is_least = entry.eqNullSafe(typed(least))
    n, one = found.filter(is_least).count() if least else 0, spark.range(1)
    head = one.select(place(0, typed(None)), F.lit('{"findings": [').alias("line"))
    tail = found.agg(F.count("*").alias("n")).select(place(2, typed(None)), F.format_string('], "total": %d}', "n").alias("line"))
    rest = found.filter(~is_least).select(place(1, entry), F.concat(F.lit(","), F.to_json(entry)).alias("line"))
    # the first line has no comma and sorts before its copies
    firsts = spark.range(n).select(place(1, typed(least)), F.concat(F.when(F.col("id") > 0, ",").otherwise(""), F.to_json(typed(least))).alias("line"))
    return head.unionByName(firsts).unionByName(rest).unionByName(tail)


def group_stats(timed: DataFrame) -> DataFrame:
    """Of (size_class, density, bytes, us): documents, bytes, mean, p50 and p99 microseconds a document (the value at place int(p * (n - 1)) of the sorted ones) and MB a second. Null times don't count among the places."""
    keys = ["size_class", "density"]
    totals = timed.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.avg("us").alias("mean_us"), F.sum("us").alias("_us"))
    placed = quantiles(timed, keys, "us", {"p50_us": 0.5, "p99_us": 0.99})
    met = [totals[k].eqNullSafe(placed[k]) for k in keys]
    return totals.join(placed, met, "left").select(*(totals[k] for k in keys), "docs", "bytes", "mean_us", "p50_us", "p99_us", (F.col("bytes") / F.nullif(F.col("_us"), F.lit(0))).alias("mb_per_sec"))


#: Parts of a range of values that are counted in a pass.
PARTS = 1024


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, a column for each name): the value at place int(p * (n - 1)) of each group's sorted values, exactly. Null values and NaN don't count; null keys are a group. Groups are few, as the driver keeps a range for each.

    A pass counts the values in the parts of each group's range; the part that holds the place, with its least and greatest value, is the next pass's range, until these are equal. Counts are added up where the rows are, so no task sorts or holds a group, however large it is.
    """
    spark, kinds = rows.sparkSession, [rows.schema[k].dataType.simpleString() for k in keys]
    x, names = F.col("_x"), [f"_k{i}" for i in range(len(keys))]
    plain = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("_x")).filter(x.isNotNull() & ~F.isnan(x))
    schema = ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds, strict=True)), "_q string, _at long, _low double, _high double"])
    begun = plain.groupBy(*names).agg(F.count("*"), F.min("_x"), F.max("_x")).collect()
    open_ = [(*g[: len(keys)], q, int(p * (g[-3] - 1)), g[-2], g[-1]) for g in begun for q, p in wanted.items()]
    done: dict[tuple, dict[str, float]] = {tuple(g[: len(keys)]): {} for g in begun}
    while open_:
        for *k, q, _, low, high in open_:
            if low == high:
                done[tuple(k)][q] = low
        open_ = [o for o in open_ if o[-2] != o[-1]]
        if not open_:
            break
        ranges = F.broadcast(spark.createDataFrame(open_, schema).select(*(F.col(n).alias("r" + n) for n in names), "_q", "_low", "_high"))
        # halves, as the difference of two doubles may be none
        width = F.col("_high") / 2 - F.col("_low") / 2
        part = F.when(width > 0, F.least(F.floor((x / 2 - F.col("_low") / 2) / width * PARTS), F.lit(PARTS - 1))).otherwise((x > F.col("_low")).cast("long"))
        inside = plain.join(ranges, [F.col(n).eqNullSafe(F.col("r" + n)) for n in names]).filter(x.between(F.col("_low"), F.col("_high")))
        counted: dict[tuple, list] = {}
        for r in inside.groupBy(*names, "_q", part.alias("_part")).agg(F.count("*"), F.min("_x"), F.max("_x")).collect():
            counted.setdefault(tuple(r[: len(keys) + 1]), []).append(tuple(r[len(keys) + 1 :]))
        following = []
        for *k, q, at, _, _ in open_:
            for _, n, low, high in sorted(counted[(*k, q)]):
                if at < n:
                    following.append((*k, q, at, low, high))
                    break
                at -= n
        open_ = following
    found = [(*k, *(float(v[q]) for q in wanted)) for k, v in done.items()]
    return spark.createDataFrame(found, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), *(f"{q} double" for q in wanted)]))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entity_type, a, b, both): the findings (doc_id, entity_type, start, end) of each engine by type, and those that agree exactly. Repeated findings count once."""
    keys = ["doc_id", "entity_type", "start", "end"]
    one = a.select(*keys).withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(b.select(*keys).withColumns({"a": F.lit(0), "b": F.lit(1)}))
    met = one.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.groupBy("entity_type").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both"))


def speed_table(stats: DataFrame, ours: str, theirs: str) -> DataFrame:
    """(size_class, density, <ours>, <theirs>, speedup) of (engine, size_class, density, mean_us)."""
    wide = stats.groupBy("size_class", "density").pivot("engine", [ours, theirs]).agg(F.first("mean_us"))
    return wide.withColumn("speedup", F.col(theirs) / F.nullif(F.col(ours), F.lit(0)))
