"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: source weights share the budget; a source stops at `most_copies` times its size and the excess is shared again.
Within a source a document's expected copies grow with its size: c * k, at most `most_copies`, for a document of k bits'
size (its size class), where c makes the expected words the target. The whole part is certain, the rest p is the
document's inclusion probability for one copy more. Documents of all classes are ranked by Pareto order, random odds
u / (1 - u) over their own inclusion odds p / (1 - p).

The sample's size is fixed in words: the longest run of this order that fits into what the certain copies leave of the
target. What then is left, less than the next step of the order holds, is filled from the documents behind the cut, larger
classes first, each class in the same order as far as it fits. Ranks are cut at steps of 2^-12, so that a histogram by
source, class and step decides all: no rows are sorted, and every document compares its step with its class's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_null_safe, materialise, numbered

#: The words that make up sizes.
WORDS = r"[^\x20\x09-\x0D]+"
#: Steps of ranks.
STEPS = 1 << 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1.0, 2.0, 3.0), most_copies: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources by code point, null last.

    Sources whose cap binds are taken out and the rest is shared anew until no cap binds, by aggregates only."""
    s = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source").cast("binary")], "k")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = materialise(s.withColumn("cap", F.col("source_size") * most_copies), "sources")
    level, bound, budget = None, 0, (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        got = s.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if level is not None and got[0] == bound or not got[2]:
            break
        bound, level = got[0], (budget - float(got[1])) / got[2]
    target = F.col("cap").cast("double") if not got[2] else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def class_rates(by_class: DataFrame, targets: DataFrame, most_copies: int = 3) -> DataFrame:
    """(source, class, source_size, target, sure, p) from words by (source, class): expected copies are sure + p."""
    t = join_null_safe(by_class, targets, ["source"])
    # classes that reach most_copies copies are the largest; c follows from what is left to the others
    above = W.partitionBy("source").orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, 0)
    rest = F.col("target") - most_copies * F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")
    t = t.withColumn("c", F.try_divide(rest, F.sum(F.col("class") * F.col("words")).over(upto).cast("double")))
    t = t.withColumn("fits", (F.col("words") > 0) & (F.col("c") * F.col("class") <= most_copies))
    c = F.max_by(F.when(F.col("fits"), F.col("c")), F.when(F.col("fits"), F.col("class"))).over(W.partitionBy("source"))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(most_copies)), F.coalesce(c, F.lit(float(most_copies))) * F.col("class")))
    t = t.withColumn("rate", rate).withColumn("sure", F.floor("rate"))
    return t.select("source", "class", "words", "source_size", "target", "sure", (F.col("rate") - F.col("sure")).alias("p"))


def _cuts(steps: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, class, cut) from words by (source, class, step): steps below the cut are in the sample."""
    left = rates.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("words")).cast("double")).alias("left"))
    # the run: the last step up to which all classes' words fit
    by_step = steps.groupBy("source", "step").agg(F.sum("words").alias("words"))
    by_step = by_step.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("step")))
    run = join_null_safe(by_step, left, ["source"]).where("upto <= left").groupBy("source").agg((F.max("step") + 1).alias("run"), F.max("upto").alias("taken"))
    left = join_null_safe(left, run, ["source"], "left").select("source", F.coalesce("run", F.lit(0)).alias("run"), (F.col("left") - F.coalesce("taken", F.lit(0))).alias("gap"))
    # the classes behind it, each as far as it fits into what larger ones leave
    behind = join_null_safe(steps, left, ["source"]).where("step >= run")
    upto = F.sum("words").over(W.partitionBy("source", "class").orderBy("step"))
    behind = behind.select("source", "class", "step", "run", "gap", upto.alias("upto")).where("upto <= gap")
    listed = behind.groupBy("source", "class").agg(F.first("run").alias("run"), F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("upto", "step"))).alias("steps"))
    listed = listed.groupBy("source").agg(F.first("gap").alias("gap"), F.reverse(F.array_sort(F.collect_list(F.struct("class", "steps")))).alias("classes"))
    empty = F.array().cast("array<struct<class:int,cut:int>>")

    def fill(state, of):
        last = F.aggregate(of["steps"], F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("step")), lambda a, x: F.when(x["upto"] <= state["gap"], F.struct(x["upto"].alias("upto"), x["step"].alias("step"))).otherwise(a))
        return F.struct((state["gap"] - last["upto"]).alias("gap"), F.concat(state["cuts"], F.array(F.struct(of["class"].alias("class"), (last["step"] + 1).alias("cut")))).alias("cuts"))

    filled = F.aggregate("classes", F.struct(F.col("gap"), empty.alias("cuts")), fill)
    filled = listed.select("source", F.explode(filled["cuts"]).alias("x")).select("source", "x.class", F.col("x.cut").alias("fill"))
    out = join_null_safe(rates.select("source", "class"), left.select("source", "run"), ["source"], "left")
    out = join_null_safe(out, filled, ["source", "class"], "left")
    return out.select("source", "class", F.greatest(F.coalesce("run", F.lit(0)), F.coalesce("fill", F.lit(0))).alias("cut"))


def pareto_mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), most_copies: int = 3, share: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, p, copies, taken) of each row; the mix has `copies` copies of the row.

    p: the row's inclusion probability for the copy beyond the certain ones. carry names further columns of docs to return
    with their rows, as carry0, carry1 and so on, whatever the rows' ids. A source's taken words never pass its target, and
    miss it by less than any document of its smallest class that is left out, where there is one with p > 0.

    Random numbers come from the seed, key and text, so reruns agree; rows equal in both share one, and are taken together
    or not at all. Null text has size 0; documents of size 0 count to the smallest class and get its certain copies only. A
    null source is a source of its own, last in order; a null id is a key like any other. Sources without words have target
    0. Other columns, whatever their names, are ignored; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rand = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
    cols = [F.col(id_col).cast(kind).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), ((rand + 0.5) / float(1 << 52)).alias("u")]
    d = docs.select(*cols, *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    # bits of the size: the length of its binary form
    d = materialise(d.withColumn("class", F.length(F.bin("size"))), "sizes")
    by_class = d.groupBy("source", "class").agg(F.sum("size").alias("words"))
    targets = source_targets(by_class.select("source", F.col("words").alias("size")), weights, most_copies, share)
    rates = materialise(class_rates(by_class, targets, most_copies), "rates")
    d = join_null_safe(d, rates.drop("words"), ["source", "class"])
    # ranks are ordered as the odds' quotient x; x / (1 + x) spreads them over (0, 1)
    x = F.col("u") * (1 - F.col("p"))
    d = d.withColumn("step", F.when((F.col("p") > 0) & (F.col("size") > 0), F.floor(x / (x + F.col("p") * (1 - F.col("u"))) * STEPS)).cast("int"))
    steps = materialise(d.where("step is not null").groupBy("source", "class", "step").agg(F.sum("size").alias("words")), "steps")
    d = join_null_safe(d, materialise(_cuts(steps, rates), "cuts"), ["source", "class"])
    copies = (F.col("sure") + F.coalesce(F.col("step") < F.col("cut"), F.lit(False)).cast("int")).cast("int")
    return d.select("doc_id", "source", "size", "source_size", "target", "p", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(f"carry{k}" for k in range(len(carry))))


def oracle(seed: int = 7) -> str:
    """The query in DuckDB SQL; caps and classes go one by one through recursion."""
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
      (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
    e AS (SELECT *, length(bin(size))::INT AS class FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, (1 + k % 3)::DOUBLE AS weight, source_size * 3 AS cap, (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM s),
    v AS (SELECT 0 AS i, -1::BIGINT AS full_, NULL::DOUBLE AS level
      UNION ALL SELECT v.i + 1, n.full_, n.level FROM v, LATERAL (SELECT count(*) FILTER (v.level * weight > cap) AS full_,
        (any_value(budget) - coalesce(sum(cap) FILTER (v.level * weight > cap), 0)::DOUBLE) / sum(weight) FILTER (NOT coalesce(v.level * weight > cap, false)) AS level FROM w) n
      WHERE n.level IS NOT NULL AND n.full_ > v.full_),
    t AS (SELECT source, source_size, CASE WHEN (SELECT max_by(level, i) FROM v) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT max_by(level, i) FROM v) * weight) END AS target FROM w),
    c AS (SELECT source, class, sum(size)::BIGINT AS words FROM e GROUP BY ALL),
    f AS (SELECT c.source, c.class, c.words, t.source_size, t.target, (t.target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(class * words) OVER (PARTITION BY c.source ORDER BY class ROWS UNBOUNDED PRECEDING))::DOUBLE AS c FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
    g AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE least(3.0, coalesce(max_by(c, class) FILTER (words > 0 AND c * class <= 3) OVER (PARTITION BY source), 3.0) * class) END::DOUBLE AS rate FROM f),
    p AS (SELECT *, floor(rate)::INT AS sure, rate - floor(rate) AS p FROM g),
    j AS (SELECT e.doc_id, e.size, p.*, CASE WHEN p > 0 AND e.size > 0 THEN floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * {STEPS}.0)::INT END AS step FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.class = p.class),
    h AS (SELECT source, class, step, sum(size)::BIGINT AS words FROM j WHERE step IS NOT NULL GROUP BY ALL),
    l AS (SELECT source, any_value(target) - sum(sure * words)::DOUBLE AS rest FROM p GROUP BY source),
    b AS (SELECT source, step, sum(sum(words)) OVER (PARTITION BY source ORDER BY step) AS upto FROM h GROUP BY source, step),
    r AS (SELECT l.source, coalesce(max(b.step) + 1, 0) AS run, any_value(l.rest) - coalesce(max(b.upto), 0) AS gap FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND b.upto <= l.rest GROUP BY l.source),
    a AS (SELECT h.source, h.class, h.step, sum(h.words) OVER (PARTITION BY h.source, h.class ORDER BY h.step) AS upto FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source AND h.step >= r.run),
    z AS (SELECT source, 64 AS class, gap, 0 AS cut FROM r
      UNION ALL SELECT z.source, z.class - 1, z.gap - coalesce(max(a.upto), 0), coalesce(max(a.step) + 1, 0) FROM z LEFT JOIN a ON a.source IS NOT DISTINCT FROM z.source AND a.class = z.class - 1 AND a.upto <= z.gap WHERE z.class > 1 GROUP BY z.source, z.class, z.gap)
    SELECT j.doc_id, j.size, j.source_size, j.target, ((j.sure + coalesce(j.step < greatest(r.run, z.cut), false)::INT) * j.size)::BIGINT AS taken
    FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source JOIN z ON j.source IS NOT DISTINCT FROM z.source AND j.class = z.class"""
