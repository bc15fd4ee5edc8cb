"""Mix sources to target token counts by entropy balancing.

Among all document rates between 0 and a limit, those nearest to 1 in relative
entropy that meet a source's token target are ``min(limit, exp(lambda * x))``,
x being the document's size over the source's mean size. The dual in lambda is
convex; Newton steps find it from sums that Spark gathers a source, over a
table of distinct sizes that is far smaller than the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, documents, materialise, renamed

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Tokens of the mix over tokens of the corpus.
SHARE = 1.5
#: Most copies of a document, and of a source's tokens.
LIMIT = 2
#: Rows of one size in one source that a single window handles.
BUCKET_ROWS = 512
#: Copies that are gathered before they are added to a source's list, so that a long list is not copied for each.
LIST_PART = 512
#: Newton steps stop when every source is this near its target, relatively.
TOLERANCE = 1e-9
MAX_STEPS = 60


def sizes(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, source, size) and other columns: words of each whole text; a null text has none."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *also)


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT
) -> DataFrame:
    """(source, source_size, target) for each source, null last.

    The targets are the fill level of capped vessels: sources in order of cap
    over weight reach their cap while the level is above it, and the rest share
    what remains by weight. This equals sharing by weight, cutting at the caps
    and sharing the excess again until none is above. One row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull().cast("int"), "source")
    nth = F.array(*[F.lit(w) for w in weights])
    per = per.select(
        "source", "source_size",
        F.get(nth, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).alias("weight"),
    )
    all_rows = Window.partitionBy()
    level = (F.lit(float(limit)) * F.col("source_size")) / F.col("weight")
    filled = Window.orderBy(level, F.col("source").isNull().cast("int"), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "source_size", "weight", level.alias("at"), F.row_number().over(filled).alias("nth"),
        (F.lit(share) * F.sum("source_size").over(all_rows)).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    step = (F.col("total") - F.lit(float(limit)) * F.col("size_before")) / F.col("weight_left")
    per = per.withColumn("step", step)
    # The first source that the level does not reach sets the level for it and all after it.
    final = F.min(
        F.when(F.col("step") < F.col("at"), F.struct("nth", "step"))
    ).over(all_rows)["step"]
    cap = F.lit(float(limit)) * F.col("source_size")
    return per.select(
        "source", "source_size",
        F.when(final.isNull() | (F.col("at") <= final), cap).otherwise(final * F.col("weight")).alias("target"),
    )


def _rate(lam: Column, size: Column, mean: Column, limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def balance(counts: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, lam, mean): the dual solution of each source.

    ``counts`` has (source, size, n) with sizes over 0. Newton steps are kept
    inside a bracket that shrinks around the root, and halve the bracket where a
    step would leave it, so flat stretches of the capped dual do no harm.
    Sources whose target is the cap keep no multiplier: all their rates are the
    limit. The bracket halves at least every other step, so ``MAX_STEPS`` are
    enough for doubles; a source that is not met by then is an error.
    """
    per = counts.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("size").alias("least"),
        (F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("heavy"),
    )
    state = per.join(targets, per.source.eqNullSafe(targets.source)).select(
        per.source, "mean", "target", "source_size", (F.col("least") / F.col("mean")).alias("x0"),
        (F.col("heavy") / F.col("mean")).alias("x1"),
    )
    state = state.where(F.col("target") < F.lit(float(limit)) * F.col("source_size")).select(
        "source", "mean", "target",
        (F.log(F.col("target") / F.col("source_size")) / F.col("x1")).alias("lam"),
        (F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) / F.col("x0") - 1e-6).alias("low"),
        (F.lit(math.log(limit)) / F.col("x0") + 1e-6).alias("high"),
    )
    state = materialise(state, "mix-state")
    for _ in range(MAX_STEPS):
        k = F.col("k.size").cast("double")
        rate = _rate(F.col("s.lam"), k, F.col("s.mean"), limit)
        # The state has a row a source: small, and joined to a table that is itself an aggregate.
        sums = (
            counts.alias("k").join(state.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(
                F.sum(rate * k * F.col("k.n")).alias("got"),
                F.sum(F.when(rate < limit, rate * k * k / F.col("s.mean") * F.col("k.n")).otherwise(0.0)).alias("slope"),
            )
        )
        step = state.alias("s").join(sums.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        off = F.col("t.got") - F.col("s.target")
        low = F.when(off < 0, F.col("s.lam")).otherwise(F.col("s.low"))
        high = F.when(off >= 0, F.col("s.lam")).otherwise(F.col("s.high"))
        newton = F.col("s.lam") - off / F.col("t.slope")
        inside = (F.col("t.slope") > 0) & (newton > low) & (newton < high)
        met = F.abs(off) <= F.lit(TOLERANCE) * F.greatest(F.col("s.target"), F.lit(1.0))
        state = materialise(
            step.select(
                F.col("s.source").alias("source"), "s.mean", "s.target",
                F.when(met, F.col("s.lam")).when(inside, newton).otherwise((low + high) / 2).alias("lam"),
                low.alias("low"), high.alias("high"), met.alias("met"),
            ),
            "mix-state",
        )
        if state.where("NOT met").isEmpty():
            return state.select("source", "lam", "mean")
        state = state.drop("met")
    raise RuntimeError(f"sources not balanced after {MAX_STEPS} steps")


def copies_by_size(rated: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, size, n, buckets, copies): copies that all documents of a size take together.

    From the largest size down, each size takes the copies nearest to its own
    tokens plus what the sizes before it left over. A source's distinct sizes are
    one row here: k of them need k^2 / 2 tokens at least, so they grow with the
    root of the corpus.
    """
    listed = rated.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate", "buckets")), False).alias("sizes"))
    none = F.array().cast("array<bigint>")

    def take(state, x):
        want = x["rate"] * x["n"] * x["size"] + state["carry"]
        k = F.greatest(F.lit(0), F.least(x["n"] * limit, F.round(want / x["size"]).cast("long")))
        full = F.size(state["part"]) >= LIST_PART
        return F.struct(
            (want - k * x["size"]).alias("carry"),
            F.concat(F.when(full, none).otherwise(state["part"]), F.array(k)).alias("part"),
            F.when(full, F.concat(state["out"], F.array(state["part"]))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0.0).alias("carry"), none.alias("part"), F.array().cast("array<array<bigint>>").alias("out"))
    taken = F.aggregate("sizes", start, take, lambda state: F.flatten(F.concat(state["out"], F.array(state["part"]))))
    return listed.select("key", F.inline(F.arrays_zip("sizes", taken.alias("copies")))).select(
        "key", "sizes.size", "sizes.n", "sizes.buckets", "copies"
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
    sized: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``.

    Rates are rounded to copies so that what is left over is carried on to
    smaller documents (``copies_by_size``). Documents of one size get equal
    copies, one more for the first of them in the order of a hash of the id, so
    reruns agree. Documents without words, with null or empty text, take 0
    copies. Null sources are one source, the last. Repeated rows are documents
    of their own; no document gets more than ``limit`` copies. A size that many
    documents of a source share is dealt in buckets of about ``BUCKET_ROWS``.
    ``sized`` may bring (doc_id, source, size, order) of the rows, order telling
    documents of a size apart in place of the hash of the id.
    """
    if sized is None:
        sized = sizes(docs).withColumn("order", F.xxhash64("doc_id", "source"))
    sized = materialise(sized, "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, limit), "mix-targets")
    counts = materialise(
        sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts"
    )
    dual = balance(counts, targets, limit)
    # A null source becomes a key of its own, so that plain equality joins it.
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    k, d = counts.alias("k"), dual.alias("d")
    rated = k.join(d, F.col("k.source").eqNullSafe(F.col("d.source")), "left").select(
        key(F.col("k.source")).alias("key"), "k.size", "k.n",
        F.when(F.col("lam").isNull(), F.lit(float(limit)))
        .otherwise(_rate(F.col("lam"), F.col("size").cast("double"), F.col("mean"), limit)).alias("rate"),
        F.ceil(F.col("k.n") / BUCKET_ROWS).cast("int").alias("buckets"),
    )
    shares = materialise(copies_by_size(rated, limit), "mix-shares")
    # size 0 has no share: its documents stay in bucket 0 and are not ranked.
    placed = (
        sized.select("doc_id", key(F.col("source")).alias("key"), "size", "order")
        .join(shares.select("key", "size", "buckets"), ["key", "size"], "left")
        .withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("order"), F.col("buckets")), F.lit(0)).cast("int"))
        .drop("buckets")
    )
    placed = materialise(placed, "mix-placed")
    parts = placed.where("size > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    along = Window.partitionBy("key", "size").orderBy("bucket")
    upto = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto).join(
        shares.select("key", "size", F.col("n").alias("all"), "copies"), ["key", "size"]
    )
    dealt = F.floor(F.col("upto") * F.col("copies") / F.col("all"))
    before = F.floor((F.col("upto") - F.col("n")) * F.col("copies") / F.col("all"))
    parts = parts.select("key", "size", "bucket", "n", (dealt - before).alias("copies"))
    parts = parts.select(
        "key", "size", "bucket", F.floor(F.col("copies") / F.col("n")).alias("each"),
        F.pmod("copies", "n").alias("extra"),
    )
    turn = Window.partitionBy("key", "size", "bucket").orderBy("order", "doc_id")
    worded = placed.where("size > 0").withColumn("turn", F.row_number().over(turn))
    taken = worded.join(parts, ["key", "size", "bucket"]).select(
        "doc_id", "key", "size",
        F.least(F.col("each") + (F.col("turn") <= F.col("extra")).cast("long"), F.lit(limit)).cast("long").alias("copies"),
    )
    empty = placed.where("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("copies"))
    t = targets.select(key(F.col("source")).alias("key"), "source", "source_size", "target")
    return taken.unionByName(empty).join(t, "key").select(
        "doc_id", "source", "size", "source_size", "target", "copies"
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they are.

    Rows are numbered in a stored table and told apart by that number alone, so
    equal ids, null ids and columns of any type or name are left as they are. In
    a size, rows come in the order of a hash of their content, so reruns agree.
    """
    plain, named = renamed(docs)
    rows = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    hashed = [name for name, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    slim = rows.select(
        F.col("row").alias("doc_id"), F.col(named["source"]).alias("source"), F.col(named["text"]).alias("text"),
        F.xxhash64(*hashed).alias("order"),
    )
    sized = sizes(slim, "order")
    copies = mix(rows, sized=sized).where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    taken = rows.join(copies, "row").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select(*plain.columns).toDF(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each row of ``documents``; null and empty texts 0 times, a null source is the last source."""
    mixed = mix(documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
