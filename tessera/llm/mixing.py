"""Mixing sources to target weights.

Words are summed per source; each source gets a repetition rate that brings
it to its target share, and every document is emitted ``floor(rate)`` times
plus one more copy when a uniform number seeded by its id falls below the
fraction. The draw needs no state: any task, on any run, decides alike.

Targets stop at ``CAP`` times a source's size; the excess goes to the other
sources by weight until none is above. With weights w and sizes S that is
``min(CAP * S, level * w)``, and the level follows from a scan of the sources
by S/w - here by repeated sums over the (one row per source) source table.

Nulls: a null source is a source of its own (last in order), a null text has
no words, a null id is drawn by its text. Repeated rows are drawn by id and
occurrence-free hash, so equal rows share one draw. Sources without words get
rate 0 and emit nothing. Extra columns pass through ``mix`` untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.order import with_row_index
from tessera.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
FEW_SOURCES = 50_000
_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    """Words of a text; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def draw(id_col: str = "doc_id", text_col: str = "text", seed: str = SEED):
    """Uniform number in [0, 1) with 52 bits, from the md5 of seed and id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, size): source, source_size, weight, target, rate."""
    ensure_checkpoint_dir(sizes.sparkSession)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark orders strings by their UTF-8 bytes, that is by code point
    ranked = with_row_index(per.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], "i")
    wt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    t = ranked.select("source", "source_size", wt.alias("weight")).checkpoint()
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, done = None, -1
    while True:
        held = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        r = t.agg(F.sum(F.when(held, F.col("source_size"))).alias("s"), F.sum(F.when(~held, F.col("weight"))).alias("w"),
                  F.count(F.when(held, 1)).alias("n")).first()
        if r["n"] == done or not r["w"]:
            break
        done, level = r["n"], (total - cap * (r["s"] or 0)) / r["w"]
    goal = F.least(F.col("weight") * F.lit(float(level or 0.0)), F.lit(float(cap)) * F.col("source_size"))
    t = t.select("source", "source_size", "weight", goal.alias("target"),
                    F.coalesce(F.try_divide(goal, F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))
    return t.checkpoint()


def with_copies(df: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input with ``__mix_size``, ``__mix_source_size``, ``__mix_target`` and ``__mix_copies``
    (how often the mix emits the row)."""
    sized = df.withColumn("__mix_size", n_words(text_col))
    rates = source_rates(sized.select(F.col(source_col).alias("source"), F.col("__mix_size").alias("size")), weights, cap)
    rates = rates.select(F.col("source").alias("__mix_src"), F.col("source_size").alias("__mix_source_size"),
                         F.col("target").alias("__mix_target"), F.col("rate").alias("__mix_rate"))
    # one row per source, counted: broadcast while few; beyond, AQE joins by source and splits hot ones
    side = F.broadcast(rates) if rates.count() <= FEW_SOURCES else rates
    joined = sized.join(side, sized[source_col].eqNullSafe(rates["__mix_src"]))
    whole = F.floor("__mix_rate")
    extra = (draw(id_col, text_col, seed) < F.col("__mix_rate") - whole).cast("int")
    return joined.withColumn("__mix_copies", (whole + extra).cast("int")).drop("__mix_src", "__mix_rate")


def mix(df: DataFrame, **kw) -> DataFrame:
    """Every row as often as the mix emits it; the columns of the input."""
    out = with_copies(df, **kw).filter("__mix_copies > 0")
    return out.withColumn("__mix_c", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
