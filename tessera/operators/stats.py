"""Tensor statistics, perplexity and divergence, directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tensor_statistics(values: DataFrame) -> DataFrame:
    """values(tensor, j, v, count) to total, least, most, mean, sd (population), active share, entropy in bits and its share of the most there can be, share with z over 1.

    Rows of count 0 are left out; v is divided by its count. Two passes: moments, then what needs them."""
    rows = values.where("count <> 0").select("tensor", "j", (F.col("v") / F.col("count")).alias("v"))
    first = rows.groupBy("tensor").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.count_if(F.abs("v") > 1e-5) / F.count(F.lit(1))).alias("active"))
    share = F.when(F.col("total") > 0, F.col("v") / F.col("total"))
    second = rows.join(first, "tensor").groupBy("tensor").agg(
        F.coalesce(-F.sum(F.when(share > 0, share * F.log2(share))), F.lit(0.0)).alias("entropy"), (F.count_if((F.col("sd") > 0) & ((F.col("v") - F.col("mean")) / F.col("sd") > 1)) / F.count(F.lit(1))).alias("z_share")
    )
    return first.join(second, "tensor").withColumn("entropy_share", F.when(F.col("n") > 1, 100 * F.col("entropy") / F.log2(F.col("n").cast("double"))).otherwise(0.0))


def layer_mean(stats: DataFrame, layer: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per layer, layers below 0 left out."""
    return stats.where(F.col(layer) >= 0).groupBy(layer).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("n"))


def previous_layer(rows: DataFrame, layer: str, name: str, vector: str) -> DataFrame:
    """Each tensor's cosine with the tensor of the same name one layer before; null if there is none."""
    from tessera.functions.vector import cosine

    before = rows.select((F.col(layer) + 1).alias(layer), name, F.col(vector).alias("_before"))
    return rows.join(before, [layer, name], "left").select(layer, name, F.when(F.col("_before").isNotNull(), cosine(F.col(vector), F.col("_before"))).alias("cossim"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two files' accumulators, element by element."""
    return a.unionByName(b).groupBy("tensor", "j").agg(F.sum("v").alias("v"), F.sum("count").alias("count"))


def perplexity(rows: DataFrame, nll: str, keys: list[str]) -> DataFrame:
    """Exp of the mean, and its error; the error is null where the variance isn't above 0."""
    var = (F.avg(F.col(nll) * F.col(nll)) - F.avg(nll) * F.avg(nll)) / F.nullif(F.count(nll) - 1, F.lit(0))
    ppl = F.exp(F.avg(nll))
    return rows.groupBy(*keys).agg(F.count(nll).alias("n"), ppl.alias("ppl"), F.when(var > 0, ppl * F.sqrt(var)).alias("error"))


def divergence(pairs: DataFrame) -> DataFrame:
    """pairs(pos, id, p, q, target): one row of mean divergence, perplexities of both and their ratio, correlation of log
    probabilities, percentiles and RMS of the change of the target's p, how often both have the same best id, with errors."""
    per = pairs.groupBy("pos").agg(
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("q")))).alias("kld"), F.max(F.when(F.col("id") == F.col("target"), F.col("p"))).alias("pt"), F.max(F.when(F.col("id") == F.col("target"), F.col("q"))).alias("qt"),
        (F.min_by("id", F.struct(-F.col("p"), F.col("id"))) == F.min_by("id", F.struct(-F.col("q"), F.col("id")))).cast("int").alias("same"),
    )
    d = F.col("qt") - F.col("pt")
    same = F.avg("same")
    return per.agg(
        F.count(F.lit(1)).alias("n"), F.avg("kld").alias("mean_kld"), F.exp(-F.avg(F.ln("pt"))).alias("ppl_p"), F.exp(-F.avg(F.ln("qt"))).alias("ppl_q"), F.exp(F.avg(F.ln("pt")) - F.avg(F.ln("qt"))).alias("ppl_ratio"),
        F.corr(F.ln("pt"), F.ln("qt")).alias("rho"), F.percentile(d, 0.05).alias("dp_p05"), F.percentile(d, 0.5).alias("dp_p50"), F.percentile(d, 0.95).alias("dp_p95"), F.sqrt(F.avg(d * d)).alias("dp_rms"),
        same.alias("same_top"), F.sqrt(same * (1 - same) / (F.count(F.lit(1)) - 1)).alias("same_top_error"),
    )


def nmse(pairs: DataFrame, a: str, b: str, keys: list[str], limit: float = 1e-6) -> DataFrame:
    """A23."""
    error = F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / F.sum(F.col(a) * F.col(a))
    return pairs.groupBy(*keys).agg(error.alias("nmse")).withColumn("passed", F.col("nmse") <= limit)


def mean_direction(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key, of length 1."""
    per = rows.select(key, F.posexplode(vector).alias("j", "v")).groupBy(key, "j").agg(F.avg("v").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    unit = per.withColumn("v", F.when(length > 0, F.col("v") / length).otherwise(0.0))
    return unit.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("direction"))


def principal_direction(rows: DataFrame, vector: str, dim: int, rounds: int = 1000, tolerance: float = 1e-9, limit: int = 4096):
    """The first principal direction, by power iteration on the Gram matrix; the sign is that which makes the largest entry positive.

    Partitions send their dim x dim sums, which are added in a tree of Spark's; only one such matrix comes to the driver, so
    dim is limited."""
    import numpy as np

    if dim > limit:
        raise ValueError(f"dim over {limit}")

    def partial(batches):
        import pyarrow as pa

        gram = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, dim)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(gram.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    gram = np.zeros((dim, dim))
    got = sums.toPandas()
    gram[got["i"], got["j"]] = got["v"]
    x = np.ones(dim) / np.sqrt(dim)
    for _ in range(rounds):
        y = gram @ x
        size = np.linalg.norm(y)
        if size == 0:
            break
        y /= size
        done = np.linalg.norm(y - x) < tolerance
        x = y
        if done:
            break
    return x * np.sign(x[np.abs(x).argmax()])
